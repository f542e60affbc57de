"""Processing only new or changed records.

Method: a manifest of processed input files with size and checksum. A run anti-joins the listing of the inputs with the
manifest, reads only files that are new or changed, writes its result under a batch identifier and commits the manifest last. The
commit is a numbered file that exactly one of several loaders can create; it names the folders that belong to the batch. A run
that dies before its commit leaves folders that no commit names; a run that is repeated after the commit finds nothing new. Rows that
arrived after the last cut are carried over, so a file counts as processed even if only part of it could be seen.

What was processed last is kept per record in a base of hash buckets and the batches since; a run reads the buckets of its own records
only, and every ``compact_every`` batches these are merged. So a run costs what is new, not what was ever processed.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import KeyKind
from ..runtime import create_once, fs, read_text

#: Files are summed in ranges of so many bytes, each in a task of its own if need be; read in steps.
RANGE, STEP = 64 << 20, 4 << 20
#: Names of new files that are handed to one read, so the driver never holds more.
NAMES = 20_000
#: Records of a bucket of the base, about.
BUCKET_ROWS = 1_000_000

_INDEX = "tab string, rec_key binary, run_no int, changed timestamp, arrived timestamp, vals bigint"
_FILES = "tab string, path string, size bigint, modified timestamp, checksum string, batch string"


class Conflict(RuntimeError):
    """Another loader committed first; nothing of this run counts."""


@dataclass(frozen=True)
class Feed:
    """One input: its folder or file, own key, how keys are spelled, and the columns that say when a row changed."""

    tab: str
    path: str
    key: str
    kind: KeyKind
    changed: Sequence[str] = ("LastChangedAt", "createdAt")
    arrived: str = "arrived_at"


def _wall(time) -> Column:
    return F.lit(str(time)).cast("timestamp_ntz")


def first_run(arrived: Column, cuts: Sequence[tuple[int, object]]) -> Column:
    """The first run, by number, whose cut is not before ``arrived``; null if none. A balanced tree of comparisons.

    Cuts are wall-clock times of the session's time zone, whatever the zone of this process.
    """
    arrived = arrived.cast("timestamp_ntz")
    rising: list[tuple[int, object]] = []
    for run, cut in sorted(cuts):
        if cut is not None and (not rising or cut > rising[-1][1]):
            rising.append((run, cut))  # a run whose cut lies before an earlier one sees nothing first

    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            run, cut = rising[lo]
            return F.when(arrived <= _wall(cut), F.lit(run))
        mid = (lo + hi) // 2
        return F.when(arrived <= _wall(rising[mid][1]), pick(lo, mid)).otherwise(pick(mid + 1, hi))

    return pick(0, len(rising) - 1) if rising else F.lit(None).cast("int")


def _range_sum(path: str, offset: int, length: int) -> bytes:
    """The checksum of a range of a file, read where the task runs."""
    from pyarrow import fs as afs

    if "://" in path and not path.startswith("file:"):
        system, name = afs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    else:
        system, name = afs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    digest = hashlib.sha256()
    with system.open_input_file(name) as f:
        while length > 0:
            block = f.read_at(min(STEP, length), offset)
            if not block:
                break
            digest.update(block)
            offset, length = offset + len(block), length - len(block)
    return digest.digest()


def checksums(files: DataFrame) -> DataFrame:
    """(path, checksum) of files (path, size): SHA-256 over the sums of their ranges, in order. Large files are shared between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [_range_sum(p, o, min(RANGE, n - o)) for p, n, o in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sums, pa.binary())], ["path", "at", "sum"])

    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(RANGE).cast("bigint"))).alias("at"))
    spread = ranges.repartition(files.sparkSession.sparkContext.defaultParallelism, "path", "at")
    summed = spread.mapInArrow(run, "path string, at bigint, sum binary")
    return summed.groupBy("path").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "sum"))), lambda x: F.hex(x["sum"])), "").cast("binary"), 256).alias("checksum"))


class IncrementalLoad:
    """Catches up with all runs not processed yet, in one pass over the new files.

    state_dir lies in storage that all executors share. Each change of a record is given to exactly one run: of
    the rows of a record that a run is the first to see, the newest (by change time, then arrival, then a hash of the values);
    it is processed if the record never was, if it is newer than the row processed last, or of the same time with other values.
    Null change times count as oldest. Rows with a null key or arrival are in no run. Empty inputs give empty batches. Of loaders that
    run at once one commits, the others raise Conflict.

    A file whose name, size and time of change are in the manifest is taken for processed without being read; with ``verify_all`` every listed
    file is summed again. A file that was only touched, so that its sum is known, isn't processed again.
    """

    def __init__(self, spark: SparkSession, state_dir: str, feeds: Sequence[Feed], compact_every: int = 8, verify_all: bool = False):
        self.spark, self.dir, self.feeds = spark, state_dir.rstrip("/"), list(feeds)
        self.compact_every, self.verify_all = compact_every, verify_all

    # commits -------------------------------------------------------------------------------------------------------

    def _numbers(self) -> list[int]:
        """Numbers of the commits, one a batch."""
        system, p = fs(self.spark, f"{self.dir}/commits")
        if not system.exists(p):
            return []
        names = (s.getPath().getName() for s in system.listStatus(p))
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n))

    def _commit(self, n: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.dir}/commits/{n:09d}.json"))

    def _latest(self) -> dict:
        done = self._numbers()
        return self._commit(done[-1]) if done else {"n": 0, "batch": None, "last": 0, "cut": None, "since": [], "carried": [], "manifests": [], "base": None}

    def batches(self) -> list[str]:
        """Identifiers of the committed batches, oldest first; one name per run of the loader, never one per row."""
        return [self._commit(n)["batch"] for n in self._numbers()]

    def manifest(self, state: dict | None = None) -> DataFrame:
        """(tab, path, size, modified, checksum, batch) of all files processed so far."""
        where = (state or self._latest())["manifests"]
        return self.spark.read.schema(_FILES).parquet(*where) if where else self.spark.createDataFrame([], _FILES)

    def listing(self) -> DataFrame:
        """(tab, path, size, modified) of all input files; contents aren't read."""
        out = None
        for f in self.feeds:
            part = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f.path)
            part = part.select(F.lit(f.tab).alias("tab"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).where(F.col("size") > 0)
            out = part if out is None else out.unionByName(part)
        return out

    def pending_files(self, state: dict | None = None) -> DataFrame:
        """Files of the listing that the manifest doesn't have: unknown, or changed by size or checksum, whatever their size."""
        known = self.manifest(state)
        fresh = self.listing()
        if not self.verify_all:
            fresh = fresh.join(known.select("tab", "path", "size", "modified"), ["tab", "path", "size", "modified"], "left_anti")
        summed = fresh.join(checksums(fresh.select("path", "size").distinct()), "path")
        return summed.join(known.select("tab", "path", "size", "checksum"), ["tab", "path", "size", "checksum"], "left_anti").select("tab", "path", "size", "modified", "checksum")

    # rows ----------------------------------------------------------------------------------------------------------

    def _index(self, feed: Feed, paths: Sequence[str], cuts) -> DataFrame:
        """Long form of new files: key, first run, change time, arrival, and a hash of all values but the arrival."""
        rows = self.spark.read.parquet(*[re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in paths])
        vals = [F.col(f"`{c}`") for c in rows.columns if c != feed.arrived]
        return rows.select(
            F.lit(feed.tab).alias("tab"),
            feed.kind.pack(F.col(f"`{feed.key}`")).alias("rec_key"),
            first_run(F.col(f"`{feed.arrived}`"), cuts).alias("run_no"),
            F.coalesce(*[F.col(f"`{c}`") for c in feed.changed]).cast("timestamp").alias("changed"),
            F.col(f"`{feed.arrived}`").cast("timestamp").alias("arrived"),
            # the hash leaves nulls out, so which ones are null goes in as well
            F.xxhash64(*vals, *[c.isNull() for c in vals]).alias("vals"),
        ).where("rec_key is not null and arrived is not null")

    def _write_index(self, files: DataFrame, cuts, path: str) -> None:
        """The index of all files under ``path``, parted into rows that some run sees and rows that none sees yet; files are read once."""

        def put(names: dict[str, list[str]]) -> None:
            parts = [self._index(f, names[f.tab], cuts) for f in self.feeds if names.get(f.tab)]
            if parts:
                reduce(DataFrame.unionByName, parts).withColumn("seen", F.col("run_no").isNotNull()).write.mode("append").partitionBy("seen").parquet(path)

        names: dict[str, list[str]] = {}
        n = 0
        for r in files.select("tab", "path").toLocalIterator(prefetchPartitions=True):
            names.setdefault(r.tab, []).append(r.path)
            n += 1
            if n == NAMES:
                put(names)
                names, n = {}, 0
        put(names)

    @staticmethod
    def fold(candidates: DataFrame) -> DataFrame:
        """Of one row per record and run, those that have to be processed; run 0 is the state left by earlier batches.

        The row processed last before a run is the newest of all before it, and of equally new ones that of the latest run:
        a running maximum. A record has at most one row per run here, however often it was delivered.
        """
        before = Window.partitionBy("tab", "rec_key").orderBy("run_no").rowsBetween(Window.unboundedPreceding, -1)
        rows = candidates.withColumn("last", F.max(F.struct("changed", "run_no", "vals")).over(before))
        newer = (F.col("changed") > F.col("last.changed")) | (F.col("changed").isNotNull() & F.col("last.changed").isNull())
        same = F.col("changed").eqNullSafe(F.col("last.changed")) & (F.col("vals") != F.col("last.vals"))
        return rows.where((F.col("run_no") > 0) & (F.col("last").isNull() | newer | same)).drop("last")

    def committed(self) -> DataFrame:
        """All changes given to runs so far: (tab, rec_key, run_no, changed, arrived, vals)."""
        outs = [self._commit(n)["out"] for n in self._numbers()]
        rows = self.spark.read.schema(_INDEX).parquet(*outs) if outs else self.spark.createDataFrame([], _INDEX)
        spelled = reduce(lambda c, f: c.when(F.col("tab") == f.tab, f.kind.unpack(F.col("rec_key"))), self.feeds, F)
        return rows.withColumn("rec_key", spelled)

    # state ---------------------------------------------------------------------------------------------------------

    @staticmethod
    def _bucket(n: int) -> Column:
        return F.pmod(F.xxhash64("tab", "rec_key"), F.lit(n)).cast("int")

    @staticmethod
    def _last(rows: DataFrame) -> DataFrame:
        """The row processed last of each record."""
        n = rows.groupBy("tab", "rec_key").agg(F.max(F.struct("changed", "run_no", "vals", "arrived")).alias("n"))
        return n.select("tab", "rec_key", "n.run_no", "n.changed", "n.arrived", "n.vals")

    def _state(self, latest: dict, records: DataFrame) -> DataFrame | None:
        """The row processed last of those ``records`` (tab, rec_key) that have one; only their buckets of the base are read."""
        parts = []
        if latest["base"]:
            n = latest["base"]["buckets"]
            wanted = [r[0] for r in records.select(self._bucket(n)).distinct().collect()] if n > 1 else [0]  # at most n numbers
            base = self.spark.read.schema(_INDEX + ", bucket int").parquet(latest["base"]["path"])
            parts.append(base.where(F.col("bucket").isin(wanted)).drop("bucket"))
        if latest["since"]:
            parts.append(self.spark.read.schema(_INDEX).parquet(*latest["since"]))
        if not parts:
            return None
        rows = reduce(DataFrame.unionByName, parts)
        return self._last(rows.join(records, ["tab", "rec_key"], "left_semi")).withColumn("run_no", F.lit(0))

    def _compacted(self, new: dict, home: str) -> dict:
        """The same state with one base, one manifest and one folder of carried rows."""
        parts = [self.spark.read.schema(_INDEX).parquet(*new["since"])]
        if new["base"]:
            parts.append(self.spark.read.schema(_INDEX + ", bucket int").parquet(new["base"]["path"]).drop("bucket"))
        rows = reduce(DataFrame.unionByName, parts)
        n = 1 + rows.count() // BUCKET_ROWS
        self._last(rows).withColumn("bucket", self._bucket(n)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{home}/base")
        out = {**new, "base": {"path": f"{home}/base", "buckets": n}, "since": []}
        if len(new["manifests"]) > 1:
            self.manifest(new).write.mode("overwrite").parquet(f"{home}/manifest")
            out["manifests"] = [f"{home}/manifest"]
        if new["carried"]:
            self._carried(new).write.mode("overwrite").parquet(f"{home}/carried")
            out["carried"] = [f"{home}/carried"]
        return out

    def _carried(self, state: dict) -> DataFrame:
        """Rows of processed files that no run could see until now."""
        rows = self.spark.read.schema(_INDEX).parquet(*state["carried"])
        return rows if state["cut"] is None else rows.where(F.col("arrived").cast("timestamp_ntz") > _wall(state["cut"]))

    def run(self, cuts: Sequence[tuple[int, object]], before_commit: Callable[[], None] | None = None) -> str | None:
        """Processes everything that the runs in ``cuts`` (number, time up to which they see rows) have to; the batch, or None.

        Runs up to the last one of the last batch are done. before_commit lets a test fail at the worst moment.
        """
        latest = self._latest()
        todo = [c for c in cuts if c[0] > latest["last"]]
        if not todo:
            return None
        batch = f"runs-{min(c[0] for c in todo):09d}-{max(c[0] for c in todo):09d}"
        home = f"{self.dir}/data/{batch}-{uuid.uuid4().hex}"  # of this attempt alone
        system, _ = fs(self.spark, home)
        exists = lambda p: system.exists(fs(self.spark, p)[1])
        self.pending_files(latest).withColumn("batch", F.lit(batch)).write.parquet(f"{home}/files")
        files = self.spark.read.schema(_FILES).parquet(f"{home}/files")
        self._write_index(files, todo, f"{home}/index")
        parts = []
        if exists(f"{home}/index/seen=true"):
            parts.append(self.spark.read.schema(_INDEX).parquet(f"{home}/index/seen=true"))
        if latest["carried"]:
            parts.append(self._carried(latest).withColumn("run_no", first_run(F.col("arrived"), todo)).where("run_no is not null"))
        rows = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], _INDEX)
        newest = F.max(F.struct("changed", "arrived", "vals")).alias("n")
        cand = rows.groupBy("tab", "rec_key", "run_no").agg(newest).select("tab", "rec_key", "run_no", "n.*")
        state = self._state(latest, cand.select("tab", "rec_key").distinct())
        if state is not None:
            cand = cand.unionByName(state)
        self.fold(cand).select("tab", "rec_key", "run_no", "changed", "arrived", "vals").write.parquet(f"{home}/out")
        later = [f"{home}/index/seen=false"] if exists(f"{home}/index/seen=false") else []
        seen = [str(c) for _, c in todo if c is not None] + ([latest["cut"]] if latest["cut"] else [])
        new = {
            "n": latest["n"] + 1,
            "batch": batch,
            "last": max(c[0] for c in todo),
            "cut": max(seen, default=None),
            "out": f"{home}/out",
            "since": [*latest["since"], f"{home}/out"],
            "carried": [*latest["carried"], *later],
            "manifests": [*latest["manifests"], f"{home}/files"],
            "base": latest["base"],
        }
        if len(new["since"]) >= self.compact_every:
            new = self._compacted(new, home)
        if before_commit:
            before_commit()
        if not create_once(self.spark, f"{self.dir}/commits/{new['n']:09d}.json", json.dumps(new)):
            raise Conflict(f"batch {batch}: another loader committed number {new['n']} first")
        return batch
