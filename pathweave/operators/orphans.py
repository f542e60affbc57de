"""References to records that do not exist.

Method: parent and child keys in one long form, tagged; grouped by parent table and key, so that a key's group
holds a flag for "has a row", "was deleted" and "is referred to". Groups lacking the parent, deleted ones and those that
arrived after a child are kept; the children meet them in a join, salted where many refer to one key, and counts go by period.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import KeyKind
from ..runtime import written


#: References to one missing key that go to one task; a key with more is spread over as many copies as it takes.
HOT = 200_000


@dataclass(frozen=True)
class Keyed:
    """A table of records: its name, rows, own key and how keys of the table are spelled."""

    tab: str
    rows: DataFrame
    key: str
    kind: KeyKind
    created: str = "createdAt"
    arrived: str = "arrived_at"


@dataclass(frozen=True)
class Reference:
    """A field of a child table that names a record of a parent table."""

    child: str
    field: str
    parent: str


@dataclass(frozen=True)
class Integrity:
    tables: Sequence[Keyed]
    references: Sequence[Reference]
    removals: DataFrame
    hot: int = HOT

    def _number(self, tab: str) -> int:
        return next(i for i, t in enumerate(self.tables) if t.tab == tab)

    def records(self, t: Keyed) -> DataFrame:
        """(key, first, created, ref_0, ...): one row per record, keys in their short form; copies and versions are merged map-side first.

        Where versions of a record name different targets, the one that arrived last counts.
        """
        refs = [r for r in self.references if r.child == t.tab]
        packed = [self.tables[self._number(r.parent)].kind.pack(F.col(f"`{r.field}`")).alias(f"ref_{i}") for i, r in enumerate(refs)]
        rows = t.rows.select(t.kind.pack(F.col(f"`{t.key}`")).alias("key"), F.col(t.arrived).alias("arrived"), F.col(t.created).alias("created"), *packed).where("key is not null")
        named = F.max_by(F.struct(*[f"ref_{i}" for i in range(len(refs))]), F.struct("arrived", *[f"ref_{i}" for i in range(len(refs))]))
        merged = rows.groupBy("key").agg(F.min("arrived").alias("first"), F.max("created").alias("created"), *([named.alias("refs")] if refs else []))
        return merged.select("key", "first", "created", "refs.*") if refs else merged

    def long_form(self) -> DataFrame:
        """(ptab, key, ref, first, at, rec_key): all keys, tagged; tables and references go by their numbers.

        ref tells the side: -1 a parent's own key (at: created), -2 a removal (at: removed), else the number of the reference, whose record is
        rec_key. Each table is read and merged once; a record gives its own key and one row per reference.
        """
        parts = []
        tiny = lambda n: F.lit(n).cast("tinyint")
        none = F.lit(None)
        for n, t in enumerate(self.tables):
            refs = [(i, r) for i, r in enumerate(self.references) if r.child == t.tab]
            sides = [F.struct(tiny(n).alias("ptab"), F.col("key"), tiny(-1).alias("ref"), F.col("created").alias("at"), none.cast("binary").alias("rec_key"))]
            sides += [F.struct(tiny(self._number(r.parent)).alias("ptab"), F.col(f"ref_{k}").alias("key"), tiny(i).alias("ref"), none.cast("timestamp").alias("at"), F.col("key").alias("rec_key")) for k, (i, r) in enumerate(refs)]
            parts.append(self.records(t).select(F.explode(F.array(*sides)).alias("s"), "first").where("s.key is not null").select("s.ptab", "s.key", "s.ref", "first", "s.at", "s.rec_key"))
            gone = self.removals.where(F.col("tab") == t.tab).select(t.kind.pack(F.col("rec_key")).alias("key"), "removed_at").where("key is not null")
            parts.append(gone.select(tiny(n).alias("ptab"), "key", tiny(-2).alias("ref"), none.cast("timestamp").alias("first"), F.col("removed_at").alias("at"), none.cast("binary").alias("rec_key")))
        return reduce(DataFrame.unionByName, parts)

    @staticmethod
    def keys(long: DataFrame) -> DataFrame:
        """(ptab, key, there, gone, since, wanted, refs): one row per parent table and key."""
        own = F.col("ref") == -1
        k = long.groupBy("ptab", "key").agg(
            F.max(own).alias("there"),
            F.max(F.when(own, F.col("at"))).alias("created"),
            F.max(F.when(F.col("ref") == -2, F.col("at"))).alias("removed"),
            F.max(F.when(own, F.col("first"))).alias("since"),
            F.min(F.when(F.col("ref") >= 0, F.col("first"))).alias("wanted"),
            F.count(F.when(F.col("ref") >= 0, 1)).alias("refs"),
        )
        # listed and not created after: deleted; listed without a row: deleted
        gone = F.col("removed").isNotNull() & (~F.col("there") | F.col("created").isNull() | (F.col("removed") >= F.col("created")))
        return k.select("ptab", "key", "there", gone.alias("gone"), "since", "wanted", "refs")

    def found(self) -> DataFrame:
        """(tab, ym, ref_field, rec_key, reason): one row per record and field.

        reason is ``deleted``, ``missing`` or ``late``; records that are deleted themselves aren't reported. Null, blank and
        all-zero references are none. Copies of a record count once. Empty tables give no rows; a table
        without removals has no deleted records. Other columns are ignored, whatever their names.
        """
        long = written(self.long_form(), "keys")
        # groups lacking their parent, or whose parent is deleted or may be late; and all deleted records
        flawed = written(self.keys(long).where("gone or (wanted is not null and (not there or since > wanted))"), "flawed")
        copies = F.ceil(F.col("refs") / self.hot).cast("int")
        bad = flawed.where("wanted is not null")
        child = long.where("ref >= 0").select("ptab", "key", "ref", "rec_key", "first")
        by = ["ptab", "key"]
        popular = bad.where(F.col("refs") > self.hot).select(*by, copies.alias("copies"))  # at most all references / hot rows
        if not popular.isEmpty():
            bad = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(copies, F.lit(1)) - 1)))
            child = child.join(popular, by, "left").withColumn("salt", F.pmod(F.hash("rec_key"), F.coalesce("copies", F.lit(1)))).drop("copies")
            by.append("salt")
        reason = F.when(F.col("gone"), "deleted").when(~F.col("there"), "missing").when(F.col("since") > F.col("first"), "late")
        hits = child.join(bad, by).select("ref", "rec_key", "first", reason.alias("reason")).where("reason is not null")
        tabs = F.array(*[F.lit(self._number(r.child)).cast("tinyint") for r in self.references])
        dead = flawed.where("gone").select(F.col("ptab").alias("tab"), F.col("key").alias("rec_key"))
        alive = hits.withColumn("tab", F.get(tabs, F.col("ref").cast("int"))).join(dead, ["tab", "rec_key"], "left_anti")
        names, fields = F.array(*[F.lit(t.tab) for t in self.tables]), F.array(*[F.lit(r.field) for r in self.references])
        spelled = reduce(lambda c, n: c.when(F.col("tab") == n, self.tables[n].kind.unpack(F.col("rec_key"))), range(len(self.tables)), F)
        return alive.select(F.get(names, F.col("tab").cast("int")).alias("tab"), F.date_format("first", "yyyy-MM").alias("ym"), F.get(fields, F.col("ref").cast("int")).alias("ref_field"), spelled.alias("rec_key"), "reason")


def per_period(found: DataFrame) -> DataFrame:
    """(tab, ref_field, ym, reason, n): orphan references per table and period."""
    return found.groupBy("tab", "ref_field", "ym", "reason").agg(F.count(F.lit(1)).alias("n"))
