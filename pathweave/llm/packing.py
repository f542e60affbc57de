"""Filling fixed-capacity containers with texts, measured in tokens.

Method: mixture-controlled packing. Each shard of the corpus holds a queue per source. Deficit round-robin over the queues fills one window of
containers after another to the target token proportions; what a source got too little of in one window it gets in the next,
and what it got too little of in the shards before comes in as a deficit from a prefix sum over shards, made good evenly over the windows of the shard, so
proportions hold across partitions as well. Best fit places the largest items of several windows first; of the containers that are full, a choice that keeps the proportions comes out, and
the rest is packed again with the next window. Texts longer than a container fill whole ones, and their rest is an item; the whole ones wait in
the queue of their source and are charged to it like other items.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import written
from .bpe import TOKENIZERS, loaded, shipped, vocabulary


#: Most rows of a shard, on average.
SHARD_ROWS = 300_000
#: Windows of texts that are packed at a time, of which the containers of one come out; free share up to which a container may be among them.
WIDE, GIVE_UP = 4, 0.1


def token_counts(docs: DataFrame, id_col: str, text_col: str, source_col: str, path: str) -> DataFrame:
    """(id, source, tokens): rows don't leave their partition; null and empty texts have no tokens, a null source is its own."""
    types = {f.name: f.dataType.simpleString() for f in docs.select(id_col, source_col).schema}

    words = shipped(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = loaded(path, words.value).encode
        for b in batches:
            n = pa.array([len(encode(t.as_py())) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), n], ["id", "source", "tokens"])

    return docs.select(id_col, text_col, source_col).mapInArrow(run, f"id {types[id_col]}, source {types[source_col]}, tokens bigint")


def fill(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit, largest first: containers as lists of positions in ``sizes``; each size is at most the capacity."""
    boxes: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, box), sorted
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            free, box = room.pop(at)
        else:
            free, box = capacity, len(boxes)
            boxes.append([])
        boxes[box].append(i)
        if free > sizes[i]:
            insort(room, (free - sizes[i], box))
    return boxes


def pack_shard(items: list[tuple], shares: dict, carried: dict, capacity: int, window: int) -> Iterator[tuple[int, list[tuple]]]:
    """(container, [(id, part, start, tokens)]) of one shard; items are (id, source, tokens) in their order.

    A source is owed its share of all tokens of the containers so far and of the next windows, less what it got in containers that are out. Its texts are taken in
    order while they are within that, for WIDE windows, and best fit packs them. Of the containers that are full enough those of one window come out, in an order that keeps the
    mixture near the shares all along; the texts of the others come first again and aren't charged. The last windows of a shard come out whole.
    """
    number = 0
    empty: list[tuple] = []
    lists: dict = defaultdict(list)
    for ident, source, tokens in items:
        whole, rest = divmod(tokens, capacity) if tokens > capacity else (0, tokens)
        lists[source].extend((ident, part, part * capacity, capacity, source) for part in range(whole))
        if rest:
            lists[source].append((ident, whole, whole * capacity, rest, source))
        elif not whole:
            empty.append((ident, 0, 0, 0, source))
    queues = {s: deque(x) for s, x in lists.items() if x}
    if empty and not queues:
        # texts without tokens take no space
        yield 0, [x[:4] for x in empty]
    budget = WIDE * capacity * window
    # what the shards before left is made good evenly over this one, so that no window is far off
    part = min(1.0, capacity * window / max(1, sum(x[3] for q in queues.values() for x in q)))
    repay = {s: part * carried.get(s, 0.0) for s in queues}
    owed = dict.fromkeys(queues, 0.0)
    known = sum(shares.get(s, 0.0) for s in queues)
    target = {s: shares.get(s, 0.0) / known if known else 1 / len(queues) for s in queues}
    ahead = np.zeros(len(target))
    while any(queues.values()):
        live = {s: shares.get(s, 0.0) for s in queues if queues[s]}
        scale = sum(live.values())
        for n, s in enumerate(target):
            owed[s] += repay[s]
            ahead[n] -= repay[s]
        grant = budget - sum(owed[s] for s in live)
        for s in live:
            owed[s] += grant * (live[s] / scale if scale else 1 / len(live))
        taken: list[tuple] = []

        def take(s, x) -> None:
            owed[s] -= x[3]
            taken.append(x)

        for s in sorted(live, key=lambda s: (-owed[s], str(s))):
            while queues[s] and queues[s][0][3] <= owed[s]:
                take(s, queues[s].popleft())
        if not taken:
            s = max(sorted(live, key=str), key=owed.__getitem__)
            take(s, queues[s].popleft())
        boxes = fill([x[3] for x in taken], capacity)
        loads = [sum(taken[i][3] for i in b) for b in boxes]
        last = not any(queues.values())
        order = sorted(range(len(boxes)), key=lambda k: (-loads[k], k))
        fit = order if last else [k for at, k in enumerate(order) if at < window // 2 or capacity - loads[k] <= GIVE_UP * capacity]
        out = []
        for k in _evenly([[taken[i] for i in boxes[k]] for k in fit], target, ahead, len(fit) if last else window):
            out.append(fit[k])
            yield number, [x[:4] for x in (*empty, *(taken[i] for i in boxes[fit[k]]))]
            empty = []
            number += 1
        for k in sorted(set(order) - set(out), reverse=True):
            for i in reversed(boxes[k]):
                owed[taken[i][4]] += taken[i][3]
                queues[taken[i][4]].appendleft(taken[i])


def _evenly(boxes: list[list[tuple]], target: dict, ahead: np.ndarray, most: int) -> Iterator[int]:
    """Positions of at most so many containers in an order that keeps the sum of each source near its share all along; ``ahead`` (by source, changed) is what each has too much."""
    place = {s: i for i, s in enumerate(target)}
    share = np.array(list(target.values()))
    held = np.zeros((len(boxes), len(place)))
    for k, b in enumerate(boxes):
        for x in b:
            held[k, place[x[4]]] += x[3]
    gain = held - held.sum(axis=1, keepdims=True) * share
    left = np.ones(len(boxes), dtype=bool)
    for _ in boxes[:most]:
        k = int(np.where(left, ((ahead + gain) ** 2).sum(axis=1), np.inf).argmin())
        ahead += gain[k]
        left[k] = False
        yield k


def pack(sizes: DataFrame, kind: str, capacity: int, shares: dict | None = None, shard_tokens: int = 8_000_000, window: int = 64) -> DataFrame:
    """(kind, container, id, part, start, tokens): every row of ``sizes`` (id, source, tokens) lies in containers of ``capacity``.

    A text that fits is never split; a longer one fills ``tokens // capacity`` containers of its own, its rest is packed like others. All parts count for the mixture of the windows. Texts
    without tokens are placed and take no space. Repeated rows are packed as often as they come; a null id stays null. shares: target token
    proportions by source, by default those of the corpus; sources without a share come when the others have run out. An empty
    table gives no containers. Shards hold about ``shard_tokens`` tokens, or SHARD_ROWS rows if these are short;
    a column ``pos`` that is fixed for a row, if there is one, spreads rows that are alike over shards.
    """
    if capacity < 1:
        raise ValueError("a container needs room for a token")
    sized = sizes.select("id", "source", "tokens", F.col("pos") if "pos" in sizes.columns else F.lit(0).alias("pos"))
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    shards = max(1, -(-total.t // shard_tokens), -(-total.n // SHARD_ROWS))
    sharded = sized.withColumn("shard", F.pmod(F.xxhash64("id", "source", "tokens", "pos"), F.lit(shards)).cast("long"))
    mine = sharded.groupBy("shard", "source").agg(F.sum("tokens").alias("own"))
    if shares is None:
        target = sized.groupBy("source").agg((F.sum("tokens") / F.lit(max(1, total.t))).alias("share"))
    else:
        named = [(k, float(v)) for k, v in shares.items()]
        target = sizes.sparkSession.createDataFrame(named, f"source {sizes.schema['source'].dataType.simpleString()}, share double")
    # what each source should have got in the shards before, less what it got
    tot = mine.groupBy("shard").agg(F.sum("own").alias("all"))
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    debts = mine.join(tot, "shard").join(target, mine["source"].eqNullSafe(target["source"]), "left").select(
        mine["shard"], mine["source"], F.coalesce("share", F.lit(0.0)).alias("share"), "own", "all"
    )
    debts = debts.withColumn("carried", F.coalesce(F.sum(F.col("share") * F.col("all") - F.col("own")).over(before), F.lit(0.0)))
    one = F.lit(None)
    rows = sharded.select("shard", "id", "source", "tokens", one.cast("double").alias("share"), one.cast("double").alias("carried")).unionByName(
        debts.select("shard", one.cast(sized.schema["id"].dataType).alias("id"), "source", F.lit(-1).cast("long").alias("tokens"), "share", "carried")
    )
    id_type = sized.schema["id"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        lead = group[group["tokens"] < 0]
        name = lambda s: s if isinstance(s, str) or s == s else None
        share = {name(s): v for s, v in zip(lead["source"], lead["share"])}
        carried = {name(s): v for s, v in zip(lead["source"], lead["carried"])}
        body = group[group["tokens"] >= 0].sort_values(["id", "tokens"], kind="stable", na_position="last")
        # neighbours in id are often alike, so the order is that of a hash of the id
        body = body.iloc[pd.util.hash_pandas_object(body["id"], index=False).argsort(kind="stable")]
        items = list(zip(body["id"], [name(s) for s in body["source"]], body["tokens"].astype(int)))
        shard = int(group["shard"].iloc[0])
        out = [(kind, f"{kind}-{shard}-{c}", i, p, start, n) for c, xs in pack_shard(items, share, carried, capacity, window) for i, p, start, n in xs]
        return pd.DataFrame(out, columns=["kind", "container", "id", "part", "start", "tokens"])

    return rows.groupBy("shard").applyInPandas(run, f"kind string, container string, id {id_type}, part int, start bigint, tokens bigint")


def pack_all(docs: DataFrame, capacities: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizers: str = TOKENIZERS, **how) -> DataFrame:
    """One packing per row of ``capacities`` (kind, tokenizer, capacity_tokens), a small table; texts are measured once a tokenizer."""
    kinds = capacities.select("kind", "tokenizer", "capacity_tokens").distinct().collect()
    measured: dict[str, DataFrame] = {}
    out = None
    for k in sorted(kinds):
        if k.tokenizer not in measured:
            counted = token_counts(docs, id_col, text_col, source_col, vocabulary(k.tokenizer, tokenizers))
            measured[k.tokenizer] = written(counted.withColumn("pos", F.monotonically_increasing_id()), "tokens")
        p = pack(measured[k.tokenizer], k.kind, k.capacity_tokens, **how)
        out = p if out is None else out.unionByName(p)
    if out is None:
        raise ValueError("no capacities")
    return out.withColumnRenamed("id", id_col)


def mixture(packed: DataFrame, docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", window: int = 64) -> DataFrame:
    """(kind, shard, window, source, share, target): what each source has of the tokens of every ``window`` containers in a row, and of all tokens."""
    place = F.split("container", "-")
    placed = packed.select("kind", F.element_at(place, -2).cast("bigint").alias("shard"), F.floor(F.element_at(place, -1).cast("bigint") / window).alias("window"), id_col, "tokens")
    sums = placed.join(docs.select(id_col, source_col).distinct(), id_col, "left").groupBy("kind", "shard", "window", source_col).agg(F.sum("tokens").alias("own"))
    sums = written(sums, "mixture")  # a row per window and source
    keyed = sums.withColumn("s", F.struct(F.col(source_col).alias("source")))  # a null source is one of its own
    of = keyed.groupBy("kind", "s").agg(F.sum("own").alias("of")).join(sums.groupBy("kind").agg(F.sum("own").alias("all")), "kind")
    of = of.select("kind", "s", (F.col("of") / F.greatest("all", F.lit(1))).alias("target"))
    windows = sums.groupBy("kind", "shard", "window").agg(F.sum("own").alias("held"))
    met = windows.join(of, "kind").join(keyed.select("kind", "shard", "window", "s", "own"), ["kind", "shard", "window", "s"], "left")
    return met.select("kind", "shard", "window", F.col("s.source").alias(source_col), (F.coalesce("own", F.lit(0)) / F.greatest("held", F.lit(1))).alias("share"), "target")


def faults(packed: DataFrame, sizes: DataFrame, capacities: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(kind, what, id): texts of ``sizes`` (id, kind, tokens) that are missing, placed with other than their tokens or split though they fit, and containers that hold too much. None, if all is well."""
    caps = capacities.select("kind", "capacity_tokens").distinct()
    got = packed.groupBy("kind", F.col(id_col).alias("id")).agg(F.sum("tokens").alias("got"), F.count(F.lit(1)).alias("parts"))
    both = sizes.groupBy("kind", "id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("times")).join(got, ["kind", "id"], "full").join(caps, "kind")
    what = F.when(F.col("got").isNull(), "missing").when(F.col("tokens").isNull() | (F.col("got") != F.col("tokens")), "changed")
    what = what.when((F.col("times") == 1) & (F.col("tokens") <= F.col("capacity_tokens")) & (F.col("parts") > 1), "split")
    texts = both.select("kind", what.alias("what"), F.col("id").cast("string").alias("id")).where("what is not null")
    full = packed.groupBy("kind", "container").agg(F.sum("tokens").alias("held")).join(caps, "kind").where(F.col("held") > F.col("capacity_tokens"))
    return texts.unionByName(full.select("kind", F.lit("too much").alias("what"), F.col("container").alias("id")))


def use(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(kind, containers, used, unused, fill) of a packing."""
    n = packed.groupBy("kind").agg(F.count_distinct("container").alias("containers"), F.sum("tokens").alias("used"))
    c = capacities.select("kind", "capacity_tokens").distinct()
    free = F.col("containers") * F.col("capacity_tokens") - F.col("used")
    return n.join(c, "kind").select("kind", "containers", "used", free.alias("unused"), (F.col("used") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
