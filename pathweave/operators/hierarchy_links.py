"""Parent-child rows to full hierarchies.

Method: frontier joins from the roots, level by level in blocks that double. Round k joins the nodes that don't know their root yet with the nodes 2^k
levels above them, which settles all levels below 2^(k+1): paths and depths are those of the node met, extended by the node's own line. A node that comes
twice in its own line of ancestors lies on or below a cycle, and the line holds the whole cycle. Beyond ``stride`` levels the frontier advances by
``stride`` levels a join, so no line grows further before it is settled; nodes that no frontier reaches then lie on or below a cycle longer than that,
which the shrinking images of the parent map give.

Keys that many rows share, such as a parent of a third of all nodes, are salted: HOT rows or more of one key are spread over as many copies
of the one row they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import scratch, written

#: Rows of one key from which on a join spreads them.
HOT = 200_000
#: Doublings of steps along long cycles in one job.
DOUBLINGS = 3


def _meet(many: DataFrame, one: DataFrame, key: str, how: str, rows: int) -> DataFrame:
    """``many`` joined with ``one``, which has one row per key. ``rows`` bounds the rows of ``many``; below HOT no key can be hot.

    Hot keys are counted with partial aggregation; there are at most rows / HOT of them. Null keys are spread at once.
    """
    if rows < HOT:
        return many.join(one, key, how)
    hot = many.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= HOT)
    hot = hot.select(key, F.ceil(F.col("__n") / HOT).cast("int").alias("__copies"))
    left = many.join(hot, key, "left")
    own = F.xxhash64(*[F.col(f"`{c}`") for c in many.columns])
    left = left.withColumn("__salt", F.when(F.col(key).isNull(), F.pmod(own, F.lit(1024))).otherwise(F.pmod(own, F.coalesce("__copies", F.lit(1)))).cast("int"))
    right = one.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__copies", F.lit(1)) - 1)))
    return left.drop("__copies").join(right.drop("__copies"), [key, "__salt"], how).drop("__salt")


def _links(rows: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """One (id, parent) per id; the smallest parent that exists wins where copies disagree. Roots have none."""
    pairs = rows.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent")).where("id is not null").distinct()
    ids = pairs.select(F.col("id").alias("parent")).distinct().withColumn("there", F.lit(True))
    n = rows.count()
    known = _meet(pairs, ids, "parent", "left", n).select("id", F.when(F.col("there"), F.col("parent")).alias("parent"))
    return known.groupBy("id").agg(F.min("parent").alias("parent"))


def _line() -> Column:
    """The node and its ancestors as far as known, nearest first."""
    return F.concat(F.array("id"), F.col("up"))


def _ancestors(links: DataFrame, stride: int, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables (id, up) with ancestors in ``up``, nearest first: nodes that know their root, nodes whose line meets itself, and nodes with ``stride`` ancestors but neither (and ``top``, the last).

    Nodes that are done aren't joined or written again; they are only met.
    """
    spark, kind = links.sparkSession, links.schema["id"].dataType.simpleString()
    line = F.when(F.col("parent").isNull(), F.array().cast(f"array<{kind}>")).otherwise(F.array("parent"))
    state = lambda loop: F.when(F.col("top").isNull(), 0).when(loop, 1).otherwise(2).cast("tinyint")
    made = links.select("id", line.alias("up"), F.col("parent").alias("top"), F.lit(1).alias("have")).withColumn("state", state(F.col("top") == F.col("id")))
    folder, have = scratch(spark, "up"), 1
    made.write.parquet(f"{folder}/1")
    rounds = spark.read.schema(made.schema)
    while True:
        # all rounds in one scan, so that small files share tasks
        every = rounds.parquet(*[f"{folder}/{1 << k}" for k in range(have.bit_length())])
        going = every.where((F.col("have") == have) & (F.col("state") == 2))
        if have >= stride or going.isEmpty():
            break
        seen = every.where((F.col("have") == have) | (F.col("state") < 2)).select(F.col("id").alias("top"), F.col("up").alias("more"), F.col("top").alias("beyond"))
        met = _meet(going.select("id", "up", "top"), seen, "top", "inner", n).select("id", F.concat("up", "more").alias("up"), F.col("beyond").alias("top"))
        have *= 2
        met.select("*", F.lit(have).alias("have")).withColumn("state", state(F.size(F.array_distinct(_line())) <= F.size("up"))).write.parquet(f"{folder}/{have}")
    return every.where("state = 0").select("id", "up"), every.where("state = 1").select("id", "up"), going.select("id", "up", "top")


def _descend(settled: DataFrame, deep: DataFrame, stride: int, n: int, name: str) -> DataFrame:
    """settled (id, root, depth, path) and all nodes of deep (id, up, top) that hang on them, ``stride`` levels a join."""
    done = frontier = settled
    while True:
        head = frontier.select(F.col("id").alias("top"), "root", "depth", F.col("path").alias("head"))
        tail = F.reverse(F.slice(_line(), 1, stride))
        frontier = written(_meet(deep, head, "top", "inner", n).select("id", "root", (F.col("depth") + stride).alias("depth"), F.concat("head", tail).alias("path")), name)
        if frontier.isEmpty():
            return done
        done = done.unionByName(frontier)


def _around(looped: DataFrame) -> DataFrame:
    """(id, cycle, up, depth, path, ring) of nodes whose line meets itself: what comes before the first node that is met again is off the cycle."""
    apart = looped.select("id", F.array_distinct(_line()).alias("apart"), _line().alias("line"))
    at = apart.select("id", "apart", F.array_position("apart", F.element_at("line", F.size("apart") + 1)).cast("int").alias("at"))
    ring = at.select("id", "apart", "at", F.slice("apart", F.col("at"), F.size("apart") - F.col("at") + 1).alias("ring"))
    least = F.array_min("ring")
    return ring.select("id", least.alias("cycle"), (F.array_position("ring", least) - 1).cast("int").alias("up"), (F.col("at") - 1).alias("depth"), F.reverse(F.slice("apart", F.lit(1), F.col("at") - 1)).alias("path"), "ring")


def _cycles(left: DataFrame, stride: int, n: int) -> DataFrame:
    """(id, cycle, up) of the nodes on cycles, from rows (id, up, top) of nodes that all have ``stride`` ancestors; cycle is the least id, ``up`` the steps up to it."""
    window = F.concat(F.array("id"), F.slice("up", 1, stride - 1))
    state = left.select("id", F.col("top").alias("to"), F.array_min(window).alias("cycle"), (F.array_position(window, F.array_min(window)) - 1).alias("up"))
    width = stride
    while True:
        for _ in range(DOUBLINGS):
            far = state.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("cycle").alias("other"), F.col("up").alias("beyond"))
            less = F.col("other") < F.col("cycle")
            up = F.when(less, F.lit(width).cast("bigint") + F.col("beyond")).otherwise(F.col("up"))
            state = _meet(state.select("id", "to", "cycle", "up"), far, "to", "inner", n).select("id", F.col("to").alias("mid"), F.col("far").alias("to"), F.least("cycle", "other").alias("cycle"), up.alias("up"), less.alias("less"))
            width *= 2
        state = written(state, "jump")
        # images of the map are nested; where that of twice the steps is as large, the map permutes it: these are the cycles.
        # Once no window of twice the width has a lesser id, each window has the least of all that lies ahead
        found = state.agg(F.count_distinct("mid").alias("before"), F.count_distinct("to").alias("now"), F.max("less").alias("less")).first()
        if found.before == found.now and not found.less:
            ring = state.select(F.col("to").alias("id")).distinct()
            return state.join(ring, "id", "left_semi").select("id", "cycle", F.col("up").cast("int").alias("up"))


def resolve(rows: DataFrame, id_col: str, parent_col: str, stride: int = 256) -> DataFrame:
    """(id, depth, root, cycle, up, path): one row for each id.

    path holds the ids from the root down to the node. A node whose parent is null or no node is a root (depth 0).
    On a cycle, ``cycle`` is the least id of the cycle, path is empty, root null and depth 0; below it path holds the ids
    from the first one off the cycle, depth counts from the cycle. ``up`` counts the steps along the cycle up to its least id, from the
    node itself or from the node of the cycle that it hangs on; elsewhere it is null. Copies of a row count once; a null id is no node; where
    copies of an id name several parents, the smallest that exists is taken. An empty table gives no rows. Other columns are ignored.
    """
    if stride < 1 or stride & (stride - 1):
        raise ValueError("stride must be a power of two")
    links = written(_links(rows, id_col, parent_col), "links")
    n = links.count()
    none, no_step = F.lit(None).cast(links.schema["id"].dataType), F.lit(None).cast("int")
    ended, looped, deep = _ancestors(links, stride, n)
    settled = ended.select("id", F.element_at(_line(), -1).alias("root"), F.size("up").alias("depth"), F.reverse(_line()).alias("path"))
    beyond = not deep.isEmpty()
    reached = _descend(settled, deep, stride, n, "tree") if beyond else settled
    out = reached.select("id", "depth", "root", none.alias("cycle"), no_step.alias("up"), "path")
    around = _around(looped)
    left = written(deep.join(reached.where(F.col("depth") >= stride).select("id"), "id", "left_anti"), "unreached") if beyond else None
    if left is None or left.isEmpty():
        return out.unionByName(around.select("id", "depth", none.alias("root"), "cycle", "up", "path"))
    # cycles or lines below them that are longer than ``stride``: all nodes that hang on cycles are done by images; known lines go on along their cycle
    known = around.select("id", F.transform(F.sequence(F.lit(1), F.lit(stride)), lambda k: F.when(k < F.col("depth"), F.try_element_at(F.reverse("path"), k + 1)).otherwise(F.try_element_at("ring", F.pmod(k - F.col("depth"), F.size("ring")) + 1))).alias("up"))
    left = written(left.unionByName(known.select("id", "up", F.element_at("up", -1).alias("top"))), "tied")
    cycles = written(_cycles(left, stride, n), "cycles")
    # below the cycles: the nodes that have one of a cycle among their ancestors known so far, then those that hang on them
    hang = left.join(cycles.select("id"), "id", "left_anti")
    near = hang.select("id", F.posexplode("up").alias("at", "ring")).join(cycles.select(F.col("id").alias("ring"), F.struct("cycle", F.col("up")).alias("root")), "ring")
    first = near.groupBy("id").agg(F.min_by(F.struct("at", "root"), "at").alias("f"))
    start = hang.join(first, "id").select("id", "f.root", (F.col("f.at") + 1).alias("depth"), F.reverse(F.concat(F.array("id"), F.slice("up", F.lit(1), F.col("f.at")))).alias("path"))
    on = cycles.select("id", F.struct("cycle", "up").alias("root"), F.lit(0).alias("depth"), F.array().cast(reached.schema["path"].dataType).alias("path"))
    start = written(start, "ring")
    far = hang.join(start.select("id"), "id", "left_anti")
    rings = start if far.isEmpty() else _descend(start, written(far, "below"), stride, n, "ring")
    return out.unionByName(on.unionByName(rings).select("id", "depth", none.alias("root"), "root.cycle", "root.up", "path"))


def path_text(resolved: DataFrame) -> DataFrame:
    """(id, path) with path as text: ids joined by ``/``, headed by ``@`` and the least id where a cycle lies above."""
    ids = F.array_join(F.col("path").cast("array<string>"), "/")
    ring = F.concat(F.lit("@"), F.col("cycle").cast("string"))
    return resolved.select("id", F.when(F.col("cycle").isNull(), ids).when(F.size("path") == 0, ring).otherwise(F.concat(ring, F.lit("/"), ids)).alias("path"))


def descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor, id, distance): every pair of a node and a proper ancestor of it.

    Every node of a cycle is an ancestor of the others and of all nodes below the cycle; its distance is that of the first time
    it is met on the way up. No node is its own ancestor.
    """
    on_path = (
        resolved.select("id", F.size("path").alias("n"), F.posexplode("path").alias("at", "ancestor"))
        .where(F.col("at") < F.col("n") - 1)
        .select("ancestor", "id", (F.col("n") - 1 - F.col("at")).alias("distance"))
    )
    tied = resolved.where("cycle is not null").select("id", "cycle", "up", F.size("path").alias("n"))
    ring = tied.where("n = 0").select("cycle", F.col("id").alias("ancestor"), F.col("up").alias("left"))
    length = ring.groupBy("cycle").agg(F.count(F.lit(1)).cast("int").alias("length"))
    around = tied.join(ring.join(length, "cycle"), "cycle").where("ancestor != id")
    return on_path.unionByName(around.select("ancestor", "id", (F.col("n") + F.pmod(F.col("up") - F.col("left"), F.col("length"))).alias("distance")))


def descendant_counts(resolved: DataFrame) -> DataFrame:
    """(id, descendants): how many other nodes lie below each node, for one on a cycle also the rest of the cycle; 0 for leaves."""
    n = resolved.select(F.explode("path").alias("id")).groupBy("id").agg((F.count(F.lit(1)) - 1).alias("descendants"))
    tied = resolved.where("cycle is not null")
    around = tied.groupBy("cycle").agg((F.count(F.lit(1)) - 1).alias("descendants"))
    ring = tied.where(F.size("path") == 0).select("id", "cycle").join(around, "cycle").select("id", "descendants")
    return resolved.select("id").join(n.unionByName(ring), "id", "left").select("id", F.coalesce("descendants", F.lit(0)).alias("descendants"))
