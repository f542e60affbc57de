"""Hierarchies for display: ranks in pre-order, tree sizes, descendants, ancestors and drill states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import written
from .hierarchy_links import resolve


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Adds 1, 2, ... in a total order without bringing all rows to one task: a range sort, then offsets by partition."""
    cols = df.columns
    placed = written(df.sort(*order).withColumn("__m", F.monotonically_increasing_id()), "sorted")
    placed = placed.withColumn("__p", F.shiftright("__m", 33))
    # one row per partition
    firsts = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__m").alias("__m0"))
    offsets = firsts.withColumn("__off", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__m0", "__off")
    return placed.join(F.broadcast(offsets), "__p").select(*cols, (F.col("__m") - F.col("__m0") + F.col("__off") + 1).alias(name))


def levels(rows: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, parent, level, root, path): what needs no ranks; roots have level 1. Rows on or below cycles aren't part of the hierarchy. Copies count once."""
    r = resolve(rows.select(F.col(node).alias("n"), F.col(parent).alias("p")), "n", "p").where("cycle is null")
    return r.select(F.col("id").alias(node), F.try_element_at("path", F.lit(-2)).alias(parent), (F.col("depth") + 1).alias("level"), "root", "path")


def hierarchy(rows: DataFrame, node: str, parent: str, sibling: str | Sequence[Column] | None = None) -> DataFrame:
    """(node, parent, level, root, rank, parent_rank, root_rank, tree_size): roots have level 1, ranks follow pre-order, siblings by ``sibling``, then node.

    sibling is a column's name, or the columns of a sort, ascending or descending. Rows on or below cycles aren't part of the hierarchy. Copies count once.
    """
    r = levels(rows, node, parent).withColumnRenamed(node, "__id")
    # sizes by partial sums over the lines; a root's count is spread by its rows
    sizes = r.select(F.explode("path").alias("__id")).groupBy("__id").agg(F.count(F.lit(1)).alias("tree_size"))
    if sibling is None:
        keyed = r.withColumn("__order", F.col("path"))
    else:
        if isinstance(sibling, str):
            by = rows.select(F.col(node).alias("step"), F.col(sibling).alias("s")).groupBy("step").agg(F.min("s").alias("s"))
        else:
            # the place in the whole sort serves as the place among siblings
            first = rows.dropDuplicates([node])
            by = numbered(first.select(F.col(node).alias("step"), *first.columns), [*sibling, F.col("step")], "s").select("step", "s")
        steps = r.select("__id", F.posexplode("path").alias("at", "step")).join(by, "step", "left")
        lines = steps.groupBy("__id").agg(F.array_sort(F.collect_list(F.struct("at", "s", "step"))).alias("__order"))
        keyed = r.join(lines.select("__id", F.transform("__order", lambda x: F.struct(x["s"], x["step"])).alias("__order")), "__id")
    ranked = numbered(keyed.join(sizes, "__id"), [F.col("__order")], "rank").drop("__order")
    ranks = ranked.select(F.col("__id").alias("k"), F.col("rank").alias("v"))
    out = ranked.join(ranks.select(F.col("k").alias(parent), F.col("v").alias("parent_rank")), parent, "left")
    out = out.join(ranks.select(F.col("k").alias("root"), F.col("v").alias("root_rank")), "root", "left")
    return out.select(F.col("__id").alias(node), parent, "level", "root", "rank", "parent_rank", "root_rank", "tree_size", "path")


def descendants(h: DataFrame, start: Column, low: int = 0, high: int | None = None) -> DataFrame:
    """Rows of ``h`` within low..high levels below the rows that ``start`` picks, with the greatest distance; high None: all the way.

    Rows below several starts come once.
    """
    node = h.columns[0]
    tops = h.where(start).select(F.col(node).alias("__top"))
    at = h.select(node, F.size("path").alias("__n"), F.posexplode("path").alias("__at", "__top"))
    d = at.join(tops, "__top").select(node, (F.col("__n") - 1 - F.col("__at")).alias("distance"))
    d = d.where(F.col("distance") >= low)
    d = d if high is None else d.where(F.col("distance") <= high)
    return h.join(d.groupBy(node).agg(F.max("distance").alias("distance")), node)


def ancestors(h: DataFrame, start: Column, keep_start: bool = True) -> DataFrame:
    """Rows of ``h`` above the rows that ``start`` picks: distance 0, -1, ...; of several the farthest from the start."""
    node = h.columns[0]
    d = h.where(start).select(F.size("path").alias("__n"), F.posexplode("path").alias("__at", node)).groupBy(node).agg(F.min(F.col("__at") - F.col("__n") + 1).alias("distance"))
    return h.join(d if keep_start else d.where("distance < 0"), node)


def top_levels(h: DataFrame, levels: int | None, expanded: Column | None = None, collapsed: Column | None = None) -> DataFrame:
    """The upper levels, with drill_state and 0-based limited_rank; nodes that ``expanded`` picks show their children, ``collapsed`` ones hide theirs."""
    node, parent = h.columns[0], h.columns[1]
    no = F.lit(False)
    open_, shut = (expanded if expanded is not None else no), (collapsed if collapsed is not None else no)
    marked = h.withColumn("__open", open_).withColumn("__shut", shut)
    state = (
        F.when(F.col("tree_size") == 1, "leaf")
        .when(F.col("__shut"), "collapsed")
        .when(F.col("__open"), "expanded")
        .when(F.lit(True) if levels is None else F.col("level") < levels, "expanded")
        .otherwise("collapsed")
    )
    seen = marked if levels is None else marked.where(F.col("level") <= levels)
    if expanded is not None and levels is not None:
        more = marked.where("__open").select(F.col(node).alias(parent))
        seen = seen.unionByName(marked.where(F.col("level") > levels).join(more, parent, "left_semi").select(*marked.columns))
    if collapsed is not None:
        hidden = marked.where("__shut").select(F.col(node).alias("__top"))
        below = marked.select(node, F.explode("path").alias("__top")).join(hidden, "__top", "left_semi").where(F.col("__top") != F.col(node))
        seen = seen.join(below.select(node), node, "left_anti").select(*marked.columns)
    out = numbered(seen.withColumn("drill_state", state), [F.col("rank")], "__r")
    return out.withColumn("limited_rank", F.col("__r") - 1).withColumn("limited_descendant_count", F.col("tree_size") - 1).withColumn("distance_from_root", F.col("level") - 1).drop("__r", "__open", "__shut")
