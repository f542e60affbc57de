"""Queries that walk a hierarchy: ``SELECT from genres { ID, DrillState } recurse parent where DistanceFromRoot <= 1``.

The association of ``recurse`` leads to the parent. Columns that come with it: RANK (in pre-order, siblings in the query's order), Distance,
DistanceFromRoot, DrillState, LimitedDescendantCount and LimitedRank; a stored column of the same name comes before them. The condition after ``recurse`` may
use ``DistanceFromRoot`` and ``DistanceTo(node, 1 | null)``, the children or all descendants of a node; ``not DistanceTo(node, null)`` shuts a node.
With a condition or search of the query itself, the rows are those that meet it and their ancestors.
"""

from __future__ import annotations

import copy
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Element, ModelError
from . import ast as A

COMPUTED = {"RANK": "Integer64", "Distance": "Integer", "DistanceFromRoot": "Integer", "DrillState": "String", "LimitedDescendantCount": "Integer64", "LimitedRank": "Integer64"}
_COMPARE = {"=": "__eq__", "==": "__eq__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__", "<>": "__ne__", "!=": "__ne__"}


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


class _Condition:
    """What stands after ``recurse ... where``: nodes shown with all (``below``) or one level (``one``) of their descendants, shut nodes, and the levels from the root."""

    def __init__(self, low, e, kind):
        self.low, self.kind = low, kind
        self.below, self.one, self.shut = [], [], []
        self.level = None
        self.from_root = False
        self.column = self._bind(e, False)

    def node(self, e) -> Column:
        values = [self.low.value(x) for x in (e.items if isinstance(e, A.Row) else (e,))]
        cols = [v if isinstance(v, Column) else F.lit(v) for v in values]
        return (F.struct(*cols) if len(cols) > 1 else cols[0]).cast(self.kind)

    def _bind(self, e, negated: bool) -> Column:
        if isinstance(e, A.Not):
            self.from_root = True
            return ~self._bind(e.arg, True)
        if isinstance(e, A.Bin) and e.op in ("and", "or"):
            a, b = self._bind(e.left, negated), self._bind(e.right, negated)
            return a & b if e.op == "and" else a | b
        if isinstance(e, A.Func) and e.name.lower() == "distanceto" and len(e.args) == 2:
            node, far = self.node(e.args[0]), self.low.value(e.args[1])
            if far == 1:
                self.one.append(node)
                return F.coalesce(F.col("__parent") == node, F.lit(False))
            if far is not None:
                raise ModelError("DistanceTo takes 1 or null")
            (self.shut if negated else self.below).append(node)
            return F.array_contains(F.slice("path", F.lit(1), F.size("path") - 1), node)
        if isinstance(e, A.Bin) and e.op in _COMPARE and isinstance(e.left, A.Ref) and e.left.names[-1] == "DistanceFromRoot":
            self.from_root, self.level = True, self.low.value(e.right)
            return getattr(F.col("level") - 1, _COMPARE[e.op])(F.lit(self.level))
        raise ModelError("a condition of recurse is made of DistanceFromRoot and DistanceTo")


def recursed(low, q: A.Select, outer) -> DataFrame:
    from ..operators import tree as T
    from .lower import Lowering, Scope

    if not isinstance(q.source, A.Table) or q.source.ref is None or q.source.path or len(q.source.ref.steps) != 1:
        raise ModelError("recurse needs one entity as its source")
    step = q.source.ref.steps[0]
    entity = low.known(step.id)
    name, cond = q.recurse
    assoc = entity.elements.get(name)
    if assoc is None or not assoc.is_assoc or assoc.target != entity.name:
        raise ModelError(f'"{name}" is no association of "{entity.name}" with itself')
    pairs = low.key_names(assoc, entity)
    if not pairs:
        raise ModelError(f'"{name}" must be an equality of columns')
    rows = low.filtered(entity, step.where, {k: low.value(v) for k, v in step.args})
    keys, refs = [k for _, k in pairs], [r for r, _ in pairs]
    node = F.col(f"`{keys[0]}`") if len(keys) == 1 else F.struct(*[F.col(f"`{k}`") for k in keys])
    named = reduce(lambda a, b: a & b, [F.col(f"`{r}`").isNotNull() for r in refs])
    parent = F.col(f"`{refs[0]}`") if len(refs) == 1 else F.when(named, F.struct(*[F.col(f"`{r}`").alias(k) for r, k in zip(refs, keys)]))
    base = rows.select("*", node.alias("__node"), parent.alias("__parent"))
    order = [low.sorted(s, None, F.col(f"`{'_'.join(s.expr.names)}`")) for s in q.order if isinstance(s.expr, A.Ref)]
    h = T.hierarchy(base.drop(*rows.columns) if not order else base, "__node", "__parent", order or None)
    kind = h.schema["__node"].dataType
    where = _Condition(low, cond, kind) if cond is not None else None
    filtered = q.where is not None or bool(q.search)
    to_only = where is not None and not filtered and not where.from_root
    if filtered:
        inner = Lowering(low.engine, low.params)
        inner.ctes, inner.localized = low.ctes, low.localized
        items = tuple(A.Item(A.Ref((A.Step(k),)), f"k{n}") for n, k in enumerate(keys))
        hits = inner.query(A.Select(source=q.source, items=items, where=q.where, search=q.search), outer)
        hit = F.col("k0") if len(keys) == 1 else F.struct(*[F.col(f"k{n}").alias(k) for n, k in enumerate(keys)])
        h = T.ancestors(h.join(hits.select(hit.alias("__node"), F.lit(True).alias("__start")).distinct(), "__node", "left"), F.col("__start")).drop("__start")
        h = h if where is None else h.where(where.column)
    elif to_only:
        starts = where.one or where.below
        h = T.descendants(h, _any([F.col("__node") == n for n in starts]), 1, 1 if where.one else None)
    else:
        h = h.withColumn("distance", F.col("level") - 1)
        h = h if where is None else h.where(where.column)
    state = F.when(F.col("tree_size") == 1, "leaf")
    if filtered or to_only:
        state = state.when(F.col("distance") == 0, "leaf")
    if where is not None:
        state = state.when(_any([F.col("__node") == n for n in where.shut]), "collapsed")
        state = state.when(_any([F.col("__node") == n for n in where.below + where.one]), "expanded")
        state = state.when(_any([F.coalesce(F.col("__parent") == n, F.lit(False)) for n in where.one]), "collapsed")
        if not to_only and where.level is not None:
            state = state.when(F.col("level") != where.level + 1, "expanded")
    shown = "collapsed" if where is not None and not where.shut else "expanded"
    if _uses(q, "LimitedRank"):
        h = T.numbered(h, [F.col("rank")], "__limited").withColumn("__limited", F.col("__limited") - 1)
    else:
        h = h.withColumn("__limited", F.lit(None).cast("bigint"))
    made = {
        "RANK": F.col("rank") - 1,
        "Distance": F.col("distance").cast("int"),
        "DistanceFromRoot": (F.col("level") - 1).cast("int"),
        "DrillState": state.otherwise(shown),
        "LimitedDescendantCount": F.col("tree_size") - 1,
        "LimitedRank": F.col("__limited"),
    }
    stored = {c.lower() for c in rows.columns}
    made = {n: c for n, c in made.items() if n.lower() not in stored}
    h = h.select("__node", F.col("rank").alias("__rank"), *[c.alias(f"__h_{n}") for n, c in made.items()])
    cells = [F.col(f"`{c}`") for c in rows.columns]
    df = base.dropDuplicates(["__node"]).join(h, "__node").select(*cells, "__rank", *[F.col(f"__h_{n}").alias(n) for n in made])
    extra = {n: Element(n, COMPUTED[n], hidden=True) for n in made} | {"__rank": Element("__rank", "Integer64", hidden=True)}
    walked = replace(entity, elements={**entity.elements, **extra}, query=None)
    n = low.node(walked, df, q.source.alias or step.id)
    rest = copy.copy(q)
    rest.where, rest.search, rest.recurse, rest.order = None, (), None, (A.Sort(A.Ref((A.Step("__rank"),))),)
    return low.select(rest, Scope(low, {q.source.alias or step.id.rpartition(".")[2]: n}, outer), n.df)


def _uses(q: A.Select, name: str) -> bool:
    return f"id='{name}'" in repr(q.items) or f"id='{name}'" in repr(q.group)
