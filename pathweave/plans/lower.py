"""From the query language to DataFrames.

Names are bound first; while they are, association paths grow a tree of joins, one node for each path and filter. Then the joins,
filters, groups and projections become DataFrame operations and Catalyst does the rest. Columns of a source called ``a`` are named
``a__column`` inside, so joined tables never clash.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.registry import AGGREGATES, Literal, call, placed
from ..model import Element, Entity, ModelError
from ..runtime import written
from . import ast as A
from .parser import parse, parse_expr

#: Casts: names of the language and their Spark types.
TYPES = {
    "string": "string", "uuid": "string", "largestring": "string", "boolean": "boolean", "uint8": "smallint", "int16": "smallint", "int32": "int", "integer": "int",
    "int64": "bigint", "integer64": "bigint", "decimal": "decimal(38,10)", "double": "double", "decimalfloat": "double", "date": "date", "time": "string", "datetime": "timestamp",
    "timestamp": "timestamp", "binary": "binary", "largebinary": "binary", "vector": "array<float>", "map": "variant", "tinyint": "smallint", "real": "float",
}

#: Weights of columns in a search by score.
RANKING = {"HIGH": 0.8, "MEDIUM": 0.5, "LOW": 0.3}


@dataclass
class Node:
    """A table in the join tree."""

    alias: str
    entity: Entity
    df: DataFrame
    cond: Column | None = None
    how: str = "left"
    children: dict = field(default_factory=dict)
    parent: Node | None = None
    localized: bool = False

    def col(self, physical: str) -> Column:
        return F.col(f"`{self.alias}__{physical}`")


@dataclass
class Bound:
    """An expression: its Column, what it was declared as, and whether it can't be null. leaves: for structures."""

    column: Column
    element: Element | None = None
    solid: bool = False
    leaves: list | None = None
    literal: object = None
    is_literal: bool = False


class Scope:
    def __init__(self, lowering: Lowering, sources: dict[str, Node], outer: Scope | None = None):
        self.lowering, self.sources, self.outer = lowering, sources, outer
        self.items: dict[str, A.Item] = {}
        self.flags: list = []  # (DataFrame, join condition) of existence tests inside expressions
        self.nested: list = []  # joins of to-many results, made after the filters
        self.main = next(iter(sources.values())) if sources else None
        self.binding: set[str] = set()


def _and(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def conjuncts(e) -> list:
    return conjuncts(e.left) + conjuncts(e.right) if isinstance(e, A.Bin) and e.op == "and" else [] if e is None else [e]


class Lowering:
    def __init__(self, engine, params: dict):
        self.engine, self.params, self.aliases, self.ctes = engine, params, {}, {}
        self.localized = False
        self.correlated = False

    # sources -------------------------------------------------------------------------------------------------------

    def alias(self, base: str) -> str:
        base = base.rpartition(".")[2]
        n = self.aliases[base.lower()] = self.aliases.get(base.lower(), 0) + 1
        return base if n == 1 else f"{base}{n}"

    def entity_rows(self, entity: Entity, args: dict | None = None) -> DataFrame:
        """Rows of an entity: a table, or its query with parameters; translated if the query is localised."""
        if entity.name in self.ctes:
            return self.ctes[entity.name]
        if entity.query is not None:
            missing = set(entity.params) - set(args or {})
            if missing:
                raise ModelError(f'"{entity.name}" needs the parameters {sorted(missing)}')
            inner = Lowering(self.engine, {**self.params, **(args or {})})
            inner.localized = self.localized
            return inner.query(parse(entity.query) if isinstance(entity.query, str) else entity.query)
        df = self.engine.rows(entity.name)
        if entity.valid:
            lo, hi = entity.valid
            s = self.engine.session
            if s.valid_from is not None:
                df = df.where((F.col(lo) < F.lit(s.get(("$valid", "to")))) & (F.col(hi) > F.lit(s.get(("$valid", "from")))))
        if self.localized and entity.texts:
            df = self.translated(entity, df)
        return df

    def translated(self, entity: Entity, df: DataFrame) -> DataFrame:
        """Localised elements from the texts of the session's locale, from the entity itself where there are none."""
        keys = entity.keys()
        names = [e.name for e in entity.elements.values() if e.localized]
        t = self.engine.rows(entity.texts).where(F.col("locale") == F.lit(self.engine.session.locale))
        t = t.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[F.col(n).alias(f"__t_{n}") for n in names])
        joined = df.join(t, _and([df[k] == t[f"__k_{k}"] for k in keys]), "left")
        return joined.select(*[F.coalesce(F.col(f"__t_{c}"), F.col(c)).alias(c) if c in names else df[c] for c in df.columns])

    def node(self, entity: Entity, df: DataFrame, base: str) -> Node:
        alias = self.alias(base)
        return Node(alias, entity, df.select(*[F.col(f"`{c}`").alias(f"{alias}__{c}") for c in df.columns]))

    def known(self, name: str) -> Entity:
        if name in self.ctes:
            return _free_entity(name, self.ctes[name])
        return self.engine.model.entity(name)

    def table(self, t, outer: Scope | None) -> tuple[dict[str, Node], DataFrame]:
        """The sources of a from clause and their joined rows."""
        if isinstance(t, A.Join):
            left, ldf = self.table(t.left, outer)
            right, rdf = self.table(t.right, outer)
            if set(left) & set(right):
                raise ModelError(f"the alias {sorted(set(left) & set(right))} is given twice")
            both = {**left, **right}
            if t.on is None:
                return both, ldf.crossJoin(rdf)
            scope = Scope(self, both, outer)
            return both, ldf.join(rdf, self.boolean(t.on, scope), {"full": "full", "cross": "inner"}.get(t.how, t.how))
        if t.query is not None:
            inner = Lowering(self.engine, self.params)
            inner.ctes, inner.localized = self.ctes, self.localized
            df = inner.query(t.query)
            name = t.alias or "__select__"
            n = self.node(_free_entity(name, df), df, name)
            return {name: n}, n.df
        first = t.ref.steps[0]
        if first.id in self.engine.functions and first.id not in self.engine.model.entities:
            df = self.engine.functions[first.id](self.engine, **{k: self.value(v) for k, v in first.args})
            name = t.alias or first.id
            n = self.node(_free_entity(name, df), df, name)
            return {name: n}, n.df
        entity = self.known(".".join(t.ref.names) if ".".join(t.ref.names) in self.engine.model.entities else first.id)
        steps = t.ref.steps[len(entity.name.split(".")) :] if len(t.ref.steps) > 1 else ()
        path = [*steps, *t.path]
        args = {k: self.value(v) for k, v in first.args}
        df = self.filtered(entity, first.where, args)
        # each step leaves the target rows that some row before refers to, once
        for s in path:
            assoc = _element(entity, s.id)
            if not assoc.is_assoc:
                raise ModelError(f'"{s.id}" is no association of "{entity.name}"')
            target = self.known(assoc.target)
            source = self.node(entity, df, entity.name)
            tdf = self.filtered(target, s.where, {k: self.value(v) for k, v in s.args})
            tnode = self.node(target, tdf, target.name)
            semi = tnode.df.join(source.df, self.on(assoc, source, tnode, ""), "left_semi")
            df, entity = semi.select(*[tnode.col(c).alias(c) for c in tdf.columns]), target
        name = t.alias or (path[-1].id if path else first.id).rpartition(".")[2]
        n = self.node(entity, df, name)
        n.localized = self.localized
        return {name: n}, n.df

    def filtered(self, entity: Entity, where, args: dict | None = None) -> DataFrame:
        """Rows of an entity that meet a filter, which may follow paths of its own; [v] is short for the single key."""
        df = self.entity_rows(entity, args)
        if where is None:
            return df
        if isinstance(where, A.Val):
            keys = entity.keys()
            if len(keys) != 1:
                raise ModelError(f'[value] needs a key of one column; "{entity.name}" has {len(keys)}')
            return df.where(F.col(keys[0]) == F.lit(where.value))
        n = self.node(entity, df, entity.name)
        scope = Scope(self, {entity.name.rpartition(".")[2]: n})
        out = self.where(n.df, where, scope)
        return out.select(*[n.col(c).alias(c) for c in df.columns])

    # joins ---------------------------------------------------------------------------------------------------------

    def on(self, assoc: Element, source: Node, target: Node, prefix: str) -> Column:
        """The condition of an association between a source and a target row."""
        if assoc.keys:
            return _and([source.col(f"{prefix}{assoc.name}_{s}") == target.col(k) for k, s in assoc.keys.items()])
        e = parse_expr(assoc.on)
        scope = Scope(self, {"$source": source})
        scope.assoc = (assoc.name, target)
        return self.boolean(e, scope)

    def backlink(self, e: A.Bin, source: Node, assoc: str, target: Node) -> Column | None:
        """``assoc.x = $self``: the foreign keys of x in the target are the keys of the source."""
        for a, b in ((e.left, e.right), (e.right, e.left)):
            if isinstance(a, A.Ref) and isinstance(b, A.Ref) and b.names == ("$self",) and len(a.steps) == 2 and a.steps[0].id == assoc:
                back = _element(target.entity, a.steps[1].id)
                if back.keys:
                    return _and([target.col(f"{back.name}_{s}") == source.col(k) for k, s in back.keys.items()])
                return self.on(back, target, source, "")
        return None

    def child(self, node: Node, assoc: Element, step: A.Step, prefix: str) -> Node:
        """The join node of an association step; the same path with the same filter and arguments is joined once."""
        key = (prefix + assoc.name, repr(step.where), repr(step.args))
        if key not in node.children:
            target = self.known(assoc.target)
            df = self.filtered(target, step.where, {k: self.value(v) for k, v in step.args})
            n = self.node(target, df, assoc.name)
            n.cond, n.parent, n.localized = self.on(assoc, node, n, prefix), node, node.localized
            node.children[key] = n
        return node.children[key]

    @staticmethod
    def joined(df: DataFrame, nodes: list[Node]) -> DataFrame:
        for n in nodes:
            for c in n.children.values():
                df = Lowering.joined(df.join(c.df, c.cond, c.how), [c])
        return df

    # expressions ---------------------------------------------------------------------------------------------------

    def value(self, e):
        """A constant given as an argument."""
        b = self.bind(e, Scope(self, {}))
        return b.literal if b.is_literal else b.column

    def boolean(self, e, scope: Scope) -> Column:
        return self.bind(e, scope).column

    def bind(self, e, scope: Scope, near: Element | None = None) -> Bound:
        if isinstance(e, A.Val):
            return Bound(F.lit(e.value), solid=e.value is not None, literal=e.value, is_literal=True)
        if isinstance(e, A.Ref):
            return self.ref(e, scope)
        if isinstance(e, A.Enum):
            symbols = near.enum if near is not None else None
            if not symbols or e.symbol not in symbols:
                raise ModelError(f'"#{e.symbol}" is no symbol of the enumeration')
            v = symbols[e.symbol]
            return Bound(F.lit(v), solid=True, literal=v, is_literal=True)
        if isinstance(e, A.Param):
            if e.name not in self.params:
                raise ModelError(f'parameter "{e.name}" isn\'t given')
            v = self.params[e.name]
            return Bound(v if isinstance(v, Column) else F.lit(v), literal=v, is_literal=not isinstance(v, Column), solid=v is not None)
        if isinstance(e, A.Not):
            return Bound(~self.boolean(e.arg, scope))
        if isinstance(e, A.Neg):
            return Bound(-self.scalar(e.arg, scope).column)
        if isinstance(e, A.Cast):
            b = self.bind(e.arg, scope)
            if b.leaves is not None:
                raise ModelError("a structure can't be cast")
            base, _, size = e.type.partition("(")
            kind = TYPES.get(base.lower(), base)
            return Bound(b.column.cast(f"{kind.partition('(')[0]}({size}" if size and kind.startswith("decimal") else kind), b.element)
        if isinstance(e, A.Case):
            out = None
            for c, v in e.whens:
                cond, val = self.boolean(c, scope), self.scalar(v, scope).column
                out = F.when(cond, val) if out is None else out.when(cond, val)
            return Bound(out.otherwise(self.scalar(e.other, scope).column) if e.other is not None else out)
        if isinstance(e, A.Bin):
            return Bound(self.binary(e, scope))
        if isinstance(e, A.Between):
            a, lo, hi = (self.scalar(x, scope).column for x in (e.arg, e.low, e.high))
            return Bound(~a.between(lo, hi) if e.negated else a.between(lo, hi))
        if isinstance(e, A.In):
            return Bound(self.isin(e, scope))
        if isinstance(e, A.Func):
            return Bound(self.func(e, scope))
        if isinstance(e, A.Sub):
            return Bound(self.subquery(e.query, scope).scalar())
        if isinstance(e, A.Exists):
            return Bound(self.exists(e, scope))
        if isinstance(e, A.Row):
            return Bound(F.struct(*[self.scalar(x, scope).column.alias(f"c{i}") for i, x in enumerate(e.items)]))
        raise ModelError(f"can't use {e!r} here")

    def scalar(self, e, scope: Scope, near: Element | None = None) -> Bound:
        b = self.bind(e, scope, near)
        if b.leaves is not None:
            raise ModelError(f'"{".".join(e.names)}" is a structure or association and can\'t be used as a value')
        return b

    def ref(self, e: A.Ref, scope: Scope) -> Bound:
        head = e.steps[0].id
        assoc = getattr(scope, "assoc", None)
        if assoc and head == assoc[0]:
            return self.walk(assoc[1], e.steps[1:], e, scope)
        if head == "$self":
            if assoc:
                return self.walk(scope.main, e.steps[1:], e, scope)
            return self.own(e, scope)
        if head == "$main":
            top = scope
            while top.outer is not None:
                top = top.outer
            b = self.walk(top.main, e.steps[1:], e, scope)
            if top is scope:
                return b
            self.correlated = True
            return Bound(b.column.outer(), b.element, b.solid)
        if head.startswith("$") and head != "$source":
            v = self.engine.session.get(e.names)
            return Bound(F.lit(v), solid=v is not None, literal=v, is_literal=True)
        s, out = scope, False
        while s is not None:
            if head in s.sources and len(e.steps) > 1:
                b = self.walk(s.sources[head], e.steps[1:], e, scope)
            else:
                hits = [n for n in s.sources.values() if head in n.entity.elements or head in n.entity.flat()]
                if len(hits) > 1:
                    raise ModelError(f'ambiguous reference to "{head}", write ' + ", ".join(f'"{n.alias}.{head}"' for n in hits))
                if not hits:
                    s, out = s.outer, True
                    continue
                b = self.walk(hits[0], e.steps, e, scope)
            if out:
                b.column = b.column.outer()
                self.correlated = True
            return b
        if head in scope.items and head not in scope.binding:
            return self.own(A.Ref((A.Step("$self"), *e.steps)), scope)
        raise ModelError(f'"{head}" not found in the elements of ' + ", ".join(f'"{n.entity.name}"' for n in scope.sources.values()))

    def own(self, e: A.Ref, scope: Scope) -> Bound:
        """``$self.x``: another column of the select list."""
        name = e.steps[1].id
        if name not in scope.items:
            raise ModelError(f'"{name}" not found in the columns list of the query')
        if name in scope.binding:
            raise ModelError(f'"$self.{name}" refers to itself')
        scope.binding.add(name)
        try:
            return self.bind(scope.items[name].expr, scope)
        finally:
            scope.binding.discard(name)

    def walk(self, node: Node, steps: tuple, whole: A.Ref, scope: Scope) -> Bound:
        prefix, elements, i = "", node.entity.elements, 0
        while True:
            step = steps[i]
            flat = node.entity.flat()
            rest = steps[i + 1 :]
            if step.id not in elements:
                if prefix + step.id in flat:
                    return Bound(node.col(prefix + step.id), flat[prefix + step.id])
                raise ModelError(f'"{step.id}" not found in the elements of "{node.entity.name}"')
            el = elements[step.id]
            if el.is_assoc:
                names = "_".join(s.id for s in rest)
                if rest and step.where is None and not step.args and el.keys and not any(s.where is not None for s in rest):
                    if names in el.keys:  # the foreign key is here: no join
                        return Bound(node.col(f"{prefix}{el.name}_{el.keys[names]}"), _maybe(self.known(el.target), names), el.not_null or el.key)
                if not rest:
                    return Bound(F.lit(None), el, leaves=[(k, node.col(f"{prefix}{el.name}_{s}")) for k, s in (el.keys or {}).items()])
                node = self.child(node, el, step, prefix)
                prefix, elements, i = "", node.entity.elements, i + 1
                continue
            if step.where is not None:
                raise ModelError(f'"{el.name}" is no association, so it takes no filter')
            if el.elements is not None:
                prefix += el.name + "_"
                if not rest:
                    return Bound(F.lit(None), el, leaves=[(n.removeprefix(prefix), node.col(n)) for n, _ in node.entity.leaves(el, prefix[:-1])])
                elements, i = el.elements, i + 1
                continue
            if rest:
                raise ModelError(f'"{rest[0].id}" not found in "{el.name}"')
            if el.virtual:
                raise ModelError(f'"{el.name}" is virtual: it has no value in the tables')
            if el.calc is not None and f"{node.alias}__{prefix}{el.name}" not in node.df.columns:
                inner = Scope(self, {"$source": node})
                return Bound(self.bind(parse_expr(el.calc), inner).column, el)
            return Bound(node.col(prefix + el.name), el, el.key or el.not_null)

    def binary(self, e: A.Bin, scope: Scope) -> Column:
        op = e.op
        if op in ("and", "or"):
            a, b = self.boolean(e.left, scope), self.boolean(e.right, scope)
            return a & b if op == "and" else a | b
        assoc = getattr(scope, "assoc", None)
        if assoc and op == "=":
            back = self.backlink(e, scope.main, *assoc)
            if back is not None:
                return back
        if isinstance(e.left, A.Row) and isinstance(e.right, A.Row):
            both = [self.binary(A.Bin(op, x, y), scope) for x, y in zip(e.left.items, e.right.items)]
            return _and(both) if op in ("=", "==") else reduce(lambda a, b: a | b, both)
        if isinstance(e.left, A.Enum):
            right = self.bind(e.right, scope)
            left = self.bind(e.left, scope, right.element)
        else:
            left = self.bind(e.left, scope)
            right = self.bind(e.right, scope, left.element)
        if left.leaves is not None or right.leaves is not None:
            return self.compare_leaves(op, left, right)
        return self.compare(op, left, right, e)

    def compare(self, op: str, left: Bound, right: Bound, e=None) -> Column:
        a, b = left.column, right.column
        null = right.is_literal and right.literal is None
        if op == "is":
            return a.isNull()
        if op == "=":
            return a.isNull() if null else a == b
        if op == "<>":
            return a != b
        if op == "==":  # never null
            return a.isNull() if null else a == b if left.solid and right.solid else a.eqNullSafe(b)
        if op == "!=":  # never null: rows without a value differ from any value
            return a.isNotNull() if null else a != b if left.solid and right.solid else ~a.eqNullSafe(b)
        if op == "like":
            return F.rlike(a, b) if isinstance(e.right, A.Val) and e.right.regex else F.like(a, b)
        return {
            "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "+": lambda: a + b, "-": lambda: a - b,
            "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b, "||": lambda: F.concat(a.cast("string"), b.cast("string")),
        }[op]()

    def compare_leaves(self, op: str, left: Bound, right: Bound) -> Column:
        """Structures are equal if all leaves are; a structure meets a value only if it has one leaf, and null with all."""
        if op not in ("=", "==", "!=", "<>", "is"):
            raise ModelError(f'structures can be tested for equality only, not with "{op}"')
        if left.leaves is None:
            left, right = right, left
        if right.leaves is None:
            if right.is_literal and right.literal is None or op == "is":
                pairs = [(c, None) for _, c in left.leaves]
            elif len(left.leaves) == 1:
                pairs = [(left.leaves[0][1], right.column)]
            else:
                raise ModelError(f"a structure of {len(left.leaves)} leaves can't be compared with a single value")
        else:
            theirs = dict(right.leaves)
            if set(theirs) != {n for n, _ in left.leaves}:
                raise ModelError("the structures have different leaves")
            pairs = [(c, theirs[n]) for n, c in left.leaves]
        out = []
        for a, b in pairs:
            r = Bound(F.lit(None), literal=None, is_literal=True) if b is None else Bound(b)
            out.append(self.compare(op, Bound(a), r))
        return reduce(lambda a, b: a | b, out) if op in ("!=", "<>") else _and(out)

    def isin(self, e: A.In, scope: Scope) -> Column:
        if isinstance(e.items, A.Select):
            sub = self.subquery(e.items, scope)
            cols = [self.scalar(x, scope).column for x in (e.arg.items if isinstance(e.arg, A.Row) else (e.arg,))]
            hit = (F.struct(*cols) if len(cols) > 1 else cols[0]).isin(sub)
            return ~hit if e.negated else hit
        left = self.bind(e.arg, scope)
        if not e.items:
            return left.column.isNotNull() if e.negated else left.column.isNull()
        if isinstance(e.arg, A.Row):
            hit = reduce(lambda a, b: a | b, [self.binary(A.Bin("=", e.arg, r), scope) for r in e.items])
        else:
            bound = [self.bind(x, scope, left.element) for x in e.items]
            hit = left.column.isin(*[b.literal if b.is_literal else b.column for b in bound])
        return ~hit if e.negated else hit

    def func(self, e: A.Func, scope: Scope) -> Column:
        name = e.name.lower()
        if name == "now":
            return F.lit(self.engine.session.now)
        if name == "session_context":
            key = e.args[0].value
            names = tuple(key.split(".")) if key.startswith("$") else ("$" + key,)
            return F.lit(self.engine.session.get(names))
        if name == "$count":
            return self.related(e.args[0], scope)
        if name == "score":
            cols = e.args[0].items if isinstance(e.args[0], A.Row) else (e.args[0],)
            return self.score(cols, str(e.args[1].value).lower(), scope)
        if name == "search":
            cols = e.args[0].items if isinstance(e.args[0], A.Row) else (e.args[0],)
            return self.matches([self.scalar(c, scope).column for c in cols], (e.args[1].value,))
        args: list = []
        for a in (*e.args, *placed(e.name, len(e.args), e.named)):
            if isinstance(a, A.Val) and a.value == "*" and name == "count":
                continue
            b = self.scalar(a, scope)
            args.append(Literal(b.literal) if b.is_literal else b.column)
        if name in self.engine.own_functions:
            out = self.engine.own_functions[name](*[a.column if isinstance(a, Literal) else a for a in args])
        else:
            out = call(e.name, args, e.distinct)
        if name == "count" and self.engine.count_as_text:
            out = out if e.over is not None else out.cast("string")
        if e.over is None:
            return out
        order = [self.sorted(s, scope) for s in e.over.order]
        w = Window.partitionBy(*[self.scalar(p, scope).column for p in e.over.partition])
        ranked = name in ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "lag", "lead")
        if order:
            w = w.orderBy(*order)
        elif ranked:
            w = w.orderBy(F.lit(1))  # Spark wants an order
        if e.over.frame:
            unit, lo, hi = e.over.frame
            ends = {"-inf": Window.unboundedPreceding, "inf": Window.unboundedFollowing}
            w = getattr(w, f"{unit}Between")(ends.get(lo, lo), ends.get(hi, hi))
        return out.over(w)

    def sorted(self, s: A.Sort, scope: Scope, column: Column | None = None) -> Column:
        """Nulls are lowest by default."""
        c = column if column is not None else self.scalar(s.expr, scope).column
        first = (s.nulls == "first") if s.nulls else not s.desc
        return (c.desc_nulls_first() if first else c.desc_nulls_last()) if s.desc else (c.asc_nulls_first() if first else c.asc_nulls_last())

    # existence -----------------------------------------------------------------------------------------------------

    def subquery(self, q: A.Select, scope: Scope) -> DataFrame:
        inner = Lowering(self.engine, self.params)
        inner.ctes, inner.localized, inner.aliases = self.ctes, self.localized, self.aliases
        out = inner.query(q, outer=scope)
        self.correlated_sub = inner.correlated
        return out

    def target_chain(self, node: Node, steps: tuple, prefix: str = "") -> tuple[Node, Column]:
        """The rows that an exists path ends with, reduced step by step from its end, and how they meet the source row."""
        entity_elements = node.entity.elements
        i = 0
        while i < len(steps) - 1 and steps[i].id in entity_elements and entity_elements[steps[i].id].elements is not None:
            prefix += steps[i].id + "_"
            entity_elements = entity_elements[steps[i].id].elements
            i += 1
        step = steps[i]
        if step.id not in entity_elements:
            raise ModelError(f'"{step.id}" not found in the elements of "{node.entity.name}"')
        assoc = entity_elements[step.id]
        if not assoc.is_assoc:
            raise ModelError(f'exists wants a path that ends with an association; "{".".join(s.id for s in steps)}" does not')
        target = self.known(assoc.target)
        t = self.node(target, self.filtered(target, step.where, {k: self.value(v) for k, v in step.args}), assoc.name)
        cond = self.on(assoc, node, t, prefix)
        if steps[i + 1 :]:
            further, meets = self.target_chain(t, steps[i + 1 :])
            t.df = t.df.join(further.df, meets, "left_semi")
        return t, cond

    def start(self, ref: A.Ref, scope: Scope) -> tuple[Node, tuple]:
        """Where an exists path begins: steps before it that are sources, then the node that has its first association."""
        steps = ref.steps
        if steps[0].id in scope.sources and len(steps) > 1:
            return scope.sources[steps[0].id], steps[1:]
        for n in scope.sources.values():
            if steps[0].id in n.entity.elements:
                return n, steps
        raise ModelError(f'"{steps[0].id}" not found in the elements of ' + ", ".join(f'"{n.entity.name}"' for n in scope.sources.values()))

    def exists(self, e: A.Exists, scope: Scope) -> Column:
        """An existence test inside an expression: a left join with the distinct matches for equal keys, else a correlated subquery."""
        if isinstance(e.arg, A.Select):
            return self.subquery(e.arg, scope).exists()
        node, steps = self.start(e.arg, scope)
        target, _ = self.target_chain(node, steps)
        assoc, prefix = self._first(node, steps)
        pairs = self.equal_keys(assoc, node, target, prefix)
        if pairs is None:
            raise ModelError("an exists path along an unmanaged association must be a condition of its own")
        flag = self.alias("flag")
        keys = target.df.select(*[t.alias(f"{flag}__{i}") for i, (_, t) in enumerate(pairs)]).distinct().withColumn(flag, F.lit(True))
        scope.flags.append((keys, _and([s == F.col(f"{flag}__{i}") for i, (s, _) in enumerate(pairs)])))
        return F.coalesce(F.col(flag), F.lit(False))

    def related(self, ref: A.Ref, scope: Scope) -> Column:
        """``$count(items)``: how many rows an association leads to, 0 if none; counted once per key, then joined."""
        node, steps = self.start(ref, scope)
        target, _ = self.target_chain(node, steps)
        assoc, prefix = self._first(node, steps)
        pairs = self.equal_keys(assoc, node, target, prefix)
        if pairs is None or len(steps) > 1:
            raise ModelError("$count takes one association whose condition is an equality of columns")
        tag = self.alias("count")
        n = target.df.groupBy(*[t.alias(f"{tag}__{i}") for i, (_, t) in enumerate(pairs)]).agg(F.count(F.lit(1)).alias(tag))
        scope.flags.append((n, _and([s == F.col(f"{tag}__{i}") for i, (s, _) in enumerate(pairs)])))
        return F.coalesce(F.col(tag), F.lit(0))

    def _first(self, node: Node, steps: tuple) -> tuple[Element, str]:
        elements, prefix = node.entity.elements, ""
        for s in steps:
            el = elements[s.id]
            if el.is_assoc:
                return el, prefix
            prefix, elements = prefix + s.id + "_", el.elements
        raise ModelError("no association")

    def key_names(self, assoc: Element, target: Entity, prefix: str = "") -> list[tuple[str, str]] | None:
        """(source column, target column) pairs if the association means that these are equal, else None."""
        if assoc.keys:
            return [(f"{prefix}{assoc.name}_{s}", k) for k, s in assoc.keys.items()]
        out = []
        for c in conjuncts(parse_expr(assoc.on)):
            if not (isinstance(c, A.Bin) and c.op in ("=", "==") and isinstance(c.left, A.Ref) and isinstance(c.right, A.Ref)):
                return None
            for a, b in ((c.left, c.right), (c.right, c.left)):
                if a.steps[0].id == assoc.name:
                    if b.names == ("$self",):
                        back = _element(target, a.steps[1].id)
                        if not back.keys:
                            return None
                        out += [(k, f"{back.name}_{s}") for k, s in back.keys.items()]
                    else:
                        mine = b.names[1:] if b.names[0] == "$self" else b.names
                        out.append(("_".join(mine), "_".join(a.names[1:])))
                    break
            else:
                return None
        return out

    def equal_keys(self, assoc: Element, source: Node, target: Node, prefix: str) -> list[tuple[Column, Column]] | None:
        names = self.key_names(assoc, target.entity, prefix)
        return None if names is None else [(source.col(a), target.col(b)) for a, b in names]

    def where(self, df: DataFrame, e, scope: Scope) -> DataFrame:
        """Filters; existence tests that stand alone become semi and anti joins."""
        plain, semi = [], []
        for c in conjuncts(e):
            inner, how = (c.arg, "left_anti") if isinstance(c, A.Not) and isinstance(c.arg, A.Exists) else (c, "left_semi")
            if isinstance(inner, A.Exists) and isinstance(inner.arg, A.Ref):
                node, steps = self.start(inner.arg, scope)
                target, cond = self.target_chain(node, steps)
                semi.append((target.df, cond, how))
            elif isinstance(inner, A.In) and isinstance(inner.items, A.Select) and not inner.negated and how == "left_semi" and not isinstance(inner.arg, A.Row):
                sub = self.subquery(inner.items, scope)
                left = self.scalar(inner.arg, scope).column
                name = self.alias("in")
                semi.append((sub.toDF(f"{name}__v"), left == F.col(f"{name}__v"), "left_semi"))
            elif (never := self.not_in(c, scope)) is not None:
                sub, left, keep = never
                name = self.alias("in")
                semi.append((sub.toDF(f"{name}__v"), left == F.col(f"{name}__v"), "left_anti"))
                plain.append(keep)
            else:
                plain.append(self.boolean(c, scope))
        df = self.joined(df, list(scope.sources.values()))
        for keys, cond in scope.flags:
            df = df.join(keys, cond, "left")
        scope.flags = []
        if plain:
            df = df.where(_and(plain))
        for t, cond, how in semi:
            df = df.join(t, cond, how)
        return df

    def not_in(self, c, scope: Scope) -> tuple[DataFrame, Column, Column] | None:
        """For ``x not in (query)`` as a condition of its own: the query, x, and what else has to hold besides that no row matches.

        Nothing else if the query is empty; if not, neither x nor any row of the query may be null. The hash anti join of
        Spark that knows nulls would send the whole query to all executors; this one needs two counts.
        """
        if isinstance(c, A.Not) and isinstance(c.arg, A.In) and not c.arg.negated:
            c = A.In(c.arg.arg, c.arg.items, True)
        if not (isinstance(c, A.In) and isinstance(c.items, A.Select) and c.negated and not isinstance(c.arg, A.Row)):
            return None
        sub = self.subquery(c.items, scope)
        left = self.scalar(c.arg, scope).column
        if self.correlated_sub or scope.outer is not None:
            return None
        v = F.col(f"`{sub.columns[0]}`")
        counts = sub.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count(v).alias("known")).alias("c")).scalar()
        return sub, left, (counts["n"] == 0) | (left.isNotNull() & (counts["n"] == counts["known"]))

    # search --------------------------------------------------------------------------------------------------------

    def matches(self, cols: list[Column], terms: tuple) -> Column:
        """Some column contains the first term, or all terms if the engine says so, whatever the case."""
        words: list[str] = []
        for t in terms:
            words += _terms(t)
        words = words if self.engine.search_all_terms else words[:1]
        if not cols or not words:
            return F.lit(False) if words else F.lit(True)
        return _and([reduce(lambda a, b: a | b, [F.coalesce(self.hit(F.lower(c.cast("string")), w.lower()), F.lit(False)) for c in cols]) for w in words])

    def hit(self, text: Column, term: str) -> Column:
        """Contains the term; with a fuzzy threshold also some word that is at least that similar to it."""
        found = F.contains(text, F.lit(term))
        return found if self.engine.fuzzy is None else found | F.exists(F.split(text, r"\W+"), lambda w: self.likeness(w, term) >= self.engine.fuzzy)

    @staticmethod
    def likeness(word: Column, term: str) -> Column:
        return F.lit(1.0) - F.levenshtein(word, F.lit(term)) / F.greatest(F.length(word), F.lit(len(term)))

    def score(self, cols: tuple, term: str, scope: Scope) -> Column:
        """How well the best word of the columns fits the term (1: contained), by the weight that the model gives each column."""
        out = []
        for c in cols:
            b = self.scalar(c, scope)
            text = F.lower(F.coalesce(b.column.cast("string"), F.lit("")))
            best = F.array_max(F.transform(F.split(text, r"\W+"), lambda w: self.likeness(w, term)))
            out.append(F.when(F.contains(text, F.lit(term)), 1.0).otherwise(best) * RANKING[(b.element.ranking if b.element else None) or "MEDIUM"])
        return F.greatest(*out) if len(out) > 1 else out[0]

    def found(self, node: Node, df: DataFrame, terms: tuple, above: tuple[str, ...] = ()) -> tuple[DataFrame, Column]:
        """``df`` with what a condition needs that tells whether the node's row, or one that its searchable associations lead to, has the terms."""
        direct, deep = [], []
        elements = node.entity.elements.values()
        listed = any(e.searchable for e in elements)
        for e in elements:
            if e.searchable is False or e.virtual or e.hidden:
                continue
            if e.is_assoc:
                if e.searchable and e.target not in above:
                    deep.append(e)
            elif e.searchable or (not listed and e.type in ("String", "LargeString") and e.calc is None):
                direct.append(self.bind(A.Ref((A.Step(e.name),)), Scope(self, {"$source": node})).column)
        if not direct and listed and all(e.is_assoc for e in elements if e.searchable):
            direct = [node.col(e.name) for e in elements if e.type in ("String", "LargeString") and e.searchable is not False and e.calc is None]
        hit = self.matches(direct, terms) if direct or not deep else F.lit(False)
        # associations: rows that any related row matches, by key, so that none is multiplied
        for e in deep:
            target = self.known(e.target)
            t = self.node(target, self.entity_rows(target), e.name)
            pairs = self.equal_keys(e, node, t, "")
            if pairs is None:
                raise ModelError(f'"{e.name}" can\'t be searched: its condition isn\'t an equality of columns')
            tdf, there = self.found(t, t.df, terms, (*above, node.entity.name))
            flag = self.alias("found")
            keys = tdf.where(there).select(*[y.alias(f"{flag}__{i}") for i, (_, y) in enumerate(pairs)]).distinct().withColumn(flag, F.lit(True))
            df = df.join(keys, _and([x == F.col(f"{flag}__{i}") for i, (x, _) in enumerate(pairs)]), "left")
            hit = hit | F.coalesce(F.col(flag), F.lit(False))
        return df, hit

    def search(self, terms: tuple, scope: Scope, df: DataFrame) -> DataFrame:
        df, hit = self.found(scope.main, df, terms)
        return df.where(hit)

    # queries -------------------------------------------------------------------------------------------------------

    def query(self, q: A.Select, outer: Scope | None = None, extra: list[tuple[str, A.Ref | Column]] | None = None) -> DataFrame:
        if q.unions:
            first = copy.copy(q)
            first.unions = []
            out = self.query(first, outer)
            for every, u in q.unions:
                out = out.union(self.query(u, outer))
                out = out if every else out.distinct()
            return out
        for name, sub in q.ctes:
            inner = Lowering(self.engine, self.params)
            inner.ctes = dict(self.ctes)
            self.ctes[name] = self.repeated(name, sub, inner) if any(_mentions(u, name) for _, u in _unions(sub)) else inner.query(sub)
        self.localized = self.localized or q.localized
        if q.source is None:
            scope = Scope(self, {}, outer)
            items = self.items(q.items or (), scope, q.excluding)
            return self.engine.spark.range(1).select(*[self.scalar(i.expr, scope).column.alias(n) for n, i in items.items()])
        if isinstance(q.source, A.Join) and q.items is None:
            raise ModelError("a join needs a list of columns")
        if q.recurse is not None:
            return recursed(self, q, outer)
        if isinstance(q.source, A.Table) and q.source.ref is not None:
            q = _merged(q, (q.source.path or q.source.ref.steps)[-1].rest)
        sources, df = self.table(q.source, outer)
        scope = Scope(self, sources, outer)
        return self.select(q, scope, df)

    def repeated(self, name: str, sub: A.Select, inner: Lowering) -> DataFrame:
        """A query that refers to itself: the parts that do see the rows of the last round, until no round gives any. Without ALL a row comes once."""
        parts = [(True, copy.copy(sub)), *_unions(sub)]
        parts = [(every, copy.copy(u)) for every, u in parts]
        for _, u in parts:
            u.unions = []
        every = all(e for e, _ in parts)
        starts = [inner.query(u) for _, u in parts if not _mentions(u, name)]
        if not starts:
            raise ModelError(f'"{name}" refers to itself and has nothing to start from')
        rows = reduce(DataFrame.union, starts)
        rows = done = written(rows if every else rows.distinct(), name)
        for _ in range(self.engine.most_rounds):
            inner.ctes[name] = rows
            step = reduce(DataFrame.union, [inner.query(u) for _, u in parts if _mentions(u, name)])
            step = step.select(*[F.col(f"`{c}`").cast(f.dataType).alias(f.name) for c, f in zip(step.columns, done.schema)])
            rows = written(step if every else step.distinct().subtract(done), name)
            if rows.isEmpty():
                return done
            done = done.union(rows)
        raise ModelError(f'"{name}" still gives rows after {self.engine.most_rounds} rounds')

    def items(self, items: tuple | None, scope: Scope, excluding: tuple = ()) -> dict[str, A.Item]:
        """Names of the result in order: ``*`` expanded, later items replacing columns of the same name in place."""
        out: dict[str, A.Item] = {}
        items = (A.Item(star=True),) if items is None or items == () else items
        if sum(i.star for i in items) > 1:
            raise ModelError('"*" may come only once in a list of columns')
        at = next((k for k, i in enumerate(items) if i.star), None)
        for k, i in enumerate(items):
            if i.star:
                seen: dict[str, list[str]] = {}
                for alias, n in scope.sources.items():
                    for c in n.entity.flat():
                        if c not in excluding and c not in out:
                            seen.setdefault(c, []).append(alias)
                clash = [c for c, s in seen.items() if len(s) > 1 and not any(_name(j) == c for j in items if not j.star)]
                if clash:
                    raise ModelError("several sources of \"*\" have the same columns: " + ", ".join(f'select "{c}" explicitly with ' + ", ".join(f'"{a}.{c}"' for a in seen[c]) for c in clash))
                for c, s in seen.items():
                    out[c] = A.Item(A.Ref((A.Step(s[0]), A.Step(c)) if len(scope.sources) > 1 else (A.Step(c),)), c)
                continue
            if isinstance(i.expr, A.Ref) and self.is_elsewhere(i, scope):
                continue
            if i.expand is not None and isinstance(i.expr, A.Ref) and self.is_structure(i.expr, scope):
                i = A.Item(i.expr, i.alias, inline=i.expand, excluding=i.excluding)  # a structure is stored flat, and stays so
            if i.inline is not None:
                for n, j in self.inlined(i, scope).items():
                    if n in out:
                        raise ModelError(f'the column "{n}" is defined twice')
                    out[n] = j
                continue
            if i.expand is None and isinstance(i.expr, A.Ref):
                b = self.peek_leaves(i.expr, scope)
                if b:
                    base = i.alias or "_".join(i.expr.names if i.expr.names[0] not in scope.sources else i.expr.names[1:])
                    for leaf in b:
                        out[f"{base}_{leaf}"] = A.Item(A.Ref((*i.expr.steps, *(A.Step(x) for x in [leaf]))), f"{base}_{leaf}")
                    # a column list names each foreign key once
                    continue
                if b == []:
                    continue
            n = _name(i, scope)
            if n is None:
                raise ModelError("an expression in a list of columns needs a name: write \"... as name\"")
            if n in out and not (at is not None and k > at):
                raise ModelError(f'the column "{n}" is defined twice')
            out[n] = i
        return out

    def peek_leaves(self, ref: A.Ref, scope: Scope) -> list[str] | None:
        """Leaf names if a reference ends with a structure or a managed association; [] for an unmanaged one."""
        if ref.names[0].startswith("$"):
            return None
        steps = ref.steps[1:] if ref.names[0] in scope.sources and len(ref.steps) > 1 else ref.steps
        node = scope.sources.get(ref.names[0]) if len(steps) < len(ref.steps) else next((n for n in scope.sources.values() if steps[0].id in n.entity.elements), None)
        if node is None:
            return None
        entity, elements = node.entity, node.entity.elements
        for k, s in enumerate(steps):
            if s.id not in elements:
                return None
            e = elements[s.id]
            if k == len(steps) - 1:
                if e.virtual:
                    return []
                if e.elements is not None:
                    return [n.removeprefix(e.name + "_") for n, _ in entity.leaves(e, e.name)]
                return list(e.keys or {}) if e.is_assoc else None
            if e.is_assoc:
                entity = self.known(e.target)
                elements = entity.elements
            elif e.elements is not None:
                elements = e.elements
            else:
                return None
        return None

    def is_elsewhere(self, i: A.Item, scope: Scope) -> bool:
        """Whether the column lies in an entity that has no rows here; such columns are left out. Foreign keys are here."""
        names = i.expr.names
        if names[0].startswith("$"):
            return False
        steps = i.expr.steps[1:] if names[0] in scope.sources and len(names) > 1 else i.expr.steps
        entity = next((n.entity for n in scope.sources.values() if names[0] not in scope.sources and steps[0].id in n.entity.elements), None)
        entity = scope.sources[names[0]].entity if names[0] in scope.sources and len(names) > 1 else entity
        elements = entity.elements if entity is not None else {}
        for k, s in enumerate(steps):
            e = elements.get(s.id)
            if e is None:
                return False
            if e.is_assoc:
                if not self.known(e.target).persisted:
                    rest = "_".join(x.id for x in steps[k + 1 :])
                    return i.expand is not None or i.inline is not None or (bool(rest) and rest not in (e.keys or {}))
                elements = self.known(e.target).elements
            else:
                elements = e.elements or {}
        return False

    def is_structure(self, ref: A.Ref, scope: Scope) -> bool:
        node, steps = self.start(ref, scope)
        elements, e = node.entity.elements, None
        for s in steps:
            e = (elements or {}).get(s.id)
            if e is None:
                return False
            elements = self.known(e.target).elements if e.is_assoc else e.elements
        return e is not None and not e.is_assoc and e.elements is not None

    def inlined(self, i: A.Item, scope: Scope) -> dict[str, A.Item]:
        """``author.{name, x}``: the inner columns, named with the path in front."""
        base = i.alias or "_".join(i.expr.names)
        out: dict[str, A.Item] = {}
        inner = i.inline
        for j in inner:
            if j.star:
                for c in self.flat_of(i.expr, scope):
                    if c not in i.excluding and not any(_name(x) == c for x in inner if not x.star):
                        out[f"{base}_{c}"] = A.Item(A.Ref((*i.expr.steps, A.Step(c))))
            elif isinstance(j.expr, A.Ref):
                n = j.alias or "_".join(j.expr.names)
                out[f"{base}_{n}"] = A.Item(A.Ref((*i.expr.steps, *j.expr.steps)), inline=None)
            else:
                raise ModelError("a flat projection takes columns, no expressions")
        return out

    def flat_of(self, ref: A.Ref, scope: Scope) -> list[str]:
        node, steps = self.start(ref, scope)
        entity, elements = node.entity, node.entity.elements
        for s in steps:
            e = _element_of(elements, s.id, entity.name)
            if e.is_assoc:
                entity = self.known(e.target)
                elements = entity.elements
            elif e.elements is not None:
                elements = e.elements
            else:
                raise ModelError(f'"{s.id}" is a plain column: nothing can be projected from it')
        if elements is entity.elements:
            return list(entity.flat())
        return [n for e in elements.values() for n, _ in entity.leaves(e, e.name)]

    def select(self, q: A.Select, scope: Scope, df: DataFrame) -> DataFrame:
        names = self.items(q.items, scope, q.excluding)
        scope.items = {n: i for n, i in names.items() if i.expand is None}
        if not names:
            raise ModelError("no column is left to select")
        grouped = bool(q.group) or any(_has_aggregate(i.expr) for i in names.values() if i.expand is None)
        if q.having is not None and not q.group and not _has_aggregate(q.having):
            raise ModelError("HAVING needs a GROUP BY or an aggregate")
        # bind everything before joining: paths grow the join tree
        group: list[tuple[A.Ref | object, Column]] = []
        for g in q.group:
            leaves = self.peek_leaves(g, scope) if isinstance(g, A.Ref) else None
            for e in [A.Ref((*g.steps, A.Step(x))) for x in leaves] if leaves else [g]:
                group.append((e, self.scalar(e, scope).column))
        columns: dict[str, Column] = {}
        for n, i in names.items():
            if i.expand is None:
                columns[n] = self.scalar(i.expr, scope).column
            elif self.is_many(i, scope):
                columns[n] = self.to_many(i, scope)
            else:
                columns[n] = self.to_one(i, scope, [g for g, _ in group] if grouped else None)
        having = self.boolean(q.having, scope) if q.having is not None else None
        order = []
        for s in q.order:
            if isinstance(s.expr, A.Ref) and len(s.expr.steps) == 1 and s.expr.names[0] in columns:
                order.append((s, None, s.expr.names[0]))
            elif isinstance(s.expr, A.Ref) and (leaves := self.peek_leaves(s.expr, scope)):
                if len(leaves) > 1:
                    raise ModelError(f'"{".".join(s.expr.names)}" has {len(leaves)} leaves, so order by needs one of them')
                order.append((s, self.scalar(A.Ref((*s.expr.steps, A.Step(leaves[0]))), scope).column, None))
            else:
                order.append((s, self.scalar(s.expr, scope).column, None))
        df = self.where(df, q.where, scope)
        if q.search and not grouped:
            df = self.search(q.search, scope, df)
        extras = [c.alias(f"__o{k}") for k, (_, c, n) in enumerate(order) if n is None]
        if grouped:
            if having is not None:
                extras.append(having.alias("__having"))
            if scope.nested:
                raise ModelError("a to-many expand can't be grouped")
            results = [*[c.alias(n) for n, c in columns.items()], *extras]
            if group:
                df = df.groupBy(*[c for _, c in group]).agg(*results)
                df = df.select(*[f"`{n}`" for n in columns], *[x for x in df.columns if x.startswith("__o") or x == "__having"])
            else:
                df = df.select(*results)  # one row; unlike groupBy this may refer to an outer query
            if having is not None:
                df = df.where("__having").drop("__having")
            if q.search:
                # the texts that the groups have: columns grouped by, and results of aggregates
                text = {c for c, t in df.dtypes if t == "string"}
                df = df.where(self.matches([F.col(f"`{n}`") for n, i in names.items() if n in text and isinstance(i.expr, (A.Ref, A.Func))], q.search))
        else:
            for attach in scope.nested:
                df = attach(df, q.where is not None or bool(q.search))
            df = df.select(*[c.alias(n) for n, c in columns.items()], *extras)
        if q.distinct:
            df = df.distinct()
        if order:
            text = {c for c, t in df.dtypes if t == "string"} if self.engine.collation else set()
            keys = [n or f"__o{k}" for k, (_, _, n) in enumerate(order)]
            cols = [F.collate(F.col(f"`{k}`"), self.engine.collation) if k in text else F.col(f"`{k}`") for k in keys]
            df = df.orderBy(*[self.sorted(s, scope, c) for (s, _, _), c in zip(order, cols)])
        limit = 1 if q.one else q.limit
        if q.offset:
            df = df.offset(q.offset)
        if limit is not None:
            df = df.limit(limit)
        return df.drop(*[f"__o{k}" for k in range(len(order))]) if extras else df

    # nested results ------------------------------------------------------------------------------------------------

    def is_many(self, i: A.Item, scope: Scope) -> bool:
        if i.expr is None:
            return False
        node, steps = self.start(i.expr, scope)
        elements = node.entity.elements
        for s in steps:
            e = _element_of(elements, s.id, node.entity.name)
            if e.is_assoc:
                if e.many:
                    return True
                elements = self.known(e.target).elements
            elif e.elements is not None:
                elements = e.elements
            else:
                raise ModelError(f'"{s.id}" is a plain column: nothing can be projected from it')
        return False

    def to_one(self, i: A.Item, scope: Scope, grouped: list | None) -> Column:
        """A structure of the target's columns, or null where there is no target."""
        if i.expr is None:
            inner = self.items(i.expand, scope)
            return F.struct(*[self.scalar(x.expr, scope).column.alias(n) for n, x in inner.items()])
        base = i.expr.steps
        cols: dict[str, Column] = {}
        for j in i.expand:
            if j.star:
                if grouped is None:
                    for c in self.flat_of(i.expr, scope):
                        cols[c] = self.scalar(A.Ref((*base, A.Step(c))), scope).column
                continue
            if j.expand is not None:
                nested = copy.copy(j)
                object.__setattr__(nested, "expr", A.Ref((*base, *j.expr.steps)))
                if self.is_many(nested, scope):
                    if grouped is not None:
                        raise ModelError("a to-many expand can't be grouped")
                    cols[j.alias or j.expr.names[-1]] = self.to_many(nested, scope)
                else:
                    cols[j.alias or j.expr.names[-1]] = self.to_one(nested, scope, grouped)
                continue
            full = _prefixed(j.expr, base)
            if grouped is not None and isinstance(j.expr, A.Ref) and full not in grouped:
                raise ModelError(f'"{".".join(full.names)}" isn\'t among the columns that the query groups by')
            cols[j.alias or _name(j)] = self.scalar(full, scope).column
        out = F.struct(*[c.alias(n) for n, c in cols.items()])
        node, steps = self.start(i.expr, scope)
        e = _element_of(node.entity.elements, steps[-1].id, node.entity.name) if len(steps) == 1 else None
        if grouped is not None or (e is not None and not e.is_assoc):
            return out
        keys = self._target_entity(i.expr, scope).keys()
        there = [self.scalar(A.Ref((*base, A.Step(k))), scope).column.isNotNull() for k in keys] if i.expr.steps[-1].where is None else None
        if there is None:
            last = self.walk_node(i.expr, scope)
            there = [last.col(k).isNotNull() for k in keys]
        return F.when(_and(there), out)

    def walk_node(self, ref: A.Ref, scope: Scope) -> Node:
        """The join node that a path of associations ends in."""
        node, steps = self.start(ref, scope)
        for s in steps:
            node = self.child(node, _element(node.entity, s.id), s, "")
        return node

    def _target_entity(self, ref: A.Ref, scope: Scope) -> Entity:
        node, steps = self.start(ref, scope)
        entity, elements = node.entity, node.entity.elements
        for s in steps:
            e = _element_of(elements, s.id, entity.name)
            if e.is_assoc:
                entity = self.known(e.target)
                elements = entity.elements
            else:
                elements = e.elements
        return entity

    def to_many(self, i: A.Item, scope: Scope) -> Column:
        """An array of structures per row, [] where there are none; the join that brings it is left in ``scope.nested``.

        To-one steps at the start of the path are joined to the row. The rest leads to the rows that are aggregated by their keys once and then joined; order and limit
        hold within a parent, by a rank, and so do groups. If the parents are filtered, a semi join by the same keys comes first: it needs no other shuffle,
        and only their children are packed. Where the condition isn't an equality of columns, the parents, by their keys, meet the targets in a join of their own.
        """
        node, steps = self.start(i.expr, scope)
        prefix, at = "", 0
        elements = node.entity.elements
        while True:
            e = _element_of(elements, steps[at].id, node.entity.name)
            if e.is_assoc and e.many:
                break
            if e.is_assoc:
                node = self.child(node, e, steps[at], prefix)
                prefix, elements = "", node.entity.elements
            else:
                prefix, elements = prefix + e.name + "_", e.elements or {}
            at += 1
        inner = Lowering(self.engine, self.params)
        inner.ctes, inner.localized, inner.aliases = self.ctes, self.localized, self.aliases
        target = self.known(e.target)
        t = first = inner.node(target, inner.filtered(target, steps[at].where), e.name)
        pairs = inner.equal_keys(e, node, first, prefix)
        cond = inner.on(e, node, first, prefix) if pairs is None else None
        for s in steps[at + 1 :]:
            further = _element(t.entity, s.id)
            if not further.is_assoc:
                raise ModelError(f'"{s.id}" is no association of "{t.entity.name}"')
            target = self.known(further.target)
            n = inner.node(target, inner.filtered(target, s.where), further.name)
            n.df = t.df.join(n.df, inner.on(further, t, n, ""))
            t = n
        iscope = Scope(inner, {steps[-1].id: t})
        cols = inner.items(i.expand, iscope, i.excluding)
        iscope.items = {n: x for n, x in cols.items() if x.expand is None}
        grouped = bool(i.group) or any(_has_aggregate(x.expr) for x in cols.values() if x.expand is None)
        if i.having is not None and not grouped:
            raise ModelError("HAVING needs a GROUP BY or an aggregate")
        made: dict[str, Column] = {}
        groups = [inner.scalar(g, iscope).column for g in i.group]
        for n, x in cols.items():
            if x.expand is None:
                made[n] = inner.scalar(x.expr, iscope).column
            elif inner.is_many(x, iscope):
                made[n] = inner.to_many(x, iscope)
            else:
                made[n] = inner.to_one(x, iscope, list(i.group) if grouped else None)
        having = inner.boolean(i.having, iscope) if i.having is not None else F.lit(True)
        order = [(s, made[s.expr.names[0]] if isinstance(s.expr, A.Ref) and len(s.expr.steps) == 1 and s.expr.names[0] in made else inner.scalar(s.expr, iscope).column) for s in i.order]
        if grouped and iscope.nested:
            raise ModelError("a to-many expand can't be grouped")
        tag = self.alias("expand")
        ranked = bool(order) or i.limit is not None or bool(i.offset)
        keys = node.entity.keys()
        if pairs is None and not keys:
            raise ModelError(f'"{e.name}" can\'t be expanded: its condition isn\'t an equality of columns, and "{node.entity.name}" has no key')
        parents = [s for s, _ in pairs] if pairs is not None else [node.col(k) for k in keys]

        def attach(df: DataFrame, reduced: bool) -> DataFrame:
            rows = t.df
            if pairs is None:
                source = df.select(*[c for c in node.df.columns if c in df.columns]).dropDuplicates([f"{node.alias}__{k}" for k in keys])
                rows = rows.join(source, cond)
            elif reduced:
                wanted = df.select(*[s.alias(f"{tag}__p{k}") for k, s in enumerate(parents)]).distinct()
                rows = rows.join(wanted, _and([c == F.col(f"{tag}__p{k}") for k, (_, c) in enumerate(pairs)]), "left_semi")
            child = inner.where(rows, i.where, iscope)
            if i.search:
                child = inner.search(i.search, iscope, child)
            for further in iscope.nested:
                child = further(child, reduced or i.where is not None)
            fk = [f"__fk{k}" for k in range(len(parents))]
            of = [(c if pairs is None else pairs[k][1]).alias(fk[k]) for k, c in enumerate(parents)]
            sorts = [c.alias(f"__o{k}") for k, (_, c) in enumerate(order)]
            values = [c.alias(f"__c{k}") for k, c in enumerate(made.values())]
            if grouped:
                child = child.groupBy(*of, *[g.alias(f"__g{k}") for k, g in enumerate(groups)]).agg(*values, *sorts, having.alias("__having")).where("__having")
            else:
                child = child.select(*of, *values, *sorts)
            row = F.struct(*[F.col(f"__c{k}").alias(n) for k, n in enumerate(made)])
            rank = F.row_number().over(Window.partitionBy(*fk).orderBy(*[inner.sorted(s, iscope, F.col(f"__o{k}")) for k, (s, _) in enumerate(order)] or [F.lit(1)]))
            child = child.select(*fk, row.alias("__row"), *([rank.alias("__rn")] if ranked else []))
            if i.limit is not None or i.offset:
                child = child.where((F.col("__rn") > i.offset) & (F.col("__rn") <= i.offset + (i.limit if i.limit is not None else 2_147_483_000)))
            if not ranked:
                packed = F.collect_list("__row")
            else:
                packed = F.collect_list(F.struct("__rn", "__row"))
                # the rank is unique within a parent, so the order of the structures is that of the ranks
                plain = not any(x in child.schema["__row"].dataType.simpleString() for x in ("map<", "variant"))
                packed = F.transform(F.array_sort(packed) if plain else F.array_sort(packed, lambda a, b: a["__rn"] - b["__rn"]), lambda x: x["__row"])
            lists = child.groupBy(*fk).agg(packed.alias(f"{tag}__list")).select(*[F.col(k).alias(f"{tag}__{k}") for k in fk], f"{tag}__list")
            return df.join(lists, _and([s == F.col(f"{tag}__{k}") for s, k in zip(parents, fk)]), "left")

        scope.nested.append(attach)
        return F.coalesce(F.col(f"{tag}__list"), F.array())


def _unions(q: A.Select) -> list[tuple[bool, A.Select]]:
    """The further parts of a union, flat."""
    return [x for every, u in q.unions for x in ((every, u), *_unions(u))]


def _mentions(q: A.Select, name: str) -> bool:
    def there(t) -> bool:
        if isinstance(t, A.Join):
            return there(t.left) or there(t.right)
        if not isinstance(t, A.Table):
            return False
        return _mentions(t.query, name) if t.query is not None else t.ref.steps[0].id == name

    return there(q.source)


def _merged(q: A.Select, rest: A.Select | None) -> A.Select:
    """A query with what the brackets of its source say besides a filter."""
    if rest is None:
        return q
    q = copy.copy(q)
    q.group, q.order, q.search = q.group or rest.group, q.order or rest.order, q.search or rest.search
    q.having = A.Bin("and", rest.having, q.having) if rest.having is not None and q.having is not None else q.having if rest.having is None else rest.having
    q.limit = min((x for x in (q.limit, rest.limit) if x is not None), default=None)
    q.offset = q.offset or rest.offset
    return q


def _terms(text: str) -> list[str]:
    import re

    return [a or b for a, b in re.findall(r'"([^"]+)"|(\S+)', text)]


def _free_entity(name: str, df: DataFrame) -> Entity:
    return Entity(name, {c: Element(c, {"string": "String"}.get(t, t)) for c, t in df.dtypes})


def _element(entity: Entity, name: str) -> Element:
    return _element_of(entity.elements, name, entity.name)


def _element_of(elements: dict[str, Element], name: str, where: str) -> Element:
    if name not in elements:
        raise ModelError(f'"{name}" not found in the elements of "{where}"')
    return elements[name]


def _maybe(entity: Entity, name: str) -> Element | None:
    return entity.elements.get(name)


def _prefixed(e, base: tuple):
    """The expression seen from the source: its references begin with ``base``."""
    if isinstance(e, A.Ref):
        return e if e.names[0].startswith("$") else A.Ref((*base, *e.steps))
    if isinstance(e, A.Func):
        return A.Func(e.name, tuple(_prefixed(a, base) for a in e.args), e.named, e.distinct, e.over)
    if isinstance(e, A.Bin):
        return A.Bin(e.op, _prefixed(e.left, base), _prefixed(e.right, base))
    if isinstance(e, (A.Not, A.Neg)):
        return type(e)(_prefixed(e.arg, base))
    if isinstance(e, A.Cast):
        return A.Cast(_prefixed(e.arg, base), e.type)
    if isinstance(e, A.Case):
        return A.Case(tuple((_prefixed(c, base), _prefixed(v, base)) for c, v in e.whens), _prefixed(e.other, base) if e.other is not None else None)
    return e


def _name(i: A.Item, scope: Scope | None = None) -> str | None:
    """The alias, else the joined steps of a path, a function's name or a value."""
    if i.alias:
        return i.alias
    if isinstance(i.expr, A.Ref):
        names = i.expr.names
        if scope is not None and names[0] in scope.sources and len(names) > 1 or names[0] in ("$self", "$main"):
            names = names[1:]
        return "_".join(names)
    if isinstance(i.expr, A.Func):
        return i.expr.name
    if isinstance(i.expr, A.Val):
        return str(i.expr.value)
    return None


def _has_aggregate(e) -> bool:
    if isinstance(e, A.Func):
        return (e.over is None and e.name.lower() in AGGREGATES) or any(_has_aggregate(a) for a in e.args)
    if isinstance(e, A.Bin):
        return _has_aggregate(e.left) or _has_aggregate(e.right)
    if isinstance(e, (A.Not, A.Neg, A.Cast)):
        return _has_aggregate(e.arg)
    if isinstance(e, A.Case):
        return any(_has_aggregate(c) or _has_aggregate(v) for c, v in e.whens) or _has_aggregate(e.other)
    if isinstance(e, A.Between):
        return any(_has_aggregate(x) for x in (e.arg, e.low, e.high))
    if isinstance(e, A.In):
        return _has_aggregate(e.arg)
    return False


from .recursion import recursed  # noqa: E402  (it needs the classes above)
