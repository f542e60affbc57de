"""Insert, upsert, update and delete over a store, for flat rows and for documents with compositions.

Everything works on whole sets: an upsert is one full outer join on the keys, an update one conditional projection, a delete one anti
filter. Conditions may follow association paths; they are then reduced to keys by a semi join first.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..engine import Engine
from ..model import Element, Entity, ModelError
from ..plans import ast as A
from ..plans.lower import Lowering, Scope
from ..plans.parser import parse, parse_expr
from ..sources.files import schema_of
from ..sources.store import Store


class Inserted(int):
    """How many rows an insert added; ``keys`` are their keys, generated ones included, as a DataFrame."""

    keys: DataFrame

    @staticmethod
    def of(n: int, keys: DataFrame) -> Inserted:
        out = Inserted(n)
        out.keys = keys
        return out


class Writer:
    """Writes to the entities of an engine, kept in a store. Reads through the engine see what was committed, or staged by this writer."""

    def __init__(self, engine: Engine, store: Store, strict: bool = True, depth: int = 3):
        self.engine, self.store, self.strict, self.depth = engine, store, strict, depth
        for n, e in engine.model.entities.items():
            if e.query is None and n in store.tables():
                self._refresh(n)

    def _refresh(self, name: str) -> None:
        if name in self.store.tables():
            self.engine.bind(name, self.store.read(name))
        else:
            self.engine.tables.pop(name, None)

    def _entity(self, name: str) -> Entity:
        e = self.engine.model.entity(name)
        if e.query is not None:
            raise ModelError(f'"{name}" is a view; write to its table')
        return e

    def _table(self, name: str) -> tuple[str, dict[str, str]]:
        """The table behind a view that only picks and renames columns of one table, and its columns by those of the view."""
        e = self.engine.model.entity(name)
        names: dict[str, str] = {}
        if e.query is None:
            return name, names
        q = parse(e.query)
        plain = isinstance(q.source, A.Table) and q.source.ref is not None and not q.source.path and not q.group and not q.unions and q.limit is None
        if not plain:
            raise ModelError(f'"{name}" is no view of one table; write to its tables')
        base, inner = self._table(q.source.ref.names[0])
        for i in q.items or (A.Item(star=True),):
            if i.star:
                names |= {c: inner.get(c, c) for c in self.engine.model.entity(base).flat() if c not in q.excluding}
            elif isinstance(i.expr, A.Ref) and len(i.expr.steps) == 1:
                c = i.expr.names[0]
                names[i.alias or c] = inner.get(c, c)
        return base, names

    def _through(self, name: str, data):
        """Data written to a view, with the names of its table."""
        base, names = self._table(name)
        if not names or isinstance(data, str):
            return base, data
        if isinstance(data, DataFrame):
            return base, data.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in data.columns])
        return base, [{names.get(k, k): v for k, v in dict(r).items()} for r in data]

    def create(self, name: str, if_not_exists: bool = False) -> None:
        self.store.create(name, schema_of(self._entity(name)), if_not_exists)
        self._refresh(name)

    def begin(self) -> None:
        self.store.begin()

    def commit(self) -> None:
        """Makes the changes since ``begin`` visible to all, or raises Conflict if another writer was first."""
        try:
            self.store.commit()
        finally:
            self._refresh_all()

    def rollback(self) -> None:
        self.store.rollback()
        self._refresh_all()

    def _refresh_all(self) -> None:
        for n in list(self.engine.tables):
            if n in self.store.tables():
                self._refresh(n)

    def create_view(self, name: str, query: str, or_replace: bool = False) -> None:
        """A name for a query; its elements are the columns of the result, and the key those of the source that it keeps."""
        if name in self.engine.model.entities and not or_replace:
            raise ModelError(f'"{name}" exists')
        df = self.engine.run(query)
        source = parse(query).source
        keys = set(self.engine.model.entity(source.ref.names[0]).keys()) if isinstance(source, A.Table) and source.ref is not None and not source.path else set()
        kinds = {"string": "String", "int": "Integer", "bigint": "Integer64", "double": "Double", "boolean": "Boolean", "date": "Date", "timestamp": "Timestamp"}
        self.engine.model.entities[name] = Entity(name, {c: Element(c, kinds.get(t, t), key=c in keys) for c, t in df.dtypes}, query=query)

    def drop_view(self, name: str, if_exists: bool = False) -> None:
        e = self.engine.model.entities.get(name)
        if e is None and if_exists:
            return
        if e is None or e.query is None:
            raise ModelError(f'"{name}" is no view')
        del self.engine.model.entities[name]

    def drop(self, name: str, if_exists: bool = False) -> None:
        self.store.drop(name, if_exists)
        self._refresh(name)

    # rows ----------------------------------------------------------------------------------------------------------

    def _value(self, text):
        """What an annotation names: a session variable, ``uuid`` or a constant."""
        if isinstance(text, str) and text.startswith("$"):
            return F.lit(self.engine.session.get(tuple(text.split("."))))
        return F.lit(text)

    def _frame(self, entity: Entity, data, at: str | None = None) -> DataFrame:
        """Rows with the entity's types; only the columns that were given, and ``at``, a place in the data. Iterables are consumed once, on the driver."""
        schema = schema_of(entity)
        types = {f.name: f.dataType for f in schema} | ({at: LongType()} if at else {})
        if isinstance(data, DataFrame):
            names, df = data.columns, data
        else:
            rows = [dict(r) for r in data]
            names = list(dict.fromkeys(k for r in rows for k in r))
            df = None
        unknown = [n for n in names if n not in types]
        if unknown and self.strict:
            raise ModelError(f"\"{entity.name}\" has no columns {unknown} to write")
        names = [n for n in names if n in types]
        if df is None:
            plain = {n: types[n].simpleString() for n in names}
            # text goes in as text and is cast, so that dates may be given as ISO text
            cells = [tuple(None if r.get(n) is None else r[n] if not plain[n].startswith(("int", "bigint", "smallint", "double", "float", "decimal", "date", "timestamp")) else str(r[n]) for n in names) for r in rows]
            kinds = ", ".join(f"`{n}` {'string' if plain[n].startswith(('int', 'bigint', 'smallint', 'double', 'float', 'decimal', 'date', 'timestamp')) else plain[n]}" for n in names)
            df = self.engine.spark.createDataFrame(cells, kinds)
        return df.select(*[F.col(f"`{n}`").cast(types[n]).alias(n) for n in names])

    def _filled(self, entity: Entity, df: DataFrame) -> DataFrame:
        """All columns for an insert: generated keys, defaults and managed fields where a column is absent."""
        out = []
        for f in schema_of(entity):
            e = entity.flat()[f.name]
            made: Column = F.lit(None)
            if e.key and e.type == "UUID":
                made = F.expr("uuid()")
            elif e.on_insert is not None:
                made = self._value(e.on_insert)
            elif e.default is not None:
                made = self._value(e.default)
            c = made if f.name not in df.columns else F.coalesce(F.col(f"`{f.name}`"), made) if e.key and e.type == "UUID" else F.col(f"`{f.name}`")
            out.append(c.cast(f.dataType).alias(f.name))
        return df.select(*out)

    def insert(self, name: str, data: DataFrame | Iterable[Mapping] | str) -> Inserted:
        """Adds rows; data is a DataFrame, rows as mappings, or a query of the language. The number of rows, and their keys."""
        name, data = self._through(name, data)
        entity = self._entity(name)
        df = self._filled(entity, self._frame(entity, self.engine.run(data) if isinstance(data, str) else data))
        seen = Observation()
        path = self.store.append(name, df.observe(seen, F.count(F.lit(1)).alias("n")))  # counted as they are written
        self._refresh(name)
        keys = self.engine.spark.read.schema(schema_of(entity)).parquet(path).select(*[f"`{k}`" for k in entity.keys()])
        return Inserted.of(seen.get["n"], keys)

    def insert_rows(self, name: str, columns: Sequence[str], rows: Iterable[Sequence]) -> int:
        return self.insert(name, [dict(zip(columns, r)) for r in rows])

    def upsert(self, name: str, data: DataFrame | Iterable[Mapping]) -> None:
        """Rows with new keys are added, with defaults; for known keys, columns that weren't given keep their value.

        Of several rows with one key the last counts, in the order of ``data``.
        """
        name, data = self._through(name, data)
        entity = self._entity(name)
        keys = entity.keys()
        at = "__at"
        if isinstance(data, DataFrame):
            data = data.withColumn(at, F.monotonically_increasing_id())
        new = self._frame(entity, data if isinstance(data, DataFrame) else [{**dict(r), at: n} for n, r in enumerate(data)], at)
        missing = [k for k in keys if k not in new.columns]
        if missing:
            raise ModelError(f'upsert into "{name}" needs its keys {missing}')
        rest = [c for c in new.columns if c not in keys and c != at]
        new = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("n")).select(*keys, *[F.col("n")[c].alias(c) for c in rest]) if rest else new.drop(at).distinct()
        old = self.store.read(name)
        a, b = old.select(*[F.col(f"`{c}`").alias(f"o__{c}") for c in old.columns], F.lit(True).alias("o__")), self._filled(entity, new)
        b = b.select(*[F.col(f"`{c}`").alias(f"n__{c}") for c in b.columns], F.lit(True).alias("n__"))
        both = a.join(b, reduce(lambda x, y: x & y, [a[f"o__{k}"] == b[f"n__{k}"] for k in keys]), "full")
        cols = []
        for f in schema_of(entity):
            e, c = entity.flat()[f.name], f.name
            given = F.col(f"n__{c}") if c in new.columns else self._value(e.on_update).cast(f.dataType) if e.on_update else F.col(f"o__{c}")
            cols.append(F.when(F.col("n__").isNull(), F.col(f"o__{c}")).when(F.col("o__").isNull(), F.col(f"n__{c}")).otherwise(given).alias(c))
        self.store.replace(name, both.select(*cols))
        self._refresh(name)

    def _hit(self, entity: Entity, where: str | None, params: dict) -> DataFrame:
        """The table with a flag for the rows that a condition picks. The flag comes from keys when the condition follows paths."""
        df = self.engine.rows(entity.name)
        if where is None:
            return df.withColumn("__hit", F.lit(True))
        low = Lowering(self.engine, params)
        keys = entity.keys()
        node = low.node(entity, df, entity.name)
        picked = low.where(node.df, parse_expr(where), Scope(low, {entity.name: node}))
        if not keys:
            raise ModelError(f'"{entity.name}" has no key')
        picked = picked.select(*[node.col(k).alias(f"__k_{k}") for k in keys]).distinct().withColumn("__hit", F.lit(True))
        joined = df.join(picked, reduce(lambda x, y: x & y, [df[k] == picked[f"__k_{k}"] for k in keys]), "left")
        return joined.select(*[df[c] for c in df.columns], F.coalesce("__hit", F.lit(False)).alias("__hit"))

    def update(self, name: str, where: str | None = None, data: Mapping | None = None, exprs: Mapping[str, str] | None = None, **params) -> None:
        """Sets columns of the rows that meet the condition: data holds values, exprs expressions over the old row."""
        if not data and not exprs:
            return
        base, names = self._table(name)
        if names:
            # the view's rows by key, then the table's columns
            keys = self._entity(base).keys()
            back = {v: k for k, v in names.items()}
            rows = self.engine.run(f"SELECT from {name} as v {{ {', '.join(f'v.{back[k]} as {k}' for k in keys)} }}" + (f" where {where}" if where else ""), **params)
            for c, x in (exprs or {}).items():
                raise ModelError(f'expressions can\'t be written through "{name}": {c} = {x}')
            self.upsert(base, rows.select(*keys, *[F.lit(v).alias(names.get(c, c)) for c, v in (data or {}).items()]))
            return
        entity = self._entity(name)
        flagged = self._hit(entity, where, params)
        types = {f.name: f.dataType for f in schema_of(entity)}
        unknown = [c for c in {**(data or {}), **(exprs or {})} if c not in types]
        if unknown:
            raise ModelError(f"\"{name}\" has no columns {unknown} to write")
        low = Lowering(self.engine, params)
        node = low.node(entity, flagged, entity.name)
        scope = Scope(low, {entity.name: node})
        new: dict[str, Column] = {c: F.lit(v) for c, v in (data or {}).items()}
        new |= {c: low.scalar(parse_expr(x), scope).column for c, x in (exprs or {}).items()}
        for c, e in entity.flat().items():
            if e.on_update is not None and c not in new:
                new[c] = self._value(e.on_update)
        hit = F.col(f"{node.alias}____hit")
        rows = low.joined(node.df, [node])
        self.store.replace(name, rows.select(*[(F.when(hit, new[c].cast(t)).otherwise(node.col(c)) if c in new else node.col(c)).alias(c) for c, t in types.items()]))
        self._refresh(name)

    def delete(self, name: str, where: str | None = None, **params) -> None:
        """Removes the rows that meet the condition, and before them the rows of their compositions, level by level."""
        base, names = self._table(name)
        entity = self._entity(base)
        if not names:
            self._delete(entity, self._hit(entity, where, params), self.depth, ())
            return
        keys = entity.keys()
        back = {v: k for k, v in names.items()}
        rows = self.engine.run(f"SELECT from {name} as v {{ {', '.join(f'v.{back[k]} as {k}' for k in keys)} }}" + (f" where {where}" if where else ""), **params)
        table = self.engine.rows(base)
        flagged = table.join(rows.distinct().withColumn("__hit", F.lit(True)), keys, "left").select(*[table[c] for c in table.columns], F.coalesce("__hit", F.lit(False)).alias("__hit"))
        self._delete(entity, flagged, self.depth, ())

    def _delete(self, entity: Entity, flagged: DataFrame, depth: int, above: tuple[str, ...]) -> None:
        for e in entity.elements.values():
            if not (e.is_assoc and e.composition) or e.target not in self.store.tables():
                continue
            if e.target in above and e.target != entity.name:
                raise ModelError(f"the compositions {' -> '.join((*above, entity.name, e.target))} go round in a circle")
            if e.target == entity.name and depth <= 0:
                continue
            target = self.engine.model.entity(e.target)
            low = Lowering(self.engine, {})
            parent = low.node(entity, flagged.where("__hit").drop("__hit"), entity.name)
            rows = self.engine.rows(e.target)
            child = low.node(target, rows, e.name)
            keys = target.keys()
            hit = child.df.join(parent.df, low.on(e, parent, child, ""), "left_semi").select(*[child.col(k).alias(f"__k_{k}") for k in keys]).distinct().withColumn("__hit", F.lit(True))
            both = rows.join(hit, reduce(lambda x, y: x & y, [rows[k] == hit[f"__k_{k}"] for k in keys]), "left")
            below = both.select(*[rows[c] for c in rows.columns], F.coalesce("__hit", F.lit(False)).alias("__hit"))
            if e.target == entity.name:
                if below.where("__hit").isEmpty():
                    continue
                self._delete(target, below, depth - 1, above)
                current = self.store.read(entity.name)
                flagged = current.join(flagged.where("__hit").select(*entity.keys(), "__hit"), entity.keys(), "left").select(*[current[c] for c in current.columns], F.coalesce("__hit", F.lit(False)).alias("__hit"))
            else:
                self._delete(target, below, depth, (*above, entity.name))
        self.store.replace(entity.name, flagged.where(~F.col("__hit")).drop("__hit"))
        self._refresh(entity.name)

    # documents -----------------------------------------------------------------------------------------------------

    def _split(self, name: str, doc: Mapping, inherited: Mapping, out: dict[str, list[dict]]) -> dict:
        """A document's own row; rows of its compositions go to ``out``, with foreign keys from their parent."""
        entity = self._entity(name)
        row = {**{k: v for k, v in doc.items() if k not in entity.elements or not entity.elements[k].is_assoc}, **inherited}
        for k in entity.keys():
            e = entity.flat()[k]
            if k not in row and e.type == "UUID":
                row[k] = str(uuid.uuid4())
        for k, v in doc.items():
            e = entity.elements.get(k)
            if e is None or not e.is_assoc:
                continue
            if not e.many and e.keys and not e.composition:
                row |= {f"{k}_{s}": (v or {}).get(t) for t, s in e.keys.items()}
                continue
            if v is None:
                continue
            for child in [v] if isinstance(v, Mapping) else v:
                link = self._links(entity, e, row)
                got = self._split(e.target, child, link, out)
                if not e.many and e.keys:
                    row |= {f"{k}_{s}": got[t] for t, s in e.keys.items()}
        out.setdefault(name, []).append(row)
        return row

    def _links(self, entity: Entity, e, row: Mapping) -> dict:
        """The child's foreign keys, from an on condition of equal columns."""
        if e.on is None:
            return {}
        pairs = Lowering(self.engine, {}).key_names(e, self.engine.model.entity(e.target))
        return {t: row.get(s) for s, t in pairs or []}

    def insert_deep(self, name: str, docs: Iterable[Mapping]) -> dict[str, int]:
        """Documents with compositions: parents and children are written in one transaction. Rows by entity."""
        out: dict[str, list[dict]] = {}
        for d in docs:
            self._split(name, d, {}, out)
        return self._all({n: (lambda n=n, rows=rows: self.insert(n, rows)) for n, rows in out.items()})

    def upsert_deep(self, name: str, docs: Iterable[Mapping]) -> None:
        """Like upsert for each level; children of a composition that a document lists but no longer has are deleted, then the rest is written."""
        docs = list(docs)
        out: dict[str, list[dict]] = {}
        for d in docs:
            self._split(name, d, {}, out)
        entity = self._entity(name)
        steps = {}
        for e in entity.elements.values():
            if e.is_assoc and e.composition and e.many and any(e.name in d for d in docs):
                steps[f"delete {e.target}"] = lambda e=e: self._drop_missing(entity, e, [d for d in docs if e.name in d], out.get(e.target, []))
        for n, rows in out.items():
            steps[n] = lambda n=n, rows=rows: self.upsert(n, rows)
        self._all(steps)

    def _drop_missing(self, entity: Entity, e, docs: list[Mapping], kept: list[dict]) -> None:
        target = self._entity(e.target)
        keys = target.keys()
        low = Lowering(self.engine, {})
        parents = self._frame(entity, [{k: d[k] for k in entity.keys()} for d in docs])
        a, rows = low.node(entity, parents, "p"), self.engine.rows(e.target)
        b = low.node(target, rows, e.name)
        owned = b.df.join(a.df, low.on(e, a, b, ""), "left_semi").select(*[b.col(k).alias(k) for k in keys])
        if kept:
            owned = owned.join(self._frame(target, [{k: r[k] for k in keys} for r in kept]), keys, "left_anti")
        both = rows.join(owned.withColumn("__hit", F.lit(True)), keys, "left").select(*[rows[c] for c in rows.columns], F.coalesce("__hit", F.lit(False)).alias("__hit"))
        self._delete(target, both, self.depth, (entity.name,))

    def _all(self, steps: Mapping) -> dict:
        own = self.store.staged is None
        if own:
            self.store.begin()
        try:
            done = {n: f() for n, f in steps.items()}
        except BaseException:
            if own:
                self.rollback()
            raise
        if own:
            self.commit()
        return done
