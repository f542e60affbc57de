"""The engine: a model, a session and queries.

    engine = Engine(spark, model)
    engine.run("SELECT from orders { o_orderkey, customer.nation.n_name as nation } where exists items[l_quantity > 40]")
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession

from .model import Model, ModelError
from .plans import ast as A
from .plans.lower import Lowering
from .plans.parser import parse


@dataclass
class Session:
    """Pseudo variables of a session; the time is frozen when it begins."""

    user: str = "anonymous"
    locale: str = "en"
    tenant: str | None = None
    now: dt.datetime = field(default_factory=lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
    valid_from: dt.datetime | None = None
    valid_to: dt.datetime | None = None

    def get(self, names: tuple[str, ...]):
        start = self.valid_from or self.now
        known = {
            ("$user",): self.user,
            ("$user", "id"): self.user,
            ("$user", "locale"): self.locale,
            ("$user", "tenant"): self.tenant,
            ("$now",): self.now,
            ("$locale",): self.locale,
            ("$tenant",): self.tenant,
            ("$at",): start,
            ("$at", "from"): start,
            ("$at", "to"): self.valid_to or start + dt.timedelta(milliseconds=1),
            ("$valid", "from"): start,
            ("$valid", "to"): self.valid_to or start + dt.timedelta(milliseconds=1),
        }
        known[("$from",)], known[("$to",)] = known[("$valid", "from")], known[("$valid", "to")]
        if names not in known:
            raise ModelError(f'"{".".join(names)}" not found among the session variables')
        return known[names]


class Engine:
    """Runs queries against DataFrames. Everything returns a lazy DataFrame unless said otherwise.

    search_all_terms: a search has to find all of its terms, not only the first. fuzzy: least similarity (0 to 1) of a word to a term that
    counts as found. collation: the order of texts in ``order by``, such as UNICODE_CI or de. count_as_text: counts come as text.
    """

    def __init__(self, spark: SparkSession, model: Model, session: Session | None = None, search_all_terms: bool = False, fuzzy: float | None = None, collation: str | None = None, count_as_text: bool = False, functions: dict[str, Callable] | None = None):
        self.spark, self.model, self.session = spark, model, session or Session()
        self.search_all_terms, self.fuzzy, self.collation, self.count_as_text = search_all_terms, fuzzy, collation, count_as_text
        #: Functions of this engine alone, by lower-case name: (*columns) -> Column. They come before those of the library.
        self.own_functions: dict[str, Callable] = {k.lower(): f for k, f in (functions or {}).items()}
        #: Rounds after which a query that refers to itself is given up.
        self.most_rounds = 1000
        self.tables: dict[str, DataFrame] = {}
        self.procedures: dict[str, Callable] = {}
        #: Sources by name, ``from name(argument: value)``: (engine, **arguments) -> DataFrame
        self.functions: dict[str, Callable] = {"hierarchy": _hierarchy, "descendants": _descendants, "ancestors": _ancestors}

    # data ----------------------------------------------------------------------------------------------------------

    def bind(self, name: str, df: DataFrame) -> Engine:
        """Gives an entity its rows."""
        self.tables[name] = df
        return self

    def bind_parquet(self, folder: str, *names: str) -> Engine:
        """Entities from ``folder/name.parquet``; read when a query needs them."""
        for n in names:
            self.model.entity(n).source = lambda e, p=f"{folder}/{n}.parquet": e.spark.read.parquet(p)
        return self

    def rows(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        e = self.model.entity(name)
        if e.source is None:
            raise ModelError(f'"{name}" has no rows')
        self.tables[name] = e.source(self)
        return self.tables[name]

    # queries -------------------------------------------------------------------------------------------------------

    def run(self, query: str | A.Select, *args, **params) -> DataFrame:
        """The rows of a query. args fill ``?`` in order, params fill ``:name``."""
        q = parse(query) if isinstance(query, str) else query
        given = {str(i): v for i, v in enumerate(args)} | params
        return Lowering(self, given).query(q)

    def count(self, query: str | A.Select, *args, **params) -> int:
        """How many rows the query has without its limit; groups count as rows."""
        import copy

        q = copy.copy(parse(query) if isinstance(query, str) else query)
        q.limit, q.offset, q.one, q.order = None, 0, False, ()
        return self.run(q, *args, **params).count()

    def page(self, query: str, *args, **params) -> tuple[list[Row], int]:
        """The rows of one page and the total; a page that isn't full tells the total without counting."""
        q = parse(query)
        if q.limit is None:
            raise ModelError("a page needs a limit")
        rows = self.run(q, *args, **params).collect()  # at most ``limit`` rows
        if len(rows) < q.limit and (rows or not q.offset):
            return rows, q.offset + len(rows)
        return rows, self.count(q, *args, **params)

    def first(self, query: str, *args, **params) -> Row | None:
        return self.run(query, *args, **params).limit(1).first()

    def foreach(self, query: str, each: Callable[[Row], None], *args, **params) -> None:
        for row in self.run(query, *args, **params).toLocalIterator(prefetchPartitions=True):
            each(row)

    def json(self, query: str, *args, chunk: int = 65536, **params) -> Iterator[str]:
        """The result as JSON text, ``[`` to ``]``, in chunks of at least so many characters but for the last; nulls are kept."""
        part, first = ["["], True
        size = 1
        for line in self.run(query, *args, **params).select(_all_json()).toLocalIterator(prefetchPartitions=True):
            part.append(line[0] if first else "," + line[0])
            first, size = False, size + len(line[0]) + 1
            if size >= chunk:
                yield "".join(part)
                part, size = [], 0
        part.append("]")
        yield "".join(part)

    def explain(self, query: str, *args, mode: str = "formatted", **params) -> str:
        df = self.run(query, *args, **params)
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    def sql(self, text: str, args: Iterable | dict | None = None) -> DataFrame:
        """Plain SQL over the bound entities, which are temporary views of their names."""
        for n in self.model.entities:
            if n in self.tables or self.model.entity(n).source:
                self.rows(n).createOrReplaceTempView(n.replace(".", "_"))
        return self.spark.sql(text, args=args if args is None or isinstance(args, dict) else list(args))

    def call(self, name: str, *args, **kw):
        """A stored procedure: a Python callable that was registered under the name."""
        if name not in self.procedures:
            raise ModelError(f'"{name}" is no procedure')
        return self.procedures[name](self, *args, **kw)

    def catalog(self) -> DataFrame:
        """(name, kind) of the entities."""
        rows = [(n, "view" if e.query else "table") for n, e in self.model.entities.items()]
        return self.spark.createDataFrame(rows, "name string, kind string")


def _hierarchy(engine: Engine, entity: str, parent: str, node: str | None = None, sibling: str | None = None, levels: int | None = None) -> DataFrame:
    """An entity with its hierarchy columns: level, rank, tree_size, drill_state and so on."""
    from .operators.tree import hierarchy, top_levels

    node = node or engine.model.entity(entity).keys()[0]
    h = hierarchy(engine.rows(entity), node, parent, sibling)
    return engine.rows(entity).dropDuplicates([node]).drop(parent).join(top_levels(h, levels).drop("path"), node)


def _near(engine: Engine, entity: str, parent: str, start: str, node: str | None):
    from .operators.tree import hierarchy

    node = node or engine.model.entity(entity).keys()[0]
    h = hierarchy(engine.rows(entity), node, parent)
    picked = engine.run(f"SELECT from {entity}[{start}] {{ {node} as __start }}")
    marked = h.join(picked.distinct(), h[node] == picked["__start"], "left")
    return engine.rows(entity).dropDuplicates([node]), marked, node


def _descendants(engine: Engine, entity: str, parent: str, start: str, node: str | None = None, low: int = 1, high: int | None = None) -> DataFrame:
    """Rows below those that meet the condition ``start``, with their distance."""
    from .operators.tree import descendants

    rows, h, node = _near(engine, entity, parent, start, node)
    from pyspark.sql import functions as F

    return rows.join(descendants(h, F.col("__start").isNotNull(), low, high).select(node, "level", "rank", "distance"), node)


def _ancestors(engine: Engine, entity: str, parent: str, start: str, node: str | None = None, keep_start: bool = True) -> DataFrame:
    """Rows above those that meet the condition ``start``, and these, with distances 0, -1, ..."""
    from .operators.tree import ancestors

    rows, h, node = _near(engine, entity, parent, start, node)
    from pyspark.sql import functions as F

    return rows.join(ancestors(h, F.col("__start").isNotNull(), keep_start).select(node, "level", "rank", "distance"), node)


def _all_json():
    from pyspark.sql import functions as F

    return F.to_json(F.struct(F.col("*")), {"ignoreNullFields": "false"})
