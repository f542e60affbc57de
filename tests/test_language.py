import datetime as dt
import json

import pytest

from pathweave.engine import Engine, Session
from pathweave.model import Model, ModelError
from pathweave.plans.parser import ParseError, parse

SPEC = {
    "Authors": {"elements": {"ID": {"type": "Integer", "key": True}, "name": "String", "place": "String", "books": {"target": "Books", "many": True, "on": "books.author = $self"}}},
    "Books": {
        "elements": {
            "ID": {"type": "Integer", "key": True},
            "title": {"type": "String", "localized": True},
            "author": {"target": "Authors"},
            "genre": {"target": "Genres"},
            "stock": "Integer",
            "status": {"type": "String", "enum": {"new": "N", "old": "O"}},
            "double": {"type": "Integer", "calc": "stock * 2"},
            "made": {"elements": {"in": "String", "by": "String"}},
            "done": {"elements": {"in": "String", "by": "String"}},
            "ghost": {"type": "String", "virtual": True},
        },
        "texts": "Texts",
    },
    "Texts": {"elements": {"ID": {"type": "Integer", "key": True}, "locale": {"type": "String", "key": True}, "title": "String"}},
    "Genres": {"elements": {"ID": {"type": "Integer", "key": True}, "name": "String", "parent": {"target": "Genres"}}},
    "Pairs": {"elements": {"a": {"type": "Integer", "key": True}, "b": {"type": "Integer", "key": True}}},
}


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark, Model.from_dict(SPEC), Session(user="u", locale="de", now=dt.datetime(2024, 5, 1)))
    e.bind("Authors", spark.createDataFrame([(1, "A", "x"), (2, "B", None), (3, "C", "x")], "ID int, name string, place string"))
    books = [(1, "t1", 1, 10, 5, "N", "p", "q", "p", "q"), (2, "t2", 1, 11, None, "O", "p", None, "p", "r"), (3, None, 2, None, 7, None, None, None, None, None), (4, "t4", None, 10, 9, "N", "a", "b", "c", "d")]
    e.bind("Books", spark.createDataFrame(books, "ID int, title string, author_ID int, genre_ID int, stock int, status string, made_in string, made_by string, done_in string, done_by string"))
    e.bind("Genres", spark.createDataFrame([(10, "g", None), (11, "h", 10)], "ID int, name string, parent_ID int"))
    e.bind("Texts", spark.createDataFrame([(1, "de", "T1"), (1, "fr", "x")], "ID int, locale string, title string"))
    e.bind("Pairs", spark.createDataFrame([(1, 1)], "a int, b int"))
    return e


def got(engine, q, *a, **k):
    return sorted((tuple(r) for r in engine.run(q, *a, **k).collect()), key=str)


@pytest.mark.parametrize(
    ("where", "ids"),
    [
        ("status = 'N'", [1, 4]),
        ("status != 'N'", [2, 3]),
        ("status <> 'N'", [2]),
        ("status = null", [3]),
        ("status != null", [1, 2, 4]),
        ("status == null", [3]),
        ("status is not null", [1, 2, 4]),
        ("status in []", [3]),
        ("status not in []", [1, 2, 4]),
        ("status = #old", [2]),
        ("#new = status", [1, 4]),
        ("status in (#new, #old)", [1, 2, 4]),
        ("stock between 5 and 7", [1, 3]),
        ("title like 't_'", [1, 2, 4]),
        ("title like /^t[12]$/", [1, 2]),
        ("not startswith(title, 't1')", [2, 3, 4]),
        ("author.name = 'A' and genre.parent.name = 'g'", [2]),
        ("exists author", [1, 2, 3]),
        ("not exists author[place = 'x']", [3, 4]),
        ("exists author.books[title = 't2']", [1, 2]),
        ("exists genre[parent.name = 'g'] or stock = 9", [2, 4]),
        ("made = done", [1]),
        ("not made = done", [4]),
        ("author = null", [4]),
        ("author = 1", [1, 2]),
        ("ID in (SELECT from Books { ID } where stock > 6)", [3, 4]),
        ("stock not in (SELECT from Books { stock } where ID > 2)", [1]),
        ("(ID, stock) in ((1, 5), (4, 1))", [1]),
        ("double > 10 and 1 + 2 * 3 = 7", [3, 4]),
        ("stock > 5 ? true : false", [3, 4]),
        ("contains(title, 't') and not (ID = 1 or ID = 2)", [4]),
    ],
)
def test_conditions(engine, where, ids):
    assert [r[0] for r in got(engine, f"SELECT from Books {{ ID }} where {where}")] == ids


def test_names_and_wildcards(engine):
    assert engine.run("SELECT from Books { ID, author.name, author.ID, count(*) over () as n }").columns == ["ID", "author_name", "author_ID", "n"]
    star = engine.run("SELECT from Books").columns
    assert star == ["ID", "title", "author_ID", "genre_ID", "stock", "status", "double", "made_in", "made_by", "done_in", "done_by"]
    assert engine.run("SELECT from Books { *, 'x' as title, 1 as extra } excluding { stock, made_in }").columns == ["ID", "title", "author_ID", "genre_ID", "status", "double", "made_by", "done_in", "done_by", "extra"]
    assert engine.run("SELECT from Books { made, author }").columns == ["made_in", "made_by", "author_ID"]
    assert engine.run("SELECT from Books { author.{ name, place }, made.{ by } }").columns == ["author_name", "author_place", "made_by"]


def test_joins_are_shared_and_left_out(engine):
    plan = engine.explain("SELECT from Books { author.ID as a, author.name as b, author.place as c, genre.ID as g } where author.name != 'z'")
    assert plan.split("== Physical Plan ==")[1].count("Join ") >= 1
    assert len([x for x in engine.run("SELECT from Books { author.name as b, author.place as c } where author.name = 'A'")._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]) == 1
    assert "Join" not in engine.run("SELECT from Books { author.ID as a, genre.ID as g }")._jdf.queryExecution().optimizedPlan().toString()


def test_filters_in_paths_keep_rows(engine):
    assert got(engine, "SELECT from Books { ID, author[place = 'x'].name as n }") == [(1, "A"), (2, "A"), (3, None), (4, None)]
    assert got(engine, "SELECT from Books { ID, author[ID = 1].name as a, author[ID = 2].name as b }") == [(1, "A", None), (2, "A", None), (3, None, "B"), (4, None, None)]


def test_path_sources(engine):
    assert got(engine, "SELECT from Books[stock > 4]:author { name }") == [("A",), ("B",)]
    assert got(engine, "SELECT from Authors[1]:books.genre { name }") == [("g",), ("h",)]


def test_nested_results(engine):
    r = engine.run("SELECT from Authors { ID, books { ID, genre { name } } order by ID desc } order by ID").collect()
    assert [(x.ID, [(b.ID, b.genre and b.genre.name) for b in x.books]) for x in r] == [(1, [(2, "h"), (1, "g")]), (2, [(3, None)]), (3, [])]
    r = engine.run("SELECT from Authors { ID, books[stock > 0] { ID } order by stock desc limit 1 as top, $count(books) as n } order by ID").collect()
    assert [([b.ID for b in x.top], x.n) for x in r] == [([1], 2), ([3], 1), ([], 0)]
    r = engine.run("SELECT from Books { ID, { stock, made.by as by } as s } order by ID").first()
    assert (r.s.stock, r.s.by) == (5, "q")
    assert [r.author for r in engine.run("SELECT from Books { author { name } } order by ID").collect()][3] is None


def test_groups(engine):
    assert got(engine, "SELECT from Books { author.name as a, count(*) as n, sum(stock) as s } group by author.name having count(*) > 0") == [("A", 2, 5), ("B", 1, 7), (None, 1, 9)]
    assert got(engine, "SELECT from Books { author, max(stock) as s } group by author") == [(1, 5), (2, 7), (None, 9)]
    assert engine.count("SELECT from Books { author.name } group by author.name limit 1") == 3
    assert engine.page("SELECT from Books { ID } order by ID limit 2 offset 3")[1] == 4
    assert engine.page("SELECT from Books { ID } order by ID limit 2 offset 9") == ([], 4)
    assert [r[0] for r in engine.run("SELECT one from Books { ID } order by stock desc nulls last limit 3 offset 1").collect()] == [3]
    assert [r[0] for r in engine.run("SELECT from Books { ID } order by stock").collect()] == [2, 1, 3, 4]


def test_session_localisation_and_output(engine):
    assert got(engine, "SELECT localized from Books { ID, title } where ID < 3") == [(1, "T1"), (2, "t2")]
    assert got(engine, "SELECT $user as u, $locale as l, year($now) as y, session_context('$user') as s") == [("u", "de", 2024, "u")]
    assert json.loads("".join(engine.json("SELECT from Books { ID, title } order by ID", chunk=10))) == [{"ID": 1, "title": "t1"}, {"ID": 2, "title": "t2"}, {"ID": 3, "title": None}, {"ID": 4, "title": "t4"}]
    seen = []
    engine.foreach("SELECT from Genres { ID }", lambda r: seen.append(r.ID))
    assert sorted(seen) == [10, 11]
    assert got(engine, "SELECT from Books { ID } where stock > ? and status = :s", 4, s="N") == [(1,), (4,)]
    assert engine.first("SELECT from Books { ID } where ID = 77") is None
    engine.procedures["twice"] = lambda e, n: 2 * n
    assert engine.call("twice", 4) == 8
    assert engine.catalog().count() == 5


def test_function_sources(engine, spark):
    assert got(engine, "SELECT from hierarchy(entity: 'Genres', parent: 'parent_ID') { ID, name, level, rank, drill_state }") == [(10, "g", 1, 1, "expanded"), (11, "h", 2, 2, "leaf")]
    assert got(engine, "SELECT from descendants(entity: 'Genres', parent: 'parent_ID', start: 'ID = 10') { ID, distance }") == [(11, 1)]
    assert got(engine, "SELECT from ancestors(entity: 'Genres', parent: 'parent_ID', start: 'ID = 11') as a { a.ID, distance }") == [(10, -1), (11, 0)]
    engine.functions["numbers"] = lambda e, n: e.spark.range(n)
    assert got(engine, "SELECT from numbers(n: 3) { id + 1 as k } where id > 0") == [(2,), (3,)]


def test_search_and_collation(engine, spark):
    e = Engine(spark, engine.model)
    e.tables = dict(engine.tables)
    e.bind("Authors", spark.createDataFrame([(1, "Bronte Emily", "x"), (2, "austen", None), (3, "Zola", "Paris")], "ID int, name string, place string"))
    assert got(e, "SELECT from Authors { ID } search 'EMILY'") == [(1,)]
    assert got(e, "SELECT from Authors { ID } search 'bronte zola'") == [(1,)]
    assert got(e, "SELECT from Authors { max(name) as m } group by place search 'zol'") == [("Zola",)]
    assert got(e, "SELECT from Authors { place, count(*) as n } group by place search 'PAR'") == [("Paris", 1)]
    e.search_all_terms = True
    assert got(e, "SELECT from Authors { ID } search 'zola paris'") == [(3,)]
    assert got(e, "SELECT from Authors { ID } search 'brontee'") == []
    e.fuzzy = 0.7
    assert got(e, "SELECT from Authors { ID } search 'brontee'") == [(1,)]
    assert [r.ID for r in e.run("SELECT from Authors { ID } order by name").collect()] == [1, 3, 2]
    e.collation = "UNICODE_CI"
    assert [r.ID for r in e.run("SELECT from Authors { ID, name } order by name").collect()] == [2, 1, 3]
    assert e.run("SELECT from Books { made { by } }").columns == ["made_by"]


def test_main_reference(engine):
    assert got(engine, "SELECT from Authors as a { ID, (SELECT from Books as b { count(*) as n } where b.author_ID = a.ID) as n }") == [(1, 2), (2, 1), (3, 0)]


@pytest.mark.parametrize(
    ("query", "message"),
    [
        ("SELECT from Nope", '"Nope" not found'),
        ("SELECT from Books { nope }", '"nope" not found'),
        ("SELECT from Books { author.nope }", '"nope" not found'),
        ("SELECT from Books { ID, stock as ID }", 'the column "ID" is defined twice'),
        ("SELECT from Books { *, * }", "only once"),
        ("SELECT from Books { stock + 1 }", "needs a name"),
        ("SELECT from Books { ID } where ghost = 'x'", "is virtual"),
        ("SELECT from Books { ID } where author > 3", "equality only"),
        ("SELECT from Books { ID } where made = 'x'", "single value"),
        ("SELECT from Books { ID } where status = #gone", '"#gone" is no symbol'),
        ("SELECT from Pairs[3] { a }", "needs a key of one column"),
        ("SELECT from Books { ID } where exists author.name", "ends with an association"),
        ("SELECT from Books { stock[ID = 1] as s }", "takes no filter"),
        ("SELECT from Books as a inner join Genres as b on a.genre_ID = b.ID", "needs a list of columns"),
        ("SELECT from Books as a inner join Genres as b on a.genre_ID = b.ID { ID }", "ambiguous reference"),
        ("SELECT from Books as a inner join Books as a on 1 = 1 { a.ID }", "is given twice"),
        ("SELECT from Books { cast(made as String) as m }", "can't be cast"),
        ("SELECT from Books { stock } having stock > 1", "HAVING"),
        ("SELECT from Books { author { name }, count(*) as n } group by genre.ID", "groups by"),
        ("SELECT from Books { $self.ID as ID }", "refers to itself"),
        ("SELECT from Books { ID } where stock = :x", "isn't given"),
        ("SELECT from Books { ID } order by made", "order by"),
    ],
)
def test_errors(engine, query, message):
    with pytest.raises(ModelError, match=message.replace('"', ".").replace("(", r"\(").replace("#", ".")):
        engine.run(query)


def test_syntax():
    q = parse("select distinct a, -b as c from t where not a = 1 and x.y[z > 1].w like 'a''b' order by a desc nulls first limit 3 offset 1")
    assert (q.distinct, q.limit, q.offset, len(q.items)) == (True, 3, 1, 2)
    for bad in ("SELECT from", "SELECT from a { b", "SELECT from a where", "SELECT from a limit", "SELECT from a ;"):
        with pytest.raises(ParseError):
            parse(bad)


def nested(engine, q):
    return [r.asDict(recursive=True) for r in engine.run(q).collect()]


def test_groups_in_nested_results(engine):
    got_ = nested(engine, "SELECT from Authors { ID, books { status, count(*) as n, max(stock) as m } group by status order by n desc, status } order by ID")
    assert [x["books"] for x in got_] == [[{"status": "N", "n": 1, "m": 5}, {"status": "O", "n": 1, "m": None}], [{"status": None, "n": 1, "m": 7}], []]
    got_ = nested(engine, "SELECT from Authors { ID, books { count(*) as n } having count(*) > 1 } order by ID")
    assert [x["books"] for x in got_] == [[{"n": 2}], [], []]
    with pytest.raises(ModelError, match="HAVING"):
        engine.run("SELECT from Authors { books { ID } having ID > 1 }")
    with pytest.raises(ModelError, match="can't be grouped"):
        engine.run("SELECT from Authors { place, books { ID } } group by place")


def test_to_many_below_to_one_and_along_paths(engine):
    got_ = nested(engine, "SELECT from Books { ID, author { name, books { ID } order by ID } } order by ID")
    assert [x["author"] and [b["ID"] for b in x["author"]["books"]] for x in got_] == [[1, 2], [1, 2], [3], None]
    got_ = nested(engine, "SELECT from Books { ID, author.books { ID } order by ID } order by ID")
    assert [[b["ID"] for b in x["author_books"]] for x in got_] == [[1, 2], [1, 2], [3], []]
    got_ = nested(engine, "SELECT from Authors { ID, books.genre { name } order by name } order by ID")
    assert [[b["name"] for b in x["books_genre"]] for x in got_] == [["g", "h"], [], []]
    got_ = nested(engine, "SELECT from Authors { ID, books { ID } search 't2' } order by ID")
    assert [[b["ID"] for b in x["books"]] for x in got_] == [[2], [], []]


def test_not_in_with_nulls(engine):
    rows = "SELECT from Books { ID }"
    assert [r[0] for r in got(engine, rows + " where stock not in (SELECT from Books { stock } where ID > 77)")] == [1, 2, 3, 4]
    assert got(engine, rows + " where stock not in (SELECT from Books { stock })") == []
    assert [r[0] for r in got(engine, rows + " where not (stock not in (SELECT from Books { stock } where ID < 3))")] == [1]
    assert [r[0] for r in got(engine, rows + " where ID = 2 or stock not in (SELECT from Books { stock } where ID = 3)")] == [1, 2, 4]


def test_recursion(engine):
    tree = "SELECT from Genres { ID, DrillState, DistanceFromRoot } recurse parent"
    assert got(engine, tree) == [(10, "expanded", 0), (11, "leaf", 1)]
    assert got(engine, tree + " where DistanceFromRoot <= 0") == [(10, "collapsed", 0)]
    assert got(engine, tree + " where DistanceTo(10, 1)") == [(11, "leaf", 1)]
    assert got(engine, "SELECT from Genres { ID, Distance } where name = 'h' recurse parent") == [(10, -1), (11, 0)]
    with pytest.raises(ModelError, match="with itself"):
        engine.run("SELECT from Books { ID } recurse author")
    with pytest.raises(ModelError, match="DistanceFromRoot and DistanceTo"):
        engine.run("SELECT from Genres { ID } recurse parent where name = 'x'")
    assert got(engine, "WITH r as (SELECT from Genres { ID } where ID = 11 union all SELECT from Genres as g inner join Genres as c on c.parent_ID = g.ID inner join r as r on r.ID = c.ID { g.ID as ID }) SELECT from r { ID }") == [(10,), (11,)]
    with pytest.raises(ModelError, match="nothing to start from"):
        engine.run("WITH r as (SELECT from r { ID } union all SELECT from r { ID }) SELECT from r { ID }")


def test_names_of_arguments_and_brackets(engine):
    assert got(engine, "SELECT from Books { substring(title, start => 1) as s } where ID = 1") == [("1",)]
    with pytest.raises(ValueError, match="no parameter"):
        engine.run("SELECT from Books { substring(title, beginning => 1) as s }")
    assert [r[0] for r in engine.run("SELECT from Books[stock > 0 order by stock desc limit 2] { ID }").collect()] == [4, 3]
    parse("SELECT from Books { ID } for update wait 3")
    parse("SELECT from Books { ID } for share lock ignore locked")
