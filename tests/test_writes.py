import pytest

from pathweave.engine import Engine
from pathweave.model import Model, ModelError
from pathweave.operators.writes import Writer
from pathweave.sources import files
from pathweave.sources.store import Conflict, Store
from pathweave.streaming.upserts import upsert_stream

SPEC = {
    "authors": {"elements": {"ID": {"type": "Integer", "key": True}, "name": "String", "books": {"target": "books", "many": True, "on": "books.author_ID = ID", "composition": True}}},
    "books": {
        "elements": {
            "ID": {"type": "Integer", "key": True},
            "title": "String",
            "stock": {"type": "Integer", "default": 7},
            "price": "Decimal(9,2)",
            "author_ID": "Integer",
            "made": {"type": "String", "on_insert": "$user"},
            "changed": {"type": "String", "on_update": "$user"},
            "author": {"target": "authors", "on": "author.ID = author_ID"},
            "pages": {"target": "pages", "many": True, "on": "pages.book = ID", "composition": True},
        }
    },
    "pages": {"elements": {"pid": {"type": "UUID", "key": True}, "book": "Integer", "text": "String"}},
    "cheap": {"elements": {"no": {"type": "Integer", "key": True}, "name": "String"}, "query": "SELECT from books { ID as no, title as name } where stock < 5"},
    "nodes": {"elements": {"ID": {"type": "Integer", "key": True}, "up": "Integer", "kids": {"target": "nodes", "many": True, "on": "kids.up = ID", "composition": True}}},
}


@pytest.fixture
def writer(spark, tmp_path):
    w = Writer(Engine(spark, Model.from_dict(SPEC)), Store(spark, f"file://{tmp_path}/s"))
    for n, e in SPEC.items():
        if "query" not in e:
            w.create(n)
    return w


def rows(w, q):
    return sorted(tuple(r) for r in w.engine.run(q).collect())


def test_insert_defaults_and_managed_fields(writer):
    assert writer.insert("books", [{"ID": 1, "title": "a", "price": "3.50"}, {"ID": 2, "stock": None}]) == 2
    assert rows(writer, "SELECT from books { ID, title, stock, made, changed } where ID = 1") == [(1, "a", None, "anonymous", None)]
    assert writer.insert_rows("books", ["ID", "title"], [(3, "c")]) == 1
    assert rows(writer, "SELECT from books { stock } where ID = 3") == [(7,)]
    with pytest.raises(ModelError, match="has no columns"):
        writer.insert("books", [{"ID": 9, "nope": 1}])
    writer.insert("books", "SELECT from books { ID + 10 as ID, title } where ID = 1")
    assert rows(writer, "SELECT from books { ID, title } where ID = 11") == [(11, "a")]


def test_upsert_keeps_what_is_absent(writer):
    writer.insert("books", [{"ID": 1, "title": "a", "stock": 3}])
    writer.upsert("books", [{"ID": 1, "title": "b"}, {"ID": 2, "title": "n"}, {"ID": 2, "title": "m"}])
    assert rows(writer, "SELECT from books { ID, title, stock, changed }") == [(1, "b", 3, "anonymous"), (2, "m", 7, None)]


def test_update_and_delete_with_paths(writer):
    writer.insert("authors", [{"ID": 1, "name": "x"}, {"ID": 2, "name": "y"}])
    writer.insert("books", [{"ID": 1, "author_ID": 1, "stock": 1}, {"ID": 2, "author_ID": 2, "stock": 2}, {"ID": 3, "stock": 3}])
    writer.update("books", "author.name = 'x'", data={"title": "t"}, exprs={"stock": "stock * 10"})
    assert rows(writer, "SELECT from books { ID, title, stock } order by ID")[0] == (1, "t", 10)
    writer.delete("books", "author.name = :n", n="y")
    assert [r[0] for r in rows(writer, "SELECT from books { ID }")] == [1, 3]
    writer.update("books", data={})
    writer.delete("books")
    assert rows(writer, "SELECT from books { ID }") == []


def test_documents(writer):
    done = writer.insert_deep("authors", [{"ID": 1, "name": "x", "books": [{"ID": 5, "title": "a", "pages": [{"text": "p"}, {"text": "q"}]}, {"ID": 6, "title": "b"}]}])
    assert done == {"pages": 2, "books": 2, "authors": 1}
    assert rows(writer, "SELECT from pages { book, text }") == [(5, "p"), (5, "q")]
    writer.upsert_deep("authors", [{"ID": 1, "books": [{"ID": 6, "title": "bb"}, {"ID": 7, "title": "c"}]}])
    assert rows(writer, "SELECT from books { ID, title, author_ID }") == [(6, "bb", 1), (7, "c", 1)]
    assert rows(writer, "SELECT from pages { text }") == []
    writer.delete("authors", "ID = 1")
    assert rows(writer, "SELECT from books { ID }") == []


def test_deep_delete_of_a_tree_goes_down_to_its_depth(writer):
    writer.insert("nodes", [{"ID": i, "up": i - 1 or None} for i in range(1, 7)])
    writer.delete("nodes", "ID = 1")
    assert [r[0] for r in rows(writer, "SELECT from nodes { ID }")] == [5, 6]


def test_generated_keys_and_views(writer):
    done = writer.insert("pages", [{"book": 1}, {"book": 1, "pid": "x"}])
    assert done == 2 and len({r.pid for r in done.keys.collect()} - {"x"}) == 1
    writer.create_view("own", "SELECT from pages { pid, book } where book = 1")
    assert len(rows(writer, "SELECT from own { pid }")) == 2 and writer.engine.model.entity("own").keys() == ["pid"]
    writer.drop_view("own")
    writer.drop_view("own", if_exists=True)
    with pytest.raises(ModelError):
        writer.drop_view("pages")


def test_transactions(writer, spark):
    writer.begin()
    writer.insert("books", [{"ID": 1}])
    writer.rollback()
    assert rows(writer, "SELECT from books { ID }") == []
    other = Store(spark, writer.store.root)
    writer.insert("books", [{"ID": 2}])
    other.staged = {"tables": {}, "batches": {}}
    with pytest.raises(Conflict):
        other.commit()


def test_a_stream_is_upserted_once(writer, spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.createDataFrame([(1, "a"), (2, "b")], "ID int, title string").write.parquet(src)
    stream = spark.readStream.schema("ID int, title string").parquet(src)
    for _ in range(2):
        q = upsert_stream(stream, writer, "books", "s", f"{tmp_path}/cp", availableNow=True)
        q.awaitTermination()
    assert rows(writer, "SELECT from books { ID, title }") == [(1, "a"), (2, "b")]
    assert writer.store.done("s") == 0


def test_files(spark, tmp_path):
    e = Model.from_dict(SPEC).entity("books")
    (tmp_path / "b.csv").write_text("title;ID;other\nx;1;z\n;2;\n")
    assert [tuple(r) for r in files.read_csv(spark, f"{tmp_path}/b.csv", e).collect()] == [("x", 1), (None, 2)]
    (tmp_path / "b.json").write_text('{"ID": 3, "price": 1.25}\n')
    r = files.read_json(spark, f"{tmp_path}/b.json", e).first()
    assert (r.ID, str(r.price), r.title) == (3, "1.25", None)
    df = spark.createDataFrame([(1, None)], "a int, b string")
    files.write_json(df, f"{tmp_path}/o.json")
    assert '"b":null' in "".join(p.read_text() for p in (tmp_path / "o.json").glob("part*"))
    files.write_parquet(df, f"{tmp_path}/o.parquet")
    assert files.read_parquet(spark, f"{tmp_path}/o.parquet").count() == 1


def test_through_views(writer):
    writer.insert("cheap", [{"no": 1, "name": "a"}, {"no": 2, "name": "b"}])
    writer.update("books", "ID = 1", data={"stock": 1})
    writer.update("cheap", data={"name": "c"})
    assert rows(writer, "SELECT from books { ID, title }") == [(1, "c"), (2, "b")]
    writer.delete("cheap", "name = 'c'")
    assert rows(writer, "SELECT from books { ID }") == [(2,)]
