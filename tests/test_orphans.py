import datetime as dt

from pathweave.functions.keys import NUMBER, UUID
from pathweave.operators.orphans import Integrity, Keyed, Reference, per_period

U = "ABCDEF0123456789ABCDEF0123456789"
V = U[::-1]
W = "0" * 31 + "1"
DAY = dt.datetime(2024, 3, 1)


def at(n):
    return DAY + dt.timedelta(days=n)


def found(spark, parents, children, removals, **how):
    kind = "key string, ref string, createdAt timestamp, arrived_at timestamp, tab string"
    p = spark.createDataFrame([(*r, "x") for r in parents], kind)
    c = spark.createDataFrame([(*r, "x") for r in children], kind)
    rm = spark.createDataFrame(removals, "tab string, rec_key string, removed_at timestamp")
    i = Integrity([Keyed("p", p, "key", UUID), Keyed("c", c, "key", NUMBER)], [Reference("c", "ref", "p")], rm, **how)
    return i.found()


def rows(df):
    return sorted((r.rec_key, r.reason, r.ym) for r in df.collect())


def test_reasons(spark):
    parents = [(U.lower(), None, at(0), at(0)), (V, None, at(0), at(5)), (V, None, at(0), at(9)), (W, None, at(3), at(0))]
    children = [
        ("1", f" {U[:8]}-{U[8:]} ", at(0), at(1)),  # another spelling: fine
        ("2", V, at(0), at(1)),  # the target comes later
        ("2", V, at(0), at(40)),  # a copy; the first arrival counts
        ("3", "F" * 32, at(0), at(40)),  # never there
        ("4", W, at(0), at(2)),  # removed, then created again: fine
        ("5", "0" * 32, at(0), at(2)),
        ("6", "  ", at(0), at(2)),
        ("7", None, at(0), at(2)),
        ("8", "E" * 32, at(0), at(2)),  # listed, without a row
        ("9", "F" * 32, at(0), at(2)),  # itself deleted
        (None, "F" * 32, at(0), at(2)),
    ]
    removals = [("p", W, at(1)), ("p", "e" * 32, at(1)), ("p", "e" * 32, at(1)), ("c", "09", at(1))]
    df = found(spark, parents, children, removals)
    assert rows(df) == [("2", "late", "2024-03"), ("3", "missing", "2024-04"), ("8", "deleted", "2024-03")]
    assert sorted(map(tuple, per_period(df).collect())) == [("c", "ref", "2024-03", "deleted", 1), ("c", "ref", "2024-03", "late", 1), ("c", "ref", "2024-04", "missing", 1)]


def test_deleted_when_removed_not_before_creation(spark):
    children = [("1", U, at(0), at(1))]
    assert rows(found(spark, [(U, None, at(2), at(0))], children, [("p", U, at(2))])) == [("1", "deleted", "2024-03")]
    assert rows(found(spark, [(U, None, at(2), at(0))], children, [("p", U, at(1))])) == []


def test_one_missing_key_with_a_third_of_all_rows(spark):
    children = [(str(i), "F" * 32 if i % 3 == 0 else U, at(0), at(1)) for i in range(1, 600)]
    assert len(rows(found(spark, [(U, None, at(0), at(0))], children, []))) == 199


def test_popular_keys_are_spread(spark):
    children = [(str(i), ("F" * 32 if i % 3 else "E" * 32) if i % 7 else U, at(0), at(1)) for i in range(1, 300)]
    want = rows(found(spark, [(U, None, at(0), at(0))], children, []))
    assert len(want) > 200 and rows(found(spark, [(U, None, at(0), at(0))], children, [], hot=20)) == want


def test_empty_tables(spark):
    assert rows(found(spark, [], [], [])) == []
    assert rows(found(spark, [], [("1", U, at(0), at(1))], [])) == [("1", "missing", "2024-03")]


def test_odd_keys_keep_their_spelling(spark):
    from pyspark.sql import functions as F

    texts = ["a" * 32, "x", "y" * 15, "z" * 14, "?", "AB-CD", None, " "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(UUID.unpack(UUID.pack(F.col("t")))).collect()]
    assert got == ["A" * 32, "X", "Y" * 15, "Z" * 14, "?", "ABCD", None, None] or got[4] == ""
