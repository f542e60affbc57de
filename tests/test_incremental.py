import datetime as dt

import pytest

from pathweave.functions.keys import UUID
from pathweave.operators import incremental as I
from pathweave.operators.incremental import Conflict, Feed, IncrementalLoad, first_run

T0 = dt.datetime(2024, 1, 1)


def t(n):
    return T0 + dt.timedelta(hours=n)


def deliver(spark, folder, rows):
    """rows: (key, value, changed, arrived)."""
    df = spark.createDataFrame([(k, v, None if c is None else t(c), t(0), t(a)) for k, v, c, a in rows], "k string, v string, LastChangedAt timestamp, createdAt timestamp, arrived_at timestamp")
    df.coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def load(spark, tmp_path):
    src = f"{tmp_path}/in"
    deliver(spark, src, [("aa", "1", 1, 1), ("aa", "1", 1, 1), ("aa", "2", 2, 2), ("bb", "1", 1, 30)])
    return src, lambda: IncrementalLoad(spark, f"file://{tmp_path}/state", [Feed("x", src, "k", UUID)])


def out(load):
    return sorted((r.run_no, r.rec_key) for r in load.committed().collect())


def brute(rows, cuts):
    """The runs one after the other."""
    seen, last, found = set(), {}, []
    for run, cut in sorted(cuts):
        new = [(i, r) for i, r in enumerate(rows) if i not in seen and t(r[3]) <= cut]
        seen |= {i for i, _ in new}
        for k in sorted({r[0] for _, r in new}):
            _, v, c, _ = max((r for _, r in new if r[0] == k), key=lambda r: (0 if r[2] is None else r[2], r[3]))
            c = 0 if c is None else c
            if k not in last or c > last[k][0] or (c == last[k][0] and v != last[k][1]):
                found.append((run, k.upper()))
                last[k] = (c, v)
    return sorted(found)


def test_catching_up_equals_run_after_run(spark, tmp_path):
    import random

    rng = random.Random(5)
    rows = [(rng.choice(["aa", "bb", "cc"]), rng.choice("12"), rng.choice([None, 1, 2, 3, 4]), n) for n in range(40)]
    cuts = [(1, t(5)), (2, t(12)), (4, t(9)), (5, t(25)), (7, t(39))]
    src = f"{tmp_path}/in"
    deliver(spark, src, rows)
    whole = IncrementalLoad(spark, f"file://{tmp_path}/a", [Feed("x", src, "k", UUID)])
    whole.run(cuts)
    assert out(whole) == brute(rows, cuts)
    for every in (1, 2, 9):
        parts = IncrementalLoad(spark, f"file://{tmp_path}/b{every}", [Feed("x", src, "k", UUID)], compact_every=every)
        for n in range(1, len(cuts) + 1):
            parts.run(cuts[:n])
        assert out(parts) == brute(rows, cuts)


def test_new_files_only_and_rows_seen_later(spark, load):
    src, make = load
    make().run([(1, t(10))])
    assert out(make()) == [(1, "AA")]
    assert make().pending_files().count() == 0
    deliver(spark, src, [("cc", "1", 5, 11), ("aa", "1", 1, 12)])
    assert make().pending_files().count() == 1
    make().run([(1, t(10)), (2, t(40))])
    # bb's file was processed before, but its row only now arrives; the older state of aa is nothing new
    assert out(make()) == [(1, "AA"), (2, "BB"), (2, "CC")]
    assert make().run([(1, t(10)), (2, t(40))]) is None


def test_a_run_that_dies_before_the_commit_is_repeated(spark, load):
    _, make = load

    def die():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        make().run([(1, t(10))], before_commit=die)
    assert out(make()) == []
    make().run([(1, t(10))])
    assert out(make()) == [(1, "AA")]


def test_a_changed_file_is_read_again_without_repeats(spark, load, tmp_path):
    import os

    src, make = load
    make().run([(1, t(10))])
    for p in os.listdir(src):
        os.remove(f"{src}/{p}")
    deliver(spark, src, [("aa", "2", 2, 2), ("aa", "3", 3, 20)])
    make().run([(1, t(10)), (2, t(25))])
    assert out(make()) == [(1, "AA"), (2, "AA")]


def test_nulls_empty_inputs_and_clashing_columns(spark, tmp_path):
    src = f"{tmp_path}/n"
    spark.createDataFrame([], "k string, LastChangedAt timestamp, createdAt timestamp, arrived_at timestamp").write.parquet(src)
    a = IncrementalLoad(spark, f"file://{tmp_path}/e", [Feed("x", src, "k", UUID)])
    a.run([(1, t(1))])
    assert out(a) == []
    assert IncrementalLoad(spark, f"file://{tmp_path}/none", [Feed("x", src, "k", UUID)]).run([]) is None
    src = f"{tmp_path}/m"
    rows = [(None, 1, None, None, t(1)), ("aa", 1, None, None, None), ("bb", 1, None, None, t(1)), ("bb", None, None, None, t(2)), ("bb", 2, t(0), None, t(3))]
    spark.createDataFrame(rows, "k string, run_no int, LastChangedAt timestamp, createdAt timestamp, arrived_at timestamp").write.parquet(src)
    b = IncrementalLoad(spark, f"file://{tmp_path}/f", [Feed("x", src, "k", UUID)])
    b.run([(1, t(1)), (2, t(2)), (3, t(5))])
    assert out(b) == [(1, "BB"), (2, "BB"), (3, "BB")]


def test_first_run_skips_cuts_that_go_back(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t(n),) for n in (0, 5, 6, 9, 11)], "a timestamp")
    got = [r[0] for r in df.select(first_run(F.col("a"), [(1, t(5)), (2, t(10)), (3, t(8)), (4, None)])).collect()]
    assert got == [1, 1, 2, 2, None]


def test_of_two_loaders_that_race_one_wins(spark, load):
    _, make = load
    with pytest.raises(Conflict):
        make().run([(1, t(10))], before_commit=lambda: make().run([(1, t(10)), (2, t(40))]))
    assert len(make().batches()) == 1
    assert out(make()) == [(1, "AA"), (2, "BB")]


def test_processed_files_are_not_read(spark, load, monkeypatch):
    src, make = load
    make().run([(1, t(10))])
    deliver(spark, src, [("dd", "1", 1, 12)])
    read = []
    index = IncrementalLoad._index
    monkeypatch.setattr(IncrementalLoad, "_index", lambda self, feed, paths, cuts: read.extend(paths) or index(self, feed, paths, cuts))
    make().run([(1, t(10)), (2, t(20))])
    make().run([(1, t(10)), (2, t(20)), (3, t(40))])
    assert len(read) == 1
    assert out(make()) == [(1, "AA"), (2, "DD"), (3, "BB")]


def test_a_touched_file_of_any_size_is_not_processed_again(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(I, "RANGE", 1000)  # many ranges a file
    src = f"{tmp_path}/in"
    deliver(spark, src, [(f"k{i}", str(i * i), 1, 1) for i in range(500)])
    make = lambda **kw: IncrementalLoad(spark, f"file://{tmp_path}/state", [Feed("x", src, "k", UUID)], **kw)
    make().run([(1, t(10))])
    part = next(f"{src}/{p}" for p in os.listdir(src) if p.endswith(".parquet"))
    os.utime(part, (1, 1))
    assert make().pending_files().count() == 0
    with open(part, "r+b") as f:  # the same size and time, another byte
        f.seek(5000)
        b = f.read(1)
        f.seek(5000)
        f.write(bytes([b[0] ^ 1]))
    os.utime(part, (1, 1))
    assert make(verify_all=True).pending_files().count() == 1


def test_buckets_of_the_base(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "BUCKET_ROWS", 10)
    src = f"{tmp_path}/in"
    deliver(spark, src, [(f"k{i}", "1", 1, 1) for i in range(100)])
    load = IncrementalLoad(spark, f"file://{tmp_path}/s", [Feed("x", src, "k", UUID)], compact_every=1)
    load.run([(1, t(5))])
    assert load._latest()["base"]["buckets"] == 11
    deliver(spark, src, [("k7", "1", 1, 6), ("k8", "2", 1, 6), ("new", "1", 0, 6)])
    load.run([(1, t(5)), (2, t(10))])
    assert [x for x in out(load) if x[0] == 2] == [(2, "K8"), (2, "NEW")]
