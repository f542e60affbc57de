import random
from collections import Counter, defaultdict

import pytest

from pathweave.llm import packing as P


def run(spark, rows, capacity, **kw):
    df = spark.createDataFrame(rows, "id bigint, source string, tokens bigint")
    return P.pack(df, "k", capacity, **kw).collect()


def check(rows, out, capacity):
    """Every token once, in order; no container over its capacity; nothing split that fits."""
    got = defaultdict(list)
    for r in out:
        got[r.id].append((r.start, r.tokens, r.part))
    want = Counter()
    for i, _, n in rows:
        want[i] += n
    assert {i: sum(n for _, n, _ in v) for i, v in got.items()} == dict(want)
    for r in out:
        assert 0 <= r.tokens <= capacity and r.start == r.part * capacity
    load = Counter()
    for r in out:
        load[r.container] += r.tokens
    assert max(load.values(), default=0) <= capacity
    single = {i for i, k in Counter(i for i, _, _ in rows).items() if k == 1}
    for i, _, n in rows:
        if n <= capacity and i in single:
            assert len(got[i]) == 1
    return load


def test_random_items(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([0, 1, 3, rng.randrange(1, 100), rng.randrange(100, 1000)])) for i in range(3000)]
    out = run(spark, rows, 100)
    load = check(rows, out, 100)
    assert sum(load.values()) / (100 * len(load)) > 0.98
    assert len({r.container for r in out}) == len(load)


def test_shards_and_hot_source(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", rng.randrange(1, 60)) for i in range(4000)]
    out = run(spark, rows, 64, shard_tokens=20_000)
    load = check(rows, out, 64)
    assert len({c.split("-")[1] for c in load}) > 3
    assert sum(load.values()) / (64 * len(load)) > 0.97


def test_windows_hold_the_mixture():
    items = [(i, "a" if i < 800 else "b", 10) for i in range(1000)]
    boxes = [b for _, b in P.pack_shard(items, {"a": 0.8, "b": 0.2}, {}, 100, 5)]
    for lo in range(0, 100, 5):
        window = [i for b in boxes[lo : lo + 5] for i, *_ in b]
        assert abs(sum(i >= 800 for i in window) - 10) <= 2


def test_windows_hold_the_mixture_with_long_texts():
    items = [(i, "a", 35) for i in range(200)] + [(1000 + i, "b", 10) for i in range(300)]
    boxes = [b for _, b in P.pack_shard(items, {"a": 0.7, "b": 0.3}, {}, 10, 20)]
    assert sum(n for b in boxes for *_, n in b) == 10_000
    for lo in range(0, len(boxes) - 20, 20):
        window = [(i, n) for b in boxes[lo : lo + 20] for i, _, _, n in b]
        assert abs(sum(n for i, n in window if i >= 1000) / sum(n for _, n in window) - 0.3) <= 0.05, lo


def test_mixture_of_many_sizes_and_no_faults(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("aaab") if i % 5 else "c", rng.choice([0, 3, 700, rng.randrange(1, 60), rng.randrange(20, 400)])) for i in range(6000)]
    df = spark.createDataFrame(rows, "id bigint, source string, tokens bigint")
    caps = spark.createDataFrame([("k", 256)], "kind string, capacity_tokens int")
    packed = P.pack(df, "k", 256, shard_tokens=300_000).withColumnRenamed("id", "doc_id").cache()
    m = P.mixture(packed, df.withColumnRenamed("id", "doc_id")).collect()
    last = Counter()
    for r in m:
        last[r.shard] = max(last[r.shard], r.window)
    assert len(last) > 1
    assert max(abs(r.share - r.target) for r in m if r.window < last[r.shard] - 2 * P.WIDE) < 0.05
    pieces = [n % 256 if n > 256 else n for _, _, n in rows if n and (n <= 256 or n % 256)]
    whole = sum(n // 256 for _, _, n in rows if n > 256)
    assert packed.select("container").distinct().count() <= 1.02 * (len(P.fill(pieces, 256)) + whole)  # little more than best fit of everything at once
    sizes = df.selectExpr("'k' as kind", "id", "tokens")
    assert P.faults(packed, sizes, caps).collect() == []
    assert {r.what for r in P.faults(packed.where("doc_id > 9"), sizes, caps).collect()} == {"missing"}
    assert {r.what for r in P.faults(packed, sizes, caps.selectExpr("kind", "200 as capacity_tokens")).collect()} == {"too much"}


def test_deficits_carry_over_and_are_made_good_evenly():
    items = [(i, "a" if i < 500 else "b", 10) for i in range(1000)]
    boxes = [b for _, b in P.pack_shard(items, {"a": 0.5, "b": 0.5}, {"b": 400.0, "a": -400.0}, 100, 4)]
    for n in (20, 40, 60, 80):
        got = sum(10 for b in boxes[:n] for i, *_ in b if i >= 500)
        assert 52 * n <= got <= 56 * n, (n, got)


def test_edges(spark):
    assert run(spark, [], 10) == []
    assert [(r.id, r.tokens) for r in run(spark, [(1, None, 0)], 10)] == [(1, 0)]
    out = run(spark, [(1, "a", 25), (1, "a", 25), (None, "a", 5)], 10)
    assert sum(r.tokens for r in out) == 55
    assert sorted((r.part, r.start, r.tokens) for r in out if r.id == 1) == [(0, 0, 10), (0, 0, 10), (1, 10, 10), (1, 10, 10), (2, 20, 5), (2, 20, 5)]
    rows = [(i, "x" if i % 2 else "y", 7) for i in range(50)]
    check(rows, run(spark, rows, 10, shares={"x": 1.0}), 10)
    with pytest.raises(ValueError):
        run(spark, rows, 0)


def test_whole_texts(spark):
    docs = spark.createDataFrame([(1, None, "s", 1), (2, "", None, 2), (3, "word " * 900, "s", 3), (4, "x", "s", 4)], "doc_id bigint, text string, source string, tokens int")
    caps = spark.createDataFrame([("small", "byte_bpe_50k", 512), ("large", "byte_bpe_50k", 8192)], "kind string, tokenizer string, capacity_tokens int")
    out = P.pack_all(docs, caps).collect()
    assert {(r.kind, r.doc_id) for r in out} == {(k, i) for k in ("small", "large") for i in (1, 2, 3, 4)}
    assert len([r for r in out if r.kind == "large" and r.doc_id == 3]) == 1
    assert [r.kind for r in P.use(P.pack_all(docs, caps), caps).orderBy("kind").collect()] == ["large", "small"]


def test_rows_that_are_alike_are_spread(spark):
    df = spark.range(3000).selectExpr("cast(null as bigint) as id", "'s' as source", "cast(7 as bigint) as tokens", "id as pos")
    out = P.pack(df, "k", 70, shard_tokens=3000).collect()
    per = Counter(r.container.split("-")[1] for r in out)
    assert len(out) == 3000 and len(per) == 7 and max(per.values()) < 600
