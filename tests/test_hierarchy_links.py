import random

import pytest

from pathweave.operators import hierarchy_links as H
from pathweave.operators import tree as T


def brute(pairs):
    """id -> path text, by walking up."""
    ids = {i for i, _ in pairs if i is not None}
    parent = {}
    for i, p in pairs:
        if i is not None and p in ids:
            parent[i] = min(p, parent.get(i, p))
    out = {}
    for i in ids:
        line, at = [i], i
        while at in parent and parent[at] not in line:
            at = parent[at]
            line.append(at)
        if at not in parent:
            out[i] = "/".join(map(str, reversed(line)))
        else:
            ring = line[line.index(parent[at]) :]
            below = line[: line.index(parent[at])]
            out[i] = "/".join(["@" + str(min(ring)), *map(str, reversed(below))])
    return out


def paths(spark, pairs, **kw):
    df = spark.createDataFrame(pairs, "ID int, parent_ID int")
    return {r.id: r.path for r in H.path_text(H.resolve(df, "ID", "parent_ID", **kw)).collect()}


def test_random_graphs_against_a_walk(spark):
    rng = random.Random(3)
    for n in (30, 120):
        pairs = [(i, rng.choice([None, rng.randrange(n + 5), i])) for i in range(n)]
        pairs += rng.sample(pairs, 5)
        assert paths(spark, pairs, stride=2) == brute(pairs)


def test_deep_chain_and_wide_root(spark):
    pairs = [(0, None)] + [(i, i - 1) for i in range(1, 70)] + [(i, 0) for i in range(100, 400)]
    got = paths(spark, pairs)
    assert got == brute(pairs)
    assert got[69].count("/") == 69


def test_hot_parents_are_spread(spark, monkeypatch):
    monkeypatch.setattr(H, "HOT", 20)
    pairs = [(0, None), (1, 0)] + [(i, 1) for i in range(2, 90)] + [(i, i - 90) for i in range(100, 130)] + [(200, 201), (201, 200)] + [(i, 200) for i in range(210, 250)]
    assert paths(spark, pairs, stride=2) == brute(pairs)


def test_cycles_with_tails(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (4, 3), (5, 4), (6, 6), (7, 6), (8, 99)]
    assert paths(spark, pairs) == {1: "@1", 2: "@1", 3: "@1", 4: "@1/4", 5: "@1/4/5", 6: "@6", 7: "@6/7", 8: "8"}


def test_nulls_copies_empty_tables_and_clashing_columns(spark):
    assert paths(spark, [(None, 1), (1, None), (1, None), (2, 1), (2, None)]) == {1: "1", 2: "1/2"}
    assert paths(spark, []) == {}
    df = spark.createDataFrame([(1, None, "x", 5), (2, 1, "y", 6)], "ID int, parent_ID int, path string, depth int")
    assert {r.id: r.depth for r in H.resolve(df, "ID", "parent_ID").collect()} == {1: 0, 2: 1}
    df = spark.createDataFrame([("b", "a"), ("a", None)], "ID string, parent_ID string")
    assert {r.id: r.path for r in H.path_text(H.resolve(df, "ID", "parent_ID")).collect()} == {"a": "a", "b": "a/b"}
    with pytest.raises(ValueError):
        H.resolve(df, "ID", "parent_ID", stride=3)


def test_descendants(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1)], "ID int, parent_ID int")
    r = H.resolve(df, "ID", "parent_ID")
    assert sorted(map(tuple, H.descendants(r).collect())) == [(1, 2, 1), (1, 3, 2), (1, 4, 1), (2, 3, 1)]
    assert sorted(map(tuple, H.descendant_counts(r).collect())) == [(1, 3), (2, 1), (3, 0), (4, 0)]


def walked(pairs):
    """(ancestor, id) -> distance, by walking up until a node comes again."""
    ids = {i for i, _ in pairs}
    parent = {i: p for i, p in pairs if p in ids}
    out = {}
    for i in ids:
        at, n = parent.get(i), 1
        while at is not None and at != i and (at, i) not in out:
            out[at, i] = n
            at, n = parent.get(at), n + 1
    return out


def test_descendants_of_cycles_with_tails(spark):
    rng = random.Random(5)
    graphs = [[(1, 2), (2, 3), (3, 1), (4, 3), (5, 4), (6, 6), (7, 6), (8, 99), (9, 8)], [(i, (i + 1) % 21) for i in range(21)] + [(30, 7), (31, 30)]]
    graphs.append([(i, rng.randrange(90)) for i in range(90)])
    for pairs in graphs:
        r = H.resolve(spark.createDataFrame(pairs, "ID int, parent_ID int"), "ID", "parent_ID", stride=2)
        want = walked(pairs)
        got = H.descendants(r).collect()
        assert len(got) == len(want) and {(x.ancestor, x.id): x.distance for x in got} == want
        counts = {i: sum(a == i for a, _ in want) for i, _ in pairs}
        assert {x.id: x.descendants for x in H.descendant_counts(r).collect()} == counts


def test_display_tree(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(10, None, "b"), (20, None, "a"), (11, 10, "z"), (12, 10, "y"), (13, 12, "x")], "ID int, up int, name string")
    h = T.hierarchy(df, "ID", "up", "name")
    assert [(r.ID, r.rank, r.level, r.tree_size, r.parent_rank, r.root_rank) for r in h.orderBy("rank").collect()] == [(20, 1, 1, 1, None, 1), (10, 2, 1, 4, None, 2), (12, 3, 2, 2, 2, 2), (13, 4, 3, 1, 3, 2), (11, 5, 2, 1, 2, 2)]
    top = T.top_levels(h, 1, expanded=F.col("ID") == 10).orderBy("limited_rank").collect()
    assert [(r.ID, r.drill_state) for r in top] == [(20, "leaf"), (10, "expanded"), (12, "collapsed"), (11, "leaf")]
    shut = T.top_levels(h, None, collapsed=F.col("ID") == 12).orderBy("limited_rank").collect()
    assert [(r.ID, r.drill_state) for r in shut] == [(20, "leaf"), (10, "expanded"), (12, "collapsed"), (11, "leaf")]
    assert sorted((r.ID, r.distance) for r in T.ancestors(h, F.col("ID").isin(13, 12)).collect()) == [(10, -2), (12, -1), (13, 0)]
    assert sorted((r.ID, r.distance) for r in T.ancestors(h, F.col("ID") == 13).collect()) == [(10, -2), (12, -1), (13, 0)]
    assert sorted((r.ID, r.distance) for r in T.descendants(h, F.col("ID") == 10, 1, 1).collect()) == [(11, 1), (12, 1)]
