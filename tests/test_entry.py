import re

import __spark_entry__ as entry
from pathweave.plans import analytics


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert {f"p{n}_" for n in (1, 3, 5)} <= {m[0] for x in q if (m := re.match(r"p\d_", x))}
    assert entry.entry(spark).count() == 5


def test_filters_and_columns_reach_the_scan(spark):
    plan = analytics.engine(spark, "/root/testdata/sf0.001").explain("SELECT from lineitem { l_orderkey } where l_quantity > 45")
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_nothing_outside_imports_the_text_operators():
    from pathlib import Path

    root = Path(entry.__file__).parent / "pathweave"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", p.read_text()), p
