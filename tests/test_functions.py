import datetime as dt

import pytest

from pathweave.engine import Engine
from pathweave.model import Model


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("substring('abcdef', 1, 2)", "bc"),
        ("substring('abcdef', 4)", "ef"),
        ("substring('abcdef', -3)", "def"),
        ("substring('abcdef', -3, 2)", "de"),
        ("indexof('abc', 'c')", 2),
        ("indexof('abc', 'x')", -1),
        ("contains(null, 'x')", False),
        ("startswith(null, 'x')", False),
        ("endswith('abc', 'bc')", True),
        ("concat('a', null)", None),
        ("matchesPattern('abc', '^a.c$')", True),
        ("round(2.5)", 3.0),
        ("round(-0.5)", -1.0),
        ("round(2.5, 0, 'half_even')", 2.0),
        ("round(2.55, 1, 'down')", 2.5),
        ("round(-2.51, 0, 'ceiling')", -2.0),
        ("round(2.1, 0, 'up')", 3.0),
        ("ceiling(1.2)", 2),
        ("floor(-1.2)", -2),
        ("hour('03:04:05')", 3),
        ("second('2024-01-01T10:11:12.7Z')", 12),
        ("fractionalseconds('2024-01-01T10:11:12.75Z')", 0.75),
        ("time('2024-01-01T10:11:12Z')", "10:11:12"),
        ("date('2024-01-01T10:11:12Z')", dt.date(2024, 1, 1)),
        ("days_between('2024-01-01T06:00:00Z', '2024-01-02T07:00:00Z')", 1),
        ("days_between('2024-01-02T07:00:00Z', '2024-01-01T08:00:00Z')", 0),
        ("months_between('2024-01-31', '2024-02-29')", 0),
        ("months_between('2024-03-15', '2024-01-16')", -1),
        ("months_between('2024-03-15', '2024-03-14')", -1),
        ("years_between('2020-02-29', '2024-02-28')", 3),
        ("years_between('2024-02-28', '2020-02-29')", -3),
        ("seconds_between('2024-01-01T00:00:00Z', '2024-01-01T00:00:01.5Z')", 1.5),
        ("nano100_between('2024-01-01T00:00:00Z', '2024-01-01T00:00:01Z')", 10_000_000),
        ("error('m', null)", '{"message":"m","args":null,"targets":null}'),
        ("maxdatetime()", "9999-12-31T23:59:59.999Z"),
        ("coalesce(null, 'x')", "x"),
        ("power(2, 3)", 8.0),
        ("case 2 when 1 then 'a' when 2 then 'b' end", "b"),
        ("cast('12' as Integer)", 12),
        ("5 / 2", 2.5),
    ],
)
def test_value(spark, text, value):
    got = Engine(spark, Model()).run(f"SELECT {text} as v").first().v
    assert (float(got) == value if isinstance(value, float) else got == value), got
