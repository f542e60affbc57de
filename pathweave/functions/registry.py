"""The portable function library: name -> Column. Unknown names go to Spark as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

AGGREGATES = {"sum", "min", "max", "avg", "average", "count", "countdistinct", "string_agg", "listagg", "first", "last", "stddev", "variance", "any_value", "bool_or", "bool_and", "approx_count_distinct"}
#: The bounds of date and time.
MAX_DATETIME, MIN_DATETIME = "9999-12-31T23:59:59.999Z", "0001-01-01T00:00:00.000Z"


def substring(x: Column, start: Column, n: Column | None = None) -> Column:
    """0-based; a negative start counts from the end."""
    at = F.when(start < 0, F.length(x) + start + 1).otherwise(start + 1).cast("int")
    return F.substr(x, at, n.cast("int")) if n is not None else F.substr(x, at)


def micros(x: Column) -> Column:
    return F.unix_micros(x.cast("timestamp"))


def _month_no(x: Column) -> Column:
    return F.year(x) * 12 + F.month(x)


def _in_month(x: Column) -> Column:
    """Day of the month and time of day as one number, in microseconds."""
    t = x.cast("timestamp")
    return F.dayofmonth(t) * F.lit(86_400_000_000) + micros(t) - micros(F.date_trunc("day", t))


def months_between(x: Column, y: Column) -> Column:
    """Whole months from x to y: the difference of the month numbers, one nearer to zero where the last month isn't full.

    In the same month a y that is earlier counts as one month back.
    """
    d = _month_no(y) - _month_no(x)
    back = _month_no(y) < _month_no(x)
    fix = F.when(back, F.when(_in_month(y) > _in_month(x), 1).otherwise(0)).otherwise(F.when(_in_month(y) < _in_month(x), -1).otherwise(0))
    return (d + fix).cast("int")


def years_between(x: Column, y: Column) -> Column:
    m = months_between(x, y)
    return (F.signum(m) * F.floor(F.abs(m) / 12)).cast("int")


def days_between(x: Column, y: Column) -> Column:
    """Whole periods of 24 hours, towards zero."""
    d = (micros(y) - micros(x)) / F.lit(86_400_000_000)
    return F.when(d < 0, F.ceil(d)).otherwise(F.floor(d)).cast("int")


def round_(x: Column, p: Column | None = None, mode: Column | None = None) -> Column:
    """Half away from zero; modes half_up, half_down, half_even, up, down, ceiling and floor."""
    digits = _literal(p) if p is not None else 0
    if mode is None:
        return F.round(x, digits)
    m = str(_literal(mode)).lower().removeprefix("round_")
    unit = F.lit(10.0**digits)
    y = x * unit
    by = {
        "half_up": lambda: F.round(x, digits),
        "half_even": lambda: F.bround(x, digits),
        "half_down": lambda: F.signum(x) * F.ceil(F.abs(y) - 0.5) / unit,
        "up": lambda: F.signum(x) * F.ceil(F.abs(y)) / unit,
        "down": lambda: F.signum(x) * F.floor(F.abs(y)) / unit,
        "ceiling": lambda: F.ceil(y) / unit,
        "floor": lambda: F.floor(y) / unit,
    }
    if m not in by:
        raise ValueError(f"unknown rounding mode {m!r}")
    return by[m]()


class Literal:
    """A literal that keeps its Python value beside its Column, for functions that need it when the plan is built."""

    def __init__(self, value):
        self.value, self.column = value, F.lit(value)


def _literal(x):
    return x.value if isinstance(x, Literal) else x


def _time_text(x: Column) -> Column:
    """What holds a time, also text that is only a time of day."""
    text = x.cast("string")
    return F.to_timestamp(F.when(text.rlike(r"^\d{1,2}:"), F.concat(F.lit("1970-01-01 "), text)).otherwise(text))


def _error(*args: Column) -> Column:
    names = ("message", "args", "targets")
    filled = [*args, *[F.lit(None).cast("string")] * (3 - len(args))]
    return F.to_json(F.struct(*[a.alias(n) for a, n in zip(filled, names)]), {"ignoreNullFields": "false"})


def _count(*a: Column, distinct: bool = False) -> Column:
    return F.count_distinct(*a) if distinct and a else F.count(a[0] if a else F.lit(1))


def _string_agg(x: Column, sep: Column | None = None, distinct: bool = False) -> Column:
    """Joined in the order of the values, so that the result doesn't depend on the shuffle."""
    items = F.collect_set(x) if distinct else F.collect_list(x)
    return F.when(F.count(x) > 0, F.call_function("array_join", F.array_sort(items), sep if sep is not None else F.lit("")))


#: Functions that want literals as they are rather than as columns.
RAW = {"round", "ntile", "lag", "lead", "nth_value"}

FUNCTIONS: dict[str, Callable] = {
    "length": F.length,
    "concat": F.concat,
    "substring": substring,
    "tolower": F.lower,
    "toupper": F.upper,
    "lower": F.lower,
    "upper": F.upper,
    "trim": F.trim,
    "contains": lambda a, b: F.coalesce(F.contains(a, b), F.lit(False)),
    "startswith": lambda a, b: F.coalesce(F.startswith(a, b), F.lit(False)),
    "endswith": lambda a, b: F.coalesce(F.endswith(a, b), F.lit(False)),
    "matchespattern": lambda a, b: F.rlike(a, b),
    "error": _error,
    "ceiling": F.ceil,
    "ceil": F.ceil,
    "floor": F.floor,
    "round": round_,
    "year": lambda x: F.year(x.cast("timestamp")),
    "month": lambda x: F.month(x.cast("timestamp")),
    "day": lambda x: F.dayofmonth(x.cast("timestamp")),
    "hour": lambda x: F.hour(_time_text(x)),
    "minute": lambda x: F.minute(_time_text(x)),
    "second": lambda x: F.second(_time_text(x)),
    "fractionalseconds": lambda x: (F.pmod(micros(_time_text(x)), F.lit(1_000_000)) / F.lit(1e6)).cast("double"),
    "date": lambda x: x.cast("date"),
    "time": lambda x: F.date_format(_time_text(x), "HH:mm:ss"),
    "maxdatetime": lambda: F.lit(MAX_DATETIME),
    "mindatetime": lambda: F.lit(MIN_DATETIME),
    "current_date": lambda: F.current_date(),
    "current_timestamp": lambda p=None: F.current_timestamp(),
    "current_time": lambda p=None: F.date_format(F.current_timestamp(), "HH:mm:ss"),
    "sysuuid": lambda: F.uuid(),
    "nano100_between": lambda x, y: (micros(y) - micros(x)) * 10,
    "seconds_between": lambda x, y: (micros(y) - micros(x)) / F.lit(1e6),
    "days_between": days_between,
    "months_between": months_between,
    "years_between": years_between,
    "average": F.avg,
    "avg": F.avg,
    "sum": lambda x, distinct=False: F.sum_distinct(x) if distinct else F.sum(x),
    "min": F.min,
    "max": F.max,
    "count": _count,
    "countdistinct": lambda *a: F.count_distinct(*a),
    "string_agg": _string_agg,
    "row_number": F.row_number,
    "rank": F.rank,
    "dense_rank": F.dense_rank,
    "percent_rank": F.percent_rank,
    "cume_dist": F.cume_dist,
    "ntile": lambda n: F.ntile(int(_literal(n))),
    "lag": lambda x, n=1, d=None: F.lag(x, int(_literal(n)), _literal(d)),
    "lead": lambda x, n=1, d=None: F.lead(x, int(_literal(n)), _literal(d)),
    "first_value": F.first_value,
    "last_value": F.last_value,
    "nth_value": lambda x, n: F.nth_value(x, int(_literal(n))),
}
FUNCTIONS["indexof"] = lambda a, b: F.position(b, a) - 1
FUNCTIONS["listagg"] = _string_agg


#: Names of parameters in their order, for arguments that are given by name.
PARAMETERS = {
    "substring": ("string", "start", "length"),
    "round": ("value", "digits", "mode"),
    "contains": ("string", "part"),
    "startswith": ("string", "part"),
    "endswith": ("string", "part"),
    "indexof": ("string", "part"),
    "matchespattern": ("string", "pattern"),
    "error": ("message", "args", "targets"),
    "lag": ("value", "offset", "default"),
    "lead": ("value", "offset", "default"),
    "nth_value": ("value", "n"),
    "ntile": ("n",),
    "string_agg": ("value", "separator"),
    **{f"{unit}_between": ("start", "end") for unit in ("nano100", "seconds", "days", "months", "years")},
}


def placed(name: str, given: int, named: tuple) -> list:
    """Arguments given by name, in the order of the function's parameters after the ``given`` first ones; as written where these aren't known."""
    order = PARAMETERS.get(name.lower())
    if not named or order is None:
        return [v for _, v in named]
    by = {k.lower(): v for k, v in named}
    unknown = set(by) - set(order[given:])
    if unknown:
        raise ValueError(f"{name} has no parameter {sorted(unknown)} left; it has {order}")
    last = max(order.index(k) for k in by)
    missing = [k for k in order[given : last + 1] if k not in by]
    if missing:
        raise ValueError(f"{name} needs {missing}")
    return [by[k] for k in order[given : last + 1]]


def call(name: str, args: list, distinct: bool = False) -> Column:
    """The Column of a function; names are case-insensitive, and Spark's own functions serve where the library has none."""
    key = name.lower()
    ready = args if key in RAW else [a.column if isinstance(a, Literal) else a for a in args]
    if key in RAW:
        ready = [a if isinstance(a, Literal) and (i or key == "ntile") else (a.column if isinstance(a, Literal) else a) for i, a in enumerate(ready)]
    if key in FUNCTIONS:
        return FUNCTIONS[key](*ready, **({"distinct": True} if distinct and key in ("count", "sum", "string_agg", "listagg") else {}))
    return F.call_function(key, *ready)
