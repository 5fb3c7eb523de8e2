"""The operators of the factor language as Columns.

A missing value is NULL; NaN never enters a window. Time-series operators look back over a symbol's rows, cross-sectional ones
over a timestamp's. Infinite inputs count as missing in rolling windows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil, log, sqrt

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

FORBIDDEN = ("ts_lead", "lead", "future_return", "forward_return", "shift_neg")
BY_SYMBOL, BY_TIME = ("symbol",), ("ts",)


class ScalarOperand(ValueError):
    """A number stands where an operator needs a panel."""


@dataclass(frozen=True)
class Operator:
    """helpers gives columns to compute first (over windows); finish makes the value of those and the arguments."""

    kind: str
    arity: int
    finish: Callable
    helpers: Callable | None = None
    windows: tuple[int, ...] = ()
    scalars: tuple[int, ...] = ()
    commutative: bool = False
    takes_scalars: bool = False


OPERATORS: dict[str, Operator] = {}


def register(name: str, kind: str, arity: int, finish: Callable, helpers: Callable | None = None, **more) -> None:
    """Adds an operator; the language is closed to anything else."""
    OPERATORS[name] = Operator(kind, arity, finish, helpers, **more)


def over_symbol(keys: tuple[str, ...] = ()):
    return Window.partitionBy(*keys, *BY_SYMBOL).orderBy("ts")


def trailing(n: int, keys: tuple[str, ...] = ()):
    return over_symbol(keys).rowsBetween(-(n - 1), 0)


def over_time(keys: tuple[str, ...] = ()):
    return Window.partitionBy(*keys, *BY_TIME)


def finite(x: Column) -> Column:
    return F.when(F.abs(x) != float("inf"), x)


def average_rank(x: Column, *by: str) -> Column:
    """1-based rank of non-null values with ties averaged; NULL for NULL."""
    place = F.rank().over(Window.partitionBy(*by).orderBy(x.asc_nulls_last()))
    return F.when(x.isNotNull(), place + (F.count(x).over(Window.partitionBy(*by, x)) - 1) / F.lit(2.0))


def _rolling(aggregate: Callable) -> Callable:
    def finish(x, n, keys):
        w = trailing(n, keys)
        return F.when(F.count(finite(x)).over(w) == n, aggregate(finite(x)).over(w))

    return finish


def _ts(name: str, finish: Callable, helpers: Callable | None = None, arity: int = 2) -> None:
    register(name, "ts", arity, finish, helpers, windows=(arity - 1,))


_ts("ts_delay", lambda x, n, keys: F.lag(x, n).over(over_symbol(keys)))
_ts("ts_delta", lambda x, n, keys: x - F.lag(x, n).over(over_symbol(keys)))
_ts("ts_returns", lambda x, n, keys: ratio(x, F.lag(x, n).over(over_symbol(keys))) - 1)
_ts("ts_mean", _rolling(F.avg))
_ts("ts_std", _rolling(F.stddev_samp))
_ts("ts_min", _rolling(F.min))
_ts("ts_max", _rolling(F.max))
_ts("ts_sum", _rolling(F.sum))


def ratio(a: Column, b: Column) -> Column:
    """a / b without clean-up: an infinity of a's sign for b = 0, NULL for 0 / 0."""
    return F.when((b == 0) & (a != 0), F.signum(a) * float("inf")).otherwise(F.try_divide(a, b))


def _window_list(x, n, keys):
    return {"list": F.collect_list(finite(x)).over(trailing(n, keys))}


_ts("ts_rank", lambda x, n, keys, list: F.when(F.size(list) == n, F.size(F.filter(list, lambda e: e <= x)) / F.lit(float(n))), _window_list)
_ts("ts_argmax", lambda x, n, keys, list: F.when(F.size(list) == n, (n - F.array_position(list, F.array_max(list))).cast("double")), _window_list)
_ts("ts_argmin", lambda x, n, keys, list: F.when(F.size(list) == n, (n - F.array_position(list, F.array_min(list))).cast("double")), _window_list)


def _ewm_helpers(x, n, keys):
    x = finite(x)
    seen = F.count(x).over(over_symbol(keys).rowsBetween(Window.unboundedPreceding, 0))
    if n == 1:
        return {"seen": seen, "last": F.last(x, ignorenulls=True).over(over_symbol(keys).rowsBetween(Window.unboundedPreceding, 0))}
    # weights beyond this many rows are below the precision of a double
    back = ceil(37 / -log(1 - 2 / (n + 1)))
    return {"seen": seen, "rows": F.collect_list(F.struct(x.alias("x"))).over(over_symbol(keys).rowsBetween(-back, 0))}


def _ewm(x, n, keys, seen, rows=None, last=None):
    if n == 1:
        return F.when(seen >= 1, last)
    keep = 1 - 2 / (n + 1)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("weight"))
    step = lambda a, e: F.struct((a["sum"] * keep + F.coalesce(e["x"], F.lit(0.0))).alias("sum"), (a["weight"] * keep + F.when(e["x"].isNull(), 0.0).otherwise(1.0)).alias("weight"))
    return F.when(seen >= n, F.aggregate(rows, start, step, lambda a: F.try_divide(a["sum"], a["weight"])))


_ts("ts_ewm", _ewm, _ewm_helpers)


def _pair(x, y):
    both = finite(x).isNotNull() & finite(y).isNotNull()
    return F.when(both, x), F.when(both, y)


def _cov(x, y, n, keys):
    (x, y), w = _pair(x, y), trailing(n, keys)
    return F.when(F.count(x).over(w) == n, F.covar_samp(x, y).over(w))


def _corr(x, y, n, keys):
    (x, y), w = _pair(x, y), trailing(n, keys)
    return F.when(F.count(x).over(w) == n, F.try_divide(F.covar_samp(x, y).over(w), F.stddev_samp(x).over(w) * F.stddev_samp(y).over(w)))


_ts("ts_cov", _cov, arity=3)
_ts("ts_corr", _corr, arity=3)


def _downside(x, n, keys):
    w, fall = trailing(n, keys), F.when(x < 0, x).otherwise(0.0)  # a missing value counts as no fall
    return F.when(F.count(F.lit(1)).over(w) == n, F.stddev_samp(fall).over(w))


def _skew(x, n, keys):
    w, x = trailing(n, keys), finite(x)
    if n < 3:
        return F.lit(None).cast("double")
    flat = F.max(x).over(w) == F.min(x).over(w)
    return F.when(F.count(x).over(w) == n, F.when(flat, 0.0).otherwise(F.skewness(x).over(w) * (sqrt(n * (n - 1)) / (n - 2))))


def _zscore(x, n, keys):
    w, x = trailing(n, keys), finite(x)
    return F.when(F.count(x).over(w) == n, F.try_divide(x - F.avg(x).over(w), F.stddev_samp(x).over(w)))


_ts("ts_downside_std", _downside)
_ts("ts_skew", _skew)
_ts("ts_zscore", _zscore)


def zscored(x: Column, *by: str) -> Column:
    w = Window.partitionBy(*by)
    return F.try_divide(x - F.avg(x).over(w), F.stddev_samp(x).over(w))


def winsorized(x: Column, p: float, *by: str) -> Column:
    w = Window.partitionBy(*by)
    return F.when(x.isNotNull(), F.greatest(F.percentile(x, F.lit(p)).over(w), F.least(F.percentile(x, F.lit(1 - p)).over(w), x)))


def _cs(name: str, finish: Callable, **more) -> None:
    register(name, "cs", more.pop("arity", 1), finish, **more)


_cs("cs_rank", lambda x, keys: average_rank(x, *keys, *BY_TIME))
_cs("cs_percentile", lambda x, keys: average_rank(x, *keys, *BY_TIME) / F.nullif(F.count(x).over(over_time(keys)), F.lit(0)))
_cs("cs_zscore", lambda x, keys: zscored(x, *keys, *BY_TIME))
_cs("cs_demean", lambda x, keys: x - F.avg(x).over(over_time(keys)))
_cs("cs_neutralize", lambda x, keys: x - F.avg(x).over(over_time(keys)))
_cs("cs_winsor", lambda x, p, keys: winsorized(x, p, *keys, *BY_TIME), arity=2, scalars=(1,))


def _both(a, b, value):
    return F.when(a.isNotNull() & b.isNotNull(), value)


def _arith(name: str, arity: int, finish: Callable, **more) -> None:
    register(name, "arith", arity, finish, **more)


_arith("add", 2, lambda a, b, keys: a + b, commutative=True, takes_scalars=True)
_arith("subtract", 2, lambda a, b, keys: a - b, takes_scalars=True)
_arith("multiply", 2, lambda a, b, keys: a * b, commutative=True, takes_scalars=True)
_arith("divide", 2, lambda a, b, keys: finite(F.try_divide(a, b)))
_arith("signed_power", 2, lambda a, p, keys: F.signum(a) * F.pow(F.abs(a), F.lit(p)), scalars=(1,))
_arith("abs", 1, lambda a, keys: F.abs(a))
_arith("neg", 1, lambda a, keys: -a, takes_scalars=True)
_arith("min", 2, lambda a, b, keys: _both(a, b, F.least(a, b)), commutative=True, takes_scalars=True)
_arith("max", 2, lambda a, b, keys: _both(a, b, F.greatest(a, b)), commutative=True, takes_scalars=True)
_arith("clip", 3, lambda a, lo, hi, keys: F.when(a.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), a))), scalars=(1, 2))

#: What operators that take numbers alone do with them.
ON_NUMBERS = {"add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "neg": lambda a: -a, "min": min, "max": max}
