"""Window building blocks shared by the per-instrument operators.

Bars hold one row per (ticker, date), so a ticker window is bounded by the
calendar however large the whole table is. All specs below shuffle on
``ticker`` and sort on (ticker, seg, date); ``seg`` is a calendar block that
rises with the date, so whole-history and per-segment windows share one
exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

SEGMENT_DAYS = 1024


def by_ticker():
    return Window.partitionBy("ticker")


def history():
    return by_ticker().orderBy("seg", "date")


def dated():
    return by_ticker().orderBy("date")


def segment_of(date: Column) -> Column:
    return F.floor(F.unix_date(date) / F.lit(SEGMENT_DAYS)).cast("int")


def running(spec=None):
    return (spec or history()).rowsBetween(Window.unboundedPreceding, 0)


def ratio(a: Column, b: Column) -> Column:
    """Division with NULL for a zero divisor."""
    return F.try_divide(a, b)


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and hand it to ``fn`` (several uses, one computation)."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def finite(x: Column) -> Column:
    """NULL in place of NaN and of both infinities."""
    # NaN sorts above infinity, so one comparison rejects all three.
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def skew_adjusted(population: Column, n: int) -> Column:
    """Sample-adjusted skewness from the population form."""
    return population * ((n * (n - 1)) ** 0.5 / (n - 2))


def kurt_adjusted(population_excess: Column, n: int) -> Column:
    """Sample-adjusted excess kurtosis from the population excess form."""
    return ((n + 1) * population_excess + 6.0) * ((n - 1) / ((n - 2) * (n - 3)))
