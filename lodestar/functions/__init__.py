"""Column builders over ordered frames.

``w`` is a window with partition and order; where a frame has fewer values
than its least number the result is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by(*keys: str, order: str = "ts") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def rolling(c: Column, agg, w: WindowSpec, n: int, least: int | None = None) -> Column:
    """agg(c) over the last n rows, null below ``least`` values (n unless given)."""
    frame = w.rowsBetween(1 - n, 0)
    return F.when(F.count(c).over(frame) >= (n if least is None else least), agg(c).over(frame))


def expanding(c: Column, agg, w: WindowSpec, least: int = 1, lag: int = 0) -> Column:
    """agg(c) over all rows up to here, or up to ``lag`` rows before."""
    frame = w.rowsBetween(Window.unboundedPreceding, -lag)
    return F.when(F.count(c).over(frame) >= least, agg(c).over(frame))


def ffill(c: Column, w: WindowSpec) -> Column:
    return F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def bfill(c: Column, w: WindowSpec) -> Column:
    return F.first(c, True).over(w.rowsBetween(0, Window.unboundedFollowing))


def lead_fill(c: Column, w: WindowSpec) -> Column:
    """Nulls take the first value there is: meant for those before it."""
    return F.coalesce(c, F.first(c, True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def interpolate(c: Column, w: WindowSpec) -> Column:
    """Straight lines, by row, between the values around a gap; after the last value it stays, before the first it is null."""
    rn = F.row_number().over(w)
    at = F.when(c.isNotNull(), rn)
    back, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    v0, v1 = F.last(c, True).over(back), F.first(c, True).over(on)
    r0, r1 = F.last(at, True).over(back), F.first(at, True).over(on)
    return F.coalesce(c, F.when(v1.isNull(), v0).when(v0.isNotNull(), v0 + (v1 - v0) * (rn - r0) / (r1 - r0)))


def pct_change(c: Column, w: WindowSpec, k: int = 1) -> Column:
    """Relative change over k rows; a zero base gives null."""
    return F.try_divide(c, F.lag(c, k).over(w)) - 1


def diff(c: Column, w: WindowSpec, k: int = 1) -> Column:
    return c - F.lag(c, k).over(w)


def forward_return(c: Column, w: WindowSpec, h: int) -> Column:
    """What the next h rows bring."""
    return F.try_divide(F.lead(c, h).over(w), c) - 1


def rank_average(c: Column, *keys: str) -> Column:
    """Rank from the largest down; ties share their mean rank."""
    w = Window.partitionBy(*keys)
    return F.when(c.isNotNull(), F.rank().over(w.orderBy(c.desc())) + (F.count(c).over(Window.partitionBy(*keys, c)) - 1) / 2)


def zscore(c: Column, *keys: str) -> Column:
    w = Window.partitionBy(*keys)
    return (c - F.avg(c).over(w)) / (F.stddev_samp(c).over(w) + 1e-6)


def skewness(c: Column) -> Column:
    """Bias-adjusted; null below three values."""
    n = F.count(c)
    return F.when(n > 2, F.try_divide(F.sqrt(n * (n - 1.0)), n - 2.0) * F.skewness(c))


def kurtosis(c: Column) -> Column:
    """Bias-adjusted excess; null below four values."""
    n = F.count(c)
    return F.when(n > 3, F.try_divide(n - 1.0, (n - 2.0) * (n - 3.0)) * ((n + 1) * F.kurtosis(c) + 6))


def correlation(a: Column, b: Column, over: WindowSpec | None = None) -> Column:
    """Pearson's r; null where a side is constant."""
    f = (lambda x: x.over(over)) if over is not None else (lambda x: x)
    both = F.when(a.isNotNull() & b.isNotNull(), F.lit(1))
    x, y = F.when(both == 1, a), F.when(both == 1, b)
    return F.try_divide(f(F.covar_pop(x, y)), f(F.stddev_pop(x)) * f(F.stddev_pop(y)))


def islands(df: DataFrame, label: str, keys: list[str], order: str = "ts") -> DataFrame:
    """df with run (a number for each run of equal labels), run_pos (from 1) and run_len."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn("_new", F.when(F.col(label).eqNullSafe(F.lag(label).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    df = df.withColumn("run", F.sum("_new").over(w)).drop("_new")
    r = Window.partitionBy(*keys, "run")
    return df.withColumn("run_pos", F.row_number().over(r.orderBy(order))).withColumn("run_len", F.count("*").over(r))


def stride(df: DataFrame, k: int, keys: list[str], order: str = "ts") -> DataFrame:
    """Every k-th row of each key, from its first."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.pmod(F.col("_rn") - 1, F.lit(k)) == 0).drop("_rn")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
