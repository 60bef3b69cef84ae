"""One-factor forecasts in windows, sweeps over them, folds, and what is read from a fit; all in built-in functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import by, correlation, expanding, rolling
from ..functions.quantiles import running_quantiles
from . import portfolio


def _line(df: DataFrame, over=None) -> tuple[Column, Column, Column, Column]:
    """Mean of value and of y, slope of y on value and number of the rows that have both; a constant value has slope 0."""
    f = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    both = F.col("value").isNotNull() & F.col("y").isNotNull()
    x, y = F.when(both, F.col("value")), F.when(both, F.col("y"))
    slope = F.coalesce(F.try_divide(f(F.covar_pop(x, y)), f(F.var_pop(x))), F.lit(0.0))
    return f(F.avg(x)), f(F.avg(y)), slope, f(F.count(x))


def line_forecasts(df: DataFrame, least: int = 36, window: int | None = None, embargo: int = 0) -> DataFrame:
    """(series, ts, pred, actual, bench, n_train): y on value by least squares over the rows before each row, for all folds in one window.

    ``window`` keeps that many rows only, ``embargo`` leaves out the last ones
    before the row.  Rows without value or y, or with fewer than ``least``
    pairs before them, have no forecast and are left out.
    """
    start = Window.unboundedPreceding if window is None else -(window + embargo)
    mx, my, slope, n = _line(df, by("series").rowsBetween(start, -1 - embargo))
    out = df.select("series", "ts", (my + slope * (F.col("value") - mx)).alias("pred"), F.col("y").alias("actual"), my.alias("bench"), n.alias("n_train"))
    return out.where((F.col("n_train") >= least) & F.col("pred").isNotNull() & F.col("actual").isNotNull())


def predict_next(df: DataFrame) -> DataFrame:
    """(series, ts, n, pred): fitted on all pairs, at the last row that has a value."""
    mx, my, slope, n = _line(df)
    out = df.groupBy("series").agg(mx.alias("mx"), my.alias("my"), slope.alias("b"), n.alias("n"), F.max(F.when(F.col("value").isNotNull(), F.struct("ts", "value"))).alias("last"))
    return out.select("series", F.col("last.ts").alias("ts"), "n", (F.col("my") + F.col("b") * (F.col("last.value") - F.col("mx"))).alias("pred"))


def leverage_sweep(df: DataFrame, combos: Sequence[tuple[float, float]]) -> DataFrame:
    """(series, max_long, max_short, n, total, sharpe) of forecasts sized by each combination: the fit is made once, its rows meet the few combinations."""
    grid = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("max_long"), F.lit(float(b)).alias("max_short")) for a, b in combos])).alias("g")
    base = portfolio.positions(df, 1.0, 1.0).select("*", grid)
    x = F.col("pos") * F.when(F.col("pred") > 0, F.col("g.max_long")).otherwise(F.col("g.max_short")) * F.col("actual")
    out = base.groupBy("series", "g.max_long", "g.max_short").agg(F.count("*").alias("n"), (F.product(1 + x) - 1).alias("total"), (F.try_divide(F.avg(x), F.stddev_samp(x)) * F.sqrt(F.lit(12.0))).alias("sharpe"))
    return out


def buy_and_hold(df: DataFrame, h: int) -> DataFrame:
    """df (series, ts, ret) of returns over h rows: every h-th compounded, by year, and its ratio to volatility (0 without any)."""
    w = by("series")
    kept = df.where("ret is not null").withColumn("_k", F.row_number().over(w)).where(F.pmod(F.col("_k") - 1, F.lit(h)) == 0)
    out = kept.groupBy("series").agg(F.count("*").alias("n"), (F.product(1 + F.col("ret")) - 1).alias("total"), (F.stddev_samp("ret") * F.sqrt(F.lit(12.0 / h))).alias("vol"))
    out = out.withColumn("annual", F.pow(1 + F.col("total"), 12.0 / (F.col("n") * h)) - 1)
    return out.withColumn("sharpe", F.when(F.col("vol") > 0, F.col("annual") / F.col("vol")).otherwise(0.0))


def effective_n(n: Column, step: int, h: int) -> Column:
    """Forecasts of h rows, ``step`` apart, that overlap count for their share only."""
    return n * (step / h) if step < h else n.cast("double")


def amplified(df: DataFrame, pred: float = 20.0, actual: float = 10.0) -> DataFrame:
    return df.withColumn("pred", F.col("pred") * pred).withColumn("actual", F.col("actual") * actual)


def cost_scaled(df: DataFrame, bps: float, turnover: float = 0.15) -> DataFrame:
    """Predictions less the share that the expected turnover costs."""
    return df.withColumn("pred", F.col("pred") * (1 - turnover * bps / 1e4))


def high_conviction(df: DataFrame, least: float = 0.5) -> DataFrame:
    """df with score, strength against the spread of the series' predictions, at most 1; predictions below ``least`` become 0."""
    s = F.stddev_samp("pred").over(Window.partitionBy("series"))
    score = F.least(F.lit(1.0), F.abs("pred") / F.when(s > 1e-8, s).otherwise(1.0))
    return df.withColumn("score", score).withColumn("pred", F.when(F.col("score") < least, 0.0).otherwise(F.col("pred")))


def factor_returns(df: DataFrame) -> DataFrame:
    """(series, ts, value): standardised values times their correlation with y."""
    g = Window.partitionBy("series")
    z = F.try_divide(F.col("value") - F.avg("value").over(g), F.stddev_samp("value").over(g))
    return df.select("series", "ts", (z * correlation(F.col("value"), F.col("y"), g)).alias("value"))


def labelled(c: Column, rules: Sequence[tuple[str, str]], other: str) -> Column:
    """The label of the first rule whose text a name holds."""
    out = F.lit(other)
    for part, label in reversed(rules):
        out = F.when(F.contains(c, F.lit(part)), label).otherwise(out)
    return out


def importance(df: DataFrame, rules: Sequence[tuple[str, str]], other: str = "original") -> DataFrame:
    """(series, kind, weight, place): series by the size of the slope of y on their standardised values, largest first; ties by name."""
    g = df.groupBy("series").agg(correlation(F.col("value"), F.col("y")).alias("r"), F.stddev_pop(F.when(F.col("value").isNotNull(), F.col("y"))).alias("s"))
    g = g.select("series", labelled(F.col("series"), rules, other).alias("kind"), F.abs(F.coalesce(F.col("r") * F.col("s"), F.lit(0.0))).alias("weight"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.col("weight").desc(), "series"))
    return g.withColumn("place", place)


def time_splits(df: DataFrame, splits: int, test: int = 12, least: int = 120) -> DataFrame:
    """(series, fold, part, n, first, last, mean): the last ``splits`` stretches of ``test`` rows, each with all rows before it; those with fewer than ``least`` are left out.

    A row belongs to the folds that start after it, which its place tells: no
    join of folds and rows.
    """
    df = df.withColumn("rn", F.row_number().over(by("series"))).withColumn("m", F.count("*").over(Window.partitionBy("series")))
    start = F.col("m") - (splits - F.col("fold")) * test
    df = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("fold")).where((start >= least) & (F.col("rn") <= start + test))
    part = F.when(F.col("rn") <= start, "train").otherwise("test")
    return df.groupBy("series", "fold", part.alias("part")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.avg("value").alias("mean"))


def state_names(df: DataFrame) -> DataFrame:
    """(series, state, mean, sd, name) of df (series, state, ret): the best state is bull, the worst bear, of three the middle one consolidation; of more those that vary over the mean of both ends are bear, else bull. A state alone is bull."""
    s = df.groupBy("series", "state").agg(F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("sd"))
    g = Window.partitionBy("series")
    down = g.orderBy(F.col("mean").desc(), "state").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.select("*", F.row_number().over(g.orderBy(F.col("mean").desc(), "state")).alias("rk"), F.count("*").over(g).alias("k"), ((F.first("sd").over(down) + F.last("sd").over(down)) / 2).alias("cut"))
    name = F.when(F.col("rk") == 1, "bull").when(F.col("rk") == F.col("k"), "bear").when(F.col("k") == 3, "consolidation").when(F.col("sd") > F.col("cut"), "bear").otherwise("bull")
    return s.select("series", "state", "mean", "sd", name.alias("name"))


def proxy_filled(df: DataFrame) -> DataFrame:
    """df (series, ts, value, ret): gaps of value filled with yearly volatility in per cent, and flags over and under the quartiles of the values up to each row (0 below 24)."""
    w = by("series")
    proxy = rolling(F.col("ret"), F.stddev_samp, w, 12, 6) * F.sqrt(F.lit(12.0)) * 100
    df = df.withColumn("value", F.coalesce(F.col("value"), proxy))
    df = running_quantiles(df, {"_q3": 0.75, "_q1": 0.25}, least=24)
    flag = lambda c: F.coalesce(c.cast("long"), F.lit(0))
    return df.withColumn("high", flag(F.col("value") > F.col("_q3"))).withColumn("low", flag(F.col("value") < F.col("_q1"))).drop("_q3", "_q1")


def minus_last(df: DataFrame, one: DataFrame) -> DataFrame:
    """df with x, value less the last price of another frame, which is one row for all."""
    last = one.agg(F.max_by("price", "ts").alias("last"))
    return df.crossJoin(F.broadcast(last)).withColumn("x", F.col("value") - F.col("last")).drop("last")


def decimal_month(c: Column) -> Column:
    """The first day of a month written as year.month, month as hundredths and between 1 and 12."""
    year = F.floor(c).cast("int")
    month = F.round((c - year) * 100).cast("int")
    return F.make_date(year, F.least(F.greatest(month, F.lit(1)), F.lit(12)), F.lit(1))


def lookback_momentum(df: DataFrame, months: Sequence[int]) -> DataFrame:
    """(months, n, annual, sharpe, hit) over all series: the sign of the return over the months before, held for one."""
    w = by("series")
    cases = [F.struct(F.lit(k).cast("long").alias("months"), F.when(F.count("ret").over(w.rowsBetween(-k, -1)) >= k, F.signum(F.product(1 + F.col("ret")).over(w.rowsBetween(-k, -1)) - 1)).alias("side")) for k in months]
    rows = df.select("series", "ts", "ret", F.array(*cases).alias("c")).select("ret", F.inline("c")).where("ret is not null and side is not null")
    x = F.col("side") * F.col("ret")
    return rows.groupBy("months").agg(F.count("*").alias("n"), (12 * F.avg(x)).alias("annual"), (F.try_divide(F.avg(x), F.stddev_samp(x)) * F.sqrt(F.lit(12.0))).alias("sharpe"), (100 * F.avg((x > 0).cast("double"))).alias("hit"))


def enough(df: DataFrame, least: int) -> DataFrame:
    """(series, n, usable) of series with over ``least`` values; usable ones have the lesser of 10 and all their rows."""
    g = df.groupBy("series").agg(F.count("value").alias("n"), F.count("*").alias("m")).where(F.col("n") > least)
    return g.select("series", "n", (F.col("n") >= F.least(F.lit(10), "m")).alias("usable"))
