"""Derived indicators and sector features over long frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import by, correlation, pct_change, rank_average, rolling, zscore

TRADING_DAYS = 252


def spread(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """One series less another, by date."""
    x, y = (df.where(F.col("series") == s).select("ts", F.col("value").alias(c)) for s, c in ((a, "x"), (b, "y")))
    return x.join(y, "ts").select(F.lit(name).alias("series"), "ts", (F.col("x") - F.col("y")).alias("value"))


def real_yield(df: DataFrame, level: str, prices: str, name: str, k: int = 12) -> DataFrame:
    """A series less the change of a price index over k rows in per cent, by date."""
    x = df.where(F.col("series") == level).select("ts", F.col("value").alias("x"))
    y = df.where(F.col("series") == prices).select("ts", (100 * pct_change(F.col("value"), by("series"), k)).alias("y"))
    return x.join(y, "ts").select(F.lit(name).alias("series"), "ts", (F.col("x") - F.col("y")).alias("value"))


def ratio(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """One series over another, by date; a zero divisor gives null."""
    x, y = (df.where(F.col("series") == s).select("ts", F.col("value").alias(c)) for s, c in ((a, "x"), (b, "y")))
    return x.join(y, "ts").select(F.lit(name).alias("series"), "ts", F.try_divide("x", "y").alias("value"))


def divergence(df: DataFrame, a: str, b: str, name: str, k: int = 12) -> DataFrame:
    """How far the growth of one series over k rows in per cent runs ahead of another's."""
    return spread(df.select("series", "ts", (100 * pct_change(F.col("value"), by("series"), k)).alias("value")), a, b, name)


def without(df: DataFrame, names: tuple[str, ...] = (), suffixes: tuple[str, ...] = ()) -> DataFrame:
    """The series that bear none of the names and end in none of the suffixes."""
    out = df.where(~F.col("series").isin(list(names))) if names else df
    for s in suffixes:
        out = out.where(~F.col("series").endswith(s))
    return out


def renamed(df: DataFrame, names: DataFrame) -> DataFrame:
    """Series under their readable names (series, name); those without one keep their own.  The dictionary is a few rows."""
    return df.join(F.broadcast(names), "series", "left").withColumn("series", F.coalesce("name", "series")).drop("name")


def growth(df: DataFrame) -> DataFrame:
    """3, 6 and 12 row growth in per cent, and how far the short one runs ahead."""
    w, v = by("series"), F.col("value")
    df = df.select("series", "ts", *[(100 * pct_change(v, w, k)).alias(f"g{k}") for k in (3, 6, 12)])
    return df.withColumn("accel", F.col("g3") - F.col("g12"))


def winsorized(df: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values clipped to quantiles of their whole series."""
    cuts = df.groupBy("series").agg(F.percentile("value", F.array(F.lit(low), F.lit(high))).alias("q"))
    return df.join(cuts, "series").select("series", "ts", F.when(F.col("value").isNotNull(), F.least(F.greatest("value", F.col("q")[0]), F.col("q")[1])).alias("value"))


def rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """Relative strength by simple means; the first change counts as none, flat windows give null."""
    w, v = by("series"), F.col("value")
    d = v - F.lag(v).over(w)
    df = df.select("series", "ts", F.when(d > 0, d).otherwise(0.0).alias("up"), F.when(d < 0, -d).otherwise(0.0).alias("down"))
    up, down = rolling(F.col("up"), F.avg, w, n), rolling(F.col("down"), F.avg, w, n)
    return df.select("series", "ts", F.when((down == 0) & (up > 0), 100.0).when(down > 0, 100 - 100 / (1 + up / down)).alias("rsi"))


def sector_features(px: DataFrame, index: DataFrame) -> DataFrame:
    """Momentum, strength and cross-section features of daily prices (series, ts, value) and an index (ts, value).

    rel_12m is a series' total return since its first date less the index's
    since that date.
    """
    w, v = by("series"), F.col("value")
    px = px.join(index.select("ts", F.col("value").alias("iv")), "ts", "left")
    df = px.select("series", "ts", "value", "iv", pct_change(v, w).alias("r1"), *[pct_change(v, w, k).alias(f"r{k}") for k in (20, 21, 63, 126)])
    df = df.withColumn("rel_12m", F.try_divide(v, F.first("value").over(w)) - F.try_divide(F.col("iv"), F.first("iv").over(w)))
    for n in (20, 50):
        # a margin far above rounding: a price equal to its mean is not above it
        mean = rolling(v, F.avg, w, n)
        df = df.withColumn(f"above_sma{n}", F.when(F.coalesce(v - mean > 1e-9 * F.abs(mean), F.lit(False)), 100.0).otherwise(0.0))
    df = df.withColumn("accel", F.col("r21") - F.col("r63")).withColumn("trend", F.col("r126") - F.col("r63"))
    df = df.withColumn("vol21", rolling(F.col("r1"), F.stddev_samp, w, 21)).withColumn("vol63", rolling(F.col("r1"), F.stddev_samp, w, 63))
    df = df.withColumn("m21", rolling(F.col("r63"), F.avg, w, 21)).withColumn("lead", F.col("r63") / (F.col("vol63") * F.sqrt(F.lit(TRADING_DAYS)) + 1e-6))
    x = Window.partitionBy("ts")
    df = df.withColumn("mean63", F.avg("r63").over(x)).withColumn("mean1", F.avg("r1").over(x))
    df = df.withColumn("zscore", zscore(F.col("m21"), "ts")).withColumn("bull", (F.col("r63") - F.col("mean63")) / (F.col("vol21") + 1e-6))
    df = df.withColumn("dispersion", F.stddev_samp("r63").over(x)).withColumn("spread", F.max("r63").over(x) - F.min("r63").over(x))
    df = df.withColumn("rank", F.when(F.count("r63").over(x) == F.count("*").over(x), rank_average(F.col("r63"), "ts")))
    c = correlation(F.col("r1"), F.col("mean1"), w.rowsBetween(-62, 0))
    return df.withColumn("corr63", F.when(F.count("r1").over(w.rowsBetween(-62, 0)) >= 63, c))


def relative_momentum(px: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """n times the mean of the last n returns over the index's."""
    r = lambda d: d.select(*[c for c in d.columns if c != "value"], pct_change(F.col("value"), by(*[c for c in d.columns if c == "series"])).alias("r"))
    both = r(px).join(index.select("ts", F.col("value").alias("iv")), "ts")
    both = both.join(index.select("ts", (F.try_divide("value", F.lag("value").over(Window.orderBy("ts"))) - 1).alias("ir")), "ts").drop("iv")
    return both.withColumn("x", F.col("r") - F.col("ir")).select("series", "ts", (n * rolling(F.col("x"), F.avg, by("series"), n)).alias("rel"))


def momentum_rotation(ret: DataFrame, look_back: int, top: int, delay: int = 0) -> DataFrame:
    """(ts, ret, n): each month the mean return of the ``top`` series by their product over the last rows, known at the month before."""
    w = by("series")
    past = F.product(1 + F.col("ret")).over(w.rowsBetween(-look_back - delay, -1 - delay)) - 1
    n = F.count("ret").over(w.rowsBetween(-look_back - delay, -1 - delay))
    df = ret.withColumn("score", F.when(n >= look_back, past)).where("score is not null and ret is not null")
    rn = F.row_number().over(Window.partitionBy("ts").orderBy(F.col("score").desc(), "series"))
    return df.withColumn("rn", rn).where(F.col("rn") <= top).groupBy("ts").agg(F.avg("ret").alias("ret"), F.count("*").alias("n"))
