"""Screening of predictors, supervised scaling and interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import by, correlation
from .metrics import draw


def t_of(r: Column, n: Column) -> Column:
    """The t statistic of a correlation, r clipped to +-0.9999."""
    r = F.greatest(F.least(r, F.lit(0.9999)), F.lit(-0.9999))
    return r * F.sqrt((n - 2) / (1 - r * r))


def screened(df: DataFrame, least: float = 0.75, rows: int = 10) -> DataFrame:
    """(grp, series, n, t, kept): of each group the series with |t| over ``least``, else its best one; df has grp, series, ts, value and y.

    A series with fewer values than ``rows`` (or than there are dates, if these are
    fewer) is out: its n and t are 0, it is not kept, and it does not thin out
    the others' dates.  Below ``rows`` common dates all t are 0.
    """
    span = df.groupBy("grp").agg(F.countDistinct("ts").alias("_d"))
    used = df.groupBy("grp", "series").agg(F.count("value").alias("_v")).join(span, "grp").select("grp", "series", (F.col("_v") >= F.least(F.lit(rows), F.col("_d"))).alias("_in"))
    df = df.join(used, ["grp", "series"])
    # listwise: a date counts for a group if all of its series and y have a value
    every = df.where("_in").groupBy("grp").agg(F.countDistinct("series").alias("_k"))
    dates = df.where("_in and value is not null and y is not null").groupBy("grp", "ts").agg(F.countDistinct("series").alias("_c")).join(every, "grp").where("_c = _k").select("grp", "ts")
    names = df.select("grp", "series", "_in").distinct()
    both = F.col("_in") & F.col("value").isNotNull() & F.col("y").isNotNull()
    df = names.join(df.where(both).drop("_in").join(dates, ["grp", "ts"], "left_semi"), ["grp", "series"], "left")
    out = df.groupBy("grp", "series", "_in").agg(F.count("value").alias("n"), correlation(F.col("value"), F.col("y")).alias("r"))
    out = out.withColumn("t", F.when(F.col("n") >= rows, F.coalesce(t_of(F.col("r"), F.col("n")), F.lit(0.0))).otherwise(0.0))
    g = Window.partitionBy("grp")
    best = F.col("_in") & (F.row_number().over(g.orderBy(F.col("_in").desc(), F.abs("t").desc(), "series")) == 1)
    strong = F.abs("t") > least
    return out.withColumn("kept", strong | (best & (F.max(F.when(strong, 1).otherwise(0)).over(g) == 0))).select("grp", "series", "n", "t", "kept")


def screened_by_fold(df: DataFrame, rows: int = 10) -> DataFrame:
    """(series, ts, n, t): the t statistic on all rows before each date, for all folds in one window."""
    w = by("series").rowsBetween(Window.unboundedPreceding, -1)
    both = F.when(F.col("value").isNotNull() & F.col("y").isNotNull(), 1)
    df = df.select("series", "ts", F.count(both).over(w).alias("n"), correlation(F.col("value"), F.col("y"), w).alias("r"))
    return df.select("series", "ts", "n", F.when(F.col("n") >= rows, t_of(F.col("r"), F.col("n"))).alias("t"))


def predictive_scale(df: DataFrame) -> DataFrame:
    """Standardised values (ddof 0) times the slope of y on them; a constant series stays at 0, fewer than 3 pairs have slope 1."""
    stats = df.groupBy("series").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    z = df.join(stats, "series").withColumn("z", (F.col("value") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0))
    pair = F.col("z").isNotNull() & F.col("y").isNotNull()
    slope = z.groupBy("series").agg(F.when(F.count(F.when(pair, 1)) >= 3, F.covar_pop("z", "y")).otherwise(1.0).alias("slope"))
    return z.join(slope, "series").select("series", "ts", (F.col("z") * F.col("slope")).alias("value"))


def percentile_of_train(df: DataFrame, split: str) -> DataFrame:
    """The share of training values (up to split) strictly below each value; nulls rank 0.

    Ranks come from one window over both: training rows that sort before a
    value are counted, so no value meets the training set in a join.
    """
    train = (F.col("ts") <= F.lit(split).cast("date")) & F.col("value").isNotNull()
    w = Window.partitionBy("series").orderBy("value").rangeBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy("series", "value")
    below = F.sum(F.when(train, 1).otherwise(0)).over(w) - F.sum(F.when(train, 1).otherwise(0)).over(same)
    n = F.sum(F.when(train, 1).otherwise(0)).over(Window.partitionBy("series"))
    return df.select("series", "ts", F.when(F.col("value").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(below, n), F.lit(0.0))).alias("pct"))


def interactions(df: DataFrame, factor: str = "value", regime: str = "pct") -> DataFrame:
    """A factor centred in its series, and its product with a regime's percentile."""
    f = F.col(factor) - F.avg(factor).over(Window.partitionBy("series"))
    return df.withColumn("factor", f).withColumn("interaction", F.col("factor") * F.col(regime))


def baselines(df: DataFrame, least: int = 1, seed: int = 42) -> DataFrame:
    """df (series, ts, actual) with what needs no fit: naive (0), hist_mean (of all rows before), momentum (the sign of the last), always_long (1) and random (1 or -1, drawn by day and seed)."""
    w = by("series")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    mean = F.when(F.count("actual").over(past) >= least, F.avg("actual").over(past))
    side = F.when(draw(F.unix_date(F.col("ts").cast("date")).cast("long"), F.length("series").cast("long"), F.lit(seed)) % 2 == 0, 1.0).otherwise(-1.0)
    return df.withColumn("naive", F.lit(0.0)).withColumn("hist_mean", mean).withColumn("momentum", F.signum(F.lag("actual").over(w))).withColumn("always_long", F.lit(1.0)).withColumn("random", side)


def rescaled(df: DataFrame, split: str, most: float = 5.0) -> DataFrame:
    """Predictions after split scaled to the spread of actual up to it, if that takes a factor between 1 and ``most`` and there are over ten; else as they are."""
    late = F.col("ts") > F.lit(split).cast("date")
    g = Window.partitionBy("series")
    p, t = F.stddev_samp(F.when(late, F.col("pred"))).over(g), F.stddev_samp(F.when(~late, F.col("actual"))).over(g)
    k = F.when((p > 0.001) & (t > 0.001) & (F.count(F.when(late, F.col("pred"))).over(g) > 10), t / p)
    return df.withColumn("_k", F.when((k > 1) & (k <= most), k).otherwise(1.0)).where(late).withColumn("pred", F.col("pred") * F.col("_k")).drop("_k")


def grouped(df: DataFrame, groups: DataFrame) -> DataFrame:
    """df (series, ts, value and others) with the groups (grp, series) of its series; a series may be in several, one in none is left out, and a group without series vanishes."""
    return df.drop("grp").join(groups.select("grp", "series").distinct(), "series")


def common_series(df: DataFrame, other: DataFrame) -> DataFrame:
    """The rows of df whose series the other frame has as well."""
    return df.join(other.select("series").distinct(), "series", "left_semi")
