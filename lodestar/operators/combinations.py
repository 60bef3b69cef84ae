"""Portfolios of several series: every choice of n, and what signals make of them; returns are (series, ts, ret)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import risk


def choices(names: DataFrame, n: int) -> DataFrame:
    """(combo, series) of every choice of n of the distinct names, in order; a choice is a row for each of its series."""
    one = names.select("series").distinct()
    out = one.select(F.array("series").alias("members"), F.col("series").alias("last"))
    for _ in range(n - 1):
        out = out.join(one.withColumnRenamed("series", "next"), F.col("next") > F.col("last")).select(F.concat("members", F.array("next")).alias("members"), F.col("next").alias("last"))
    return out.select(F.array_join("members", ",").alias("combo"), F.explode("members").alias("series"))


def combined(ret: DataFrame, n: int) -> DataFrame:
    """(combo, ts, ret): the mean return of each choice of n series, at dates where all n have one."""
    picked = choices(ret, n).join(ret.where("ret is not null").select("series", "ts", "ret"), "series")
    return picked.groupBy("combo", "ts").agg(F.avg("ret").alias("ret"), F.count("*").alias("k")).where(F.col("k") == n).drop("k")


def combination_report(ret: DataFrame, index: DataFrame, n: int, year: int = 12) -> DataFrame:
    """One row a choice of n: n, total, annual, vol, sharpe, max_dd, hit, bench_annual, excess, info and calmar.

    index is (ts, ret).  excess is the total less that of the index on the same
    dates, info is excess over vol, hit the share of dates with a gain.
    """
    both = combined(ret, n).join(index.select("ts", F.col("ret").alias("bench")), "ts").where("bench is not null")
    side = both.groupBy("combo").agg(F.avg((F.col("ret") > 0).cast("double")).alias("hit"), (F.product(1 + F.col("bench")) - 1).alias("bench_total"), F.count("*").alias("m"))
    side = side.withColumn("bench_annual", F.pow(1 + F.col("bench_total"), year / F.col("m")) - 1)
    out = risk(both, ["combo"], "ret", year).select("combo", "n", "total", "annual", "vol", "sharpe", "max_dd", F.col("calmar_geo").alias("calmar")).join(side, "combo")
    out = out.withColumn("excess", F.col("total") - F.col("bench_total"))
    return out.select("combo", "n", "total", "annual", "vol", "sharpe", "max_dd", "hit", "bench_annual", "excess", F.try_divide("excess", "vol").alias("info"), "calmar")


def by_signal(df: DataFrame, top: int = 3) -> DataFrame:
    """(strategy, ts, ret) of df (series, ts, pred, ret), where pred was known before ret.

    top: the mean of the ``top`` series by pred; weighted: series with a positive
    pred, by its size; long_short: half the mean of the ``top`` less half that of
    the last ones.  Ties go by name; a date without a series to hold returns 0.
    """
    w = Window.partitionBy("ts")
    df = df.where("pred is not null and ret is not null")
    df = df.withColumn("best", F.row_number().over(w.orderBy(F.col("pred").desc(), "series"))).withColumn("worst", F.row_number().over(w.orderBy("pred", F.col("series").desc())))
    long, ret = F.greatest("pred", F.lit(0.0)), F.col("ret")
    first, last = F.avg(F.when(F.col("best") <= top, ret)), F.avg(F.when(F.col("worst") <= top, ret))
    made = df.groupBy("ts").agg(first.alias("top"), F.coalesce(F.try_divide(F.sum(long * ret), F.sum(long)), F.lit(0.0)).alias("weighted"), ((first - last) / 2).alias("long_short"))
    return made.unpivot("ts", ["top", "weighted", "long_short"], "strategy", "ret").select("strategy", "ts", "ret")
