"""Sources and sinks: typed CSV and Parquet, month-end panels, calendars and point-in-time snapshots."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LONG = "series string, grp string, ts date, value double"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; Python workers on this machine then find the package wherever they start."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (known, root)))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str = LONG) -> DataFrame:
    """Long series with a stated schema; rows that do not parse have nulls."""
    return spark.read.csv(path, schema=schema, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def month_last(df: DataFrame, keys: list[str], day: str = "d", value: str = "value") -> DataFrame:
    """The last non-null value of each month, stamped with the month's end; months without one are absent (see ``on_calendar``)."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.last_day(day).alias("ts")).agg(F.max_by(value, day).alias("value"))


def month_mean(df: DataFrame, keys: list[str], day: str = "d", value: str = "value") -> DataFrame:
    return df.groupBy(*keys, F.last_day(day).alias("ts")).agg(F.avg(value).alias("value"))


def calendar(df: DataFrame, keys: list[str], ts: str = "ts", step: str = "month") -> DataFrame:
    """Each key's dates from its first to its last, by month end or by day."""
    ends = df.groupBy(*keys).agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    if step == "day":
        return ends.select(*keys, F.explode(F.expr("sequence(a, b, interval 1 day)")).alias(ts))
    return ends.select(*keys, F.explode(F.expr("sequence(trunc(a, 'MM'), trunc(b, 'MM'), interval 1 month)")).alias("m")).select(*keys, F.last_day("m").alias(ts))


def on_calendar(df: DataFrame, keys: list[str], ts: str = "ts", step: str = "month") -> DataFrame:
    """df with a row of nulls for each date that a key misses."""
    return calendar(df, keys, ts, step).join(df, [*keys, ts], "left")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """left with the last value of right on or before each of its dates: one union and one window, no range join."""
    both = left.select(*keys, ts, F.lit(1).alias("_side"), F.lit(None).cast("double").alias(value)).unionByName(right.select(*keys, ts, F.lit(0).alias("_side"), value))
    w = Window.partitionBy(*keys).orderBy(ts, "_side")
    return both.withColumn(value, F.last(value, True).over(w)).where("_side = 1").drop("_side")


def vintage(df: DataFrame, date: str, keys: list[str], stamp: str = "vintage", value: str = "value") -> DataFrame:
    """What was known on a date: of each key, the value of the last vintage up to it."""
    return df.where(F.col(stamp) <= F.lit(date).cast("date")).groupBy(*keys).agg(F.max_by(value, stamp).alias(value), F.max(stamp).alias(stamp))


def cache_key(*parts: str):
    """The name of a cached extract: MD5 of its arguments joined by underscores."""
    return F.md5(F.concat_ws("_", *[F.lit(p) if not isinstance(p, type(F.lit(1))) else p for p in parts]))


def synthetic(spark: SparkSession, months: int, per_group: int, groups: tuple[str, ...], seed: int = 42) -> DataFrame:
    """A made panel: random walks with a yearly wave; the draws are hashes of series and month, so partitions don't matter."""
    base = spark.range(months).withColumnRenamed("id", "m").select("m", F.explode(F.array(*[F.lit(g) for g in groups])).alias("grp"))
    base = base.select("m", "grp", F.explode(F.sequence(F.lit(0), F.lit(per_group - 1))).alias("j"))
    u = lambda k: (F.pmod(F.xxhash64("grp", "j", "m", F.lit(seed + k)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    base = base.withColumn("e", F.sqrt(-2 * F.log(u(0))) * F.cos(2 * F.pi() * u(1)))
    w = Window.partitionBy("grp", "j").orderBy("m")
    return base.select(F.format_string("%s_%d", "grp", "j").alias("series"), "grp", F.last_day(F.expr("add_months(date'1990-01-31', cast(m as int))")).alias("ts"), (F.sum("e").over(w) + F.sin(2 * F.pi() * F.col("m") / 12)).alias("value"))


def synthetic_target(panel: DataFrame, weight: float = 0.01, noise: float = 0.05, name: str = "index", seed: int = 42) -> DataFrame:
    """(ts, y) for a made panel: a weighted sum of its series, with weights drawn by series and name, and noise drawn by date and name.

    Each name, such as a sector's, has weights and noise of its own.  The first
    date has no return and is left out.
    """
    u = lambda k, *c: (F.pmod(F.xxhash64(*c, F.lit(name), F.lit(seed + k)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    normal = lambda *c: F.sqrt(-2 * F.log(u(0, *c))) * F.cos(2 * F.pi() * u(1, *c))
    sums = panel.groupBy("ts").agg(F.sum(F.col("value") * normal("series") * weight).alias("y"))
    start = panel.agg(F.min("ts")).first()[0]
    return sums.select("ts", (F.col("y") + normal("ts") * noise).alias("y")).where(F.col("ts") > F.lit(start))
