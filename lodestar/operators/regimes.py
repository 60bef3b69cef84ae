"""Market regimes: labels, votes, smoothing and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import by, islands, rolling

#: The order in which ties are broken.
ORDER = ("bull", "bear", "high_vol", "low_vol", "up", "down", "consolidation", "recovery", "unknown")


def volatility(df: DataFrame, split: str, n: int = 12) -> DataFrame:
    """high_vol or low_vol beyond the quartiles of the training rows (up to split), else consolidation, also while warming up."""
    df = df.withColumn("vol", rolling(F.col("ret"), F.stddev_samp, by("series"), n))
    cuts = df.where(F.col("ts") <= F.lit(split).cast("date")).groupBy("series").agg(F.percentile("vol", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    df = df.join(cuts, "series", "left")
    label = F.when(F.col("vol") > F.col("q")[1], "high_vol").when(F.col("vol") < F.col("q")[0], "low_vol").otherwise("consolidation")
    return df.withColumn("vol_regime", label).drop("q")


def trend(df: DataFrame, n: int = 12, least: float = 0.0) -> DataFrame:
    """up or down by the sum of the last n returns; null while warming up."""
    df = df.withColumn("momentum", rolling(F.col("ret"), F.sum, by("series"), n))
    m = F.col("momentum")
    return df.withColumn("trend_regime", F.when(m > least, "up").when(m < -least, "down").when(m.isNotNull(), "consolidation"))


def drawdown(df: DataFrame, limit: float = 0.10) -> DataFrame:
    """bear while equity lies more than ``limit`` below its peak."""
    w = by("series").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("equity", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(w))
    df = df.withColumn("dd", F.col("equity") / F.max("equity").over(w) - 1)
    return df.withColumn("dd_regime", F.when(F.col("dd") < -limit, "bear").otherwise("consolidation"))


def median_split(df: DataFrame, n: int = 12) -> DataFrame:
    """The stand-in for states that cannot be fitted: volatility over or under its median."""
    df = df.withColumn("vol", rolling(F.col("ret"), F.stddev_samp, by("series"), n))
    cut = df.groupBy("series").agg(F.median("vol").alias("cut"))
    return df.join(cut, "series").withColumn("state", F.when(F.col("vol") > F.col("cut"), "high_vol").when(F.col("vol") <= F.col("cut"), "low_vol")).drop("cut")


def vote(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The label with most votes of the columns in weights; ties go to the first in ORDER, as does a row without votes."""
    columns = list(weights)
    score = lambda r: sum((F.when(F.col(c) == r, F.lit(float(weights[c]))).otherwise(0.0) for c in columns), F.lit(0.0))
    votes = F.array(*[F.struct(score(r).alias("v"), F.lit(-k).alias("k"), F.lit(r).alias("r")) for k, r in enumerate(ORDER)])
    return df.withColumn("regime", F.array_max(votes)["r"])


def smoothed(df: DataFrame, label: str = "regime", least: int = 3) -> DataFrame:
    """Runs shorter than ``least`` take the raw label of the next run; a short last run takes that of the one before. A series of fewer rows than that stays as it is."""
    df = islands(df, label, ["series"])
    runs = df.groupBy("series", "run").agg(F.first(label).alias("raw"), F.first("run_len").alias("len"))
    w = Window.partitionBy("series").orderBy("run")
    few = F.sum("len").over(Window.partitionBy("series")) < least
    runs = runs.withColumn("smooth", F.when(few | (F.col("len") >= least), F.col("raw")).otherwise(F.coalesce(F.lead("raw").over(w), F.lag("raw").over(w), F.col("raw"))))
    return df.join(runs.select("series", "run", "smooth"), ["series", "run"])


def features(df: DataFrame, label: str, labels: tuple[str, ...], n: int = 12) -> DataFrame:
    """One-hot columns, persistence, its share of the window's longest, and volatility within each label."""
    df = islands(df, label, ["series"]).withColumn("persistence", F.col("run_pos").cast("long"))
    w = by("series")
    df = df.withColumn("strength", F.col("persistence") / rolling(F.col("persistence"), F.max, w, n, 1))
    vol = rolling(F.col("ret"), F.stddev_samp, w, n)
    for r in labels:
        df = df.withColumn(f"is_{r}", F.coalesce((F.col(label) == r).cast("int"), F.lit(0))).withColumn(f"vol_{r}", F.when(F.col(label) == r, vol).otherwise(0.0))
    return df


def shares(df: DataFrame, label: str) -> DataFrame:
    """(series, label, n, share in per cent)."""
    n = df.where(F.col(label).isNotNull()).groupBy("series", label).agg(F.count("*").alias("n"))
    return n.withColumn("share", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("series")))
