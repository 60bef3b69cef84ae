"""Series with two time axes: what a value is for (ts) and when it was known (vintage)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def validity(df: DataFrame, keys: list[str], stamp: str = "vintage", value: str = "value", ts: str = "ts") -> DataFrame:
    """df (keys, ts, vintage, value) with until, the vintage that replaces each value (null: none yet).

    Of rows with one key, ts and vintage the largest value counts; a null value
    is a withdrawal, and a row without a vintage was never known.
    """
    one = df.where(F.col(stamp).isNotNull()).groupBy(*keys, ts, stamp).agg(F.max(value).alias(value))
    return one.withColumn("until", F.lead(stamp).over(Window.partitionBy(*keys, ts).orderBy(stamp)))


def panel_as_of(df: DataFrame, dates: DataFrame, keys: list[str], stamp: str = "vintage", value: str = "value", ts: str = "ts") -> DataFrame:
    """(as_of, keys, ts, vintage, value): for each date of ``dates`` (as_of), all that was known on it.

    A value is known from its vintage until the next one.  Each such span is
    cut at months, and meets the dates of its months by an equal join; the
    ends are compared afterwards.  So the work is that of the result, for all
    dates at once.  Values for dates after as_of are left out, as are
    withdrawn ones; a repeated date counts once.
    """
    dates = dates.select(F.col("as_of").cast("date").alias("as_of")).where("as_of is not null").distinct()
    month = lambda c: F.floor(F.months_between(F.trunc(c, "MM"), F.lit("1900-01-01"))).cast("int")
    first, last = dates.agg(F.min(month("as_of")), F.max(month("as_of"))).first()
    spans = validity(df.select(*keys, F.col(ts).alias(ts), F.col(stamp).cast("date").alias(stamp), value), keys, stamp, value, ts).where(F.col(value).isNotNull())
    low, high = F.greatest(month(stamp), F.lit(first)), F.least(F.coalesce(month("until"), F.lit(last)), F.lit(last))
    spans = spans.withColumn("_m", F.explode(F.when(low <= high, F.sequence(low, high))))
    known = spans.join(dates.withColumn("_m", month("as_of")), "_m").where((F.col(stamp) <= F.col("as_of")) & (F.col("until").isNull() | (F.col("as_of") < F.col("until"))))
    return known.where(F.col(ts) <= F.col("as_of")).select("as_of", *keys, ts, stamp, value)


def monthly_as_of(known: DataFrame, keys: list[str]) -> DataFrame:
    """The last value of each month in each date's panel, stamped with the month's end."""
    return known.groupBy("as_of", *keys, F.last_day("ts").alias("ts")).agg(F.max_by("value", "ts").alias("value"))
