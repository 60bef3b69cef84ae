"""Tolerant readers with a channel for bad records, idempotent sinks, and stored extracts by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import by, latest
from . import month_mean, on_calendar

BAD = "_corrupt_record"


def split_records(raw: DataFrame, dates: dict[str, str], numbers: list[str], needed: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of raw rows of text columns.

    ``dates`` names columns and their patterns, ``numbers`` columns of
    numbers; each is tried, and what does not parse is null.  A row is bad if
    the reader put it into ``_corrupt_record``, if a text that is there does not
    parse, or if a needed column is missing; bad rows keep their text and
    say why.  Each row is in one of the two.
    """
    texts = [c for c in raw.columns if c != BAD]
    parsed = {c: F.to_date(F.try_to_timestamp(F.trim(c), F.lit(p))) for c, p in dates.items()}
    parsed |= {c: F.expr(f"try_cast(trim(replace(`{c}`, ',', '')) as double)") for c in numbers}
    there = lambda c: F.col(c).isNotNull() & (F.trim(c) != "")
    why = F.array_compact(F.array(
        F.when(F.col(BAD).isNotNull(), F.lit("record")) if BAD in raw.columns else F.lit(None).cast("string"),
        *[F.when(there(c) & (v.isNull() | F.coalesce(F.isnan(v) if c in numbers else F.lit(False), F.lit(False))), F.lit(c)) for c, v in parsed.items()],
        *[F.when(~F.coalesce(there(c), F.lit(False)), F.lit(f"no {c}")) for c in needed],
    ))
    judged = raw.withColumn("why", why)
    good = judged.where(F.size("why") == 0).select(*[parsed.get(c, F.col(c)).alias(c) for c in texts])
    return good, judged.where(F.size("why") > 0)


def read_records(spark: SparkSession, path: str, columns: list[str], dates: dict[str, str], numbers: list[str], needed: list[str], skip: str | None = None, header: bool = True, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of CSV files: columns by position, lines that match ``skip`` (a pattern, for titles and notes) left out.

    A line with more or fewer fields than ``columns`` is bad as a record.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    if skip:
        lines = lines.where(~F.col("value").rlike(skip))
    if header:
        first = F.concat_ws(sep, *map(F.lit, columns))
        lines = lines.where(F.lower(F.regexp_replace("value", '["\\s]', "")) != F.lower(F.regexp_replace(first, '["\\s]', "")))
    schema = ", ".join(f"`{c}` string" for c in [*columns, BAD])
    raw = lines.select(F.from_csv("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD, "sep": sep}).alias("r"), "value").select("r.*", "value")
    wrong = F.size(F.split("value", sep)) != len(columns)
    return split_records(raw.withColumn(BAD, F.when(wrong & F.col(BAD).isNull() & ~F.col("value").contains('"'), F.col("value")).otherwise(F.col(BAD))).drop("value"), dates, numbers, needed)


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return latest(df, keys, list(order))


def ratio_months(*sources: DataFrame) -> DataFrame:
    """(series, ts, value): the monthly mean of several sources of (series, day, value), where the earlier source wins a day that two have."""
    rows = None
    for k, s in enumerate(sources):
        s = s.select("series", "day", "value", F.lit(k).alias("source")).where("day is not null and value is not null")
        rows = s if rows is None else rows.unionByName(s)
    one = first_of(rows, ["series", "day"], F.col("source"), F.col("value"))
    return month_mean(one, ["series"], "day", "value")


def decimal_year_months(df: DataFrame, until: str | None = None) -> DataFrame:
    """(series, ts, value) of (series, stamp, value, line): stamp is year and hundredths of it as month; of equal months the last line counts."""
    year = F.floor("stamp")
    month = F.least(F.greatest(F.round((F.col("stamp") - year) * 100).cast("int"), F.lit(1)), F.lit(12))
    df = df.where("stamp is not null and value is not null").withColumn("ts", F.last_day(F.make_date(year.cast("int"), month, F.lit(1))))
    df = first_of(df, ["series", "ts"], F.col("line").desc()).select("series", "ts", "value")
    return df.where(F.col("ts") <= F.lit(until).cast("date")) if until else df


def quarters_as_months(df: DataFrame) -> DataFrame:
    """(series, ts, value) with a row for each month end from the first to the last, filled forward from the last day at or before it."""
    ends = df.where("value is not null").groupBy("series", F.last_day("ts").alias("ts")).agg(F.max_by("value", "ts").alias("value"))
    w = by("series").rowsBetween(-(1 << 31) + 1, 0)
    return on_calendar(ends, ["series"]).withColumn("value", F.last("value", True).over(w))


def joined_features(panel: DataFrame, *more: DataFrame) -> DataFrame:
    """(series, ts, value) of a panel's dates, with further series laid on them: filled forward, and before their first value with it."""
    dates = panel.select("ts").distinct()
    rows = None
    for m in more:
        m = m.select("series", "ts", "value").where("value is not null")
        rows = m if rows is None else rows.unionByName(m)
    if rows is None:
        return panel
    grid = rows.select("series").distinct().join(dates).join(rows, ["series", "ts"], "left")
    w = by("series")
    value = F.coalesce(F.last("value", True).over(w.rowsBetween(-(1 << 31) + 1, 0)), F.first("value", True).over(w.rowsBetween(0, (1 << 31) - 1)))
    return panel.select("series", "ts", "value").unionByName(grid.select("series", "ts", value.alias("value")))


def write_partitions(df: DataFrame, path: str, parts: list[str]) -> None:
    """Parquet by partition columns; only the partitions that df has are replaced, so that writing twice leaves one copy."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*parts).parquet(path)


class Extracts:
    """Stored results under ``root`` by prefix and key, in one table partitioned by both: made once, read again, cleared by prefix."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def path(self, prefix: str, *args: str) -> str:
        """The folder of an extract: its prefix, and the MD5 of its arguments joined by underscores."""
        import hashlib

        return f"{self.root}/{prefix}/{hashlib.md5('_'.join(args).encode()).hexdigest()}"

    def get(self, prefix: str, args: tuple[str, ...], make) -> DataFrame:
        """The extract as stored; where there is none (or an unfinished one), ``make()`` is stored first."""
        path = self.path(prefix, *args)
        fs, done = self._fs(f"{path}/_SUCCESS")
        if not fs.exists(done):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def clear(self, prefix: str | None = None) -> bool:
        """Deletes the extracts of a prefix, or all; tells whether there were any."""
        fs, path = self._fs(f"{self.root}/{prefix}" if prefix else self.root)
        return bool(fs.delete(path, True))


def write_report(df: DataFrame, folder: str, run: str) -> None:
    """Predictions (series, ts, actual, pred, bench) by run, and one row of metrics a run and series, each written as one partition a run."""
    from ..operators.metrics import accuracy

    write_partitions(df.withColumn("run", F.lit(run)), f"{folder}/predictions", ["run"])
    write_partitions(accuracy(df, ["series"]).withColumn("run", F.lit(run)), f"{folder}/metrics", ["run"])
