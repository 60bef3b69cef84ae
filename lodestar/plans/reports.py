"""Text of results: tables as lines, and as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def markdown(df: DataFrame, order: list[str], places: int = 4) -> DataFrame:
    """(place, line): df as a markdown table, a line for each row in the given order; nulls are empty."""
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + " --- |" * len(df.columns))], "place long, line string")
    cell = lambda c, k: F.when(F.col(c).isNull(), "").otherwise(F.format_string(f"%.{places}f", F.col(c)) if k == "double" else F.col(c).cast("string"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c, k) for c, k in df.dtypes]), F.lit(" |"))
    place = F.row_number().over(Window.orderBy(*order)).cast("long") + 1  # a report has a row for each model or series
    return head.unionByName(df.select(place.alias("place"), line.alias("line")))


def write_markdown(df: DataFrame, path: str, order: list[str], places: int = 4) -> None:
    """The table as one text file in a folder that is replaced."""
    markdown(df, order, places).coalesce(1).sortWithinPartitions("place").select("line").write.mode("overwrite").text(path)
