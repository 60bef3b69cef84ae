"""Panels that the queries read, as DataFrames and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import by, ffill, pct_change
from ..sources import on_calendar, read_table

#: The last month of orders has one day, which is left out; lineitem runs to its end.
END = "2001-08-01"
SPLIT = "1998-12-31"
#: Columns of results are rounded to this many places.
PLACES = 6


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Monthly sums by part type and by order priority: (series, grp, ts, value)."""
    li = read_table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice")
    a = li.join(read_table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    a = a.groupBy(F.col("p_type").alias("series"), F.last_day("l_shipdate").alias("ts")).agg(F.sum("l_extendedprice").alias("value"))
    o = read_table(spark, d, "orders").where(F.col("o_orderdate") < END)
    b = o.groupBy(F.col("o_orderpriority").alias("series"), F.last_day("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("value"))
    return a.select("series", F.lit("type").alias("grp"), "ts", "value").union(b.select("series", F.lit("priority").alias("grp"), "ts", "value"))


def returns(spark: SparkSession, d: str) -> DataFrame:
    """panel with ret, the change to the month before, as a tenth so that equity stays positive."""
    return panel(spark, d).withColumn("ret", pct_change(F.col("value"), by("series")) / 10)


def gappy(spark: SparkSession, d: str) -> DataFrame:
    """panel with holes at dates that depend on month and series."""
    hole = F.pmod(F.month("ts") * 5 + F.length("series") + F.year("ts"), F.lit(7)) < 2
    return panel(spark, d).withColumn("value", F.when(~hole, F.col("value")))


def price(spark: SparkSession, d: str) -> DataFrame:
    """One index: the monthly sum of orders."""
    o = read_table(spark, d, "orders").where(F.col("o_orderdate") < END)
    return o.groupBy(F.last_day("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("price")).withColumn("series", F.lit("index"))


def target(spark: SparkSession, d: str) -> DataFrame:
    """panel with y, the index's return of the next month."""
    p = price(spark, d).select("ts", (F.try_divide(F.lead("price").over(by("series")), F.col("price")) - 1).alias("y"))
    return panel(spark, d).join(p, "ts", "left")


def signals(spark: SparkSession, d: str) -> DataFrame:
    """returns with pred (the last return, centred on the series' past mean), actual and bench, from the second month on."""
    w = by("series")
    past = F.avg("ret").over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = returns(spark, d).withColumn("bench", past).withColumn("pred", F.lag("ret").over(w) - past * 0.5)
    return r.where("ret is not null and pred is not null").withColumn("actual", F.col("ret"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Daily sums of orders by market segment on a full calendar, filled forward: (series, ts, value)."""
    o = read_table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_totalprice").join(read_table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.groupBy(F.col("c_mktsegment").alias("series"), F.to_date("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("value"))
    return on_calendar(o, ["series"], step="day").withColumn("value", ffill(F.col("value"), by("series")))


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Doubles rounded, counts as bigint."""
    kinds = {"double": lambda c: F.round(c, places), "int": lambda c: c.cast("long")}
    return df.select(*[kinds[k](F.col(c)).alias(c) if k in kinds else F.col(c) for c, k in df.dtypes])


#: The panels as SQL, to go before an oracle's select.
SQL = f"""WITH panel AS (
  SELECT p_type AS series, 'type' AS grp, last_day(CAST(l_shipdate AS DATE)) AS ts, sum(l_extendedprice) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 3
  UNION ALL SELECT o_orderpriority, 'priority', last_day(CAST(o_orderdate AS DATE)), sum(o_totalprice) FROM orders WHERE o_orderdate < TIMESTAMP '{END}' GROUP BY 1, 3),
ret AS (SELECT *, (value / lag(value) OVER (PARTITION BY series ORDER BY ts) - 1) / 10 AS ret FROM panel),
gappy AS (SELECT series, grp, ts, CASE WHEN (month(ts) * 5 + length(series) + year(ts)) % 7 < 2 THEN NULL ELSE value END AS value FROM panel),
price AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS ts, sum(o_totalprice) AS price FROM orders WHERE o_orderdate < TIMESTAMP '{END}' GROUP BY 1),
tgt AS (SELECT p.*, y FROM panel p LEFT JOIN (SELECT ts, lead(price) OVER (ORDER BY ts) / price - 1 AS y FROM price) USING (ts)),
sig AS (SELECT * FROM (SELECT *, ret AS actual, avg(ret) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bench, lag(ret) OVER (PARTITION BY series ORDER BY ts) - 0.5 * avg(ret) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pred FROM ret) WHERE ret IS NOT NULL AND pred IS NOT NULL),
daysum AS (SELECT c_mktsegment AS series, CAST(o_orderdate AS DATE) AS ts, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
daycal AS (SELECT series, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS ts FROM (SELECT series, min(ts) AS a, max(ts) AS b FROM daysum GROUP BY 1)),
daily AS (SELECT series, ts, last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) AS value FROM daycal LEFT JOIN daysum USING (series, ts))
"""
W = "(PARTITION BY series ORDER BY ts)"


class Registry:
    """Collects queries and their oracles; an oracle's doubles are rounded as the query's are."""

    def __init__(self):
        self.queries, self.oracles = {}, {}

    def __call__(self, sql: str | None = None, places: int = PLACES):
        def add(f):
            self.queries[f.__name__] = lambda spark, d: rounded(f(spark, d), places)
            self.queries[f.__name__].__doc__ = f.__doc__
            if sql:
                self.oracles[f.__name__] = _expanded(SQL + sql.replace("R(", f"round_{places}("), places)
            return f

        return add


def _expanded(sql: str, places: int) -> str:
    """R(x) of an oracle spelled as round(x, places)."""
    mark = f"round_{places}("
    while mark in sql:
        a = sql.index(mark)
        k, depth = a + len(mark), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        sql = sql[:a] + "round(" + sql[a + len(mark) : k - 1] + f", {places})" + sql[k:]
    return sql
