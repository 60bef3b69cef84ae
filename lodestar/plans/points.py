"""Queries on panels with two time axes, tolerant records and loaders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files, read_table, vintages
from . import panels
from .panels import Registry

query = Registry()


def _revised(spark, d):
    """Per return flag and order month, the price known at each ship date."""
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice", "l_returnflag")
    li = li.join(read_table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return li.groupBy(F.col("l_returnflag").alias("series"), F.to_date("o_orderdate").alias("ts"), F.to_date("l_shipdate").alias("vintage")).agg(F.sum("l_extendedprice").alias("value"))


_REVISED = "revised AS (SELECT l_returnflag AS series, CAST(o_orderdate AS DATE) AS ts, CAST(l_shipdate AS DATE) AS vintage, sum(l_extendedprice) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3), ends AS (SELECT DISTINCT last_day(CAST(o_orderdate AS DATE)) AS as_of FROM orders)"
_KNOWN = f"{_REVISED}, known AS (SELECT as_of, series, ts, max_by(value, vintage) AS value, max(vintage) AS vintage FROM ends JOIN revised ON vintage <= as_of AND ts <= as_of GROUP BY 1, 2, 3)"


@query(f", {_KNOWN} SELECT as_of, series, count(*) AS n, R(sum(value)) AS value, max(vintage) AS vintage FROM known GROUP BY 1, 2", 2)
def bitemporal_panel(spark, d):
    """What was known of each series at each month's end, all ends at once."""
    dates = read_table(spark, d, "orders").select(F.last_day("o_orderdate").alias("as_of")).distinct()
    known = vintages.panel_as_of(_revised(spark, d), dates, ["series"])
    return known.groupBy("as_of", "series").agg(F.count("*").alias("n"), F.sum("value").alias("value"), F.max("vintage").alias("vintage"))


@query(f", {_KNOWN} SELECT as_of, series, last_day(ts) AS ts, R(max_by(value, ts)) AS value FROM known WHERE as_of >= DATE '2001-01-01' GROUP BY 1, 2, 3", 2)
def monthly_vintage_panel(spark, d):
    """Month ends of the panels known in the last year."""
    dates = read_table(spark, d, "orders").select(F.last_day("o_orderdate").alias("as_of")).where("as_of >= DATE'2001-01-01'").distinct()
    return vintages.monthly_as_of(vintages.panel_as_of(_revised(spark, d), dates, ["series"]), ["series"])


@query("""SELECT why, count(*) AS n, R(sum(price)) AS price FROM (SELECT CASE WHEN k % 7 = 0 AND k % 11 = 0 THEN 'stamp,price' WHEN k % 7 = 0 THEN 'stamp' WHEN k % 11 = 0 THEN 'price' ELSE '' END || CASE WHEN k % 13 = 0 THEN CASE WHEN k % 7 = 0 OR k % 11 = 0 THEN ',' ELSE '' END || 'no label' ELSE '' END AS why,
CASE WHEN k % 7 != 0 AND k % 11 != 0 AND k % 13 != 0 THEN p END AS price FROM (SELECT o_orderkey AS k, round(o_totalprice, 2) AS p FROM orders)) GROUP BY 1""", 2)
def tolerant_records(spark, d):
    """Records as text, some of them spoilt: each is loaded or told apart with what is wrong."""
    k = F.col("o_orderkey")
    raw = read_table(spark, d, "orders").select(
        F.when(k % 7 == 0, "n/a").otherwise(F.date_format("o_orderdate", "dd.MM.yyyy")).alias("stamp"),
        F.when(k % 11 == 0, "12x").otherwise(F.format_number("o_totalprice", 2)).alias("price"), F.when(k % 13 == 0, " ").otherwise(F.col("o_orderpriority")).alias("label"),
    )
    good, bad = files.split_records(raw, {"stamp": "dd.MM.yyyy"}, ["price"], ["stamp", "price", "label"])
    good = good.where("stamp IS NOT NULL").select(F.lit("").alias("why"), "price")
    return good.unionByName(bad.select(F.array_join("why", ",").alias("why"), F.lit(None).cast("double").alias("price"))).groupBy("why").agg(F.count("*").alias("n"), F.sum("price").alias("price"))


@query("""SELECT 'ratio' AS series, last_day(day) AS ts, R(avg(value)) AS value FROM (SELECT day, value, row_number() OVER (PARTITION BY day ORDER BY source, value) AS rn FROM (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS value, 0 AS source FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1 UNION ALL SELECT CAST(o_orderdate AS DATE), avg(o_totalprice), 1 FROM orders GROUP BY 1)) WHERE rn = 1 GROUP BY 2""", 4)
def ratio_months(spark, d):
    """Two overlapping daily sources, of which the first wins, as monthly means."""
    o = read_table(spark, d, "orders").select(F.lit("ratio").alias("series"), F.to_date("o_orderdate").alias("day"), "o_totalprice", "o_orderpriority")
    source = lambda df: df.groupBy("series", "day").agg(F.avg("o_totalprice").alias("value"))
    return files.ratio_months(source(o.where("o_orderpriority = '5-LOW'")), source(o))


@query("""SELECT series, ts, R(value) AS value FROM (SELECT 'cape' AS series, last_day(make_date(CAST(floor(stamp) AS INT), least(greatest(CAST(round((stamp - floor(stamp)) * 100) AS INT), 1), 12), 1)) AS ts, max_by(value, line) AS value FROM (SELECT year(o_orderdate) + (month(o_orderdate) + day(o_orderdate) % 3 - 1) / 100.0::DOUBLE AS stamp, o_totalprice AS value, o_orderkey AS line FROM orders) GROUP BY 2) WHERE ts <= DATE '2000-06-30'""", 2)
def decimal_year_series(spark, d):
    """Stamps of year and hundredths, the last line of each month, up to a cutoff."""
    o = read_table(spark, d, "orders")
    stamp = F.year("o_orderdate") + (F.month("o_orderdate") + F.pmod(F.dayofmonth("o_orderdate"), F.lit(3)) - 1) / F.lit(100.0)
    return files.decimal_year_months(o.select(F.lit("cape").alias("series"), stamp.alias("stamp"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("line")), "2000-06-30")


_Q = "q AS (SELECT series, ts, value FROM panel WHERE month(ts) % 3 = 0 AND grp = 'priority'), m AS (SELECT series, last_day(CAST(unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS DATE)) AS ts FROM (SELECT series, min(ts) AS a, max(ts) AS b FROM q GROUP BY 1))"


@query(f", {_Q} SELECT series, ts, R(last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS value FROM m LEFT JOIN q USING (series, ts)", 2)
def quarters_as_months(spark, d):
    return files.quarters_as_months(panels.panel(spark, d).where("grp = 'priority' AND month(ts) % 3 = 0").select("series", "ts", "value"))


@query("""SELECT series, ts, R(value) AS value FROM panel WHERE grp = 'type' UNION ALL SELECT series, ts, R(coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING), first_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))) FROM (SELECT DISTINCT ts FROM panel WHERE grp = 'type') JOIN (SELECT DISTINCT series FROM panel WHERE grp = 'priority') ON true LEFT JOIN (SELECT * FROM gappy WHERE value IS NOT NULL AND year(ts) > 1996) USING (series, ts)""", 2)
def joined_features(spark, d):
    """Series that start late and have gaps, laid on a panel's dates."""
    p = panels.panel(spark, d)
    late = panels.gappy(spark, d).where("grp = 'priority' AND year(ts) > 1996")
    return files.joined_features(p.where("grp = 'type'"), late)


QUERIES, ORACLES = query.queries, query.oracles
