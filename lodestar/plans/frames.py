"""Resampling, alignment, ordered frames and derived indicators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import sources
from ..functions import bfill, by, correlation, diff, expanding, ffill, forward_return, interpolate, lead_fill, pct_change, rolling, stride
from ..functions.quantiles import running_quantiles
from ..operators import features, metrics, portfolio
from ..streaming import windowed
from . import panels
from .panels import SPLIT, Registry, W

query = Registry()


def _over(sql: str, table: str = "panel", name: str = "x") -> str:
    return f"SELECT series, ts, R({sql}) AS {name} FROM {table}"


def _x(df, c, name="x"):
    return df.select("series", "ts", c.alias(name))


def _min(agg: str, n: int, col: str = "ret", least: int | None = None) -> str:
    f = f"OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) {f} >= {least or n} THEN {agg} {f} END"


@query(f"""SELECT R(total) AS total, R(vol) AS vol, R(sharpe) AS sharpe, R(max_dd) AS max_dd, n FROM (
SELECT product(1 + r) - 1 AS total, stddev_samp(r) * sqrt(12) AS vol, avg(r) / stddev_samp(r) * sqrt(12) AS sharpe, count(r) AS n, max((peak - eq) / peak) AS max_dd FROM (
SELECT r, eq, max(eq) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM (SELECT ts, r, product(1 + r) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS eq FROM (SELECT ts, (price / lag(price) OVER (ORDER BY ts) - 1) / 10 AS r FROM price) WHERE r IS NOT NULL)))""")
def performance_summary(spark, d):
    """Monthly price to return, equity, drawdown and one row of risk figures."""
    r = panels.price(spark, d).withColumn("ret", pct_change(F.col("price"), by("series")) / 10)
    return metrics.risk(r, ["series"]).select("total", "vol", "sharpe", "max_dd", "n")


@query("SELECT series, ts, R(max_by(v, d)) AS value FROM (SELECT event_type AS series, last_day(CAST(ts AS DATE)) AS ts, ts AS d, value AS v FROM events) GROUP BY 1, 2")
def resample_month_last(spark, d):
    e = sources.read_table(spark, d, "events").select(F.col("event_type").alias("series"), F.col("ts").alias("d"), "value")
    return sources.month_last(e, ["series"])


@query("SELECT event_type AS series, last_day(CAST(ts AS DATE)) AS ts, R(avg(value)) AS value FROM events GROUP BY 1, 2")
def resample_month_mean(spark, d):
    e = sources.read_table(spark, d, "events").select(F.col("event_type").alias("series"), F.col("ts").alias("d"), "value")
    return sources.month_mean(e, ["series"])


@query("SELECT series, ts, R(value) AS value FROM daily", 2)
def calendar_ffill(spark, d):
    """Daily sums on a full calendar, filled forward."""
    return panels.daily(spark, d)


for _name, _f, _sql in (
    ("gap_fill_ffill", ffill, f"last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING)"),
    ("gap_fill_bfill", bfill, "first_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"),
    ("gap_fill_leading", lead_fill, "coalesce(value, first_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"),
):

    def _fill(spark, d, f=_f):
        return _x(panels.gappy(spark, d), f(F.col("value"), by("series")))

    _fill.__name__ = _name
    query(_over(_sql, "gappy"), 2)(_fill)


@query("""SELECT series, ts, R(coalesce(value, CASE WHEN v1 IS NULL THEN v0 WHEN v0 IS NOT NULL THEN v0 + (v1 - v0) * (rn - r0) / (r1 - r0) END)) AS x FROM (
SELECT *, last_value(value IGNORE NULLS) OVER b AS v0, first_value(value IGNORE NULLS) OVER f AS v1, last_value(pl IGNORE NULLS) OVER b AS r0, first_value(pl IGNORE NULLS) OVER f AS r1 FROM (
SELECT *, CASE WHEN value IS NOT NULL THEN rn END AS pl FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) AS rn FROM (SELECT series, ts, value / 1e6 AS value FROM gappy)))
WINDOW b AS (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""", 3)
def gap_fill_linear(spark, d):
    return _x(panels.gappy(spark, d).withColumn("value", F.col("value") / 1e6), interpolate(F.col("value"), by("series")))


@query("SELECT series, ts, coalesce(R(value), 0) AS x FROM gappy", 2)
def fill_zero(spark, d):
    return _x(panels.gappy(spark, d), F.coalesce(F.col("value"), F.lit(0.0)))


@query(f"SELECT series, ts, R(100 * (value / lag(value, 3) OVER {W} - 1)) AS g3, R(100 * (value / lag(value, 6) OVER {W} - 1)) AS g6, R(100 * (value / lag(value, 12) OVER {W} - 1)) AS g12, R(100 * (value / lag(value, 3) OVER {W} - 1) - 100 * (value / lag(value, 12) OVER {W} - 1)) AS accel FROM panel")
def growth_acceleration(spark, d):
    return features.growth(panels.panel(spark, d))


@query(_over(f"value - lag(value, 12) OVER {W}"), 2)
def diff_12(spark, d):
    return _x(panels.panel(spark, d), diff(F.col("value"), by("series"), 12))


@query(_over(f"lead(value, 3) OVER {W} / value - 1"))
def forward_return_3(spark, d):
    return _x(panels.panel(spark, d), forward_return(F.col("value"), by("series"), 3))


@query(f"SELECT series, ts, R(value) AS value, R(y) AS y FROM (SELECT *, lead(ret) OVER {W} AS y FROM ret) WHERE y IS NOT NULL", 4)
def lead1_align(spark, d):
    """Features of a month with the return of the next; the last has none."""
    return panels.returns(spark, d).withColumn("y", F.lead(F.col("ret")).over(by("series"))).where("y is not null").select("series", "ts", "value", "y")


@query("SELECT series, ts, R(value) AS value, R(y) AS y FROM tgt", 4)
def left_join_target(spark, d):
    return panels.target(spark, d).select("series", "ts", "value", "y")


@query("SELECT ts, R(a.value) AS a, R(b.value) AS b FROM (SELECT ts, value FROM gappy WHERE series = '1-URGENT' AND value IS NOT NULL) a FULL JOIN (SELECT ts, value FROM gappy WHERE series = '5-LOW' AND value IS NOT NULL) b USING (ts)", 2)
def full_join_series(spark, d):
    g = panels.gappy(spark, d).where("value is not null")
    a, b = (g.where(F.col("series") == s).select("ts", F.col("value").alias(c)) for s, c in (("1-URGENT", "a"), ("5-LOW", "b")))
    return a.join(b, "ts", "full")


@query("SELECT ts, R(a.value - b.value) AS value, 'urgent-low' AS series FROM panel a JOIN panel b USING (ts) WHERE a.series = '1-URGENT' AND b.series = '5-LOW'", 2)
def spread_columns(spark, d):
    return features.spread(panels.panel(spark, d), "1-URGENT", "5-LOW", "urgent-low")


@query("SELECT user_id, ts, R(v) AS value FROM (SELECT l.user_id, l.ts, max_by(r.value, r.ts) AS v FROM (SELECT user_id, ts FROM events WHERE event_type = 'click') l LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type <> 'click') r ON l.user_id = r.user_id AND r.ts <= l.ts GROUP BY 1, 2)")
def as_of_join(spark, d):
    """Each click with its user's last value of another kind."""
    e = sources.read_table(spark, d, "events")
    return sources.as_of(e.where("event_type = 'click'").select("user_id", "ts"), e.where("event_type != 'click'").select("user_id", "ts", "value"), ["user_id"])


@query("SELECT ts, R(max_by(value, vintage)) AS value, max(vintage) AS vintage FROM (SELECT last_day(CAST(o_orderdate AS DATE)) AS ts, CAST(l_shipdate AS DATE) AS vintage, sum(l_extendedprice) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) WHERE vintage <= DATE '1998-06-30' GROUP BY 1", 2)
def vintage_asof(spark, d):
    """Per order month, the value of the last ship date known on a day."""
    li = sources.read_table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice").join(sources.read_table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    v = li.groupBy(F.last_day("o_orderdate").alias("ts"), F.to_date("l_shipdate").alias("vintage")).agg(F.sum("l_extendedprice").alias("value"))
    return sources.vintage(v, "1998-06-30", ["ts"])


for _name, _n, _agg, _sql in (("rolling_std_12", 12, F.stddev_samp, "stddev_samp(ret)"), ("rolling_sum_12", 12, F.sum, "sum(ret)"), ("rolling_mean_20", 20, F.avg, "avg(ret)"), ("rolling_max_12", 12, F.max, "max(ret)")):

    def _roll(spark, d, n=_n, agg=_agg):
        return _x(panels.returns(spark, d), rolling(F.col("ret"), agg, by("series"), n))

    _roll.__name__ = _name
    query(_over(_min(_sql, _n), "ret"))(_roll)


@query(_over(_min("stddev_samp(ret)", 12, least=6) + " * sqrt(12) * 100", "ret"))
def rolling_vol_proxy(spark, d):
    """Yearly volatility in per cent, from 6 values on."""
    return _x(panels.returns(spark, d), rolling(F.col("ret"), F.stddev_samp, by("series"), 12, 6) * F.sqrt(F.lit(12.0)) * 100)


@query(_over(f"({_min('avg(ret)', 24)}) / ({_min('stddev_samp(ret)', 24)}) * sqrt(12)", "ret"), 5)
def rolling_sharpe_24(spark, d):
    w = by("series")
    return _x(panels.returns(spark, d), F.try_divide(rolling(F.col("ret"), F.avg, w, 24), rolling(F.col("ret"), F.stddev_samp, w, 24)) * F.sqrt(F.lit(12.0)))


@query(_over("CASE WHEN count(*) OVER f >= 12 THEN avg(CAST(sign(actual) = sign(pred) AS DOUBLE)) OVER f END", "sig") + " WINDOW f AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
def rolling_hit_rate_12(spark, d):
    s = panels.signals(spark, d).withColumn("hit", (F.signum("actual") == F.signum("pred")).cast("double"))
    return _x(s, rolling(F.col("hit"), F.avg, by("series"), 12))


@query("SELECT series, ts, R(CASE WHEN count(ret) OVER f >= 24 THEN corr(ret, m) OVER f END) AS x FROM (SELECT *, avg(ret) OVER (PARTITION BY ts) AS m FROM ret) WINDOW f AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)")
def rolling_corr_24(spark, d):
    r = panels.returns(spark, d).withColumn("m", F.avg("ret").over(Window.partitionBy("ts")))
    f = by("series").rowsBetween(-23, 0)
    return _x(r, F.when(F.count("ret").over(f) >= 24, correlation(F.col("ret"), F.col("m"), f)))


@query(_over("max(abs(ret)) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING)", "ret"))
def expanding_max(spark, d):
    return _x(panels.returns(spark, d), expanding(F.abs(F.col("ret")), F.max, by("series")))


@query(_over("greatest(coalesce(CASE WHEN count(ret) OVER f >= 2 THEN stddev_samp(abs(ret)) OVER f END, first_value(abs(ret)) OVER (PARTITION BY series ORDER BY ts)), 1e-8)", "ret WHERE ret IS NOT NULL") + " WINDOW f AS (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def expanding_std_lagged(spark, d):
    """The spread of all sizes before; the first size until there are two."""
    return _x(panels.returns(spark, d).where("ret IS NOT NULL"), portfolio.past_spread(F.abs(F.col("ret"))))


@query("SELECT series, ts, R(CASE WHEN count(value) OVER f >= 24 THEN quantile_cont(value, 0.75) OVER f END) AS high, R(CASE WHEN count(value) OVER f >= 24 THEN quantile_cont(value, 0.25) OVER f END) AS low FROM panel WINDOW f AS (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING)", 4)
def expanding_quantile(spark, d):
    """Both quartiles of all values so far, by order statistics."""
    return running_quantiles(panels.panel(spark, d).select("series", "ts", "value"), {"high": 0.75, "low": 0.25}, least=24).select("series", "ts", "high", "low")


@query("SELECT series, ts, R(CASE WHEN count(value) OVER f >= 6 THEN quantile_cont(value, 0.9) OVER f END) AS high, R(CASE WHEN count(value) OVER f >= 6 THEN quantile_cont(value, 0.1) OVER f END) AS low FROM gappy WINDOW f AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)", 4)
def rolling_quantile(spark, d):
    """Outer deciles of the last 24 rows, gaps passed over."""
    return running_quantiles(panels.gappy(spark, d).select("series", "ts", "value"), {"high": 0.9, "low": 0.1}, window=24, least=6).select("series", "ts", "high", "low")


@query("SELECT series, ts, R(eq) AS equity, R((pk - eq) / pk) AS drawdown FROM (SELECT *, max(eq) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) AS pk FROM (SELECT series, ts, product(1 + coalesce(ret, 0)) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) AS eq FROM ret))")
def equity_drawdown(spark, d):
    return metrics.curve(panels.returns(spark, d), ["series"]).select("series", "ts", "equity", "drawdown")


@query(_over("value / first_value(value) OVER (PARTITION BY series ORDER BY ts) - 1"))
def rebase_first(spark, d):
    return _x(panels.panel(spark, d), F.col("value") / F.first("value").over(by("series")) - 1)


@query(_over("sum(ret) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING)", "ret"))
def cumulative_sum(spark, d):
    return _x(panels.returns(spark, d), expanding(F.col("ret"), F.sum, by("series")))


@query(f"SELECT series, ts, R(value) AS value FROM (SELECT *, row_number() OVER {W} AS rn FROM panel) WHERE (rn - 1) % 3 = 0", 2)
def stride_sample(spark, d):
    return stride(panels.panel(spark, d), 3, ["series"]).select("series", "ts", "value")


@query("SELECT series, ts, R((value - avg(value) OVER p) / (stddev_samp(value) OVER p + 1e-6)) AS z, R(rank() OVER (PARTITION BY ts ORDER BY value DESC) + (count(*) OVER (PARTITION BY ts, value) - 1) / 2.0) AS rk, R(stddev_samp(value) OVER p / avg(value) OVER p) AS dispersion, R((max(value) OVER p - min(value) OVER p) / avg(value) OVER p) AS spread FROM panel WINDOW p AS (PARTITION BY ts)")
def cross_section(spark, d):
    """z-score, average rank, dispersion and spread across series at each date."""
    from ..functions import rank_average, zscore

    p = Window.partitionBy("ts")
    m = F.avg("value").over(p)
    return panels.panel(spark, d).select("series", "ts", zscore(F.col("value"), "ts").alias("z"), rank_average(F.col("value"), "ts").alias("rk"), (F.stddev_samp("value").over(p) / m).alias("dispersion"), ((F.max("value").over(p) - F.min("value").over(p)) / m).alias("spread"))


@query("""SELECT series, ts, R(CASE WHEN dn = 0 AND up > 0 THEN 100 WHEN dn > 0 THEN 100 - 100 / (1 + up / dn) END) AS rsi FROM (
SELECT series, ts, CASE WHEN count(*) OVER f >= 14 THEN avg(greatest(coalesce(dv, 0), 0)) OVER f END AS up, CASE WHEN count(*) OVER f >= 14 THEN avg(greatest(-coalesce(dv, 0), 0)) OVER f END AS dn FROM (SELECT *, value - lag(value) OVER (PARTITION BY series ORDER BY ts) AS dv FROM daily)
WINDOW f AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))""", 4)
def rsi_14(spark, d):
    return features.rsi(panels.daily(spark, d))


@query(f"""SELECT series, ts, R(r20) AS r20, R(rel_12m) AS rel_12m, CASE WHEN coalesce(value - s20 > 1e-9 * abs(s20), false) THEN 100.0 ELSE 0.0 END AS above_sma20, CASE WHEN coalesce(value - s50 > 1e-9 * abs(s50), false) THEN 100.0 ELSE 0.0 END AS above_sma50, R(CASE WHEN count(r1) OVER w63 >= 63 THEN covar_pop(r1, mean1) OVER w63 / nullif(stddev_pop(r1) OVER w63 * stddev_pop(CASE WHEN r1 IS NOT NULL THEN mean1 END) OVER w63, 0) END) AS corr63, R(r21 - r63) AS accel, R(r126 - r63) AS trend, R((r63 - avg(r63) OVER p) / (v21 + 1e-6)) AS bull, R(stddev_samp(r63) OVER p) AS dispersion, R(max(r63) OVER p - min(r63) OVER p) AS spread,
R((m21 - avg(m21) OVER p) / (stddev_samp(m21) OVER p + 1e-6)) AS zscore, R(r63 / (v63 * sqrt(252) + 1e-6)) AS lead,
R(CASE WHEN count(r63) OVER p = count(*) OVER p THEN rank() OVER (PARTITION BY ts ORDER BY r63 DESC) + (count(r63) OVER (PARTITION BY ts, r63) - 1) / 2.0 END) AS rank FROM (
SELECT *, avg(r1) OVER (PARTITION BY ts) AS mean1, {_min('stddev_samp(r1)', 21, 'r1')} AS v21, {_min('stddev_samp(r1)', 63, 'r1')} AS v63, {_min('avg(r63)', 21, 'r63')} AS m21 FROM (
SELECT *, value / lag(value) OVER w - 1 AS r1, value / lag(value, 20) OVER w - 1 AS r20, value / lag(value, 21) OVER w - 1 AS r21, value / lag(value, 63) OVER w - 1 AS r63, value / lag(value, 126) OVER w - 1 AS r126, value / first_value(value) OVER w - iv / first_value(iv) OVER w AS rel_12m, {_min('avg(value)', 20, 'value')} AS s20, {_min('avg(value)', 50, 'value')} AS s50 FROM (SELECT *, sum(value) OVER (PARTITION BY ts) AS iv FROM daily) WINDOW w AS (PARTITION BY series ORDER BY ts)))
WINDOW p AS (PARTITION BY ts), w63 AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)""", 4)
def sector_features(spark, d):
    """Daily sector features: momentum, breadth, strength and cross-section."""
    px = panels.daily(spark, d)
    f = features.sector_features(px, px.groupBy("ts").agg(F.sum("value").alias("value")))
    return f.select("series", "ts", "r20", "rel_12m", "above_sma20", "above_sma50", "corr63", "accel", "trend", "bull", "dispersion", "spread", "zscore", "lead", "rank")


for _n in (21, 63, 126):

    def _relative(spark, d, n=_n):
        px = panels.daily(spark, d)
        return features.relative_momentum(px, px.groupBy("ts").agg(F.sum("value").alias("value")), n)

    _relative.__name__ = f"relative_momentum_{_n}"
    query(f"""SELECT series, ts, R({_n} * ({_min('avg(x)', _n, 'x')})) AS rel FROM (SELECT s.series, s.ts, s.r - i.r AS x FROM (SELECT *, value / lag(value) OVER {W} - 1 AS r FROM daily) s JOIN (SELECT ts, v / lag(v) OVER (ORDER BY ts) - 1 AS r FROM (SELECT ts, sum(value) AS v FROM daily GROUP BY 1)) i USING (ts))""", 4)(_relative)


@query("SELECT series, ts, R(least(greatest(value, a), b)) AS value FROM gappy JOIN (SELECT series, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM gappy GROUP BY 1) USING (series) WHERE value IS NOT NULL UNION ALL SELECT series, ts, NULL FROM gappy WHERE value IS NULL", 2)
def winsorize(spark, d):
    return features.winsorized(panels.gappy(spark, d))


@query("SELECT series, ts, CAST(coalesce(ret > 0.02, false) AS BIGINT) AS high, CAST(coalesce(ret < -0.02, false) AS BIGINT) AS low, R(CAST(sign(ret) AS DOUBLE)) AS side FROM ret")
def threshold_flags(spark, d):
    return panels.returns(spark, d).select("series", "ts", F.coalesce((F.col("ret") > 0.02).cast("int"), F.lit(0)).alias("high"), F.coalesce((F.col("ret") < -0.02).cast("int"), F.lit(0)).alias("low"), F.signum("ret").alias("side"))


@query("SELECT ts, count(value) AS n FROM gappy GROUP BY 1 HAVING count(value) >= 0.8 * count(*)")
def complete_rows(spark, d):
    """Dates with at least 80 per cent of the series."""
    return panels.gappy(spark, d).groupBy("ts").agg(F.count("value").alias("n"), F.count("*").alias("m")).where("n >= 0.8 * m").drop("m")


@query("SELECT CASE WHEN ts <= DATE '1997-12-31' THEN 'train' WHEN ts <= DATE '1999-12-31' THEN 'val' ELSE 'test' END AS part, count(*) AS n, min(ts) AS first, max(ts) AS last FROM panel GROUP BY 1")
def date_split(spark, d):
    part = F.when(F.col("ts") <= F.lit("1997-12-31").cast("date"), "train").when(F.col("ts") <= F.lit("1999-12-31").cast("date"), "val").otherwise("test")
    return panels.panel(spark, d).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("SELECT series, count(*) AS n, R(avg(ret)) AS mean, R(stddev_samp(ret)) AS sd1, R(stddev_pop(ret)) AS sd0, R(median(ret)) AS med, R(quantile_cont(ret, 0.05)) AS q05, R(skewness(ret)) AS skew, R(kurtosis(ret)) AS kurt, R(product(1 + ret) - 1) AS total, min_by(ts, ret) AS worst, max_by(ts, ret) AS best FROM ret WHERE ret IS NOT NULL GROUP BY 1", 5)
def series_statistics(spark, d):
    from ..functions import kurtosis, skewness

    r = panels.returns(spark, d).where("ret is not null")
    return r.groupBy("series").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd1"), F.stddev_pop("ret").alias("sd0"), F.median("ret").alias("med"), F.percentile("ret", F.lit(0.05)).alias("q05"), skewness(F.col("ret")).alias("skew"), kurtosis(F.col("ret")).alias("kurt"), (F.product(1 + F.col("ret")) - 1).alias("total"), F.min_by("ts", "ret").alias("worst"), F.max_by("ts", "ret").alias("best"))


@query("SELECT a.series AS a, b.series AS b, R(corr(a.ret, b.ret)) AS r FROM ret a JOIN ret b USING (ts) WHERE a.series < b.series GROUP BY 1, 2", 5)
def correlation_matrix(spark, d):
    r = panels.returns(spark, d).select("series", "ts", "ret")
    a, b = r.select(F.col("series").alias("a"), "ts", F.col("ret").alias("x")), r.select(F.col("series").alias("b"), "ts", F.col("ret").alias("y"))
    return a.join(b, "ts").where("a < b").groupBy("a", "b").agg(correlation(F.col("x"), F.col("y")).alias("r"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, R(sum(value)) AS total FROM events GROUP BY 1, 2", 3)
def event_windows(spark, d):
    """Hourly sums, by the plan that also runs on the stream."""
    return windowed(sources.read_table(spark, d, "events"))


@query("SELECT md5('table_' || p_type || '_' || p_brand) AS key, count(*) AS n FROM part GROUP BY 1")
def cache_keys(spark, d):
    p = sources.read_table(spark, d, "part")
    return p.groupBy(sources.cache_key("table", F.col("p_type"), F.col("p_brand")).alias("key")).agg(F.count("*").alias("n"))


@query("SELECT series, grp, ts, R(value) AS value FROM (SELECT *, row_number() OVER (PARTITION BY last_day(ts), grp ORDER BY value DESC, series) AS rn FROM panel) WHERE rn = 1", 2)
def top1_per_group(spark, d):
    from ..functions import latest

    return latest(panels.panel(spark, d), ["grp", "ts"], [F.col("value").desc(), F.col("series")]).select("series", "grp", "ts", "value")


QUERIES, ORACLES = query.queries, query.oracles
