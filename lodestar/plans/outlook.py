"""One-factor forecasts and what is made of them, folds, labels and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources
from ..functions import by, forward_return
from ..operators import outlook
from . import panels
from .panels import Registry, W

query = Registry()


def _lin(frame: str) -> str:
    f = f"(PARTITION BY series ORDER BY ts ROWS BETWEEN {frame})"
    return f"lin AS (SELECT * FROM (SELECT series, ts, y AS actual, regr_avgy(y, value) OVER f + coalesce(regr_slope(y, value) OVER f, 0) * (value - regr_avgx(y, value) OVER f) AS pred, regr_avgy(y, value) OVER f AS bench, regr_count(y, value) OVER f AS n_train FROM tgt WINDOW f AS {f}) WHERE n_train >= 36 AND pred IS NOT NULL AND actual IS NOT NULL)"


LIN = _lin("UNBOUNDED PRECEDING AND 1 PRECEDING")


def _fit(spark, d):
    return outlook.line_forecasts(panels.target(spark, d))


@query(f", {LIN} SELECT series, ts, R(pred) AS pred, R(actual) AS actual, R(bench) AS bench, n_train FROM lin")
def walk_forward_line(spark, d):
    """Expanding refits of one factor, all folds of all series in one window."""
    return _fit(spark, d)


@query(f", {_lin('50 PRECEDING AND 3 PRECEDING')} SELECT series, ts, R(greatest(pred, 0)) AS pred, R(bench) AS bench, n_train FROM lin")
def walk_forward_line_rolling(spark, d):
    """A window of 48 rows, an embargo of two, and a floor of zero."""
    r = outlook.line_forecasts(panels.target(spark, d), window=48, embargo=2)
    return r.select("series", "ts", F.greatest("pred", F.lit(0.0)).alias("pred"), "bench", "n_train")


@query("SELECT series, max(ts) AS ts, regr_count(y, value) AS n, R(regr_avgy(y, value) + coalesce(regr_slope(y, value), 0) * (max_by(value, ts) - regr_avgx(y, value))) AS pred FROM tgt GROUP BY 1")
def predict_next(spark, d):
    return outlook.predict_next(panels.target(spark, d))


COMBOS = ((1.0, 1.0), (1.5, 0.5), (1.75, 0.25), (2.5, 0.25), (3.0, 0.25))


@query(f", {LIN}, x AS (SELECT series, a AS max_long, b AS max_short, actual * CASE WHEN pred > 0 THEN s * a ELSE -s * b END AS x FROM (SELECT *, abs(pred) / greatest(max(abs(pred)) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING), 1e-8) AS s FROM lin), (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE)' for a, b in COMBOS)}) g(a, b)) SELECT series, max_long, max_short, count(*) AS n, R(product(1 + x) - 1) AS total, R(avg(x) / stddev_samp(x) * sqrt(12)) AS sharpe FROM x GROUP BY 1, 2, 3", 5)
def leverage_sweep(spark, d):
    """Fitted forecasts under five combinations of leverage."""
    return outlook.leverage_sweep(_fit(spark, d), COMBOS)


@query(f"SELECT series, n, R(total) AS total, R(vol) AS vol, R(annual) AS annual, R(CASE WHEN vol > 0 THEN annual / vol ELSE 0 END) AS sharpe FROM (SELECT *, (1 + total) ** (12.0 / (n * 3)) - 1 AS annual FROM (SELECT series, count(*) AS n, product(1 + r) - 1 AS total, stddev_samp(r) * 2 AS vol FROM (SELECT *, row_number() OVER {W} AS rn FROM (SELECT series, ts, lead(value, 3) OVER {W} / value - 1 AS r FROM panel) WHERE r IS NOT NULL) WHERE (rn - 1) % 3 = 0 GROUP BY 1))", 5)
def buy_and_hold(spark, d):
    """Quarterly returns that do not overlap."""
    p = panels.panel(spark, d)
    return outlook.buy_and_hold(p.select("series", "ts", forward_return(F.col("value"), by("series"), 3).alias("ret")), 3)


@query(f", {LIN} SELECT series, count(*) AS n, R(count(*) / 3.0) AS n_eff FROM lin GROUP BY 1")
def effective_n(spark, d):
    return _fit(spark, d).groupBy("series").agg(F.count("*").alias("n")).withColumn("n_eff", outlook.effective_n(F.col("n"), 1, 3))


@query(f", {LIN} SELECT series, ts, R(pred * 20) AS pred, R(actual * 10) AS actual FROM lin", 5)
def amplified(spark, d):
    return outlook.amplified(_fit(spark, d)).select("series", "ts", "pred", "actual")


@query(f", {LIN} SELECT series, ts, R(pred * (1 - 0.15 * 25 / 1e4)) AS pred FROM lin")
def cost_scaled_prediction(spark, d):
    return outlook.cost_scaled(_fit(spark, d), 25.0).select("series", "ts", "pred")


@query("SELECT series, ts, R(score) AS score, R(CASE WHEN score < 0.5 THEN 0 ELSE pred END) AS pred FROM (SELECT *, least(1, abs(pred) / stddev_samp(pred) OVER (PARTITION BY series)) AS score FROM sig)", 5)
def high_conviction(spark, d):
    return outlook.high_conviction(panels.signals(spark, d)).select("series", "ts", "score", "pred")


@query("SELECT series, ts, R((value - avg(value) OVER g) / stddev_samp(value) OVER g * regr_slope(z, y) OVER g / nullif(stddev_pop(z) OVER g / stddev_pop(CASE WHEN value IS NOT NULL THEN y END) OVER g, 0)) AS value FROM (SELECT *, CASE WHEN y IS NOT NULL THEN value END AS z FROM tgt) WINDOW g AS (PARTITION BY series)", 5)
def factor_returns(spark, d):
    return outlook.factor_returns(panels.target(spark, d))


@query("SELECT series, kind, R(weight) AS weight, row_number() OVER (PARTITION BY kind ORDER BY weight DESC, series) AS place FROM (SELECT series, CASE WHEN contains(series, 'PROMO') THEN 'promoted' WHEN contains(series, '-') THEN 'priority' ELSE 'original' END AS kind, abs(corr(value, y) * stddev_pop(y)) AS weight FROM tgt WHERE value IS NOT NULL GROUP BY 1)")
def feature_importance(spark, d):
    return outlook.importance(panels.target(spark, d), (("PROMO", "promoted"), ("-", "priority")))


@query(f"SELECT series, fold, CASE WHEN rn <= m - (4 - fold) * 12 THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(ts) AS first, max(ts) AS last, R(avg(value)) AS mean FROM (SELECT *, row_number() OVER {W} AS rn, count(*) OVER (PARTITION BY series) AS m FROM panel), (VALUES (0::BIGINT), (1), (2), (3)) f(fold) WHERE m - (4 - fold) * 12 >= 36 AND rn <= m - (3 - fold) * 12 GROUP BY 1, 2, 3", 4)
def time_splits(spark, d):
    return outlook.time_splits(panels.panel(spark, d), 4, least=36)


@query("SELECT series, state, R(mean) AS mean, R(sd) AS sd, CASE WHEN rk = 1 THEN 'bull' WHEN rk = k THEN 'bear' WHEN sd > (max(CASE WHEN rk = 1 THEN sd END) OVER (PARTITION BY series) + max(CASE WHEN rk = k THEN sd END) OVER (PARTITION BY series)) / 2 THEN 'bear' ELSE 'bull' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY mean DESC, state) AS rk, count(*) OVER (PARTITION BY series) AS k FROM (SELECT series, month(ts) % 4 AS state, avg(ret) AS mean, stddev_pop(ret) AS sd FROM ret WHERE ret IS NOT NULL GROUP BY 1, 2))")
def state_names(spark, d):
    """Four states, dealt by month."""
    r = panels.returns(spark, d).where("ret is not null").withColumn("state", F.pmod(F.month("ts"), F.lit(4)))
    return outlook.state_names(r)


@query("SELECT series, ts, R(v) AS value, CAST(coalesce(CASE WHEN count(v) OVER f >= 24 THEN v > quantile_cont(v, 0.75) OVER f END, false) AS BIGINT) AS high, CAST(coalesce(CASE WHEN count(v) OVER f >= 24 THEN v < quantile_cont(v, 0.25) OVER f END, false) AS BIGINT) AS low FROM (SELECT series, ts, coalesce(CASE WHEN (month(ts) * 5 + length(series) + year(ts)) % 7 >= 2 THEN value / 1e6 END, CASE WHEN count(ret) OVER w >= 6 THEN stddev_samp(ret) OVER w * sqrt(12) * 100 END) AS v FROM ret WINDOW w AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) WINDOW f AS (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING)", 4)
def proxy_filled(spark, d):
    """Gaps filled with volatility, and flags by expanding quartiles."""
    hole = F.pmod(F.month("ts") * 5 + F.length("series") + F.year("ts"), F.lit(7)) < 2
    r = panels.returns(spark, d).withColumn("value", F.when(~hole, F.col("value") / 1e6))
    return outlook.proxy_filled(r.select("series", "ts", "value", "ret")).select("series", "ts", "value", "high", "low")


@query("SELECT series, ts, R(value - (SELECT max_by(price, ts) FROM price)) AS x FROM panel", 2)
def minus_last_price(spark, d):
    return outlook.minus_last(panels.panel(spark, d), panels.price(spark, d)).select("series", "ts", "x")


@query("SELECT make_date(CAST(floor(x) AS INT), least(greatest(CAST(round((x - floor(x)) * 100) AS INT), 1), 12), 1) AS ts, count(*) AS n FROM (SELECT year(o_orderdate) + (month(o_orderdate) + day(o_orderdate) % 3 - 1) / 100.0::DOUBLE AS x FROM orders) GROUP BY 1")
def decimal_months(spark, d):
    """Months as hundredths of a year number, some below 1 and over 12."""
    o = sources.read_table(spark, d, "orders")
    x = F.year("o_orderdate") + (F.month("o_orderdate") + F.pmod(F.dayofmonth("o_orderdate"), F.lit(3)) - 1) / F.lit(100.0)
    return o.groupBy(outlook.decimal_month(x).alias("ts")).agg(F.count("*").alias("n"))


@query("SELECT months, count(*) AS n, R(12 * avg(x)) AS annual, R(avg(x) / stddev_samp(x) * sqrt(12)) AS sharpe, R(100.0 * avg(CAST(x > 0 AS INT))) AS hit FROM (" + " UNION ALL ".join(f"SELECT {k}::BIGINT AS months, ret * sign(p - 1) AS x FROM (SELECT ret, CASE WHEN count(ret) OVER w >= {k} THEN product(1 + ret) OVER w END AS p FROM ret WINDOW w AS (PARTITION BY series ORDER BY ts ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)) WHERE p IS NOT NULL AND ret IS NOT NULL" for k in (3, 6, 12)) + ") GROUP BY 1", 4)
def lookback_momentum(spark, d):
    return outlook.lookback_momentum(panels.returns(spark, d), (3, 6, 12))


@query("SELECT series, count(value) AS n, count(value) >= least(10, count(*)) AS usable FROM gappy GROUP BY 1 HAVING count(value) > 50")
def enough_rows(spark, d):
    return outlook.enough(panels.gappy(spark, d), 50)


@query("SELECT series, ts, R(value) AS value, R(ret) AS y FROM ret WHERE ret IS NOT NULL", 4)
def contemporaneous_align(spark, d):
    """Features of a month with the return of the same month."""
    return panels.returns(spark, d).where("ret is not null").select("series", "ts", "value", F.col("ret").alias("y"))


@query("SELECT series, count(value) AS n, min(ts) AS first, max(ts) AS last, R(100.0 * count(value) / count(*)) AS share FROM gappy GROUP BY 1")
def period_coverage(spark, d):
    return panels.gappy(spark, d).groupBy("series").agg(F.count("value").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), (100.0 * F.count("value") / F.count("*")).alias("share"))


@query("SELECT DISTINCT CAST(l_shipdate AS DATE) AS vintage FROM lineitem WHERE year(l_shipdate) = 1997")
def vintage_list(spark, d):
    """The vintages of a year."""
    li = sources.read_table(spark, d, "lineitem").where(F.year("l_shipdate") == 1997)
    return li.select(F.to_date("l_shipdate").alias("vintage")).distinct()


QUERIES, ORACLES = query.queries, query.oracles
