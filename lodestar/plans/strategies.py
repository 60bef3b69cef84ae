"""Screens, regimes, portfolios, metrics and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import by, pct_change
from ..operators import combinations, features, metrics, portfolio, regimes, screening
from . import panels
from .panels import SPLIT, Registry, W

query = Registry()
C = "OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING)"


@query("""SELECT grp, series, n, R(t) AS t, (abs(t) > 0.75 OR (rk = 1 AND NOT any_)) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY abs(t) DESC, series) AS rk, max(CAST(abs(t) > 0.75 AS INT)) OVER (PARTITION BY grp) = 1 AS any_ FROM (
SELECT grp, series, count(value) AS n, CASE WHEN count(value) >= 10 THEN corr(value, y) * sqrt((count(value) - 2) / (1 - corr(value, y) ** 2)) ELSE 0.0 END AS t FROM (SELECT DISTINCT grp, series FROM tgt) LEFT JOIN (SELECT * FROM tgt WHERE value IS NOT NULL AND y IS NOT NULL AND (grp, ts) IN (SELECT (grp, ts) FROM tgt JOIN (SELECT grp, count(DISTINCT series) AS k FROM tgt GROUP BY 1) USING (grp) WHERE value IS NOT NULL AND y IS NOT NULL GROUP BY grp, ts, k HAVING count(DISTINCT series) = k)) USING (grp, series) GROUP BY 1, 2))""", 4)
def tstat_screen(spark, d):
    return screening.screened(panels.target(spark, d))


@query("SELECT series, ts, n, R(CASE WHEN n >= 10 THEN r * sqrt((n - 2) / (1 - r * r)) END) AS t FROM (SELECT series, ts, count(y) OVER f AS n, corr(value, y) OVER f AS r FROM tgt WINDOW f AS (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))", 4)
def tstat_screen_all_folds(spark, d):
    return screening.screened_by_fold(panels.target(spark, d))


@query("SELECT series, ts, R(z * s) AS value FROM (SELECT series, ts, y, (value - avg(value) OVER (PARTITION BY series)) / stddev_pop(value) OVER (PARTITION BY series) AS z FROM tgt) JOIN (SELECT series, covar_pop(z, y) AS s FROM (SELECT series, y, (value - avg(value) OVER (PARTITION BY series)) / stddev_pop(value) OVER (PARTITION BY series) AS z FROM tgt) GROUP BY 1) USING (series)")
def predictive_scale(spark, d):
    return screening.predictive_scale(panels.target(spark, d))


@query(f"SELECT g.series, g.ts, R(CASE WHEN g.value IS NULL THEN 0 ELSE count(t.value) / any_value(n) END) AS pct FROM gappy g JOIN (SELECT series, count(value) AS n FROM gappy WHERE ts <= DATE '{SPLIT}' GROUP BY 1) USING (series) LEFT JOIN (SELECT * FROM gappy WHERE ts <= DATE '{SPLIT}') t ON t.series = g.series AND t.value < g.value GROUP BY g.series, g.ts, g.value")
def percentile_rank_train(spark, d):
    return screening.percentile_of_train(panels.gappy(spark, d), SPLIT)


@query(f"SELECT series, ts, R(f) AS factor, R(f * pct) AS interaction FROM (SELECT series, ts, ret - avg(ret) OVER (PARTITION BY series) AS f, percent_rank() OVER (PARTITION BY series ORDER BY value) AS pct FROM ret)")
def interaction_terms(spark, d):
    from pyspark.sql import Window

    r = panels.returns(spark, d).withColumn("pct", F.percent_rank().over(Window.partitionBy("series").orderBy("value")))
    return screening.interactions(r, "ret").select("series", "ts", "factor", "interaction")


VOL = "CASE WHEN count(ret) OVER f >= 12 THEN stddev_samp(ret) OVER f END"
SUM = "CASE WHEN count(ret) OVER f >= 12 THEN sum(ret) OVER f END"
REG = f"""reg AS (SELECT series, ts, ret, CASE WHEN vol > q3 THEN 'high_vol' WHEN vol < q1 THEN 'low_vol' ELSE 'consolidation' END AS vol_regime, CASE WHEN mom > 0 THEN 'up' WHEN mom < 0 THEN 'down' WHEN mom IS NOT NULL THEN 'consolidation' END AS trend_regime, CASE WHEN vol > cut THEN 'high_vol' WHEN vol <= cut THEN 'low_vol' END AS state FROM (
SELECT series, ts, ret, {VOL} AS vol, {SUM} AS mom FROM ret WINDOW f AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) JOIN (
SELECT series, quantile_cont(vol, 0.25) FILTER (ts <= DATE '{SPLIT}') AS q1, quantile_cont(vol, 0.75) FILTER (ts <= DATE '{SPLIT}') AS q3, median(vol) AS cut FROM (SELECT series, ts, {VOL} AS vol FROM ret WINDOW f AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) GROUP BY 1) USING (series)),
voted AS (SELECT series, ts, ret, vol_regime, trend_regime, state, (SELECT max_by(l, s * 100 - k) FROM (VALUES ('bull', 0), ('bear', 1), ('high_vol', 2), ('low_vol', 3), ('up', 4), ('down', 5), ('consolidation', 6), ('recovery', 7), ('unknown', 8)) o(l, k), LATERAL (SELECT coalesce(CAST(vol_regime = l AS INT), 0) + coalesce(CAST(trend_regime = l AS INT), 0) + 2 * coalesce(CAST(state = l AS INT), 0) AS s)) AS regime FROM reg),
runs AS (SELECT *, row_number() OVER (PARTITION BY series, run ORDER BY ts) AS pos FROM (SELECT *, sum(new) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN regime = lag(regime) OVER (PARTITION BY series ORDER BY ts) THEN 0 ELSE 1 END AS new FROM voted)))
"""
WITH = ", " + REG


def _regimes(spark, d):
    r = regimes.volatility(panels.returns(spark, d), SPLIT)
    return regimes.median_split(regimes.trend(r.select("series", "ts", "ret", "vol_regime"))).drop("vol", "momentum")


@query(WITH + "SELECT series, ts, vol_regime, trend_regime, state FROM reg")
def market_regimes(spark, d):
    """Volatility, trend and median-split labels."""
    return _regimes(spark, d).select("series", "ts", "vol_regime", "trend_regime", "state")


@query(f"SELECT series, ts, R(dd) AS dd, CASE WHEN dd < -0.1 THEN 'bear' ELSE 'consolidation' END AS dd_regime FROM (SELECT series, ts, eq / max(eq) {C} - 1 AS dd FROM (SELECT series, ts, product(1 + coalesce(ret, 0)) {C} AS eq FROM ret))")
def drawdown_regime(spark, d):
    return regimes.drawdown(panels.returns(spark, d)).select("series", "ts", "dd", "dd_regime")


def _voted(spark, d):
    return regimes.vote(_regimes(spark, d), {"vol_regime": 1, "trend_regime": 1, "state": 2})


@query(WITH + "SELECT series, ts, regime FROM voted")
def regime_vote(spark, d):
    return _voted(spark, d).select("series", "ts", "regime")


@query(WITH + ", r2 AS (SELECT series, run, any_value(regime) AS raw, count(*) AS len FROM runs GROUP BY 1, 2), r3 AS (SELECT *, CASE WHEN len >= 3 THEN raw ELSE coalesce(lead(raw) OVER (PARTITION BY series ORDER BY run), lag(raw) OVER (PARTITION BY series ORDER BY run), raw) END AS smooth FROM r2) SELECT series, ts, smooth FROM runs JOIN r3 USING (series, run)")
def regime_smooth(spark, d):
    return regimes.smoothed(_voted(spark, d)).select("series", "ts", "smooth")


@query(WITH + "SELECT series, ts, pos AS persistence, R(pos / max(pos) OVER f) AS strength, CAST(regime = 'high_vol' AS BIGINT) AS is_high_vol, R(CASE WHEN regime = 'high_vol' THEN CASE WHEN count(ret) OVER f >= 12 THEN stddev_samp(ret) OVER f END ELSE 0 END) AS vol_high_vol FROM runs WINDOW f AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
def regime_features(spark, d):
    return regimes.features(_voted(spark, d), "regime", ("high_vol",)).select("series", "ts", "persistence", "strength", "is_high_vol", "vol_high_vol")


@query(WITH + "SELECT series, regime, count(*) AS n, R(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY series)) AS share FROM voted GROUP BY 1, 2")
def regime_share(spark, d):
    return regimes.shares(_voted(spark, d), "regime")


@query(WITH + "SELECT series, max_by(regime, ts) AS regime, max(ts) AS ts FROM voted GROUP BY 1")
def regime_current(spark, d):
    return _voted(spark, d).groupBy("series").agg(F.max_by("regime", "ts").alias("regime"), F.max("ts").alias("ts"))


POS = f"pos AS (SELECT *, CASE WHEN pred > 0 THEN abs(pred) / greatest(max(abs(pred)) {C}, 1e-8) * 1.5 ELSE -abs(pred) / greatest(max(abs(pred)) {C}, 1e-8) * 0.5 END AS pos FROM sig)"


@query(f", {POS} SELECT series, ts, R(pos) AS pos, R(greatest(0, abs(pos) - 1) * 0.06 / 12) AS margin FROM pos", 8)
def asym_positions_margin(spark, d):
    return portfolio.margin(portfolio.positions(panels.signals(spark, d)), 0.06).select("series", "ts", "pos", "margin")


@query(f""", {POS}, o AS (SELECT *, row_number() OVER {W} AS rn FROM pos), w AS (
SELECT series, ts, rn, pos AS p, 1 + ret * pos AS c, greatest(1.0, 1 + ret * pos) AS k FROM (SELECT *, CASE WHEN pos > 1 THEN 1 + (pos - 1) * 1.0 ELSE pos END AS p0 FROM o WHERE rn = 1)
), rec AS (WITH RECURSIVE s AS (SELECT series, ts, rn, CAST(p AS DOUBLE) AS p, CAST(c AS DOUBLE) AS c, CAST(k AS DOUBLE) AS k FROM w UNION ALL
SELECT n.series, n.ts, n.rn, n.p2, s.c * (1 + n.ret * n.p2), greatest(s.k, s.c * (1 + n.ret * n.p2)) FROM s JOIN LATERAL (SELECT o.*, CASE WHEN o.pos > 1 THEN 1 + (o.pos - 1) * (1 - 0.5 * least((s.k - s.c) / s.k / 0.2, 1.0)) ELSE o.pos END AS p2 FROM o WHERE o.series = s.series AND o.rn = s.rn + 1) n ON true) SELECT * FROM s) SELECT series, ts, R(p) AS pos FROM rec""")
def drawdown_delever(spark, d):
    """Positions over 1 cut by the drawdown that they cause themselves."""
    return portfolio.delevered(portfolio.positions(panels.signals(spark, d)), 0.2, 1.5).select("series", "ts", "pos")


@query("SELECT series, ts, R(CASE WHEN abs(pred) / greatest(coalesce(CASE WHEN count(pred) OVER f >= 2 THEN stddev_samp(abs(pred)) OVER f END, first_value(abs(pred)) OVER (PARTITION BY series ORDER BY ts)), 1e-8) < 0.5 THEN 0 ELSE pred END) AS kept_pred FROM sig WINDOW f AS (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def conviction_filter(spark, d):
    return portfolio.conviction(panels.signals(spark, d), 0.5).select("series", "ts", "kept_pred")


COST = f"{POS}, cost AS (SELECT *, pos * ret - greatest(0, abs(pos) - 1) * 0.06 / 12 AS gross, abs(side - coalesce(lag(side) OVER {W}, side)) / 2 AS turnover FROM (SELECT *, CASE WHEN abs(pred) < 0.02 THEN 0 ELSE sign(pred) END AS side FROM pos))"


@query(f", {COST} SELECT series, ts, R(turnover) AS turnover, R(gross) AS gross, R(turnover * 25 / 1e4) AS cost, R(gross - turnover * 25 / 1e4) AS net FROM cost")
def tc_net_returns(spark, d):
    return portfolio.costed(panels.signals(spark, d), portfolio.bps("standard")).select("series", "ts", "turnover", "gross", "cost", "net")


@query(f", {COST} SELECT series, bps, R(product(1 + gross) - 1) AS gross, R(product(1 + gross - turnover * bps / 1e4) - 1) AS net, count(*) FILTER (turnover > 0) AS trades FROM cost, (VALUES (0.0), (5.0), (15.0), (25.0), (50.0)) g(bps) GROUP BY 1, 2")
def tc_scenarios(spark, d):
    """Totals at each cost tier and at none."""
    grid = spark.createDataFrame([(0.0,), *((b,) for b in portfolio.TIERS.values())], "bps double")
    c = portfolio.costed(panels.signals(spark, d), 0.0).crossJoin(F.broadcast(grid))
    return c.groupBy("series", "bps").agg((F.product(1 + F.col("gross")) - 1).alias("gross"), (F.product(1 + F.col("gross") - F.col("turnover") * F.col("bps") / 1e4) - 1).alias("net"), F.count(F.when(F.col("turnover") > 0, 1)).alias("trades"))


@query("SELECT turnover, bps, count(*) AS n, R(product(1 + r - 9 * turnover * bps / 1e4) - 1) AS total, R((product(1 + r - 9 * turnover * bps / 1e4)) ** (12.0 / count(*)) - 1) AS annual FROM (SELECT avg(ret) AS r, row_number() OVER (ORDER BY ts) AS rn FROM ret WHERE ret IS NOT NULL GROUP BY ts), (VALUES (0.1, 0.0), (0.1, 25.0), (0.3, 25.0)) g(turnover, bps) WHERE rn > 24 GROUP BY 1, 2")
def equal_weight_tc_grid(spark, d):
    grid = spark.createDataFrame([(0.1, 0.0), (0.1, 25.0), (0.3, 25.0)], "turnover double, bps double")
    return portfolio.equal_weight(panels.returns(spark, d), grid, 24)


@query("SELECT ts, R(avg(ret)) AS ret, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC, series) AS rn FROM (SELECT *, CASE WHEN count(ret) OVER f >= 6 THEN product(1 + ret) OVER f - 1 END AS score FROM ret WINDOW f AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)) WHERE score IS NOT NULL AND ret IS NOT NULL) WHERE rn <= 3 GROUP BY 1")
def momentum_topn_rotation(spark, d):
    return features.momentum_rotation(panels.returns(spark, d), 6, 3)


@query("SELECT ts, R(avg(ret)) AS ret, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC, series) AS rn FROM (SELECT *, CASE WHEN count(ret) OVER f >= 6 THEN product(1 + ret) OVER f - 1 END AS score FROM ret WINDOW f AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 2 PRECEDING)) WHERE score IS NOT NULL AND ret IS NOT NULL) WHERE rn <= 3 GROUP BY 1")
def momentum_topn_delayed(spark, d):
    """The rotation with a row between signal and holding."""
    return features.momentum_rotation(panels.returns(spark, d), 6, 3, delay=1)


@query("SELECT a || ',' || b || ',' || c AS combo, R(avg(r) * 12) AS mean, R(stddev_samp(r) * sqrt(12)) AS vol FROM (SELECT a.series AS a, b.series AS b, c.series AS c, (a.ret + b.ret + c.ret) / 3 AS r FROM ret a JOIN ret b USING (ts) JOIN ret c USING (ts) WHERE a.grp = 'priority' AND b.grp = 'priority' AND c.grp = 'priority' AND a.series < b.series AND b.series < c.series) WHERE r IS NOT NULL GROUP BY a, b, c")
def sector_combos(spark, d):
    """Every three of five series, equally weighted."""
    r = panels.returns(spark, d).where("grp = 'priority' and ret is not null")
    one = lambda s, x: r.select("ts", F.col("series").alias(s), F.col("ret").alias(x))
    j = one("a", "x").join(one("b", "y"), "ts").where("a < b").join(one("c", "z"), "ts").where("b < c")
    j = j.withColumn("r", (F.col("x") + F.col("y") + F.col("z")) / 3)
    return j.groupBy(F.concat_ws(",", "a", "b", "c").alias("combo")).agg((F.avg("r") * 12).alias("mean"), (F.stddev_samp("r") * F.sqrt(F.lit(12.0))).alias("vol"))


_FOUR = "c AS (SELECT a.ts, a.series || ',' || b.series || ',' || c.series || ',' || e.series AS combo, (a.ret + b.ret + c.ret + e.ret) / 4 AS r FROM ret a JOIN ret b USING (ts) JOIN ret c USING (ts) JOIN ret e USING (ts) WHERE a.series < b.series AND b.series < c.series AND c.series < e.series), ix AS (SELECT ts, (price / lag(price) OVER (ORDER BY ts) - 1) / 10 AS bench FROM price), eq AS (SELECT combo, ts, r, bench, product(1 + r) OVER (PARTITION BY combo ORDER BY ts ROWS UNBOUNDED PRECEDING) AS eq FROM c JOIN ix USING (ts) WHERE r IS NOT NULL AND bench IS NOT NULL), dd AS (SELECT *, max(eq) OVER (PARTITION BY combo ORDER BY ts ROWS UNBOUNDED PRECEDING) AS pk FROM eq)"


@query(f", {_FOUR} SELECT combo, n, R(total) AS total, R(annual) AS annual, R(vol) AS vol, R(sharpe) AS sharpe, R(max_dd) AS max_dd, R(hit) AS hit, R(bench_annual) AS bench_annual, R(total - bench_total) AS excess, R((total - bench_total) / vol) AS info, R(annual / max_dd) AS calmar FROM (SELECT combo, count(*) AS n, product(1 + r) - 1 AS total, product(1 + r) ** (12.0 / count(*)) - 1 AS annual, stddev_samp(r) * sqrt(12) AS vol, avg(r) / stddev_samp(r) * sqrt(12) AS sharpe, max((pk - eq) / pk) AS max_dd, avg(CAST(r > 0 AS DOUBLE)) AS hit, product(1 + bench) - 1 AS bench_total, product(1 + bench) ** (12.0 / count(*)) - 1 AS bench_annual FROM dd GROUP BY 1)", 4)
def combination_report(spark, d):
    """Every four of the series, against the index: risk, excess and information ratio."""
    index = panels.price(spark, d).select("ts", (pct_change(F.col("price"), by("series")) / 10).alias("ret"))
    return combinations.combination_report(panels.returns(spark, d), index, 4)


_SIGNAL = "(SELECT ts, series, pred, ret, row_number() OVER (PARTITION BY ts ORDER BY pred DESC, series) AS best, row_number() OVER (PARTITION BY ts ORDER BY pred, series DESC) AS worst FROM sig)"


@query(f"SELECT strategy, count(*) AS n, R(sum(ret)) AS total, R(avg(ret) / stddev_samp(ret) * sqrt(12)) AS sharpe FROM (SELECT ts, unnest(['top', 'weighted', 'long_short']) AS strategy, unnest([a, w, (a - z) / 2]) AS ret FROM (SELECT ts, avg(ret) FILTER (best <= 3) AS a, avg(ret) FILTER (worst <= 3) AS z, coalesce(sum(greatest(pred, 0) * ret) / nullif(sum(greatest(pred, 0)), 0), 0) AS w FROM {_SIGNAL} GROUP BY 1)) GROUP BY 1", 5)
def signal_portfolios(spark, d):
    """The best three by signal, all long ones by its size, and the best against the worst."""
    r = combinations.by_signal(panels.signals(spark, d), 3)
    return r.groupBy("strategy").agg(F.count("*").alias("n"), F.sum("ret").alias("total"), (F.avg("ret") / F.stddev_samp("ret") * F.sqrt(F.lit(12.0))).alias("sharpe"))


@query("""SELECT series, count(*) AS n, R(product(1 + ret) - 1) AS total, R(product(1 + ret) ** (12.0 / count(*)) - 1) AS annual, R(avg(ret) / stddev_samp(ret) * sqrt(12)) AS sharpe, R(avg(ret) / stddev_samp(ret) FILTER (ret < 0) * sqrt(12)) AS sortino, R(max((pk - eq) / pk)) AS max_dd, R(avg(ret) * 12 / max((pk - eq) / pk)) AS calmar_arith, R((product(1 + ret) ** (12.0 / count(*)) - 1) / max((pk - eq) / pk)) AS calmar_geo, R(skewness(ret)) AS skew, R(kurtosis(ret)) AS kurt, R(abs(quantile_cont(ret, 0.95) / quantile_cont(ret, 0.05))) AS tail FROM (
SELECT *, max(eq) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) AS pk FROM (SELECT series, ts, ret, product(1 + ret) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) AS eq FROM ret WHERE ret IS NOT NULL)) GROUP BY 1""", 4)
def metrics_full(spark, d):
    return metrics.risk(panels.returns(spark, d), ["series"]).select("series", "n", "total", "annual", "sharpe", "sortino", "max_dd", "calmar_arith", "calmar_geo", "skew", "kurt", "tail")


@query("SELECT series, count(*) AS n, R(1 - sum((actual - pred) ** 2) / sum((actual - bench) ** 2)) AS r2, R(avg((actual - pred) ** 2)) AS mse, R(avg(abs(actual - pred))) AS mae, R(avg(CAST(sign(actual) = sign(pred) AS DOUBLE))) AS hit, count(*) FILTER (pred > 0) AS n_pos, R(coalesce(avg(CAST(sign(actual) = sign(pred) AS DOUBLE)) FILTER (pred > 0), 0)) AS pos_hit, R(coalesce(avg(CAST(sign(actual) = sign(pred) AS DOUBLE)) FILTER (pred < 0), 0)) AS neg_hit FROM sig WHERE bench IS NOT NULL GROUP BY 1")
def forecast_accuracy(spark, d):
    return metrics.accuracy(panels.signals(spark, d), ["series"]).select("series", "n", "r2", "mse", "mae", "hit", "n_pos", "pos_hit", "neg_hit")


@query("SELECT series, R(avg(abs((actual - pred) / nullif(actual, 0)))) AS mape FROM sig WHERE bench IS NOT NULL GROUP BY 1", 4)
def forecast_mape(spark, d):
    """Mean error relative to actual, rows with none left out."""
    return metrics.accuracy(panels.signals(spark, d), ["series"]).select("series", "mape")


@query("""SELECT series, max_by(since, dd * 1e12 - rn) AS dd_rows FROM (SELECT series, rn, (pk - eq) / pk AS dd, rn - max(CASE WHEN eq = pk THEN rn END) OVER (PARTITION BY series ORDER BY rn ROWS UNBOUNDED PRECEDING) + 1 AS since FROM (
SELECT *, max(eq) OVER (PARTITION BY series ORDER BY rn ROWS UNBOUNDED PRECEDING) AS pk FROM (SELECT series, row_number() OVER (PARTITION BY series ORDER BY ts) AS rn, product(1 + ret) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) AS eq FROM ret WHERE ret IS NOT NULL))) GROUP BY 1""")
def drawdown_rows(spark, d):
    """Rows from the peak to the deepest drawdown, both counted."""
    return metrics.risk(panels.returns(spark, d), ["series"]).select("series", "dd_rows")


@query("SELECT series, count(d) AS n, R(avg(d) / sqrt(var_samp(d) / count(d))) AS dm FROM (SELECT series, (actual - bench) ** 2 - (actual - pred) ** 2 AS d FROM sig) GROUP BY 1", 4)
def dm_stat(spark, d):
    return metrics.diebold_mariano(panels.signals(spark, d), ["series"]).select("series", "n", "dm")


@query("SELECT series, count(f) AS n, R(avg(f) / (stddev_pop(f) / sqrt(count(f)))) AS cw FROM (SELECT series, (actual - m) ** 2 - (actual - pred) ** 2 + (m - pred) ** 2 AS f FROM (SELECT *, avg(actual) OVER (PARTITION BY series) AS m FROM sig)) GROUP BY 1", 4)
def cw_stat(spark, d):
    return metrics.clark_west(panels.signals(spark, d), ["series"]).select("series", "n", "cw")


@query("SELECT series, count(x) AS n, R(avg(x) / (stddev_samp(x) / sqrt(count(x)))) AS t FROM (SELECT series, sign(pred) * actual AS x FROM sig) GROUP BY 1", 4)
def t_test_pnl(spark, d):
    return metrics.t_test(panels.signals(spark, d).withColumn("x", F.signum("pred") * F.col("actual")), ["series"], "x").select("series", "n", "t")


@query(f"SELECT series, ts, R(avg(ret) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS bench FROM ret")
def benchmark_expanding_mean(spark, d):
    from ..functions import by, expanding

    return panels.returns(spark, d).select("series", "ts", expanding(F.col("ret"), F.avg, by("series"), 1, 1).alias("bench"))


@query(f"SELECT combo, R(max(CASE WHEN series = '1-URGENT' THEN s END)) AS urgent, R(max(CASE WHEN series = '5-LOW' THEN s END)) AS low FROM (SELECT series, combo, avg(p * ret) / stddev_samp(p * ret) * sqrt(12) AS s FROM (SELECT series, ret, l || '/' || s AS combo, CASE WHEN pred > 0 THEN st * l ELSE -st * s END AS p FROM (SELECT *, abs(pred) / greatest(max(abs(pred)) {C}, 1e-8) AS st FROM sig), (VALUES (1.0, 1.0), (1.5, 0.5), (2.5, 0.25)) g(l, s)) GROUP BY 1, 2) GROUP BY 1".replace("l || '/' || s AS combo", "CAST(CAST(l AS DOUBLE) AS VARCHAR) || '/' || CAST(CAST(s AS DOUBLE) AS VARCHAR) AS combo"), 4)
def leverage_crosstab(spark, d):
    """Sharpe by leverage and series: the signal once, each leverage on top of it."""
    combos = F.array(*[F.struct(F.lit(f"{a}/{b}").alias("combo"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1.0, 1.0), (1.5, 0.5), (2.5, 0.25))])
    out = portfolio.positions(panels.signals(spark, d), 1.0, 1.0).withColumn("c", F.explode(combos)).withColumn("combo", F.col("c.combo"))
    size = F.when(F.col("pos") > 0, F.col("c.a")).otherwise(F.col("c.b"))
    s = out.withColumn("x", F.col("pos") * size * F.col("ret")).groupBy("combo", "series").agg((F.avg("x") / F.stddev_samp("x") * F.sqrt(F.lit(12.0))).alias("s"))
    return s.groupBy("combo").pivot("series", ["1-URGENT", "5-LOW"]).agg(F.first("s")).toDF("combo", "urgent", "low")


QUERIES, ORACLES = query.queries, query.oracles
