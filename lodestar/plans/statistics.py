"""Tests, intervals and reports of forecasts, derived series and baselines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import features, metrics, portfolio, screening
from . import panels
from .panels import SPLIT, Registry, W
from .models import BOOT
from .strategies import COST

query = Registry()

#: The distribution functions of the oracles, by Gamma functions: the operators sum recurrences instead.
PHI = "(0.5 + exp(-{0} * {0} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda k: {0} ** (2 * k + 1) / exp(lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1)))))"
STUDENT = """(0.5 + CASE WHEN {1} % 2 = 0 THEN sin(atan({0} / sqrt({1}))) * list_sum(list_transform(range(0, {1} // 2), lambda k: exp(lgamma(2 * k + 1) - 2 * k * ln(2) - 2 * lgamma(k + 1)) * ({1} / ({1} + {0} * {0})) ** k))
ELSE 2 / pi() * (atan({0} / sqrt({1})) + sin(atan({0} / sqrt({1}))) * cos(atan({0} / sqrt({1}))) * list_sum(list_transform(range(0, ({1} - 1) // 2), lambda k: exp(2 * k * ln(2) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * ({1} / ({1} + {0} * {0})) ** k))) END / 2)"""


def _sig(spark, d):
    return panels.signals(spark, d)


@query(f"SELECT series, R(2 * (1 - {PHI.format('least(abs(dm), 8)')})) AS dm_p, R(1 - {STUDENT.format('cw', 'df')}) AS cw_p, R(2 * (1 - {STUDENT.format('abs(t)', 'dt')})) AS t_p FROM (SELECT series, avg(d) / sqrt(var_samp(d) / count(d)) AS dm, avg(f) / (stddev_pop(f) / sqrt(count(f))) AS cw, count(f) - 1 AS df, avg(x) / (stddev_samp(x) / sqrt(count(x))) AS t, count(x) - 1 AS dt FROM (SELECT series, (actual - bench) ** 2 - (actual - pred) ** 2 AS d, (actual - m) ** 2 - (actual - pred) ** 2 + (m - pred) ** 2 AS f, sign(pred) * actual AS x FROM (SELECT *, avg(actual) OVER (PARTITION BY series) AS m FROM sig)) GROUP BY 1)")
def p_values(spark, d):
    """p values of the Diebold-Mariano, Clark-West and mean tests."""
    return metrics.p_values(_sig(spark, d), ["series"])


R2 = "(SELECT series, count(*) AS n, 1 - sum((actual - pred) ** 2) / sum((actual - bench) ** 2) AS r2 FROM sig WHERE bench IS NOT NULL GROUP BY 1)"


@query(f"SELECT series, n, R(r2) AS r2, R(r2 - 1.959963984540054 * se) AS low, R(least(r2 + 1.959963984540054 * se, 1)) AS high FROM (SELECT *, CASE WHEN r2 >= 1 THEN 0 WHEN r2 <= -10 THEN 2 * abs(r2) / sqrt(n) ELSE 2 * abs(1 - r2) / sqrt(n) END AS se FROM {R2})")
def r2_interval(spark, d):
    return metrics.r2_interval(_sig(spark, d), ["series"])


@query(f"SELECT series, n, R(r2) AS r2, R(1 - (1 - r2) * (n - 1) / (n - 2)) AS r2_adj FROM (SELECT series, count(*) AS n, 1 - sum((actual - pred) ** 2) / (count(*) * var_pop(actual)) AS r2 FROM sig GROUP BY 1)")
def adjusted_r2(spark, d):
    return metrics.adjusted_r2(_sig(spark, d), ["series"])


@query(f"SELECT series, n, R(dm) AS dm, R(2 * (1 - {PHI.format('least(abs(dm), 8)')})) AS p FROM (SELECT series, count(d) AS n, avg(d) / (stddev_pop(d) / sqrt(count(d) + 1 - 6 + 4)) AS dm FROM (SELECT series, (actual - bench) ** 2 - (actual - pred) ** 2 AS d FROM sig) GROUP BY 1)", 5)
def dm_yield(spark, d):
    """With a horizon of three rows."""
    return metrics.dm_yield(_sig(spark, d), ["series"], 3)


TRADE = "(SELECT series, count(*) AS n, 100.0 * avg(CAST(sign(pred) = sign(actual) AS INT)) AS hit, count(*) FILTER (pred > 0) AS n_pos, count(*) FILTER (pred < 0) AS n_neg, 100.0 * coalesce(avg(CAST(actual > 0 AS INT)) FILTER (pred > 0), 0) AS pos_hit, 100.0 * coalesce(avg(CAST(actual < 0 AS INT)) FILTER (pred < 0), 0) AS neg_hit, sum(sign(pred) * actual) AS total, 12 * avg(sign(pred) * actual) AS annual, sqrt(12) * stddev_pop(sign(pred) * actual) AS vol, sqrt(12) * avg(sign(pred) * actual) / stddev_pop(sign(pred) * actual) AS sharpe, 1 - sum((actual - pred) ** 2) / (count(*) * var_pop(actual)) AS r2 FROM sig GROUP BY 1)"


@query(f"SELECT series, n, R(hit) AS hit, n_pos, n_neg, R(pos_hit) AS pos_hit, R(neg_hit) AS neg_hit, R(total) AS total, R(annual) AS annual, R(vol) AS vol, R(sharpe) AS sharpe, R(r2) AS r2 FROM {TRADE}")
def trading_metrics(spark, d):
    return metrics.trading(_sig(spark, d), ["series"])


_PNL = "SELECT series, ts, sign(pred) * actual AS ret FROM sig"


@query(f"""SELECT series, CASE WHEN hit > 50 AND sharpe > 0 AND low > 0 THEN 'passes' WHEN hit > 50 AND sharpe > 0 THEN 'marginal' WHEN sharpe < 0 THEN 'fails' ELSE 'inconclusive' END AS verdict, CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.1 THEN '*' ELSE '' END AS marks
FROM {TRADE} JOIN {BOOT.replace('{source}', f'({_PNL})')} USING (series) JOIN (SELECT series, 2 * (1 - {STUDENT.format('abs(t)', 'dt')}) AS p FROM (SELECT series, avg(x) / (stddev_samp(x) / sqrt(count(x))) AS t, count(x) - 1 AS dt FROM (SELECT series, sign(pred) * actual AS x FROM sig) GROUP BY 1)) USING (series)""")
def verdicts(spark, d):
    """Verdicts by the lower end of the resampled Sharpe ratio, and marks by the p value of the mean return."""
    s = _sig(spark, d)
    pnl = s.select("series", "ts", (F.signum("pred") * F.col("actual")).alias("ret"))
    t = metrics.trading(s, ["series"]).select("series", "hit", "sharpe").join(metrics.bootstrap(pnl, ["series"], "ret", 1000).select("series", "low"), "series")
    t = t.join(metrics.t_test(pnl, ["series"], "ret").select("series", "p"), "series")
    return t.select("series", metrics.verdict("hit", "sharpe", "low").alias("verdict"), metrics.stars("p").alias("marks"))


@query(f"SELECT series, ts, R(list_reduce(list_prepend(0::DOUBLE, CAST(range(0, 30) AS DOUBLE[])), lambda z, j: z - ({PHI.format('z')} - p) / (exp(-z * z / 2) / sqrt(2 * pi())))) AS score FROM (SELECT series, ts, (row_number() OVER (PARTITION BY series ORDER BY ret, ts) - 0.5) / count(*) OVER (PARTITION BY series) AS p FROM ret WHERE ret IS NOT NULL)", 6)
def normal_scores(spark, d):
    """Each return as the normal quantile of its rank."""
    w = Window.partitionBy("series")
    r = panels.returns(spark, d).where("ret IS NOT NULL")
    p = (F.row_number().over(w.orderBy("ret", "ts")) - 0.5) / F.count("*").over(w)
    return r.select("series", "ts", p.alias("p")).select("series", "ts", metrics.normal_ppf("p").alias("score"))


_PDF = "exp(lgamma((dt + 1) / 2.0) - lgamma(dt / 2.0)) / sqrt(dt * pi()) * (1 + z * z / dt) ** (-(dt + 1) / 2.0)"


@query(f"SELECT series, R(m - q * e) AS low, R(m + q * e) AS high FROM (SELECT *, list_reduce(list_prepend(0::DOUBLE, CAST(range(0, 40) AS DOUBLE[])), lambda z, j: z - ({STUDENT.format('z', 'dt')} - 0.95) / ({_PDF})) AS q FROM (SELECT series, avg(ret) AS m, stddev_samp(ret) / sqrt(count(ret)) AS e, count(ret) - 1 AS dt FROM ret GROUP BY 1))", 6)
def mean_interval(spark, d):
    """The interval of 90 per cent of each series' mean return, by Student's quantile."""
    s = panels.returns(spark, d).groupBy("series").agg(F.avg("ret").alias("m"), (F.stddev_samp("ret") / F.sqrt(F.count("ret"))).alias("e"), (F.count("ret") - 1).alias("dt"))
    q = metrics.student_ppf("0.95D", "dt")
    return s.select("series", (F.col("m") - q * F.col("e")).alias("low"), (F.col("m") + q * F.col("e")).alias("high"))


@query(f", {COST} SELECT series, count(*) AS n, R(avg(gross) / stddev_samp(gross) * sqrt(12)) AS sharpe_gross, R(avg(net) / stddev_samp(net) * sqrt(12)) AS sharpe_net, R(product(1 + gross) - 1) AS total_gross, R(product(1 + net) - 1) AS total_net, R(avg(turnover)) AS avg_turnover, R(sum(turnover)) AS total_turnover, R(sum(c)) AS total_cost, count(*) FILTER (turnover > 0) AS trades, R(coalesce(avg(c) FILTER (turnover > 0) * 1e4, 0)) AS bps_a_trade, R(product(1 + gross) - product(1 + net)) AS drag FROM (SELECT *, turnover * 25 / 1e4 AS c, gross - turnover * 25 / 1e4 AS net FROM cost) GROUP BY 1", 5)
def cost_report(spark, d):
    return portfolio.cost_report(portfolio.costed(_sig(spark, d), 25.0), ["series"])


@query(f", {COST} SELECT series, ts, R(pred - turnover * 25 / 1e4 * sign(pred)) AS adjusted FROM cost")
def cost_adjusted_prediction(spark, d):
    return portfolio.cost_adjusted(_sig(spark, d), 25.0).select("series", "ts", "adjusted")


@query("SELECT series, ts, R(pred / max(abs(pred)) OVER (PARTITION BY series) * ret) AS gross FROM sig")
def symmetric_positions(spark, d):
    """Long and short of one size against the strongest signal of all, without financing."""
    return portfolio.symmetric(_sig(spark, d)).select("series", "ts", "gross")


@query(f"SELECT series, ts, R(naive) AS naive, R(hist_mean) AS hist_mean, R(momentum) AS momentum FROM (SELECT series, ts, 0.0 AS naive, avg(actual) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hist_mean, sign(lag(actual) OVER {W}) AS momentum FROM sig)")
def baseline_forecasts(spark, d):
    return screening.baselines(_sig(spark, d)).select("series", "ts", F.col("naive"), "hist_mean", F.col("momentum"))


@query("SELECT series, R(100.0 * avg(CAST(actual > 0 AS INT))) AS long_hit, R(100.0 * avg(CAST(sign(actual) = side AS INT))) AS random_hit, R(sum(actual * side)) AS random_sum FROM (SELECT series, actual, CASE WHEN ((x2 * x2 + 42) % 2147483647) % 2 = 0 THEN 1.0 ELSE -1.0 END AS side FROM (SELECT *, (x1 * x1 + b) % 2147483647 AS x2 FROM (SELECT *, (x0 * x0 + i) % 2147483647 AS x1 FROM (SELECT *, (i * 48271 + b * 69621 + 42 * 16807) % 2147483647 AS x0 FROM (SELECT series, actual, CAST(datediff('day', DATE '1970-01-01', ts) AS BIGINT) AS i, CAST(length(series) AS BIGINT) AS b FROM sig))))) GROUP BY 1")
def baseline_signals(spark, d):
    """Hits of always holding, and of a drawn side."""
    b = screening.baselines(_sig(spark, d))
    hit = lambda c: 100 * F.avg((F.signum("actual") == F.col(c)).cast("double"))
    return b.groupBy("series").agg(hit("always_long").alias("long_hit"), hit("random").alias("random_hit"), F.sum(F.col("actual") * F.col("random")).alias("random_sum"))


@query("SELECT series, count(*) AS n FROM panel WHERE series IN (SELECT series FROM gappy WHERE ts > DATE '2001-07-31' INTERSECT SELECT series FROM panel) GROUP BY 1")
def common_series(spark, d):
    """Series that a later part of the panel still has."""
    p = panels.panel(spark, d)
    return screening.common_series(p, p.where("ts > DATE'2001-07-31'")).groupBy("series").agg(F.count("*").alias("n"))


@query(f"SELECT grp, series, count(*) AS n, R(sum(value)) AS value FROM (SELECT * EXCLUDE (grp) FROM panel) JOIN (VALUES ('fast', '1-URGENT'), ('fast', '2-HIGH'), ('all', '2-HIGH'), ('all', '5-LOW'), ('empty', 'absent')) m(grp, series) USING (series) GROUP BY 1, 2", 2)
def feature_groups(spark, d):
    """Groups from a table of names; those of series that are not there vanish."""
    names = spark.createDataFrame([("fast", "1-URGENT"), ("fast", "2-HIGH"), ("all", "2-HIGH"), ("all", "5-LOW"), ("empty", "absent")], "grp string, series string")
    return screening.grouped(panels.panel(spark, d), names).groupBy("grp", "series").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


@query(f"SELECT series, ts, R(pred * CASE WHEN n > 10 AND p > 0.001 AND t > 0.001 AND t / p > 1 AND t / p <= 5 THEN t / p ELSE 1 END) AS pred FROM (SELECT series, ts, pred, count(CASE WHEN ts > DATE '{SPLIT}' THEN pred END) OVER g AS n, stddev_samp(CASE WHEN ts > DATE '{SPLIT}' THEN pred END) OVER g AS p, stddev_samp(CASE WHEN ts <= DATE '{SPLIT}' THEN actual END) OVER g AS t FROM sig WINDOW g AS (PARTITION BY series)) WHERE ts > DATE '{SPLIT}'")
def variance_rescale(spark, d):
    return screening.rescaled(_sig(spark, d), SPLIT).select("series", "ts", "pred")


A, B = "1-URGENT", "5-LOW"


@query(f"SELECT 'real' AS series, a.ts, R(a.value - 100 * (b.value / b.was - 1)) AS value FROM panel a JOIN (SELECT *, lag(value, 12) OVER {W} AS was FROM panel) b USING (ts) WHERE a.series = '{A}' AND b.series = '{B}'", 3)
def real_yield(spark, d):
    return features.real_yield(panels.panel(spark, d), A, B, "real")


@query(f"SELECT 'ratio' AS series, ts, R(a.value / b.value) AS value FROM panel a JOIN panel b USING (ts) WHERE a.series = '{A}' AND b.series = '{B}'")
def ratio_columns(spark, d):
    return features.ratio(panels.panel(spark, d), A, B, "ratio")


@query(f"SELECT 'divergence' AS series, ts, R(100 * (a.value / a.was - b.value / b.was)) AS value FROM (SELECT *, lag(value, 12) OVER {W} AS was FROM panel) a JOIN (SELECT *, lag(value, 12) OVER {W} AS was FROM panel) b USING (ts) WHERE a.series = '{A}' AND b.series = '{B}'", 4)
def growth_divergence(spark, d):
    return features.divergence(panels.panel(spark, d), A, B, "divergence")


@query(f"SELECT coalesce(name, series) AS series, count(*) AS n FROM panel LEFT JOIN (VALUES ('{A}', 'urgent'), ('{B}', 'low')) m(series, name) USING (series) WHERE series != '3-MEDIUM' AND NOT ends_with(series, 'BRASS') GROUP BY 1")
def pruned_and_named(spark, d):
    """Series left out by name and by ending, and readable names."""
    names = spark.createDataFrame([(A, "urgent"), (B, "low")], "series string, name string")
    return features.renamed(features.without(panels.panel(spark, d), ("3-MEDIUM",), ("BRASS",)), names).groupBy("series").agg(F.count("*").alias("n"))


QUERIES, ORACLES = query.queries, query.oracles
