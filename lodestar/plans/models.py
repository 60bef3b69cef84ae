"""Walk-forward fits, the composed model, factors, hidden states and resampling; fitted models have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import by, forward_return, pct_change, rolling
from ..operators import factor_model, metrics, outlook, portfolio, regimes, walkforward
from . import panels
from .outlook import COMBOS
from .panels import Registry

query = Registry()


def _wide(spark, d):
    names = [r[0] for r in panels.panel(spark, d).select("series").distinct().orderBy("series").collect()]
    w = panels.target(spark, d).groupBy("ts", "y").pivot("series", names).agg(F.first("value"))
    return w.toDF("ts", "y", *[f"x{k}" for k in range(len(names))])


@query()
def walk_forward_linear_models(spark, d):
    """Expanding refits of the linear models."""
    return walkforward.walk_forward(_wide(spark, d), ["linear", "ridge", "elastic_net", "factor_linear"], 36)


@query()
def walk_forward_rolling(spark, d):
    """A fixed window, an embargo of two rows and a floor of zero."""
    return walkforward.walk_forward(_wide(spark, d), ["linear", "ridge"], 36, rolling=True, embargo=2, floor_zero=True)


@query()
def walk_forward_nonlinear(spark, d):
    """Trees, network and mixture, every month."""
    return walkforward.walk_forward(_wide(spark, d), ["forest", "boosting", "network", "ensemble", "elastic_net_cv"], 48)


@query()
def model_comparison(spark, d):
    """One row of accuracy a model."""
    return metrics.accuracy(walkforward.walk_forward(_wide(spark, d), ["linear", "ridge", "elastic_net"], 36), ["model"])


@query()
def pca_factors(spark, d):
    """Scores of the first three components of the returns."""
    scores = walkforward.panel_factors(panels.returns(spark, d), 3)
    return scores.groupBy("ts").pivot("factor", [0, 1, 2]).agg(F.first("score")).toDF("ts", "f0", "f1", "f2")


@query()
def hmm_states(spark, d):
    """The likeliest states of a Gaussian hidden Markov model, with their labels."""
    return walkforward.hidden_states(panels.returns(spark, d))


@query()
def hmm_states_joint(spark, d):
    """States of return and rolling spread together, with full covariances."""
    r = panels.returns(spark, d).withColumn("spread", rolling(F.col("ret"), F.stddev_samp, by("series"), 6))
    return walkforward.hidden_states(r, 2, columns=("ret", "spread"))


@query()
def hmm_state_names(spark, d):
    """Names of the hidden states by their mean and spread."""
    r = panels.returns(spark, d)
    states = walkforward.hidden_states(r).select("series", "ts", "state").where("state IS NOT NULL")
    return outlook.state_names(states.join(r.select("series", "ts", "ret"), ["series", "ts"]))


def _runs(spark, d):
    """The panel as runs of the composed model: next month's return of the index, and that of the next three."""
    p = panels.price(spark, d)
    y = [p.select(F.lit(f"h{h}").alias("run"), "ts", forward_return(F.col("price"), by("series"), h).alias("y")) for h in (1, 3)]
    return panels.panel(spark, d).join(y[0].union(y[1]), "ts").select("run", "grp", "series", "ts", "value", "y")


GRID = """, px AS (SELECT ts, price, lead(price, 1) OVER (ORDER BY ts) / price - 1 AS y1, lead(price, 3) OVER (ORDER BY ts) / price - 1 AS y3 FROM price),
dates AS (SELECT run, ts, y, row_number() OVER (PARTITION BY run ORDER BY ts) - 1 AS rn FROM (SELECT 'h1' AS run, ts, y1 AS y FROM px UNION ALL SELECT 'h3', ts, y3 FROM px)),
grid AS (SELECT run, rn, ts, y, grp, series, value FROM dates JOIN (SELECT DISTINCT grp, series FROM panel) ON true LEFT JOIN gappy USING (ts, grp, series)),
folds AS (SELECT DISTINCT run, rn AS f FROM dates WHERE rn >= 36 AND rn % 4 = 0),
known AS (SELECT run, f, grp, series, avg(value) AS mean, stddev_pop(value) AS sd, regr_count(y, value) AS pairs, covar_pop(y, value) AS cov FROM grid JOIN folds USING (run) WHERE rn < f GROUP BY 1, 2, 3, 4 HAVING count(value) >= 10),
whole AS (SELECT run, f, grp, rn FROM known JOIN grid USING (run, grp, series) WHERE rn < f GROUP BY 1, 2, 3, 4 HAVING count(value) = count(*) AND max(y) IS NOT NULL),
stat AS (SELECT k.run, k.f, k.grp, k.series, count(w.rn) AS n, corr(CASE WHEN w.rn IS NOT NULL THEN value END, y) AS r FROM known k JOIN grid g USING (run, grp, series) LEFT JOIN whole w ON w.run = k.run AND w.f = k.f AND w.grp = k.grp AND w.rn = g.rn WHERE g.rn < k.f GROUP BY 1, 2, 3, 4),
t AS (SELECT *, CASE WHEN n >= 10 THEN coalesce(rr * sqrt((n - 2) / (1 - rr * rr)), 0) ELSE 0 END AS t FROM (SELECT *, least(greatest(r, -0.9999), 0.9999) AS rr FROM stat))"""


@query(GRID + """ SELECT run, f AS rn, grp, series, n, R(t) AS t, R(mean) AS mean, R(CASE WHEN sd > 0 THEN sd ELSE 1 END) AS spread, R(CASE WHEN pairs >= 3 THEN cov / CASE WHEN sd > 0 THEN sd ELSE 1 END ELSE 1 END) AS slope,
abs(t) > 0.75 OR (max(CASE WHEN abs(t) > 0.75 THEN 1 ELSE 0 END) OVER (PARTITION BY run, f, grp) = 0 AND row_number() OVER (PARTITION BY run, f, grp ORDER BY abs(t) DESC, series) = 1) AS kept FROM t JOIN known USING (run, f, grp, series)""", 3)
def fold_states(spark, d):
    """What each fold of two runs screens, keeps and scales by, on a panel with gaps."""
    p = panels.price(spark, d)
    y = [p.select(F.lit(f"h{h}").alias("run"), "ts", forward_return(F.col("price"), by("series"), h).alias("y")) for h in (1, 3)]
    dates = y[0].union(y[1])
    names = panels.panel(spark, d).select("grp", "series").distinct()
    grid = dates.join(names).join(panels.gappy(spark, d), ["grp", "series", "ts"], "left").select("run", "grp", "series", "ts", "value", "y")
    return factor_model.fold_states(factor_model.numbered(grid), 36, 4)


#: The seven estimators that are compared.
SEVEN = ["linear", "elastic_net_cv", "forest", "boosting", "oblivious", "network", "ensemble"]


@query()
def factor_model_forecasts(spark, d):
    """The composed model with linear fits, for one and three months ahead, and the forecast after the last row."""
    return factor_model.forecasts(_runs(spark, d), ["linear", "ridge"], 36, ahead=True)


@query()
def factor_model_importance(spark, d):
    """Coefficients of the last fold's final fits, with regime flags as further columns, strongest first."""
    runs = _runs(spark, d)
    index = panels.price(spark, d).withColumn("ret", pct_change(F.col("price"), by("series")) / 10)
    labels = ("up", "down", "consolidation")
    flags = regimes.features(regimes.trend(index), "trend_regime", labels)
    names = ["persistence", "strength", *[f"is_{r}" for r in labels], *[f"vol_{r}" for r in labels]]
    flags = flags.select("ts", *[F.col(c).cast("double").alias(c) for c in names]).unpivot("ts", names, "name", "value")
    flags = flags.withColumn("run", F.explode(F.array(F.lit("h1"), F.lit("h3"))))
    return factor_model.importance(factor_model.forecasts(runs, ["linear", "elastic_net"], 36, ahead=True, coefs=True, extra=flags))


@query()
def factor_model_failures(spark, d):
    """Folds and failed fits of estimators that are given as functions, one of which fails on every other fold."""

    def brittle(x, y):
        if len(y) % 2:
            raise ValueError("an odd number of rows")
        return walkforward.ols(x, y)

    return factor_model.failures(factor_model.forecasts(_runs(spark, d), {"own": walkforward.ridge(5.0), "brittle": brittle}, 36))


@query()
def model_sweep(spark, d):
    """Seven estimators, fitted once, under five combinations of leverage with financing and a drawdown limit."""
    found = factor_model.forecasts(_runs(spark, d).where("run = 'h3'"), SEVEN, 36, step=3)
    signal = found.where("actual IS NOT NULL").select("model", "ts", "pred", F.col("actual").alias("ret"))
    return portfolio.sweep_report(portfolio.swept(signal, COMBOS, 0.25, ("model",)), 0.05, ("model",), 4)


#: The recursion of one combination: positions cut in the drawdown that they cause.
_CUT = """, pos AS (SELECT series, ts, ret, max_long, row_number() OVER (PARTITION BY series, max_long, max_short ORDER BY ts) AS rn, max_short, s * CASE WHEN pred > 0 THEN max_long ELSE -max_short END AS pos FROM (SELECT *, abs(pred) / greatest(max(abs(pred)) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING), 1e-8) AS s FROM sig WHERE ret IS NOT NULL AND pred IS NOT NULL), (VALUES {combos}) c(max_long, max_short)),
lists AS (SELECT series, max_long, max_short, list({{'p': CAST(pos AS DOUBLE), 'r': CAST(ret AS DOUBLE), 'e': 1.0::DOUBLE, 'k': 1.0::DOUBLE, 'g': 0.0::DOUBLE}} ORDER BY rn) AS x FROM pos GROUP BY 1, 2, 3),
folded AS (SELECT series, max_long, max_short, list_transform(range(1, len(x) + 1), lambda j: list_reduce(list_prepend({{'p': 0.0::DOUBLE, 'r': 0.0::DOUBLE, 'e': 1.0::DOUBLE, 'k': 1.0::DOUBLE, 'g': 0.0::DOUBLE}}, x[1:j]), lambda a, b: list_transform([CASE WHEN b.p > 1 AND max_long > 1 THEN 1 + (b.p - 1) * (1 - 0.5 * least((a.k - a.e) / a.k / 0.25, 1.0)) ELSE b.p END], lambda q: {{'p': q, 'r': b.r, 'e': a.e * (1 + q * b.r), 'k': greatest(a.k, a.e * (1 + q * b.r)), 'g': q * b.r - greatest(abs(q) - 1, 0) * 0.05 / 12}})[1]).g) AS g FROM lists)"""


@query(_CUT.format(combos=", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in COMBOS)) + " SELECT series, max_long, max_short, count(*) AS n, R(product(1 + g) - 1) AS total, R(avg(g) / stddev_samp(g) * sqrt(12)) AS sharpe FROM (SELECT series, max_long, max_short, unnest(g) AS g FROM folded) GROUP BY 1, 2, 3", 5)
def leverage_sweep_drawdown(spark, d):
    """Five combinations of leverage with financing, each cut in its own drawdown, in one pass over each series."""
    return portfolio.sweep_report(portfolio.swept(panels.signals(spark, d), COMBOS, 0.25), 0.05).select("series", "max_long", "max_short", "n", "total", "sharpe")


#: The draws of the resampling queries: three squarings modulo a prime.
DRAW = "((x2 * x2 + 42) % 2147483647)"


def drawn(source: str, i: str) -> str:
    """SQL of source for each replicate b, with u, the draw of row i."""
    one = f"SELECT *, ({i} * 48271 + b * 69621 + 42 * 16807) % 2147483647 AS x0 FROM (SELECT * FROM {source}), (SELECT range AS b FROM range(1000))"
    return f"(SELECT *, {DRAW} AS u FROM (SELECT *, (x1 * x1 + b) % 2147483647 AS x2 FROM (SELECT *, (x0 * x0 + {i}) % 2147483647 AS x1 FROM ({one}))))"


_W = " + ".join(f"CAST(u / 2147483647.0::DOUBLE > {p!r} AS INT)" for p in metrics.POISSON)
BOOT = f"""(SELECT series, max(n) AS n, quantile_cont(s, 0.025) AS low, quantile_cont(s, 0.975) AS high FROM (SELECT series, n, CASE WHEN v > 1e-18 THEN m / sqrt(v) * sqrt(12) END AS s FROM (SELECT series, b, count(*) AS n, sum(w * ret) / sum(w) AS m, sum(w * ret * ret) / sum(w) - (sum(w * ret) / sum(w)) ** 2 AS v FROM
(SELECT *, {_W} AS w FROM {drawn("(SELECT series, ret, CAST(datediff('day', DATE '1970-01-01', ts) AS BIGINT) AS i FROM {source})", "i")}) GROUP BY 1, 2)) GROUP BY 1)"""


@query(f"SELECT series, n, R(low) AS low, R(high) AS high FROM {BOOT.replace('{source}', 'ret WHERE ret IS NOT NULL')}")
def bootstrap_sharpe(spark, d):
    """Intervals of the Sharpe ratio from 1000 weightings of the rows."""
    return metrics.bootstrap(panels.returns(spark, d), ["series"], "ret", 1000)


@query(f"""SELECT series, R(max(real)) AS real, R(avg(CAST(s >= real - 1e-12 AS DOUBLE))) AS p FROM (SELECT series, b, avg(x) / nullif(stddev_pop(x), 0) AS s FROM (SELECT a.series, b, sign(a.pred) * q.actual AS x FROM
(SELECT series, b, pred, row_number() OVER (PARTITION BY series, b ORDER BY u, i) AS i FROM {drawn("(SELECT series, pred, row_number() OVER (PARTITION BY series ORDER BY ts) AS i FROM sig)", "i")}) a JOIN (SELECT series, actual, row_number() OVER (PARTITION BY series ORDER BY ts) AS i FROM sig) q USING (series, i)) GROUP BY 1, 2)
JOIN (SELECT series, avg(sign(pred) * actual) / stddev_pop(sign(pred) * actual) AS real FROM sig GROUP BY 1) USING (series) GROUP BY 1""")
def permutation_sharpe(spark, d):
    """The share of 1000 shuffles of the signals whose Sharpe reaches the real one."""
    return metrics.permutation(panels.signals(spark, d), ["series"], 1000)


QUERIES, ORACLES = query.queries, query.oracles
