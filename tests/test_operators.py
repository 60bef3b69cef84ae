import datetime
import math

import numpy as np
from pyspark.sql import functions as F

from lodestar.operators import metrics, outlook, portfolio, regimes, screening, walkforward
from lodestar.plans import models, panels
from lodestar.streaming import windowed


def _series(spark, values, name="s"):
    day = datetime.date(2000, 1, 31)
    return spark.createDataFrame([(name, day + datetime.timedelta(days=31 * k), v) for k, v in enumerate(values)], "series string, ts date, ret double")


def test_no_look_ahead(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 3)), rng.normal(size=60)
    day = datetime.date(2000, 1, 31)
    rows = [(day + datetime.timedelta(days=31 * k), float(y[k]), *map(float, x[k])) for k in range(60)]
    df = spark.createDataFrame(rows, "ts date, y double, a double, b double, c double")
    whole = walkforward.walk_forward(df, ["linear"], 30).toPandas().set_index("ts")
    cut = walkforward.walk_forward(df.where(F.col("ts") <= F.lit(rows[45][0])), ["linear"], 30).toPandas().set_index("ts")
    np.testing.assert_allclose(whole.loc[cut.index, "pred"].astype(float), cut["pred"].astype(float))
    k = 30
    beta = np.linalg.lstsq(np.column_stack([np.ones(k), x[:k]]), y[:k], rcond=None)[0]
    assert abs(whole.loc[rows[k][0], "pred"] - (beta[0] + x[k] @ beta[1:])) < 1e-9


def test_elastic_net_meets_its_conditions():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(80, 5)), rng.normal(size=80)
    x, y = x - x.mean(0), y - y.mean()
    b = walkforward._net(x, y, 0.05, 0.5)
    g = x.T @ (y - x @ b) / 80 - 0.05 * 0.5 * b
    assert (np.abs(g[b == 0]) <= 0.025 + 1e-7).all() and np.allclose(g[b != 0], 0.025 * np.sign(b[b != 0]), atol=1e-6)


def test_models_fit_a_line():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 3))
    y = x[:, 0] * 2 - x[:, 1] + rng.normal(size=120) * 0.1
    for name, fit in walkforward.MODELS.items():
        assert np.corrcoef(fit(x[:100], y[:100])(x[100:]), y[100:])[0, 1] > 0.5, name


def test_models_have_the_reference_sizes(monkeypatch):
    rng = np.random.default_rng(5)
    x, grown = rng.normal(size=(60, 2)), []
    for grows in ("_tree", "_grown"):  # trees of the forest, and of boosting
        monkeypatch.setattr(walkforward, grows, lambda *a: grown.append(1) or 0.0)
    for name, trees in (("forest", 100), ("boosting", 100), ("ensemble", 50)):
        grown.clear()
        walkforward.MODELS[name](x, x[:, 0])
        assert len(grown) == trees, name
    steps = []
    monkeypatch.setattr(walkforward, "_forward", lambda q, w: steps.append(len(q)) or [q, np.zeros((len(q), 16)), np.zeros((len(q), 8)), np.full((len(q), 1), 1 / (1 + len(steps)))])
    walkforward.MODELS["network"](x, np.zeros(60))
    assert steps == [51, 9] * 1000
    steps.clear()
    monkeypatch.setattr(walkforward, "_forward", lambda q, w: steps.append(len(q)) or [q, np.zeros((len(q), 16)), np.zeros((len(q), 8)), np.ones((len(q), 1))])
    walkforward.MODELS["network"](x, np.zeros(60))
    assert steps == [51, 9] * 22


def test_registered_jobs_are_whole(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(walkforward, "MODELS", dict.fromkeys(walkforward.MODELS, walkforward.ols))
    months = models._wide(spark, d).dropna().count()
    out = models.QUERIES["walk_forward_nonlinear"](spark, d).groupBy("model").count().collect()
    assert months > 54 and len(out) == 5 and {r["count"] for r in out} == {months - 48}
    for name, whole in (("bootstrap_sharpe", metrics.bootstrap(panels.returns(spark, d), ["series"], "ret")), ("permutation_sharpe", metrics.permutation(panels.signals(spark, d), ["series"]))):
        assert sorted(models.QUERIES[name](spark, d).collect()) == sorted(panels.rounded(whole).collect()), name


def test_hidden_states_separate(spark):
    rng = np.random.default_rng(4)
    values = [float(v) for v in np.concatenate([rng.normal(1, 0.1, 40), rng.normal(-1, 0.1, 40)])]
    out = walkforward.hidden_states(_series(spark, values), 2).toPandas().sort_values("ts")
    assert (out.state.to_numpy() == np.repeat([0, 1], 40)).all()
    assert walkforward.hidden_states(_series(spark, values[:10])).where("state is not null").count() == 0


def test_smoothing(spark):
    labels = list("aaabaccccd")
    day = datetime.date(2000, 1, 1)
    df = spark.createDataFrame([("s", day + datetime.timedelta(days=k), v) for k, v in enumerate(labels)], "series string, ts date, regime string")
    got = [r.smooth for r in regimes.smoothed(df).orderBy("ts").collect()]
    assert got == list("aaaaccccc" + "c")


def test_positions_and_drawdown(spark):
    df = _series(spark, [0.1, -0.2, 0.05, -0.1, 0.2]).withColumn("pred", F.lit(1.0))
    pos = portfolio.positions(df, 2.0, 0.5)
    assert {r.pos for r in pos.collect()} == {2.0}
    got = [r.pos for r in portfolio.delevered(pos, 0.2, 2.0).orderBy("ts").collect()]
    c = k = 1.0
    want = []
    for r in (0.1, -0.2, 0.05, -0.1, 0.2):
        want.append(1 + 1 * (1 - 0.5 * min((k - c) / k / 0.2, 1)))
        c *= 1 + r * want[-1]
        k = max(k, c)
    np.testing.assert_allclose(got, want)


def test_metrics_edges(spark):
    one = metrics.risk(_series(spark, [0.0, 0.0, 0.0]), ["series"]).first()
    assert one.sharpe == 0.0 and one.skew is None and one.max_dd == 0.0
    same = _series(spark, [0.1, 0.2]).selectExpr("series", "ts", "ret actual", "0D pred", "0D bench")
    assert metrics.diebold_mariano(same, ["series"]).first().dm is None
    assert metrics.accuracy(same, ["series"]).first().r2 == 0.0


def test_bootstrap_is_reproducible(spark):
    df = _series(spark, [0.01 * ((k * 7) % 11 - 5) for k in range(40)])
    a, b = (metrics.bootstrap(df.repartition(n), ["series"], "ret", 100).first() for n in (1, 3))
    assert a == b and a.low < a.high


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    src.coalesce(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = windowed(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    rows = lambda df: {tuple(r) for r in df.select(F.col("start").cast("string"), "event_type", "n").collect()}
    got = rows(spark.table("w"))
    q.stop()
    assert got and got == rows(windowed(src))


def test_distribution_functions(spark):
    """Against numerical integration and known quantiles."""
    x = np.linspace(-60, 3, 2_000_001)
    for df in (1, 2, 3, 4, 7, 30, 251):
        density = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
        for t in (-2.5, -0.3, 0.0, 1.0, 2.9):
            got = spark.createDataFrame([(t, df)], "t double, df long").select(metrics.student_cdf("t", "df").alias("p")).first().p
            want = np.trapezoid(density[x <= t], x[x <= t]) + (0.5 - math.atan(60) / math.pi if df == 1 else 0)
            assert abs(got - want) < 2e-4, (t, df)
    rows = spark.createDataFrame([(z,) for z in (-9.0, -1.959963984540054, 0.0, 1.0, 3.0, 9.0)], "z double").select(metrics.normal_cdf("z").alias("p")).collect()
    assert np.allclose([r.p for r in rows], [0, 0.025, 0.5, 0.8413447460685429, 0.9986501019683699, 1], atol=1e-12)


def test_ratios_without_a_loss(spark):
    up, flat = _series(spark, [0.01, 0.02, 0.01], "up"), _series(spark, [0.0, 0.0, 0.0], "flat")
    got = {r.series: r for r in metrics.risk(up.union(flat), ["series"]).collect()}
    assert got["up"].sortino == got["up"].calmar_geo == got["up"].calmar_arith == float("inf")
    assert got["flat"].sortino == got["flat"].calmar_geo == got["flat"].sharpe == 0


def test_screen_is_listwise(spark):
    """A date counts for a group only if all of its series have a value; too few common dates give no t."""
    rng, day, rows = np.random.default_rng(6), datetime.date(2000, 1, 1), []
    x, y = rng.normal(size=(40, 2)), rng.normal(size=40)
    for k in range(40):
        for j, s in enumerate("ab"):
            rows.append(("g", s, day + datetime.timedelta(days=k), None if (k + j) % 5 == 0 else float(x[k, j]), float(y[k])))
        rows.append(("h", "c", day + datetime.timedelta(days=k), 1.0 * k if k < 9 else None, float(y[k])))
    got = {r.series: r for r in screening.screened(spark.createDataFrame(rows, "grp string, series string, ts date, value double, y double")).collect()}
    ok = [k for k in range(40) if k % 5 and (k + 1) % 5]
    for j, s in enumerate("ab"):
        r = np.corrcoef(x[ok, j], y[ok])[0, 1]
        assert got[s].n == len(ok) and abs(got[s].t - r * math.sqrt((len(ok) - 2) / (1 - r * r))) < 1e-9
    assert got["c"].t == 0 and not got["c"].kept  # under ten values: the reference leaves it out before the screen


def test_costs_of_the_sized_portfolio(spark):
    rows = [("s", datetime.date(2000, 1, 1) + datetime.timedelta(days=k), p, r) for k, (p, r) in enumerate([(0.1, 0.02), (-0.2, 0.01), (0.2, -0.5), (0.2, 0.1), (0.01, 0.1)])]
    df = spark.createDataFrame(rows, "series string, ts date, pred double, ret double")
    top, equity, peak, want, side, before = 0.0, 1.0, 1.0, [], [], None
    for _, _, p, r in rows:
        top = max(top, abs(p))
        pos = abs(p) / top * (1.5 if p > 0 else -0.5)
        if pos > 1:
            pos = 1 + (pos - 1) * (1 - 0.5 * min((peak - equity) / peak / 0.2, 1))
        equity *= 1 + pos * r
        peak = max(peak, equity)
        now = 0 if abs(p) < 0.02 else math.copysign(1, p)
        want.append(pos * r - max(0, abs(pos) - 1) * 0.06 / 12 - abs(now - (now if before is None else before)) / 2 * 25 / 1e4)
        before = now
    got = [r.net for r in portfolio.costed(df, 25.0, limit=0.2).orderBy("ts").collect()]
    assert np.allclose(got, want)


def _pairs(spark, x, y, name="s"):
    day = datetime.date(2000, 1, 31)
    return spark.createDataFrame([(name, day + datetime.timedelta(days=31 * k), a, b) for k, (a, b) in enumerate(zip(x, y))], "series string, ts date, value double, y double")


def test_line_forecasts_meet_least_squares(spark):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=40).tolist(), rng.normal(size=40).tolist()
    x[5], y[7], y[39] = None, None, None
    df = _pairs(spark, x, y)
    ok = [k for k in range(40) if x[k] is not None and y[k] is not None]
    for window, embargo in ((None, 0), (15, 2)):
        want = []
        for k in ok:
            start = 0 if window is None else max(0, k - window - embargo)
            past = [i for i in ok if start <= i < k - embargo]
            if len(past) >= 10:
                b, a = np.polyfit([x[i] for i in past], [y[i] for i in past], 1)
                want.append((a + b * x[k], np.mean([y[i] for i in past]), len(past)))
        got = outlook.line_forecasts(df, 10, window, embargo).orderBy("ts").select("pred", "bench", "n_train").collect()
        np.testing.assert_allclose(np.array(got, float), np.array(want))
    b, a = np.polyfit([x[i] for i in ok], [y[i] for i in ok], 1)
    r = outlook.predict_next(df).first()
    assert r["n"] == len(ok) and abs(r["pred"] - (a + b * x[39])) < 1e-12
    assert outlook.line_forecasts(df.limit(0)).count() == 0 and outlook.predict_next(df.limit(0)).count() == 0
    assert outlook.predict_next(_pairs(spark, [1.0, 1.0, 1.0], [2.0, 4.0, None])).first()["pred"] == 3.0


def test_splits_states_and_months(spark):
    x = [float(k) for k in range(70)]
    got = {(r["fold"], r["part"]): (r["n"], r["mean"]) for r in outlook.time_splits(_pairs(spark, x, x), 3, least=40).collect()}
    assert got == {(1, "train"): (46, 22.5), (1, "test"): (12, 51.5), (2, "train"): (58, 28.5), (2, "test"): (12, 63.5)}
    rows = [("s", "a", 0.1), ("s", "b", 0.0), ("s", "c", -0.1), ("t", "a", 0.1)]
    got = {(r["series"], r["state"]): r["name"] for r in outlook.state_names(spark.createDataFrame(rows, "series string, state string, ret double")).collect()}
    assert got == {("s", "a"): "bull", ("s", "b"): "consolidation", ("s", "c"): "bear", ("t", "a"): "bull"}
    months = spark.createDataFrame([(1871.01,), (1871.1,), (1999.12,), (2000.0,), (2000.13,), (None,)], "x double").select(outlook.decimal_month(F.col("x")).alias("d"))
    assert [str(r["d"]) for r in months.collect()] == ["1871-01-01", "1871-10-01", "1999-12-01", "2000-01-01", "2000-12-01", "None"]


def test_panel_factors_meet_the_decomposition(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(50, 4)) @ rng.normal(size=(4, 4))
    day = datetime.date(2000, 1, 31)
    rows = [(f"s{j}", day + datetime.timedelta(days=31 * k), float(x[k, j])) for k in range(50) for j in range(4) if (k, j) != (20, 2)]
    df = spark.createDataFrame(rows, "series string, ts date, ret double")
    got = walkforward.panel_factors(df, 3).groupBy("ts").pivot("factor", [0, 1, 2]).agg(F.first("score")).orderBy("ts").toPandas()
    kept = np.delete(x, 20, 0)
    m, v = walkforward.factors(kept, 3)
    np.testing.assert_allclose(got[["0", "1", "2"]].to_numpy(float), (kept - m) @ v, atol=1e-9)
    assert walkforward.panel_factors(df.limit(0)).count() == 0
