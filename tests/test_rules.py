"""Rules against plain numpy, pandas or known values: quantiles, resampling, sizing, hidden states and what was put right."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.functions import quantiles
from lodestar.operators import features, metrics, portfolio, regimes, screening, walkforward

KIND = "series string, ts date, pred double, ret double"


@pytest.fixture(scope="module")
def signals(spark):
    rng = np.random.default_rng(7)
    rows = [(s, d, float(p), float(r)) for s, n in (("a", 120), ("b", 90), ("c", 2)) for d, p, r in zip(pd.date_range("1990-01-31", periods=n, freq="ME").date, rng.normal(0.004, 0.03, n), rng.normal(0.004, 0.05, n))]
    return spark.createDataFrame(rows, KIND), pd.DataFrame(rows, columns=["series", "ts", "pred", "ret"])


def test_running_quantiles():
    rng, shares = np.random.default_rng(0), [0, 0.25, 0.5, 0.9, 1]
    for n in (0, 1, 2, 3, 50, 333):
        v = np.round(rng.normal(size=n), 1)
        v[rng.random(n) < 0.2] = np.nan
        for w in (None, 7, 40):
            got, s = quantiles.running(v, shares, w, 3), pd.Series(v)
            for j, p in enumerate(shares):
                np.testing.assert_allclose(got[:, j], (s.expanding(3) if w is None else s.rolling(w, min_periods=3)).quantile(p), rtol=1e-12)


def test_running_quantiles_keep_columns(spark, signals):
    df = signals[0].withColumnRenamed("ret", "value").withColumn("high", F.lit("clash"))
    got = quantiles.running_quantiles(df, {"high": 0.75}, least=24).toPandas().sort_values(["series", "ts"])
    want = signals[1].sort_values(["series", "ts"]).groupby("series")["ret"].transform(lambda s: s.expanding(24).quantile(0.75))
    np.testing.assert_allclose(got["high"].to_numpy(float), want.to_numpy(), rtol=1e-12)
    assert set(got.columns) == {"series", "ts", "pred", "value", "high"}


def test_quantile_functions(spark):
    known = [(0.975, 1, 1.959963984540054, 12.706204736432095), (0.95, 2, 1.6448536269514722, 2.919985580353725), (0.995, 3, 2.5758293035489004, 5.840909309733355), (0.975, 10, 1.959963984540054, 2.2281388519649385), (0.5, 7, 0.0, 0.0)]
    known += [(1 - p, n, -z, -t) for p, n, z, t in known[:4]]
    df = spark.createDataFrame([k[:2] for k in known], "p double, n int")
    got = df.select("p", "n", metrics.normal_ppf("p").alias("z"), metrics.student_ppf("p", "n").alias("t")).collect()
    np.testing.assert_allclose([(r.z, r.t) for r in got], [k[2:] for k in known], rtol=1e-9, atol=1e-9)
    many = spark.range(200).select(((F.col("id") + 0.5) / 200).alias("p"), (F.col("id") % 40 + 1).cast("int").alias("n")).withColumn("z", metrics.normal_ppf("p")).withColumn("t", metrics.student_ppf("p", "n"))
    for r in many.select("p", metrics.normal_cdf("z").alias("a"), metrics.student_cdf("t", "n").alias("b")).collect():
        assert abs(r.a - r.p) < 1e-12 and abs(r.b - r.p) < 1e-12
    odd = spark.createDataFrame([(0.0, 3), (1.0, 3), (None, 3), (0.3, 0)], "p double, n int").select(metrics.normal_ppf("p").alias("z"), metrics.student_ppf("p", "n").alias("t")).collect()
    assert [r.z is None for r in odd] == [True, True, True, False] and all(r.t is None for r in odd)
    wide, narrow = (metrics.r2_interval(spark.createDataFrame([(1, float(k), float(k + k % 3), 2.0) for k in range(30)], "g int, actual double, pred double, bench double"), ["g"], level).first() for level in (0.99, 0.9))
    assert (wide.r2 - wide.low) / (narrow.r2 - narrow.low) == pytest.approx(2.5758293035489004 / 1.6448536269514722)


def test_bootstrap_has_the_intervals_of_drawing_rows(spark, signals):
    df, pdf = signals
    got = {r.series: r for r in metrics.bootstrap(df, ["series"], "ret", 2000).collect()}
    rng = np.random.default_rng(1)
    for s in "ab":
        v = pdf.loc[pdf.series == s, "ret"].to_numpy()
        x = v[rng.integers(0, len(v), (4000, len(v)))]
        low, high = np.quantile(x.mean(1) / x.std(1) * 12**0.5, [0.025, 0.975])
        assert got[s].n == len(v) and abs(got[s].low - low) < 0.12 and abs(got[s].high - high) < 0.12
    plan = metrics.bootstrap(df, ["series"], "ret", 2000)._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and "Join" not in plan  # rows meet only in sums


def test_permutation(spark, signals):
    df, pdf = signals
    got = {r.series: r for r in metrics.permutation(df.withColumnRenamed("ret", "actual"), ["series"], 400, blocks=3).collect()}
    rng = np.random.default_rng(1)
    for s in "ab":
        p, a = pdf.loc[pdf.series == s, "pred"].to_numpy(), pdf.loc[pdf.series == s, "ret"].to_numpy()
        ratio = lambda x: x.mean(-1) / x.std(-1)
        real = ratio(np.sign(p) * a)
        reps = ratio(np.array([np.sign(rng.permutation(p)) * a for _ in range(4000)]))
        assert got[s].real == pytest.approx(real) and abs(got[s].p - (reps >= real).mean()) < 0.08
    flat = spark.createDataFrame([("x", pd.Timestamp("2000-01-31").date(), 1.0, 0.5)] * 3, "series string, ts date, pred double, actual double")
    assert tuple(metrics.permutation(flat, ["series"], 10).first()) == ("x", None, None)


def test_draws_are_even():
    i, b = np.meshgrid(np.arange(300), np.arange(300))
    u = metrics.draw(i, b, 42) / metrics.PRIME
    assert abs(np.histogram(u, 10, (0, 1))[0] / u.size - 0.1).max() < 0.005 and abs(np.corrcoef(u[:-1].ravel(), u[1:].ravel())[0, 1]) < 0.02 and abs(np.corrcoef(u[:, :-1].ravel(), u[:, 1:].ravel())[0, 1]) < 0.02


def test_sweep_is_each_combination_alone(spark, signals):
    df, combos = signals[0], ((1.0, 1.0), (1.5, 0.5), (2.5, 0.25), (3.0, 0.25))
    got = {(r.series, r.ts, r.max_long): r.pos for r in portfolio.swept(df, combos, 0.2).collect()}
    for a, b in combos:
        alone = portfolio.delevered(portfolio.positions(df, a, b), 0.2, a).collect()
        assert len(alone) == 212 and all(abs(got[r.series, r.ts, a] - r.pos) < 1e-12 for r in alone)
    report = portfolio.sweep_report(portfolio.swept(df, combos, 0.0), 0.05).where("series = 'a' and max_long = 3").first()
    pos = np.array([p for (s, _, a), p in sorted({(r.series, r.ts, r.max_long): r.pos for r in portfolio.positions(df, 3.0, 0.25).where("series = 'a'").withColumn("max_long", F.lit(3.0)).collect()}.items())])
    ret = signals[1].loc[signals[1].series == "a", "ret"].to_numpy()
    net = pos * ret - np.maximum(np.abs(pos) - 1, 0) * 0.05 / 12
    assert report.n == 120 and report.total == pytest.approx(np.prod(1 + net) - 1) and report.sharpe == pytest.approx(net.mean() / net.std(ddof=1) * 12**0.5)


def test_conviction_and_symmetric_sizing(spark, signals):
    df, pdf = signals
    kept = {(r.series, r.ts): r.kept_pred for r in portfolio.conviction(df, 0.5).collect()}
    even = {(r.series, r.ts): r.gross for r in portfolio.symmetric(df).collect()}
    for s, g in pdf.groupby("series"):
        size = g["pred"].abs().reset_index(drop=True)
        spread = size.expanding().std().shift(1)
        spread.iloc[0] = max(size.iloc[0], 1e-8)
        weak = size / spread.ffill().clip(lower=1e-8) < 0.5
        for k, r in enumerate(g.itertuples()):
            assert kept[s, r.ts] == (0.0 if weak[k] else r.pred)
            assert even[s, r.ts] == pytest.approx(r.pred / size.max() * r.ret)
    still = spark.createDataFrame([("z", pd.Timestamp("2000-01-31").date(), 0.0, 0.1)], KIND)
    assert portfolio.symmetric(still).first().gross == 0.0


def test_adjusted_r2_is_against_the_mean(spark):
    rng = np.random.default_rng(3)
    a, p = rng.normal(size=40), rng.normal(size=40)
    r = metrics.adjusted_r2(spark.createDataFrame([(1, float(x), float(y), 9.0) for x, y in zip(a, p)], "g int, actual double, pred double, bench double"), ["g"]).first()
    r2 = 1 - ((a - p) ** 2).sum() / ((a - a.mean()) ** 2).sum()
    assert r.r2 == pytest.approx(r2) and r.r2_adj == pytest.approx(1 - (1 - r2) * 39 / 38)


def test_total_relative_return(spark):
    days = pd.date_range("2000-01-01", periods=30).date
    px = spark.createDataFrame([(s, d, float(10 + k * m)) for s, m in (("a", 1), ("b", 2)) for k, d in enumerate(days)], "series string, ts date, value double")
    index = spark.createDataFrame([(d, float(100 + 3 * k)) for k, d in enumerate(days)], "ts date, value double")
    got = {(r.series, r.ts): r.rel_12m for r in features.sector_features(px, index).collect()}
    assert got["b", days[20]] == pytest.approx((10 + 40) / 10 - (100 + 60) / 100)


def test_a_sparse_series_does_not_empty_its_group(spark):
    rng = np.random.default_rng(5)
    days, y = pd.date_range("2000-01-31", periods=40, freq="ME").date, rng.normal(size=40)
    x = {"full": y + rng.normal(size=40), "gap": rng.normal(size=40), "rare": rng.normal(size=40)}
    x["gap"][3] = np.nan
    x["rare"][9:] = np.nan
    rows = [("g", s, d, None if np.isnan(v) else float(v), float(t)) for s, c in x.items() for d, v, t in zip(days, c, y)]
    got = {r.series: r for r in screening.screened(spark.createDataFrame(rows, "grp string, series string, ts date, value double, y double")).collect()}
    ok = ~np.isnan(x["gap"])
    r = np.corrcoef(x["full"][ok], y[ok])[0, 1]
    assert got["full"].n == got["gap"].n == 39 and got["full"].t == pytest.approx(r * np.sqrt(37 / (1 - r * r))) and got["full"].kept
    assert (got["rare"].n, got["rare"].t, got["rare"].kept) == (0, 0.0, False)


def test_short_series_keep_their_labels(spark):
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate("xy")] + [("b", k, v) for k, v in enumerate("xyyyx")], "series string, ts int, regime string")
    got = {(r.series, r.ts): r.smooth for r in regimes.smoothed(df).collect()}
    assert [got["a", k] for k in range(2)] == ["x", "y"] and [got["b", k] for k in range(5)] == ["y"] * 5


def test_hidden_states_are_found_again(spark):
    rng = np.random.default_rng(0)
    state = np.repeat([0, 1, 0, 2, 1, 2], 60)
    mean, cov = np.array([[2.0, 0.0], [0.0, 1.0], [-2.0, 0.5]]), [np.array([[1, 0.8], [0.8, 1]]), np.array([[0.3, 0], [0, 0.3]]), np.array([[1, -0.7], [-0.7, 1]])]
    x = np.array([rng.multivariate_normal(mean[s], cov[s]) for s in state])
    made = walkforward.HiddenMarkov(3).fit(x)
    assert all(b >= a - 1e-8 for a, b in zip(made.gains, made.gains[1:])) and len(made.gains) > 3
    order = np.argsort(-made.mean[:, 0])
    assert (np.argsort(order)[made.path(x)] == state).mean() > 0.97
    np.testing.assert_allclose(made.cov[order], cov, atol=0.35)
    days = pd.date_range("1980-01-31", periods=len(x), freq="ME").date
    rows = [("long", d, float(a), float(b)) for d, (a, b) in zip(days, x)] + [("short", d, float(a), 0.0) for d, (a, _) in zip(days[:40], x)] + [("long", days[0], None, 1.0)]
    got = walkforward.hidden_states(spark.createDataFrame(rows, "series string, ts date, ret double, other double"), 3, columns=("ret", "other")).toPandas().sort_values("ts")
    long, short = got[got.series == "long"], got[got.series == "short"]
    assert (long["state"].to_numpy(int) == state).mean() > 0.97 and set(long["label"]) == {"bull", "consolidation", "bear"}
    spread = pd.Series(x[:40, 0]).rolling(12).std()
    assert short["state"].isna().all() and short["label"].fillna("").tolist() == ["" if np.isnan(v) else "high_volatility" if v > spread.median() else "low_volatility" for v in spread]
