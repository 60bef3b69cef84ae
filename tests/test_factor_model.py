"""The composed forecast against a plain version fold by fold, injected models, and boosting against closed forms."""

import numpy as np
import pandas as pd
import pytest

from lodestar.operators import factor_model, walkforward

KIND = "run string, grp string, series string, ts date, value double, y double"


def made(n=70, seed=4):
    """Three groups with a late starter, gaps, a constant series and one that never has ten values."""
    rng = np.random.default_rng(seed)
    days = pd.date_range("2001-01-31", periods=n, freq="ME").date
    base = rng.normal(0, 1, (n, 2)).cumsum(0)
    x = {("a", f"a{k}"): base[:, k % 2] * (k + 1) + rng.normal(0, 1, n) for k in range(4)} | {("b", f"b{k}"): rng.normal(0, 1, n) for k in range(3)} | {("c", "c0"): np.ones(n), ("c", "c1"): rng.normal(0, 1, n)}
    x["a", "a3"][:35] = np.nan
    x["b", "b1"][rng.integers(20, n, 6)] = np.nan
    x["c", "c1"][8:] = np.nan
    y = 0.3 * np.roll(base[:, 0], 1) + rng.normal(0, 1, n)
    y[5] = y[-1] = np.nan
    return days, x, y


def table(spark, days, x, y, run="r", skip=True):
    rows = [(run, g, s, d, None if np.isnan(v) else float(v), None if np.isnan(t) else float(t)) for (g, s), c in x.items() for d, v, t in zip(days, c, y)]
    return spark.createDataFrame([r for r in rows if not skip or r[4] is not None or r[2] == "a0"], KIND)


def plain(x, y, t, least=0.75, k=10, window=12):
    """Prediction of row t by least squares from the rows before it, step by step."""
    kept, yy = [], y[:t]
    for g in sorted({g for g, _ in x}):
        names = [s for s in sorted(x) if s[0] == g and (~np.isnan(x[s][:t])).sum() >= min(10, t)]
        if not names:
            continue
        m = np.column_stack([x[s][:t] for s in names])
        ok = ~np.isnan(m).any(1) & ~np.isnan(yy)
        stat = np.zeros(len(names))
        if ok.sum() >= 10:
            for j in range(len(names)):
                if m[ok, j].std() > 0:
                    r = np.clip(np.corrcoef(m[ok, j], yy[ok])[0, 1], -0.9999, 0.9999)
                    stat[j] = r * np.sqrt((ok.sum() - 2) / (1 - r * r))
        strong = np.abs(stat) > least
        kept += [s for s, u in zip(names, strong if strong.any() else np.arange(len(names)) == np.abs(stat).argmax()) if u]
    z, row = np.empty((t, len(kept))), np.empty(len(kept))
    for j, s in enumerate(kept):
        c = x[s][:t]
        mean, sd = np.nanmean(c), np.nanstd(c) or 1.0
        u = (c - mean) / sd
        both = ~np.isnan(u) & ~np.isnan(yy)
        slope = np.mean(u[both] * (yy[both] - yy[both].mean())) if both.sum() >= 3 else 1.0
        z[:, j], row[j] = u * slope, (x[s][t] - mean) / sd * slope
    whole = ~np.isnan(z).any(1)
    centre = z[whole].mean(0)
    vec = np.linalg.svd(z[whole] - centre)[2][: min(k, len(kept))].T
    f = pd.DataFrame((z - centre) @ vec).ffill().to_numpy()
    vol = pd.Series(yy).rolling(window).std().to_numpy()
    known = vol[~np.isnan(vol)]
    p = np.array([(known < v).sum() / len(known) for v in vol])
    f, q = np.nan_to_num(f), np.nan_to_num((row - centre) @ vec)
    d = np.column_stack([np.ones(t), f, f * p[:, None]])
    ok = ~np.isnan(yy)
    b = np.linalg.lstsq(d[ok], yy[ok], rcond=None)[0]
    return b[0] + np.r_[q, q * p[-1]] @ b[1:], len(kept), ok.sum()


def test_forecasts_equal_the_plain_version(spark):
    days, x, y = made()
    df = table(spark, days, x, y).unionByName(table(spark, days, x, np.roll(y, 3), "other"))
    got = {(r.run, r.ts): r for r in factor_model.forecasts(df, ["linear"], 30, step=2, parts=3).collect()}
    assert len(got) == 40
    for run, target in (("r", y), ("other", np.roll(y, 3))):
        for t in range(30, 70, 2):
            pred, kept, n = plain(x, target, t)
            r = got[run, days[t]]
            assert r.n_kept == kept and r.n_train == n and not r.failed
            np.testing.assert_allclose([r.pred, r.bench], [pred, np.nanmean(target[:t])], rtol=1e-7)
    ahead = [r for r in factor_model.forecasts(df.where("run = 'r'"), ["linear"], 30, ahead=True).collect() if r.ahead]
    last = {s: np.append(c, c[-1]) for s, c in x.items()}
    np.testing.assert_allclose([r.pred for r in ahead], [plain(last, y, 70)[0]], rtol=1e-7)


def test_short_and_failing_fits_predict_the_mean(spark):
    days, x, y = made(40)

    class Own:
        def __call__(self, a, b):
            return lambda z: z[:, 0] * 0 + 7.0

    def broken(a, b):
        raise RuntimeError("no fit")

    got = factor_model.forecasts(table(spark, days, x, y), {"own": Own(), "broken": broken}, 15, parts=2).collect()
    for r in got:
        t = days.tolist().index(r.ts)
        short = (~np.isnan(y[:t])).sum() < 20
        assert r.pred == pytest.approx(np.nanmean(y[:t])) if short or r.model == "broken" else r.pred == 7.0
        assert r.failed == (r.model == "broken" and not short)
    counted = {r.model: (r.folds, r.failed) for r in factor_model.failures(factor_model.forecasts(table(spark, days, x, y), {"own": Own(), "broken": broken}, 25, parts=2)).collect()}
    assert counted == {"own": (15, 0), "broken": (15, 15)}
    wide = spark.createDataFrame([(d, float(k), float(k % 5)) for k, d in enumerate(days)], "ts date, y double, x double")
    seen = walkforward.walk_forward(wide, {"own": Own(), "broken": broken}, 30, parts=2).collect()
    assert len(seen) == 20 and all(r.pred == (r.bench if r.failed else 7.0) and r.failed == (r.model == "broken") for r in seen)
    assert factor_model.forecasts(spark.createDataFrame([], KIND), ["linear"], 10).count() == 0


def test_extra_columns_of_the_last_training_row(spark):
    days, x, y = made(50)
    flag = spark.createDataFrame([("r", d, "flag", float(k % 3 == 0)) for k, d in enumerate(days)], "run string, ts date, name string, value double")
    taken = lambda a, b: lambda z: z[:, -1]
    got = factor_model.forecasts(table(spark, days, x, y), {"flag": taken}, 30, extra=flag, parts=2).collect()
    assert len(got) == 20 and all(r.pred == float((days.tolist().index(r.ts) - 1) % 3 == 0) for r in got)


def test_components_pad_and_cut():
    rng = np.random.default_rng(0)
    made = factor_model.Components(rng.normal(size=(30, 3)), 5)
    z = rng.normal(size=(4, 3))
    np.testing.assert_allclose(made.of(np.column_stack([z, z])), made.of(z))
    np.testing.assert_allclose(made.of(z[:, :2]), made.of(np.column_stack([z[:, :2], np.zeros(4)])))
    assert made.scores.shape[1] == 3 and np.isnan(factor_model.Components(np.full((5, 2), np.nan), 2).of(z[:, :2])).all()


def test_boosting_against_closed_forms():
    x, y = np.array([[0.0]] * 10 + [[1.0]] * 10), np.r_[np.zeros(10), np.ones(10) * 3] + 1
    one = walkforward.boosting(1, 1, 1.0, 1.0, 1.0, least=1, alpha=0.0, lam=2.0)(x, y)
    np.testing.assert_allclose(one(np.array([[0.0], [1.0]])), y.mean() + np.array([-15, 15]) / 12)  # sums of residuals over n + lam
    two = walkforward.boosting(1, 1, 1.0, 1.0, 1.0, least=1, alpha=5.0, lam=0.0)(x, y)
    np.testing.assert_allclose(two(np.array([[0.0], [1.0]])), y.mean() + np.array([-10, 10]) / 10)  # sums less alpha
    assert walkforward.boosting(1, 1, 1.0, 1.0, 1.0, least=11)(x, y)(x[:1])[0] == pytest.approx(y.mean())  # no leaf may be that small
    flat = walkforward.oblivious(1, 1, 1.0, lam=3.0)(x, y)
    np.testing.assert_allclose(flat(np.array([[0.0], [1.0]])), y.mean() + np.array([-15, 15]) / 13)
    rng = np.random.default_rng(2)
    a = rng.uniform(-2, 2, (400, 3))
    b = np.where(a[:, 0] > 0, 1.0, -1.0) * np.where(a[:, 1] > 0.5, 2.0, 1.0) + rng.normal(0, 0.1, 400)
    for fit in (walkforward.boosting(), walkforward.oblivious(), walkforward.forest()):
        p = fit(a[:300], b[:300])
        assert ((p(a[300:]) - b[300:]) ** 2).mean() < 0.2 * b[300:].var()
        np.testing.assert_array_equal(p(a[300:]), fit(a[:300], b[:300])(a[300:]))
