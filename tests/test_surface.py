"""Combinations, importances, made targets, reports, the command line and the exports."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import lodestar
from lodestar import sources
from lodestar.operators import combinations, factor_model, walkforward
from lodestar.plans import reports

DAYS = pd.date_range("2000-01-31", periods=60, freq="ME").date


def test_combinations(spark):
    rng = np.random.default_rng(1)
    x = {s: rng.normal(0.01, 0.03, 60) for s in "abcde"}
    x["e"][50:] = np.nan
    bench = rng.normal(0.005, 0.03, 60)
    ret = spark.createDataFrame([(s, d, None if np.isnan(v) else float(v)) for s, c in x.items() for d, v in zip(DAYS, c)], "series string, ts date, ret double")
    got = {r.combo: r for r in combinations.combination_report(ret, spark.createDataFrame(list(zip(DAYS, map(float, bench))), "ts date, ret double"), 3).collect()}
    assert set(got) == {",".join(c) for c in itertools.combinations("abcde", 3)}
    for c in itertools.combinations("abcde", 3):
        v = np.mean([x[s] for s in c], 0)
        ok = ~np.isnan(v)
        r, total, other = got[",".join(c)], np.prod(1 + v[ok]) - 1, np.prod(1 + bench[ok]) - 1
        vol = v[ok].std(ddof=1) * 12**0.5
        np.testing.assert_allclose([r.n, r.total, r.hit, r.excess, r.info], [ok.sum(), total, (v[ok] > 0).mean(), total - other, (total - other) / vol], rtol=1e-9)


def test_portfolios_by_signal(spark):
    rows = [("a", DAYS[0], 3.0, 0.1), ("b", DAYS[0], 1.0, 0.2), ("c", DAYS[0], -1.0, 0.3), ("a", DAYS[1], -1.0, 0.5), ("b", DAYS[1], -2.0, 0.25), ("a", DAYS[2], None, 0.5)]
    got = {(r.strategy, r.ts): r.ret for r in combinations.by_signal(spark.createDataFrame(rows, "series string, ts date, pred double, ret double"), 1).collect()}
    want = {("top", DAYS[0]): 0.1, ("weighted", DAYS[0]): (3 * 0.1 + 0.2) / 4, ("long_short", DAYS[0]): (0.1 - 0.3) / 2, ("top", DAYS[1]): 0.5, ("weighted", DAYS[1]): 0.0, ("long_short", DAYS[1]): (0.5 - 0.25) / 2}
    assert got == pytest.approx(want)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    y = x @ [0.5, -0.3, 0.0, 0.1] * 0.02 + rng.normal(0, 0.02, 60)
    return spark.createDataFrame([("r", f"g{j % 2}", f"s{j}", d, float(x[t, j]), float(y[t])) for t, d in enumerate(DAYS) for j in range(4)], "run string, grp string, series string, ts date, value double, y double")


def test_importance_has_the_fits_coefficients(spark, panel):
    seen = {}

    def keep(x, y):
        b = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
        return lambda z: b[0] + z @ b[1:] + (0 * seen.setdefault("x", 0))

    flag = spark.createDataFrame([("r", d, "flag", float(k % 2)) for k, d in enumerate(DAYS)], "run string, ts date, name string, value double")
    found = factor_model.forecasts(panel, {"keep": keep, "linear": walkforward.ols}, 40, ahead=True, coefs=True, extra=flag, parts=2)
    out = factor_model.importance(found).collect()
    for m in ("keep", "linear"):
        mine = [r for r in out if r.model == m]
        assert [r.place for r in sorted(mine, key=lambda r: -abs(r.coef))] == list(range(1, len(mine) + 1))
        assert {r.kind for r in mine} == {"factor", "interaction", "regime"} and sum(r.name == "flag" for r in mine) == 1
    by = lambda m: {r.name: r.coef for r in out if r.model == m}
    assert by("keep") == pytest.approx(by("linear"))


def test_made_targets(spark):
    made = sources.synthetic(spark, 50, 2, ("labor", "interest"))
    one, again, other = (sources.synthetic_target(made.repartition(k + 1), name=n).toPandas().set_index("ts")["y"].sort_index() for k, n in enumerate(("index", "index", "sector")))
    assert len(one) == 49 and np.allclose(one, again) and abs(one.corr(other)) < 0.9
    quiet = sources.synthetic_target(made, noise=0.0).toPandas().set_index("ts")["y"].sort_index()
    wide = made.groupBy("ts").pivot("series").agg(F.first("value")).toPandas().set_index("ts").sort_index().iloc[1:]
    fit = np.linalg.lstsq(wide.to_numpy(), quiet.to_numpy(), rcond=None)
    assert np.allclose(wide.to_numpy() @ fit[0], quiet) and (one - quiet).std() == pytest.approx(0.05, rel=0.4)


def test_markdown(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, 0.5), ("a", 1, None)], "name string, n long, x double")
    reports.write_markdown(df, f"file://{tmp_path}/m", ["name"], 2)
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/m").collect()] == ["| name | n | x |", "| --- | --- | --- |", "| a | 1 |  |", "| b | 2 | 0.50 |"]


def test_command_line(spark, panel, tmp_path):
    from lodestar.__main__ import arguments, main

    path, out = f"file://{tmp_path}/panel", f"file://{tmp_path}/out"
    panel.write.parquet(path)
    for _ in range(2):
        main([path, out, "--models", "linear", "ridge", "--window", "40", "--sweep", "--predict-next", "--tier", "standard", "--conviction", "0.2"])
    assert spark.read.parquet(f"{out}/forecasts").count() == 2 * 21
    text = lambda name: [r.value for r in spark.read.text(f"{out}/{name}-latest").collect()]
    assert len(text("accuracy")) == 4 and len(text("sweep")) == 2 + 10 and len(text("costs")) == 4 and len(text("next")) == 4
    with pytest.raises(SystemExit):
        arguments([path, out, "--models", "none"])


def test_exports():
    assert len(lodestar.__all__) > 31 and all(callable(getattr(lodestar, n)) or n == "MODELS" for n in lodestar.__all__)
    with pytest.raises(AttributeError):
        lodestar.nothing
