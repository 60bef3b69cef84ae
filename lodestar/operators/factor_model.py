"""The composed forecast: screening by group, scaling by predictive slope, components, regime interactions, a final estimator.

Spark makes one table of fold states for all folds of all runs: which series
each fold keeps, with their t, mean, spread and slope, all by windows over
the rows before the fold.  The folds are then dealt to groups; a group gets
the panel and its folds' states, and does what needs a matrix: components,
interactions and the final fit.  A run is one backtest (a target, a universe,
a horizon); its panel must fit a task.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import by, correlation
from .screening import t_of
from .walkforward import Fit, factors, resolved


def numbered(df: DataFrame, ahead: bool = False) -> DataFrame:
    """df (run, grp, series, ts, value, y) on the full grid of each run's dates and series, with rn, the date's number from 0.

    ``ahead`` adds the last date once more, as a row to predict that trains on
    all rows.  Of repeated rows of a series and date one counts; y is the
    date's.
    """
    dates = df.groupBy("run", "ts").agg(F.max("y").alias("y")).withColumn("rn", F.row_number().over(by("run")) - 1)
    if ahead:
        last = dates.withColumn("_n", F.max("rn").over(Window.partitionBy("run"))).where("rn = _n").select("run", "ts", F.lit(None).cast("double").alias("y"), (F.col("rn") + 1).alias("rn"))
        dates = dates.unionByName(last)
    names = df.select("run", "grp", "series").distinct()
    cells = df.groupBy("run", "grp", "series", "ts").agg(F.max("value").alias("value"))
    return dates.join(names, "run").join(cells, ["run", "grp", "series", "ts"], "left").select("run", "grp", "series", "rn", "ts", "value", "y")


def fold_states(grid: DataFrame, window: int, step: int = 1, least: float = 0.75, rows: int = 10) -> DataFrame:
    """(run, rn, grp, series, n, t, mean, spread, slope, kept) of each fold, from the rows before it; grid is ``numbered``.

    A fold considers a group's series that have ``rows`` values by then.  t
    comes from the dates at which all of these and y have a value; below
    ``rows`` such dates it is 0.  Kept are those with |t| over ``least``, else
    the group's best.  mean and spread (ddof 0, 1 where it is 0) are those of the
    series' own values, slope that of y on the standardised value, 1 below
    three pairs.

    The series that a group considers change only when one of them gets its
    tenth value.  Between two such dates the sums run on in one window.
    """
    some = F.col("value").isNotNull()
    order = Window.partitionBy("run", "grp", "series").orderBy("rn")
    enters = grid.where(some).withColumn("k", F.row_number().over(order)).where(F.col("k") == rows).select("run", "grp", "series", F.greatest(F.col("rn") + 1, F.lit(window)).alias("enters"))
    spans = enters.select("run", "grp", F.col("enters").alias("start")).distinct()
    spans = spans.withColumn("stop", F.lead("start").over(Window.partitionBy("run", "grp").orderBy("start")))
    members = spans.join(enters, ["run", "grp"]).where("enters <= start").drop("enters")
    # each span's dates with the series it considers, up to its last fold
    cells = grid.join(members, ["run", "grp", "series"]).where("stop IS NULL OR rn < stop")
    whole = Window.partitionBy("run", "grp", "start", "rn")
    cells = cells.withColumn("all", (F.count("value").over(whole) == F.count("*").over(whole)) & F.col("y").isNotNull())
    before = Window.partitionBy("run", "grp", "start", "series").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    x, y = F.when(F.col("all"), F.col("value")), F.when(F.col("all"), F.col("y"))
    pair = F.when(some & F.col("y").isNotNull(), F.col("value"))
    cells = cells.select(
        "run", "rn", "grp", "start", "series", F.count(x).over(before).alias("n"), correlation(x, y, before).alias("r"), F.avg("value").over(before).alias("mean"),
        F.stddev_pop("value").over(before).alias("spread"), F.count(pair).over(before).alias("pairs"), F.covar_pop(pair, F.col("y")).over(before).alias("slope"),
    ).where((F.col("rn") >= F.col("start")) & (F.pmod(F.col("rn") - window, F.lit(step)) == 0))
    cells = cells.withColumn("t", F.when(F.col("n") >= rows, F.coalesce(t_of(F.col("r"), F.col("n")), F.lit(0.0))).otherwise(0.0))
    cells = cells.withColumn("spread", F.when(F.col("spread") > 0, F.col("spread")).otherwise(1.0)).withColumn("slope", F.when(F.col("pairs") >= 3, F.col("slope") / F.col("spread")).otherwise(1.0))
    group = Window.partitionBy("run", "grp", "rn")
    strong = F.abs("t") > least
    best = F.row_number().over(group.orderBy(F.abs("t").desc(), "series")) == 1
    return cells.withColumn("kept", strong | (best & (F.max(strong.cast("int")).over(group) == 0))).select("run", "rn", "grp", "series", "n", "t", "mean", "spread", "slope", "kept")


def scaled(x: np.ndarray, mean: np.ndarray, spread: np.ndarray, slope: np.ndarray) -> np.ndarray:
    return (x - mean) / spread * slope


def fitted_width(x: np.ndarray, width: int) -> np.ndarray:
    """Columns of zeros added, or the last ones left out, until there are ``width``."""
    return np.pad(x, ((0, 0), (0, max(0, width - x.shape[1]))))[:, :width]


class Components:
    """Principal components of complete rows; rows with a gap take the scores of the last complete row before."""

    def __init__(self, x: np.ndarray, k: int):
        whole = ~np.isnan(x).any(1)
        self.width = x.shape[1]
        k = min(k, self.width)
        self.usable = int(whole.sum()) >= max(k, 1)
        self.scores = np.full((len(x), k), np.nan)
        if self.usable:
            self.mean, self.loadings = factors(x[whole], k)
            self.scores[whole] = (x[whole] - self.mean) @ self.loadings
            self.centre = self.scores[whole].mean(0)
            at = np.maximum.accumulate(np.where(whole, np.arange(len(x)), -1))
            self.scores = np.where(at[:, None] >= 0, self.scores[at], np.nan) - self.centre

    def of(self, x: np.ndarray) -> np.ndarray:
        """Centred scores of other rows; a row with a gap has none."""
        if not self.usable:
            return np.full((len(x), self.scores.shape[1]), np.nan)
        return (fitted_width(x, self.width) - self.mean) @ self.loadings - self.centre


def regime_ranks(y: np.ndarray, window: int = 12) -> np.ndarray:
    """The share of all rolling spreads of y strictly below each date's own; 0 before the first, 0.5 where there is none at all."""
    spread = pd.Series(y).rolling(window).std().to_numpy()
    known = np.sort(spread[~np.isnan(spread)])
    if not len(known):
        return np.full(len(y), 0.5)
    return np.where(np.isnan(spread), 0.0, np.searchsorted(known, spread) / len(known))


def with_interactions(scores: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Scores and their products with the regime's rank; gaps are 0."""
    scores = np.nan_to_num(scores)
    return np.concatenate([scores, scores * rank[:, None]], axis=1)


def forecasts(df: DataFrame, models: list[str] | Mapping[str, Fit], window: int, step: int = 1, least: float = 0.75, k: int = 10, regime_window: int = 12, rows: int = 20, floor_zero: bool = False, ahead: bool = False, parts: int | None = None, extra: DataFrame | None = None, coefs: bool = False) -> DataFrame:
    """(run, model, ts, ahead, pred, actual, bench, n_train, n_kept, n_factors, failed) of each model at each fold.

    df is (run, grp, series, ts, value, y).  ``models`` are names, or any
    functions fit(x, y) that return predict(x); they are shipped to the
    workers.  A model that raises predicts the training mean and has failed
    set.  Under ``rows`` training rows with a y, or with no series kept, the mean
    is predicted too, and failed is not set.  ``extra`` (run, ts, name, value)
    are columns for the final fit alone, such as regime flags: the row to
    predict takes those of the last training row; gaps are 0.  ``coefs`` adds
    terms, an array of (name, kind, coef) of what a prediction gains by one
    unit more of each column of the final fit: its coefficients where it is
    linear.
    """
    ready = resolved(models)
    grid = numbered(df, ahead)
    parts = parts or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    part = F.pmod(F.floor((F.col("rn") - window) / step), F.lit(parts)).cast("int").alias("part")
    states = fold_states(grid, window, step, least).where("kept").select(F.col("run").alias("run"), part, *(F.col(c).alias(c) for c in ("rn", "series", "mean", "spread", "slope")))
    cells = grid.select("run", "rn", "ts", "y", "series", "value", F.lit(None).cast("string").alias("name"))
    if extra is not None:
        when = grid.groupBy("run", "ts").agg(F.min("rn").alias("rn"))
        cells = cells.unionByName(extra.join(when, ["run", "ts"]).select("run", "rn", "ts", F.lit(None).cast("double").alias("y"), F.lit(None).cast("string").alias("series"), "value", "name"))
    cells = cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    columns = ["run", "model", "ts", "ahead", "pred", "actual", "bench", "n_train", "n_kept", "n_factors", "failed", *["terms"][: int(coefs)]]
    more_names = sorted(r[0] for r in extra.select("name").distinct().collect()) if coefs and extra is not None else []  # columns, not rows

    def terms(predict, width: int, k: int) -> list[tuple[str, str, float]]:
        gain = np.ravel(predict(np.eye(width))) - np.ravel(predict(np.zeros((1, width))))
        names = [(f"factor_{j}", "factor") for j in range(k)] + [(f"factor_{j}_interaction", "interaction") for j in range(k)] + [(n, "regime") for n in more_names]
        return [(n, kind, float(g)) for (n, kind), g in zip(names, gain)]

    def run(key, panel: pd.DataFrame, folds: pd.DataFrame) -> pd.DataFrame:
        out = []
        main = panel[panel["name"].isna()]
        if not len(main):
            return pd.DataFrame(out, columns=columns)
        wide = main.pivot(index="rn", columns="series", values="value").sort_index()
        days = main.drop_duplicates("rn").set_index("rn").sort_index()
        x, y, ts = wide.to_numpy(float), days["y"].to_numpy(float), days["ts"].to_numpy()
        more = panel[panel["name"].notna()]
        more = more.pivot(index="rn", columns="name", values="value").reindex(wide.index).fillna(0.0).to_numpy(float) if len(more) else np.zeros((len(x), 0))
        last = len(x) - 1
        at = {s: j for j, s in enumerate(wide.columns)}
        states = dict(list(folds.groupby("rn")))
        for t in range(window, len(x), step):
            if (t - window) // step % parts != key[1]:
                continue
            state, known = states.get(t), ~np.isnan(y[:t])
            bench = float(y[:t][known].mean()) if known.any() else 0.0
            head = (key[0], ts[t], bool(ahead and t == last))
            tail = (float(y[t]), bench, int(known.sum()), 0 if state is None else len(state))
            if state is None or known.sum() < rows:
                out += [(head[0], m, *head[1:], bench, *tail, 0, False, *[[]][: int(coefs)]) for m in ready]
                continue
            use = [at[s] for s in state["series"]]
            figures = [state[c].to_numpy(float) for c in ("mean", "spread", "slope")]
            made = Components(scaled(x[:t][:, use], *figures), k)
            rank = regime_ranks(y[:t], regime_window)
            train = np.concatenate([with_interactions(made.scores, rank), more[:t]], axis=1)
            test = np.concatenate([with_interactions(made.of(scaled(x[t : t + 1][:, use], *figures)), rank[-1:]), more[t - 1 : t]], axis=1)
            for m, fit in ready.items():
                failed, told = False, []
                try:
                    predict = fit(train[known], y[:t][known])
                    pred = float(np.ravel(predict(test))[0])
                    told = terms(predict, train.shape[1], made.scores.shape[1]) if coefs else told
                except Exception:
                    pred, failed = bench, True
                out.append((head[0], m, *head[1:], max(0.0, pred) if floor_zero and not failed else pred, *tail, made.scores.shape[1], failed, *[told][: int(coefs)]))
        return pd.DataFrame(out, columns=columns)

    got = cells.groupBy("run", "part").cogroup(states.groupBy("run", "part"))
    return got.applyInPandas(run, "run string, model string, ts date, ahead boolean, pred double, actual double, bench double, n_train int, n_kept int, n_factors int, failed boolean" + ", terms array<struct<name: string, kind: string, coef: double>>" * coefs)


def importance(found: DataFrame) -> DataFrame:
    """(run, model, place, name, kind, coef) of each run's and model's last fold, strongest first; found has terms."""
    last = found.withColumn("k", F.row_number().over(Window.partitionBy("run", "model").orderBy(F.col("ts").desc(), F.col("ahead").desc()))).where("k = 1")
    one = last.select("run", "model", F.inline("terms"))
    return one.withColumn("place", F.row_number().over(Window.partitionBy("run", "model").orderBy(F.abs("coef").desc(), "name")))


def failures(found: DataFrame) -> DataFrame:
    """How many folds of each run and model there are, and how many failed."""
    return found.groupBy("run", "model").agg(F.count("*").alias("folds"), F.sum(F.col("failed").cast("int")).alias("failed"))
