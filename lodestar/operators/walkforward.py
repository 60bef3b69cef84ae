"""Walk-forward fitting: folds are a table, a fold is fitted in one Arrow group.

Estimators read a matrix and a target; they are plain numpy, since the
panel of one model is a few hundred rows.  Many models, leverages or
universes are many groups, which spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Fit = Callable[[np.ndarray, np.ndarray], Callable[[np.ndarray], np.ndarray]]


def ols(x: np.ndarray, y: np.ndarray):
    b = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
    return lambda z: b[0] + z @ b[1:]


def ridge(alpha: float = 1.0) -> Fit:
    def fit(x, y):
        m = x.mean(0)
        b = np.linalg.solve((x - m).T @ (x - m) + alpha * np.eye(x.shape[1]), (x - m).T @ (y - y.mean()))
        return lambda z: y.mean() + (z - m) @ b

    return fit


def _net(x: np.ndarray, y: np.ndarray, alpha: float, mix: float, b: np.ndarray | None = None, most: int = 2000) -> np.ndarray:
    """Coordinate descent on RSS / 2n + alpha * (mix * |b|_1 + (1 - mix) / 2 * |b|^2), for centred x and y."""
    n = len(x)
    b = np.zeros(x.shape[1]) if b is None else b.copy()
    square, rest = (x * x).sum(0) / n, y - x @ b
    for _ in range(most):
        step = 0.0
        for j in range(len(b)):
            if square[j] == 0:
                continue
            rho = x[:, j] @ rest / n + square[j] * b[j]
            new = np.sign(rho) * max(abs(rho) - alpha * mix, 0) / (square[j] + alpha * (1 - mix))
            if new != b[j]:
                rest += x[:, j] * (b[j] - new)
                step = max(step, abs(new - b[j]))
                b[j] = new
        if step < 1e-9:
            break
    return b


def elastic_net(alpha: float = 0.001, mix: float = 0.5) -> Fit:
    def fit(x, y):
        m, c = x.mean(0), y.mean()
        b = _net(x - m, y - c, alpha, mix)
        return lambda z: c + (z - m) @ b

    return fit


def elastic_net_cv(mix: float = 0.5, alphas=np.logspace(0, -5, 50), folds: int = 5) -> Fit:
    """The penalty with the least error over contiguous folds."""

    def fit(x, y):
        errors = np.zeros(len(alphas))
        for part in np.array_split(np.arange(len(x)), folds):
            rest = np.setdiff1d(np.arange(len(x)), part)
            m, c, b = x[rest].mean(0), y[rest].mean(), None
            for k, a in enumerate(alphas):
                b = _net(x[rest] - m, y[rest] - c, a, mix, b, 200)
                errors[k] += ((y[part] - c - (x[part] - m) @ b) ** 2).sum()
        return elastic_net(alphas[int(np.argmin(errors))], mix)(x, y)

    return fit


def _tree(x, y, depth, leaf, columns, rng, split=2):
    """A regression tree by squared error as nested tuples; a node of under ``split`` rows is a leaf."""
    best = (0.0, None, None)
    if depth and len(y) >= max(split, 2 * leaf):
        for j in rng.choice(x.shape[1], max(1, int(columns * x.shape[1])), replace=False):
            order = np.argsort(x[:, j], kind="stable")
            s, v = np.cumsum(y[order]), x[order, j]
            k = np.arange(leaf, len(y) - leaf + 1)
            k = k[v[k - 1] < v[k]] if len(k) and k[-1] < len(y) else k[:-1][v[k[:-1] - 1] < v[k[:-1]]]
            if len(k):
                gain = s[k - 1] ** 2 / k + (s[-1] - s[k - 1]) ** 2 / (len(y) - k) - s[-1] ** 2 / len(y)
                i = int(np.argmax(gain))
                if gain[i] > best[0] + 1e-12:
                    best = (gain[i], j, (v[k[i] - 1] + v[k[i]]) / 2)
    if best[1] is None:
        return float(y.mean())
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], _tree(x[low], y[low], depth - 1, leaf, columns, rng, split), _tree(x[~low], y[~low], depth - 1, leaf, columns, rng, split)


def _leaf(tree, z):
    while isinstance(tree, tuple):
        tree = tree[2] if z[tree[0]] <= tree[1] else tree[3]
    return tree


def forest(trees: int = 100, depth: int = 5, leaf: int = 10, split: int = 20, seed: int = 42) -> Fit:
    def fit(x, y):
        rng = np.random.default_rng(seed)
        grown = []
        for _ in range(trees):
            i = rng.integers(0, len(y), len(y))
            grown.append(_tree(x[i], y[i], depth, leaf, 1.0, rng, split))
        return lambda z: np.array([np.mean([_leaf(t, r) for t in grown]) for r in z])

    return fit


class Binned:
    """Columns cut at quantiles into at most ``bins`` bins, for splits by histograms."""

    def __init__(self, x: np.ndarray, bins: int):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
        self.width = bins

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, v) for c, v in zip(self.cuts, x.T)]) if x.shape[1] else np.zeros((len(x), 0), int)


def shrunk(g, h, alpha: float, lam: float):
    """The value of a leaf with gradient sum g and second-order sum h: -soft(g, alpha) / (h + lam)."""
    return -np.sign(g) * np.maximum(np.abs(g) - alpha, 0) / (h + lam)


def _worth(g, h, alpha: float, lam: float):
    """What a leaf takes off the penalised loss, twice."""
    return np.maximum(np.abs(g) - alpha, 0) ** 2 / np.maximum(h + lam, 1e-12)


def _grown(codes, g, rows, depth, least, alpha, lam, columns, width):
    """A tree by second-order gain over histograms, as nested tuples; the loss is half the squared error, so h counts rows."""
    total, n = g[rows].sum(), len(rows)
    best = (1e-12, None, None)
    if depth and n >= 2 * least:
        for j in columns:
            sums, counts = np.bincount(codes[rows, j], g[rows], width), np.bincount(codes[rows, j], minlength=width)
            left, h = np.cumsum(sums)[:-1], np.cumsum(counts)[:-1]
            ok = (h >= least) & (n - h >= least)
            gain = np.where(ok, _worth(left, h, alpha, lam) + _worth(total - left, n - h, alpha, lam) - _worth(total, n, alpha, lam), -np.inf)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], j, k)
    if best[1] is None:
        return float(shrunk(total, n, alpha, lam))
    low = codes[rows, best[1]] <= best[2]
    more = (depth - 1, least, alpha, lam, columns, width)
    return best[1], best[2], _grown(codes, g, rows[low], *more), _grown(codes, g, rows[~low], *more)


def _values(tree, codes: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(codes), tree)
    j, k, left, right = tree
    low = codes[:, j] <= k
    out = np.empty(len(codes))
    out[low], out[~low] = _values(left, codes[low]), _values(right, codes[~low])
    return out


def boosting(trees: int = 100, depth: int = 3, rate: float = 0.05, rows: float = 0.8, columns: float = 0.8, least: float = 5, alpha: float = 0.1, lam: float = 1.0, seed: int = 42, bins: int = 64) -> Fit:
    """Gradient boosting with second-order gain, least leaf weight, and L1 and L2 shrinkage of leaves."""

    def fit(x, y):
        rng, base, made = np.random.default_rng(seed), y.mean(), []
        cut = Binned(x, bins)
        codes = cut.codes(x)
        at = np.full(len(y), base)
        for _ in range(trees):
            some = np.sort(rng.choice(len(y), max(2, int(rows * len(y))), replace=False))
            use = np.sort(rng.choice(x.shape[1], max(1, int(columns * x.shape[1])), replace=False))
            t = _grown(codes, at - y, some, depth, least, alpha, lam, use, bins)
            at = at + rate * _values(t, codes)
            made.append(t)
        return lambda z: base + rate * sum(_values(t, cut.codes(z)) for t in made)

    return fit


def oblivious(trees: int = 100, depth: int = 3, rate: float = 0.05, lam: float = 3.0, seed: int = 42, bins: int = 64) -> Fit:
    """Boosted oblivious trees: all nodes of a level share one split.

    The splits are scored on ordered residuals: rows stand in a drawn order, and
    a row's leaf value comes from the rows before it alone, so that no row is
    fitted to its own target.
    """

    def fit(x, y):
        rng, base, made = np.random.default_rng(seed), y.mean(), []
        cut = Binned(x, bins)
        codes = cut.codes(x)
        order = rng.permutation(len(y))
        back = np.argsort(order)
        ordered, plain = np.full(len(y), base), np.full(len(y), base)  # predictions from earlier rows, and from all
        for _ in range(trees):
            leaf, splits, g = np.zeros(len(y), int), [], y - ordered
            for _ in range(depth):
                best = (-np.inf, 0, 0)
                for j in range(x.shape[1]):
                    cells = leaf * bins + codes[:, j]
                    sums = np.bincount(cells, g, (leaf.max() + 1) * bins).reshape(-1, bins).cumsum(1)
                    n = np.bincount(cells, minlength=(leaf.max() + 1) * bins).reshape(-1, bins).cumsum(1)
                    score = (sums**2 / (n + lam) + (sums[:, -1:] - sums) ** 2 / (n[:, -1:] - n + lam)).sum(0)[:-1]
                    k = int(score.argmax())
                    if score[k] > best[0] + 1e-12:
                        best = (score[k], j, k)
                splits.append(best[1:])
                leaf = 2 * leaf + (codes[:, best[1]] > best[2])
            value = np.bincount(leaf, y - plain, 2**depth) / (np.bincount(leaf, minlength=2**depth) + lam)
            mine, r = leaf[order], (y - ordered)[order]
            seen = (mine[:, None] == np.arange(2**depth)) * 1.0
            before, count = np.cumsum(seen * r[:, None], 0) - seen * r[:, None], np.cumsum(seen, 0) - seen
            pick = np.arange(len(y))
            ordered = ordered + rate * (before[pick, mine] / (count[pick, mine] + lam))[back]
            plain = plain + rate * value[leaf]
            made.append((splits, value))

        def predict(z):
            c, out = cut.codes(z), np.full(len(z), base)
            for splits, value in made:
                leaf = np.zeros(len(z), int)
                for j, k in splits:
                    leaf = 2 * leaf + (c[:, j] > k)
                out = out + rate * value[leaf]
            return out

        return predict

    return fit


def network(hidden: tuple[int, int] = (16, 8), alpha: float = 1.0, epochs: int = 1000, seed: int = 42, held: float = 0.15, patience: int = 20) -> Fit:
    """Two tanh layers by Adam; the last rows, a share of ``held``, stop training when they no longer gain."""

    def fit(x, y):
        rng = np.random.default_rng(seed)
        m, s = x.mean(0), x.std(0) + 1e-9
        z, sizes = (x - m) / s, [x.shape[1], *hidden, 1]
        w = [rng.normal(0, sizes[k] ** -0.5, (sizes[k] + 1, sizes[k + 1])) for k in range(3)]
        cut = max(1, int(np.ceil(held * len(z))))
        a, b = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
        best, kept, wait = np.inf, w, 0
        for t in range(1, epochs + 1):
            acts = _forward(z[:-cut], w)
            back = (acts[-1] - y[:-cut, None]) / len(y)
            for k in (2, 1, 0):
                inp = np.column_stack([acts[k], np.ones(len(acts[k]))])
                g = inp.T @ back + alpha * w[k] / len(y)
                back = (back @ w[k][:-1].T) * (1 - acts[k] ** 2) if k else back
                a[k], b[k] = 0.9 * a[k] + 0.1 * g, 0.999 * b[k] + 0.001 * g * g
                w[k] = w[k] - 0.01 * (a[k] / (1 - 0.9**t)) / (np.sqrt(b[k] / (1 - 0.999**t)) + 1e-8)
            error = ((_forward(z[-cut:], w)[-1][:, 0] - y[-cut:]) ** 2).mean()
            best, kept, wait = (error, [v.copy() for v in w], 0) if error < best - 1e-9 else (best, kept, wait + 1)
            if wait > patience:
                break
        return lambda q: _forward((q - m) / s, kept)[-1][:, 0]

    return fit


def _forward(q: np.ndarray, w: list[np.ndarray]) -> list[np.ndarray]:
    out = [q]
    for k, v in enumerate(w):
        h = np.column_stack([out[-1], np.ones(len(out[-1]))]) @ v
        out.append(np.tanh(h) if k < len(w) - 1 else h)
    return out


def ensemble(*fits: Fit) -> Fit:
    def fit(x, y):
        made = [f(x, y) for f in fits]
        return lambda z: np.mean([p(z) for p in made], axis=0)

    return fit


def factors(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and loadings of the first k principal components; of each, the largest loading is positive."""
    m = x.mean(0)
    v = np.linalg.svd(x - m, full_matrices=False)[2][:k]
    v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]
    return m, v.T


def panel_factors(df: DataFrame, k: int = 3, most: int = 2000) -> DataFrame:
    """(ts, factor, score) of df (series, ts, ret): scores of the first k principal components at dates where every series has a value.

    Cross products are summed by Spark; the driver decomposes their matrix,
    one row a series, of which there may be ``most``.  A series counts once a
    date.  The sign of a component is that of its largest loading.  Fewer than
    two such dates have no components.
    """
    df = df.where("ret is not null").groupBy("series", "ts").agg(F.first("ret").alias("ret"))
    names = sorted(r[0] for r in df.select("series").distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"components of over {most} series")
    at = {s: i for i, s in enumerate(names)}
    whole = df.groupBy("ts").agg(F.count("*").alias("c")).where(F.col("c") == len(names)).select("ts")
    df = df.join(whole, "ts", "left_semi")
    a, b = df.select("ts", F.col("series").alias("a"), F.col("ret").alias("x")), df.select("ts", F.col("series").alias("b"), F.col("ret").alias("z"))
    cells = a.join(b, "ts").where("a <= b").groupBy("a", "b").agg(F.covar_samp("x", "z").alias("v"), F.avg("x").alias("m")).collect()
    cov, mean = np.zeros((len(names), len(names))), np.zeros(len(names))
    for r in cells:
        i, j = at[r["a"]], at[r["b"]]
        cov[i, j] = cov[j, i] = np.nan if r["v"] is None else r["v"]
        if i == j:
            mean[i] = r["m"]
    if not cells or np.isnan(cov).any():
        return df.select("ts", F.lit(0).alias("factor"), F.lit(0.0).alias("score")).limit(0)
    v = np.linalg.eigh(cov)[1][:, ::-1][:, :k]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    rows = [(s, j, float(v[i, j]), float(mean[i])) for s, i in at.items() for j in range(v.shape[1])]
    loads = df.sparkSession.createDataFrame(rows, "series string, factor int, load double, mean double")
    return df.join(F.broadcast(loads), "series").groupBy("ts", "factor").agg(F.sum((F.col("ret") - F.col("mean")) * F.col("load")).alias("score"))


def factor_model(final: Fit = ols, k: int = 3, least: float = 0.75) -> Fit:
    """Screening by |t|, scaling by predictive slope, principal components, and a final estimator on them."""

    def fit(x, y):
        s = x.std(0)
        s = np.where(s > 0, s, 1.0)
        z = (x - x.mean(0)) / s
        slope = (z * (y - y.mean())[:, None]).mean(0)
        r = np.clip(slope / (y.std() or 1.0), -0.9999, 0.9999)
        t = np.abs(r * np.sqrt((len(y) - 2) / (1 - r * r)))
        use = t > least if (t > least).any() else t == t.max()
        m, v = factors((z * slope)[:, use], min(k, int(use.sum())))
        to = lambda q: (((q - x.mean(0)) / s * slope)[:, use] - m) @ v
        predict = final(to(x), y)
        return lambda q: predict(to(q))

    return fit


MODELS: dict[str, Fit] = {
    "linear": ols,
    "ridge": ridge(),
    "elastic_net": elastic_net(),
    "elastic_net_cv": elastic_net_cv(),
    "forest": forest(),
    "boosting": boosting(),
    "network": network(),
    "oblivious": oblivious(),
    "ensemble": ensemble(ols, boosting(50, 2, least=10)),
    "factor_linear": factor_model(),
}


def resolved(models: list[str] | Mapping[str, Fit]) -> dict[str, Fit]:
    """Estimators by name: those of MODELS that are listed, or any others that are given."""
    return dict(models) if isinstance(models, Mapping) else {m: MODELS[m] for m in models}


def walk_forward(wide: DataFrame, models: list[str] | Mapping[str, Fit], window: int, step: int = 1, rolling: bool = False, embargo: int = 0, floor_zero: bool = False, parts: int = 8) -> DataFrame:
    """(model, ts, pred, actual, bench, n_train, failed): each model at each fold fitted on the rows before it.

    ``models`` are names, or any functions fit(x, y) that return predict(x).

    wide has ts, y and feature columns; rows with a null are left out.
    ``rolling`` keeps the last ``window`` rows only; ``embargo`` leaves out
    that many rows before the test row, for targets that overlap; the bench
    is the mean of the training rows; a model that raises predicts it, and
    has failed set.  ``floor_zero`` raises negative predictions to 0.  The folds of a model
    are dealt to ``parts`` groups, each with all rows of the panel: nothing is
    broadcast, but the panel of one backtest must fit a task.
    """
    columns = [c for c in wide.columns if c not in ("ts", "y")]
    ready = resolved(models)
    groups = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("part")) for m in ready for k in range(parts)])).alias("g")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        model, part = key
        pdf = pdf.sort_values("ts", kind="stable")
        x, y, out = pdf[columns].to_numpy(float), pdf["y"].to_numpy(float), []
        for fold, t in enumerate(range(window, len(pdf), step)):
            if fold % parts != part:
                continue
            end = max(0, t - embargo)
            start = max(0, end - window) if rolling else 0
            bench = float(y[start:end].mean())
            try:
                pred, failed = float(np.ravel(ready[model](x[start:end], y[start:end])(x[t : t + 1]))[0]), False
            except Exception:
                pred, failed = bench, True
            out.append((model, pdf["ts"].iloc[t], max(0.0, pred) if floor_zero else pred, float(y[t]), bench, end - start, failed))
        return pd.DataFrame(out, columns=["model", "ts", "pred", "actual", "bench", "n_train", "failed"])

    rows = wide.select("ts", "y", *columns).dropna().select("*", groups).select("ts", "y", *columns, "g.*")
    return rows.groupBy("model", "part").applyInPandas(run, "model string, ts date, pred double, actual double, bench double, n_train int, failed boolean")


def _log_normal(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Log densities of rows under each state, by Cholesky factors."""
    out = np.empty((len(x), len(mean)))
    for k in range(len(mean)):
        root = np.linalg.cholesky(cov[k])
        z = np.linalg.solve(root, (x - mean[k]).T)
        out[:, k] = -0.5 * (z * z).sum(0) - np.log(np.diag(root)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
    return out


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


class HiddenMarkov:
    """Gaussian states with full covariances, by expectation and maximisation in logarithms.

    Starts at quantiles of the first column, so the fit is fixed.  ``gains`` holds
    the log likelihood of each round.
    """

    def __init__(self, states: int = 3, rounds: int = 1000, tol: float = 1e-2, ridge: float = 1e-6):
        self.states, self.rounds, self.tol, self.ridge = states, rounds, tol, ridge

    def fit(self, x: np.ndarray) -> HiddenMarkov:
        n, k = x.shape[1], self.states
        order = np.array_split(np.argsort(x[:, 0], kind="stable"), k)
        floor = self.ridge * (np.diag(x.var(0)) + 1e-12 * np.eye(n))
        self.mean = np.array([x[i].mean(0) for i in order])
        self.cov = np.array([np.cov(x.T, bias=True).reshape(n, n) + floor] * k)
        self.start = np.log(np.full(k, 1 / k))
        self.move = np.log(np.full((k, k), 0.1 / max(1, k - 1)) * (1 - np.eye(k)) + np.eye(k) * (0.9 if k > 1 else 1) + 1e-300)
        self.gains: list[float] = []
        for _ in range(self.rounds):
            seen = _log_normal(x, self.mean, self.cov)
            ahead, back = np.empty_like(seen), np.zeros_like(seen)
            ahead[0] = self.start + seen[0]
            for t in range(1, len(x)):
                ahead[t] = seen[t] + _logsum(ahead[t - 1][:, None] + self.move, 0)
            for t in range(len(x) - 2, -1, -1):
                back[t] = _logsum(self.move + seen[t + 1] + back[t + 1], 1)
            self.gains.append(float(_logsum(ahead[-1], 0)))
            share = np.exp(ahead + back - self.gains[-1])
            pairs = np.exp(ahead[:-1, :, None] + self.move + (seen[1:] + back[1:])[:, None, :] - self.gains[-1]).sum(0) + 1e-300
            if len(self.gains) > 1 and self.gains[-1] - self.gains[-2] < self.tol:
                break
            weight = share.sum(0) + 1e-300
            self.start, self.move = np.log(share[0] + 1e-300), np.log(pairs / pairs.sum(1, keepdims=True))
            self.mean = share.T @ x / weight[:, None]
            self.cov = np.array([(share[:, j, None] * (x - self.mean[j])).T @ (x - self.mean[j]) / weight[j] + floor for j in range(k)])
        return self

    def path(self, x: np.ndarray) -> np.ndarray:
        """The likeliest sequence of states."""
        seen = _log_normal(x, self.mean, self.cov)
        score, trace = self.start + seen[0], []
        for t in range(1, len(x)):
            step = score[:, None] + self.move
            trace.append(step.argmax(0))
            score = step.max(0) + seen[t]
        out = [int(score.argmax())]
        for back in reversed(trace):
            out.append(int(back[out[-1]]))
        return np.array(out[::-1])


def hidden_states(df: DataFrame, states: int = 3, rounds: int = 1000, columns: tuple[str, ...] = ("ret",), least: int = 50, window: int = 12) -> DataFrame:
    """(series, ts, state, mean, sd, label): the likeliest path of a Gaussian hidden Markov model over ``columns``, by series.

    States are ordered by the mean of the first column on their rows, 0 the
    highest; mean and sd (ddof 0) are of that column.  label is bull for the
    first state, bear for the last, consolidation between them where there are
    three, else bear or bull by whether a state's sd exceeds the mean of the
    first and last one's.  Rows with a gap are left out.  Under ``least`` rows, or
    where the fit breaks down, state is null and label is high_volatility or
    low_volatility by the median of the rolling spread, null before the window
    is full.  A series must fit a task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=list(columns)).sort_values("ts", kind="stable")
        x = pdf[list(columns)].to_numpy(float)
        out = pdf[["series", "ts"]].assign(state=pd.array([None] * len(pdf), "Int32"), mean=np.nan, sd=np.nan, label=None)
        path = None
        if len(x) >= least:
            try:
                path = HiddenMarkov(states, rounds).fit(x).path(x)
            except np.linalg.LinAlgError:
                path = None
        if path is None:
            spread = pdf[columns[0]].rolling(window).std()
            return out.assign(label=np.where(spread.isna(), None, np.where(spread > spread.median(), "high_volatility", "low_volatility")))
        used = np.unique(path)
        mean = {s: x[path == s, 0].mean() for s in used}
        order = sorted(used, key=lambda s: -mean[s])
        sd = {s: x[path == s, 0].std() for s in used}
        edge = (sd[order[0]] + sd[order[-1]]) / 2

        def label(k):
            if k == 0:
                return "bull"
            if k == len(order) - 1:
                return "bear"
            return "consolidation" if len(order) == 3 else "bear" if sd[order[k]] > edge else "bull"

        place = {s: k for k, s in enumerate(order)}
        return out.assign(state=pd.array([place[s] for s in path], "Int32"), mean=[mean[s] for s in path], sd=[sd[s] for s in path], label=[label(place[s]) for s in path])

    return df.select("series", "ts", *columns).groupBy("series").applyInPandas(run, "series string, ts date, state int, mean double, sd double, label string").withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("mean", "sd")})
