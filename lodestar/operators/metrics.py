"""Accuracy, risk and significance of forecasts and returns, by group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kurtosis, skewness


def curve(df: DataFrame, keys: list[str], ret: str = "ret") -> DataFrame:
    """df with equity, peak and drawdown; the peak starts at the first equity."""
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("equity", F.product(1 + F.coalesce(F.col(ret), F.lit(0.0))).over(w))
    df = df.withColumn("peak", F.max("equity").over(w))
    return df.withColumn("drawdown", (F.col("peak") - F.col("equity")) / F.col("peak"))


def _calmar(annual: Column, r: Column) -> Column:
    """A year's return over the worst drawdown; without one, infinity or 0 by the sign of the mean."""
    worst = F.max("drawdown")
    return F.when(worst == 0, F.when(F.avg(r) > 0, float("inf")).otherwise(0.0)).otherwise(F.try_divide(annual, worst))


def risk(df: DataFrame, keys: list[str], ret: str = "ret", year: int = 12, rf: float = 0.0) -> DataFrame:
    """One row a key: totals, Sharpe, Sortino, Calmar, drawdown and its duration, tails and moments."""
    c = curve(df.where(F.col(ret).isNotNull()), keys, ret)
    rn = Window.partitionBy(*keys).orderBy("ts")
    c = c.withColumn("rn", F.row_number().over(rn)).withColumn("x", F.col(ret) - rf / year)
    top = F.max(F.when(F.col("equity") == F.col("peak"), F.col("rn"))).over(rn.rowsBetween(Window.unboundedPreceding, 0))
    c = c.withColumn("since", F.col("rn") - top + 1)
    r = F.col(ret)
    q = F.percentile(ret, F.array(F.lit(0.05), F.lit(0.95)))
    down = F.stddev_samp(F.when(F.col("x") < 0, F.col("x")))
    total = F.product(1 + r) - 1
    annual = F.pow(1 + total, year / F.count(r)) - 1
    return c.groupBy(*keys).agg(
        F.count(r).alias("n"),
        total.alias("total"),
        annual.alias("annual"),
        (F.stddev_samp(r) * math.sqrt(year)).alias("vol"),
        F.coalesce(F.try_divide(F.avg("x"), F.stddev_samp("x")) * math.sqrt(year), F.lit(0.0)).alias("sharpe"),
        F.when((F.count(F.when(F.col("x") < 0, 1)) == 0) | (down == 0), F.when(F.avg("x") > 0, float("inf")).otherwise(0.0)).otherwise(F.try_divide(F.avg("x"), down) * math.sqrt(year)).alias("sortino"),
        F.max("drawdown").alias("max_dd"),
        F.max_by("since", F.struct("drawdown", -F.col("rn"))).alias("dd_rows"),
        _calmar(annual, r).alias("calmar_geo"),
        _calmar(F.avg(r) * year, r).alias("calmar_arith"),
        F.when(F.count(r) >= 20, F.abs(F.try_divide(q[1], q[0]))).alias("tail"),
        skewness(r).alias("skew"),
        kurtosis(r).alias("kurt"),
    )


def accuracy(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key of actual, pred and bench: R2 against bench, errors and hits by side."""
    a, p, b = F.col("actual"), F.col("pred"), F.col("bench")
    hit = F.signum(a) == F.signum(p)
    share = lambda c: F.coalesce(F.avg(F.when(c, hit.cast("double"))), F.lit(0.0))
    return df.where("actual is not null and pred is not null and bench is not null").groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.coalesce(1 - F.try_divide(F.sum((a - p) * (a - p)), F.sum((a - b) * (a - b))), F.lit(0.0)).alias("r2"),
        F.avg((a - p) * (a - p)).alias("mse"),
        F.avg(F.abs(a - p)).alias("mae"),
        F.avg(F.abs(F.try_divide(a - p, F.when(a != 0, a)))).alias("mape"),
        F.avg(hit.cast("double")).alias("hit"),
        F.count(F.when(p > 0, 1)).alias("n_pos"),
        F.count(F.when(p < 0, 1)).alias("n_neg"),
        share(p > 0).alias("pos_hit"),
        share(p < 0).alias("neg_hit"),
    )


def _normal(z: str) -> str:
    z = f"({z})"
    series = f"aggregate(sequence(1, 120), named_struct('t', cast({z} as double), 's', cast({z} as double)), (a, k) -> named_struct('t', a.t * {z} * {z} / (2 * k + 1), 's', a.s + a.t * {z} * {z} / (2 * k + 1)), a -> a.s)"
    return f"CASE WHEN {z} > 8 THEN 1D WHEN {z} < -8 THEN 0D ELSE 0.5D + exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {series} END"


def normal_cdf(z: str) -> Column:
    """SQL column to the normal distribution function, by its series; beyond 8 it is 0 or 1 to 15 places."""
    return F.expr(_normal(z))


def _student(t: str, df: str) -> str:
    t, df = f"({t})", f"({df})"
    angle, n = f"atan({t} / sqrt({df}))", f"cast({df} as int)"
    square = f"({df} / ({df} + {t} * {t}))"  # cos of the angle, squared
    even = f"aggregate(sequence(1, greatest({n} div 2, 1)), named_struct('c', 1D, 's', 0D), (a, k) -> named_struct('c', a.c * (2 * k - 1) / (2 * k) * {square}, 's', a.s + a.c), a -> a.s)"
    odd = f"aggregate(sequence(1, greatest(({n} - 1) div 2, 1)), named_struct('c', 1D, 's', 0D), (a, k) -> named_struct('c', a.c * (2 * k) / (2 * k + 1) * {square}, 's', a.s + a.c), a -> a.s)"
    inner = f"CASE WHEN {n} % 2 = 0 THEN sin({angle}) * {even} WHEN {n} = 1 THEN 2 / pi() * {angle} ELSE 2 / pi() * ({angle} + sin({angle}) * cos({angle}) * {odd}) END"
    return f"CASE WHEN {n} >= 1 THEN 0.5D + ({inner}) / 2 END"


def student_cdf(t: str, df: str) -> Column:
    """SQL columns to Student's distribution function for whole degrees of freedom, by the finite sums of its two cases; null below 1."""
    return F.expr(_student(t, df))


def _bisected(low: str, high: str, less: str, out: str) -> str:
    """SQL of 64 halvings of (low, high): ``less`` tells of a.m whether the place sought is above it; ``out`` makes the result of a.m."""
    return f"aggregate(sequence(1, 64), named_struct('lo', cast({low} as double), 'hi', cast({high} as double), 'm', (cast({low} as double) + {high}) / 2), (q, j) -> transform(array(named_struct('up', {less.replace('a.m', 'q.m')}, 'lo', q.lo, 'hi', q.hi, 'm', q.m)), h -> named_struct('lo', if(h.up, h.m, h.lo), 'hi', if(h.up, h.hi, h.m), 'm', (if(h.up, h.m, h.lo) + if(h.up, h.hi, h.m)) / 2))[0], q -> {out.replace('a.m', 'q.m')})"


def normal_ppf(p: str) -> Column:
    """SQL column to the normal quantile of a share; null outside (0, 1). The lower half is sought and mirrored, where the sums lose no places."""
    tail = f"least({p}, 1 - {p})"
    found = _bisected("-9D", "0D", f"{_normal('a.m')} < {tail}", "a.m")
    return F.expr(f"CASE WHEN {p} > 0 AND {p} < 1 THEN CASE WHEN {p} = 0.5D THEN 0D WHEN {p} < 0.5D THEN {found} ELSE -{found} END END")


def student_ppf(p: str, df: str) -> Column:
    """SQL columns to Student's quantile for whole degrees of freedom, sought by angle, so that no bracket is too narrow; null outside (0, 1) or below 1."""
    tail = f"least({p}, 1 - {p})"
    found = _bisected("-pi() / 2", "0D", f"{_student(f'tan(a.m) * sqrt({df})', df)} < {tail}", f"tan(a.m) * sqrt({df})")
    return F.expr(f"CASE WHEN {p} > 0 AND {p} < 1 AND {df} >= 1 THEN CASE WHEN {p} = 0.5D THEN 0D WHEN {p} < 0.5D THEN {found} ELSE -{found} END END")


def r2_interval(df: DataFrame, keys: list[str], level: float = 0.95) -> DataFrame:
    """(n, r2, low, high) of an out-of-sample R2 by its asymptotic error 2 |1 - R2| / sqrt(n); at -10 or less the error is 2 |R2| / sqrt(n), and high is 1 at most."""
    out = accuracy(df, keys).select(*keys, "n", "r2").withColumn("z", normal_ppf(f"{(1 + level) / 2!r}D"))
    se = F.when(F.col("r2") >= 1, 0.0).when(F.col("r2") <= -10, 2 * F.abs("r2") / F.sqrt("n")).otherwise(2 * F.abs(1 - F.col("r2")) / F.sqrt("n"))
    return out.withColumn("low", F.col("r2") - F.col("z") * se).withColumn("high", F.least(F.col("r2") + F.col("z") * se, F.lit(1.0))).drop("z")


def adjusted_r2(df: DataFrame, keys: list[str], predictors: int = 1) -> DataFrame:
    """(n, r2, r2_adj) against the mean of actual, not against bench; r2 is 0 where actual is constant, r2_adj null without degrees of freedom."""
    a, p = F.col("actual"), F.col("pred")
    r2 = F.coalesce(1 - F.try_divide(F.sum((a - p) * (a - p)), F.var_pop("actual") * F.count("*")), F.lit(0.0))
    out = df.where("actual is not null and pred is not null").groupBy(*keys).agg(F.count("*").alias("n"), r2.alias("r2"))
    return out.withColumn("r2_adj", 1 - F.try_divide((1 - F.col("r2")) * (F.col("n") - 1), F.col("n") - predictors - 1))


def dm_yield(df: DataFrame, keys: list[str], h: int = 1) -> DataFrame:
    """(n, dm, p) of squared errors of bench less those of pred, with the horizon's small-sample factor; (0, 1) where they don't vary."""
    d = (F.col("actual") - F.col("bench")) ** 2 - (F.col("actual") - F.col("pred")) ** 2
    k = F.sqrt(F.count("*") + 1 - 2 * h + F.lit(h * (h + 1) / 3))
    out = df.withColumn("d", d).where("d is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.try_divide(F.avg("d") * k, F.stddev_pop("d")), F.lit(0.0)).alias("dm"))
    return out.withColumn("p", 2 * (1 - normal_cdf("abs(dm)")))


def trading(df: DataFrame, keys: list[str], year: int = 12) -> DataFrame:
    """One row a key of sign(pred) * actual: hits in per cent and by side, sum, yearly mean, deviation (ddof 0) and Sharpe, and R2 against the mean."""
    a, p = F.col("actual"), F.col("pred")
    df = df.where("actual is not null and pred is not null").withColumn("pnl", F.signum(p) * a)
    side = lambda c, s: 100 * F.coalesce(F.avg(F.when(c, (F.signum(a) == s).cast("double"))), F.lit(0.0))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        (100 * F.avg((F.signum(p) == F.signum(a)).cast("double"))).alias("hit"),
        F.count(F.when(p > 0, 1)).alias("n_pos"),
        F.count(F.when(p < 0, 1)).alias("n_neg"),
        side(p > 0, 1).alias("pos_hit"),
        side(p < 0, -1).alias("neg_hit"),
        F.sum("pnl").alias("total"),
        (F.avg("pnl") * year).alias("annual"),
        (F.stddev_pop("pnl") * math.sqrt(year)).alias("vol"),
        F.coalesce(F.try_divide(F.avg("pnl"), F.stddev_pop("pnl")) * math.sqrt(year), F.lit(0.0)).alias("sharpe"),
        F.coalesce(1 - F.try_divide(F.sum((a - p) * (a - p)), F.var_pop(a) * F.count("*")), F.lit(0.0)).alias("r2"),
    )


def stars(p: str) -> Column:
    """Marks of significance at 1, 5 and 10 per cent."""
    c = F.col(p)
    return F.when(c < 0.01, "***").when(c < 0.05, "**").when(c < 0.1, "*").otherwise("")


def verdict(hit: str, sharpe: str, low: str) -> Column:
    """What a hit ratio in per cent, a Sharpe ratio and the lower end of its interval say."""
    h, s = F.col(hit), F.col(sharpe)
    return F.when((h > 50) & (s > 0) & (F.col(low) > 0), "passes").when((h > 50) & (s > 0), "marginal").when(s < 0, "fails").otherwise("inconclusive")


def diebold_mariano(df: DataFrame, keys: list[str], ddof: int = 1) -> DataFrame:
    """(n, dm, p) of squared errors of bench less those of pred; null (ddof 1) or 0 (ddof 0) where they don't vary."""
    d = (F.col("actual") - F.col("bench")) ** 2 - (F.col("actual") - F.col("pred")) ** 2
    var = F.var_samp("d") if ddof else F.var_pop("d")
    out = df.withColumn("d", d).where("d is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.when(var > 0, F.avg("d") / F.sqrt(var / F.count("*"))).alias("dm"))
    out = out if ddof else out.withColumn("dm", F.coalesce("dm", F.lit(0.0)))
    return out.withColumn("p", 2 * (1 - normal_cdf("abs(dm)")))


def clark_west(df: DataFrame, keys: list[str]) -> DataFrame:
    """(n, cw, p): errors against the mean of actual, corrected for the forecast's own spread; one-sided."""
    m = F.avg("actual").over(Window.partitionBy(*keys))
    df = df.withColumn("m", m).withColumn("f", (F.col("actual") - F.col("m")) ** 2 - (F.col("actual") - F.col("pred")) ** 2 + (F.col("m") - F.col("pred")) ** 2)
    out = df.where("f is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.try_divide(F.avg("f"), F.stddev_pop("f") / F.sqrt(F.count("*"))).alias("cw"))
    return out.withColumn("p", 1 - student_cdf("cw", "n - 1"))


def t_test(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(n, t, p) of a mean against 0, two-sided."""
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.try_divide(F.avg(value), F.stddev_samp(value) / F.sqrt(F.count(value))).alias("t"))
    return out.withColumn("p", 2 * (1 - student_cdf("abs(t)", "n - 1")))


def p_values(df: DataFrame, keys: list[str]) -> DataFrame:
    """(dm_p, cw_p, t_p) of the three tests above, by one aggregate over one reading of df; t is of sign(pred) * actual."""
    a, p = F.col("actual"), F.col("pred")
    d, m = (a - F.col("bench")) ** 2 - (a - p) ** 2, F.avg("actual").over(Window.partitionBy(*keys))
    df = df.withColumn("m", m).withColumn("d", d).withColumn("f", (a - F.col("m")) ** 2 - (a - p) ** 2 + (F.col("m") - p) ** 2).withColumn("x", F.signum(p) * a)
    over = lambda c, s: F.try_divide(F.avg(c), s(c) / F.sqrt(F.count(c)))
    out = df.groupBy(*keys).agg(
        F.when(F.var_samp("d") > 0, F.avg("d") / F.sqrt(F.var_samp("d") / F.count("d"))).alias("dm"), over("f", F.stddev_pop).alias("cw"), (F.count("f") - 1).alias("nf"), over("x", F.stddev_samp).alias("t"), (F.count("x") - 1).alias("nx")
    )
    return out.select(*keys, (2 * (1 - normal_cdf("abs(dm)"))).alias("dm_p"), (1 - student_cdf("cw", "nf")).alias("cw_p"), (2 * (1 - student_cdf("abs(t)", "nx"))).alias("t_p"))


#: Modulus of the draws, so that any engine with 64-bit integers makes the same.
PRIME = 2147483647


def draw(i, b, seed):
    """A number from 0 to PRIME - 1 for row i of replicate b; the arguments are columns or integer arrays."""
    x = (i * 48271 + b * 69621 + seed * 16807) % PRIME
    for add in (i, b, seed):
        x = (x * x + add) % PRIME
    return x


#: The shares of a Poisson variable of mean 1 that are at most 0, 1, 2 and so on.
POISSON = [sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(10)]


def bootstrap(df: DataFrame, keys: list[str], value: str, times: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(n, low, high) of the Sharpe ratio by resampling.

    Row and replicate draw how often the row counts, with mean 1 (Poisson), so
    no row looks another one up.  A task sums each replicate's weights and
    moments over its rows; only these sums are shuffled, as many as there are
    replicates, whatever the rows.  A row is known by its day: rows of one key
    and day are drawn together.
    """
    i = F.unix_date(F.col("ts").cast("date")).cast("long")
    rows = df.where(F.col(value).isNotNull()).select(*keys, i.alias("i"), F.col(value).alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))).alias("b"))
    u = draw(F.col("i"), F.col("b"), F.lit(seed)) / float(PRIME)
    w = sum(((F.col("u") > p).cast("int") for p in POISSON), F.lit(0))
    rows = rows.withColumn("u", u).withColumn("w", w)
    sums = rows.groupBy(*keys, "b").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("v")).alias("wv"), F.sum(F.col("w") * F.col("v") * F.col("v")).alias("wvv"))
    mean = F.try_divide("wv", "w")
    var = F.try_divide("wvv", "w") - mean * mean
    # to 12 places, so that the order in which tasks add up does not show
    sums = sums.withColumn("s", F.when(var > 1e-18, F.round(mean / F.sqrt(var) * math.sqrt(12), 12)))
    a = (1 - level) / 2
    return sums.groupBy(*keys).agg(F.max("n").alias("n"), F.percentile("s", F.lit(a)).alias("low"), F.percentile("s", F.lit(1 - a)).alias("high"))


def permutation(df: DataFrame, keys: list[str], times: int = 1000, seed: int = 42, blocks: int = 8) -> DataFrame:
    """(real, p): the share of shuffles of pred whose Sharpe of sign(pred) * actual reaches the real one.

    A key's rows go to ``blocks`` tasks, each of which makes its share of the
    shuffles in memory: rows times blocks are moved, not rows times shuffles.
    Equal to 12 places counts as reached; without spread the ratio is null.
    """
    named = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def sharpe(x):
        x = np.atleast_2d(x)
        spread = x.std(1)
        return np.where(spread > 0, x.mean(1) / np.where(spread > 0, spread, 1), np.nan)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        side, actual, i = np.sign(pdf["pred"].to_numpy(float)), pdf["actual"].to_numpy(float), np.arange(1, len(pdf) + 1)
        real = sharpe(side * actual)[0]
        reached = tried = 0
        for b in range(int(pdf["block"].iloc[0]), times, blocks):
            s = sharpe(side[np.lexsort((i, draw(i, b, seed)))] * actual)[0]
            if not np.isnan(s) and not np.isnan(real):
                tried, reached = tried + 1, reached + int(s >= real - 1e-12)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "real": [None if np.isnan(real) else real], "reached": [reached], "tried": [tried]})

    rows = df.where("pred is not null and actual is not null").select(*keys, "ts", "pred", "actual", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    parts = rows.groupBy(*keys, "block").applyInPandas(run, f"{named}, real double, reached long, tried long")
    return parts.groupBy(*keys).agg(F.max("real").alias("real"), F.try_divide(F.sum("reached"), F.sum("tried")).alias("p"))
