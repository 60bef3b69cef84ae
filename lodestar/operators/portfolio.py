"""Positions, costs and equity of signal portfolios; df has series, ts, pred and ret."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import by, expanding

#: Cost tiers in basis points.
TIERS = {"micro": 50.0, "standard": 25.0, "professional": 15.0, "institutional": 5.0}


def bps(tier: str) -> float:
    return TIERS.get(tier, 25.0)


def positions(df: DataFrame, max_long: float = 1.5, max_short: float = 0.5) -> DataFrame:
    """Signal strength against the strongest so far, times the limit of its side."""
    p = F.col("pred")
    strength = F.abs(p) / F.greatest(F.max(F.abs(p)).over(by("series").rowsBetween(Window.unboundedPreceding, 0)), F.lit(1e-8))
    return df.withColumn("pos", F.when(p > 0, strength * max_long).otherwise(-strength * max_short))


def delevered(df: DataFrame, limit: float, max_long: float) -> DataFrame:
    """Positions over 1 cut while equity is below its peak: the cut feeds back into equity, so each series is folded in order.

    A series must fit into a task, as a backtest of monthly or daily rows does.
    Rows without a position or return hold nothing and are left out.
    """
    if limit <= 0 or max_long <= 1:
        return df
    def run(pdf):
        pdf = pdf.sort_values("ts")
        equity = peak = 1.0
        out = []
        for pos, ret in zip(pdf["pos"].tolist(), pdf["ret"].tolist()):
            if pos > 1:
                pos = 1 + (pos - 1) * (1 - 0.5 * min((peak - equity) / peak / limit, 1.0))
            out.append(pos)
            equity *= 1 + pos * ret
            peak = max(peak, equity)
        return pdf.assign(pos=out)

    rows = df.select("series", "ts", "pos", "ret").where("pos is not null and ret is not null")
    return rows.groupBy("series").applyInPandas(run, rows.schema)


def swept(df: DataFrame, combos: Sequence[tuple[float, float]], limit: float, keys: Sequence[str] = ("series",)) -> DataFrame:
    """(keys, ts, max_long, max_short, pos, ret) of fitted predictions under each (max_long, max_short).

    The predictions are sized once; then one pass in order of time carries the
    equities of all combinations side by side, and each cuts its own positions
    over 1 in its own drawdown, as ``delevered`` does for one.  A key's rows must
    fit a task.  Rows without a prediction or return are left out; a limit of
    0 cuts nothing.
    """
    longs, shorts = (np.array(c, float) for c in zip(*combos))
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        pred, ret = pdf["pred"].to_numpy(float), pdf["ret"].to_numpy(float)
        strength = np.abs(pred) / np.maximum(np.maximum.accumulate(np.abs(pred)), 1e-8)
        pos = np.where(pred[:, None] > 0, strength[:, None] * longs, -strength[:, None] * shorts)
        equity, peak = np.ones(len(longs)), np.ones(len(longs))
        if limit > 0:
            for t in range(len(pos)):
                cut = 1 + (pos[t] - 1) * (1 - 0.5 * np.minimum((peak - equity) / peak / limit, 1.0))
                pos[t] = np.where((pos[t] > 1) & (longs > 1), cut, pos[t])
                equity = equity * (1 + pos[t] * ret[t])
                peak = np.maximum(peak, equity)
        n = len(longs)
        out = {k: np.repeat(pdf[k].to_numpy(), n) for k in (*keys, "ts")}
        return pd.DataFrame({**out, "max_long": np.tile(longs, len(pos)), "max_short": np.tile(shorts, len(pos)), "pos": pos.ravel(), "ret": np.repeat(ret, n)})

    rows = df.where("pred is not null and ret is not null").select(*keys, "ts", "pred", "ret")
    return rows.groupBy(*keys).applyInPandas(run, f"{kinds}, ts date, max_long double, max_short double, pos double, ret double")


def sweep_report(df: DataFrame, rate: float, keys: Sequence[str] = ("series",), year: int = 12) -> DataFrame:
    """One row for each key and combination of ``swept``: n, total, annual, sharpe and max_drawdown of the returns less the financing."""
    from .metrics import risk

    net = margin(df, rate).withColumn("net", F.col("pos") * F.col("ret") - F.col("margin"))
    return risk(net, [*keys, "max_long", "max_short"], "net", year).select(*keys, "max_long", "max_short", "n", "total", "annual", "sharpe", F.col("max_dd").alias("max_drawdown"))


def margin(df: DataFrame, rate: float) -> DataFrame:
    """Financing of what exceeds the capital, by month."""
    return df.withColumn("margin", F.greatest(F.lit(0.0), F.abs("pos") - 1) * rate / 12)


def past_spread(size: Column) -> Column:
    """The spread of all sizes before each row; until there are two of them, the first size; 1e-8 at least."""
    w = by("series")
    return F.greatest(F.coalesce(expanding(size, F.stddev_samp, w, 2, 1), F.first(size).over(w)), F.lit(1e-8))


def conviction(df: DataFrame, least: float) -> DataFrame:
    """Predictions whose size is under ``least`` of the spread of the sizes before become 0."""
    size = F.abs("pred")
    return df.withColumn("kept_pred", F.when(size / past_spread(size) < least, 0.0).otherwise(F.col("pred")))


def symmetric(df: DataFrame) -> DataFrame:
    """df with pos and gross: each prediction against the strongest of its whole series, long and short alike, without financing."""
    top = F.max(F.abs("pred")).over(Window.partitionBy("series"))
    df = df.withColumn("pos", F.when(top > 0, F.col("pred") / top).otherwise(0.0))
    return df.withColumn("gross", F.col("pos") * F.col("ret"))


def turnover(df: DataFrame, still: float = 0.02) -> DataFrame:
    """Half the change of the sign position; predictions under ``still`` hold none."""
    p = F.col("pred")
    df = df.withColumn("side", F.when(F.abs(p) < still, 0.0).otherwise(F.signum(p)))
    return df.withColumn("turnover", F.abs(F.col("side") - F.coalesce(F.lag("side").over(by("series")), F.col("side"))) / 2)


def simulated(df: DataFrame, max_long: float = 1.5, max_short: float = 0.5, rate: float = 0.06, limit: float = 0.0) -> DataFrame:
    """df with pos and gross, the return of the sized positions less the financing of their leverage; a limit cuts them in drawdowns."""
    out = positions(df, max_long, max_short)
    if limit > 0 and max_long > 1:
        cut = delevered(out, limit, max_long).select("series", "ts", "pos")
        out = out.drop("pos").join(cut, ["series", "ts"])
    return margin(out, rate).withColumn("gross", F.col("pos") * F.col("ret") - F.col("margin")).drop("margin")


def costed(df: DataFrame, rate: float, max_long: float = 1.5, max_short: float = 0.5, financing: float = 0.06, limit: float = 0.0) -> DataFrame:
    """Gross return of the sized positions, cost of the sign's turnover at a rate in basis points, and net return."""
    out = turnover(simulated(df, max_long, max_short, financing, limit))
    return out.withColumn("cost", F.col("turnover") * rate / 1e4).withColumn("net", F.col("gross") - F.col("cost"))


def cost_adjusted(df: DataFrame, rate: float) -> DataFrame:
    """df with adjusted: the prediction less the cost of its own turnover, of the same sign."""
    return turnover(df).withColumn("adjusted", F.col("pred") - F.col("turnover") * rate / 1e4 * F.signum("pred"))


def cost_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key of gross, cost, net and turnover: Sharpe and totals before and after costs, drag, trades and what a trade costs."""
    sharpe = lambda c: F.coalesce(F.try_divide(F.avg(c), F.stddev_samp(c)) * F.sqrt(F.lit(12.0)), F.lit(0.0))
    total = lambda c: F.product(1 + F.col(c)) - 1
    traded = F.col("turnover") > 0
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        sharpe("gross").alias("sharpe_gross"),
        sharpe("net").alias("sharpe_net"),
        total("gross").alias("total_gross"),
        total("net").alias("total_net"),
        F.avg("turnover").alias("avg_turnover"),
        F.sum("turnover").alias("total_turnover"),
        F.sum("cost").alias("total_cost"),
        F.count(F.when(traded, 1)).alias("trades"),
        F.coalesce(F.avg(F.when(traded, F.col("cost"))) * 1e4, F.lit(0.0)).alias("bps_a_trade"),
    )
    return out.withColumn("drag", F.col("total_gross") - F.col("total_net"))


def equal_weight(ret: DataFrame, grid: DataFrame, skip: int = 0, held: int = 9) -> DataFrame:
    """(turnover, bps, n, total, annual) of the mean of all series less each month's cost of ``held`` positions, for each row of the grid."""
    monthly = ret.where("ret is not null").groupBy("ts").agg(F.avg("ret").alias("r"))
    monthly = monthly.withColumn("k", F.row_number().over(Window.orderBy("ts"))).where(F.col("k") > skip)
    # the grid is a parameter, a few rows
    net = monthly.crossJoin(F.broadcast(grid)).withColumn("net", F.col("r") - held * F.col("turnover") * F.col("bps") / 1e4)
    out = net.groupBy("turnover", "bps").agg(F.count("*").alias("n"), (F.product(1 + F.col("net")) - 1).alias("total"))
    return out.withColumn("annual", F.pow(1 + F.col("total"), 12.0 / F.col("n")) - 1)
