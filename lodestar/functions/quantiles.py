"""Quantiles over frames of ordered rows, by order statistics instead of a sort for each row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Ranks:
    """The ranks of a sequence, one bit a level, with the number of zeros before each place.

    The k-th smallest value of any run of places is found from the highest bit
    down, in as many steps as ranks have bits; all runs take each step together.
    """

    def __init__(self, values: np.ndarray):
        self.sorted = np.sort(values, kind="stable")
        at = np.empty(len(values), np.int64)
        at[np.argsort(values, kind="stable")] = np.arange(len(values))
        self.levels = []
        for bit in range(max(len(values) - 1, 1).bit_length() - 1, -1, -1):
            one = (at >> bit) & 1
            self.levels.append((bit, np.concatenate([[0], np.cumsum(1 - one)])))
            at = np.concatenate([at[one == 0], at[one == 1]])

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value, from 0, of the places low to high - 1 of each run."""
        low, high, k, rank = low.copy(), high.copy(), k.copy(), np.zeros(len(k), np.int64)
        for bit, zeros in self.levels:
            a, b = zeros[low], zeros[high]
            up = k >= b - a
            k = np.where(up, k - (b - a), k)
            rank += up.astype(np.int64) << bit
            low, high = np.where(up, zeros[-1] + low - a, a), np.where(up, zeros[-1] + high - b, b)
        return self.sorted[rank]


def running(values: np.ndarray, shares: list[float], window: int | None = None, least: int = 1) -> np.ndarray:
    """Quantiles, linear between neighbours, of the values up to each row, or of the last ``window`` rows; null below ``least`` values.

    A row for each value and a column for each share; gaps (NaN) are passed over.
    """
    known = ~np.isnan(values)
    high = np.cumsum(known)
    low = np.zeros(len(values), np.int64) if window is None else np.concatenate([np.zeros(min(window, len(values)), np.int64), high[: max(0, len(values) - window)]])
    n = high - low
    ok = n >= max(least, 1)
    out = np.full((len(values), len(shares)), np.nan)
    if ok.any():
        ranks = Ranks(values[known])
        for j, p in enumerate(shares):
            at = (n[ok] - 1) * p
            k = np.floor(at).astype(np.int64)
            a = ranks.smallest(low[ok], high[ok], k)
            b = ranks.smallest(low[ok], high[ok], np.minimum(k + 1, n[ok] - 1))
            out[ok, j] = a + (b - a) * (at - k)
    return out


def running_quantiles(df: DataFrame, shares: dict[str, float], value: str = "value", window: int | None = None, least: int = 1, keys: tuple[str, ...] = ("series",), order: str = "ts") -> DataFrame:
    """df (its keys, order, value and other columns) with a column of running quantiles for each name in shares.

    A series is one group and must fit a task: some 100 bytes a row.  Rows of
    one date are taken in the order of their values.
    """
    names = list(shares)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, value], kind="stable")
        return pdf.assign(**dict(zip(names, running(pdf[value].to_numpy(float), list(shares.values()), window, least).T)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in names)
    return df.drop(*names).groupBy(*keys).applyInPandas(run, f"{schema}, {', '.join(f'{n} double' for n in names)}").withColumns({n: F.nanvl(n, F.lit(None).cast("double")) for n in names})
