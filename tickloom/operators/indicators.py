"""Indicators per series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions import kernels
from tickloom.functions.windows import KEY, by_index, dealt, whole


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, warmup: str = "zero") -> DataFrame:
    """dif, dea and macd_hist of every bar; null for series of fewer than ``slow`` bars.

    The means are linear recursions, so this is a fold per series. They start with zeros, which makes the
    first values of dif price-sized; ``warmup="null"`` gives null until all means have started.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx", kind="stable")
        found = kernels.macd(rows["close"].to_numpy(float), fast, slow, signal)
        out = rows[[*KEY, "idx"]].copy()
        for name, values in zip(("dif", "dea", "macd_hist"), found or [np.full(len(rows), np.nan)] * 3):
            out[name] = values if warmup == "zero" else np.where(np.arange(len(rows)) < slow + signal - 2, np.nan, values)
        return out.astype(object).where(out.notna(), None)

    schema = "symbol string, tf string, idx int, dif double, dea double, macd_hist double"
    return dealt(bars.select(*KEY, "idx", "close")).groupBy(*KEY).applyInPandas(fold, schema)


def macd_by_blocks(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, block: int = 4096) -> DataFrame:
    """As :func:`macd`, for series too long for one task: dealt in blocks of bars, with idx counting from 0 without gaps.

    Each block says where the means end if they start from zeros; from that, what they were before every block follows
    in one step a block; then each block is taken once more from there. The same values but for rounding.
    """
    periods = (fast, slow, signal)
    if block < max(periods):
        raise ValueError("the means must start within the first block")
    rows = bars.select(*KEY, F.floor(F.col("idx") / block).cast("int").alias("block"), "idx", F.col("close").cast("double").alias("close"))
    keys = [*KEY, "block"]

    def ends(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("idx", kind="stable")
        first = held["block"].iloc[0] == 0
        found = kernels.macd_block(held["close"].to_numpy(float), periods, None if first else (0.0, 0.0, 0.0))
        return pd.DataFrame([(*held[keys].iloc[0], len(held), *(float(x[-1]) for x in found))], columns=[*keys, "n", "a", "b", "d"])

    def starts(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("block", kind="stable").reset_index(drop=True)
        found = kernels.macd_starts(held["n"].tolist(), list(zip(held["a"], held["b"], held["d"])), periods)
        out = held[keys].copy()
        out[["a", "b", "d"]] = [(np.nan, np.nan, np.nan), *found]
        out["total"] = held["n"].sum()
        return out

    def again(held: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        held, at = held.sort_values("idx", kind="stable"), start.iloc[0]
        out = held[[*KEY, "idx"]].copy()
        if at["total"] < slow:
            return out.assign(dif=None, dea=None, macd_hist=None)
        a, b, dea = kernels.macd_block(held["close"].to_numpy(float), periods, None if at["block"] == 0 else (at["a"], at["b"], at["d"]))
        return out.assign(dif=a - b, dea=dea, macd_hist=2.0 * (a - b - dea))

    key = "symbol string, tf string, block int"
    from_zero = dealt(rows, "block").groupBy(*keys).applyInPandas(ends, f"{key}, n long, a double, b double, d double")
    before = from_zero.groupBy(*KEY).applyInPandas(starts, f"{key}, a double, b double, d double, total long")
    pairs = dealt(rows, "block").groupBy(*keys).cogroup(before.groupBy(*keys))
    return pairs.applyInPandas(again, "symbol string, tf string, idx int, dif double, dea double, macd_hist double")


def volume_scores(bars: DataFrame) -> DataFrame:
    """Volume/price score (signed share of the mean volume) and on-balance volume."""
    before = F.lag("close").over(by_index())
    signed = F.when(F.col("close") > before, F.col("vol")).when(F.col("close") < before, -F.col("vol")).otherwise(0.0)
    score = F.try_divide(F.when(F.col("close") > F.col("open"), F.col("vol")).otherwise(-F.col("vol")), F.avg("vol").over(whole()))
    steps = bars.select(*KEY, "idx", F.coalesce(score, F.lit(0.0)).alias("vp_score"), signed.alias("_step"))
    running = by_index().rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(*KEY, "idx", "vp_score", F.sum("_step").over(running).alias("obv"))
