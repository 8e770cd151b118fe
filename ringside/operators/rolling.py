"""Trailing windows, resampling and forward fill."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.functions.numeric import clip

from .folds import fold

WINDOW = 100
MIN_FILL = 0.5


def trailing(keys: list[str], order: list[str], rows: int = WINDOW):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(rows - 1), 0)


def rolling_mean(v: Column, w) -> Column:
    """Mean of the values there are; NULL if there is none."""
    return F.avg(v).over(w)


def moving_percentile(df: DataFrame, keys: list[str], order: list[str], v: str, out: str, q: float, rows: int = WINDOW, min_fill: float = MIN_FILL) -> DataFrame:
    """``df`` with ``out`` added: the linear percentile of a trailing window of
    ``rows`` rows, NULL under min_fill * rows values.

    One ordered pass a key. The window's values are held sorted: a row's value
    goes in at its place and the one that leaves is taken out, so a row costs a
    binary search and not a sort of its window."""
    least = max(1, math.ceil(rows * min_fill))
    picked = df.drop(out).withColumn("_v", F.col(v).cast("double"))
    kinds = dict(picked.dtypes)

    def step(state: tuple[deque, list], pdf: pd.DataFrame) -> pd.DataFrame:
        window, held = state
        got = []
        for x in pdf["_v"].tolist():
            if len(window) == rows and (gone := window.popleft()) == gone:
                del held[bisect_left(held, gone)]
            window.append(x)
            if x == x:  # NULLs come as NaN
                insort(held, x)
            if len(held) < least:
                got.append(None)
                continue
            at = q * (len(held) - 1)
            lo = held[int(at)]
            got.append(lo + (held[min(int(at) + 1, len(held) - 1)] - lo) * (at - int(at)))
        return pdf.drop(columns="_v").assign(**{out: pd.Series(got, index=pdf.index, dtype="float64")})

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in picked.columns if c != "_v"), f"`{out}` double"])
    return fold(picked, keys, list(order), lambda: (deque(), []), step, schema)


def mobility(df: DataFrame, keys: list[str], order: list[str], v: str, index: str, rows: int = WINDOW, base: tuple[int, int] = (100, 600), q: float = 0.9) -> DataFrame:
    """Adds ``roll`` (trailing percentile) and ``mobility``: roll over its own
    median on the base rows, held to [0, 1.5]; NULL without a positive base."""
    df = moving_percentile(df, keys, order, v, "roll", q, rows)
    inside = (F.col(index) >= base[0]) & (F.col(index) < base[1])
    median = F.percentile(F.when(inside, F.col("roll")), 0.5).over(Window.partitionBy(*keys))
    df = df.withColumn("_base", median)
    return df.withColumn("mobility", F.when(F.col("_base") > 0, clip(F.col("roll") / F.col("_base"), 0, 1.5))).drop("_base")


def control(df: DataFrame, keys: list[str], order: list[str], centre: tuple[str, str], pinned: tuple[str, str], rows: int = WINDOW) -> DataFrame:
    """Adds ``control`` in [-1, 1]: 0.6 of the difference in centre shares and
    0.4 of that in the opponent's and own pinned shares."""
    w = trailing(keys, order, rows)
    share = lambda c: rolling_mean(F.col(c), w)
    return df.withColumn("control", clip(0.6 * (share(centre[0]) - share(centre[1])) + 0.4 * (share(pinned[1]) - share(pinned[0])), -1, 1))


def resampled(df: DataFrame, keys: list[str], t: Column, v: str) -> DataFrame:
    """Mean in buckets of one unit of t; buckets without a value are absent."""
    return df.groupBy(*keys, F.floor(t).alias("sec")).agg(F.avg(v).alias("value"), F.count(v).alias("_n")).filter("_n > 0").drop("_n")


def filled(series: DataFrame, keys: list[str], fill: float) -> DataFrame:
    """A series (keys, sec, value) on the dense grid from 0 to its last second,
    each gap taking the last value before it, and ``fill`` before the first."""
    ends = series.groupBy(*keys).agg(F.max("sec").alias("_end"))
    grid = ends.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_end").cast("long"))).alias("sec"))
    w = Window.partitionBy(*keys).orderBy("sec").rowsBetween(Window.unboundedPreceding, 0)
    joined = grid.join(series, [*keys, "sec"], "left")
    return joined.select(*keys, "sec", F.coalesce(F.last("value", ignorenulls=True).over(w), F.lit(fill)).alias("value"))
