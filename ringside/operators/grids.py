"""Presence grids: two-way histograms and their blur."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(v: Column, lo: float, hi: float, n: int) -> Column:
    """The cell of v on n equal cells of [lo, hi]; outer values clip to the edge cells."""
    return F.when(v.isNotNull(), F.greatest(F.lit(0), F.least(F.floor((v - lo) / (hi - lo) * n), F.lit(n - 1))).cast("int"))


def histogram2d(df: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    return df.withColumn("gx", x).withColumn("gy", y).filter("gx is not null and gy is not null").groupBy(*keys, "gx", "gy").agg(F.count("*").cast("double").alias("n"))


def taps(sigma: float = 1.6) -> list[float]:
    """Gaussian weights of radius floor(4 sigma + 0.5)."""
    radius = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def blurred(grid: DataFrame, keys: list[str], size: tuple[int, int], sigma: float = 1.6) -> DataFrame:
    """A sparse grid (keys, gx, gy, n) under a separable Gaussian blur with
    mirrored edges, on all cells it reaches. Mirroring maps target to source,
    so each source cell spreads to the targets that read it."""
    weights = taps(sigma)
    radius = len(weights) // 2
    out = grid
    for axis, n in zip(("gx", "gy"), size, strict=True):
        pairs: dict[tuple[int, int], float] = {}
        for to in range(n):
            for k, w in enumerate(weights):
                m = (to + k - radius) % (2 * n)
                at = m if m < n else 2 * n - 1 - m
                pairs[at, to] = pairs.get((at, to), 0.0) + w
        spread = [[(to, w) for (at, to), w in sorted(pairs.items()) if at == i] for i in range(n)]
        table = F.from_json(F.lit(json.dumps([[{"to": to, "w": w} for to, w in row] for row in spread])), "array<array<struct<to:int,w:double>>>")
        other = "gy" if axis == "gx" else "gx"
        rows = out.select(*keys, other, "n", F.explode(F.get(table, F.col(axis))).alias("s"))
        out = rows.groupBy(*keys, other, F.col("s.to").alias(axis)).agg(F.sum(F.col("n") * F.col("s.w")).alias("n"))
    return out.select(*keys, "gx", "gy", "n")
