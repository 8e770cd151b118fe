"""Homographies: fitting, their error, and positions from image points."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringside.functions import numeric as N
from ringside.shipping import ship

from . import segments


# Fixed value: a singular value of so small a share of the largest is rounding.
SAME = 1e-10


def _solved(image: np.ndarray, floor: np.ndarray) -> np.ndarray | None:
    """The homography of least squares through point pairs, its last entry 1."""
    rows = []
    for (x, y), (u, v) in zip(image, floor, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
    a = np.array(rows)
    if np.linalg.matrix_rank(a) < 8:
        return None
    return np.append(np.linalg.lstsq(a, floor.ravel(), rcond=None)[0], 1.0)


def _rank(image: np.ndarray, floor: np.ndarray) -> int:
    """How much point pairs say of a homography: it is determined from 8 on."""
    unit = lambda p: (p - p.mean(axis=0)) / (p.std() or 1.0)
    rows = []
    for (x, y), (u, v) in zip(unit(image), unit(floor), strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
    s = np.linalg.svd(np.array(rows), compute_uv=False)
    return int((s > SAME * s[0]).sum())


def _telling(image: np.ndarray, floor: np.ndarray) -> list[int]:
    """The point pairs, in order, that say more than those before them, up to
    the one that determines the homography."""
    taken: list[int] = []
    rank = 0
    for k in range(len(image)):
        if (more := _rank(image[[*taken, k]], floor[[*taken, k]])) > rank:
            taken.append(k)
            rank = more
        if rank >= 8:
            break
    return taken


def _misses(h: np.ndarray, image: np.ndarray, floor: np.ndarray) -> np.ndarray:
    p = np.c_[image, np.ones(len(image))] @ h.reshape(3, 3).T
    return ((p[:, :2] / p[:, 2:] - floor) ** 2).sum(axis=1)


def fit(image: np.ndarray, floor: np.ndarray) -> np.ndarray | None:
    """Nine numbers, row by row; four pairs are solved, more by the least median
    of squares over sets of four, then by the pairs that this one explains."""
    if len(image) < 4 or _rank(image, floor) < 8:
        return None
    if len(image) == 4:
        return _solved(image, floor)
    sets = list(combinations(range(len(image)), 4))
    sets = sets[:: max(1, len(sets) // 300)]
    tried = [h for s in sets if (h := _solved(image[list(s)], floor[list(s)])) is not None]
    if not tried:
        return None
    best = min(tried, key=lambda h: float(np.median(_misses(h, image, floor))))
    miss = _misses(best, image, floor)
    good = miss <= max(6.25 * float(np.median(miss)) * (1 + 5 / max(1, len(image) - 4)) ** 2, 1e-12)
    return _solved(image[good], floor[good]) if good.sum() >= 4 else best


def fitted(pairs: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """(keys, h, error_m): a homography of nine numbers for each key from point
    pairs (ix, iy, fx, fy) and its RMS error. A key has the few points that a
    person marked; keys without four sound pairs have no row. With ``order``, a
    key may have many: they are taken by it, and only those that say more than
    the ones before, until the homography is determined."""
    ship(pairs.sparkSession)
    kinds = dict(pairs.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order) if order else pdf
        image, floor = pdf[["ix", "iy"]].to_numpy(float), pdf[["fx", "fy"]].to_numpy(float)
        if order:
            taken = _telling(image, floor)
            image, floor = image[taken], floor[taken]
        h = fit(image, floor)
        if h is None:
            return pd.DataFrame(columns=[*keys, "h", "error_m"])
        row = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame([row | {"h": h.tolist(), "error_m": float(np.sqrt(_misses(h, image, floor).mean()))}])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return pairs.select(*keys, "ix", "iy", "fx", "fy", *([order] if order else [])).dropna().groupBy(*keys).applyInPandas(run, f"{schema}, h array<double>, error_m double")


def rms_error(px: Column, py: Column, x: Column, y: Column) -> Column:
    """The root mean square distance of projected from true points, an aggregate."""
    return F.sqrt(F.avg((px - x) * (px - x) + (py - y) * (py - y)))


def box_centre(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    return x + w / 2, y + h / 2


def tracked(boxes: DataFrame, shots: DataFrame, angles: DataFrame, homographies: DataFrame) -> DataFrame:
    """Positions on the floor (fight_id, i, t, bot, x, y, angle_id) from boxes
    (fight_id, i, t, bot, bx, by, bw, bh), shots (fight_id, start_t, end_t,
    shot_idx, wide), angles (fight_id, shot_idx, angle_id) and homographies
    (fight_id, angle_id, h). A frame outside wide shots, or of an angle
    without a homography, is a gap: its x and y are NULL, never a guess. A
    fight without angles has angle 0 throughout."""
    placed = segments.in_interval(boxes, shots.filter("wide"), ["fight_id"], "t", ["shot_idx"])
    split = angles.select("fight_id").distinct().withColumn("_split", F.lit(True))
    rows = placed.join(angles, ["fight_id", "shot_idx"], "left").join(split, "fight_id", "left")
    angle = F.when(F.col("shot_idx").isNotNull(), F.when(F.col("_split"), F.col("angle_id")).otherwise(F.lit(0)))
    rows = rows.withColumn("angle_id", angle).join(homographies.select("fight_id", "angle_id", "h"), ["fight_id", "angle_id"], "left")
    x, y = N.project([F.col("h")[k] for k in range(9)], *box_centre(*(F.col(c) for c in ("bx", "by", "bw", "bh"))))
    return rows.select("fight_id", "i", "t", "bot", x.alias("x"), y.alias("y"), "angle_id")
