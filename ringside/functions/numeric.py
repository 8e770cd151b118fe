"""Numeric column functions of the telemetry operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The floor's edge in metres, and the radii and margins on it.
FLOOR_M = 14.63
CENTRE_RADIUS_M = 3.5
PINNED_M = 2.0
HAZARD_STRIP_M = 1.2


def clip(v: Column, lo: float, hi: float) -> Column:
    """v held to [lo, hi]; NULL stays NULL (least and greatest alone would drop it)."""
    return F.when(v.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), v)))


def falsy(*columns: Column) -> Column:
    """The first that is neither NULL nor zero."""
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in columns])


def logistic(z: Column, bound: float = 3.0) -> Column:
    return 1 / (1 + F.exp(-clip(z, -bound, bound)))


def half_even_split(share: Column, total: int) -> list[Column]:
    """A share of an integer total, rounded half-even, and what is left."""
    first = F.bround(share * total).cast("int")
    return [first, F.lit(total) - first]


def wall_distance(x: Column, y: Column, edge: float = FLOOR_M) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), F.least(x, y, edge - x, edge - y))


def centre_distance(x: Column, y: Column, edge: float = FLOOR_M) -> Column:
    return F.hypot(x - edge / 2, y - edge / 2)


def flag(condition: Column) -> Column:
    """1.0 or 0.0, NULL where unknown."""
    return F.when(condition, 1.0).when(~condition, 0.0)


def project(h: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """A 3x3 row-major homography applied to a point."""
    w = h[6] * x + h[7] * y + h[8]
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def inverted(h: list[Column]) -> list[Column]:
    """The inverse homography: the adjugate over the determinant."""
    a, b, c, d, e, f, g, i, j = h
    adjugate = [e * j - f * i, c * i - b * j, b * f - c * e, f * g - d * j, a * j - c * g, c * d - a * f, d * i - e * g, b * g - a * i, a * e - b * d]
    det = a * adjugate[0] + b * adjugate[3] + c * adjugate[6]
    return [x / det for x in adjugate]


def savgol_matrix(window: int = 9, order: int = 2) -> list[list[float]]:
    """The least-squares polynomial's hat matrix on equispaced points: row r
    gives the fitted value at point r."""
    import numpy as np

    a = np.vander(np.arange(window) - window // 2, order + 1).astype(float)
    return (a @ np.linalg.pinv(a)).tolist()


def savgol(values: Column, window: int = 9, order: int = 2) -> Column:
    """Savitzky-Golay smoothing of an array; the edges follow the edge
    windows' polynomials. Arrays shorter than the window stay as they are."""
    rows = F.array(*[F.array(*[F.lit(x) for x in r]) for r in savgol_matrix(window, order)])
    n, half = F.size(values), window // 2

    def at(k: Column) -> Column:
        start = F.greatest(F.lit(0), F.least(k - half, n - window))
        terms = F.zip_with(F.slice(values, start + 1, F.lit(window)), F.get(rows, k - start), lambda v, h: v * h)
        return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)

    return F.when(n < window, values).otherwise(F.transform(F.sequence(F.lit(0), n - 1), at))


def brier(p: Column, y: Column) -> Column:
    return F.avg(F.pow(p - y, 2))


def log_loss(p: Column, y: Column, eps: float = 1e-9) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q)))


def bin_of(p: Column, bins: int = 10, closed: bool = True) -> Column:
    """The equal-width bin of a probability, found against the literal edges
    i / bins; p = 1 is in the last bin if ``closed``, else in none."""
    found = F.size(F.filter(F.array(*[F.lit(i / bins) for i in range(1, bins)]), lambda e: p >= e))
    return F.when((p >= 0) & ((p <= 1) if closed else (p < 1)), found)


def bgr(colour: Column) -> list[Column]:
    """Blue, green and red of '#rrggbb'."""
    code = F.ltrim(colour, F.lit("#"))
    return [F.conv(F.substring(code, at, 2), 16, 10).cast("int") for at in (5, 3, 1)]
