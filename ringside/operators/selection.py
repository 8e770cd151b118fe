"""Exact order statistics of a whole column, by repeated bracketing.

A quantile sketch brackets the wanted ranks, one aggregation counts what lies
below and inside, and the bracket is bracketed again until few enough rows are
inside to be counted value by value. Each pass gives back a few numbers, so
neither a task nor the driver ever holds more than ``FEW`` values, and a pass
narrows the rows by a factor of about ACCURACY / 4.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000
FEW = 20_000


def order_values(df: DataFrame, v: str, ranks: Callable[[int], list[int]], few: int = FEW, accuracy: int = ACCURACY) -> tuple[int, list]:
    """The number of values that aren't NULL, and those at ``ranks(n)``, counted
    from 0 in ascending order; no values: none. The rows are read once to
    three times a pass."""
    rows = df.select(F.col(v).alias("v")).filter("v is not null")
    part, below, inside, wanted = rows, 0, None, None
    while True:
        near = [0.0, 1.0] if wanted is None else [max(0.0, (wanted[0] - below) / inside - 2 / accuracy), min(1.0, (wanted[-1] + 1 - below) / inside + 2 / accuracy)]
        facts = part.agg(F.count("*").alias("n"), F.percentile_approx("v", F.lit(near), accuracy).alias("near")).first()
        if wanted is None:
            total = inside = facts["n"]
            wanted = sorted(set(ranks(total))) if total else []
            if not wanted:
                return total, []
            if total > few:
                continue
        else:
            lo, hi = facts["near"]
            counts = part.agg(F.count_if(F.col("v") < lo).alias("below"), F.count_if((F.col("v") >= lo) & (F.col("v") <= hi)).alias("inside")).first()
            if not below + counts["below"] <= wanted[0] <= wanted[-1] < below + counts["below"] + counts["inside"]:
                raise ArithmeticError("the sketch's bracket lost a rank")
            stuck = counts["inside"] == inside
            below, inside = below + counts["below"], counts["inside"]
            part = rows.filter((F.col("v") >= lo) & (F.col("v") <= hi))
            if lo == hi:
                return total, [lo for _ in ranks(total)]
            if inside > few and not stuck:
                continue
        values = part.groupBy("v").agg(F.count("*").alias("c"))
        # Few rows, or a few values that many rows share.
        found, at = {}, below
        for r in sorted(values.collect(), key=lambda r: r["v"]):
            at += r["c"]
            for k in wanted:
                if k not in found and k < at:
                    found[k] = r["v"]
        return total, [found[k] for k in ranks(total)]


def quantile(df: DataFrame, v: str, q: float, **options) -> float | None:
    """The linear quantile of all values, as one number; None without any."""
    ends = lambda n: [int(q * (n - 1)), min(int(q * (n - 1)) + 1, n - 1)]
    n, found = order_values(df, v, ends, **options)
    if not found:
        return None
    lo, hi = map(float, found)
    return lo + (hi - lo) * (q * (n - 1) - int(q * (n - 1)))
