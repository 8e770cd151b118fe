"""Islands, gaps and intervals over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_segments(df: DataFrame, keys: list[str], order: list[str], *states: str, name: str = "seg") -> DataFrame:
    """Adds ``name``: a number that grows where any of the states changes
    (NULL-safe) inside the keys' order, from 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    same = F.lit(True)
    for s in states:
        same = same & F.col(s).eqNullSafe(F.lag(s).over(w))
    change = F.when((F.row_number().over(w) == 1) | same, 0).otherwise(1)
    return df.withColumn("_change", change).withColumn(name, F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def islands(df: DataFrame, keys: list[str], order: list[str], t: str, *states: str) -> DataFrame:
    """One row a segment: its states, number of rows, first and last t."""
    return with_segments(df, keys, order, *states).groupBy(*keys, "seg", *states).agg(F.count("*").alias("n"), F.min(t).alias("start_t"), F.max(t).alias("end_t"))


def silences(df: DataFrame, keys: list[str], t: str, least: float) -> DataFrame:
    """Gaps [start, end] of ``least`` or more between consecutive rows."""
    w = Window.partitionBy(*keys).orderBy(t)
    return df.select(*keys, F.lag(t).over(w).alias("start_t"), F.col(t).alias("end_t")).filter(F.col("end_t") - F.col("start_t") >= least)


def state_gaps(df: DataFrame, keys: list[str], order: list[str], t: str, present: str) -> DataFrame:
    """Islands where ``present`` is false, [start, next present t]; one that is
    still open ends at the last t."""
    w = Window.partitionBy(*keys).orderBy("seg")
    runs = islands(df, keys, order, t, present)
    return runs.withColumn("end_t", F.coalesce(F.lead("start_t").over(w), "end_t")).filter(~F.col(present)).select(*keys, "start_t", "end_t")


def in_interval(points: DataFrame, intervals: DataFrame, keys: list[str], t: str, columns: list[str]) -> DataFrame:
    """Left join of points with disjoint half-open intervals [start_t, end_t) of
    the same keys. Interval starts and points go through one window a key,
    so the plan is a shuffle and a sort, whatever the intervals' lengths."""
    point = points.withColumn("_at", F.col(t)).withColumn("_kind", F.lit(1))
    start = intervals.select(*keys, F.col("start_t").alias("_at"), F.lit(0).alias("_kind"), F.struct("end_t", *columns).alias("_in"))
    both = point.unionByName(start, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_in", F.last("_in", ignorenulls=True).over(w)).filter("_kind = 1")
    inside = F.col(t) < F.col("_in.end_t")
    return found.select(*points.columns, *[F.when(inside, F.col(f"_in.{c}")).alias(c) for c in columns])
