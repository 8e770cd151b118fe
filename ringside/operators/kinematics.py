"""Smoothing and derivatives of positions, never across a segment's border."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.functions.numeric import savgol


def smoothed(df: DataFrame, keys: list[str], order: str, *values: str, window: int = 9, degree: int = 2) -> DataFrame:
    """(keys, order, values): Savitzky-Golay smoothing inside each key group,
    which must be one segment: the group is one array of its rows."""
    row = F.sort_array(F.collect_list(F.struct(order, *values)))
    arrays = df.groupBy(*keys).agg(row.alias("_rows"))
    for v in values:
        arrays = arrays.withColumn(f"_{v}", savgol(F.col(f"_rows.{v}"), window, degree))
    every = F.arrays_zip(F.col(f"_rows.{order}").alias(order), *[F.col(f"_{v}").alias(v) for v in values])
    out = arrays.select(*keys, F.explode(every).alias("_r"))
    return out.select(*keys, F.col("_r")[order].alias(order), *[F.col("_r")[v].alias(v) for v in values])


def with_speed(df: DataFrame, keys: list[str], order: list[str], *axes: str, rate: float = 10.0) -> DataFrame:
    """Adds ``speed``: the distance to the row before times the rate; the first
    row of a key group (a segment) borrows the second's, one row alone has none."""
    w = Window.partitionBy(*keys).orderBy(*order)
    square = sum((F.pow(F.col(a) - F.lag(a).over(w), 2) for a in axes), F.lit(0.0))
    df = df.withColumn("_v", F.sqrt(square) * rate)
    return df.withColumn("speed", F.when(F.row_number().over(w) == 1, F.lead("_v").over(w)).otherwise(F.col("_v"))).drop("_v")


def second_difference(v: Column, w) -> Column:
    """x[i+1] - 2 x[i] + x[i-1]; NULL at a segment's ends."""
    return F.lead(v).over(w) - 2 * v + F.lag(v).over(w)


def joint_change(df: DataFrame, keys: list[str], order: list[str], axes: list[tuple[str, ...]], rate: float = 10.0, least: int = 4) -> DataFrame:
    """Adds ``joint``: the sum over bodies of their change of velocity; NULL at
    the ends of key groups and in those of under ``least`` rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    total = F.lit(0.0)
    for body in axes:
        total = total + F.sqrt(sum((F.pow(second_difference(F.col(a), w), 2) for a in body), F.lit(0.0)))
    return df.withColumn("joint", F.when(F.count("*").over(Window.partitionBy(*keys)) >= least, total * rate**2))


def gradient(v: Column, w, rate: float = 1.0) -> Column:
    """Central difference; one-sided at the ends of the whole series."""
    first, last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
    return F.when(first, F.lead(v).over(w) - v).when(last, v - F.lag(v).over(w)).otherwise((F.lead(v).over(w) - F.lag(v).over(w)) / 2) * rate
