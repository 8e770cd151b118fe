"""Coverage of frames, samples of them, and a series' ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage(frames: DataFrame, keys: list[str], wide: Column, complete: Column, fps: float = 10.0) -> DataFrame:
    """(keys, coverage, screen_s): the share of frames that are wide with all
    positions known, and the seconds of wide frames."""
    seen = F.avg(F.when(wide & complete, 1.0).otherwise(0.0))
    return frames.groupBy(*keys).agg(seen.alias("coverage"), (F.count_if(wide) / fps).alias("screen_s"))


def strided(df: DataFrame, keys: list[str], order: list[str], parts: int = 6, most: int = 8) -> DataFrame:
    """Every n-th row of each key, n = max(rows // parts, 1), ``most`` at most,
    with its number ``k``."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_step", F.greatest(F.floor(F.count("*").over(w) / parts), F.lit(1)))
    return rows.filter((F.col("_i") % F.col("_step") == 0) & (F.col("_i") / F.col("_step") < most)).withColumn("k", (F.col("_i") / F.col("_step")).cast("int")).drop("_i", "_step")


def spread(df: DataFrame, keys: list[str], order: list[str], many: int) -> DataFrame:
    """At most ``many`` rows of each key at even distances, both ends included."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    at = F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda k: F.floor(k * (F.col("_n") - 1) / max(many - 1, 1)))
    return rows.filter((F.col("_n") <= many) | F.array_contains(at, F.col("_i"))).drop("_i", "_n")


def ends(series: DataFrame, keys: list[str], t: str, v: str) -> DataFrame:
    """(keys, earliest, final): a series' first and last value."""
    at = F.struct(F.col(t).alias("t"), F.col(v).alias("v"))
    return series.groupBy(*keys).agg(F.min(at)["v"].alias("earliest"), F.max(at)["v"].alias("final"))


def decay_onset(series: DataFrame, keys: list[str], t: str, v: str, low: float = 0.6, high: float = 0.85, least: int = 8) -> DataFrame:
    """(keys, onset): the first run of ``least`` samples under ``low`` (NULL
    breaks it), dated back to the last sample of ``high`` or more before it
    (without one, the run's start)."""
    from .events import sustained

    runs = sustained(series, keys, [t], F.col(v) < low, least, t).groupBy(*keys).agg(F.min("start_t").alias("_run"))
    before = series.join(runs, keys).groupBy(*keys).agg(F.max(F.when((F.col(t) <= F.col("_run")) & (F.col(v) >= high), F.col(t))).alias("_high"), F.first("_run").alias("_run"))
    return before.select(*keys, F.coalesce("_high", "_run").alias("onset"))


def replaced(telemetry: DataFrame, column: str, fresh: DataFrame, key: str = "fight_id") -> DataFrame:
    """``telemetry`` with ``column`` taken from ``fresh`` (key, column) where it
    has the key; all else as it was, in the same order of columns."""
    new = fresh.select(key, F.struct(column).alias("_fresh"))
    joined = telemetry.join(new, key, "left")
    return joined.withColumn(column, F.when(F.col("_fresh").isNotNull(), F.col(f"_fresh.{column}")).otherwise(F.col(column))).select(*telemetry.columns)


def markdown(df: DataFrame) -> DataFrame:
    """One ``line`` a row of a Markdown table, NULL as a dash; the header and
    its rule are the rows before."""
    cells = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—"))
    body = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cells(c) for c in df.columns]), F.lit(" |")).alias("line"))
    head = df.sparkSession.createDataFrame([("| " + " | ".join(df.columns) + " |",), ("|" + "---|" * len(df.columns),)], "line string")
    return head.unionByName(body)
