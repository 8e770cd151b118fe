"""Audience attention: statistics, lift and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringside.functions.numeric import falsy

from .matching import band_join
from .selection import quantile

LIFT_WINDOW_S, CRITICAL_Q = 5.0, 0.70


def stats(points: DataFrame, keys: list[str], t: str, v: str, method: str = "linear") -> DataFrame:
    """baseline (the linear 20th percentile, or the value of lower rank), mean,
    peak and the first time of the peak."""
    base = F.percentile(v, 0.2)
    if method != "linear":  # the value of that rank, from an ordered pass a key
        own = Window.partitionBy(*keys)
        points = points.withColumn("_rank", F.row_number().over(own.orderBy(F.col(v).asc_nulls_last())))
        at = F.greatest(F.floor(F.count(v).over(own) * 0.2), F.lit(1))
        points = points.withColumn("_low", F.when(F.col("_rank") == at, F.col(v)))
        base = F.max("_low")
    first = F.min(F.struct((-F.col(v)).alias("v"), F.col(t).alias("t")))
    return points.groupBy(*keys).agg(base.alias("baseline"), F.avg(v).alias("mean"), F.count(v).alias("n"), F.max(v).alias("peak"), first["t"].alias("peak_t"))


def lift(events: DataFrame, points: DataFrame, base: DataFrame, keys: list[str], window: float = LIFT_WINDOW_S) -> DataFrame:
    """(keys, event_t, type, lift): mean attention around each event over the
    baseline; events without a point in the window, or a positive baseline, are absent."""
    found = band_join(events.select(*keys, F.col("t").alias("event_t"), "type"), points.select(*keys, F.col("t").alias("at"), "value"), keys, "event_t", "at", window, window)
    means = found.groupBy(*keys, "event_t", "type").agg(F.avg("value").alias("mean")).join(base.select(*keys, "baseline"), keys).filter("baseline > 0")
    return means.select(*keys, "event_t", "type", F.round(F.col("mean") / F.col("baseline"), 2).alias("lift"))


def critical_threshold(points: DataFrame, v: str = "value", q: float = CRITICAL_Q) -> DataFrame:
    """One row: the linear quantile of all values pooled, exactly; NULL
    without any. The value is selected now, pass by pass."""
    found = quantile(points, v, q)
    return points.sparkSession.range(1).select(F.lit(found).cast("double").alias("threshold"))


def spacing(points: DataFrame, keys: list[str], t: str) -> DataFrame:
    """(keys, spacing, half_width): the median step, and the adaptive window's
    half, 1.5 steps or 5 s at least."""
    w = Window.partitionBy(*keys).orderBy(t)
    steps = points.withColumn("_d", F.lead(t).over(w) - F.col(t))
    out = steps.groupBy(*keys).agg(F.percentile("_d", 0.5).alias("spacing"))
    return out.withColumn("half_width", F.greatest(F.lit(5.0), F.coalesce(1.5 * F.col("spacing"), F.lit(5.0))))


def heat_map(rows: DataFrame, video: str = "video_id") -> DataFrame:
    """Most-replayed buckets (start, end, value; text or numbers) as midpoints
    and values over the video's peak; malformed ones and peakless videos go."""
    cast = lambda c: F.col(c).try_cast("double")
    clean = rows.select(video, ((cast("start") + cast("end")) / 2).alias("t"), cast("value").alias("value")).dropna()
    peak = F.max("value").over(Window.partitionBy(video))
    return clean.withColumn("_peak", peak).filter("_peak > 0").select(video, "t", (F.col("value") / F.col("_peak")).alias("value"))


def clipped(points: DataFrame, start: float, end: float) -> DataFrame:
    """A curve's part in [start, end], moved to begin at 0."""
    return points.filter((F.col("t") >= start) & (F.col("t") <= end)).withColumn("t", F.col("t") - start)


def with_baseline(stats_: DataFrame, points: DataFrame, keys: list[str], v: str = "value") -> DataFrame:
    """Stored statistics whose baseline, where missing or 0, is the points'
    linear 20th percentile."""
    own = points.groupBy(*keys).agg(F.percentile(v, 0.2).alias("_base"))
    return stats_.join(own, keys, "left").withColumn("baseline", falsy(F.col("baseline"), F.col("_base"))).drop("_base")
