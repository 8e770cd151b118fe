"""The tables behind an overlay: which window, what flashes, and where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.functions.numeric import FLOOR_M

from .matching import band_join
from .selection import order_values

# Fixed values of the overlay.
HERO_S, KO_CUSHION_S, FLASH_S = 90.0, 5.0, 0.4
CANVAS, MARGIN, OUT = (1280, 720), 40.0, (1280, 720)


def hero_windows(fights: DataFrame, events: DataFrame) -> DataFrame:
    """(fight_id, start_t, end_t) from fights (fight_id, duration_s) and
    events (fight_id, t, type, magnitude): HERO_S around just after the first
    knockout, else around the strongest hit (the earliest on ties), else the
    beginning; a shorter fight whole."""
    knockout = F.min(F.when(F.col("type") == "ko", F.col("t"))) + KO_CUSHION_S
    hit = (F.col("type") == "hit") & F.col("magnitude").isNotNull()
    strongest = F.min(F.when(hit, F.struct((-F.col("magnitude")).alias("m"), F.col("t").alias("t"))))["t"]
    centre = events.groupBy("fight_id").agg(F.coalesce(knockout, strongest).alias("centre"))
    rows = fights.join(centre, "fight_id", "left")
    middle = F.coalesce("centre", F.lit(HERO_S / 2)) - HERO_S / 2
    start = F.when(F.col("duration_s") <= HERO_S, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(middle, F.col("duration_s") - HERO_S)))
    return rows.select("fight_id", start.alias("start_t"), F.when(F.col("duration_s") <= HERO_S, F.col("duration_s")).otherwise(start + HERO_S).alias("end_t"))


def hit_flashes(events: DataFrame, frames: DataFrame, keys: list[str], t: str = "t", lasts: float = FLASH_S, more: list[str] | None = None) -> DataFrame:
    """Frames on which an event still flashes, 0 <= age < ``lasts``, with the
    flash's age and radius in pixels. ``events``: keys, event_t, magnitude and
    ``more``."""
    met = band_join(events.select(*keys, "event_t", "magnitude", *(more or [])), frames, keys, "event_t", t, 0.0, lasts)
    age = F.col(t) - F.col("event_t")
    size = F.least(F.lit(1.0), F.coalesce(F.nullif(F.col("magnitude"), F.lit(0.0)), F.lit(5.0)) / 10)
    return met.withColumn("age", age).filter((F.col("age") >= 0) & (F.col("age") < lasts)).withColumn("radius", F.floor(14 + 40 * (F.col("age") / lasts) * size).cast("int"))


def schematic(v: Column, canvas: tuple[int, int] = CANVAS, margin: float = MARGIN) -> Column:
    """A floor coordinate in metres as a pixel of the drawn floor."""
    return margin + v * ((min(canvas) - 2 * margin) / FLOOR_M)


def letterbox(width: Column, height: Column, out: tuple[int, int] = OUT) -> dict[str, Column]:
    """Where a picture lies in an ``out`` frame of another shape."""
    scale = F.least(out[0] / width, out[1] / height)
    w, h = F.floor(width * scale).cast("int"), F.floor(height * scale).cast("int")
    left, top = (F.floor((F.lit(total) - x) / 2).cast("int") for total, x in zip(out, (w, h)))
    return {"w": w, "h": h, "left": left, "top": top}


def marker_radius(df: DataFrame, keys: list[str], magnitude: str) -> DataFrame:
    """Adds ``radius``, 2.5 to 8.5 by the magnitude's share of its key's
    greatest (1 at least)."""
    most = df.groupBy(*keys).agg(F.greatest(F.lit(1.0), F.coalesce(F.max(magnitude), F.lit(0.0))).alias("_most"))
    return df.join(most, keys).withColumn("radius", 2.5 + 6 * F.coalesce(magnitude, F.lit(0.0)) / F.col("_most")).drop("_most")


def trails(df: DataFrame, keys: list[str], order: list[str], value: Column, rows: int = 30) -> DataFrame:
    """(keys, trail): the last ``rows`` values in order, NULLs kept."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    last = df.select(*keys, *order, value.alias("_v")).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= rows)
    return last.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("_rn")).alias("rn"), F.col("_v").alias("v")))).alias("_r")).select(*keys, F.transform("_r", lambda x: x["v"]).alias("trail"))


def outliers(df: DataFrame, value: str, score: str) -> DataFrame:
    """Adds ``labelled``: rows whose value is far over the middle one with a
    low score, or far under it with a high one; all rows of four or fewer. The
    middle is the element at half the count, selected now, pass by pass."""
    n, found = order_values(df.select(F.col(value).cast("double").alias("v")), "v", lambda n: [n // 2])
    total = n if n > 4 else df.count()
    if total <= 4:
        return df.withColumn("labelled", F.lit(True))
    if not found:
        return df.withColumn("labelled", F.lit(False))
    high, low = F.col(value) > 1.5 * found[0], F.col(value) < 0.67 * found[0]
    return df.withColumn("labelled", F.coalesce((high & (F.col(score) < 0.5)) | (low & (F.col(score) > 0.5)), F.lit(False)))
