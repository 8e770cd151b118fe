"""League-wide indices: media value, sponsorship, authorship."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringside.functions.numeric import falsy

from . import attention
from .matching import named_in


def with_max(df: DataFrame, *values: str) -> DataFrame:
    """Adds max_<v>: a global aggregate joined back as one row, so that no
    window gathers the table."""
    return df.crossJoin(F.broadcast(df.agg(*[F.max(v).alias(f"max_{v}") for v in values])))


def media_value(sides: DataFrame, exposure: DataFrame, index: DataFrame) -> DataFrame:
    """One row a bot from sides (fight_id, bot, won; NULL undecided), exposure
    (fight_id, screen_s) and index (fight_id, attn_index): fights, seconds on
    screen, mean index over fights that have one, their product, record."""
    rows = sides.join(exposure, "fight_id", "left").join(index, "fight_id", "left")
    out = rows.groupBy("bot").agg(
        F.count("*").alias("fights"),
        F.sum(F.coalesce("screen_s", F.lit(0.0))).alias("screen_s"),
        F.coalesce(F.avg(F.when(F.col("attn_index") > 0, F.col("attn_index"))), F.lit(0.0)).alias("attn_index"),
        F.count_if("won").alias("wins"),
        F.count_if(~F.col("won")).alias("losses"),
    )
    return _with_record(out, "bot")


def rolled_up(rows: DataFrame, bot: str, value: str, won: Column, lost: Column) -> DataFrame:
    """One row a bot from its own rows: their number, the sum of ``value``, its
    mean over its linear 20th percentile, their product, and the record of the
    rows that are ``won`` or ``lost``."""
    out = rows.groupBy(bot).agg(F.count("*").alias("fights"), F.sum(value).alias("screen_s"), (F.avg(value) / F.percentile(value, 0.2)).alias("attn_index"), F.count_if(won).alias("wins"), F.count_if(lost).alias("losses"))
    return _with_record(out, bot)


def _with_record(out: DataFrame, bot: str) -> DataFrame:
    decided = F.col("wins") + F.col("losses")
    perf = F.when(decided > 0, F.col("wins") / decided).otherwise(0.0)
    record = F.concat_ws("-", F.col("wins").cast("string"), F.col("losses").cast("string"))
    return out.select(bot, "fights", "screen_s", "attn_index", (F.col("screen_s") * F.col("attn_index")).alias("media_value"), record.alias("record"), perf.alias("perf_score"))


def authorship(events: DataFrame, points: DataFrame, widths: DataFrame, share: float = 0.25) -> DataFrame:
    """(fight_id, bot, credit): attention at each event times its magnitude to
    the actor, a quarter of it to the target. Events without a point near count nothing."""
    near = widths.select("fight_id", "half_width")
    happened = events.select("fight_id", F.col("t").alias("event_t"), "type", "magnitude", "actor", "target").join(near, "fight_id")
    # Buckets are as wide as each fight's own band.
    bucket = lambda at: F.floor(at / (2 * F.col("half_width")))
    happened = happened.withColumn("_b", F.explode(F.sequence(bucket(F.col("event_t") - F.col("half_width")), bucket(F.col("event_t") + F.col("half_width")))))
    seen = points.select("fight_id", F.col("t").alias("at"), "value").join(near, "fight_id").withColumn("_b", bucket(F.col("at"))).drop("half_width")
    own = happened.join(seen, ["fight_id", "_b"]).filter(F.abs(F.col("at") - F.col("event_t")) <= F.col("half_width"))
    each = own.groupBy("fight_id", "event_t", "type", "magnitude", "actor", "target").agg(F.avg("value").alias("attention"))
    weight = F.col("attention") * falsy(F.col("magnitude"), F.lit(1.0))
    sides = F.explode(F.array(F.struct(F.col("actor").alias("bot"), weight.alias("credit")), F.struct(F.col("target").alias("bot"), (share * weight).alias("credit"))))
    return each.select("fight_id", sides.alias("s")).select("fight_id", "s.*").filter("bot is not null").groupBy("fight_id", "bot").agg(F.sum("credit").alias("credit"))


def sponsor_index(sides: DataFrame, points: DataFrame, events: DataFrame) -> DataFrame:
    """One row a bot from sides (fight_id, bot, won, by_ko), attention points
    and events: critical seconds, peak attention, authorship, performance and
    the weighted score, the highest first."""
    cut = attention.critical_threshold(points)
    widths = attention.spacing(points, ["fight_id"], "t")
    hot = points.crossJoin(F.broadcast(cut)).withColumn("hot", F.col("value") >= F.col("threshold")).groupBy("fight_id").agg(F.count_if("hot").alias("n"), F.avg(F.when(F.col("hot"), F.col("value"))).alias("peak"))
    per_fight = hot.join(widths, "fight_id").select("fight_id", (F.col("n") * F.coalesce("spacing", F.lit(0.0))).alias("critical_s"), "peak")
    credit = authorship(events, points, widths)
    measured = events.select("fight_id").distinct().withColumn("seen", F.lit(True))
    rows = sides.join(per_fight, "fight_id").join(credit, ["fight_id", "bot"], "left").join(measured, "fight_id", "left")
    out = rows.groupBy("bot").agg(
        F.count("*").alias("fights"),
        F.sum("critical_s").alias("critical_seconds"),
        F.avg("peak").alias("peak_attention"),
        F.sum(F.coalesce("credit", F.lit(0.0))).alias("credit"),
        F.count_if("won").alias("wins"),
        F.count_if(F.col("won") & F.col("by_ko")).alias("kos"),
        F.count("won").alias("decided"),
        F.max(F.coalesce("seen", F.lit(False))).alias("has_events"),
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = out.withColumn("spot", F.col("critical_seconds") * F.coalesce("peak_attention", F.lit(0.0))).withColumn("perf", rate("wins", "decided") * (1 + 0.25 * rate("kos", "wins")))
    out = with_max(out, "spot", "credit", "perf")
    part = lambda c: F.round(F.coalesce(F.col(c) / F.nullif(F.col(f"max_{c}"), F.lit(0)), F.lit(0.0)), 4)
    score = F.round(100 * (0.45 * part("spot") + 0.30 * part("credit") + 0.25 * part("perf")), 2)
    confidence = F.when(F.col("has_events"), 1.0).otherwise(0.6) * F.when(F.col("peak_attention").isNull(), 0.5).otherwise(1.0)
    return out.select("bot", score.alias("sponsor_score"), part("spot").alias("spotlight"), part("credit").alias("authorship"), part("perf").alias("performance"), F.round("critical_seconds", 1).alias("critical_seconds"), F.round("peak_attention", 4).alias("peak_attention"), "fights", confidence.alias("confidence")).orderBy(F.desc("sponsor_score"), "bot")


def channel_reach(videos: DataFrame, roster: DataFrame) -> DataFrame:
    """One row a named bot from videos (title, views, views_approx, heat_peak)
    and the roster (name): videos, views, their mean, mean heat, index."""
    reach = named_in(videos, "title", roster.select("name"))
    out = reach.groupBy("name").agg(F.count("*").alias("videos"), F.sum(F.coalesce(falsy(F.col("views"), F.col("views_approx")), F.lit(0))).alias("total_views"), F.avg("heat_peak").alias("heat"))
    index = F.col("total_views") / 1e6 * (1 + F.coalesce("heat", F.lit(0.0)))
    return out.select("name", "videos", "total_views", F.floor(F.col("total_views") / F.col("videos")).alias("avg_views"), F.round("heat", 3).alias("heat_peak"), F.round(index, 2).alias("sponsor_index"))


def missing(fights: DataFrame, found: DataFrame, key: str = "fight_id") -> DataFrame:
    """One row for each key of ``fights`` that ``found`` lacks."""
    return fights.select(key).distinct().join(found.select(key).distinct(), key, "left_anti").select(F.col(key).alias("missing"))
