"""In-contest win probability and its calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringside.functions.numeric import bin_of, brier, log_loss, logistic

from .matching import interval_sums
from .rolling import filled

# Fixed values of the model.
W_CONTROL, W_HITS, W_MOBILITY, HIT_SCALE, HIT_WINDOW_S, RAMP_S = 1.2, 1.5, 2.2, 8.0, 30, 5.0


def logit(control: Column, hits: Column, mobility_a: Column, mobility_b: Column) -> Column:
    return W_CONTROL * control + W_HITS * F.tanh(hits / HIT_SCALE) + W_MOBILITY * (mobility_a - mobility_b)


def ramped(p: Column, sec: Column, ko_t: Column, first_wins: Column) -> Column:
    """p, drawn linearly to 0.99 or 0.01 over the seconds before a knockout."""
    share = F.least(F.lit(1.0), (sec - (ko_t - RAMP_S)) / RAMP_S)
    goal = F.when(first_wins, 0.99).otherwise(0.01)
    return F.when(ko_t.isNull() | first_wins.isNull() | (sec < ko_t - RAMP_S), p).otherwise(p + (goal - p) * share)


def momentum(meta: DataFrame, control: DataFrame, mobility: DataFrame, events: DataFrame) -> DataFrame:
    """(fight_id, sec, value): P(bot_a wins) on the grid of all whole seconds
    from control (fight_id, sec, value) and mobility (with bot), 1 Hz."""
    sides = meta.select("fight_id", "bot_a", "bot_b")
    ends = control.select("fight_id", "sec").unionByName(mobility.select("fight_id", "sec")).groupBy("fight_id").agg(F.max("sec").alias("end"))
    grid = sides.join(ends, "fight_id").withColumn("sec", F.explode(F.sequence(F.lit(0).cast("long"), F.col("end").cast("long")))).drop("end")
    open_end = lambda s, keys: grid.select(*keys, "sec").join(s, [*keys, "sec"], "left")
    c = filled(open_end(control, ["fight_id"]), ["fight_id"], 0.0).withColumnRenamed("value", "c")
    side = lambda name, out: filled(open_end(mobility.join(sides.select("fight_id", F.col(name).alias("bot")), ["fight_id", "bot"]).select("fight_id", "sec", "value"), ["fight_id"]), ["fight_id"], 1.0).withColumnRenamed("value", out)
    signed = events.filter("type in ('hit', 'hazard')").join(sides, "fight_id")
    sign = F.when(F.col("actor") == F.col("bot_a"), 1).when(F.col("actor") == F.col("bot_b"), -1).when(F.col("target") == F.col("bot_b"), 1).when(F.col("target") == F.col("bot_a"), -1).otherwise(0)
    sums = interval_sums(signed.withColumn("v", sign * F.coalesce("magnitude", F.lit(0.0))), ["fight_id"], "t", "v", HIT_WINDOW_S).withColumnRenamed("value", "h")
    ko = events.filter("type = 'ko'").groupBy("fight_id").agg(F.min(F.struct("t", "actor")).alias("ko"))
    rows = grid.join(c, ["fight_id", "sec"]).join(side("bot_a", "ma"), ["fight_id", "sec"]).join(side("bot_b", "mb"), ["fight_id", "sec"]).join(sums, ["fight_id", "sec"], "left").join(ko, "fight_id", "left")
    p = logistic(logit(F.col("c"), F.coalesce("h", F.lit(0.0)), F.col("ma"), F.col("mb")))
    first = F.when(F.col("ko.actor") == F.col("bot_a"), True).when(F.col("ko.actor") == F.col("bot_b"), False)
    return rows.select("fight_id", "sec", F.round(ramped(p, F.col("sec"), F.col("ko.t"), first), 4).alias("value"))


def reliability(samples: DataFrame, p: str, y: str, closed: bool = True) -> DataFrame:
    """Ten equal-width bins; empty ones are absent. ``closed``: p = 1 counts."""
    found = samples.withColumn("bin", bin_of(F.col(p), 10, closed)).filter("bin is not null")
    return found.groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_predicted"), F.avg(y).alias("actual_rate"))


def scores(samples: DataFrame, p: str, y: str) -> DataFrame:
    return samples.agg(F.count("*").alias("n"), brier(F.col(p), F.col(y)).alias("brier"), log_loss(F.col(p), F.col(y)).alias("log_loss"))


def calibration(meta: DataFrame, curve: DataFrame, lead: float = 5.0) -> DataFrame:
    """(fight_id, p, y): every point at least ``lead`` seconds before the end of
    a fight with a known winner."""
    last = curve.groupBy("fight_id").agg(F.max("sec").alias("last"))
    known = meta.filter((F.col("winner") == F.col("bot_a")) | (F.col("winner") == F.col("bot_b"))).join(last, "fight_id")
    end = F.coalesce(F.nullif("time_s", F.lit(0)), F.col("last").cast("double"))
    rows = curve.join(known.select("fight_id", end.alias("end"), (F.col("winner") == F.col("bot_a")).cast("int").alias("y")), "fight_id")
    return rows.filter(F.col("sec") < F.col("end") - lead).select("fight_id", F.col("value").alias("p"), "y")
