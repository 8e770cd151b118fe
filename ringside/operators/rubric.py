"""The 11-point rubric scorecard and the disagreement leaderboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.functions.numeric import half_even_split

# The rubric's points.
DAMAGE, AGGRESSION, CONTROL = 5, 3, 3
# Fixed value: the relative error of one addition of doubles, with room to spare.
SUM_ERROR = 4e-16


def card(damage: Column, aggression: Column, control: Column) -> dict[str, Column]:
    """The split of each category for side A's shares, winner and margin."""
    parts = {"damage": half_even_split(damage, DAMAGE), "aggression": half_even_split(aggression, AGGRESSION), "control": half_even_split(control, CONTROL)}
    a, b = (sum((v[k] for v in parts.values()), F.lit(0)) for k in (0, 1))
    out = {f"{name}_{side}": v[k] for name, v in parts.items() for k, side in enumerate("ab")}
    return out | {"winner": F.when(a >= b, "A").otherwise("B"), "margin": F.round(F.abs(a - b) / 11, 2)}


def end_median(values: DataFrame, keys: list[str], order: str, v: str, rows: int = 100) -> DataFrame:
    """The median of each key's last ``rows`` values that aren't NULL."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    last = values.filter(F.col(v).isNotNull()).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= rows)
    return last.groupBy(*keys).agg(F.percentile(v, 0.5).alias("end_value"))


def initiations(frames: DataFrame, least: float = 0.3) -> DataFrame:
    """(fight_id, a, b): frames on which the sides close in faster than
    ``least``, by who is the faster; from (fight_id, seg, i, ax .. by) of
    segments of three frames or more, with forward differences."""
    w = Window.partitionBy("fight_id", "seg").orderBy("i")
    d = lambda c: (F.lead(c).over(w) - F.col(c)) * 10.0
    gap = F.greatest(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")), F.lit(1e-9))
    ux, uy = (F.col("bx") - F.col("ax")) / gap, (F.col("by") - F.col("ay")) / gap
    rows = frames.withColumn("_n", F.count("*").over(Window.partitionBy("fight_id", "seg"))).filter("_n >= 3")
    rows = rows.withColumn("va", d("ax") * ux + d("ay") * uy).withColumn("vb", -(d("bx") * ux + d("by") * uy))
    closing = F.col("va") + F.col("vb") > least
    return rows.groupBy("fight_id").agg(F.count_if(closing & (F.col("va") > F.col("vb"))).alias("a"), F.count_if(closing & (F.col("vb") > F.col("va"))).alias("b"))


def scorecards(meta: DataFrame, frames: DataFrame, control: DataFrame, mobility: DataFrame) -> DataFrame:
    """One card a fight, from frames, the 1 Hz control and the 10 Hz mobility."""
    ends = end_median(mobility, ["fight_id", "bot"], "i", "mobility")
    side = lambda name: meta.select("fight_id", F.col(name).alias("bot")).join(ends, ["fight_id", "bot"], "left").select("fight_id", (1 - F.least(F.coalesce("end_value", F.lit(1.0)), F.lit(1.0))).alias(f"decay_{name[-1]}"))
    rows = meta.join(side("bot_a"), "fight_id").join(side("bot_b"), "fight_id").join(initiations(frames), "fight_id", "left").join(control.groupBy("fight_id").agg(F.avg("value").alias("mean_control")), "fight_id", "left")
    half = lambda x, total: F.when(total > 0, x / total).otherwise(0.5)
    damage = half(F.col("decay_b"), F.col("decay_a") + F.col("decay_b"))
    aggression = half(F.coalesce("a", F.lit(0)), F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0)))
    control_share = (F.coalesce("mean_control", F.lit(0.0)) + 1) / 2
    cols = card(damage, aggression, control_share)
    return rows.select("fight_id", *[c.alias(k) for k, c in cols.items()], damage.alias("damage_share"), control_share.alias("control_share"), "a", "b")


def tallies(rows: DataFrame, key: str, order: list[str], a: str, b: str) -> DataFrame:
    """(key, a, b): sums of two columns of which 2 a is held against b. A sum of
    doubles varies with its order, by ``slack`` at most. Where that can turn the
    comparison, or the difference in hundredths, rows are added one by one in
    ``order``, as a plain pass over the table does; all other sums in any order."""
    size = F.sum(F.abs(a)) * 2 + F.sum(F.abs(b))
    sums = rows.groupBy(key).agg(F.sum(a).alias("a"), F.sum(b).alias("b"), (F.count("*") * size * SUM_ERROR).alias("slack"))
    margin = F.abs(2 * F.col("a") - F.col("b"))
    near = (margin <= F.col("slack")) | (F.abs(F.pmod(margin * 100, F.lit(1.0)) - 0.5) <= F.col("slack") * 100)
    sums = sums.withColumn("near", F.coalesce(near, F.lit(False)))
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    again = rows.join(sums.filter("near").select(key), key, "left_semi")
    again = again.select(key, F.struct(*order).alias("_at"), F.struct(F.sum(a).over(w).alias("a"), F.sum(b).over(w).alias("b")).alias("_s"))
    again = again.groupBy(key).agg(F.max_by("_s", "_at").alias("_s")).select(key, "_s.a", "_s.b")
    return sums.filter("not near").select(key, "a", "b").unionByName(again)


def robbery(method: Column, official: Column, ours: Column, margin: Column) -> Column:
    """Our margin where judges decided otherwise; a knockout is never one."""
    return F.when((method == "jd") & (official != ours), margin).otherwise(F.lit(0.0))


def robberies(rows: DataFrame, key: str) -> DataFrame:
    """Fights (key, method, official, ours, margin) with their robbery, the
    greatest first."""
    return rows.withColumn("robbery", robbery(F.col("method"), F.col("official"), F.col("ours"), F.col("margin"))).orderBy(F.desc("robbery"), key)


def leaderboard(cards: DataFrame, meta: DataFrame) -> DataFrame:
    """Cards with names, the greatest robbery first, fights in order on ties."""
    named = lambda c: F.when(F.col(c) == "A", F.col("bot_a")).when(F.col(c) == "B", F.col("bot_b"))
    official = F.when(F.col("m.winner") == F.col("bot_a"), "A").when(F.col("m.winner") == F.col("bot_b"), "B")
    rows = cards.alias("c").join(meta.alias("m"), "fight_id").withColumn("official", official).withColumn("ours", F.col("c.winner"))
    return robberies(rows, "fight_id").select("fight_id", F.concat_ws(" vs ", "bot_a", "bot_b").alias("bots"), named("ours").alias("our_winner"), named("official").alias("official_winner"), "margin", "robbery")


def cheap_card(scores: DataFrame) -> DataFrame:
    """(fight_id, winner, margin) from an external scorer's points (fight_id,
    damage_a, damage_b, aggression_a, .. control_b), whole numbers."""
    a, b = (sum((F.col(f"{k}_{s}").cast("int") for k in ("damage", "aggression", "control")), F.lit(0)) for s in "ab")
    return scores.select("fight_id", F.when(a >= b, "A").otherwise("B").alias("winner"), F.round(F.abs(a - b) / (DAMAGE + AGGRESSION + CONTROL), 2).alias("margin"))
