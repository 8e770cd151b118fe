"""Event detection on per-frame tables: spikes, bursts, contacts, debounce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.saving import save

HIT_FACTOR, HIT_RANGE_M, MIN_GAP_S = 4.0, 2.5, 3.0


def spikes(df: DataFrame, keys: list[str], v: str, factor: float = HIT_FACTOR) -> DataFrame:
    """Rows whose v is over factor times its key's median (a positive one)."""
    base = F.percentile(v, 0.5).over(Window.partitionBy(*keys))
    return df.withColumn("base", base).filter((F.col("base") > 0) & (F.col(v) > factor * F.col("base")))


def bursts(df: DataFrame, keys: list[str], order: list[str], t: str, gap: float = MIN_GAP_S) -> DataFrame:
    """Adds ``burst``: rows chained while they are under ``gap`` apart; a row
    exactly ``gap`` later begins a new one (unlike session_window)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    begin = F.when(F.col(t) - F.lag(t).over(w) < gap, 0).otherwise(1)
    return df.withColumn("_begin", begin).withColumn("burst", F.sum("_begin").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_begin")


#: Rows of a burst that are folded as one array.
SHORT = 256


def debounced(df: DataFrame, keys: list[str], fields: list[str], t: str, gap: float) -> DataFrame:
    """The rows a greedy pass accepts: the first, and each at least ``gap``
    after the last accepted one. ``t`` is the first of ``fields``, which give
    the order; rows without it go.

    A row ``gap`` after the one before it is accepted whatever came earlier, and
    those less than ``gap`` after such a head are not, so only the rest, the
    open rows, is written and decided, burst by burst. Up to SHORT of them are
    folded as an array; in longer bursts each points to the first that is
    ``gap`` later, and those that the head reaches are found by doubling the
    pointers, however many a key has."""
    if fields[0] != t:
        raise ValueError("t must come first in the order; see debounced_in_turn")
    order = Window.partitionBy(*keys).orderBy(*fields)
    rows = df.select(*keys, *fields).filter(F.col(t).isNotNull())
    rows = rows.withColumn("_head", F.coalesce(F.col(t) - F.lag(t).over(order) >= gap, F.lit(True)))
    rows = rows.withColumn("_from", F.last(F.when(F.col("_head"), F.col(t)), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = save(rows.filter(F.col("_head") | (F.col(t) - F.col("_from") >= gap)), "debounced")
    out = rows.filter("_head").select(*keys, *fields)
    open_, burst = rows.filter("not _head"), [*keys, "_from"]
    most = open_.groupBy(*burst).count().agg(F.max("count")).first()[0]
    if not most:
        return out
    many = open_.withColumn("_n", F.count("*").over(Window.partitionBy(*burst)))
    if most <= SHORT:
        many = open_.withColumn("_n", F.lit(1))
    lists = many.filter(F.col("_n") <= SHORT).groupBy(*burst).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_r"))
    # The first open row is accepted: its head is gap or more before it.
    step = lambda kept, r: F.when(r[t] - F.element_at(kept, -1)[t] >= gap, F.concat(kept, F.array(r))).otherwise(kept)
    folded = lists.select(*keys, F.explode(F.aggregate(F.slice("_r", 2, SHORT), F.slice("_r", 1, 1), step)).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in fields])
    out = out.unionByName(folded)
    if most > SHORT:
        long = many.filter(F.col("_n") > SHORT).withColumn("_at", F.row_number().over(Window.partitionBy(*burst).orderBy(*fields)))
        out = out.unionByName(_reached(save(long, "bursts"), burst, t, gap).select(*keys, *fields))
    return out


def _reached(rows: DataFrame, burst: list[str], t: str, gap: float) -> DataFrame:
    """The rows of bursts (numbered by _at) that the first one reaches by steps
    of at least ``gap``."""
    at = rows.select(*burst, F.col(t).alias("_t"), F.lit(0).alias("_ask"), "_at")
    asks = rows.select(*burst, (F.col(t) + gap).alias("_t"), F.lit(1).alias("_ask"), "_at")
    seen = Window.partitionBy(*burst).orderBy(F.desc("_t"), "_ask", F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    to = F.last(F.when(F.col("_ask") == 0, F.col("_at")), ignorenulls=True).over(seen)
    steps = at.unionByName(asks).withColumn("_to", to).filter("_ask = 1 and _to is not null").select(*burst, "_at", "_to")
    steps = save(steps, "steps")
    found = rows.filter("_at = 1").select(*burst, "_at")
    while steps.limit(1).count():
        found = save(found.unionByName(found.join(steps, [*burst, "_at"]).select(*burst, F.col("_to").alias("_at"))), "found")
        # Steps of twice the length.
        after = steps.select(*burst, F.col("_at").alias("_to"), F.col("_to").alias("_then"))
        steps = save(steps.join(after, [*burst, "_to"]).select(*burst, "_at", F.col("_then").alias("_to")), "steps")
    return rows.join(found, [*burst, "_at"], "left_semi")


def debounced_in_turn(df: DataFrame, keys: list[str], turn: str, turns: list, fields: list[str], t: str, gap: float) -> DataFrame:
    """``debounced`` over a key's rows of each of ``turns`` one after the other
    with one memory: a turn's rows count from ``gap`` after the last that the
    turns before it accepted."""
    out = []
    for value in turns:
        rows = df.filter(F.col(turn) == value).select(*keys, turn, *fields)
        if out:
            last = out[0]
            for more in out[1:]:
                last = last.unionByName(more)
            last = last.groupBy(*keys).agg(F.max(t).alias("_last"))
            rows = rows.join(last, keys, "left").filter(F.col("_last").isNull() | (F.col(t) - F.col("_last") >= gap)).drop("_last")
        out.append(debounced(rows, keys, fields, t, gap).withColumn(turn, F.lit(value)))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def sustained(df: DataFrame, keys: list[str], order: list[str], below: Column, least: int, t: str) -> DataFrame:
    """Runs of ``least`` rows or more on which ``below`` holds (NULL breaks one)."""
    from .segments import islands

    runs = islands(df.withColumn("_low", F.coalesce(below, F.lit(False))), keys, order, t, "_low")
    return runs.filter(F.col("_low") & (F.col("n") >= least)).drop("_low", "seg")


def before_cutoff(df: DataFrame, cutoffs: DataFrame, keys: list[str], t: str, margin: float = 1.0) -> DataFrame:
    """Rows with t < cutoff - margin where their key has a cutoff; all others stay."""
    joined = df.join(cutoffs.select(*keys, F.col("cutoff")), keys, "left")
    return joined.filter(F.col("cutoff").isNull() | (F.col(t) < F.col("cutoff") - margin)).drop("cutoff")


def contacts(frames: DataFrame, found: DataFrame, pad: int = 5) -> DataFrame:
    """(fight_id, burst, peak): the frame of least separation in each burst,
    widened by ``pad`` frames; NULL is skipped, the first frame wins ties."""
    spans = found.groupBy("fight_id", "burst").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    wide = spans.withColumn("i", F.explode(F.sequence(F.col("lo") - pad, F.col("hi") + pad)))
    near = wide.join(frames.select("fight_id", "i", "sep"), ["fight_id", "i"]).filter("sep is not null")
    return near.groupBy("fight_id", "burst").agg(F.min(F.struct("sep", "i")).alias("_m")).select("fight_id", "burst", F.col("_m.i").alias("peak"))


def with_release(frames: DataFrame, fps: float = 10.0, ahead: int = 5) -> DataFrame:
    """Adds ``release``: the fastest growth of separation over the next frames."""
    w = Window.partitionBy("fight_id").orderBy("i")
    grown = (F.lead("sep").over(w) - F.col("sep")) * fps
    return frames.withColumn("_g", grown).withColumn("release", F.max("_g").over(w.rowsBetween(0, ahead - 1))).drop("_g")


def hits(frames: DataFrame, fps: float = 10.0) -> DataFrame:
    """Hits (fight_id, t, magnitude, actor, target) from a frame table
    (fight_id, bot_a, bot_b, i, t, joint, sep, ax, ay, bx, by, avx, avy, bvx, bvy).

    Candidates spike in joint change at close range; a burst's contact is its
    least separation; contacts are debounced; the actor approaches faster just
    before (the first side where the gap is unknown, the second where a speed is).
    """
    frames = with_release(frames, fps)
    near = spikes(frames, ["fight_id"], "joint").filter(F.col("sep") < HIT_RANGE_M)
    peaks = contacts(frames, bursts(near, ["fight_id"], ["i"], "t"))
    before = frames.select("fight_id", (F.col("i") + 3).alias("peak"), "ax", "ay", "bx", "by", "avx", "avy", "bvx", "bvy")
    at = frames.select("fight_id", F.col("i").alias("peak"), "t", "joint", "release", "bot_a", "bot_b")
    joined = peaks.join(at, ["fight_id", "peak"]).join(before, ["fight_id", "peak"], "left")
    gap = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    ux, uy = (F.col("bx") - F.col("ax")) / gap, (F.col("by") - F.col("ay")) / gap
    va, vb = F.col("avx") * ux + F.col("avy") * uy, -(F.col("bvx") * ux + F.col("bvy") * uy)
    first = F.when(gap.isNull() | (gap == 0), True).otherwise(F.coalesce(va >= vb, F.lit(False)))
    size = F.round(F.greatest(F.coalesce("release", F.col("joint") / 2), F.lit(0.5)), 2)
    rows = joined.select("fight_id", "t", size.alias("magnitude"), F.when(first, F.col("bot_a")).otherwise(F.col("bot_b")).alias("actor"), F.when(first, F.col("bot_b")).otherwise(F.col("bot_a")).alias("target"))
    return debounced(rows, ["fight_id"], ["t", "magnitude", "actor", "target"], "t", MIN_GAP_S)


def knockouts(meta: DataFrame, mobility: DataFrame, least: int = 100, below: float = 0.15) -> DataFrame:
    """(fight_id, t, actor, target): the recorded knockout, else the first bot,
    in the fight's order, that stays under ``below`` for ``least`` frames."""
    known = meta.filter("method = 'ko' and time_s is not null").select("fight_id", F.col("time_s").alias("t"), F.col("winner").alias("actor"), F.when(F.col("bot_a") == F.col("winner"), F.col("bot_b")).otherwise(F.col("bot_a")).alias("target"))
    runs = sustained(mobility, ["fight_id", "bot"], ["i"], F.col("mobility") < below, least, "t").groupBy("fight_id", "bot").agg(F.min("start_t").alias("t"))
    rest = meta.join(known.select("fight_id"), "fight_id", "left_anti").join(runs, "fight_id").filter((F.col("bot") == F.col("bot_a")) | (F.col("bot") == F.col("bot_b")))
    first = rest.groupBy("fight_id", "bot_a", "bot_b").agg(F.min(F.struct((F.col("bot") != F.col("bot_a")).alias("second"), "t")).alias("_m"))
    seen = first.select("fight_id", F.col("_m.t").alias("t"), F.when(F.col("_m.second"), F.col("bot_a")).otherwise(F.col("bot_b")).alias("actor"), F.when(F.col("_m.second"), F.col("bot_b")).otherwise(F.col("bot_a")).alias("target"))
    return known.unionByName(seen)


def hazards(frames: DataFrame, per_bot: bool = False, factor: float = HIT_FACTOR) -> DataFrame:
    """Hazards: a spike beside a wall with the other body far. The debounce
    goes over the first bot's rows and then the second's with one memory (or
    one for each bot), as the fight's sides are visited in order."""
    spiked = spikes(frames, ["fight_id"], "joint", factor).filter("sep > 3.0")
    side = lambda n, bot, other, wall: spiked.filter(F.col(wall) < 1.2).select("fight_id", F.lit(n).alias("side"), "t", F.round(F.col("joint") / 2, 2).alias("magnitude"), F.col(other).alias("actor"), F.col(bot).alias("target"))
    rows = side(0, "bot_a", "bot_b", "wall_a").unionByName(side(1, "bot_b", "bot_a", "wall_b"))
    fields = ["t", "magnitude", "actor", "target"]
    if per_bot:
        return debounced(rows, ["fight_id", "side"], fields, "t", MIN_GAP_S).drop("side")
    return debounced_in_turn(rows, ["fight_id"], "side", [0, 1], fields, "t", MIN_GAP_S).drop("side")


def merged(found_hits: DataFrame, found_hazards: DataFrame, kos: DataFrame) -> DataFrame:
    """All events; those from a second before a knockout on give way to it."""
    typed = lambda df, kind: df.select("fight_id", "t", F.lit(kind).alias("type"), "magnitude", "actor", "target")
    early = before_cutoff(typed(found_hits, "hit").unionByName(typed(found_hazards, "hazard")), kos.select("fight_id", F.col("t").alias("cutoff")), ["fight_id"], "t")
    return early.unionByName(typed(kos.withColumn("magnitude", F.lit(None).cast("double")), "ko"))
