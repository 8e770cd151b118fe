"""The per-fight analysis, over all fights at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringside.functions import numeric as N
from ringside.operators import events, kinematics, momentum, rolling, rubric, segments
from ringside.saving import save


@dataclass
class Bout:
    frames: DataFrame
    control: DataFrame
    speed: DataFrame
    mobility_10hz: DataFrame
    mobility: DataFrame
    events: DataFrame
    momentum: DataFrame
    scorecards: DataFrame


def smoothed_frames(frames: DataFrame) -> DataFrame:
    """Frames with smoothed positions, separation, wall distances, joint change
    of velocity and central velocities. Smoothing and second differences stay
    inside segments of known positions."""
    known = frames.withColumn("known", F.col("ax").isNotNull() & F.col("bx").isNotNull())
    seg = segments.with_segments(known, ["fight_id"], ["i"], "known")
    axes = ["ax", "ay", "bx", "by"]
    smooth = kinematics.smoothed(seg.filter("known"), ["fight_id", "seg"], "i", *axes).drop("seg")
    wide = seg.drop(*axes).join(smooth, ["fight_id", "i"], "left")
    wide = kinematics.joint_change(wide, ["fight_id", "seg"], ["i"], [("ax", "ay"), ("bx", "by")])
    w = Window.partitionBy("fight_id").orderBy("i")
    for a in axes:
        wide = wide.withColumn(f"{a[0]}v{a[1]}", kinematics.gradient(F.col(a), w, 10.0))
    gap = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    return wide.withColumn("sep", gap).withColumn("wall_a", N.wall_distance(F.col("ax"), F.col("ay"))).withColumn("wall_b", N.wall_distance(F.col("bx"), F.col("by")))


def kinematic_series(frames: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """control, speed and mobility at 1 Hz, and mobility at 10 Hz."""
    w = ["fight_id"]
    for s in "ab":
        x, y = F.col(f"{s}x"), F.col(f"{s}y")
        frames = frames.withColumn(f"c{s}", N.flag(N.centre_distance(x, y) < N.CENTRE_RADIUS_M)).withColumn(f"p{s}", N.flag(F.col(f"wall_{s}") < N.PINNED_M))
    control = rolling.control(frames, w, ["i"], ("ca", "cb"), ("pa", "pb"))
    control_1hz = rolling.resampled(control, w, F.col("t"), "control").withColumn("value", F.round("value", 4))
    side = lambda s: frames.select("fight_id", "seg", "i", "t", F.col(f"bot_{s}").alias("bot"), F.col(f"{s}x").alias("x"), F.col(f"{s}y").alias("y"))
    bots = side("a").unionByName(side("b"))
    speeds = kinematics.with_speed(bots, ["fight_id", "bot", "seg"], ["i"], "x", "y")
    speed_1hz = rolling.resampled(speeds, ["fight_id", "bot"], F.col("t"), "speed").withColumn("value", F.round("value", 4))
    mobility = rolling.mobility(speeds, ["fight_id", "bot"], ["i"], "speed", "i")
    mobility_1hz = rolling.resampled(mobility, ["fight_id", "bot"], F.col("t"), "mobility").withColumn("value", F.round("value", 4))
    return control_1hz, speed_1hz, mobility, mobility_1hz


def analyse(frames: DataFrame, meta: DataFrame) -> Bout:
    """Frames (see sources.artifacts.frames) and sides to all results. What
    several later steps read, the smoothed frames, the mobility at 10 Hz and the
    events, is written to the shared folder, so that a lost executor loses none."""
    smooth = save(smoothed_frames(frames), "smoothed")
    control, speed, mobility_10, mobility = kinematic_series(smooth)
    mobility_10 = save(mobility_10, "mobility")
    kos = events.knockouts(meta, mobility_10)
    found = save(events.merged(events.hits(smooth), events.hazards(smooth), kos), "events")
    curve = momentum.momentum(meta, control, mobility, found)
    cards = rubric.scorecards(meta, smooth.filter("known"), control, mobility_10)
    return Bout(smooth, control, speed, mobility_10, mobility, found, curve, cards)
