"""Greedy online clustering of signatures, one ordered pass a key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import fold


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(v: Column) -> Column:
    """A vector about its mean, at length 1; NULL if it is (nearly) constant."""
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda s, x: s + f(x))
    centred = _let(total(v, lambda x: x) / F.size(v), lambda mean: F.transform(v, lambda x: x - mean))
    scaled = lambda c: _let(F.sqrt(total(c, lambda x: x * x)), lambda norm: F.when(norm > 1e-6, F.transform(c, lambda x: x / norm)))
    return _let(centred, scaled)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def greedy(df: DataFrame, key: str, order: str, vector: str, least: float = 0.70) -> DataFrame:
    """(key, order, cluster): each unit vector joins the centroid of the
    highest cosine over ``least`` (the first on ties), else begins a cluster. A
    centroid is a running mean, brought back to length 1 at each step. One
    ordered pass a key that holds the centroids alone; NULL vectors go."""
    kind = dict(df.dtypes)

    def step(clusters: list[list], pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for v in pdf[vector]:
            x = np.asarray(v, np.float64)
            cos = [float(x @ c) for c, _ in clusters]
            best = int(np.argmax(cos)) if cos else -1
            if best >= 0 and cos[best] > least:
                centre, n = clusters[best]
                centre = centre * (n / (n + 1)) + x * (1 / (n + 1))
                norm = np.linalg.norm(centre)
                clusters[best] = [centre / norm if norm > 1e-6 else centre, n + 1]
            else:
                best = len(clusters)
                clusters.append([x, 1])
            out.append(best)
        return pd.DataFrame({key: pdf[key], order: pdf[order], "cluster": np.array(out, np.int32)})

    rows = df.select(key, order, vector).filter(F.col(vector).isNotNull())
    return fold(rows, [key], [order], list, step, f"{key} {kind[key]}, {order} {kind[order]}, cluster int")


def mean_signature(samples: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, signature): the mean of unit vectors, at length 1 again; NULL
    where it vanishes, and no row where no sample has a vector."""
    each = samples.select(*keys, F.posexplode(vector).alias("_k", "_x"))
    means = each.groupBy(*keys, "_k").agg(F.avg("_x").alias("_m")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_k", "_m"))).alias("_v"))
    mean = F.transform("_v", lambda e: e["_m"])
    scaled = _let(F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, e: s + e["_m"] * e["_m"])), lambda norm: F.when(norm > 1e-6, F.transform(mean, lambda x: x / norm)))
    return means.select(*keys, scaled.alias("signature"))


def with_bands(clusters: DataFrame, members: DataFrame, keys: list[str], below: float = 0.48) -> DataFrame:
    """Adds band (the median of the members' fractions ``frac``, 1 without
    any) and elevated, under ``below``."""
    bands = members.groupBy(*keys).agg(F.percentile("frac", 0.5).alias("band"))
    return clusters.join(bands, keys, "left").withColumn("band", F.coalesce("band", F.lit(1.0))).withColumn("elevated", F.col("band") < below)


def demoted(shots: DataFrame, members: DataFrame, kept: DataFrame, original: DataFrame | None = None) -> DataFrame:
    """``shots`` (fight_id, shot_idx, wide, ...) with wide only where the shot's
    cluster is kept. ``members``: (fight_id, shot_idx, cluster); ``kept``:
    (fight_id, cluster). ``original`` (fight_id, shot_idx, wide) has the flags
    before an earlier run, so that another choice loses nothing."""
    stay = members.join(kept.select("fight_id", "cluster"), ["fight_id", "cluster"], "left_semi").select("fight_id", "shot_idx", F.lit(True).alias("_stay"))
    rows = shots
    if original is not None:
        rows = rows.join(original.select("fight_id", "shot_idx", F.col("wide").alias("_was")), ["fight_id", "shot_idx"], "left").withColumn("wide", F.coalesce("_was", "wide"))
    rows = rows.join(stay, ["fight_id", "shot_idx"], "left").withColumn("wide", F.col("wide") & F.coalesce("_stay", F.lit(False)))
    return rows.select(*shots.columns)


def ranked(clusters: DataFrame, keep: int = 1, least_s: float = 1.0) -> DataFrame:
    """Clusters (fight_id, cluster, time_s, elevated) of a second or more,
    elevated ones first, then the longest; ``kept`` marks the first ``keep``."""
    from pyspark.sql import Window

    w = Window.partitionBy("fight_id").orderBy(F.desc("elevated"), F.desc("time_s"), "cluster")
    return clusters.filter(F.col("time_s") >= least_s).withColumn("angle_id", F.row_number().over(w) - 1).withColumn("kept", F.col("angle_id") < keep)
