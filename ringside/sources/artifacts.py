"""The contract tables: one JSON document a fight and kind, read as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The documents' schemas.
SCHEMAS = {
    "meta": "fight_id STRING, episode INT, bots ARRAY<STRING>, colors MAP<STRING,STRING>, result STRUCT<winner STRING, method STRING, time_s DOUBLE>, video STRUCT<yt_id STRING, fight_start_s DOUBLE, fight_end_s DOUBLE>, role STRING",
    "tracks": "fight_id STRING, fps INT, coverage DOUBLE, frames ARRAY<STRUCT<t DOUBLE, wide BOOLEAN, pos MAP<STRING,ARRAY<DOUBLE>>>>",
    "events": "fight_id STRING, events ARRAY<STRUCT<t DOUBLE, type STRING, magnitude DOUBLE, actor STRING, target STRING>>",
    "telemetry": "fight_id STRING, series STRUCT<momentum ARRAY<ARRAY<DOUBLE>>, control ARRAY<ARRAY<DOUBLE>>, speed MAP<STRING,ARRAY<ARRAY<DOUBLE>>>, mobility MAP<STRING,ARRAY<ARRAY<DOUBLE>>>>, heatmap_png MAP<STRING,STRING>",
    "attention": "video_id STRING, fight_id STRING, points ARRAY<ARRAY<DOUBLE>>, stats STRUCT<baseline DOUBLE, peak DOUBLE, peak_t DOUBLE>, event_lift ARRAY<STRUCT<event_t DOUBLE, type STRING, lift DOUBLE>>",
    "scorecard": "fight_id STRING, ours STRUCT<damage ARRAY<INT>, aggression ARRAY<INT>, control ARRAY<INT>, winner STRING, margin DOUBLE>, official STRUCT<winner STRING, split STRING>, robbery_score DOUBLE",
    "shots": "fight_id STRING, shots ARRAY<STRUCT<start_t DOUBLE, end_t DOUBLE, wide BOOLEAN>>",
    "angles": "fight_id STRING, original_wide ARRAY<BOOLEAN>, kept_angles ARRAY<INT>, angles ARRAY<STRUCT<angle_id INT, shots ARRAY<INT>, time_s DOUBLE, kept BOOLEAN, elevated BOOLEAN, yellow_band_frac DOUBLE, example_frame STRING>>",
    "calibration": "fight_id STRING, image_points ARRAY<ARRAY<DOUBLE>>, floor_points ARRAY<ARRAY<DOUBLE>>, homography ARRAY<ARRAY<DOUBLE>>, reprojection_error_m DOUBLE, source_frame STRING",
}


def _unknown(found: T.DataType, declared: T.DataType, path: str = "") -> list[str]:
    """Fields that a document has and its contract hasn't."""
    if isinstance(found, T.ArrayType) and isinstance(declared, T.ArrayType):
        return _unknown(found.elementType, declared.elementType, path)
    if not isinstance(found, T.StructType) or not isinstance(declared, T.StructType):
        return []  # maps take any key
    known = {f.name: f.dataType for f in declared}
    return [x for f in found for x in ([f"{path}{f.name}"] if f.name not in known else _unknown(f.dataType, known[f.name], f"{path}{f.name}."))]


def read(spark: SparkSession, root: str, kind: str, strict: bool = False) -> DataFrame:
    """All documents of a kind under ``root``/<fight_id>/. A kind without a
    contract is a KeyError. ``strict`` fails on fields the contract lacks and
    on malformed documents; else they are NULL."""
    schema = SCHEMAS[kind]
    path = f"{root}/*/{kind}.json"
    if strict:
        extra = _unknown(spark.read.json(path, multiLine=True).schema, T._parse_datatype_string(schema))
        if extra:
            raise ValueError(f"{kind}: unknown fields {', '.join(extra)}")
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST" if strict else "PERMISSIVE")


def write(df: DataFrame, root: str, kind: str, form: str = "parquet") -> None:
    """One table a kind, partitioned by fight."""
    SCHEMAS[kind]
    df.write.mode("overwrite").partitionBy("fight_id").format(form).save(f"{root}/{kind}")


def fights(*tables: DataFrame) -> DataFrame:
    """The sorted fights that any table has."""
    out = tables[0].select("fight_id")
    for t in tables[1:]:
        out = out.unionByName(t.select("fight_id"))
    return out.distinct().orderBy("fight_id")


def sides(meta: DataFrame) -> DataFrame:
    """Meta documents as a flat table: bot_a is the sign's reference."""
    return meta.select("fight_id", "episode", F.get("bots", F.lit(0)).alias("bot_a"), F.get("bots", F.lit(1)).alias("bot_b"), "result.winner", "result.method", "result.time_s", (F.col("video.fight_end_s") - F.col("video.fight_start_s")).alias("duration_s"))


def frames(tracks: DataFrame, meta: DataFrame) -> DataFrame:
    """One row a frame: fight_id, bot_a, bot_b, i, t, wide, ax, ay, bx, by.
    Positions count only where the frame is wide and has both bots."""
    rows = tracks.select("fight_id", F.posexplode("frames").alias("i", "f")).join(sides(meta).select("fight_id", "bot_a", "bot_b"), "fight_id")
    a, b = F.col("f.pos")[F.col("bot_a")], F.col("f.pos")[F.col("bot_b")]
    known = F.coalesce(F.col("f.wide") & a.isNotNull() & b.isNotNull(), F.lit(False))
    pick = lambda p, k: F.when(known, F.nanvl(F.get(p, F.lit(k)), F.lit(None).cast("double")))
    return rows.select("fight_id", "bot_a", "bot_b", "i", F.col("f.t").alias("t"), F.col("f.wide").alias("wide"), *[pick(p, k).alias(n) for n, p, k in (("ax", a, 0), ("ay", a, 1), ("bx", b, 0), ("by", b, 1))])


def points(attention: DataFrame) -> DataFrame:
    """(fight_id, t, value) of attention documents."""
    rows = attention.select("fight_id", F.explode("points").alias("p"))
    return rows.select("fight_id", F.get("p", F.lit(0)).alias("t"), F.get("p", F.lit(1)).alias("value"))


def series(telemetry: DataFrame, metric: str) -> DataFrame:
    """(fight_id, [bot,] sec, value) of one metric of telemetry documents."""
    both = telemetry.select("fight_id", F.explode(f"series.{metric}").alias(*(("bot", "ps") if metric in ("speed", "mobility") else ("p",))))
    if metric in ("speed", "mobility"):
        both = both.select("fight_id", "bot", F.explode("ps").alias("p"))
    rest = [c for c in both.columns if c != "p"]
    return both.select(*rest, F.get("p", F.lit(0)).cast("long").alias("sec"), F.get("p", F.lit(1)).alias("value"))


def nested(rows: DataFrame, keys: list[str], t: str = "sec", v: str = "value") -> DataFrame:
    """A long series as one array of [t, value] a key, in order."""
    pair = F.transform(F.sort_array(F.collect_list(F.struct(t, v))), lambda r: F.array(r[t].cast("double"), r[v]))
    return rows.groupBy(*keys).agg(pair.alias("series"))


def index(meta: DataFrame, **kinds: DataFrame) -> DataFrame:
    """The export index: each fight with its result, and which kinds it has."""
    rows = meta.select("fight_id", "bots", "colors", "role", "result")
    for name, df in kinds.items():
        rows = rows.join(df.select("fight_id").distinct().withColumn(f"_{name}", F.lit(True)), "fight_id", "left")
    has = F.map_from_arrays(F.array(*[F.lit(n) for n in kinds]), F.array(*[F.coalesce(f"_{n}", F.lit(False)) for n in kinds]))
    return rows.select("fight_id", "bots", "colors", "role", "result", has.alias("has")).orderBy("fight_id")
