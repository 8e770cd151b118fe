"""Every registered query against its SQL, and the streaming forms."""

import math
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ringside.plans import queries as Q
from ringside.streaming import twins

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, con, sf, name):
    df = Q.QUERIES[name](spark, sf)
    want = con.sql(Q.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.limit(10**9).fetchall()), key=repr)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return rows.withColumn("at", F.col("ts").cast("timestamp")).withColumn("t", F.unix_micros("at") / 1e6)


def test_streamed_debounce_equals_batch(spark, sf, stream):
    got = twins.drained(twins.debounced(stream, "user_id", "t", 7200), "debounced")
    want = Q.greedy_debounce(spark, sf)
    assert got.count() == want.count()


def test_streamed_rolling_mean_equals_batch(spark, sf, stream):
    got = {(r["user_id"], round(r["t"], 3)): r["roll"] for r in twins.drained(twins.rolling_mean(stream, "user_id", "t", "value"), "rolled").collect()}
    e = Q.ev(spark, sf).select("user_id", "event_id", "t")
    want = Q.rolling_mean(spark, sf).join(e, ["user_id", "event_id"]).collect()
    assert len(got) == len(want)
    assert all(got[r["user_id"], round(r["t"], 3)] == pytest.approx(r["roll"], abs=1e-5) for r in want)


def test_streamed_resample_equals_batch(spark, sf, stream):
    got = twins.drained(twins.resampled(stream, ["user_id"], "at", "value", "1 hour"), "resampled", "append")
    hour = lambda r: (r["user_id"], int(r["start"].timestamp()) // 3600)
    found = {hour(r): r["value"] for r in got.collect()}
    want = {(r["user_id"], r["sec"]): r["value"] for r in Q.resample_1h(spark, sf).collect()}
    last = max(h for _, h in want)
    # Windows of the last hour wait for the watermark; all others are there, and equal.
    assert {k for k in want if k[1] < last - 1} <= set(found) <= set(want)
    assert all(found[k] == pytest.approx(want[k], abs=1e-5) for k in found)


def test_streamed_sessions(spark, sf, stream):
    got = twins.drained(twins.sessions(stream, ["user_id"], "at", "1 hour"), "sessions", "append")
    assert got.count() > 0 and got.agg(F.sum("n")).first()[0] <= 1000


def test_streamed_fill_and_elo_equal_batch(spark, tmp_path):
    from ringside.operators import prebout, rolling

    points = [(1, 2, 5.0), (1, 4, None), (1, 5, 7.0), (2, 0, 1.0)]
    fights = [("x", f"f{i:02}", "abcd"[i % 4], "bcda"[i % 4], "abcd"[(i * 7) % 4] if (i * 7) % 4 in (i % 4, (i + 1) % 4) else "abcd"[i % 4]) for i in range(40)]
    for name, rows, schema in (("points", points, "k int, sec long, value double"), ("fights", fights, "league string, fight_id string, bot_a string, bot_b string, winner string")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
    read = lambda name: spark.readStream.schema(spark.read.parquet(str(tmp_path / name)).schema).parquet(str(tmp_path / name))
    got = twins.drained(twins.filled(read("points"), "k", "sec", "value", 0.5), "filled").collect()
    assert sorted((r["k"], r["sec"], r["value"]) for r in got) == [(1, 0, 0.5), (1, 1, 0.5), (1, 2, 5.0), (1, 3, 5.0), (1, 4, 5.0), (1, 5, 7.0), (2, 0, 1.0)]
    batch = rolling.filled(spark.createDataFrame(points, "k int, sec long, value double"), ["k"], 0.5).collect()
    assert sorted((r["k"], r["sec"], r["value"]) for r in batch) == sorted((r["k"], r["sec"], r["value"]) for r in got)
    priors = spark.createDataFrame([("a", 1600.0), ("c", 1450.0)], "bot string, rating double")
    classes = spark.createDataFrame([("a", "spinner"), ("b", "flipper"), ("d", "spinner")], "bot string, class string")
    want = prebout.walk_forward(spark.createDataFrame(fights, "league string, fight_id string, bot_a string, bot_b string, winner string").withColumn("episode", F.lit(1)), priors, classes)
    live = twins.drained(twins.walk_forward(read("fights"), priors, classes), "elo")
    assert {r["fight_id"]: r["p"] for r in live.collect()} == pytest.approx({r["fight_id"]: r["p"] for r in want.collect()})


def in_files(spark, path, batches, schema):
    """A stream of one micro-batch for each of ``batches``."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path / f"part={i}"))
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))


def ran(result, name, mode="append"):
    q = result.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return q, result.sparkSession.table(name)


def test_elo_state_goes_from_batch_to_batch(spark, tmp_path):
    from ringside.operators import prebout

    schema = "league string, fight_id string, bot_a string, bot_b string, winner string"
    fights = [("xy"[i % 2], f"f{i:02}", "abc"[i % 3], "bca"[i % 3], "abc"[i % 3] if i % 4 else "bca"[i % 3]) for i in range(30)]
    priors = spark.createDataFrame([("a", 1600.0)], "bot string, rating double")
    classes = spark.createDataFrame([("b", "flipper")], "bot string, class string")
    _, got = ran(twins.walk_forward(in_files(spark, tmp_path, [fights[:7], fights[7:20], fights[20:]], schema), priors, classes), "elo_batches")
    want = prebout.walk_forward(spark.createDataFrame(fights, schema).withColumn("episode", F.lit(1)), priors, classes)
    assert {r["fight_id"]: r["p"] for r in got.collect()} == pytest.approx({r["fight_id"]: r["p"] for r in want.collect()})


def test_states_end_and_late_rows_are_dropped(spark, tmp_path):
    batches = [[(k, float(t), 1.0) for k in range(20) for t in (0, 1, 5)], [(0, 500.0, 2.0), (1, 3.0, 9.0)], [(0, 1.0, 7.0), (0, 2000.0, 3.0), (0, 2001.0, 4.0)], [(0, 2002.0, 5.0)]]
    schema = "k int, t double, v double"
    q, got = ran(twins.debounced(in_files(spark, tmp_path / "a", batches, schema), "k", "t", 3.0), "ending")
    times = sorted((r["k"], r["t"]) for r in got.collect())
    # The row of 1 in the third batch is behind the watermark.
    assert times == sorted([(k, t) for k in range(20) for t in (0.0, 5.0)] + [(0, 500.0), (0, 2000.0)])
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 1
    q, got = ran(twins.rolling_mean(in_files(spark, tmp_path / "b", batches, schema), "k", "t", "v", 3, idle=600.0), "rolling_ends")
    means = {r["t"]: r["roll"] for r in got.filter("k = 0").collect()}
    assert means == {0.0: 1.0, 1.0: 1.0, 5.0: 1.0, 500.0: pytest.approx(4 / 3), 2000.0: 3.0, 2001.0: 3.5, 2002.0: 4.0}
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 1
    q, got = ran(twins.filled(in_files(spark, tmp_path / "c", [[(1, 0, 5.0), (1, 2, None)], [(1, 3, 6.0)], [(1, 900, None), (1, 902, 8.0)]], "k int, sec long, v double"), "k", "sec", "v", 0.5, idle=100.0), "fill_ends")
    assert sorted((r["sec"], r["v"]) for r in got.collect()) == [(0, 5.0), (1, 5.0), (2, 5.0), (3, 6.0), (900, 0.5), (901, 0.5), (902, 8.0)]
