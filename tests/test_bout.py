"""The scripted bout through the whole plan, at the accepted tolerances."""

import bout_fixture as X
import pytest
from pyspark.sql import functions as F

from ringside.operators import attention, league, momentum, rubric
from ringside.plans import bout
from ringside.sources import artifacts


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("bout"))
    X.write(root)
    meta = artifacts.read(spark, root, "meta", strict=True)
    sides = artifacts.sides(meta).persist()
    frames = artifacts.frames(artifacts.read(spark, root, "tracks", strict=True), meta)
    return sides, bout.analyse(frames, sides), artifacts.points(artifacts.read(spark, root, "attention")).persist()


def test_hits_and_knockout(found):
    rows = sorted((r["t"], r["type"], r["magnitude"], r["actor"]) for r in found[1].events.collect())
    hits = [r for r in rows if r[1] == "hit"]
    near = [min(abs(t - h[0]) for h in hits) for t, _, _ in X.HITS]
    assert sum(d <= 1.0 for d in near) >= 4 and len(hits) <= 6
    assert [r[0] for r in hits] == [21.8, 48.3, 64.2, 88.2, 107.8]
    assert [r[2] for r in hits] == [2.76, 3.1, 2.83, 3.04, 5.66]
    assert [r[3] for r in hits] == [X.A, X.A, X.B, X.B, X.A]
    assert [r for r in rows if r[1] == "ko"] == [(141.5, "ko", None, X.A)] and not [r for r in rows if r[1] == "hazard"]


def test_mobility_decays_for_one_side(found):
    rows = found[1].mobility_10hz.filter("mobility is not null").orderBy("i").collect()
    low = [r["t"] for r in rows if r["bot"] == X.B and r["mobility"] < 0.6]
    steady = [r["t"] for r in rows if r["bot"] == X.B and r["mobility"] >= 0.85 and r["t"] < low[0]]
    assert abs(steady[-1] - 101.9) < 0.05
    healthy = sorted(r["mobility"] for r in rows if r["bot"] == X.A and r["t"] < 136.5)
    assert healthy[len(healthy) // 2] > 0.6


def test_series_skip_gaps(found):
    sides, b, _ = found
    count = lambda df: df.filter(F.col("bot") == X.A).count()
    assert (b.control.count(), count(b.speed), count(b.mobility)) == (150, 120, 119)
    seconds = {r["sec"] for r in b.speed.collect()}
    assert not seconds & {*range(30, 40), *range(75, 85), *range(128, 138)}


def test_momentum_is_bounded_and_ends_with_the_winner(found):
    p = {r["sec"]: r["value"] for r in found[1].momentum.collect()}
    assert sorted(p) == list(range(150)) and all(0 <= v <= 1 for v in p.values())
    assert p[149] == 0.99
    for sec, value in ((0, 0.4085), (30, 0.521), (60, 0.3839), (110, 0.8069)):
        assert p[sec] == pytest.approx(value, abs=2e-3)
    samples = momentum.calibration(found[0], found[1].momentum)
    assert samples.count() == 137 and {r["y"] for r in samples.collect()} == {1}


def test_scorecard(found):
    card = found[1].scorecards.first()
    assert (card["damage_a"], card["aggression_a"], card["control_a"]) == (4, 2, 1)
    assert card["damage_share"] == pytest.approx(0.8314, abs=2e-3) and card["control_share"] == pytest.approx(0.4858, abs=2e-3)
    assert abs(card["a"] - 255) <= 1 and abs(card["b"] - 163) <= 1
    assert rubric.leaderboard(found[1].scorecards, found[0]).first()["robbery"] == 0.0


def test_attention_lift(found):
    _, b, points = found
    stats = attention.stats(points, ["fight_id"], "t", "value")
    row = stats.first()
    assert row["baseline"] == pytest.approx(0.2331, abs=2e-3) and abs(row["peak_t"] - 141.5) < 6
    lift = {round(r["event_t"], 1): r["lift"] for r in attention.lift(b.events, points, stats, ["fight_id"]).collect()}
    for t, value in ((21.8, 1.66), (48.3, 2.04), (64.2, 1.47), (88.2, 1.84), (107.8, 1.90), (141.5, 3.73)):
        assert lift[t] == pytest.approx(value, abs=0.02)


def test_sponsor_index(spark, found):
    sides, b, points = found
    rows = spark.createDataFrame([("bout-1", X.A, True, True), ("bout-1", X.B, False, True)], "fight_id string, bot string, won boolean, by_ko boolean")
    got = league.sponsor_index(rows, points, b.events).collect()
    assert [r["bot"] for r in got] == [X.A, X.B] and all(0 <= r["sponsor_score"] <= 100 for r in got)
    assert got[1]["authorship"] == pytest.approx(0.5781, abs=0.02) and got[0]["authorship"] == 1.0


def test_strict_reading_rejects_unknown_fields(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "events.json").write_text('{"fight_id": "f", "events": [{"t": 1, "type": "hit", "zz": 2}]}')
    with pytest.raises(ValueError, match="zz"):
        artifacts.read(spark, str(tmp_path), "events", strict=True)
    assert artifacts.read(spark, str(tmp_path), "events").first()["events"][0]["t"] == 1
    with pytest.raises(KeyError):
        artifacts.read(spark, str(tmp_path), "nothing")
