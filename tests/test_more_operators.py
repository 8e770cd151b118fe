"""Pages, calibration, overlay and sample operators on small literal tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringside.functions import numeric as N
from ringside.operators import attention, calibration, cluster, events, exposure, folds, matching, overlay, prebout, rubric
from ringside.sources import artifacts, corpora, pages


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- pages ------------------------------------------------------------------


def test_channel_pages_in_both_layouts(spark):
    data = {
        "a": [{"videoRenderer": {"videoId": "v1", "title": {"runs": [{"text": "Red "}, {"text": "vs Blue"}]}, "viewCountText": {"simpleText": "1,234 views"}}}],
        "b": {"lockupViewModel": {"contentId": "v2", "metadata": {"title": {"content": "Gold"}, "rows": [{"content": "3 days ago"}, {"content": "1.5K views"}]}}},
        "c": {"videoRenderer": {"videoId": "v1", "title": {"runs": []}}, "lockupViewModel": {"contentId": "v3"}},
    }
    html = f"<script>var ytInitialData = {json.dumps(data)};</script>"
    rows = pages.channel_videos(frame(spark, [("p", html), ("q", "no data")], "page string, html string"), "page", "html").collect()
    assert sorted(map(tuple, rows)) == [("p", "v1", "Red vs Blue", 1234), ("p", "v2", "Gold", 1500)]


def test_watch_pages_inventory_and_info(spark):
    html = 'x ytInitialPlayerResponse = {"videoDetails": {"viewCount": "77"}}; "heatMarkerIntensityScoreNormalized": 0.25, "heatMarkerIntensityScoreNormalized":0.5'
    got = pages.watch_stats(frame(spark, [("p", html), ("q", "")], "page string, html string"), "page", "html").collect()
    assert sorted(map(tuple, got)) == [("p", 77, 0.5, 2), ("q", None, None, 0)]
    listing = json.dumps({"entries": [{"id": "a", "title": "t", "view_count": 3}, {"id": None, "title": "x"}, {"id": "b"}]})
    rows = pages.inventory(frame(spark, [(listing,)], "doc string"), "doc").collect()
    assert sorted(map(tuple, rows)) == [("a", "t", 3), ("b", "", None)]
    info = json.dumps({"id": "a", "duration": 9.5, "view_count": "x", "heatmap": [{"start_time": 0, "end_time": 2, "value": 0.5}]})
    r = pages.video_info(frame(spark, [(info,), ("bad",)], "doc string"), "doc").orderBy("yt_id").collect()
    assert r[0]["yt_id"] is None and (r[1]["duration_s"], r[1]["view_count"], r[1]["heatmap"][0]["value"]) == (9.5, None, 0.5)


def test_infobox_walk_and_fight_cards(spark):
    box = '<h3 class="pi-data-label">Weapon</h3> <div class="pi-data-value pi">Drum <b>spinner</b></div>'
    assert [r[0] for r in frame(spark, [(box,), ("none",)], "h string").select(pages.infobox(F.col("h"), "Weapon")).collect()] == ["Drum spinner", ""]
    doc = '{"k": 1, "a": [{"k": {"k": "x"}}]}'
    assert frame(spark, [(doc,)], "d string").select(pages.walked(F.col("d"), "k")).first()[0] == ["1", '{"k": "x"}', '"x"']
    html = "<p>Tonight: Red Storm vs. Blue Wave.</p> <p>Later on, Red Storm defeats Blue.</p>" + " filler" * 80 + "<li>Gold versus Jade</li>" + " filler" * 80 + "<li>JADE vs Gold</li><li>Onyx vs Onyx</li>"
    rows = {(r["bot_a"], r["bot_b"]): r["winner"] for r in pages.fight_card(frame(spark, [("p", html)], "page string, html string"), "page", "html").collect()}
    assert all(a.lower() != b.lower() for a, b in rows) and sum({a.lower(), b.lower()} == {"gold", "jade"} for a, b in rows) <= 1
    assert any("Red Storm" in a and "Blue Wave" in b for a, b in rows)


# --- calibration ---------------------------------------------------------------


def test_homographies_are_fitted_with_and_without_an_outlier(spark):
    h = np.array([[1.2, 0.1, 3.0], [-0.2, 0.9, 1.0], [0.001, 0.002, 1.0]])
    rng = np.random.default_rng(1)
    rows = []
    for key, n in ((1, 4), (2, 8), (3, 3)):
        for x, y in rng.uniform(0, 100, (n, 2)):
            p = h @ [x, y, 1]
            rows.append((key, float(x), float(y), float(p[0] / p[2]), float(p[1] / p[2])))
    x, y = 50.0, 20.0
    rows.append((2, x, y, 500.0, -300.0))  # a point that was marked wrong
    pairs = frame(spark, rows, "k int, ix double, iy double, fx double, fy double")
    got = {r["k"]: r for r in calibration.fitted(pairs, ["k"]).collect()}
    assert set(got) == {1, 2}
    for r in got.values():
        assert np.allclose(np.array(r["h"]).reshape(3, 3), h, atol=1e-4)
    assert got[1]["error_m"] < 1e-6 < got[2]["error_m"]
    px, py = N.project([F.lit(float(v)) for v in h.ravel()], F.col("ix"), F.col("iy"))
    assert pairs.filter("k = 1").agg(calibration.rms_error(px, py, F.col("fx"), F.col("fy"))).first()[0] == pytest.approx(0, abs=1e-9)


def test_points_on_a_line_take_further_points(spark, tmp_path):
    from ringside.plans import queries

    # The first user's first five events, and the seventh, are on one line of (x, 7 x % 50).
    values = {1: [7.55, 9.51, 12.3, 7.3, 12.55, 44.63, 13.03, 25.2, 30.1], 2: [44.63, 7.55, 9.51, 25.2, 30.1, 60.0], 3: [5.0] * 9, 4: [1.0, 20.0, 30.0, 44.0]}
    rows = [(i, u, v) for u, vs in values.items() for i, v in enumerate(vs)]
    e = frame(spark, rows, "event_id long, user_id long, value double").withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, event_id)"))
    e.write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(map(tuple, queries.homography_fit(spark, str(tmp_path)).collect()))
    # The third's events are all one point, which no homography follows from; the fourth has four.
    assert got == [(1, 0.0, 1.2, 0.9), (2, 0.0, 1.2, 0.9)]


def test_uncalibrated_angles_leave_gaps(spark):
    boxes = frame(spark, [("f", i, i / 10, "a", 10.0, 20.0, 4.0, 2.0) for i in range(4)] + [("g", 0, 0.0, "a", 10.0, 20.0, 4.0, 2.0)], "fight_id string, i int, t double, bot string, bx double, by double, bw double, bh double")
    shots = frame(spark, [("f", 0.0, 0.1, 0, True), ("f", 0.1, 0.2, 1, True), ("f", 0.2, 0.3, 2, False), ("g", 0.0, 1.0, 0, True)], "fight_id string, start_t double, end_t double, shot_idx int, wide boolean")
    angles = frame(spark, [("f", 0, 0), ("f", 1, 1)], "fight_id string, shot_idx int, angle_id int")
    known = frame(spark, [(f, 0, [2.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]) for f in "fg"], "fight_id string, angle_id int, h array<double>")
    got = {(r["fight_id"], r["i"]): (r["x"], r["y"]) for r in calibration.tracked(boxes, shots, angles, known).collect()}
    assert got == {("f", 0): (25.0, 21.0), ("f", 1): (None, None), ("f", 2): (None, None), ("f", 3): (None, None), ("g", 0): (25.0, 21.0)}


# --- samples, series, overlay ----------------------------------------------------


def test_folds_carry_state_over_batches_and_keys(spark):
    rows = frame(spark, [(k, i) for k in (1, 2, None) for i in range(500)], "k int, i int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:

        def step(seen, pdf):
            seen[0] += len(pdf)
            return pdf[["i"]].assign(n=range(seen[0] - len(pdf), seen[0]))

        got = folds.fold(rows, ["k"], ["i"], lambda: [0], step, "i int, n long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 1500 and all(r["i"] == r["n"] for r in got)


def test_pooled_quantile_is_exact(spark):
    rng = np.random.default_rng(2)
    for values in (rng.normal(size=2001), np.repeat([1.0, 2.0, 5.0], [10, 700, 4]), np.array([3.0])):
        points = frame(spark, [(float(v),) for v in values] + [(None,)], "value double")
        for q in (0.0, 0.2, 0.7, 1.0):
            assert attention.critical_threshold(points, "value", q).first()[0] == pytest.approx(np.quantile(values, q))


def test_onset_is_dated_back_and_ends_are_found(spark):
    v = [1.0, 0.9, 0.8, 0.7, *[0.5] * 9, 1.0]
    rows = frame(spark, [(1, float(i), x) for i, x in enumerate(v)], "k int, t double, v double")
    assert exposure.decay_onset(rows, ["k"], "t", "v").collect()[0]["onset"] == 1.0
    assert tuple(exposure.ends(rows, ["k"], "t", "v").first()) == (1, 1.0, 1.0)
    assert [r["t"] for r in exposure.strided(rows, ["k"], ["t"]).orderBy("k").collect()] == [0, 2, 4, 6, 8, 10, 12]
    assert sorted(r["t"] for r in exposure.spread(rows, ["k"], ["t"], 3).collect()) == [0, 6, 13]
    new = exposure.replaced(rows, "v", frame(spark, [(0.0, 7.0)], "t double, v double"), "t")
    assert new.columns == rows.columns and new.filter("t = 0").first()["v"] == 7.0 and new.filter("t = 1").first()["v"] == 0.9
    assert [r[0] for r in exposure.markdown(frame(spark, [("a", None)], "x string, y int")).collect()] == ["| x | y |", "|---|---|", "| a | — |"]


def test_hero_windows_and_flashes(spark):
    fights = frame(spark, [("a", 60.0), ("b", 200.0), ("c", 200.0), ("d", 200.0)], "fight_id string, duration_s double")
    happened = frame(spark, [("b", 150.0, "ko", None), ("b", 20.0, "hit", 9.0), ("c", 100.0, "hit", 5.0), ("c", 120.0, "hit", 5.0)], "fight_id string, t double, type string, magnitude double")
    got = {r["fight_id"]: (r["start_t"], r["end_t"]) for r in overlay.hero_windows(fights, happened).collect()}
    assert got == {"a": (0.0, 60.0), "b": (110.0, 200.0), "c": (55.0, 145.0), "d": (0.0, 90.0)}
    frames = frame(spark, [("f", i / 8) for i in range(10)], "fight_id string, t double")
    flashes = overlay.hit_flashes(frame(spark, [("f", 0.25, None)], "fight_id string, event_t double, magnitude double"), frames, ["fight_id"])
    assert sorted(r["t"] for r in flashes.collect()) == [0.25, 0.375, 0.5, 0.625]
    box = spark.range(1).select(*[c.alias(k) for k, c in overlay.letterbox(F.lit(640), F.lit(480)).items()]).first()
    assert tuple(box) == (960, 720, 160, 0)


def test_shots_are_demoted_and_restored(spark):
    shots = frame(spark, [("f", i, i < 4) for i in range(6)], "fight_id string, shot_idx int, wide boolean")
    members = frame(spark, [("f", i, i % 2) for i in range(4)], "fight_id string, shot_idx int, cluster int")
    keep = lambda c: frame(spark, [("f", c)], "fight_id string, cluster int")
    first = cluster.demoted(shots, members, keep(0))
    assert [r["wide"] for r in first.orderBy("shot_idx").collect()] == [True, False, True, False, False, False]
    again = cluster.demoted(first, members, keep(1), shots)
    assert [r["wide"] for r in again.orderBy("shot_idx").collect()] == [False, True, False, True, False, False]


def test_truths_take_each_finding_once(spark):
    truth = frame(spark, [(1, 1.0), (1, 1.5), (1, 9.0)], "k int, t double")
    found = frame(spark, [(1, 1.2), (1, 2.4), (1, 30.0)], "k int, t double")
    got = sorted((r["truth_t"], r["found_t"]) for r in matching.matched_truth(truth, found, ["k"]).collect())
    assert got == [(1.0, 1.2), (1.5, 2.4)]
    rng = np.random.default_rng(9)
    rows = {k: [np.round(rng.uniform(0, 60, 80), 1).tolist() for _ in range(2)] for k in range(4)}
    sides = [frame(spark, [(k, t) for k in rows for t in rows[k][s]] + [(9, 1.0), (0, None)], "k int, t double") for s in (0, 1)]
    want = []
    for k, (truths, findings) in rows.items():
        free = sorted(findings)
        for t in sorted(truths):
            near = next((f for f in free if abs(f - t) <= 0.5), None)
            if near is not None:
                free.remove(near)
                want.append((k, t, near))
    got = matching.matched_truth(*sides, ["k"], 0.5).collect()
    assert sorted(map(tuple, got)) == sorted([*want, (9, 1.0, 1.0)])


def test_small_operators(spark):
    got = matching.enriched(frame(spark, [(" Red",), ("Blue",)], "name string"), "name", frame(spark, [("red", "T")], "name string, team string"), "team").collect()
    assert {r["name"]: r["team"] for r in got} == {" Red": "T", "Blue": None}
    assert [r["bot"] for r in prebout.entrants(frame(spark, [(["b", "a"],), (["a", "c"],)], "bots array<string>")).collect()] == ["a", "b", "c"]
    assert prebout.paired(frame(spark, [(0.1, 0.2, 1), (None, 0.2, 1)], "a double, b double, y int"), "a", "b", "y").count() == 1
    cards = frame(spark, [("f", 3, 2, 2, 1, 1, 2)], "fight_id string, damage_a int, damage_b int, aggression_a int, aggression_b int, control_a int, control_b int")
    assert tuple(rubric.cheap_card(cards).first()) == ("f", "A", 0.09)
    base = attention.with_baseline(frame(spark, [(1, 0.0), (2, 0.5)], "k int, baseline double"), frame(spark, [(1, 1.0), (1, 2.0), (2, 9.0)], "k int, value double"), ["k"]).collect()
    assert {r["k"]: r["baseline"] for r in base} == pytest.approx({1: 1.2, 2: 0.5})
    names = frame(spark, [("St. Ann",), ("7up",), ("!!",)], "name string")
    texts = frame(spark, [("st. ann wins",), ("a 7UP!",), ("best. ann",), ("oh !! no",)], "t string")
    assert {(r["t"], r["name"]) for r in matching.named_in(texts, "t", names).collect()} == {("st. ann wins", "St. Ann"), ("a 7UP!", "7up"), ("oh !! no", "!!")}


# --- sources that had no test ------------------------------------------------------


def test_artifacts_are_written_listed_and_read(spark, tmp_path):
    import bout_fixture as X

    root = str(tmp_path / "in")
    X.write(root)
    meta = artifacts.read(spark, root, "meta", strict=True)
    out = str(tmp_path / "out")
    artifacts.write(meta, out, "meta")
    again = spark.read.parquet(f"{out}/meta")
    assert [r["bots"] for r in again.collect()] == [r["bots"] for r in meta.collect()]
    other = frame(spark, [("a-fight",)], "fight_id string")
    assert [r[0] for r in artifacts.fights(meta, other).collect()] == ["a-fight", "bout-1"]
    has = artifacts.index(meta, shots=meta, tracks=other).first()["has"]
    assert has == {"shots": True, "tracks": False}
    with pytest.raises(KeyError):
        artifacts.write(meta, out, "nothing")


def test_rosters_histories_logs_and_reports(spark, tmp_path):
    (tmp_path / "bots.csv").write_text("name,weapon_class,weapon_text,record\nRed,drum,x,1-0\nBlue,,y,\nRED,hammer,x,1-0\n")
    assert {r["bot"]: r["class"] for r in corpora.roster_classes(spark, str(tmp_path / "bots.csv")).collect()} == {"red": "hammer", "blue": "other"}
    (tmp_path / "red_history.csv").write_text("bot,season,stage,opponent,won,method,result_text\nRed,1,F,Blue,True,ko,Won\n")
    assert corpora.history(spark, str(tmp_path)).count() == 1
    (tmp_path / "log.jsonl").write_text('{"ts": 1.5, "url": "u", "via": "plain", "status": 200, "cached": false}\n')
    assert corpora.fetch_log(spark, str(tmp_path / "log.jsonl")).first()["status"] == 200
    corpora.export_csv(frame(spark, [(["a", "b"], 1)], "bots array<string>, n int"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["bots"] == "a vs b"
    got = corpora.cached(frame(spark, [("u",), ("w",)], "url string"), frame(spark, [("u", "body")], "url string, body string").select(F.sha2(F.col("url").cast("binary"), 256).alias("key"), "body"))
    assert {r["url"]: r["cached"] for r in got.collect()} == {"u": True, "w": False}
    assert events.HIT_FACTOR == 4.0


def test_response_cache_drops_corrupt_entries_and_keeps_the_newest(spark):
    from ringside.sources import responses

    asked = frame(spark, [("t", "m", "a"), ("t", "m", "a"), ("t", "m", "b"), ("u", "m", None), ("u", "m", "")], "task string, model string, payload string")
    keyed = {(r["task"], r["payload"]): r["key"] for r in asked.select("*", responses.request_key().alias("key")).collect()}
    cache = frame(spark, [(keyed["t", "a"], '{"result": {"x": 1}}'), (keyed["t", "b"], '{"result": '), (keyed["u", ""], '{"other": 1}'), (None, '{"result": 1}')], "key string, entry string")
    got = responses.answered(asked, cache).collect()
    assert len(got) == 5 and sorted(str(r["result"]) for r in got) == ["None"] * 3 + ['{"x":1}'] * 2
    assert {r["key"] for r in responses.calls(asked, cache).collect()} == {keyed["t", "b"], keyed["u", ""]}
    assert {tuple(r) for r in responses.usage(asked, cache).collect()} == {("t", 3, 2, 1), ("u", 2, 1, 1)}
    grown = responses.stored(cache, frame(spark, [("t", "m", "a", "7"), ("t", "m", "b", '["y"]')], "task string, model string, payload string, result string"))
    assert {(r["task"], r["payload"] or ""): r["result"] for r in responses.answered(asked, grown).collect()} == {("t", "a"): "7", ("t", "b"): '["y"]', ("u", ""): None}
    assert responses.usage(asked, grown.limit(0)).filter("task = 't'").first()["calls"] == 2


def test_ties_are_summed_in_the_order_of_the_rows(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from ringside.plans import queries

    rng = np.random.default_rng(7)
    order, tax, discount = rng.integers(0, 3000, 20_000), rng.integers(0, 9, 20_000) / 100, rng.integers(0, 11, 20_000) / 100
    items = pa.table({"l_orderkey": order, "l_tax": tax, "l_discount": discount})
    (tmp_path / "lineitem.parquet").mkdir()
    for part in range(4):
        pq.write_table(items.slice(part * 5000, 5000), tmp_path / "lineitem.parquet" / f"part-{part}.parquet")
    keys = sorted(set(order.tolist()))
    pq.write_table(pa.table({"o_orderkey": keys, "o_orderstatus": ["F"] * len(keys), "o_orderpriority": ["5-LOW"] * len(keys)}), tmp_path / "orders.parquet")
    a, b = dict.fromkeys(keys, 0.0), dict.fromkeys(keys, 0.0)
    for k, t, d in zip(order.tolist(), tax.tolist(), discount.tolist()):
        a[k], b[k] = a[k] + t, b[k] + d
    rows = {r["o_orderkey"]: r for r in queries.robbery_leaderboard(spark, str(tmp_path)).collect()}
    assert {k: r["ours"] for k, r in rows.items()} == {k: "A" if 2 * a[k] >= b[k] else "B" for k in keys}
    assert all(r["margin"] == round(abs(2 * a[k] - b[k]), 2) for k, r in rows.items())
