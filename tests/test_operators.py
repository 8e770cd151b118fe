"""Operators on small literal tables."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringside.functions import numeric as N
from ringside.functions import text as T
from ringside.operators import attention, cluster, events, grids, league, matching, momentum, overlay, prebout, rolling, segments, selection
from ringside.sources import corpora


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_clip_keeps_null_and_logistic_is_bounded(spark):
    r = one(spark, N.clip(F.lit(None).cast("double"), 0, 1), N.clip(F.lit(5.0), 0, 1), N.logistic(F.lit(99.0)))
    assert r[0] is None and r[1] == 1 and r[2] == pytest.approx(1 / (1 + math.exp(-3)))


def test_half_even_split(spark):
    assert tuple(one(spark, *N.half_even_split(F.lit(0.5), 5), *N.half_even_split(F.lit(0.5), 3))) == (2, 3, 2, 1)


def test_homography_and_inverse(spark):
    h = [F.lit(v) for v in (1.1, 0.2, 3.0, -0.3, 0.9, 1.0, 0.01, 0.02, 1.0)]
    x, y = N.project(h, F.lit(2.0), F.lit(5.0))
    back = N.project(N.inverted(h), x, y)
    assert tuple(one(spark, *back)) == pytest.approx((2.0, 5.0))


def test_savgol_follows_quadratics_and_leaves_short_arrays(spark):
    r = one(spark, N.savgol(F.array(*[F.lit(float(i * i - 3 * i)) for i in range(12)])), N.savgol(F.array(F.lit(1.0), F.lit(9.0))))
    assert r[0] == pytest.approx([i * i - 3 * i for i in range(12)]) and r[1] == [1.0, 9.0]
    assert N.savgol_matrix()[4] == pytest.approx([x / 231 for x in (-21, 14, 39, 54, 59, 54, 39, 14, -21)])


def test_bins_have_literal_edges(spark):
    p = [0.0, 0.1, 0.3, 0.7, 0.99, 1.0]
    rows = frame(spark, [(x,) for x in p], "p double").select(N.bin_of(F.col("p")), N.bin_of(F.col("p"), closed=False)).collect()
    assert [r[0] for r in rows] == [0, 1, 3, 7, 9, 9] and rows[-1][1] is None


@pytest.mark.parametrize(
    "text, cls",
    [("Vertical spinner Lifter", "vertical_spinner"), ("Hammer saw", "hammer"), ("Eggbeater drum", "drum"), ("Undercutter", "horizontal_spinner"), ("a wedge with a spinner", "control"), ("Flipper", "flipper"), ("", "other"), ("Spinner", "vertical_spinner")],
)
def test_weapon_rules(spark, text, cls):
    assert one(spark, T.first_rule(F.lit(text), T.WEAPON_RULES))[0] == cls


def test_result_methods(spark):
    rows = frame(spark, [("Won (KO)",), ("Lost (Split JD)",), ("Won by decision",), ("TBD",), (None,)], "t string").select(T.result_method(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["ko", "jd", "jd", None, None]


def test_view_counts(spark):
    texts = [("1,234,567 views", 1234567), ("123K views", 123000), ("1.2M views", 1200000), ("2B views", 2000000000), ("no", None), (None, None)]
    rows = frame(spark, [(t,) for t, _ in texts], "t string").select(T.view_count(F.col("t"))).collect()
    assert [r[0] for r in rows] == [v for _, v in texts]


def test_whole_names(spark):
    rows = frame(spark, [("Huge win", "HUGE"), ("Hugely", "HUGE"), ("a.b vs c", "a.b"), ("axb vs c", "a.b")], "t string, n string").select(T.whole_name(F.col("t"), F.col("n"))).collect()
    assert [r[0] for r in rows] == [True, False, True, False]


def test_json_blob_stops_at_its_brace(spark):
    text = 'var data = {"a": {"b": "}{"}, "c": [1]}; more }'
    assert one(spark, T.json_blob(F.lit(text), "data ="))[0] == '{"a": {"b": "}{"}, "c": [1]}'
    assert one(spark, T.json_blob(F.lit("none"), "data ="))[0] is None


def test_fences_clocks_slugs(spark):
    r = one(spark, T.unfenced(F.lit("```json\n{}\n```")), T.clock(F.lit(125.9)), T.slug(F.lit(" End Game ")))
    assert tuple(r) == ("{}", "2:05", "End_Game")


def test_burst_gap_is_strict(spark):
    rows = frame(spark, [(1, t) for t in (0.0, 2.9, 5.9, 9.0)], "k int, t double")
    got = [r["burst"] for r in events.bursts(rows, ["k"], ["t"], "t", 3.0).orderBy("t").collect()]
    assert got == [1, 1, 2, 3]


def test_debounce_advances_only_on_accepted(spark):
    rows = frame(spark, [(1, t) for t in (0.0, 2.0, 3.5, 6.0, 6.6)], "k int, t double")
    assert sorted(r["t"] for r in events.debounced(rows, ["k"], ["t"], "t", 3.0).collect()) == [0.0, 3.5, 6.6]


def test_null_breaks_a_sustained_run(spark):
    v = [0.1] * 3 + [None] + [0.1] * 4
    rows = frame(spark, [(1, i, float(i), x) for i, x in enumerate(v)], "k int, i int, t double, v double")
    got = events.sustained(rows, ["k"], ["i"], F.col("v") < 0.15, 4, "t").collect()
    assert [(r["start_t"], r["n"]) for r in got] == [(4.0, 4)]


def test_knockout_prefers_the_record_then_the_first_side(spark):
    meta = frame(spark, [("f", "a", "b", "a", "ko", 50.0), ("g", "a", "b", None, None, None)], "fight_id string, bot_a string, bot_b string, winner string, method string, time_s double")
    runs = [("g", bot, i, i / 10, 0.0 if (bot == "a" and i > 200) or (bot == "b" and i < 150) else 1.0) for bot in "ab" for i in range(400)]
    got = {r["fight_id"]: (r["t"], r["actor"], r["target"]) for r in events.knockouts(meta, frame(spark, runs, "fight_id string, bot string, i int, t double, mobility double")).collect()}
    assert got == {"f": (50.0, "a", "b"), "g": (20.1, "b", "a")}


def test_hazard_memory_is_shared_unless_asked(spark):
    rows = [("f", "a", "b", i, float(i), 100.0 if i in (2, 3, 9) else 1.0, 5.0, 1.0 if i in (9,) else 5.0, 1.0 if i in (2, 3) else 5.0) for i in range(20)]
    df = frame(spark, rows, "fight_id string, bot_a string, bot_b string, i int, t double, joint double, sep double, wall_a double, wall_b double")
    assert [r["t"] for r in events.hazards(df).collect()] == [9.0]
    assert sorted(r["t"] for r in events.hazards(df, per_bot=True).collect()) == [2.0, 9.0]


def test_state_gaps_close_at_the_next_present_row(spark):
    ok = [True, False, False, True, False]
    rows = frame(spark, [(1, i, float(i), x) for i, x in enumerate(ok)], "k int, i int, t double, ok boolean")
    assert sorted((r["start_t"], r["end_t"]) for r in segments.state_gaps(rows, ["k"], ["i"], "t", "ok").collect()) == [(1.0, 3.0), (4.0, 4.0)]


def test_point_in_interval_is_half_open(spark):
    points = frame(spark, [(1, t) for t in (0.0, 1.0, 2.0, 3.0)], "k int, t double")
    shots = frame(spark, [(1, 1.0, 2.0, "x"), (1, 2.0, 2.5, "y")], "k int, start_t double, end_t double, shot string")
    got = {r["t"]: r["shot"] for r in segments.in_interval(points, shots, ["k"], "t", ["shot"]).collect()}
    assert got == {0.0: None, 1.0: "x", 2.0: "y", 3.0: None}


def test_band_join_equals_all_pairs(spark):
    import random

    rng = random.Random(1)
    left = [(rng.randint(0, 2), round(rng.uniform(0, 50), 1)) for _ in range(60)]
    right = [(rng.randint(0, 2), round(rng.uniform(0, 50), 1)) for _ in range(60)]
    got = matching.band_join(frame(spark, left, "k int, a double"), frame(spark, right, "k int, b double"), ["k"], "a", "b", 2.0, 3.0)
    want = sorted((k, a, b) for (k, a), (j, b) in itertools.product(left, right) if k == j and a - 2.0 <= b <= a + 3.0)
    assert sorted((r["k"], r["a"], r["b"]) for r in got.collect()) == want


def test_nearest_and_as_of(spark):
    left = frame(spark, [(1, 0.0), (1, 5.0), (1, 9.0), (2, 1.0)], "k int, t double")
    right = frame(spark, [(1, 1.0, "a"), (1, 7.0, "b"), (1, 3.0, "c")], "k int, rt double, v string")
    got = {(r["k"], r["t"]): r["near_value"] for r in matching.nearest(left, right, ["k"], "t", "rt", "v").collect()}
    assert got == {(1, 0.0): "a", (1, 5.0): "c", (1, 9.0): "b", (2, 1.0): None}
    got = {(r["k"], r["t"]): r["prior_value"] for r in matching.as_of(left, right, ["k"], "t", "rt", "v").collect()}
    assert got == {(1, 0.0): None, (1, 5.0): "c", (1, 9.0): "b", (2, 1.0): None}


def test_upsert_newest_run_wins(spark):
    old = frame(spark, [("Malice", 1), ("Cobalt", 1), (" ", 1)], "name string, v int")
    new = frame(spark, [("HyperShock", 2), ("COBALT ", 2)], "name string, v int")
    assert [(r["name"], r["v"]) for r in matching.upserted(old, new, "name").collect()] == [("COBALT ", 2), ("HyperShock", 2), ("Malice", 1)]


def test_ramp_and_bins(spark):
    p = lambda s: one(spark, momentum.ramped(F.lit(0.5), F.lit(s), F.lit(100.0), F.lit(True)))[0]
    assert (p(94.0), p(95.0), p(100.0), p(130.0)) == pytest.approx((0.5, 0.5, 0.99, 0.99)) and p(97.5) == pytest.approx(0.745)


def test_heat_map_midpoints(spark):
    rows = [("v", "0", "10", ".2"), ("v", "10", "20", ".8"), ("v", "20", "30", ".4"), ("v", "x", "1", ".9"), ("w", "0", "1", "0")]
    got = sorted((r["t"], r["value"]) for r in attention.heat_map(frame(spark, rows, "video_id string, start string, end string, value string")).collect())
    assert got == [(5.0, 0.25), (15.0, 1.0), (25.0, 0.5)]


def test_adaptive_window(spark):
    rows = [("a", 12.98 * i) for i in range(5)] + [("b", 1.5 * i) for i in range(5)] + [("c", 0.0)]
    got = {r["k"]: r["half_width"] for r in attention.spacing(frame(spark, rows, "k string, t double"), ["k"], "t").collect()}
    assert got["a"] == pytest.approx(19.47) and got["b"] == 5.0 and got["c"] == 5.0


def test_history_ignores_unplayed_rows(spark):
    rows = [("Red", "x", "True", "ko"), ("red ", "y", "False", "jd"), ("Red", "z", "False", ""), ("Red", "w", "False", None)]
    got = prebout.history(frame(spark, rows, "bot string, opponent string, won string, method string")).first()
    assert tuple(got) == ("red", 1, 2)


def plain_walk(fights, ratings, classes):
    """The same model as a plain loop."""
    r, g, w, n, out = dict(ratings), {}, {}, {}, []
    for fid, _, a, b, win in sorted(fights, key=lambda f: (math.inf if f[1] is None else f[1], f[0])):
        y, ka, kb = float(win == a), a.lower(), b.lower()
        ra, rb, ca, cb = r.get(ka, 1500), r.get(kb, 1500), classes.get(ka, "other"), classes.get(kb, "other")
        e = 1 / (1 + 10 ** (-(ra - rb) / 400))
        wins, bouts = w.get((ca, cb), 0), n.get((ca, cb), 0)
        weight = bouts / (bouts + 8)
        out.append((fid, (1 - weight) * e + weight * (wins + 2) / (bouts + 4)))
        k = lambda x: 40 if g.get(x, 0) < 10 else 24
        r[ka], r[kb] = ra + k(ka) * (y - e), rb + k(kb) * (e - y)
        g[ka], g[kb] = g.get(ka, 0) + 1, g.get(kb, 0) + 1
        for key, v in (((ca, cb), y), ((cb, ca), 1 - y)):
            w[key], n[key] = w.get(key, 0) + v, n.get(key, 0) + 1
    return dict(out)


def test_walk_forward_equals_a_loop(spark):
    import random

    rng = random.Random(3)
    bots = ["Red", "Blue", "Gold", "Jade", "Onyx"]
    fights = []
    for i in range(60):
        a, b = rng.sample(bots, 2)
        fights.append((f"f{i:02}", rng.choice([None, 1, 2, 3]), a, b, rng.choice([a, b])))
    ratings, classes = {"red": 1600.0, "jade": 1450.0}, {"red": "drum", "blue": "hammer", "gold": "drum"}
    got = prebout.walk_forward(
        frame(spark, fights, "fight_id string, episode int, bot_a string, bot_b string, winner string"),
        frame(spark, list(ratings.items()), "bot string, rating double"),
        frame(spark, list(classes.items()), "bot string, class string"),
    )
    want = plain_walk(fights, ratings, classes)
    assert {r["fight_id"]: r["p"] for r in got.collect()} == pytest.approx(want)


def test_comparison_picks(spark):
    rows = frame(spark, [("f", "a", "b", "a", 0.6, None), ("g", "a", "b", "a", 0.4, 0.5)], "fight_id string, bot_a string, bot_b string, winner string, generic_p double, main_p double")
    got = prebout.compared(rows).collect()
    assert [(r["generic_pick"], r["generic_correct"], r["main_pick"], r["main_correct"]) for r in got] == [("a", True, None, None), ("b", False, "a", True)]


def test_two_cameras_make_two_clusters(spark):
    rows = [(1, i, [1.0, 0.1, 0.0] if i % 2 == 0 else [0.0, 0.1, 1.0]) for i in range(6)]
    got = [r["cluster"] for r in cluster.greedy(frame(spark, rows, "f int, i int, v array<double>"), "f", "i", "v").orderBy("i").collect()]
    assert got == [0, 1] * 3


def test_blur_keeps_mass_with_mirrored_edges(spark):
    rows = frame(spark, [(0, 0, 5.0), (39, 20, 3.0)], "gx int, gy int, n double")
    assert sum(r["n"] for r in grids.blurred(rows, [], (40, 40)).collect()) == pytest.approx(8.0)
    assert sum(grids.taps()) == pytest.approx(1) and len(grids.taps()) == 13


def test_rolling_percentile_needs_half_its_rows(spark):
    rows = frame(spark, [(1, i, float(i)) for i in range(20)], "k int, i int, v double")
    got = [r["p"] for r in rolling.moving_percentile(rows, ["k"], ["i"], "v", "p", 0.9, 10).orderBy("i").collect()]
    assert got[:4] == [None] * 4 and got[4] == pytest.approx(3.6) and got[19] == pytest.approx(18.1)


def test_moving_percentile_equals_numpy_over_gaps_ties_and_batches(spark):
    rng = np.random.default_rng(7)
    v = rng.integers(0, 9, 700).astype(float)
    v[rng.random(700) < 0.3] = np.nan
    rows = frame(spark, [(k, i, None if np.isnan(x) else float(x), None if i % 3 else i) for k in (1, 2) for i, x in enumerate(v)], "k int, i int, v double, note long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = rolling.moving_percentile(rows, ["k"], ["i"], "v", "p", 0.3, 40, 0.6).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 1400
    for r in got:
        part = v[max(0, r["i"] - 39) : r["i"] + 1]
        part = part[~np.isnan(part)]
        assert r["p"] == (pytest.approx(np.quantile(part, 0.3)) if len(part) >= 24 else None)
        assert r["note"] == (None if r["i"] % 3 else r["i"])


def test_channel_reach(spark):
    videos = frame(spark, [("Red vs Blue", 0, 1000, 0.5), ("red again", 3000, 1, None), ("Bored", 9, 9, 0.1)], "title string, views long, views_approx long, heat_peak double")
    got = {r["name"]: (r["videos"], r["total_views"], r["avg_views"]) for r in league.channel_reach(videos, frame(spark, [("Red",), ("Blue",), ("Gold",)], "name string")).collect()}
    assert got == {"Red": (2, 4000, 2000), "Blue": (1, 1000, 1000)}


def test_manifest_history_and_cards(spark, tmp_path):
    (tmp_path / "m.yaml").write_text("fights:\n  - {fight_id: s, bots: [Red, Blue], synthetic: true}\n  - {fight_id: f1, episode: 1, bots: [Red, Blue], yt_id: TODO, fight_start_s: 3, time_s: TODO, winner: Red, method: ko}\n")
    meta = corpora.to_meta(corpora.manifest(spark, str(tmp_path / "m.yaml"))).collect()
    assert [m["fight_id"] for m in meta] == ["f1"] and meta[0]["video"]["yt_id"] is None and meta[0]["result"]["time_s"] is None and meta[0]["video"]["fight_start_s"] == 3
    assert len(set(meta[0]["colors"].values())) == 2
    html = "<table><tr><td>Red</td><td>Red</td><td>Red</td></tr><tr><td>Season 2 3-1</td><td>Season 2 3-1</td><td>Season 2 3-1</td></tr><tr><td>Final</td><td>vs. <b>Blue</b> (3)</td><td>Won (KO)</td></tr></table>"
    cards = '<a href="/robots/red-one/">Red One</a> Weapon type: <i>Hammer saw</i> <a href="/robots/blue">Blue</a> <a href="/robots/">Robots</a> <a href="/robot/red-one">RED ONE</a>'
    pages = frame(spark, [("p", html), ("q", cards)], "page string, html string")
    rows = corpora.history_rows(corpora.table_rows(pages, "page", "html"), F.lit("Red")).collect()
    assert [(r["season"], r["stage"], r["opponent"], r["won"], r["method"]) for r in rows] == [("Season 2", "Final", "Blue", True, "ko")]
    found = {r["name"]: r["weapon_class"] for r in corpora.roster_cards(pages, "page", "html").collect()}
    assert found == {"Red One": "hammer", "Blue": "other"}


def greedy(times, gap, last=None):
    out = []
    for t in times:
        if last is None or t - last >= gap:
            last = t
            out.append(t)
    return out


def test_debounce_of_long_and_short_bursts_equals_a_greedy_pass(spark, monkeypatch):
    rng = np.random.default_rng(12)
    times = {1: np.sort(rng.uniform(0, 400, 900)).round(1), 2: np.arange(700) * 0.5, 3: np.array([5.0]), 4: np.sort(rng.uniform(0, 9000, 300)), 5: np.repeat([1.0, 4.0, 7.0], 3)}
    rows = frame(spark, [(k, float(t), i) for k, ts in times.items() for i, t in enumerate(ts)] + [(5, None, 0)], "k int, t double, i int")
    for short in (events.SHORT, 20):
        monkeypatch.setattr(events, "SHORT", short)
        got = events.debounced(rows, ["k"], ["t", "i"], "t", 3.0).collect()
        for k, ts in times.items():
            assert sorted(r["t"] for r in got if r["k"] == k) == greedy(ts.tolist(), 3.0)
    assert events.debounced(rows.limit(0), ["k"], ["t", "i"], "t", 3.0).count() == 0


def test_turns_share_one_memory(spark):
    sides = {0: [1.0, 2.0, 9.0], 1: [0.0, 10.0, 12.5, 14.0, 16.0]}
    rows = frame(spark, [("f", s, t) for s, ts in sides.items() for t in ts] + [("g", 1, 0.0)], "k string, side int, t double")
    got = events.debounced_in_turn(rows, ["k"], "side", [0, 1], ["t"], "t", 3.0).collect()
    first = greedy(sides[0], 3.0)
    want = [("f", 0, t) for t in first] + [("f", 1, t) for t in greedy(sides[1], 3.0, first[-1])] + [("g", 1, 0.0)]
    assert sorted((r["k"], r["side"], r["t"]) for r in got) == sorted(want)


def test_nearest_is_linear_in_a_hot_key_and_exact(spark):
    rng = np.random.default_rng(5)
    right = sorted({float(x) for x in rng.integers(0, 10**6, 60_000)})
    left = [float(x) for x in rng.integers(-1000, 10**6 + 1000, 60_000)]
    a = frame(spark, [(1, x) for x in left] + [(2, 5.0)], "k int, t double")
    b = frame(spark, [(1, x, x * 2) for x in right] + [(1, right[0], -1.0), (3, 1.0, 1.0)], "k int, rt double, v double")
    got = matching.nearest(a, b, ["k"], "t", "rt", "v").collect()
    assert len(got) == len(left) + 1
    at = np.array(right)
    for r in got:
        if r["k"] == 2:
            assert r["near_t"] is None
            continue
        i = int(np.searchsorted(at, r["t"]))
        near = min(at[max(0, i - 1) : i + 1], key=lambda x: (abs(x - r["t"]), x))
        assert (r["near_t"], r["near_value"]) == (near, near * 2)


def test_order_values_narrow_down_pass_by_pass(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(float(x),) for x in np.concatenate([rng.normal(size=9000).round(3), np.zeros(4000)])] + [(None,)], "v double").repartition(4)
    values = sorted(r["v"] for r in rows.dropna().collect())
    for ranks in ([0], [len(values) - 1], [6500, 6501], [len(values) // 3]):
        n, got = selection.order_values(rows, "v", lambda n, ranks=ranks: ranks, few=50, accuracy=100)
        assert n == len(values) and got == [values[k] for k in ranks]
    assert selection.order_values(rows.filter("v is null"), "v", lambda n: [0]) == (0, [])


def test_outliers_of_few_rows_and_of_none(spark):
    rows = frame(spark, [(float(v), 0.4 if v > 50 else 0.6) for v in (1, 10, 11, 12, 100)], "v double, s double")
    assert sorted(r["v"] for r in overlay.outliers(rows, "v", "s").filter("labelled").collect()) == [1.0, 100.0]
    assert overlay.outliers(rows.limit(4), "v", "s").filter("labelled").count() == 4
    assert overlay.outliers(frame(spark, [(None, 0.1)] * 6, "v double, s double"), "v", "s").filter("labelled").count() == 0
