"""Operators on hand-made sequences and against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.functions.geometry import fit_homography, grid_bin, in_polygon, iou, parse_polygon, project
from touchline.functions.ids import clean_id, numbered_id, words_state
from touchline.functions.text import clock_seconds, hash_numbers, minutes_millis, minutes_seconds, stem, truth
from touchline.operators import associate, evaluate, motion, possession, select, stateful, value, votes
from touchline.operators.sequence import neighbours, running, running_count


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def sequence(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b"]), rng.randrange(0, 900), i, float(rng.randrange(50)), rng.random() < 0.2) for i in range(600)]
    return spark.createDataFrame(rows, "clip string, f int, id int, v double, flag boolean").cache()


@pytest.mark.parametrize("block", [7, 100, 65536])
def test_blocked_windows_equal_plain_ones(sequence, block):
    w = Window.partitionBy("clip").orderBy("f", "id")
    want = sequence.select("id", F.lag("v").over(w).alias("prev_v"), F.lead("v").over(w).alias("next_v"), F.sum(F.col("flag").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n"))
    got = neighbours(sequence, by=["clip"], order="f", columns=["v"], tie=["id"], following=True, block=block)
    got = running_count(got, by=["clip"], order="f", flag=F.col("flag"), name="n", tie=["id"], block=block).select("id", "prev_v", "next_v", "n")
    assert sorted(want.collect(), key=lambda r: r["id"]) == sorted(got.collect(), key=lambda r: r["id"])
    numbered = running_count(sequence, by=["clip"], order="f", flag=F.lit(True), name="i", tie=["id"])
    wi = Window.partitionBy("clip").orderBy("i")
    want = numbered.select("id", F.max("v").over(wi.rowsBetween(Window.unboundedPreceding, 0)).alias("a"), F.min("v").over(wi.rowsBetween(0, Window.unboundedFollowing)).alias("b"))
    got = running(numbered, by=["clip"], order="i", exprs={"a": ("max", False, F.col("v")), "b": ("min", True, F.col("v"))}, block=block).select("id", "a", "b")
    assert sorted(want.collect(), key=lambda r: r["id"]) == sorted(got.collect(), key=lambda r: r["id"])


def test_ids_and_texts(spark):
    ids = {"7.0": "7", " 7 ": "7", "x9 ": "x9", None: "", "7.5": "7.5"}
    got = spark.createDataFrame([(k,) for k in ids], "t string").select("t", clean_id("t").alias("x")).collect()
    assert {r["t"]: r["x"] for r in got} == ids
    keys = {" Segment_0009\t": "segment_9", "segment_10": "segment_10", "segment_000": "segment_0", "NONE": None, "": None, None: None}
    got = spark.createDataFrame([(k,) for k in keys], "t string").select("t", numbered_id("t").alias("x")).collect()
    assert {r["t"]: r["x"] for r in got} == keys
    assert one(spark, words_state(F.lit(" In-Transit "))) == "in_transit"
    assert one(spark, minutes_seconds(F.lit(125.9))) == "2:05" and one(spark, minutes_millis(F.lit(61.2345))) == "01:01.235"
    assert one(spark, clock_seconds(F.lit("00:12:34.567"))) == pytest.approx(754.567)
    assert one(spark, hash_numbers(F.lit("see #1 and # 12"))) == [1, 12] and one(spark, stem(F.lit("/a/b.c/d.e.txt"))) == "d.e"
    assert one(spark, truth(F.lit(" Yes"))) and not one(spark, truth(F.lit(None).cast("string")))


def test_polygon_boundaries(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    text = parse_polygon(F.lit("0,0;10,0;10,10;0,10"))
    want = {"half_open": {(5, 5), (5, 10), (10, 5)}, "even_odd": {(5, 5), (0, 5), (5, 0)}, "inclusive": {(5, 5), (5, 10), (10, 5), (0, 5), (5, 0), (10, 10)}}
    points = [(5, 5), (5, 10), (10, 5), (0, 5), (5, 0), (10, 10), (11, 5)]
    df = spark.createDataFrame([(float(x), float(y)) for x, y in points], "x double, y double")
    for mode, inside in want.items():
        for polygon in (square, text):
            got = {(r["x"], r["y"]) for r in df.filter(in_polygon("x", "y", polygon, mode)).collect()}
            assert got - {(10, 10), (0, 0)} == inside - {(10, 10)}, mode
    assert one(spark, in_polygon(F.lit(1.0), F.lit(1.0), parse_polygon(F.lit(None).cast("string")), null_is=True)) is True


def test_boxes_grid_and_homography(spark):
    box = lambda *q: tuple(map(F.lit, map(float, q)))
    assert one(spark, iou(box(0, 0, 2, 2), box(1, 1, 3, 3))) == pytest.approx(1 / 7)
    assert one(spark, iou(box(0, 0, 0, 0), box(1, 1, 1, 1))) == 0
    assert [one(spark, grid_bin(F.lit(v), 120.0, 6)) for v in (-5.0, 0.0, 59.9, 120.0, 500.0)] == [0, 0, 2, 5, 5]
    h = fit_homography([(0, 0), (100, 0), (100, 50), (0, 50)], [(0, 0), (120, 0), (120, 75), (0, 75)])
    x, y = project(F.lit(50.0), F.lit(25.0), h)
    assert one(spark, x) == pytest.approx(60) and one(spark, y) == pytest.approx(37.5)
    with pytest.raises(ValueError):
        fit_homography([(0, 0)], [(0, 0)])


BALL = "clip string, detection_id long, frame int, confidence double, x1 double, y1 double, x2 double, y2 double, center_x double, center_y double, time_seconds double, object_type string"


def balls(spark, rows):
    return spark.createDataFrame([("c", i, f, 0.5, x - 1, y - 1, x + 1, y + 1, float(x), float(y), f / 30.0, "ball") for i, (f, x, y) in enumerate(rows)], BALL)


def test_interpolation_and_speed(spark):
    b = balls(spark, [(0, 0.0, 0.0), (4, 8.0, 4.0), (4, 9.0, 4.0), (40, 9.0, 4.0), (42, 3000.0, 4.0)])
    out = motion.interpolate(b, 30.0, by=["clip"], max_gap_s=0.5, max_speed=2500.0, tie=["detection_id"]).orderBy("frame", "detection_id").collect()
    assert [(r["frame"], r["center_x"], r["source"]) for r in out[:4]] == [(0, 0.0, "detected"), (1, 2.0, "interpolated"), (2, 4.0, "interpolated"), (3, 6.0, "interpolated")]
    assert len(out) == 8 and all(r["confidence"] is None for r in out if r["source"] == "interpolated")
    m = motion.motion(b, 30.0, by=["clip"], tie=["detection_id"]).orderBy("detection_id").collect()
    assert m[0]["prev_frame"] is None and m[2]["ball_speed_px_per_second"] == float("inf") and m[3]["ball_speed_px_per_second"] == 0
    assert motion.interpolate(b.limit(0), 30.0, by=["clip"], max_gap_s=0.5).count() == 0


def test_joins_against_brute_force(spark):
    rng = random.Random(3)
    left = [(rng.choice("ab"), rng.randrange(300), i) for i in range(200)]
    states = sorted({(rng.choice("ab"), rng.randrange(300)) for _ in range(60)})
    ld = spark.createDataFrame(left, "k string, f int, id int")
    sd = spark.createDataFrame([(k, f, f * 10) for k, f in states], "k string, f int, s int")
    want = {i: max((g for h, g in states if h == k and g <= f), default=None) for k, f, i in left}
    for block in (16, 4096):
        got = {r["id"]: r["s"] for r in associate.asof_backward(ld, sd, by=["k"], order="f", columns=["s"], block=block).collect()}
        assert got == {i: None if g is None else g * 10 for i, g in want.items()}
    pairs = {(r["id"], r["s"]) for r in associate.range_join(ld, sd, by=["k"], order="f", reach=5).collect()}
    assert pairs == {(i, g * 10) for k, f, i in left for h, g in states if h == k and abs(f - g) <= 5}
    iv = [(rng.choice("ab"), s, s + rng.randrange(0, 90), n) for n, s in enumerate(rng.sample(range(300), 40))]
    idf = spark.createDataFrame([(*x, f"v{x[3]}") for x in iv], "k string, a int, z int, n int, label string")
    for last in (True, False):
        got = {r["id"]: r["label"] for r in associate.stamp_intervals(ld, idf, by=["k"], time="f", start="a", end="z", rank="n", columns=["label"], row="id", width=20.0, last_wins=last).collect()}
        for k, f, i in left:
            hit = [n for h, a, z, n in iv if h == k and a <= f <= z]
            assert got[i] == (f"v{(max if last else min)(hit)}" if hit else None)


def test_nearest_prefers_strict_within_limit(spark):
    b = balls(spark, [(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0)])
    p = spark.createDataFrame([("c", 1, 1, 10.0, 0.0, "tolerant"), ("c", 1, 2, 100.0, 0.0, "strict"), ("c", 2, 1, 10.0, 0.0, "tolerant"), ("c", 2, 2, 151.0, 0.0, "strict"), ("c", 2, 3, -10.0, 0.0, "tolerant")], "clip string, frame int, player_id int, foot_x double, foot_y double, field_zone string")
    n = associate.nearest(b, p, keys=["clip", "frame"], row="detection_id", keep=["field_zone"], prefer=F.col("field_zone") == "strict")
    assert {r["frame"]: r["nearest_player_id"] for r in n.collect()} == {1: 2, 2: 1, 3: None}


def test_demo_accuracy_and_pass(spark):
    truth_rows = [(0.0, 2.5, "controlled", "home", "home_07"), (2.5, 3.1, "airborne", "", ""), (3.1, 6.2, "controlled", "home", "home_10"), (6.2, 7.0, "contested", "", ""), (7.0, 10.0, "controlled", "away", "away_04")]
    guess_rows = [(0.0, 2.7, "controlled", "home", "home_07"), (2.7, 3.0, "airborne", "", ""), (3.0, 6.4, "controlled", "home", "home_10"), (6.4, 7.2, "contested", "", ""), (7.2, 10.0, "controlled", "away", "away_04")]
    make = lambda rows: spark.createDataFrame([("m", f"s{i}", *r, None) for i, r in enumerate(rows)], "m string, id string, start double, end double, state string, team string, player string, confidence double")
    r = possession.time_weighted_accuracy(make(truth_rows), make(guess_rows), by=["m"]).first()
    assert (r["evaluated_seconds"], r["controlled_seconds"], r["state_seconds"], r["team_seconds"], r["player_seconds"]) == pytest.approx((10.0, 8.6, 9.3, 8.4, 8.4))
    events, skipped = possession.passes(make(truth_rows), by=["m"])
    e = events.collect()
    assert len(e) == 1 and e[0]["from_player"] == "home_07" and e[0]["to_player"] == "home_10" and e[0]["duration"] == pytest.approx(0.6) and e[0]["id"] == "event_0001"
    assert skipped.count() == 0


def test_pass_rules(spark):
    rows = [("s1", 0.0, 1.0, "left", "a"), ("s2", 1.0, 2.0, "left", "b"), ("s3", 4.5, 5.0, "left", "c"), ("s4", 5.0, 6.0, "right", "d"), ("s5", 6.0, 7.0, "unknown", "e"), ("s6", 7.0, 8.0, "right", "f"), ("s7", 8.0, 9.0, "right", "g"), ("s8", 8.5, 9.5, "right", "g"), ("s9", 9.5, 9.9, "right", "h")]
    df = spark.createDataFrame([("m", i, a, b, "controlled", t, p, 0.5) for i, a, b, t, p in rows], "m string, id string, start double, end double, state string, team string, player string, confidence double")
    dead = spark.createDataFrame([("m", 8.9, 9.2, "goal", 1)], "m string, start double, end double, reason string, rank int")
    events, skipped = possession.passes(df, by=["m"], non_live=dead)
    assert [(r["from_possession_id"], r["id"]) for r in events.orderBy("id").collect()] == [("s1", "event_0001")]
    assert {r["from_possession_id"]: r["skip_reason"] for r in skipped.collect()} == {"s4": "unknown_team", "s5": "unknown_team", "s6": "non_live:goal", "s8": "non_live:goal"}
    events, _ = possession.passes(df, by=["m"], allow_unknown=True)
    assert {r["from_possession_id"]: r["type"] for r in events.collect()}["s5"] == "possession_transition_candidate"


def chain(rows, **spec):
    c, out, done = stateful.PossessionChain(stateful.ChainSpec(**spec)), [], []
    for i, (player, state, dist, speed) in enumerate(rows):
        now, closed = c.step({"frame": i, "time": i * 0.5, "player": player, "distance": dist, "speed": speed, "state": state, "excluded": False, "repaired": False})
        out.append((now["state"], now["owner"]))
        done += [closed] if closed else []
    return out, done, c


def test_chain_confirms_carries_and_times_out():
    control, away = ("a", "controlled", 10.0, 0.0), (None, "in_transit", None, 900.0)
    out, done, c = chain([control] * 3 + [away] * 6, confirm=3)
    assert out[:3] == [("pending_control", None), ("pending_control", None), ("controlled", "a")]
    assert done == [(1, "a", 1.0, 4.0, 3.0, 2, 8, "carry_forward_timeout")] and c.owner is None
    out, done, _ = chain([control] * 3 + [("b", "controlled", 80.0, 0.0)] * 3, confirm=3)
    assert out[3] == ("in_transit", "a") and done[0][-1] == "confirmed_new_controller" and out[5] == ("controlled", "b")
    assert chain([("a", "controlled", 80.1, 0.0)] * 9, confirm=3)[2].owner is None
    out, _, c = chain([("a", "controlled", 10.0, 999.0)] * 4 + [control], confirm=3, start_speed=500.0)
    assert out[3] == ("pending_control", None) and c.owner == "a" and c.begun[1] == 4
    assert chain([control] * 3 + [(None, "unknown", None, None)] * 20, confirm=3)[2].owner == "a"


def test_chain_in_spark_ignores_row_order_and_other_clips(spark):
    rng = random.Random(7)
    rows = [("x", i, i / 30.0, rng.choice(["1", "1", "1", "2", None]), rng.choice([5.0, 20.0, 90.0, None]), 10.0, rng.choice(["controlled", "controlled", "in_transit", "unknown"]), False, False) for i in range(500)]
    schema = "clip string, frame int, time double, player string, distance double, speed double, state string, excluded boolean, repaired boolean"
    spec = stateful.ChainSpec(confirm=2, carry_s=0.2)
    a = sorted(map(tuple, stateful.possession_segments(spark.createDataFrame(rows, schema), by=["clip"], spec=spec).collect()))
    mixed = rows + [("y", *r[1:]) for r in rows]
    rng.shuffle(mixed)
    b = stateful.possession_segments(spark.createDataFrame(mixed, schema).repartition(7), by=["clip"], spec=spec).collect()
    assert sorted(tuple(r) for r in b if r["clip"] == "x") == a and len(b) == 2 * len(a) and len(a) > 3
    by_segment = sorted(a, key=lambda r: r[1])
    assert all(p[6 + 1] <= q[6] for p, q in zip(by_segment, by_segment[1:]))  # segments don't overlap


def test_player_tracks_follow_and_number_on(spark):
    rows = []
    for f in [*range(0, 30), *range(60, 80)]:
        rows += [("c", f, 1, 0.9, 100.0 + f, 100.0, 120.0 + f, 150.0, 110.0 + f, 150.0), ("c", f, 2, 0.8, 600.0 - f, 100.0, 620.0 - f, 150.0, 610.0 - f, 150.0)]
    schema = "clip string, frame int, player_id int, confidence double, x1 double, y1 double, x2 double, y2 double, foot_x double, foot_y double"
    t = stateful.track_players(spark.createDataFrame(rows, schema), by=["clip"]).collect()
    assert {(r["track_id"], r["player_id"], r["frame"] >= 60) for r in t} == {(1, 1, False), (2, 2, False), (3, 1, True), (4, 2, True)}
    assert sum(r["track_status"] == "new" for r in t) == 4
    assert stateful.track_players(spark.createDataFrame([], schema), by=["clip"]).count() == 0


def all_pairs_matches(tracks, seen, boxes, frame, spec):
    pairs = []
    for i, t in enumerate(tracks):
        for j, b in enumerate(boxes):
            (_, _, _, d, allowed, iou), = stateful.match_frame(t[None], seen[i : i + 1], b[None], frame, spec) or [(0, 0, 0.0, 0.0, 0.0, None)]
            if iou is not None:
                ta, ba = (np.maximum(1.0, (q[2] - q[0]) * (q[3] - q[1])) for q in (t, b))
                score = d / allowed + (1 - iou) * 0.35 + np.minimum(1.0, abs(np.log(np.maximum(ta, ba) / np.minimum(ta, ba)))) * 0.20
                pairs.append((np.inf if np.isnan(score) else score, d, -iou, i, j))
    out, used_t, used_b = [], set(), set()
    for _, _, _, i, j in sorted(pairs):
        if i not in used_t and j not in used_b:
            used_t.add(i), used_b.add(j)
            out.append((i, j))
    return out


def test_crowded_frames_match_as_all_pairs_do():
    rng, spec = np.random.default_rng(5), stateful.PlayerTrackSpec()
    for spread in (60, 900):
        for odd in (False, True):
            def some(n):
                x, y, w, h = rng.integers(0, spread, n) * 1.0, rng.integers(0, spread, n) * 1.0, rng.integers(5, 40, n), rng.integers(10, 90, n)
                b = np.stack([x - w / 2, y - h, x + w / 2, y, x, y], 1)
                if odd:
                    b[0, 1] -= 500.0  # one tall box
                    b[1, 0] = np.nan
                    b[2, 4:] += 300.0  # feet far from the box
                return b
            tracks, boxes, seen = some(70), some(90), rng.integers(1, 9, 70)
            want = all_pairs_matches(tracks, seen, boxes, 10, spec)
            for most in (7, 100, 2000, 1_000_000):
                got = [m[:2] for m in stateful.match_frame(tracks, seen, boxes, 10, spec, most)]
                assert sorted(got) == sorted(want) and len(want) > 20


def test_player_tracks_keep_the_crowded_frame(spark, tmp_path):
    from touchline.plans import automata

    spot = lambda f, k: ("v", f, k, 0.9, 100.0 * k, 100.0, 100.0 * k + 20, 150.0, 100.0 * k + 10 + f, 150.0, 1)
    rows = [spot(0, 1), *[spot(1, k) for k in range(1, 91)], spot(2, 1), spot(2, 80)]
    schema = "video string, frame int, player_id int, confidence double, x1 double, y1 double, x2 double, y2 double, foot_x double, foot_y double, loaded_at int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/player_detections.parquet")
    t = {(r["frame"], r["player_id"]): r for r in automata.player_tracks(spark, str(tmp_path)).collect()}
    assert len(t) == len(rows)
    assert len({t[f, 1]["track_id"] for f in (0, 1, 2)}) == 1 and t[1, 80]["track_id"] == t[2, 80]["track_id"] and t[2, 1]["track_age"] == 3


def test_ball_tracker_resets_and_rejects():
    row = lambda f, x, c=0.9, k=0: {"row": k, "frame": f, "confidence": c, "center_x": x, "center_y": 0.0, "box_size": 10.0, "player_penalty": 0.0}
    t = stateful.BallTracker(stateful.BallTrackSpec())
    assert t.pick(0, [row(0, 0.0, 0.4)]) is None and t.pick(1, [row(1, 0.0, 0.5)]) is not None
    assert t.pick(2, [row(2, 20.0), row(2, 3000.0, 0.69, 1)])["center_x"] == 20.0
    assert t.pick(40, [row(40, 40.0)]) is None and t.pick(41, [row(41, 40.0)]) is not None  # a reset discards its frame
    kept = [t.pick(42 + i, [row(42 + i, 40.0)]) for i in range(14)]
    assert kept[10] is not None and kept[11] is None


def test_votes_and_selection(spark):
    df = spark.createDataFrame([("s", "left", 0.9), ("s", "left", 0.7), ("s", "right", 0.5), ("s", None, 0.5), ("t", "unknown", 0.5), ("u", "right", 0.5), ("u", "left", 0.5)], "seg string, team string, confidence double")
    segs = spark.createDataFrame([(x, "old") for x in "stuv"], "seg string, team string")
    got = {r["seg"]: (r["team"], r["team_vote_frames"], r["team_vote_total_frames"]) for r in votes.team_vote(segs, df, keys=["seg"]).collect()}
    assert got == {"s": ("left", 2, 3), "t": ("unknown", 0, 0), "u": ("unknown", 1, 2), "v": ("unknown", 0, 0)}
    nums = spark.range(11).select(F.lit("a").alias("k"), F.col("id").alias("i"))
    assert sorted(r["i"] for r in select.evenly(nums, 4, by=["k"], order=["i"]).collect()) == [0, 3, 7, 10]
    assert select.evenly(nums, 20, by=["k"], order=["i"]).count() == 11
    out = select.expand_offsets(nums.filter("i in (0, 5)").withColumnRenamed("i", "frame"), [-5, 0, 5], 8, by=["k"]).collect()
    assert {(r["frame"], r["source_frame"]) for r in out} == {(0, 5), (5, 5), (8, 5)}


def ball_tables(spark, folder, readings):
    """Tables with ball readings (detection_id, video, frame, confidence, center_x, center_y), and without players and associations."""
    rows = [(i, v, f, c, x - 5.0, y - 5.0, x + 5.0, y + 5.0, x, y, 1) for i, v, f, c, x, y in readings]
    kinds = "x1 double, y1 double, x2 double, y2 double, center_x double, center_y double, loaded_at int"
    spark.createDataFrame(rows, f"detection_id long, video string, frame int, confidence double, {kinds}").write.parquet(f"{folder}/ball_detections.parquet")
    for t in ("player_detections", "association"):
        spark.createDataFrame([("b", 130)], "video string, frame int").write.parquet(f"{folder}/{t}.parquet")


def test_neighbour_frames_end_with_their_video(spark, tmp_path):
    from touchline.plans import reference

    ball_tables(spark, tmp_path, [(1, "a", 30000, 0.1, 9.0, 9.0), (2, "a", 30020, 0.1, 9.0, 9.0), (3, "a", 30050, 0.9, 9.0, 9.0), (4, "b", 100, 0.1, 9.0, 9.0)])
    got = {tuple(r) for r in reference.neighbour_frames(spark, str(tmp_path)).collect()}
    assert got == {("a", 29940, 30000), ("a", 30000, 30000), ("a", 30050, 30020), ("a", 29960, 30020), ("a", 30020, 30020), ("b", 40, 100), ("b", 100, 100), ("b", 130, 100)}


def test_expected_threat_counts_places_of_larger_pictures(spark, tmp_path):
    from touchline.plans import reference

    # 33 is a shot and a goal, 44 a shot from a place that cannot be
    ball_tables(spark, tmp_path, [(32, "a", 0, 0.9, 3000.0, 500.0), (33, "a", 3, 0.9, 3100.0, 510.0), (43, "b", 0, 0.9, 99999.0, 500.0), (44, "b", 3, 0.9, 100.0, 500.0)])
    got = {(r["row"], r["col"]): r["value"] for r in reference.expected_threat(spark, str(tmp_path)).collect()}
    assert len(got) == 192 and got.pop((5, 15)) == pytest.approx(1.0) and not any(got.values())


def test_values_and_outcomes(spark):
    acts = spark.createDataFrame([("p", "pass", 0.0, 0.0, 105.0, 68.0), ("p", "carry", 50.0, 30.0, None, 1.0), ("q", "shot", 1.0, 1.0, 1.0, 1.0)], "player string, event_type string, start_x double, start_y double, end_x double, end_y double")
    kept = value.static_values(value.actions_only(acts), [[0.0, 0.1], [0.2, 0.5]])
    assert [r["value_added"] for r in kept.collect()] == [0.5]
    surface = value.fit_expected_threat(spark.createDataFrame([("shot", 100.0, 34.0, None, None, True, True), ("pass", 10.0, 34.0, 100.0, 34.0, True, False)], "event_type string, start_x double, start_y double, end_x double, end_y double, success boolean, goal boolean"), 4, 2)
    assert surface[1][3] == pytest.approx(1.0) and surface[1][0] == pytest.approx(1.0) and surface[0][0] == 0
    items = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "k string")
    box = "k string, confidence double, x1 double, y1 double, x2 double, y2 double"
    t = spark.createDataFrame([("a", 1.0, 0.0, 0.0, 2.0, 2.0), ("b", 1.0, 0.0, 0.0, 2.0, 2.0), ("c", 1.0, 0.0, 0.0, 2.0, 2.0)], box)
    g = spark.createDataFrame([("a", 0.9, 0.0, 0.0, 2.0, 2.1), ("b", 0.9, 5.0, 5.0, 6.0, 6.0), ("d", 0.9, 0.0, 0.0, 1.0, 1.0)], box)
    got = {r["k"]: r["outcome"] for r in evaluate.detection_outcomes(items, t, g, key="k").collect()}
    assert got == {"a": "true_positive", "b": "poor_localization", "c": "missed_ball", "d": "false_positive_on_null", "e": "true_negative_null"}
