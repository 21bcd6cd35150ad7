"""The ball path cut into parts gives what one pass over a sequence gives."""

import random

from touchline.operators.stateful import LEGACY, BallTracker, BallTrackSpec, ball_path

CAND = "clip string, frame int, id long, confidence double, center_x double, center_y double, box_size double, player_penalty double"


def one_pass(rows, spec):
    out, tracker = set(), BallTracker(spec)
    for f in sorted({r[1] for r in rows}):
        cands = [dict(zip(("frame", "row", "confidence", "center_x", "center_y", "box_size", "player_penalty"), r[1:])) for r in sorted(rows, key=lambda r: r[2]) if r[1] == f]
        if (got := tracker.pick(f, cands)) is not None:
            out.add((f, got["row"]))
    return out


def test_parts_equal_one_pass(spark):
    rng = random.Random(12)
    rows, i = [], 0
    for clip in ("a", "b", "c"):
        f, x, y = 0, 500.0, 300.0
        for _ in range(900):
            f += rng.choice([1, 1, 1, 2, 5, 20, 31, 45, 90])
            x, y = x + rng.gauss(0, 20), y + rng.gauss(0, 10)
            for _ in range(rng.choice([1, 1, 2, 3])):
                i += 1
                rows.append((clip, f, i, rng.random() * rng.choice([0.4, 1.0]), x + rng.gauss(0, 60), y + rng.gauss(0, 60), 5 + rng.random() * 20, rng.choice([0.0, 0.0, 100.0])))
    df = spark.createDataFrame(rows, CAND).repartition(5)
    for spec in (BallTrackSpec(), LEGACY, BallTrackSpec(restart=0.8)):
        want = {(c, f, k) for c in ("a", "b", "c") for f, k in one_pass([r for r in rows if r[0] == c], spec)}
        got = [tuple(r) for r in ball_path(df, by=["clip"], row="id", spec=spec).select("clip", "frame", "id").collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_no_candidates(spark):
    assert ball_path(spark.createDataFrame([], CAND), by=["clip"], row="id").count() == 0
