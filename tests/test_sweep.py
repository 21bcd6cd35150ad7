"""The sweep over settings: against one run a setting, and what it writes."""

import random
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from touchline import session
from touchline.operators import stateful
from touchline.plans import pipelines

SETTINGS = [(g, v) for g in (0.1, 0.2, 0.5) for v in (60.0, 150.0, 900.0)]
SPEC = stateful.ChainSpec(confirm=2, max_distance=60.0, carry_s=0.3)
LIMITS = {"max_distance": 90.0, "control_distance": 60.0, "controlled_speed": 250.0, "transit_speed": 400.0}
OUT = ["clip", "max_gap_seconds", "max_speed", "path_rows", "interpolated_rows", "controlled_frames", "in_transit_frames", "loose_or_unclear_frames", "pending_control_frames", "segments", "total_seconds", "median_seconds"]


def clips(spark, rows=250):
    """Balls with gaps and several readings in a frame, players in some stretches only; the last clip has none."""
    rnd, balls, players, n = random.Random(5), [], [], 10**17
    for clip in ("a", "b", "c", "none"):
        frame, x = 0, 100.0
        for _ in range(rows):
            frame += rnd.choice((0, 1, 1, 1, 1, 2, 3, 5, 8, 14, 30))
            x += rnd.choice((-60.0, -12.0, -3.0, 0.0, 0.0, 3.0, 12.0, 60.0)) + rnd.random()
            n += 1
            balls.append((clip, n, frame, x, 50.0 + rnd.random()))
        for f in range(frame + 1) if clip != "none" else ():
            if f // 40 % 4 and rnd.random() < 0.95:
                players += [(clip, f, p, 100.0 + 60 * p + rnd.gauss(0, 25), 50.0, rnd.choice(("strict", "tolerant"))) for p in range(3)]
    b = spark.createDataFrame(balls, "clip string, detection_id long, frame int, center_x double, center_y double")
    # the limits above are for a ball of 30 frames a second; other columns as the views have them
    b = b.withColumns({c: F.col(f"center_{c[0]}") for c in ("x1", "x2", "y1", "y2")}).withColumns({"confidence": F.lit(0.5), "time_seconds": F.col("frame") / 30.0, "object_type": F.lit("ball")})
    return b, spark.createDataFrame(players, "clip string, frame int, player_id long, foot_x double, foot_y double, field_zone string")


def told(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*OUT).collect())


def one_by_one(balls, players, settings, spec):
    out = []
    for g, v in settings:
        path, rows = pipelines.clip_rows(balls, players, 30.0, by=["clip"], max_gap_s=g, max_speed=v, **LIMITS)
        rows = session.materialise(rows)
        args = {"by": ["clip"], "spec": spec, "tie": ["detection_id"]}
        chain = stateful.chain_summary(stateful.possession_frames(rows, **args), stateful.possession_segments(rows, **args), by=["clip"])
        made = path.groupBy("clip").agg(F.count(F.lit(1)).alias("path_rows"), F.count_if(F.col("source") != "detected").alias("interpolated_rows"))
        out += told(made.join(chain, "clip").withColumns({"max_gap_seconds": F.lit(g), "max_speed": F.lit(v)}))
    return sorted(out)


@pytest.mark.parametrize("spec", [SPEC, replace(SPEC, carry_s=-1.0, start_speed=120.0, start_distance=40.0)], ids=["carried", "for_ever"])
def test_sweep_is_one_run_a_setting(spark, spec):
    balls, players = clips(spark)
    some = [SETTINGS[0], SETTINGS[4], SETTINGS[8]]
    got = told(pipelines.sweep(balls, players, 30.0, SETTINGS, by=["clip"], spec=spec, **LIMITS))
    assert len(got) == 4 * len(SETTINGS)
    assert [r for r in got if r[1:3] in some] == one_by_one(balls, players, some, spec)
    assert len({r[3:] for r in got if r[0] == "a"}) > 4 and sum(r[9] for r in got) > 100 and all(r[9] == 0 for r in got if r[0] == "none")
    assert told(pipelines.sweep(balls, players.limit(0), 30.0, SETTINGS, by=["clip"], spec=spec, **LIMITS)) == [(*r[:5], 0, 0, 0, 0, 0, 0.0, 0.0) for r in got]


def test_sweep_writes_no_copy_a_setting(spark):
    balls, players = (session.materialise(t) for t in clips(spark))

    def written(settings):
        shared = Path(session.shared_dir(spark).removeprefix("file://"))
        before = set(shared.iterdir())
        pipelines.sweep(balls, players, 30.0, settings, by=["clip"], spec=SPEC, **LIMITS).collect()
        return sum(spark.read.parquet(f"file://{p}").count() for p in set(shared.iterdir()) - before)

    assert written(SETTINGS) < 1.5 * written(SETTINGS[-1:])
