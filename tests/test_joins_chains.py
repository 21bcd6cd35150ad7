"""Bucketed interval joins and the possession chain in parts against brute force."""

import random

from touchline.operators.associate import overlap_join, stamp_intervals
from touchline.operators.select import best_per_segment, top
from touchline.operators.sequence import running
from touchline.operators.stateful import ChainSpec, PossessionChain, chain_summary, possession_frames, possession_segments
from touchline.operators.votes import exclude_unstable, majority_exclusions


def intervals(rng, n):
    out = []
    for i in range(n):
        a = rng.uniform(-500, 20_000)
        out.append((rng.choice(["x", "y"]), i, a, a + rng.choice([0, 1, 30, 300, 5_000, 400_000])))
    return out


def test_stamp_and_overlap_against_brute_force(spark):
    rng = random.Random(3)
    iv = intervals(rng, 120) + [("x", 900, 5.0, 1.0), ("y", 901, None, 3.0), (None, 902, 0.0, 9.0)]
    points = [(rng.choice(["x", "y"]), i, rng.choice([None, rng.uniform(-600, 30_000), iv[i % 100][2], iv[i % 100][3]])) for i in range(300)]
    left, right = spark.createDataFrame(points, "k string, row long, t double"), spark.createDataFrame(iv, "k string, id long, a double, z double")
    for last in (True, False):
        out = stamp_intervals(left, right, by=["k"], time="t", start="a", end="z", rank="id", columns=["id"], row="row", last_wins=last)
        got = {r["row"]: r["id"] for r in out.collect()}
        assert len(got) == 300
        for k, row, t in points:
            hits = [i for c, i, a, z in iv if c == k and None not in (t, a, z) and a <= t <= z]
            assert got[row] == ((max if last else min)(hits) if hits else None)
    other = intervals(rng, 80)
    b = spark.createDataFrame(other, "k string, other long, s double, e double")
    met = {(r["id"], r["other"]) for r in overlap_join(right.filter("a <= z"), b, by=["k"], left_ends=("a", "z"), right_ends=("s", "e")).collect()}
    assert met == {(i, j) for k, i, a, z in iv for c, j, s, e in other if k == c and None not in (a, z) and a <= z and a <= e and s <= z}


ROW = "clip string, frame int, time double, player string, distance double, speed double, state string, excluded boolean, repaired boolean"


def chain_rows(rng, clip, n):
    rows, f, state = [], 0, "controlled"
    for _ in range(n):
        f += rng.choice([1, 1, 2, 5, 40])
        if rng.random() < 0.15:
            state = rng.choice(["controlled", "controlled", "in_transit", "loose_or_unclear", "unknown"])
        rows.append((clip, f, f / 30, rng.choice(["1", "1", "1", "2", None]), rng.choice([None, 10.0, 80.0, 81.0, 200.0, 20.0]), rng.choice([None, 100.0, 900.0]), state, rng.random() < 0.1, rng.random() < 0.2))
    return rows


def test_chain_in_parts_equals_one_pass(spark):
    rng = random.Random(8)
    rows = {c: chain_rows(rng, c, 700) for c in ("a", "b")}
    df = spark.createDataFrame([r for x in rows.values() for r in x], ROW).repartition(4)
    names = [x.split()[0] for x in ROW.split(", ")]
    for spec in (ChainSpec(confirm=2), ChainSpec(confirm=3, carry_s=0.5, start_speed=500.0, instant_repaired=True), ChainSpec(confirm=2, carry_s=-1.0)):
        frames, segments = {}, []
        for c, part in rows.items():
            chain = PossessionChain(spec)
            for r in part:
                now, done = chain.step(dict(zip(names, r)))
                frames[c, r[1]] = (now["state"], now["owner"], now["segment"], now["carried"], now["why"])
                segments += [(c, *done)] if done else []
            segments += [(c, *chain.close(chain.last, "end_of_input"))] if chain.owner is not None else []
        got = {(r["clip"], r["frame"]): (r["possession_state"], r["possession_player"], r["segment"], r["carried_rows"], r["transition_reason"]) for r in possession_frames(df, by=["clip"], spec=spec).collect()}
        assert got == frames
        out = possession_segments(df, by=["clip"], spec=spec)
        assert sorted(tuple(r)[:3] + tuple(r)[6:] for r in out.collect()) == sorted(s[:3] + s[6:] for s in segments) and len(segments) > 3
    none = spark.createDataFrame([], ROW)
    assert possession_segments(none, by=["clip"]).count() == 0
    assert chain_summary(possession_frames(none, by=["clip"]), possession_segments(none, by=["clip"]), by=["clip"]).count() == 0


def test_running_both_ways(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = [(c, i, rng.choice([None, rng.randrange(100)])) for c in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "c string, i long, v long")
    out = running(df, by=["c"], order="i", exprs={"up": ("max", False, F.col("v")), "ahead": ("min", True, F.col("v"))}, block=16)
    for r in out.collect():
        mine = [(i, v) for c, i, v in rows if c == r["c"] and v is not None]
        assert r["up"] == max((v for i, v in mine if i <= r["i"]), default=None) and r["ahead"] == min((v for i, v in mine if i >= r["i"]), default=None)


def test_small_selections(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", 0.0, 1, 0.5), ("a", 5.0, 2, 0.9), ("a", 6.0, 3, 0.9), ("a", 10.0, 4, 0.1), ("b", 3.0, 5, 1.0)], "c string, t double, id long, s double")
    got = sorted(tuple(r) for r in best_per_segment(df, df, 2, by=["c"], time="t", score="s", row="id").collect())
    assert got == [("a", 0, 1), ("a", 1, 2)]  # a sequence without extent has none
    assert [r["id"] for r in top(df, 1, by=["c"], order=[F.desc("s"), F.asc("id")], rank="k").orderBy("c").collect()] == [2, 5]
    rows = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("a", None, 3)], "c string, p string, n int")
    votes = spark.createDataFrame([("a", "1", "gone"), ("a", "1", "gone"), ("a", "1", "stay"), ("a", "2", "gone"), ("a", "2", "gone"), ("a", "2", "gone"), ("a", "2", "stay")], "c string, p string, l string")
    kept, removed = majority_exclusions(rows, votes, keys=["c", "p"], label="l", gone="gone")
    assert sorted(r["n"] for r in kept.collect()) == [1, 3] and [r["n"] for r in removed.collect()] == [2]
    flags = spark.createDataFrame([("a", "1", "jumpy_track"), ("a", "2", "stable")], "c string, p string, stability_flag string")
    out = exclude_unstable(rows.withColumn("excluded", F.lit(None).cast("boolean")), flags, by=["c"], player="p")
    assert {r["n"]: r["excluded"] for r in out.collect()} == {1: True, 2: False, 3: False}
