"""Intervals and references against brute force, with the edge cases they define."""

import random

from touchline.operators.intervals import merge_intervals
from touchline.operators.references import orphan_references

SCHEMA = "team string, player string, a long, b long, start string"


def brute(rows):
    out, by = set(), {}
    for team, player, a, b, *_ in rows:
        if a is not None and b is not None and b > a:
            by.setdefault((team, player), []).append((a, b))
    for key, iv in by.items():
        iv.sort()
        periods = [list(iv[0])]
        for a, b in iv[1:]:
            if a <= periods[-1][1]:
                periods[-1][1] = max(periods[-1][1], b)
            else:
                periods.append([a, b])
        out |= {(*key, "period", a, b) for a, b in periods}
        out |= {(*key, "gap", p[1], q[0]) for p, q in zip(periods, periods[1:])}
    return out


def merged(spark, rows, ranges):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, merge_intervals(df, entity=["team", "player"], start="a", end="b", ranges=ranges).collect()), key=str)


def test_merge_with_hot_entity_nulls_and_ties(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        a = rng.randrange(0, 40_000)
        player = "hot" if i % 3 == 0 else rng.choice(["p1", "p2", None, ""])
        rows.append((rng.choice(["x", None]), player, a, a + rng.choice([0, 1, 5, 30, -4]), "clash"))
    rows += [("x", "hot", None, 5, ""), ("x", "hot", 5, None, ""), ("x", "hot", 0, 35_000, ""), ("x", "hot", 0, 35_000, "")]
    for ranges in (1, 7, 40):
        assert merged(spark, rows, ranges) == sorted(brute(rows), key=str)


def test_merge_touching_and_nested(spark):
    rows = [("t", "p", 0, 10, ""), ("t", "p", 10, 20, ""), ("t", "p", 2, 5, ""), ("t", "p", 21, 30, "")]
    assert merged(spark, rows, 3) == sorted({("t", "p", "period", 0, 20), ("t", "p", "period", 21, 30), ("t", "p", "gap", 20, 21)}, key=str)


def test_merge_empty(spark):
    assert merged(spark, [], 4) == []


REFS, PARENTS = "key string, seen timestamp, n int, reason_ string", "key string, since timestamp, gone boolean, n string"


def ts(day):
    import datetime

    return None if day is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day)


def test_orphans_against_brute_force(spark):
    rng = random.Random(5)
    parents = {f"k{i}": (rng.choice([None, *range(20)]), rng.choice([True, False, None])) for i in range(0, 400, 2)}
    refs = [(rng.choice([None, "hot", *[f"k{i}" for i in range(400)]]) if i % 3 else "hot", ts(rng.choice([None, *range(20)])), i, "x") for i in range(4000)]
    parents["hot"] = (3, False)
    up = spark.createDataFrame([(k, ts(d), g, "other") for k, (d, g) in parents.items()], PARENTS)
    want = set()
    for key, seen, i, _ in refs:
        if key is None:
            continue
        if key not in parents:
            want.add((i, "missing"))
        elif parents[key][1]:
            want.add((i, "gone"))
        elif parents[key][0] is not None and seen is not None and ts(parents[key][0]) > seen:
            want.add((i, "late"))
    df = spark.createDataFrame(refs, REFS)
    for hot in (100, 10**9):
        got = {(r["n"], r["reason"]) for r in orphan_references(df, up, hot=hot, ranges=6).collect()}
        assert got == want


def test_orphans_empty_sides(spark):
    refs, parents = spark.createDataFrame([("a", ts(1), 1, "")], REFS), spark.createDataFrame([], PARENTS)
    assert [r["reason"] for r in orphan_references(refs, parents).collect()] == ["missing"]
    assert orphan_references(spark.createDataFrame([], REFS), parents).count() == 0
