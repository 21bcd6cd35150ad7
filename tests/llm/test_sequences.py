"""Runs and top-n against brute force."""

import itertools
import random

from touchline.llm.runs import collapse_runs
from touchline.llm.topn import top_n

RUN = "clip string, f int, player string, state string, t double, n_rows string"


def brute_runs(rows, gap, least):
    out = []
    ok = sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[:2])
    for clip, part in itertools.groupby(ok, key=lambda r: r[0]):
        part, start = list(part), 0
        for i in range(1, len(part) + 1):
            if i == len(part) or part[i][2:4] != part[start][2:4] or part[i][1] - part[i - 1][1] > gap:
                if i - start >= least:
                    out.append((clip, *part[start][2:4], part[start][1], part[i - 1][1], i - start, part[i - 1][4] - part[start][4]))
                start = i
    return sorted(out, key=str)


def test_runs_against_brute_force(spark):
    rng = random.Random(4)
    rows, f = [], 0
    for clip in ("hot", "b", "c"):
        for i in range(4000 if clip == "hot" else 300):
            f += rng.choice([1, 1, 2, 16, 15])
            stay = i % 500 < 350
            rows.append((clip, f, "7" if stay else rng.choice(["7", "8", None, ""]), "controlled" if stay else rng.choice(["x", None]), float(f), "clash"))
    rows += [(None, 5, "7", "x", 1.0, ""), ("b", None, "7", "x", 1.0, "")]
    want = brute_runs(rows, 15, 2)
    df = spark.createDataFrame(rows, RUN)
    for block in (65536, 97, 11):
        got = collapse_runs(df, entity="clip", order="f", event=["player", "state"], time="t", block=block)
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_runs_time_missing_and_empty(spark):
    df = spark.createDataFrame([("a", 1, "7", "x", None, ""), ("a", 2, "7", "x", 2.0, "")], RUN)
    assert [tuple(r) for r in collapse_runs(df, entity="clip", order="f", event=["player", "state"], time="t").collect()] == [("a", "7", "x", 1, 2, 2, None)]
    assert collapse_runs(spark.createDataFrame([], RUN), entity="clip", order="f", event=["player", "state"]).count() == 0


TOP = "clip string, f int, id int, score double, rank string"


def test_top_n_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", None]), 0 if i % 3 == 0 else rng.randrange(400), i, rng.choice([None, float("nan"), float(rng.randrange(40))]), "clash") for i in range(6000)]
    rows += rows[:50]
    by = {}
    for r in rows:
        if r[3] is not None and r[3] == r[3]:
            by.setdefault(r[:2], []).append((-r[3], r[2]))
    want = sorted(((*g, i, -s) for g, v in by.items() for s, i in sorted(v)[:3]), key=str)
    df = spark.createDataFrame(rows, TOP).repartition(5)
    for bands in ((0.35, 0.7), (0.01,), ()):
        got = top_n(df, group=["clip", "f"], score="score", tie="id", n=3, bands=bands)
        assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == want


def test_top_n_hot_groups_versions_and_bands(spark):
    rng = random.Random(7)
    # one group holds a third of all rows, and one of its items a tenth
    rows = [("a", 0 if i % 3 == 0 else rng.randrange(300), 5 if i % 10 == 0 else rng.randrange(3000), rng.choice([None, float("nan"), float(rng.randrange(40))]), rng.choice(["1", "2", "3", None])) for i in range(9000)]
    rows += [(None, None, None, 3.0, "1"), (None, None, 7, 3.0, "1"), (None, None, 7, 2.0, None)]
    key = lambda r: (r[4] is not None, r[4] or "", r[3] is not None, r[3] != r[3] if r[3] is not None else False, r[3] if r[3] is not None and r[3] == r[3] else 0.0)
    last = {}
    for r in rows:
        if r[:3] not in last or key(r) > key(last[r[:3]]):
            last[r[:3]] = r
    by = {}
    for r in last.values():
        if r[3] is not None and r[3] == r[3]:
            by.setdefault(r[:2], []).append((-r[3], r[2] is not None, r[2] or 0, r[2]))
    want = sorted(((*g, i[3], -i[0], k + 1) for g, v in by.items() for k, i in enumerate(sorted(v)[:3])), key=str)
    df = spark.createDataFrame(rows, TOP).repartition(5)
    for hot, bands in ((10**9, None), (200, None), (200, (0.1, 0.5)), (200, ())):
        got = top_n(df, group=["clip", "f"], score="score", tie="id", n=3, version="rank", hot=hot, bands=bands)
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_top_n_empty_and_all_null(spark):
    assert top_n(spark.createDataFrame([], TOP), group=["clip"], score="score", tie="id", n=3).count() == 0
    assert top_n(spark.createDataFrame([("a", 1, 1, None, "")], TOP), group=["clip"], score="score", tie="id", n=3).count() == 0
