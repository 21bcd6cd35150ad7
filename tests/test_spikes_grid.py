"""Control charts and regular series."""

import math
import random

from touchline.operators.grid import regular_series
from touchline.operators.spikes import ChartSpec, flag_implausible

READ = "id long, clip string, f int, x double, y double, v double, reasons string"


def flags(spark, rows, **spec):
    df = spark.createDataFrame(rows, READ)
    out = flag_implausible(df, key="id", source="clip", tick="f", x="x", y="y", rate="v", spec=ChartSpec(**spec))
    return {r["id"]: set(r["reasons"]) for r in out.collect()}


def walk(n, seed=1, clip="a", start=0):
    rng = random.Random(seed)
    return [[start + i, clip, i, 500 + i * 0.7 + rng.gauss(0, 0.2), 400 + i * 0.2 + rng.gauss(0, 0.2), 20 + rng.gauss(0, 2), "q"] for i in range(n)]


def test_spikes_stuck_and_limits(spark):
    rows = walk(3000)
    rows[100][3] += 90  # one away
    for i in (500, 501, 502):
        rows[i][4] -= 80  # three away together
    for i in range(800, len(rows)):
        rows[i][3] += 150  # a jump that stays
    for i in range(1000, 1007):
        rows[i][3] = rows[1000][3]  # seven equal values
    for i in range(1200, 1204):
        rows[i][4] = rows[1200][4]  # four are too few
    rows[1500][3], rows[1600][5], rows[1700][5] = -9999.0, -1.0, 1e7
    rows[1800][5] = 900.0
    for i in range(1900, 1930):
        rows[i][5] = 900.0 + i  # fast but steady
    rows[2000][3], rows[2001][4], rows[2002][5] = None, float("nan"), None
    want = {100: "place_spike", 500: "place_spike", 501: "place_spike", 502: "place_spike", 1500: "place_limit", 1600: "rate_limit", 1700: "rate_limit", 1800: "rate_spike", **{i: "x_stuck" for i in range(1001, 1007)}}
    for block in (8192, 700):
        got = flags(spark, [tuple(r) for r in rows], block=block)
        assert {k: v for k, v in got.items()} == {k: {v} for k, v in want.items()}, block


def test_spikes_of_a_source_that_rests(spark):
    still = [[i, "a", i, 100.0, 100.0, 0.0, "q"] for i in range(100)]
    still[40][3], still[70][5] = 160.0, 500.0
    moves = [[1000 + i, "b", i, 100.0 + 5 * max(0, i - 70), 100.0, 10.0 if i > 70 else 0.0, "q"] for i in range(100)]
    moves[30][4], moves[85][4], moves[90][3] = 400.0, 130.0, 900.0
    moves[50][5], moves[88][5], moves[92][5] = 900.0, 120.0, 800.0
    got = flags(spark, [tuple(r) for r in still + moves])
    of = lambda reason: {k for k, v in got.items() if reason in v}
    assert of("place_spike") == {40, 1030, 1090} and of("rate_spike") == {70, 1050, 1092}


def test_gap_move_and_missing_ticks(spark):
    rows = walk(400)
    for i in range(200, 400):
        rows[i][2] += 1000
        rows[i][3] += 700
    rows.append([999_999_999_999_999_999, "a", None, -9999.0, 1.0, -5.0, ""])
    rows.append([10_001, None, 5, -9999.0, 1.0, -5.0, ""])
    assert flags(spark, [tuple(r) for r in rows]) == {}


def test_repeated_delivery_large_keys_and_empty(spark):
    rows = walk(300, start=2**60)
    rows[50][3] = 1e6
    twice = [tuple(r) for r in rows] * 2
    assert flags(spark, twice) == {2**60 + 50: {"place_limit"}}
    assert flags(spark, []) == {}
    assert flags(spark, [(1, "a", 1, None, None, None, "")]) == {}


def test_blocks_equal_one_pass(spark):
    rng = random.Random(9)
    rows, stuck = [], set()
    for clip, step in (("dense", 1), ("sparse", 250), ("bursts", 0)):
        f, still, held = 0, 0, None
        for i in range(1500):
            f += step or rng.choice([0, 1, 1, 2, 700])
            x, y, v = 500 + 40 * math.sin(i / 30) + rng.gauss(0, 1), 300 + rng.gauss(0, 1), abs(rng.gauss(20, 4))
            if rng.random() < 0.02 and not still:
                still, held = rng.choice([4, 5, 6, 7, 30, 140]), v
            if still:
                still -= 1
                v = held
            if rng.random() < 0.03:
                x += 300
            if rng.random() < 0.03:
                v *= rng.choice([14, 17, 60])
            rows.append((len(rows), clip, f, None if rng.random() < 0.05 else x, y, None if rng.random() < 0.1 else v, ""))
    rows += [(90_000, "one", 1, 5.0, 5.0, 5.0, "")]
    for clip in ("dense", "sparse", "bursts"):
        own = [r for r in rows if r[1] == clip and r[5] is not None]
        own.sort(key=lambda r: (r[2], r[0]))
        at = 0
        while at < len(own):
            to = at
            while to < len(own) and own[to][5] == own[at][5]:
                to += 1
            if to - at >= 6:
                stuck |= {r[0] for r in own[at + 1 : to]}
            at = to
    whole = flags(spark, rows, block=10**6)
    assert {k for k, v in whole.items() if "rate_stuck" in v} == stuck and len(stuck) > 300
    assert sum("place_spike" in v for v in whole.values()) > 50 and sum("rate_spike" in v for v in whole.values()) > 20
    for block in (64, 512, 700):
        assert flags(spark, rows, block=block) == whole, block


def test_rates_runs_and_ends(spark):
    rows = walk(600)
    for i, times in ((100, 14), (200, 17), (599, 500), (0, 500)):
        rows[i][5] = 20.0 * times
    for i in (300, 301, 302, 400, 401, 402, 403):
        rows[i][5] = 10_000.0 + i
    got = flags(spark, [tuple(r) for r in rows])
    # more than fifteen times the usual, three together at most, and a reading in control on either side
    assert got == {i: {"rate_spike"} for i in (200, 300, 301, 302)}


SER = "clip string, f int, x double, y double, fill string"


def series(spark, rows, **kw):
    df = spark.createDataFrame(rows, SER)
    out = regular_series(df, source="clip", tick="f", values=["x", "y"], step=10, max_gap=50, **kw)
    return sorted(tuple(r) for r in out.drop("n_periods").collect())


def brute(rows):
    from collections import defaultdict

    ticks = defaultdict(lambda: defaultdict(list))
    for c, f, x, y, _ in rows:
        if None not in (c, f, x, y) and not math.isnan(x) and not math.isnan(y):
            ticks[c][f].append((x, y))
    out = []
    for c, by in ticks.items():
        pts = sorted((f, sum(p[0] for p in v) / len(v), sum(p[1] for p in v) / len(v)) for f, v in by.items())
        for p in range(pts[0][0] // 10, pts[-1][0] // 10 + 1):
            own = [q for q in pts if q[0] // 10 == p]
            if own:
                out.append((c, p * 10, len(own), sum(q[1] for q in own) / len(own), sum(q[2] for q in own) / len(own), "observed"))
                continue
            a, b, m = max(q for q in pts if q[0] < p * 10), min(q for q in pts if q[0] > p * 10), p * 10 + 4.5
            w = (m - a[0]) / (b[0] - a[0])
            if b[0] - a[0] > 50:
                out.append((c, p * 10, 0, None, None, "missing"))
            else:
                out.append((c, p * 10, 0, a[1] * (1 - w) + b[1] * w, a[2] * (1 - w) + b[2] * w, "interpolated"))
    return sorted(out)


def test_series_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for c in ("a", "b"):
        f = -35
        for _ in range(120):
            f += rng.choice([1, 2, 7, 25, 45, 130, 900])
            rows.append((c, f, rng.random() * 100, rng.random() * 100, "z"))
    rows += [rows[3], ("a", None, 1.0, 1.0, ""), (None, 3, 1.0, 1.0, ""), ("a", 100_000, float("nan"), 1.0, ""), ("b", 100_000, None, 1.0, "")]
    want = brute(rows)
    for chunk in (4096, 8, 3):
        got = series(spark, rows, chunk=chunk)
        assert len(got) == len(want)
        for g, w in zip(got, want):
            assert g[:3] == w[:3] and g[5] == w[5]
            assert all((a is None and b is None) or abs(a - b) < 1e-9 for a, b in zip(g[3:5], w[3:5]))


def test_series_with_a_wrong_tick_far_out(spark):
    rows = [("a", f, 1.0, float(f), "") for f in (3, 17, 41, 10_000_005, 10_000_031)]
    df = spark.createDataFrame(rows, SER)
    for longest in (40, 1000):
        out = regular_series(df, source="clip", tick="f", values=["x", "y"], step=10, max_gap=50, chunk=8, longest=longest)
        got = sorted((r["period_start"], r["n_periods"], r["n_readings"], r["fill"]) for r in out.collect())
        assert got == [
            (0, 1, 1, "observed"), (10, 1, 1, "observed"), (20, 1, 0, "interpolated"), (30, 1, 0, "interpolated"), (40, 1, 1, "observed"), (50, 999_995, 0, "missing"),
            (10_000_000, 1, 1, "observed"), (10_000_010, 1, 0, "interpolated"), (10_000_020, 1, 0, "interpolated"), (10_000_030, 1, 1, "observed"),
        ]


def test_series_empty(spark):
    assert series(spark, []) == []
