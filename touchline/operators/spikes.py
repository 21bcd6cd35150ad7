"""Implausible readings: spikes, stuck values and impossible values, judged per source.

Robust exponentially weighted control charts with run-length counters and physical limits.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.ids import finite
from touchline.operators.sequence import BLOCK
from touchline.session import materialise


@dataclass(frozen=True)
class ChartSpec:
    """Parameters of the charts.

    ``suspect`` and ``confirm`` are multiples of the source's usual motion (median distance of one
    reading from the one before); the trend is carried on for ``trend_ticks`` at most. The limit of the rates' chart lies ``rate_scales`` scales
    above its mean, between ``rate_suspect`` and ``rate_factor`` median rates; a reading above ``rate_factor`` medians is confirmed. At most ``max_away``
    readings may be away together. ``min_stuck`` equal readings make a stuck stretch. A chart
    starts anew after ``max_gap`` ticks or ``max_missing`` readings without a value.

    A source is cut into blocks of ``block`` readings. Charts run in from ``run_in`` readings before a block, by which time mean, scale and
    trend have forgotten where they began, and look ``ahead`` readings past it.

    A source that rests for more than half of its readings has a median of 0; its usual motion and rate are then the medians of those
    above 0 if at least the share ``moving`` is, else ``least_usual``: spikes alone don't make what is usual.
    """

    suspect: float = 8.0
    confirm: float = 12.0
    rate_scales: float = 4.0
    rate_suspect: float = 3.0
    rate_factor: float = 15.0
    max_away: int = 3
    min_stuck: int = 6
    max_gap: int = 600
    max_missing: int = 48
    weight: float = 0.2
    trend_ticks: int = 15
    block: int = 8192
    run_in: int = 256
    ahead: int = 32
    place_min: float = -5000.0
    place_max: float = 20000.0
    rate_min: float = 0.0
    rate_max: float = 100000.0
    moving: float = 0.1
    least_usual: float = 1.0
    accuracy: int = field(default=10000)


def chart(number: np.ndarray, tick: np.ndarray, u: np.ndarray, w: np.ndarray, usual: float, pace: float, spec: ChartSpec) -> np.ndarray:
    """Flags the readings of one source that left the chart and came back. ``usual`` is its motion from one reading to the next, ``pace`` that per tick,
    ``number`` counts all its readings, also those without a place.

    Trend and scale of the motion are exponentially weighted. A suspected reading is clipped before they
    are updated: its deviation counts as one and a half scales, its motion as the trend itself. A run of suspects ends
    with a reading in control, or after ``max_away`` with none; then it is checked exactly which of its
    first readings, if any, are away from both neighbours while these agree. If none are, the level has moved: the chart starts anew
    with the run's first reading, and the others are judged again.
    """
    n = len(tick)
    flags = np.zeros(n, dtype=bool)
    if n == 0 or not usual > 0:
        return flags
    N, T, U, V = number.tolist(), tick.tolist(), u.tolist(), w.tolist()
    a, limit, least = spec.weight, spec.suspect * usual, spec.confirm * usual

    def apart(i: int, j: int) -> float:
        return ((U[i] - U[j]) ** 2 + (V[i] - V[j]) ** 2) ** 0.5

    def away(b: int, c: int) -> bool:
        """Whether all between ``b`` and ``c`` are far from both: farther than usual and than three times what these are apart, and at least on one side farther than a move through the gap there."""
        least_here = max(least, 3 * apart(b, c))
        for k in range(b + 1, c):
            before, after = apart(k, b), apart(k, c)
            if min(before, after) <= least_here or (before <= 2 * pace * (T[k] - T[b]) and after <= 2 * pace * (T[c] - T[k])):
                return False
        return True

    last, vu, vw, scale = 0, 0.0, 0.0, usual
    i = 1
    while i < n:
        dt = T[i] - T[last]
        if T[i] - T[i - 1] > spec.max_gap or N[i] - N[i - 1] > spec.max_missing:
            last, vu, vw, scale = i, 0.0, 0.0, usual
            i += 1
            continue
        du, dw, ahead = U[i] - U[last], V[i] - V[last], min(dt, spec.trend_ticks)
        ru, rw = du - vu * ahead, dw - vw * ahead
        off, step = (ru * ru + rw * rw) ** 0.5, (du * du + dw * dw) ** 0.5
        suspect = off > max(limit, 4 * scale) and step > limit
        if suspect and i - last <= spec.max_away:
            scale += a * (min(off, 1.5 * scale) - scale)
            i += 1
            continue
        if suspect or i - last > 1:
            back = next((c for c in range(last + 2, i + 1) if away(last, c)), None)
            if back is not None:
                flags[last + 1 : back] = True
                # the reading that came back is the chart's new last; what follows is judged from there
                last, scale = back, max(scale, usual)
                i = back + 1
                continue
            if suspect:
                last, vu, vw, scale = last + 1, 0.0, 0.0, usual
                i = last + 1
                continue
        dt = max(dt, 1)
        scale += a * (min(off, 3 * scale) - scale)
        vu += a * (du / dt - vu)
        vw += a * (dw / dt - vw)
        last = i
        i += 1
    return flags


def rate_chart(number: np.ndarray, s: np.ndarray, usual: float, spec: ChartSpec) -> np.ndarray:
    """One-sided chart of the rates of one source: flags those that rose above it and came back.

    Mean and scale are exponentially weighted; a suspected rate counts as the limit it exceeds. A
    run-length counter follows the suspects: after more than ``max_away`` the level has moved and the chart starts anew there. A shorter run that
    comes back holds the cases: its readings above ``rate_factor`` usual rates. The chart's limit never
    exceeds that, so none is passed over. At either end of the readings, or beside a stretch of ``max_missing`` without a rate, a run has one side
    only and is no case.
    """
    n = len(s)
    flags = np.zeros(n, dtype=bool)
    if n == 0 or not usual > 0:
        return flags
    N, S = number.tolist(), s.tolist()
    a, low, top = spec.weight, spec.rate_suspect * usual, spec.rate_factor * usual
    mean, scale, run = usual, usual, 0
    above = np.zeros(n, dtype=bool)
    for i in range(n):
        if i and N[i] - N[i - 1] > spec.max_missing:
            mean, scale, run = usual, usual, 0
        x = S[i]
        limit = min(max(mean + spec.rate_scales * scale, low), top)
        if x > limit:
            run += 1
            above[i] = True
            if run > spec.max_away:
                mean, scale, run = min(x, top), usual, 0
                continue
            x = limit
        else:
            run = 0
        off = x - mean
        scale += a * (abs(off) - scale)
        mean += a * off
    edge = np.diff(np.r_[False, above & (s > top), False].astype(np.int8))
    apart = np.r_[True, np.diff(number) > spec.max_missing, True]
    for i, j in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        if j - i <= spec.max_away and not apart[i : j + 1].any():
            flags[i:j] = True
    return flags


def stuck(values: np.ndarray, least: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Run-length counter: all but the first of each stretch of at least ``least`` equal values; and the positions of the first
    and the last stretch (one, if they are the same), which may be part of longer ones beyond."""
    n = len(values)
    if n == 0:
        return np.zeros(0, dtype=bool), []
    new = np.r_[True, values[1:] != values[:-1]]
    run = np.cumsum(new) - 1
    ends = [np.flatnonzero(run == r) for r in sorted({0, int(run[-1])})]
    return (np.bincount(run)[run] >= least) & ~new, ends


def judge(pdf: pd.DataFrame, usual: float, pace: float, rate: float, spec: ChartSpec) -> pd.DataFrame:
    """Limits and charts of one block's sorted readings; nulls are never a case and are passed over."""
    number, tick, x, y, s = (pdf[c].to_numpy(dtype=float) for c in ("n", "tick", "x", "y", "rate"))
    reasons = {k: np.zeros(len(pdf), dtype=bool) for k in ("place_limit", "rate_limit", "place_spike", "rate_spike")}
    with np.errstate(invalid="ignore"):
        bad_place = (x < spec.place_min) | (x > spec.place_max) | (y < spec.place_min) | (y > spec.place_max)
        bad_rate = (s < spec.rate_min) | (s > spec.rate_max)
    reasons["place_limit"], reasons["rate_limit"] = bad_place, bad_rate
    at = np.flatnonzero(~np.isnan(x) & ~np.isnan(y) & ~bad_place)
    reasons["place_spike"][at[chart(number[at], tick[at], x[at], y[at], usual, pace, spec)]] = True
    at = np.flatnonzero(~np.isnan(s) & ~bad_rate)
    reasons["rate_spike"][at[rate_chart(number[at], s[at], rate, spec)]] = True
    return pd.DataFrame(reasons)


def _number(x) -> float:  # noqa: ANN001
    return 0.0 if pd.isna(x) else float(x)


def flag_implausible(
    df: DataFrame, *, key: str, source: str, tick: str, x: str, y: str, rate: str, spec: ChartSpec = ChartSpec()
) -> DataFrame:
    """Readings of ``df`` that cannot be real, as ``key`` and an array of ``reasons``.

    Null or NaN values are no case, neither are rows without tick or source. Rows of one key
    are one reading (the greatest row counts). Equal ticks are ordered by key. Empty input gives
    no rows; extra columns are ignored. Up to ``max_away`` readings may be away together, with
    neighbours that agree on both sides: a longer run is a new level, and the first and last reading of a source lie between none.

    A source's readings are numbered and cut into blocks of ``spec.block`` readings, so one of any size or
    density is spread over many tasks. Charts run in before a block; stretches of equal values that
    reach a block's border are counted on over the blocks, so the size of blocks changes nothing. What
    a source usually does comes from mergeable quantile summaries.
    """
    raw = df.filter(F.col(tick).isNotNull() & F.col(source).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("k"), F.col(source).alias("src"), F.col(tick).cast("long").alias("tick"),
        finite(F.col(x).cast("double")).alias("x"), finite(F.col(y).cast("double")).alias("y"), finite(F.col(rate).cast("double")).alias("rate"),
    )
    one = materialise(raw.groupBy("k").agg(F.max(F.struct("src", "tick", "x", "y", "rate")).alias("r")).select("k", "r.*"), "readings")

    sane = F.col("x").between(spec.place_min, spec.place_max) & F.col("y").between(spec.place_min, spec.place_max)
    # the places of the last reading that has one, block of ticks by block of ticks: what crosses a border doesn't matter for a median
    ticks = one.withColumns({"tb": F.floor(F.col("tick") / BLOCK), "at": F.when(sane, F.struct("x", "y", "tick"))})
    order = Window.partitionBy("src", "tb").orderBy("tick", "k")
    last = F.last("at", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = ticks.groupBy("src", "tb").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("src").orderBy("tb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = ticks.withColumns({"_in": F.row_number().over(order), "_last": F.when(sane, last)}).join(first.select("src", "tb", before.alias("_before")), ["src", "tb"])
    numbered = materialise(numbered.select(
        "k", "src", "tick", "x", "y", "rate", (F.col("_in") - 1 + F.col("_before")).alias("n"),
        F.hypot(F.col("x") - F.col("_last.x"), F.col("y") - F.col("_last.y")).alias("step"), (F.col("tick") - F.col("_last.tick")).alias("dt"),
    ), "numbered")

    def typical(c: Column) -> Column:
        middle, above = (F.percentile_approx(v, 0.5, spec.accuracy) for v in (c, F.when(c > 0, c)))
        return F.when(middle > 0, middle).when(F.count_if(c > 0) >= spec.moving * F.count(c), above).otherwise(spec.least_usual)

    usual = numbered.groupBy("src").agg(
        typical(F.col("step")).alias("usual"), typical(F.try_divide("step", "dt")).alias("pace"),
        typical(F.when(F.col("rate").between(spec.rate_min, spec.rate_max), F.col("rate"))).alias("usual_rate"), F.max("n").alias("most"), F.min("k").alias("k"),
    )
    # one row a block carries what is usual for its source, so the readings themselves need no join
    blk = lambda n: F.floor(n / spec.block)
    header = usual.select(
        "src", F.explode(F.sequence(F.lit(0).cast("long"), blk(F.col("most")))).alias("blk"), F.lit(-1).alias("own"), F.lit(-1).cast("long").alias("n"), F.lit(0).cast("long").alias("tick"), "k",
        F.col("usual").alias("x"), F.col("pace").alias("y"), F.col("usual_rate").alias("rate"),
    )
    seen_by = F.sequence(F.greatest(blk(F.col("n") - spec.ahead), F.lit(0)), blk(F.col("n") + spec.run_in))
    spread = numbered.withColumn("blk", F.explode(seen_by)).select("src", "blk", (F.col("blk") == blk(F.col("n"))).cast("int").alias("own"), "n", "tick", "k", "x", "y", "rate")
    kind, src = one.schema["k"].dataType.simpleString(), one.schema["src"].dataType.simpleString()

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf["own"].to_numpy() == -1
        empty = {c: pd.Series([], dtype=object) for c in ("k", "reasons", "src", "blk", "col", "piece", "v", "size", "keys")}
        if not head.any() or not (pdf["own"].to_numpy() == 1).any():
            return pd.DataFrame(empty)
        top, rows = pdf[head].iloc[0], pdf[~head].sort_values("n", kind="stable").reset_index(drop=True)
        told = judge(rows, _number(top["x"]), _number(top["y"]), _number(top["rate"]), spec)
        mine = rows["own"].to_numpy() == 1
        rows, told = rows[mine].reset_index(drop=True), told[mine].reset_index(drop=True)
        keys, edges = rows["k"].to_numpy(), []
        for name, c in (("x_stuck", "x"), ("y_stuck", "y"), ("rate_stuck", "rate")):
            values = rows[c].to_numpy(dtype=float)
            at = np.flatnonzero(~np.isnan(values))
            flags, ends = stuck(values[at], spec.min_stuck)
            told[name] = False
            told.loc[at[flags], name] = True
            # of a stretch that is long enough by itself only the first reading is open
            edges += [(name, p, values[at[e[0]]], len(e), keys[at[e[: spec.min_stuck - 1 if len(e) < spec.min_stuck else 1]]].tolist()) for p, e in enumerate(ends)]
        table, names = told.to_numpy(dtype=bool), told.columns.to_numpy()
        hit = np.flatnonzero(table.any(axis=1))
        cases = pd.DataFrame({"k": keys[hit], "reasons": pd.Series([names[r].tolist() for r in table[hit]], dtype=object)})
        open_ = pd.DataFrame(edges, columns=["col", "piece", "v", "size", "keys"]).assign(src=top["src"], blk=top["blk"])
        return pd.concat([cases.astype(object), open_.astype(object)], ignore_index=True).reindex(columns=list(empty)).astype(object).where(lambda d: d.notna(), None)

    schema = f"k {kind}, reasons array<string>, src {src}, blk long, col string, piece int, v double, size long, keys array<{kind}>"
    told = materialise(header.unionByName(spread).groupBy("src", "blk").applyInPandas(block, schema), "judged")
    cases = told.filter("col is null").select("k", F.explode("reasons").alias("reason"))
    return cases.unionByName(_stitched(told.filter("col is not null"), spec.min_stuck)).groupBy(F.col("k").alias(key)).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def _stitched(edges: DataFrame, least: int) -> DataFrame:
    """Readings of stretches that go on over borders: ``edges`` has each block's first and last stretch (piece 0 and 1)."""
    w = Window.partitionBy("src", "col").orderBy("blk", "piece")
    goes_on = F.coalesce((F.lag("blk").over(w) != F.col("blk")) & (F.lag("v").over(w) == F.col("v")), F.lit(False))
    edges = edges.withColumn("new", (~goes_on).cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = edges.withColumn("total", F.sum("size").over(Window.partitionBy("src", "col", "run"))).filter(F.col("total") >= least)
    found = whole.select("col", "new", F.posexplode("keys").alias("pos", "k")).filter("new = 0 or pos > 0")
    return found.select("k", F.col("col").alias("reason"))
