"""Sequential automata: trackers, smoothers and possession chains.

Each automaton reads one sequence in order and holds only its own state. ``stream_groups`` feeds it row by row
from sorted partitions, so a long sequence is never held in memory as a whole.
"""

from __future__ import annotations

import copy
import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.motion import islands
from touchline.operators.sequence import neighbours, running, running_count
from touchline.session import materialise, parallelism


def stream_groups(df: DataFrame, machine: Callable[[], Callable[[dict], list[tuple]]], *, by: list[str], order: list, schema: str, finish: bool = False) -> DataFrame:
    """Runs a fresh ``machine()`` over each group's rows in order. A machine maps a row to output rows; if ``finish``, it is
    called once more with None at the group's end."""
    columns = [x.split()[0].strip("`") for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, step = None, None
        for pdf in batches:
            out: list[tuple] = []
            names, lists = list(pdf.columns), [pdf[c].tolist() for c in pdf.columns]
            for k, values in zip(zip(*[pdf[b].tolist() for b in by]), zip(*lists)):
                row = dict(zip(names, values))
                if k != key:
                    if step is not None and finish:
                        out += step(None)
                    key, step = k, machine()
                out += step(row)
            yield pd.DataFrame(out, columns=columns, dtype=object)  # keeps large ids beside nulls
        if step is not None and finish:
            yield pd.DataFrame(step(None), columns=columns, dtype=object)

    return df.repartition(parallelism(df.sparkSession), *by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def missing(v) -> bool:  # noqa: ANN001
    return v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NaT


@dataclass(frozen=True)
class ChainSpec:
    """``confirm`` rows of evidence start or change a possession; it is carried ``carry_s`` seconds through transit (negative: for ever)."""

    confirm: int = 5
    max_distance: float = 80.0
    carry_s: float = 2.0
    start_speed: float | None = None
    start_distance: float | None = None
    instant_repaired: bool = False


class PossessionChain:
    """Hysteresis automaton over association rows (frame, time, player, distance, speed, state, excluded, repaired)."""

    def __init__(self, spec: ChainSpec):
        self.spec, self.owner, self.begun, self.count = spec, None, None, 0
        self.candidate, self.seen, self.carried, self.carried_from = None, 0, 0, None
        self.last = None

    def close(self, row: dict, reason: str) -> tuple:
        t0, f0 = self.begun
        done = (self.count, self.owner, t0, row["time"], max(0.0, row["time"] - t0), f0, row["frame"], reason)
        self.owner = self.begun = None
        return done

    def blocked(self, row: dict) -> bool:
        if self.owner is not None:
            return False
        over = lambda limit, v: limit is not None and not missing(v) and v > limit
        return over(self.spec.start_speed, row["speed"]) or over(self.spec.start_distance, row["distance"])

    def step(self, row: dict) -> tuple[dict, tuple | None]:
        """What holds at this row, and the segment it closes, if any."""
        self.last, done, why = row, None, ""
        state = "in_transit" if row["state"] == "controlled" and row["excluded"] else row["state"]
        player, near = row["player"], not missing(row["distance"]) and row["distance"] <= self.spec.max_distance
        told = state
        if state == "controlled" and player is not None and near:
            self.carried, self.carried_from = 0, None
            if player == self.owner:
                self.candidate, self.seen, told = None, 0, "controlled"
            else:
                self.seen = self.seen + 1 if player == self.candidate else 1
                self.candidate = player
                if self.seen < (1 if self.spec.instant_repaired and row["repaired"] else self.spec.confirm):
                    told, why = ("pending_control", "") if self.owner is None else ("in_transit", "candidate_controller_not_confirmed")
                elif self.blocked(row):
                    told, why = "pending_control", "new_possession_start_not_stable"
                else:
                    why, told = "confirmed_new_controller", "controlled"
                    if self.owner is not None:
                        done = self.close(row, why)
                    self.count, self.owner, self.begun = self.count + 1, player, (row["time"], row["frame"])
                    self.candidate, self.seen = None, 0
        else:
            self.candidate, self.seen = None, 0
            if self.owner is None:
                self.carried, self.carried_from = 0, None
            elif state in ("in_transit", "loose_or_unclear"):
                self.carried += 1
                self.carried_from = row["time"] if self.carried_from is None else self.carried_from
                if 0 <= self.spec.carry_s < row["time"] - self.carried_from:
                    why = "carry_forward_timeout"
                    done = self.close(row, why)
                    self.carried, self.carried_from = 0, None
        now = {"state": told, "owner": None if told == "pending_control" else self.owner, "segment": self.count if self.owner is not None else None, "pending": self.candidate, "seen": self.seen, "carried": self.carried, "carried_seconds": None if self.carried_from is None else row["time"] - self.carried_from, "why": why}
        return now, done


#: States whose frames a summary counts.
CHAIN_STATES = ("controlled", "in_transit", "loose_or_unclear", "pending_control")
_STATE_AT = {s: i for i, s in enumerate(CHAIN_STATES)}
_CHAIN_INPUT = ["frame", "time", "player", "distance", "speed", "state", "excluded", "repaired"]


def _chain_parts(df: DataFrame, by: list[str], spec: ChainSpec, tie: list[str]) -> DataFrame:
    """Adds ``_part``: a sequence is cut where the chain surely holds nothing, that is, where evidence follows a stretch in transit or loose that
    is longer than a possession is carried. Frames with equal order are put in the order of ``tie``."""
    rows = df.select(*by, *_CHAIN_INPUT, *tie)
    evidence = (F.col("state") == "controlled") & ~F.coalesce("excluded", F.lit(False)) & F.col("player").isNotNull() & (F.col("distance") <= spec.max_distance)
    state = F.when((F.col("state") == "controlled") & F.col("excluded"), "in_transit").otherwise(F.col("state"))
    quiet = F.coalesce(~F.coalesce(evidence, F.lit(False)) & state.isin("in_transit", "loose_or_unclear"), F.lit(False))
    # a run is a row that isn't quiet (but for one at the very beginning) and the quiet ones after it
    return _cut_parts(rows, by, spec, tie, quiet, ~F.col("_quiet"))


def _cut_parts(rows: DataFrame, by: list[str], spec: ChainSpec, tie: list[str], quiet: Column, starts: Column) -> DataFrame:
    """Adds ``_part``: rows with ``starts`` begin runs, and a run whose ``quiet`` rows last longer than a possession is carried ends a part."""
    if spec.carry_s < 0:
        return rows.withColumn("_part", F.lit(0).cast("long"))
    rows = materialise(running_count(rows.withColumn("_quiet", quiet), by=by, order="frame", flag=starts, name="_run", tie=tie), "chain")
    runs = rows.groupBy(*by, "_run").agg((F.max(F.when(F.col("_quiet"), F.col("time"))) - F.min(F.when(F.col("_quiet"), F.col("time"))) > spec.carry_s).alias("_dead"))
    over = Window.partitionBy(*by, "_step").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    # dead runs are counted in blocks of runs, then over the blocks
    runs = runs.withColumns({"_step": F.floor(F.col("_run") / 65536), "_d": F.coalesce(F.col("_dead").cast("int"), F.lit(0))})
    steps = runs.groupBy(*by, "_step").agg(F.sum("_d").alias("_n"))
    steps = steps.select(*by, "_step", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    runs = runs.withColumn("_in", F.coalesce(F.sum("_d").over(over), F.lit(0))).join(steps, [*by, "_step"]).select(*by, "_run", (F.col("_in") + F.col("_before")).alias("_part"))
    return rows.join(runs, [*by, "_run"]).drop("_quiet", "_run")


def _chain(df: DataFrame, *, by: list[str], spec: ChainSpec, tie: list[str], closes: bool) -> tuple[DataFrame, DataFrame]:
    """The chain's rows (or, if ``closes``, its segments) with ``_part`` and segments numbered in it, and the offsets of the parts' numbers."""
    kinds = ", ".join(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by)

    def machine():  # noqa: ANN202
        chain, key = PossessionChain(spec), []

        def step(row: dict | None) -> list[tuple]:
            if row is None:
                return [(*key[0], *chain.close(chain.last, "end_of_input"))] if closes and chain.owner is not None else []
            key[:] = [[*(row[b] for b in by), row["_part"]]]
            row["player"] = None if missing(row["player"]) else row["player"]
            now, done = chain.step(row)
            if closes:
                return [(*key[0], *done)] if done else []
            return [(*key[0], row["frame"], *now.values(), chain.count)]

        return step

    if closes:
        schema = f"{kinds}, _part long, segment int, player_id string, start_time double, end_time double, duration_seconds double, start_frame int, end_frame int, end_reason string"
    else:
        schema = f"{kinds}, _part long, frame int, possession_state string, possession_player string, segment int, pending_player string, pending_rows int, carried_rows int, carried_seconds double, transition_reason string, _count int"
    out = materialise(stream_groups(_chain_parts(df, by, spec, tie), machine, by=[*by, "_part"], order=["frame", *tie], schema=schema, finish=True), "chained")
    many = out.groupBy(*by, "_part").agg(F.max("segment" if closes else "_count").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out, many.select(*by, "_part", before.cast("int").alias("_before"))


def possession_frames(df: DataFrame, *, by: list[str], spec: ChainSpec = ChainSpec(), tie: list[str] = ()) -> DataFrame:
    """Possession state, owner and segment of every row. ``df`` has frame, time, player (null: none), distance, speed, state, excluded and repaired (booleans)."""
    out, before = _chain(df, by=by, spec=spec, tie=list(tie), closes=False)
    return out.join(before, [*by, "_part"]).withColumn("segment", F.col("segment") + F.col("_before")).drop("_part", "_before", "_count")


def possession_segments(df: DataFrame, *, by: list[str], spec: ChainSpec = ChainSpec(), tie: list[str] = ()) -> DataFrame:
    """Confirmed possessions of every sequence, with their ends and why they ended."""
    out, before = _chain(df, by=by, spec=spec, tie=list(tie), closes=True)
    return out.join(before, [*by, "_part"]).withColumn("segment", F.col("segment") + F.col("_before")).drop("_part", "_before")


def chain_summary(frames: DataFrame, segments: DataFrame, *, by: list[str]) -> DataFrame:
    """Per sequence: frames by possession state, number of segments, their total and (exact) median duration; 0 where there is none."""
    out = frames.groupBy(*by).agg(*[F.count_if(F.col("possession_state") == s).alias(f"{s}_frames") for s in CHAIN_STATES])
    parts = segments.groupBy(*by).agg(F.count(F.lit(1)).alias("segments"), F.sum("duration_seconds").alias("total_seconds"), F.median("duration_seconds").alias("median_seconds"))
    return out.join(parts, by, "left").fillna({"segments": 0, "total_seconds": 0.0, "median_seconds": 0.0})


class ChainSweep:
    """The chains of ``many`` settings over one sequence. Settings whose chains hold the same share one, which is copied where their rows differ."""

    def __init__(self, spec: ChainSpec, many: int):
        self.groups: list[list] = [[PossessionChain(spec), list(range(many)), None, [0] * len(CHAIN_STATES)]]  # chain, settings, last row's place, frames by state
        self.frames = [[0] * len(CHAIN_STATES) for _ in range(many)]

    def settle(self, group: list) -> None:
        if any(group[3]):
            for s in group[1]:
                self.frames[s] = [a + b for a, b in zip(self.frames[s], group[3])]
            group[3] = [0] * len(CHAIN_STATES)

    def split(self, filled: str) -> None:
        for group in list(self.groups):
            inside = [s for s in group[1] if filled[s] == "1"]
            if inside and len(inside) < len(group[1]):
                self.settle(group)
                self.groups.append([copy.copy(group[0]), inside, group[2], [0] * len(CHAIN_STATES)])
                group[1] = [s for s in group[1] if filled[s] != "1"]

    def merge(self) -> None:
        held: dict[tuple, list] = {}
        for group in self.groups:
            c = group[0]
            first = held.setdefault((c.owner, c.begun, c.candidate, c.seen, c.carried_from, group[2]), group)
            if first is not group:
                self.settle(first), self.settle(group)
                first[1] = first[1] + group[1]
        self.groups = list(held.values())

    def step(self, row: dict) -> list[tuple[list[int], float]]:
        """The settings and durations of the segments that this row closes."""
        if row["end"]:
            return [(g[1], g[0].close(row, "end_of_input")[4]) for g in self.groups if g[0].owner is not None]
        filled, out = row["filled"], []
        if filled is not None:
            self.split(filled)
        for group in self.groups:
            inside = filled is not None and filled[group[1][0]] == "1"
            state = row["filled_state"] if inside else row["state"]
            if state is None:  # a made row that these settings don't have
                continue
            chain = group[0]
            if group[2] != (row["frame"] - 1 if inside else row["back"], row["back_id"]):  # rows without players in between
                chain.candidate, chain.seen = None, 0
            now, done = chain.step(row | {"state": state, "speed": row["filled_speed"] if inside else row["speed"]})
            group[2] = (row["frame"], row["id"])
            if (at := _STATE_AT.get(now["state"])) is not None:
                group[3][at] += 1
            if done:
                out.append((group[1], done[4]))
        if len(self.groups) > 1 and row["state"] is not None:
            self.merge()
        return out


def sweep_summary(df: DataFrame, many: int, *, by: list[str], spec: ChainSpec) -> DataFrame:
    """What ``chain_summary`` tells, for each of ``many`` settings (``setting``, from 0) whose paths differ in the gaps they fill, in one pass over the rows of all of them.

    ``df`` has the path's rows that meet a player: frame, time, player, distance, id (order within a frame), and

    * ``filled``: of a made row, or one after a gap that some setting fills, "1" for each setting that fills it and "0" for the others; else null,
    * ``state`` and ``speed`` where the gap isn't filled (null for made rows), ``filled_state`` and ``filled_speed`` where it is,
    * ``back`` and ``back_id``: the row before, ``back`` where the gap isn't filled (else it is the frame before). Where it has met no player, it is an unknown row.

    One more row a sequence, with ``end``, has its last frame and time. Sequences without segments in a setting have sums of null.
    """
    near = F.col("player").isNotNull() & (F.col("distance") <= spec.max_distance)
    evidence = F.coalesce(near & ((F.col("state") == "controlled") | (F.col("filled_state") == "controlled")), F.lit(False))
    still = lambda c: F.col(c).isin("in_transit", "loose_or_unclear")
    # a possession is carried over unknown rows, too, so only evidence in some setting begins a run; rows that were read are in every setting's path
    quiet = F.coalesce(~evidence & still("state") & (F.col("filled").isNull() | still("filled_state")), F.lit(False))
    parts = _cut_parts(df, by, spec, ["end", "id"], quiet, evidence)
    keys = [*by, "_part"]
    names = [f"{s}_frames" for s in CHAIN_STATES]
    kinds = ", ".join(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sweep = None, None

        def ended() -> list[tuple]:
            if sweep is None:
                return []
            for group in sweep.groups:
                sweep.settle(group)
            return [(*key[:-1], [s], *n, None) for s, n in enumerate(sweep.frames) if any(n)]

        def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), schema.types)], schema=schema)

        schema = None
        for b in batches:
            schema = schema or pa.schema([*(b.schema.field(x) for x in by), ("settings", pa.list_(pa.int32())), *((n, pa.int64()) for n in names), ("duration", pa.float64())])
            out, columns = [], b.to_pydict()
            for values in zip(*columns.values()):
                row = dict(zip(columns, values))
                k = tuple(row[x] for x in keys)
                if k != key:
                    out += ended()
                    key, sweep = k, ChainSweep(spec, many)
                out += [(*k[:-1], settings, *[None] * len(names), seconds) for settings, seconds in sweep.step(row)]
            if out:
                yield batch(out, schema)
        if schema and (out := ended()):
            yield batch(out, schema)

    read = parts.select(*keys, "frame", "time", "player", "distance", "speed", "state", "filled", "filled_state", "filled_speed", "back", "back_id", "id", "end", F.lit(False).alias("excluded"), F.lit(False).alias("repaired"))
    placed = read.repartition(parallelism(df.sparkSession), *keys).sortWithinPartitions(*keys, "frame", "end", "id")
    told = placed.mapInArrow(run, f"{kinds}, settings array<int>, {', '.join(f'{n} long' for n in names)}, duration double")
    each = told.withColumn("setting", F.explode("settings")).groupBy(*by, "setting")
    return each.agg(*[F.sum(n).alias(n) for n in names], F.count("duration").alias("segments"), F.sum("duration").alias("total_seconds"), F.median("duration").alias("median_seconds"))


@dataclass(frozen=True)
class BallTrackSpec:
    restart: float = 0.45
    jump: float = 400.0
    sure: float = 0.70
    reset_gap: int = 30
    least_score: float = 150.0
    still_px: float = 15.0
    still_rows: int = 12
    confidence: float = 900.0
    predicted: float = 1.6
    last: float = 0.7
    size: float = 4.0
    conservative: bool = True


#: The older picker: always restarts with the most confident candidate and accepts any score.
LEGACY = BallTrackSpec(restart=0.0, jump=260.0, sure=0.65, reset_gap=25, least_score=-math.inf, predicted=1.4, last=0.5, still_rows=2**31, conservative=False)


class BallTracker:
    """Constant-velocity path picker over the candidates of each frame."""

    def __init__(self, spec: BallTrackSpec):
        self.spec, self.last, self.before, self.still = spec, None, None, 0

    def pick(self, frame: int, cands: list[dict]) -> dict | None:
        s = self.spec
        lead = max(cands, key=lambda r: (r["confidence"], -r["row"]))
        if self.last is not None and frame - self.last["frame"] > s.reset_gap:
            self.last = self.before = None
            self.still = 0
            if s.conservative:
                return None
        if self.last is None:
            if lead["confidence"] < s.restart:
                return None
            return self.take(lead)
        px, py = self.last["center_x"], self.last["center_y"]
        if self.before is not None and (d := self.last["frame"] - self.before["frame"]) > 0:
            ahead = (frame - self.last["frame"]) / d
            px, py = px + (px - self.before["center_x"]) * ahead, py + (py - self.before["center_y"]) * ahead
        best = None
        for r in cands:
            off = math.hypot(r["center_x"] - self.last["center_x"], r["center_y"] - self.last["center_y"])
            if off > s.jump and r["confidence"] < s.sure:
                continue
            score = r["confidence"] * s.confidence - math.hypot(r["center_x"] - px, r["center_y"] - py) * s.predicted - off * s.last - r["player_penalty"] - r["box_size"] * s.size
            if best is None or (score, -r["row"]) > (best[0], -best[1]["row"]):
                best = (score, r, off)
        if best is None or best[0] < s.least_score:
            return None
        self.still = self.still + 1 if best[2] < s.still_px else 0
        return None if self.still >= s.still_rows else self.take(best[1])

    def take(self, r: dict) -> dict:
        self.before, self.last = self.last, r
        return r


def ball_path(df: DataFrame, *, by: list[str], row: str, spec: BallTrackSpec = BallTrackSpec()) -> DataFrame:
    """At most one candidate a frame: a plausible path. ``df`` has frame, confidence, center_x, center_y, box_size and player_penalty; equal scores go to the smaller ``row``.

    A stretch of more than ``reset_gap`` frames without candidates resets the picker, so a sequence is cut there and its parts are picked apart. What crosses a cut is whether
    the picker held a place before it: the conservative one then gives the first frame away. So each part is picked both ways, and a running
    composition of the parts' ends tells which of the two holds.
    """
    kinds = ", ".join(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by)
    kind = df.schema[row].dataType.simpleString()
    cols = materialise(df.filter(F.col("frame").isNotNull()).select(*by, F.col(row).alias("row"), "frame", "confidence", "center_x", "center_y", "box_size", "player_penalty"), "candidates")
    frames = islands(materialise(cols.select(*by, "frame").distinct(), "frames"), by=by, order="frame", max_gap=spec.reset_gap, name="_part").select(*by, "frame", "_part")
    frames = materialise(frames, "parts")
    cut = cols.join(frames, [*by, "frame"])
    if spec.conservative:
        first = frames.groupBy(*by, "_part").agg(F.min("frame").alias("_first"))
        ways = F.when((F.col("_part") == 1) | (F.col("frame") == F.col("_first")), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
        cut = cut.join(first, [*by, "_part"]).withColumn("_way", F.explode(ways)).drop("_first")
    else:
        cut = cut.withColumn("_way", F.lit(0))

    def machine():  # noqa: ANN202
        tracker, held, key = BallTracker(spec), [], []

        def step(r: dict | None) -> list[tuple]:
            out = []
            if held and (r is None or r["frame"] != held[0]["frame"]):
                if (got := tracker.pick(held[0]["frame"], held)) is not None:
                    out.append((*key, got["row"], got["frame"], None))
                held.clear()
            if r is None:
                return [*out, (*key, None, None, int(tracker.last is not None))]
            key[:] = [*(r[b] for b in by), r["_part"], r["_way"]]
            held.append(r)
            return out

        return step

    out = stream_groups(cut, machine, by=[*by, "_part", "_way"], order=["frame", "row"], schema=f"{kinds}, _part long, _way int, row {kind}, frame int, _end int", finish=True)
    if not spec.conservative:
        return out.filter("row is not null").select(*by, F.col("row").alias(row), "frame")
    out = materialise(out, "picked")
    # a part whose second way has no frame left ends with nothing held
    ends = out.filter("row is null").groupBy(*by, "_part").agg(F.coalesce(F.max(F.when(F.col("_way") == 0, F.col("_end"))), F.lit(0)).alias("_a"), F.coalesce(F.max(F.when(F.col("_way") == 1, F.col("_end"))), F.lit(0)).alias("_b"))
    same = (F.col("_a") == F.col("_b")) | (F.col("_part") == 1)
    ends = ends.withColumns({"_fix": F.when(same, F.col("_a")), "_not": F.when(~same & (F.col("_a") == 1), 1).otherwise(0)})
    over = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_turns", F.sum("_not").over(over)).withColumn("_since", F.last(F.when(F.col("_fix").isNotNull(), F.struct("_fix", "_turns")), ignorenulls=True).over(over))
    ends = ends.withColumn("_held", (F.col("_since._fix") + F.col("_turns") - F.col("_since._turns")) % 2)
    starts = ends.select(*by, (F.col("_part") + 1).alias("_part"), F.col("_held").alias("_start"))
    return out.filter("row is not null").join(starts, [*by, "_part"], "left").filter(F.col("_way") == F.coalesce("_start", F.lit(0))).select(*by, F.col("row").alias(row), "frame")


@dataclass(frozen=True)
class PlayerTrackSpec:
    missing_frames: int = 8
    distance: float = 90.0
    least_iou: float = 0.02


def near_pairs(tracks: np.ndarray, reach: np.ndarray, boxes: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Portions of about ``most`` (track, box) pairs that hold all pairs whose feet are within the track's ``reach`` or whose boxes overlap.

    Crowded frames are cut into strips of equal numbers of boxes by foot_y, searched by foot_x in each.
    """
    n, m = len(tracks), len(boxes)
    if n * m <= most:
        yield np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
        return
    x, y = boxes[:, 4], boxes[:, 5]
    left, up, right, down = (np.fmax.reduce(d, initial=0.0) for d in (x - boxes[:, 0], y - boxes[:, 1], boxes[:, 2] - x, boxes[:, 3] - y))
    slack = 1e-6 + 1e-9 * (np.abs(tracks[:, 4]) + np.abs(tracks[:, 5]) + reach)  # for rounding; the exact test follows
    x_from, x_to = np.fmin(tracks[:, 4] - reach, tracks[:, 0] - right) - slack, np.fmax(tracks[:, 4] + reach, tracks[:, 2] + left) + slack
    y_from, y_to = np.fmin(tracks[:, 5] - reach, tracks[:, 1] - down) - slack, np.fmax(tracks[:, 5] + reach, tracks[:, 3] + up) + slack
    by_y, high = np.argsort(y, kind="stable"), max(1, math.isqrt(m))
    for k in range(0, m, high):
        strip = by_y[k : k + high]
        t = np.nonzero((y_from <= y[strip[-1]]) & (y_to >= y[strip[0]]))[0]
        strip = strip[np.argsort(x[strip], kind="stable")]
        first = np.searchsorted(x[strip], x_from[t])
        number = np.maximum(np.searchsorted(x[strip], x_to[t], "right") - first, 0)
        portion = np.cumsum(number) // most
        for q in np.unique(portion):
            own = portion == q
            c = number[own]
            yield np.repeat(t[own], c), strip[np.repeat(first[own] - np.cumsum(c) + c, c) + np.arange(c.sum())]


def match_frame(tracks: np.ndarray, seen: np.ndarray, boxes: np.ndarray, frame: int, spec: PlayerTrackSpec, most: int = 1_000_000) -> list[tuple]:
    """Greedy one-to-one matches (track, box, score, distance, allowed, iou), best score first.

    A box is x1, y1, x2, y2, foot_x, foot_y; ``seen`` is each track's last frame. About ``most`` pairs are held at a time, the best ones:
    where a frame has more, they are matched first, then the next best of what is left, so the matches don't depend on ``most``.
    """
    gap = np.maximum(1, frame - seen)
    size = lambda q: np.stack([q[..., 2] - q[..., 0], q[..., 3] - q[..., 1]], -1)
    area = lambda s: np.maximum(s[..., 0], 0) * np.maximum(s[..., 1], 0)

    def measured(i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
        t, b = tracks[i], boxes[j]
        ts, bs = size(t), size(b)
        dist = np.sqrt((b[..., 4] - t[..., 4]) ** 2 + (b[..., 5] - t[..., 5]) ** 2)
        allowed = spec.distance + gap[i] * np.maximum(12.0, np.maximum(np.maximum(ts[..., 1], bs[..., 1]), 1.0) * 0.45)
        inter = np.maximum(np.minimum(t[..., 2], b[..., 2]) - np.maximum(t[..., 0], b[..., 0]), 0) * np.maximum(np.minimum(t[..., 3], b[..., 3]) - np.maximum(t[..., 1], b[..., 1]), 0)
        union = area(ts) + area(bs) - inter
        overlap = np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)
        ta, ba = np.maximum(1.0, ts.prod(-1)), np.maximum(1.0, bs.prod(-1))
        score = dist / allowed + (1 - overlap) * 0.35 + np.minimum(1.0, np.abs(np.log(np.maximum(ta, ba) / np.minimum(ta, ba)))) * 0.20
        can = (dist <= allowed) | (overlap >= spec.least_iou)
        return [v[can] for v in (i, j, score, dist, allowed, overlap)]

    def best(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        i, j, score, dist, allowed, overlap = map(np.concatenate, zip(*parts))
        order = np.lexsort((j, i, -overlap, dist, score))[:most]
        return [v[order] for v in (i, j, score, dist, allowed, overlap)]

    out, free_t, free_b = [], np.arange(len(tracks)), np.arange(len(boxes))
    while len(free_t) and len(free_b):
        tallest = np.fmax.reduce(size(boxes[free_b])[:, 1], initial=1.0)
        reach = spec.distance + gap[free_t] * np.maximum(12.0, np.maximum(size(tracks[free_t])[:, 1], tallest) * 0.45)
        parts, held, cut = [], 0, False
        for i, j in near_pairs(tracks[free_t], reach, boxes[free_b], most):
            parts.append(measured(free_t[i], free_b[j]))
            held += len(parts[-1][0])
            if held > 2 * most:
                parts, held, cut = [best(parts)], most, True
        if not held:
            break
        cut |= held > most
        used_t, used_b = set(), set()
        for a, c, *rest in zip(*(v.tolist() for v in best(parts))):
            if a not in used_t and c not in used_b:
                used_t.add(a), used_b.add(c)
                out.append((a, c, *rest))
        if not cut:
            break
        free_t, free_b = np.setdiff1d(free_t, list(used_t)), np.setdiff1d(free_b, list(used_b))
    return out


def track_players(df: DataFrame, *, by: list[str], player: str = "player_id", spec: PlayerTrackSpec = PlayerTrackSpec()) -> DataFrame:
    """Track ids for detections (frame, confidence, x1, y1, x2, y2, foot_x, foot_y), by greedy matching from frame to frame.

    A gap of more than ``missing_frames`` + 1 frames ends every track, so a sequence is cut there and its parts are tracked apart;
    ids are numbered on over the parts.
    """
    kinds = ", ".join(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by)
    df = materialise(df.select(*by, "frame", player, "confidence", "x1", "y1", "x2", "y2", "foot_x", "foot_y"), "detections")
    frames = materialise(df.select(*by, "frame").distinct(), "frames")
    parts = materialise(islands(frames, by=by, order="frame", max_gap=spec.missing_frames + 1, name="_part").select(*by, "frame", "_part"), "parts")
    cut = df.join(parts, [*by, "frame"])
    box, keys = ["x1", "y1", "x2", "y2", "foot_x", "foot_y"], [*by, "_part"]
    schema = f"{kinds}, _part long, frame int, {player} {df.schema[player].dataType.simpleString()}, local_track long, match_score double, match_distance_px double, match_allowed_px double, match_iou double, track_age int, track_status string"

    def track(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Frame by frame over sorted rows; tracks are arrays in the order of their numbers. A frame cut by a batch's end waits for the next one."""
        rest, key = None, None
        none = np.zeros(0, dtype=np.int64)
        number, ids, held, seen, age = 0, none, np.zeros((0, 6)), none, none
        for pdf in itertools.chain(batches, [None]):
            rows = rest if pdf is None else pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if rows is None or not len(rows):
                continue
            same = np.ones(len(rows) - 1, dtype=bool)
            for c in (*keys, "frame"):
                v = rows[c].to_numpy()
                same &= v[1:] == v[:-1]
            start = np.r_[0, np.flatnonzero(~same) + 1]
            stop = np.r_[start[1:], len(rows)]
            if pdf is not None:  # the last frame may go on
                rest = rows.iloc[start[-1] :].reset_index(drop=True)
                start, stop = start[:-1], stop[:-1]
                if not len(start):
                    continue
            rows = rows.iloc[: stop[-1]]
            boxes, frame = rows[box].to_numpy(dtype=float), rows["frame"].to_numpy(dtype=np.int64)
            local, grown = np.zeros(len(rows), dtype=np.int64), np.ones(len(rows), dtype=np.int64)
            told = np.full((len(rows), 4), np.nan)
            values = list(zip(*[rows[c].iloc[start].tolist() for c in keys]))
            for k, a, b in zip(values, start.tolist(), stop.tolist()):
                at = int(frame[a])
                if k != key:
                    key, number, ids, held, seen, age = k, 0, ids[:0], held[:0], seen[:0], age[:0]
                alive = at - seen <= spec.missing_frames + 1
                if not alive.all():
                    ids, held, seen, age = ids[alive], held[alive], seen[alive], age[alive]
                found = match_frame(held, seen, boxes[a:b], at, spec) if len(ids) else []
                fresh = np.ones(b - a, dtype=bool)
                if found:
                    t, j = np.array([m[0] for m in found]), np.array([m[1] for m in found])
                    fresh[j] = False
                    held[t], seen[t] = boxes[a + j], at
                    age[t] += 1
                    local[a + j], grown[a + j], told[a + j] = ids[t], age[t], [m[2:] for m in found]
                if (n := int(fresh.sum())):
                    new = np.arange(number + 1, number + n + 1)
                    number += n
                    local[a:b][fresh] = new
                    ids, held, seen, age = np.r_[ids, new], np.vstack([held, boxes[a:b][fresh]]), np.r_[seen, np.full(n, at)], np.r_[age, np.ones(n, dtype=np.int64)]
            out = rows[[*keys, "frame", "_player"]].rename(columns={"_player": player}).assign(local_track=local)
            for i, c in enumerate(("match_score", "match_distance_px", "match_allowed_px", "match_iou")):
                out[c] = told[:, i]
            yield out.assign(track_age=grown, track_status=np.where(np.isnan(told[:, 0]), "new", "matched"))

    cols = cut.select(*keys, "frame", F.col(player).alias("_player"), "confidence", *box)
    placed = cols.repartition(parallelism(df.sparkSession), *keys).sortWithinPartitions(*keys, "frame", F.desc("confidence"), "_player")
    tracked = materialise(placed.mapInPandas(track, schema), "tracked")
    many = tracked.groupBy(*by, "_part").agg(F.max("local_track").alias("_n"))
    offset = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    many = many.select(*by, "_part", offset.alias("_offset"))
    return tracked.join(many, [*by, "_part"]).withColumn("track_id", F.col("local_track") + F.col("_offset")).drop("_part", "_offset", "local_track")


@dataclass(frozen=True)
class SmoothSpec:
    enter_speed: float = 150.0
    enter_distance: float = 65.0
    core_speed: float = 700.0
    core_distance: float = 40.0
    go_on_speed: float = 75.0
    go_on_distance: float = 65.0
    tight: float = 22.0
    seed_gap: int = 2
    confirm_rows: int = 3
    strict_zones: tuple[str, ...] = ("strict", "tolerant")
    other_rows: int = 999


def smooth_states(df: DataFrame, *, by: list[str], spec: SmoothSpec = SmoothSpec()) -> DataFrame:
    """Smoothed ball states of association rows (frame, state, speed, distance, zone), with the reason.

    All in windows: passes grow from seeds through rows that go on like one, unless tight control lies more than one row from the seeds;
    then control by distance, and short controlled runs right after a pass are taken back.
    """
    speed, dist = F.coalesce("speed", F.lit(0.0)), F.coalesce("distance", F.lit(9999.0))
    rows = df.withColumns({"_s": speed, "_d": dist})
    seed = (((F.col("_s") >= spec.core_speed) & (F.col("_d") >= spec.core_distance)) | ((F.col("_s") >= spec.enter_speed) & (F.col("_d") >= spec.enter_distance))) & ~(F.col("_d") <= spec.tight)
    going = (F.col("_s") >= spec.go_on_speed) | (F.col("_d") >= spec.go_on_distance) | F.coalesce(F.col("state") == "in_transit", F.lit(False))
    wall = (F.col("_d") <= spec.tight) & F.coalesce(F.col("state") == "controlled", F.lit(False))
    rows = running_count(rows.withColumns({"_seed": seed, "_on": going, "_wall": wall}), by=by, order="frame", flag=F.lit(True), name="_i")
    # the nearest seed on either side, then the nearest row that stops growth between it and here
    at = lambda cond: F.when(cond, F.col("_i"))
    rows = materialise(running(materialise(rows, "numbered"), by=by, order="_i", exprs={"_left": ("max", False, at(F.col("_seed"))), "_right": ("min", True, at(F.col("_seed")))}), "seeds")
    stop_l = ~F.col("_on") | (F.col("_wall") & (F.col("_i") - F.col("_left") > 1))
    stop_r = ~F.col("_on") | (F.col("_wall") & (F.col("_right") - F.col("_i") > 1))
    rows = running(rows, by=by, order="_i", exprs={"_sl": ("max", False, at(stop_l & ~F.col("_seed"))), "_sr": ("min", True, at(stop_r & ~F.col("_seed")))})
    between = F.coalesce(F.col("_right") - F.col("_left") <= spec.seed_gap + 1, F.lit(False))
    from_left = F.col("_left").isNotNull() & (F.col("_sl").isNull() | (F.col("_sl") < F.col("_left")))
    from_right = F.col("_right").isNotNull() & (F.col("_sr").isNull() | (F.col("_sr") > F.col("_right")))
    passing = F.col("_seed") | between | from_left | from_right
    near = (F.col("_d") <= 80) & (F.col("_s") <= 500)
    rows = rows.withColumn("_pass", passing)
    rows = rows.withColumns({
        "_state": F.when(F.col("_pass"), "in_transit").when(near, "controlled").when(F.col("_d") > 80, "loose_or_unclear").otherwise(F.col("state")),
        "_why": F.when(F.col("_pass"), "pass_interval").when(near, "control_distance").when(F.col("_d") > 80, "outside_control_distance").otherwise("raw"),
    })
    rows = neighbours(materialise(rows.select(*df.columns, "_i", "_state", "_why"), "states"), by=by, order="_i", columns=["_state", "_i"])
    change = ~F.col("_state").eqNullSafe(F.col("prev__state")) | F.col("prev__i").isNull()
    rows = running_count(rows, by=by, order="_i", flag=change, name="_run")
    rows = materialise(rows, "runs")
    runs = rows.groupBy(*by, "_run").agg(F.count(F.lit(1)).alias("_n"), F.min_by("prev__state", "_i").alias("_before"), F.mode("zone", True).alias("_zone"))
    rows = rows.join(runs, [*by, "_run"])
    need = F.when(F.coalesce("_zone", F.lit("")).isin(*spec.strict_zones), spec.confirm_rows).otherwise(spec.other_rows)
    undo = (F.col("_state") == "controlled") & F.coalesce(F.col("_before") == "in_transit", F.lit(False)) & (F.col("_n") < need) & F.lit(spec.confirm_rows > 1)
    out = rows.withColumns({"smoothed_state": F.when(undo, "in_transit").otherwise(F.col("_state")), "smoothing_reason": F.when(undo, "receiver_not_confirmed").otherwise(F.col("_why"))})
    return out.select(*df.columns, "smoothed_state", "smoothing_reason")
