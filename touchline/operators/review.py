"""Relational steps of review preparation: windows, fallbacks, exclusions, distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.geometry import distance
from touchline.operators.motion import islands
from touchline.operators.select import top
from touchline.operators.sequence import first_per, neighbours, running_count


def segment_windows(segments: DataFrame, *, by: list[str], short: float = 0.5) -> DataFrame:
    """Time windows around the starts, ends and short stretches of segments (segment, start_time, end_time), clamped at 0."""
    def part(kind: str, rank: int, centre: Column, a: Column, b: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("priority"), centre.alias("center_time"), F.greatest(a, F.lit(0.0)).alias("window_start"), b.alias("window_end"))

    s, e = F.col("start_time"), F.col("end_time")
    parts = F.array_compact(F.array(
        F.when(e - s < short, part("short_controlled_segment", 0, s, s - 2.0, e + 2.0)), part("segment_start", 1, s, s - 1.5, s + 1.5), part("segment_end", 2, e, e - 1.5, e + 1.5),
    ))
    return segments.select(*by, "segment", F.inline(parts))


def flagged_runs(df: DataFrame, flag: Column, *, by: list[str], time: str = "time") -> DataFrame:
    """Runs of flagged rows in successive frames with their ends."""
    runs = islands(df.filter(flag), by=by, order="frame", max_gap=1, name="run")
    return runs.groupBy(*by, "run").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.min(time).alias("start_time"), F.max(time).alias("end_time"), F.count(F.lit(1)).alias("n"))


def fallback_nearest(rows: DataFrame, players: DataFrame, wrong: Column, *, keys: list[str], row: str, radius: float = 45.0, allowed: Column | None = None) -> DataFrame:
    """Where ``wrong`` holds, the nearest other allowed player within ``radius`` replaces the one associated; what was is kept as ``before_*``."""
    cand = rows.filter(wrong).select(*keys, row, "center_x", "center_y", F.col("nearest_player_id").alias("_was")).join(players.filter(allowed) if allowed is not None else players, keys)
    cand = cand.filter(~F.col("player_id").eqNullSafe(F.col("_was"))).withColumn("_d", distance("center_x", "center_y", "foot_x", "foot_y")).filter(F.col("_d") <= radius)
    best = cand.groupBy(row).agg(F.min(F.struct("_d", "player_id")).alias("_new"))
    out = rows.join(best, row, "left")
    hit = F.col("_new").isNotNull()
    return out.withColumns({"before_player_id": F.col("nearest_player_id"), "before_distance_px": F.col("nearest_player_distance_px"), "repaired": hit}).withColumns(
        {"nearest_player_id": F.when(hit, F.col("_new.player_id")).otherwise(F.col("nearest_player_id")), "nearest_player_distance_px": F.when(hit, F.col("_new._d")).otherwise(F.col("nearest_player_distance_px"))}
    ).drop("_new")


def at_or_nearest_frame(points: DataFrame, frames: DataFrame, *, by: list[str], row: str, frame: str) -> DataFrame:
    """For each point the frame of ``frames`` that is nearest to its own (of two as near the earlier one), null where there is none.

    A backward and a forward neighbour over the union of both, so nothing is compared pairwise.
    """
    from touchline.operators.associate import asof_backward

    have = frames.select(*by, F.col("frame")).distinct()
    p = points.select(*by, row, F.col(frame).alias("frame"))
    back = asof_backward(p, have.withColumn("f", F.col("frame")), by=by, order="frame", columns=["f"]).withColumnRenamed("f", "_back")
    mirrored = have.select(*by, (-F.col("frame")).alias("frame"), F.col("frame").alias("f"))
    ahead = asof_backward(back.withColumn("frame", -F.col("frame")), mirrored, by=by, order="frame", columns=["f"]).withColumnRenamed("f", "_ahead")
    at = -F.col("frame")
    pick = F.when(F.col("_ahead").isNull() | (at - F.col("_back") <= F.col("_ahead") - at), F.col("_back")).otherwise(F.col("_ahead"))
    return ahead.select(*by, row, at.alias(frame), pick.alias("nearest_frame"))


def harvest(frames: DataFrame, readings: DataFrame, *, by: list[str], every: int = 10) -> DataFrame:
    """Frames worth keeping among every n-th: long empty streaks, tiny or unsure readings, round frames, and the ends of long gaps.

    ``readings`` has at most one row a frame (area, confidence).
    """
    rows = frames.filter(F.pmod("frame", F.lit(every)) == 0).join(readings.select(*by, "frame", "area", "confidence"), [*by, "frame"], "left").withColumn("_hit", F.col("confidence").isNotNull())
    rows = running_count(rows, by=by, order="frame", flag=F.col("_hit"), name="_since")
    rows = running_count(rows, by=[*by, "_since"], order="frame", flag=~F.col("_hit"), name="_streak")
    found = neighbours(rows.filter("_hit"), by=by, order="frame", columns=["frame"]).select(*by, "frame", (F.col("frame") - F.col("prev_frame")).alias("_gap"))
    rows = rows.join(found, [*by, "frame"], "left")
    reasons = F.array_compact(F.array(
        F.when(~F.col("_hit") & (F.col("_streak") % 5 == 0), "negative_frames"), F.when(F.col("area") < 150, "tiny_ball"), F.when(F.col("confidence") < 0.40, "low_confidence"),
        F.when(F.col("_hit") & (F.pmod("frame", F.lit(100)) == 0), "review_all"), F.when(F.col("_gap") > 75, "tracking_failures"),
    ))
    return rows.select(*by, "frame", F.explode(reasons).alias("reason"))


def describe(df: DataFrame, column: str, *, by: list[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum."""
    q = lambda p: F.percentile(column, p)
    return df.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max(column).alias("max"))


def nested_count(df: DataFrame, column: str) -> DataFrame:
    """Entries per outer and inner key of a map of maps of arrays."""
    outer = df.select(F.explode(column).alias("outer", "inner"))
    return outer.select("outer", F.explode("inner").alias("inner", "items")).groupBy("outer", "inner").agg(F.sum(F.size("items")).alias("n"))


def numbered_windows(segments: DataFrame, advisory: DataFrame, *, by: list[str]) -> DataFrame:
    """The windows of ``segment_windows`` and a second around advisory stretches (start_time, end_time), numbered by priority and centre; equal ones by window and segment."""
    own = segment_windows(segments, by=by)
    s, e = F.col("start_time"), F.col("end_time")
    more = advisory.select(*by, F.lit(None).cast(own.schema["segment"].dataType).alias("segment"), F.lit("advisory_window").alias("kind"), F.lit(3).alias("priority"), s.alias("center_time"), F.greatest(s - 1.0, F.lit(0.0)).alias("window_start"), (e + 1.0).alias("window_end"))
    both = own.unionByName(more)
    # by priority first, so the priorities' numbers are counted apart, each in blocks of time
    counted = running_count(both, by=[*by, "priority"], order="center_time", flag=F.lit(True), name="_k", tie=["window_start", "segment"], block=2048.0)
    before = both.groupBy(*by).agg(*[F.count_if(F.col("priority") < p).alias(f"_n{p}") for p in range(4)])
    offset = F.element_at(F.array(*[F.col(f"_n{p}") for p in range(4)]), F.col("priority") + 1)
    out = counted.join(before, by).withColumn("number", F.col("_k") + offset)
    return out.withColumn("review_id", F.format_string("review_%04d", "number")).drop("_k", *[f"_n{p}" for p in range(4)])


def hard_frames(rows: DataFrame, most: int, *, by: list[str], row: str) -> DataFrame:
    """At most ``most`` frames a sequence worth a review, with the reason: low confidence, ends and middles of gaps, jumps, made readings.

    A quarter of them (four at least) for each reason; a frame keeps its first reason; what is left is filled up with further readings of low confidence.
    ``rows`` has frame, confidence, dt_seconds, ball_speed_px_per_second, frame_gap and interpolated.
    """
    k = max(4, most // 4)
    low = top(rows.filter("confidence between 0.15 and 0.45"), k + most, by=by, order=[F.asc("confidence"), F.asc(row)], rank="_q")
    gaps = top(rows.filter("dt_seconds >= 0.5"), k, by=by, order=[F.desc("dt_seconds"), F.asc(row)], rank="_q").withColumn("_q", 2 * F.col("_q"))
    middle = gaps.withColumns({"frame": F.greatest(F.lit(0), F.col("frame") - F.rint(F.col("frame_gap") / 2).cast("int")), "_q": F.col("_q") + 1})
    jumps = top(rows.filter("dt_seconds <= 0.2 and ball_speed_px_per_second >= 650"), k, by=by, order=[F.desc("ball_speed_px_per_second"), F.asc(row)], rank="_q")
    made = rows.filter("interpolated")
    made = running_count(made, by=by, order="frame", flag=F.lit(True), name="_i", tie=[row]).withColumn("_i", F.col("_i") - 1).join(made.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), by)
    every = F.greatest(F.lit(1), F.floor(F.col("_n") / k))
    made = made.filter((F.col("_i") % every == 0) & (F.floor(F.col("_i") / every) < k)).withColumn("_q", F.col("_i"))
    parts = [("low_confidence_detection", 0, low.filter(F.col("_q") <= k)), ("detection_gap_end", 1, gaps), ("detection_gap_middle", 1, middle), ("suspicious_ball_jump", 2, jumps), ("interpolated_position", 3, made)]
    named = [p.select(*by, "frame", F.lit(name).alias("reason"), F.lit(i).alias("_p"), F.col("_q").cast("long").alias("_q")) for name, i, p in parts]
    first = first_per(reduce(DataFrame.unionByName, named), [*by, "frame"], [F.asc("_p"), F.asc("_q")])
    kept = top(first, most, by=by, order=[F.asc("_p"), F.asc("_q")])
    # at most ``most`` of the further ones are needed, and as many may be among those kept already
    lacking = kept.groupBy(*by).agg((F.lit(most) - F.count(F.lit(1))).alias("_open")).filter("_open > 0")
    rest = low.join(kept.select(*by, "frame"), [*by, "frame"], "left_anti").join(lacking, by)
    rest = rest.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_q"))).filter(F.col("_r") <= F.col("_open"))
    return kept.select(*by, "frame", "reason").unionByName(rest.select(*by, "frame", F.lit("low_confidence_detection").alias("reason")))
