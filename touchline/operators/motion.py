"""Motion, gaps and islands of frame-indexed sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.geometry import distance
from touchline.operators.sequence import neighbours, running_count


def with_time(df: DataFrame, fps: float, *, frame: str = "frame", time: str = "time_seconds", force: bool = False) -> DataFrame:
    """``time`` as frame / fps where it is missing, null or NaN, or everywhere if forced."""
    made = F.col(frame) / F.lit(float(fps))
    if force or time not in df.columns:
        return df.withColumn(time, made)
    return df.withColumn(time, F.when(F.col(time).isNull() | F.isnan(time), made).otherwise(F.col(time)))


def speed(dist: Column, seconds: Column) -> Column:
    """Distance over time; no time gives infinity for a move and null for none."""
    return F.when(seconds == 0, F.when(dist > 0, F.lit(float("inf")))).otherwise(F.try_divide(dist, seconds))


def motion(df: DataFrame, fps: float, *, by: list[str], frame: str = "frame", x: str = "center_x", y: str = "center_y", tie: list[str] = ()) -> DataFrame:
    """Adds prev_frame, prev_x, prev_y, dx, dy, dt_seconds and speed of the step from the row before."""
    df = neighbours(df, by=by, order=frame, columns=[frame, x, y], tie=tie)
    df = df.withColumns({"prev_frame": F.col(f"prev_{frame}"), "dx": F.col(x) - F.col(f"prev_{x}"), "dy": F.col(y) - F.col(f"prev_{y}")})
    df = df.withColumn("dt_seconds", (F.col(frame) - F.col("prev_frame")) / F.lit(float(fps)))
    return df.withColumn("ball_speed_px_per_second", speed(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), F.col("dt_seconds")))


def islands(df: DataFrame, *, by: list[str], order: str, max_gap: float, name: str, tie: list[str] = (), block: float = 65536) -> DataFrame:
    """Numbers stretches from 1; a row more than ``max_gap`` after the one before begins a new one."""
    df = neighbours(df, by=by, order=order, columns=[order], tie=tie, block=block)
    gap = F.col(order) - F.col(f"prev_{order}")
    df = df.withColumn("gap", gap)
    df = running_count(df, by=by, order=order, flag=gap > max_gap, name=name, tie=tie, block=block)
    return df.withColumn(name, F.col(name) + 1)


def island_summary(df: DataFrame, *, by: list[str], island: str, frame: str = "frame", time: str = "time_seconds", x: str = "center_x", y: str = "center_y", confidence: str = "confidence", tie: list[str] = ()) -> DataFrame:
    """One row an island: its ends, duration, length, straight distance and mean speed."""
    key, ends = F.struct(frame, *tie), F.struct(F.col(frame).alias("f"), F.col(time).alias("t"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(confidence).alias("c"))
    out = df.groupBy(*by, island).agg(F.min_by(ends, key).alias("a"), F.max_by(ends, key).alias("b"), F.count(F.lit(1)).alias("num_detections"), F.avg(confidence).alias("avg_confidence"))
    out = out.select(
        *by, island, F.col("a.f").alias("start_frame"), F.col("b.f").alias("end_frame"), F.col("a.t").alias("start_time"), F.col("b.t").alias("end_time"),
        (F.col("b.t") - F.col("a.t")).alias("duration_seconds"), "num_detections", F.col("a.x").alias("start_x"), F.col("a.y").alias("start_y"), F.col("b.x").alias("end_x"), F.col("b.y").alias("end_y"),
        (F.col("b.x") - F.col("a.x")).alias("dx"), (F.col("b.y") - F.col("a.y")).alias("dy"), F.col("a.c").alias("start_confidence"), F.col("b.c").alias("end_confidence"), "avg_confidence",
    )
    out = out.withColumn("distance", distance("start_x", "start_y", "end_x", "end_y"))
    return out.withColumn("avg_speed", F.coalesce(F.try_divide(F.col("distance"), F.when(F.col("duration_seconds") > 0, F.col("duration_seconds"))), F.lit(0.0)))


def trajectories(df: DataFrame, *, by: list[str], max_gap: int = 15, least_s: float = 0.5, most_s: float = 5.0, least_px: float = 40.0, tie: list[str] = ()) -> DataFrame:
    """Short movement chunks between gaps in the frames."""
    parts = island_summary(islands(df, by=by, order="frame", max_gap=max_gap, name="segment_id", tie=tie), by=by, island="segment_id", tie=tie)
    return parts.filter(F.col("duration_seconds").between(least_s, most_s) & (F.col("distance") >= least_px))


def progressions(df: DataFrame, *, by: list[str], max_gap_s: float = 1.5, least_s: float = 1.0, most_s: float = 12.0, least_distance: float = 180.0, least_speed: float = 40.0, tie: list[str] = ()) -> DataFrame:
    """Longer movements between gaps in time."""
    parts = islands(df, by=by, order="time_seconds", max_gap=max_gap_s, name="sequence_id", tie=tie, block=2048.0)
    parts = island_summary(parts, by=by, island="sequence_id", frame="time_seconds", tie=tie).drop("start_frame", "end_frame")
    return parts.filter(F.col("duration_seconds").between(least_s, most_s) & (F.col("distance") >= least_distance) & (F.col("avg_speed") >= least_speed))


def movement_shape(ratio: float, dx: str = "dx", dy: str = "dy", names: tuple[str, str, str] = ("mostly_horizontal", "mostly_vertical", "diagonal")) -> Column:
    ax, ay = F.abs(F.col(dx)), F.abs(F.col(dy))
    return F.when(ax > ay * ratio, names[0]).when(ay > ax * ratio, names[1]).otherwise(names[2])


def classify_movement(df: DataFrame) -> DataFrame:
    """Direction, shape, length, speed and a suggested event of a pixel progression."""
    ax, ay, dx, dy = F.abs("dx"), F.abs("dy"), F.col("dx"), F.col("dy")
    direction = F.when(ax > ay * 1.5, F.when(dx > 0, "right").otherwise("left")).when(ay > ax * 1.5, F.when(dy > 0, "down").otherwise("up")).otherwise("diagonal")
    size = F.when(F.col("distance") >= 400, "long").when(F.col("distance") >= 250, "medium").otherwise("short")
    pace = F.when(F.col("avg_speed") >= 120, "fast").when(F.col("avg_speed") >= 70, "medium").otherwise("slow")
    df = df.withColumns({"movement_direction": direction, "movement_shape": movement_shape(1.8), "movement_length": size, "movement_speed": pace})
    wide = F.col("movement_shape") == "mostly_horizontal"
    event = (
        F.when((F.col("movement_length") == "long") & (F.col("movement_speed") != "slow"), "direct_ball_movement_candidate")
        .when((F.col("movement_length") != "short") & wide, "switch_or_lateral_progression_candidate")
        .when(F.col("movement_length") == "medium", "pass_candidate")
        .otherwise("minor_progression")
    )
    return df.withColumn("suggested_event_type", event)


def classify_field_event(df: DataFrame) -> DataFrame:
    """Event candidate, length and speed bucket of a progression in field yards."""
    d, s, ax, ay = F.col("distance"), F.col("avg_speed"), F.abs("dx"), F.abs("dy")
    across, along, quick = (ay > ax * 1.5) & (d >= 25), (ax > ay * 1.5) & (d >= 25), s >= 8
    event = (
        F.when(across & quick, "switch_candidate").when(across, "lateral_circulation_candidate")
        .when(along & quick & (F.col("duration_seconds") <= 6), "direct_progression_candidate").when(along & ~quick, "buildup_progression_candidate")
        .when((d >= 30) & quick, "diagonal_direct_ball_candidate").when(d >= 30, "diagonal_progression_candidate")
        .when(d >= 15, "simple_pass_candidate").otherwise("minor_movement")
    )
    size = F.when(d >= 40, "very_long").when(d >= 30, "long").when(d >= 20, "medium").otherwise("short")
    return df.withColumns({"event_candidate": event, "length_bucket": size, "speed_bucket": F.when(s >= 12, "fast").when(s >= 7, "medium").otherwise("slow")})


def drop_hotspots(df: DataFrame, *, by: list[str], x: str = "center_x", y: str = "center_y", cell: float = 12.0, least: int = 20) -> DataFrame:
    """Removes readings in grid cells (half-even rounding) that are hit ``least`` times or more: things that don't move."""
    cells = df.withColumns({"_gx": F.rint(F.col(x) / cell), "_gy": F.rint(F.col(y) / cell)})
    hot = cells.groupBy(*by, "_gx", "_gy").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).drop("_n")
    return cells.join(hot, [*by, "_gx", "_gy"], "left_anti").drop("_gx", "_gy")


def interpolate(df: DataFrame, fps: float, *, by: list[str], max_gap_s: float | Column, max_speed: float | Column | None = None, source: str = "interpolated", tie: list[str] = ()) -> DataFrame:
    """Fills gaps of at most int(fps * max_gap_s) missing frames linearly; longer or too fast gaps stay. Limits may be columns, such as a setting's.

    Made rows take other columns from the row before, but have no confidence.
    """
    places = ["x1", "y1", "x2", "y2", "center_x", "center_y"]
    df = df if "source" in df.columns else df.withColumn("source", F.lit("detected"))
    wide = neighbours(df, by=by, order="frame", columns=["frame", *places], tie=tie, previous=False, following=True)
    gap = F.col("next_frame") - F.col("frame")
    ok = (gap > 1) & (gap - 1 <= (F.floor(max_gap_s * F.lit(float(fps))) if isinstance(max_gap_s, Column) else int(fps * max_gap_s)))
    if max_speed is not None:
        ok = ok & (distance("next_center_x", "next_center_y", "center_x", "center_y") / (gap / F.lit(float(fps))) <= max_speed)
    made = wide.filter(ok).withColumn("_gap", gap).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_gap") - 1)))
    share = F.col("_k") / F.col("_gap")
    made = made.withColumns({c: F.col(c) + share * (F.col(f"next_{c}") - F.col(c)) for c in places})
    made = made.withColumns({"frame": F.col("frame") + F.col("_k"), "source": F.lit(source), "confidence": F.lit(None).cast("double"), "object_type": F.lit(f"ball_{source}")})
    made = made.withColumn("time_seconds", F.col("frame") / F.lit(float(fps)))
    return df.unionByName(made.select(*df.columns))
