"""Quality and volume reports of ball and player tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.geometry import iou
from touchline.operators.select import top
from touchline.operators.sequence import neighbours


def graded(value: Column, steps: list[tuple[float, str]], rest: str, upwards: bool = True) -> Column:
    """The name of the first step that ``value`` reaches (or, downwards, doesn't exceed)."""
    out = None
    for limit, name in steps:
        test = value >= limit if upwards else value <= limit
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(rest)


def tracking_quality(ball: DataFrame, players: DataFrame, *, by: list[str], tie: list[str] = ()) -> DataFrame:
    """Per sequence: counts, rates, frame gaps and grades of players, ball volume and ball continuity."""
    gaps = neighbours(ball, by=by, order="frame", columns=["frame"], tie=tie).withColumn("gap", F.col("frame") - F.col("prev_frame"))
    b = gaps.groupBy(*by).agg(F.count(F.lit(1)).alias("ball_rows"), F.countDistinct("frame").alias("ball_frames"), F.avg("gap").alias("mean_ball_gap"), F.max("gap").alias("max_ball_gap"), F.max("time_seconds").alias("bt"))
    per_frame = players.groupBy(*by, "frame").agg(F.count(F.lit(1)).alias("n"), F.max("time_seconds").alias("t"))
    p = per_frame.groupBy(*by).agg(F.sum("n").alias("player_rows"), F.count(F.lit(1)).alias("player_frames"), F.avg("n").alias("avg_players_per_frame"), F.max("t").alias("pt"))
    out = b.join(p, by, "full").withColumn("duration_seconds", F.greatest("bt", "pt"))
    per_s = F.try_divide(F.col("ball_rows"), F.col("duration_seconds"))
    return out.withColumns({
        "ball_per_second": per_s, "player_grade": graded(F.col("avg_players_per_frame"), [(14, "GOOD"), (8, "USABLE")], "WEAK"),
        "volume_grade": graded(per_s, [(2, "GOOD"), (0.75, "USABLE")], "WEAK"), "continuity_grade": graded(F.col("max_ball_gap"), [(60, "GOOD"), (150, "USABLE")], "GAPPY", upwards=False),
    }).drop("bt", "pt")


def gap_report(ball: DataFrame, *, by: list[str], tie: list[str] = ()) -> DataFrame:
    """Per sequence: duration, rate and how many time gaps reach half a second, one, two and five seconds."""
    gaps = neighbours(ball, by=by, order="time_seconds", columns=["time_seconds"], tie=tie, block=2048.0).withColumn("gap", F.col("time_seconds") - F.col("prev_time_seconds"))
    span = F.max("time_seconds") - F.min("time_seconds")
    return gaps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("detections"), span.alias("duration_seconds"), F.try_divide(F.count(F.lit(1)), span).alias("detections_per_second"), F.max("gap").alias("max_gap"),
        *[F.count_if(F.col("gap") >= s).alias(f"gaps_{str(s).replace('.', '_')}s") for s in (0.5, 1.0, 2.0, 5.0)],
    )


def trajectory_stats(path: DataFrame, fps: float, *, by: list[str], max_dt: int = 15, jump: float = 2500.0, tie: list[str] = ()) -> DataFrame:
    """Per sequence: source counts, coverage, gap histogram, exact speed quantiles over short steps, jumps."""
    steps = neighbours(path, by=by, order="frame", columns=["frame", "center_x", "center_y"], tie=tie)
    dt = F.col("frame") - F.col("prev_frame")
    dx, dy = F.col("center_x") - F.col("prev_center_x"), F.col("center_y") - F.col("prev_center_y")
    v = F.when((dt > 0) & (dt <= max_dt), F.try_divide(F.sqrt(dx * dx + dy * dy), dt / F.lit(float(fps))))
    steps = steps.withColumns({"dt": dt, "v": v})
    missing = F.col("dt") - 1
    span = F.max("frame") - F.min("frame") + 1
    return steps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("source") == "detected").alias("detected"), F.count_if(F.col("source").contains("interpolated")).alias("interpolated"),
        (F.countDistinct("frame") * 100.0 / span).alias("coverage_percent"),
        F.count_if(missing.between(1, 15)).alias("gap_1_15"), F.count_if(missing.between(16, 30)).alias("gap_16_30"), F.count_if(missing.between(31, 60)).alias("gap_31_60"),
        F.count_if(missing.between(61, 150)).alias("gap_61_150"), F.count_if(missing >= 151).alias("gap_151"),
        F.avg("v").alias("avg_speed"), F.median("v").alias("median_speed"), F.percentile("v", 0.95).alias("p95_speed"), F.max("v").alias("max_speed"), F.count_if(F.col("v") > jump).alias("jumps"),
    )


def grouped_rollup(df: DataFrame, a: str, b: str, aggregates: list[Column]) -> DataFrame:
    """The same aggregates by ``a``, by ``b`` and by both, with a ``grouping`` column; null keys don't count."""
    kept = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    out = kept.groupingSets([[F.col(a)], [F.col(b)], [F.col(a), F.col(b)]], F.col(a), F.col(b)).agg(F.grouping_id(F.col(a), F.col(b)).alias("_g"), *aggregates)
    return out.withColumn("grouping", F.when(F.col("_g") == 1, a).when(F.col("_g") == 2, b).otherwise(f"{a}+{b}")).drop("_g")


def longest_gaps(ball: DataFrame, n: int, *, by: list[str], row: str, least: float = 2.0) -> DataFrame:
    """The ``n`` longest time gaps of each sequence of at least ``least`` seconds, by the row that ends them, with their rank."""
    gaps = neighbours(ball, by=by, order="time_seconds", columns=["time_seconds"], tie=[row], block=2048.0).withColumn("gap", F.col("time_seconds") - F.col("prev_time_seconds"))
    return top(gaps.filter(F.col("gap") >= least), n, by=by, order=[F.desc("gap"), F.asc(row)], rank="rank")


def temporal_overlap(df: DataFrame, *, by: list[str], confidence: float = 0.5, overlap: float = 0.7, tie: list[str] = ()) -> DataFrame:
    """Per sequence: rows, rows of low confidence, and rows whose box overlaps the one before too little."""
    corners = ["x1", "y1", "x2", "y2"]
    rows = neighbours(df, by=by, order="frame", columns=corners, tie=tie)
    share = iou(tuple(F.col(c) for c in corners), tuple(F.col(f"prev_{c}") for c in corners))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("detected"), F.count_if(F.col("confidence") < confidence).alias("low_confidence"), F.count_if(F.col("prev_x1").isNotNull() & (share < overlap)).alias("low_overlap"),
    )
