"""Whole pipelines as one lazy plan: clip to possessions, parameter sweeps, streams."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import associate, evaluate, motion, stateful
from touchline.plans import automata, inventory, reference, views
from touchline.session import materialise, scratch
from touchline.sources.tables import table
from touchline.streaming import live


def clip_rows(balls: DataFrame, players: DataFrame, fps: float, *, by: list[str], max_gap_s: float = 1.0, max_speed: float = 2500.0, **limits: float) -> tuple[DataFrame, DataFrame]:
    """Ball readings and players to the filled path and the rows the possession chain takes: fill gaps, motion, nearest on-field player, ball state.

    ``limits`` are those of ``associate.ball_state``.
    """
    path = motion.interpolate(balls, fps, by=by, max_gap_s=max_gap_s, max_speed=max_speed, source="interpolated_extended", tie=["detection_id"])
    path = materialise(path.withColumn("row", F.struct(*by, "detection_id", "frame")), "path")
    moved = materialise(motion.motion(path, fps, by=by, tie=["detection_id"]), "motion")
    near = associate.nearest(moved, players, keys=[*by, "frame"], row="row", keep=["field_zone"], prefer=F.col("field_zone") == "strict")
    _, state = associate.ball_state(F.col("ball_speed_px_per_second"), F.col("nearest_player_distance_px"), F.col("nearest_player_field_zone"), **limits)
    return path, near.select(
        *by, "detection_id", "frame", (F.col("frame") / fps).alias("time"), F.col("nearest_player_id").cast("string").alias("player"), F.col("nearest_player_distance_px").alias("distance"),
        F.col("ball_speed_px_per_second").alias("speed"), state.alias("state"), F.lit(False).alias("excluded"), F.lit(False).alias("repaired"),
    )


def clip_possessions(balls: DataFrame, players: DataFrame, fps: float, *, by: list[str], spec: stateful.ChainSpec = stateful.ChainSpec(confirm=15), **settings) -> DataFrame:  # noqa: ANN003
    """Ball readings and players to possession segments: ``clip_rows``, then hysteresis."""
    return stateful.possession_segments(clip_rows(balls, players, fps, by=by, **settings)[1], by=by, spec=spec, tie=["detection_id"])


def sweep(balls: DataFrame, players: DataFrame, fps: float, settings: list[tuple[float, float]], *, by: list[str], spec: stateful.ChainSpec, **limits: float) -> DataFrame:
    """Every setting (longest gap in seconds, greatest speed) through filling, association and chain, in one job; a summary row a clip and setting.

    Settings differ only in the gaps they fill, so a gap that some of them fill is filled and associated once, its rows name the settings, and what comes after it has its
    motion both ways. The chains of all settings read these rows together.
    """
    settings = list(dict.fromkeys((float(g), float(v)) for g, v in settings))
    given = F.col("source") != "detected" if "source" in balls.columns else F.lit(False)
    read = balls.filter(" and ".join(f"`{b}` is not null" for b in by)).select(*by, "detection_id", "frame", "center_x", "center_y", given.alias("given"))
    read = materialise(motion.neighbours(read, by=by, order="frame", columns=["frame", "center_x", "center_y", "detection_id"], tie=["detection_id"]), "read")
    gap, k = F.col("frame") - F.col("prev_frame"), F.col("k")
    length = lambda x, y: F.sqrt(x * x + y * y)
    step = length(F.col("center_x") - F.col("prev_center_x"), F.col("center_y") - F.col("prev_center_y"))
    pace = F.try_divide(step, gap / F.lit(float(fps)))
    fills = [F.coalesce((gap > 1) & (gap - 1 <= math.floor(g * fps)) & (pace <= v), F.lit(False)) for g, v in settings]

    made = [F.struct(F.lit(i).alias("setting"), F.lit(g).alias("max_gap_seconds"), F.lit(v).alias("max_speed"), (F.col("n") + F.col(f"made{i}")).alias("path_rows"), (F.col("given") + F.col(f"made{i}")).alias("interpolated_rows")) for i, (g, v) in enumerate(settings)]
    rows = read.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("given").alias("given"), *[F.coalesce(F.sum(F.when(ok, gap - 1)), F.lit(0)).alias(f"made{i}") for i, ok in enumerate(fills)])
    rows = rows.select(*by, F.explode(F.array(*made)).alias("m")).select(*by, "m.*")

    # k counts the frames from the row before: of a gap that is filled somewhere those in it and the row after it; 0 is a row by itself
    filled = F.concat(*[F.when(ok, "1").otherwise("0") for ok in fills])
    path = read.withColumn("filled", F.when(filled.contains("1"), filled)).withColumn("k", F.explode(F.when(F.col("filled").isNotNull(), F.sequence(F.lit(1), gap)).otherwise(F.array(F.lit(0)))))
    within = (k > 0) & (k < gap)

    def at(c: str, k: Column) -> Column:
        start, end = F.col(f"prev_{c}"), F.col(c)
        return F.when(k == 0, start).when(k == gap, end).otherwise(start + F.try_divide(k, gap) * (end - start))

    places = {c: F.when(k > 0, at(c, k)).otherwise(F.col(c)) for c in ("center_x", "center_y")}
    back = {c: at(c, k - 1) for c in ("center_x", "center_y")}
    path = path.select(
        *by, F.when(within, F.col("prev_frame") + k).otherwise(F.col("frame")).alias("frame"), F.when(within, F.col("prev_detection_id")).otherwise(F.col("detection_id")).alias("id"),
        *[p.alias(c) for c, p in places.items()], "filled", within.alias("made"), F.coalesce("prev_frame", "frame").alias("back"), F.coalesce("prev_detection_id", "detection_id").alias("back_id"),
        F.when(~within, motion.speed(step, gap / F.lit(float(fps)))).alias("speed"),
        F.when(k > 0, motion.speed(length(*[places[c] - back[c] for c in places]), F.lit(1.0) / F.lit(float(fps)))).alias("filled_speed"),
    )
    path = path.withColumn("row", F.struct(*[c for c in path.columns if c not in places]))
    near = associate.nearest_met(path, players, keys=[*by, "frame"], row="row", keep=["field_zone"], prefer=F.col("field_zone") == "strict")
    state = lambda c: associate.ball_state(F.col(f"row.{c}"), F.col("nearest_player_distance_px"), F.col("nearest_player_field_zone"), **limits)[1]
    near = near.select(
        "row.*", (F.col("row.frame") / fps).alias("time"), F.col("nearest_player_id").cast("string").alias("player"), F.col("nearest_player_distance_px").alias("distance"),
        F.when(~F.col("row.made"), state("speed")).alias("state"), F.when(F.col("row.filled").isNotNull(), state("filled_speed")).alias("filled_state"), F.lit(False).alias("end"),
    ).drop("made")
    ends = read.groupBy(*by).agg(F.max("frame").alias("frame")).filter("frame is not null").withColumns({"time": F.col("frame") / fps, "end": F.lit(True)})
    chain = stateful.sweep_summary(materialise(near.unionByName(ends, allowMissingColumns=True), "sweep"), len(settings), by=by, spec=spec)
    out = rows.join(chain, [*by, "setting"], "left").drop("setting")
    return out.fillna(0, [c for c in chain.columns if c not in (*by, "setting")])


def handoff(labels: DataFrame, items: DataFrame, old: DataFrame, new: DataFrame, rerun: Callable[[str], DataFrame], venues: list[str], *, key: str) -> dict[str, DataFrame]:
    """From exported labels to reruns: errors of the labels, metrics of the old and the new model's outcomes, their comparison, and each venue's possessions.

    Every part is a plan of its own; ``explain()`` on it is a dry run.
    """
    checked = evaluate.validate_items(items, evaluate.validate_boxes(labels), key="item")
    compared = evaluate.compare_outcomes(old, new, key=key)
    return {
        "label_errors": evaluate.error_counts(checked), "old_metrics": evaluate.detection_metrics(old, []), "new_metrics": evaluate.detection_metrics(new, []),
        "comparison": compared.groupBy("comparison_result").agg(F.count(F.lit(1)).alias("n")), **{f"possessions_{v}": rerun(v) for v in venues},
    }


#: Wide limits: few frames of these tables hold both ball and players.
_WIDE = stateful.ChainSpec(confirm=2, max_distance=500.0, carry_s=5.0)
_LIMITS = {"max_distance": 800.0, "control_distance": 500.0, "controlled_speed": 9000.0, "transit_speed": 20000.0}
_SETTINGS = [(g, v) for g in (0.5, 0.75, 1.0, 1.5) for v in (1200.0, 1800.0, 2500.0, 3500.0)]


def _inputs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = views.players(s, d).filter("field_zone <> 'off_field'").select("video", "frame", "player_id", "foot_x", "foot_y", "field_zone")
    return views.balls(s, d), p


def clip_pipeline(s: SparkSession, d: str) -> DataFrame:
    balls, players = _inputs(s, d)
    p = clip_possessions(balls, players, views.FPS, by=["video"], spec=_WIDE, **_LIMITS)
    return p.withColumns({c: F.round(c, 6) for c in ("start_time", "end_time", "duration_seconds")})


def settings_sweep(s: SparkSession, d: str) -> DataFrame:
    balls, players = _inputs(s, d)
    out = sweep(balls, players, views.FPS, _SETTINGS, by=["video"], spec=_WIDE, **_LIMITS)
    return out.withColumns({c: F.round(c, 4) for c in ("total_seconds", "median_seconds")})


def handoff_summary(s: SparkSession, d: str) -> DataFrame:
    """The hand-off's parts as one table of step, name and number."""
    labels, old, new = reference.box_labels(s, d), reference._outcomes(s, d, 9, 0.4), reference._outcomes(s, d, 5, 0.3)
    balls, players = _inputs(s, d)
    videos = ["video_a", "video_b"]
    rank = balls.groupBy("video").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "video").limit(2).collect()  # the venues of this run

    def rerun(name: str) -> DataFrame:
        video = dict(zip(videos, [r["video"] for r in rank])).get(name)
        return clip_possessions(balls.filter(F.col("video") == video), players.filter(F.col("video") == video), views.FPS, by=["video"], spec=_WIDE, **_LIMITS)

    parts = handoff(labels, labels.select("item").distinct(), old, new, rerun, videos, key="k")
    out = parts["label_errors"].select(F.lit("label_errors").alias("step"), F.col("error").alias("name"), "n").unionByName(parts["comparison"].select(F.lit("comparison").alias("step"), F.col("comparison_result").alias("name"), "n"))
    for side in ("old_metrics", "new_metrics"):
        m = parts[side].select(F.lit(side).alias("step"), F.expr("stack(2, 'true_positive', true_positive, 'missed_ball', missed_ball) AS (name, n)"))
        out = out.unionByName(m)
    for v in videos:
        out = out.unionByName(parts[f"possessions_{v}"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("possessions").alias("step"), F.lit(v).alias("name"), "n"))
    return out


def control_sweep(s: SparkSession, d: str) -> DataFrame:
    """Possessions under several confirmation lengths in one job, summed up per setting."""
    rows = views.association(s, d)
    parts = [stateful.possession_segments(rows, by=["video"], spec=stateful.ChainSpec(confirm=k)).withColumn("confirm_rows", F.lit(k)) for k in (3, 5, 8)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("confirm_rows").agg(F.count(F.lit(1)).alias("segments"), F.round(F.sum("duration_seconds"), 4).alias("total_seconds"), F.round(F.median("duration_seconds"), 4).alias("median_seconds"))


def event_sessions(s: SparkSession, d: str) -> DataFrame:
    """Six-hour sessions per user; the same function serves a stream."""
    e = table(s, d, "events", "user_id", "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    out = live.session_islands(e, key="user_id", ts="ts", gap="6 hours", late="1 day")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), (F.unix_micros("end") - 6 * 3_600_000_000).alias("last_us"), "n")


def run_stream(df: DataFrame, tag: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now into a table in the shared folder, and reads it.

    In append mode windows that the watermark hasn't passed at the end are left out; complete mode has them too.
    """
    s = df.sparkSession
    base = scratch(s, f"{tag}-{uuid.uuid4().hex}")
    w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "complete":  # the file sink only appends; each batch is the whole result
        s.createDataFrame([], df.schema).write.parquet(f"{base}/out")
        w = w.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/out"))
    else:
        w = w.format("parquet").option("path", f"{base}/out")
    w.start().awaitTermination()
    return s.read.schema(df.schema).parquet(f"{base}/out")


def stream_rates(s: SparkSession, d: str) -> DataFrame:
    """Sliding event rates of the whole events table, also of the windows still open at its end, run as a stream."""
    src = s.readStream.schema(s.read.parquet(f"{d}/events.parquet").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    e = src.select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    return run_stream(live.windowed_rates(e, key="event_type", ts="ts", value="value", size="2 days", slide="1 day", late="1 hour"), "rates", "complete")


def stream_rate_counts(s: SparkSession, d: str) -> DataFrame:
    """``stream_rates`` with its windows in microseconds."""
    return stream_rates(s, d).select("event_type", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (clip_pipeline, settings_sweep, handoff_summary, control_sweep, event_sessions, stream_rates, stream_rate_counts)}

_ALL_PLAYERS = "pl AS (SELECT video, frame, player_id, foot_x, foot_y, field_zone FROM players WHERE field_zone <> 'off_field')"


def _clip_sql(settings: bool) -> str:
    """SQL: the clip pipeline's chain; with ``settings`` every clip once a setting, named "clip|gap|speed"."""
    values = ", ".join(f"({g}::DOUBLE, {v}::DOUBLE)" for g, v in (_SETTINGS if settings else [(1.0, 2500.0)]))
    name = "b.video || '|' || g || '|' || v" if settings else "b.video"
    rows = f"""{views.SQL['balls'].replace('balls AS', 'base AS', 1)}, {views.SQL['players']}, {_ALL_PLAYERS},
balls AS (SELECT {name} AS video, b.video AS place, g, v, detection_id, frame, center_x, center_y FROM base b, (VALUES {values}) st(g, v)),
nx AS (SELECT *, lead(frame) OVER w AS nf, lead(center_x) OVER w AS nx, lead(center_y) OVER w AS ny FROM balls WINDOW w AS (PARTITION BY video ORDER BY frame, detection_id)),
mk AS (SELECT *, nf - frame AS gap, unnest(generate_series(1, nf - frame - 1)) AS k FROM nx WHERE nf - frame > 1 AND nf - frame - 1 <= floor(30 * g) AND sqrt((nx - center_x) * (nx - center_x) + (ny - center_y) * (ny - center_y)) / ((nf - frame) / 30.0::DOUBLE) <= v),
path AS (SELECT video, place, detection_id, CAST(frame + k AS INTEGER) AS frame, center_x + (k / gap::DOUBLE) * (nx - center_x) AS center_x, center_y + (k / gap::DOUBLE) * (ny - center_y) AS center_y, true AS made FROM mk UNION ALL SELECT video, place, detection_id, frame, center_x, center_y, false FROM balls),
lg AS (SELECT *, lag(frame) OVER w AS pf, lag(center_x) OVER w AS px, lag(center_y) OVER w AS py FROM path WINDOW w AS (PARTITION BY video ORDER BY frame, detection_id)),
sp AS (SELECT *, sqrt((center_x - px) * (center_x - px) + (center_y - py) * (center_y - py)) AS di, (frame - pf) / 30.0::DOUBLE AS dt FROM lg), sv AS (SELECT *, CASE WHEN dt > 0 THEN di / dt WHEN dt = 0 AND di > 0 THEN 'inf'::DOUBLE END AS speed FROM sp),
cd AS (SELECT s.video, s.frame, s.detection_id, p.player_id, p.field_zone AS z, sqrt((s.center_x - p.foot_x) * (s.center_x - p.foot_x) + (s.center_y - p.foot_y) * (s.center_y - p.foot_y)) AS d FROM sv s JOIN pl p ON p.video = s.place AND p.frame = s.frame),
nr AS (SELECT video, frame, detection_id, min(struct_pack(d := d, p := player_id)) AS m, min(struct_pack(d := d, p := player_id)) FILTER (z = 'strict') AS q FROM cd GROUP BY 1, 2, 3),
nd AS (SELECT sv.*, CASE WHEN q.d <= 150 THEN q ELSE m END AS b FROM sv LEFT JOIN nr USING (video, frame, detection_id)),
assoc AS (SELECT video, frame, detection_id, frame / 30.0::DOUBLE AS time, CAST(b.p AS VARCHAR) AS player, b.d AS distance, speed, NULL AS zone,
  CASE WHEN b.d IS NULL THEN 'unknown' WHEN speed >= 20000 THEN 'in_transit' WHEN b.d > 800 THEN 'loose_or_unclear' WHEN b.d <= 500 AND (speed IS NULL OR speed <= 9000) THEN 'controlled' ELSE 'loose_or_unclear' END AS state FROM nd)"""
    return automata.chain_sql(2, distance=500, carry=5, order="frame, detection_id", views_sql=rows)


def _setting(chain: str) -> str:
    return chain + inventory.FRAMES_SQL + """, fr AS (SELECT video, count(*) FILTER (possession_state = 'controlled') AS controlled_frames, count(*) FILTER (possession_state = 'in_transit') AS in_transit_frames, count(*) FILTER (possession_state = 'loose_or_unclear') AS loose_or_unclear_frames,
  count(*) FILTER (possession_state = 'pending_control') AS pending_control_frames FROM pf GROUP BY 1), zz AS (SELECT video, count(*) AS segments, round(sum(greatest(0, t1 - t0)), 4) AS total_seconds, round(median(greatest(0, t1 - t0)), 4) AS median_seconds FROM segs GROUP BY 1),
pt AS (SELECT video, count(*) AS path_rows, count(*) FILTER (made) AS interpolated_rows FROM path GROUP BY 1)
SELECT split_part(video, '|', 1) AS video, CAST(split_part(video, '|', 2) AS DOUBLE) AS max_gap_seconds, CAST(split_part(video, '|', 3) AS DOUBLE) AS max_speed, path_rows, interpolated_rows, controlled_frames, in_transit_frames, loose_or_unclear_frames, pending_control_frames,
  coalesce(segments, 0) AS segments, coalesce(total_seconds, 0) AS total_seconds, coalesce(median_seconds, 0) AS median_seconds FROM pt JOIN fr USING (video) LEFT JOIN zz USING (video)"""


_SEGMENT_COLUMNS = "video, segment, player_id, round(t0, 6) AS start_time, round(t1, 6) AS end_time, round(greatest(0, t1 - t0), 6) AS duration_seconds, f0 AS start_frame, f1 AS end_frame, why AS end_reason"

ORACLES = {
    "clip_pipeline": _clip_sql(False) + f" SELECT {_SEGMENT_COLUMNS} FROM segs",
    "settings_sweep": _setting(_clip_sql(True)),
    "control_sweep": " UNION ALL ".join(f"SELECT {k} AS confirm_rows, count(*) AS segments, round(sum(greatest(0, t1 - t0)), 4) AS total_seconds, round(median(greatest(0, t1 - t0)), 4) AS median_seconds FROM ({automata.chain_sql(k)} SELECT * FROM segs)" for k in (3, 5, 8)),
    "stream_rate_counts": """WITH w AS (SELECT event_type, (epoch_us(ts) // 86400000000 - k) * 86400000000 AS start_us, value FROM events, (VALUES (0), (1)) x(k) WHERE ts IS NOT NULL)
      SELECT event_type, start_us, start_us + 172800000000 AS end_us, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2""",
    "event_sessions": """WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 21600000000 THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(t) AS start_us, max(t) AS last_us, count(*) AS n FROM i GROUP BY user_id, k""",
}
