"""Queries that go through file sources and sinks: tables written in an outside format and read again, beside their SQL over the tables themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import motion, stateful
from touchline.plans import automata, reference, views
from touchline.plans.views import FPS, with_views
from touchline.session import scratch
from touchline.sources import files
from touchline.sources.tables import table


def _place(s: SparkSession, name: str) -> str:
    return scratch(s, f"{name}-{uuid.uuid4().hex}")


def csv_balls(s: SparkSession, d: str) -> DataFrame:
    """Ball readings as CSV of two venues, read through the source registry: only balls, from confidence 0.2 on."""
    columns = ["venue", "video", "frame", "time_seconds", "object_type", "confidence", "x1", "y1", "x2", "y2", "center_x", "center_y"]
    b = table(s, d, "ball_detections", *columns)
    paths = {}
    for name, part in (("north", F.pmod(F.xxhash64("video", "frame"), F.lit(2)) == 0), ("south", F.pmod(F.xxhash64("video", "frame"), F.lit(2)) == 1)):
        paths[name] = _place(s, f"csv-{name}")
        files.write_csv(b.filter(part), paths[name], columns)
    back = files.read_sources(s, [f"{n}:{p}" for n, p in paths.items()], files.SCHEMAS["ball_detections"])
    balls = files.detections(back, ("ball",), 0.2)
    return balls.groupBy("video").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("venue").alias("venues"), F.count("center_x").alias("with_place"), F.round(F.sum("center_x"), 4).alias("sum_x"), F.max("frame").alias("last_frame"))


def csv_players(s: SparkSession, d: str) -> DataFrame:
    """Players as CSV, in a time window of [10 s, 60 s) of 30 frames a second."""
    columns = ["venue", "video", "frame", "time_seconds", "object_type", "confidence", "x1", "y1", "x2", "y2", "center_x", "center_y", "player_id"]
    path = _place(s, "csv-players")
    files.write_csv(table(s, d, "player_detections", *columns), path, columns)
    p = files.detections(files.read_csv(s, path, files.SCHEMAS["player_detections"]), ("player", "person"))
    return files.frame_window(p, 10.0, 60.0, FPS).groupBy("video").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("player_id").alias("ids"), F.round(F.sum("x1"), 4).alias("sum_x1"))


def mask_frames(s: SparkSession, d: str) -> DataFrame:
    """Boxes of ball readings as field masks in CSV, those without confidence without polygon; the last mask of each frame."""
    b = views.balls(s, d)
    point = lambda x, y: F.concat(F.format_string("%.2f", x), F.lit(","), F.format_string("%.2f", y))
    ring = F.concat_ws(";", *[point(F.col(x), F.col(y)) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))])
    has_box = F.col("x1").isNotNull() & F.col("y1").isNotNull() & F.col("x2").isNotNull() & F.col("y2").isNotNull()
    masks = b.select("frame", (F.col("frame") / FPS + F.col("detection_id") / 1e9).alias("time_sec"), F.when(F.col("confidence").isNotNull() & has_box, ring).alias("field_polygon"), F.lit(4).alias("num_points"), "confidence", F.col("video").alias("status"))
    path = _place(s, "masks")
    files.write_csv(masks, path)
    now = files.current_masks(files.read_csv(s, path, files.SCHEMAS["field_masks"]), by=["status"])
    return now.select(F.col("status").alias("video"), "frame", F.round("confidence", 6).alias("confidence"), (F.size(F.split("tolerant_field_polygon", ";"))).alias("n_points"))


def label_files(s: SparkSession, d: str) -> DataFrame:
    """Labels as one JSON document a half, read again and made regular."""
    seg = F.struct("id", "start", "end", "state", "team", "player", "confidence", F.lit("").alias("notes"), "half", F.lit("").alias("source_action_id"))
    docs = views.labels(s, d).groupBy("match_id", "half").agg(F.collect_list(seg).alias("segments"))
    path = _place(s, "labels")
    files.write_each(docs.select(F.lit("0.1").alias("schema_version"), F.lit("").alias("clip"), "match_id", "half", F.lit("reviewed").alias("review_status"), "segments"), path)
    back = files.normal_segments(files.read_labels(s, path))
    return back.select("match_id", "half", "id", "state", *[F.round(c, 6).alias(f"{c}_at") for c in ("start", "end")], F.round("confidence", 6).alias("confidence"))


def action_files(s: SparkSession, d: str) -> DataFrame:
    """Ball actions as annotated documents, read again: half, seconds and label; nameless halves and times are left out."""
    a = views.actions(s, d).filter("source_time is not null and source_time >= 0 and half is not null")
    ms = F.round(F.col("source_time") * 1000).cast("long")
    clock = F.concat(F.col("half").cast("string"), F.lit(" - "), F.format_string("%02d:%02d", F.floor(F.col("source_time") / 60).cast("int"), F.floor(F.col("source_time") % 60).cast("int")))
    item = F.struct(F.col("original_label").alias("label"), clock.alias("gameTime"), ms.cast("string").alias("position"), F.col("team"), F.col("player").alias("player_id"), "visibility")
    path = _place(s, "actions")
    files.write_each(a.groupBy("match_id").agg(F.lit(25.0).alias("fps"), F.collect_list(item).alias("annotations")), path)
    back = files.read_actions(s, path)
    return back.groupBy("match_id", "half", "original_label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("source_time"), 2).alias("seconds"))


def box_files(s: SparkSession, d: str) -> DataFrame:
    """Boxes as label text files, some lines broken, parsed again into errors and pixels."""
    b = views.balls(s, d)
    num = lambda c: F.format_string("%.8f", c)
    line = F.concat_ws(" ", F.lit("0"), num(F.col("center_x") / 1920), num(F.col("center_y") / 1080), num((F.col("x2") - F.col("x1")) / 1920), num((F.col("y2") - F.col("y1")) / 1080))
    line = F.when(F.col("detection_id") % 31 == 0, "0 0.5 0.5").when(F.col("detection_id") % 37 == 0, "0 a 0.5 0.1 0.1").when(F.col("x1").isNull() | F.col("x2").isNull() | F.col("y1").isNull() | F.col("y2").isNull(), "").otherwise(line)
    path = _place(s, "boxes")
    b.select(line.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 5000).text(path)
    rows = files.read_box_labels(s, path)
    pixels = files.pixel_boxes(rows, F.lit(1920.0), F.lit(1080.0)).groupBy("parse_error").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x1"), 1).alias("sum_x1"))
    return rows.filter("parse_error <> ''").groupBy("parse_error").agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("sum_x1")).unionByName(pixels)


def standard_feed(s: SparkSession, d: str) -> DataFrame:
    """Ball actions in a provider's columns, made standard."""
    a = views.actions(s, d).filter("source_time is not null and source_time >= 0")
    t = F.round(F.col("source_time") * 1000).cast("long")
    clock = F.format_string("%02d:%02d:%02d.%03d", F.floor(t / 3_600_000), F.floor(t / 60_000) % 60, F.floor(t / 1000) % 60, t % 1000)
    none = F.lit(None).cast("double")
    feed = a.select("match_id", F.col("half").alias("period"), clock.alias("timestamp"), F.col("team").alias("team_name"), F.col("player").alias("player_name"), F.col("original_label").alias("type_name"), none.alias("x"), none.alias("y"), none.alias("end_x"),
                    none.alias("end_y"), F.when(F.col("visibility") != "visible", F.lit("Incomplete")).alias("outcome_name"), F.lit(0).alias("possession"), "id")
    out = files.standard_events(feed)
    return out.select("match_id", "period", F.round("time_seconds", 3).alias("time_seconds"), "team", "player", "event_type", "outcome", F.col("source_event_id").alias("event_id"))


def split_rows(s: SparkSession, d: str) -> DataFrame:
    """Readings split into kept and removed ones by one pass, counted from the files."""
    path = _place(s, "split")
    files.split_sink(views.balls(s, d), F.col("confidence") < 0.3, path)
    return s.read.parquet(path).groupBy(F.col("part").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("center_x"), 4).alias("sum_x"))


def segment_labels(s: SparkSession, d: str) -> DataFrame:
    """The chain's possessions as label rows."""
    seg = stateful.possession_segments(views.association(s, d), by=["video"], spec=automata.CHAIN)
    seg = seg.withColumn("segment_id", F.concat_ws(":", "video", F.format_string("possession_%04d", "segment")))
    return files.labels_from_segments(seg).select("id", *[F.round(c, 6).alias(f"{c}_at") for c in ("start", "end")], "state", "team", "player", "confidence", "half")


def clock_sheet(s: SparkSession, d: str) -> DataFrame:
    """A review sheet's clock: minutes and seconds, cut down."""
    t = motion.trajectories(views.balls(s, d), by=["video"], tie=["detection_id"])
    sec = F.col("start_time").cast("int")
    return t.select("video", "segment_id", F.format_string("%d:%02d", F.floor(sec / 60), sec % 60).alias("starts"), F.lit("").alias("review_label"), F.lit("").alias("review_notes"))


QUERIES = {f.__name__: f for f in (csv_balls, csv_players, mask_frames, label_files, action_files, box_files, standard_feed, split_rows, segment_labels, clock_sheet)}

_NUM = lambda c: f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END"
ORACLES = {
    "csv_balls": f"""SELECT video, count(*) AS n, 2 AS venues, count({_NUM('center_x')}) AS with_place, round(sum({_NUM('center_x')}), 4) AS sum_x, max(frame) AS last_frame FROM ball_detections WHERE lower(trim(object_type)) = 'ball' AND coalesce({_NUM('confidence')}, 1) >= 0.2 GROUP BY 1""",
    "csv_players": f"""SELECT video, count(*) AS n, count(DISTINCT player_id) AS ids, round(sum({_NUM('x1')}), 4) AS sum_x1 FROM player_detections WHERE lower(trim(object_type)) IN ('player', 'person') AND frame >= 300 AND frame < 1800 GROUP BY 1""",
    "mask_frames": with_views("balls") + """SELECT video, frame, round(confidence, 6) AS confidence, 4 AS n_points FROM balls WHERE confidence IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND y1 IS NOT NULL AND y2 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY video, frame ORDER BY detection_id DESC) = 1""",
    "label_files": with_views("labels") + """SELECT match_id, half, id, coalesce(state, 'unknown') AS state, round(s, 6) AS start_at, round(e, 6) AS end_at, round(coalesce(confidence, 1), 6) AS confidence FROM labels WHERE s IS NOT NULL AND e IS NOT NULL AND e > s""",
    "action_files": with_views("actions") + """SELECT match_id, half, original_label, count(*) AS n, round(sum(round(source_time * 1000) / 1000), 2) AS seconds FROM actions WHERE source_time IS NOT NULL AND source_time >= 0 GROUP BY 1, 2, 3""",
    "box_files": with_views("balls") + """, l AS (SELECT *, CASE WHEN detection_id % 31 = 0 THEN 'too_few_columns' WHEN detection_id % 37 = 0 THEN 'non_numeric_value' ELSE '' END AS parse_error FROM balls)
      SELECT parse_error, count(*) AS n, CASE WHEN parse_error = '' THEN round(sum(center_x - (x2 - x1) / 2), 1) END AS sum_x1 FROM l WHERE parse_error <> '' OR (x1 IS NOT NULL AND x2 IS NOT NULL AND y1 IS NOT NULL AND y2 IS NOT NULL) GROUP BY 1""",
    "standard_feed": with_views("actions") + """SELECT match_id, half AS period, round(source_time, 3) AS time_seconds, team, player, lower(original_label) AS event_type, CASE WHEN visibility <> 'visible' THEN 'incomplete' ELSE 'successful' END AS outcome, id AS event_id FROM actions WHERE source_time IS NOT NULL AND source_time >= 0""",
    "split_rows": with_views("balls") + "SELECT CASE WHEN confidence < 0.3 THEN 'removed' ELSE 'kept' END AS part, count(*) AS n, round(sum(center_x), 4) AS sum_x FROM balls GROUP BY 1",
    "segment_labels": automata._CHAIN_SQL + """ SELECT video || ':' || printf('possession_%04d', segment) AS id, round(t0, 6) AS start_at, round(t1, 6) AS end_at, 'controlled' AS state, 'unknown' AS team, player_id AS player, 0.25::DOUBLE AS confidence, 1 AS half FROM segs WHERE t1 > t0""",
    "clock_sheet": reference.ORACLES["trajectory_segments"].split("SELECT video, segment_id, f0")[0] + """SELECT video, segment_id, printf('%d:%02d', CAST(trunc(t0) AS BIGINT) // 60, CAST(trunc(t0) AS BIGINT) % 60) AS starts, '' AS review_label, '' AS review_notes
      FROM (SELECT *, f0 / 30.0::DOUBLE AS t0 FROM sped WHERE dur BETWEEN 0.5 AND 5.0 AND dist >= 40)""",
}
