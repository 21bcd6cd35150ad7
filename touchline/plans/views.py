"""The domain tables as the operators' entities: latest deliveries, conformed columns; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.geometry import field_zone
from touchline.functions.ids import clean_id, finite, words_state
from touchline.sources.tables import latest, table

FPS = 30.0
STRICT = [(150.0, 220.0), (1750.0, 200.0), (1850.0, 950.0), (80.0, 930.0)]
TOLERANT = [(120.0, 200.0), (1790.0, 180.0), (1890.0, 980.0), (40.0, 960.0)]


def balls(spark: SparkSession, d: str) -> DataFrame:
    cols = ["video", "frame", "confidence", "x1", "y1", "x2", "y2", "center_x", "center_y"]
    df = latest(table(spark, d, "ball_detections", "detection_id", "loaded_at", *cols), ["detection_id"], "loaded_at", cols)
    df = df.withColumns({c: finite(c) for c in cols[2:]}).filter("video is not null and frame is not null and center_x is not null and center_y is not null")
    return df.select("detection_id", *cols, (F.col("frame") / FPS).alias("time_seconds"), F.lit("ball").alias("object_type"))


def players(spark: SparkSession, d: str) -> DataFrame:
    cols = ["confidence", "x1", "y1", "x2", "y2", "foot_x", "foot_y"]
    df = latest(table(spark, d, "player_detections", "video", "frame", "player_id", "loaded_at", *cols), ["video", "frame", "player_id"], "loaded_at", cols)
    df = df.withColumns({c: finite(c) for c in cols})
    df = df.withColumns({"foot_x": F.coalesce("foot_x", (F.col("x1") + F.col("x2")) / 2), "foot_y": F.coalesce("foot_y", "y2")})
    df = df.filter("foot_x is not null and foot_y is not null")
    return df.select("video", "frame", "player_id", *cols, (F.col("frame") / FPS).alias("time_seconds"), field_zone("foot_x", "foot_y", STRICT, TOLERANT).alias("field_zone"))


def association(spark: SparkSession, d: str) -> DataFrame:
    cols = ["nearest_player_id", "nearest_player_distance_px", "nearest_player_field_zone", "ball_speed_px_per_second", "ball_state"]
    df = table(spark, d, "association", "video", "frame", "loaded_at", *cols).filter("video is not null and frame is not null")
    df = latest(df, ["video", "frame"], "loaded_at", cols)
    player = clean_id("nearest_player_id")
    return df.select(
        "video", "frame", (F.col("frame") / FPS).alias("time"), F.when(~F.lower(player).isin("", "none", "nan"), player).alias("player"),
        finite("nearest_player_distance_px").alias("distance"), finite("ball_speed_px_per_second").alias("speed"), F.col("nearest_player_field_zone").alias("zone"),
        F.coalesce(words_state("ball_state"), F.lit("unknown")).alias("state"), F.lit(False).alias("excluded"), F.lit(False).alias("repaired"),
    )


def labels(spark: SparkSession, d: str) -> DataFrame:
    cols = ["start", "end", "state", "team", "player", "confidence", "review_status"]
    df = table(spark, d, "possession_labels", "match_id", "half", "id", "loaded_at", *cols).withColumn("half", F.coalesce("half", F.lit(1)))
    df = latest(df, ["match_id", "half", "id"], "loaded_at", cols).filter(F.coalesce(words_state("review_status"), F.lit("")) != "withdrawn")
    return df.select("match_id", "half", "id", finite("start").alias("start"), finite("end").alias("end"), "state", "team", clean_id("player").alias("player"), finite("confidence").alias("confidence"))


def actions(spark: SparkSession, d: str) -> DataFrame:
    cols = ["source_time", "original_label", "team", "player", "visibility"]
    df = table(spark, d, "ball_actions", "match_id", "half", "id", "loaded_at", *cols).withColumn("half", F.coalesce("half", F.lit(1)))
    return latest(df, ["match_id", "half", "id"], "loaded_at", cols).withColumn("source_time", finite("source_time")).withColumn("player", clean_id("player")).drop("loaded_at")


def _inside(x: str, y: str, polygon: list[tuple[float, float]]) -> str:
    """SQL: even-odd test."""
    terms = []
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1]):
        if ay != by:
            terms.append(f"CAST({y} >= {min(ay, by)} AND {y} < {max(ay, by)} AND {x} < {ax}::DOUBLE + ({y} - {ay}::DOUBLE) * ({bx}::DOUBLE - {ax}::DOUBLE) / ({by}::DOUBLE - {ay}::DOUBLE) AS INTEGER)")
    return f"(({' + '.join(terms)}) % 2 = 1)"


def _fin(c: str) -> str:
    return f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END"


_CLEAN = "CASE WHEN {0} IS NULL THEN '' WHEN try_cast(trim({0}) AS DOUBLE) = floor(try_cast(trim({0}) AS DOUBLE)) AND NOT isnan(try_cast(trim({0}) AS DOUBLE)) THEN CAST(CAST(try_cast(trim({0}) AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE trim({0}) END"


def clean_sql(c: str) -> str:
    return _CLEAN.format(c)


def _state_sql(c: str) -> str:
    return f"nullif(regexp_replace(regexp_replace(lower(trim({c})), '[\\s_-]+', '_', 'g'), '^_+|_+$', '', 'g'), '')"


SQL = {
    "balls": f"""balls AS (SELECT * FROM (
        SELECT detection_id, video, frame, {_fin('confidence')} AS confidence, {_fin('x1')} AS x1, {_fin('y1')} AS y1, {_fin('x2')} AS x2, {_fin('y2')} AS y2, {_fin('center_x')} AS center_x,
          {_fin('center_y')} AS center_y, frame / 30.0::DOUBLE AS time_seconds FROM ball_detections QUALIFY row_number() OVER (PARTITION BY detection_id ORDER BY loaded_at DESC, frame DESC NULLS LAST, confidence DESC NULLS LAST, x1 DESC NULLS LAST) = 1)
        WHERE video IS NOT NULL AND frame IS NOT NULL AND center_x IS NOT NULL AND center_y IS NOT NULL)""",
    "players": f"""players AS (SELECT *, CASE WHEN {_inside('foot_x', 'foot_y', STRICT)} THEN 'strict' WHEN {_inside('foot_x', 'foot_y', TOLERANT)} THEN 'tolerant' ELSE 'off_field' END AS field_zone FROM (
        SELECT video, frame, player_id, {_fin('confidence')} AS confidence, {_fin('x1')} AS x1, {_fin('y1')} AS y1, {_fin('x2')} AS x2, {_fin('y2')} AS y2,
          coalesce({_fin('foot_x')}, (x1 + x2) / 2) AS foot_x, coalesce({_fin('foot_y')}, y2) AS foot_y, frame / 30.0::DOUBLE AS time_seconds
        FROM player_detections QUALIFY row_number() OVER (PARTITION BY video, frame, player_id ORDER BY loaded_at DESC, player_detections.confidence DESC NULLS LAST, player_detections.x1 DESC NULLS LAST, player_detections.y1 DESC NULLS LAST) = 1) WHERE foot_x IS NOT NULL AND foot_y IS NOT NULL)""",
    "assoc": f"""assoc AS (SELECT video, frame, frame / 30.0::DOUBLE AS time, CASE WHEN lower(p) IN ('', 'none', 'nan') THEN NULL ELSE p END AS player, distance, speed, zone, coalesce(s, 'unknown') AS state FROM (
        SELECT video, frame, {clean_sql('nearest_player_id')} AS p, {_fin('nearest_player_distance_px')} AS distance, {_fin('ball_speed_px_per_second')} AS speed, nearest_player_field_zone AS zone, {_state_sql('ball_state')} AS s
        FROM association WHERE video IS NOT NULL AND frame IS NOT NULL QUALIFY row_number() OVER (PARTITION BY video, frame ORDER BY loaded_at DESC, nearest_player_id DESC NULLS LAST, nearest_player_distance_px DESC NULLS LAST) = 1))""",
    "labels": f"""labels AS (SELECT * EXCLUDE (rs) FROM (
        SELECT match_id, coalesce(half, 1) AS half, id, {_fin('"start"')} AS s, {_fin('"end"')} AS e, state, team, {clean_sql('player')} AS player, {_fin('confidence')} AS confidence, {_state_sql('review_status')} AS rs
        FROM possession_labels QUALIFY row_number() OVER (PARTITION BY match_id, coalesce(half, 1), id ORDER BY loaded_at DESC, "start" DESC NULLS LAST, "end" DESC NULLS LAST, possession_labels.state DESC NULLS LAST, possession_labels.team DESC NULLS LAST, possession_labels.player DESC NULLS LAST, possession_labels.confidence DESC NULLS LAST) = 1) WHERE coalesce(rs, '') <> 'withdrawn')""",
    "actions": f"""actions AS (SELECT match_id, coalesce(half, 1) AS half, id, {_fin('source_time')} AS source_time, original_label, team, {clean_sql('player')} AS player, visibility
        FROM ball_actions QUALIFY row_number() OVER (PARTITION BY match_id, coalesce(half, 1), id ORDER BY loaded_at DESC, ball_actions.source_time DESC NULLS LAST, original_label DESC NULLS LAST, team DESC NULLS LAST, ball_actions.player DESC NULLS LAST, visibility DESC NULLS LAST) = 1)""",
}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
