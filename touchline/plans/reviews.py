"""Queries of review preparation, distributions and value zones, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.ids import words_state
from touchline.operators import motion, review, votes
from touchline.plans import automata, reference, views
from touchline.plans.views import with_views


def review_windows(s: SparkSession, d: str) -> DataFrame:
    w = review.segment_windows(automata.possession_segments(s, d).select("video", "segment", "start_time", "end_time"), by=["video"])
    return w.select("video", "segment", "kind", "priority", *[F.round(c, 6).alias(c) for c in ("center_time", "window_start", "window_end")])


def transit_runs(s: SparkSession, d: str) -> DataFrame:
    r = review.flagged_runs(views.association(s, d), F.col("state") == "in_transit", by=["video"])
    return r.select("video", "start_frame", "end_frame", "n")


def fallback_players(s: SparkSession, d: str) -> DataFrame:
    from touchline.operators import associate

    p = views.players(s, d).select("video", "frame", "player_id", "foot_x", "foot_y", "field_zone")
    near = associate.nearest(views.balls(s, d), p, keys=["video", "frame"], row="detection_id", keep=["field_zone"])
    out = review.fallback_nearest(near, p, F.col("nearest_player_field_zone") != "strict", keys=["video", "frame"], row="detection_id", radius=400.0, allowed=F.col("field_zone") == "strict")
    return out.select("detection_id", "before_player_id", "nearest_player_id", F.round("nearest_player_distance_px", 6).alias("distance"), "repaired")


def segment_mid_frames(s: SparkSession, d: str) -> DataFrame:
    seg = automata.possession_segments(s, d).withColumns({"mid": F.floor((F.col("start_frame") + F.col("end_frame")) / 2).cast("int"), "row": F.struct("video", "segment")})
    out = review.at_or_nearest_frame(seg, views.balls(s, d), by=["video"], row="row", frame="mid")
    return out.select("video", F.col("row.segment").alias("segment"), "mid", "nearest_frame")


def harvest_frames(s: SparkSession, d: str) -> DataFrame:
    b = views.balls(s, d).withColumn("area", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    best = b.groupBy("video", "frame").agg(F.max(F.struct("confidence", "detection_id", "area")).alias("b")).select("video", "frame", "b.confidence", "b.area")
    span = b.groupBy("video").agg(F.min("frame").alias("a"), F.max("frame").alias("z"))
    frames = span.select("video", F.explode(F.sequence("a", "z")).alias("frame"))
    return review.harvest(frames, best, by=["video"])


def step_distribution(s: SparkSession, d: str) -> DataFrame:
    m = motion.motion(views.balls(s, d), views.FPS, by=["video"], tie=["detection_id"])
    m = m.withColumn("step", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2))
    out = review.describe(m, "step", by=["video"])
    return out.select("video", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


def unstable_rows(s: SparkSession, d: str) -> DataFrame:
    p = views.players(s, d)
    gone = votes.track_stability(p, views.FPS, by=["video"], track="player_id").filter("stability_flag <> 'stable'").select("video", "player_id")
    kept = p.join(gone, ["video", "player_id"], "left_anti").groupBy("video").agg(F.count(F.lit(1)).alias("kept"))
    return kept.join(p.join(gone, ["video", "player_id"], "left_semi").groupBy("video").agg(F.count(F.lit(1)).alias("removed")), "video", "full").fillna(0)


def transition_frames(s: SparkSession, d: str) -> DataFrame:
    """State transitions as two rows each: the frame before and the frame of the switch with the state seen there."""
    t = reference.state_transitions(s, d)
    return t.select("video", F.expr("stack(2, 'before', before_frame, before_state, 'switch', switch_frame, switch_state) AS (side, frame, state)"))


def zone_value(s: SparkSession, d: str) -> DataFrame:
    """Value of six equal zones along the picture; beyond the last there is none."""
    zones = F.create_map(*[x for k, v in enumerate((0.01, 0.02, 0.04, 0.08, 0.15, 0.30)) for x in (F.lit(k).cast("long"), F.lit(v))])
    a = reference._steps(s, d)
    at = lambda c: F.coalesce(F.try_element_at(zones, F.floor(F.col(c) / 320)), F.lit(0.0))
    a = a.withColumn("added", at("end_x") - at("start_x"))
    return a.groupBy("video", "event_type").agg(F.count(F.lit(1)).alias("actions"), F.round(F.sum("added"), 6).alias("total_value"))


def status_counts(s: SparkSession, d: str) -> DataFrame:
    from touchline.sources.tables import table

    return table(s, d, "possession_labels", "review_status", "state").groupBy(words_state("review_status").alias("status"), "state").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (review_windows, transit_runs, fallback_players, segment_mid_frames, harvest_frames, step_distribution, unstable_rows, transition_frames, zone_value, status_counts)}

_SEGS = automata._CHAIN_SQL + ", sg AS (SELECT video, segment, round(t0, 6) AS a, round(t1, 6) AS b, f0, f1 FROM segs)"
ORACLES = {
    "review_windows": _SEGS + """ SELECT video, segment, 'short_controlled_segment' AS kind, 0 AS priority, a AS center_time, round(greatest(a - 2, 0), 6) AS window_start, round(b + 2, 6) AS window_end FROM sg WHERE b - a < 0.5
      UNION ALL SELECT video, segment, 'segment_start', 1, a, round(greatest(a - 1.5, 0), 6), round(a + 1.5, 6) FROM sg UNION ALL SELECT video, segment, 'segment_end', 2, b, round(greatest(b - 1.5, 0), 6), round(b + 1.5, 6) FROM sg""",
    "transit_runs": with_views("assoc") + """, r AS (SELECT video, frame, frame - row_number() OVER (PARTITION BY video ORDER BY frame) AS g FROM assoc WHERE state = 'in_transit') SELECT video, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n FROM r GROUP BY video, g""",
    "fallback_players": with_views("balls", "players") + """, c AS (SELECT b.detection_id, p.player_id, p.field_zone AS z, sqrt((b.center_x - p.foot_x) * (b.center_x - p.foot_x) + (b.center_y - p.foot_y) * (b.center_y - p.foot_y)) AS d FROM balls b JOIN players p USING (video, frame)),
      f AS (SELECT detection_id, min(struct_pack(d := d, p := player_id, z := z)) AS m FROM c GROUP BY 1), n AS (SELECT c.detection_id, min(struct_pack(d := c.d, p := c.player_id)) AS q FROM c JOIN f USING (detection_id) WHERE f.m.z <> 'strict' AND c.z = 'strict' AND c.d <= 400 AND c.player_id <> f.m.p GROUP BY 1)
      SELECT b.detection_id, f.m.p AS before_player_id, coalesce(n.q.p, f.m.p) AS nearest_player_id, round(coalesce(n.q.d, f.m.d), 6) AS distance, n.q IS NOT NULL AS repaired FROM balls b LEFT JOIN f USING (detection_id) LEFT JOIN n USING (detection_id)""",
    "segment_mid_frames": _SEGS.replace("WITH RECURSIVE ", "WITH RECURSIVE " + views.SQL["balls"] + ",\n", 1) + """, m AS (SELECT video, segment, CAST(floor((f0 + f1) / 2.0) AS INTEGER) AS mid FROM sg)
      SELECT m.video, segment, mid, arg_min(b.frame, struct_pack(d := abs(b.frame - mid), f := b.frame)) AS nearest_frame FROM m LEFT JOIN balls b ON b.video = m.video GROUP BY 1, 2, 3""",
    "harvest_frames": with_views("balls") + """, f AS (SELECT video, unnest(generate_series(min(frame), max(frame))) AS frame FROM balls GROUP BY video), b AS (SELECT video, frame, max(confidence) AS c, arg_max((x2 - x1) * (y2 - y1), struct_pack(a := confidence, b := detection_id)) AS area FROM balls GROUP BY 1, 2),
      j AS (SELECT f.video, f.frame, c, area FROM f LEFT JOIN b USING (video, frame) WHERE f.frame % 10 = 0), k AS (SELECT *, count(c) OVER (PARTITION BY video ORDER BY frame) AS g FROM j),
      s AS (SELECT *, CASE WHEN c IS NULL THEN count(*) FILTER (c IS NULL) OVER (PARTITION BY video, g ORDER BY frame) END AS streak FROM k), h AS (SELECT video, frame, frame - lag(frame) OVER (PARTITION BY video ORDER BY frame) AS gap FROM j WHERE c IS NOT NULL)
      SELECT video, frame, 'negative_frames' AS reason FROM s WHERE streak % 5 = 0 UNION ALL SELECT video, frame, 'tiny_ball' FROM j WHERE area < 150 UNION ALL SELECT video, frame, 'low_confidence' FROM j WHERE c < 0.4
      UNION ALL SELECT video, frame, 'review_all' FROM j WHERE c IS NOT NULL AND frame % 100 = 0 UNION ALL SELECT video, frame, 'tracking_failures' FROM h WHERE gap > 75""",
    "step_distribution": reference._MOTION + """, st AS (SELECT video, sqrt(dx * dx + dy * dy) AS s FROM moved) SELECT video, count(s) AS n, round(avg(s), 4) AS mean, round(stddev_samp(s), 4) AS std, round(min(s), 4) AS min, round(quantile_cont(s, 0.25), 4) AS q25,
      round(quantile_cont(s, 0.5), 4) AS q50, round(quantile_cont(s, 0.75), 4) AS q75, round(max(s), 4) AS max FROM st GROUP BY video""",
    "unstable_rows": reference.ORACLES["track_stability"].split("SELECT video, player_id, detections")[0] + """SELECT p.video, count(*) FILTER (a.detections >= 60 AND a.cov >= 0.5 AND a.big_jump_count < 3) AS kept, count(*) FILTER (NOT (a.detections >= 60 AND a.cov >= 0.5 AND a.big_jump_count < 3)) AS removed
      FROM players p JOIN a USING (video, player_id) GROUP BY 1""",
    "transition_frames": reference.ORACLES["state_transitions"].replace("SELECT video, pf AS before_frame", ", x AS (SELECT video, pf AS before_frame", 1) + ") SELECT video, 'before' AS side, before_frame AS frame, before_state AS state FROM x UNION ALL SELECT video, 'switch', switch_frame, switch_state FROM x",
    "zone_value": reference._STEPS + """, z AS (SELECT *, CAST(floor(start_x / 320) AS INTEGER) AS a, CAST(floor(end_x / 320) AS INTEGER) AS b FROM acts), v AS (SELECT * FROM (VALUES (0, 0.01::DOUBLE), (1, 0.02), (2, 0.04), (3, 0.08), (4, 0.15), (5, 0.30)) t(k, v))
      SELECT video, event_type, count(*) AS actions, round(sum(coalesce(e.v, 0) - coalesce(s.v, 0)), 6) AS total_value FROM z LEFT JOIN v s ON s.k = z.a LEFT JOIN v e ON e.k = z.b GROUP BY 1, 2""",
    "status_counts": f"SELECT {views._state_sql('review_status')} AS status, state, count(*) AS n FROM possession_labels GROUP BY 1, 2",
}
