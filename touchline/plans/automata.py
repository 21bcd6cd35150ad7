"""Queries of the sequential automata, clustering and streaming, with SQL where SQL can step rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import associate, stateful
from touchline.plans import views
from touchline.plans.views import with_views
from touchline.sources.tables import table

CHAIN = stateful.ChainSpec()


def possession_segments(s: SparkSession, d: str) -> DataFrame:
    p = stateful.possession_segments(views.association(s, d), by=["video"], spec=CHAIN)
    return p.select("video", "segment", "player_id", F.round("start_time", 6).alias("start_time"), F.round("end_time", 6).alias("end_time"), F.round("duration_seconds", 6).alias("duration_seconds"), "start_frame", "end_frame", "end_reason")


def possession_frames(s: SparkSession, d: str) -> DataFrame:
    p = stateful.possession_frames(views.association(s, d), by=["video"], spec=CHAIN)
    return p.select("video", "frame", "possession_state", "possession_player", "segment", "transition_reason")


def possession_summary(s: SparkSession, d: str) -> DataFrame:
    p = possession_segments(s, d)
    return p.groupBy("video").agg(F.count(F.lit(1)).alias("segments"), F.round(F.sum("duration_seconds"), 4).alias("total_seconds"), F.round(F.median("duration_seconds"), 4).alias("median_seconds"))


def smooth_states(s: SparkSession, d: str) -> DataFrame:
    return stateful.smooth_states(views.association(s, d), by=["video"]).select("video", "frame", "smoothed_state", "smoothing_reason")


def _candidates(s: SparkSession, d: str, least: float, most: float) -> DataFrame:
    b = views.balls(s, d).filter(F.col("confidence") >= least)
    b = b.withColumn("box_size", (F.col("x2") - F.col("x1") + F.col("y2") - F.col("y1")) / 2).filter(F.col("box_size") <= most)
    return associate.player_penalty(b, views.players(s, d), by=["video"], row="detection_id")


def ball_path(s: SparkSession, d: str) -> DataFrame:
    return stateful.ball_path(_candidates(s, d, 0.25, 140.0), by=["video"], row="detection_id").select("video", "frame", "detection_id")


def ball_path_legacy(s: SparkSession, d: str) -> DataFrame:
    return stateful.ball_path(_candidates(s, d, 0.10, 80.0), by=["video"], row="detection_id", spec=stateful.LEGACY).select("video", "frame", "detection_id")


def player_tracks(s: SparkSession, d: str) -> DataFrame:
    """Tracks of all players in all frames, however crowded."""
    t = stateful.track_players(views.players(s, d), by=["video"])
    return t.select("video", "frame", "player_id", "track_id", "track_status", "track_age", F.round("match_score", 6).alias("match_score"))


def appearance_clusters(s: SparkSession, d: str) -> DataFrame:
    """Two k-means clusters of appearance vectors, named by their centres' first component, with the margin to the other centre."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = table(s, d, "embeddings", "vec_id", "embedding").withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    model = KMeans(k=2, seed=7, maxIter=20).fit(v)
    centres = sorted((c.tolist() for c in model.clusterCenters()), key=lambda c: -c[0])
    far = lambda c: F.sqrt(F.aggregate(F.zip_with("embedding", F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda x, y: x + y))
    v = v.withColumns({"d0": far(centres[0]), "d1": far(centres[1])})
    margin = F.abs(F.col("d0") - F.col("d1")) / F.greatest("d0", "d1")
    return v.select("vec_id", F.when(margin < 0.15, "unknown").when(F.col("d0") < F.col("d1"), "cluster_a").otherwise("cluster_b").alias("team"), F.round(margin, 6).alias("confidence"))


QUERIES = {f.__name__: f for f in (possession_segments, possession_frames, possession_summary, smooth_states, ball_path, ball_path_legacy, player_tracks, appearance_clusters)}

def chain_sql(confirm: int, source: str = "assoc", before: str = "", distance: float = 80, carry: float = 2, order: str = "frame", views_sql: str | None = None) -> str:
    """The possession chain as recursive SQL over ``source`` (default: the latest association rows); ``before`` are further views it needs."""
    head = "WITH RECURSIVE " + (before + ",\n" if before else "") + (views.SQL["assoc"] if views_sql is None else views_sql) + """,
o AS (SELECT video, frame, time, player, state, row_number() OVER (PARTITION BY video ORDER BY __ORDER__) AS rn, coalesce(state = 'controlled' AND player IS NOT NULL AND distance <= __DISTANCE__, false) AS ev FROM __SOURCE__ q),
rec AS (
  SELECT DISTINCT video, 0::BIGINT AS rn, NULL::VARCHAR AS owner, NULL::VARCHAR AS cand, 0 AS seen, NULL::DOUBLE AS cfrom, 0 AS seg, NULL::DOUBLE AS t0, NULL::INTEGER AS f0,
    NULL::VARCHAR AS c_owner, NULL::DOUBLE AS c_t0, NULL::INTEGER AS c_f0, NULL::DOUBLE AS c_t1, NULL::INTEGER AS c_f1, 0 AS c_seg, NULL::VARCHAR AS c_why FROM o
  UNION ALL
  SELECT video, rn, CASE WHEN conf THEN player WHEN tout THEN NULL ELSE owner END, CASE WHEN conf OR NOT ev OR player = coalesce(owner, '') THEN NULL ELSE player END, CASE WHEN conf THEN 0 ELSE n END, CASE WHEN tout THEN NULL ELSE cf END,
    seg + conf::INT, CASE WHEN conf THEN time ELSE t0 END, CASE WHEN conf THEN frame ELSE f0 END,
    CASE WHEN (conf OR tout) THEN owner END, t0, f0, time, frame, seg, CASE WHEN conf THEN 'confirmed_new_controller' WHEN tout THEN 'carry_forward_timeout' END
  FROM (SELECT *, ev AND player IS DISTINCT FROM owner AND n >= __K__ AS conf, carry AND time - cf > __CARRY__ AS tout FROM (
    SELECT r.video, o.rn, r.owner, r.seg, r.t0, r.f0, o.player, o.time, o.frame, o.ev, NOT o.ev AND r.owner IS NOT NULL AND o.state IN ('in_transit', 'loose_or_unclear') AS carry,
      CASE WHEN NOT o.ev OR o.player = r.owner THEN 0 WHEN o.player = r.cand THEN r.seen + 1 ELSE 1 END AS n,
      CASE WHEN o.ev OR r.owner IS NULL THEN NULL WHEN o.state IN ('in_transit', 'loose_or_unclear') THEN coalesce(r.cfrom, o.time) ELSE r.cfrom END AS cf
    FROM rec r JOIN o ON o.video = r.video AND o.rn = r.rn + 1))),
ends AS (SELECT video, arg_max(owner, rn) AS owner, arg_max(seg, rn) AS seg, arg_max(t0, rn) AS t0, arg_max(f0, rn) AS f0, max(rn) AS rn FROM rec GROUP BY video),
segs AS (SELECT video, c_seg AS segment, c_owner AS player_id, c_t0 AS t0, c_t1 AS t1, c_f0 AS f0, c_f1 AS f1, c_why AS why FROM rec WHERE c_owner IS NOT NULL
  UNION ALL SELECT e.video, e.seg, (SELECT r.owner FROM rec r WHERE r.video = e.video AND r.rn = e.rn), e.t0, o.time, e.f0, o.frame, 'end_of_input' FROM ends e JOIN o ON o.video = e.video AND o.rn = e.rn
    WHERE (SELECT r.owner FROM rec r WHERE r.video = e.video AND r.rn = e.rn) IS NOT NULL)"""
    return head.replace("__SOURCE__", source).replace("__K__", str(confirm)).replace("__DISTANCE__", str(distance)).replace("__CARRY__", str(carry)).replace("__ORDER__", order)


_CHAIN_SQL = chain_sql(5)

_SMOOTH_SQL = with_views("assoc") + """,
a AS (SELECT video, frame, zone, state, coalesce(speed, 0) AS s, coalesce(distance, 9999) AS d, row_number() OVER (PARTITION BY video ORDER BY frame) AS i FROM assoc),
b AS (SELECT *, ((s >= 700 AND d >= 40) OR (s >= 150 AND d >= 65)) AND NOT d <= 22 AS seed, s >= 75 OR d >= 65 OR state = 'in_transit' AS going, d <= 22 AND state = 'controlled' AS wall FROM a),
sd AS (SELECT video, i, i - lag(i) OVER (PARTITION BY video ORDER BY i) AS g FROM b WHERE seed),
cl AS (SELECT video, min(i) AS a, max(i) AS z FROM (SELECT *, sum(CASE WHEN g <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY video ORDER BY i) AS c FROM sd) GROUP BY video, c),
st AS (SELECT cl.video, cl.a, cl.z, coalesce((SELECT max(i) FROM b WHERE b.video = cl.video AND i < cl.a AND (NOT going OR (wall AND cl.a - i > 1))), 0) AS lo,
  coalesce((SELECT min(i) FROM b WHERE b.video = cl.video AND i > cl.z AND (NOT going OR (wall AND i - cl.z > 1))), 1000000000) AS hi FROM cl),
m AS (SELECT b.*, EXISTS (SELECT 1 FROM st WHERE st.video = b.video AND b.i > st.lo AND b.i < st.hi) AS pass FROM b),
t AS (SELECT *, CASE WHEN pass THEN 'in_transit' WHEN d <= 80 AND s <= 500 THEN 'controlled' WHEN d > 80 THEN 'loose_or_unclear' ELSE state END AS ns, CASE WHEN pass THEN 'pass_interval' WHEN d <= 80 AND s <= 500 THEN 'control_distance' WHEN d > 80 THEN 'outside_control_distance' ELSE 'raw' END AS why FROM m),
u AS (SELECT *, lag(ns) OVER w AS ps FROM t WINDOW w AS (PARTITION BY video ORDER BY i)), v AS (SELECT *, sum(CASE WHEN ns = ps THEN 0 ELSE 1 END) OVER (PARTITION BY video ORDER BY i) AS run FROM u),
zc AS (SELECT video, run, zone, count(*) AS n FROM v WHERE zone IS NOT NULL GROUP BY 1, 2, 3), zm AS (SELECT video, run, arg_max(zone, struct_pack(n := n, k := -ascii(zone))) AS z FROM zc GROUP BY 1, 2),
r AS (SELECT video, run, count(*) AS n, arg_min(ps, i) AS before FROM v GROUP BY 1, 2), f AS (SELECT r.*, CASE WHEN zm.z IN ('strict', 'tolerant') THEN 3 ELSE 999 END AS need FROM r LEFT JOIN zm USING (video, run))
SELECT video, frame, CASE WHEN ns = 'controlled' AND before = 'in_transit' AND n < need THEN 'in_transit' ELSE ns END AS smoothed_state, CASE WHEN ns = 'controlled' AND before = 'in_transit' AND n < need THEN 'receiver_not_confirmed' ELSE why END AS smoothing_reason
FROM v JOIN f USING (video, run)"""

ORACLES = {
    "possession_segments": _CHAIN_SQL + " SELECT video, segment, player_id, round(t0, 6) AS start_time, round(t1, 6) AS end_time, round(greatest(0, t1 - t0), 6) AS duration_seconds, f0 AS start_frame, f1 AS end_frame, why AS end_reason FROM segs",
    "possession_summary": _CHAIN_SQL + " SELECT video, count(*) AS segments, round(sum(round(greatest(0, t1 - t0), 6)), 4) AS total_seconds, round(median(round(greatest(0, t1 - t0), 6)), 4) AS median_seconds FROM segs GROUP BY video",
    "smooth_states": _SMOOTH_SQL,
}
