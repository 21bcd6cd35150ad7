"""Queries of the engine's own operators over the domain tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.geometry import fit_homography, in_polygon, project, within_field
from touchline.operators import associate, evaluate, motion, possession, quality, select, spikes, value, votes
from touchline.operators.sequence import neighbours
from touchline.plans import views
from touchline.plans.views import FPS, STRICT, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Calibration landmarks: pixel and field (yards).
LANDMARKS = ([(150.0, 220.0), (1750.0, 200.0), (1850.0, 950.0), (80.0, 930.0)], [(0.0, 0.0), (120.0, 0.0), (120.0, 75.0), (0.0, 75.0)])
#: A value surface of 4 rows and 6 columns that rises towards the far end.
GRID = [[round(0.01 * (c + 1) ** 1.5 + 0.005 * r * (3 - r), 4) for c in range(6)] for r in range(4)]
GRID_SQL = "[" + ", ".join("[" + ", ".join(f"{v}::DOUBLE" for v in row) + "]" for row in GRID) + "]"


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(**columns: Column | str) -> list[Column]:
    return [F.round(c, 6).alias(n) for n, c in columns.items()]


def _b(s: SparkSession, d: str) -> DataFrame:
    return views.balls(s, d)


V = ["video"]
T = ["detection_id"]

_MOTION = with_views("balls") + """, m AS (SELECT *, lag(frame) OVER w AS pf, lag(center_x) OVER w AS px, lag(center_y) OVER w AS py FROM balls WINDOW w AS (PARTITION BY video ORDER BY frame, detection_id)),
moved AS (SELECT *, center_x - px AS dx, center_y - py AS dy, (frame - pf) / 30.0::DOUBLE AS dt FROM m),
speeds AS (SELECT *, CASE WHEN dt > 0 THEN sqrt(dx * dx + dy * dy) / dt WHEN dt = 0 AND dx * dx + dy * dy > 0 THEN 'inf'::DOUBLE END AS v FROM moved)"""


@query(_MOTION + "SELECT detection_id, pf AS prev_frame, round(dx, 6) AS dx, round(dy, 6) AS dy, round(v, 4) AS speed FROM speeds")
def motion_lag(s, d):  # noqa: ANN001, ANN201
    m = motion.motion(_b(s, d), FPS, by=V, tie=T)
    return m.select("detection_id", "prev_frame", *r6(dx="dx", dy="dy"), F.round("ball_speed_px_per_second", 4).alias("speed"))


@query(with_views("balls") + """, g AS (SELECT *, time_seconds - lag(time_seconds) OVER (PARTITION BY video ORDER BY time_seconds, detection_id) AS gap FROM balls)
SELECT video, count(*) AS detections, round(max(time_seconds) - min(time_seconds), 6) AS duration_seconds, round(count(*) / nullif(max(time_seconds) - min(time_seconds), 0), 6) AS detections_per_second,
  round(max(gap), 6) AS max_gap, count(*) FILTER (gap >= 0.5) AS gaps_0_5s, count(*) FILTER (gap >= 1) AS gaps_1_0s, count(*) FILTER (gap >= 2) AS gaps_2_0s, count(*) FILTER (gap >= 5) AS gaps_5_0s FROM g GROUP BY video""")
def gap_report(s, d):  # noqa: ANN001, ANN201
    g = quality.gap_report(_b(s, d), by=V, tie=T)
    return g.select("video", "detections", *r6(duration_seconds="duration_seconds", detections_per_second="detections_per_second", max_gap="max_gap"), "gaps_0_5s", "gaps_1_0s", "gaps_2_0s", "gaps_5_0s")


@query(with_views("balls", "players") + """, g AS (SELECT *, frame - lag(frame) OVER (PARTITION BY video ORDER BY frame, detection_id) AS gap FROM balls),
b AS (SELECT video, count(*) AS ball_rows, count(DISTINCT frame) AS ball_frames, avg(gap) AS mean_gap, max(gap) AS max_gap, max(time_seconds) AS bt FROM g GROUP BY 1),
pf AS (SELECT video, frame, count(*) AS n, max(time_seconds) AS t FROM players GROUP BY 1, 2), p AS (SELECT video, sum(n)::BIGINT AS player_rows, count(*) AS player_frames, avg(n) AS ap, max(t) AS pt FROM pf GROUP BY 1),
j AS (SELECT *, ball_rows / nullif(greatest(bt, pt), 0) AS rate FROM b FULL JOIN p USING (video))
SELECT video, ball_rows, ball_frames, player_rows, player_frames, max_gap AS max_ball_gap, round(mean_gap, 6) AS mean_ball_gap, round(ap, 6) AS avg_players_per_frame, round(rate, 6) AS ball_per_second,
  CASE WHEN ap >= 14 THEN 'GOOD' WHEN ap >= 8 THEN 'USABLE' ELSE 'WEAK' END AS player_grade, CASE WHEN rate >= 2 THEN 'GOOD' WHEN rate >= 0.75 THEN 'USABLE' ELSE 'WEAK' END AS volume_grade,
  CASE WHEN max_gap <= 60 THEN 'GOOD' WHEN max_gap <= 150 THEN 'USABLE' ELSE 'GAPPY' END AS continuity_grade FROM j""")
def tracking_quality(s, d):  # noqa: ANN001, ANN201
    q = quality.tracking_quality(_b(s, d), views.players(s, d), by=V, tie=T)
    return q.select("video", "ball_rows", "ball_frames", "player_rows", "player_frames", "max_ball_gap", *r6(mean_ball_gap="mean_ball_gap", avg_players_per_frame="avg_players_per_frame", ball_per_second="ball_per_second"), "player_grade", "volume_grade", "continuity_grade")


def _island_sql(order: str, gap: str, island: str) -> str:
    return with_views("balls") + f""", g AS (SELECT *, {order} - lag({order}) OVER (PARTITION BY video ORDER BY {order}, detection_id) AS gap FROM balls),
i AS (SELECT *, 1 + sum(CASE WHEN gap > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY {order}, detection_id ROWS UNBOUNDED PRECEDING) AS {island} FROM g),
e AS (SELECT video, {island}::BIGINT AS {island}, count(*) AS n, avg(confidence) AS ac, min(struct_pack(f := {order}, k := detection_id, t := time_seconds, x := center_x, y := center_y, fr := frame)) AS a,
  max(struct_pack(f := {order}, k := detection_id, t := time_seconds, x := center_x, y := center_y, fr := frame)) AS b FROM i GROUP BY 1, 2),
parts AS (SELECT video, {island}, n, ac, a.fr AS f0, b.fr AS f1, b.t - a.t AS dur, b.x - a.x AS dx, b.y - a.y AS dy, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM e),
sped AS (SELECT *, CASE WHEN dur > 0 THEN dist / dur ELSE 0 END AS v FROM parts)"""


@query(_island_sql("frame", "15", "segment_id") + """SELECT video, segment_id, f0 AS start_frame, f1 AS end_frame, n AS num_detections, round(dur, 6) AS duration_seconds, round(dist, 6) AS distance, round(v, 4) AS avg_speed, round(ac, 6) AS avg_confidence
FROM sped WHERE dur BETWEEN 0.5 AND 5.0 AND dist >= 40""")
def trajectory_segments(s, d):  # noqa: ANN001, ANN201
    t = motion.trajectories(_b(s, d), by=V, tie=T)
    return t.select("video", "segment_id", "start_frame", "end_frame", "num_detections", *r6(duration_seconds="duration_seconds", distance="distance", avg_confidence="avg_confidence"), F.round("avg_speed", 4).alias("avg_speed"))


@query(_island_sql("time_seconds", "1.5", "sequence_id") + """, k AS (SELECT *, CASE WHEN abs(dx) > abs(dy) * 1.5 THEN CASE WHEN dx > 0 THEN 'right' ELSE 'left' END WHEN abs(dy) > abs(dx) * 1.5 THEN CASE WHEN dy > 0 THEN 'down' ELSE 'up' END ELSE 'diagonal' END AS movement_direction,
  CASE WHEN abs(dx) > abs(dy) * 1.8 THEN 'mostly_horizontal' WHEN abs(dy) > abs(dx) * 1.8 THEN 'mostly_vertical' ELSE 'diagonal' END AS movement_shape, CASE WHEN dist >= 400 THEN 'long' WHEN dist >= 250 THEN 'medium' ELSE 'short' END AS movement_length,
  CASE WHEN v >= 120 THEN 'fast' WHEN v >= 70 THEN 'medium' ELSE 'slow' END AS movement_speed FROM sped WHERE dur BETWEEN 1 AND 12 AND dist >= 180 AND v >= 40)
SELECT video, sequence_id, n AS num_detections, round(dur, 6) AS duration_seconds, round(dist, 6) AS distance, movement_direction, movement_shape, movement_length, movement_speed,
  CASE WHEN movement_length = 'long' AND movement_speed <> 'slow' THEN 'direct_ball_movement_candidate' WHEN movement_length <> 'short' AND movement_shape = 'mostly_horizontal' THEN 'switch_or_lateral_progression_candidate'
  WHEN movement_length = 'medium' THEN 'pass_candidate' ELSE 'minor_progression' END AS suggested_event_type FROM k""")
def progressions(s, d):  # noqa: ANN001, ANN201
    p = motion.classify_movement(motion.progressions(_b(s, d), by=V, tie=T))
    return p.select("video", "sequence_id", "num_detections", *r6(duration_seconds="duration_seconds", distance="distance"), "movement_direction", "movement_shape", "movement_length", "movement_speed", "suggested_event_type")


_H = fit_homography(*LANDMARKS).tolist()
_W = f"(center_x * {_H[2][0]!r} + center_y * {_H[2][1]!r} + {_H[2][2]!r})"
_FX, _FY = (f"(center_x * {r[0]!r} + center_y * {r[1]!r} + {r[2]!r}) / {_W}" for r in _H[:2])


@query(with_views("balls").replace("balls AS", "raw AS", 1) + f""", projected AS (SELECT * REPLACE ({_FX} AS center_x, {_FY} AS center_y) FROM raw),
balls AS (SELECT * FROM projected WHERE center_x BETWEEN -5 AND 125 AND center_y BETWEEN -5 AND 80)""" + _island_sql("time_seconds", "1.5", "sequence_id").replace(with_views("balls"), "", 1) + """
SELECT video, sequence_id, n AS num_detections, round(dur, 5) AS duration_seconds, round(dist, 5) AS distance,
  CASE WHEN abs(dx) > abs(dy) * 1.5 THEN 'lengthwise' WHEN abs(dy) > abs(dx) * 1.5 THEN 'widthwise' ELSE 'diagonal' END AS shape,
  CASE WHEN abs(dy) > abs(dx) * 1.5 AND dist >= 25 AND v >= 8 THEN 'switch_candidate' WHEN abs(dy) > abs(dx) * 1.5 AND dist >= 25 THEN 'lateral_circulation_candidate'
    WHEN abs(dx) > abs(dy) * 1.5 AND dist >= 25 AND v >= 8 AND dur <= 6 THEN 'direct_progression_candidate' WHEN abs(dx) > abs(dy) * 1.5 AND dist >= 25 AND v < 8 THEN 'buildup_progression_candidate'
    WHEN dist >= 30 AND v >= 8 THEN 'diagonal_direct_ball_candidate' WHEN dist >= 30 THEN 'diagonal_progression_candidate' WHEN dist >= 15 THEN 'simple_pass_candidate' ELSE 'minor_movement' END AS event_candidate,
  CASE WHEN dist >= 40 THEN 'very_long' WHEN dist >= 30 THEN 'long' WHEN dist >= 20 THEN 'medium' ELSE 'short' END AS length_bucket, CASE WHEN v >= 12 THEN 'fast' WHEN v >= 7 THEN 'medium' ELSE 'slow' END AS speed_bucket
FROM sped WHERE dur BETWEEN 1 AND 12 AND dist >= 15 AND v >= 4""")
def field_progressions(s, d):  # noqa: ANN001, ANN201
    x, y = project("center_x", "center_y", fit_homography(*LANDMARKS))
    balls = _b(s, d).withColumns({"center_x": x, "center_y": y}).filter(within_field(F.col("center_x"), F.col("center_y"), margin=5.0))
    p = motion.classify_field_event(motion.progressions(balls, by=V, tie=T, least_distance=15.0, least_speed=4.0))
    shape = motion.movement_shape(1.5, names=("lengthwise", "widthwise", "diagonal"))
    return p.select("video", "sequence_id", "num_detections", F.round("duration_seconds", 5).alias("duration_seconds"), F.round("distance", 5).alias("distance"), shape.alias("shape"), "event_candidate", "length_bucket", "speed_bucket")


@query(_island_sql("frame", "1", "part") + "SELECT video, count(*) AS n_segments, max((f1 - f0 + 1) / 30.0::DOUBLE) AS longest_seconds, max(n) AS longest_rows FROM parts GROUP BY video")
def continuous_segments(s, d):  # noqa: ANN001, ANN201
    i = motion.island_summary(motion.islands(_b(s, d), by=V, order="frame", max_gap=1, name="part", tie=T), by=V, island="part", tie=T)
    return i.groupBy("video").agg(F.count(F.lit(1)).alias("n_segments"), F.max((F.col("end_frame") - F.col("start_frame") + 1) / FPS).alias("longest_seconds"), F.max("num_detections").alias("longest_rows"))


@query(with_views("balls") + """, c AS (SELECT *, count(*) OVER (PARTITION BY video, round_even(center_x / 12, 0), round_even(center_y / 12, 0)) AS n FROM balls) SELECT detection_id FROM c WHERE n < 20""")
def static_hotspots(s, d):  # noqa: ANN001, ANN201
    return motion.drop_hotspots(_b(s, d), by=V).select("detection_id")


@query(with_views("players") + "SELECT video, frame, count(*) AS n FROM players GROUP BY 1, 2 HAVING count(*) >= 3")
def detections_per_frame(s, d):  # noqa: ANN001, ANN201
    return views.players(s, d).groupBy("video", "frame").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")


def _interp_sql(limit: int, extra: str, source: str) -> str:
    return with_views("balls") + f""", n AS (SELECT *, lead(frame) OVER w AS nf, lead(center_x) OVER w AS nx, lead(center_y) OVER w AS ny, lead(x1) OVER w AS nx1 FROM balls WINDOW w AS (PARTITION BY video ORDER BY frame, detection_id)),
made AS (SELECT video, detection_id, frame, nf - frame AS gap, center_x, center_y, x1, nx, ny, nx1, unnest(generate_series(1, nf - frame - 1)) AS k FROM n WHERE nf - frame > 1 AND nf - frame - 1 <= {limit} {extra}),
path AS (SELECT video, detection_id, CAST(frame + k AS INTEGER) AS frame, center_x + (k / gap::DOUBLE) * (nx - center_x) AS center_x, center_y + (k / gap::DOUBLE) * (ny - center_y) AS center_y, x1 + (k / gap::DOUBLE) * (nx1 - x1) AS x1, '{source}' AS source, NULL::DOUBLE AS confidence FROM made
UNION ALL SELECT video, detection_id, frame, center_x, center_y, x1, 'detected', confidence FROM balls)"""


_PATH_SQL = "SELECT video, detection_id, frame, round(center_x, 6) AS center_x, round(center_y, 6) AS center_y, round(x1, 6) AS x1, source, confidence FROM path"
_FAST = "AND sqrt((nx - center_x) * (nx - center_x) + (ny - center_y) * (ny - center_y)) / ((nf - frame) / 30.0::DOUBLE) <= {}"


def _path(s, d, gap, limit, source):  # noqa: ANN001, ANN202
    return motion.interpolate(_b(s, d), FPS, by=V, max_gap_s=gap, max_speed=limit, source=source, tie=T)


def _path_out(p: DataFrame) -> DataFrame:
    return p.select("video", "detection_id", "frame", *r6(center_x="center_x", center_y="center_y", x1="x1"), "source", "confidence")


@query(_interp_sql(15, "", "interpolated") + _PATH_SQL)
def interpolate_gaps(s, d):  # noqa: ANN001, ANN201
    return _path_out(_path(s, d, 0.5, None, "interpolated"))


@query(_interp_sql(30, _FAST.format(2500), "interpolated_extended") + _PATH_SQL)
def interpolate_speed_gated(s, d):  # noqa: ANN001, ANN201
    return _path_out(_path(s, d, 1.0, 2500.0, "interpolated_extended"))


def _stats_sql(prefix: str) -> str:
    return prefix + """, st AS (SELECT *, frame - lag(frame) OVER w AS dt, center_x - lag(center_x) OVER w AS dx, center_y - lag(center_y) OVER w AS dy FROM path WINDOW w AS (PARTITION BY video ORDER BY frame, detection_id)),
sv AS (SELECT *, CASE WHEN dt BETWEEN 1 AND 15 THEN sqrt(dx * dx + dy * dy) / (dt / 30.0::DOUBLE) END AS v FROM st)
SELECT video, count(*) AS row_count, count(*) FILTER (source = 'detected') AS detected, count(*) FILTER (source <> 'detected') AS interpolated, round(count(DISTINCT frame) * 100.0::DOUBLE / (max(frame) - min(frame) + 1), 6) AS coverage_percent,
 count(*) FILTER (dt - 1 BETWEEN 1 AND 15) AS gap_1_15, count(*) FILTER (dt - 1 BETWEEN 16 AND 30) AS gap_16_30, count(*) FILTER (dt - 1 BETWEEN 31 AND 60) AS gap_31_60, count(*) FILTER (dt - 1 BETWEEN 61 AND 150) AS gap_61_150, count(*) FILTER (dt - 1 >= 151) AS gap_151,
 round(avg(v), 4) AS avg_speed, round(quantile_cont(v, 0.5), 4) AS median_speed, round(quantile_cont(v, 0.95), 4) AS p95_speed, count(*) FILTER (v > 2500) AS jumps FROM sv GROUP BY video"""


def _stats_out(df: DataFrame, *more: str) -> DataFrame:
    names = ["row_count", "detected", "interpolated", "gap_1_15", "gap_16_30", "gap_31_60", "gap_61_150", "gap_151", "jumps"]
    return df.select(*more, "video", *names, F.round("coverage_percent", 6).alias("coverage_percent"), *[F.round(c, 4).alias(c) for c in ("avg_speed", "median_speed", "p95_speed")])


@query(_stats_sql(_interp_sql(30, _FAST.format(2500), "interpolated_extended")))
def trajectory_stats(s, d):  # noqa: ANN001, ANN201
    return _stats_out(quality.trajectory_stats(_path(s, d, 1.0, 2500.0, "interpolated_extended"), FPS, by=V, tie=T))


_SWEEP = [(int(FPS * g), g, v) for g in (0.5, 0.75, 1.0, 1.5) for v in (1200.0, 1800.0, 2500.0, 3500.0)]


@query(with_views("balls") + """, n AS (SELECT *, lead(frame) OVER w AS nf, lead(center_x) OVER w AS nx, lead(center_y) OVER w AS ny FROM balls WINDOW w AS (PARTITION BY video ORDER BY frame, detection_id)),
p AS (SELECT g, v, CAST(floor(30 * g) AS INTEGER) AS lim FROM (VALUES (0.5), (0.75), (1.0), (1.5)) a(g), (VALUES (1200.0), (1800.0), (2500.0), (3500.0)) b(v))
SELECT g::DOUBLE AS max_gap_seconds, v::DOUBLE AS max_speed, count(*) FILTER (nf - frame > 1) AS gaps, count(*) FILTER (nf - frame - 1 > lim) AS long_gaps,
  coalesce(sum(CASE WHEN nf - frame > 1 AND nf - frame - 1 <= lim AND sqrt((nx - center_x) * (nx - center_x) + (ny - center_y) * (ny - center_y)) / ((nf - frame) / 30.0::DOUBLE) <= v THEN nf - frame - 1 END), 0)::BIGINT AS made_rows
FROM n, p GROUP BY 1, 2""")
def interpolation_sweep(s, d):  # noqa: ANN001, ANN201
    """All parameter settings in one job: each gap meets the sixteen settings as an array, not as a join."""
    wide = neighbours(_b(s, d), by=V, order="frame", columns=["frame", "center_x", "center_y"], tie=T, previous=False, following=True)
    gap = F.col("next_frame") - F.col("frame")
    speed = F.sqrt((F.col("next_center_x") - F.col("center_x")) ** 2 + (F.col("next_center_y") - F.col("center_y")) ** 2) / (gap / FPS)
    params = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(v).alias("v"), F.lit(n).alias("n")) for n, g, v in _SWEEP])
    rows = wide.select(gap.alias("gap"), F.when(gap > 0, speed).alias("speed"), F.explode(params).alias("p"))
    ok = (F.col("gap") > 1) & (F.col("gap") - 1 <= F.col("p.n")) & (F.col("speed") <= F.col("p.v"))
    return rows.groupBy(F.col("p.g").alias("max_gap_seconds"), F.col("p.v").alias("max_speed")).agg(
        F.count_if(F.col("gap") > 1).alias("gaps"), F.count_if(F.col("gap") - 1 > F.col("p.n")).alias("long_gaps"), F.coalesce(F.sum(F.when(ok, F.col("gap") - 1)), F.lit(0)).alias("made_rows")
    )


_NEAR = """, c AS (SELECT b.detection_id, b.video, b.frame, p.player_id, p.field_zone AS z, p.foot_x, sqrt((b.center_x - p.{0}) * (b.center_x - p.{0}) + (b.center_y - p.{1}) * (b.center_y - p.{1})) AS d FROM balls b JOIN players p USING (video, frame) {2})"""


@query(with_views("balls", "players") + _NEAR.format("mx", "my", "").replace("JOIN players p", "JOIN (SELECT *, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my FROM players) p") + """, f AS (SELECT detection_id, min(struct_pack(d := d, p := player_id)) AS m FROM c WHERE d IS NOT NULL GROUP BY 1)
SELECT b.detection_id, f.m.p AS nearest_player_id, round(f.m.d, 6) AS distance, CASE WHEN f.m.d IS NULL THEN 'no_players_in_frame' WHEN f.m.d <= 150 THEN 'associated' ELSE 'too_far' END AS association_status FROM balls b LEFT JOIN f USING (detection_id)""")
def nearest_player(s, d):  # noqa: ANN001, ANN201
    p = views.players(s, d).withColumns({"mx": (F.col("x1") + F.col("x2")) / 2, "my": (F.col("y1") + F.col("y2")) / 2}).select("video", "frame", "player_id", "mx", "my")
    n = associate.nearest(_b(s, d), p, keys=["video", "frame"], row="detection_id", px="mx", py="my")
    dist = F.col("nearest_player_distance_px")
    return n.select("detection_id", "nearest_player_id", F.round(dist, 6).alias("distance"), F.when(dist.isNull(), "no_players_in_frame").when(dist <= 150, "associated").otherwise("too_far").alias("association_status"))


_ZONED = _NEAR.format("foot_x", "foot_y", "WHERE p.field_zone <> 'off_field'") + """, f0 AS (SELECT detection_id, min(struct_pack(d := d, p := player_id, x := foot_x, z := z)) AS a, min(struct_pack(d := d, p := player_id, x := foot_x, z := z)) FILTER (z = 'strict') AS s FROM c GROUP BY 1),
f AS (SELECT detection_id, CASE WHEN s.d <= 150 THEN s ELSE a END AS m FROM f0)"""


def _associated(s, d):  # noqa: ANN001, ANN202
    p = views.players(s, d).filter("field_zone <> 'off_field'").select("video", "frame", "player_id", "foot_x", "foot_y", "field_zone")
    m = motion.motion(_b(s, d), FPS, by=V, tie=T)
    return associate.nearest(m, p, keys=["video", "frame"], row="detection_id", keep=["field_zone"], prefer=F.col("field_zone") == "strict")


@query(_MOTION.replace("WITH ", "WITH " + views.SQL["players"] + ",\n", 1) + _ZONED + """, j AS (SELECT speeds.*, f.m FROM speeds LEFT JOIN f USING (detection_id))
SELECT detection_id, m.p AS nearest_player_id, round(m.d, 6) AS distance, m.z AS zone, round(v, 4) AS speed,
  CASE WHEN m.d IS NULL THEN 'no_on_field_players' WHEN v >= 700 THEN 'near_player_but_fast' WHEN m.d > 150 THEN 'too_far' WHEN m.d <= 80 AND (v IS NULL OR v <= 500) THEN 'associated' ELSE 'near_player_unclear' END AS association_status,
  CASE WHEN m.d IS NULL THEN 'unknown' WHEN v >= 700 THEN 'in_transit' WHEN m.d > 150 THEN 'loose_or_unclear' WHEN m.d <= 80 AND (v IS NULL OR v <= 500) THEN 'controlled' ELSE 'loose_or_unclear' END AS ball_state FROM j""")
def association_state(s, d):  # noqa: ANN001, ANN201
    a = _associated(s, d)
    status, state = associate.ball_state(F.col("ball_speed_px_per_second"), F.col("nearest_player_distance_px"), F.col("nearest_player_field_zone"))
    return a.select("detection_id", "nearest_player_id", F.round("nearest_player_distance_px", 6).alias("distance"), F.col("nearest_player_field_zone").alias("zone"), F.round("ball_speed_px_per_second", 4).alias("speed"), status.alias("association_status"), state.alias("ball_state"))


@query(with_views("balls", "players") + _NEAR.format("foot_x", "foot_y", "") + ", k AS (SELECT *, row_number() OVER (PARTITION BY detection_id ORDER BY d, player_id) AS rank FROM c) SELECT detection_id, player_id, round(d, 6) AS distance, rank FROM k WHERE rank <= 5")
def topk_players(s, d):  # noqa: ANN001, ANN201
    k = associate.k_nearest(_b(s, d), views.players(s, d), 5, keys=["video", "frame"], row="detection_id")
    return k.select("detection_id", "player_id", F.round("distance_px", 6).alias("distance"), "rank")


@query(with_views("players") + "SELECT video, field_zone, count(*) AS n, count(*) FILTER (" + views._inside("foot_x", "foot_y", STRICT) + ") AS inside_even_odd FROM players GROUP BY 1, 2")
def field_zones(s, d):  # noqa: ANN001, ANN201
    p = views.players(s, d).withColumn("inside", in_polygon("foot_x", "foot_y", STRICT, "even_odd"))
    return p.groupBy("video", "field_zone").agg(F.count(F.lit(1)).alias("n"), F.count_if("inside").alias("inside_even_odd"))


@query(with_views("balls", "assoc") + """SELECT b.detection_id, a.state AS ball_state, a.frame AS state_frame FROM balls b ASOF LEFT JOIN assoc a ON b.video = a.video AND b.frame >= a.frame""")
def asof_state(s, d):  # noqa: ANN001, ANN201
    states = views.association(s, d).select("video", "frame", F.col("state").alias("ball_state"), F.col("frame").alias("state_frame"))
    return associate.asof_backward(_b(s, d), states, by=V, order="frame", columns=["ball_state", "state_frame"]).select("detection_id", "ball_state", "state_frame")


@query(with_views("balls", "players") + """, c AS (SELECT b.detection_id, sum(CASE WHEN b.center_y >= p.y1 + 0.62::DOUBLE * (p.y2 - p.y1) THEN 300 ELSE 100 END) AS cost FROM balls b JOIN players p ON b.video = p.video AND p.frame BETWEEN b.frame - 5 AND b.frame + 5
 WHERE b.center_x BETWEEN p.x1 AND p.x2 AND b.center_y BETWEEN p.y1 AND p.y2 GROUP BY 1) SELECT detection_id, coalesce(cost, 0)::DOUBLE AS player_penalty FROM balls LEFT JOIN c USING (detection_id)""")
def player_penalty_range(s, d):  # noqa: ANN001, ANN201
    return associate.player_penalty(_b(s, d), views.players(s, d), by=V, row="detection_id").select("detection_id", "player_penalty")


@query(_MOTION.replace("WITH ", "WITH " + views.SQL["players"] + ",\n", 1) + _ZONED.replace("x := foot_x", "x := foot_x, y := foot_y").replace("p.foot_x, sqrt", "p.foot_x, p.foot_y, sqrt") + """, r AS (SELECT b.detection_id, b.video, b.frame, f.m.x AS fx, f.m.y AS fy FROM balls b JOIN f USING (detection_id)),
pr AS (SELECT r.detection_id, r.frame AS mid, p.frame AS rf, p.foot_x AS qx, p.foot_y AS qy, p.field_zone AS qz, sqrt((r.fx - p.foot_x) * (r.fx - p.foot_x) + (r.fy - p.foot_y) * (r.fy - p.foot_y)) AS d FROM r JOIN players p ON r.video = p.video AND p.frame BETWEEN r.frame - 15 AND r.frame + 15),
bf AS (SELECT detection_id, mid, rf, min(struct_pack(d := d, x := qx, y := qy, z := qz)) AS m FROM pr GROUP BY 1, 2, 3 HAVING min(d) <= 45)
SELECT detection_id, count(*) AS match_frames, count(*) FILTER (m.z = 'strict') AS strict_frames, max(CASE WHEN rf < mid THEN 1 ELSE 0 END) AS prev_match, max(CASE WHEN rf > mid THEN 1 ELSE 0 END) AS next_match, round(min(m.d), 6) AS min_distance, round(median(m.d), 6) AS median_distance,
 CASE WHEN count(*) >= 2 THEN round(sqrt((arg_max(m.x, rf) - arg_min(m.x, rf)) ** 2 + (arg_max(m.y, rf) - arg_min(m.y, rf)) ** 2), 6) END AS displacement FROM bf GROUP BY 1""")
def local_motion(s, d):  # noqa: ANN001, ANN201
    a = _associated(s, d).filter("nearest_player_id is not null").select("video", "frame", "detection_id", F.col("nearest_player_foot_x").alias("foot_x"), F.col("nearest_player_foot_y").alias("foot_y"))
    m = associate.local_motion(a, views.players(s, d), by=V, row="detection_id")
    return m.select("detection_id", "match_frames", "strict_frames", "prev_match", "next_match", *r6(min_distance="min_distance", median_distance="median_distance", displacement="displacement"))


@query(with_views("assoc") + """, t AS (SELECT *, lag(state) OVER w AS ps, lag(frame) OVER w AS pf FROM assoc WINDOW w AS (PARTITION BY video ORDER BY frame)) SELECT video, pf AS before_frame, frame AS switch_frame, ps AS before_state, state AS switch_state FROM t WHERE ps <> state""")
def state_transitions(s, d):  # noqa: ANN001, ANN201
    a = neighbours(views.association(s, d).withColumnRenamed("state", "ball_state"), by=V, order="frame", columns=["ball_state", "frame"])
    return possession.state_transitions(a).select("video", F.col("prev_frame").alias("before_frame"), F.col("frame").alias("switch_frame"), F.col("prev_ball_state").alias("before_state"), F.col("ball_state").alias("switch_state"))


@query(with_views("players") + """, s AS (SELECT *, frame - lag(frame) OVER w AS df, foot_x - lag(foot_x) OVER w AS dx, foot_y - lag(foot_y) OVER w AS dy FROM players WINDOW w AS (PARTITION BY video, player_id ORDER BY frame)),
v AS (SELECT *, sqrt(dx * dx + dy * dy) / greatest(df, 1) AS st FROM s), a AS (SELECT video, player_id, count(*) AS detections, max(frame) - min(frame) + 1 AS span_frames, count(*) / (max(frame) - min(frame) + 1)::DOUBLE AS cov, median(confidence) AS mc, median(y2 - y1) AS mh,
 count(*) FILTER (df > 1) AS gap_count, coalesce(max(df) FILTER (df > 1), 0) AS max_gap_frames, count(*) FILTER (st > 35) AS big_jump_count, coalesce(median(st), 0) AS ms FROM v GROUP BY 1, 2)
SELECT video, player_id, detections, span_frames, round(cov, 6) AS coverage_rate, round(mc, 6) AS median_confidence, round(mh, 6) AS median_box_height, gap_count, max_gap_frames, big_jump_count, round(ms, 6) AS median_step,
 CASE WHEN detections >= 60 AND cov >= 0.5 AND big_jump_count < 3 THEN 'stable' WHEN detections >= 60 AND big_jump_count >= 3 THEN 'jumpy_track' WHEN detections >= 60 THEN 'gappy_track' ELSE 'short_track' END AS stability_flag FROM a""")
def track_stability(s, d):  # noqa: ANN001, ANN201
    t = votes.track_stability(views.players(s, d), FPS, by=V, track="player_id")
    return t.select("video", "player_id", "detections", "span_frames", *r6(coverage_rate="coverage_rate", median_confidence="median_confidence", median_box_height="median_box_height", median_step="median_step"), "gap_count", "max_gap_frames", "big_jump_count", "stability_flag")


@query(with_views("players") + """, n AS (SELECT video, player_id, count(*) AS n, (max(frame) - min(frame)) / 30.0::DOUBLE AS secs FROM players GROUP BY 1, 2)
SELECT video, count(*) AS tracks, round(median(n), 6) AS median_length, round(quantile_cont(n, 0.75), 6) AS p75_length, round(quantile_cont(n, 0.9), 6) AS p90_length, max(n) AS max_length, count(*) FILTER (secs >= 2) AS long_tracks FROM n GROUP BY video""")
def track_summary(s, d):  # noqa: ANN001, ANN201
    n = views.players(s, d).groupBy("video", "player_id").agg(F.count(F.lit(1)).alias("n"), ((F.max("frame") - F.min("frame")) / FPS).alias("secs"))
    return n.groupBy("video").agg(F.count(F.lit(1)).alias("tracks"), F.round(F.median("n"), 6).alias("median_length"), F.round(F.percentile("n", 0.75), 6).alias("p75_length"), F.round(F.percentile("n", 0.9), 6).alias("p90_length"), F.max("n").alias("max_length"), F.count_if(F.col("secs") >= 2).alias("long_tracks"))


@query(with_views("labels") + """, v AS (SELECT match_id, half, player, team, count(*) AS n, avg(confidence) AS c FROM labels WHERE coalesce(team, '') NOT IN ('', 'unknown') GROUP BY 1, 2, 3, 4),
t AS (SELECT *, sum(n) OVER (PARTITION BY match_id, half, player)::BIGINT AS total, row_number() OVER (PARTITION BY match_id, half, player ORDER BY n DESC, team) AS r FROM v),
k AS (SELECT DISTINCT match_id, half, player FROM labels)
SELECT match_id, half, player, CASE WHEN n IS NULL OR n / total::DOUBLE < 0.65 THEN 'unknown' ELSE team END AS team, round(coalesce(n / total::DOUBLE, 0), 6) AS team_vote_share, coalesce(n, 0) AS team_vote_frames, coalesce(total, 0) AS team_vote_total_frames, round(coalesce(c, 0), 6) AS team_mean_confidence
FROM k LEFT JOIN t USING (match_id, half, player) WHERE coalesce(r, 1) = 1""")
def team_vote(s, d):  # noqa: ANN001, ANN201
    lab, keys = views.labels(s, d), ["match_id", "half", "player"]
    t = votes.team_vote(lab.select(*keys).distinct(), lab, keys=keys)
    return t.select(*keys, "team", *r6(team_vote_share="team_vote_share", team_mean_confidence="team_mean_confidence"), "team_vote_frames", "team_vote_total_frames")


@query(with_views("assoc") + """, v AS (SELECT player, state, count(*) AS n, min(frame) AS f0, max(frame) AS f1 FROM assoc WHERE player IS NOT NULL GROUP BY 1, 2)
SELECT player, sum(n)::BIGINT AS rows_labelled, arg_min(state, struct_pack(a := -n, b := state)) AS majority_label, round(max(n) / sum(n)::DOUBLE, 6) AS majority_share, min(f0) AS first_frame, max(f1) AS last_frame, string_agg(state, ';' ORDER BY n DESC, state) AS labels_seen FROM v GROUP BY player""")
def label_majority(s, d):  # noqa: ANN001, ANN201
    m = votes.label_summary(views.association(s, d).filter("player is not null"), key="player", label="state", frame="frame")
    return m.withColumn("majority_share", F.round("majority_share", 6))


@query(with_views("balls", "assoc") + """, m AS (SELECT video, frame, min(detection_id) AS t FROM balls GROUP BY 1, 2)
SELECT a.video, a.frame, coalesce(CAST(m.t AS VARCHAR), a.player) AS player, a.player AS original_player, CASE WHEN m.t IS NULL THEN 'original' ELSE 'remapped' END AS id_source FROM assoc a LEFT JOIN m ON a.video = m.video AND a.frame = m.frame AND a.player IS NOT NULL""")
def id_remap(s, d):  # noqa: ANN001, ANN201
    a = views.association(s, d)
    mapping = _b(s, d).select("video", "frame", "detection_id").join(a.select("video", "frame", "player"), ["video", "frame"])
    return votes.remap_ids(a, mapping, keys=["video", "frame"], old="player", new="detection_id", order="detection_id").select("video", "frame", "player", "original_player", "id_source")


_PASS_SQL = with_views("labels") + """, c AS (SELECT * FROM labels WHERE lower(state) = 'controlled' AND trim(coalesce(team, '')) <> '' AND trim(coalesce(player, '')) <> ''),
p AS (SELECT *, lead(s) OVER w AS ts, lead(e) OVER w AS te, lead(team) OVER w AS tt, lead(player) OVER w AS tp, lead(id) OVER w AS ti, lead(confidence) OVER w AS tc FROM c WINDOW w AS (PARTITION BY match_id, half ORDER BY s, id)),
q AS (SELECT *, lower(trim(team)) IN ('unknown', 'none', 'nan', 'unclear') OR lower(trim(tt)) IN ('unknown', 'none', 'nan', 'unclear') AS unk FROM p WHERE ti IS NOT NULL AND player <> tp AND ts - e BETWEEN 0 AND 2),
dead AS (SELECT q.match_id, q.half, q.id, arg_min(l.state, l.id) AS why FROM q JOIN labels l ON l.match_id = q.match_id AND l.half = q.half AND l.state IN ('out_of_play') AND l.s <= q.te AND l.e >= q.s AND l.s <= l.e GROUP BY 1, 2, 3),
k AS (SELECT q.*, dead.why FROM q LEFT JOIN dead USING (match_id, half, id) WHERE unk OR team = tt)"""


def _passes(s, d):  # noqa: ANN001, ANN202
    lab = views.labels(s, d)
    dead = lab.filter("state in ('out_of_play') and start <= end").select("match_id", "half", "start", "end", F.col("state").alias("reason"), F.col("id").alias("rank"))
    return possession.passes(lab, by=["match_id", "half"], non_live=dead)


@query(_PASS_SQL + """SELECT match_id, half, printf('event_%04d', row_number() OVER (PARTITION BY match_id, half ORDER BY s, id)) AS id, 'completed_pass_candidate' AS type, id AS from_possession_id, ti AS to_possession_id, team, player AS from_player, tp AS to_player,
 round(e, 6) AS start_seconds, round(ts, 6) AS end_seconds, round(ts - e, 6) AS duration, least(coalesce(confidence, 1), coalesce(tc, 1)) AS confidence FROM k WHERE NOT unk AND why IS NULL""")
def pass_candidates(s, d):  # noqa: ANN001, ANN201
    e = _passes(s, d)[0]
    return e.select("match_id", "half", "id", "type", "from_possession_id", "to_possession_id", "team", "from_player", "to_player", *r6(start_seconds="start", end_seconds="end", duration="duration"), "confidence")


@query(_PASS_SQL + "SELECT match_id, half, id AS from_possession_id, ti AS to_possession_id, CASE WHEN unk THEN 'unknown_team' ELSE 'non_live:' || why END AS skip_reason FROM k WHERE unk OR why IS NOT NULL")
def pass_skipped(s, d):  # noqa: ANN001, ANN201
    return _passes(s, d)[1].select("match_id", "half", "from_possession_id", "to_possession_id", "skip_reason")


_ACT_SQL = with_views("actions") + """, n AS (SELECT *, upper(trim(coalesce(original_label, ''))) AS label, CASE WHEN half = 2 AND source_time >= 2700 THEN source_time - 2700 ELSE source_time END AS t FROM actions),
o AS (SELECT *, lead(t) OVER (PARTITION BY match_id, half ORDER BY t, id) AS nt FROM n WHERE t IS NOT NULL),
poss AS (SELECT match_id, half, id, t AS s, least(coalesce(nt, t + 2), t + 8) AS e, team, player, CASE WHEN visibility = 'visible' THEN 0.75 ELSE 0.5 END AS confidence FROM o
 WHERE label IN ('PASS', 'DRIVE', 'HEADER', 'HIGH PASS', 'CROSS', 'SHOT', 'THROW IN', 'FREE KICK', 'PLAYER SUCCESSFUL TACKLE') AND coalesce(team, '') <> '' AND player <> '')"""


def _action_possessions(s, d):  # noqa: ANN001, ANN202
    acts = possession.normalise_actions(views.actions(s, d)).filter("time is not null")
    return possession.possessions_from_actions(acts, by=["match_id", "half"])


@query(_ACT_SQL.split(", o AS")[0] + " SELECT match_id, half, id, label, lower(replace(label, ' ', '_')) AS type, round(t, 6) AS time_seconds, CAST(floor(t * 25 + 0.5) AS INTEGER) AS action_frame, label IN ('PASS', 'DRIVE', 'HEADER', 'HIGH PASS', 'OUT', 'CROSS', 'THROW IN', 'SHOT', 'BALL PLAYER BLOCK', 'PLAYER SUCCESSFUL TACKLE', 'FREE KICK', 'GOAL') AS known_label FROM n")
def normalised_actions(s, d):  # noqa: ANN001, ANN201
    a = possession.normalise_actions(views.actions(s, d))
    return a.select("match_id", "half", "id", "label", "type", F.round("time", 6).alias("time_seconds"), "action_frame", "known_label")


@query(_ACT_SQL + "SELECT match_id, half, id AS source_action_id, round(s, 6) AS start_seconds, round(e, 6) AS end_seconds, team, player, confidence::DOUBLE AS confidence FROM poss WHERE e > s")
def possession_from_actions(s, d):  # noqa: ANN001, ANN201
    p = _action_possessions(s, d)
    return p.select("match_id", "half", "source_action_id", *r6(start_seconds="start", end_seconds="end"), "team", "player", "confidence")


@query(with_views("labels") + """, e AS (SELECT *, concat_ws(';', CASE WHEN s IS NULL THEN 'missing_start' END, CASE WHEN e IS NULL THEN 'missing_end' END, CASE WHEN trim(coalesce(state, '')) = '' THEN 'missing_state' END, CASE WHEN e <= s THEN 'end_not_after_start' END,
 CASE WHEN lower(state) = 'controlled' AND trim(coalesce(team, '')) = '' THEN 'missing_team' END, CASE WHEN lower(state) = 'controlled' AND trim(coalesce(player, '')) = '' THEN 'missing_player' END) AS errors FROM labels) SELECT match_id, half, id, errors FROM e WHERE errors <> ''""")
def invalid_labels(s, d):  # noqa: ANN001, ANN201
    return possession.invalid_labels(views.labels(s, d)).select("match_id", "half", "id", "errors")


@query(_ACT_SQL.replace("WITH ", "WITH " + views.SQL["labels"] + ",\n", 1) + """SELECT n.match_id, n.half, n.id, arg_max(l.state, l.id) AS state, arg_max(l.id, l.id) AS label_id FROM n LEFT JOIN labels l ON l.match_id = n.match_id AND l.half = n.half AND l.s <= l.e AND n.t BETWEEN l.s AND l.e GROUP BY 1, 2, 3""")
def interval_stamp(s, d):  # noqa: ANN001, ANN201
    a = possession.normalise_actions(views.actions(s, d)).withColumn("row", F.struct("match_id", "half", "id"))
    iv = views.labels(s, d).withColumn("label_id", F.col("id"))
    return associate.stamp_intervals(a, iv, by=["match_id", "half"], time="time", start="start", end="end", rank="id", columns=["state", "label_id"], row="row").select("match_id", "half", "id", "state", "label_id")


@query(_ACT_SQL.replace("WITH ", "WITH " + views.SQL["labels"] + ",\n", 1) + """, tr AS (SELECT match_id, half, id, s, e, state, team, player FROM labels WHERE e > s), gs AS (SELECT match_id, half, id, s, e, 'controlled' AS state, team, player FROM poss WHERE e > s),
pts AS (SELECT DISTINCT match_id, half, a FROM (SELECT match_id, half, s AS a FROM tr UNION ALL SELECT match_id, half, e FROM tr UNION ALL SELECT match_id, half, s FROM gs UNION ALL SELECT match_id, half, e FROM gs)),
sl AS (SELECT *, lead(a) OVER (PARTITION BY match_id, half ORDER BY a) AS b FROM pts), md AS (SELECT *, (a + b) / 2 AS m FROM sl WHERE b IS NOT NULL),
t AS (SELECT md.match_id, md.half, md.a, md.b, min(struct_pack(s := x.s, i := x.id, st := x.state, te := x.team, pl := x.player)) AS t FROM md JOIN tr x ON x.match_id = md.match_id AND x.half = md.half AND x.s <= m AND x.e > m GROUP BY ALL),
g AS (SELECT md.match_id, md.half, md.a, min(struct_pack(s := x.s, i := x.id, st := x.state, te := x.team, pl := x.player)) AS g FROM md JOIN gs x ON x.match_id = md.match_id AND x.half = md.half AND x.s <= m AND x.e > m GROUP BY ALL)
SELECT match_id, half, round(sum(b - a), 4) AS evaluated_seconds, round(coalesce(sum(b - a) FILTER (t.st = 'controlled'), 0), 4) AS controlled_seconds, round(coalesce(sum(b - a) FILTER (t.st = g.st), 0), 4) AS state_seconds,
 round(coalesce(sum(b - a) FILTER (t.st = 'controlled' AND t.te = g.te), 0), 4) AS team_seconds, round(coalesce(sum(b - a) FILTER (t.st = 'controlled' AND t.pl = g.pl), 0), 4) AS player_seconds FROM t LEFT JOIN g USING (match_id, half, a) GROUP BY 1, 2""")
def time_weighted_accuracy(s, d):  # noqa: ANN001, ANN201
    truth = views.labels(s, d).filter("end > start")
    guess = _action_possessions(s, d).withColumnRenamed("source_action_id", "id")
    t = possession.time_weighted_accuracy(truth, guess, by=["match_id", "half"])
    return t.select("match_id", "half", *[F.round(c, 4).alias(c) for c in ("evaluated_seconds", "controlled_seconds", "state_seconds", "team_seconds", "player_seconds")])


_STEPS = _MOTION + """, acts AS (SELECT video, detection_id, CASE WHEN dt <= 0.1 THEN 'carry' ELSE 'pass' END AS event_type, px AS start_x, py AS start_y, center_x AS end_x, center_y AS end_y FROM moved WHERE px IS NOT NULL)"""


def _steps(s, d):  # noqa: ANN001, ANN202
    m = motion.motion(_b(s, d), FPS, by=V, tie=T)
    kind = F.when(F.col("dt_seconds") <= 0.1, "carry").otherwise("pass")
    return value.actions_only(m.select("video", "detection_id", kind.alias("event_type"), F.col("prev_center_x").alias("start_x"), F.col("prev_center_y").alias("start_y"), F.col("center_x").alias("end_x"), F.col("center_y").alias("end_y")))


def _grid_sql(x: str, y: str) -> str:
    b = lambda v, ext, n: f"least(greatest(CAST(trunc({v} / {ext}.0::DOUBLE * {n}) AS BIGINT), 0), {n - 1})"
    return f"({GRID_SQL})[{b(y, 1080, 4)} + 1][{b(x, 1920, 6)} + 1]"


_VALUED = _STEPS + f", valued AS (SELECT *, {_grid_sql('start_x', 'start_y')} AS sv, {_grid_sql('end_x', 'end_y')} AS ev FROM acts)"


@query(_VALUED + "SELECT detection_id, event_type, round(sv, 6) AS start_value, round(ev, 6) AS end_value, round(ev - sv, 6) AS value_added FROM valued")
def grid_value(s, d):  # noqa: ANN001, ANN201
    return value.static_values(_steps(s, d), GRID, 1920.0, 1080.0).select("detection_id", "event_type", *r6(start_value="start_value", end_value="end_value", value_added="value_added"))


@query(_VALUED + "SELECT video, round(sum(ev - sv), 6) AS total_value, count(*) AS actions, round(avg(ev - sv), 6) AS mean_value FROM valued GROUP BY video")
def value_leaderboard(s, d):  # noqa: ANN001, ANN201
    return value.value_table(value.static_values(_steps(s, d), GRID, 1920.0, 1080.0), ["video"]).select("video", *r6(total_value="total_value", mean_value="mean_value"), "actions")


@query(_VALUED + """SELECT video, round(coalesce(sum(ev - sv) FILTER (event_type = 'pass'), 0), 6) AS pass, round(coalesce(sum(ev - sv) FILTER (event_type = 'carry'), 0), 6) AS carry,
 round(coalesce(sum(ev - sv) FILTER (event_type = 'pass'), 0) + coalesce(sum(ev - sv) FILTER (event_type = 'carry'), 0), 6) AS total_value FROM valued GROUP BY video""")
def value_by_type(s, d):  # noqa: ANN001, ANN201
    return value.value_pivot(value.static_values(_steps(s, d), GRID, 1920.0, 1080.0), ["video"], ["pass", "carry"]).select("video", *r6(**{"pass": "pass", "carry": "carry", "total_value": "total_value"}))


@query(_STEPS + """, w AS (SELECT *, min(start_x) OVER () AS a, max(start_x) OVER () AS b, min(end_x) OVER () AS c, max(end_x) OVER () AS e FROM acts),
z AS (SELECT detection_id, greatest(ceil((start_x - a) / ((b - a) / 12)) - 1, 0) AS sb, greatest(ceil((end_x - c) / ((e - c) / 12)) - 1, 0) AS eb FROM w) SELECT detection_id, CAST(sb AS INTEGER) AS start_x_bin, CAST(eb AS INTEGER) AS end_x_bin, round((eb - sb) * (0.34::DOUBLE / 11), 6) AS value_added FROM z""")
def binned_value(s, d):  # noqa: ANN001, ANN201
    return value.binned_values(_steps(s, d)).select("detection_id", "start_x_bin", "end_x_bin", F.round("value_added", 6).alias("value_added"))


def _cell(x: str, y: str) -> str:
    b = lambda v, ext, n: f"least(greatest(CAST(trunc({v} / {ext}.0::DOUBLE * {n}) AS BIGINT), 0), {n - 1})"
    return f"{b(y, 1080, 12)} * 16 + {b(x, 1920, 16)}"


_THREAT = _STEPS.replace("WITH ", "WITH RECURSIVE ", 1) + f""", c AS (SELECT CASE WHEN detection_id % 11 = 0 THEN 'shot' ELSE event_type END AS k, end_x >= start_x AS ok, detection_id % 33 = 0 AS goal, {_cell('start_x', 'start_y')} AS a, {_cell('end_x', 'end_y')} AS b
  FROM acts WHERE start_x BETWEEN -5000 AND 20000 AND start_y BETWEEN -5000 AND 20000 AND end_x BETWEEN -5000 AND 20000 AND end_y BETWEEN -5000 AND 20000),
cells AS (SELECT range AS a FROM range(192)), n AS (SELECT a, count(*) FILTER (k = 'shot') AS s, count(*) FILTER (k = 'shot' AND goal) AS g, count(*) FILTER (k <> 'shot') AS m FROM c GROUP BY 1),
f AS (SELECT cells.a, coalesce(s / greatest(s + m, 1)::DOUBLE * g / greatest(s, 1), 0) AS score, coalesce(m / greatest(s + m, 1)::DOUBLE, 0) AS move FROM cells LEFT JOIN n USING (a)),
tr AS (SELECT c.a, c.b, count(*) FILTER (ok) / greatest(any_value(m), 1)::DOUBLE AS p FROM c JOIN n USING (a) WHERE k <> 'shot' GROUP BY 1, 2),
ro AS (SELECT x.a, list(coalesce(p, 0) ORDER BY y.a) AS t FROM cells x CROSS JOIN cells y LEFT JOIN tr ON tr.a = x.a AND tr.b = y.a GROUP BY 1),
ma AS (SELECT (SELECT list(score ORDER BY a) FROM f) AS sc, (SELECT list(move ORDER BY a) FROM f) AS mv, (SELECT list(t ORDER BY a) FROM ro) AS tt),
it AS (SELECT 0 AS i, list_transform(range(192), lambda x: 0::DOUBLE) AS v, 1::DOUBLE AS diff UNION ALL SELECT i + 1, nv, list_max(list_transform(range(1, 193), lambda j: abs(nv[j] - v[j])))
  FROM (SELECT i, v, list_transform(range(1, 193), lambda j: sc[j] + mv[j] * list_dot_product(tt[j], v)) AS nv FROM it, ma WHERE diff >= 1e-5 AND i < 200))
SELECT CAST(j // 16 AS INTEGER) AS row, CAST(j % 16 AS INTEGER) AS col, round(v[j + 1], 8) AS value FROM (SELECT v FROM it ORDER BY i DESC LIMIT 1), (SELECT range AS j FROM range(192))"""


@query(_THREAT)
def expected_threat(s, d):  # noqa: ANN001, ANN201
    """Fitted on the steps of grid_value: places beyond 1920 x 1080 count in the border cells. Only steps from or to a place outside any picture, as p3 has it, are left out."""
    place = spikes.ChartSpec()
    possible = reduce(Column.__and__, [F.col(c).between(place.place_min, place.place_max) for c in ("start_x", "start_y", "end_x", "end_y")])
    steps = _steps(s, d).filter(possible)
    steps = steps.withColumns({"event_type": F.when(F.pmod("detection_id", F.lit(11)) == 0, "shot").otherwise(F.col("event_type")), "success": F.col("end_x") >= F.col("start_x"), "goal": F.pmod("detection_id", F.lit(33)) == 0})
    surface = value.fit_expected_threat(steps, length=1920.0, width=1080.0)
    return s.createDataFrame([(r, c, round(float(v), 8)) for r, row in enumerate(surface) for c, v in enumerate(row)], "row int, col int, value double")


_DET_SQL = with_views("balls") + """, items AS (SELECT DISTINCT video, frame, video || ':' || frame AS k FROM balls), truth AS (SELECT video || ':' || frame AS k, x1, y1, x2, y2 FROM balls WHERE detection_id % 10 <> 0),
gs AS (SELECT video || ':' || frame AS k, confidence, x1 + {0} AS x1, y1 AS y1, x2 + {0} AS x2, y2 FROM balls WHERE confidence >= {1}),
iou AS (SELECT k, max(CASE WHEN u <= 0 THEN 0 ELSE i / u END) AS best FROM (SELECT k, i, a + b - i AS u FROM (SELECT t.k, greatest(least(t.x2, g.x2) - greatest(t.x1, g.x1), 0) * greatest(least(t.y2, g.y2) - greatest(t.y1, g.y1), 0) AS i,
  greatest(t.x2 - t.x1, 0) * greatest(t.y2 - t.y1, 0) AS a, greatest(g.x2 - g.x1, 0) * greatest(g.y2 - g.y1, 0) AS b FROM truth t JOIN gs g USING (k))) GROUP BY k),
det AS (SELECT i.k, i.video, coalesce(t.n, 0) AS truth_boxes, coalesce(g.n, 0) AS guesses, coalesce(iou.best, 0) AS best_iou, g.c AS best_confidence FROM items i LEFT JOIN (SELECT k, count(*) AS n FROM truth GROUP BY 1) t USING (k) LEFT JOIN (SELECT k, count(*) AS n, max(confidence) AS c FROM gs GROUP BY 1) g USING (k) LEFT JOIN iou USING (k)),
outcomes AS (SELECT *, CASE WHEN truth_boxes > 0 AND best_iou >= 0.5 THEN 'true_positive' WHEN truth_boxes > 0 AND guesses > 0 THEN 'poor_localization' WHEN truth_boxes > 0 THEN 'missed_ball' WHEN guesses > 0 THEN 'false_positive_on_null' ELSE 'true_negative_null' END AS outcome FROM det)"""
_OLD, _NEW = _DET_SQL.format("(detection_id % 9)::DOUBLE", "0.4::DOUBLE"), _DET_SQL.format("(detection_id % 5)::DOUBLE", "0.3::DOUBLE")


def _outcomes(s, d, step, least):  # noqa: ANN001, ANN202
    b = _b(s, d).withColumn("k", F.concat_ws(":", "video", F.col("frame").cast("string")))
    shift = F.pmod("detection_id", F.lit(step)).cast("double")
    guesses = b.filter(F.col("confidence") >= least).withColumns({"x1": F.col("x1") + shift, "x2": F.col("x2") + shift})
    return evaluate.detection_outcomes(b.select("k", "video").distinct(), b.filter(F.pmod("detection_id", F.lit(10)) != 0), guesses, key="k")


@query(_OLD + """SELECT video, count(*) AS n_items, count(*) FILTER (truth_boxes > 0) AS visible_items, count(*) FILTER (outcome = 'true_positive') AS true_positive, count(*) FILTER (outcome = 'missed_ball') AS missed_ball, count(*) FILTER (outcome = 'poor_localization') AS poor_localization,
 count(*) FILTER (outcome = 'false_positive_on_null') AS false_positive_on_null, count(*) FILTER (outcome = 'true_negative_null') AS true_negative_null, round(avg((outcome = 'true_positive')::INT) FILTER (truth_boxes > 0), 6) AS visible_recall, round(avg(best_iou) FILTER (truth_boxes > 0), 6) AS mean_best_iou_visible FROM outcomes GROUP BY video""")
def detection_metrics(s, d):  # noqa: ANN001, ANN201
    m = evaluate.detection_metrics(_outcomes(s, d, 9, 0.4), ["video"])
    return m.drop("null_false_positive_rate", "poor_localization_rate").withColumns({c: F.round(c, 6) for c in ("visible_recall", "mean_best_iou_visible")})


_SCORE = "CASE {} WHEN 'true_positive' THEN 3 WHEN 'true_negative_null' THEN 2 WHEN 'poor_localization' THEN 1 ELSE 0 END"


@query(_OLD + ", old AS (SELECT k, video, outcome, best_confidence FROM outcomes), " + _NEW.replace("WITH " + views.SQL["balls"] + ", ", "").replace("items AS", "items2 AS").replace("truth AS", "truth2 AS").replace("gs AS", "gs2 AS").replace("iou AS", "iou2 AS").replace("det AS", "det2 AS").replace("outcomes AS", "new AS").replace("FROM truth t JOIN gs g", "FROM truth2 t JOIN gs2 g").replace("FROM items i", "FROM items2 i").replace("FROM truth GROUP", "FROM truth2 GROUP").replace("FROM gs GROUP", "FROM gs2 GROUP").replace("LEFT JOIN iou USING", "LEFT JOIN iou2 USING").replace("iou.best", "iou2.best").replace("FROM det)", "FROM det2)") + f""", cmp AS (SELECT k, old.video, CASE WHEN old.best_confidence >= 0.6 THEN 'sure' ELSE 'unsure' END AS reason, {_SCORE.format('new.outcome')} - {_SCORE.format('old.outcome')} AS delta FROM old FULL JOIN new USING (k))
SELECT video, reason, CASE grouping(video, reason) WHEN 1 THEN 'video' WHEN 2 THEN 'reason' ELSE 'video+reason' END AS "grouping", count(*) AS n, count(*) FILTER (delta > 0) AS improved, count(*) FILTER (delta < 0) AS regressed, round(avg(delta), 6) AS mean_delta
FROM cmp GROUP BY GROUPING SETS ((video), (reason), (video, reason))""")
def evaluation_compare(s, d):  # noqa: ANN001, ANN201
    old, new = _outcomes(s, d, 9, 0.4), _outcomes(s, d, 5, 0.3)
    c = evaluate.compare_outcomes(old, new, key="k", keep=["video", "best_confidence"])
    c = c.withColumn("reason", F.when(F.col("best_confidence") >= 0.6, "sure").otherwise("unsure"))
    out = quality.grouped_rollup(c, "video", "reason", [F.count(F.lit(1)).alias("n"), F.count_if(F.col("delta_score") > 0).alias("improved"), F.count_if(F.col("delta_score") < 0).alias("regressed"), F.round(F.avg("delta_score"), 6).alias("mean_delta")])
    return out.select("video", "reason", "grouping", "n", "improved", "regressed", "mean_delta")


@query(with_views("balls", "assoc") + """, j AS (SELECT a.state AS truth, CASE WHEN b.confidence >= 0.6 THEN 'controlled' WHEN b.confidence >= 0.4 THEN 'in_transit' WHEN b.confidence IS NOT NULL THEN 'unknown' END AS guess FROM assoc a LEFT JOIN balls b USING (video, frame))
SELECT truth, count(*) FILTER (guess = 'controlled') AS controlled, count(*) FILTER (guess = 'in_transit') AS in_transit, count(*) FILTER (guess = 'unknown') AS unknown FROM j GROUP BY truth""")
def state_confusion(s, d):  # noqa: ANN001, ANN201
    c = F.col("confidence")
    guess = F.when(c >= 0.6, "controlled").when(c >= 0.4, "in_transit").when(c.isNotNull(), "unknown")
    j = views.association(s, d).select("video", "frame", F.col("state").alias("truth")).join(_b(s, d).select("video", "frame", "confidence"), ["video", "frame"], "left").withColumn("guess", guess)
    return evaluate.confusion(j, "truth", "guess", ["controlled", "in_transit", "unknown"])


_BOX_SQL = with_views("balls") + """, l AS (SELECT detection_id, detection_id // 3 AS item, detection_id % 25 = 0 AS odd, center_x / 1920 AS x, center_y / 1080 AS y, (x2 - x1) / 1920 AS w, (y2 - y1) / 1080 AS h FROM balls),
e AS (SELECT item, CASE WHEN odd THEN 'unexpected_class_id' WHEN w <= 0 OR h <= 0 THEN 'non_positive_box_size' WHEN w > 1 OR h > 1 THEN 'box_size_out_of_range' WHEN NOT (x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1) THEN 'box_center_out_of_range'
 WHEN x - w / 2 < 0 OR x + w / 2 > 1 OR y - h / 2 < 0 OR y + h / 2 > 1 THEN 'box_extends_outside_image' END AS er FROM l),
g AS (SELECT item, count(*) FILTER (er IS NULL) AS valid_boxes, list(DISTINCT er) FILTER (er IS NOT NULL) AS es FROM e GROUP BY 1),
i AS (SELECT g.item, valid_boxes, array_to_string(list_sort(list_concat(coalesce(es, []), CASE WHEN valid_boxes > 1 THEN ['multiple_ball_boxes'] ELSE [] END)), ';') AS validation_errors FROM g)"""


def box_labels(s, d):  # noqa: ANN001, ANN201
    return _b(s, d).select(
        F.floor(F.col("detection_id") / 3).alias("item"), F.when(F.pmod("detection_id", F.lit(25)) == 0, 1).otherwise(0).alias("class_id"), (F.col("center_x") / 1920).alias("x_center"), (F.col("center_y") / 1080).alias("y_center"),
        ((F.col("x2") - F.col("x1")) / 1920).alias("width"), ((F.col("y2") - F.col("y1")) / 1080).alias("height"), F.lit("").alias("parse_error"),
    )


def _validated(s, d):  # noqa: ANN001, ANN202
    lab = box_labels(s, d)
    return evaluate.validate_items(lab.select("item").distinct(), evaluate.validate_boxes(lab), key="item")


@query(_BOX_SQL + "SELECT * FROM i")
def box_validation(s, d):  # noqa: ANN001, ANN201
    return _validated(s, d)


@query(_BOX_SQL + "SELECT error, count(*) AS n FROM (SELECT unnest(string_split(validation_errors, ';')) AS error FROM i WHERE validation_errors <> '') GROUP BY 1")
def error_tokens(s, d):  # noqa: ANN001, ANN201
    return evaluate.error_counts(_validated(s, d))


@query(_MOTION + """, lc AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY confidence, detection_id) AS r FROM speeds WHERE confidence BETWEEN 0.15 AND 0.45), ga AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY dt DESC, detection_id) AS r FROM speeds WHERE dt >= 0.5),
ju AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY v DESC, detection_id) AS r FROM speeds WHERE dt <= 0.2 AND v >= 650),
al AS (SELECT video, frame, 'low_confidence_detection' AS reason, 0 AS p, detection_id FROM lc WHERE r <= 5 UNION ALL SELECT video, frame, 'detection_gap_end', 1, detection_id FROM ga WHERE r <= 5 UNION ALL SELECT video, frame, 'suspicious_ball_jump', 2, detection_id FROM ju WHERE r <= 5),
un AS (SELECT *, row_number() OVER (PARTITION BY video, frame ORDER BY p, detection_id) AS q FROM al) SELECT video, frame, reason FROM un WHERE q = 1""")
def hard_frames(s, d):  # noqa: ANN001, ANN201
    m = motion.motion(_b(s, d), FPS, by=V, tie=T).select("video", "frame", "detection_id", "confidence", "dt_seconds", "ball_speed_px_per_second")
    low = select.top(m.filter("confidence between 0.15 and 0.45"), 5, by=V, order=[F.asc("confidence"), F.asc("detection_id")])
    gaps = select.top(m.filter("dt_seconds >= 0.5"), 5, by=V, order=[F.desc("dt_seconds"), F.asc("detection_id")])
    jumps = select.top(m.filter("dt_seconds <= 0.2 and ball_speed_px_per_second >= 650"), 5, by=V, order=[F.desc("ball_speed_px_per_second"), F.asc("detection_id")])
    parts = [("low_confidence_detection", low), ("detection_gap_end", gaps), ("suspicious_ball_jump", jumps)]
    return select.prioritised(parts, keys=["video", "frame"], order=["detection_id"]).select("video", "frame", "reason")


@query(with_views("balls") + """, r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame, detection_id) - 1 AS i, count(*) OVER (PARTITION BY video) AS n FROM balls),
k AS (SELECT DISTINCT video, CAST(round_even(q * (n - 1) / 24.0::DOUBLE, 0) AS BIGINT) AS i FROM (SELECT DISTINCT video, n FROM r), generate_series(0, 24) g(q)) SELECT r.detection_id FROM r LEFT JOIN k USING (video, i) WHERE n <= 25 OR k.video IS NOT NULL""")
def even_sample(s, d):  # noqa: ANN001, ANN201
    return select.evenly(_b(s, d), 25, by=V, order=["frame", "detection_id"]).select("detection_id")


@query(with_views("balls") + "SELECT detection_id FROM balls WHERE frame % 30 = 0")
def frame_sample(s, d):  # noqa: ANN001, ANN201
    return select.every_nth(_b(s, d), 30).select("detection_id")


@query(with_views("balls") + """, e AS (SELECT video, least(greatest(frame + o, 0), 20000) AS frame, frame AS source_frame, o FROM balls, (VALUES (-60), (0), (60)) x(o) WHERE confidence < 0.25), r AS (SELECT *, row_number() OVER (PARTITION BY video, frame ORDER BY source_frame DESC, o DESC) AS q FROM e)
SELECT video, frame, source_frame FROM r WHERE q = 1""")
def neighbour_frames(s, d):  # noqa: ANN001, ANN201
    """Clamped to the video's own last frame, the greatest one in any delivery of its ball readings, players and associations; the SQL still clamps all videos to 20000."""
    from touchline.sources.tables import table

    last = reduce(DataFrame.union, [table(s, d, t, "video", "frame") for t in ("ball_detections", "player_detections", "association")]).groupBy("video").agg(F.max("frame").alias("last"))
    low = _b(s, d).filter("confidence < 0.25").join(last, V)
    return select.expand_offsets(low, [-60, 0, 60], F.col("last"), by=V).select("video", "frame", "source_frame")


@query(with_views("balls") + """, g AS (SELECT *, time_seconds - lag(time_seconds) OVER (PARTITION BY video ORDER BY time_seconds, detection_id) AS gap FROM balls), f AS (SELECT video, detection_id, CAST(floor(greatest(time_seconds - gap - 2, 0) * 2) AS BIGINT) AS a, CAST(floor((time_seconds + 2) * 2) AS BIGINT) AS b FROM g WHERE gap >= 2)
SELECT video, detection_id, CAST(k AS BIGINT) * 15 AS frame FROM (SELECT video, detection_id, unnest(generate_series(a, b)) AS k FROM f)""")
def gap_review_frames(s, d):  # noqa: ANN001, ANN201
    n = neighbours(_b(s, d), by=V, order="time_seconds", columns=["time_seconds"], tie=T, block=2048.0).withColumn("gap", F.col("time_seconds") - F.col("prev_time_seconds")).filter("gap >= 2")
    a, b = F.floor(F.greatest(F.col("time_seconds") - F.col("gap") - 2, F.lit(0.0)) * 2), F.floor((F.col("time_seconds") + 2) * 2)
    return n.select("video", "detection_id", F.explode(F.sequence(a, b)).alias("k")).select("video", "detection_id", (F.col("k") * 15).alias("frame"))


@query(with_views("balls", "players") + """SELECT video, frame FROM balls WHERE confidence BETWEEN 0.1 AND 0.35 UNION SELECT video, frame FROM players GROUP BY 1, 2 HAVING count(*) >= 20""")
def review_frames(s, d):  # noqa: ANN001, ANN201
    low = _b(s, d).filter("confidence between 0.1 and 0.35").select("video", "frame")
    busy = views.players(s, d).groupBy("video", "frame").agg(F.count(F.lit(1)).alias("n")).filter("n >= 20").select("video", "frame")
    return low.union(busy).distinct()


@query(with_views("balls", "players") + "SELECT DISTINCT video, frame FROM players EXCEPT SELECT video, frame FROM balls")
def frames_without_ball(s, d):  # noqa: ANN001, ANN201
    return views.players(s, d).select("video", "frame").distinct().join(_b(s, d).select("video", "frame"), ["video", "frame"], "left_anti")


@query(with_views("balls") + """, w AS (SELECT detection_id, list(center_x ORDER BY frame, detection_id) OVER (PARTITION BY video ORDER BY frame, detection_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS xs FROM balls) SELECT detection_id, len(xs) AS n_points, round(list_avg(xs), 6) AS mean_x FROM w""")
def trailing_points(s, d):  # noqa: ANN001, ANN201
    from pyspark.sql import Window

    # blocks of frames with the readings of the block before as lead-in; a reading is at most 19 rows from its trail's first
    b = _b(s, d).select("video", "frame", "detection_id", "center_x").withColumn("blk", F.floor(F.col("frame") / 65536))
    heads = b.select("video", "blk").distinct()
    over = Window.partitionBy("video").orderBy("blk")
    heads = heads.withColumn("nxt", F.lead("blk").over(over)).filter("nxt is not null")
    lead_in = select.top(b.join(heads, ["video", "blk"]), 19, by=["video", "blk"], order=[F.desc("frame"), F.desc("detection_id")])
    both = b.withColumn("own", F.lit(True)).unionByName(lead_in.select("video", "frame", "detection_id", "center_x", F.col("nxt").alias("blk"), F.lit(False).alias("own")))
    w = Window.partitionBy("video", "blk").orderBy("frame", "detection_id").rowsBetween(-19, 0)
    out = both.withColumns({"n_points": F.count("center_x").over(w), "mean_x": F.avg("center_x").over(w)}).filter("own")
    return out.select("detection_id", "n_points", F.round("mean_x", 6).alias("mean_x"))


@query("SELECT n_name AS venue, o_orderpriority AS reason, CASE grouping(n_name, o_orderpriority) WHEN 1 THEN 'venue' WHEN 2 THEN 'reason' ELSE 'venue+reason' END AS \"grouping\", count(*) AS n, round(avg(o_totalprice), 4) AS mean_value, count(*) FILTER (o_orderstatus = 'F') AS finished "
       "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((n_name), (o_orderpriority), (n_name, o_orderpriority))")
def rollup_by_group(s, d):  # noqa: ANN001, ANN201
    from touchline.sources.tables import table

    o = table(s, d, "orders", "o_custkey", "o_orderpriority", "o_totalprice", "o_orderstatus").join(table(s, d, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(table(s, d, "nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("venue"), F.col("o_orderpriority").alias("reason"), "o_totalprice", "o_orderstatus")
    return quality.grouped_rollup(o, "venue", "reason", [F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_value"), F.count_if(F.col("o_orderstatus") == "F").alias("finished")])


