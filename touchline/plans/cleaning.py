"""Queries p3 to p6: spikes, regular grids, intervals and references over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.ids import numbered_id, plain_id, words_state
from touchline.operators.grid import regular_series
from touchline.operators.intervals import merge_intervals
from touchline.operators.references import orphan_references
from touchline.operators.spikes import flag_implausible
from touchline.sources.tables import latest, table

PERIOD = 10  # frames
FILL_GAP = 50  # frames between two readings that interpolation may bridge


def _flags(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "ball_detections", "detection_id", "video", "frame", "center_x", "center_y", "speed_px_per_second", "loaded_at")
    df = latest(df, ["detection_id"], "loaded_at", ["video", "frame", "center_x", "center_y", "speed_px_per_second"])
    return flag_implausible(df, key="detection_id", source="video", tick="frame", x="center_x", y="center_y", rate="speed_px_per_second")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).select("detection_id")


def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n_readings"))


def p3_limits_and_stuck(spark: SparkSession, d: str) -> DataFrame:
    """The part of p3's cases that SQL can tell."""
    told = _flags(spark, d).select("detection_id", F.explode("reasons").alias("reason"))
    return told.filter(~F.col("reason").endswith("_spike"))


def _series(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "ball_detections", "video", "frame", "center_x", "center_y")
    return regular_series(df, source="video", tick="frame", values=["center_x", "center_y"], step=PERIOD, max_gap=FILL_GAP)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _series(spark, d).filter(F.col("fill") != "observed").select("video", "period_start")


def p4_series(spark: SparkSession, d: str) -> DataFrame:
    return _series(spark, d).select(
        "video", "period_start", F.col("n_readings").alias("n_frames"), F.round("center_x", 6).alias("center_x"), F.round("center_y", 6).alias("center_y"), "fill"
    )


def _labels(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "possession_labels", "match_id", "half", "id", "start", "end", "player", "review_status", "loaded_at")
    return df.withColumn("half", F.coalesce("half", F.lit(1)))


def _withdrawn(column: str):  # noqa: ANN202
    return F.coalesce(words_state(column) == "withdrawn", F.lit(False))


def _player_intervals(spark: SparkSession, d: str) -> DataFrame:
    now = latest(_labels(spark, d), ["match_id", "half", "id"], "loaded_at", ["start", "end", "player", "review_status"])
    ms = lambda c: F.when(~F.isnan(c), F.round(F.col(c) * 1000).cast("long"))
    now = now.filter(~_withdrawn("review_status")).select("match_id", "half", plain_id("player").alias("player"), ms("start").alias("start_ms"), ms("end").alias("end_ms"))
    return now.filter("player is not null")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    merged = merge_intervals(_player_intervals(spark, d), entity=["match_id", "half", "player"], start="start_ms", end="end_ms")
    return merged.select("match_id", "half", "player", "kind", "start_ms", "end_ms")


_REFS = {"from_possession_id": "label", "to_possession_id": "label", "from_source_action_id": "action"}


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    key = lambda kind, c: F.concat_ws("\x1f", F.col("match_id"), F.col("half").cast("string"), kind, c)
    labels = _labels(spark, d).withColumn("rid", numbered_id("id")).filter("rid is not null").groupBy("match_id", "half", "rid").agg(
        F.min("loaded_at").alias("since"), F.max(F.struct("loaded_at", "review_status")).alias("last")
    )
    actions = table(spark, d, "ball_actions", "match_id", "half", "id", "loaded_at").withColumn("half", F.coalesce("half", F.lit(1)))
    actions = actions.withColumn("rid", numbered_id("id")).filter("rid is not null").groupBy("match_id", "half", "rid").agg(F.min("loaded_at").alias("since"))
    parents = labels.select(key(F.lit("label"), F.col("rid")).alias("key"), _withdrawn("last.review_status").alias("gone"), "since").unionByName(
        actions.select(key(F.lit("action"), F.col("rid")).alias("key"), F.lit(False).alias("gone"), "since")
    )
    events = table(spark, d, "event_candidates", "id", "match_id", "half", "loaded_at", *_REFS).withColumn("half", F.coalesce("half", F.lit(1)))
    events = events.groupBy("match_id", "half", F.col("id").alias("event_id")).agg(
        F.min("loaded_at").alias("seen"), F.max(F.struct("loaded_at", *_REFS)).alias("last")
    )
    each = F.array(*[F.struct(F.lit(f).alias("ref_field"), F.lit(kind).alias("kind"), numbered_id(f"last.{f}").alias("rid")) for f, kind in _REFS.items()])
    refs = events.select("match_id", "half", "event_id", "seen", F.explode(each).alias("x")).select("match_id", "half", "event_id", "seen", "x.*")
    refs = refs.filter("rid is not null").withColumn("key", key(F.col("kind"), F.col("rid")))
    return orphan_references(refs.select("key", "match_id", "half", "event_id", "ref_field", "seen", F.col("kind")), parents)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("match_id", "half", "event_id", "ref_field")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    table_name = F.when(F.col("kind") == "label", "possession_labels").otherwise("ball_actions")
    return _orphans(spark, d).groupBy(table_name.alias("ref_table"), F.date_format("seen", "yyyy-MM").alias("month"), "reason").agg(F.count(F.lit(1)).alias("n_orphans"))


QUERIES = {f.__name__: f for f in (p3_found, p3_reasons, p3_limits_and_stuck, p4_found, p4_series, p5_found, p6_found, p6_counts)}

_P4_READINGS = f"""
readings AS (
  SELECT video, frame, avg(center_x) AS x, avg(center_y) AS y FROM ball_detections
  WHERE video IS NOT NULL AND frame IS NOT NULL AND NOT isnan(coalesce(center_x, 'nan')) AND NOT isnan(coalesce(center_y, 'nan')) GROUP BY 1, 2),
periods AS (
  SELECT video, CAST(floor(frame / {PERIOD}.0) AS BIGINT) AS p, count(*) AS n, avg(x) AS x, avg(y) AS y, min(frame) AS t0, max(frame) AS t1,
         arg_min(x, frame) AS x0, arg_min(y, frame) AS y0, arg_max(x, frame) AS x1, arg_max(y, frame) AS y1 FROM readings GROUP BY 1, 2),
spans AS (SELECT *, lead(p) OVER w AS pn, lead(t0) OVER w AS tn, lead(x0) OVER w AS xn, lead(y0) OVER w AS yn FROM periods WINDOW w AS (PARTITION BY video ORDER BY p)),
holes AS (SELECT *, unnest(generate_series(p + 1, pn - 1)) AS q FROM spans WHERE pn > p + 1)
"""

_LABELS = """
labels AS (
  SELECT match_id, coalesce(half, 1) AS half, id, "start" AS s, "end" AS e, player,
         coalesce(lower(trim(regexp_replace(review_status, '[ _-]+', '_', 'g'))) IN ('withdrawn', '_withdrawn', 'withdrawn_', '_withdrawn_'), false) AS withdrawn, loaded_at
  FROM possession_labels)
"""


def _squash(c: str) -> str:
    """SQL: an id in lower case, without surrounding blanks and the number's leading zeros; '' where empty."""
    low = f"lower(trim(coalesce({c}, ''), E' \\t\\n'))"
    return f"(CASE WHEN {low} IN ('', 'none', 'nan', 'null') THEN '' ELSE regexp_replace({low}, '(^|[^0-9])0+([0-9])', '\\1\\2', 'g') END)"


_P6 = f"""
WITH {_LABELS},
parents AS (
  SELECT match_id, half, 'label' AS kind, {_squash('id')} AS rid, min(loaded_at) AS since, arg_max(withdrawn, loaded_at) AS gone FROM labels GROUP BY ALL
  UNION ALL
  SELECT match_id, coalesce(half, 1), 'action', {_squash('id')}, min(loaded_at), false FROM ball_actions GROUP BY ALL),
events AS (
  SELECT match_id, coalesce(half, 1) AS half, id AS event_id, min(loaded_at) AS seen,
         max(struct_pack(l := loaded_at, a := coalesce(from_possession_id, ''), b := coalesce(to_possession_id, ''), c := coalesce(from_source_action_id, ''))) AS z
  FROM event_candidates GROUP BY 1, 2, 3),
refs AS (
  SELECT match_id, half, event_id, seen, 'from_possession_id' AS ref_field, 'label' AS kind, {_squash('z.a')} AS rid FROM events
  UNION ALL SELECT match_id, half, event_id, seen, 'to_possession_id', 'label', {_squash('z.b')} FROM events
  UNION ALL SELECT match_id, half, event_id, seen, 'from_source_action_id', 'action', {_squash('z.c')} FROM events),
orphans AS (
  SELECT r.*, CASE WHEN p.rid IS NULL THEN 'missing' WHEN p.gone THEN 'gone' ELSE 'late' END AS reason
  FROM refs r LEFT JOIN parents p USING (match_id, half, kind, rid)
  WHERE r.rid <> '' AND (p.rid IS NULL OR p.gone OR p.since > r.seen))
"""

def _stuck_sql(column: str, reason: str) -> str:
    return f"""SELECT detection_id, '{reason}' AS reason FROM (SELECT *, count(*) OVER (PARTITION BY video, run) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY video ORDER BY frame, detection_id ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT detection_id, video, frame, CASE WHEN lag({column}) OVER (PARTITION BY video ORDER BY frame, detection_id) = {column} THEN 0 ELSE 1 END AS new FROM r WHERE {column} IS NOT NULL))) WHERE n >= 6 AND new = 0"""


_P3 = """
WITH z AS (SELECT detection_id, max(struct_pack(l := loaded_at, v := video, f := frame, x := center_x, y := center_y, s := speed_px_per_second)) AS z FROM ball_detections WHERE detection_id IS NOT NULL GROUP BY 1),
r AS (SELECT detection_id, z.v AS video, z.f AS frame, CASE WHEN NOT isnan(z.x) THEN z.x END AS x, CASE WHEN NOT isnan(z.y) THEN z.y END AS y, CASE WHEN NOT isnan(z.s) THEN z.s END AS s FROM z WHERE z.v IS NOT NULL AND z.f IS NOT NULL)
"""

ORACLES = {
    "p3_limits_and_stuck": _P3 + "SELECT detection_id, 'place_limit' AS reason FROM r WHERE x < -5000 OR x > 20000 OR y < -5000 OR y > 20000 UNION ALL SELECT detection_id, 'rate_limit' FROM r WHERE s < 0 OR s > 100000 UNION ALL "
    + " UNION ALL ".join(_stuck_sql(c, reason) for c, reason in (("x", "x_stuck"), ("y", "y_stuck"), ("s", "rate_stuck"))),
    "p4_found": f"WITH {_P4_READINGS} SELECT video, CAST(q * {PERIOD} AS INTEGER) AS period_start FROM holes",
    "p4_series": f"""WITH {_P4_READINGS},
      filled AS (SELECT video, q, (q * {PERIOD} + {(PERIOD - 1) / 2} - t1) / (tn - t1) AS f, tn - t1 > {FILL_GAP} AS far, x1, y1, xn, yn FROM holes)
      SELECT video, CAST(p * {PERIOD} AS INTEGER) AS period_start, n AS n_frames, round(x, 6) AS center_x, round(y, 6) AS center_y, 'observed' AS fill FROM periods
      UNION ALL SELECT video, CAST(q * {PERIOD} AS INTEGER), 0, CASE WHEN NOT far THEN round(x1 * (1 - f) + xn * f, 6) END,
        CASE WHEN NOT far THEN round(y1 * (1 - f) + yn * f, 6) END, CASE WHEN far THEN 'missing' ELSE 'interpolated' END FROM filled""",
    "p5_found": f"""WITH {_LABELS},
      last AS (SELECT match_id, half, id, max(struct_pack(l := loaded_at, s := s, e := e, p := player, w := withdrawn)) AS z FROM labels GROUP BY 1, 2, 3),
      good AS (SELECT DISTINCT match_id, half, regexp_replace(trim(z.p), '\\.0$', '') AS player, CAST(round(z.s * 1000) AS BIGINT) AS s, CAST(round(z.e * 1000) AS BIGINT) AS e
        FROM last WHERE NOT z.w AND trim(coalesce(z.p, '')) <> '' AND NOT isnan(coalesce(z.s, 'nan')) AND NOT isnan(coalesce(z.e, 'nan'))),
      seen AS (SELECT *, max(e) OVER (PARTITION BY match_id, half, player ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM good WHERE e > s),
      islands AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, half, player ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM seen)
      SELECT match_id, half, player, 'period' AS kind, min(s) AS start_ms, max(e) AS end_ms FROM islands GROUP BY match_id, half, player, i
      UNION ALL SELECT match_id, half, player, 'gap', b, s FROM seen WHERE s > b""",
    "p6_found": _P6 + "SELECT match_id, half, event_id, ref_field FROM orphans",
    "p6_counts": _P6 + """SELECT CASE WHEN kind = 'label' THEN 'possession_labels' ELSE 'ball_actions' END AS ref_table, strftime(seen, '%Y-%m') AS month, reason, count(*) AS n_orphans
      FROM orphans GROUP BY 1, 2, 3""",
}
