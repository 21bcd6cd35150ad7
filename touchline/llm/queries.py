"""Queries p1, p2, p7, p8 and p9, and their SQL where SQL can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.ids import words_state
from touchline.llm.leakage import find_leaks, remove_leaks
from touchline.llm.mixture import mix, token_counter
from touchline.llm.runs import collapse_runs
from touchline.llm.subjects import tag_subjects
from touchline.llm.topn import top_n
from touchline.sources.tables import latest, table

MAX_GAP = 15  # frames
TOP = 3


def _runs(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "association", "video", "frame", "time_seconds", "nearest_player_id", "ball_state", "loaded_at")
    df = df.filter("video is not null and frame is not null")
    now = latest(df, ["video", "frame"], "loaded_at", ["time_seconds", "nearest_player_id", "ball_state"])
    player, state = words_state("nearest_player_id"), words_state("ball_state")
    now = now.select("video", "frame", "time_seconds", F.when(~player.isin("none", "nan", "null"), player).alias("player_id"), state.alias("ball_state"))
    return collapse_runs(now, entity="video", order="frame", event=["player_id", "ball_state"], time="time_seconds", max_gap=MAX_GAP)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select("video", F.col("first").cast("int").alias("first_frame"), F.col("last").cast("int").alias("last_frame"))


def p1_events(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select(
        "video", "player_id", "ball_state", F.col("first").cast("int").alias("first_frame"), F.col("last").cast("int").alias("last_frame"), "n_rows",
        F.round("duration", 3).alias("duration_seconds"),
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "player_detections", "video", "frame", "player_id", "foot_x", "loaded_at")
    return top_n(df, group=["video", "frame"], score="foot_x", tie="player_id", n=TOP, version="loaded_at").select("video", "frame", "player_id")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "passage"), doc="doc_id", text="text", item="item_id", passage="passage")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked, into how many documents."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("words_in_row").alias("most_words_in_row"))


def p7_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every document's length and how much of it is leaked text, once that is cut out."""
    docs, items = table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "passage")
    clean = remove_leaks(docs, items, doc="doc_id", text="text", item="item_id", passage="passage")
    return clean.select("doc_id", F.length("text").alias("n_chars"), "removed_chars")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs, targets = table(spark, d, "documents", "doc_id", "text", "source"), table(spark, d, "source_targets", "source", "target_share", "max_repeats")
    return mix(docs, targets, doc="doc_id", source=words_state("source"), tokens=token_counter()(F.col("text")))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return tag_subjects(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "doc_labels", "doc_id", "subject"), table(spark, d, "subject_areas", "subject"), doc="doc_id", text="text", subject="subject")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and sentences of each subject."""
    return _subjects(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_sentences").alias("n_sentences"))


QUERIES = {f.__name__: f for f in (p1_found, p1_events, p2_found, p7_found, p7_items, p7_cleaned, p8_mixture, p8_shares, p9_found, p9_composition)}


def _canon(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce({c}, ''))), '[\\s_-]+', '_', 'g'), '^_+|_+$', '', 'g'), '\\.0$', '')"


_RUNS = f"""
WITH now AS (
  SELECT video, frame, max(struct_pack(l := loaded_at, t := time_seconds, p := nearest_player_id, s := ball_state)) AS z FROM association
  WHERE video IS NOT NULL AND frame IS NOT NULL GROUP BY 1, 2),
canon AS (SELECT video, frame, CASE WHEN isnan(z.t) THEN NULL ELSE z.t END AS t, {_canon('z.p')} AS p0, {_canon('z.s')} AS s FROM now),
events AS (SELECT video, frame, t, CASE WHEN p0 IN ('none', 'nan', 'null') THEN '' ELSE p0 END AS p, s FROM canon),
flagged AS (
  SELECT *, CASE WHEN lag(p) OVER w = p AND lag(s) OVER w = s AND frame - lag(frame) OVER w <= {MAX_GAP} THEN 0 ELSE 1 END AS new
  FROM events WINDOW w AS (PARTITION BY video ORDER BY frame)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY video ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM flagged),
collapsed AS (
  SELECT video, nullif(any_value(p), '') AS player_id, nullif(any_value(s), '') AS ball_state, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n_rows,
         round(max(struct_pack(f := frame, t := t)).t - min(struct_pack(f := frame, t := t)).t, 3) AS duration_seconds
  FROM runs GROUP BY video, run HAVING count(*) >= 2)
"""

ORACLES = {
    "p1_found": _RUNS + "SELECT video, first_frame, last_frame FROM collapsed",
    "p1_events": _RUNS + "SELECT * FROM collapsed",
    "p2_found": f"""WITH now AS (SELECT video, frame, player_id, max(struct_pack(l := loaded_at, x := foot_x)).x AS x FROM player_detections GROUP BY 1, 2, 3),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY video, frame ORDER BY x DESC, player_id) AS r FROM now WHERE x IS NOT NULL AND NOT isnan(x))
      SELECT video, frame, player_id FROM ranked WHERE r <= {TOP}""",
}
