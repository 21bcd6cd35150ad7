"""Majority votes, track summaries and exclusions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.sequence import first_per, neighbours


def majority(df: DataFrame, *, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """The most frequent value of each key (ties: the smaller value), its share, and the mean ``weight`` of its rows."""
    votes = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("votes"), F.avg(weight or F.lit(1.0)).alias("mean_weight"))
    total = F.sum("votes").over(Window.partitionBy(*keys))
    top = first_per(votes.withColumn("total", total), keys, [F.desc("votes"), F.asc(value)])
    return top.withColumn("share", F.col("votes") / F.col("total"))


def team_vote(segments: DataFrame, votes: DataFrame, *, keys: list[str], least_share: float = 0.65) -> DataFrame:
    """Segments with the team their frames vote for; under ``least_share`` the team is "unknown", no votes count as zero."""
    known = votes.filter(F.col("team").isNotNull() & ~F.col("team").isin("", "unknown"))
    top = majority(known, keys=keys, value="team", weight="confidence")
    top = top.select(*keys, F.when(F.col("share") < least_share, "unknown").otherwise(F.col("team")).alias("team"), F.col("share").alias("team_vote_share"), F.col("votes").alias("team_vote_frames"), F.col("total").alias("team_vote_total_frames"), F.col("mean_weight").alias("team_mean_confidence"))
    out = segments.drop("team").join(top, keys, "left")
    return out.fillna({"team": "unknown", "team_vote_share": 0.0, "team_vote_frames": 0, "team_vote_total_frames": 0, "team_mean_confidence": 0.0})


def label_summary(df: DataFrame, *, key: str, label: str, frame: str) -> DataFrame:
    """Per key: votes, majority label and share, first and last frame, and the labels seen, most frequent first."""
    votes = df.groupBy(key, label).agg(F.count(F.lit(1)).alias("n"), F.min(frame).alias("f0"), F.max(frame).alias("f1"))
    seen = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.coalesce(label, F.lit("")).alias("l")))), lambda x: x["l"]), ";")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.coalesce(label, F.lit("")).alias("l")))
    out = votes.groupBy(key).agg(F.sum("n").alias("rows_labelled"), best.alias("b"), F.min("f0").alias("first_frame"), F.max("f1").alias("last_frame"), seen.alias("labels_seen"))
    return out.select(key, "rows_labelled", F.col("b.l").alias("majority_label"), (-F.col("b.n") / F.col("rows_labelled")).alias("majority_share"), "first_frame", "last_frame", "labels_seen")


def track_stability(tracks: DataFrame, fps: float, *, by: list[str], track: str, stable_s: float = 2.0, jump: float = 35.0, tie: list[str] = ()) -> DataFrame:
    """Per track: span, coverage, confidence, boxes, gaps, steps and a stability flag (the last rule that holds wins)."""
    keys = [*by, track]
    steps = neighbours(tracks, by=keys, order="frame", columns=["frame", "foot_x", "foot_y"], tie=tie)
    df, dx, dy = F.col("frame") - F.col("prev_frame"), F.col("foot_x") - F.col("prev_foot_x"), F.col("foot_y") - F.col("prev_foot_y")
    steps = steps.withColumns({"step": F.sqrt(dx * dx + dy * dy) / F.greatest(df, F.lit(1)), "df": df, "w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")})
    span = F.max("frame") - F.min("frame") + 1
    out = steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("detections"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), span.alias("span_frames"), (F.count(F.lit(1)) / span).alias("coverage_rate"),
        F.avg("confidence").alias("mean_confidence"), F.median("confidence").alias("median_confidence"), F.median("h").alias("median_box_height"), F.median("w").alias("median_box_width"),
        F.count_if(F.col("df") > 1).alias("gap_count"), F.coalesce(F.max(F.when(F.col("df") > 1, F.col("df"))), F.lit(0)).alias("max_gap_frames"),
        F.count_if(F.col("step") > jump).alias("big_jump_count"), F.coalesce(F.max("step"), F.lit(0.0)).alias("max_step"), F.coalesce(F.median("step"), F.lit(0.0)).alias("median_step"),
    )
    least = max(2, round(stable_s * fps))
    long, full, jumpy = F.col("detections") >= least, F.col("coverage_rate") >= 0.5, F.col("big_jump_count") >= 3
    flag = F.when(long & full & ~jumpy, "stable").when(long & jumpy, "jumpy_track").when(long & ~full, "gappy_track").when(~long, "short_track").otherwise("ok")
    return out.withColumns({"is_stable": long, "stability_flag": flag})


def remap_ids(df: DataFrame, mapping: DataFrame, *, keys: list[str], old: str, new: str, order: str) -> DataFrame:
    """Replaces ids that the mapping knows (its first row a key counts) and says which were replaced."""
    first = first_per(mapping, [*keys, old], [F.asc(order)]).select(*keys, F.col(old).cast("string").alias("_old"), F.col(new).cast("string").alias("_new"))
    out = df.withColumn("_old", F.col(old).cast("string")).join(first, [*keys, "_old"], "left")
    return out.withColumns({f"original_{old}": F.col("_old"), old: F.coalesce("_new", "_old"), "id_source": F.when(F.col("_new").isNotNull(), "remapped").otherwise("original")}).drop("_old", "_new")


def with_vote_confidence(df: DataFrame) -> DataFrame:
    """The confidence of a voted team: the lesser of its share and of its votes' mean confidence."""
    return df.withColumn("confidence", F.least("team_vote_share", F.coalesce("team_mean_confidence", F.lit(0.0))))


def track_involvement(stability: DataFrame, tracks: DataFrame, association: DataFrame, chain: DataFrame, *, by: list[str], track: str) -> DataFrame:
    """Tracks with the rows in which they were nearest (``association.player``), nearest to a controlled ball, and in possession (``chain``), and their rows by
    zone; 0 where there is none. Track ids meet as whole numbers."""
    number = lambda c: F.col(c).try_cast("double").cast("bigint").alias(track)
    near = association.filter("player is not null").groupBy(*by, number("player")).agg(F.count(F.lit(1)).alias("nearest_rows"), F.count_if(F.col("state") == "controlled").alias("controlled_nearest_rows"))
    held = chain.filter("possession_player is not null").groupBy(*by, number("possession_player")).agg(F.count(F.lit(1)).alias("possession_rows"))
    zones = tracks.groupBy(*by, track).agg(F.count_if(F.col("field_zone") == "strict").alias("strict_rows"), F.count_if(F.col("field_zone") == "tolerant").alias("tolerant_rows"))
    out = stability
    for part in (zones, near, held):
        out = out.join(part, [*by, track], "left")
    return out.fillna(0, ["strict_rows", "tolerant_rows", "nearest_rows", "controlled_nearest_rows", "possession_rows"])


def exclude_unstable(rows: DataFrame, flags: DataFrame, *, by: list[str], player: str, unstable: tuple[str, ...] = ("jumpy_track", "gappy_track")) -> DataFrame:
    """Rows with their player's ``stability_flag`` and ``excluded`` set where that is unstable (or was set before)."""
    out = rows.join(flags, [*by, player], "left")
    return out.withColumn("excluded", F.coalesce("excluded", F.lit(False)) | F.coalesce(F.col("stability_flag").isin(*unstable), F.lit(False)))


def exclusion_keys(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """All keys that any part excludes, each once."""
    return reduce(DataFrame.union, [p.select(*keys) for p in parts]).distinct()


def majority_exclusions(rows: DataFrame, votes: DataFrame, *, keys: list[str], label: str, gone: str, least_votes: int = 1, least_share: float = 0.67) -> tuple[DataFrame, DataFrame]:
    """Rows kept and rows removed: removed are those whose key's majority label is ``gone``, by enough votes and a large enough share."""
    best = majority(votes, keys=keys, value=label).filter((F.col(label) == gone) & (F.col("total") >= least_votes) & (F.col("share") >= least_share)).select(*keys)
    return rows.join(best, keys, "left_anti"), rows.join(best, keys, "left_semi")


def track_rates(tracked: DataFrame, *, by: list[str], track: str) -> DataFrame:
    """Per sequence: detections, tracks, their median length, the frame rate as seen, tracks of two seconds or more, and the share of new detections."""
    lengths = tracked.groupBy(*by, track).agg(F.count(F.lit(1)).alias("_n"))
    seconds = F.max("time_seconds") - F.min("time_seconds")
    whole = tracked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("detections"), F.try_divide(F.max("frame") - F.min("frame"), F.when(seconds > 0, seconds)).alias("fps_estimate"), F.avg((F.col("track_status") == "new").cast("int")).alias("new_detection_rate"),
    )
    least = F.greatest(F.lit(2.0), F.rint(F.coalesce("fps_estimate", F.lit(1.0)) * 2))
    out = lengths.join(whole, by).groupBy(*by, "detections", "fps_estimate", "new_detection_rate")
    return out.agg(F.count(F.lit(1)).alias("tracks"), F.median("_n").alias("median_track_detections"), F.count_if(F.col("_n") >= least).alias("long_tracks_2s"))
