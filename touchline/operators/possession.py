"""Labels, possessions and passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.associate import overlap_join, stamp_intervals
from touchline.operators.sequence import neighbours, running_count

#: The action vocabulary of annotated ball actions, and the actions that show control of the ball.
ACTION_LABELS = ("PASS", "DRIVE", "HEADER", "HIGH PASS", "OUT", "CROSS", "THROW IN", "SHOT", "BALL PLAYER BLOCK", "PLAYER SUCCESSFUL TACKLE", "FREE KICK", "GOAL")
CONTROL_ACTIONS = ("pass", "drive", "header", "high_pass", "cross", "shot", "throw_in", "free_kick", "player_successful_tackle")
HALF_SECONDS = 2700


def normalise_actions(df: DataFrame, fps: float = 25.0) -> DataFrame:
    """Upper-case label, type, time within the half, and frame (half-up); labels outside the vocabulary are flagged."""
    label = F.upper(F.trim(F.coalesce("original_label", F.lit(""))))
    time = F.when((F.col("half") == 2) & (F.col("source_time") >= HALF_SECONDS), F.col("source_time") - HALF_SECONDS).otherwise(F.col("source_time"))
    return df.withColumns({"label": label, "type": F.lower(F.replace(label, F.lit(" "), F.lit("_"))), "time": time}).withColumns(
        {"action_frame": F.floor(F.col("time") * fps + 0.5).cast("int"), "known_label": F.col("label").isin(*ACTION_LABELS), "player": F.coalesce("player", F.lit("")), "team": F.coalesce("team", F.lit("")), "visibility": F.coalesce("visibility", F.lit("unknown"))}
    )


def possessions_from_actions(actions: DataFrame, *, by: list[str], longest: float = 8.0, last: float = 2.0) -> DataFrame:
    """Controlled stretches from each control action to the next action of any type, ``longest`` seconds at most."""
    out = neighbours(actions, by=by, order="time", columns=["time"], tie=["id"], previous=False, following=True, block=600.0)
    end = F.least(F.coalesce("next_time", F.col("time") + last), F.col("time") + longest)
    out = out.filter(F.col("type").isin(*CONTROL_ACTIONS) & (F.col("team") != "") & (F.col("player") != ""))
    out = out.select(*by, F.col("id").alias("source_action_id"), F.col("time").alias("start"), end.alias("end"), F.lit("controlled").alias("state"), "team", "player", F.when(F.col("visibility") == "visible", 0.75).otherwise(0.5).alias("confidence"))
    return out.filter(F.col("end") > F.col("start"))


def invalid_labels(df: DataFrame) -> DataFrame:
    """Labels that lack a start, end or state, end too early, or are controlled without team or player, with all their errors."""
    no = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    controlled = F.lower(F.col("state")) == "controlled"
    errors = F.array_compact(F.array(
        F.when(F.col("start").isNull() | F.isnan("start"), "missing_start"), F.when(F.col("end").isNull() | F.isnan("end"), "missing_end"), F.when(no("state"), "missing_state"),
        F.when(~F.isnan("start") & ~F.isnan("end") & (F.col("end") <= F.col("start")), "end_not_after_start"), F.when(controlled & no("team"), "missing_team"), F.when(controlled & no("player"), "missing_player"),
    ))
    return df.withColumn("errors", F.array_join(errors, ";")).filter(F.col("errors") != "")


def passes(labels: DataFrame, *, by: list[str], max_gap: float = 2.0, allow_unknown: bool = False, non_live: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pass events between successive controlled labels, and the pairs skipped with their reason.

    ``labels`` has start, end, state, team, player, id, confidence (null counts as 1). In order: another player, a gap of 0 to
    ``max_gap``, known teams (else skipped, or a transition where allowed), equal teams, no overlap with ``non_live`` (columns ``by``, start, end, reason, rank; ends
    count, the smallest rank gives the reason). Events are numbered per ``by`` in order.
    """
    controlled = labels.filter((F.lower(F.col("state")) == "controlled") & (F.trim(F.coalesce("team", F.lit(""))) != "") & (F.trim(F.coalesce("player", F.lit(""))) != ""))
    fields = ["start", "end", "team", "player", "id", "confidence"]
    pairs = neighbours(controlled, by=by, order="start", columns=fields, tie=["id"], previous=False, following=True, block=600.0)
    pairs = pairs.withColumn("to", F.struct(*[F.col(f"next_{c}").alias(c) for c in fields])).filter("to.id is not null").withColumn("gap", F.col("to.start") - F.col("end"))
    pairs = pairs.filter((F.col("player") != F.col("to.player")) & F.col("gap").between(0, max_gap))
    unknown = _unknown(F.col("team")) | _unknown(F.col("to.team"))
    pairs = pairs.withColumn("unknown", unknown).filter(F.col("unknown") | (F.col("team") == F.col("to.team")))
    pairs = pairs.select(
        *by, F.col("id").alias("from_possession_id"), F.col("to.id").alias("to_possession_id"), "team", F.col("player").alias("from_player"), F.col("to.player").alias("to_player"),
        F.col("end").alias("start"), F.col("to.start").alias("end"), F.col("gap").alias("duration"), F.least(F.coalesce("confidence", F.lit(1.0)), F.coalesce("to.confidence", F.lit(1.0))).alias("confidence"),
        "unknown", F.col("start").alias("_from"), F.col("to.end").alias("_until"),
    )
    if non_live is None:
        pairs = pairs.withColumn("_dead", F.lit(None).cast("string"))
    else:
        iv = non_live.select(*by, F.col("start").alias("_s"), F.col("end").alias("_e"), "reason", "rank")
        met = overlap_join(pairs.select(*by, "from_possession_id", "_from", "_until"), iv, by=by, left_ends=("_from", "_until"), right_ends=("_s", "_e"))
        hit = met.groupBy(*by, "from_possession_id").agg(F.min_by("reason", "rank").alias("_dead"))
        pairs = pairs.join(hit, [*by, "from_possession_id"], "left")
    reason = F.when(F.col("unknown") & F.lit(not allow_unknown), "unknown_team").when(F.col("_dead").isNotNull(), F.concat(F.lit("non_live:"), "_dead"))
    pairs = pairs.withColumn("skip_reason", reason)
    events = running_count(pairs.filter("skip_reason is null"), by=by, order="_from", flag=F.lit(True), name="_k", tie=["from_possession_id"], block=600.0)
    events = events.withColumn("id", F.format_string("event_%04d", F.col("_k"))).withColumn("type", F.when(F.col("unknown"), "possession_transition_candidate").otherwise("completed_pass_candidate"))
    return events.drop("unknown", "_from", "_until", "_k", "_dead", "skip_reason"), pairs.filter("skip_reason is not null").select(*by, "from_possession_id", "to_possession_id", "from_player", "to_player", "start", "end", "skip_reason")


def _unknown(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("", "unknown", "none", "nan", "unclear")


def state_transitions(df: DataFrame) -> DataFrame:
    """Rows whose state differs from the row before (``prev_*`` columns as of ``neighbours``); both are known."""
    return df.filter(F.col("ball_state").isNotNull() & F.col("prev_ball_state").isNotNull() & (F.col("ball_state") != F.col("prev_ball_state")))


def time_weighted_accuracy(truth: DataFrame, guess: DataFrame, *, by: list[str]) -> DataFrame:
    """Seconds in which the predicted state, team and player agree with the truth, and the seconds evaluated.

    All boundaries of both cut time into slices; the first interval that holds a slice counts. State is judged
    wherever there is truth, team and player only where the truth is controlled.
    """
    points = truth.select(*by, "start", "end").unionByName(guess.select(*by, "start", "end"))
    points = points.select(*by, F.explode(F.array("start", "end")).alias("_a")).filter("_a is not null").distinct()
    slices = neighbours(points, by=by, order="_a", columns=["_a"], previous=False, following=True, block=600.0).withColumnRenamed("next__a", "_z").filter("_z is not null")
    got = slices.withColumns({"_m": (F.col("_a") + F.col("_z")) / 2, "_row": F.struct(*by, "_a"), "_len": F.col("_z") - F.col("_a")})
    for df, name in ((truth, "_t"), (guess, "_g")):
        iv = df.withColumns({name: F.struct("state", "team", "player"), "_rank": F.struct("start", "id")})
        got = stamp_intervals(got, iv, by=by, time="_m", start="start", end="end", rank="_rank", columns=[name], row="_row", last_wins=False)
    got = got.filter("_t is not null")
    controlled = F.col("_t.state") == "controlled"
    secs = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("_len"))), F.lit(0.0))
    return got.groupBy(*by).agg(
        F.sum("_len").alias("evaluated_seconds"), secs(controlled).alias("controlled_seconds"), secs(F.col("_t.state") == F.col("_g.state")).alias("state_seconds"),
        secs(controlled & (F.col("_t.team") == F.col("_g.team"))).alias("team_seconds"), secs(controlled & (F.col("_t.player") == F.col("_g.player"))).alias("player_seconds"),
    )


def label_document(labels: DataFrame, *, by: list[str]) -> DataFrame:
    """One JSON document a group: its valid segments by start and end."""
    seg = F.struct("start", "end", "id", "state", "team", "player", "confidence")
    return labels.filter(F.col("end") > F.col("start")).groupBy(*by).agg(F.to_json(F.array_sort(F.collect_list(seg))).alias("segments"), F.count(F.lit(1)).alias("n_segments"))


EVENT_FIELDS = ("id", "schema_version", "match_id", "clip", "half", "type", "team", "from_player", "to_player", "start", "end", "duration", "from_possession_id", "to_possession_id", "from_source_action_id", "to_source_action_id", "from_source_note", "confidence", "review_status", "notes")
SKIPPED_FIELDS = ("from_possession_id", "to_possession_id", "start", "end", "reason", "game_state_label", "restart_type", "source_review_id")
#: The notes an event carries.
NOTES = {
    "completed_pass_candidate": "Derived from consecutive reviewed controlled possessions.",
    "possession_transition_candidate": "Derived from consecutive controlled possessions with unknown team identity; requires team classification before it can be treated as a completed pass.",
}


def event_rows(labels: DataFrame, *, by: list[str], max_gap: float = 2.0, allow_unknown: bool = False, non_live: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Events in the twenty fields of an event document, and the pairs skipped, with the columns ``by``.

    ``labels`` has start, end, state, team, player, id, clip, confidence (null counts as 1), source_action_id and notes (nulls are ''). The rules are those of ``passes``; ``non_live`` has
    ``by``, start, end, game_state_label, restart_type and source_review_id, of several the one with the smallest source_review_id counts.
    """
    full = lambda c: F.coalesce(F.col(c), F.lit(""))
    controlled = labels.filter((F.col("state") == "controlled") & (full("team") != "") & (full("player") != "")).withColumns({c: full(c) for c in ("clip", "source_action_id", "notes")})
    fields = ["start", "end", "team", "player", "id", "confidence", "source_action_id"]
    pairs = neighbours(controlled, by=by, order="start", columns=fields, tie=["id"], previous=False, following=True, block=600.0).filter("next_id is not null")
    gap, unknown = F.col("next_start") - F.col("end"), _unknown(F.col("team")) | _unknown(F.col("next_team"))
    pairs = pairs.withColumns({"gap": gap, "unknown": unknown}).filter((F.col("player") != F.col("next_player")) & F.col("gap").between(0, max_gap) & (F.col("unknown") | (F.col("team") == F.col("next_team"))))
    if non_live is None:
        pairs = pairs.withColumn("stop", F.lit(None).cast("struct<source_review_id: string, game_state_label: string, restart_type: string>"))
    else:
        iv = non_live.select(*by, F.col("start").alias("_s"), F.col("end").alias("_e"), F.struct("source_review_id", "game_state_label", "restart_type").alias("_v"))
        met = overlap_join(pairs.select(*by, "id", F.col("start").alias("_from"), F.col("next_end").alias("_until")), iv, by=by, left_ends=("_from", "_until"), right_ends=("_s", "_e"))
        pairs = pairs.join(met.groupBy(*by, "id").agg(F.min("_v").alias("stop")), [*by, "id"], "left")
    nameless = F.col("unknown") & F.lit(not allow_unknown)
    reason = F.when(nameless, "unknown_team_identity").when(F.col("stop").isNotNull(), "non_live_game_state_overlap")
    pairs = pairs.withColumn("reason", reason)
    skipped = pairs.filter("reason is not null").select(
        *by, F.col("id").alias("from_possession_id"), F.col("next_id").alias("to_possession_id"), F.col("end").alias("start"), F.col("next_start").alias("end"), "reason",
        *[F.when(nameless, "").otherwise(F.coalesce(f"stop.{c}", F.lit(""))).alias(c) for c in ("game_state_label", "restart_type", "source_review_id")],
    )
    kept = running_count(pairs.filter("reason is null"), by=by, order="start", flag=F.lit(True), name="_k", tie=["id"], block=600.0)
    kind = F.when(F.col("unknown"), "possession_transition_candidate").otherwise("completed_pass_candidate")
    one = lambda c: F.coalesce(F.col(c), F.lit(1.0))
    events = kept.select(
        F.format_string("event_%04d", F.col("_k")).alias("id"), F.lit("0.1").alias("schema_version"), *[c for c in by if c not in EVENT_FIELDS], *[c for c in ("match_id", "clip", "half") if c in kept.columns], kind.alias("type"), "team",
        F.col("player").alias("from_player"), F.col("next_player").alias("to_player"), F.col("end").alias("start"), F.col("next_start").alias("end"), F.col("gap").alias("duration"), F.col("id").alias("from_possession_id"),
        F.col("next_id").alias("to_possession_id"), F.col("source_action_id").alias("from_source_action_id"), F.coalesce("next_source_action_id", F.lit("")).alias("to_source_action_id"), F.col("notes").alias("from_source_note"),
        F.least(one("confidence"), one("next_confidence")).alias("confidence"), F.lit("candidate").alias("review_status"), F.when(F.col("unknown"), NOTES["possession_transition_candidate"]).otherwise(NOTES["completed_pass_candidate"]).alias("notes"),
    )
    return events, skipped


def event_documents(labels: DataFrame, *, by: list[str], source: str = "", game_state: str = "", **rules) -> DataFrame:  # noqa: ANN003
    """One document a group of ``by``: its counts, events and skipped pairs, in order; groups of labels without events have empty lists.

    A document holds the events of one group (a match half), which a person's labels bound; nothing larger is gathered.
    """
    events, skipped = event_rows(labels, by=by, **rules)
    gathered = lambda df, names, name: df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*[c for c in names if c in df.columns]))).alias(name))
    docs = labels.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("clip") != "", F.col("clip"))), F.lit("")).alias("clip"))
    docs = docs.join(gathered(events, EVENT_FIELDS, "events"), by, "left").join(gathered(skipped, SKIPPED_FIELDS, "skipped_events"), by, "left")
    none = {c: F.array().cast(docs.schema[c].dataType) for c in ("events", "skipped_events")}
    docs = docs.withColumns({c: F.coalesce(c, none[c]) for c in none})
    return docs.select(F.lit("0.1").alias("schema_version"), F.lit(source).alias("source_labels"), *by, "clip", F.size("events").alias("event_count"), F.size("skipped_events").alias("skipped_event_count"), F.lit(game_state).alias("game_state_intervals"), "events", "skipped_events")
