"""Further queries of the operator inventory over the domain tables: events, track involvement, review batches, features; beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.ids import words_state
from touchline.operators import associate, evaluate, motion, possession, quality, review, select, stateful, votes
from touchline.operators.sequence import first_per, neighbours, running_count
from touchline.plans import automata, reference, views
from touchline.plans.views import FPS, STRICT, with_views
from touchline.sources.tables import latest, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
V, T = ["video"], ["detection_id"]
_MOVED = reference._MOTION


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(with_views("balls") + "SELECT detection_id FROM balls WHERE center_y < 900")
def upper_readings(s, d):  # noqa: ANN001, ANN201
    return views.balls(s, d).filter("center_y < 900").select("detection_id")


@query(with_views("assoc") + "SELECT video, frame, state FROM assoc WHERE time BETWEEN 10 AND 60")
def time_window(s, d):  # noqa: ANN001, ANN201
    return select.between(views.association(s, d), "time", 10.0, 60.0).select("video", "frame", "state")


@query(reference._STEPS + "SELECT video, event_type, count(*) AS n, round(sum(end_x - start_x), 4) AS progress FROM acts WHERE event_type = 'pass' AND end_x - start_x > 20 GROUP BY 1, 2")
def progressive_passes(s, d):  # noqa: ANN001, ANN201
    p = reference._steps(s, d).filter("event_type = 'pass'").withColumn("progress_distance", F.col("end_x") - F.col("start_x")).filter("progress_distance > 20")
    return p.groupBy("video", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("progress_distance"), 4).alias("progress"))


@query(with_views("labels") + "SELECT match_id, arg_min(team, struct_pack(h := half, s := s, i := id)) AS first_team FROM labels WHERE coalesce(team, '') <> '' AND s IS NOT NULL GROUP BY 1")
def first_team(s, d):  # noqa: ANN001, ANN201
    lab = views.labels(s, d).filter("coalesce(team, '') <> '' and start is not null")
    return lab.groupBy("match_id").agg(F.min_by("team", F.struct("half", "start", "id")).alias("first_team"))


@query(with_views("labels", "actions") + """, names AS (SELECT match_id, player, min(team) AS known_team FROM labels WHERE player <> '' AND coalesce(team, '') <> '' GROUP BY 1, 2)
SELECT a.match_id, a.half, a.id, a.player, n.known_team FROM actions a LEFT JOIN names n ON a.match_id = n.match_id AND a.player = n.player""")
def player_lookup(s, d):  # noqa: ANN001, ANN201
    names = views.labels(s, d).filter("player <> '' and coalesce(team, '') <> ''").groupBy("match_id", "player").agg(F.min("team").alias("known_team"))
    return views.actions(s, d).select("match_id", "half", "id", "player").join(names, ["match_id", "player"], "left")


@query(with_views("players", "assoc") + """SELECT a.video, a.frame, a.player, p.field_zone FROM assoc a LEFT JOIN players p ON p.video = a.video AND p.frame = a.frame AND p.player_id = try_cast(a.player AS INTEGER)""")
def frames_with_zone(s, d):  # noqa: ANN001, ANN201
    zones = views.players(s, d).select("video", "frame", F.col("player_id").cast("string").alias("player"), "field_zone")
    return views.association(s, d).select("video", "frame", "player").join(zones, ["video", "frame", "player"], "left")


@query(with_views("balls") + """, g AS (SELECT video, detection_id, time_seconds, time_seconds - lag(time_seconds) OVER (PARTITION BY video ORDER BY time_seconds, detection_id) AS gap FROM balls),
r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY gap DESC, detection_id) AS rank FROM g WHERE gap >= 2) SELECT video, detection_id, round(time_seconds, 6) AS gap_end, round(gap, 6) AS gap_seconds, rank FROM r WHERE rank <= 15""")
def longest_gaps(s, d):  # noqa: ANN001, ANN201
    g = quality.longest_gaps(views.balls(s, d), 15, by=V, row="detection_id")
    return g.select("video", "detection_id", F.round("time_seconds", 6).alias("gap_end"), F.round("gap", 6).alias("gap_seconds"), "rank")


# --- the possession chain: frames, summary, sweeps, exclusion of unstable tracks

#: SQL: what holds at every row, after the views of ``automata.chain_sql``.
FRAMES_SQL = """,
told AS (SELECT o.video, o.frame, o.player, o.state, o.ev, o.time, r.owner, r.seg, r.cand, r.seen, r.cfrom, r.c_why, p.owner AS had FROM rec r JOIN o ON o.video = r.video AND o.rn = r.rn JOIN rec p ON p.video = r.video AND p.rn = r.rn - 1),
pf AS (SELECT *, CASE WHEN ev AND player IS NOT DISTINCT FROM owner THEN 'controlled' WHEN ev AND had IS NULL THEN 'pending_control' WHEN ev THEN 'in_transit' ELSE state END AS possession_state,
  CASE WHEN ev AND player IS NOT DISTINCT FROM owner AND player IS DISTINCT FROM had THEN 'confirmed_new_controller' WHEN ev AND had IS NOT NULL AND player IS DISTINCT FROM owner THEN 'candidate_controller_not_confirmed'
    WHEN NOT ev AND had IS NOT NULL AND owner IS NULL THEN 'carry_forward_timeout' ELSE '' END AS why FROM told)"""
_FRAMES = automata._CHAIN_SQL + FRAMES_SQL

ORACLES["possession_frames"] = _FRAMES + """ SELECT video, frame, possession_state, CASE WHEN possession_state = 'pending_control' THEN NULL ELSE owner END AS possession_player, CASE WHEN owner IS NOT NULL THEN seg END AS segment, why AS transition_reason FROM pf"""


@query(_FRAMES + """, n AS (SELECT video, count(*) FILTER (possession_state = 'controlled') AS controlled_frames, count(*) FILTER (possession_state = 'in_transit') AS in_transit_frames, count(*) FILTER (possession_state = 'loose_or_unclear') AS loose_or_unclear_frames,
  count(*) FILTER (possession_state = 'pending_control') AS pending_control_frames FROM pf GROUP BY 1), z AS (SELECT video, count(*) AS segments, round(sum(greatest(0, t1 - t0)), 4) AS total_seconds, round(median(greatest(0, t1 - t0)), 4) AS median_seconds FROM segs GROUP BY 1)
SELECT n.*, coalesce(segments, 0) AS segments, coalesce(total_seconds, 0) AS total_seconds, coalesce(median_seconds, 0) AS median_seconds FROM n LEFT JOIN z USING (video)""")
def chain_summary(s, d):  # noqa: ANN001, ANN201
    rows = views.association(s, d)
    out = stateful.chain_summary(stateful.possession_frames(rows, by=V, spec=automata.CHAIN), stateful.possession_segments(rows, by=V, spec=automata.CHAIN), by=V)
    return out.withColumns({c: F.round(c, 4) for c in ("total_seconds", "median_seconds")})


@query(_FRAMES + """ SELECT video, frame, coalesce(round(CASE WHEN owner IS NOT NULL THEN time - cfrom END, 6), 0) AS carry_forward_seconds, CASE WHEN cand IS NOT NULL THEN seen ELSE 0 END AS pending_confirm_frames, cand AS pending_player FROM pf""")
def carried_frames(s, d):  # noqa: ANN001, ANN201
    p = stateful.possession_frames(views.association(s, d), by=V, spec=automata.CHAIN)
    return p.select("video", "frame", F.coalesce(F.round("carried_seconds", 6), F.lit(0.0)).alias("carry_forward_seconds"), F.col("pending_rows").alias("pending_confirm_frames"), "pending_player")


@query(with_views("assoc") + """, c AS (SELECT video, player, lag(player) OVER (PARTITION BY video ORDER BY frame) AS was, row_number() OVER (PARTITION BY video ORDER BY frame) AS i FROM assoc WHERE state = 'controlled')
SELECT video, count(*) FILTER (i = 1 OR player IS NULL OR was IS NULL OR player <> was) AS raw_switches, count(*) AS controlled_rows FROM c GROUP BY 1""")
def raw_switches(s, d):  # noqa: ANN001, ANN201
    rows = neighbours(views.association(s, d).filter("state = 'controlled'"), by=V, order="frame", columns=["player"])
    # a missing player differs from everything, itself too; so does the first row
    switch = F.coalesce(F.col("player") != F.col("prev_player"), F.lit(True))
    return rows.groupBy("video").agg(F.count_if(switch).alias("raw_switches"), F.count(F.lit(1)).alias("controlled_rows"))


_STABLE = reference.ORACLES["track_stability"].split("SELECT video, player_id, detections")[0].replace(with_views("players"), "", 1)
_FLAG = "CASE WHEN detections >= 60 AND cov >= 0.5 AND big_jump_count < 3 THEN 'stable' WHEN detections >= 60 AND big_jump_count >= 3 THEN 'jumpy_track' WHEN detections >= 60 THEN 'gappy_track' ELSE 'short_track' END"
_INVOLVED = _FRAMES.replace("WITH RECURSIVE ", "WITH RECURSIVE " + views.SQL["players"] + ",\n", 1) + _STABLE + f""",
st AS (SELECT video, player_id, detections, {_FLAG} AS stability_flag FROM a), zn AS (SELECT video, player_id, count(*) FILTER (field_zone = 'strict') AS strict_rows, count(*) FILTER (field_zone = 'tolerant') AS tolerant_rows FROM players GROUP BY 1, 2),
nr AS (SELECT video, try_cast(player AS INTEGER) AS player_id, count(*) AS nearest_rows, count(*) FILTER (state = 'controlled') AS controlled_nearest_rows FROM assoc WHERE player IS NOT NULL GROUP BY 1, 2),
pr AS (SELECT video, try_cast(owner AS INTEGER) AS player_id, count(*) AS possession_rows FROM pf WHERE owner IS NOT NULL AND possession_state <> 'pending_control' GROUP BY 1, 2),
inv AS (SELECT st.*, strict_rows, tolerant_rows, coalesce(nearest_rows, 0) AS nearest_rows, coalesce(controlled_nearest_rows, 0) AS controlled_nearest_rows, coalesce(possession_rows, 0) AS possession_rows
  FROM st JOIN zn USING (video, player_id) LEFT JOIN nr USING (video, player_id) LEFT JOIN pr USING (video, player_id))"""


def _involvement(s: SparkSession, d: str) -> DataFrame:
    rows, players = views.association(s, d), views.players(s, d)
    chain = stateful.possession_frames(rows, by=V, spec=automata.CHAIN)
    return votes.track_involvement(votes.track_stability(players, FPS, by=V, track="player_id"), players, rows, chain, by=V, track="player_id")


@query(_INVOLVED + " SELECT * FROM inv")
def track_involvement(s, d):  # noqa: ANN001, ANN201
    return _involvement(s, d).select("video", "player_id", "detections", "stability_flag", "strict_rows", "tolerant_rows", "nearest_rows", "controlled_nearest_rows", "possession_rows")


@query(_INVOLVED + """, r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY possession_rows DESC, controlled_nearest_rows DESC, nearest_rows DESC, detections DESC, player_id) AS rank FROM inv
  WHERE stability_flag <> 'stable' AND nearest_rows + controlled_nearest_rows + possession_rows > 0) SELECT video, player_id, stability_flag, possession_rows, rank FROM r WHERE rank <= 20""")
def trouble_tracks(s, d):  # noqa: ANN001, ANN201
    t = _involvement(s, d).filter("stability_flag <> 'stable' and nearest_rows + controlled_nearest_rows + possession_rows > 0")
    order = [*(F.desc(c) for c in ("possession_rows", "controlled_nearest_rows", "nearest_rows", "detections")), F.asc("player_id")]
    return select.top(t, 20, by=V, order=order, rank="rank").select("video", "player_id", "stability_flag", "possession_rows", "rank")


_JUMPY = "(SELECT video, player_id, " + _FLAG + " AS flag FROM a)"


@query(automata.chain_sql(5, source=f"""(SELECT s.* REPLACE (CASE WHEN s.state = 'controlled' AND f.flag IN ('jumpy_track', 'gappy_track') THEN 'in_transit' ELSE s.state END AS state) FROM assoc s LEFT JOIN {_JUMPY} f ON f.video = s.video AND f.player_id = try_cast(s.player AS INTEGER))""",
                          before=views.SQL["players"] + _STABLE) + " SELECT video, segment, player_id, f0 AS start_frame, f1 AS end_frame, why AS end_reason FROM segs")
def possession_without_unstable(s, d):  # noqa: ANN001, ANN201
    """The chain with the tracks' stability looked up before it: rows of jumpy or gappy tracks are no evidence."""
    flags = votes.track_stability(views.players(s, d), FPS, by=V, track="player_id").select("video", F.col("player_id").cast("string").alias("player"), "stability_flag")
    rows = votes.exclude_unstable(views.association(s, d), flags, by=V, player="player")
    p = stateful.possession_segments(rows, by=V, spec=automata.CHAIN)
    return p.select("video", "segment", "player_id", "start_frame", "end_frame", "end_reason")


# --- events

_EVENT_SQL = """, c AS (SELECT * FROM lab WHERE state = 'controlled' AND coalesce(team, '') <> '' AND coalesce(player, '') <> ''),
p AS (SELECT *, lead(s) OVER w AS ts, lead(e) OVER w AS te, lead(team) OVER w AS tt, lead(player) OVER w AS tp, lead(id) OVER w AS ti, lead(confidence) OVER w AS tc, lead(source_action_id) OVER w AS ta FROM c WINDOW w AS (PARTITION BY match_id, half ORDER BY s, id)),
q AS (SELECT *, lower(trim(team)) IN ('unknown', 'none', 'nan', 'unclear') OR lower(trim(tt)) IN ('unknown', 'none', 'nan', 'unclear') AS unk FROM p WHERE ti IS NOT NULL AND player <> tp AND ts - e BETWEEN 0 AND 2),
dead AS (SELECT q.match_id, q.half, q.id, min(struct_pack(r := l.id, w := l.state)) AS z FROM q JOIN lab l ON l.match_id = q.match_id AND l.half = q.half AND l.state = 'out_of_play' AND l.s <= q.te AND l.e >= q.s AND l.s <= l.e GROUP BY 1, 2, 3),
k AS (SELECT q.*, dead.z FROM q LEFT JOIN dead USING (match_id, half, id) WHERE unk OR team = tt)"""
_LAB = "WITH " + views.SQL["labels"].replace("labels AS (SELECT * EXCLUDE (rs) FROM (", "lab AS (SELECT * EXCLUDE (rs) FROM (").replace(f"{views._fin('confidence')} AS confidence,", f"{views._fin('confidence')} AS confidence, clip, source_action_id, notes,")


def _event_labels(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cols = ["start", "end", "state", "team", "player", "confidence", "review_status", "clip", "source_action_id", "notes"]
    df = table(s, d, "possession_labels", "match_id", "half", "id", "loaded_at", *cols).withColumn("half", F.coalesce("half", F.lit(1)))
    df = latest(df, ["match_id", "half", "id"], "loaded_at", cols).filter(F.coalesce(words_state("review_status"), F.lit("")) != "withdrawn")
    lab = df.withColumns({**{c: views.finite(c) for c in ("start", "end", "confidence")}, "player": views.clean_id("player")}).drop("review_status", "loaded_at")
    stops = lab.filter("state = 'out_of_play' and start <= end").select("match_id", "half", "start", "end", F.col("state").alias("game_state_label"), F.lit("").alias("restart_type"), F.col("id").alias("source_review_id"))
    return lab, stops


@query(_LAB + _EVENT_SQL + """SELECT printf('event_%04d', row_number() OVER (PARTITION BY match_id, half ORDER BY s, id)) AS id, '0.1' AS schema_version, match_id, coalesce(clip, '') AS clip, half, 'completed_pass_candidate' AS type, team, player AS from_player, tp AS to_player,
 round(e, 6) AS start_seconds, round(ts, 6) AS end_seconds, round(ts - e, 6) AS duration, id AS from_possession_id, ti AS to_possession_id, coalesce(source_action_id, '') AS from_source_action_id, coalesce(ta, '') AS to_source_action_id, coalesce(notes, '') AS from_source_note,
 least(coalesce(confidence, 1), coalesce(tc, 1)) AS confidence, 'candidate' AS review_status, 'Derived from consecutive reviewed controlled possessions.' AS notes FROM k WHERE NOT unk AND z IS NULL""")
def event_rows(s, d):  # noqa: ANN001, ANN201
    lab, stops = _event_labels(s, d)
    events, _ = possession.event_rows(lab, by=["match_id", "half"], non_live=stops)
    return events.withColumns({"start_seconds": F.round("start", 6), "end_seconds": F.round("end", 6), "duration": F.round("duration", 6)}).drop("start", "end")


@query(_LAB + _EVENT_SQL + """SELECT match_id, half, id AS from_possession_id, ti AS to_possession_id, CASE WHEN unk THEN 'unknown_team_identity' ELSE 'non_live_game_state_overlap' END AS reason, CASE WHEN unk THEN '' ELSE z.w END AS game_state_label,
 '' AS restart_type, CASE WHEN unk THEN '' ELSE z.r END AS source_review_id FROM k WHERE unk OR z IS NOT NULL""")
def event_skipped(s, d):  # noqa: ANN001, ANN201
    lab, stops = _event_labels(s, d)
    return possession.event_rows(lab, by=["match_id", "half"], non_live=stops)[1].drop("start", "end")


@query(_LAB + _EVENT_SQL + """, h AS (SELECT DISTINCT match_id, half FROM lab) SELECT h.match_id, h.half, count(k.id) FILTER (NOT unk AND z IS NULL) AS event_count, count(k.id) FILTER (unk OR z IS NOT NULL) AS skipped_event_count FROM h LEFT JOIN k USING (match_id, half) GROUP BY 1, 2""")
def event_documents(s, d):  # noqa: ANN001, ANN201
    """One document a half; what the SQL compares are its counts (the arrays' lengths)."""
    lab, stops = _event_labels(s, d)
    docs = possession.event_documents(lab, by=["match_id", "half"], non_live=stops)
    return docs.select("match_id", "half", F.size("events").cast("long").alias("event_count"), F.size("skipped_events").cast("long").alias("skipped_event_count"))


@query(_LAB + _EVENT_SQL + """SELECT match_id, half, player AS player, 'pass' AS kind, round(ts - e, 6) AS seconds FROM k WHERE NOT unk AND z IS NULL UNION ALL SELECT match_id, half, player, 'carry', round(e - s, 6) FROM lab WHERE state = 'controlled' AND e > s AND coalesce(player, '') <> ''""")
def passes_and_carries(s, d):  # noqa: ANN001, ANN201
    lab, stops = _event_labels(s, d)
    e = possession.event_rows(lab, by=["match_id", "half"], non_live=stops)[0]
    p = e.select("match_id", "half", F.col("from_player").alias("player"), F.lit("pass").alias("kind"), F.round("duration", 6).alias("seconds"))
    carry = lab.filter("state = 'controlled' and end > start and coalesce(player, '') <> ''")
    return p.unionByName(carry.select("match_id", "half", "player", F.lit("carry").alias("kind"), F.round(F.col("end") - F.col("start"), 6).alias("seconds")))


# --- review batches

_K, _MOST = 10, 40
_HARD = _MOVED + f""", lc AS (SELECT video, frame, detection_id, row_number() OVER (PARTITION BY video ORDER BY confidence, detection_id) AS r FROM speeds WHERE confidence BETWEEN 0.15 AND 0.45),
ga AS (SELECT video, frame, frame - pf AS fg, detection_id, row_number() OVER (PARTITION BY video ORDER BY dt DESC, detection_id) AS r FROM speeds WHERE dt >= 0.5), ju AS (SELECT video, frame, detection_id, row_number() OVER (PARTITION BY video ORDER BY v DESC, detection_id) AS r FROM speeds WHERE dt <= 0.2 AND v >= 650),
it AS (SELECT video, frame, detection_id, row_number() OVER (PARTITION BY video ORDER BY frame, detection_id) - 1 AS i, count(*) OVER (PARTITION BY video) AS n FROM speeds WHERE detection_id % 7 = 0),
al AS (SELECT video, frame, 'low_confidence_detection' AS reason, 0 AS p, r AS q FROM lc WHERE r <= {_K} UNION ALL SELECT video, frame, 'detection_gap_end', 1, 2 * r FROM ga WHERE r <= {_K}
  UNION ALL SELECT video, greatest(0, frame - CAST(round_even(fg / 2.0::DOUBLE, 0) AS INTEGER)), 'detection_gap_middle', 1, 2 * r + 1 FROM ga WHERE r <= {_K} UNION ALL SELECT video, frame, 'suspicious_ball_jump', 2, r FROM ju WHERE r <= {_K}
  UNION ALL SELECT video, frame, 'interpolated_position', 3, i FROM it WHERE i % greatest(1, n // {_K}) = 0 AND i // greatest(1, n // {_K}) < {_K}),
un AS (SELECT *, row_number() OVER (PARTITION BY video, frame ORDER BY p, q) AS u FROM al), first AS (SELECT video, frame, reason, row_number() OVER (PARTITION BY video ORDER BY p, q) AS place FROM un WHERE u = 1),
kept AS (SELECT * FROM first WHERE place <= {_MOST}), have AS (SELECT video, count(*) AS n FROM kept GROUP BY 1),
rest AS (SELECT lc.video, lc.frame, row_number() OVER (PARTITION BY lc.video ORDER BY lc.r) AS q FROM lc LEFT JOIN kept USING (video, frame) WHERE kept.frame IS NULL),
batch AS (SELECT video, frame, reason FROM kept UNION ALL SELECT rest.video, frame, 'low_confidence_detection' FROM rest JOIN have USING (video) WHERE q <= {_MOST} - n)"""


def _hard(s: SparkSession, d: str) -> DataFrame:
    m = motion.motion(views.balls(s, d), FPS, by=V, tie=T).withColumn("interpolated", F.col("detection_id") % 7 == 0)
    m = m.select("video", "frame", "detection_id", "confidence", "dt_seconds", "ball_speed_px_per_second", (F.col("frame") - F.col("prev_frame")).alias("frame_gap"), "interpolated")
    return review.hard_frames(m, _MOST, by=V, row="detection_id")


@query(_HARD + " SELECT * FROM batch")
def hard_frame_batch(s, d):  # noqa: ANN001, ANN201
    """Every seventh reading stands for an interpolated one here, since the table has none."""
    return _hard(s, d).select("video", "frame", "reason")


@query(_HARD + " SELECT video, reason, count(*) AS n FROM batch GROUP BY 1, 2")
def batch_counts(s, d):  # noqa: ANN001, ANN201
    return _hard(s, d).groupBy("video", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(with_views("assoc") + """, x AS (SELECT video, frame, 'seed' AS reason, 0 AS p FROM assoc WHERE frame % 300 = 0 UNION ALL SELECT video, frame, 'suspicious', 1 FROM assoc WHERE state = 'controlled' AND (distance > 60 OR speed > 400)),
u AS (SELECT *, row_number() OVER (PARTITION BY video, frame ORDER BY p) AS q FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY p, frame) AS place FROM u WHERE q = 1) SELECT video, frame, reason FROM r WHERE place <= 80""")
def suspicious_batch(s, d):  # noqa: ANN001, ANN201
    a = views.association(s, d)
    parts = [("seed", a.filter("frame % 300 = 0")), ("suspicious", a.filter("state = 'controlled' and (distance > 60 or speed > 400)"))]
    return select.prioritised([(n, p.select("video", "frame")) for n, p in parts], keys=["video", "frame"], order=["frame"], limit=80, by=V).select("video", "frame", "reason")


_WINDOWS = automata._CHAIN_SQL + """, w AS (SELECT video, segment, round(t0, 6) AS a, round(t1, 6) AS b FROM segs), tr AS (SELECT video, min(time) AS a, max(time) AS b FROM (SELECT video, time, frame - row_number() OVER (PARTITION BY video ORDER BY frame) AS g FROM assoc WHERE state = 'in_transit') GROUP BY video, g),
x AS (SELECT video, 'short_controlled_segment' AS kind, 0 AS priority, a AS c, a - 2 AS lo, b + 2 AS hi FROM w WHERE b - a < 0.5 UNION ALL SELECT video, 'segment_start', 1, a, a - 1.5, a + 1.5 FROM w UNION ALL SELECT video, 'segment_end', 2, b, b - 1.5, b + 1.5 FROM w
  UNION ALL SELECT video, 'advisory_window', 3, a, a - 1, b + 1 FROM tr),
n AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY priority, c) AS i FROM x)"""


def _windows(s: SparkSession, d: str) -> DataFrame:
    a = views.association(s, d)
    seg = stateful.possession_segments(a, by=V, spec=automata.CHAIN).withColumns({c: F.round(c, 6) for c in ("start_time", "end_time")})
    return review.numbered_windows(seg, review.flagged_runs(a, F.col("state") == "in_transit", by=V), by=V)


@query(_WINDOWS + " SELECT video, printf('review_%04d', i) AS review_id, kind, priority, round(c, 6) AS center_time, round(greatest(lo, 0), 6) AS window_start, round(hi, 6) AS window_end FROM n")
def impact_windows(s, d):  # noqa: ANN001, ANN201
    return _windows(s, d).select("video", "review_id", "kind", "priority", *[F.round(c, 6).alias(c) for c in ("center_time", "window_start", "window_end")])


@query(_WINDOWS + """, u AS (SELECT *, row_number() OVER (PARTITION BY video, c ORDER BY i) AS dup FROM n), g AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY i) AS place FROM u WHERE dup = 1)
SELECT video, printf('review_%04d', i) AS review_id, round(greatest(c - 3, 0), 6) AS window_start, round(c + 3, 6) AS window_end FROM g WHERE place <= 20""")
def game_state_windows(s, d):  # noqa: ANN001, ANN201
    w = first_per(_windows(s, d), ["video", "center_time"], [F.asc("number")])
    w = select.top(w, 20, by=V, order=[F.asc("number")])
    return w.select("video", "review_id", F.round(F.greatest(F.col("center_time") - 3, F.lit(0.0)), 6).alias("window_start"), F.round(F.col("center_time") + 3, 6).alias("window_end"))


@query(with_views("balls") + """, sp AS (SELECT video, min(time_seconds) AS a, max(time_seconds) AS z FROM balls GROUP BY 1), g AS (SELECT b.*, least(9, CAST(floor((b.time_seconds - a) / ((z - a) / 10)) AS INTEGER)) AS part FROM balls b JOIN sp USING (video) WHERE z > a)
SELECT video, part, arg_max(detection_id, struct_pack(c := confidence, d := -detection_id)) AS detection_id FROM g WHERE confidence IS NOT NULL GROUP BY 1, 2""")
def best_per_segment(s, d):  # noqa: ANN001, ANN201
    b = views.balls(s, d).filter("confidence is not null")
    return select.best_per_segment(views.balls(s, d), b, 10, by=V, time="time_seconds", score="confidence", row="detection_id")


@query(with_views("assoc") + """, f AS (SELECT video, player, frame, row_number() OVER (PARTITION BY video, player ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY video, player) AS n FROM assoc WHERE state = 'controlled' AND player IS NOT NULL),
k AS (SELECT DISTINCT video, player, CAST(floor(q * (n - 1) / 29.0::DOUBLE) AS BIGINT) AS i FROM (SELECT DISTINCT video, player, n FROM f), generate_series(0, 29) g(q)) SELECT f.video, f.player, f.frame FROM f LEFT JOIN k USING (video, player, i) WHERE n <= 30 OR k.video IS NOT NULL""")
def controlled_sample(s, d):  # noqa: ANN001, ANN201
    a = views.association(s, d).filter("state = 'controlled' and player is not null").select("video", "player", "frame")
    return select.evenly(a, 30, by=["video", "player"], order=["frame"], floor=True).select("video", "player", "frame")


@query(reference.ORACLES["trajectory_segments"].replace("SELECT video, segment_id, f0", ", tt AS (SELECT video, segment_id, f0", 1) + """), r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY distance DESC, segment_id) AS rank FROM tt) SELECT video, segment_id, distance, rank FROM r WHERE rank <= 10""")
def longest_trajectories(s, d):  # noqa: ANN001, ANN201
    t = reference.trajectory_segments(s, d)
    return select.top(t, 10, by=V, order=[F.desc("distance"), F.asc("segment_id")], rank="rank").select("video", "segment_id", "distance", "rank")


@query(with_views("balls", "players") + """, u AS (SELECT video, frame FROM balls WHERE confidence BETWEEN 0.1 AND 0.35 UNION SELECT video, frame FROM players GROUP BY 1, 2 HAVING count(*) >= 20), r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame) AS place FROM u) SELECT video, frame FROM r WHERE place <= 150""")
def review_frames_first(s, d):  # noqa: ANN001, ANN201
    return select.top(reference.review_frames(s, d), 150, by=V, order=[F.asc("frame")]).select("video", "frame")


@query(with_views("balls", "assoc") + "SELECT video, frame FROM balls WHERE confidence < 0.2 UNION SELECT video, frame FROM assoc WHERE state = 'loose_or_unclear' UNION SELECT video, frame FROM assoc WHERE speed > 2500")
def excluded_frames(s, d):  # noqa: ANN001, ANN201
    a = views.association(s, d)
    parts = [views.balls(s, d).filter("confidence < 0.2"), a.filter("state = 'loose_or_unclear'"), a.filter("speed > 2500")]
    return votes.exclusion_keys(parts, ["video", "frame"])


# --- votes, features, evaluation

_MAJORITY = with_views("assoc") + """, v AS (SELECT video, player, count(*) AS votes, count(*) FILTER (state <> 'controlled') AS non FROM assoc WHERE player IS NOT NULL AND state <> 'unknown' GROUP BY 1, 2),
gone AS (SELECT video, player FROM v WHERE votes >= 1 AND non > votes - non AND non / votes::DOUBLE >= 0.67)"""


@query(_MAJORITY + """ SELECT a.video, count(*) FILTER (g.player IS NULL) AS kept, count(*) FILTER (g.player IS NOT NULL) AS removed, count(DISTINCT g.player) AS removed_tracks FROM assoc a LEFT JOIN gone g USING (video, player) GROUP BY 1""")
def majority_exclusions(s, d):  # noqa: ANN001, ANN201
    a = views.association(s, d)
    votes_cast = a.filter("player is not null and state <> 'unknown'").withColumn("label", F.when(F.col("state") == "controlled", "active").otherwise("non_active"))
    kept, removed = votes.majority_exclusions(a, votes_cast, keys=["video", "player"], label="label", gone="non_active")
    out = kept.groupBy("video").agg(F.count(F.lit(1)).alias("kept")).join(removed.groupBy("video").agg(F.count(F.lit(1)).alias("removed"), F.count_distinct("player").alias("removed_tracks")), "video", "full")
    return out.fillna(0)


@query(with_views("players") + """, f AS (SELECT frame, video, player_id, row_number() OVER (PARTITION BY video, frame ORDER BY player_id) AS ordinal FROM players) SELECT video, frame, player_id, ordinal FROM f""")
def frame_ordinals(s, d):  # noqa: ANN001, ANN201
    return running_count(views.players(s, d).select("video", "frame", "player_id"), by=["video", "frame"], order="player_id", flag=F.lit(True), name="ordinal")


_SIZE = ", size AS (SELECT video, max(w) AS w, max(h) AS h FROM (SELECT video, max(x2) AS w, max(y2) AS h FROM players GROUP BY 1 UNION ALL SELECT video, max(x2), max(y2) FROM balls GROUP BY 1) GROUP BY 1)"


@query(with_views("balls", "players") + _SIZE + """, cn AS (SELECT video, frame, count(*) AS players_in_frame, count(*) FILTER (field_zone = 'strict') AS strict_in_frame FROM players GROUP BY 1, 2), bf AS (SELECT * FROM balls QUALIFY row_number() OVER (PARTITION BY video, frame ORDER BY detection_id) = 1),
c AS (SELECT b.video, b.frame, p.player_id, p.field_zone, sqrt((b.center_x - p.foot_x) * (b.center_x - p.foot_x) + (b.center_y - p.foot_y) * (b.center_y - p.foot_y)) AS d, p.x2 - p.x1 AS bw, p.y2 - p.y1 AS bh, p.foot_x AS fx, p.foot_y AS fy FROM bf b JOIN players p USING (video, frame)),
k AS (SELECT *, row_number() OVER (PARTITION BY video, frame ORDER BY d, player_id) AS rank FROM c WHERE d IS NOT NULL)
SELECT k.video, k.frame, k.player_id, k.rank, round(k.d, 6) AS ball_distance, players_in_frame, strict_in_frame, round(k.d / size.h, 6) AS ball_distance_norm, round(fx / size.w, 6) AS foot_x_norm, round(fy / size.h, 6) AS foot_y_norm,
 round(least(fx, size.w - fx) / size.w, 6) AS edge_x_norm, round(least(fy, size.h - fy) / size.h, 6) AS edge_y_norm, round(CASE WHEN bh > 0 THEN bw / bh END, 6) AS aspect, round(bh / size.h, 6) AS height_norm FROM k JOIN size USING (video) JOIN cn USING (video, frame) WHERE rank <= 5""")
def participant_features(s, d):  # noqa: ANN001, ANN201
    f = associate.participant_features(first_per(views.balls(s, d), ["video", "frame"], [F.asc("detection_id")]), views.players(s, d), views.balls(s, d), by=V, most=5)
    more = ("ball_distance", "ball_distance_norm", "foot_x_norm", "foot_y_norm", "edge_x_norm", "edge_y_norm", "aspect", "height_norm")
    return f.select("video", "frame", "player_id", "rank", "players_in_frame", "strict_in_frame", *[F.round(c, 6).alias(c) for c in more])


@query(_MOVED + """, pr AS (SELECT video, detection_id, confidence, x1, y1, x2, y2, lag(x1) OVER w AS a1, lag(y1) OVER w AS b1, lag(x2) OVER w AS a2, lag(y2) OVER w AS b2 FROM balls WINDOW w AS (PARTITION BY video ORDER BY frame, detection_id)),
o AS (SELECT *, greatest(0, least(x2, a2) - greatest(x1, a1)) * greatest(0, least(y2, b2) - greatest(y1, b1)) AS i, greatest(0, x2 - x1) * greatest(0, y2 - y1) + greatest(0, a2 - a1) * greatest(0, b2 - b1) AS u FROM pr)
SELECT video, count(*) AS detected, count(*) FILTER (confidence < 0.5) AS low_confidence, count(*) FILTER (CASE WHEN u - i > 0 THEN i / (u - i) ELSE 0 END < 0.7 AND a1 IS NOT NULL) AS low_overlap FROM o GROUP BY 1""")
def temporal_overlap(s, d):  # noqa: ANN001, ANN201
    return quality.temporal_overlap(views.balls(s, d), by=V, tie=T)


@query("""SELECT r_name AS "outer", substr(n_name, 1, 1) AS "inner", count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def nested_counts(s, d):  # noqa: ANN001, ANN201
    n = table(s, d, "nation", "n_name", "n_regionkey").join(table(s, d, "region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    inner = n.groupBy("r_name", F.substring("n_name", 1, 1).alias("letter")).agg(F.collect_list("n_name").alias("names"))
    outer = inner.groupBy("r_name").agg(F.map_from_entries(F.collect_list(F.struct("letter", "names"))).alias("m"))
    return review.nested_count(outer.select(F.create_map("r_name", "m").alias("m")), "m")


_SWITCH = automata._SMOOTH_SQL.rsplit("SELECT video, frame, CASE", 1)
_REVIEWED = (automata._SMOOTH_SQL.replace(_SWITCH[1], "").rsplit("SELECT video, frame, CASE", 1)[0] + ", sm AS (SELECT video, frame, CASE" + _SWITCH[1] + """),
tq AS (SELECT video, frame, state, lag(state) OVER w AS ps, lag(frame) OVER w AS pf FROM assoc WINDOW w AS (PARTITION BY video ORDER BY frame)),
want AS (SELECT video, pf AS frame, ps AS desired FROM tq WHERE ps <> state UNION ALL SELECT video, frame, state FROM tq WHERE ps <> state),
jd AS (SELECT desired, smoothed_state AS guess, smoothed_state = desired AS ok FROM want JOIN sm USING (video, frame))""")


def _reviewed(s: SparkSession, d: str) -> DataFrame:
    t = reference.state_transitions(s, d)
    want = t.select("video", F.expr("stack(2, before_frame, before_state, switch_frame, switch_state) AS (frame, desired)"))
    return want.join(automata.smooth_states(s, d).select("video", "frame", F.col("smoothed_state").alias("guess")), ["video", "frame"])


@query(_REVIEWED + " SELECT desired, count(*) AS n, count(*) FILTER (ok) AS correct, round(avg(ok::INTEGER), 6) AS accuracy FROM jd GROUP BY 1")
def transition_accuracy(s, d):  # noqa: ANN001, ANN201
    a = evaluate.accuracy(_reviewed(s, d), "desired", "guess", by=["desired"])
    return a.withColumn("accuracy", F.round("accuracy", 6))


@query(_REVIEWED + ", er AS (SELECT desired, guess, count(*) AS n FROM jd WHERE NOT ok GROUP BY 1, 2) SELECT *, row_number() OVER (ORDER BY n DESC, desired, guess) AS rank FROM er")
def transition_errors(s, d):  # noqa: ANN001, ANN201
    return evaluate.error_ranking(_reviewed(s, d), "desired", "guess")


@query(with_views("players") + """, n AS (SELECT video, player_id, count(*) AS n FROM players GROUP BY 1, 2), t AS (SELECT video, count(*) AS detections, (max(frame) - min(frame)) / nullif(max(time_seconds) - min(time_seconds), 0) AS fps FROM players GROUP BY 1)
SELECT video, any_value(t.detections) AS detections, count(*) AS tracks, round(median(n), 6) AS median_track_detections, round(any_value(fps), 6) AS fps_estimate, count(*) FILTER (n >= greatest(2, round_even(coalesce(fps, 1) * 2, 0))) AS long_tracks_2s, round(count(*) / any_value(t.detections)::DOUBLE, 6) AS new_detection_rate
FROM n JOIN t USING (video) GROUP BY 1""")
def track_rates(s, d):  # noqa: ANN001, ANN201
    """Every (video, player_id) is a track here, its first detection the new one."""
    first = F.row_number().over(reference_window(["video", "player_id"], "frame")) == 1
    tracked = views.players(s, d).withColumn("track_status", F.when(first, "new").otherwise("matched"))
    out = votes.track_rates(tracked, by=V, track="player_id")
    return out.withColumns({c: F.round(c, 6) for c in ("median_track_detections", "fps_estimate", "new_detection_rate")})


def reference_window(by: list[str], order: str):  # noqa: ANN201
    from pyspark.sql import Window

    return Window.partitionBy(*by).orderBy(order)


@query(with_views("labels") + """, v AS (SELECT match_id, half, player, team, count(*) AS n, avg(confidence) AS c FROM labels WHERE coalesce(team, '') NOT IN ('', 'unknown') GROUP BY 1, 2, 3, 4),
t AS (SELECT *, sum(n) OVER (PARTITION BY match_id, half, player) AS total, row_number() OVER (PARTITION BY match_id, half, player ORDER BY n DESC, team) AS r FROM v)
SELECT match_id, half, player, CASE WHEN n / total::DOUBLE < 0.65 THEN 'unknown' ELSE team END AS team, round(least(n / total::DOUBLE, coalesce(c, 0)), 6) AS confidence FROM t WHERE r = 1""")
def team_labels(s, d):  # noqa: ANN001, ANN201
    lab, keys = views.labels(s, d), ["match_id", "half", "player"]
    known = lab.filter(F.coalesce("team", F.lit("")).isin("", "unknown") == F.lit(False)).select(*keys).distinct()
    t = votes.with_vote_confidence(votes.team_vote(known, lab, keys=keys))
    return t.select(*keys, "team", F.round("confidence", 6).alias("confidence"))


@query(with_views("players") + "SELECT video, frame, player_id FROM players WHERE " + views._inside("foot_x", "foot_y", STRICT) + " AND confidence >= 0.5")
def strict_players(s, d):  # noqa: ANN001, ANN201
    return views.players(s, d).filter("field_zone = 'strict' and confidence >= 0.5").select("video", "frame", "player_id")
