"""The event document against the checked-in pair of reviewed labels and events (values as in FIXTURES.md), and its rules."""

import json

from touchline.operators.possession import EVENT_FIELDS, event_documents, event_rows
from touchline.sources.files import write_each

LABEL = "match_id string, half int, clip string, id string, start double, end double, state string, team string, player string, confidence double, source_action_id string, notes string"


def lab(i, a, z, team, player, state="controlled", conf=0.5, half=1):
    return ("m", half, "c.mp4", f"segment_{i:04d}", a, z, state, team, player, conf, f"action_{i:04d}", "n")


def test_expected_pairs_of_the_fixture(spark):
    # starts of the fifteen reviewed possessions; a pass joins neighbours of one team that touch
    times = [0.0, 2.12, 6.0, 10.52, 12.0, 13.5, 15.0, 16.4, 17.52, 18.2, 19.2, 20.2, 23.48, 26.0, 27.96, 30.0]
    team = ["r", "r", "l", "l", "r", "l", "r", "l", "l", "l", "l", "l", "l", "r", "r"]
    rows = [lab(i + 1, times[i], times[i + 1], team[i], f"p{i}") for i in range(15)]
    events, skipped = event_rows(spark.createDataFrame(rows, LABEL), by=["match_id", "half"])
    got = sorted((int(r["from_possession_id"][-4:]), int(r["to_possession_id"][-4:]), r["start"], r["end"], r["duration"], r["id"]) for r in events.collect())
    want = [(1, 2, 2.12), (3, 4, 10.52), (8, 9, 17.52), (9, 10, 18.2), (10, 11, 19.2), (11, 12, 20.2), (12, 13, 23.48), (14, 15, 27.96)]
    assert got == [(a, b, t, t, 0.0, f"event_{k + 1:04d}") for k, (a, b, t) in enumerate(want)]
    assert tuple(events.columns) == EVENT_FIELDS and skipped.count() == 0


def test_rules_skips_and_document(spark, tmp_path):
    rows = [
        lab(1, 0.0, 1.0, "a", "1"), lab(2, 1.5, 2.0, "a", "2", conf=None), lab(3, 2.0, 3.0, "unknown", "3"), lab(4, 3.0, 4.0, "a", "4"), lab(5, 4.0, 5.0, "b", "5"), lab(6, 7.0, 8.0, "b", "6"), lab(7, 10.5, 11.0, "b", "7"),
        lab(8, 11.0, 12.0, "b", "7"), lab(9, 12.0, 13.0, "b", "9"), lab(10, 12.5, 12.6, "", "", "airborne"), lab(11, 0.0, 1.0, None, None, "airborne", half=2),
    ]
    stops = spark.createDataFrame([("m", 1, 12.9, 14.0, "goal_stoppage", "kick_off", "r2"), ("m", 1, 13.0, 13.0, "restart", "", "r3")], "match_id string, half int, start double, end double, game_state_label string, restart_type string, source_review_id string")
    labels = spark.createDataFrame(rows, LABEL)
    docs = {r["half"]: r for r in event_documents(labels, by=["match_id", "half"], non_live=stops).collect()}
    d = docs[1]
    assert [(e["from_possession_id"], e["confidence"], e["type"]) for e in d["events"]] == [("segment_0001", 0.5, "completed_pass_candidate"), ("segment_0005", 0.5, "completed_pass_candidate")]
    assert d["events"][1]["duration"] == 2.0 and d["event_count"] == 2 and d["skipped_event_count"] == 3
    assert [(x["from_possession_id"], x["reason"], x["source_review_id"]) for x in d["skipped_events"]] == [("segment_0002", "unknown_team_identity", ""), ("segment_0003", "unknown_team_identity", ""), ("segment_0008", "non_live_game_state_overlap", "r2")]
    assert docs[2]["events"] == [] and docs[2]["skipped_events"] == [] and docs[2]["event_count"] == 0
    allowed = {e["from_possession_id"]: e["type"] for e in event_rows(labels, by=["match_id", "half"], allow_unknown=True)[0].collect()}
    assert allowed["segment_0002"] == "possession_transition_candidate"
    path = f"file://{tmp_path}/docs"
    write_each(event_documents(labels, by=["match_id", "half"], non_live=stops), path)
    back = [json.loads(f.read_text()) for f in sorted((tmp_path / "docs").glob("*.json"))]
    assert sorted((x["half"], len(x["events"])) for x in back) == [(1, 2), (2, 0)] and set(EVENT_FIELDS) <= set(next(x for x in back if x["half"] == 1)["events"][0])


def test_events_of_no_labels(spark):
    none = spark.createDataFrame([], LABEL)
    assert event_rows(none, by=["match_id", "half"])[0].count() == 0 and event_documents(none, by=["match_id", "half"]).count() == 0


def test_surface_round_trip(spark, tmp_path):
    import pytest

    from touchline.operators.value import load_surface, save_surface

    surface = [[0.1 * r + c for c in range(6)] for r in range(4)]
    save_surface(spark, surface, f"file://{tmp_path}/xt")
    assert load_surface(spark, f"file://{tmp_path}/xt") == surface
    spark.createDataFrame([(2, 2, [[1.0]])], "columns int, rows int, surface array<array<double>>").write.json(f"file://{tmp_path}/bad")
    with pytest.raises(ValueError):
        load_surface(spark, f"file://{tmp_path}/bad")
