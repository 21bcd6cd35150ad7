"""Sources, sinks, streams and the driver's contract."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from touchline.operators import stateful
from touchline.plans.pipelines import run_stream
from touchline.sources import files
from touchline.streaming import live

SMALL = "/root/testdata/sf0.001"


def test_csv_is_lenient(spark, tmp_path):
    (tmp_path / "a.csv").write_text("frame,time_seconds,ball_state,nearest_player_id\n7.0,NaN,controlled,3\nNA,1.5,,\n")
    rows = files.read_csv(spark, str(tmp_path / "a.csv"), files.SCHEMAS["association"]).select("frame", "time_seconds", "ball_state", "nearest_player_id", "source").collect()
    assert [tuple(r) for r in rows] == [(7, None, "controlled", "3", None), (None, 1.5, None, None, None)]
    with pytest.raises(ValueError):
        files.require(spark.range(1), ["frame"])


def test_label_documents_round_trip(spark, tmp_path):
    seg = [{"id": "s2", "start": 5, "end": 6.5, "state": "controlled", "team": "left", "player": "9"}, {"id": "s1", "start": 1, "end": 2, "state": "loose", "half": 2}]
    (tmp_path / "a.json").write_text(json.dumps({"match_id": "m", "clip": "c", "segments": seg}, indent=1))
    rows = {r["id"]: r for r in files.read_labels(spark, str(tmp_path / "a.json")).collect()}
    assert rows["s2"]["half"] == 1 and rows["s1"]["half"] == 2 and rows["s2"]["end"] == 6.5
    (tmp_path / "b.json").write_text(json.dumps({"match_id": "m"}))
    with pytest.raises(ValueError):
        files.read_labels(spark, str(tmp_path / "b.json"))


def test_actions_and_box_labels(spark, tmp_path):
    from touchline.operators.possession import normalise_actions

    doc = {"match_id": "m", "annotations": [{"label": "high pass", "gameTime": "2 - 00:10", "position": "2710020", "team": "left", "player_id": "4", "visibility": "visible"}, {"label": "DANCE", "gameTime": "1 - 00:01", "position": "1000"}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    acts = normalise_actions(files.read_actions(spark, str(tmp_path / "a.json"))).orderBy("id").collect()
    assert (acts[0]["type"], acts[0]["time"], acts[0]["action_frame"], acts[0]["known_label"], acts[1]["known_label"]) == ("high_pass", pytest.approx(10.02), 250, True, False)
    with pytest.raises(Exception, match="invalid action"):
        files.checked_actions(normalise_actions(files.read_actions(spark, str(tmp_path / "a.json")))).collect()
    (tmp_path / "img_1.txt").write_text("0 0.5 0.5 0.2 0.1\n\n0 0.5\n1.0 x 0 0 0\n")
    lab = files.read_box_labels(spark, str(tmp_path / "img_1.txt")).orderBy("line_number").collect()
    assert [(r["image_stem"], r["line_number"], r["parse_error"]) for r in lab] == [("img_1", 1, ""), ("img_1", 3, "too_few_columns"), ("img_1", 4, "non_numeric_value")]
    px = files.pixel_boxes(files.read_box_labels(spark, str(tmp_path / "img_1.txt")), F.lit(100), F.lit(200)).collect()
    assert len(px) == 1 and (px[0]["x1"], px[0]["y2"]) == pytest.approx((40.0, 110.0))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, t string")
    files.write_csv(df, str(tmp_path / "csv"), ["t", "n"])
    assert next((tmp_path / "csv").glob("*.csv")).read_text().startswith("t,n")
    files.split_sink(df, F.col("n") > 1, str(tmp_path / "parts"))
    assert {p.name for p in Path(tmp_path / "parts").glob("part=*")} == {"part=kept", "part=removed"}
    assert "| 1 | a |" in files.report(df, "Rows")


def test_live_possessions_equal_batch(spark, tmp_path):
    import random

    rng = random.Random(3)
    schema = "clip string, frame int, time double, player string, distance double, speed double, state string, excluded boolean, repaired boolean"
    rows = [("x", i, i / 30.0, rng.choice(["1", "1", "2", None]), 5.0, 10.0, rng.choice(["controlled", "in_transit", "unknown"]), False, False) for i in range(300)]
    spec = stateful.ChainSpec(confirm=2, carry_s=0.2)
    batch = stateful.possession_segments(spark.createDataFrame(rows, schema), by=["clip"], spec=spec)
    want = sorted(tuple(r) for r in batch.filter("end_reason <> 'end_of_input'").collect())
    for k in range(3):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    src = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run_stream(live.live_possessions(src, by="clip", spec=spec), "live-test")
    assert sorted(map(tuple, got.collect())) == want and len(want) > 3


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the test tables")
def test_contract(spark):
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and entry.entry(spark).count() > 0
    from verify import compare, connect

    con = connect(SMALL)
    for name in ("association_state", "pass_candidates", "trajectory_segments", "p4_found", "p5_found", "p6_found", "grid_value", "transit_runs"):
        assert compare(spark, con, name, SMALL)[0].startswith("ok"), name


def test_sources_masks_files_and_events(spark, tmp_path):
    (tmp_path / "m.csv").write_text("frame,field_polygon,status\n1,\"0,0;1,0;1,1\",a\n1,\"0,0;2,0;2,2\",b\n2,,c\n")
    masks = files.current_masks(files.read_csv(spark, str(tmp_path / "m.csv"), files.SCHEMAS["field_masks"]), order="status").collect()
    assert [(m["frame"], m["status"], m["strict_field_polygon"]) for m in masks] == [(1, "b", "0,0;2,0;2,2")]
    both = files.read_sources(spark, [f"x:{tmp_path}/m.csv", f"y:{tmp_path}/m.csv"], "frame int")
    assert both.groupBy("venue").count().count() == 2
    (tmp_path / "pics").mkdir()
    for name in ("b.JPG", "a.png", "c.txt"):
        (tmp_path / "pics" / name).write_text("x")
    assert [r["path"].rsplit("/", 1)[1] for r in files.find_files(spark, str(tmp_path / "pics"), (".jpg", ".png")).collect()] == ["a.png", "b.JPG"]
    raw = spark.createDataFrame([(1, 1, "00:12:34.567", "home", "p", "Pass", 1.0, 2.0, 3.0, 4.0, None, 7, "e1")], "match_id int, period int, timestamp string, team_name string, player_name string, type_name string, x double, y double, end_x double, end_y double, outcome_name string, possession int, id string")
    e = files.standard_events(raw).first()
    assert (e["event_type"], e["outcome"], e["time_seconds"]) == ("pass", "successful", pytest.approx(754.567)) and len(e) == 14
    odd = spark.createDataFrame([("cat", 0.9), ("Ball", 0.1), ("ball", None)], "object_type string, confidence double")
    assert files.detections(odd, least=0.2).count() == 1
    segs = spark.createDataFrame([("possession_0001", "7.0", 1.0, 2.0), ("possession_0002", "8", 2.0, 2.0)], "segment_id string, player_id string, start_time double, end_time double")
    assert [(r["id"], r["player"], r["confidence"]) for r in files.labels_from_segments(segs).collect()] == [("possession_0001", "7", 0.25)]
    loose = spark.createDataFrame([("1", "2.5", None, None, None), ("x", "2", "s", "0.5", 2)], "start string, end string, state string, confidence string, half int")
    assert [(r["start"], r["state"], r["confidence"], r["half"]) for r in files.normal_segments(loose).collect()] == [(1.0, "unknown", 1.0, 1)]


def test_stream_rates_cover_the_whole_table(spark):
    from touchline.plans import pipelines

    e = spark.read.parquet(f"{SMALL}/events.parquet").filter("ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    want = e.groupBy("event_type", F.window("ts", "2 days", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    want = {(r["event_type"], r["w"]["start"], r["w"]["end"]): (r["n"], r["total"]) for r in want.collect()}
    got = {(r["event_type"], r["start"], r["end"]): (r["n"], r["total"]) for r in pipelines.stream_rates(spark, SMALL).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
