"""CSV, JSON, label-text and file sources and sinks at the engine's edge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.ids import clean_id
from touchline.operators.sequence import first_per

BOX = "x1 double, y1 double, x2 double, y2 double, center_x double, center_y double"
SCHEMAS = {
    "ball_detections": f"venue string, video string, frame int, time_seconds double, object_type string, confidence double, {BOX}",
    "player_detections": f"venue string, video string, frame int, time_seconds double, object_type string, confidence double, {BOX}, player_id int",
    "field_masks": "frame int, time_sec double, field_polygon string, strict_field_polygon string, tolerant_field_polygon string, num_points int, field_area_px int, confidence double, status string",
    "association": "frame int, time_seconds double, source string, nearest_player_id string, nearest_player_distance_px double, nearest_player_field_zone string, ball_speed_px_per_second double, association_status string, ball_state string",
    "possession_segments": "segment_id string, player_id string, start_time double, end_time double, duration_seconds double, start_frame int, end_frame int, end_reason string",
    "track_stability": "track_id int, stability_flag string",
}
#: Texts that stand for a missing value in a CSV.
MISSING = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a", "<NA>")
SEGMENT = "id string, start double, end double, state string, team string, player string, confidence double, notes string, half int, source_action_id string"
LABEL_DOCUMENT = f"schema_version string, clip string, match_id string, half int, review_status string, segments array<struct<{', '.join(f.strip().replace(' ', ': ', 1) for f in SEGMENT.split(','))}>>"
ACTION_ITEM = "array<struct<label: string, gameTime: string, position: string, team: string, player_id: string, visibility: string>>"


def read_csv(spark: SparkSession, path: str | list[str], schema: str, **options: str) -> DataFrame:
    """A CSV with header and a declared schema. Every usual text for "missing" is null, also NaN; columns are cast leniently."""
    kinds = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    raw = spark.read.options(header=True, **options).csv(path, inferSchema=False)
    out = []
    for f in kinds.fields:
        c = F.trim(F.col(f.name)) if f.name in raw.columns else F.lit(None).cast("string")
        c = F.when(~c.isin(*MISSING), c)
        if isinstance(f.dataType, T.IntegerType):
            c = c.try_cast("double").cast("int")  # "7.0" is 7
        elif not isinstance(f.dataType, T.StringType):
            c = c.try_cast(f.dataType)
        out.append(c.alias(f.name))
    return raw.select(*out)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def detections(df: DataFrame, kinds: tuple[str, ...] = ("ball",), least: float = 0.0) -> DataFrame:
    """Rows of the wanted object types and at least this confidence (missing confidence is 1), from object_type, class or label."""
    named = next((c for c in ("object_type", "class", "label") if c in df.columns), None)
    if named:
        df = df.filter(F.lower(F.trim(F.col(named))).isin(*kinds))
    return df.filter(F.coalesce(F.col("confidence"), F.lit(1.0)) >= least) if "confidence" in df.columns else df


def read_sources(spark: SparkSession, specs: list[str], schema: str) -> DataFrame:
    """``venue:path`` (further colons belong to the path), one table with a ``venue`` column."""
    parts = [read_csv(spark, spec.split(":", 1)[1], schema).withColumn("venue", F.lit(spec.split(":", 1)[0])) for spec in specs]
    return reduce(DataFrame.unionByName, parts)


def current_masks(df: DataFrame, *, by: list[str] = (), order: str = "time_sec") -> DataFrame:
    """Field masks with a polygon, the last one a frame; without strict or tolerant polygon the plain one stands in."""
    kept = df.filter(F.trim(F.coalesce("field_polygon", "strict_field_polygon", F.lit(""))) != "")
    kept = kept.withColumns({c: F.coalesce(c, "field_polygon") for c in ("strict_field_polygon", "tolerant_field_polygon")})
    return first_per(kept, [*by, "frame"], [F.desc_nulls_last(order)])


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Segments of label documents: one row a segment with its document's match and clip; a null half is the document's, or 1."""
    doc = spark.read.schema(LABEL_DOCUMENT).json(path, multiLine=True)
    if doc.filter("segments is null").limit(1).count():
        raise ValueError("a label document lacks its list of segments")
    seg = doc.select("match_id", "clip", F.col("half").alias("_half"), F.inline("segments"))
    return seg.withColumn("half", F.coalesce("half", "_half", F.lit(1))).drop("_half")


def normal_segments(df: DataFrame) -> DataFrame:
    """Lenient segments: unknown state, full confidence and half 1 where missing; without start, end or length they are dropped."""
    num = lambda c: F.when(~F.isnan(F.col(c).try_cast("double")), F.col(c).try_cast("double"))
    df = df.withColumns({"start": num("start"), "end": num("end"), "state": F.coalesce("state", F.lit("unknown")), "confidence": F.coalesce(num("confidence"), F.lit(1.0)), "half": F.coalesce("half", F.lit(1))})
    return df.filter("start is not null and end is not null and end > start")


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """Annotated ball actions ("actions" or "annotations" of a document): half from "1 - mm:ss", seconds from milliseconds."""
    doc = spark.read.schema(f"match_id string, UrlLocal string, fps double, actions {ACTION_ITEM}, annotations {ACTION_ITEM}").json(path, multiLine=True)
    rows = doc.select(F.coalesce("match_id", "UrlLocal").alias("match_id"), F.coalesce("fps", F.lit(25.0)).alias("fps"), F.posexplode(F.coalesce("actions", "annotations")).alias("i", "a"))
    half = F.split("a.gameTime", " - ")[0].try_cast("int")
    return rows.select("match_id", "fps", half.alias("half"), F.format_string("action_%04d", F.col("i") + 1).alias("id"), (F.col("a.position").try_cast("long") / 1000).alias("source_time"), F.col("a.label").alias("original_label"), "a.team", F.col("a.player_id").alias("player"), "a.visibility")


def checked_actions(df: DataFrame) -> DataFrame:
    """Raises at run time on a label outside the vocabulary or a half other than 1 or 2."""
    bad = ~F.coalesce(F.col("known_label"), F.lit(False)) | ~F.coalesce(F.col("half").isin(1, 2), F.lit(False)) | F.col("time").isNull()
    return df.filter(F.when(bad, F.raise_error(F.concat(F.lit("invalid action: "), F.coalesce("original_label", F.lit("null"))))).otherwise(F.lit(True)).cast("boolean"))


def read_box_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label text files "class x y w h": a row a non-blank line, with file stem, line number and parse error."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    lines = text.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("image_stem"), F.posexplode(F.split("value", r"\r?\n")).alias("i", "raw_line"))
    lines = lines.filter(F.trim("raw_line") != "").withColumn("_p", F.split(F.trim("raw_line"), r"\s+"))
    num = lambda i: F.get("_p", F.lit(i)).try_cast("double")
    few, bad = F.size("_p") < 5, F.array_contains(F.transform(F.slice("_p", 1, 5), lambda x: x.try_cast("double").isNull()), True)
    return lines.select("image_stem", (F.col("i") + 1).alias("line_number"), "raw_line", F.when(few, "too_few_columns").when(bad, "non_numeric_value").otherwise("").alias("parse_error"), num(0).cast("int").alias("class_id"), num(1).alias("x_center"), num(2).alias("y_center"), num(3).alias("width"), num(4).alias("height"))


def pixel_boxes(df: DataFrame, width: Column | str = "image_width", height: Column | str = "image_height") -> DataFrame:
    """Pixel corners of normalised boxes; rows without a number are left out."""
    w, h = (F.col(c) if isinstance(c, str) else c for c in (width, height))
    half_w, half_h = F.col("width") / 2, F.col("height") / 2
    return df.filter(F.col("parse_error") == "").withColumns({"x1": (F.col("x_center") - half_w) * w, "y1": (F.col("y_center") - half_h) * h, "x2": (F.col("x_center") + half_w) * w, "y2": (F.col("y_center") + half_h) * h})


def find_files(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> DataFrame:
    """Paths with one of the suffixes in any case, each once, sorted; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return files.filter(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*suffixes)).distinct().orderBy("path")


def standard_events(df: DataFrame) -> DataFrame:
    """A provider's event feed in the standard columns; "HH:MM:SS.fff" becomes seconds, no outcome means success."""
    clock = F.aggregate(F.transform(F.split("timestamp", ":"), lambda p: p.try_cast("double")), F.lit(0.0), lambda a, p: a * 60 + p)
    return df.select(
        "match_id", "period", clock.alias("time_seconds"), F.col("team_name").alias("team"), F.col("player_name").alias("player"), F.lower("type_name").alias("event_type"), F.col("x").cast("double").alias("start_x"), F.col("y").cast("double").alias("start_y"),
        F.col("end_x").cast("double").alias("end_x"), F.col("end_y").cast("double").alias("end_y"), F.coalesce(F.lower("outcome_name"), F.lit("successful")).alias("outcome"), "possession", F.lit("statsbomb").alias("source"), F.col("id").alias("source_event_id"),
    )


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV with header in the given column order; as many files as partitions."""
    (df.select(*columns) if columns else df).write.mode("overwrite").option("header", True).csv(path)


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON document a row and line."""
    df.write.mode("overwrite").json(path)


def write_each(df: DataFrame, path: str) -> None:
    """One JSON file a row, for readers that take a document a file."""
    df.write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def frame_window(df: DataFrame, start: float, end: float, fps: float, frame: str = "frame") -> DataFrame:
    """Rows of the frames in [start, end) seconds, both rounded to whole frames (half-even)."""
    return df.filter((F.col(frame) >= round(start * fps)) & (F.col(frame) < round(end * fps)))


def split_sink(df: DataFrame, removed: Column, path: str) -> None:
    """Kept rows under ``kept``, the others under ``removed``, from one pass over the plan."""
    df.withColumn("part", F.when(F.coalesce(removed, F.lit(False)), "removed").otherwise("kept")).write.mode("overwrite").partitionBy("part").parquet(path)


def labels_from_segments(df: DataFrame) -> DataFrame:
    """Segments as label rows: unknown team, low confidence, first half."""
    return df.filter(F.col("end_time") > F.col("start_time")).select(F.col("segment_id").alias("id"), F.col("start_time").alias("start"), F.col("end_time").alias("end"), F.lit("controlled").alias("state"), F.lit("unknown").alias("team"), clean_id("player_id").alias("player"), F.lit(0.25).alias("confidence"), F.lit(1).alias("half"))


def report(df: DataFrame, title: str, most: int = 100) -> str:
    """A small result as a Markdown table of at most ``most`` rows."""
    rows = df.limit(most).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return f"# {title}\n\n{head}\n" + "\n".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows) + "\n"
