"""Evaluation of detections and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.geometry import iou


def detection_outcomes(items: DataFrame, truth: DataFrame, guesses: DataFrame, *, key: str, least_iou: float = 0.5) -> DataFrame:
    """Per item: boxes on both sides, best overlap, best confidence and the outcome."""
    box = lambda p: tuple(F.col(f"{p}{c}") for c in ("x1", "y1", "x2", "y2"))
    t = truth.select(key, *[F.col(c).alias(f"t{c}") for c in ("x1", "y1", "x2", "y2")])
    g = guesses.select(key, "confidence", *[F.col(c).alias(f"g{c}") for c in ("x1", "y1", "x2", "y2")])
    best = t.join(g, key).groupBy(key).agg(F.max(iou(box("t"), box("g"))).alias("best_iou"))
    out = items.join(t.groupBy(key).agg(F.count(F.lit(1)).alias("truth_boxes")), key, "left").join(g.groupBy(key).agg(F.count(F.lit(1)).alias("guesses"), F.max("confidence").alias("best_confidence")), key, "left").join(best, key, "left")
    out = out.fillna({"truth_boxes": 0, "guesses": 0, "best_iou": 0.0})
    visible = F.col("truth_boxes") > 0
    outcome = (
        F.when(visible & (F.col("best_iou") >= least_iou), "true_positive").when(visible & (F.col("guesses") > 0), "poor_localization").when(visible, "missed_ball")
        .when(F.col("guesses") > 0, "false_positive_on_null").otherwise("true_negative_null")
    )
    return out.withColumn("outcome", outcome)


def outcome_score(outcome: Column) -> Column:
    return F.when(outcome == "true_positive", 3).when(outcome == "true_negative_null", 2).when(outcome == "poor_localization", 1).otherwise(0)


def detection_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of each outcome and the rates among items with and without a ball."""
    names = ("true_positive", "missed_ball", "poor_localization", "false_positive_on_null", "true_negative_null")
    visible = F.col("truth_boxes") > 0
    rate = lambda name, among: F.avg(F.when(among, (F.col("outcome") == name).cast("double")))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if(visible).alias("visible_items"), *[F.count_if(F.col("outcome") == n).alias(n) for n in names],
        rate("true_positive", visible).alias("visible_recall"), rate("false_positive_on_null", ~visible).alias("null_false_positive_rate"), rate("poor_localization", visible).alias("poor_localization_rate"),
        F.avg(F.when(visible, F.col("best_iou"))).alias("mean_best_iou_visible"),
    )


def compare_outcomes(old: DataFrame, new: DataFrame, *, key: str, keep: list[str] = ()) -> DataFrame:
    """Full outer comparison of two evaluations: side, scores, delta and whether an item improved."""
    a = old.select(key, *keep, F.col("outcome").alias("outcome_old"), F.lit(True).alias("_a"))
    b = new.select(key, F.col("outcome").alias("outcome_new"), F.lit(True).alias("_b"))
    out = a.join(b, key, "full")
    delta = outcome_score(F.col("outcome_new")) - outcome_score(F.col("outcome_old"))
    side = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").otherwise("both")
    return out.withColumns({"side": side, "delta_score": delta, "comparison_result": F.when(delta > 0, "improved").when(delta < 0, "regressed").otherwise("unchanged")}).drop("_a", "_b")


def validate_boxes(df: DataFrame, classes: tuple[int, ...] = (0,)) -> DataFrame:
    """The first error of each normalised box label (class_id, x_center, y_center, width, height, parse_error), or null."""
    w, h, x, y = F.col("width"), F.col("height"), F.col("x_center"), F.col("y_center")
    out = (x - w / 2 < 0) | (x + w / 2 > 1) | (y - h / 2 < 0) | (y + h / 2 > 1)
    error = (
        F.when(F.coalesce("parse_error", F.lit("")) != "", F.col("parse_error")).when(~F.col("class_id").isin(*classes), "unexpected_class_id").when((w <= 0) | (h <= 0), "non_positive_box_size")
        .when((w > 1) | (h > 1), "box_size_out_of_range").when(~(x.between(0, 1) & y.between(0, 1)), "box_center_out_of_range").when(out, "box_extends_outside_image")
    )
    return df.withColumn("label_error", error)


def validate_items(items: DataFrame, labels: DataFrame, *, key: str) -> DataFrame:
    """Per item: valid boxes and all errors, sorted, each once, joined by ';'."""
    per = labels.groupBy(key).agg(F.count_if(F.col("label_error").isNull()).alias("valid_boxes"), F.collect_set("label_error").alias("_errors"))
    out = items.join(per, key, "left").fillna({"valid_boxes": 0})
    extra = F.array_compact(F.array(F.when(F.col("_errors").isNull(), "missing_label_file"), F.when(F.col("valid_boxes") > 1, "multiple_ball_boxes")))
    errors = F.array_join(F.array_sort(F.array_union(F.coalesce("_errors", F.array().cast("array<string>")), extra)), ";")
    return out.withColumn("validation_errors", errors).drop("_errors")


def error_counts(df: DataFrame, column: str = "validation_errors") -> DataFrame:
    return df.filter(F.col(column) != "").select(F.explode(F.split(column, ";")).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, truth: str, guess: str, values: list[str]) -> DataFrame:
    """Truth by prediction, one column a predicted value; missing predictions are in none."""
    return df.groupBy(truth).pivot(guess, values).agg(F.count(F.lit(1))).fillna(0, values)


def accuracy(df: DataFrame, truth: str, guess: str, *, by: list[str]) -> DataFrame:
    """Rows, correct rows and their share."""
    right = F.coalesce(F.col(truth) == F.col(guess), F.lit(False))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("correct"), F.avg(right.cast("int")).alias("accuracy"))


def error_ranking(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Confusions by number, the most frequent first; one row a pair of labels."""
    wrong = df.filter(~F.col(truth).eqNullSafe(F.col(guess))).groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))
    return wrong.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), truth, guess)))
