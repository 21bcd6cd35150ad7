"""Grid-based action values and their tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.geometry import grid_bin


def actions_only(df: DataFrame, types: tuple[str, ...] = ("pass", "carry")) -> DataFrame:
    """Passes and carries with all four coordinates."""
    return df.filter(F.col("event_type").isin(*types)).dropna(subset=["start_x", "start_y", "end_x", "end_y"])


def grid_value(x: Column, y: Column, grid: list[list[float]], length: float, width: float) -> Column:
    g = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in grid])
    return F.element_at(F.element_at(g, grid_bin(y, width, len(grid)) + 1), grid_bin(x, length, len(grid[0])) + 1)


def static_values(df: DataFrame, grid: list[list[float]], length: float = 105.0, width: float = 68.0) -> DataFrame:
    """Value at the start, at the end, and what the action adds."""
    df = df.withColumns({"start_value": grid_value(F.col("start_x"), F.col("start_y"), grid, length, width), "end_value": grid_value(F.col("end_x"), F.col("end_y"), grid, length, width)})
    return df.withColumn("value_added", F.col("end_value") - F.col("start_value"))


def observed_bins(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """Equal-width, right-closed bins over each column's observed range, the first one holding the minimum; null without range."""
    span = df.agg(*[F.min(c).alias(f"_lo_{c}") for c in columns], *[F.max(c).alias(f"_hi_{c}") for c in columns])  # one row
    out = df.crossJoin(F.broadcast(span))
    for c in columns:
        width = (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) / bins
        out = out.withColumn(f"{c}_bin", F.greatest(F.ceil(F.try_divide(F.col(c) - F.col(f"_lo_{c}"), width)) - 1, F.lit(0)).cast("int"))
    return out.drop(*[f"_lo_{c}" for c in columns], *[f"_hi_{c}" for c in columns])


def binned_values(df: DataFrame, x_bins: int = 12, low: float = 0.01, high: float = 0.35) -> DataFrame:
    """Values that rise evenly over the observed range of x."""
    df = observed_bins(df, ["start_x", "end_x"], x_bins)
    value = lambda c: F.lit(low) + F.col(f"{c}_bin") * ((high - low) / (x_bins - 1))
    return df.withColumns({"start_value": value("start_x"), "end_value": value("end_x")}).withColumn("value_added", F.col("end_value") - F.col("start_value"))


def value_table(df: DataFrame, keys: list[str]) -> DataFrame:
    """Total, number and mean of the values added."""
    return df.groupBy(*keys).agg(F.sum("value_added").alias("total_value"), F.count("value_added").alias("actions"), F.avg("value_added").alias("mean_value"))


def value_pivot(df: DataFrame, keys: list[str], types: list[str]) -> DataFrame:
    """Values added by action type, one column each, and their total."""
    wide = df.groupBy(*keys).pivot("event_type", types).agg(F.sum("value_added")).fillna(0.0, types)
    return wide.withColumn("total_value", sum((F.col(t) for t in types), F.lit(0.0)))


def fit_expected_threat(df: DataFrame, columns: int = 16, rows: int = 12, length: float = 105.0, width: float = 68.0, eps: float = 1e-5, most: int = 200) -> list[list[float]]:
    """Expected-threat surface by value iteration; cells are counted in Spark, the surface has ``columns`` x ``rows`` cells.

    ``df`` has event_type (pass, carry, shot), start and end coordinates, success (boolean) and goal (boolean).
    """
    cell = lambda x, y: grid_bin(y, width, rows) * columns + grid_bin(x, length, columns)
    cells = df.select("event_type", "success", "goal", cell(F.col("start_x"), F.col("start_y")).alias("a"), cell(F.col("end_x"), F.col("end_y")).alias("b")).filter("a is not null")
    n = columns * rows
    shots, goals, moves, trans = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros((n, n))
    for r in cells.groupBy("event_type", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("goal")).alias("g"), F.count_if(F.col("success")).alias("s")).collect():  # at most 3 x cells^2 rows
        if r["event_type"] == "shot":
            shots[r["a"]] += r["n"]
            goals[r["a"]] += r["g"]
        else:
            moves[r["a"]] += r["n"]
            if r["b"] is not None:
                trans[r["a"], r["b"]] += r["s"]
    total = np.maximum(shots + moves, 1)
    score, move = shots / total * goals / np.maximum(shots, 1), moves / total
    trans = trans / np.maximum(moves, 1)[:, None]
    value = np.zeros(n)
    for _ in range(most):
        new = score + move * (trans @ value)
        done = np.abs(new - value).max() < eps
        value = new
        if done:
            break
    return value.reshape(rows, columns).tolist()


def save_surface(spark: SparkSession, surface: list[list[float]], path: str, length: float = 105.0, width: float = 68.0) -> None:
    """A value surface as one JSON document."""
    row = [(length, width, len(surface[0]), len(surface), [[float(v) for v in r] for r in surface])]
    spark.createDataFrame(row, "length double, width double, columns int, rows int, surface array<array<double>>").coalesce(1).write.mode("overwrite").json(path)


def load_surface(spark: SparkSession, path: str) -> list[list[float]]:
    """The surface that ``save_surface`` wrote; an error if it isn't as large as it says."""
    r = spark.read.schema("columns int, rows int, surface array<array<double>>").json(path).first()
    if r is None or len(r["surface"]) != r["rows"] or any(len(x) != r["columns"] for x in r["surface"]):
        raise ValueError(f"no value surface in {path}")
    return [list(x) for x in r["surface"]]
