"""Sampling, review selection and top lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.sequence import first_per, running_count


def every_nth(df: DataFrame, n: int, frame: str = "frame") -> DataFrame:
    return df.filter(F.pmod(F.col(frame), F.lit(n)) == 0)


def evenly(df: DataFrame, k: int, *, by: list[str], order: list[str], floor: bool = False) -> DataFrame:
    """``k`` rows spread evenly over each group's order (positions rounded half-even, or down); all rows of smaller groups."""
    rows = running_count(df, by=by, order=order[0], flag=F.lit(True), name="_k", tie=order[1:]).withColumn("_i", F.col("_k") - 1).drop("_k")
    rows = rows.join(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), by)
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (F.floor if floor else F.rint)(i * (F.col("_n") - 1) / F.lit(float(max(1, k - 1)))).cast("int"))
    return rows.filter((F.col("_n") <= k) | F.array_contains(at, F.col("_i"))).drop("_i", "_n")


def prioritised(parts: list[tuple[str, DataFrame]], *, keys: list[str], order: list[str], limit: int | None = None, by: list[str] = ()) -> DataFrame:
    """Union of parts in order of priority; each key keeps its first reason; at most ``limit`` rows a group of ``by``."""
    named = [df.withColumns({"reason": F.lit(name), "_p": F.lit(i)}) for i, (name, df) in enumerate(parts)]
    rows = first_per(reduce(DataFrame.unionByName, named), keys, [F.asc("_p"), *map(F.asc, order)])
    if limit:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("_p", *order))
        rows = rows.withColumn("_r", rank).filter(F.col("_r") <= limit).drop("_r")
    return rows.drop("_p")


def top(df: DataFrame, n: int, *, by: list[str], order: list[Column], rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group, with their ``rank`` if it has a name; the limit acts before the exchange."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    out = df.withColumn(rank or "_r", place).filter(F.col(rank or "_r") <= n)
    return out if rank else out.drop("_r")


def between(df: DataFrame, time: str, start: float, end: float) -> DataFrame:
    """Rows of a time window; both ends count."""
    return df.filter(F.col(time).between(start, end))


def best_per_segment(df: DataFrame, candidates: DataFrame, n: int, *, by: list[str], time: str, score: str, row: str) -> DataFrame:
    """The candidate of the greatest score (ties: the smaller ``row``) in each of ``n`` equal parts of a sequence's time span; sequences without extent have none."""
    span = df.groupBy(*by).agg(F.min(time).alias("_a"), F.max(time).alias("_z")).filter("_z > _a")
    part = F.least(F.floor((F.col(time) - F.col("_a")) / ((F.col("_z") - F.col("_a")) / n)), F.lit(n - 1)).cast("int")
    return candidates.join(span, by).groupBy(*by, part.alias("part")).agg(F.max_by(row, F.struct(F.col(score), -F.col(row))).alias(row))


def expand_offsets(df: DataFrame, offsets: list[int], last: Column | int, *, by: list[str], frame: str = "frame") -> DataFrame:
    """Each frame with its neighbours at ``offsets``, clamped to 0..last; of equal frames the greatest source frame stays."""
    out = df.withColumn("offset", F.explode(F.array(*map(F.lit, offsets)))).withColumn("source_frame", F.col(frame))
    out = out.withColumn(frame, F.least(F.greatest(F.col(frame) + F.col("offset"), F.lit(0)), F.lit(last) if isinstance(last, int) else last))
    return first_per(out, [*by, frame], [F.desc("source_frame"), F.desc("offset")])
