"""Ordered-sequence primitives that don't need a whole sequence in one task.

A sequence is cut into blocks of its order column. Windows work inside a block; a small table of block edges
carries what crosses from one block to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65536


def neighbours(df: DataFrame, *, by: list[str], order: str, columns: list[str], tie: list[str] = (), previous: bool = True, following: bool = False, block: float = BLOCK) -> DataFrame:
    """Adds ``prev_<column>`` and ``next_<column>`` of the row before and after; null at a sequence's ends.

    Rows follow ``order``, then ``tie``. Rows with a null order come out with null neighbours.
    """
    blk = df.withColumn("_blk", F.floor(F.col(order) / block))
    inside = Window.partitionBy(*by, "_blk").orderBy(order, *tie)
    row, key = F.struct(*columns), F.struct(order, *tie)
    edges = blk.filter("_blk is not null").groupBy(*by, "_blk").agg(F.min_by(row, key).alias("_head"), F.max_by(row, key).alias("_tail"))
    over = Window.partitionBy(*by).orderBy("_blk")
    edges = edges.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("_blk").alias("_b"), F.lag("_tail").over(over).alias("_before"), F.lead("_head").over(over).alias("_after"))
    out = blk.withColumns({"_p": F.lag(row).over(inside), "_n": F.lead(row).over(inside)} if following else {"_p": F.lag(row).over(inside)})
    same = F.col("_blk") == F.col("_b")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_by{i}"))
    out = out.join(edges, same, "left")
    new: dict[str, Column] = {}
    for c in columns:
        if previous:
            new[f"prev_{c}"] = F.when(F.col("_p").isNotNull(), F.col(f"_p.{c}")).otherwise(F.col(f"_before.{c}"))
        if following:
            new[f"next_{c}"] = F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_after.{c}"))
    return out.withColumns(new).drop("_blk", "_b", "_p", "_n", "_before", "_after", *[f"_by{i}" for i in range(len(by))])


def running_count(df: DataFrame, *, by: list[str], order: str, flag: Column, name: str, tie: list[str] = (), block: float = BLOCK) -> DataFrame:
    """Adds how many rows up to and with this one have ``flag``: an island number where flags mark beginnings."""
    blk = df.withColumns({"_blk": F.floor(F.col(order) / block), "_flag": F.coalesce(flag.cast("int"), F.lit(0))})
    inside = Window.partitionBy(*by, "_blk").orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, 0)
    sums = blk.groupBy(*by, "_blk").agg(F.sum("_flag").alias("_s"))
    over = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("_blk").alias("_b"), F.coalesce(F.sum("_s").over(over), F.lit(0)).alias("_offset"))
    same = F.col("_blk").eqNullSafe(F.col("_b"))
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_by{i}"))
    out = blk.withColumn("_in", F.sum("_flag").over(inside)).join(sums, same, "left")
    return out.withColumn(name, F.col("_in") + F.col("_offset")).drop("_blk", "_flag", "_in", "_b", "_offset", *[f"_by{i}" for i in range(len(by))])


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; the limit acts before the exchange."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def running(df: DataFrame, *, by: list[str], order: str, exprs: dict[str, tuple[str, bool, Column]], block: float = BLOCK) -> DataFrame:
    """Adds running "max" or "min" of expressions; each says whether it looks ahead (to the sequence's end) or back (to its beginning)."""
    blk = df.withColumns({"_blk": F.floor(F.col(order) / block), **{f"_x_{n}": e for n, (_, _, e) in exprs.items()}})
    fn, both = {"max": F.max, "min": F.min}, {"max": F.greatest, "min": F.least}
    # looking ahead is looking back in the opposite order; a frame that ends at the block's end would be computed anew for each row
    inside, over = Window.partitionBy(*by, "_blk"), Window.partitionBy(*by)
    rows = {ahead: inside.orderBy(F.desc(order) if ahead else F.asc(order)).rowsBetween(Window.unboundedPreceding, 0) for ahead in (False, True)}
    rest = {ahead: over.orderBy(F.desc("_blk") if ahead else F.asc("_blk")).rowsBetween(Window.unboundedPreceding, -1) for ahead in (False, True)}
    sums = blk.groupBy(*by, "_blk").agg(*[fn[f](f"_x_{n}").alias(f"_b_{n}") for n, (f, _, _) in exprs.items()])
    sums = sums.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("_blk").alias("_b"), *[fn[f](f"_b_{n}").over(rest[a]).alias(f"_c_{n}") for n, (f, a, _) in exprs.items()])
    same = F.col("_blk").eqNullSafe(F.col("_b"))
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_by{i}"))
    out = blk.withColumns({f"_r_{n}": fn[f](f"_x_{n}").over(rows[a]) for n, (f, a, _) in exprs.items()}).join(sums, same, "left")
    out = out.withColumns({n: both[f](F.col(f"_r_{n}"), F.col(f"_c_{n}")) for n, (f, _, _) in exprs.items()})
    return out.drop("_blk", "_b", *[f"_by{i}" for i in range(len(by))], *[f"{p}{n}" for n in exprs for p in ("_x_", "_r_", "_c_")])
