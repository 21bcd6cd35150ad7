"""The N highest-scoring items of every group, by descending score bands."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.session import materialise, on_release, parallelism, scratch


def _bucketed(df: DataFrame, n: int, tag: str, by: list[str] = ()) -> DataFrame:
    """Writes ``df`` to the shared folder in ``n`` buckets of its column ``h``, one folder per value of ``by``: what is read back
    is already placed by ``h``, so ranking and joining on it need no exchange."""
    spark, name = df.sparkSession, f"touchline_{tag}_{uuid.uuid4().hex}"
    w = df.write.format("parquet").bucketBy(n, "h").option("path", scratch(spark, name))
    on_release(lambda: _drop(spark, name))
    (w.partitionBy(*by) if by else w).saveAsTable(name)
    return spark.table(name)


def _drop(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # the session may be gone already, and its catalog with it
        pass


def shares(rows: int, groups: int, n: int) -> list[float]:
    """Share of all scores above each band's lower edge: the first band holds about three times what the groups take (but no less than quantiles are told
    apart), a second one three times as much, the last is open."""
    if not rows or not groups:
        return []
    first = max(0.004, 3.0 * n * groups / rows)
    return [s for s in (first, 3 * first) if s < 0.9]


def top_n(
    df: DataFrame, *, group: list[str], score: str, tie: str, n: int, version: str | None = None, bands: tuple[float, ...] | None = None, hot: int = 100_000
) -> DataFrame:
    """Up to ``n`` rows of each group with the greatest ``score``, equal scores in ascending order of ``tie``.

    Columns: group, tie, score, rank. Null or NaN scores aren't ranked; a null tie comes first; repeated rows are ranked
    one after the other; a null in the group columns is a value of its own. Empty input gives no rows; extra columns are ignored.
    With ``version``, of several rows of one (group, tie) only that of the greatest version counts (nulls lowest; of equal versions the greatest
    score), also if its score isn't ranked.

    Scores are cut into bands at approximate quantiles (they decide the cost, not the result; ``bands`` are the shares of the scores above their edges). From the top
    band down, a band is read without groups that are full, which an anti-join takes out before anything is ranked, the rest is
    ranked exactly, and a group takes as many as it still lacks; once all groups are full, what is below isn't read.

    Without ``version``, ``df`` itself is read once a band (and once each for sizes and quantiles), and before a band's exchange each task keeps at most ``n`` rows of a
    group, so a group of any size is ranked without meeting in one task. With ``version`` rows have to meet: they are placed once, by group, and written in bands that are
    ranked and joined as they lie. There a group of more than ``hot`` rows and a quarter of what a partition holds on average (so there are at most four a
    partition) is spread over parts, its deliveries are reduced before the exchange, and the best of its parts are ranked once more.
    """
    names, spark = [f"g{i}" for i in range(len(group))], df.sparkSession
    buckets = parallelism(spark)
    rows = df.select(*[F.col(c).alias(g) for c, g in zip(group, names)], F.col(tie).alias("tie"), F.col(score).alias("score"), *([F.col(version).alias("v")] if version else []))
    sizes = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("c"))
    size = sizes.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("groups"), F.max("c").alias("most")).first()
    hot = max(hot, size["rows"] // (4 * buckets))
    edges: list[float] = []
    if cuts := list(bands) if bands is not None else shares(size["rows"], size["groups"], n):
        ranked = rows.select(F.col("score").cast("double").alias("s")).filter(F.col("s").isNotNull() & ~F.isnan("s"))
        edges = ranked.agg(F.percentile_approx("s", [1 - c for c in cuts], 1000).alias("q")).first()["q"] or []

    keys = ["h", *names, "part"]
    split = bool(version) and (size["most"] or 0) > hot
    if split:
        wide = sizes.filter(F.col("c") > hot).groupBy(F.xxhash64(*names).alias("g")).agg(F.ceil(F.sum("c") / hot).alias("parts"))  # at most 4 * buckets rows
        # equal ties stay together where their versions have to meet
        salt = F.pmod(F.xxhash64("tie"), F.col("parts")) + 1
        rows = rows.withColumn("g", F.xxhash64(*names)).join(F.broadcast(wide), "g", "left").withColumn("part", F.coalesce(salt, F.lit(0)).cast("int")).drop("g", "parts")
    else:
        rows = rows.withColumn("part", F.lit(0))
    rows = rows.withColumn("h", F.xxhash64(*names, "part"))
    if version:
        columns, newest = [*keys, "tie"], F.max(F.struct("v", "score")).alias("z")
        if split:
            fewer = rows.filter("part > 0").groupBy(*columns).agg(newest).select(*columns, "z.*")
            rows = rows.filter("part = 0").select(*fewer.columns).unionByName(fewer)
        rows = rows.repartition(buckets, "h").groupBy(*columns).agg(newest).select(*columns, "z.score")
    rows = rows.filter(F.col("score").isNotNull() & ~F.isnan(F.col("score").cast("double")))
    band = reduce(lambda rest, ie: F.when(F.col("score") >= ie[1], ie[0]).otherwise(rest), reversed(list(enumerate(edges))), F.lit(len(edges)))
    rows = rows.withColumn("band", band)
    if version:
        rows = _bucketed(rows, buckets, "bands", ["band"])

    same = F.struct(*names, "part")
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("tie").asc())
    taken: list[DataFrame] = []
    for b in range(len(edges) + 1):
        best = rows.filter(F.col("band") == b).drop("band")
        have = F.lit(0)
        for i, above in enumerate(taken):
            # joins on the hash alone, by which both sides are placed; groups of one hash (two, if hashes collide) are told apart in a list
            full = above.filter(F.col("rank") == n).groupBy(F.col("h").alias("hf")).agg(F.collect_list(same).alias("full"))
            best = best.join(full, (F.col("h") == F.col("hf")) & F.array_contains("full", same), "left_anti")
            got = above.groupBy(F.col("h").alias(f"h{i}")).agg(F.collect_list(F.struct(same.alias("k"), "rank")).alias(f"got{i}"))
            best = best.join(got, F.col("h") == F.col(f"h{i}"), "left")
            mine = F.transform(F.filter(f"got{i}", lambda x: x["k"] == same), lambda x: x["rank"])
            have = F.greatest(have, F.coalesce(F.array_max(mine), F.lit(0)))
        best = best.withColumn("have", have).select(*keys, "tie", "score", "have")
        best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).withColumn("rank", F.col("rank") + F.col("have")).filter(F.col("rank") <= n)
        best = best.select(*keys, "tie", "score", "rank")
        taken.append(_bucketed(best, buckets, f"taken{b}") if version else materialise(best, f"taken{b}"))
        if not split and b < len(edges) and sum(t.filter(F.col("rank") == n).count() for t in taken) == size["groups"]:
            break
    out = reduce(DataFrame.unionByName, taken)
    if split:
        whole = Window.partitionBy(*names).orderBy(F.col("score").desc(), F.col("tie").asc())
        again = out.filter("part > 0").withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= n)
        out = out.filter("part = 0").unionByName(again)
    return out.select(*[F.col(g).alias(c) for c, g in zip(group, names)], F.col("tie").alias(tie), F.col("score").alias(score), "rank")
