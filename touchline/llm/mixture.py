"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.session import materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to this public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Hash buckets a source's random keys are ranged into; the exact cut is made in one bucket of each source.
BUCKET_BITS = 12


def token_counter(path: str = TOKENIZER, pattern: str = PATTERN):  # noqa: ANN201
    """A pandas UDF that counts a text's tokens; null and empty texts have none. The vocabulary is read by the driver (about a megabyte) and shipped to the workers."""
    with open(path, "rb") as f:
        shared = SparkSession.active().sparkContext.broadcast(f.read())
    held: dict = {}

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        if "coder" not in held:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
            held["coder"] = tiktoken.Encoding("mixture", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        coder = held["coder"]
        for texts in batches:
            yield pd.Series([len(coder.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count


def budgets(targets: list[tuple[str, float, int]], available: dict[str, int], total: int | None = None) -> dict[str, float]:
    """Tokens each source contributes.

    A source gives at most its tokens times its repeats. Without ``total`` the mixture is the largest one whose
    shares are exact among the sources that have anything, in proportion of their targets. With ``total``, sources that
    can't give their part give all they may, and the others share the rest in proportion of their targets.
    """
    cap = {s: available.get(s, 0) * max(0, int(r or 0)) for s, _, r in targets}
    want = {s: float(w or 0) for s, w, _ in targets if cap[s] > 0 and (w or 0) > 0}
    if not want:
        return {s: 0.0 for s in cap}
    weight = sum(want.values())
    if total is None:
        total = min(cap[s] / (w / weight) for s, w in want.items())
    out = {s: 0.0 for s in cap}
    left, open_ = float(total), dict(want)
    while open_ and left > 0:
        weight = sum(open_.values())
        full = [s for s, w in open_.items() if left * w / weight >= cap[s]]
        if not full:
            out |= {s: left * w / weight for s, w in open_.items()}
            break
        for s in full:
            out[s] = float(cap[s])
            del open_[s]
        left = total - sum(out.values())
    return out


def mix(docs: DataFrame, targets: DataFrame, *, doc: str, source: Column, tokens: Column, total: int | None = None, seed: int = 42, max_sources: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc, source, tokens, copies) and its report (one row a target source).

    ``targets`` has source, target_share and max_repeats, at most ``max_sources`` rows (more raise an
    error; the plan carries one budget a source). Documents of other or null sources take no part; documents without
    tokens neither. A source without documents contributes nothing and its target falls to the others in proportion.
    Repeated rows of one document count once each. Null shares or repeats count as 0. No documents give an empty mixture and a report of zeros.
    The report's columns: source, target_share, max_repeats, available_tokens, used_tokens, actual_share.

    Each document gets a hash-random key. Keys are ranged into buckets; prefix sums of the buckets' tokens find the
    bucket in which a source's budget ends, and exact prefix sums in that bucket's key order cut it there, at the
    document that brings the source nearest. Sources larger than one epoch repeat whole epochs first.
    """
    spark = docs.sparkSession
    aims = [(r["source"], r["target_share"], r["max_repeats"]) for r in targets.select("source", "target_share", "max_repeats").filter("source is not null").dropDuplicates(["source"]).limit(max_sources + 1).collect()]
    if len(aims) > max_sources:
        raise ValueError(f"more than {max_sources} target sources")
    known = [s for s, _, _ in aims]
    rows = docs.select(F.col(doc).alias("d"), source.alias("s"), tokens.alias("n")).filter(F.col("s").isin(known) & (F.col("n") > 0))
    rows = rows.withColumn("key", F.xxhash64("d", F.lit(seed)))
    # the key's leading bits, with the sign turned so that buckets rise with the key
    bucket = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(2**63))), 64 - BUCKET_BITS)
    rows = materialise(rows.withColumn("b", bucket), "mixture")
    sums = rows.groupBy("s", "b").agg(F.sum("n").alias("n"))  # at most 2**BUCKET_BITS rows a source
    available = {r["s"]: int(r["n"]) for r in sums.groupBy("s").agg(F.sum("n").alias("n")).collect()}  # one row a source
    spent = budgets(aims, available, total)
    # whole epochs, and what is left for a part of one
    shares = [(s, *divmod(int(round(spent[s])), size)) for s, size in available.items()]
    shares = F.broadcast(spark.createDataFrame(shares, "s string, epochs long, rest long"))  # at most max_sources rows
    upto = F.sum("n").over(Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    inside = sums.withColumn("upto", upto).join(shares, "s").groupBy("s", "epochs", "rest").agg(
        F.min(F.when(F.col("upto") > F.col("rest"), F.col("b"))).alias("at"), F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))).alias("held")
    )
    cut = inside.select("s", "epochs", F.coalesce("at", F.lit(2**BUCKET_BITS)).alias("at"), (F.col("rest") - F.coalesce("held", F.lit(0))).alias("left"))
    placed = rows.join(F.broadcast(cut), "s")
    ordered = Window.partitionBy("s").orderBy("key", "d").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.filter("b = at").withColumn("before", F.coalesce(F.sum("n").over(ordered), F.lit(0)))
    edge = edge.withColumn("extra", (F.col("before") + F.col("n") / 2 <= F.col("left")).cast("long"))
    rest = placed.filter("b <> at").withColumn("extra", (F.col("b") < F.col("at")).cast("long"))
    cols = ["d", "s", "n", (F.col("epochs") + F.col("extra")).alias("copies")]
    mixture = rest.select(*cols).unionByName(edge.select(*cols)).filter("copies > 0")
    used = mixture.groupBy("s").agg(F.sum(F.col("n") * F.col("copies")).alias("used_tokens"))
    have = spark.createDataFrame([(s, float(w or 0), int(r or 0), available.get(s, 0)) for s, w, r in aims] or [("", 0.0, 0, 0)], "s string, target_share double, max_repeats int, available_tokens long").filter(F.lit(bool(aims)))
    report = have.join(used, "s", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    everything = F.sum("used_tokens").over(Window.partitionBy())  # one row a target source
    report = report.withColumn("actual_share", F.when(everything > 0, F.col("used_tokens") / everything).otherwise(0.0)).withColumnRenamed("s", "source")
    return mixture.select(F.col("d").alias(doc), F.col("s").alias("source"), F.col("n").alias("tokens"), "copies"), report
