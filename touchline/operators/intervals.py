"""Overlapping and gapped intervals: continuous periods and the gaps between them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.ranges import Ranges
from touchline.session import materialise, pieces

_LOW = -(2**62)


def scan_range(entity: np.ndarray, start: np.ndarray, end: np.ndarray, carry: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rescan of one range, sorted by entity and start.

    ``carry`` is the greatest end that earlier ranges hold of the first entity, or None. Returns for every row
    the greatest end before it (``_LOW`` where there is none) and whether it begins an island.
    """
    n = len(start)
    first = np.r_[True, entity[1:] != entity[:-1]] if n else np.zeros(0, dtype=bool)
    group = np.cumsum(first) - 1
    # running maximum within an entity: ranks make later entities' values greater than all earlier ones'
    uniq, rank = np.unique(end, return_inverse=True)
    run = np.maximum.accumulate(rank + group * np.int64(len(uniq) + 1)) - group * np.int64(len(uniq) + 1)
    before = np.full(n, _LOW, dtype=np.int64)
    before[1:] = np.where(first[1:], _LOW, uniq[run[:-1]])
    if carry is not None:
        before[group == 0] = np.maximum(before[group == 0], carry)
    return before, start > before


def merge_intervals(df: DataFrame, *, entity: list[str], start: str, end: str, ranges: int | None = None) -> DataFrame:
    """Continuous periods and gaps of every entity, as entity, kind ("period" or "gap"), start, end.

    ``start`` and ``end`` are whole numbers. Intervals that overlap, nest or touch form one period; a gap
    is what lies between two successive periods. Rows with a null start or end or an end not after the
    start are left out; a null entity column is a value like any other; repeated rows change nothing; an empty input
    gives no rows; extra columns are ignored.

    Rows are range-partitioned by (entity, start), so even one entity's intervals are spread; each range's
    greatest end per entity is summed up, combined over the ranges before, and carried into the rescan.
    """
    spark = df.sparkSession
    names = [f"e{i}" for i in range(len(entity))]
    h = F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in names])
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(entity, names)], F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("t"))
    rows = rows.filter("s is not null and t is not null and t > s").groupBy(*names, "s").agg(F.max("t").alias("t"))
    rows = materialise(rows.withColumn("h", h).withColumn("id", F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(n).cast("string")), F.lit("-")) for n in names])), "intervals")
    many = rows.count()  # of a table just written: its footers
    n = ranges or pieces(spark, many)
    bounds = Ranges.draw(rows, F.col("h"), F.col("s"), n, many)
    rows = rows.withColumn("r", bounds.column(F.col("h"), F.col("s")))

    # Only an entity that bounds run through reaches over ranges: at most one a bound, so the carries are few.
    cut = spark.createDataFrame([(int(x),) for x in np.unique(bounds.h)], "h long")
    ends = rows.join(F.broadcast(cut), "h", "left_semi").groupBy("h", "id", "r").agg(F.max("t").alias("t"))
    carries = {}
    for x in ends.collect():  # at most two rows a bound, but for colliding hashes
        carries.setdefault((x["h"], x["id"]), {})[x["r"]] = x["t"]
    carried = {}
    for (_, ident), by in carries.items():
        most = _LOW
        for r in sorted(by):
            if most > _LOW:
                carried[(r, ident)] = most
            most = max(most, by[r])
    last = {ident: max(by) for (_, ident), by in carries.items()}
    first_of = {ident: min(by) for (_, ident), by in carries.items()}

    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)

    def rescan(batches):  # noqa: ANN001
        for r, pdf in _by_range(batches):
            ids, s, t = pdf["id"].to_numpy(), pdf["s"].to_numpy(), pdf["t"].to_numpy()
            before, new = scan_range(ids, s, t, None)
            firsts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            for a, b in zip(firsts, np.r_[firsts[1:], len(ids)]):
                if (have := carried.get((r, ids[a]))) is not None:
                    before[a:b], new[a:b] = scan_range(ids[a:b], s[a:b], t[a:b], have)
            part = np.cumsum(new | np.r_[True, ids[1:] != ids[:-1]]) - 1
            at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            stop = np.maximum.reduceat(t, at)
            closing = np.r_[ids[at][1:] != ids[at][:-1], True]
            # a part is open where it goes on from an earlier range or may go on into a later one
            goes_on = ~new[at]
            opens = goes_on | (closing & np.array([last.get(i, r) > r for i in ids[at]], dtype=bool))
            out = pdf.iloc[at][names].assign(id=ids[at], kind="period", s=s[at], t=stop, opens=opens, goes_on=goes_on, r=r, k=np.arange(len(at)))
            gap = np.flatnonzero(new & (before > _LOW))
            gaps = pdf.iloc[gap][names].assign(id=ids[gap], kind="gap", s=before[gap], t=s[gap], opens=False, goes_on=False, r=r, k=0)
            yield pd.concat([out, gaps], ignore_index=True)

    scanned = rows.repartitionById(n, F.col("r")).sortWithinPartitions("r", "h", "id", "s").mapInPandas(
        rescan, f"{kinds}, id string, kind string, s long, t long, opens boolean, goes_on boolean, r int, k int"
    )
    parts = materialise(scanned, "parts")
    w = Window.partitionBy("id").orderBy("r", "k")
    stitched = parts.filter("opens").withColumn("island", F.sum((~F.col("goes_on")).cast("int")).over(w)).groupBy("id", "island").agg(
        *[F.first(n).alias(n) for n in names], F.lit("period").alias("kind"), F.min("s").alias("s"), F.max("t").alias("t")
    )
    out = parts.filter("not opens").select(*names, "kind", "s", "t").unionByName(stitched.select(*names, "kind", "s", "t"))
    return out.select(*[F.col(n).alias(c) for c, n in zip(entity, names)], "kind", F.col("s").alias(start), F.col("t").alias(end))


def _by_range(batches):  # noqa: ANN001, ANN202
    """Joins Arrow batches, sorted by r, into one frame a range."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        while len(pdf):
            r = pdf["r"].iloc[0]
            if held and held[0]["r"].iloc[0] != r:
                yield int(held[0]["r"].iloc[0]), pd.concat(held, ignore_index=True)
                held = []
            n = int(np.searchsorted(pdf["r"].to_numpy(), r, side="right"))
            held.append(pdf.iloc[:n])
            pdf = pdf.iloc[n:]
    if held:
        yield int(held[0]["r"].iloc[0]), pd.concat(held, ignore_index=True)
