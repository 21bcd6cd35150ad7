"""References to records that do not exist, or not yet, or no longer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.ranges import Ranges
from touchline.session import materialise, parallelism, pieces

_REASONS = np.array(["", "missing", "gone", "late"], dtype=object)


def orphan_references(refs: DataFrame, parents: DataFrame, *, hot: int = 100_000, ranges: int | None = None) -> DataFrame:
    """The rows of ``refs`` whose parent is absent, gone or late, with ``reason`` "missing", "gone" or "late".

    ``refs`` needs ``key`` (any text naming table and record) and ``seen`` (when the
    reference was first loaded), ``parents`` one row a ``key`` with ``gone`` (boolean) and ``since`` (when
    it was first loaded). A null key is no reference. A null ``seen`` or ``since`` makes nothing late, a null ``gone`` is
    false. Repeated references are all reported. An empty ``parents`` makes all references "missing".
    Other columns of ``refs`` are kept.

    Both sides are range-partitioned by the key's hash, with bounds drawn from both. Each range holds its parents as sorted
    arrays and probes them with vectorised batches of references by binary search; keys themselves are compared only where hashes are equal. Keys that
    more than ``hot`` references share, and more than a quarter of what a partition holds on average (so at most four a partition), are spread
    over as many ranges as they have times that, their parents copied to each.
    """
    spark = refs.sparkSession
    kept = refs.columns
    refs, parents = refs.filter("key is not null"), parents.filter("key is not null")
    nothing = {c: F.lit(None).cast(refs.schema[c].dataType) for c in kept if c != "key"}
    # a missing time makes nothing late
    stamp = lambda c, rest: F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(rest))
    up = parents.select(
        F.col("key"), *[v.alias(c) for c, v in nothing.items()], F.lit(0).alias("_side"),
        stamp("since", -(2**63)).alias("_at"), F.coalesce(F.col("gone"), F.lit(False)).alias("_gone"),
    ).select(*kept, "_side", "_at", "_gone")
    down = refs.select(*kept, F.lit(1).alias("_side"), stamp("seen", 2**63 - 1).alias("_at"), F.lit(False).alias("_gone"))
    both = materialise(up.unionByName(down).withColumn("_h", F.xxhash64("key")), "refs")
    rows = both.count()  # of a table just written: its footers
    hot = max(hot, rows // (4 * parallelism(spark)))
    wide = both.filter("_side = 1").groupBy("_h").count().filter(F.col("count") > hot)
    wide = {x["_h"]: -(-x["count"] // hot) for x in wide.collect()}  # at most 4 * parallelism rows
    both = both.withColumn("_g", F.col("_h"))
    if wide:
        salts = spark.createDataFrame(list(wide.items()), "_h long, _salts int")
        both = both.join(F.broadcast(salts), "_h", "left")
        mine = F.when(F.col("_side") == 0, F.sequence(F.lit(0), F.col("_salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64(*kept), F.col("_salts")).cast("int")))
        both = both.withColumn("_salt", F.explode(F.when(F.col("_salts").isNull(), F.array(F.lit(0))).otherwise(mine)))
        both = both.withColumn("_g", F.when(F.col("_salt") == 0, F.col("_h")).otherwise(F.xxhash64("_h", "_salt"))).drop("_salts", "_salt")
    n = ranges or pieces(spark, rows)
    bounds = Ranges.draw(both, F.col("_g"), F.lit(0), n, rows)
    both = both.drop("_h").withColumn("_r", bounds.column(F.col("_g"), F.lit(0)))
    schema = ", ".join(f"`{c}` {refs.schema[c].dataType.simpleString()}" for c in kept) + ", reason string"

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        arrays, current = None, None
        for batch in batches:
            r = batch.column("_r").to_numpy()
            side = batch.column("_side").to_numpy()
            # stretches of one range and one side, in order
            cut = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (side[1:] != side[:-1])]) if len(r) else []
            for a, b in zip(cut, np.r_[cut[1:], len(r)] if len(r) else []):
                if r[a] != current:
                    current, held, arrays = r[a], [], None
                part = batch.slice(a, b - a)
                if side[a] == 0:
                    held.append(part.select(["_g", "key", "_at", "_gone"]))
                    arrays = None
                    continue
                if arrays is None:
                    arrays = _arrays(held)
                told = _probe(arrays, part)
                if told.any():
                    out = part.select(kept).filter(pa.array(told > 0))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(_REASONS[told[told > 0]], pa.string())], names=[*kept, "reason"])

    placed = both.repartitionById(n, F.col("_r")).sortWithinPartitions("_r", "_side", "_g", "key")
    return placed.mapInArrow(probe, schema)


def _arrays(held: list[pa.RecordBatch]) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray] | None:
    """A range's parents as arrays; they arrive sorted by hash."""
    if not held:
        return None
    whole = pa.Table.from_batches(held).combine_chunks()
    key = whole.column("key").chunk(0) if whole.column("key").num_chunks else pa.array([], pa.string())
    return whole.column("_g").to_numpy(), key.cast(pa.large_string()), whole.column("_at").to_numpy(), whole.column("_gone").to_numpy()


def _probe(arrays: tuple | None, ask: pa.RecordBatch) -> np.ndarray:
    """0 where the parent is there, else the number of the reason."""
    out = np.ones(ask.num_rows, dtype=np.int8)
    if arrays is None:
        return out
    h, key, since, gone = arrays
    g, seen, k = ask.column("_g").to_numpy(), ask.column("_at").to_numpy(), ask.column("key").cast(pa.large_string())
    at = np.searchsorted(h, g, side="left")
    todo = np.arange(len(g))
    while len(todo):  # more than one step only where hashes of different keys collide
        todo = todo[at[todo] < len(h)]
        todo = todo[h[at[todo]] == g[todo]]
        if not len(todo):
            break
        same = pc.equal(key.take(pa.array(at[todo])), k.take(pa.array(todo))).to_numpy(zero_copy_only=False)
        hit = todo[same]
        p = at[hit]
        out[hit] = np.where(gone[p], 2, np.where(since[p] > seen[hit], 3, 0))
        todo = todo[~same]
        at[todo] += 1
    return out
