"""Runs of repeated consecutive events, found by backreference on symbol strings."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.sequence import neighbours, running_count
from touchline.session import materialise, parallelism

_RUN = re.compile(r"(.)\1*", re.DOTALL)
_FIRST = 0x100  # code points below are free for separators
_SEPARATOR = 0x1F


def symbol_string(symbols: np.ndarray, breaks: np.ndarray) -> tuple[str, np.ndarray]:
    """One code point a row, a separator before each row of ``breaks``; and the row each position stands for."""
    code = symbols.astype(np.uint32) + _FIRST
    code[code >= 0xD800] += 0x800  # surrogates are no characters
    at = np.flatnonzero(breaks)
    rows = np.insert(np.arange(len(code)), at, -1)
    return np.insert(code, at, _SEPARATOR).astype("<u4").tobytes().decode("utf-32-le"), rows


def spans(text: str) -> np.ndarray:
    """Start and end of every run, separators left out."""
    found = [m.span() for m in _RUN.finditer(text) if m[1] != "\x1f"]
    return np.array(found, dtype=np.int64).reshape(-1, 2)


def collapse_runs(
    df: DataFrame, *, entity: str, order: str, event: list[str], time: str | None = None, max_gap: int = 15, min_rows: int = 2, block: int = 65536
) -> DataFrame:
    """Each maximal run of equal consecutive events of an entity as one row.

    Columns: entity, the event's columns, first, last (of ``order``), n_rows, and, if ``time`` is given, duration
    (time at the last less time at the first row, null where either is null or NaN). Rows more than ``max_gap``
    apart don't belong together. Runs shorter than ``min_rows`` are left out. ``df`` has one row
    per (entity, order); rows with a null in either are left out; null event values equal each other and differ from
    all else. Empty input gives no rows; extra columns are ignored.

    Canonical events become code points, an entity's rows a string, and a backreference finds the repetitions.
    An entity is cut into blocks of ``block`` steps of ``order``, so it need not fit one task; only the first and the
    last run of each piece, which may go on next door, are stitched afterwards, in blocks as well.
    """
    spark = df.sparkSession
    kinds = {c: df.schema[c].dataType.simpleString() for c in (entity, order, *event)}
    t = F.col(time).cast("double") if time else F.lit(None).cast("double")
    rows = df.filter(F.col(entity).isNotNull() & F.col(order).isNotNull()).select(
        F.col(entity).alias("e"), F.col(order).cast("long").alias("o"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(event)],
        F.when(~F.isnan(t), t).alias("t"), F.floor(F.col(order) / block).alias("blk"),
    )
    vals = [f"v{i}" for i in range(len(event))]
    schema = f"e {kinds[entity]}, {', '.join(f'{v} {kinds[c]}' for v, c in zip(vals, event))}, o0 long, o1 long, n long, t0 double, t1 double, head boolean, tail boolean"

    def find(batches):  # noqa: ANN001
        for pdf in batches:
            if not len(pdf):
                continue
            e, o, blk = pdf["e"].to_numpy(), pdf["o"].to_numpy(), pdf["blk"].to_numpy()
            symbol = pdf.groupby(vals, sort=False, dropna=False).ngroup().to_numpy()
            piece = np.r_[False, (e[1:] != e[:-1]) | (blk[1:] != blk[:-1])]
            text, row = symbol_string(symbol, piece | np.r_[False, np.diff(o) > max_gap])
            at = spans(text)
            a, b = row[at[:, 0]], row[at[:, 1] - 1]
            number = np.cumsum(piece)[a]  # the piece a run lies in
            change = number[1:] != number[:-1]
            head, tail = np.r_[True, change], np.r_[change, True]
            n = b - a + 1
            keep = (n >= min_rows) | head | tail
            a, b = a[keep], b[keep]
            out = pdf.iloc[a][["e", *vals]].reset_index(drop=True)
            yield out.assign(o0=o[a], o1=o[b], n=n[keep], t0=pdf["t"].to_numpy()[a], t1=pdf["t"].to_numpy()[b], head=head[keep], tail=tail[keep])

    found = rows.repartition(parallelism(spark), "e", "blk").sortWithinPartitions("e", "blk", "o").mapInPandas(find, schema)
    found = materialise(found, "runs")
    # few rows if blocks are full; where ticks are sparse nearly all, so these are taken in (wider) blocks, too
    edge = neighbours(found.filter("head or tail"), by=["e"], order="o0", columns=[*vals, "tail", "o1"], block=64 * block)
    same = F.lit(True)
    for v in vals:
        same = same & F.col(v).eqNullSafe(F.col(f"prev_{v}"))
    joined = F.coalesce(same & F.col("head") & F.col("prev_tail") & (F.col("o0") - F.col("prev_o1") <= max_gap), F.lit(False))
    edge = running_count(edge.withColumn("new", ~joined), by=["e"], order="o0", flag=F.col("new"), name="run", block=64 * block)
    edge = edge.groupBy("e", "run").agg(
        *[F.min_by(v, "o0").alias(v) for v in vals], F.min("o0").alias("o0"), F.max("o1").alias("o1"), F.sum("n").alias("n"),
        F.min_by("t0", "o0").alias("t0"), F.max_by("t1", "o1").alias("t1"),
    )
    cols = ["e", *vals, "o0", "o1", "n", "t0", "t1"]
    runs = found.filter("not head and not tail").select(*cols).unionByName(edge.select(*cols)).filter(F.col("n") >= min_rows)
    finite = lambda c: F.when(~F.isnan(c), F.col(c))
    return runs.select(
        F.col("e").alias(entity), *[F.col(v).alias(c) for v, c in zip(vals, event)], F.col("o0").alias("first"), F.col("o1").alias("last"),
        F.col("n").alias("n_rows"), *([(finite("t1") - finite("t0")).alias("duration")] if time else []),
    )
