"""Irregular readings onto a regular grid."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.ids import finite
from touchline.session import materialise


def asof_fill(grid: np.ndarray, at: np.ndarray, values: np.ndarray, max_gap: float) -> np.ndarray:
    """As-of merge of a sorted grid and sorted readings, both sides, weighted by time.

    ``values`` has one row a reading; the result one row a grid point, NaN where a side is missing or the
    neighbours are more than ``max_gap`` apart.
    """
    out = np.full((len(grid), values.shape[1]), np.nan)
    if not len(at) or not len(grid):
        return out
    after = np.searchsorted(at, grid, side="left")
    before = np.searchsorted(at, grid, side="right") - 1
    ok = (before >= 0) & (after < len(at))
    lo, hi = before[ok], after[ok]
    span = at[hi] - at[lo]
    share = np.where(span > 0, (grid[ok] - at[lo]) / np.where(span > 0, span, 1), 0.0)[:, None]
    filled = values[lo] * (1 - share) + values[hi] * share
    filled[span > max_gap] = np.nan
    out[ok] = filled
    return out


def regular_series(
    df: DataFrame, *, source: str, tick: str, values: list[str], step: int, max_gap: int, chunk: int = 4096, longest: int | None = None
) -> DataFrame:
    """One row per source and period of ``step`` ticks, from its first to its last reading.

    Columns: source, period_start, n_periods (1), n_readings, the values and ``fill``: "observed" (mean of the period's
    readings), "interpolated" (as-of neighbours of the period's middle on both sides, weighted by time) or
    "missing" (neighbours more than ``max_gap`` ticks apart, values null). A row
    without source, tick or with a null or NaN value is no reading. Repeated rows of one tick are averaged
    first, so deliveries don't weigh. No readings, no rows. Extra columns are ignored.

    With ``longest``, a stretch of more than so many (at least two chunks of) periods without a reading is one "missing" row, with their number in ``n_periods``:
    one wrong tick far out then costs one row. Without it every period has its row.

    Readings are reduced to periods before the shuffle; a source is filled in chunks of
    ``chunk`` periods, each with its neighbours' nearest readings, so no source must fit one task.
    """
    m = len(values)
    reading = df.select(F.col(source).alias("src"), F.col(tick).cast("long").alias("tick"), *[finite(F.col(v).cast("double")).alias(f"x{k}") for k, v in enumerate(values)])
    reading = reading.na.drop()
    xs = [f"x{k}" for k in range(m)]
    per_tick = reading.groupBy("src", "tick").agg(*[F.avg(x).alias(x) for x in xs])
    period = F.floor(F.col("tick") / step)
    ends = F.struct("tick", *xs)
    seen = per_tick.withColumn("p", period).groupBy("src", "p").agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(x) for x in xs], F.min(ends).alias("first"), F.max(ends).alias("last"))
    seen = seen.select(
        "src", "p", "n", *xs, F.col("first.tick").alias("t0"), *[F.col(f"first.{x}").alias(f"a{k}") for k, x in enumerate(xs)],
        F.col("last.tick").alias("t1"), *[F.col(f"last.{x}").alias(f"z{k}") for k, x in enumerate(xs)], F.floor(F.col("p") / chunk).alias("c"),
    )
    seen = materialise(seen, "periods")
    # chunk table: small (one row a chunk of periods), carries the nearest reading on either side
    front, back = (F.struct("p", *cols) for cols in (["t0", *[f"a{k}" for k in range(m)]], ["t1", *[f"z{k}" for k in range(m)]]))
    edge = seen.groupBy("src", "c").agg(F.min(front).alias("head"), F.max(back).alias("tail"))
    w = Window.partitionBy("src").orderBy("c")
    edge = edge.withColumns({"prev": F.lag("tail").over(w), "next": F.lead("head").over(w), "c_prev": F.lag("c").over(w)})
    far = None
    if longest is not None:
        most = F.lit(max(longest, 2 * chunk))
        cut = F.coalesce(F.col("next.p") - F.col("tail.p") - 1 > most, F.lit(False))
        far = edge.filter(cut).select("src", (F.col("tail.p") + 1).alias("p"), (F.col("next.p") - F.col("tail.p") - 1).alias("n_periods"))
        before = F.coalesce(F.col("head.p") - F.col("prev.p") - 1 > most, F.lit(False))
        edge = edge.withColumns({"next": F.when(~cut, F.col("next")), "prev": F.when(~before, F.col("prev")), "c_prev": F.when(~before, F.col("c_prev"))})
    # every chunk between the first and the last, also those without a reading, each with both its neighbours' readings
    near = [F.col("prev.t1").alias("pt"), *[F.col(f"prev.z{k}").alias(f"pv{k}") for k in range(m)]]
    after = lambda s: [F.col(f"{s}.p").alias("p_next"), F.col(f"{s}.t0").alias("nt"), *[F.col(f"{s}.a{k}").alias(f"nv{k}") for k in range(m)]]
    filled = edge.select("src", "c", *near, *after("next"))
    between = edge.filter("c_prev is not null and c > c_prev + 1").select("src", F.explode(F.sequence(F.col("c_prev") + 1, F.col("c") - 1)).alias("c"), *near, *after("head"))
    body = ["p", "n", *xs, "t0", *[f"a{k}" for k in range(m)], "t1", *[f"z{k}" for k in range(m)]]
    heads = filled.unionByName(between).withColumn("kind", F.lit(0)).select("*", *[F.lit(None).cast(seen.schema[c].dataType).alias(c) for c in body])
    none = {c: F.lit(None).cast(heads.schema[c].dataType) for c in ("pt", "p_next", "nt", *[f"{s}{k}" for s in ("pv", "nv") for k in range(m)])}
    rows_side = seen.withColumns({**none, "kind": F.lit(1)}).select(*heads.columns)
    schema = f"src {seen.schema['src'].dataType.simpleString()}, p long, n long, {', '.join(f'{x} double' for x in xs)}, fill string"

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        src, c = key
        head, rows = pdf[pdf["kind"] == 0].iloc[0], pdf[pdf["kind"] == 1].sort_values("p")
        first, last = c * chunk, c * chunk + chunk - 1
        p = rows["p"].to_numpy(dtype=np.int64)
        if len(p):
            first = first if pd.notna(head["pt"]) else p[0]
            last = last if pd.notna(head["p_next"]) else p[-1]
        grid = np.arange(first, last + 1, dtype=np.int64)
        of = lambda df, name: df[[f"{name}{k}" for k in range(m)]].to_numpy(dtype=float)
        at, val = [], []
        if pd.notna(head["pt"]):
            at.append([head["pt"]]), val.append(of(pdf[pdf["kind"] == 0], "pv")[:1])
        if len(p):
            t = np.stack([rows["t0"].to_numpy(dtype=float), rows["t1"].to_numpy(dtype=float)], 1).ravel()
            v = np.stack([of(rows, "a"), of(rows, "z")], 1).reshape(-1, m)
            keep = np.r_[True, t[1:] > t[:-1]]
            at.append(t[keep]), val.append(v[keep])
        if pd.notna(head["nt"]):
            at.append([head["nt"]]), val.append(of(pdf[pdf["kind"] == 0], "nv")[:1])
        at, val = np.concatenate(at).astype(float), np.concatenate(val).astype(float)
        got = np.isin(grid, p)
        out = asof_fill(grid * step + (step - 1) / 2, at, val, max_gap)
        n = np.zeros(len(grid), dtype=np.int64)
        out[got], n[got] = rows[xs].to_numpy(dtype=float), rows["n"].to_numpy()
        how = np.where(got, "observed", np.where(np.isnan(out[:, 0]), "missing", "interpolated"))
        res = pd.DataFrame({"src": [src] * len(grid), "p": grid, "n": n})
        for k, x in enumerate(xs):
            res[x] = out[:, k]
        return res.assign(fill=how)

    made = heads.unionByName(rows_side).groupBy("src", "c").applyInPandas(fill, schema).withColumn("n_periods", F.lit(1).cast("long"))
    if far is not None:
        made = made.unionByName(far.select("src", "p", F.lit(0).cast("long").alias("n"), *[F.lit(None).cast("double").alias(x) for x in xs], F.lit("missing").alias("fill"), "n_periods"))
    return made.select(F.col("src").alias(source), (F.col("p") * step).cast("int").alias("period_start"), "n_periods", F.col("n").alias("n_readings"), *[finite(x).alias(v) for x, v in zip(xs, values)], "fill")
