"""Explicit range partitioning: a range is a pure function of a row's own key.

Unlike the bounds of ``repartitionByRange``, which are drawn anew by every job, these stay the same over
several passes and after the loss of an executor, so what one pass sums up per range holds in the next.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows the driver sees per range when it draws bounds, and at most in all. Bounds only decide balance, never a result.
SAMPLE_PER_RANGE, SAMPLE_MOST = 64, 500_000


class Ranges:
    """Ranges over (h, s): a 64-bit hash of the entity, then a sortable 64-bit position in it."""

    def __init__(self, h: list[int], s: list[int]):
        self.h, self.s = np.array(h, dtype=np.int64), np.array(s, dtype=np.int64)

    @classmethod
    def draw(cls, df: DataFrame, h: Column, s: Column, n: int, rows: int) -> Ranges:
        """Bounds of ``n`` ranges from a sample of the ``rows`` rows, about ``SAMPLE_PER_RANGE`` a range, fewer where there are many ranges."""
        if n < 2 or not rows:
            return cls([], [])
        want = min(n * SAMPLE_PER_RANGE, SAMPLE_MOST)
        keys = df.select(h.alias("h"), s.cast("long").alias("s")).na.drop()
        drawn = keys.sample(min(1.0, want / rows), seed=7).limit(2 * want).toPandas().sort_values(["h", "s"])
        if not len(drawn):
            return cls([], [])
        at = drawn.iloc[np.unique(np.linspace(0, len(drawn), n + 1).astype(int)[1:-1])].drop_duplicates()
        return cls(at["h"].tolist(), at["s"].tolist())

    def __len__(self) -> int:
        return len(self.h) + 1

    def of(self, h: np.ndarray, s: np.ndarray) -> np.ndarray:
        """The range of each key: how many bounds are at or below it."""
        lo, hi = np.searchsorted(self.h, h, side="left"), np.searchsorted(self.h, h, side="right")
        out = lo.astype(np.int32)
        for value in np.unique(h[hi > lo]):  # only entities that bounds run through
            rows = h == value
            a, b = lo[rows][0], hi[rows][0]
            out[rows] = a + np.searchsorted(self.s[a:b], s[rows], side="right")
        return out

    def column(self, h: Column, s: Column) -> Column:
        @F.pandas_udf("int")
        def of(h: pd.Series, s: pd.Series) -> pd.Series:
            return pd.Series(self.of(h.to_numpy(dtype=np.int64), s.to_numpy(dtype=np.int64)))

        return of(h, s.cast("long"))
