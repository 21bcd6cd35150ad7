"""Streaming twins of batch operators: session islands, windowed rates and the possession chain."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from touchline.operators.stateful import ChainSpec, PossessionChain, missing


def session_islands(events: DataFrame, *, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Stretches of a key's events no more than ``gap`` apart; rows later than ``late`` behind the stream are dropped."""
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(F.col(key), w).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def windowed_rates(events: DataFrame, *, key: str, ts: str, value: str, size: str, slide: str, late: str) -> DataFrame:
    """Count and sum of a key's events per sliding window."""
    w = F.window(ts, size, slide)
    return events.withWatermark(ts, late).groupBy(F.col(key), w).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total")


def live_possessions(rows: DataFrame, *, by: str, spec: ChainSpec = ChainSpec()) -> DataFrame:
    """Possession segments of a stream of association rows, emitted as they close. Rows of one batch are put in order
    of their frame; a row of an earlier frame than the last one handled is late and left out."""
    kind = rows.schema[by].dataType.simpleString()
    fields = ("owner", "begun", "count", "candidate", "seen", "carried", "carried_from", "last")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chain = PossessionChain(spec)
        if state.exists:
            for f, v in json.loads(state.get[0]).items():
                setattr(chain, f, tuple(v) if f == "begun" and v is not None else v)
        upto = chain.last["frame"] if chain.last else -1
        out = []
        for row in pd.concat(list(batches)).sort_values("frame").to_dict("records"):
            if row["frame"] <= upto:
                continue
            row = {k: (None if missing(v) else v.item() if hasattr(v, "item") else v) for k, v in row.items()}
            _, done = chain.step(row)
            if done:
                out.append((*key, *done))
        state.update((json.dumps({f: getattr(chain, f) for f in fields}),))
        yield pd.DataFrame(out, columns=[by, "segment", "player_id", "start_time", "end_time", "duration_seconds", "start_frame", "end_frame", "end_reason"])

    return rows.select(by, "frame", "time", "player", "distance", "speed", "state", "excluded", "repaired").groupBy(by).applyInPandasWithState(
        step, f"{by} {kind}, segment int, player_id string, start_time double, end_time double, duration_seconds double, start_frame int, end_frame int, end_reason string", "state string", "append", GroupStateTimeout.NoTimeout
    )
