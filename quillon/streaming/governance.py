"""The proposal state machine as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from quillon.operators.governance import MOVES


def replay_stream(events: DataFrame, key: str = "proposal", order: str = "seq", state: str = "state", first: str = "suggested") -> DataFrame:
    """(key, order, state, legal) as events arrive; each key's state is kept between batches."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        at = held.get[0] if held.exists else None
        for frame in frames:
            frame = frame.sort_values(order)
            legal = []
            for s in frame[state]:
                ok = s == first if at is None else (at, s) in MOVES
                at = s if ok else at
                legal.append(ok)
            yield pd.DataFrame({key: k[0], order: frame[order], state: frame[state], "legal": legal})
        held.update((at,))

    return events.groupBy(key).applyInPandasWithState(run, f"{key} long, {order} long, {state} string, legal boolean", "state string", "append", "NoTimeout")


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts by kind and window, with a watermark for late events."""
    from pyspark.sql import functions as F

    return events.withWatermark(time, late).groupBy(F.window(time, window), kind).agg(F.count(F.lit(1)).alias("n"))
