"""Anchored clustering of a stream of positions, as an extension of the batch operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "key string, anchor long, last long, members long"
_STATE = "anchor long, last long, members long"


def stream_clusters(events: DataFrame, key: str, at: str, event_time: str, distance: int, lateness: str = "10 minutes") -> DataFrame:
    """Clusters of positions (longs that do not fall over event time) by key: a position further than `distance` from the
    cluster's first one closes it and begins the next; what is open when the watermark passes its last event is closed too.

    State is one open cluster for each key. Append mode."""

    def fold(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        if state.hasTimedOut:
            out.append((group[0], *state.get))
            state.remove()
        else:
            anchor, last, members = state.get if state.exists else (None, None, 0)
            rows = pd.concat(list(batches)).sort_values("at")
            latest = int(rows["ms"].max())
            for p in rows["at"].tolist():
                if anchor is None or p - anchor > distance:
                    if anchor is not None:
                        out.append((group[0], anchor, last, members))
                    anchor, members = p, 0
                last, members = p, members + 1
            state.update((anchor, last, members))
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["key", "anchor", "last", "members"])

    from pyspark.sql import functions as F

    rows = events.withWatermark(event_time, lateness).select(F.col(key).cast("string").alias("key"), F.col(at).cast("long").alias("at"), event_time, F.unix_millis(F.col(event_time)).alias("ms"))
    return rows.groupBy("key").applyInPandasWithState(fold, OUTPUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
