"""Structured Streaming forms: latest status, bar sums, sessions, keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_status(events: DataFrame, key: str, order: str, status: str) -> DataFrame:
    """Running last status of every key (update or complete mode)."""
    return events.groupBy(key).agg(F.max_by(status, order).alias(status), F.count(F.lit(1)).alias("events"))


def bar_sums(events: DataFrame, ts: str, keys: list[str], value: str, width: str = "8 hours", late: str = "1 day") -> DataFrame:
    """Sums of tumbling windows; rows later than ``late`` are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.sum(value).alias("power"), F.count(F.lit(1)).alias("n"))


def gap_sessions(events: DataFrame, ts: str, keys: list[str], gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions that end after an idle gap."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("n"))


def run_for(query: StreamingQuery, seconds: float) -> bool:
    """Wait for a query up to a deadline and stop it then; whether it ended by itself.

    What its last whole trigger wrote stays; a later start goes on from there.
    """
    ended = query.awaitTermination(seconds)
    if not ended:
        query.stop()
    return bool(ended)


def hysteresis_stream(points: DataFrame, key: str, order: str, value: str, on: float = 0.5, off: float = 0.3) -> DataFrame:
    """Two-threshold state of every key over arriving points; the state is one flag a key.

    Points of one trigger are taken in order; points of later triggers must
    not lie before them.
    """
    kind = points.schema[key].dataType.simpleString()
    at = points.schema[order].dataType.simpleString()

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flag = bool(state.get[0]) if state.exists else False
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for x in rows[value]:
            flag = x >= off if flag else x > on
            out.append(bool(flag))
        state.update((flag,))
        yield pd.DataFrame({key: [k[0]] * len(rows), order: rows[order].to_numpy(), "state": out})

    return points.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {order} {at}, state boolean", "flag boolean", "append", GroupStateTimeout.NoTimeout)
