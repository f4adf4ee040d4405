"""Structured Streaming over turns and events."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sessions import SNAPSHOT, empty_state, said, snapshot, transition


def session_states(turns: DataFrame, ts: str | None = None, late: str = "1 hour", idle_ms: int = 6 * 3600 * 1000) -> DataFrame:
    """A snapshot after each turn of a stream (conv_id, turn, entities).

    With a time column ``ts`` the state of a session goes once the watermark is ``idle_ms`` past its last turn; without one it
    stays.  Time is that of the events, since a time-out by the clock never lets a run over the available data end.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = json.loads(state.get[0]) if state.exists else empty_state()
        rows = pd.concat(list(frames)).sort_values("turn")
        out = []
        for r in rows.itertuples(index=False):
            own = transition(own, int(r.turn), [said(e) for e in r.entities])
            out.append(snapshot(int(key[0]), own))
        state.update((json.dumps(own),))
        if ts:
            state.setTimeoutTimestamp(max(int(rows["_ms"].max()), state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(out)

    own = turns.withWatermark(ts, late).withColumn("_ms", F.unix_millis(ts)) if ts else turns
    timeout = GroupStateTimeout.EventTimeTimeout if ts else GroupStateTimeout.NoTimeout
    return own.groupBy("conv_id").applyInPandasWithState(step, SNAPSHOT, "state string", "append", timeout)


def timed(events: DataFrame) -> DataFrame:
    """A watermark needs a timestamp with a zone; batches keep their own type."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")) if events.isStreaming else events


def event_windows(events: DataFrame, late: str = "1 day", length: str = "1 day") -> DataFrame:
    """Counts and sums of events by window and type, open to rows that are late by ``late``."""
    own = timed(events).withWatermark("ts", late).groupBy(F.window("ts", length), "event_type")
    return own.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each user that a pause of ``gap`` ends."""
    own = timed(events).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap))
    return own.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
