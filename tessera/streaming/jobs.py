"""Job events as streams: the state each analysis is in, how many entered a state in each window, and which requests join a job that is under way."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TERMINAL = ("complete", "failed")


def latest_states(events: DataFrame) -> DataFrame:
    """The last state of each analysis by sequence (analysis_id, events, state); for update or complete mode. Batch and stream alike."""
    return events.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("events"), F.max_by("state", "seq").alias("state"))


def entered(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """How many events entered each state in each window of event time (column ts); windows close ``late`` behind the newest event, and later events are dropped."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "state").agg(F.count(F.lit(1)).alias("events"))
    return counts.select(F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "state", "events")


def admissions(events: DataFrame, idle_ms: int = 86_400_000) -> DataFrame:
    """(key, request, analysis_id, joined): each request of ``events`` (key, analysis_id, seq, state, ts) gets the analysis of its key that is under way, or begins its own.

    An event of state ``requested`` is a request; one of a terminal state ends the analysis that it names. Only the analysis under way is held for a key, and dropped
    when its key is silent for ``idle_ms`` of event time. Events of one key within a batch count in the order of seq.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        active = state.get[0] if state.exists else None
        rows = []
        newest = 0
        for pdf in batches:
            for r in pdf.sort_values("seq", kind="stable").itertuples(index=False):
                newest = max(newest, int(r.ts.timestamp() * 1000))
                if r.state == "requested":
                    rows.append((key[0], r.analysis_id, active or r.analysis_id, active is not None))
                    active = active or r.analysis_id
                elif r.state in TERMINAL and r.analysis_id == active:
                    active = None
        if active is None:
            if state.exists:
                state.remove()
        else:
            state.update((active,))
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_ms)
        if rows:
            yield pd.DataFrame(rows, columns=["key", "request", "analysis_id", "joined"])

    return events.withWatermark("ts", "10 minutes").groupBy("key").applyInPandasWithState(step, "key string, request string, analysis_id string, joined boolean", "active string", "append", GroupStateTimeout.EventTimeTimeout)
