"""Run boundaries as a keyed stream: what is open, what closed, what never came back.

Keys are platform, session and turn together. A start opens a run, and another one while it is open
changes nothing; a stop closes it; a run that is open for longer than allowed, by event time, is told as
incomplete once, and a late stop then recovers it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, status string, started_at timestamp, ended_at timestamp, n_events long"
STATE = "status string, started_ms long, last_ms long, n long"


def run_key(platform: Column, session: Column, turn: Column) -> Column:
    """One key of the three, each with its length, so that no two triples share one."""
    part = lambda c: F.concat(F.length(F.coalesce(c, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(c, F.lit("")))
    return F.concat_ws("/", part(platform), part(session), part(turn))


def _advance(patience_ms: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, started, last, n = state.get if state.exists else ("untouched", 0, 0, 0)
        stamp = lambda ms: pd.Timestamp(ms, unit="ms") if ms else pd.NaT
        told = []
        if state.hasTimedOut:
            if status == "in_progress":
                status = "incomplete"
                told.append((key[0], status, stamp(started), pd.NaT, n))
            state.update((status, started, last, n))
        else:
            rows = pd.concat(list(batches))
            rows = rows.assign(ms=rows["at"].astype("datetime64[ms]").astype("int64")).sort_values(["ms", "seq"])
            for kind, ms in zip(rows["type"], rows["ms"], strict=True):
                n, last = n + 1, max(last, int(ms))
                if kind == "start" and status != "in_progress":
                    status, started = "in_progress", int(ms)
                    told.append((key[0], status, stamp(started), pd.NaT, n))
                elif kind == "stop" and status in ("in_progress", "incomplete"):
                    status = "completed" if status == "in_progress" else "recovered"
                    told.append((key[0], status, stamp(started), stamp(int(ms)), n))
            state.update((status, started, last, n))
            if status == "in_progress":
                state.setTimeoutTimestamp(max(started + patience_ms, state.getCurrentWatermarkMs() + 1))
        if told:
            yield pd.DataFrame(told, columns=["key", "status", "started_at", "ended_at", "n_events"])

    return step


def run_transitions(events: DataFrame, patience: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """A stream of (key, status, started_at, ended_at, n_events), a row for each change of a run's state.

    ``events``: a stream of (key string, seq long, type string: start, stop or other, at timestamp). A run
    without a stop for ``patience`` after its start, by the watermark, becomes incomplete.
    """
    patience_ms = int(pd.Timedelta(patience).total_seconds() * 1000)
    marked = events.select("key", "seq", "type", "at").withWatermark("at", lateness)
    return marked.groupBy("key").applyInPandasWithState(_advance(patience_ms), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def pending(events: DataFrame) -> DataFrame:
    """(key, started_at) of runs open at the end of a table of events (key, seq, type, at): the batch form.

    A run is open if its last start has no stop after it; started_at is its first start since the stop before.
    """
    e = events.where(F.col("type").isin("start", "stop"))
    last_stop = F.coalesce(F.max(F.when(F.col("type") == "stop", F.col("seq"))), F.lit(-1))
    stops = e.groupBy("key").agg(last_stop.alias("stopped"))
    return e.where("type = 'start'").join(stops, "key").where("seq > stopped").groupBy("key").agg(F.min_by("at", "seq").alias("started_at"))
