"""The progress fold over a stream: state for each pipeline, and event-time windows beyond the reference."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATS = "pipeline string, total_items long, completed_items long, errors long, warnings long, late long"
STATE = "total long, completed long, errors long, warnings long, late long, ts timestamp, event_id long"


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState):
    total, done, errors, warnings, late, ts, last = state.get if state.exists else (0, 0, 0, 0, 0, pd.Timestamp(0), -1)
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    for r in rows.itertuples():
        if (r.ts, r.event_id) <= (ts, last):
            late += 1  # older than what the state holds: its place in the order is past, so it is counted apart
            continue
        if r.event_type == "start":
            total = int(r.items)
        elif r.event_type == "progress":
            done = int(r.items)
        elif r.event_type == "complete":
            done += 1
        errors += r.event_type == "error"
        warnings += r.event_type == "warning"
        ts, last = r.ts, int(r.event_id)
    state.update((total, done, int(errors), int(warnings), late, ts, last))
    yield pd.DataFrame([(key[0], total, done, errors, warnings, late)], columns=["pipeline", "total_items", "completed_items", "errors", "warnings", "late"])


def fold_stream(events: DataFrame) -> DataFrame:
    """Streaming counterpart of operators.progress.fold, with a count of events that came too late for it; write it with output mode update."""
    return events.groupBy("pipeline").applyInPandasWithState(_step, STATS, STATE, "update", GroupStateTimeout.NoTimeout)


def daily_counts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Beyond the reference: events of each type in one-day windows, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
