"""Progress of every pipeline as a stream: statistics, custom values, the last events and throttled reports, kept as state of several kinds.

The same rules folded in batch are fold_all and emitted below: a stream over files gives what they give, however its micro-batches fall.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..plans.session import reachable

#: Events that are remembered of a pipeline, and the seconds that must lie between two reports of its progress.
RECENT, GAP = 10, 5.0
EVENT = "pipeline string, event_type string, ts timestamp, event_id long, total_items long, completed_items long, current_item string, custom_stats map<string,string>"
OUT = "pipeline string, kind string, event_id long, total_items long, completed_items long, errors long, warnings long, late long, current_item string, custom_stats map<string,string>, recent array<long>, percent double"


class _Progress(StatefulProcessor):
    """Value state for counts, map state for custom values, list state for the ring of events."""

    def __init__(self, recent: int, gap: float):
        self.most, self.gap = recent, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "total long, done long, errors long, warnings long, late long, item string, at long, last long, told long")
        self.custom = handle.getMapState("custom", "name string", "value string")
        self.ring = handle.getListState("ring", "event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, done, errors, warnings, late, item, at, last, told = self.counts.get() if self.counts.exists() else (0, 0, 0, 0, 0, "", -(1 << 62), -1, -(1 << 62))
        ring, out = [r[0] for r in self.ring.get()], []
        for e in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples():
            now, event_id = e.ts.value // 1000, int(e.event_id)
            if (now, event_id) <= (at, last):
                late += 1  # its place in the order is past, so it is counted apart
                continue
            at, last = now, event_id
            given = lambda v: v is not None and v == v
            if e.event_type in ("start", "progress"):
                total = int(e.total_items) if given(e.total_items) else total
                item = e.current_item if given(e.current_item) else item
            if e.event_type == "progress":
                done = int(e.completed_items) if given(e.completed_items) else done
                if total > 0 and now - told > self.gap * 1e6:
                    told = now
                    out.append((key[0], "report", event_id, total, done, errors, warnings, late, item, None, None, 100.0 * done / total))
            elif e.event_type == "complete":
                item = "" if given(e.current_item) else item
                done += 1
            errors += e.event_type == "error"
            warnings += e.event_type == "warning"
            for name, value in dict(e.custom_stats or ()).items():
                self.custom.updateValue((name,), (value,))
            ring = (ring + [event_id])[-self.most :]
        self.counts.update((total, done, errors, warnings, late, item, at, last, told))
        self.ring.put([(r,) for r in ring])
        custom = {k[0]: v[0] for k, v in self.custom.iterator()}
        out.append((key[0], "status", last, total, done, errors, warnings, late, item, custom, ring, 100.0 * min(done / total, 1.0) if total > 0 else 0.0))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.replace("map<string,string>", "map").split(", ")])

    def close(self) -> None:
        pass


def progress_stream(events: DataFrame, recent: int = RECENT, gap: float = GAP) -> DataFrame:
    """Rows of kind report (a PROGRESS event more than `gap` seconds of its pipeline's own time after the last one told, where a total is known) and, for each
    micro-batch with events of a pipeline, one of kind status.

    events are a stream with the columns of EVENT; output mode update. Events are put in order of (ts, event_id) within a
    micro-batch, and one that is older than what is folded counts as late and changes nothing else. The session's state store must be RocksDB's.
    """
    reachable(events.sparkSession)
    return events.groupBy("pipeline").transformWithStateInPandas(_Progress(recent, gap), OUT, "Update", "None")


def fold_all(events: DataFrame, recent: int = RECENT) -> DataFrame:
    """(pipeline, total_items, completed_items, errors, warnings, current_item, custom_stats, recent): what the stream knows after the same events, in batch.

    Partial aggregates only: a value that events set is that of the last one that sets it, and completed items are the last that were told and the COMPLETEs after that.
    """
    at = F.struct("ts", "event_id")
    is_ = lambda *t: F.col("event_type").isin(*t)
    told = is_("progress") & F.col("completed_items").isNotNull()
    last = events.groupBy("pipeline").agg(F.max(F.when(told, F.struct("ts", "event_id", "completed_items"))).alias("_p"))
    total = is_("start", "progress") & F.col("total_items").isNotNull()
    item = F.col("current_item").isNotNull() & is_("start", "progress", "complete")
    marked = events.join(last, "pipeline")
    after = F.col("_p").isNull() | (at > F.struct(F.col("_p.ts"), F.col("_p.event_id")))
    counts = marked.groupBy("pipeline").agg(
        F.coalesce(F.max_by(F.when(total, F.col("total_items")), F.when(total, at)), F.lit(0)).alias("total_items"), (F.coalesce(F.max("_p.completed_items"), F.lit(0)) + F.count(F.when(is_("complete") & after, 1))).alias("completed_items"),
        F.count(F.when(is_("error"), 1)).alias("errors"), F.count(F.when(is_("warning"), 1)).alias("warnings"),
        F.coalesce(F.max_by(F.when(item, F.when(is_("complete"), "").otherwise(F.col("current_item"))), F.when(item, at)), F.lit("")).alias("current_item"),
    )
    values = events.select("pipeline", "ts", "event_id", F.explode("custom_stats").alias("name", "value")).groupBy("pipeline", "name").agg(F.max_by("value", at).alias("value"))
    custom = values.groupBy("pipeline").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("custom_stats"))  # a row for each name
    nth = F.row_number().over(Window.partitionBy("pipeline").orderBy(F.desc("ts"), F.desc("event_id")))
    ring = events.select("pipeline", "ts", "event_id").withColumn("_n", nth).filter(F.col("_n") <= recent).groupBy("pipeline").agg(F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("_n", "event_id"))), lambda x: x["event_id"])).alias("recent"))
    none = F.create_map().cast("map<string,string>")
    return counts.join(custom, "pipeline", "left").join(ring, "pipeline", "left").withColumn("custom_stats", F.coalesce("custom_stats", none))


def emitted(events: DataFrame, gap: float = GAP) -> DataFrame:
    """(pipeline, event_id): the PROGRESS events that are told, in batch; events need pipeline, event_type, ts, event_id and total_items.

    A PROGRESS more than `gap` seconds after the one before it is told whatever came earlier. So a pipeline's events fall into stretches that know nothing of
    each other, and a stretch is walked by the task that holds it: a busy pipeline is as many tasks' work as it has pauses.
    """
    reachable(events.sparkSession)
    order = Window.partitionBy("pipeline").orderBy("ts", "event_id")
    total = F.last(F.when(F.col("event_type").isin("start", "progress"), F.col("total_items")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    told = events.withColumn("_total", F.coalesce(total, F.lit(0))).filter((F.col("event_type") == "progress") & (F.col("_total") > 0)).withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    new = F.coalesce(F.col("_us") - F.lag("_us").over(order) > int(gap * 1e6), F.lit(True))
    rows = told.withColumn("_stretch", F.sum(new.cast("long")).over(order)).select("pipeline", "_stretch", "_us", "event_id")
    schema = StructType([events.schema["pipeline"], events.schema["event_id"]])
    arrow = to_arrow_schema(schema)

    def run(batches):
        now, last = None, 0
        for batch in batches:
            keys, stretches, times = (batch.column(k).to_pylist() for k in range(3))
            kept = []
            for k, (p, s, t) in enumerate(zip(keys, stretches, times)):
                if now != (p, s) or t - last > gap * 1e6:
                    kept.append(k)
                    now, last = (p, s), t
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(kept, pa.int64())).cast(f.type) for c, f in zip((0, 3), arrow)], schema=arrow)

    return rows.repartition("pipeline", "_stretch").sortWithinPartitions("pipeline", "_stretch", "_us", "event_id").mapInArrow(run, schema)
