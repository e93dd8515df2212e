"""Progress events as they come: type check, fan-out to subscribers, refresh, shutdown, and audio in order of arrival."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

# Pipelines and kinds of events.
PIPELINES = ("tts", "image", "epub", "overall")
KINDS = ("start", "progress", "complete", "error", "warning", "info")
FIELDS = {"event_id": "bigint", "ts": "timestamp", "pipeline": "string", "event_type": "string"}


def checked(events: DataFrame) -> DataFrame:
    """The events, if their columns are those of events; otherwise TypeError. Batch or stream."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    wrong = [f"{name} must be {kind}, is {kinds.get(name)}" for name, kind in FIELDS.items() if kinds.get(name) != kind and not (kind == "timestamp" and kinds.get(name) == "timestamp_ntz")]
    if wrong:
        raise TypeError("; ".join(wrong))
    return events


def is_event(ts: str = "ts", pipeline: str = "pipeline", kind: str = "event_type") -> Column:
    """Whether a row is an event: a time, a known pipeline and a known kind."""
    return F.coalesce(F.col(ts).isNotNull() & F.col(pipeline).isin(*PIPELINES) & F.col(kind).isin(*KINDS), F.lit(False))


def ingested(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events, and the rows that are none."""
    ok = is_event()
    return checked(events).filter(ok), events.filter(~ok)


def is_shutdown(pipeline: str = "pipeline", kind: str = "event_type", action: str = "action") -> Column:
    return F.coalesce((F.col(pipeline) == "overall") & (F.col(kind) == "info") & (F.col(action) == "shutdown"), F.lit(False))


def before_shutdown(events: DataFrame, ts: str = "ts", event_id: str = "event_id") -> DataFrame:
    """The events before the first shutdown event; what was queued after it is lost. All, if there is none."""
    at = F.struct(ts, event_id)
    stop = events.filter(is_shutdown()).agg(F.min(at)).scalar()
    return events.filter(stop.isNull() | (at < stop))


def fan_out(stream: DataFrame, subscribers: Iterable[Callable[[DataFrame, int], None]], failed: Callable[[Exception], None] = print) -> DataStreamWriter:
    """A writer that hands each batch to every subscriber; one that raises is reported and keeps none of the others from it."""
    callbacks = list(subscribers)

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        for callback in callbacks:
            try:
                callback(held, number)
            except Exception as e:  # subscribers are isolated from each other
                failed(e)
        held.unpersist()

    return stream.writeStream.foreachBatch(each)


def refreshed(writer: DataStreamWriter, seconds: float = 0.1) -> DataStreamWriter:
    """A writer that looks for new events every so often."""
    return writer.trigger(processingTime=f"{max(1, round(seconds * 1000))} milliseconds")


def stop_at_shutdown(query: Callable[[], StreamingQuery | None]) -> Callable[[DataFrame, int], None]:
    """A subscriber that stops the stream's query once a batch holds a shutdown event."""

    def look(batch: DataFrame, number: int) -> None:
        if batch.filter(is_shutdown()).take(1) and (running := query()) is not None:
            running.stop()

    return look


def joined_chunks(chunks: DataFrame, key: str, order: str, samples: str) -> DataFrame:
    """(key, samples): each stream's chunks of audio in order of arrival. Batch, or a stream in output mode complete or update."""
    rows = chunks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(samples).alias("s")))).alias("x"))
    return rows.select(key, F.flatten(F.col("x.s")).alias("samples"))
