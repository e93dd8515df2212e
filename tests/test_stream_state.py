"""State of several kinds over a stream of files, against the batch fold and a walk event by event."""

import datetime as dt
import random

import pytest

from scriptorium.streaming import state

KINDS = ("start", "progress", "progress", "progress", "complete", "error", "warning")


def made(n, seed):
    rng, out, at = random.Random(seed), [], dt.datetime(2024, 1, 1)
    for k in range(n):
        at += dt.timedelta(seconds=rng.choice((0, 1, 2, 4, 9)))
        kind = rng.choice(KINDS)
        out.append((rng.choice("ab"), kind, at, k, rng.choice((None, 50, 80)) if kind in ("start", "progress") else None, rng.choice((None, k)) if kind == "progress" else None, rng.choice((None, f"item {k}")), rng.choice((None, {"speed": str(k)}, {f"n{k % 3}": "x", "speed": "1"}))))
    return out


def walked(events, gap):
    """Event by event, in order."""
    stats, reports = {}, []
    for p, kind, at, k, total, done, item, custom in sorted(events, key=lambda e: (e[2], e[3])):
        s = stats.setdefault(p, {"total": 0, "done": 0, "errors": 0, "warnings": 0, "item": "", "custom": {}, "recent": [], "told": None})
        if kind in ("start", "progress"):
            s["total"] = total if total is not None else s["total"]
            s["item"] = item if item is not None else s["item"]
        if kind == "progress":
            s["done"] = done if done is not None else s["done"]
            if s["total"] > 0 and (s["told"] is None or (at - s["told"]).total_seconds() > gap):
                s["told"] = at
                reports.append((p, k))
        if kind == "complete":
            s["item"] = "" if item is not None else s["item"]
            s["done"] += 1
        s["errors"] += kind == "error"
        s["warnings"] += kind == "warning"
        s["custom"].update(custom or {})
        s["recent"] = (s["recent"] + [k])[-10:]
    return {p: (s["total"], s["done"], s["errors"], s["warnings"], s["item"], s["custom"], s["recent"]) for p, s in stats.items()}, sorted(reports)


def test_batch_fold_and_reports(spark):
    events = made(300, 1)
    df = spark.createDataFrame(events, state.EVENT).repartition(5)
    stats, reports = walked(events, 5.0)
    got = {r.pipeline: (r.total_items, r.completed_items, r.errors, r.warnings, r.current_item, r.custom_stats, r.recent) for r in state.fold_all(df).collect()}
    assert got == stats
    for gap in (5.0, 0.5, 30.0):
        assert sorted(map(tuple, state.emitted(df, gap).collect())) == walked(events, gap)[1]
    assert state.fold_all(df.limit(0)).count() == 0 == state.emitted(df.limit(0)).count()
    assert reports


@pytest.mark.parametrize("batches", [1, 4])
def test_stream_equals_batch(spark, tmp_path, batches):
    events = made(120, 2)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        size = -(-len(events) // batches)
        for k in range(batches):  # files in order of their events
            spark.createDataFrame(events[k * size : (k + 1) * size], state.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(spark.createDataFrame([], state.EVENT).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        rows = []
        query = state.progress_stream(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda df, n: rows.extend(df.collect())).start()
        query.awaitTermination()
        stats, reports = walked(events, 5.0)
        assert sorted((r.pipeline, r.event_id) for r in rows if r.kind == "report") == reports
        last = {r.pipeline: (r.total_items, r.completed_items, r.errors, r.warnings, r.current_item, r.custom_stats, r.recent) for r in rows if r.kind == "status"}
        assert last == stats and {r.late for r in rows} == {0} and sum(r.kind == "status" for r in rows) >= 2 * min(batches, 2) - 1
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
