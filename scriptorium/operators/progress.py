"""Progress events folded into statistics, in batch; streaming/progress.py folds the same events as they come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("ts", "event_id")


def fold(events: DataFrame, key: str = "pipeline") -> DataFrame:
    """Totals of each pipeline: START sets the total, PROGRESS sets completed, COMPLETE adds one, ERROR and WARNING count.

    Events are ordered by (ts, event_id). Partial aggregates only: completed is the items of the last PROGRESS plus
    the COMPLETEs after it.
    """
    at = F.struct(*ORDER)
    is_ = lambda t: F.col("event_type") == t
    # one row for each key: adaptive execution broadcasts it where it is small, and splits hot keys where it isn't
    last = events.groupBy(key).agg(F.max(F.when(is_("progress"), F.struct(*ORDER, "items"))).alias("p"))
    marked = events.join(last, key)
    after = F.col("p").isNull() | (at > F.struct(F.col("p.ts"), F.col("p.event_id")))
    return marked.groupBy(key).agg(
        F.coalesce(F.max_by(F.when(is_("start"), F.col("items")), F.when(is_("start"), at)), F.lit(0)).alias("total_items"),
        (F.coalesce(F.max("p.items"), F.lit(0)) + F.count(F.when(is_("complete") & after, 1))).alias("completed_items"),
        F.count(F.when(is_("error"), 1)).alias("errors"), F.count(F.when(is_("warning"), 1)).alias("warnings"), F.max("ts").alias("last_update"),
    )


def recent(events: DataFrame, k: int = 10, key: str = "pipeline") -> DataFrame:
    """The k newest events of each pipeline, newest first."""
    newest = Window.partitionBy(key).orderBy(*(F.desc(c) for c in ORDER))
    return events.withColumn("nth", F.row_number().over(newest).cast("long")).filter(F.col("nth") <= k)


def overall(stats: DataFrame) -> DataFrame:
    total, done = F.sum("total_items"), F.sum("completed_items")
    return stats.agg(total.alias("total_items"), done.alias("completed_items"), F.sum("errors").alias("errors"), F.round(F.least(F.lit(100.0), F.when(total > 0, 100.0 * done / total).otherwise(0.0)), 6).alias("percent"))


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100.0), 100.0 * done / total)).otherwise(0.0)


def eta(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds to go at the rate so far: null before anything is done or known, 0 when nothing is left."""
    return F.when((total == 0) | (done == 0), F.lit(None).cast("double")).when(total <= done, 0.0).when(elapsed > 0, (total - done) * elapsed / done)


def status(events: DataFrame, key: str = "pipeline") -> DataFrame:
    """fold() with percent, elapsed seconds between a pipeline's first and last event, eta_seconds, and active: items are left and one is in work.

    An item is in work from START or PROGRESS to the next COMPLETE.
    """
    span = F.unix_micros(F.col("ts").cast("timestamp"))
    working = F.max_by(F.col("event_type"), F.when(F.col("event_type").isin("start", "progress", "complete"), F.struct(*ORDER))).isin("start", "progress")
    times = events.groupBy(key).agg(((F.max(span) - F.min(span)) / 1e6).alias("elapsed"), F.coalesce(working, F.lit(False)).alias("working"))
    both = fold(events, key).join(times, key)
    left = F.col("completed_items") < F.col("total_items")
    return both.select(
        key, "total_items", "completed_items", "errors", "warnings", F.round(percent(F.col("completed_items"), F.col("total_items")), 6).alias("percent"), F.round("elapsed", 6).alias("elapsed"),
        F.round(eta(F.col("completed_items"), F.col("total_items"), F.col("elapsed")), 6).alias("eta_seconds"), ((F.col("total_items") > 0) & left & F.col("working")).alias("active"),
    )


def roll_up(states: DataFrame, key: str = "pipeline") -> DataFrame:
    """One row over status(): sums, percent, the latest of the positive ETAs, and the active pipelines in order."""
    total, done = F.sum("total_items"), F.sum("completed_items")
    return states.agg(
        total.alias("total_items"), done.alias("completed_items"), F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"), F.round(percent(done, total), 6).alias("percent"),
        F.max(F.when(F.col("eta_seconds") > 0, F.col("eta_seconds"))).alias("eta_seconds"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("active"), F.col(key)))), ",").alias("active"),
    )


def running(events: DataFrame, key: str = "pipeline") -> DataFrame:
    """COMPLETEs so far at each event, in two steps: within each day of a pipeline, and the days before it.

    A pipeline's days are as many tasks, and the sums of days a few numbers.
    """
    one = F.when(F.col("event_type") == "complete", 1).otherwise(0)
    day = events.withColumn("_day", F.to_date("ts"))
    sums = day.groupBy(key, "_day").agg(F.sum(one).alias("_n"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    upto = Window.partitionBy(key, "_day").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    both = day.withColumn("_own", F.sum(one).over(upto)).join(before, [key, "_day"])
    return both.withColumn("completed_so_far", F.col("_own") + F.col("_before")).drop("_own", "_before", "_day")


def throttled(times: Column, gap: float) -> Column:
    """Of an ascending array of seconds, those more than `gap` after the last one taken."""
    return F.aggregate(times, F.array().cast("array<double>"), lambda kept, t: F.when((F.size(kept) == 0) | (t - F.element_at(F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(0.0))), -1) > gap), F.concat(kept, F.array(t))).otherwise(kept))


def logged_percents(total: Column, step: int = 10) -> Column:
    """Percents that a counter to `total` logs: ten or more after the last, and the end."""
    seq = F.transform(F.sequence(F.lit(1).cast("long"), total), lambda i: F.floor(i * 100 / total))
    start = F.struct(F.lit(0).cast("long").alias("last"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(seq, start, lambda a, p: F.when((p >= a["last"] + step) | (p >= 100), F.struct(p.alias("last"), F.concat(a["out"], F.array(p)).alias("out"))).otherwise(a), lambda a: a["out"])


def clock_time(seconds: Column) -> Column:
    """HH:MM:SS of seconds since 1970, in the session's time zone."""
    return F.date_format(F.timestamp_seconds(seconds), "HH:mm:ss")


def event_name(pipeline: Column, kind: Column, ts: Column) -> Column:
    """pipeline_kind_milliseconds."""
    return F.concat_ws("_", pipeline, kind, F.unix_millis(ts.cast("timestamp")).cast("string"))


def shortened(text: Column, most: int) -> Column:
    """The text, or its beginning and three dots, most characters in all."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def bar(percent: Column, width: int = 20) -> Column:
    filled = F.floor(percent * width / 100).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def duration_text(s: Column) -> Column:
    """45s, 01:05 or 01:01:05."""
    whole = F.floor(s).cast("long")
    return (
        F.when(s < 60, F.concat(F.rint(s).cast("long").cast("string"), F.lit("s")))
        .when(s < 3600, F.format_string("%02d:%02d", F.floor(whole / 60), whole % 60))
        .otherwise(F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor((whole % 3600) / 60), whole % 60))
    )
