"""Sequences of clips as one recording: overlaps by position, samples by frame, so that no sequence meets in one array."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..plans.session import reachable

#: Samples of a frame.
FRAME = 8192


def placed(clips: DataFrame, key: str, order: str, samples: str, overlap: int) -> DataFrame:
    """(key, order, offset, overlap): where each clip with samples begins in its recording, and how many samples of it fade in over what was there.

    A clip overlaps the recording so far by `overlap` samples, or by all of the shorter of both. While no clip had `overlap` samples,
    the recording is as long as the longest clip; from then on each one adds what it has beyond the overlap. So offsets are running maxima
    and sums of lengths, and samples don't move for them.
    """
    sizes = clips.select(key, order, F.size(samples).cast("long").alias("_n")).filter("_n > 0")
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = sizes.withColumn("_most", F.max("_n").over(so_far)).withColumn("_before", F.max("_n").over(before))
    rows = rows.withColumn("_settled", F.coalesce(F.col("_before") >= overlap, F.lit(False))).withColumn("_more", F.when(F.col("_settled"), F.greatest(F.col("_n") - overlap, F.lit(0))).otherwise(0))
    first = F.min(F.when(F.col("_most") >= overlap, F.col("_most"))).over(before)
    length = F.when(F.col("_settled"), first + F.sum("_more").over(before)).otherwise(F.coalesce("_before", F.lit(0)))
    rows = rows.withColumn("_length", length).withColumn("overlap", F.least(F.lit(overlap), "_n", "_length"))
    return rows.select(key, order, (F.col("_length") - F.col("overlap")).alias("offset"), "overlap")


def crossfaded(clips: DataFrame, key: str, order: str, samples: str, overlap: int, frame: int = FRAME) -> DataFrame:
    """(key, frame, samples): the clips of each key in order, each fading into the next over `overlap` samples, in frames of `frame` samples from 0 on.

    Sample by sample it is what joining the clips one after the other gives: over an overlap of k samples the i-th of the recording
    so far counts 1 - i / (k + 1) and that of the clip i / (k + 1). A frame sees its slices in order and holds nothing else. Clips that are null or
    empty (missing files) are skipped; a key without samples has no frames. (key, order) must tell clips apart.
    """
    reachable(clips.sparkSession)
    at = placed(clips, key, order, samples, overlap)
    rows = clips.select(key, order, F.col(samples).cast("array<double>").alias("_s")).filter(F.size("_s") > 0).join(at, [key, order])
    rows = rows.select(key, order, "offset", "overlap", "_s", F.explode(F.sequence(F.floor(F.col("offset") / frame), F.floor((F.col("offset") + F.size("_s") - 1) / frame))).alias("frame"))
    start = F.greatest(F.col("frame") * frame - F.col("offset"), F.lit(0))
    stop = F.least((F.col("frame") + 1) * frame - F.col("offset"), F.size("_s").cast("long"))
    slices = rows.select(key, "frame", order, (F.col("offset") + start - F.col("frame") * frame).alias("_at"), start.alias("_first"), "overlap", F.slice("_s", (start + 1).cast("int"), (stop - start).cast("int")).alias("_s"))
    schema = StructType([clips.schema[key], StructField("frame", LongType()), StructField("samples", ArrayType(DoubleType()))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        now, held, used = None, np.zeros(frame), 0
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([d[c] for d in done], f.type) for c, f in enumerate(arrow)], schema=arrow)
            done.clear()
            return made

        for batch in batches:
            keys, frames, places, firsts, overlaps = (batch.column(c).to_pylist() for c in (0, 1, 3, 4, 5))
            for k, f, p, first, over, s in zip(keys, frames, places, firsts, overlaps, batch.column(6)):
                if now != (k, f):
                    if now is not None:
                        done.append((*now, held[:used].copy()))
                    now, used = (k, f), 0
                new = s.values.to_numpy(zero_copy_only=False)
                fading = max(0, min(over - first, len(new)))  # so many of the slice lie in the overlap
                share = np.arange(first + 1, first + 1 + fading) / (over + 1)
                held[p : p + fading] = held[p : p + fading] * (1 - share) + new[:fading] * share
                held[p + fading : p + len(new)] = new[fading:]
                used = max(used, p + len(new))
            if done:
                yield out()
        if now is not None:
            done.append((*now, held[:used].copy()))
            yield out()

    return slices.repartition(key, "frame").sortWithinPartitions(key, "frame", order).mapInArrow(run, schema)


def samples_of(frames: DataFrame, key: str, frame: int = FRAME) -> DataFrame:
    """(key, pos, sample) of frames, pos from 0 on."""
    return frames.select(key, "frame", F.posexplode("samples").alias("_k", "sample")).select(key, (F.col("frame") * frame + F.col("_k")).alias("pos"), "sample")


def recording_info(frames: DataFrame, key: str) -> DataFrame:
    """(key, n, head, tail): samples of each recording, its first and its last; only the ends of frames move."""
    ends = frames.select(key, "frame", F.size("samples").cast("long").alias("n"), F.element_at("samples", 1).alias("a"), F.element_at("samples", -1).alias("z"))
    return ends.groupBy(key).agg(F.sum("n").alias("n"), F.min_by("a", "frame").alias("head"), F.max_by("z", "frame").alias("tail"))


def framed_files(frames: DataFrame, key: str) -> DataFrame:
    """(name, content) of raw 16-bit little-endian samples, a file for each frame (key/frame.pcm, numbers of ten digits so that names sort as frames do)."""
    name = F.concat(F.col(key).cast("string"), F.lit("/"), F.lpad(F.col("frame").cast("string"), 10, "0"), F.lit(".pcm"))
    reachable(frames.sparkSession)

    def run(batches):
        for batch in batches:
            data = [(np.clip(s.values.to_numpy(zero_copy_only=False), -1, 1) * 32767).astype("<i2").tobytes() for s in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(data, pa.binary())], names=["name", "content"])

    return frames.select(name.alias("name"), "samples").mapInArrow(run, "name string, content binary")
