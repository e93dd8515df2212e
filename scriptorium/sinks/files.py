"""Sinks: texts, JSON and other bytes as a file for each row, image copies, a cache in which the latest entry wins, WAV audio.

Rows are written by the tasks that hold them, to any store that pyarrow opens. A task that is run again writes the same
files again, so results don't change; the manifest that comes back names every file with its bytes.
"""

from __future__ import annotations

import io
import posixpath
import re
import wave

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import reachable


def store(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri)


def write_files(df: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """Writes column content (a string or binary) of each row to folder/name; (file, bytes) when the result is run. A null content writes nothing."""
    reachable(df.sparkSession)

    def run(batches):
        disk, root = store(folder)
        for batch in batches:
            rows = []
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if data is None or file is None:
                    continue
                path = posixpath.join(root, file)
                disk.create_dir(posixpath.dirname(path))
                with disk.open_output_stream(path) as out:
                    out.write(data)
                rows.append((file, len(data)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64()))], names=["file", "bytes"])

    return df.select(name, F.col(content).cast("binary")).mapInArrow(run, "file string, bytes long")


def stem(path: Column) -> Column:
    """A path's last part without its ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def image_targets(images: DataFrame, folder: str, base: str, path: str = "file_path") -> DataFrame:
    """Images with file_path and local_path in folder/base_images; those without a source path keep theirs."""
    target = F.concat(F.lit(f"{folder}/"), F.col(base), F.lit("_images/"), F.element_at(F.split(path, "/"), -1))
    there = F.coalesce(F.col(path), F.lit("")) != ""
    return images.withColumn("source_path", F.col(path)).withColumn("local_path", F.when(there, target)).withColumn(path, F.when(there, target).otherwise(F.col(path)))


def copy_images(images: DataFrame, folder: str, base: str, existing: DataFrame, path: str = "file_path") -> DataFrame:
    """Copies the images that exist (binaryFile rows path, content) and gives what was written."""
    targets = image_targets(images, folder, base, path)
    named = targets.withColumn("_name", F.concat(F.col(base), F.lit("_images/"), F.element_at(F.split("source_path", "/"), -1)))
    return write_files(named.join(existing.select(F.col("path").alias("source_path"), "content"), "source_path"), folder, "_name", "content")


def latest(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """A cache after a write: of equal keys the entry with the highest order stays, of equal orders the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc("_new")))
    return both.withColumn("_nth", nth).filter("_nth = 1").drop("_nth", "_new")


def wav(samples: list[float], rate: int) -> bytes:
    """16-bit mono WAV of samples between -1 and 1."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(np.asarray(samples, float), -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def encoded_audio(df: DataFrame, name: str, samples: str, rate: int, kind: str = "wav") -> DataFrame:
    """(name, audio) as bytes; a kind other than wav needs an encoder that isn't here and raises ValueError."""
    if kind != "wav":
        raise ValueError(f"unsupported audio format: {kind}")
    reachable(df.sparkSession)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array([wav(s or [], rate) for s in batch.column(1).to_pylist()], pa.binary())], names=["name", "audio"])

    return df.select(F.col(name).cast("string").alias("name"), samples).mapInArrow(run, "name string, audio binary")
