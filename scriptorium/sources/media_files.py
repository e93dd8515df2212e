"""Image and audio files: what their headers say, and the samples of WAV files. Spark reads the bytes."""

from __future__ import annotations

import io
import struct
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import reachable


def image_header(data: bytes) -> tuple[str | None, int | None, int | None]:
    """Format, width and height of a PNG, GIF, BMP or JPEG file; nulls for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return ("PNG", *struct.unpack(">II", data[16:24]))
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return ("GIF", *struct.unpack("<HH", data[6:10]))
    if data[:2] == b"BM" and len(data) >= 26:
        width, height = struct.unpack("<ii", data[18:26])
        return "BMP", width, abs(height)
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return "JPEG", width, height
            at += 2 + size
    return None, None, None


def _scan(spark: SparkSession, path: str, step, schema: str, names: list[str], types: list[pa.DataType]) -> DataFrame:
    reachable(spark)

    def run(batches):
        for batch in batches:
            rows = [(p, *step(data or b"")) for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, width, height, mode) of image files, wide, tall or square by their sides; files that are no image have nulls."""
    found = _scan(spark, path, image_header, "path string, format string, width long, height long", ["path", "format", "width", "height"], [pa.string(), pa.string(), pa.int64(), pa.int64()])
    return found.withColumn("mode", F.when(F.col("width") > F.col("height"), "wide").when(F.col("width") < F.col("height"), "tall").when(F.col("width").isNotNull(), "square"))


def _samples(data: bytes) -> tuple[int | None, list[float], str | None]:
    try:
        with wave.open(io.BytesIO(data)) as f:
            raw, width = np.frombuffer(f.readframes(f.getnframes()), np.uint8), f.getsampwidth()
            if width == 1:  # the only one without a sign
                whole = (raw.astype(np.int64) - 128) / 127
            else:  # little-endian, the sign in the last byte
                parts = raw.reshape(-1, width).astype(np.int64)
                whole = sum(parts[:, k] << (8 * k) for k in range(width - 1)) + (np.where(parts[:, -1] > 127, parts[:, -1] - 256, parts[:, -1]) << (8 * (width - 1)))
                whole = whole / (2 ** (8 * width - 1) - 1)
            found = whole.reshape(-1, f.getnchannels()).mean(axis=1)
            return f.getframerate(), found.tolist(), None
    except (wave.Error, EOFError) as e:  # a broken file is a row, not a failed job
        return None, [], f"{type(e).__name__}: {e}"


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """(path, rate, samples, error) of WAV files of 8 to 32 bits, channels averaged."""
    return _scan(spark, path, _samples, "path string, rate long, samples array<double>, error string", ["path", "rate", "samples", "error"], [pa.string(), pa.int64(), pa.list_(pa.float64()), pa.string()])
