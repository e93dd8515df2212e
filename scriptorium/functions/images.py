"""Pixels of images, scaling and figures of them, and what can be said of an image without a model."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.arrow import over_batches

#: Longest sides that images are scaled down to, for models and for services.
MODEL_SIDE, SERVICE_SIDE = 1024, 768
PIXELS = "path string, width int, height int, rgb binary"

# Words of a context and what an image of that context shows; the first kind that occurs counts.
SHOWN = (
    (("person", "people", "man", "woman"), " showing people"), (("building", "house", "city"), " of a building or structure"),
    (("nature", "tree", "forest", "mountain"), " of a natural scene"), (("chart", "graph", "diagram"), " containing a chart or diagram"),
)


def _rgb(data: bytes, channels: int) -> bytes:
    """Pixels as decoded (gray, or blue, green, red and maybe opacity) as red, green, blue; opacity goes."""
    raw = np.frombuffer(data, np.uint8).reshape(-1, channels)
    return np.ascontiguousarray(np.repeat(raw, 3, axis=1) if channels == 1 else raw[:, 2::-1]).tobytes()


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, rgb) of image files, three bytes a pixel, row by row; Spark decodes them in the JVM. A file that is no image has nulls."""
    found = spark.read.format("image").load(path).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")

    def make():
        def step(batch: pa.RecordBatch):
            there = [n > 0 for n in batch.column(3).to_pylist()]
            side = lambda c: [v if ok else None for v, ok in zip(batch.column(c).to_pylist(), there)]
            return [batch.column(0), side(1), side(2), [_rgb(d.as_py(), n) if ok else None for d, n, ok in zip(batch.column(4), batch.column(3).to_pylist(), there)]]

        return step

    return over_batches(found, make, PIXELS)


def _shares(old: int, new: int) -> np.ndarray:
    """new x old: how much of each new pixel lies over each old one."""
    edges = np.arange(new + 1) * old / new
    left, right = np.maximum(edges[:-1, None], np.arange(old)), np.minimum(edges[1:, None], np.arange(1, old + 1))
    return np.maximum(right - left, 0) * new / old


def shrink(rgb: bytes, width: int, height: int, most: int) -> tuple[bytes, int, int]:
    """An image of no side longer than `most`: each new pixel is the mean of the area that it covers. Small images stay."""
    if max(width, height) <= most:
        return rgb, width, height
    ratio = most / max(width, height)
    w, h = max(1, int(width * ratio)), max(1, int(height * ratio))
    area = np.frombuffer(rgb, np.uint8).reshape(height, width, 3)
    rows = np.tensordot(_shares(height, h), area, axes=1)
    out = np.einsum("hwc,vw->hvc", rows, _shares(width, w))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8).tobytes(), w, h


def downscaled(images: DataFrame, most: int = MODEL_SIDE) -> DataFrame:
    """images (path, width, height, rgb) with no side longer than `most`; rows without pixels stay as they are."""

    def make():
        def step(batch: pa.RecordBatch):
            rows = []
            for path, w, h, rgb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                small, w, h = shrink(rgb.as_py(), w, h, most) if rgb.is_valid else (None, w, h)
                rows.append((path, w, h, small))
            return list(zip(*rows))

        return step

    return over_batches(images.select("path", "width", "height", "rgb"), make, PIXELS)


def colors(images: DataFrame) -> DataFrame:
    """(path, color, n): how often each color (red * 65536 + green * 256 + blue) occurs in an image; images without pixels have none."""

    def make():
        def step(batch: pa.RecordBatch):
            paths, found, counts = [], [], []
            for path, rgb in zip(batch.column(0).to_pylist(), batch.column(1)):
                if rgb.is_valid and len(rgb.as_py()):
                    raw = np.frombuffer(rgb.as_py(), np.uint8).reshape(-1, 3).astype(np.int64)
                    value, n = np.unique(raw[:, 0] << 16 | raw[:, 1] << 8 | raw[:, 2], return_counts=True)
                    paths += [path] * len(value)
                    found.append(value)
                    counts.append(n)
            return [paths, pa.array(np.concatenate(found)), pa.array(np.concatenate(counts))] if paths else None

        return step

    return over_batches(images.select("path", "rgb"), make, "path string, color long, n long")


def main_color(images: DataFrame) -> DataFrame:
    """(path, color, n): the most frequent color of each image, the least of equals."""
    return colors(images).groupBy("path").agg(F.max(F.struct("n", (-F.col("color")).alias("c"))).alias("m")).select("path", (-F.col("m.c")).alias("color"), F.col("m.n").alias("n"))


def tone(color: Column) -> Column:
    """What the channel that is above both others makes of a color; "colored" where there is none to look at."""
    r, g, b = F.shiftright(color, 16), F.shiftright(color, 8).bitwiseAND(F.lit(255)), color.bitwiseAND(F.lit(255))
    return F.when(color.isNull(), "colored").when((r > g) & (r > b), "reddish").when((g > r) & (g > b), "greenish").when((b > r) & (b > g), "bluish").otherwise("neutral-toned")


def plain_description(width: Column, height: Column, color: Column, context: Column, most: int = 100) -> Column:
    """struct<description, confidence> from an image's sides, its most frequent color and the text around it; cut to `most` characters, three of them dots.

    The confidence lies between 0.75 and 0.99, by a hash of the sides, the same on every run. A null context says nothing.
    """
    shape = F.when(width > height, "landscape").when(height > width, "portrait").otherwise("square")
    low = F.lower(F.coalesce(context, F.lit("")))
    shown = F.lit("")
    for words, said in reversed(SHOWN):
        held = F.lit(False)
        for word in words:
            held = held | low.contains(word)
        shown = F.when(held, said).otherwise(shown)
    whole = F.concat(F.lit("A "), shape, F.lit(" "), tone(color), F.lit(" image"), shown)
    cut = F.when(F.length(whole) > most, F.concat(F.substring(whole, 1, most - 3), F.lit("..."))).otherwise(whole)
    sides = F.concat(width.cast("string"), F.lit("x"), height.cast("string"))
    share = F.conv(F.substring(F.md5(sides), 1, 6), 16, 10).cast("long") % 25
    return F.struct(cut.alias("description"), F.round(F.lit(0.75) + share / 100.0, 6).alias("confidence"))


def png(rgb: bytes, width: int, height: int) -> bytes:
    """A PNG file of pixels, three bytes each."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = b"".join(b"\0" + rgb[y * width * 3 : (y + 1) * width * 3] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def encoded(images: DataFrame) -> DataFrame:
    """(path, png) of images (path, width, height, rgb); null where there are no pixels."""

    def make():
        def step(batch: pa.RecordBatch):
            made = [png(rgb.as_py(), w, h) if rgb.is_valid else None for w, h, rgb in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3))]
            return [batch.column(0), made]

        return step

    return over_batches(images.select("path", "width", "height", "rgb"), make, "path string, png binary")


def pixel_histogram(images: DataFrame, key: str, pixels: str) -> DataFrame:
    """(key, color, n) of arrays of pixel values: how often each occurs."""
    return images.select(key, F.explode(pixels).alias("color")).groupBy(key, "color").agg(F.count("*").alias("n"))


def dominant_color(images: DataFrame, key: str, pixels: str) -> DataFrame:
    """(key, color, n): the most frequent value of each image, the least of equals."""
    counted = pixel_histogram(images, key, pixels)
    return counted.groupBy(key).agg(F.max(F.struct("n", (-F.col("color")).alias("c"))).alias("m")).select(key, (-F.col("m.c")).alias("color"), F.col("m.n").alias("n"))


def brightness(pixels: Column) -> Column:
    """Mean of an array of values; null for none."""
    return F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x.cast("double"), lambda a: a / F.nullif(F.size(pixels), F.lit(0)))
