"""Decoded pixels, scaling and what is said of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import images


def test_pixels_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    made = {f"{w}x{h}": (w, h, rng.integers(0, 256, (h, w, 3), dtype=np.uint8)) for w, h in ((1, 1), (7, 3), (3, 40), (64, 64))}
    for name, (w, h, a) in made.items():
        (tmp_path / f"{name}.png").write_bytes(images.png(a.tobytes(), w, h))
    (tmp_path / "broken.png").write_bytes(b"no image")
    read = images.read_pixels(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r for r in read.collect()}
    for name, (w, h, a) in made.items():
        r = got[f"{name}.png"]
        assert (r.width, r.height, bytes(r.rgb)) == (w, h, a.tobytes())
    assert got["broken.png"].rgb is None and got["broken.png"].width is None
    again = {r.path.rsplit("/", 1)[1]: r.png for r in images.encoded(read).collect()}
    assert all(bytes(again[f"{n}.png"]) == (tmp_path / f"{n}.png").read_bytes() for n in made) and again["broken.png"] is None
    counted = {}
    for r in images.colors(read).collect():
        counted.setdefault(r.path.rsplit("/", 1)[1], {})[r.color] = r.n
    for name, (_, _, a) in made.items():
        value, n = np.unique((a.reshape(-1, 3).astype(int) * (65536, 256, 1)).sum(axis=1), return_counts=True)
        assert counted[f"{name}.png"] == dict(zip(value.tolist(), n.tolist()))
    assert "broken.png" not in counted and images.colors(read.limit(0)).count() == 0


def test_gray_images(spark, tmp_path):
    """One channel becomes three."""
    import struct
    import zlib

    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    (tmp_path / "g.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\x10\xf0")) + chunk(b"IEND", b""))
    assert bytes(images.read_pixels(spark, str(tmp_path)).first().rgb) == b"\x10\x10\x10\xf0\xf0\xf0"


@pytest.mark.parametrize("w,h,most", [(10, 4, 5), (9, 9, 4), (5, 3, 5), (300, 2, 7)])
def test_shrink_is_the_mean_of_areas(w, h, most):
    a = np.random.default_rng(w).integers(0, 256, (h, w, 3), dtype=np.uint8)
    data, nw, nh = images.shrink(a.tobytes(), w, h, most)
    got = np.frombuffer(data, np.uint8).reshape(nh, nw, 3)
    assert max(nw, nh) <= most or max(w, h) <= most
    for y in range(nh):
        for x in range(nw):
            total, weight = np.zeros(3), 0.0
            for oy in range(h):
                for ox in range(w):
                    share = max(0.0, min((y + 1) * h / nh, oy + 1) - max(y * h / nh, oy)) * max(0.0, min((x + 1) * w / nw, ox + 1) - max(x * w / nw, ox))
                    total, weight = total + a[oy, ox] * share, weight + share
            assert np.abs(got[y, x] - total / weight).max() <= 0.5 + 1e-9


def test_downscaled(spark):
    flat = bytes([10, 200, 30]) * (40 * 20)
    df = spark.createDataFrame([("a", 40, 20, bytearray(flat)), ("b", 2, 2, bytearray(flat[:12])), ("c", None, None, None)], images.PIXELS)
    got = {r.path: r for r in images.downscaled(df, 8).collect()}
    assert (got["a"].width, got["a"].height, bytes(got["a"].rgb)) == (8, 4, bytes([10, 200, 30]) * 32)
    assert bytes(got["b"].rgb) == flat[:12] and got["c"].rgb is None
    said = images.main_color(images.downscaled(df, 8)).select("path", images.tone(F.col("color")).alias("t")).collect()
    assert {r.path: r.t for r in said} == {"a": "greenish", "b": "greenish"}


def test_plain_description(spark):
    rows = [(4, 3, 0xFF0000, "A Woman in a house"), (3, 4, 0x0000FF, "the house"), (3, 3, 0x101010, None), (5, 1, None, "a GRAPH of trees"), (5, 1, None, "the graph")]
    df = spark.createDataFrame(rows, "w int, h int, c int, t string")
    got = [r.d for r in df.select(images.plain_description(F.col("w"), F.col("h"), F.col("c"), F.col("t")).alias("d")).collect()]
    assert [d.description for d in got] == ["A landscape reddish image showing people", "A portrait bluish image of a building or structure", "A square neutral-toned image", "A landscape colored image of a natural scene", "A landscape colored image containing a chart or diagram"]
    assert all(0.75 <= d.confidence < 1 for d in got) and got[3].confidence == got[4].confidence
    short = df.select(images.plain_description(F.col("w"), F.col("h"), F.col("c"), F.col("t"), 20).alias("d")).first().d.description
    assert short == "A landscape reddi..." and len(short) == 20
