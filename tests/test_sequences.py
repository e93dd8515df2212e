"""Clip sequences and automata against versions that walk one by one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import audio, automata
from scriptorium.sinks import files


def joined(clips, n):
    """One clip after the other, the way it is said: the last k samples fade out as the first k of the next fade in."""
    out = np.zeros(0)
    for c in clips:
        if c is None or not len(c):
            continue
        c, k = np.array(c), min(n, len(out), len(c))
        t = np.arange(1, k + 1) / (k + 1)
        out = np.concatenate([out[: len(out) - k], out[len(out) - k :] * (1 - t) + c[:k] * t, c[k:]])
    return out


@pytest.mark.parametrize("overlap,frame", [(0, 7), (5, 7), (16, 1000), (40, 3)])
def test_crossfaded(spark, overlap, frame):
    rng = random.Random(overlap)
    rows = []
    for key in (1, 2, 3, None):
        for order in range(25):
            n = rng.choice((0, 1, 3, 20, 60)) if key != 2 else rng.choice((1, 2, 4))  # key 2: all clips shorter than the overlap
            rows.append((key, order * 3, None if rng.random() < 0.1 else [rng.uniform(-1, 1) for _ in range(n)]))
    rows.append((4, 0, []))
    df = spark.createDataFrame([(*r, "x") for r in rows], "k long, o long, s array<float>, frame_ string").repartition(5)
    frames = audio.crossfaded(df.filter("k is not null"), "k", "o", "s", overlap, frame)
    got = {}
    for r in sorted(frames.collect(), key=lambda r: (r.k, r.frame)):
        assert len(r.samples) <= frame and r.frame == len(got.get(r.k, [])) // frame
        got.setdefault(r.k, []).extend(r.samples)
    for key in (1, 2, 3):
        want = joined([np.float32(s).astype(float) if s is not None else None for k, _, s in rows if k == key], overlap)
        assert np.allclose(got[key], want, atol=1e-12), key
        info = {r.k: r for r in audio.recording_info(frames, "k").collect()}[key]
        assert (info.n, info.head, info.tail) == (len(want), pytest.approx(want[0]), pytest.approx(want[-1]))
    assert 4 not in got and audio.crossfaded(df.limit(0), "k", "o", "s", overlap, frame).count() == 0


def test_framed_files(spark, tmp_path):
    df = spark.createDataFrame([("a", k, [float(np.sin(k * 40 + i)) for i in range(40)]) for k in range(5)], "k string, o int, s array<double>")
    files.write_files(audio.framed_files(audio.crossfaded(df, "k", "o", "s", 8, 50), "k"), str(tmp_path), "name", "content").collect()
    data = b"".join(f.read_bytes() for f in sorted((tmp_path / "a").iterdir()))
    want = joined([[np.sin(k * 40 + i) for i in range(40)] for k in range(5)], 8)
    assert np.array_equal(np.frombuffer(data, "<i2"), (np.clip(want, -1, 1) * 32767).astype("<i2"))


def test_states(spark):
    rng = random.Random(2)
    moves = [[rng.randrange(4) for _ in range(4)] for _ in range(6)] + [None]
    rows = [(k, at // 10, at, rng.choice(moves)) for k in ("a", "b", None) for at in range(95)]
    df = spark.createDataFrame(rows, "k string, b int, o int, m array<int>").repartition(6)
    got = {(r.k, r.o): r.state for r in automata.states(df, "k", "b", "o", "m", 2).collect()}
    for k in ("a", "b", None):
        state = 2
        for _, _, at, m in [r for r in rows if r[0] == k]:
            state = state if m is None else m[state]
            assert got[k, at] == state
    assert automata.states(df.limit(0), "k", "b", "o", "m").count() == 0


def test_degradation_and_retry(spark):
    said = ["ok", "Metal", "voice not found", None, "failed assertion", "ok", "commit call", "Metal", "ok"]
    df = spark.createDataFrame([("e", k // 2, k, m) for k, m in enumerate(said)], "engine string, day int, at int, message string")
    got = sorted(automata.degradation(df, "engine", "day", "at", "message").collect(), key=lambda r: r["at"])
    assert [r.errors for r in got] == [0, 1, 1, 1, 2, 2, 3, 3, 3] and [r.level for r in got] == [0, 1, 1, 1, 1, 1, 2, 2, 2]
    cases = [(0, 0, None, "done"), (2, 0, "graphics", "give up"), (1, 0, "graphics", "again"), (0, 1, "quota", "wait"), (0, 3, "other", "fail"), (1, 3, "graphics", "fail")]
    rows = spark.createDataFrame([c[:3] for c in cases], "level int, attempt int, failed string")
    assert [r.r for r in rows.select(automata.retry(F.col("level"), F.col("attempt"), F.col("failed")).alias("r")).collect()] == [c[3] for c in cases]
