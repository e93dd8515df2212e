"""Semantic chunks by lexical cohesion: where the words before and after a gap between sentences differ most, a chunk may end."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import splitters
from ..plans import rules as R
from ..plans.arrow import over_batches
from .language import SENTENCE_END, sentences, words

#: Sentences on either side of a gap, letters from which on a word counts, characters of a chunk at most, and those that
#: it should have before a valley ends it.
WINDOW, LEAST_LETTERS, SIZE, LEAST_SIZE = 3, 4, 4000, 1000
#: Words whose gaps are counted at once, to bound a worker's memory; a text is never parted.
BATCH_WORDS = 200_000


def _said(text: str) -> Column:
    """The words that count of each sentence."""
    return F.transform(sentences(F.col(text)), lambda s: F.filter(words(F.lower(s)), lambda w: F.length(w) >= LEAST_LETTERS))


def _slices(lists, most: int = BATCH_WORDS):
    """Bounds of neighbouring rows of sentences of words that hold `most` words or fewer, or one row."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.bincount(pc.list_parent_indices(lists).to_numpy(), pc.list_value_length(lists.flatten()).to_numpy(), len(lists))
    ends = np.concatenate(([0], np.cumsum(sizes)))
    start = 0
    while start < len(lists):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
        yield start, stop
        start = stop


def _cosines(lists, window: int):
    """The row, number and cosine of each gap, by rows of sentences of words. A word counts before the `window` gaps behind its sentence and after those in front of it."""
    import numpy as np
    import pyarrow.compute as pc

    row = pc.list_parent_indices(lists).to_numpy()  # of each sentence; a gap has the number of the sentence before it
    n, starts, ends = len(row), np.searchsorted(row, row), np.searchsorted(row, row, "right") - 1
    each = lists.flatten()
    at, coded = pc.list_parent_indices(each).to_numpy(), each.flatten().dictionary_encode()
    code, size = coded.indices.to_numpy(), max(1, len(coded.dictionary))

    def counted(steps):
        keys = []
        for step in steps:
            held = (at + step >= starts[at]) & (at + step < ends[at])
            keys.append((at + step)[held] * size + code[held])
        return np.unique(np.concatenate(keys), return_counts=True)

    (before, a), (after, b) = counted(range(window)), counted(range(-window, 0))
    _, i, j = np.intersect1d(before, after, assume_unique=True, return_indices=True)
    total = lambda keys, values: np.bincount(keys // size, values, n)
    dot, aa, bb = total(before[i], a[i] * b[j]), total(before, a * a), total(after, b * b)
    cosine = np.divide(dot, np.sqrt(aa * bb), out=np.zeros(n), where=(aa > 0) & (bb > 0))
    gaps = np.flatnonzero(np.arange(n) < ends)
    return row[gaps], gaps - starts[gaps] + 1, cosine[gaps]


def cohesion(df: DataFrame, text: str, key: str, window: int = WINDOW) -> DataFrame:
    """(key, gap, cohesion): cosine of the word counts of `window` sentences before and after each gap, 1 after the first sentence; 0 where a side has no words.

    Words are counted where their text is: dealt by gap they would be many times the texts. Work grows with a text's length.
    Texts with one sentence have no gaps; key must tell rows apart.
    """
    kind = df.schema[key].dataType.simpleString()

    def make():
        import numpy as np

        def step(batch):
            found = []
            for start, stop in _slices(batch.column(1)):
                row, gap, cosine = _cosines(batch.column(1).slice(start, stop - start), window)
                found.append((row + start, gap, cosine))
            row, gap, cosine = map(np.concatenate, zip(*found))
            return [batch.column(0).take(pa.array(row)), gap, cosine] if len(row) else None

        return step

    return over_batches(df.select(key, _said(text).alias("_s")), make, f"`{key}` {kind}, gap long, cohesion double")


def depths(found: DataFrame, key: str) -> DataFrame:
    """(key, gap, depth): how far cohesion lies below the highest within WINDOW gaps on either side, both taken together."""
    order = Window.partitionBy(key).orderBy("gap")
    left, right = order.rowsBetween(-WINDOW, 0), order.rowsBetween(0, WINDOW)
    return found.select(key, "gap", (F.max("cohesion").over(left) + F.max("cohesion").over(right) - 2 * F.col("cohesion")).alias("depth"))


def _depths(found) -> list[float]:
    """depths() of one text's gaps."""
    import numpy as np

    held = np.pad(found, WINDOW, constant_values=-np.inf)
    highest = lambda first: np.max([held[k : k + len(found)] for k in range(first, first + WINDOW + 1)], axis=0)
    return (highest(0) + highest(WINDOW) - 2 * found).tolist()


def cuts(lengths: list[int], depth: list[float], size: int = SIZE, least: int = LEAST_SIZE) -> list[int]:
    """Numbers of sentences after which a chunk ends: the deepest gap (the first of equals) between `least` and `size` characters, the last one within `size` if there is none.

    What is left within `size` is the last chunk. A sentence that is longer than `size` is a chunk of its own.
    """
    out, start, n = [], 0, len(lengths)
    while start < n:
        total, best, last, k = 0, None, None, start
        while k < n and total + lengths[k] <= size:
            total += lengths[k]
            k += 1
            if k < n:
                last = k
                if total >= least and (best is None or depth[k - 1] > depth[best - 1]):
                    best = k
        start = n if k == n else best or last or start + 1
        out.append(start)
    return out


def chunks(df: DataFrame, text: str, key: str, size: int = SIZE, least: int = LEAST_SIZE) -> DataFrame:
    """(key, id, chunk, method): chunks of whole sentences, cut at valleys of cohesion, that put together are the text; ids count from semantic_000.

    A sentence that is longer than `size` goes to the recursive splitter, whose chunks (recursive_000 and on, method recursive) overlap as they
    do there. A text's cuts follow from the depths of its gaps, found where it is: texts aren't moved. Null and empty texts have no chunks.
    """
    rows = df.filter(F.length(text) > 0).select(key, text, _said(text).alias("_s"))
    kind = df.schema[key].dataType.simpleString()

    def make():
        import re

        import numpy as np

        end = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", SENTENCE_END.replace("<Z>", R.STRIP)))

        def deep(lists):
            for start, stop in _slices(lists):
                row, _, found = _cosines(lists.slice(start, stop - start), WINDOW)
                yield from map(_depths, np.split(found, np.searchsorted(row, range(1, stop - start))))

        def step(batch):
            out = []
            for k, t, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), deep(batch.column(2))):
                ends = [m.end() for m in end.finditer(t)]
                starts = [0, *ends]  # a sentence keeps the white space behind it, so nothing of the text is lost
                lengths = [b - a for a, b in zip(starts, [*ends, len(t)])]
                before, nth = 0, {"semantic": 0, "recursive": 0}
                for stop in cuts(lengths, d, size, least):
                    whole = t[starts[before] : starts[stop] if stop < len(starts) else len(t)]
                    parts = [("semantic", whole)] if len(whole) <= size else [("recursive", p) for p in splitters.split(whole, size)]
                    for method, part in parts:
                        if part:
                            out.append((k, f"{method}_{nth[method]:03d}", part, method))
                            nth[method] += 1
                    before = stop
            return list(zip(*out)) if out else None

        return step

    return over_batches(rows, make, f"`{key}` {kind}, id string, chunk string, method string")
