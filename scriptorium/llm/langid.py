"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, anything else is one space, and n-grams of one to three code points are hashed
into a fixed number of buckets. Training sums bucket counts for each language over a bounded hash sample of
its labelled documents; the matrix of log probabilities (buckets x languages) is broadcast, its size fixed by
the two bounds below. Scoring is a sparse product in numpy for a batch at a time: the n-grams of all its texts
are the column indices of one sparse matrix whose rows are the texts, and that times the matrix of log
probabilities, row by row in bounded pieces, gives all scores. A text longer than BLOCK is scored alone, in blocks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Bound of the sample that the model is fitted on: expected rows of each language, by hash of id and text. More languages than the
#: matrix is made for (131 MB) are an error; none is left out.
LANGUAGE_ROWS, MAX_LANGUAGES = 5_000, 1_000
#: Hashes are compared in so many steps, far more than a table has rows.
STEPS = 1 << 48
#: Code points of a text that are scored at a time, for memory.
BLOCK = 1 << 18
#: Numbers of the dense product that are held at a time.
PIECE = 1 << 21
UNKNOWN = "und"


@lru_cache(1)
def _table() -> np.ndarray:
    """For each code point its lower-case letter, or a space if it is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters(text: str) -> np.ndarray:
    """Code points of the letters in lower case, runs of others as one space, a space at both ends."""
    return batch_letters([text])[0]


def batch_letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all texts one after the other, and where each text's begin (one entry more than texts)."""
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 2)])
    a, inner = np.full(starts[-1], 32, np.uint32), np.ones(starts[-1], bool)
    inner[starts[:-1]] = inner[starts[1:] - 1] = False
    a[inner] = _table()[raw]
    keep = np.r_[True, (a[1:] != 32) | (a[:-1] != 32)]
    keep[starts[:-1]] = True
    return a[keep], np.concatenate([[0], np.cumsum(np.add.reduceat(keep, starts[:-1], dtype=np.int64))])


def _hashed(a: np.ndarray, orders: tuple[int, ...], buckets: int):
    """(n, buckets of the n-grams at each place) for each order that fits."""
    h = np.zeros(len(a), np.uint32)
    for n in range(1, max(orders) + 1):
        if len(a) < n:
            break
        h = (h[: len(a) - n + 1] * np.uint32(0x01000193)) ^ (a[n - 1 :] * np.uint32(0x9E3779B1)) ^ np.uint32(n)
        if n in orders:
            mixed = h ^ (h >> np.uint32(15))
            yield n, ((mixed * np.uint32(0x85EBCA6B)) >> np.uint32(7)) & np.uint32(buckets - 1)


def grams(a: np.ndarray, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all n-grams of a text."""
    found = [g for _, g in _hashed(a, orders, buckets)]
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


def blocks(text: str):
    """A long text in blocks that overlap so that no n-gram is lost or counted twice; each gives its n-grams."""
    a = letters(text)
    keep = max(ORDERS) - 1
    yield grams(a[:BLOCK])
    for at in range(BLOCK, len(a), BLOCK):
        part = a[at - keep : at + BLOCK]
        for n in ORDERS:
            yield grams(part[keep - n + 1 :], (n,)) if len(part) > keep - n + 1 else np.zeros(0, np.int64)


def has_letters(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def train(labelled: DataFrame, language_rows: int = LANGUAGE_ROWS, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and the matrix of log probabilities, from rows (doc_id, text, lang) without null lang.

    All rows of a language with language_rows or fewer teach, and about language_rows of one with more. A language that no text
    with a letter teaches is none of the model's: it would explain best what no other has seen. More than MAX_LANGUAGES are an
    error. Repeated rows count each time, extra columns are ignored. No rows give no languages.
    """
    found = labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; the matrix of log probabilities isn't made for them")
    share = {r.lang: min(1.0, language_rows / r.n) for r in found}
    some = labelled.select("doc_id", "text", "lang")
    if any(x < 1 for x in share.values()):
        drawn = some.sparkSession.createDataFrame([(lang, int(x * STEPS)) for lang, x in share.items()], "lang string, below long")
        some = some.join(F.broadcast(drawn), "lang").filter(F.pmod(F.xxhash64("doc_id", "text", F.lit("train")), F.lit(STEPS)) < F.col("below"))

    def make():
        def step(batch: pa.RecordBatch):
            total: dict[str, np.ndarray] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for g in blocks(text.as_py() or ""):
                    total[lang] = total.get(lang, 0) + np.bincount(g, minlength=BUCKETS)
            rows = [(lang, int(b), int(counts[b])) for lang, counts in total.items() for b in np.flatnonzero(counts)]
            return list(zip(*rows)) if rows else None

        return step

    counts = map_batches(some.select("lang", "text"), make, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    silent, place, matrix = set(grams(letters("")).tolist()), {}, np.full((BUCKETS, len(share)), smoothing)
    heard = set()
    for r in counts.toLocalIterator():  # BUCKETS x MAX_LANGUAGES numbers at most
        matrix[r.bucket, place.setdefault(r.lang, len(place))] += r.n
        if r.bucket not in silent:
            heard.add(r.lang)
    langs = sorted(heard)
    matrix = matrix[:, [place[lang] for lang in langs]]
    return langs, np.log(matrix / matrix.sum(axis=0)).astype(np.float32)


def product(starts: np.ndarray, columns: np.ndarray, matrix: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Sparse times dense: row i of the result sums the rows of `matrix` that columns[starts[i]:starts[i + 1]] name, none of these empty."""
    out = np.zeros((len(starts) - 1, matrix.shape[1]))
    step = max(1, piece // matrix.shape[1])
    for at in range(0, len(columns), step):
        stop = min(at + step, len(columns))
        first, last = np.searchsorted(starts, at, "right") - 1, np.searchsorted(starts, stop, "left")
        cuts = np.maximum(starts[first:last], at) - at
        out[first:last] += np.add.reduceat(matrix[columns[at:stop]], cuts, axis=0, dtype=np.float64)
    return out


def _totals(texts: list[str], matrix: np.ndarray) -> np.ndarray:
    """Log likelihoods of texts that have letters, for each language."""
    a, starts = batch_letters(texts)
    last = np.zeros(len(a), bool)
    last[starts[1:] - 1] = True
    total, crossing = np.zeros((len(texts), matrix.shape[1])), np.zeros(len(a), bool)
    for n, g in _hashed(a, ORDERS, BUCKETS):
        if n > 1:  # windows that reach from one text into the next
            crossing = crossing[: len(g)] | last[n - 2 : n - 2 + len(g)]
            g = g[~crossing]
        total += product(starts - (n - 1) * np.arange(len(starts)), g, matrix)
    return total


def score(texts: list[str | None], langs: list[str], matrix: np.ndarray) -> tuple[list[str], list[float]]:
    """Predicted language and its posterior (languages equally likely beforehand) of each text."""
    preds, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)

    def settle(places: list[int], total: np.ndarray) -> None:
        best = total.argmax(axis=1)
        top = 1 / np.exp(np.minimum(total - total[np.arange(len(best)), best][:, None], 0)).sum(axis=1)
        for k, b, x in zip(places, best.tolist(), top.tolist()):
            preds[k], scores[k] = langs[b], x

    some, size = [], 0
    for k, text in enumerate(texts if langs else []):
        if not has_letters(text):
            continue
        if len(text) > BLOCK:
            total = np.zeros(len(langs))
            for g in blocks(text):
                counts = np.bincount(g, minlength=BUCKETS)
                hit = np.flatnonzero(counts)
                total += counts[hit] @ matrix[hit].astype(np.float64)
            settle([k], total[None, :])
            continue
        some.append(k)
        size += len(text)
        if size > BLOCK:
            settle(some, _totals([texts[j] for j in some], matrix))
            some, size = [], 0
    if some:
        settle(some, _totals([texts[j] for j in some], matrix))
    return preds, scores


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score for every row; `und` with score 0 for a text that is null or has no letter, or without a model.

    Reads doc_id and text alone. Ties go to the language that sorts first. One row for each row, repeated ones too; no rows, none.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        langs, matrix = known.value

        def step(batch: pa.RecordBatch):
            preds, scores = score([t.as_py() for t in batch.column(1)], langs, matrix)
            return [batch.column(0), preds, scores]

        return step

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, lang_pred string, score double")


def held_out(docs: DataFrame, folds: int = 3, fold: int = 1):
    """Whether a document is kept from training: crc32 of its id as text, modulo the folds."""
    return F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % folds == fold, F.lit(False))
