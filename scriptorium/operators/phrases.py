"""Topics of texts by the phrases of their corpus, as `language.topics` of `language.phrases` of `language.phrase_pairs`, for corpora of any size.

Texts are moved once, and no word is moved by itself. A part of the texts says which pairs it holds, as packed blobs dealt by a hash of the
pair; what comes back to it is a bit for each. So no table of pairs or words is broadcast on purpose, whatever their number.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.arrow import BATCH_ROWS
from ..plans.session import TASKS_A_CORE, deal_to, reachable
from .language import LEAST_PAIRS, LIFT, PHRASE_WORDS, TOPICS

#: Anything between two words but one space, by RE2, which DuckDB runs on too.
BREAK = r"[^\p{L} ]+|  +"
#: How hard blobs are packed.
LEVEL = 3


class Words:
    """Words of texts as numbers: ids, in the order of `names`, with the rows they are in and whether the next one is their neighbour."""

    def __init__(self) -> None:
        self.coded, self.rows, self.near = [], [], []

    def add(self, texts: pa.Array, rows) -> None:
        """rows: a number for each text."""
        import numpy as np
        import pyarrow.compute as pc

        lists = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")), BREAK, " \n "), " ")
        tokens, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
        # what is no word is a break, or nothing beside a break or at an end
        word = pc.and_(pc.not_equal(tokens, ""), pc.not_equal(tokens, "\n")).to_numpy(zero_copy_only=False)
        followed = np.zeros(len(word), bool)
        followed[:-1] = word[1:] & (row[1:] == row[:-1])
        self.coded.append(tokens.filter(pa.array(word)).dictionary_encode())
        self.rows.append(np.asarray(rows)[row[word]])
        self.near.append(followed[word])

    def done(self):
        """(names, ids, rows, near): names sorted."""
        import numpy as np
        import pyarrow.compute as pc

        chunks = pa.chunked_array(self.coded, pa.dictionary(pa.int32(), pa.string())).unify_dictionaries().chunks
        names = chunks[-1].dictionary if chunks else pa.array([], pa.string())
        order = pc.array_sort_indices(names).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ids = np.concatenate([place[c.indices.to_numpy()] for c in chunks]) if chunks else place
        return names.take(pa.array(order)), ids, *(np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((self.rows, np.int64), (self.near, bool)))


def _hashes(names: pa.Array):
    import zlib

    import numpy as np

    return np.fromiter((zlib.crc32(w.encode()) for w in names.to_pylist()), np.int64, len(names))


def _dealt(names: pa.Array, first, second, n: int):
    """(number under n, places) of pairs that are dealt to it."""
    import numpy as np

    hashed = np.append(_hashes(names), 0)  # nothing has the hash 0
    at = ((3 * hashed[first] + hashed[second]) % n).astype(np.uint16 if n < 1 << 16 else np.int64)  # short numbers are sorted by digits
    order = np.argsort(at, kind="stable")
    return [(int(at[rows[0]]), rows) for rows in np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(rows)]


def _to(word: Column, following: Column, labels: list[int]) -> Column:
    """The label of a pair, as _dealt() has it."""
    at = F.pmod(3 * F.crc32(word.cast("binary")) + F.crc32(following.cast("binary")), F.lit(len(labels)))
    return F.get(F.lit(labels), at.cast("int"))


def pack(names: pa.Array, first, second, n) -> bytes:
    """Pairs with their counts, in their order, as a blob; second is -1 for none."""
    import numpy as np
    import pyarrow.compute as pc

    held = np.zeros(len(names) + 1, bool)
    held[first] = held[second] = True
    every = np.flatnonzero(held[:-1])
    place = np.append(np.cumsum(held[:-1], dtype=np.int32) - np.int32(1), np.int32(-1)).astype("<i4")
    ahead, behind = place[first], place[second]
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), names.take(pa.array(every))), "\n")[0].as_py().encode()
    # bytes of numbers stand by their places, and what grows as its steps: that packs well
    plain = b"".join(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in (np.diff(ahead, prepend=np.int32(0)), behind, n.astype("<i8")))
    raw = len(text).to_bytes(8, "little") + len(first).to_bytes(8, "little") + text + plain
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", LEVEL).compress(raw, asbytes=True)


def unpack(blob: bytes):
    """(names, first, second, n) of pack()."""
    import numpy as np
    import pyarrow.compute as pc

    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    size, rows = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:16], "little")
    names = pc.split_pattern(pa.array([raw[16 : 16 + size].decode()]), "\n").flatten()
    at, out = 16 + size, []
    for kind in ("<i4", "<i4", "<i8"):
        width = np.dtype(kind).itemsize
        flat = np.frombuffer(raw, np.uint8, width * rows, at).reshape(width, -1).T
        out.append(np.ascontiguousarray(flat).view(kind).ravel())
        at += width * rows
    return names, np.cumsum(out[0], dtype=np.int64), out[1].astype(np.int64), out[2]


def _counted(names, ids, near):
    """(first, second, n): pairs of neighbours in order, and each word with none (-1) for all its places."""
    import numpy as np

    size = len(names) + 1
    at = np.flatnonzero(near)
    pairs, n = np.unique(ids[at] * size + ids[at + 1] + 1, return_counts=True)
    single = np.bincount(ids, minlength=size - 1)
    code, n = np.concatenate([pairs, np.arange(size - 1) * size]), np.concatenate([n, single])
    order = np.argsort(code, kind="stable")
    return code[order] // size, code[order] % size - 1, n[order]


def _merged(blobs):
    """(names, first, second, n) of all pairs of blobs, each once, in order."""
    import numpy as np

    chunks, rest = [], []
    for blob in blobs:
        names, first, second, n = unpack(blob)
        chunks.append(pa.DictionaryArray.from_arrays(pa.array(np.arange(len(names), dtype=np.int32)), names))
        rest.append((first, second, n))
    whole = pa.chunked_array(chunks).unify_dictionaries().chunks
    names, place = whole[-1].dictionary, [c.indices.to_numpy().astype(np.int64) for c in whole]
    size = len(names) + 1
    code = np.concatenate([p[a] * size + np.where(b < 0, 0, p[b] + 1) for p, (a, b, _) in zip(place, rest)])
    each, back = np.unique(code, return_inverse=True)
    n = np.bincount(back, np.concatenate([x for _, _, x in rest]), len(each)).astype(np.int64)  # whole numbers under 2**53 are exact
    return names, each // size, each % size - 1, n


def _blobs(texts: DataFrame, labels: list[int]) -> DataFrame:
    """What pairs each part of the texts holds, a blob for each label that some are dealt to."""

    def run(batches):
        import numpy as np
        import pyarrow.compute as pc

        found = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for part in set(batch.column(0).to_pylist()):  # one, unless labels meet
                own = batch.filter(pc.equal(batch.column(0), part))
                found.setdefault(part, Words()).add(own.column(2), np.zeros(own.num_rows, np.int64))
        for part, words in found.items():
            names, ids, _, near = words.done()
            first, second, n = _counted(names, ids, near)
            for to, rows in _dealt(names, first, second, len(labels)):
                yield pa.RecordBatch.from_pydict({"_to": pa.array([labels[to]], pa.int32()), "_part": pa.array([part], pa.int32()), "blob": pa.array([pack(names, first[rows], second[rows], n[rows])], pa.binary())})

    return texts.mapInArrow(run, "_to int, _part int, blob binary")


def _known(blobs: DataFrame, least: int, lift: int) -> DataFrame:
    """(word, next) that meet `least` times or more and `lift` times as often as by chance, as `language.phrase_pairs` has them."""

    def run(batches):
        import numpy as np

        held = [x for batch in batches for x in batch.column(2).to_pylist()]
        if not held:
            return
        names, first, second, n = _merged(held)
        total = pa.RecordBatch.from_pydict({"word": pa.array([None], pa.string()), "next": pa.array([None], pa.string()), "n": pa.array([int(n[second < 0].sum())], pa.int64())})
        kept = np.flatnonzero(n >= least)  # a pair is no more frequent than its words
        yield total
        for a in range(0, len(kept), 1 << 16):
            k = kept[a : a + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"word": names.take(pa.array(first[k])), "next": names.take(pa.array(second[k], mask=second[k] < 0)), "n": pa.array(n[k])})

    rows = blobs.mapInArrow(run, "word string, next string, n long")
    total = rows.filter("word is null").agg(F.sum("n").cast("decimal(19,0)")).scalar()
    counts, met = rows.filter("word is not null and next is null"), rows.filter("next is not null")
    one, other = counts.select("word", F.col("n").alias("_a")), counts.select(F.col("word").alias("next"), F.col("n").alias("_b"))
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    return met.join(one, "word").join(other, "next").filter(whole("n") * total >= F.lit(lift).cast("decimal(4,0)") * (whole("_a") * whole("_b")).cast("decimal(33,0)")).select("word", "next")


def _answers(known: DataFrame, blobs: DataFrame) -> DataFrame:
    """(_part, _to, bits): which of a blob's pairs are known, in their order; both tables are dealt by _to. A blob without any has no row."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow.compute as pc

        out = []
        if left.num_rows:
            coded = [pc.unique(left.column(c).combine_chunks()) for c in ("word", "next")]
            size = len(coded[1])
            have = np.sort(pc.index_in(left.column("word"), coded[0]).to_numpy().astype(np.int64) * size + pc.index_in(left.column("next"), coded[1]).to_numpy())
            for to, part, blob in zip(*(right.column(c).to_pylist() for c in ("_to", "_part", "blob"))):
                names, first, second, _ = unpack(blob)
                a, b = (pc.fill_null(pc.index_in(names, c), -1).to_numpy().astype(np.int64) for c in coded)
                one, other = a[first], np.append(b, -1)[second]
                code = one * size + other
                at = np.minimum(np.searchsorted(have, code), len(have) - 1)
                bits = (one >= 0) & (other >= 0) & (have[at] == code)
                if bits.any():
                    out.append((part, to, np.packbits(bits).tobytes()))
        return pa.table([pa.array(x, kind) for x, kind in zip(zip(*out) if out else [[]] * 3, (pa.int32(), pa.int32(), pa.binary()))], ["_part", "_to", "bits"])

    return known.groupBy("_to").cogroup(blobs.groupBy("_to")).applyInArrow(run, "_part int, _to int, bits binary")


def _ranked(names: pa.Array, ids, rows, tied, most: int, top: int):
    """(row, rank, phrase, n): chains of tied words cut into phrases of up to `most`, the `top` most frequent of each row, ties by first place."""
    import numpy as np
    import pyarrow.compute as pc

    size, at = len(names) + 1, np.arange(len(ids))
    # a chain begins where the word before isn't tied; phrases begin at every `most`-th of its words
    fresh = np.ones(len(ids), bool)
    fresh[1:] = ~tied[:-1]
    starts = np.flatnonzero(fresh)
    chain = np.cumsum(fresh) - 1
    length = np.diff(np.append(starts, len(ids)))
    offset = at - starts[chain]
    start = at[(offset % most == 0) & (length[chain] - offset > 1)]
    held = np.minimum(most, length[chain[start]] - offset[start])
    same = [np.where(k < held, ids[np.minimum(start + k, len(ids) - 1)], size - 1) for k in range(most)]
    row = rows[start]
    order = np.lexsort((*same[::-1], row))  # stable: the first of equals is the first in its text
    if not len(order):
        return None
    new = np.ones(len(order), bool)
    new[1:] = np.any([np.diff(x[order]) != 0 for x in (row, *same)], axis=0)
    heads = np.flatnonzero(new)
    n = np.diff(np.append(heads, len(order)))
    one = order[heads]
    ranks = np.lexsort((start[one], -n, row[one]))
    r = row[one][ranks]
    rank = np.arange(1, len(r) + 1) - np.searchsorted(r, r)
    kept = rank <= top
    pick = one[ranks][kept]
    columns = [names.take(pa.array(x[pick], mask=x[pick] == size - 1)) for x in same]
    return r[kept], rank[kept], pc.binary_join_element_wise(*columns, " ", null_handling="skip"), n[ranks][kept]


def topics(df: DataFrame, text: str, key: str, least: int = LEAST_PAIRS, lift: int = LIFT, most: int = PHRASE_WORDS, top: int = TOPICS, parts: int | None = None) -> DataFrame:
    """(key, rank, topic, n): the most frequent phrases of each text, ties by first place.

    Phrases are chains of neighbours that meet `least` times or more in all texts and `lift` times as often as by chance, from the left, up
    to `most` words. key must tell rows apart. parts: in how many the texts are dealt, each in the memory of a task; else as Spark's shuffles.
    """
    spark, kind = reachable(df.sparkSession), df.schema[key].dataType.simpleString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    n = parts or max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a blob packs better with more pairs in it, and a task holds those of one label
    to = max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, -(-n // 2))
    labels = deal_to(spark, to)
    part = F.get(F.lit(deal_to(spark, n)), F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).alias("_part")
    texts = df.select(part, key, text).repartition(n, "_part")
    blobs = _blobs(texts, labels).repartition(to, "_to")
    known = _known(blobs, least, lift)
    answers = _answers(known.select(_to(F.col("word"), F.col("next"), labels).alias("_to"), "word", "next").repartition(to, "_to"), blobs)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np

        keys = left.column(key).combine_chunks().dictionary_encode("encode")
        keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        rows, at, words = keys.indices.to_numpy(), 0, Words()
        found = None
        if left.num_rows and right.num_rows:
            for chunk in left.column(text).chunks:
                words.add(chunk, rows[at : at + len(chunk)])
                at += len(chunk)
            names, ids, row, near = words.done()
            # the same texts hold the same pairs in the same order as before
            first, second, _ = _counted(names, ids, near)
            bits, yes = dict(zip(right.column("_to").to_pylist(), right.column("bits").to_pylist())), np.zeros(len(first), bool)
            for k, places in _dealt(names, first, second, to):
                if labels[k] in bits:
                    yes[places] = np.unpackbits(np.frombuffer(bits[labels[k]], np.uint8), count=len(places))
            code, i, size = (first * (len(names) + 1) + second)[yes], np.flatnonzero(near), len(names) + 1
            tied = near.copy()
            tied[i] = np.isin(ids[i] * size + ids[i + 1], code)
            found = _ranked(names, ids, row, tied, most, top)
        row, rank, phrase, times = found or ([], [], [], [])
        return pa.table({key: keys.dictionary.take(pa.array(row, pa.int64())), "rank": pa.array(rank, pa.int64()), "topic": pa.array(phrase, pa.string()) if not len(row) else phrase, "n": pa.array(times, pa.int64())})

    return texts.groupBy("_part").cogroup(answers.repartition(n, "_part").groupBy("_part")).applyInArrow(run, f"`{key}` {kind}, rank long, topic string, n long")
