"""Ranked lexical search: the k best documents of every query by a sum of term impacts, with safe pruning.

Terms are known once the queries are read, so one pass turns every document into its postings of those terms (the forward index, in
the shared folder), with document frequencies beside it. A term's impact in a document is a whole number. Then

1. for each term its k highest impacts in the corpus are found. The k-th is a score that k documents reach at least, so
   the greatest k-th impact over a query's terms is a lower bound of the query's k-th score: the seed;
2. terms are put in order of their highest impact. Where the highest impacts of the last terms add up to less than the seed
   (the suffix bound), a document that holds none but them can't be among the k: they are no longer looked up;
3. postings of the terms that are left join the queries: they are the candidates, block by block of documents, and each
   candidate is scored exactly over all terms of its query. A task raises its threshold as it finds better ones, and what may
   still win in it, k a query at most, goes to a last sort for each query.

Queries are worked in blocks of BLOCK_BYTES of text, as many as it takes, so what is broadcast has a bound that doesn't grow with
documents or with queries; a query longer than that is a block of its own. Each block of queries is held against all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import reachable
from .common import CACHES, checkpoint, gathered, small_batches

K = 50
#: Text of the queries that are worked at once, and of the postings that make a block of documents.
BLOCK_BYTES, GATHER = 1 << 20, 4 << 20
_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_NO_ID = np.iinfo(np.int64).max


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, repeats included: runs of ASCII letters, digits and characters beyond ASCII, A-Z as a-z; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_SPLIT).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(w: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """Whole numbers: w * ((10**9 * tf) div (1000 * tf + 20 * m)), m = 50 + 50 * n * N div L."""
    m = 50 + (50 * n * n_docs) // max(length, 1)
    return w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def _batches(df: DataFrame, run, schema: str, gather: int = 0) -> DataFrame:
    """mapInArrow with a state for each task: run is a generator over batches."""
    small_batches(reachable(df.sparkSession))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for free in CACHES:
            free()
        yield from run(gathered(batches, gather) if gather else batches)

    return df.mapInArrow(task, schema)


def _forward(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms, repeats included), ids and tfs (little-endian int32) of the known terms, for documents with a term."""
    names = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        at = names.value
        for batch in batches:
            kept, n, ids, tfs = [], [], [], []
            for k, text in enumerate(batch.column(1)):
                found = terms(text.as_py())
                if found:
                    counts = [(at[t], c) for t, c in Counter(found).items() if t in at]
                    kept.append(k)
                    n.append(len(found))
                    ids.append(np.array([c[0] for c in counts], "<i4").tobytes())
                    tfs.append(np.array([c[1] for c in counts], "<i4").tobytes())
            if kept:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(tfs, pa.binary())], names=["doc_id", "n", "ids", "tfs"])

    return _batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n long, ids binary, tfs binary")


def _block(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n, doc, term, tf): the postings of a batch, doc as the row's place."""
    column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
    n = column["n"].to_numpy(zero_copy_only=False)
    ids = [x.as_py() for x in column["ids"]]
    term = np.frombuffer(b"".join(ids), "<i4").astype(np.int64)
    tf = np.frombuffer(b"".join(x.as_py() for x in column["tfs"]), "<i4").astype(np.int64)
    return n, np.repeat(np.arange(len(ids)), [len(x) // 4 for x in ids]), term, tf


def _figures(forward: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of each term: a row for each task and term, summed in Spark."""

    def run(batches):
        df, docs, length = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            n, _, term, _ = _block(batch)
            docs, length = docs + len(n), length + int(n.sum())
            df += np.bincount(term, minlength=n_terms)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], seen]).astype(np.int64)), pa.array(np.concatenate([[docs, length], df[seen]]).astype(np.int64))], names=["term", "n"])

    sums = {r.term: r.n for r in _batches(forward.select("n", "ids", "tfs"), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each term of a block
    return sums.get(-1, 0), sums.get(-2, 0), np.array([sums.get(t, 0) for t in range(n_terms)], np.int64)


def _top(groups: np.ndarray, values: np.ndarray, k: int, tie: np.ndarray | None = None) -> np.ndarray:
    """Places of the k highest values of each group, ties by the lesser `tie`."""
    order = np.lexsort((*(() if tie is None else (tie,)), -values, groups))
    g = groups[order]
    first = np.r_[True, g[1:] != g[:-1]] if len(g) else np.zeros(0, bool)
    rank = np.arange(len(g)) - np.maximum.accumulate(np.where(first, np.arange(len(g)), 0)) if len(g) else g
    return order[rank < k]


def _term_bounds(forward: DataFrame, w: np.ndarray, n_docs: int, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest and the k-th highest impact of each term; 0 where fewer than k documents hold it."""
    weights = forward.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        own = weights.value
        best_term, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            n, doc, term, tf = _block(batch)
            t, v = np.concatenate([best_term, term]), np.concatenate([best, impacts(own[term], tf, n[doc], n_docs, length)])
            top = _top(t, v, k)
            best_term, best = t[top], v[top]
        yield pa.RecordBatch.from_arrays([pa.array(best_term), pa.array(best)], names=["term", "impact"])

    found = _batches(forward.select("n", "ids", "tfs"), run, "term long, impact long", GATHER)
    # a term's rows are k for each task at most; they meet in two steps
    for key in (["term", F.spark_partition_id() % 64], ["term"]):
        found = found.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("impact")))).filter(F.col("nth") <= k).select("term", "impact", "nth")
    high, kth = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
    for r in found.filter(F.col("nth").isin(1, k)).collect():  # two rows for each term of a block
        if r.nth == 1:
            high[r.term] = r.impact
        if r.nth == k:
            kth[r.term] = r.impact
    return high, kth


def plan(query: np.ndarray, high: np.ndarray, kth: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(seed, all terms in order of their highest impact, those that are looked up): a document with none of the latter scores below the seed."""
    order = query[np.argsort(-high[query], kind="stable")]
    seed = int(kth[query].max(initial=0))
    suffix = np.cumsum(high[order][::-1])[::-1]  # the most that terms from here on can add up to
    return seed, order, order[suffix >= max(seed, 1)]


def _search(forward: DataFrame, queries: list[tuple], w: np.ndarray, n_docs: int, length: int, k: int) -> DataFrame:
    """query (its place), doc_id, score: what may be among the k best of each query."""
    sent = forward.sparkSession.sparkContext.broadcast((w, queries))

    def run(batches):
        own, plans = sent.value
        least = np.array([p[0] for p in plans], np.int64)
        held_q, held_id, held_s = (np.zeros(0, np.int64) for _ in range(3))
        for batch in batches:
            n, doc, term, tf = _block(batch)
            ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            value = impacts(own[term], tf, n[doc], n_docs, length)
            by_term = np.argsort(term, kind="stable")
            doc, value, term = doc[by_term], value[by_term], term[by_term]
            starts = np.searchsorted(term, np.arange(len(own) + 1))
            new_q, new_id, new_s = [held_q], [held_id], [held_s]
            for q, (_, every, sought) in enumerate(plans):
                here = np.zeros(len(n), bool)
                for t in sought:  # the join of the query's terms with the postings: its candidates
                    here[doc[starts[t] : starts[t + 1]]] = True
                if here.any():
                    score = np.zeros(len(n), np.int64)
                    for t in every:  # a term has one posting in a document; what isn't a candidate is left out below
                        a, b = starts[t], starts[t + 1]
                        score[doc[a:b]] += value[a:b]
                    won = np.flatnonzero(here & (score >= max(least[q], 1)))
                    new_q.append(np.full(len(won), q))
                    new_id.append(ids[won])
                    new_s.append(score[won])
            q, i, s = np.concatenate(new_q), np.concatenate(new_id), np.concatenate(new_s)
            top = _top(q, s, k, i)
            held_q, held_id, held_s = q[top], i[top], s[top]
            count = np.bincount(held_q, minlength=len(plans))
            worst = np.full(len(plans), _NO_ID)
            np.minimum.at(worst, held_q, held_s)
            least = np.where(count >= k, np.maximum(least, worst), least)
        yield pa.RecordBatch.from_arrays([pa.array(held_q), pa.array(held_id, mask=held_id == _NO_ID), pa.array(held_s)], names=["query", "doc_id", "score"])

    return _batches(forward, run, "query long, doc_id long, score long", GATHER)


def _item_blocks(items: DataFrame) -> Iterator[list]:
    """Rows (item_id, text) in blocks of about BLOCK_BYTES; a block is one item where an item is longer."""
    sized = checkpoint(items.select("item_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"), F.monotonically_increasing_id().alias("at")))
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    parts = total // BLOCK_BYTES + 1
    while True:
        dealt = sized.withColumn("part", F.pmod(F.xxhash64("at"), F.lit(parts)))
        sizes = dealt.groupBy("part").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        if not sizes.filter((F.col("bytes") > 2 * BLOCK_BYTES) & (F.col("n") > 1)).take(1):
            break
        parts *= 2
    for r in sizes.select("part").toLocalIterator():
        yield dealt.filter(F.col("part") == r.part).select("item_id", "text").collect()  # bounded: see above


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of items the k documents with the highest scores above 0, equal scores by ascending doc_id.

    Null and empty texts have no terms: such items have no rows, such documents don't count. Documents without id come
    after those with one where scores are equal (ids are whole numbers), rows that repeat are documents of their own, and an item that repeats
    is answered each time. Extra columns are ignored; no documents or no items, no rows.
    """
    spark, kind, parts = docs.sparkSession, items.schema["item_id"].dataType.simpleString(), []
    for block in _item_blocks(items):
        found = [(r.item_id, set(terms(r.text))) for r in block]
        known = {t: i for i, t in enumerate(sorted(set().union(*(f[1] for f in found))))}
        if not known:
            continue
        forward = checkpoint(_forward(docs, known))
        n_docs, length, df = _figures(forward, len(known))
        w = np.array([weight(n_docs, int(d)) for d in df], np.int64)
        high, kth = _term_bounds(forward, w, n_docs, length, k)
        plans = [plan(np.array(sorted(known[t] for t in f[1]), np.int64), high, kth) for f in found]
        best = _search(forward, plans, w, n_docs, length, k)
        names = spark.createDataFrame([(q, f[0]) for q, f in enumerate(found)], f"query long, item_id {kind}")
        nth = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("rank", F.row_number().over(nth)).filter(F.col("rank") <= k)
        parts.append(best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
