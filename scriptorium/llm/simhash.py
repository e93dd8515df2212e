"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most two bits have a variant in common that is within one bit of both.
Each different fingerprint emits itself and its 64 one-bit variants, rows meet by variant, and what meets is
verified. A variant can gather 65 different fingerprints at most, and all that meet at it are linked through
the least of them, so neither groups nor pairs grow with the corpus. Exact copies share one fingerprint and
are one node from the start.

near_duplicates works on 64 bits of 3-word shingles and finds every link. Two bits of 64 are little for texts with a
few words changed, so one_of_each, which keeps one document of each group, takes a longer print: BANDS independent
SimHashes of BAND_BITS bits over a text's different words. Every band is ball-hashed as above, and what meets in any
band is verified on the whole print and on 5-word shingles, by the SKETCH least hashes of each text's: words alone are
the same in many texts of one small vocabulary (logs, forms, tables), which have nothing else in common. Texts whose 5-word
shingles are alike to 0.8 or more meet with a probability of about 0.92 (measured), less similar ones more and more rarely.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import checkpoint, fresh, join_keyed, map_batches, struct

SHINGLE, SEED, RADIUS = 3, 42, 2
#: The longer print, and how many of its bits may differ. Unrelated texts of one language differ in a quarter of them at least.
BANDS, BAND_BITS, WHOLE_RADIUS = 5, 48, 48
#: Words of a shingle that links are verified on, least hashes that are kept of a text's, and the share of them that linked texts
#: have in common. It is exact where both texts have SKETCH shingles or fewer together, and off by 0.05 (one standard deviation) at 0.8 where not.
VERIFIED_SHINGLE, SKETCH, LEAST_ALIKE = 5, 64, 0.7
#: Minima under hashes of their own, under which texts meet that have a centre of their ball in common but aren't like it.
SLOTS = 4
_BLOCK = 1 << 16


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits: bit k is set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[-n:] - 1).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, _BLOCK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + _BLOCK], stops[k : k + _BLOCK])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def prints(text: str | None) -> tuple[list[int], list[int], bytes]:
    """(bands, slots, sketch) of a text, ASCII capitals as small letters.

    BANDS SimHashes of BAND_BITS bits over its different words; the least hash of its VERIFIED_SHINGLE-word shingles (its words as a
    whole, if there are fewer) under SLOTS mixings; the SKETCH least of their 32-bit hashes, in order. Zeros and nothing if there are no words.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return [0] * BANDS, [0] * SLOTS, b""
    digest = xxhash.xxh64_intdigest
    known = {w: digest(w, SEED) for w in set(words)}
    h = np.fromiter(known.values(), np.uint64, len(known))
    out = []
    for k in range(BANDS):  # further hashes of a word are mixed from its first
        g = (h ^ np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
        g = (g ^ (g >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        g ^= g >> np.uint64(29)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(g), _BLOCK):
            ones += np.unpackbits(g[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones[:BAND_BITS] > len(g), bitorder="little").tobytes(), "little"))
    at_word = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(VERIFIED_SHINGLE, len(words))
    shingles = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        shingles = (shingles ^ at_word[k : len(words) - n + 1 + k]) * np.uint64(0xFF51AFD7ED558CCD)
        shingles ^= shingles >> np.uint64(33)
    slots = [signed(int((((shingles ^ np.uint64(k)) * np.uint64(0xC4CEB9FE1A85EC53)) ^ (shingles >> np.uint64(31))).min())) for k in range(1, SLOTS + 1)]
    sketch = np.unique((shingles >> np.uint64(32)).astype("<u4"))[:SKETCH].tobytes()
    return out, slots, sketch


def alike(one: bytes, other: bytes) -> float:
    """Jaccard similarity of two sets of shingles by their sketches: the share of the least hashes of both that both have."""
    a, b = np.frombuffer(one, "<u4"), np.frombuffer(other, "<u4")
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    least = np.union1d(a, b)
    if len(a) >= SKETCH or len(b) >= SKETCH:
        least = least[: min(SKETCH, len(least))]
    return float(np.isin(least, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def make():
        def step(batch: pa.RecordBatch):
            return [batch.column(0), [signed(simhash(t.as_py())) for t in batch.column(1)]]

        return step

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, fp long")


def _through_least(reps: DataFrame, bits: int, *within: str) -> DataFrame:
    """(a, b), different, for rows (value, rep): in each ball of one bit around a value, every rep b and the least one a. A ball has bits + 1 values at most.

    Balls are made for each value of the columns `within` apart.
    """
    flips = F.array(F.lit(0).cast("long"), *(F.lit(signed(1 << k)) for k in range(bits)))
    variants = reps.select("rep", "value", *within, F.explode(flips).alias("flip")).select("rep", *within, F.col("value").bitwiseXOR(F.col("flip")).alias("variant"))
    least = variants.select(F.col("rep").alias("b"), F.min("rep").over(Window.partitionBy("variant", *within)).alias("a"))
    return least.filter("a <> b").select("a", "b").distinct()


def links(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b, linking all of `nodes` (column fp, all different) that are within RADIUS bits, each ball through its least member.

    Two members of a ball of one bit differ in two at most, so what meets needs no further test.
    """
    return _through_least(nodes.select(F.col("fp").alias("value"), F.col("fp").alias("rep")), 64)


def _met(items: DataFrame, *within: str) -> DataFrame:
    """(a, b) for rows (node, value): nodes with one value hang on the least of them, and the values meet in balls.

    A value that very many share so gathers none of them.
    """
    items = checkpoint(items)
    reps = checkpoint(items.groupBy("value", *within).agg(F.min("node").alias("rep"), F.count("*").alias("n")))
    both = F.xxhash64(*within, "value") if within else F.col("value")
    equal = join_keyed(items.select("node", both.alias("key")), reps.filter("n > 1").select(both.alias("key"), "rep", "n"), "key", "n").filter("node <> rep")
    return equal.select(F.col("rep").alias("a"), F.col("node").alias("b")).union(_through_least(reps, BAND_BITS, *within)).distinct()


def _verified(met: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, apart, alike): bits of the whole print that differ, and similarity by sketches."""
    one, other = (nodes.select(F.col("node").alias(c), F.col("bands").alias(f"{c}_bands"), F.col("sketch").alias(f"{c}_sketch")) for c in "ab")
    apart = F.aggregate(F.zip_with("a_bands", "b_bands", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    pairs = met.join(one, "a").join(other, "b").select("a", "b", apart.alias("apart"), "a_sketch", "b_sketch")

    def make():
        def step(batch: pa.RecordBatch):
            a, b, bits, x, y = batch.columns
            return [a, b, bits, [alike(p.as_py(), q.as_py()) for p, q in zip(x, y)]]

        return step

    return map_batches(pairs, make, "a long, b long, apart int, alike double")


def band_links(nodes: DataFrame) -> DataFrame:
    """(a, b) for rows (node, bands, slots, sketch) with different nodes: nodes within RADIUS bits in a band, in stars, verified on the whole print and by sketches.

    A star's centre can be a text that its members aren't like (one vocabulary), while they are like each other. Nodes of pairs
    that fail the sketches meet once more, in balls that are made for each value of a slot apart: texts alike to 0.8 have one
    of SLOTS in common with a probability of 0.998. What meets there is verified alike.
    """
    value = F.col("bits").bitwiseOR(F.shiftleft(F.col("band").cast("long"), BAND_BITS))
    every = nodes.select("node", "slots", F.posexplode("bands").alias("band", "bits")).select("node", "slots", value.alias("value"))
    first = checkpoint(_verified(checkpoint(_met(every.select("node", "value"))), nodes))
    failed = first.filter((F.col("alike") < LEAST_ALIKE) | (F.col("apart") > WHOLE_RADIUS))
    again = checkpoint(failed.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    good = first.filter((F.col("alike") >= LEAST_ALIKE) & (F.col("apart") <= WHOLE_RADIUS)).select("a", "b")
    if again.isEmpty():
        return good
    apart = every.join(again, "node").select("node", "value", F.posexplode("slots").alias("slot", "least"))
    second = _verified(checkpoint(_met(apart, "slot", "least")), nodes).filter((F.col("alike") >= LEAST_ALIKE) & (F.col("apart") <= WHOLE_RADIUS))
    return good.union(second.select("a", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of `edges` (a, b) reaches.

    Large-star and small-star steps in turn: a node's neighbours are hung on the least of them until nothing
    changes, in a logarithmic number of rounds. Minima are partial aggregates and each round is a checkpoint.
    """
    # columns computed anew carry no constraints over to the copy, over which the optimizer stumbles where they name other columns
    edges = checkpoint(edges.select(*(F.col(c).bitwiseOR(F.lit(0).cast("long")).alias(c) for c in "ab")))
    mark = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        down = large.filter("a < b").select(F.col("b").alias("a"), F.col("a").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).filter("x < y").distinct()
        edges = checkpoint(small.select(F.col("x").alias("a"), F.col("y").alias("b")))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select("a", "a").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every row: the smallest doc_id that is reachable over links, the row's own included.

    Null and empty texts have fingerprint zero and are linked like any other. A row with null doc_id gets its
    component's smallest id, null if there is none. Rows with equal ids are kept. Extra columns are ignored; no rows, none.
    """
    own = checkpoint(hashed(docs))
    nodes = checkpoint(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    classes = _classes(nodes, "fp", links(nodes.select("fp")))
    return join_keyed(own, classes.select("fp", "component_id", "n"), "fp", "n").select("doc_id", "fp", "component_id")


def _classes(nodes: DataFrame, node: str, edges: DataFrame) -> DataFrame:
    """nodes (with columns least and n) with the root and the smallest id of each one's component."""
    roots = checkpoint(components(edges)).withColumnRenamed("node", "_node")
    linked = checkpoint(nodes.join(roots, nodes[node] == roots["_node"], "left").select(node, "least", "n", F.coalesce("root", node).alias("root")))
    best = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    return checkpoint(join_keyed(linked, best, "root", "members").select(node, "n", "root", "component_id"))


def _with_prints(docs: DataFrame, name: str, only: bool = False) -> DataFrame:
    """docs (or doc_id alone) with the text's bands, slots and sketch in a column."""
    at = docs.columns.index("text")
    kind = struct("bands array<long>, slots array<long>, sketch binary")

    def make():
        def step(batch: pa.RecordBatch):
            made = [dict(zip(("bands", "slots", "sketch"), prints(t.as_py()))) for t in batch.column(at)]
            return [*([batch.column(0)] if only else batch.columns), made]

        return step

    kept = docs.schema.fields[:1] if only else docs.schema.fields
    return map_batches(docs, make, StructType([*kept, StructField(name, kind)]))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, the one of the smallest doc_id, with all columns.

    Groups are components over band_links; texts with one print (words and least shingles) are one node, and so are texts without any
    words. Where the smallest id repeats, the row with the least text of the group's own stays. Rows without doc_id stay. No rows, none.
    """
    printed = checkpoint(_with_prints(docs.select("doc_id", "text"), "p", only=True)).filter("doc_id is not null").select("doc_id", "p.*").withColumn("node", F.xxhash64("bands", "sketch"))
    nodes = checkpoint(printed.groupBy("node").agg(*(F.first(c).alias(c) for c in ("bands", "slots", "sketch")), F.min("doc_id").alias("least"), F.count("*").alias("n")))
    classes = _classes(nodes.select("node", "least", "n"), "node", band_links(nodes.select("node", "bands", "slots", "sketch")))
    name, kept_node, root, own, salt, nth = fresh(docs, "_kept_id", "_kept_node", "_root", "_own", "_salt", "_nth")
    # a component's smallest id is the least of one of its nodes; an id that repeats can be the least of several
    least = nodes.select("node", "least").join(classes.filter("component_id is not null"), "node").filter("least = component_id")
    keep = least.select(F.col("least").alias(name), F.col("node").alias(kept_node), F.col("root").alias(root))
    repeated = bool(printed.groupBy("doc_id").count().filter("count > 1").take(1))
    ids = keep.select(name).distinct().withColumn(salt, F.lit(0))
    # rows without an id match nothing and are spread, so one pass over docs serves both
    spread = docs.withColumn(own, F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(1024)).cast("int")).otherwise(0))
    met = spread.join(ids.hint("shuffle_hash"), (spread["doc_id"] == ids[name]) & (spread[own] == ids[salt]), "left").filter(F.col(name).isNotNull() | F.col("doc_id").isNull())
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if not repeated:
        return met.select(*columns)
    met = checkpoint(met.select(*columns))
    again = _with_prints(met.filter("doc_id is not null"), own).withColumn(own, F.xxhash64(F.col(own)["bands"], F.col(own)["sketch"]))
    again = again.join(keep, (again["doc_id"] == keep[name]) & (again[own] == keep[kept_node]))
    again = again.withColumn(nth, F.row_number().over(Window.partitionBy(name, root).orderBy("text"))).filter(F.col(nth) == 1)
    return again.select(*columns).unionByName(met.filter("doc_id is null"))
