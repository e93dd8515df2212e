"""SpotSigs document fingerprints.

A signature is a common word (the anchor) and the chain of the next content words after it. A text's
fingerprint is the set of its signatures' hashes, kept as one sorted hexadecimal string. Likeness is
the Jaccard coefficient of two sets; two sets whose sizes differ too much can't reach a threshold and
aren't compared, which is what partitioning by set length rests on.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import reachable
from .common import checkpoint, join_keyed, map_batches, small_batches
from .simhash import components

# Common words of English, German, French and Spanish.
ANCHORS = frozenset("""
the a an of and to in is it that this for on as with was be by are from or at not have has had
der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er
le la les de et un une du en que qui dans est pour au sur pas par avec ne se ce il elle
el los las y del por una su al lo con no como más pero sus
""".split())
CHAIN = 3
_TOKEN = re.compile(r"\w+")


def signatures(text: str, chain: int = CHAIN) -> frozenset[int]:
    """Hashes of the chains that follow anchors. A text with words but no such chain counts every word as an anchor,
    and a shorter one is a single chain, so only a text without words has no signature."""
    words = _TOKEN.findall(text.lower())
    content, starts = [], []
    for w in words:
        if w in ANCHORS:
            starts.append((w, len(content)))
        else:
            content.append(w)
    last = len(content) - chain
    found = {f"{a} {' '.join(content[i : i + chain])}" for a, i in starts if i <= last}
    if not found and words:
        found = {" ".join(words[i : i + chain]) for i in range(max(1, len(words) - chain + 1))}
    return frozenset(xxhash.xxh32_intdigest(s) for s in found)


def encode(found: frozenset[int]) -> str:
    return np.array(sorted(found), ">u4").tobytes().hex()


def decode(fingerprint: str) -> frozenset[int]:
    return frozenset(np.frombuffer(bytes.fromhex(fingerprint), ">u4").tolist())


def jaccard(a: frozenset[int], b: frozenset[int]) -> float:
    """1.0 for two empty sets."""
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def edited(text: str, following: str) -> str:
    """The text with its last quarter (rounded down, in code points) replaced by as many of the following text's first, or all of them."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


#: Rows of one range of ids, the most ranges that the driver lays out, and the ids that it draws for each.
RANGE_ROWS, MAX_RANGES, DRAWN = 4000, 20_000, 100


def _ranges(docs: DataFrame) -> list[int]:
    """Ids that split the documents into ranges of about equal size, from a hash sample of bounded size; their number is bounded."""
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull())
    rows = ids.count()
    n = min(MAX_RANGES, rows // RANGE_ROWS)
    if n < 1:
        return []
    drawn = ids.distinct().filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(min(1.0, DRAWN * n / rows) * (1 << 40)))
    found = np.sort(drawn.toArrow().column(0).to_numpy())
    return sorted({int(found[k * len(found) // (n + 1)]) for k in range(1, n + 1)}) if len(found) else []


def _constant(values: list, kind: str) -> Column:
    """A long list as one literal, which the optimizer folds."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _range_of(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are below a value (null: 0), looked up in two steps of about the root of their number."""
    width = math.isqrt(len(cuts)) + 1
    parts = [cuts[k : k + width] for k in range(0, len(cuts), width)]

    def below(found: Column) -> Column:
        return F.size(F.filter(found, lambda c: c < value))

    part = F.greatest(below(_constant([p[0] for p in parts], "array<bigint>")) - 1, F.lit(0))
    return F.coalesce(part * width + below(F.element_at(_constant(parts, "array<array<bigint>>"), part + 1)), F.lit(0))


def with_following(docs: DataFrame) -> DataFrame:
    """Rows (range, copy, doc_id, text), a partition for each range in the order of ids; a row with copy = 1 ends a range: the first row of the next.

    Texts are shuffled once, each range to a partition of its own. The rows copied are one for each range, whose number
    is bounded; above MAX_RANGES * RANGE_ROWS rows ranges grow, and a range is sorted by Spark, which can spill. Rows
    without an id are one range, as are rows of one id.
    """
    cuts = _ranges(docs)
    at = _range_of(F.col("doc_id"), cuts) if cuts else F.lit(0)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("range", F.when(F.col("doc_id").isNull(), 0).otherwise(at).cast("int"))
    first = {r.range: r.first for r in rows.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), F.col("doc_id").alias("id"))).alias("first")).collect()}
    order = sorted(first)
    homes = {r: order[k - 1] for k, r in enumerate(order)}  # the first range's first row ends the last range
    every = range(len(cuts) + 1)
    first_id = F.element_at(_constant([first[r].id if r in first else None for r in every], "array<bigint>"), F.col("range") + 1)
    home = F.element_at(_constant([homes.get(r) for r in every], "array<int>"), F.col("range") + 1)
    copies = F.when(F.col("doc_id").eqNullSafe(first_id), home)
    both = F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("copy")), F.struct(copies.alias("range"), F.lit(1).alias("copy")))
    spread = rows.select("doc_id", "text", F.explode(F.filter(both, lambda x: x["range"].isNotNull())).alias("to")).select("to.range", "to.copy", "doc_id", "text")
    return spread.repartitionById(len(cuts) + 1, "range").sortWithinPartitions("range", "copy", "doc_id", "text")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """Fingerprint of every text (null: empty) and of its edited text, with likenesses to the edited and the next text.

    Documents follow each other by doc_id (null first), equal ids by text; the first follows the last, so
    a single document follows itself. Extra columns are ignored; no documents, no rows.
    """

    def make():
        held: list = []  # the row whose following text is still to come: range, doc_id, text, signatures

        def row(own, text, found):
            _, doc_id, mine, sigs = own
            other = edited(mine, text)
            new = signatures(other, chain)
            return (doc_id, len(mine), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), encode(sigs), encode(new), jaccard(sigs, new), jaccard(sigs, found))

        def step(batch: pa.RecordBatch):
            rows = []
            for at, copy, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                text = text.as_py()
                if copy and not held:
                    continue  # more copies of one id
                found = signatures(text, chain)
                if held:
                    rows.append(row(held.pop(), text, found))
                if not copy:
                    held.append((at, doc_id, text, found))
            return list(zip(*rows)) if rows else None

        return step

    return map_batches(with_following(docs), make, OUT)


def length_bounds(threshold: Fraction, longest: int) -> list[int]:
    """Least set lengths of the partitions up to `longest`: sets in partitions that aren't equal or adjacent can't reach the threshold."""
    bounds = [1]
    while bounds[-1] <= longest:
        bounds.append(bounds[-1] * threshold.denominator // threshold.numerator + 1)
    return bounds


def similar(a: frozenset[int], b: frozenset[int], threshold: Fraction) -> bool:
    """Pruned Jaccard: whether two sets reach the threshold, in whole numbers; lengths are compared first."""
    if min(len(a), len(b)) * threshold.denominator < max(len(a), len(b)) * threshold.numerator:
        return False
    both = len(a & b)
    return both * threshold.denominator >= (len(a) + len(b) - both) * threshold.numerator


def _indexed(prints: DataFrame, at_least: Fraction) -> DataFrame:
    """(fingerprint, size, part, sig) of different fingerprints: each in its length partition under the rarest hashes of its set, a prefix that any partner must share."""
    num, den = at_least.numerator, at_least.denominator
    classes = checkpoint(prints.select("fingerprint").filter("fingerprint <> ''").distinct())
    longest = (classes.agg(F.max(F.length("fingerprint"))).first()[0] or 0) // 8
    one = F.transform(F.expr("sequence(0, length(fingerprint) div 8 - 1)"), lambda i: F.substr("fingerprint", i.cast("int") * 8 + 1, F.lit(8)))
    sigs = classes.select("fingerprint", F.explode(one).alias("sig"))
    ranked = sigs.join(sigs.groupBy("sig").agg(F.count("*").alias("n")), "sig").groupBy("fingerprint").agg(F.sort_array(F.collect_list(F.struct("n", "sig"))).alias("s"))
    size = F.size("s").cast("long")
    part = F.size(F.filter(_constant(length_bounds(at_least, longest), "array<bigint>"), lambda b: b <= size))
    prefix = size - F.floor((size * num + (den - 1)) / den) + 1
    return checkpoint(ranked.select("fingerprint", size.alias("size"), part.alias("part"), F.explode(F.slice("s", F.lit(1), prefix.cast("int"))["sig"]).alias("sig")))


def similar_pairs(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(fingerprint_a, fingerprint_b, likeness) of different fingerprints at `threshold` or more; prints has a column fingerprint.

    Equal fingerprints are one class first. A class is indexed in its length partition under the rarest hashes of
    its set, so no frequent signature gathers the corpus and no pair is lost: all bounds are whole numbers. Null and empty fingerprints
    have no partner; no rows, none. Classes that are all similar to each other have a pair for each two: similar_classes says
    the same of k of them in k rows.
    """
    at_least = Fraction(str(threshold))
    num, den = at_least.numerator, at_least.denominator
    keys = _indexed(prints, at_least)
    left = keys.select(F.col("fingerprint").alias("a"), F.col("size").alias("na"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), F.col("part").alias("own"))
    right = keys.select(F.col("fingerprint").alias("b"), F.col("size").alias("nb"), "sig", "part")
    near = left.join(right, ["sig", "part"]).filter((F.col("own") < F.col("part")) | (F.col("a") < F.col("b")))
    near = near.filter(F.least("na", "nb") * den >= F.greatest("na", "nb") * num).select("a", "b").distinct()

    def make():
        def step(batch: pa.RecordBatch):
            rows = [(a, b, jaccard(p, q)) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if similar(p := decode(a), q := decode(b), at_least)]
            return list(zip(*rows)) if rows else None

        return step

    return map_batches(near, make, "fingerprint_a string, fingerprint_b string, likeness double")


def class_links(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """fingerprint, n_docs, n_links of each class of equal fingerprints: its rows, and the other classes that it is similar to."""
    pairs = similar_pairs(prints, threshold)
    ends = pairs.select(F.explode(F.array("fingerprint_a", "fingerprint_b")).alias("fingerprint")).groupBy("fingerprint").agg(F.count("*").alias("n_links"))
    own = prints.select("fingerprint").groupBy("fingerprint").agg(F.count("*").alias("n_docs"))
    return own.join(ends, "fingerprint", "left").select("fingerprint", "n_docs", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _forest(keys: DataFrame, at_least: Fraction) -> DataFrame:
    """(a, b): similar fingerprints, so many that those which pairs connect within a bucket are connected, and one fewer than they are.

    A bucket (hash, length partition) is read in order by one task. A member is compared with those before it only as long as they aren't connected
    to it already, so k variants of one text cost k comparisons and k rows. The task holds the bucket's members: those that share one
    of their rarest hashes and are of one length.
    """
    home = keys.select("sig", "part", F.lit(0).alias("visits"), "fingerprint")
    both = home.unionByName(keys.select("sig", (F.col("part") + 1).alias("part"), F.lit(1).alias("visits"), "fingerprint"))

    def run(batches):
        now, held, root = None, [], []

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for batch in batches:
            out = []
            for sig, part, visits, mine in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (sig, part):
                    now, held, root = (sig, part), [], []
                own, k = decode(mine), len(held)
                held.append((visits, mine, own))
                root.append(k)
                for other in range(k):
                    there, name, theirs = held[other]
                    if not (visits and there) and find(other) != find(k) and similar(own, theirs, at_least):  # visitors meet at home
                        root[find(k)] = find(other)
                        out.append((name, mine))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["a", "b"])

    small_batches(reachable(keys.sparkSession))
    return both.repartition("sig", "part").sortWithinPartitions("sig", "part", "visits", "fingerprint").mapInArrow(run, "a string, b string")


def similar_classes(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(fingerprint, n_docs, class_fingerprint, class_size) of each different fingerprint: its rows, the least fingerprint that links of `threshold` or more lead to, and how many different ones do.

    All links count, none is dropped; what is written is a row for each fingerprint and an edge or two, not a pair for each two of a
    family. Null fingerprints have no row, the empty one is a class of its own; no rows, none.
    """
    at_least = Fraction(str(threshold))
    nodes = checkpoint(prints.filter("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("n_docs")).withColumn("id", F.xxhash64("fingerprint")))
    edges = checkpoint(_forest(_indexed(prints, at_least), at_least).distinct())
    roots = checkpoint(components(edges.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))))
    linked = checkpoint(nodes.join(roots, nodes["id"] == roots["node"], "left").select("fingerprint", "n_docs", F.coalesce("root", "id").alias("root")))
    best = linked.groupBy("root").agg(F.min("fingerprint").alias("class_fingerprint"), F.count("*").alias("class_size"))
    return join_keyed(linked, best.withColumn("_n", F.col("class_size")), "root", "_n").select("fingerprint", "n_docs", "class_fingerprint", "class_size")
