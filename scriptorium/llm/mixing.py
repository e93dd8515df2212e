"""Mixing sources to target weights.

Words are summed for each source, targets follow from weights by water-filling, and a source's rate
is target / size. Two steps give a document's copies:

1. the draw: floor(rate) copies, and one more by a Bernoulli draw, seeded by a hash of its id, whose probability is
   the rate's fraction;
2. the correction: the words drawn stray from the target as sums of random size do (by 1 to 2 % in the mean and 4 to 7 % at most over sources of
   2,500 documents and more, by 10 and 57 % over sources of 50). What is missing or too much then is made up by few documents of the source that no
   draw chose, or that one did, taken in the order of a second hash: one copy more or less of each, until the middle of
   the next one's words lies beyond. None has more words than were missing.

The draw decides for all documents but those that the correction takes, whose words are the draw's error and so a vanishing
share as sources grow. `correct=False` leaves the draws alone. Nothing larger than a row for each source and hash bucket
is gathered, and only sums reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, fresh

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "mix-1"
BUCKET_BITS, HASH_BITS = 12, 60
#: Bytes of the table of sources up to which it is broadcast; beyond it Spark joins by shuffle.
BROADCAST_BYTES = 8_000_000


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number below 2**60 from a hash of the id; a null id draws like the empty string."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with their place (from 0) by code point, null last; sorted by range, without one task for all."""
    parts = sources.withColumn("_null", F.col("source").isNull()).repartitionByRange(8, "_null", "source").withColumn("_part", F.spark_partition_id())
    parts = checkpoint(parts)
    first, before = F.lit(0), 0
    for r in sorted(parts.groupBy("_part").agg(F.count("*").alias("n")).collect()):  # a row for each range
        first = F.when(F.col("_part") == r._part, before).otherwise(first)
        before += r.n
    own = Window.partitionBy("_part").orderBy("_null", "source")
    return parts.withColumn("place", F.row_number().over(own) - 1 + first).drop("_null", "_part")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target of rows (source, size): shares of all sizes by weight, none above max_repeats times its size."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = checkpoint(_ranked(sources).withColumn("weight", weight))
    level, capped = 0.0, -1
    whole = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    while True:  # the level only rises; a source that is full stays full
        full = F.col("weight") * F.lit(level) >= F.col("source_size") * max_repeats if capped >= 0 else F.lit(False)
        n, used, open_weight = sources.agg(
            F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, F.col("source_size") * max_repeats)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))
        ).first()
        if n == capped or not open_weight:
            break
        level, capped = (whole - used) / open_weight, n
    target = F.least(F.col("weight") * F.lit(level), (F.col("source_size") * max_repeats).cast("double"))
    return sources.select("source", "source_size", target.alias("target"))


def _near(df: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """df with the columns of its source, null sources included."""
    own = sources.withColumnRenamed("source", "_source")
    return df.join(F.broadcast(own) if few else own, df["source"].eqNullSafe(own["_source"])).drop("_source")


def rates(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED, correct: bool = True) -> tuple[DataFrame, DataFrame, bool]:
    """(doc_id, source, size) of all documents with two hashes of their ids, draw and place; a row (source, source_size, target, times, chance, need, upto) for each source; whether those are few.

    `chance` is the fraction of 2**HASH_BITS, `need` the words that the draws leave missing (below 0: that they have too much), and
    `upto` the last place that the correction takes. A source's candidates are put in order within one bucket of
    2**BUCKET_BITS, so that a task sorts a 4096th of a source's rows, a few numbers each.
    """
    sized = checkpoint(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), draw(F.col("doc_id"), seed).alias("draw"), draw(F.col("doc_id"), f"{seed}-again").alias("place")))
    goal = targets(sized, weights, max_repeats)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("times", times).withColumn("more", F.col("target") - F.col("times") * F.col("source_size"))
    goal = goal.withColumn("chance", F.when(F.col("source_size") > 0, F.col("more") / F.col("source_size")).otherwise(0.0) * F.lit(float(1 << HASH_BITS)))
    few = (goal.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64)).first()[0] or 0) <= BROADCAST_BYTES
    hits = _near(sized, goal.select("source", "chance"), few).groupBy("source").agg(F.coalesce(F.sum(F.when(F.col("draw") < F.col("chance"), F.col("size"))), F.lit(0)).alias("_words"))
    hits = hits.withColumnRenamed("source", "_of")
    need = F.col("more") - F.col("_words") if correct else F.lit(0.0)
    goal = checkpoint(goal.join(hits, goal["source"].eqNullSafe(hits["_of"])).select("source", "source_size", "target", "times", "chance", need.alias("need")))
    candidates = _near(sized, goal.select("source", "chance", "need"), few).filter(_candidate())
    bucket = F.shiftright("place", HASH_BITS - BUCKET_BITS)
    missing = F.abs("need")
    by_bucket = candidates.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.first("need").alias("need"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cum = by_bucket.select("source", "bucket", "need", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"), F.sum("words").over(so_far).alias("after"))
    crossing = cum.filter(F.col("after") > missing).groupBy("source").agg(F.min(F.struct("bucket", "before")).alias("c")).select("source", "c.*")
    inside = _near(candidates.withColumn("own", bucket), crossing, few).filter(F.col("own") == F.col("bucket"))
    inside = inside.groupBy("source", "bucket", "before", "need", "place").agg(F.sum("size").alias("words"))  # rows with one id go together
    own = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("middle", F.col("before") + F.sum("words").over(own) - F.col("words") / 2)
    last = inside.groupBy("source").agg(
        F.coalesce(F.max(F.when(F.col("middle") <= missing, F.col("place"))), F.first("bucket") * F.lit(1 << (HASH_BITS - BUCKET_BITS)) - 1).alias("upto")
    )
    last = last.withColumnRenamed("source", "_of")
    ends = goal.join(last, goal["source"].eqNullSafe(last["_of"]), "left")  # no end where all candidates are too few
    return sized, checkpoint(ends.select("source", "source_size", "target", "times", "chance", "need", F.coalesce("upto", F.lit((1 << HASH_BITS) - 1)).alias("upto"))), few


def _hit() -> Column:
    return F.col("draw") < F.col("chance")


def _candidate() -> Column:
    """Documents that the correction may take: none has more words than it needs."""
    return (F.col("need") != 0) & (_hit() == (F.col("need") < 0)) & (F.col("size") <= F.abs("need"))


def drawn() -> Column:
    """Step 1: copies by rate, the last one with the probability of the fraction."""
    return F.col("times") + _hit().cast("long")


def correction() -> Column:
    """Step 2: 1 or -1 copies for the documents that it takes, 0 for all others."""
    return F.when(_candidate() & (F.col("place") <= F.col("upto")), F.when(F.col("need") > 0, 1).otherwise(-1)).otherwise(0).cast("long")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, drawn, corrected of every document: words taken, copies drawn, and copies that the correction adds.

    Null texts have no words and null sources are one source. Rows with equal ids share a draw. A
    source without words takes none. Extra columns are ignored; no documents, no rows.
    """
    sized, ends, few = rates(docs, **options)
    return _near(sized, ends, few).select("doc_id", "size", "source_size", "target", (F.col("size") * (drawn() + correction())).alias("taken"), drawn().alias("drawn"), correction().alias("corrected"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is drawn and corrected, with the columns it had. Nulls, ties and empty tables as in mix_report."""
    _, ends, few = rates(docs, **options)
    seed = options.get("seed", SEED)
    row, copy = fresh(docs.select(*(F.lit(0).alias(c) for c in ("source", *ends.columns))), "_row", "_copy")
    figures = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row), "source", size_of(F.col("text")).alias("size"), draw(F.col("doc_id"), seed).alias("draw"), draw(F.col("doc_id"), f"{seed}-again").alias("place"))
    copies = drawn() + correction()
    every = F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies)).otherwise(F.array().cast("array<bigint>"))
    return _near(figures, ends, few).withColumn(copy, F.explode(every)).select(*(F.col(row)[c].alias(c) for c in docs.columns))
