"""Exact dedup by content sort, with DataFrame functions only.

Rows are dealt by range over (first bytes, hash, salt) of their normalised text: Spark samples the splitters, and a splitter is a
few bytes however long texts are. Within a range an external sort puts equal texts side by side, and rows belong together
only if neighbours are equal as a whole; first bytes and hash just make most comparisons short.

A text of more than 1/HOT_SHARE of all rows (and LEAST_HOT rows) is dealt over several places by a hash of the rows' ids, the salt.
Its parts then meet once more, one row each, and are compared as a whole again. There are fewer such texts than HOT_SHARE
and at most 2 * HOT_SHARE parts, whatever the data, so both tables have a bound and are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, fresh

#: Bytes of a text in a splitter.
PREFIX_CHARS = 32
HOT_SHARE, LEAST_HOT = 10_000, 256


def as_is(text: Column) -> Column:
    """No change; null counts as empty."""
    return F.coalesce(text, F.lit(""))


def squeezed(text: Column) -> Column:
    """ASCII white space as one space, trimmed, A-Z as a-z; null counts as empty."""
    plain = F.trim(F.regexp_replace(as_is(text), r"[\x20\x09-\x0D]+", " "))
    return F.translate(plain, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _sorted(rows: DataFrame, keep: str) -> DataFrame:
    """rows (doc_id, _text and others) with _place from 1, _size and _best of their part, _part of a hot text's parts, and _hash."""
    rows = rows.withColumns({"_prefix": F.substring("_text", 1, PREFIX_CHARS), "_hash": F.xxhash64("_text")})
    least = max(rows.count() // HOT_SHARE, LEAST_HOT)
    hot = rows.groupBy(F.col("_hash").alias("_hot")).agg(F.count("*").alias("_n")).filter(F.col("_n") > least)
    hot = hot.select("_hot", F.ceil(F.col("_n") / least).cast("int").alias("_parts"))
    salted = rows.join(F.broadcast(hot), F.col("_hash") == F.col("_hot"), "left")
    salted = salted.withColumn("_salt", F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("_parts"))).otherwise(-1).cast("int"))
    dealt = salted.drop("_hot", "_parts").repartitionByRange("_prefix", "_hash", "_salt").withColumn("_at", F.monotonically_increasing_id())
    # partitions by range hold whole parts already, so these windows sort and compare neighbours without another exchange
    part = Window.partitionBy("_prefix", "_hash", "_salt", "_text")
    order = F.col("doc_id").desc_nulls_last() if keep == "largest" else F.col("doc_id").asc_nulls_last()
    return dealt.withColumns({
        "_place": F.row_number().over(part.orderBy(order)),
        "_best": F.first("doc_id").over(part.orderBy(order)),
        "_size": F.count("*").over(part.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "_part": F.when(F.col("_salt") >= 0, F.first("_at").over(part.orderBy(order))),
    })


def _groups(heads: DataFrame, keep: str) -> DataFrame:
    """_of, _all_best, _all_size, _winner for each part of a hot text, from its first row."""
    best = (F.max_by if keep == "largest" else F.min_by)(F.struct("_best", "_part"), F.struct(F.col("_best").isNull() if keep == "smallest" else F.col("_best").isNotNull(), "_best", "_part"))
    # a part more than the texts' own: one row for each hot text comes back to its parts through the hash and the whole text
    whole = heads.groupBy("_hash", "_text").agg(best.alias("_b"), F.sum("_size").alias("_all_size"), F.collect_list("_part").alias("_parts"))
    return whole.select(F.explode("_parts").alias("_of"), F.col("_b._best").alias("_all_best"), "_all_size", F.col("_b._part").alias("_winner"))


def _checked(keep: str) -> None:
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep}")


def exact_duplicates(docs: DataFrame, normalise: Callable[[Column], Column] = as_is, keep: str = "smallest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row: of rows equal after `normalise` the one of the smallest (or largest) doc_id stays.

    A null text counts as empty. Of rows with the id that stays, repeated, one is kept; rows without id stay only where
    none of their group has one, and then one does, with keep_id null. Extra columns are ignored; no rows, none.
    """
    _checked(keep)
    rows = docs.select("doc_id", normalise(F.col("text")).alias("_text"))
    head = F.when((F.col("_place") == 1) & (F.col("_salt") >= 0), F.col("_text"))
    slim = checkpoint(_sorted(rows, keep).select("doc_id", "_hash", "_place", "_size", "_best", "_part", F.sha2("_text", 256).alias("text_sha256"), head.alias("_text")))
    of = _groups(slim.filter(F.col("_text").isNotNull()), keep)
    met = slim.drop("_text").join(F.broadcast(of), F.col("_part") == F.col("_of"), "left")
    kept = (F.col("_place") == 1) & (F.col("_part").isNull() | (F.col("_part") == F.col("_winner")))
    keep_id = F.when(F.col("_part").isNull(), F.col("_best")).otherwise(F.col("_all_best"))
    return met.select("doc_id", keep_id.alias("keep_id"), F.coalesce("_all_size", "_size").alias("group_size"), kept.alias("kept"), "text_sha256")


def one_of_equals(docs: DataFrame, normalise: Callable[[Column], Column] = as_is, keep: str = "smallest") -> DataFrame:
    """The rows of docs that stay, with all their columns; nulls, ties, repeats and empty tables as in exact_duplicates."""
    _checked(keep)
    (whole,) = fresh(docs.select(F.lit(0).alias("doc_id"), F.lit(0).alias("_text")), "_row")
    rows = docs.select("doc_id", normalise(F.col("text")).alias("_text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(whole))
    first = checkpoint(_sorted(rows, keep).filter("_place = 1").select("_hash", "_text", "_size", "_best", "_part", whole))
    of = _groups(first.filter(F.col("_part").isNotNull()).select("_hash", "_text", "_size", "_best", "_part"), keep)
    met = first.join(F.broadcast(of.select("_winner").distinct()), F.col("_part") == F.col("_winner"), "left")
    return met.filter(F.col("_part").isNull() | F.col("_winner").isNotNull()).select(*(F.col(whole)[c].alias(c) for c in docs.columns))
