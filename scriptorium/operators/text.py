"""Cleaning, normalising and lowering of texts: chains of rules, one narrow stage each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import rules as R


def clean(text: Column) -> Column:
    """The cleaned text with prosody markers; null and blank texts stay as they are."""
    return R.in_batches(text, R.CLEAN, blank=False)


def clean_stats(df: DataFrame, column: str = "text", *keys: str) -> DataFrame:
    """keys, original_length, cleaned_length, patterns_applied, transformations_made, compression_ratio, characters_removed.

    A column for each removal and transform rule keeps the chain linear; nothing is evaluated twice.
    """
    steps = df.select(*keys, F.coalesce(column, F.lit("")).alias("s0"))
    rules = R.REMOVE + R.TRANSFORM
    for k, rule in enumerate(rules):
        steps = steps.withColumn(f"s{k + 1}", rule.spark(F.col(f"s{k}")))
    changed = [F.when(F.col(f"s{k}") != F.col(f"s{k + 1}"), 1).otherwise(0) for k in range(len(rules))]
    out = steps.select(
        *keys, F.length("s0").cast("long").alias("original_length"), F.length(R.apply(F.col(f"s{len(rules)}"), R.CHARACTERS + R.SPACING + R.PAUSES)).cast("long").alias("cleaned_length"),
        sum(changed[1:], changed[0]).cast("long").alias("patterns_applied"), sum(changed[len(R.REMOVE) + 1 :], changed[len(R.REMOVE)]).cast("long").alias("transformations_made"),
    )
    ratio = F.when(F.col("original_length") == 0, 0.0).otherwise(F.round(F.col("cleaned_length") / F.col("original_length"), 6))
    return out.withColumn("compression_ratio", ratio).withColumn("characters_removed", F.col("original_length") - F.col("cleaned_length"))


def lower(text: Column, style: str = "plain") -> Column:
    """Markers lowered for a speech back end: plain, ssml or ellipsis."""
    return R.in_batches(text, R.LOWERINGS[style])


def normalise(text: Column) -> Column:
    return R.in_batches(text, R.MODERN)


def phoneme_safe(text: Column) -> Column:
    return R.apply(text, R.PHONEME)


def spaced(text: Column) -> Column:
    """Words with one space between them."""
    return F.trim(F.regexp_replace(text, R.JAVA_RUNS, " "))


def word_count(text: Column) -> Column:
    """Words between white space of all kinds; 0 for null. Single spaces are counted: no word is made a string of its own."""
    # a lambda's variable is computed once, however often it is used
    n = F.transform(F.array(spaced(text)), lambda v: F.when(v == "", 0).otherwise(F.octet_length(v) - F.octet_length(F.replace(v, F.lit(" "), F.lit(""))) + 1))
    return F.coalesce(F.element_at(n, 1), F.lit(0)).cast("long")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(R.STRIPPED))


def slug(title: Column, size: int = 20) -> Column:
    """Letters, digits, spaces, hyphens and underscores, spaces as underscores, cut to size."""
    return F.substring(F.replace(F.regexp_replace(title, r"[^\p{L}\p{N} _-]", ""), F.lit(" "), F.lit("_")), 1, size)
