"""Chapters by sentence: heading candidates, their union and filter, spans, and the choice between ways of processing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import rules as R
from ..plans.session import once
from . import chapters as C
from .language import with_proper_noun
from .text import clean, normalise, strip, word_count

MODES = ("legacy", "modern", "hybrid")
CANDIDATE = ("start", "method", "title", "confidence")


def is_heading(sentence: Column) -> Column:
    """At most ten words, in title case or capitals; the reference's patterns never match. Its proper-noun branch is sentence_candidates'."""
    return (C.is_title(sentence) | C.is_upper(sentence)) & (word_count(sentence) <= 10)  # most fail at their second word


def sentence_candidates(df: DataFrame, text: str, key: str, proper: DataFrame | None = None) -> DataFrame:
    """(key, start, method 0, title, confidence) of sentences that look like headings; text is normalised, so one space parts sentences.

    With proper nouns (word), sentences of at most ten words that hold one, capitalised, are headings too; key must tell texts apart then.
    """
    sentences = df.select(key, F.posexplode(F.split(text, "(?<=[.!?]) ", -1)).alias("_k", "title"))
    before = Window.partitionBy(key).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    placed = sentences.withColumn("start", F.coalesce(F.sum(F.length("title") + 1).over(before), F.lit(0)).cast("long"))
    shaped = (F.col("title") != "") & is_heading(F.col("title"))
    if proper is None:
        found = placed.filter(shaped)
    else:  # both branches read what is short; the rest of the text is gone by then
        short = placed.filter((F.col("title") != "") & (word_count(F.col("title")) <= 10)).withColumn("_shaped", is_heading(F.col("title")))
        named = with_proper_noun(short.filter(~F.col("_shaped")), proper, "title", key, "_k").withColumn("_named", F.lit(True))
        found = short.join(named, [key, "_k"], "left").filter(F.col("_shaped") | F.col("_named"))
    return found.select(key, "start", F.lit(0).alias("method"), "title", C.heading_confidence(F.col("title")).alias("confidence"))


def structural_candidates(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, start, method 1, title, confidence 0.6) of paragraphs of at most ten words before one of more than fifty; start is the title's first occurrence."""
    paragraphs = df.select(key, F.col(text).alias("_t"), F.split(text, "\n\n", -1).alias("_ps"))
    # the last paragraph has none after it, and a text without blank lines has no other: most texts end here
    rows = paragraphs.filter(F.size("_ps") > 1).select(key, "_t", F.explode(F.arrays_zip(F.expr("slice(_ps, 1, size(_ps) - 1)").alias("p"), F.expr("slice(_ps, 2, size(_ps))").alias("n"))).alias("x"))
    rows = rows.select(key, "_t", strip(F.col("x.p")).alias("title"), F.col("x.n").alias("_next"))
    rows = rows.filter((F.col("title") != "") & (word_count(F.col("title")) <= 10) & (word_count(F.col("_next")) > 50))
    return rows.select(key, (F.expr("locate(title, _t)") - 1).cast("long").alias("start"), F.lit(1).alias("method"), "title", F.lit(0.6).alias("confidence"))


def candidates(df: DataFrame, text: str, key: str, proper: DataFrame | None = None) -> DataFrame:
    """Sentence and structural candidates, repeated ones too."""
    return sentence_candidates(df, text, key, proper).unionByName(structural_candidates(df, text, key))


def by_candidates(df: DataFrame, found: DataFrame, text: str, key: str) -> DataFrame:
    """Chapters between the candidates that the greedy filter leaves: from a title's end to the next start.

    Blank bodies are dropped and keep their number; a text without chapters is one, "Full Document", at 0.5.
    """
    listed = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*CANDIDATE))).alias("_c"))
    listed = listed.select(key, C.nms(F.transform("_c", lambda c: F.struct(c["start"].alias("start"), c["confidence"].alias("confidence"), c["title"].alias("title")))).alias("_kept"))
    both = df.select(key, F.col(text).alias("_t")).join(listed, key, "left").withColumn("_kept", F.coalesce("_kept", F.array().cast(C.CANDIDATES)))
    after = F.expr("slice(_kept, 2, size(_kept))")

    def body(pair: Column) -> Column:
        at = pair["c"]["start"] + F.length(pair["c"]["title"])
        stop = F.coalesce(pair["n"]["start"], F.length("_t"))
        return F.struct(pair["c"]["title"].alias("title"), strip(F.substr(F.col("_t"), (at + 1).cast("int"), F.greatest(stop - at, F.lit(0)).cast("int"))).alias("content"), pair["c"]["confidence"].alias("confidence"))

    spans = F.transform(F.arrays_zip(F.col("_kept").alias("c"), after.alias("n")), body)
    numbered = F.filter(F.transform(spans, lambda s, i: F.struct((i + 1).cast("long").alias("chapter_num"), s["title"].alias("title"), s["content"].alias("content"), s["confidence"].alias("confidence"))), lambda s: s["content"] != "")
    whole = F.array(F.struct(F.lit(1).cast("long").alias("chapter_num"), F.lit("Full Document").alias("title"), F.col("_t").alias("content"), F.lit(0.5).alias("confidence")))
    listed = once(both.select(key, "_t", numbered.alias("_n")), "_s", F.when(F.size("_n") > 0, F.col("_n")).otherwise(whole))
    return C.measured(listed.select(key, F.explode("_s").alias("s")).select(key, "s.*"))


def modern(df: DataFrame, text: str, key: str, toc: DataFrame | None = None, proper: DataFrame | None = None) -> DataFrame:
    """Normalised text, then the table of contents if there is one, else candidates, with those of proper nouns if these are given."""
    # dealt by key once more: all that follows reads the normalised texts there, none normalises them again
    cleaned = once(df.select(key, normalise(F.col(text)).alias("_whole")).repartition(key), "_text", F.col("_whole")).select(key, "_text")
    if toc is not None:
        return C.by_toc(cleaned, toc, "_text", key)
    return by_candidates(cleaned, candidates(cleaned, "_text", key, proper), "_text", key)


def legacy(df: DataFrame, text: str, key: str) -> DataFrame:
    cleaned = once(df.select(key, F.col(text).alias("_raw")), "_text", clean(F.col("_raw"))).select(key, "_text")
    return C.segment(cleaned, "_text", key)


def process(df: DataFrame, text: str, key: str, mode: str = "legacy", toc: DataFrame | None = None) -> DataFrame:
    """Chapters (key, chapter_num, title, content, word_count, estimated_duration, confidence) by mode.

    hybrid cleans first; with a table of contents it goes on as modern does, without one it cleans once more and goes on as
    legacy does. An unknown mode raises ValueError.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if mode == "legacy":
        return legacy(df, text, key)
    if mode == "modern":
        return modern(df, text, key, toc)
    cleaned = once(df.select(key, F.col(text).alias("_first")), "_cleaned", clean(F.col("_first"))).select(key, "_cleaned")
    return modern(cleaned, "_cleaned", key, toc) if toc is not None else legacy(cleaned, "_cleaned", key)


def all_modes(df: DataFrame, text: str, key: str) -> DataFrame:
    """process() in every mode, without a table of contents, with a column mode. legacy and hybrid share their cleaning and are cut in one pass."""
    first = once(df.select(key, F.col(text).alias("_raw")), "_l", clean(F.col("_raw"))).select(key, "_l")
    both = once(first, "_h", clean(F.col("_l"))).select(F.explode(F.array(F.struct(F.lit("legacy").alias("mode"), F.col(key).alias("k"), F.col("_l").alias("t")), F.struct(F.lit("hybrid").alias("mode"), F.col(key).alias("k"), F.col("_h").alias("t")))).alias("_x"))
    cut = C.segment(both.select(F.struct("_x.mode", "_x.k").alias("_key"), F.col("_x.t").alias("_text")), "_text", "_key")
    old = cut.select(F.col("_key.mode").alias("mode"), F.col("_key.k").alias(key), *(c for c in cut.columns if c != "_key"))
    return old.unionByName(modern(df, text, key).withColumn("mode", F.lit("modern")))


def with_contents(df: DataFrame, text: str, key: str, toc: DataFrame, mode: str = "modern") -> DataFrame:
    """process() for texts of which some have contents: those with entries in toc (key, pos, title) go by them, the others as if there were none."""
    have = toc.select(key).distinct()
    return process(df.join(have, key, "left_semi"), text, key, mode, toc).unionByName(process(df.join(have, key, "left_anti"), text, key, mode))


def clean_only(text: Column, mode: str = "legacy") -> Column:
    """The cleaned text without chapters: normalised in mode modern, else by the rules. An unknown mode raises ValueError."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    return normalise(text) if mode == "modern" else clean(text)


def smart(chapters: DataFrame, chunks: Column) -> DataFrame:
    """Legacy chapters with the fields that only modern ones have: no summary, topics or entities, and chunks."""
    none = F.array().cast("array<string>")
    return chapters.withColumn("semantic_summary", F.lit(None).cast("string")).withColumn("topics", none).withColumn("named_entities", none).withColumn("chunks", chunks)


def plain(chapters: DataFrame, key: str) -> DataFrame:
    """Modern chapters without the fields that legacy ones lack."""
    return chapters.select(key, "chapter_num", "title", "content", "word_count", "estimated_duration", "confidence")


def statistics(chapters: DataFrame, key: str, chunks: Column) -> DataFrame:
    """(key, processed_length, chapters_detected, chunks_created, confidence_score) of a text's chapters."""
    return chapters.groupBy(key).agg(
        F.sum(F.length("content")).cast("long").alias("processed_length"), F.count("*").alias("chapters_detected"), F.sum(F.size(chunks)).cast("long").alias("chunks_created"), F.round(F.avg("confidence"), 6).alias("confidence_score")
    )
