"""Chapters: segmentation by markers, heading patterns or a table of contents; filter, split and renumber."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import rules as R
from ..plans.session import once
from .text import spaced, strip, word_count

WORDS_A_MINUTE = 200.0
#: For the SQL of by_toc, which ignores the case of these.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANDIDATES = "array<struct<start: bigint, confidence: double, title: string>>"
#: Title case: each run of cased letters is a capital and then small ones, and there is one at least.
TITLE = r"^[^\p{Lu}\p{Lt}\p{Ll}]*[\p{Lu}\p{Lt}]\p{Ll}*([^\p{Lu}\p{Lt}\p{Ll}]+[\p{Lu}\p{Lt}]\p{Ll}*)*[^\p{Lu}\p{Lt}\p{Ll}]*$"


def measured(df: DataFrame, confidence: float | None = None) -> DataFrame:
    df = once(df.drop("word_count"), "word_count", word_count(F.col("content")))
    df = df.withColumn("estimated_duration", F.round(F.col("word_count") / WORDS_A_MINUTE, 6))
    return df if confidence is None else df.withColumn("confidence", F.lit(confidence))


def by_pattern(df: DataFrame, pattern, text: str, key: str, group: int = 1, fallback: str | None = "Full Text") -> DataFrame:
    """(key, chapter_num, title, content, word_count, estimated_duration): what stands between matches of a pattern (a string or a column).

    Text before the first match is dropped, empty bodies too, but they keep their number. Texts without a match
    are one chapter called `fallback`, unstripped.
    """
    at = F.lit(pattern) if isinstance(pattern, str) else pattern
    whole_text = once(df.withColumn("_at", at), "_t", F.col(text))
    found = once(whole_text, "_f", F.struct(F.regexp_extract_all("_t", F.col("_at"), F.lit(group)).alias("titles"), F.split("_t", F.col("_at"), -1).alias("parts")))
    found = found.select(key, "_t", F.col("_f.titles").alias("_titles"), F.col("_f.parts").alias("_parts"))
    pairs = F.arrays_zip(F.col("_titles").alias("t"), F.expr("slice(_parts, 2, size(_titles))").alias("c"))
    whole = F.array(F.struct(F.lit(fallback).alias("t"), F.col("_t").alias("c"))) if fallback else F.array().cast("array<struct<t: string, c: string>>")
    spans = found.select(key, F.posexplode(F.when(F.size("_titles") > 0, F.transform(pairs, lambda p: F.struct(strip(p["t"]).alias("t"), strip(p["c"]).alias("c")))).otherwise(whole)).alias("k", "p"))
    return measured(spans.select(key, (F.col("k") + 1).cast("long").alias("chapter_num"), F.col("p.t").alias("title"), F.col("p.c").alias("content")).filter("content <> ''"))


def by_marker(df: DataFrame, text: str, key: str) -> DataFrame:
    return by_pattern(df, R.MARKER, text, key)


def heading_pattern(text):
    """The first of the heading patterns that occurs in the text, as one regular expression; null if none does."""
    chosen = F.lit(None).cast("string")
    for p in reversed(R.HEADINGS):
        java = "(?dmi)" + R.in_java(p)
        chosen = F.when(F.regexp_count(text, F.lit(java)) > 0, F.lit(java)).otherwise(chosen)
    return chosen


def segment(df: DataFrame, text: str, key: str) -> DataFrame:
    """Legacy segmentation with confidence: markers (1.0), else the first heading pattern that occurs (0.8), else the whole text as "Full Text" (1.0).

    Bodies that are blank are dropped and keep their number; where all are, the whole text counts.
    """
    marked = F.regexp_count(F.col(text), F.lit(R.MARKER)) > 0
    chosen = df.withColumn("_m", marked).withColumn("_p", F.when(F.col("_m"), R.MARKER).otherwise(F.coalesce(heading_pattern(F.col(text)), F.lit(r"(?!)"))))
    chosen = once(chosen, "_t", F.col(text))
    titles = F.when(F.col("_m"), F.regexp_extract_all("_t", F.lit(R.MARKER), F.lit(1))).otherwise(F.regexp_extract_all("_t", F.col("_p"), F.lit(0)))
    found = once(chosen, "_f", F.struct(titles.alias("titles"), F.split("_t", F.col("_p"), -1).alias("parts")))
    pairs = F.arrays_zip(F.col("_f.titles").alias("t"), F.expr("slice(_f.parts, 2, size(_f.titles))").alias("c"))
    numbered = F.transform(pairs, lambda p, i: F.struct((i + 1).cast("long").alias("n"), strip(p["t"]).alias("t"), strip(p["c"]).alias("c"), F.when(F.col("_m"), 1.0).otherwise(0.8).alias("q")))
    kept = once(found.select(key, "_m", "_t", F.filter(numbered, lambda x: x["c"] != "").alias("_n")), "_s", F.when(F.size("_n") > 0, F.col("_n")).otherwise(F.array(F.struct(F.lit(1).cast("long").alias("n"), F.lit("Full Text").alias("t"), F.col("_t").alias("c"), F.lit(1.0).alias("q")))))
    rows = kept.select(key, F.explode("_s").alias("s")).select(key, F.col("s.n").alias("chapter_num"), F.col("s.t").alias("title"), F.col("s.c").alias("content"), F.col("s.q").alias("confidence"))
    return measured(rows)


def by_headings(df: DataFrame, text: str, key: str) -> DataFrame:
    """Segmentation by the first heading pattern that occurs; the whole match is the title. One plan, the pattern a column."""
    with_pattern = df.withColumn("_p", F.coalesce(heading_pattern(F.col(text)), F.lit(r"(?!)")))
    return by_pattern(with_pattern, F.col("_p"), text, key, group=0)


def by_toc(df: DataFrame, toc: DataFrame, text: str, key: str) -> DataFrame:
    """Chapters of the titles in toc (key, pos, title): from a title's first occurrence to the next title's first after it; no match starts at 0.

    Matching ignores ASCII case. An entry with a value in a column content brings its own text. Entries whose body is
    blank are dropped and keep their position.
    """

    def halves(t, title):
        """What stands before a title's first occurrence and after it; in Java (?i) alone leaves letters beyond ASCII as they are."""
        return F.split(t, F.concat(F.lit(r"(?i)\Q"), F.replace(title, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), 2)

    order = Window.partitionBy(key).orderBy("pos")
    entries = toc.withColumn("_next", F.lead("title").over(order))
    both = entries.join(df.select(key, F.col(text).alias("_t")), key)
    # an empty title is found at once: nothing stands before it
    rest = once(both, "_rest", F.when(F.col("title") == "", F.col("_t")).otherwise(F.coalesce(F.get(halves(F.col("_t"), F.col("title")), F.lit(1)), F.col("_t"))))
    both = once(rest, "_body", F.when(F.col("_next").isNull(), F.col("_rest")).when(F.col("_next") == "", "").otherwise(F.get(halves(F.col("_rest"), F.col("_next")), F.lit(0))))
    body = F.col("_body")
    if "content" in toc.columns:
        body = F.coalesce("content", body)
    return measured(both.select(key, F.col("pos").cast("long").alias("chapter_num"), "title", strip(body).alias("content")).filter("content <> ''"), 1.0)


def keep_long(df: DataFrame, min_words: int = 100) -> DataFrame:
    return df.filter(F.col("word_count") >= min_words)


def split_long(df: DataFrame, max_words: int = 5000, parts_in: str | None = None) -> DataFrame:
    """Chapters above max_words in windows of words, titled `t - Part k`; others keep title, text and count. Adds part (from 1), and the number of parts in a column of the name given."""
    long = F.col("word_count") > max_words
    # windows are cut as a whole, no word is made a string of its own
    cut = F.regexp_extract_all(spaced(F.col("content")), F.lit(rf"(?:[^ ]++ ?+){{1,{max_words}}}+"), F.lit(0))
    windows = once(df, "_w", F.when(long, cut))

    def window(w, i):
        return F.struct(F.trim(w).alias("c"), F.when(i < F.size("_w") - 1, F.lit(max_words).cast("long")).otherwise(word_count(w)).alias("n"))

    whole = F.array(F.struct(F.col("content").alias("c"), F.col("word_count").cast("long").alias("n")))
    blank = F.array(F.struct(F.lit("").alias("c"), F.lit(0).cast("long").alias("n")))
    parts = once(windows, "_p", F.when(~long | long.isNull(), whole).when(F.size("_w") == 0, blank).otherwise(F.transform("_w", window)))
    parts = parts.select("*", F.posexplode("_p").alias("_k", "_c"))
    title = F.when(F.size("_p") > 1, F.concat("title", F.lit(" - Part "), (F.col("_k") + 1).cast("string"))).otherwise(F.col("title"))
    out = parts.withColumn("title", title).withColumn("content", F.col("_c.c")).withColumn("word_count", F.col("_c.n")).withColumn("part", (F.col("_k") + 1).cast("long"))
    out = (out.withColumn(parts_in, F.size("_p").cast("long")) if parts_in else out).drop("_w", "_p", "_k", "_c")
    return out.withColumn("estimated_duration", F.round(F.col("word_count") / WORDS_A_MINUTE, 6))


def renumber(df: DataFrame, key: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy("chapter_num", "part")
    return df.withColumn("chapter_num", F.row_number().over(order).cast("long"))


#: Fixed value: the head of a table of contents.
HEADER = "Table of Contents\n=================\n\n"


def contents_table(df: DataFrame, key: str) -> DataFrame:
    """(key, toc): three lines for each chapter, in order, under HEADER; a fixed format."""
    line = F.format_string("Chapter %d: %s\n  Words: %d\n  Estimated duration: %.1f minutes\n\n", "chapter_num", "title", "word_count", "estimated_duration")
    rows = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("chapter_num", line.alias("l")))).alias("l"))
    return rows.select(key, F.concat(F.lit(HEADER), F.array_join(F.col("l.l"), "")).alias("toc"))


def is_title(text):
    """TITLE, said without a repeated group, which recurses with every word of a long line: no run of cased letters begins small, and no capital stands in one."""
    cased = r"\p{Lu}\p{Lt}\p{Ll}"
    return text.rlike(r"[\p{Lu}\p{Lt}]") & ~text.rlike(rf"(?<![{cased}])\p{{Ll}}|(?<=[{cased}])[\p{{Lu}}\p{{Lt}}]")


def is_upper(text):
    """Capitals and no other cased letter."""
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"[\p{Ll}\p{Lt}]")


def heading_confidence(title):
    """0.5, more for chapter words, digits, few words and title case; at most 1."""
    low = F.lower(title)
    score = F.lit(0.5) + F.when(low.contains("chapter"), 0.3).otherwise(0.0) + F.when(low.contains("part") | low.contains("section"), 0.2).otherwise(0.0)
    score = score + F.when(title.rlike(r"\p{Nd}"), 0.1).otherwise(0.0) + F.when(word_count(title) <= 5, 0.1).otherwise(0.0)
    score = score + F.when(is_title(title), 0.1).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), score), 6)


def nms(candidates, near: int = 100, least: float = 0.6):
    """Greedy filter of an array of (start, confidence, title) in order of start: of two closer than `near`, the more confident stays.

    What lies `near` or more before a candidate can't meet it or any later one, so only the rest of what is kept is looked at.
    """
    def step(kept, c):
        still = F.filter(kept["last"], lambda k: c["start"] - k["start"] < near)
        past = F.filter(kept["last"], lambda k: c["start"] - k["start"] >= near)
        done = F.when(F.size(past) == 0, kept["done"]).otherwise(F.concat(kept["done"], past))
        first = F.get(still, F.lit(0))
        replaced = F.concat(F.filter(still, lambda k: k != first), F.array(c))
        last = F.when(F.size(still) == 0, F.array(c)).when(c["confidence"] > first["confidence"], replaced).otherwise(still)
        return F.when(c["confidence"] < least, kept).otherwise(F.struct(done.alias("done"), last.alias("last")))

    none = F.array().cast(CANDIDATES)
    return F.aggregate(candidates, F.struct(none.alias("done"), none.alias("last")), step, lambda kept: F.concat(kept["done"], kept["last"]))
