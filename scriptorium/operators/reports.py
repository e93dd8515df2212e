"""Results as JSON and as texts for people: documents, processing metadata, batch summaries, reports, stage timings, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def authors(author: Column, listed: Column) -> Column:
    """The listed authors, or the one author where none is listed; none at all without that one, as the reference has it."""
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(author, F.lit("")) == "", none).when(F.coalesce(F.size(listed), F.lit(0)) > 0, listed).otherwise(F.array(author))


def book_metadata(title: Column, author: Column, listed: Column, publisher: Column, date: Column, language: Column, isbn: Column, description: Column, tags: Column, size: Column) -> Column:
    """A book's metadata under the names that results have."""
    subjects = F.coalesce(tags, F.array().cast("array<string>"))
    return F.struct(
        title.alias("title"), author.alias("author"), authors(author, listed).alias("authors"), publisher.alias("publisher"), date.cast("string").alias("publication_date"), language.alias("language"),
        isbn.alias("identifier"), description.alias("description"), subjects.alias("subjects"), F.lit("epub").alias("original_format"), size.alias("file_size"),
    )


def document_json(metadata: Column, text: Column, chapters: Column, images: Column) -> Column:
    """A whole result as one JSON string; null fields are left out."""
    return F.to_json(F.struct(metadata.alias("metadata"), text.alias("text"), chapters.alias("chapters"), images.alias("images")))


def thousands(n: Column) -> Column:
    """A whole number with commas."""
    return F.format_number(n, 0)


# Fixed format: lines of a processing report, with their marks.
REPORT = (
    "Processing Report\n" + "=" * 40 + "\n\n",
    "📖 Book Information:\n",
    "📄 Text Processing:\n",
    "📚 Chapters:\n",
    "🖼️  Image Processing:\n",
    "🔊 TTS Generation:\n",
    "✅ Processing completed successfully!\n",
)


def _line(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def report(book: Column, length: Column, words: Column, chapters: Column, removed: Column, ratio: Column, images: Column, high: Column, mean: Column, spoken: Column, minutes: Column) -> Column:
    """A report of one document. book: array<struct<key, value>>; chapters: array<struct<n, title, words, minutes>> in order.

    Null values leave their line out, no images or spoken chapters their section.
    """
    title, about, text, listing, pictures, speech, done = map(F.lit, REPORT)
    info = F.array_join(F.transform(F.filter(book, lambda b: F.coalesce(b["value"], F.lit("")) != ""), lambda b: _line("  ", F.initcap(b["key"]), ": ", b["value"], "\n")), "")
    cleaned = F.when(removed.isNotNull(), _line("  Text cleaning: ", thousands(removed), " characters removed\n  Compression ratio: ", F.format_string("%.1f", F.round(ratio * 100, 1)), "%\n")).otherwise("")
    rows = F.array_join(
        F.transform(chapters, lambda c: _line("  ", c["n"].cast("string"), ". ", c["title"], "\n     Words: ", thousands(c["words"]), ", Duration: ", F.format_string("%.1f", c["minutes"]), " min\n")), ""
    )
    seen = F.when(images > 0, _line(pictures, "  Images processed: ", images.cast("string"), "\n  High confidence descriptions: ", high.cast("string"), "\n  Average confidence: ", F.format_string("%.2f", mean), "\n\n")).otherwise("")
    told = F.when(spoken > 0, _line(speech, "  Chapters processed: ", spoken.cast("string"), "/", F.size(chapters).cast("string"), "\n  Total audio duration: ", F.format_string("%.1f", minutes), " minutes\n\n")).otherwise("")
    sizes = _line("  Chapters extracted: ", F.size(chapters).cast("string"), "\n  Total text length: ", thousands(length), " characters\n  Total word count: ", thousands(words), " words\n")
    return _line(title, about, info, "\n", text, sizes, cleaned, "\n", listing, rows, "\n", seen, told, done)


def batch_summary(files: DataFrame, key: str, order: str) -> DataFrame:
    """(key, summary) of files (key, order, ok, chars, chapters, seconds, error): totals over successes, mean time over all, and lists of both kinds.

    Files are numbered from 0 within each kind, in order; names don't show. Lists are as long as a batch.
    """
    number = F.row_number().over(Window.partitionBy(key, "ok").orderBy(order)) - 1
    rows = files.withColumn("_file", F.concat(F.lit("file_"), number.cast("string")))
    good = F.when(F.col("ok"), F.struct(F.col(order).alias("o"), F.struct(F.col("_file").alias("file"), F.col("chars").alias("characters"), "chapters", F.col("seconds").alias("processing_time")).alias("f")))
    bad = F.when(~F.col("ok"), F.struct(F.col(order).alias("o"), F.struct(F.col("_file").alias("file"), "error").alias("f")))
    total = F.coalesce(F.sum("seconds"), F.lit(0))
    done = rows.groupBy(key).agg(
        F.struct(
            F.count("*").alias("total_files"), F.count_if("ok").alias("successful"), F.count_if(~F.col("ok")).alias("failed"), total.alias("total_processing_time"),
            F.coalesce(F.sum(F.when(F.col("ok"), F.col("chars"))), F.lit(0)).alias("total_characters_extracted"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("chapters"))), F.lit(0)).alias("total_chapters_extracted"),
            (total / F.count("*")).alias("average_processing_time"),
        ).alias("batch_processing"),
        F.sort_array(F.collect_list(good)).alias("g"), F.sort_array(F.collect_list(bad)).alias("b"),
    )
    return done.select(key, F.to_json(F.struct("batch_processing", F.col("g.f").alias("successful_files"), F.col("b.f").alias("failed_files"))).alias("summary"))


def stage_times(events: DataFrame, key: str, stage: str, seconds: str) -> DataFrame:
    """(key, times): a map from stage to its seconds, the last measurement of a stage counts (by column at)."""
    last = events.groupBy(key, stage).agg(F.max_by(seconds, "at").alias("s"))
    return last.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(stage, "s")))).alias("times"))


def cleaning_totals(stats: DataFrame) -> DataFrame:
    """One row over cleaning statistics: characters before, after and removed, the share left, and how much was changed."""
    before, after = F.sum("original_length"), F.sum("cleaned_length")
    return stats.agg(
        before.alias("original_length"), after.alias("cleaned_length"), (before - after).alias("characters_removed"),
        F.round(F.coalesce(F.try_divide(after, before), F.lit(0.0)), 6).alias("compression_ratio"), F.sum("patterns_applied").alias("patterns_applied"), F.sum("transformations_made").alias("transformations_made"),
    )
