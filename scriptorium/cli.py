"""Command line: convert books one folder or many patterns at a time, validate and describe them, clean texts, check and show rules and settings.

    python -m scriptorium.cli convert BOOKS --output-dir OUT [--format plain|json] [--mode legacy|modern|hybrid]
    python -m scriptorium.cli batch PATTERN... --output-dir OUT [--resume] [--limit N] [--dry-run]
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import settings
from .operators import chapters as C
from .operators import modern, reports
from .operators import text as T
from .operators.language import if_small
from .sinks.files import stem, write_files
from .sources import epub

VERSION = "0.3"
#: Fixed value: the least words of a chapter where none is given.
MIN_WORDS = 100


def _books(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return epub.read_epub(spark, path)


def named(books: DataFrame, path: str | list[str]) -> DataFrame:
    """Books with base, the name of their files: the file's stem, with a hash of the path behind it where another file that path names has the same stem.

    Stems are counted over names alone; no book moves for it while those that repeat are few.
    """
    stems = books.sparkSession.read.format("binaryFile").load(path).select(stem(F.col("path")).alias("_stem"))
    several = if_small(stems.groupBy("_stem").agg(F.count("*").alias("_n")).filter("_n > 1"), "_stem")
    both = books.withColumn("_stem", stem(F.col("path"))).join(several, "_stem", "left")
    return both.withColumn("base", F.when(F.col("_n").isNotNull(), F.concat("_stem", F.lit("-"), F.substring(F.md5("path"), 1, 8))).otherwise(F.col("_stem"))).drop("_stem", "_n")


def _not_done(spark: SparkSession, books: DataFrame, folder: str, suffix: str) -> DataFrame:
    """Books that the folder has no text of, or that of another book: a text's metadata names the file that it is from. A folder that isn't there has none."""
    try:
        done = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(folder).select(stem(F.col("path")).alias("base"))
        told = spark.read.format("binaryFile").option("pathGlobFilter", "*_metadata.json").load(folder)
    except AnalysisException:
        return books
    told = told.select(F.regexp_replace(stem(F.col("path")), "_metadata$", "").alias("base"), F.get_json_object(F.col("content").cast("string"), "$.source_file").alias("_from"))
    done = done.join(told, "base")
    return books.join(done, (books["base"] == done["base"]) & (F.col("_from").isNull() | (F.col("_from") == books["path"])), "left_anti")


def convert(spark: SparkSession, path: str | list[str], folder: str, form: str = "plain", mode: str = "legacy", resume: bool = False, min_words: int = 1, max_words: int = 5000, books: DataFrame | None = None) -> DataFrame:
    """Writes each book's text or JSON and its metadata and contents to the folder; (file, bytes).

    Books of equal names in several folders get names of their own. A book whose chapters are all below min_words has an empty text.
    With resume, books whose text the folder already has are left out.
    """
    books = named((_books(spark, path) if books is None else books).filter("error is null"), path)
    suffix = "json" if form == "json" else "txt"
    if resume:
        books = _not_done(spark, books, folder, suffix)
    texts = books.select("base", "content")
    found = modern.process(texts, "content", "base", mode) if mode == "legacy" else modern.with_contents(texts, "content", "base", epub.contents(books, "base"), mode)
    parts = C.keep_long(C.split_long(found, max_words), min_words)
    chapters = C.renumber(parts, "base")
    fields = F.struct("chapter_num", "title", "content", "word_count", "estimated_duration")
    listed = chapters.groupBy("base").agg(F.sort_array(F.collect_list(fields)).alias("chapters"))
    metadata = F.struct("title", "author", "authors", "publisher", "publication_date", "language", "identifier", "description", "subjects", "original_format", "file_size", F.col("path").alias("source_file"))
    whole = books.drop("chapters").join(listed, "base", "left")
    whole = whole.withColumn("chapters", F.coalesce("chapters", F.array().cast(listed.schema["chapters"].dataType))).withColumn("text", F.array_join(F.col("chapters.content"), "\n\n"))
    body = reports.document_json(metadata, F.col("text"), F.col("chapters"), F.col("image_info")) if form == "json" else F.col("text")
    files = whole.select(F.explode(F.array(F.struct(F.concat("base", F.lit(f".{suffix}")).alias("name"), body.alias("content")), F.struct(F.concat("base", F.lit("_metadata.json")).alias("name"), F.to_json(metadata).alias("content")))).alias("f")).select("f.*")
    contents = C.contents_table(chapters, "base").select(F.concat("base", F.lit("_toc.txt")).alias("name"), F.col("toc").alias("content"))
    return write_files(files.union(contents), folder, "name", "content")


def batch(spark: SparkSession, patterns: list[str], folder: str, form: str = "plain", mode: str = "legacy", resume: bool = False, limit: int | None = None, dry_run: bool = False, min_words: int = MIN_WORDS) -> tuple[dict, list[str]]:
    """Converts the books that patterns name, in order of path, `limit` of them at most; (totals, patterns that name none).

    A book that can't be read is a failure of its own, with its error. Next to the books' files the folder gets batch_files, a line of JSON for each
    book of the run (file, success, characters, chapters, error), and batch_summary.json with the totals. With dry_run nothing is read or written.
    """
    listing, unknown = epub.expand_patterns(spark, patterns)
    listing = listing.limit(limit) if limit is not None else listing
    paths = [r.path for r in listing.toLocalIterator()]  # names, which Spark's own listing has on the driver too
    totals = {"total_files": len(paths), "successful": 0, "failed": 0, "skipped": 0, "total_processing_time": 0.0, "total_characters_extracted": 0, "total_chapters_extracted": 0, "average_processing_time": 0.0}
    if dry_run or not paths:
        return totals | {"files": paths}, unknown
    began, suffix = time.time(), "json" if form == "json" else "txt"
    books = _books(spark, paths)
    told = named(books.filter("error is null").select("path", F.length("content").alias("characters"), F.size("chapters").alias("chapters")), paths)
    left = _not_done(spark, told, folder, suffix) if resume else told
    left = spark.createDataFrame(left.select("path", "characters", "chapters").collect(), "path string, characters int, chapters int")  # before anything is written, a row a file
    failed = books.filter("error is not null").select("path", "error")
    convert(spark, paths, folder, form, mode, resume, min_words, books=books).agg(F.sum("bytes")).collect()
    results = left.select(F.col("path").alias("file"), F.lit(True).alias("success"), "characters", "chapters", F.lit(None).cast("string").alias("error"))
    results = results.unionByName(failed.select(F.col("path").alias("file"), F.lit(False).alias("success"), F.lit(0).alias("characters"), F.lit(0).alias("chapters"), "error"))
    results.write.mode("overwrite").json(f"{folder}/batch_files")
    done = spark.read.schema(results.schema).json(f"{folder}/batch_files").agg(F.count_if("success"), F.count_if(~F.col("success")), F.coalesce(F.sum("characters"), F.lit(0)), F.coalesce(F.sum("chapters"), F.lit(0))).first()
    seconds = time.time() - began
    totals |= {"successful": done[0], "failed": done[1], "skipped": len(paths) - done[0] - done[1], "total_processing_time": seconds, "total_characters_extracted": done[2], "total_chapters_extracted": done[3], "average_processing_time": seconds / len(paths)}
    summary = spark.createDataFrame([("batch_summary.json", json.dumps({"batch_processing": totals}))], "name string, content string")
    write_files(summary, folder, "name", "content").collect()
    return totals, unknown


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="scriptorium", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in (("convert", "write texts, JSON, metadata and contents"), ("info", "describe books"), ("validate", "list what is wrong with books"), ("clean", "clean a text file"), ("check", "check rule and settings files"), ("config", "show settings, a custom file's over the default's"), ("batch", "convert what patterns name"), ("version", "show the version")):
        sub = commands.add_parser(name, help=text)
        if name == "version":
            continue
        sub.add_argument("path", **({"nargs": "+"} if name == "batch" else {}))
        if name == "config":
            sub.add_argument("--custom")
        if name == "batch":
            sub.add_argument("--limit", type=int)
            sub.add_argument("--dry-run", action="store_true")
        if name in ("convert", "batch"):
            sub.add_argument("--min-words", type=int, default=MIN_WORDS)
            sub.add_argument("--output-dir", "-o", required=True)
            sub.add_argument("--format", "-f", choices=("plain", "json"), default="plain")
            sub.add_argument("--mode", choices=modern.MODES, default="legacy")
            sub.add_argument("--resume", action="store_true")
        if name == "check":
            sub.add_argument("--kind", choices=("rules", "settings"), default="settings")
    args = parser.parse_args(argv)
    if args.command == "check":  # no Spark needed
        loaded = settings.read(args.path)
        found = settings.compiled(loaded)[1] if args.kind == "rules" else settings.problems(settings.flat(loaded))
        print("\n".join(found) or "ok")
        return 1 if found else 0
    if args.command == "version":
        print(VERSION)
        return 0
    if args.command == "config":
        try:
            print(json.dumps(settings.load(args.path, args.custom), indent=2, ensure_ascii=False))
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
        return 0
    spark = SparkSession.builder.appName("scriptorium").getOrCreate()
    if args.command == "convert":
        written = convert(spark, args.path, args.output_dir, args.format, args.mode, args.resume, args.min_words).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")).first()
        print(f"{written.files} files, {written.bytes or 0} bytes")
        unread = [f"{r.path}: {r.error}" for r in _books(spark, args.path).filter("error is not null").select("path", "error").toLocalIterator()]
        print("\n".join(unread), file=sys.stderr, end="\n" if unread else "")
        return 1 if unread else 0
    elif args.command == "batch":
        totals, unknown = batch(spark, args.path, args.output_dir, args.format, args.mode, args.resume, args.limit, args.dry_run, args.min_words)
        print("\n".join(f"names no book: {p}" for p in unknown), file=sys.stderr, end="\n" if unknown else "")
        print(json.dumps(totals))
        return 1 if totals["failed"] or not totals["total_files"] else 0
    elif args.command == "clean":
        for row in spark.read.text(args.path, wholetext=True).select(T.clean(F.col("value")).alias("value")).toLocalIterator():
            print(row.value)
    elif args.command == "validate":
        found = [r for r in epub.validate(_books(spark, args.path)).toLocalIterator() if r.issues]
        print("\n".join(f"{r.path}: {'; '.join(r.issues)}" for r in found) or "ok")
        return 1 if found else 0
    else:
        rows = _books(spark, args.path).select("path", "title", "author", "language", "identifier", F.size("chapters").alias("chapters"), F.size("images").alias("images"), T.word_count(F.col("content")).alias("words"), "error")
        for row in rows.toLocalIterator():
            print(json.dumps(row.asDict(), ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
