"""Registered queries of repair, sentence-level chapters, modes of processing, results and reports, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import chapters as C
from .operators import chunking, media, modern, repair, reports
from .operators import text as T
from .plans import rules as R
from .plans.session import once
from .queries import (
    _BEST, BOOKS, CHAPTERS, MARKUP, NL, _described, _descriptions, _stats_sql, _TOC, _toc_sql, books, chapters, cleaned, clean_stats, documents, duck_strip, markup, nms_sql, query, table, wc,
)
from .sinks import files

# ---- repair -----------------------------------------------------------------------------------------------------

#: Misread bytes, ligatures, line ends and control characters put into texts.
_MANGLE = (("é", "Ã©"), ("ü", "Ã¼"), ("ñ", "Ã±"), (" the ", " â€œtheâ€\x9d "), (" der ", " ‘der’ "), ("fi", "ﬁ"), ("\n", "\r\n"), (". ", ".\x01 "))


def _mangled(text: str) -> str:
    for good, bad in _MANGLE:
        a, b = (" || ".join(f"chr({ord(c)})" if ord(c) < 32 else f"'{c}'" for c in x) for x in (good, bad))
        text = f"replace({text}, {a}, {b})"
    return text


@query(f"SELECT doc_id, {repair.repair_duck('t')} AS repaired FROM (SELECT doc_id, {_mangled('text')} AS t FROM documents)")
def repair_encoding(spark, sf_dir):
    return documents(spark, sf_dir).selectExpr("doc_id", f"{_mangled('text')} AS t").select("doc_id", repair.repair(F.col("t")).alias("repaired"))


# ---- chapters by sentence ---------------------------------------------------------------------------------------


def _confidence_sql(t: str) -> str:
    low = f"lower({t})"
    return (
        f"CAST(round(least(1.0, 0.5 + CASE WHEN contains({low}, 'chapter') THEN 0.3 ELSE 0.0 END + CASE WHEN contains({low}, 'part') OR contains({low}, 'section') THEN 0.2 ELSE 0.0 END"
        f" + CASE WHEN regexp_matches({t}, '\\p{{Nd}}') THEN 0.1 ELSE 0.0 END + CASE WHEN {wc(t)} <= 5 THEN 0.1 ELSE 0.0 END + CASE WHEN regexp_matches({t}, '{C.TITLE}') THEN 0.1 ELSE 0.0 END), 6) AS DOUBLE)"
    )


def _sentence_sql(src: str, key: str) -> str:
    """Sentence candidates of src (key, txt), as modern.sentence_candidates gives them."""
    parts = f"SELECT {key}, unnest(l) AS title, unnest(range(1, len(l) + 1)) AS i FROM (SELECT {key}, string_split(regexp_replace(txt, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)) AS l FROM ({src}))"
    placed = f"SELECT *, CAST(coalesce(sum(length(title) + 1) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM ({parts})"
    heading = f"title <> '' AND {wc('title')} <= 10 AND (regexp_matches(title, '{C.TITLE}') OR (regexp_matches(title, '\\p{{Lu}}') AND NOT regexp_matches(title, '[\\p{{Ll}}\\p{{Lt}}]')))"
    return f"SELECT {key}, start, title, {_confidence_sql('title')} AS confidence FROM ({placed}) WHERE {heading}"


def _by_candidates_sql(src: str, key: str) -> str:
    listed = f"SELECT {key}, {nms_sql('l')} AS kept FROM (SELECT {key}, list({{'start': start, 'confidence': confidence, 'title': title}} ORDER BY start, title, confidence) AS l FROM ({_sentence_sql(src, key)}) GROUP BY {key})"
    spans = (
        f"SELECT {key}, txt, list_filter(list_transform(range(1, len(kept) + 1), lambda i: {{'n': i, 't': kept[i].title, 'q': kept[i].confidence, 'c': "
        + duck_strip("substr(txt, kept[i].start + length(kept[i].title) + 1, greatest(coalesce(kept[i + 1].start, length(txt)) - kept[i].start - length(kept[i].title), 0))")
        + f"}}), lambda s: s.c <> '') AS s FROM (SELECT b.*, coalesce(k.kept, []) AS kept FROM ({src}) b LEFT JOIN ({listed}) k ON b.{key} = k.{key})"
    )
    rows = f"SELECT {key}, unnest(CASE WHEN len(s) > 0 THEN s ELSE [{{'n': 1, 't': 'Full Document', 'q': CAST(0.5 AS DOUBLE), 'c': txt}}] END) AS s FROM ({spans})"
    content = "s.c"
    return f"SELECT {key}, CAST(s.n AS BIGINT) AS chapter_num, s.t AS title, {content} AS content, {wc(content)} AS word_count, round({wc(content)} / 200.0, 6) AS estimated_duration, CAST(s.q AS DOUBLE) AS confidence FROM ({rows})"


_MODERN_BOOKS = f"SELECT book_id, {R.apply_duck('raw', R.MODERN)} AS txt FROM ({BOOKS})"
_MODERN = _by_candidates_sql(_MODERN_BOOKS, "book_id")


@query(_sentence_sql(_MODERN_BOOKS, "book_id"))
def sentence_headings(spark, sf_dir):
    texts = once(books(spark, sf_dir), "t", T.normalise(F.col("raw"))).select("book_id", "t")
    return modern.sentence_candidates(texts, "t", "book_id").drop("method")


@query(_MODERN)
def modern_chapters(spark, sf_dir):
    return modern.process(books(spark, sf_dir), "raw", "book_id", "modern")


def _simple_count(column: str) -> str:
    e = "CAST([] AS VARCHAR[])"
    held = f"CASE WHEN a.cur <> '' THEN list_append(a.out, {duck_strip('a.cur')}) ELSE a.out END"
    fold = f"list_reduce(list_prepend({{'cur': '', 'out': {e}}}, list_transform(string_split({column}, '. '), lambda s: {{'cur': s, 'out': {e}}})), lambda a, s: CASE WHEN length(a.cur) + length(s.cur) > 4000 THEN {{'cur': s.cur, 'out': {held}}} ELSE {{'cur': a.cur || s.cur || '. ', 'out': a.out}} END)"
    return f"(len(({fold}).out) + CASE WHEN {duck_strip(f'({fold}).cur')} <> '' THEN 1 ELSE 0 END)"


@query(f"SELECT book_id, CAST(sum(length(content)) AS BIGINT) AS processed_length, count(*) AS chapters_detected, CAST(sum({_simple_count('content')}) AS BIGINT) AS chunks_created, round(avg(confidence), 6) AS confidence_score FROM ({_MODERN}) GROUP BY book_id")
def modern_stats(spark, sf_dir):
    return modern.statistics(modern_chapters(spark, sf_dir), "book_id", chunking.simple_chunks(F.col("content")))


# ---- modes of processing ----------------------------------------------------------------------------------------


def _legacy_sql(src: str) -> str:
    """Legacy segmentation of src (book_id, txt) with confidence."""
    cases = " ".join(f"WHEN regexp_matches(txt, {R.quoted('(?mi)' + p.replace('<S>', R.SPACE))}) THEN {R.quoted('(?mi)' + p.replace('<S>', R.SPACE))}" for p in R.HEADINGS)
    chosen = f"SELECT *, len(regexp_extract_all(txt, '{R.MARKER}')) > 0 AS m, CASE WHEN len(regexp_extract_all(txt, '{R.MARKER}')) > 0 THEN '{R.MARKER}' {cases} END AS p FROM ({src})"
    parts = f"SELECT *, CASE WHEN p IS NULL THEN [] WHEN m THEN regexp_extract_all(txt, p, 1) ELSE regexp_extract_all(txt, p, 0) END AS titles, CASE WHEN p IS NULL THEN [txt] ELSE string_split_regex(txt, p) END AS parts FROM ({chosen})"
    spans = f"SELECT book_id, txt, list_filter(list_transform(range(1, len(titles) + 1), lambda i: {{'n': i, 't': {duck_strip('titles[i]')}, 'c': {duck_strip('parts[i + 1]')}, 'q': CASE WHEN m THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END}}), lambda s: s.c <> '') AS s FROM ({parts})"
    rows = f"SELECT book_id, unnest(CASE WHEN len(s) > 0 THEN s ELSE [{{'n': 1, 't': 'Full Text', 'c': txt, 'q': 1.0::DOUBLE}}] END) AS s FROM ({spans})"
    return f"SELECT book_id, CAST(s.n AS BIGINT) AS chapter_num, s.t AS title, {wc('s.c')} AS word_count, s.q AS confidence FROM ({rows})"


_CLEAN_BOOKS = f"SELECT book_id, {cleaned('raw')} AS txt FROM ({BOOKS})"
_TWICE = f"SELECT book_id, {cleaned('txt')} AS txt FROM ({_CLEAN_BOOKS})"


@query(_legacy_sql(f"SELECT book_id, raw AS txt FROM ({BOOKS})"))
def segment_legacy(spark, sf_dir):
    """Of raw books, whose chapters are found by heading patterns."""
    return C.segment(books(spark, sf_dir), "raw", "book_id").select("book_id", "chapter_num", "title", "word_count", "confidence")


@query(
    f"SELECT 'legacy' AS mode, * FROM ({_legacy_sql(_CLEAN_BOOKS)}) UNION ALL SELECT 'hybrid', * FROM ({_legacy_sql(_TWICE)}) UNION ALL SELECT 'modern', book_id, chapter_num, title, word_count, confidence FROM ({_MODERN})"
)
def dispatch_chapters(spark, sf_dir):
    """Books by each mode, without a table of contents."""
    return modern.all_modes(books(spark, sf_dir), "raw", "book_id").select("mode", "book_id", "chapter_num", "title", "word_count", "confidence")


_HYBRID_BOOKS = f"SELECT book_id, {R.apply_duck('txt', R.MODERN)} AS raw FROM ({_CLEAN_BOOKS})"


@query(_toc_sql(_TOC.replace(", ' || CAST(doc_id AS VARCHAR)", "'"), _HYBRID_BOOKS))
def hybrid_with_contents(spark, sf_dir):
    """Hybrid with a table of contents: cleaned, then normalised, then cut at the titles."""
    toc = table(spark, sf_dir, "documents").selectExpr("doc_id div 5 AS book_id", "doc_id % 5 + 1 AS pos", "'Chapter ' || CAST(doc_id % 5 + 1 AS STRING) || ': Part' AS title")
    return modern.process(books(spark, sf_dir), "raw", "book_id", "hybrid", toc)


@query(f"SELECT mode, count(*) AS chapters, CAST(sum(word_count) AS BIGINT) AS words, round(avg(confidence), 6) AS mean_confidence FROM (SELECT 'legacy' AS mode, * FROM ({_legacy_sql(_CLEAN_BOOKS)}) UNION ALL SELECT 'hybrid', * FROM ({_legacy_sql(_TWICE)}) UNION ALL SELECT 'modern', book_id, chapter_num, title, word_count, confidence FROM ({_MODERN})) GROUP BY mode")
def mode_chapters(spark, sf_dir):
    return dispatch_chapters(spark, sf_dir).groupBy("mode").agg(F.count("*").alias("chapters"), F.sum("word_count").alias("words"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query(f"SELECT book_id, chapter_num, title, word_count, CAST(NULL AS VARCHAR) AS semantic_summary, CAST(0 AS BIGINT) AS topics, CAST({_simple_count('content')} AS BIGINT) AS chunks FROM ({CHAPTERS})")
def smart_format(spark, sf_dir):
    """Legacy chapters in the modern format."""
    rich = modern.smart(chapters(spark, sf_dir), chunking.simple_chunks(F.col("content")))
    return rich.select("book_id", "chapter_num", "title", "word_count", "semantic_summary", F.size("topics").cast("long").alias("topics"), F.size("chunks").cast("long").alias("chunks"))


# ---- results ----------------------------------------------------------------------------------------------------

_PICTURES = "SELECT book_id, doc_id, 'img/p' || CAST(doc_id % 50 AS VARCHAR) || '.png' AS file_path, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'Alt ' || CAST(doc_id AS VARCHAR) END AS alt_text, chapter_num AS position, 'png' AS format FROM (" + MARKUP + ")"


def _pictures(spark, sf_dir):
    alt = F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("Alt "), F.col("doc_id").cast("string")))
    return markup(spark, sf_dir).select("book_id", "doc_id", F.concat(F.lit("img/p"), (F.col("doc_id") % 50).cast("string"), F.lit(".png")).alias("file_path"), alt.alias("alt_text"), F.col("chapter_num").cast("long").alias("position"), F.lit("png").alias("format"))


@query(f"SELECT book_id, doc_id, file_path, coalesce(alt_text, '') AS alt_text, position, format FROM ({_PICTURES})")
def image_fields(spark, sf_dir):
    from .sources.catalogue import image_fields as fields

    return fields(_pictures(spark, sf_dir), "book_id", "doc_id")


@query(f"SELECT book_id, doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'out/' || CAST(book_id AS VARCHAR) || '_images/p' || CAST(doc_id % 50 AS VARCHAR) || '.png' END AS file_path, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'out/' || CAST(book_id AS VARCHAR) || '_images/p' || CAST(doc_id % 50 AS VARCHAR) || '.png' END AS local_path FROM ({_PICTURES})")
def image_copies(spark, sf_dir):
    rows = _pictures(spark, sf_dir).withColumn("file_path", F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("file_path"))).withColumn("base", F.col("book_id").cast("string"))
    return files.image_targets(rows, "out", "base").select("book_id", "doc_id", "file_path", "local_path")


_PICKED = "SELECT doc_id, file_path FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE file_path END AS file_path FROM (" + _PICTURES + ")) WHERE file_path IN (SELECT 'img/p' || CAST(item_id AS VARCHAR) || '.png' FROM benchmark)"


@query(_PICKED)
def existing_images(spark, sf_dir):
    from .sources.catalogue import existing_images as existing

    rows = _pictures(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("file_path")).alias("file_path"))
    there = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("img/p"), F.col("item_id").cast("string"), F.lit(".png")).alias("path"))
    return existing(rows, there).select("doc_id", "file_path")


@query(f"""WITH d AS ({_BEST}), t AS (SELECT book_id, doc_id, CAST(chapter_num AS BIGINT) AS chapter_num, {cleaned('raw')} AS content, 'page_' || CAST(doc_id % 50 AS VARCHAR) || '.png' AS image_name FROM ({MARKUP})),
 r AS (SELECT book_id, doc_id, chapter_num, CASE WHEN d.description IS NULL THEN content ELSE {_described('content', media.CHAPTER_SPELLINGS)} END AS content FROM t LEFT JOIN d USING (image_name))
 SELECT *, {wc('content')} AS word_count, round({wc('content')} / 200.0, 6) AS estimated_duration FROM r""")
def image_integrate_chapters(spark, sf_dir):
    rows = once(markup(spark, sf_dir), "content", T.clean(F.col("raw"))).select("book_id", "doc_id", F.col("chapter_num").cast("long").alias("chapter_num"), "content")
    return media.integrate_chapters(rows.withColumn("estimated_duration", F.lit(0.0)), _descriptions(spark, sf_dir), "doc_id")


_BY_BOOK = "SELECT doc_id // 5 AS book_id, min(source) AS source, min(lang) AS lang FROM documents GROUP BY 1"


def _json_text(expr: str) -> str:
    return f"to_json({expr})::VARCHAR"


@query(f"""WITH c AS (SELECT book_id, list({{'chapter_num': chapter_num, 'title': title, 'content': content, 'word_count': word_count}} ORDER BY chapter_num) AS l FROM ({CHAPTERS}) GROUP BY book_id),
 i AS (SELECT book_id, list({{'file_path': file_path, 'alt_text': coalesce(alt_text, ''), 'position': CAST(position AS BIGINT)}} ORDER BY doc_id) AS l FROM ({_PICTURES}) GROUP BY book_id)
 SELECT CAST(b.book_id AS BIGINT) AS book_id, {_json_text("{'metadata': {'title': 'Book ' || CAST(b.book_id AS VARCHAR), 'language': lang, 'authors': [source]}, 'text': list_reduce(list_transform(c.l, lambda x: x.content), lambda a, x: a || chr(10) || chr(10) || x), 'chapters': c.l, 'images': i.l}")} AS document FROM ({_BY_BOOK}) b JOIN c ON b.book_id = c.book_id JOIN i ON b.book_id = i.book_id""")
def document_json(spark, sf_dir):
    fields = F.struct("chapter_num", "title", "content", "word_count")
    listed = chapters(spark, sf_dir).groupBy("book_id").agg(F.sort_array(F.collect_list(fields)).alias("c"))
    pictures = _pictures(spark, sf_dir).groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("doc_id", F.struct("file_path", F.coalesce("alt_text", F.lit("")).alias("alt_text"), "position").alias("p")))).alias("i"))
    whole = _by_book(spark, sf_dir).join(listed, "book_id").join(pictures, "book_id")
    metadata = F.struct(F.concat(F.lit("Book "), F.col("book_id").cast("string")).alias("title"), F.col("lang").alias("language"), F.array("source").alias("authors"))
    return whole.select("book_id", reports.document_json(metadata, F.array_join(F.col("c.content"), "\n\n"), F.col("c"), F.col("i.p")).alias("document"))


def _by_book(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.expr("doc_id div 5").alias("book_id")).agg(F.min("source").alias("source"), F.min("lang").alias("lang"))


_SHOWN = "SELECT doc_id // 5 AS book_id, count(*) AS images, count(*) FILTER (WHERE (doc_id % 10) / 10.0 > 0.7) AS high, avg((doc_id % 10) / 10.0) AS mean FROM documents WHERE doc_id % 3 = 0 GROUP BY 1"


def _shown(spark, sf_dir):
    c = (F.col("doc_id") % 10) / 10.0
    return table(spark, sf_dir, "documents").filter("doc_id % 3 = 0").groupBy(F.expr("doc_id div 5").alias("book_id")).agg(F.count("*").alias("images"), F.count_if(c > 0.7).alias("high"), F.avg(c).alias("mean"))


@query(f"""WITH c AS (SELECT book_id, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars, CAST(sum(word_count) AS BIGINT) AS words FROM ({CHAPTERS}) GROUP BY book_id)
 SELECT CAST(c.book_id AS BIGINT) AS book_id, {_json_text("{'book_metadata': {'language': lang, 'author': source}, 'processing_stats': {'total_chapters': c.n, 'total_text_length': c.chars, 'total_word_count': c.words, 'images_processed': coalesce(s.images, 0), 'tts_enabled': c.book_id % 2 = 0}, 'pipeline_info': {'text_format': 'plain'}}")} AS metadata
 FROM c JOIN ({_BY_BOOK}) b ON c.book_id = b.book_id LEFT JOIN ({_SHOWN}) s ON c.book_id = s.book_id""")
def processing_metadata(spark, sf_dir):
    totals = chapters(spark, sf_dir).groupBy("book_id").agg(F.count("*").alias("total_chapters"), F.sum(F.length("content")).cast("long").alias("total_text_length"), F.sum("word_count").alias("total_word_count"))
    both = totals.join(_by_book(spark, sf_dir), "book_id").join(_shown(spark, sf_dir), "book_id", "left")
    stats = F.struct("total_chapters", "total_text_length", "total_word_count", F.coalesce("images", F.lit(0)).alias("images_processed"), (F.col("book_id") % 2 == 0).alias("tts_enabled"))
    return both.select("book_id", F.to_json(F.struct(F.struct(F.col("lang").alias("language"), F.col("source").alias("author")).alias("book_metadata"), stats.alias("processing_stats"), F.struct(F.lit("plain").alias("text_format")).alias("pipeline_info"))).alias("metadata"))


def _tenth(expr: str, digits: int = 1) -> str:
    return f"printf('%.{digits}f', {expr})"


def _report_sql() -> str:
    title, about, text, listing, pictures, _, done = map(R.quoted, reports.REPORT)
    comma = lambda e: f"format('{{:,}}', CAST({e} AS BIGINT))"
    row = f"'  ' || CAST(chapter_num AS VARCHAR) || '. ' || title || {NL} || '     Words: ' || {comma('word_count')} || ', Duration: ' || {_tenth('CAST(round(CAST(word_count AS DECIMAL(18,6)) / 200, 1) AS DOUBLE)')} || ' min' || {NL}"
    per = f"SELECT book_id, count(*) AS n, sum(length(content)) AS chars, sum(word_count) AS words, string_agg({row}, '' ORDER BY chapter_num) AS rows_ FROM ({CHAPTERS}) GROUP BY book_id"
    seen = f"CASE WHEN s.images > 0 THEN {pictures} || '  Images processed: ' || CAST(s.images AS VARCHAR) || {NL} || '  High confidence descriptions: ' || CAST(s.high AS VARCHAR) || {NL} || '  Average confidence: ' || {_tenth('s.mean100', 2)} || {NL} || {NL} ELSE '' END"
    shown = f"SELECT *, CAST(round(CAST(mean AS DECIMAL(18,6)), 2) AS DOUBLE) AS mean100 FROM ({_SHOWN})"
    body = f"{title} || {about} || '  Language: ' || lang || {NL} || '  Author: ' || source || {NL} || {NL} || {text} || '  Chapters extracted: ' || CAST(c.n AS VARCHAR) || {NL} || '  Total text length: ' || {comma('c.chars')} || ' characters' || {NL} || '  Total word count: ' || {comma('c.words')} || ' words' || {NL} || {NL} || {listing} || c.rows_ || {NL} || {seen} || {done}"
    return f"SELECT CAST(c.book_id AS BIGINT) AS book_id, {body} AS report FROM ({per}) c JOIN ({_BY_BOOK}) b ON c.book_id = b.book_id LEFT JOIN ({shown}) s ON c.book_id = s.book_id"


@query(_report_sql())
def processing_report(spark, sf_dir):
    minutes = F.round(F.col("word_count").cast("decimal(18,6)") / 200, 1).cast("double")
    listed = chapters(spark, sf_dir).groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct(F.col("chapter_num").alias("n"), "title", F.col("word_count").alias("words"), minutes.alias("minutes")))).alias("c"), F.sum(F.length("content")).alias("chars"), F.sum("word_count").alias("words"))
    both = listed.join(_by_book(spark, sf_dir), "book_id").join(_shown(spark, sf_dir), "book_id", "left")
    book = F.array(*(F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in (("language", "lang"), ("author", "source"), ("publisher", "nobody"))))
    none = F.lit(None).cast("double")
    mean = F.round(F.col("mean").cast("decimal(18,6)"), 2).cast("double")
    return both.withColumn("nobody", F.lit(None).cast("string")).select("book_id", reports.report(book, F.col("chars"), F.col("words"), F.col("c"), none.cast("long"), none, F.col("images"), F.col("high"), mean, none.cast("long"), none).alias("report"))


@query(f"SELECT CAST(sum(original_length) AS BIGINT) AS original_length, CAST(sum(cleaned_length) AS BIGINT) AS cleaned_length, CAST(sum(characters_removed) AS BIGINT) AS characters_removed, round(sum(cleaned_length) / sum(original_length), 6) AS compression_ratio, CAST(sum(patterns_applied) AS BIGINT) AS patterns_applied, CAST(sum(transformations_made) AS BIGINT) AS transformations_made FROM ({_stats_sql()})")
def cleaning_totals(spark, sf_dir):
    return reports.cleaning_totals(clean_stats(spark, sf_dir))


@query(f"SELECT 'legacy' AS mode, doc_id, {cleaned('raw')} AS cleaned FROM ({MARKUP}) UNION ALL SELECT 'modern', doc_id, {R.apply_duck('raw', R.MODERN)} FROM ({MARKUP})")
def clean_by_mode(spark, sf_dir):
    raw = once(once(markup(spark, sf_dir), "l", modern.clean_only(F.col("raw"), "legacy")), "m", modern.clean_only(F.col("raw"), "modern"))
    return raw.select("doc_id", F.explode(F.array(*(F.struct(F.lit(mode).alias("mode"), F.col(c).alias("cleaned")) for mode, c in (("legacy", "l"), ("modern", "m"))))).alias("x")).select("x.mode", "doc_id", "x.cleaned")


@query("SELECT doc_id, base64(encode(text)) AS data, text = decode(from_base64(base64(encode(text)))) AS same FROM documents")
def inline_images(spark, sf_dir):
    data = media.inline(F.encode("text", "utf-8"))
    return table(spark, sf_dir, "documents").select("doc_id", data.alias("data"), (F.decode(F.unbase64(data), "utf-8") == F.col("text")).alias("same"))


_AUTHOR = "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE source END"


@query(f"SELECT doc_id, {_json_text("{'title': lang || ' ' || CAST(doc_id AS VARCHAR), 'author': a, 'authors': CASE WHEN coalesce(a, '') = '' THEN [] WHEN len(l) > 0 THEN l ELSE [a] END, 'language': lang, 'subjects': [source], 'original_format': 'epub', 'file_size': n_chars}")} AS metadata FROM (SELECT *, coalesce({_AUTHOR}, 'nobody') AS a, CASE doc_id % 3 WHEN 0 THEN CAST([] AS VARCHAR[]) ELSE [source, 'x'] END AS l FROM documents)")
def book_metadata_json(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("a", F.coalesce(F.expr(_AUTHOR), F.lit("nobody"))).withColumn("l", F.when(F.col("doc_id") % 3 != 0, F.array("source", F.lit("x"))).otherwise(F.array().cast("array<string>")))
    none = F.lit(None).cast("string")
    fields = reports.book_metadata(F.concat_ws(" ", "lang", F.col("doc_id").cast("string")), F.col("a"), F.col("l"), none, none, F.col("lang"), none, none, F.array("source"), F.col("n_chars"))
    return rows.select("doc_id", F.to_json(fields).alias("metadata"))
