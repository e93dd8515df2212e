"""Registered queries of the narration operators and their DuckDB oracles.

The plain tables set off few rules, so queries work on texts marked up from them in the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import splitters
from .operators import chapters as C
from .operators import chunking, language, media, modern, progress
from .operators import text as T
from .plans import rules as R
from .plans.session import once, spread
from .sources import epub
from .streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Z = R.STRIP
NL = "chr(10)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for long chains of expressions, on all cores."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def wc(expr: str) -> str:
    return f"CAST(len(regexp_extract_all({expr}, '[^{Z}]+')) AS BIGINT)"


def duck_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{Z}]+|[{Z}]+$', '', 'g')"


# ---- inputs: books of up to five marked-up chapters -------------------------------------------------------------

_PIECES = [
    "'# Chapter '", "n", "': Part, '", "d", "chr(10)", "chr(10)", "t", "'['", "f", "']'", "chr(10)", "'Page '", "n", "' of 9'", "chr(10)", "'\"Said '", "d", "', then — more…\"'",
    "chr(10)", "'![page_'", "p", "'.png](img/a.png)'", "chr(10)", "'<b>x</b> **bold** *mild* is 5% of $3 & more? yes! ok'",
]
_DUCK = {"n": "CAST(doc_id % 5 + 1 AS VARCHAR)", "d": "CAST(doc_id AS VARCHAR)", "t": "coalesce(text, '')", "f": "CAST(doc_id % 9 + 1 AS VARCHAR)", "p": "CAST(doc_id % 50 AS VARCHAR)"}
_SPARK = {k: v.replace("VARCHAR", "STRING") for k, v in _DUCK.items()}
MARKUP = f"SELECT CAST(doc_id // 5 AS BIGINT) AS book_id, CAST(doc_id % 5 + 1 AS BIGINT) AS chapter_num, doc_id, {' || '.join(_DUCK.get(p, p) for p in _PIECES)} AS raw FROM documents"
BOOKS = f"SELECT book_id, string_agg(raw, chr(10) || chr(10) ORDER BY chapter_num, doc_id) AS raw FROM ({MARKUP}) GROUP BY book_id"


def markup(spark: SparkSession, sf_dir: str, key: str = "doc_id") -> DataFrame:
    """Marked-up texts, dealt by doc_id or by book_id."""
    raw = " || ".join(_SPARK.get(p, p) for p in _PIECES)
    rows = spread(table(spark, sf_dir, "documents").selectExpr("doc_id div 5 AS book_id", "doc_id", "text"), key)
    return rows.selectExpr("book_id", "doc_id % 5 + 1 AS chapter_num", "doc_id", f"{raw} AS raw")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = markup(spark, sf_dir, "book_id").groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("chapter_num", "doc_id", "raw"))).alias("r"))
    return rows.select("book_id", F.array_join(F.col("r.raw"), "\n\n").alias("raw"))


def cleaned(expr: str) -> str:
    return f"CASE WHEN len(regexp_extract_all({expr}, '[^{Z}]')) = 0 THEN {expr} ELSE {R.apply_duck(expr, R.CLEAN)} END"


# ---- cleaning ---------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {cleaned('raw')} AS cleaned FROM ({MARKUP})")
def clean_text(spark, sf_dir):
    return markup(spark, sf_dir).select("doc_id", T.clean(F.col("raw")).alias("cleaned"))


@query(f"SELECT doc_id, {cleaned('text')} AS cleaned FROM documents")
def clean_documents(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.clean(F.col("text")).alias("cleaned"))


def _stats_sql() -> str:
    rules = R.REMOVE + R.TRANSFORM
    inner = f"SELECT doc_id, raw AS s0 FROM ({MARKUP})"
    for k, rule in enumerate(rules):
        inner = f"SELECT *, {rule.duck(f's{k}')} AS s{k + 1} FROM ({inner})"
    change = [f"(CASE WHEN s{k} <> s{k + 1} THEN 1 ELSE 0 END)" for k in range(len(rules))]
    last = R.apply_duck(f"s{len(rules)}", R.CHARACTERS + R.SPACING + R.PAUSES)
    base = f"SELECT doc_id, CAST(length(s0) AS BIGINT) AS original_length, CAST(length({last}) AS BIGINT) AS cleaned_length, CAST({' + '.join(change)} AS BIGINT) AS patterns_applied, CAST({' + '.join(change[len(R.REMOVE):])} AS BIGINT) AS transformations_made FROM ({inner})"
    return f"SELECT *, CASE WHEN original_length = 0 THEN 0.0 ELSE round(cleaned_length / original_length, 6) END AS compression_ratio, original_length - cleaned_length AS characters_removed FROM ({base})"


@query(_stats_sql())
def clean_stats(spark, sf_dir):
    return T.clean_stats(markup(spark, sf_dir), "raw", "doc_id")


def _group(name: str, rules) -> None:
    def run(spark, sf_dir):
        return markup(spark, sf_dir).select("doc_id", R.apply(F.col("raw"), rules).alias("out"))

    run.__name__ = name
    query(f"SELECT doc_id, {R.apply_duck('raw', rules)} AS out FROM ({MARKUP})")(run)


for _name, _rules in (("remove_rules", R.REMOVE), ("transform_rules", R.TRANSFORM), ("tts_char_map", R.CHARACTERS), ("whitespace_rules", R.SPACING), ("pause_markers", R.PAUSES), ("normalize_modern", R.MODERN), ("phoneme_clean", R.PHONEME)):
    _group(_name, _rules)

_tags = R.REMOVE[3:4] + R.SPACING


@query(f"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, {R.apply_duck('html', _tags)} AS body FROM pages")
def clean_html_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), R.apply(F.col("html"), _tags).alias("body"))


def _lowering(style: str) -> None:
    def run(spark, sf_dir):
        out = once(markup(spark, sf_dir), "lowered", T.lower(T.clean(F.col("raw")), style)).select("doc_id", "lowered")
        return out.withColumn("error", F.when(F.col("lowered") == "", "Empty text after preprocessing"))

    run.__name__ = f"lower_{style}"
    rules = R.apply_duck("c", R.LOWERINGS[style])
    query(f"SELECT doc_id, lowered, CASE WHEN lowered = '' THEN 'Empty text after preprocessing' END AS error FROM (SELECT doc_id, {rules} AS lowered FROM (SELECT doc_id, {cleaned('raw')} AS c FROM ({MARKUP})))")(run)


for _style in R.LOWERINGS:
    _lowering(_style)

# ---- chapters ---------------------------------------------------------------------------------------------------

_SPANS = """SELECT {key}, CAST(i AS BIGINT) AS chapter_num, {t} AS title, {c} AS content FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM (
 SELECT *, regexp_extract_all(txt, p, {g}) AS titles, string_split_regex(txt, p) AS parts, len(regexp_extract_all(txt, p, {g})) AS n FROM ({src})))"""


def _measured_sql(src: str) -> str:
    return f"SELECT *, {wc('content')} AS word_count, round({wc('content')} / 200.0, 6) AS estimated_duration FROM ({src}) WHERE content <> ''"



def _segments_sql(src: str, key: str, group: int) -> str:
    spans = _SPANS
    for name, value in (("{key}", key), ("{t}", duck_strip("titles[i]")), ("{c}", duck_strip("parts[i + 1]")), ("{g}", str(group)), ("{src}", src)):
        spans = spans.replace(name, value)
    whole = f"SELECT {key}, CAST(1 AS BIGINT), 'Full Text', txt FROM ({src}) WHERE p IS NULL OR len(regexp_extract_all(txt, p)) = 0"
    return _measured_sql(f"{spans} UNION ALL {whole}")


_MARKED = f"SELECT book_id, {cleaned('raw')} AS txt, '{R.MARKER}' AS p FROM ({BOOKS})"
CHAPTERS = _segments_sql(_MARKED, "book_id", 1)


def chapters(spark, sf_dir) -> DataFrame:
    return C.by_marker(books(spark, sf_dir).select("book_id", T.clean(F.col("raw")).alias("raw")), "raw", "book_id")


@query(CHAPTERS)
def segment_by_marker(spark, sf_dir):
    return chapters(spark, sf_dir)


@query(f"SELECT book_id, count(*) AS chapters, CAST(sum(word_count) AS BIGINT) AS total_words, CAST(sum(length(content)) AS BIGINT) AS total_chars, round(sum(word_count) / 200.0, 6) AS minutes FROM ({CHAPTERS}) GROUP BY book_id")
def book_totals(spark, sf_dir):
    return chapters(spark, sf_dir).groupBy("book_id").agg(
        F.count("*").alias("chapters"), F.sum("word_count").alias("total_words"), F.sum(F.length("content")).cast("long").alias("total_chars"), F.round(F.sum("word_count") / 200.0, 6).alias("minutes")
    )


_CASES = " ".join(f"WHEN regexp_matches(txt, {R.quoted('(?mi)' + p.replace('<S>', R.SPACE))}) THEN {R.quoted('(?mi)' + p.replace('<S>', R.SPACE))}" for p in R.HEADINGS)


@query(_segments_sql(f"SELECT *, CASE {_CASES} END AS p FROM (SELECT book_id, raw AS txt FROM ({BOOKS}))", "book_id", 0))
def segment_by_pattern(spark, sf_dir):
    return C.by_headings(books(spark, sf_dir), "raw", "book_id")


def _low(expr: str) -> str:
    return f"translate({expr}, '{C.UPPER}', '{C.LOWER}')"


_TOC = "SELECT CAST(doc_id // 5 AS BIGINT) AS book_id, doc_id % 5 + 1 AS pos, 'Chapter ' || CAST(doc_id % 5 + 1 AS VARCHAR) || ': Part, ' || CAST(doc_id AS VARCHAR) AS title FROM documents"
def _toc_sql(toc: str, src: str) -> str:
    """Chapters of src (book_id, raw) by the titles in toc (book_id, pos, title)."""
    at, after = f"strpos({_low('raw')}, {_low('title')})", f"strpos({_low('rest')}, {_low('nx')})"
    body = duck_strip(f"CASE WHEN nx IS NOT NULL AND {after} > 0 THEN substr(rest, 1, CAST({after} - 1 AS BIGINT)) ELSE rest END")
    return f"""WITH e AS (SELECT *, lead(title) OVER (PARTITION BY book_id ORDER BY pos) AS nx FROM ({toc})),
 b AS (SELECT e.*, raw, CASE WHEN {at} > 0 THEN {at} - 1 + length(title) ELSE 0 END AS st FROM e JOIN ({src}) USING (book_id)),
 r AS (SELECT *, substr(raw, CAST(st + 1 AS BIGINT)) AS rest FROM b)
 SELECT *, CAST(1 AS DOUBLE) AS confidence FROM ({_measured_sql(f"SELECT book_id, CAST(pos AS BIGINT) AS chapter_num, title, {body} AS content FROM r")})"""


_TOC_SQL = _toc_sql(_TOC, BOOKS)


@query(_TOC_SQL)
def segment_by_toc(spark, sf_dir):
    toc = table(spark, sf_dir, "documents").selectExpr("doc_id div 5 AS book_id", "doc_id % 5 + 1 AS pos", "'Chapter ' || CAST(doc_id % 5 + 1 AS STRING) || ': Part, ' || CAST(doc_id AS STRING) AS title")
    return C.by_toc(books(spark, sf_dir), toc, "raw", "book_id")


@query(f"SELECT * FROM ({CHAPTERS}) WHERE word_count >= 100")
def filter_short_chapters(spark, sf_dir):
    return C.keep_long(chapters(spark, sf_dir))


SPLIT = f"""SELECT book_id, chapter_num, CASE WHEN n > 1 THEN title || ' - Part ' || CAST(k AS VARCHAR) ELSE title END AS title, CASE WHEN word_count > 200 THEN array_to_string(w[(k - 1) * 200 + 1 : k * 200], ' ') ELSE content END AS content, CAST(k AS BIGINT) AS part
 FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM (SELECT *, regexp_extract_all(content, '[^{Z}]+') AS w, CASE WHEN word_count > 200 THEN CAST(ceil(word_count / 200.0) AS BIGINT) ELSE 1 END AS n FROM ({CHAPTERS})))"""


@query(f"SELECT *, {wc('content')} AS word_count, round({wc('content')} / 200.0, 6) AS estimated_duration FROM ({SPLIT})")
def split_long_chapters(spark, sf_dir):
    return C.split_long(chapters(spark, sf_dir), 200)


@query(f"SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY chapter_num, part) AS BIGINT) AS chapter_num, title, part FROM (SELECT * FROM ({SPLIT}) WHERE {wc('content')} >= 20)")
def renumber_chapters(spark, sf_dir):
    return C.renumber(C.keep_long(C.split_long(chapters(spark, sf_dir), 200), 20), "book_id").select("book_id", "chapter_num", "title", "part")


@query(f"SELECT book_id, {R.quoted(C.HEADER)} || string_agg('Chapter ' || CAST(chapter_num AS VARCHAR) || ': ' || title || {NL} || '  Words: ' || CAST(word_count AS VARCHAR) || {NL} || '  Estimated duration: ' || printf('%.1f', CAST(round(CAST(word_count AS DECIMAL(18,6)) / 200, 1) AS DOUBLE)) || ' minutes' || {NL} || {NL}, '' ORDER BY chapter_num) AS toc FROM ({CHAPTERS}) GROUP BY book_id")
def chapter_toc(spark, sf_dir):
    rounded = chapters(spark, sf_dir).withColumn("estimated_duration", F.round(F.col("word_count").cast("decimal(18,6)") / 200, 1).cast("double"))
    return C.contents_table(rounded, "book_id")


@query(f"SELECT book_id, printf('chapter_%03d.txt', chapter_num) AS file, '# ' || title || {NL} || {NL} || content AS body FROM ({CHAPTERS})")
def chapter_files(spark, sf_dir):
    return chapters(spark, sf_dir).select("book_id", F.format_string("chapter_%03d.txt", "chapter_num").alias("file"), F.concat(F.lit("# "), "title", F.lit("\n\n"), "content").alias("body"))


@query(f"SELECT book_id, printf('chapter_%03d_', chapter_num) || substr(replace(regexp_replace(title, '[^\\p{{L}}\\p{{N}} _-]', '', 'g'), ' ', '_'), 1, 20) || CASE WHEN n > 1 THEN printf('_part_%02d', part) ELSE '' END AS chunk_id FROM (SELECT *, count(*) OVER (PARTITION BY book_id, chapter_num) AS n FROM ({SPLIT.replace(chr(39) + ' - Part ' + chr(39), chr(39) + ' ' + chr(39))}))")
def chunk_ids(spark, sf_dir):
    counted = C.split_long(chapters(spark, sf_dir), 200, parts_in="n")
    title = F.replace(F.col("title"), F.lit(" - Part "), F.lit(" "))
    part = F.when(F.col("n") > 1, F.format_string("_part_%02d", "part")).otherwise("")
    return counted.select("book_id", F.concat(F.format_string("chapter_%03d_", "chapter_num"), T.slug(title), part).alias("chunk_id"))


@query(f"""SELECT doc_id, line, CAST(round(least(1.0, 0.5 + c + p + g + f), 6) AS DOUBLE) AS confidence FROM (SELECT doc_id, line,
 CASE WHEN contains(lower(t), 'chapter') THEN 0.3 ELSE 0.0 END AS c, CASE WHEN contains(lower(t), 'part') OR contains(lower(t), 'section') THEN 0.2 ELSE 0.0 END AS p, CASE WHEN regexp_matches(t, '\\p{{Nd}}') THEN 0.1 ELSE 0.0 END AS g,
 (CASE WHEN {wc('t')} <= 5 THEN 0.1 ELSE 0.0 END) + (CASE WHEN regexp_matches(t, '{C.TITLE}') THEN 0.1 ELSE 0.0 END) AS f FROM (SELECT doc_id, unnest(l) AS t, CAST(unnest(range(1, len(l) + 1)) AS BIGINT) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))""")
def heading_confidence(spark, sf_dir):
    """How much each line of each text looks like a heading."""
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "t"))
    return lines.select("doc_id", (F.col("k") + 1).cast("long").alias("line"), C.heading_confidence(F.col("t")).alias("confidence"))


@query(f"""SELECT book_id, CAST(strpos(raw, t) - 1 AS BIGINT) AS start, t AS title, CAST(0.6 AS DOUBLE) AS confidence FROM (SELECT book_id, raw, {duck_strip('ps[i]')} AS t, ps[i + 1] AS nx FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT book_id, raw, string_split(raw, chr(10) || chr(10)) AS ps FROM ({BOOKS})))) WHERE t <> '' AND {wc('t')} <= 10 AND {wc('nx')} > 50""")
def heading_candidates(spark, sf_dir):
    return modern.structural_candidates(books(spark, sf_dir), "raw", "book_id").drop("method")


_EVENT_LISTS = """SELECT user_id, list({'start': CAST(event_id % 997 AS BIGINT), 'confidence': CAST(round(0.5 + (event_id % 6) / 10.0, 1) AS DOUBLE), 'title': CAST(event_id AS VARCHAR)} ORDER BY event_id % 997, round(0.5 + (event_id % 6) / 10.0, 1), CAST(event_id AS VARCHAR)) AS l FROM events GROUP BY user_id"""


def nms_sql(listed: str) -> str:
    """DuckDB expression: what the greedy filter leaves of a list of structs (start, confidence, title)."""
    none = "CAST([] AS STRUCT(start BIGINT, confidence DOUBLE, title VARCHAR)[])"
    first = "list_filter(a.k, lambda e: abs(e.start - x.c.start) < 100)[1]"
    step = f"CASE WHEN x.c.confidence < 0.6 THEN a WHEN {first} IS NULL THEN {{'c': a.c, 'k': list_append(a.k, x.c)}} WHEN x.c.confidence > ({first}).confidence THEN {{'c': a.c, 'k': list_append(list_filter(a.k, lambda e: e <> {first}), x.c)}} ELSE a END"
    none_c = "CAST(NULL AS STRUCT(start BIGINT, confidence DOUBLE, title VARCHAR))"
    return f"list_reduce(list_prepend({{'c': {none_c}, 'k': {none}}}, list_transform({listed}, lambda c: {{'c': c, 'k': {none}}})), lambda a, x: {step}).k"


@query(f"SELECT user_id, CAST(len(list_filter(l, lambda x: x.confidence >= 0.6)) AS BIGINT) AS candidates FROM ({_EVENT_LISTS})")
def heading_nms_input(spark, sf_dir):
    return _candidates(spark, sf_dir).select("user_id", F.size(F.filter("l", lambda x: x["confidence"] >= 0.6)).cast("long").alias("candidates"))


def _candidates(spark, sf_dir):
    c = F.struct((F.col("event_id") % 997).alias("start"), F.round(0.5 + (F.col("event_id") % 6) / 10.0, 1).alias("confidence"), F.col("event_id").cast("string").alias("title"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(c)).alias("l"))


@query(f"SELECT user_id, k.start AS start, k.confidence AS confidence, k.title AS title FROM (SELECT user_id, unnest({nms_sql('l')}) AS k FROM ({_EVENT_LISTS}))")
def heading_nms(spark, sf_dir):
    return _candidates(spark, sf_dir).select("user_id", F.explode(C.nms(F.col("l"))).alias("k")).select("user_id", "k.start", "k.confidence", "k.title")


# ---- documents: validation, info, metadata ----------------------------------------------------------------------

_ISSUES = "list_filter([CASE WHEN text IS NULL OR text = '' THEN 'no text' END, CASE WHEN {w} < 50 THEN 'fewer than 50 words' END, CASE WHEN {w} > 10000 THEN 'more than 10000 words' END, CASE WHEN length(text) < 1000 THEN 'short text' END, CASE WHEN regexp_matches(text, '[#*]{1,}') THEN 'residual markup' END], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, array_to_string({_ISSUES.replace('{w}', wc('text'))}, ';') AS issues FROM documents")
def diagnose_issues(spark, sf_dir):
    w, t = T.word_count(F.col("text")), F.col("text")
    found = F.array_compact(F.array(
        F.when(t.isNull() | (t == ""), "no text"), F.when(w < 50, "fewer than 50 words"), F.when(w > 10000, "more than 10000 words"), F.when(F.length(t) < 1000, "short text"), F.when(t.rlike("[#*]{1,}"), "residual markup"),
    ))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, ";").alias("issues"))


@query("SELECT page_id, array_to_string(list_filter([CASE WHEN NOT ends_with(lower(url), '.epub') THEN 'not an .epub' END, CASE WHEN length(html) = 0 THEN 'empty' WHEN length(html) < 1024 THEN 'too small' END, CASE WHEN regexp_extract(html, '<title>([^<]*)', 1) = '' THEN 'no title' END], lambda x: x IS NOT NULL), ';') AS issues FROM pages")
def validate_docs(spark, sf_dir):
    """Pages as if they were books, through the operator that checks these."""
    size = F.length("html").cast("long")
    books = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"), size.alias("file_size"), F.lit(None).cast("string").alias("error"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.col("html").alias("content"))
    return epub.validate(books, 1024, "page_id").select("page_id", F.array_join("issues", ";").alias("issues"))


@query(f"SELECT doc_id, {wc('text')} AS words, round(length(text) / 10000.0, 6) AS processing_seconds, round({wc('text')} / 200.0, 6) AS audio_minutes FROM documents")
def doc_info(spark, sf_dir):
    w = T.word_count(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", w.alias("words"), F.round(F.length("text") / 10000.0, 6).alias("processing_seconds"), F.round(w / 200.0, 6).alias("audio_minutes"))


@query("""SELECT doc_id, '{"identifier":"' || CAST(doc_id AS VARCHAR) || '","language":"' || lang || '","subjects":["' || source || '"],"authors":[' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '"' || source || '"' END || ']}' AS metadata FROM documents""")
def doc_metadata_json(spark, sf_dir):
    author = F.when(F.col("doc_id") % 3 != 0, F.col("source"))
    fields = F.struct(F.col("doc_id").cast("string").alias("identifier"), F.col("lang").alias("language"), F.array("source").alias("subjects"), F.when(author.isNotNull(), F.array(author)).otherwise(F.array().cast("array<string>")).alias("authors"))
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(fields).alias("metadata"))


@query(f"SELECT conv_id, turn, printf('%03d', turn + 1) || ' ' || role AS title, '[DIALOGUE_START]' || text || '[DIALOGUE_END]' AS spoken, {wc('text')} AS word_count, CAST(1 AS DOUBLE) AS confidence FROM conversations")
def dialogue_chapters(spark, sf_dir):
    spoken = F.concat(F.lit("[DIALOGUE_START]"), "text", F.lit("[DIALOGUE_END]"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.format_string("%03d", F.col("turn") + 1), F.lit(" "), "role").alias("title"), spoken.alias("spoken"), T.word_count(F.col("text")).alias("word_count"), F.lit(1.0).alias("confidence"))


@query("SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS path FROM pages WHERE regexp_matches(url, '^https?://[^/]*example[.]com/') UNION SELECT DISTINCT regexp_replace(url, '[?#].*$', '') FROM pages WHERE regexp_matches(url, '/en/')")
def path_union_dedup(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("path", F.regexp_replace("url", "[?#].*$", ""))
    return p.filter(p.url.rlike("^https?://[^/]*example[.]com/")).select("path").union(p.filter(p.url.rlike("/en/")).select("path")).distinct()


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT coalesce(b.k, o.k) AS k, coalesce(o.v, b.v) AS v FROM (SELECT doc_id AS k, lang AS v FROM documents) b FULL OUTER JOIN (SELECT doc_id AS k, CAST(quality AS VARCHAR) AS v FROM labels) o ON b.k = o.k")
def config_merge(spark, sf_dir):
    base = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.col("lang").alias("v"))
    over = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("k"), F.col("quality").cast("string").alias("w"))
    return base.join(over, "k", "full").select("k", F.coalesce("w", "v").alias("v"))


@query("SELECT 'both' AS side, doc_id FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'left', doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'right', doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def metadata_set_compare(spark, sf_dir):
    a, b = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    tag = lambda df, s: df.select(F.lit(s).alias("side"), "doc_id")
    return tag(a.intersect(b), "both").union(tag(a.subtract(b), "left")).union(tag(b.subtract(a), "right"))


@query("SELECT doc_id, CAST(0.5 + doc_id % 20 / 10.0 BETWEEN 0.5 AND 2.0 AS BOOLEAN) AS speed_ok, [16000, 22050, 44100, 48000, 8000][CAST(doc_id % 5 + 1 AS BIGINT)] IN (16000, 22050, 44100, 48000) AS rate_ok FROM documents")
def config_checks(spark, sf_dir):
    rate = F.element_at(F.array(*map(F.lit, (16000, 22050, 44100, 48000, 8000))), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", (0.5 + F.col("doc_id") % 20 / 10.0).between(0.5, 2.0).alias("speed_ok"), rate.isin(16000, 22050, 44100, 48000).alias("rate_ok"))


# ---- chunks -----------------------------------------------------------------------------------------------------


def _packer_sql(limit: int) -> str:
    e = "CAST([] AS VARCHAR[])"
    w = f"list_reduce(list_prepend({{'cur': '', 'out': {e}}}, list_transform(regexp_extract_all(s.cur, '[^{Z}]+'), lambda w: {{'cur': w, 'out': {e}}})), lambda g, w: CASE WHEN length(g.cur) + length(w.cur) + 1 > {limit} THEN CASE WHEN g.cur <> '' THEN {{'cur': w.cur, 'out': list_append(g.out, g.cur)}} ELSE {{'cur': g.cur, 'out': list_append(g.out, w.cur[1:{limit}])}} END ELSE {{'cur': CASE WHEN g.cur = '' THEN w.cur ELSE g.cur || ' ' || w.cur END, 'out': g.out}} END)"
    step = f"CASE WHEN length(a.cur) + length(s.cur) + 1 > {limit} THEN CASE WHEN a.cur <> '' THEN {{'cur': s.cur, 'out': list_append(a.out, {duck_strip('a.cur')})}} ELSE {{'cur': ({w}).cur, 'out': list_concat(a.out, ({w}).out)}} END ELSE {{'cur': CASE WHEN a.cur = '' THEN s.cur ELSE a.cur || ' ' || s.cur END, 'out': a.out}} END"
    sents = f"list_transform(string_split(regexp_replace(text, '([.!?])[{Z}]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {{'cur': s, 'out': {e}}})"
    fold = f"list_reduce(list_prepend({{'cur': '', 'out': {e}}}, {sents}), lambda a, s: {step})"
    done = f"SELECT doc_id, list_filter(CASE WHEN f.cur <> '' THEN list_append(f.out, {duck_strip('f.cur')}) ELSE f.out END, lambda c: {duck_strip('c')} <> '') AS l FROM (SELECT doc_id, {fold} AS f FROM documents)"
    return f"SELECT doc_id, CAST(i AS BIGINT) AS part, l[i] AS chunk FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM ({done}))"


def _packed(limit: int) -> None:
    def run(spark, sf_dir):
        rows = documents(spark, sf_dir).select("doc_id", F.posexplode(chunking.sentence_chunks(F.col("text"), limit)).alias("k", "chunk"))
        return rows.select("doc_id", (F.col("k") + 1).cast("long").alias("part"), "chunk")

    run.__name__ = f"chunk_sentences_{limit}"
    query(_packer_sql(limit))(run)


for _limit in (500, 2500, 5000):
    _packed(_limit)


def _simple_sql() -> str:
    e = "CAST([] AS VARCHAR[])"
    held = f"CASE WHEN a.cur <> '' THEN list_append(a.out, {duck_strip('a.cur')}) ELSE a.out END"
    fold = f"list_reduce(list_prepend({{'cur': '', 'out': {e}}}, list_transform(string_split(text, '. '), lambda s: {{'cur': s, 'out': {e}}})), lambda a, s: CASE WHEN length(a.cur) + length(s.cur) > 4000 THEN {{'cur': s.cur, 'out': {held}}} ELSE {{'cur': a.cur || s.cur || '. ', 'out': a.out}} END)"
    done = f"SELECT doc_id, CASE WHEN {duck_strip('f.cur')} <> '' THEN list_append(f.out, {duck_strip('f.cur')}) ELSE f.out END AS l FROM (SELECT doc_id, {fold} AS f FROM documents)"
    return f"SELECT doc_id, printf('simple_%03d', i - 1) AS id, l[i] AS chunk, {wc('l[i]')} AS word_count FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM ({done}))"


@query(_simple_sql())
def chunk_simple_4000(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(chunking.simple_chunks(F.col("text"))).alias("k", "chunk"))
    return rows.select("doc_id", F.format_string("simple_%03d", "k").alias("id"), "chunk", T.word_count(F.col("chunk")).alias("word_count"))


@query()
def chunk_recursive_4000(spark, sf_dir):
    """The recursive splitter has no SQL form; tests hold it against its rules."""
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(splitters.recursive_chunks(F.col("text"))).alias("k", "chunk"))
    return rows.select("doc_id", F.format_string("recursive_%03d", "k").alias("id"), "chunk", T.word_count(F.col("chunk")).alias("word_count"))


_W = wc("text")


@query(f"SELECT doc_id, round({_W} / 200.0, 6) AS text_minutes, round(length(text) / 150.0 * 60, 6) AS by_chars_seconds, round(greatest({_W} / 150.0 * 60, 0.5), 6) AS by_words_seconds FROM documents")
def duration_estimates(spark, sf_dir):
    w = T.word_count(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(w / 200.0, 6).alias("text_minutes"), F.round(F.length("text") / 150.0 * 60, 6).alias("by_chars_seconds"), F.round(F.greatest(w / 150.0 * 60, F.lit(0.5)), 6).alias("by_words_seconds"))


@query("SELECT doc_id, CASE WHEN len(l) = 0 THEN NULL WHEN len(l) = 1 THEN l[1] ELSE l[1] || ' ... ' || l[-1] END AS summary FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[" + Z + "]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: " + duck_strip("s") + "), lambda s: s <> '') AS l FROM documents)")
def summary_first_last(spark, sf_dir):
    sentences = F.filter(F.transform(F.split("text", rf"(?<=[.!?])[{R.JAVA_STRIP}]+", -1), T.strip), lambda s: s != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", sentences.alias("l"))
    return rows.select("doc_id", F.when(F.size("l") == 1, F.col("l")[0]).when(F.size("l") > 1, F.concat(F.element_at("l", 1), F.lit(" ... "), F.element_at("l", -1))).alias("summary"))


@query(f"""WITH w AS (SELECT doc_id, lower(unnest(l)) AS word, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[^{Z}.,]+') AS l FROM documents)),
 c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM w WHERE length(word) > 3 GROUP BY doc_id, word)
 SELECT doc_id, rank, word, n FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS BIGINT) AS rank FROM c) WHERE rank <= 5""")
def topics_topk(spark, sf_dir):
    """The five most common longer words of each document, ties by first occurrence; words stand in for noun phrases."""
    words = F.transform(F.regexp_extract_all("text", F.lit(f"[^{R.JAVA_STRIP}.,]+"), F.lit(0)), F.lower)
    return language.frequent(documents(spark, sf_dir), F.filter(words, lambda w: F.length(w) > 3), "doc_id", 5)


# ---- images -----------------------------------------------------------------------------------------------------

_KEY = "substr(md5({a}), 1, 16) || '_' || substr(md5({b}), 1, 8)"
_IMAGES = f"SELECT doc_id, {_KEY.format(a='text', b='source')} AS cache_key FROM documents"
_CACHE = f"SELECT {_KEY.format(a='text', b='source')} AS cache_key FROM documents WHERE doc_id % 3 = 0"


def _keys(spark, sf_dir, where="true"):
    return table(spark, sf_dir, "documents").filter(where).select("doc_id", media.cache_key(F.col("text"), F.col("source")).alias("cache_key"))


@query(_IMAGES)
def image_cache_key(spark, sf_dir):
    return _keys(spark, sf_dir)


@query(f"SELECT * FROM ({_IMAGES}) WHERE cache_key IN ({_CACHE})")
def image_cache_hits(spark, sf_dir):
    return media.cache_hits(_keys(spark, sf_dir), _keys(spark, sf_dir, "doc_id % 3 = 0").select("cache_key"))


@query(f"SELECT * FROM ({_IMAGES}) WHERE cache_key NOT IN ({_CACHE})")
def image_cache_misses(spark, sf_dir):
    return media.cache_misses(_keys(spark, sf_dir), _keys(spark, sf_dir, "doc_id % 3 = 0").select("cache_key"))


_DESC = "SELECT 'page_' || CAST(doc_id % 50 AS VARCHAR) || '.png' AS image_name, 'seen ' || CAST(doc_id AS VARCHAR) AS description, (doc_id % 10) / 10.0 AS confidence, doc_id AS seq FROM documents WHERE doc_id % 2 = 1"


_PLACED = "' [IMAGE: ' || image_name || '] ![' || image_name || '] ![Image of ' || image_name || ']'"


def _described(expr: str, spellings) -> str:
    for shape in spellings:
        a, b = shape.split("%s")
        expr = f"replace({expr}, '{a}' || d.image_name || '{b}', '[IMAGE DESCRIPTION: ' || d.description || ']')"
    return expr


_BEST = f"SELECT image_name, max_by(description, seq) AS description FROM ({_DESC}) WHERE confidence > 0.5 GROUP BY image_name"


@query(f"""WITH d AS ({_BEST}) SELECT doc_id, CASE WHEN d.description IS NULL THEN t ELSE {_described('t', media.SPELLINGS)} END AS text
 FROM (SELECT doc_id, image_name, c || {_PLACED} AS t FROM (SELECT doc_id, {cleaned('raw')} AS c, 'page_' || CAST(doc_id % 50 AS VARCHAR) || '.png' AS image_name FROM ({MARKUP}))) LEFT JOIN d USING (image_name)""")
def image_integrate(spark, sf_dir):
    texts = once(markup(spark, sf_dir), "c", T.clean(F.col("raw"))).selectExpr("doc_id", "'page_' || CAST(doc_id % 50 AS STRING) || '.png' AS image_name", "c").selectExpr("doc_id", f"c || {_PLACED} AS text")
    return media.integrate(texts, _descriptions(spark, sf_dir), "doc_id").select("doc_id", "text")


def _descriptions(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("doc_id % 2 = 1").selectExpr("'page_' || CAST(doc_id % 50 AS STRING) || '.png' AS image_name", "'seen ' || CAST(doc_id AS STRING) AS description", "(doc_id % 10) / 10.0 AS confidence", "doc_id AS seq")


_D0 = "regexp_replace(text, '^[\"'']+|[\"'']+$', '', 'g')"


@query(f"""WITH a AS (SELECT doc_id, {_D0} AS t FROM documents), b AS (SELECT doc_id, CASE WHEN t <> '' AND NOT regexp_matches(t, '[.!?]$') THEN t || '.' ELSE t END AS t FROM a),
 c AS (SELECT doc_id, replace(replace(upper(substr(t, 1, 1)) || substr(t, 2), '"', ''), '''', '') AS t FROM b),
 d AS (SELECT *, regexp_replace(list_reduce(list_prepend({{'t': '', 'go': true}}, list_transform(string_split(t, '.'), lambda s: {{'t': s, 'go': true}})), lambda acc, s: CASE WHEN acc.go AND length(acc.t) + length(s.t) + 1 <= 150 THEN {{'t': acc.t || s.t || '.', 'go': true}} ELSE {{'t': acc.t, 'go': false}} END).t, '[.]+$', '') AS cut FROM c)
 SELECT doc_id, CASE WHEN length(t) > 150 THEN CASE WHEN cut <> '' AND NOT regexp_matches(cut, '[.!?]$') THEN cut || '.' ELSE cut END ELSE t END AS description FROM d""")
def description_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", media.clean_description(F.col("text"), 150).alias("description"))


@query("SELECT doc_id, round(greatest(0.0, least(1.0, CASE WHEN contains(lower(t), 'error') OR contains(lower(t), 'unavailable') THEN 0.1 WHEN length(t) < 20 THEN 0.6 ELSE 0.8 END - CASE WHEN doc_id % 2 = 0 THEN 0.1 ELSE 0.0 END)), 6)::DOUBLE AS confidence FROM (SELECT doc_id, text AS t FROM documents)")
def description_confidence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", media.description_confidence(F.col("text"), F.col("doc_id") % 2 == 0).alias("confidence"))


@query("SELECT doc_id, CAST(floor(w * least(1.0, 1024 / greatest(w, h))) AS BIGINT) AS width, CAST(floor(h * least(1.0, 1024 / greatest(w, h))) AS BIGINT) AS height FROM (SELECT doc_id, doc_id % 3000 + 1 AS w, n_chars % 2500 + 1 AS h FROM documents)")
def image_fit(spark, sf_dir):
    size = media.fitted_size(F.col("doc_id") % 3000 + 1, F.col("n_chars") % 2500 + 1)
    return table(spark, sf_dir, "documents").select("doc_id", size.alias("s")).select("doc_id", "s.width", "s.height")


@query("SELECT count(*) AS images, count(*) FILTER (WHERE c > 0.7) AS high, count(*) FILTER (WHERE c > 0) AS processed, round(avg(c), 6) AS mean_confidence FROM (SELECT (quality * 6 + doc_id % 4) / 10.0 AS c FROM labels)")
def image_report(spark, sf_dir):
    c = (F.col("quality") * 6 + F.col("doc_id") % 4) / 10.0
    return table(spark, sf_dir, "labels").select(c.alias("c")).agg(F.count("*").alias("images"), F.count_if(F.col("c") > 0.7).alias("high"), F.count_if(F.col("c") > 0).alias("processed"), F.round(F.avg("c"), 6).alias("mean_confidence"))


@query("SELECT event_id, CAST(epoch(ts) AS BIGINT) < (SELECT CAST(max(epoch(ts)) AS BIGINT) FROM events) - 7 * 86400 AS expired FROM events")
def cache_expiry(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"))
    newest = e.agg(F.max("s")).scalar()
    return e.select("event_id", (F.col("s") < newest - 7 * 86400).alias("expired"))


# ---- audio ------------------------------------------------------------------------------------------------------


@query("SELECT vec_id, round(len(embedding) / 24000.0, 9) AS seconds FROM embeddings")
def audio_duration(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(media.seconds(F.col("embedding"), 24000), 9).alias("seconds"))


@query("SELECT vec_id // 4 AS clip, CAST(sum(len(embedding)) AS BIGINT) AS n, round(CAST(list(embedding ORDER BY vec_id)[1][1] AS DOUBLE), 6) AS head, round(CAST(list(embedding ORDER BY vec_id)[-1][-1] AS DOUBLE), 6) AS tail FROM embeddings GROUP BY 1")
def audio_concat(spark, sf_dir):
    joined = media.joined_audio(table(spark, sf_dir, "embeddings").selectExpr("vec_id div 4 AS clip", "vec_id", "embedding"), "clip", "vec_id", "embedding")
    return joined.select("clip", F.size("samples").cast("long").alias("n"), F.round(F.element_at("samples", 1).cast("double"), 6).alias("head"), F.round(F.element_at("samples", -1).cast("double"), 6).alias("tail"))


@query("SELECT vec_id, CAST(len(s) AS BIGINT) AS n, round(list_sum(s), 5) AS total FROM (SELECT vec_id, list_concat(list_concat(e[1:len(e) - 8], list_transform(range(1, 9), lambda i: e[len(e) - 8 + i] * (1 - i / 9.0::DOUBLE) + e[i] * (i / 9.0::DOUBLE))), e[9:len(e)]) AS s FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))")
def audio_crossfade(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    faded = table(spark, sf_dir, "embeddings").select("vec_id", media.crossfade(e, e, 8).alias("s"))
    return faded.select("vec_id", F.size("s").cast("long").alias("n"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("SELECT vec_id, CAST(len(s) AS BIGINT) AS n, round(list_sum(s), 5) AS total FROM (SELECT vec_id, list_transform(range(0, m), lambda i: e[CAST(floor(i * (len(e) - 1) / (m - 1)::DOUBLE) AS BIGINT) + 1] + (e[least(CAST(floor(i * (len(e) - 1) / (m - 1)::DOUBLE) AS BIGINT) + 2, len(e))] - e[CAST(floor(i * (len(e) - 1) / (m - 1)::DOUBLE) AS BIGINT) + 1]) * (i * (len(e) - 1) / (m - 1)::DOUBLE - floor(i * (len(e) - 1) / (m - 1)::DOUBLE))) AS s FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST(floor(len(embedding) / 1.25) AS BIGINT) AS m FROM embeddings))")
def audio_resample(spark, sf_dir):
    faster = table(spark, sf_dir, "embeddings").select("vec_id", media.resample(F.col("embedding").cast("array<double>"), 1.25).alias("s"))
    return faster.select("vec_id", F.size("s").cast("long").alias("n"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


# ---- jobs, usage, errors ----------------------------------------------------------------------------------------


@query("SELECT source, count(*) AS files, count(*) FILTER (WHERE n_chars >= 500) AS ok, count(*) FILTER (WHERE n_chars < 500) AS failed, CAST(coalesce(sum(n_chars) FILTER (WHERE n_chars >= 500), 0) AS BIGINT) AS chars, round(avg(n_chars / 10000.0), 6) AS mean_seconds FROM documents GROUP BY source")
def batch_summary(spark, sf_dir):
    ok = F.col("n_chars") >= 500
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, F.col("n_chars"))), F.lit(0)).alias("chars"), F.round(F.avg(F.col("n_chars") / 10000.0), 6).alias("mean_seconds"))


@query("SELECT conv_id, count(*) AS total, count(*) FILTER (WHERE role = 'assistant') AS ok, count(*) FILTER (WHERE role <> 'assistant') AS failed, round(sum(CASE WHEN role = 'assistant' THEN length(text) / 15.0 ELSE 0 END), 4) AS seconds, string_agg('turn_' || CAST(turn AS VARCHAR), ',' ORDER BY turn) AS files FROM conversations GROUP BY conv_id")
def tts_summary(spark, sf_dir):
    ok = F.col("role") == "assistant"
    files = F.array_join(F.transform(F.sort_array(F.collect_list("turn")), lambda t: F.concat(F.lit("turn_"), t.cast("string"))), ",")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("total"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.round(F.sum(F.when(ok, F.length("text") / 15.0).otherwise(0.0)), 4).alias("seconds"), files.alias("files"))


@query("SELECT role, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS calls, round(sum(length(text)) / count(*), 6) AS chars_per_call FROM conversations GROUP BY role")
def usage_stats(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.sum(F.length("text")).cast("long").alias("chars"), F.count("*").alias("calls"), F.round(F.coalesce(F.try_divide(F.sum(F.length("text")), F.count("*")), F.lit(0.0)), 6).alias("chars_per_call"))


_MODES = {"legacy": cleaned("raw"), "modern": R.apply_duck("raw", R.MODERN), "hybrid": cleaned("c")}


@query(f"WITH l AS (SELECT doc_id, raw, {cleaned('raw')} AS c FROM ({MARKUP})) SELECT mode, count(*) AS texts, CAST(sum({wc('t')}) AS BIGINT) AS words, CAST(sum(length(t)) AS BIGINT) AS chars FROM (SELECT 'legacy' AS mode, c AS t FROM l UNION ALL SELECT 'modern', {_MODES['modern']} FROM l UNION ALL SELECT 'hybrid', {_MODES['hybrid']} FROM l) GROUP BY mode")
def mode_benchmark(spark, sf_dir):
    """Each text is cleaned once for legacy and once more for hybrid, and normalised once, all in one pass."""
    legacy = once(markup(spark, sf_dir), "c", T.clean(F.col("raw")))
    texts = once(once(legacy, "h", T.clean(F.col("c"))), "m", T.normalise(F.col("raw")))
    modes = F.array(*(F.struct(F.lit(k).alias("mode"), T.word_count(F.col(c)).alias("w"), F.length(c).alias("n")) for k, c in (("legacy", "c"), ("modern", "m"), ("hybrid", "h"))))
    return texts.select(F.explode(modes).alias("x")).groupBy("x.mode").agg(F.count("*").alias("texts"), F.sum("x.w").alias("words"), F.sum("x.n").cast("long").alias("chars"))


_MESSAGES = "['Rate limit hit', 'HTTP 429', 'Quota exceeded', 'Unauthorized', 'Voice x not found', 'timeout', 'Invalid API key']"


@query(f"SELECT event_id, CASE WHEN contains(m, 'rate limit') OR contains(m, '429') THEN 'rate_limit' WHEN contains(m, 'quota') OR contains(m, 'insufficient credits') THEN 'quota' WHEN contains(m, 'unauthorized') OR contains(m, 'invalid api key') THEN 'auth' WHEN contains(m, 'voice') AND contains(m, 'not found') THEN 'voice' ELSE 'other' END AS class FROM (SELECT event_id, lower({_MESSAGES}[CAST(event_id % 7 + 1 AS BIGINT)]) AS m FROM events)")
def retry_classify(spark, sf_dir):
    m = F.element_at(F.array(*(F.lit(x) for x in ("Rate limit hit", "HTTP 429", "Quota exceeded", "Unauthorized", "Voice x not found", "timeout", "Invalid API key"))), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", media.error_class(m).alias("class"))


@query("SELECT event_id, engine, attempt, CASE WHEN engine = 'c' THEN 1.0::DOUBLE * (attempt + 1) ELSE CASE engine WHEN 'a' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END * pow(2, attempt) END AS seconds FROM (SELECT event_id, engine, unnest(range(0, CASE engine WHEN 'a' THEN 4 ELSE 3 END)) AS attempt FROM (SELECT event_id, ['a', 'b', 'c'][CAST(event_id % 3 + 1 AS BIGINT)] AS engine FROM events WHERE event_type = 'error'))")
def backoff_schedule(spark, sf_dir):
    """When each failed event is tried again, by the engine that failed."""
    engine = F.element_at(F.array(*map(F.lit, "abc")), (F.col("event_id") % 3 + 1).cast("int"))
    failed = table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", engine.alias("engine"))
    waits = F.when(F.col("engine") == "a", media.backoff(4, 1.0)).when(F.col("engine") == "b", media.backoff(3, 2.0)).otherwise(media.backoff(3, 1.0, False))
    return failed.select("event_id", "engine", F.posexplode(waits).alias("attempt", "seconds")).withColumn("attempt", F.col("attempt").cast("long"))


# ---- progress ---------------------------------------------------------------------------------------------------

EVENTS = "SELECT event_id, ts, ['tts', 'image', 'epub'][CAST(user_id % 3 + 1 AS BIGINT)] AS pipeline, CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'progress' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' ELSE 'warning' END AS event_type, CAST(floor(value) AS BIGINT) AS items FROM events"


def progress_events(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "click", "progress").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "error").otherwise("warning")
    name = F.element_at(F.array(F.lit("tts"), F.lit("image"), F.lit("epub")), (F.col("user_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", "ts", name.alias("pipeline"), kind.alias("event_type"), F.floor("value").cast("long").alias("items"))


_FOLD = f"""WITH e AS ({EVENTS}), p AS (SELECT pipeline, ts AS pts, event_id AS pid, items AS pitems FROM (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY ts DESC, event_id DESC) AS r FROM e WHERE event_type = 'progress') WHERE r = 1),
 s AS (SELECT pipeline, items FROM (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY ts DESC, event_id DESC) AS r FROM e WHERE event_type = 'start') WHERE r = 1)
 SELECT e.pipeline, coalesce(max(s.items), 0) AS total_items, coalesce(max(pitems), 0) + count(*) FILTER (WHERE event_type = 'complete' AND (pts IS NULL OR ts > pts OR (ts = pts AND event_id > pid))) AS completed_items, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'warning') AS warnings, max(ts) AS last_update
 FROM e LEFT JOIN p ON e.pipeline = p.pipeline LEFT JOIN s ON e.pipeline = s.pipeline GROUP BY e.pipeline"""


@query(_FOLD)
def progress_fold(spark, sf_dir):
    return progress.fold(progress_events(spark, sf_dir))


@query(f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY pipeline ORDER BY ts DESC, event_id DESC) AS BIGINT) AS nth FROM ({EVENTS})) WHERE nth <= 10")
def progress_recent(spark, sf_dir):
    return progress.recent(progress_events(spark, sf_dir))


@query(f"SELECT CAST(sum(total_items) AS BIGINT) AS total_items, CAST(sum(completed_items) AS BIGINT) AS completed_items, CAST(sum(errors) AS BIGINT) AS errors, round(least(100.0, 100.0 * sum(completed_items) / sum(total_items)), 6) AS percent FROM ({_FOLD})")
def progress_overall(spark, sf_dir):
    return progress.overall(progress.fold(progress_events(spark, sf_dir)))


@query(f"SELECT *, CAST(sum(CASE WHEN event_type = 'complete' THEN 1 ELSE 0 END) OVER (PARTITION BY pipeline ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS completed_so_far FROM ({EVENTS})")
def progress_running(spark, sf_dir):
    return progress.running(progress_events(spark, sf_dir))


@query("SELECT user_id, CAST(len(list_reduce(list_prepend([]::DOUBLE[], list_transform(l, lambda t: [t])), lambda k, t: CASE WHEN len(k) = 0 OR t[1] - k[-1] > 86400 THEN list_append(k, t[1]) ELSE k END)) AS BIGINT) AS emitted FROM (SELECT user_id, list(epoch(ts)::DOUBLE ORDER BY ts) AS l FROM events GROUP BY user_id)")
def progress_throttle(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("pipeline"), F.lit("progress").alias("event_type"), "ts", "event_id", F.lit(1).cast("long").alias("total_items"))
    return state.emitted(rows, 86400.0).groupBy(F.col("pipeline").alias("user_id")).agg(F.count("*").alias("emitted"))


def _state_events(spark, sf_dir) -> DataFrame:
    """Progress events with what the live fold reads: totals of START, items done of PROGRESS, the item in work and custom values of some."""
    rows = progress_events(spark, sf_dir)
    some = lambda kind: F.when(F.col("event_type") == kind, F.col("items"))
    item = F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("item "), F.col("event_id").cast("string")))
    custom = F.when(F.col("event_id") % 5 == 0, F.create_map(F.concat(F.lit("n"), (F.col("event_id") % 3).cast("string")), F.col("event_id").cast("string")))
    return rows.select("pipeline", "event_type", "ts", "event_id", some("start").alias("total_items"), some("progress").alias("completed_items"), item.alias("current_item"), custom.alias("custom_stats"))


_ORDERED = "PARTITION BY pipeline ORDER BY ts DESC, event_id DESC"
_STATE = f"""WITH e AS (SELECT *, 'item ' || CAST(event_id AS VARCHAR) AS item FROM ({EVENTS})),
 items AS (SELECT pipeline, CASE WHEN event_type = 'complete' THEN '' ELSE item END AS current_item FROM (SELECT *, row_number() OVER ({_ORDERED}) AS r FROM e WHERE event_id % 4 > 0 AND event_type IN ('start', 'progress', 'complete')) WHERE r = 1),
 named AS (SELECT pipeline, string_agg(name || '=' || event_id, ',' ORDER BY name) AS custom FROM (SELECT pipeline, 'n' || CAST(event_id % 3 AS VARCHAR) AS name, CAST(event_id AS VARCHAR) AS event_id, row_number() OVER (PARTITION BY pipeline, event_id % 3 ORDER BY ts DESC, event_id DESC) AS r FROM e WHERE event_id % 5 = 0) WHERE r = 1 GROUP BY pipeline),
 ring AS (SELECT pipeline, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY r DESC) AS recent FROM (SELECT *, row_number() OVER ({_ORDERED}) AS r FROM e) WHERE r <= 10 GROUP BY pipeline)
 SELECT f.pipeline, f.total_items, f.completed_items, f.errors, f.warnings, coalesce(current_item, '') AS current_item, coalesce(custom, '') AS custom, recent FROM ({_FOLD}) f LEFT JOIN items i ON f.pipeline = i.pipeline LEFT JOIN named n ON f.pipeline = n.pipeline LEFT JOIN ring g ON f.pipeline = g.pipeline"""


@query(_STATE)
def progress_state(spark, sf_dir):
    """All that the live fold knows of each pipeline, in batch."""
    rows = state.fold_all(_state_events(spark, sf_dir))
    custom = F.array_join(F.transform(F.array_sort(F.map_entries("custom_stats")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return rows.select("pipeline", "total_items", "completed_items", "errors", "warnings", "current_item", custom.alias("custom"), F.array_join(F.transform("recent", lambda x: x.cast("string")), ",").alias("recent"))


_KNOWN = "last_value(CASE WHEN event_type = 'start' THEN items END IGNORE NULLS) OVER (PARTITION BY pipeline ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(f"""SELECT pipeline, unnest(list_transform(list_reduce(list_prepend([]::STRUCT(t BIGINT, i BIGINT)[], list_transform(l, lambda x: [x])), lambda k, x: CASE WHEN len(k) = 0 OR x[1].t - k[-1].t > 3600000000 THEN list_append(k, x[1]) ELSE k END), lambda x: x.i)) AS event_id
 FROM (SELECT pipeline, list({{'t': CAST(epoch_us(ts) AS BIGINT), 'i': CAST(event_id AS BIGINT)}} ORDER BY ts, event_id) AS l FROM (SELECT *, {_KNOWN} AS total FROM ({EVENTS})) WHERE event_type = 'progress' AND total > 0 GROUP BY pipeline)""")
def progress_reports(spark, sf_dir):
    """PROGRESS events of each pipeline that lie more than an hour after the last one told."""
    return state.emitted(_state_events(spark, sf_dir), 3600.0)


@query("SELECT total, array_to_string(list_reduce(list_prepend({'last': 0::BIGINT, 'out': []::BIGINT[]}, list_transform(range(1, total + 1), lambda i: {'last': i * 100 // total, 'out': []::BIGINT[]})), lambda a, p: CASE WHEN p.last >= a.last + 10 OR p.last >= 100 THEN {'last': p.last, 'out': list_append(a.out, p.last)} ELSE a END).out, ',') AS logged FROM (SELECT DISTINCT n_chars % 97 + 1 AS total FROM documents)")
def progress_deciles(spark, sf_dir):
    totals = table(spark, sf_dir, "documents").select((F.col("n_chars") % 97 + 1).alias("total")).distinct()
    return totals.select("total", F.array_join(progress.logged_percents(F.col("total")), ",").alias("logged"))


@query("SELECT doc_id, CASE WHEN n_chars < 60 THEN CAST(n_chars AS VARCHAR) || 's' WHEN n_chars < 3600 THEN printf('%02d:%02d', n_chars // 60, n_chars % 60) ELSE printf('%02d:%02d:%02d', n_chars // 3600, (n_chars % 3600) // 60, n_chars % 60) END AS duration FROM documents")
def duration_format(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", progress.duration_text(F.col("n_chars").cast("double")).alias("duration"))


@query("SELECT doc_id, repeat('█', (n_chars % 101) * 20 // 100) || repeat('░', 20 - (n_chars % 101) * 20 // 100) AS bar FROM documents")
def progress_bar(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", progress.bar(F.col("n_chars") % 101).alias("bar"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def daily_events(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


from . import queries_books, queries_jobs, queries_language  # noqa: E402, F401  (they register theirs)
