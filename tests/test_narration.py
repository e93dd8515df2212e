"""Narration operators: pinned examples, oracles on the smallest tables, folds against Python loops, stream against batch."""

import io
import re
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from scriptorium import queries
from scriptorium.functions import engines, settings
from scriptorium.operators import chapters, chunking, media, progress
from scriptorium.operators import text as T
from scriptorium.plans import rules as R
from scriptorium.sources import epub
from scriptorium.streaming import progress as streaming

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["clean_text", "clean_stats", "segment_by_marker", "segment_by_pattern", "segment_by_toc", "renumber_chapters", "lower_plain", "lower_ssml", "chunk_sentences_500", "chunk_simple_4000", "image_integrate", "description_truncate", "progress_fold", "progress_throttle", "topics_topk", "audio_resample"])
def test_oracle(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cur = duck.execute(queries.ORACLES[name])
    at = [[d[0] for d in cur.description].index(c) for c in columns]
    want = sorted(repr([plain(r[k]) for k in at]) for r in cur.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want and want


def test_every_query_with_sql_has_the_same_columns(spark, duck):
    for name, sql in queries.ORACLES.items():
        assert sorted(queries.QUERIES[name](spark, SF).columns) == sorted(d[0] for d in duck.execute(f"SELECT * FROM ({sql}) LIMIT 0").description), name


@pytest.mark.parametrize(
    "raw,want",
    [
        ("A note[1] and [23] more.", "A note and more."),
        ("**bold** and *mild*", "[EMPHASIS_STRONG: bold] and [EMPHASIS_MILD: mild]"),
        ("a & b 5% c", "a and b 5 percent c"),
        ("# One\n\ntext", "[CHAPTER_START: One][PAUSE: 2.0][PAUSE: 3.0]\n[PAUSE: 0.5]\ntext"),
        ('"Hi"', "[DIALOGUE_START]Hi[DIALOGUE_END][PAUSE: 0.3]"),
        ("Why? Yes! So, it is. ok", "Why?[PAUSE: 0.5] Yes![PAUSE: 0.5] So,[PAUSE: 0.5] it is.[PAUSE: 0.5] ok"),
        ("a\n\n\nb", "a b"), ("x\u2028y", "x\u2028y"), ("  ", "  "), ("", ""), (None, None), ("$1\\n", "dollars 1\\n"), ("‘a’ ′b‛ `c´", "'a' 'b' 'c'"),
    ],
)
def test_clean(spark, raw, want):
    assert one(spark, T.clean(F.col("t").cast("string")), t=raw) == want


def test_clean_against_python(spark):
    import random

    import regex

    rng = random.Random(1)
    bits = ["# ", "\n", "\n\n", "Page 3", "Chapter 2", "[4]", "<b>", "**", "*", '"', "a", "Bc", ", ", ". ", "? ", "! ", "—", "…", "$", "%", " ", "  ", "\t", "\u00a0", "\u2028", "\u0085", "![x](y)", "\\", "$1", "’"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.clean(F.col("t")).alias("c")).collect()
    for r in rows:
        t = texts[r.k]
        if t.strip():
            for rule in R.CLEAN:
                t = t.replace(rule.pattern, rule.replacement) if rule.literal else regex.sub(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", rule.regex), rule.replacement.replace("\n", "\\n"), t, flags=regex.M if rule.multiline else 0)
        assert r.c == t, repr(texts[r.k])


def test_segments(spark):
    df = spark.createDataFrame([(1, "lost [CHAPTER_START: One] a b [CHAPTER_START: Two]  [CHAPTER_START: Three]c"), (2, " no marker "), (3, "")], "id int, t string")
    got = [(r.id, r.chapter_num, r.title, r.content, r.word_count) for r in chapters.by_marker(df, "t", "id").orderBy("id", "chapter_num").collect()]
    assert got == [(1, 1, "One", "a b", 2), (1, 3, "Three", "c", 1), (2, 1, "Full Text", " no marker ", 2)]
    df = spark.createDataFrame([(1, "x\nChapter 1\nbody one\nChapter 2\nbody two"), (2, "Part II: x\nbody."), (3, "Letters only\nhere")], "id int, t string")
    got = [(r.id, r.chapter_num, r.title, r.content) for r in chapters.by_headings(df, "t", "id").orderBy("id", "chapter_num").collect()]
    assert got == [(1, 1, "Chapter 1", "body one"), (1, 2, "Chapter 2", "body two"), (2, 1, "Part II", ": x\nbody.")]


def test_split_filter_renumber(spark):
    rows = [("b", 1, "T", " ".join(["w"] * 150)), ("b", 2, "S", " ".join(["v"] * 10)), ("b", 3, "U", " ".join(["u"] * 100))]
    df = spark.createDataFrame(rows, "book string, chapter_num long, title string, content string").withColumn("word_count", T.word_count(F.col("content")))
    got = chapters.renumber(chapters.split_long(chapters.keep_long(df, 50), 100), "book").orderBy("chapter_num").collect()
    assert [(r.chapter_num, r.title, r.word_count) for r in got] == [(1, "T - Part 1", 100), (2, "T - Part 2", 50), (3, "U", 100)]


def test_stats_of_nothing(spark):
    r = T.clean_stats(spark.createDataFrame([(1, None)], "id int, text string"), "text", "id").first()
    assert (r.compression_ratio, r.characters_removed) == (0.0, 0)


def brute_nms(rows):
    kept = []
    for s, c, t in sorted(rows):
        if c < 0.6:
            continue
        for k in kept:
            if abs(s - k[0]) < 100:
                if c > k[1]:
                    kept.remove(k)
                    kept.append((s, c, t))
                break
        else:
            kept.append((s, c, t))
    return kept


def test_heading_nms(spark):
    found = {}
    for k in queries.heading_nms(spark, SF).collect():
        found.setdefault(k.user_id, []).append((k.start, k.confidence, k.title))
    for r in queries._candidates(spark, SF).collect():
        assert sorted(found.get(r.user_id, [])) == sorted(brute_nms([tuple(x) for x in r.l]))


def test_heading_nms_has_all_users(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    want = {r.user_id for r in events.filter("round(0.5 + (event_id % 6) / 10.0, 1) >= 0.6").collect()}
    assert {r.user_id for r in queries.heading_nms(spark, SF).collect()} == want


def test_chunks_within_the_limit(spark):
    text = "Short. " + "x" * 95 + " y. " + "Tail is here! " * 9
    strict, fixed = (one(spark, chunking.sentence_chunks(F.col("t"), 40, s), t=text) for s in (True, False))
    assert max(map(len, strict)) > 40 and max(map(len, fixed)) <= 40
    assert re.sub(r"\s", "", "".join(fixed)) == re.sub(r"\s", "", text)
    assert one(spark, chunking.sentence_chunks(F.col("t"), 5), t="") == []


def test_media(spark):
    assert one(spark, media.backoff(3, 2.0)) == [2.0, 4.0, 8.0]
    a = F.array(*(F.lit(float(x)) for x in (1, 1, 1, 1)))
    assert one(spark, media.crossfade(a, a, 2)) == pytest.approx([1.0] * 6)
    assert one(spark, media.resample(a, 2.0)) == [1.0, 1.0] and one(spark, media.resample(F.array().cast("array<double>"), 2.0)) == []
    assert one(spark, media.clean_description(F.col("t"), 12), t="'one two. three four'") == "One two."
    assert one(spark, media.error_class(F.col("t")), t="Voice abc NOT found") == "voice"


def test_progress_examples(spark):
    rows = [(1, "start", 5), (2, "progress", 2), (3, "complete", 1), (4, "error", 0)]
    df = spark.createDataFrame([(k, "tts", e, i) for k, e, i in rows], "event_id long, pipeline string, event_type string, items long").withColumn("ts", F.timestamp_seconds("event_id"))
    r = progress.fold(df).first()
    assert (r.total_items, r.completed_items, r.errors) == (5, 3, 1)
    assert one(spark, progress.logged_percents(F.lit(7).cast("long"))) == [14, 28, 42, 57, 71, 85, 100]
    assert [one(spark, progress.duration_text(F.lit(s))) for s in (45.0, 65.0, 3665.0)] == ["45s", "01:05", "01:01:05"]


def test_stream_equals_batch(spark, tmp_path):
    events = queries.progress_events(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streaming.fold_stream(stream).writeStream.outputMode("update").format("memory").queryName("fold").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.sql("SELECT pipeline, total_items, completed_items, errors, warnings FROM fold").collect()}
    assert got == {tuple(r) for r in progress.fold(events).select("pipeline", "total_items", "completed_items", "errors", "warnings").collect()}


def test_epub(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package xmlns="urn:y" xmlns:dc="urn:z"><metadata><dc:title>Book</dc:title><dc:creator>Me</dc:creator></metadata><manifest><item id="a" href="a.xhtml" media-type="x"/><item id="i" href="i.png" media-type="image/png"/></manifest><spine><itemref idref="a"/></spine></package>')
        z.writestr("o/a.xhtml", "<html><head><title>n</title></head><body><h1>One</h1><p>Hello &amp; bye</p></body></html>")
    (tmp_path / "a.epub").write_bytes(data.getvalue())
    (tmp_path / "b.epub").write_bytes(b"no")
    rows = {r.path[-6:]: r for r in epub.read_epub(spark, str(tmp_path)).collect()}
    assert (rows["a.epub"].title, rows["a.epub"].author, rows["a.epub"].images) == ("Book", "Me", ["i.png"])
    assert [(c.title, c.content, c.word_count) for c in rows["a.epub"].chapters] == [("One", "One\n\nHello & bye", 4)]
    assert rows["b.epub"].error and not rows["b.epub"].chapters
    paths = spark.createDataFrame([("b.EPUB",), ("a.epub",), ("a.epub",), ("c.txt",)], "path string")
    assert [r.path for r in epub.expand(paths).collect()] == ["a.epub", "b.EPUB"]


def test_engines_and_settings(spark):
    assert len(one(spark, engines.speech(F.col("t"), "unknown"), t="abc")) == 30
    assert one(spark, engines.describe(F.encode(F.lit("abcd"), "utf-8"), F.lit(""), "naming")).description == "An image of 4 bytes."
    assert settings.merged({"a": 1, "b": {"c": 2, "d": 3}, "e": 5}, {"b": {"c": 10, "f": 6}, "g": 7}) == {"a": 1, "b": {"c": 10, "d": 3, "f": 6}, "e": 5, "g": 7}
    assert settings.problems({"speed": 1.0}) == [] and len(settings.problems({"speed": 3.0, "pitch": 0.1, "sample_rate": 8000, "format": "flac", "text_format": "xml", "min_words": 0, "max_words": -1})) == 7


def test_entry_without_the_training_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['scriptorium.llm'] = None; import __spark_entry__ as e; assert 'clean_text' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=epub.__file__.rsplit("/", 3)[0])


def test_word_count(spark):
    """Against splitting by every character that Python and the rules call white space."""
    import random

    from scriptorium.operators import text as T

    spaces = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000\x1c\x1f"
    rng = random.Random(8)
    texts = ["", " ", "a", None, "\u3000", " a ", "\x1ca\x1fb\x85", *("".join(rng.choice(spaces + "aé—漢. ") for _ in range(rng.randrange(30))) for _ in range(500))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    assert {r.k: r.n for r in df.select("k", T.word_count(F.col("t")).alias("n")).collect()} == {k: len((t or "").split()) for k, t in enumerate(texts)}
