"""Files, settings, reports, sentence-level chapters, live events: examples and round trips."""

import json
import wave
import io

import pytest
from pyspark.sql import functions as F

from scriptorium import cli, queries
from scriptorium.functions import images, settings, splitters
from scriptorium.operators import chapters, media, modern, progress, repair, reports
from scriptorium.operators import text as T
from scriptorium.plans import rules as R
from scriptorium.sinks import files
from scriptorium.sources import catalogue, epub, media_files
from scriptorium.streaming import events as live
from scriptorium.streaming import progress as streaming

from test_narration import SF, duck, one, plain  # noqa: F401

NEW = (
    "repair_encoding", "sentence_headings", "modern_chapters", "modern_stats", "segment_legacy", "dispatch_chapters", "hybrid_with_contents", "document_json", "processing_report", "batch_summary_json", "stage_timings", "cache_write", "cache_index",
    "settings_checks", "progress_status", "progress_rollup", "event_ingest", "events_before_shutdown", "event_labels", "heading_candidates", "heading_nms", "heading_confidence", "config_merge", "description_confidence", "progress_running", "chapter_toc",
)


@pytest.mark.parametrize("name", NEW)
def test_oracle(spark, duck, name):  # noqa: F811
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cur = duck.execute(queries.ORACLES[name])
    at = [[d[0] for d in cur.description].index(c) for c in columns]
    want = sorted(repr([plain(r[k]) for k in at]) for r in cur.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want and want


@pytest.mark.parametrize(
    "raw,want",
    [
        ("cafÃ© â€œyesâ€\x9d donâ€™t", 'café "yes" don\'t'), ("Ã¼ber Ã±andÃº", "über ñandú"), ("ﬁne ‘x’\r\ny\rz\x00", "fine 'x'\ny\nz"), ("clean — text é", "clean — text é"), ("Âº Â©", "º ©"), ("", ""), (None, None),
    ],
)
def test_repair(spark, raw, want):
    assert one(spark, repair.repair(F.col("t").cast("string")), t=raw) == want


@pytest.mark.parametrize("raw,want", [("note[١٢] end", "note end"), ("Page ٣ of\nx", "x"), ("say 4] x", "say x"), ("cost $5 & 10%", "cost dollars 5 and 10 percent")])
def test_clean_takes_digits_of_any_script(spark, raw, want):
    assert one(spark, T.clean(F.col("t")), t=raw) == want


def test_titles(spark):
    for text in ("The Cat", "Éa Bc", "A1 Bc", "They'Re", "ǅa", "1 A", "It's", "the cat", "THE", "", "1", "ABc", "Été À Nice"):
        assert one(spark, chapters.is_title(F.col("t")), t=text) == text.istitle(), text
        assert one(spark, chapters.is_upper(F.col("t")), t=text) == text.isupper(), text


def test_modern_chapters(spark):
    body = "here are some words of a longer sentence that is no heading at all, and it goes on and on and on so that it is long. "
    df = spark.createDataFrame([(1, f"lost words that are no heading. Chapter One. {body}Chapter Two. {body}"), (2, body), (3, None)], "id int, t string")
    got = [(r.id, r.chapter_num, r.title, r.confidence) for r in modern.process(df, "t", "id", "modern").orderBy("id", "chapter_num").collect()]
    assert got[:2] == [(1, 1, "Chapter One.", 1.0), (1, 2, "Chapter Two.", 1.0)] and got[2][:3] == (2, 1, "Full Document") and got[2][3] == 0.5
    with pytest.raises(ValueError):
        modern.process(df, "t", "id", "other")
    text = "Head\n\n" + "w " * 60 + "\n\nno head either\n\nshort"
    found = modern.structural_candidates(spark.createDataFrame([(1, text)], "id int, t string"), "t", "id").collect()
    assert [(r.start, r.title, r.confidence) for r in found] == [(0, "Head", 0.6)]


def test_legacy_segmentation(spark):
    df = spark.createDataFrame([(1, "[CHAPTER_START: A] x [CHAPTER_START: B] "), (2, "Chapter 1\n one\nChapter 2\n two"), (3, "[CHAPTER_START: A]  "), (4, "just text")], "id int, t string")
    got = [(r.id, r.chapter_num, r.title, r.content, r.confidence) for r in chapters.segment(df, "t", "id").orderBy("id", "chapter_num").collect()]
    assert got == [(1, 1, "A", "x", 1.0), (2, 1, "Chapter 1", "one", 0.8), (2, 2, "Chapter 2", "two", 0.8), (3, 1, "Full Text", "[CHAPTER_START: A]  ", 1.0), (4, 1, "Full Text", "just text", 1.0)]


def test_contents_keep_positions_and_own_texts(spark):
    df = spark.createDataFrame([(1, "İİİ ONE first İ Two second")], "id int, t string")
    toc = spark.createDataFrame([(1, 1, "one", None), (1, 2, "two", None), (1, 3, "three", "own text")], "id int, pos int, title string, content string")
    got = [(r.chapter_num, r.content) for r in chapters.by_toc(df, toc, "t", "id").orderBy("chapter_num").collect()]
    assert got == [(1, "first İ"), (2, "second"), (3, "own text")]


def test_placeholders(spark):
    texts = spark.createDataFrame([(1, "a [IMAGE: x.png] b ![x.png] c ![Image of x.png] d [IMAGE: Image of x.png] e [PAUSE: 0.5] ![z.png]"), (2, "none"), (3, None)], "id int, text string")
    desc = spark.createDataFrame([("x.png", "old", 0.9, 1), ("x.png", "a cat", 0.9, 2), ("z.png", "low", 0.5, 3)], "image_name string, description string, confidence double, seq int")
    d = "[IMAGE DESCRIPTION: a cat]"
    want = {1: f"a {d} b {d} c {d} d {d} e [PAUSE: 0.5] ![z.png]", 2: "none", 3: None}
    for most in (media.MAP_BYTES, 0):
        saved, media.MAP_BYTES = media.MAP_BYTES, most
        try:
            assert {r.id: r.text for r in media.integrate(texts, desc, "id").collect()} == want
        finally:
            media.MAP_BYTES = saved
    parts = spark.createDataFrame([(1, "one [IMAGE: x.png] ![x.png]", 9, 9.0)], "id int, content string, word_count long, estimated_duration double")
    r = media.integrate_chapters(parts, desc, "id").first()
    assert (r.content, r.word_count, r.estimated_duration) == (f"one {d} ![x.png]", 6, 0.03)


def test_splitter():
    numbers = iter(range(100, 10_000))
    text = "\n\n".join("".join(f"Sentence {next(numbers)} here. " for _ in range(k)) for k in range(1, 40)) + "\n\n" + "".join(f"{next(numbers)}x" for _ in range(250))
    for size, overlap in ((100, 0), (300, 40), (4000, 200)):
        chunks = splitters.split(text, size, overlap)
        assert max(map(len, chunks)) <= size and all(c == c.strip() and c for c in chunks)
        at = 0
        for c in chunks:  # in order, leaving out nothing but white space, reaching back by the overlap at most
            found = text.find(c, max(0, at - overlap - 2))
            assert 0 <= found and (found <= at or not text[at:found].strip())
            at = max(at, found + len(c))
        assert not text[at:].strip()
    assert splitters.split("") == [] and splitters.split("short") == ["short"]


RULES = """
cleaning_rules:
  remove:
    - pattern: '\\[\\d+\\]'
      name: notes
    - pattern: '^Page [\\d\\s]+$'
      name: pages
      multiline: true
    - pattern: '(['
      name: broken
  transform:
    - pattern: '\\*(.+?)\\*'
      name: mild
      replacement: '<\\1>'
  tts_replacements:
    '&': ' and '
chapter_detection:
  patterns: ['^Chapter\\s+\\d+', '(']
"""


def test_rule_and_settings_files(spark, tmp_path):
    (tmp_path / "rules.yaml").write_text(RULES)
    groups, found = settings.compiled(settings.read(str(tmp_path / "rules.yaml")))
    assert {k: len(v) for k, v in groups.items()} == {"remove": 2, "transform": 1, "chapters": 1, "characters": 1}
    assert len(found) == 2 and found[0].startswith("Pattern broken") and groups["chapters"][0].multiline and groups["chapters"][0].ignore_case
    rules = (*groups["remove"], *groups["transform"], *groups["characters"])
    assert one(spark, R.apply(F.col("t"), rules), t="a[٣] *b* & c\nPage 1 2\nd") == "a <b>  and  c\n\nd"
    (tmp_path / "default.yaml").write_text("tts: {engine: kokoro, speed: 1.0, sample_rate: 48000}\noutput: {text_format: plain}\nchapters: {min_words_per_chapter: 100, max_words_per_chunk: 5000}\n")
    (tmp_path / "own.json").write_text('{"tts": {"speed": 1.5}}')
    assert settings.load(str(tmp_path / "default.yaml"), str(tmp_path / "own.json"))["tts"] == {"engine": "kokoro", "speed": 1.5, "sample_rate": 48000}
    for bad, n in (({"tts": {"engine": "x", "speed": 3.0, "pitch": 0.1, "sample_rate": 8000, "output_format": "flac"}}, 5), ({"output": {"text_format": "xml"}, "processing": {"max_parallel_jobs": 0}}, 2), ({"chapters": {"min_words_per_chapter": 0, "max_words_per_chunk": -1}}, 2)):
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError) as e:
            settings.load(str(tmp_path / "default.yaml"), str(tmp_path / "bad.json"))
        assert len(str(e.value).split("; ")) == n
    with pytest.raises(FileNotFoundError):
        settings.read(str(tmp_path / "none.yaml"))
    (tmp_path / "broken.yaml").write_text("a: [")
    with pytest.raises(ValueError):
        settings.read(str(tmp_path / "broken.yaml"))
    assert cli.main(["check", str(tmp_path / "rules.yaml"), "--kind", "rules"]) == 1 and cli.main(["check", str(tmp_path / "default.yaml")]) == 0


def book(path, title="Book", text="Chapter 1\n\nHello <b>there</b>", identifier="978-3-16-148410-0"):
    import zipfile

    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", f'<package xmlns="urn:y" xmlns:dc="urn:z"><metadata><dc:title>{title}</dc:title><dc:creator>Me</dc:creator><dc:creator>You</dc:creator><dc:publisher>P</dc:publisher><dc:date>2001</dc:date><dc:language>en</dc:language><dc:identifier>urn:uuid:1</dc:identifier><dc:identifier>{identifier}</dc:identifier><dc:subject>S</dc:subject><dc:subject>T</dc:subject></metadata><manifest><item id="a" href="a.xhtml" media-type="x"/><item id="i" href="img/i.png" media-type="image/png"/></manifest><spine><itemref idref="a"/></spine></package>')
        z.writestr("o/a.xhtml", f'<html><body><p>{text}</p><img src="img/i.png" alt="A cat"/></body></html>')
        z.writestr("o/filler", "x" * 2000, compress_type=zipfile.ZIP_STORED)


def test_books(spark, tmp_path, capsys):
    book(tmp_path / "a.epub")
    book(tmp_path / "b.epub", title="", text="")
    (tmp_path / "c.epub").write_bytes(b"no book")
    rows = {r.path[-6:]: r for r in epub.read_epub(spark, str(tmp_path)).collect()}
    a = rows["a.epub"]
    assert (a.title, a.author, a.authors, a.publisher, a.publication_date, a.language, a.identifier, a.subjects, a.original_format) == ("Book", "Me", ["Me", "You"], "P", "2001", "en", "978-3-16-148410-0", ["S", "T"], "epub")
    assert [tuple(i) for i in a.image_info] == [("o/img/i.png", "A cat", 0, "png")] and a.file_size == (tmp_path / "a.epub").stat().st_size
    found = {r.path[-6:]: r.issues for r in epub.validate(epub.read_epub(spark, str(tmp_path))).collect()}
    assert found["a.epub"] == [] and found["b.epub"] == ["no title", "no text"] and found["c.epub"][0] == "too small" and found["c.epub"][1].startswith("parse error")
    out = tmp_path / "out"
    assert {(r.file, r.bytes) for r in cli.convert(spark, str(tmp_path / "a.epub"), str(out), "json").collect()} == {(f.name, f.stat().st_size) for f in out.iterdir()}
    whole = json.loads((out / "a.json").read_text())
    assert whole["metadata"]["authors"] == ["Me", "You"] and whole["images"][0]["alt_text"] == "A cat" and [c["chapter_num"] for c in whole["chapters"]] == [1]
    assert (out / "a_toc.txt").read_text().startswith("Table of Contents\n=================\n\nChapter 1: ") and json.loads((out / "a_metadata.json").read_text())["publisher"] == "P"
    cli.convert(spark, str(tmp_path / "a.epub"), str(out)).collect()
    assert (out / "a.txt").read_text() == whole["text"]
    assert cli.convert(spark, str(tmp_path / "a.epub"), str(out), resume=True).count() == 0


def test_books_of_one_name(spark, tmp_path, monkeypatch, capsys):
    """Two books of one stem keep apart, the first run may resume, another folder's book of that name isn't taken for done, and the working folder doesn't matter."""
    for folder, title in (("p", "First"), ("q", "Second")):
        (tmp_path / folder).mkdir()
        book(tmp_path / folder / "x.epub", title, f"{title} text of some words")
    book(tmp_path / "p/y.epub", "Third", "third")
    (tmp_path / "q/z.epub").write_bytes(b"no book")
    monkeypatch.chdir(tmp_path)
    out = tmp_path / "new"
    pair = [f"{tmp_path}/p/x.epub", f"{tmp_path}/q/x.epub"]
    cli.convert(spark, pair, str(out), resume=True).collect()
    texts = {f.name: f.read_text() for f in out.glob("*.txt") if "_toc" not in f.name}
    assert sorted(texts.values()) == ["First text of some words", "Second text of some words"] and all(n.startswith("x-") for n in texts)
    assert {json.loads(f.read_text())["title"] for f in out.glob("*_metadata.json")} == {"First", "Second"}
    assert cli.convert(spark, pair, str(out), resume=True).count() == 0
    one = tmp_path / "one"
    cli.convert(spark, pair[0], str(one)).collect()
    assert (one / "x.txt").read_text().startswith("First")
    assert cli.convert(spark, pair[0], str(one), resume=True).count() == 0 and cli.convert(spark, pair[1], str(one), resume=True).count() > 0
    cli.convert(spark, f"{tmp_path}/p/y.epub", str(one), min_words=100).collect()
    assert (one / "y.txt").read_text() == ""  # short, but not lost


def test_batch(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "in").mkdir()
    for k in range(3):
        book(tmp_path / f"in/b{k}.epub", f"T{k}", f"words of book {k}")
    (tmp_path / "in/bad.epub").write_bytes(b"no book")
    patterns, out = [f"{tmp_path}/in", f"{tmp_path}/in/b*.epub", f"{tmp_path}/none/*.epub"], tmp_path / "out"
    totals, unknown = cli.batch(spark, patterns, str(out), dry_run=True)
    assert [p.rsplit("/", 1)[1] for p in totals["files"]] == ["b0.epub", "b1.epub", "b2.epub", "bad.epub"] and unknown == patterns[2:] and not out.exists()
    totals, _ = cli.batch(spark, patterns, str(out), limit=2, min_words=1)
    assert (totals["total_files"], totals["successful"], totals["failed"]) == (2, 2, 0) and not (out / "b2.txt").exists()
    totals, _ = cli.batch(spark, patterns, str(out), resume=True, min_words=1)
    assert (totals["total_files"], totals["successful"], totals["failed"], totals["skipped"]) == (4, 1, 1, 2) and (out / "b2.txt").read_text() == "words of book 2"
    rows = [json.loads(line) for f in (out / "batch_files").glob("*.json") for line in f.read_text().splitlines()]
    assert {(r["file"].rsplit("/", 1)[1], r["success"]) for r in rows} == {("b2.epub", True), ("bad.epub", False)} and "BadZipFile" in next(r["error"] for r in rows if not r["success"])
    assert json.loads((out / "batch_summary.json").read_text())["batch_processing"]["total_characters_extracted"] == 15
    assert cli.batch(spark, [f"{tmp_path}/none"], str(out))[0]["total_files"] == 0
    assert cli.main(["version"]) == 0 and cli.VERSION in capsys.readouterr().out


def test_models_are_made_once(spark, tmp_path):
    from scriptorium.functions import engines

    df = spark.createDataFrame([("a",), (None,), ("bb",)], "t string").repartition(1)
    assert len(df.select(engines.speech(F.col("t"), "none").alias("s")).collect()) == 3
    assert df.select(engines.describe(F.col("t").cast("binary"), F.col("t"), "naming").alias("d")).select("d.confidence").distinct().count() == 1


def test_integrate_both_ways(spark, monkeypatch):
    """A small and a large table of descriptions give the same, for rows with null, equal and hot keys too."""
    texts = spark.createDataFrame([(None, "see [IMAGE: a.png]"), (None, "and ![b.png]"), (1, "![Image of a.png] ![a.png]"), (1, "[IMAGE: c.png]"), (2, None), (3, "none"), (3, "none")], "k long, text string").repartition(3)
    known = spark.createDataFrame([("a.png", "a cat", 0.9, 1), ("a.png", "a dog", 0.4, 2), ("b.png", "b", 0.8, 1), *((f"n{k}", f"d{k}", 0.9, k) for k in range(300))], "image_name string, description string, confidence double, seq long")
    want = sorted([(None, "see [IMAGE DESCRIPTION: a cat]"), (None, "and [IMAGE DESCRIPTION: b]"), (1, "[IMAGE DESCRIPTION: a cat] [IMAGE DESCRIPTION: a cat]"), (1, "[IMAGE: c.png]"), (2, None), (3, "none"), (3, "none")], key=str)
    for most in (media.MAP_BYTES, 0):
        monkeypatch.setattr(media, "MAP_BYTES", most)
        assert sorted(map(tuple, media.integrate(texts, known, "k").collect()), key=str) == want
        assert media.integrate(texts, known.limit(0), "k").count() == 7


def test_greedy_filter_is_the_plain_one(spark):
    """Against a version that compares each candidate with all that are kept."""
    import random

    from scriptorium.operators import chapters as C

    def plain(rows):
        kept = []
        for c in rows:
            if c[1] < 0.6:
                continue
            close = [k for k in kept if abs(c[0] - k[0]) < 100]
            if not close:
                kept.append(c)
            elif c[1] > close[0][1]:
                kept = [k for k in kept if k != close[0]] + [c]
        return kept

    rng = random.Random(4)
    lists = [sorted((rng.randrange(3000), rng.choice((0.5, 0.6, 0.7, 0.9)), f"t{j % 3}") for j in range(n)) for n in (0, 1, 40, 200, 400)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], f"k int, c {C.CANDIDATES}")
    assert {r.k: [tuple(c) for c in r.kept] for r in df.select("k", C.nms(F.col("c")).alias("kept")).collect()} == {k: plain(x) for k, x in enumerate(lists)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("x/a.txt", "é"), ("b.txt", ""), ("c.txt", None)], "name string, text string")
    assert {(r.file, r.bytes) for r in files.write_files(df, f"file://{tmp_path}", "name", "text").collect()} == {("x/a.txt", 2), ("b.txt", 0)}
    assert (tmp_path / "x/a.txt").read_text() == "é" and (tmp_path / "b.txt").read_bytes() == b"" and not (tmp_path / "c.txt").exists()
    audio = files.encoded_audio(spark.createDataFrame([(1, [0.0, 1.0, -2.0]), (2, [])], "id int, s array<double>"), "id", "s", 8000).orderBy("name").collect()
    with wave.open(io.BytesIO(audio[0].audio)) as w:
        assert (w.getframerate(), w.getnchannels(), w.getsampwidth(), w.readframes(9)) == (8000, 1, 2, b"\x00\x00\xff\x7f\x01\x80")
    with pytest.raises(ValueError):
        files.encoded_audio(df, "name", "text", 8000, "mp3")
    old = spark.createDataFrame([("a", 1, 5), ("b", 1, 5)], "k string, v int, seq int")
    new = spark.createDataFrame([("a", 2, 5), ("b", 2, 4), ("c", 2, 1)], "k string, v int, seq int")
    assert {r.k: r.v for r in files.latest(old, new, "k", "seq").collect()} == {"a": 2, "b": 1, "c": 2}
    pictures = spark.createDataFrame([("b1", f"{tmp_path}/x/a.txt"), ("b1", ""), ("b1", "/gone")], "base string, file_path string")
    there = spark.createDataFrame([(f"{tmp_path}/x/a.txt", b"\xc3\xa9")], "path string, content binary")
    assert [r.file for r in files.copy_images(pictures, str(tmp_path / "o"), "base", there).collect()] == ["b1_images/a.txt"] and (tmp_path / "o/b1_images/a.txt").read_bytes() == b"\xc3\xa9"


def test_catalogues(spark):
    empty = spark.createDataFrame([("v/a.txt",)], "path string")
    assert [r.voice for r in catalogue.voices(empty, ["z", "y"]).collect()] == ["y", "z"]
    index = spark.createDataFrame([('{"k":{"description":"d"}}',), ("{",), (None,), ("[]",)], "json string")
    assert [(r.cache_key, r.entry.description) for r in catalogue.cache_index(index).collect() if r.cache_key] == [("k", "d")]
    assert images.dominant_color(spark.createDataFrame([(1, [3, 1, 3, 1, 9])], "id int, p array<int>"), "id", "p").first()[1:] == (1, 2)


def test_image_and_audio_files(spark, tmp_path):
    import struct

    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 30, 20) + b"\0" * 5)
    (tmp_path / "b.gif").write_bytes(b"GIF89a" + struct.pack("<HH", 5, 7))
    (tmp_path / "c.jpg").write_bytes(b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"xx" + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 9, 9) + b"\0" * 9)
    (tmp_path / "d.png").write_bytes(b"no")
    got = {r.path[-5:]: (r.format, r.width, r.height, r.mode) for r in media_files.read_images(spark, str(tmp_path)).collect()}
    assert got == {"a.png": ("PNG", 30, 20, "wide"), "b.gif": ("GIF", 5, 7, "tall"), "c.jpg": ("JPEG", 9, 9, "square"), "d.png": (None, None, None, None)}
    (tmp_path / "wav").mkdir()
    (tmp_path / "wav/a.wav").write_bytes(files.wav([0.0, 0.5, -1.0], 8000))
    (tmp_path / "wav/b.wav").write_bytes(b"no")
    rows = {r.path[-5:]: r for r in media_files.read_audio(spark, str(tmp_path / "wav")).collect()}
    assert rows["a.wav"].rate == 8000 and rows["a.wav"].samples == pytest.approx([0.0, 0.5, -1.0], abs=1e-4) and rows["b.wav"].error and rows["b.wav"].samples == []


def test_patterns(spark, tmp_path):
    for name in ("a.epub", "b.EPUB", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/d.epub").write_bytes(b"x")
    found, left = epub.expand_patterns(spark, [str(tmp_path / "*.epub"), str(tmp_path / "a.epub"), str(tmp_path / "sub"), str(tmp_path / "gone.epub"), str(tmp_path / "b.EPUB")])
    assert [r.path.rsplit("/", 1)[1] for r in found.collect()] == ["a.epub", "b.EPUB", "d.epub"] and left == [str(tmp_path / "gone.epub")]
    none, left = epub.expand_patterns(spark, [str(tmp_path / "x?.epub")])
    assert none.count() == 0 and len(left) == 1


def test_report(spark):
    book_ = F.array(F.struct(F.lit("title").alias("key"), F.lit("B").alias("value")), F.struct(F.lit("author").alias("key"), F.lit(None).cast("string").alias("value")))
    parts = F.array(F.struct(F.lit(1).alias("n"), F.lit("One").alias("title"), F.lit(1234).alias("words"), F.lit(6.17).alias("minutes")))
    text = one(spark, reports.report(book_, F.lit(12345), F.lit(1234), parts, F.lit(1000), F.lit(0.925), F.lit(2), F.lit(1), F.lit(0.65), F.lit(1), F.lit(6.2)))
    assert "  Title: B\n" in text and "Author" not in text and "12,345 characters" in text and "  Text cleaning: 1,000 characters removed\n  Compression ratio: 92.5%\n" in text
    assert "  1. One\n     Words: 1,234, Duration: 6.2 min\n" in text and "  Average confidence: 0.65\n" in text and "  Chapters processed: 1/1\n  Total audio duration: 6.2 minutes\n" in text


def test_status(spark):
    rows = [("tts", 1, "start", 4), ("tts", 11, "complete", 0), ("tts", 21, "start", 4), ("image", 1, "start", 2), ("image", 5, "progress", 2), ("epub", 3, "warning", 0)]
    df = spark.createDataFrame([(k, p, e, i, t) for k, (p, t, e, i) in enumerate(rows)], "event_id long, pipeline string, event_type string, items long, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.pipeline: (r.percent, r.eta_seconds, r.active) for r in progress.status(df).collect()}
    assert got == {"tts": (25.0, 60.0, True), "image": (100.0, 0.0, False), "epub": (0.0, None, False)}
    r = progress.roll_up(progress.status(df)).first()
    assert (r.total_items, r.completed_items, r.percent, r.eta_seconds, r.active, r.warnings) == (6, 3, 50.0, 60.0, "tts", 1)


def test_live_events(spark, tmp_path):
    with pytest.raises(TypeError):
        live.checked(spark.createDataFrame([(1,)], "event_id long"))
    rows = [(1, "tts", "start", None), (2, "tts", "progress", None), (3, "overall", "info", "shutdown"), (4, "tts", "error", None), (5, "x", "start", None)]
    df = spark.createDataFrame(rows, "event_id long, pipeline string, event_type string, action string").withColumn("ts", F.timestamp_seconds("event_id"))
    good, bad = live.ingested(df)
    assert good.count() == 4 and [r.event_id for r in bad.collect()] == [5]
    assert [r.event_id for r in live.before_shutdown(df).collect()] == [1, 2] and live.before_shutdown(df.filter("event_id <> 3")).count() == 4
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    seen, errors, held = [], [], []

    def broken(batch, number):
        raise RuntimeError("no")

    writer = live.fan_out(stream, [broken, lambda batch, number: seen.extend(r.event_id for r in batch.collect()), live.stop_at_shutdown(lambda: held[0] if held else None)], errors.append)
    q = live.refreshed(writer).option("checkpointLocation", str(tmp_path / "c")).start()
    held.append(q)
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == [1, 2, 3, 4, 5] and len(errors) >= 1 and isinstance(errors[0], RuntimeError)


def test_late_events_are_counted(spark, tmp_path):
    def write(rows):
        df = spark.createDataFrame(rows, "event_id long, pipeline string, event_type string, items long").withColumn("ts", F.timestamp_seconds("event_id"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return df.schema

    found = []
    for rows in ([(5, "tts", "start", 3), (6, "tts", "complete", 0)], [(2, "tts", "complete", 0), (7, "tts", "complete", 0)]):
        stream = spark.readStream.schema(write(rows)).parquet(str(tmp_path / "in"))
        writer = streaming.fold_stream(stream).writeStream.outputMode("update").foreachBatch(lambda b, n: found.extend(b.collect()))
        writer.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination(120)
    assert [(r.total_items, r.completed_items, r.late) for r in found if r.pipeline] == [(3, 1, 0), (3, 2, 1)]
