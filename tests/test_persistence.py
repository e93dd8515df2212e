"""Caches that outlive runs, and contents of books."""

import zipfile

import pytest

from scriptorium import cli
from scriptorium.sinks import cache
from scriptorium.sources import epub

ENTRY = "k string, text string, at long"


def held(spark, folder, schema):
    return {r.k: (r.text, r.at) for r in cache.read_cache(spark, folder, schema).collect()}


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_cache_stays(spark, tmp_path, scheme, monkeypatch):
    folder = f"{scheme}{tmp_path}/cache"
    first = spark.createDataFrame([(f"k{n}", f"a{n}", 1) for n in range(50)] + [(None, "none", 1)], ENTRY)
    schema = first.schema
    assert held(spark, folder, schema) == {}
    cache.write_cache(first.limit(0), folder, "k", "at")
    assert held(spark, folder, schema) == {}
    cache.write_cache(first, folder, "k", "at")
    cache.write_cache(first, folder, "k", "at")
    whole = {f"k{n}": (f"a{n}", 1) for n in range(50)} | {None: ("none", 1)}
    assert held(spark, folder, schema) == whole and cache.read_cache(spark, folder, schema).count() == 51
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "cache").rglob("*.parquet")}
    second = spark.createDataFrame([("k1", "b1", 2), ("k2", "late", 0), ("new", "c", 5), ("new", "d", 6)], ENTRY)
    # a run that stops before its write is complete: nothing happened
    real = cache._apply
    (tmp_path / "cache/_pending").mkdir()
    (tmp_path / "cache/_pending/part-0.parquet").write_bytes(b"torn")
    assert held(spark, folder, schema) == whole
    # one that stops after it: it counts, and the next run puts it in place
    calls = []
    monkeypatch.setattr(cache, "_apply", lambda *a: real(*a) if not calls.append(a) and len(calls) == 1 else None)
    cache.write_cache(second, folder, "k", "at")
    monkeypatch.setattr(cache, "_apply", real)
    want = whole | {"k1": ("b1", 2), "new": ("d", 6)}
    assert (tmp_path / "cache/_pending/_SUCCESS").exists() and held(spark, folder, schema) == want
    cache.write_cache(second, folder, "k", "at")
    assert held(spark, folder, schema) == want and not (tmp_path / "cache/_pending").exists()
    left = [f for f, at in files.items() if f.exists() and f.stat().st_mtime_ns == at]
    assert len(left) >= 0.5 * len(files)  # buckets without new keys are the files they were
    cache.expire(spark, folder, schema, "at", 2)
    assert held(spark, folder, schema) == {"k1": ("b1", 2), "new": ("d", 6)}
    cache.expire(spark, folder, schema, "at", 100)
    assert held(spark, folder, schema) == {}


NAV = """<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="landmarks"><ol><li><a href="x">no</a></li></ol></nav>
<nav epub:type="toc"><ol><li><a href="a.xhtml#1">Part   <b>One</b></a><ol><li><a href="a.xhtml#2">Alpha</a><ol><li><a href="a.xhtml#3">Deep</a></li></ol></li><li><a href="a.xhtml#4">Beta</a></li></ol></li><li><span>Part Two</span></li></ol></nav></body></html>"""
NCX = """<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>Part One</text></navLabel><content src="a.xhtml"/><navPoint><navLabel><text>Alpha</text></navLabel><content src="a.xhtml#2"/></navPoint></navPoint></navMap></ncx>"""


def book(path, text, nav=None, ncx=None, image=False):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        items = '<item id="a" href="a.xhtml" media-type="application/xhtml+xml"/>'
        items += '<item id="n" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/>' if nav else ""
        items += '<item id="t" href="toc.ncx" media-type="application/x-dtbncx+xml"/>' if ncx else ""
        items += '<item id="i" href="i.png" media-type="image/png"/><item id="j" href="gone.png" media-type="image/png"/>' if image else ""
        z.writestr("o/p.opf", f'<package xmlns="urn:y" xmlns:dc="urn:z"><metadata><dc:title>T</dc:title></metadata><manifest>{items}</manifest><spine><itemref idref="a"/></spine></package>')
        z.writestr("o/a.xhtml", f"<html><body>{text}</body></html>")
        for name, data in (("nav.xhtml", nav), ("toc.ncx", ncx), ("i.png", b"picture" if image else None)):
            if data:
                z.writestr(f"o/{name}", data)


def test_contents_of_books(spark, tmp_path):
    text = "<p>Part One</p><p>of it all</p><p>Alpha</p><p>first words</p><p>Deep</p><p>below that</p><p>Beta</p><p>second words</p><p>Part Two</p><p>the end</p>"
    book(tmp_path / "nav.epub", text, NAV, NCX, image=True)
    book(tmp_path / "ncx.epub", text, None, NCX)
    book(tmp_path / "broken.epub", text, "<html>", NCX)
    book(tmp_path / "none.epub", text)
    (tmp_path / "bad.epub").write_bytes(b"no book")
    books = epub.read_epub(spark, str(tmp_path))
    got = {}
    for r in sorted(epub.contents(books).collect(), key=lambda r: (r.path, r.pos)):
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.pos, r.level, r.place, r.title, r.href))
    assert got["nav.epub"] == [(1, 1, "1", "Part One", "a.xhtml#1"), (2, 2, "1.1", "Alpha", "a.xhtml#2"), (3, 3, "1.1.1", "Deep", "a.xhtml#3"), (4, 2, "1.2", "Beta", "a.xhtml#4"), (5, 1, "2", "Part Two", None)]
    assert [e[2:4] for e in got["ncx.epub"]] == [("1", "Part One"), ("1.1", "Alpha")] == [e[2:4] for e in got["broken.epub"]]
    assert set(got) == {"nav.epub", "ncx.epub", "broken.epub"}
    out = tmp_path / "out"
    cli.convert(spark, str(tmp_path / "*.epub"), str(out), "json", "modern").collect()
    import json

    titles = {f.stem: [c["title"] for c in json.loads(f.read_text())["chapters"]] for f in out.glob("*.json") if "_metadata" not in f.name}
    assert titles["nav"] == ["Part One", "Alpha", "Deep", "Beta", "Part Two"] and titles["ncx"] == ["Part One", "Alpha"] and len(titles["none"]) >= 1 and "bad" not in titles
    images = epub.image_bytes(spark, str(tmp_path / "*.epub")).collect()
    assert [(r.path.rsplit("/", 1)[1], r.file_path, bytes(r.content)) for r in images] == [("nav.epub", "o/i.png", b"picture")]


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_wav_of_all_widths(spark, tmp_path, width):
    import wave

    from scriptorium.sources import media_files

    top = 2 ** (8 * width - 1) - 1
    values = [0, top, -top, top // 2, -(top // 3)]
    data = b"".join((v + 128).to_bytes(1, "little") if width == 1 else v.to_bytes(width, "little", signed=True) for v in values for _ in range(2))
    with wave.open(str(tmp_path / "a.wav"), "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(width)
        f.setframerate(8000)
        f.writeframes(data)
    row = media_files.read_audio(spark, str(tmp_path)).first()
    assert row.error is None and row.rate == 8000 and row.samples == pytest.approx([v / top for v in values])


def test_settings_of_rows_are_those_of_files(spark):
    """The column of invalid names says what problems() says of the same settings, one by one."""
    from pyspark.sql import functions as F

    from scriptorium.functions import settings

    base = {"engine": "kokoro", "speed": 1.0, "pitch": 1.0, "sample_rate": 22050, "format": "wav", "text_format": "plain", "min_words": 10, "max_words": 100, "max_jobs": 1}
    wrong = [{}, {"speed": 3.0}, {"pitch": 0.1}, {"sample_rate": 8000}, {"format": "flac"}, {"text_format": "xml"}, {"min_words": 0}, {"max_words": 5}, {"max_jobs": 0}, {"engine": "x", "speed": 0.4}]
    rows = [(k, *(base | w).values()) for k, w in enumerate(wrong)]
    df = spark.createDataFrame(rows, ["row", *base])
    got = {r.row: r.bad for r in df.select("row", settings.invalid({c: F.col(c) for c in base}).alias("bad")).collect()}
    for k, w in enumerate(wrong):
        assert len(got[k]) == len(settings.problems(base | w)) == len(w), w
    assert got[7] == ["max_words_per_chunk"] and got[9] == ["engine", "speed"]
