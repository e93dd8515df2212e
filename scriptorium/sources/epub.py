"""Books from EPUB files, and file lists: Spark reads the bytes, the standard library unpacks them."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import reachable

IMAGE = "struct<file_path: string, alt_text: string, position: bigint, format: string>"
ENTRY = "struct<title: string, href: string, place: array<int>>"
METADATA = "title string, author string, authors array<string>, publisher string, publication_date string, language string, identifier string, description string, subjects array<string>, original_format string, file_size long"
BOOK = f"path string, {METADATA}, content string, chapters array<struct<title: string, content: string, word_count: bigint>>, images array<string>, image_info array<{IMAGE}>, toc array<{ENTRY}>, error string"
COLUMNS = [c.split()[0] for c in ("path", *METADATA.split(", "), "content", "chapters", "images", "image_info", "toc", "error")]


class _Text(HTMLParser):
    BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li br tr section article blockquote".split())

    def __init__(self):
        super().__init__()
        self.out, self.skip, self.heading, self.title, self.alts = [], 0, False, "", {}

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "head")
        self.heading = tag in ("h1", "h2") or self.heading
        if tag in self.BLOCKS:
            self.out.append("\n")
        if tag == "img" and dict(attrs).get("src"):
            self.alts[posixpath.basename(dict(attrs)["src"])] = dict(attrs).get("alt") or ""

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "head")
        if tag in ("h1", "h2"):
            self.heading = False
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)
            if self.heading and not self.title:
                self.title = data.strip()


def _plain(root):
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    return root


def _said(e) -> str:
    return " ".join("".join(e.itertext()).split())


def _entries(parent, child: str, title, href, within) -> list[dict]:
    """A tree of entries as a list in reading order; place is the way down, counted from 1 at each level."""
    out, stack = [], [(iter(enumerate(within(parent, child), 1)), [])]
    while stack:  # without recursion: contents may nest deeply
        for k, e in stack[-1][0]:
            place = [*stack[-1][1], k]
            if label := title(e):
                out.append({"title": label, "href": href(e), "place": place})
            stack.append((iter(enumerate(within(e, child), 1)), place))
            break
        else:
            stack.pop()
    return out


def _contents(z: zipfile.ZipFile, package, items: dict, folder: str) -> list[dict]:
    """Contents of a book: those of its navigation document, else of its NCX file; none if there is neither or both are broken."""
    docs = [i for i in items.values() if "nav" in (i.get("properties") or "").split()] + [i for i in items.values() if i.get("media-type") == "application/x-dtbncx+xml"]
    for item in docs:
        try:
            root = _plain(ElementTree.fromstring(z.read(posixpath.normpath(posixpath.join(folder, item.get("href"))))))
        except (KeyError, ElementTree.ParseError):
            continue
        if (ncx := root.find(".//navMap")) is not None:
            found = _entries(ncx, "navPoint", lambda e: _said(e.find("navLabel")) if e.find("navLabel") is not None else "", lambda e: (e.find("content").get("src") if e.find("content") is not None else None), lambda e, c: e.findall(c))
        else:
            navs = list(root.iter("nav"))
            nav = next((n for n in navs if any(k.endswith("type") and "toc" in v.split() for k, v in n.attrib.items())), navs[0] if navs else None)
            if nav is None:
                continue
            link = lambda e: e.find("a") if e.find("a") is not None else e.find("span")
            found = _entries(nav, "li", lambda e: _said(link(e)) if link(e) is not None else "", lambda e: link(e).get("href"), lambda e, c: [x for ol in e.findall("ol") for x in ol.findall(c)])
        if found:
            return found
    return []


def parse(data: bytes) -> dict:
    """Metadata, chapters (in spine order), images (in manifest order, with their alternative texts) and contents of one EPUB file.

    authors are all creators, author the first; identifier prefers an ISBN.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        strip = lambda root: [setattr(e, "tag", e.tag.rpartition("}")[2]) for e in root.iter()] and root
        opf = strip(ElementTree.fromstring(z.read("META-INF/container.xml"))).find(".//rootfile").get("full-path")
        package = strip(ElementTree.fromstring(z.read(opf)))
        items = {i.get("id"): i for i in package.iter("item")}
        text = lambda tag: next((e.text for e in package.iter(tag) if e.text), None)
        every = lambda tag: [e.text.strip() for e in package.iter(tag) if e.text and e.text.strip()]
        chapters, alts = [], {}
        for ref in package.iter("itemref"):
            if (item := items.get(ref.get("idref"))) is None:
                continue
            page = _Text()
            page.feed(z.read(posixpath.normpath(posixpath.join(posixpath.dirname(opf), item.get("href")))).decode("utf-8", "replace"))
            alts.update(page.alts)
            body = re.sub(r"\n{2,}", "\n\n", "".join(page.out)).strip()
            if body:
                chapters.append({"title": page.title or f"Chapter {len(chapters) + 1}", "content": body, "word_count": len(body.split())})
        images = [i for i in items.values() if (i.get("media-type") or "").startswith("image/")]
        info = [
            {"file_path": posixpath.normpath(posixpath.join(posixpath.dirname(opf), i.get("href"))), "alt_text": alts.get(posixpath.basename(i.get("href")), ""), "position": k, "format": i.get("media-type").split("/", 1)[1]}
            for k, i in enumerate(images)
        ]
        identifiers = every("identifier")
        return {
            "title": text("title"), "author": text("creator"), "authors": every("creator"), "publisher": text("publisher"), "publication_date": text("date"), "language": text("language"),
            "identifier": next((x for x in identifiers if "isbn" in x.lower() or re.fullmatch(r"[\d-]{9,16}[\dXx]", x)), next(iter(identifiers), None)), "description": text("description"), "subjects": every("subject"),
            "original_format": "epub", "file_size": len(data), "content": "\n\n".join(c["content"] for c in chapters), "chapters": chapters, "images": [i.get("href") for i in images], "image_info": info, "toc": _contents(z, package, items, posixpath.dirname(opf)), "error": None,
        }


def read_epub(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row for each file; a file that can't be read has an error and no chapters, and the others go on."""
    reachable(spark)

    def run(frames):
        for frame in frames:
            rows = []
            for p, data in zip(frame["path"], frame["content"]):
                try:
                    rows.append({"path": p, **parse(bytes(data))})
                except Exception as e:  # a broken book is a row, not a failed job
                    rows.append({"path": p, "authors": [], "subjects": [], "original_format": "epub", "file_size": len(data), "chapters": [], "images": [], "image_info": [], "toc": [], "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=COLUMNS, dtype=object)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, BOOK)


def contents(books: DataFrame, key: str = "path") -> DataFrame:
    """(key, pos, level, place, title, href) of books' contents, nested levels flattened in reading order; pos from 1, place the way down. Books without contents have no rows."""
    rows = books.select(key, F.posexplode("toc").alias("_k", "_e"))
    return rows.select(key, (F.col("_k") + 1).cast("long").alias("pos"), F.size("_e.place").alias("level"), F.array_join(F.transform("_e.place", lambda x: x.cast("string")), ".").alias("place"), F.col("_e.title").alias("title"), F.col("_e.href").alias("href"))


def image_bytes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, file_path, content) of all images that books list and hold; books that can't be read have none."""
    reachable(spark)

    def run(frames):
        for frame in frames:
            for p, data in zip(frame["path"], frame["content"]):
                rows = []
                try:
                    listed = [i["file_path"] for i in parse(bytes(data))["image_info"]]
                    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                        names = set(z.namelist())
                        rows = [(p, f, z.read(f)) for f in listed if f in names]
                except Exception:  # its error is read_epub's to tell
                    rows = []
                yield pd.DataFrame(rows, columns=["path", "file_path", "content"], dtype=object)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, file_path string, content binary")


def validate(books: DataFrame, least_bytes: int = 1024, *keys: str) -> DataFrame:
    """(path, keys, issues) of books as read_epub gives them, files that don't exist included as rows without file_size."""
    size = F.col("file_size")
    found = F.array_compact(F.array(
        F.when(size.isNull(), "file does not exist"), F.when(~F.lower("path").endswith(".epub"), "not an .epub"), F.when(size == 0, "empty").when(size < least_bytes, "too small"),
        F.when(F.col("error").isNotNull(), F.concat(F.lit("parse error: "), "error")), F.when(F.col("error").isNull() & size.isNotNull() & (F.coalesce("title", F.lit("")) == ""), "no title"),
        F.when(F.col("error").isNull() & size.isNotNull() & (F.coalesce("content", F.lit("")) == ""), "no text"),
    ))
    return books.select("path", *keys, found.alias("issues"))


def expand(listing: DataFrame, path: str = "path") -> DataFrame:
    """Different .epub paths of a listing, in order."""
    return listing.filter(F.lower(F.col(path)).endswith(".epub")).select(path).distinct().orderBy(path)


def expand_patterns(spark: SparkSession, patterns: list[str]) -> tuple[DataFrame, list[str]]:
    """Books that patterns name, each once and in order, and the patterns that name none: an .epub file, a glob with * or ?, or a folder of .epub files."""
    found, left = [], []
    for pattern in patterns:
        folder = not re.search(r"[*?]|\.epub$", pattern, re.I)
        reader = spark.read.format("binaryFile")
        try:
            listed = (reader.option("pathGlobFilter", "*.{epub,EPUB,Epub}") if folder else reader).load(pattern).select("path")
        except AnalysisException:  # nothing there
            left.append(pattern)
            continue
        found.append(listed)
    every = found[0] if found else spark.createDataFrame([], "path string")
    for df in found[1:]:
        every = every.union(df)
    return expand(every), left
