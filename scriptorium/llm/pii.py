"""Personal data by offset-preserving deobfuscation.

Four exact patterns find identifiers in the source text. Then transducers rewrite disguises (homoglyphs, characters
of no width, spelled digits, at/dot in words or brackets) into a normalised text that keeps its edits, by which any
span of it leads back to the source. The same patterns run over it, and what they find is mapped back to source characters.
Spans found that way are added where they overlap no other.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches
from .tokenizing import parts_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def emails(text: str):
    """The matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from their @ outwards, in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns: leftmost, not overlapping within a kind, matches that fail their test dropped."""
    found: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(n := p.lstrip("0")) <= 3 and int(n or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


# Letters of other scripts that look like ASCII letters, and number words of four languages.
LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝɡАВЕКМНОРСТУХІЈЅαοινΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwgABEKMHOPCTYXIJSaoivABEZHIKMNOPTYX"))
NUMBER_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
INVISIBLE = "­​‌‍⁠﻿"
_NUMBER = "|".join(sorted(NUMBER_WORDS, key=len, reverse=True))
_AT = r"(?<!\s)\s*+[\[({<]\s*(?:at|@|arroba|ät)\s*[\])}>]\s*"
_DOT = r"(?<!\s)\s*+[\[({<]\s*(?:dot|\.|punkt|point|punto)\s*[\])}>]\s*"
_BRACKET = re.compile(r"[\[({<]\s*(?:at|@|arroba|ät|dot|\.|punkt|point|punto)\s*[\])}>]", re.I)
_BRACKETED = re.compile(rf"(?P<at>{_AT})|(?P<dot>{_DOT})", re.I)
_NAME = r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*"
#: Last labels that make words with at and dot an address; ordinary words such as "in" or "it" aren't among them.
SPOKEN_ENDINGS = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "dev", "app", "uk", "de", "fr", "es", "eu", "ch", "nl", "pl", "se", "ru", "jp", "cn", "br", "mx", "ca", "au")
_SPOKEN = re.compile(rf"(?<![\w.%+-])(?:{_NAME}(?:\s+(?:dot|punkt|point|punto)\s+))*{_NAME}(?P<at>\s+(?:at|arroba|ät)\s+)[A-Za-z0-9-]+(?:(?:\s+(?:dot|punkt|point|punto)\s+|\.)[A-Za-z0-9-]+)*(?:\s+(?:dot|punkt|point|punto)\s+)(?:{'|'.join(SPOKEN_ENDINGS)})(?!\w)", re.I)
#: Country domains; with at and dot in words they make an address too where no word of PROSE or AFTER_AT speaks against it.
COUNTRIES = frozenset(
    "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn so sr ss st sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw".split()
)
#: Words before at that speak of a place on the web, and words after it that no domain begins with.
PROSE = frozenset("me us you him her them it here there available found find look looks looked looking online site website web page pages visit see read more info information details hosted documentation docs download downloads is are was be and or".split())
AFTER_AT = frozenset("the a an this that these those each every any some which what one my your his her its our their no all www".split())
_AT_DOMAIN = re.compile(r"(?<=\s)(?P<word>at|arroba|ät)\s++(?P<domain>[A-Za-z0-9-]++(?:(?:\s++(?:dot|punkt|point|punto)\s++|\.)[A-Za-z0-9-]++)+)", re.I)
_WORDS = re.compile(r"\w+")
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_DOT_BEFORE = re.compile(r"\s(?:dot|punkt|point|punto)\Z", re.I)
_CUE = re.compile(r"mail|contact|kontakt|address|adress|correo|courriel|schreib|write", re.I)
_SPOKEN_DOT = re.compile(r"\s+(?:dot|punkt|point|punto)\s+", re.I)
_SPELLED = re.compile(rf"(?<!\w)(?:(?:plus)[\s-]+)?(?:(?:double|triple)\s+)?(?:{_NUMBER}|[0-9]+)(?:[\s,.-]+(?:(?:double|triple)\s+)?(?:dot|punkt|point|punto|{_NUMBER}|[0-9]+)(?!\w))+", re.I)
_SPELLED_WORD = re.compile(rf"plus|double|triple|dot|punkt|point|punto|{_NUMBER}|[0-9]+", re.I)
#: Cheap signs that a text may hold a disguise in words, no narrower than the patterns; number words need several of them.
_DOT_WORDS = ("dot", "punkt", "point", "punto")
_DOT_SIGN = re.compile(r"(?<=\s)(?:dot|punkt|point|punto)(?=\s)", re.I)
_INVISIBLE = re.compile(f"[{INVISIBLE}]+")
#: Characters of a text that are cut into words at a time, for memory, and the words that reach from one such part into the next.
_PART, _REACH = 1 << 20, 16


@lru_cache(1)
def _single() -> dict[str, str]:
    """Characters that stand for one ASCII character: look-alikes, decimal digits of any script, full-width and styled forms."""
    table = dict(LOOKALIKES)
    for c in range(0x80, 0x20000):
        ch = chr(c)
        if (d := unicodedata.decimal(ch, None)) is not None:
            table[ch] = str(d)
        elif 0xFF01 <= c <= 0xFF5E or 0x1D400 <= c <= 0x1D7FF or c in (0xFE52, 0xFE6B, 0x2024, 0x3002, 0x2010, 0x2011, 0x2012, 0x2013, 0x2212, 0x00A0, 0x2007, 0x202F):
            plain = {0x3002: ".", 0x2212: "-", 0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-"}.get(c) or unicodedata.normalize("NFKC", ch)
            if len(plain) == 1 and plain.isascii():
                table[ch] = plain
    return table


@lru_cache(1)
def _odd() -> frozenset[str]:
    return frozenset([*_single(), *INVISIBLE])


@lru_cache(1)
def _translation() -> dict[int, str]:
    return str.maketrans(_single())


class Tape:
    """A text that was rewritten step by step, and the way back: each step keeps its edits only, in order.

    What an edit put in stands for the whole span that it replaced; any other character stands for itself, a
    bisection away. Memory follows the number of edits and not the length of the text.
    """

    def __init__(self, text: str):
        self.text, self.steps = text, []

    def same_length(self, text: str) -> "Tape":
        """Replaces characters one by one, which moves none."""
        self.text = text
        return self

    def rewrite(self, edits: Iterable[tuple[int, int, str]]) -> "Tape":
        """Replaces spans, which come in order and apart from each other."""
        text, at, moved = [], 0, 0
        new_at, new_end, old_at, old_end = (array("q") for _ in range(4))
        for a, b, new in edits:
            text += [self.text[at:a], new]
            new_at.append(a + moved)
            new_end.append(a + moved + len(new))
            old_at.append(a)
            old_end.append(b)
            moved, at = moved + len(new) - (b - a), b
        if new_at:
            self.text = "".join(text) + self.text[at:]
            self.steps.append((new_at, new_end, old_at, old_end))
        return self

    def source(self, a: int, b: int) -> tuple[int, int]:
        """The source span of characters a to b (exclusive) of the text."""
        for step in reversed(self.steps):
            a, b = self._before(step, a)[0], self._before(step, b - 1)[1]
        return a, b

    @staticmethod
    def _before(step, p: int) -> tuple[int, int]:
        new_at, new_end, old_at, old_end = step
        k = bisect_right(new_at, p) - 1
        if k < 0:
            return p, p + 1
        if p < new_end[k]:
            return old_at[k], old_end[k]
        p += old_end[k] - new_end[k]
        return p, p + 1


def _characters(tape: Tape) -> Tape:
    if tape.text.isascii():
        return tape
    tape.same_length(tape.text.translate(_translation()))
    return tape.rewrite((m.start(), m.end(), "") for m in _INVISIBLE.finditer(tape.text))


def _local(text: str, end: int) -> tuple[int, list[tuple[int, int]]]:
    """Where the name that ends before `end` begins, white space between left out, and the spans of its dots in words; (end, []) if there is none."""
    start, dots, dot = end, [], None
    while True:
        stop = dot[0] if dot else end
        while not dot and stop and text[stop - 1].isspace():
            stop -= 1
        at = stop
        while at and text[at - 1] in _LOCAL:
            at -= 1
        while at < stop and text[at] == ".":
            at += 1
        if at == stop or text[stop - 1] == "." or (at and text[at - 1].isalnum()):
            return start, dots
        start, dots = at, [dot, *dots] if dot else dots
        while at and text[at - 1].isspace():
            at -= 1
        word = _DOT_BEFORE.search(text, max(0, at - 7), at)
        if at == start or not word:
            return start, dots
        stop = word.start() + 1
        while stop and text[stop - 1].isspace():
            stop -= 1
        dot = (stop, start)


def _is_address(text: str, start: int, at: int, labels: list[str], dots: list[str]) -> bool:
    """Whether what stands at start, at in words and these labels are an address and not prose."""
    end, name = labels[-1], text[start:at].strip()
    if not re.fullmatch("[A-Za-z]{2,}", end) or labels[0].lower() in AFTER_AT or name.lower() in PROSE:
        return False
    known = end.lower() in COUNTRIES or end.lower() in SPOKEN_ENDINGS
    strong = bool(re.search(r"[0-9._]|\s", name) or re.search("[0-9]", "".join(labels)) or _CUE.search(text, max(0, start - 40), start))
    if all(d == "." for d in dots):
        return (end.islower() or end.isupper()) and known
    if "point" in dots:
        return known and (strong or len(dots) > 1)
    return known or strong or len(dots) > 1


def _spoken(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Edits of addresses with at in words that _SPOKEN doesn't know; none touches a span of `taken`."""
    edits, last, k = [], 0, 0
    for m in _AT_DOMAIN.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            last = max(last, taken[k][1])
            k += 1
        stop = m.start()
        while stop and text[stop - 1].isspace():
            stop -= 1
        start, before = _local(text, m.start())
        found = list(_LABEL.finditer(text, *m.span("domain")))
        pieces, n = [(found[0].start(), found[0].end())], 1
        gaps = []
        while n < len(found) and len(pieces) < 127:  # no domain has more labels; words for dots stand between labels as labels of their own
            gap = text[pieces[-1][1] : found[n].start()]
            if gap == ".":
                gaps.append((pieces[-1][1], found[n].start(), "."))
                pieces.append(found[n].span())
                n += 1
            else:
                gaps.append((pieces[-1][1], found[n + 1].start(), found[n][0].lower()))
                pieces.append(found[n + 1].span())
                n += 2
        while len(pieces) > 1 and not _is_address(text, start, stop, [text[a:b] for a, b in pieces], [g[2] for g in gaps]):
            pieces.pop()
            gaps.pop()
        if len(pieces) < 2 or start >= stop or start < last or (k < len(taken) and taken[k][0] < pieces[-1][1]):
            continue
        edits += [(a, b, ".") for a, b in before] + [(stop, pieces[0][0], "@")] + [(a, b, ".") for a, b, d in gaps if d != "."]
        last = pieces[-1][1]
    return edits


def _dot_sign(text: str, low: str) -> bool:
    return any(w in low for w in _DOT_WORDS) and bool(_DOT_SIGN.search(text))


def _at_dot(tape: Tape) -> Tape:
    tape = tape.rewrite((m.start(), m.end(), "@" if m["at"] else ".") for m in _BRACKETED.finditer(tape.text)) if _BRACKET.search(tape.text) else tape
    edits, taken = [], []
    if _dot_sign(tape.text, tape.text.lower()):
        for m in _SPOKEN.finditer(tape.text):
            a, b = m.span("at")
            taken.append(m.span())
            edits += [(d.start(), d.end(), ".") for d in _SPOKEN_DOT.finditer(tape.text, m.start(), a)] + [(a, b, "@")] + [(d.start(), d.end(), ".") for d in _SPOKEN_DOT.finditer(tape.text, b, m.end())]
    return tape.rewrite(sorted(edits + _spoken(tape.text, taken)))


def _spelled(tape: Tape) -> Tape:
    """Runs with at least four number words, or with figures and three words for dots, become digits; plus becomes +, dot a dot, double and triple repeat."""
    edits = []
    low = tape.text.lower()
    if not _number_words(low) and not _dot_sign(tape.text, low):
        return tape
    for m in _SPELLED.finditer(tape.text):
        parts = [(p.start(), p.end(), p[0].lower()) for p in _SPELLED_WORD.finditer(tape.text, m.start(), m.end())]
        if sum(w in NUMBER_WORDS for _, _, w in parts) < 4 and sum(w in _DOT_WORDS for _, _, w in parts) < 3:
            continue
        times, at = 1, m.start()
        for k, (a, b, w) in enumerate(parts):
            if w in ("double", "triple"):
                times = 2 if w == "double" else 3
                continue
            new = "+" if w == "plus" else NUMBER_WORDS.get(w, w if w.isdigit() else ".") * (times if w in NUMBER_WORDS else 1)
            edits.append((at if k else m.start(), b, new))
            times, at = 1, b
    return tape.rewrite(edits)


def _number_words(low: str) -> bool:
    """Whether four number words stand within sixteen words of each other, as any run that _spelled rewrites has them."""
    seen: list[int] = []  # places of the last number words
    before = 0
    for part in parts_of(low, _PART):
        words = _WORDS.findall(part)
        at = seen + [before + k for k, w in enumerate(words) if w in NUMBER_WORDS]
        if any(b - a < _REACH for a, b in zip(at, at[3:])):
            return True
        seen, before = at[-3:], before + len(words)
    return False


def disguised(text: str) -> bool:
    """Cheap signs that a rewriting could find anything."""
    if not text.isascii() and not _odd().isdisjoint(text):
        return True
    low = text.lower()
    return _dot_sign(text, low) or bool(_BRACKET.search(text)) or bool(_AT_DOMAIN.search(text)) or _number_words(low)


def _stretches(spans: list[Span]) -> list[tuple[int, int, list[Span]]]:
    """Stretches of text that spans cover, in order and apart from each other, each with its spans."""
    out: list[tuple[int, int, list[Span]]] = []
    for span in sorted(spans, key=lambda s: s[1:]):
        _, a, b = span
        if out and a < out[-1][1]:
            out[-1][2].append(span)
            out[-1] = out[-1][0], max(b, out[-1][1]), out[-1][2]
        else:
            out.append((a, b, [span]))
    return out


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans that only the normalised text shows, in source characters.

    None overlaps another, nor a base span, unless it holds all of a shorter one of its kind: the rest of an identifier
    that a disguise cut off. Where candidates overlap, the one that starts first counts, then the longest.
    """
    if not disguised(text):
        return []
    tape = _spelled(_at_dot(_characters(Tape(text))))
    if tape.text == text:
        return []
    taken, at, end_of_last, out = _stretches(base), 0, 0, []
    found = [(kind, *tape.source(a, b)) for kind, a, b in base_spans(tape.text)]
    for kind, start, end in sorted(found, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        k, met = at, []
        while k < len(taken) and taken[k][0] < end:
            met += [s for s in taken[k][2] if s[1] < end and s[2] > start]
            k += 1
        if start >= end_of_last and all(s[0] == kind and start <= s[1] and s[2] <= end and s[2] - s[1] < end - start for s in met):
            out.append((kind, start, end))
            end_of_last = end
    return out


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered(spans))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all, kind:start:end), n_added of every row.

    Null text is empty and has no spans. Equal rows and rows with equal or null ids are read one by one; extra columns
    are ignored; no rows, none. Spans of one start go by kind.
    """

    def make():
        def step(batch: pa.RecordBatch):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                base = base_spans(text)
                added = added_spans(text, base)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added)))
            return list(zip(*rows))

        return step

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(text: str) -> str:
    """The text with each stretch of personal data replaced by its kind in capitals, e.g. <EMAIL>; overlapping spans are one stretch."""
    base = base_spans(text)
    out, at, end = [], 0, -1
    for kind, a, b in ordered(base + added_spans(text, base)):
        if a < end:
            end = at = max(end, b)
            continue
        out += [text[at:a], f"<{kind.upper()}>"]
        at = end = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """All rows with their columns, personal data replaced in text; n_chars, where there is one, follows.

    Null texts stay null, empty ones empty. Spans that overlap or touch the same characters go as one stretch, under the kind
    that starts first (then in the order of KINDS). Texts and numbers of any length are read whole; equal rows are
    redacted one by one; no rows, none.
    """
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def make():
        def step(batch: pa.RecordBatch):
            texts = [None if t is None else redacted(t) for t in (x.as_py() for x in batch.column(at))]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            if count is not None:
                columns[count] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            return columns

        return step

    return map_batches(docs, make, docs.schema)
