"""Declarative text rules, in a regular-expression subset that Spark and DuckDB read alike.

`<S>` stands for all Unicode white space inside a character class; dialects differ in their \\s.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import over_texts

SPACE = r"\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: White space of str.strip() and str.split(), which has four control characters more.
STRIP = SPACE + r"\x{1c}-\x{1f}"
#: The same two sets for Java, where a list of ranges is asked one by one for each character (ten times the time) and a property once.
JAVA_SPACE = r"\p{IsWhite_Space}"
JAVA_STRIP = JAVA_SPACE + r"\x{1c}-\x{1f}"
#: What a rule that makes every run of white space one space changes: all runs but a space by itself.
RUNS = f"[{STRIP.replace(' ', '')}][{STRIP}]*| [{STRIP}]+"
JAVA_RUNS = f"[[^!-~]&&[{JAVA_STRIP}]&&[^ ]][{JAVA_STRIP}]*+| [[^!-~]&&[{JAVA_STRIP}]]++"  # most characters are told by the first range
#: The characters of STRIP themselves.
STRIPPED = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\x1c\x1d\x1e\x1f"


def in_java(pattern: str) -> str:
    return pattern.replace("<S>", JAVA_SPACE).replace("<Z>", JAVA_STRIP)


@dataclass(frozen=True)
class Rule:
    """Replaces every match; \\1 in the replacement is the first group. literal: pattern is plain text; faster: what finds the same matches in Java sooner; sparing: what finds those of them that change, in RE2."""

    pattern: str
    replacement: str = ""
    multiline: bool = False
    literal: bool = False
    ignore_case: bool = False
    faster: str = ""
    sparing: str = ""

    @property
    def regex(self) -> str:
        return self.pattern.replace("<S>", SPACE).replace("<Z>", STRIP)

    @property
    def java(self) -> str:
        return in_java(self.faster or self.pattern)

    def spark(self, text: Column) -> Column:
        if self.literal:
            return F.replace(text, F.lit(self.pattern), F.lit(self.replacement))
        flags = "d" + "m" * self.multiline + "i" * self.ignore_case
        return F.regexp_replace(text, f"(?{flags})" + self.java, self.replacement.replace("$", r"\$").replace("\\1", "$1").replace("\\2", "$2"))

    def arrow(self, texts: pa.Array) -> pa.Array:
        """An array of texts, by the engine that DuckDB has (RE2): what spark() says, at an eighth of its time."""
        if self.literal:
            return texts if self.pattern == self.replacement else pc.replace_substring(texts, self.pattern, self.replacement)
        flags = "m" * self.multiline + "i" * self.ignore_case
        return pc.replace_substring_regex(texts, (f"(?{flags})" if flags else "") + (self.sparing or self.regex), self.replacement)

    def duck(self, text: str) -> str:
        if self.literal:
            return f"replace({text}, {quoted(self.pattern)}, {quoted(self.replacement)})"
        flags = "m" * self.multiline + "i" * self.ignore_case
        return f"regexp_replace({text}, {quoted((f'(?{flags})' if flags else '') + self.regex)}, {quoted(self.replacement)}, 'g')"


def quoted(text: str) -> str:
    """A DuckDB string; newlines by chr(10), as the driver may keep SQL on one line."""
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n")).join("()" if "\n" in text else ("", ""))


# Cleaning rules, headings and lowerings, in the order in which they apply. \p{Nd} are the decimal digits of all scripts.
REMOVE = (
    Rule(r"\[?\p{Nd}+\]"),
    Rule(r"^Page \p{Nd}+.*$", multiline=True),
    Rule(r"^[<S>]*Chapter \p{Nd}+[<S>]*$", multiline=True),
    Rule(r"<[^>]+>"),
    Rule(r"[<S>]{3,}", "  "),
)
TRANSFORM = (
    Rule(r"^#{1,6}[<S>]+(.+)$", "\n\n[CHAPTER_START: \\1][HEADER_END]\n\n", multiline=True),
    Rule(r"!\[([^\]]*)\]\([^\)]+\)", "\n[IMAGE: Image of \\1]\n"),
    Rule(r"\*\*(.+?)\*\*", "[EMPHASIS_STRONG: \\1]"),
    Rule(r"\*(.+?)\*", "[EMPHASIS_MILD: \\1]"),
    Rule(r'^"(.+)"$', "[DIALOGUE_START]\\1[DIALOGUE_END]", multiline=True),
    Rule("—", " -- ", literal=True),
    Rule("…", "…", literal=True),
)
CHARACTERS = tuple(
    Rule(a, b, literal=True)
    for a, b in (
        ("&", " and "), ("%", " percent "), ("$", " dollars "), ("€", " euros "), ("£", " pounds "), ("@", " at "), ("#", " number "),
        ("\u2018", "'"), ("\u2019", "'"), ("\u201b", "'"), ("\u2032", "'"), ("`", "'"), ("\u00b4", "'"),
    )
)
SPACING = (
    Rule(r" {2,}", " "),
    Rule(r"\n{3,}", "\n\n"),
    Rule(r"[ \t]+$", multiline=True),
    Rule(r"^[ \t]+", multiline=True),
    Rule(r"^[<Z>]+|[<Z>]+$"),
)
PAUSES = (
    Rule(r"\[CHAPTER_START: ([^\]]+)\]", "[CHAPTER_START: \\1][PAUSE: 2.0]"),
    Rule(r"\?([<S>]+)", "?[PAUSE: 0.5]\\1"),
    Rule(r"!([<S>]+)", "![PAUSE: 0.5]\\1"),
    Rule("[DIALOGUE_END]", "[DIALOGUE_END][PAUSE: 0.3]", literal=True),
    Rule("[HEADER_END]", "[PAUSE: 3.0]", literal=True),
    Rule(r",([<S>]+)", ",[PAUSE: 0.5]\\1"),
    Rule(r"\.([<S>]+)", ".[PAUSE: 0.5]\\1"),
    Rule("\n\n", "\n[PAUSE: 0.5]\n", literal=True),
)
CLEAN = REMOVE + TRANSFORM + CHARACTERS + SPACING + PAUSES
MARKER = r"\[CHAPTER_START: ([^\]]+)\]"
HEADINGS = (
    r"^Chapter[<S>]+\p{Nd}+", r"^Chapter[<S>]+[IVX]+", r"^CHAPTER[<S>]+\p{Nd}+", r"^#{1,3}[<S>]+Chapter", r"^#{1,3}[<S>]+\p{Nd}+[\.<S>]+",
    r"^\p{Nd}+\.[<S>]*[A-Z]", r"^#{1,3}[<S>]+[A-Z][^#\n]*$", r"^[A-Z][A-Z<S>]{3,}$", r"^Part[<S>]+[IVX\p{Nd}]+", r"^Section[<S>]+[IVX\p{Nd}]+",
)
MODERN = (
    Rule(r"https?://[^<S>]+", "URL"),
    # a name is read from its start, or from where the last match ended, not once more from each of its characters
    Rule(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "email address", faster=r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    Rule(r"\+[0-9][0-9 ()-]{7,}[0-9]", "phone number"),
    Rule(r"\$(\p{Nd}+)", "\\1 dollars"),
    Rule(r"€(\p{Nd}+)", "\\1 euros"),
    Rule(r"£(\p{Nd}+)", "\\1 pounds"),
    Rule(r"(\p{Nd}+)%", "\\1 percent"),
    Rule(r"[<Z>]&[<Z>]", " and "),
    Rule("—", " -- ", literal=True),
    Rule("–", " - ", literal=True),
    Rule("…", "... ", literal=True),
    Rule(r"[<Z>]+", " ", sparing=RUNS),
    Rule(r"^ +| +$"),
)
_ENDS = (Rule(r"[<Z>]+", " ", sparing=RUNS), Rule(r"^ +| +$"))
_TEXTS = (Rule("[DIALOGUE_START]", literal=True), Rule("[DIALOGUE_END]", literal=True))
PLAIN = (
    Rule(r"\[PAUSE:[<Z>]*[0-9.]+\]", " "),
    Rule(r"\[EMPHASIS_STRONG:[<Z>]*([^\]]+)\]", "\\1"),
    Rule(r"\[EMPHASIS_MILD:[<Z>]*([^\]]+)\]", "\\1"),
    *_TEXTS,
    Rule(r"\[CHAPTER_START:[<Z>]*([^\]]+)\]", "Chapter: \\1. "),
    Rule(r"\[IMAGE:[<Z>]*([^\]]+)\]", "Image description: \\1. "),
    Rule(r"\[IMAGE DESCRIPTION:[<Z>]*([^\]]+)\]", "Image description: \\1. "),
    Rule("[HEADER_END]", ". ", literal=True),
    Rule(r"\[[A-Z_]+(?::[<Z>]*[^\]]+)?\]", " "),
    *_ENDS,
)
_SPOKEN = (*_TEXTS, Rule(r"\[CHAPTER_START: ([^\]]+)\]", "Chapter: \\1. "), Rule(r"\[IMAGE: ([^\]]+)\]", "Image description: \\1. "), *_ENDS)
SSML = (
    Rule(r"\[PAUSE: ([0-9.]+)\]", '<break time="\\1s"/>'),
    Rule(r"\[EMPHASIS_STRONG: ([^\]]+)\]", '<emphasis level="strong">\\1</emphasis>'),
    Rule(r"\[EMPHASIS_MILD: ([^\]]+)\]", '<emphasis level="moderate">\\1</emphasis>'),
    *_SPOKEN,
)
ELLIPSIS = (Rule(r"\[PAUSE: ([0-9.]+)\]", " ... "), Rule(r"\[EMPHASIS_STRONG: ([^\]]+)\]", "\\1"), Rule(r"\[EMPHASIS_MILD: ([^\]]+)\]", "\\1"), *_SPOKEN)
PHONEME = (
    Rule(r"[<Z>]+", " ", sparing=RUNS),
    Rule(r"[^\p{L}\p{N}_<Z>.,!?;:'\"-]", " "),
    Rule(r"[.]{3,}", "..."),
    Rule(r"!{2,}", "!"),
    Rule(r"\?{2,}", "?"),
    Rule(r"([.!?])[<Z>]*([A-Z])", "\\1 \\2"),
    Rule(r"^[<Z>]+|[<Z>]+$"),
)
LOWERINGS = {"plain": PLAIN, "ssml": SSML, "ellipsis": ELLIPSIS}


def apply(text: Column, rules: tuple[Rule, ...]) -> Column:
    for rule in rules:
        text = rule.spark(text)
    return text


def in_batches(text: Column, rules: tuple[Rule, ...], blank: bool = True) -> Column:
    """apply() for long chains of rules: batches of texts go through all of them in one pass. Without blank, texts of white space alone stay as they are."""

    def step(texts: pa.Array) -> pa.Array:
        out = texts
        for rule in rules:
            out = rule.arrow(out)
        return out if blank else pc.if_else(pc.match_substring_regex(texts, f"[^{STRIP}]"), out, texts)

    return over_texts(text, step)


def apply_duck(text: str, rules: tuple[Rule, ...]) -> str:
    for rule in rules:
        text = rule.duck(text)
    return text
