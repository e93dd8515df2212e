"""Encoding repair: the documented subset of what the reference leaves to a library.

UTF-8 that was read as Windows-1252 or Latin-1 is put right for the letters U+00C0 to U+00FF and common punctuation, control
characters go, line ends become newlines, ligatures letters and curly quotes straight ones. Clean text stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.rules import Rule, apply, apply_duck

#: Letters and punctuation whose two or three bytes are seen as characters of their own.
REPAIRED = [*map(chr, range(0xA1, 0x100)), *"‘’‚“”„†‡•…‰‹›€™–—"]
SIGNS = "[ÂÃâ]"


def _misread(char: str) -> set[str]:
    """A character's bytes, read as Latin-1 and as Windows-1252; bytes that the latter doesn't have stay control characters."""
    latin = char.encode().decode("latin-1")
    return {latin, "".join(c if ord(c) in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([ord(c)]).decode("cp1252") for c in latin)}


#: Longer ones first, as a shorter one can be part of them.
MOJIBAKE = tuple(Rule(bad, char, literal=True) for bad, char in sorted({(bad, c) for c in REPAIRED for bad in _misread(c)}, key=lambda p: (-len(p[0]), p)))
CONTROL = (
    Rule("\r\n", "\n", literal=True), Rule("\r", "\n", literal=True), Rule(r"[\x00-\x08\x0b\x0e-\x1f\x7f]"),
    Rule("ﬀ", "ff", literal=True), Rule("ﬁ", "fi", literal=True), Rule("ﬂ", "fl", literal=True), Rule("ﬃ", "ffi", literal=True), Rule("ﬄ", "ffl", literal=True),
    Rule("[‘’‛]", "'"), Rule("[“”]", '"'),
)


def repair(text: Column) -> Column:
    """The repaired text; only texts with a sign of misread bytes go through the table of these."""
    return apply(F.when(text.rlike(SIGNS), apply(text, MOJIBAKE)).otherwise(text), CONTROL)


def repair_duck(text: str) -> str:
    return apply_duck(f"(CASE WHEN regexp_matches({text}, '{SIGNS}') THEN {apply_duck(text, MOJIBAKE)} ELSE {text} END)", CONTROL)
