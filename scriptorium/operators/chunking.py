"""Size-bounded chunks of sentences: sequential folds as higher-order functions, without shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import rules as R
from .text import strip

_STATE = "struct<cur: string, out: array<string>>"


def _state(cur: Column, out: Column) -> Column:
    return F.struct(cur.alias("cur"), out.alias("out"))


def _empty() -> Column:
    return _state(F.lit(""), F.array().cast("array<string>"))


def _joined(cur: Column, more: Column) -> Column:
    return F.when(cur == "", more).otherwise(F.concat(cur, F.lit(" "), more))


def _words(sentence: Column, limit: int, strict: bool) -> Column:
    """Packs one over-long sentence by words; strict cuts the tail off a first word that is longer than the limit."""
    words = F.regexp_extract_all(sentence, F.lit(f"[^{R.JAVA_STRIP}]+"), F.lit(0))

    def step(acc, w):
        over = F.length(acc["cur"]) + F.length(w) + 1 > limit
        cut = F.array(F.substring(w, 1, limit)) if strict else F.transform(F.sequence(F.lit(0), ((F.length(w) - 1) / limit).cast("int")), lambda i: F.substr(w, i * limit + 1, F.lit(limit)))
        return F.when(over & (acc["cur"] != ""), _state(w, F.concat(acc["out"], F.array(acc["cur"])))).when(over, _state(acc["cur"], F.concat(acc["out"], cut))).otherwise(_state(_joined(acc["cur"], w), acc["out"]))

    return F.aggregate(words, _empty(), step)


def sentence_chunks(text: Column, limit: int, strict: bool = True) -> Column:
    """Chunks of whole sentences up to `limit` characters. strict follows the reference where it lets later over-long sentences through."""
    sentences = F.split(text, rf"(?<=[.!?])[{R.JAVA_STRIP}]+", -1)

    def step(acc, s):
        over = F.length(acc["cur"]) + F.length(s) + 1 > limit
        by_words = _words(s, limit, strict)
        spread = _state(F.when(by_words["cur"] != "", by_words["cur"]).otherwise(acc["cur"]), F.concat(acc["out"], by_words["out"]))
        flushed = _state(s, F.concat(acc["out"], F.array(strip(acc["cur"]))))
        if not strict:
            held = F.concat(acc["out"], F.when(acc["cur"] != "", F.array(strip(acc["cur"]))).otherwise(F.array().cast("array<string>")))
            spread = _state(by_words["cur"], F.concat(held, by_words["out"]))
            return F.when(over & (F.length(s) + 1 > limit), spread).when(over, flushed).otherwise(_state(_joined(acc["cur"], s), acc["out"]))
        return F.when(over & (acc["cur"] != ""), flushed).when(over, spread).otherwise(_state(_joined(acc["cur"], s), acc["out"]))

    done = F.aggregate(sentences, _empty(), step, lambda a: F.when(a["cur"] != "", F.concat(a["out"], F.array(strip(a["cur"])))).otherwise(a["out"]))
    return F.filter(done, lambda c: strip(c) != "")


def simple_chunks(text: Column, limit: int = 4000) -> Column:
    """Chunks of pieces between `. `; a chunk that starts after an overflow doesn't get its `. ` back."""

    def step(acc, s):
        over = F.length(acc["cur"]) + F.length(s) > limit
        held = F.when(acc["cur"] != "", F.concat(acc["out"], F.array(strip(acc["cur"])))).otherwise(acc["out"])
        return F.when(over, _state(s, held)).otherwise(_state(F.concat(acc["cur"], s, F.lit(". ")), acc["out"]))

    return F.aggregate(F.split(text, r"\. ", -1), _empty(), step, lambda a: F.when(strip(a["cur"]) != "", F.concat(a["out"], F.array(strip(a["cur"])))).otherwise(a["out"]))
