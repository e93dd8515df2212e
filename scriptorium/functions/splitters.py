"""Recursive splitting of texts: separators from coarse to fine, chunks that overlap."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..plans.session import reachable

# Separators in order, the size of a chunk and of the overlap.
SEPARATORS = ("\n\n\n", "\n\n", "\n", ". ", " ", "")
SIZE, OVERLAP = 4000, 200


def _cut(text: str, separator: str, size: int) -> list[str]:
    """The text's parts, each but the first with the separator in front; without a separator, parts of one character."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in (first, *(separator + r for r in rest)) if p]


def _packed(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    """Parts put together up to size; a chunk begins with the last parts of the one before, up to overlap."""
    held: list[str] = []
    total = 0
    for part in parts:
        if held and total + len(part) > size:
            yield "".join(held)
            while held and (total > overlap or total + len(part) > size):
                total -= len(held.pop(0))
        held.append(part)
        total += len(part)
    if held:
        yield "".join(held)


def split(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most `size` characters without outer white space, blank ones left out.

    The coarsest separator that occurs cuts the text; parts that fit are packed, one that doesn't is cut by the finer ones.
    """
    at = next((k for k, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    out: list[str] = []
    small: list[str] = []
    for part in _cut(text, separators[at], size):
        if len(part) <= size:
            small.append(part)
            continue
        out += _packed(small, size, overlap)
        small = []
        out += split(part, size, overlap, separators[at + 1 :]) if at + 1 < len(separators) else [part[k : k + size] for k in range(0, len(part), size)]
    out += _packed(small, size, overlap)
    return [c for c in (c.strip() for c in out) if c]


def recursive_chunks(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """split() as a column; null texts have no chunks."""
    if session := SparkSession.getActiveSession():
        reachable(session)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split(t or "", size, overlap))

    return run(text)
