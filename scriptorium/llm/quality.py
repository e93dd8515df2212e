"""Quality rules as a short-circuit cascade.

Each rule reads lazily computed figures of a text. On a hash sample over all rows the cascade measures, where the rows
are, which texts a rule rejects and what the figures cost that it reads. It then orders the rules one by one: next
comes the rule that rejects most of the texts still there for each second that its figures cost beyond those
already computed. A text meets the rules in that order and leaves at the first that rejects it. The verdict is a
conjunction, so the order changes the work and never the result.
"""

from __future__ import annotations

import json
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, map_batches

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
#: Texts that costs and rejections are measured on: as many are expected, drawn by hash from all rows of any length.
#: No more than SAMPLE_LIMIT are used, which matters only where equal rows repeat without end.
SAMPLE_ROWS, SAMPLE_LIMIT = 400, 2000


def repeated_words(words: list, n: int = 5) -> int:
    """Words that lie in n-word windows found twice or more in the list, the first included."""
    windows = list(zip(*(words[k:] for k in range(n))))
    if len(set(windows)) == len(windows):
        return 0
    found, total, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if found[w] > 1:
            total += i + n - max(i, end)
            end = i + n
    return total


class figure:
    """A figure of a text, computed when first asked for; a text with a clock notes the seconds that each took by itself."""

    def __init__(self, compute: Callable):
        self.compute, self.name = compute, compute.__name__

    def __get__(self, text, owner=None):
        if text.clock is None:
            value = text.__dict__[self.name] = self.compute(text)
            return value
        text.clock.append(0.0)
        began = time.perf_counter()
        value = text.__dict__[self.name] = self.compute(text)
        spent = time.perf_counter() - began
        text.seconds[self.name] = spent - text.clock.pop()
        if text.clock:
            text.clock[-1] += spent
        return value


class Figures:
    """What rules ask of one text."""

    def __init__(self, text: str | None, timed: bool = False):
        self.text = text or ""
        self.clock: list[float] | None = [] if timed else None
        self.seconds: dict[str, float] = {}

    @figure
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    def _count(self, chars: bytes) -> int:
        return len(self.raw) - len(self.raw.translate(None, chars))

    @figure
    def words(self) -> list[bytes]:
        return self.raw.split()

    @figure
    def n_words(self) -> int:
        return len(self.words)

    @figure
    def word_chars(self) -> int:
        return len(self.text) - self._count(SPACES)

    @figure
    def n_symbols(self) -> int:
        return self._count(SYMBOLS)

    @figure
    def n_upper(self) -> int:
        return self._count(UPPER)

    @figure
    def n_lower(self) -> int:
        return self._count(LOWER)

    @figure
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip(SPACES)]

    @figure
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @figure
    def line_bytes(self) -> int:
        return sum(len(x.strip(SPACES)) for x in self.lines)

    @figure
    def dup_line_bytes(self) -> int:
        """Bytes of lines that stood before in the text."""
        return self.line_bytes - sum(len(x.strip(SPACES)) for x in set(self.lines))

    @figure
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)


@dataclass(frozen=True)
class Rule:
    """rejects(figures) is true for a text that must go."""

    name: str
    rejects: Callable[[Figures], bool]


#: Thresholds as published for web text: symbol-to-word ratio, mean word length, share of repeated lines.
RULES = (
    Rule("too_few_words", lambda f: f.n_words < 10),
    Rule("repeated_windows", lambda f: 100 * f.n_repeat_words > 20 * f.n_words),
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("word_length", lambda f: not 2 * f.n_words <= f.word_chars <= 12 * f.n_words),
    Rule("repeated_lines", lambda f: 10 * f.n_dup_lines > 3 * len(f.lines)),
    Rule("shouting", lambda f: f.n_upper > f.n_lower),
)
#: For a corpus: repeated lines must also be over 30 % of the text in lines, so a short line twice costs no long text.
#: RULES count lines alone, as the SQL of op3_quality does.
CORPUS_RULES = tuple(Rule(r.name, lambda f: 10 * f.n_dup_lines > 3 * len(f.lines) and 10 * f.dup_line_bytes > 3 * f.line_bytes) if r.name == "repeated_lines" else r for r in RULES)
BASE = ("too_few_words", "repeated_windows")


#: Of one text: whether each rule rejects it, the figures that each rule reads, and the seconds of each figure by itself.
Measured = tuple[list[bool], list[list[str]], dict[str, float]]
#: Seconds of a rule beyond its figures: a call.
CALL = 2e-7


def measure(text: str | None, rules: tuple[Rule, ...] = RULES) -> Measured:
    rejects, reads, seconds = [], [], {}
    for rule in rules:
        f = Figures(text, timed=True)
        rejects.append(bool(rule.rejects(f)))
        reads.append(sorted(f.seconds))
        for name, s in f.seconds.items():
            seconds[name] = min(s, seconds.get(name, s))
    return rejects, reads, seconds


def order(measured: list[Measured], rules: tuple[Rule, ...] = RULES) -> list[str]:
    """Names of the rules: next comes the one with most rejections, among texts that no rule before it rejects, for each second of figures that none before it read; ties by name."""
    texts, left, out = list(measured), list(range(len(rules))), []
    computed: list[set[str]] = [set() for _ in texts]
    while left:

        def worth(k: int) -> float:
            cost = sum(CALL + sum(m[2][name] for name in m[1][k] if name not in done) for m, done in zip(texts, computed))
            return sum(m[0][k] for m in texts) / max(cost, CALL)

        best = min(left, key=lambda k: (-worth(k), rules[k].name))
        left.remove(best)
        out.append(rules[best].name)
        kept = [(m, done | set(m[1][best])) for m, done in zip(texts, computed) if not m[0][best]]
        texts, computed = [m for m, _ in kept], [done for _, done in kept]
    return out


def sampled(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> list[Measured]:
    """What the rules do on a hash sample of all rows, measured where the texts are; only verdicts and seconds come to the driver."""
    n = docs.count()
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < int(min(1.0, SAMPLE_ROWS / max(1, n)) * (1 << 40))
    some = docs.select("doc_id", "text").filter(drawn).select("text")
    found = map_batches(some, lambda: lambda batch: [[json.dumps(measure(t.as_py(), rules)) for t in batch.column(0)]], "measured string")
    return [tuple(json.loads(r.measured)) for r in found.limit(SAMPLE_LIMIT).collect()]


def planned(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """The rules in the order that the sample suggests."""
    by_name = {r.name: r for r in rules}
    return tuple(by_name[name] for name in order(sampled(docs, rules), rules))


def first_rejection(figures: Figures, rules: tuple[Rule, ...]) -> str | None:
    return next((r.name for r in rules if r.rejects(figures)), None)


def verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by.

    Null and empty texts have no words and are rejected. rejected_by is the first rule in the cascade's
    order and so may differ between runs for a text that fails several. One row for each row, repeated ones too;
    extra columns are ignored; no rows, none. The base figures are asked of every text and so computed for each;
    what only the other rules read is computed as far as the cascade goes. keep_good computes nothing else.
    """
    cascade = planned(docs, rules)
    base = tuple(r for r in RULES if r.name in BASE)

    def make():
        def step(batch: pa.RecordBatch):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                f = Figures(text.as_py())
                by = first_rejection(f, cascade)
                failed = any(r.rejects(f) for r in base)
                rows.append((doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, failed, not failed and by is None, by))
            return list(zip(*rows))

        return step

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
    return map_batches(docs.select("doc_id", "text"), make, schema)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that no rule rejects, with all their columns; each text is read until a rule rejects it.

    Null and empty texts go where a rule asks for words. Repeated rows have one verdict; no rows, none.
    """
    cascade = planned(docs, rules)
    at = docs.columns.index("text")

    def make():
        def step(batch: pa.RecordBatch):
            good = [first_rejection(Figures(t.as_py()), cascade) is None for t in batch.column(at)]
            return batch.filter(pa.array(good)) if any(good) else None

        return step

    return map_batches(docs, make, docs.schema)
