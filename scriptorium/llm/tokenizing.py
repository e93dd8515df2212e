"""Token ids of whole texts, word by word.

The vocabulary's pre-tokenizer drops white space and never joins what stands on both sides of it,
so a text's ids are the ids of its words in order. A batch of texts is split into words by Arrow and
dictionary-encoded; only its different words are looked up, in what the worker remembers (a bounded
number), and one `take` puts their ids in the order of the texts. New words are encoded many at a
time and cut apart again at the ids that end a word.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import CACHES

#: Words that a worker remembers, in each of two generations; when the newer is full it becomes the older.
REMEMBERED = 250_000
#: Bytes of texts whose words are looked up together, for memory; a longer text is cut at white space.
AT_ONCE = 6 << 20
DEFAULT_VOCABULARY = "word_bpe_49k.json"
_PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII, without the apostrophe, which can start a contraction
#: The pre-tokenizer that the word-by-word way holds for; texts of other vocabularies are encoded whole.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")  # letters up to U+00FF
_MARKS = r"[\x{300}-\x{37F}]"
_AFTER_OTHERS = r"(?:\A|[^a-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])[,.][ \n]"
_GAP = re.compile(r"[ \t\n\x0b\x0c\r]")


def vocabulary(path: str | None = None) -> str:
    """The file of the vocabulary: a path, or by default the public word BPE, looked up on this machine."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_VOCABULARY)


def parts_of(text: str, most: int = AT_ONCE) -> list[str]:
    """A text in parts of about `most` characters, cut at white space only."""
    out, at = [], 0
    while len(text) - at > most and (gap := _GAP.search(text, at + most)):
        out.append(text[at : gap.start()])
        at = gap.start()
    return [*out, text[at:]]


class WordTokenizer:
    """Little-endian unsigned 32-bit ids of whole texts, as bytes.

    With plain, a control token's string in a text is ordinary text and never becomes that token.
    """

    def __init__(self, path: str | None = None, remembered: int = REMEMBERED, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary(path))
        self.tokenizer.encode_special_tokens = plain
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.remembered = remembered
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        words = self.tokenizer.get_vocab()
        self.size = max(words.values(), default=0) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[k for w, k in words.items() if w.endswith("</w>")]] = True
        made = json.loads(self.tokenizer.to_str())
        steps = ((made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_words = made["model"].get("end_of_word_suffix") == "</w>" and (steps.get("pattern") or {}).get("Regex") == SPLIT and made.get("post_processor") is None

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that are letters only, each of which ends with the one id that ends a word."""
        out: list[bytes] = []
        for k in range(0, len(words), 500):
            some = words[k : k + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some) and stops[-1] == len(ids):
                raw, at = ids.tobytes(), [0, *(4 * stops).tolist()]
                out += [raw[a:b] for a, b in zip(at, at[1:])]
            else:
                out += self.encode([w.decode() for w in some])
        return out

    def _learn(self, new: list[bytes]) -> None:
        known, whole = self.known, _LETTERS.fullmatch
        if self.older:
            known.update((w, ids) for w, ids in zip(new, map(self.older.get, new)) if ids is not None)
            new = [w for w in new if w not in known]
        letters, rest = [], []
        for w in new:
            (letters if w.isalpha() or whole(w) else rest).append(w)
        known.update(zip(letters, self._letters(letters)))
        ended, others = [], []
        for w in rest:
            stem = w.rstrip(_PUNCTUATION)
            if stem and (stem.isalpha() or whole(stem)):  # letters, then one run of punctuation: two pre-tokens
                ended.append((w, stem, w[len(stem) :]))
            else:
                others.append(w)
        if stems := [s for s in {stem for _, stem, _ in ended} if s not in known]:
            known.update(zip(stems, self._letters(stems)))
        if tails := [t for t in {tail for *_, tail in ended} if t not in known]:
            known.update(zip(tails, self.encode([t.decode() for t in tails])))
        known.update((w, known[stem] + known[tail]) for w, stem, tail in ended)
        if others:
            known.update(zip(others, self.encode([w.decode() for w in others])))

    def _ids_of(self, words: pa.Array) -> pa.Array:
        """The ids of different words, as binary."""
        if len(self.known) > self.remembered:
            self.known, self.older = {}, self.known
        listed = words.cast(pa.binary()).to_pylist()
        found = list(map(self.known.get, listed))
        if new := [w for w, ids in zip(listed, found) if ids is None]:
            self._learn(new)
            found = list(map(self.known.__getitem__, listed))
        return pa.array(found, pa.binary())

    def _some(self, texts: pa.Array) -> list[bytes]:
        # ASCII capitals become small letters in any case; with combining marks (U+0300 on) order would matter
        low = pc.if_else(pc.match_substring_regex(texts, _MARKS), texts, pc.ascii_lower(texts))
        apart = low  # full stops and commas after letters are pre-tokens of their own: fewer different words
        for a, b in ((". ", " . "), (", ", " , "), (".\n", " .\n")):
            apart = pc.replace_substring(apart, a, b)
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(low, _AFTER_OTHERS), low, apart))
        words = split.values.dictionary_encode()
        ids = self._ids_of(words.dictionary).take(words.indices)
        raw, at = ids.buffers()[2] or pa.py_buffer(b""), np.frombuffer(ids.buffers()[1], "<i4")[: len(ids) + 1]
        ends = at[np.frombuffer(split.buffers()[1], "<i4")[: len(split) + 1]].tolist()
        return [raw[a:b].to_pybytes() if b > a else b"" for a, b in zip(ends, ends[1:])]

    def ids(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Null texts have no ids. Texts that hold a control token's string are read whole by the library."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        out: list[bytes] = [b""] * len(texts)
        sizes = pc.fill_null(pc.binary_length(texts), 0)
        alone = pa.array(np.zeros(len(texts), bool)) if self.by_words else pc.greater(sizes, 0)
        for s in self.special:
            alone = pc.or_(alone, pc.fill_null(pc.match_substring(texts, s), False))
        for k in np.flatnonzero(alone).tolist():
            out[k] = self.encode([texts[k].as_py()])[0]
        some, size, sizes = [], 0, sizes.to_pylist()
        for k in np.flatnonzero(pc.and_(pc.invert(alone), pc.greater(pa.array(sizes), 0))).tolist():
            if sizes[k] > AT_ONCE:
                out[k] = b"".join(self._some(pa.array([part]))[0] for part in parts_of(texts[k].as_py()))
                continue
            some.append(k)
            size += sizes[k]
            if size > AT_ONCE:
                for j, ids in zip(some, self._some(texts.take(pa.array(some)))):
                    out[j] = ids
                some, size = [], 0
        if some:
            for j, ids in zip(some, self._some(texts.take(pa.array(some)))):
                out[j] = ids
        return out


@lru_cache(1)
def worker_tokenizer(path: str | None = None, plain: bool = False) -> WordTokenizer:
    """One for each Python worker, so that words stay known from task to task."""
    return WordTokenizer(path, plain=plain)


CACHES.append(worker_tokenizer.cache_clear)
