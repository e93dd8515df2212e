"""Operators against brute-force versions, on the small tables and on a fixture of awkward rows."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from scriptorium.llm import chat, fingerprints, htmltext, langid, mixing, packing, pii, quality, queries, simhash, tokenfiles
from scriptorium.llm.tokenizing import WordTokenizer, vocabulary

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, length long, range int, fp long"
ODD = [
    (5, None, None, None), (1, "", "en", "a"), (2, " \t\n", None, "a"), (3, "one two three four five six seven eight nine ten eleven", "en", "b"),
    (4, "one two three four five six seven eight nine ten eleven", "en", None), (4, "one two three four five six seven eight nine ten eleven", "en", None),
    (None, "a row without an id but with some words of its own here", "en", "b"), (7, "x " * 6000, "de", "a"), (9, "été À ü <|endoftext|> ok don't 12.5", "fr", "c"),
    (10, "mail a.b@c.de or +49 170 1234567 or 10.0.0.1", "de", "c"), (12, "!!! ???", None, "c"), (13, "一二三 四五", None, "é"),
]
W = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, lang, s, None if t is None else len(t), 1, 2, 3) for i, t, lang, s in ODD]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def both(odd, small):
    return [odd.select("doc_id", "text", "lang", "source").collect(), small.select("doc_id", "text", "lang", "source").collect()]


def brute_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [(r, k) for k, r in enumerate(rooms) if r >= n]
        if fit:
            r, k = min(fit)
            rooms[k] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_room_tree_and_plan():
    for lengths in ([], [5], [3, 3, 3], [10, 9, 8, 2, 2, 1, 1, 1, 7, 7], list(range(1, 11)) * 3, [4] * 11 + [3] * 5 + [1] * 9):
        runs = packing.plan(Counter(lengths), 10)
        bins = defaultdict(list)
        for length, n in Counter(lengths).items():
            for rank in range(n):
                _, first_rank, first_bin, per_bin, offset = max(r for r in runs if r[0] == length and r[1] <= rank)
                k, j = divmod(rank - first_rank, per_bin)
                bins[first_bin + k].append((offset + j * length, length))
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= 10
        assert sorted(10 - sum(n for _, n in b) for b in bins.values()) == brute_best_fit(lengths, 10)
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def test_packing(odd, small):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    for df, rows in zip((odd, small), both(odd, small)):
        want = []
        for doc_id, text, *_ in rows:
            ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
            for k in range(0, len(ids), 2048):
                piece = ids[k : k + 2048]
                want.append((doc_id, k // 2048, k, len(piece), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in piece))))
        got = packing.pack(df).collect()
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(want)
        bins = defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        assert all(a + n == b for x in bins.values() for (a, n), (b, _) in itertools.pairwise(sorted(x))) and all(min(x)[0] == 0 for x in bins.values())
        assert sorted(2048 - sum(n for _, n in x) for x in bins.values()) == brute_best_fit([w[3] for w in want], 2048)
    assert packing.pack(odd.limit(0)).count() == 0


def test_tokenizer_is_exact():
    tok = WordTokenizer(remembered=10)
    texts = ["It's DON'T \"x.'s\" »abc«. J̌ H̱ İ ΣΑΣ.", "a<|endoftext|> b", "x...y''re 'RE \x1c É", "日本語 !!ñandú... ß ① ²", "", None, "n.b. 1,5% (ok) 'll"]
    for _ in range(3):
        assert tok.ids(texts) == [tok.encode([t])[0] if t else b"" for t in texts]


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        if not free:
            break
        level = (total - 3 * sum(sizes[s] for s in full)) / sum(w[s] for s in free)
        more = {s for s in free if w[s] * level >= 3 * sizes[s]}
        if not more:
            break
        full |= more
    return {s: 3.0 * sizes[s] if s in full else w[s] * level for s in names}


def test_mixing(odd, small):
    for df, rows in zip((odd, small), both(odd, small)):
        sizes = Counter()
        for _, text, _, source in rows:
            sizes[source] += len(W.findall(text or ""))
        want = brute_targets(sizes)
        got = mixing.mix_report(df).collect()
        assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len(W.findall(t or ""))) for d, t, *_ in rows)
        for r in got:  # the draw at the fraction, from the hash of the id, and a correction of one copy at most
            rate = r.target / r.source_size if r.source_size else 0
            u = int(hashlib.md5(f"mix-1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:15], 16) / 2**60
            assert r.drawn == int(rate) + (u < rate - int(rate)) and r.taken == r.size * (r.drawn + r.corrected) and abs(r.corrected) <= 1
        by_size = {v: k for k, v in sizes.items()}
        taken, goal = Counter(), {}
        for r in got:
            assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
            taken[by_size[r.source_size]] += r.taken
            goal[by_size[r.source_size]] = r.target
        for s, t in goal.items():
            assert t == pytest.approx(want[s])
            assert abs(taken[s] - t) <= max([r.size for r in got if r.source_size == sizes[s]]) * 2
        assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix_report(df.repartition(2)).collect()))
        copies = Counter((r.doc_id, r.text) for r in mixing.mix(df).collect())
        words = Counter()
        for (_, text), n in copies.items():
            words[text] += n * len(W.findall(text or ""))
        assert sum(words.values()) == sum(r.taken for r in got)
        assert mixing.mix(df).columns == df.columns
    assert mixing.mix_report(odd.limit(0)).count() == 0 and mixing.mix(odd.limit(0)).count() == 0


def brute_repeat(words, n=5):
    wins = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    seen = Counter(wins)
    return len({k for i, w in enumerate(wins) if seen[w] > 1 for k in range(i, i + n)})


def test_quality(odd, small):
    for df, rows in zip((odd, small), both(odd, small)):
        want = Counter()
        for doc_id, text, *_ in rows:
            text = text or ""
            words = W.findall(text)
            lines = [x for x in text.split("\n") if W.search(x)]
            rep = brute_repeat(words)
            failed = len(words) < 10 or 100 * rep > 20 * len(words)
            symbols = len(re.findall(r"[#*$%&|<>]", text))
            dup = sum(x in lines[:k] for k, x in enumerate(lines))
            chars = sum(map(len, words))
            kept = not failed and 10 * symbols <= len(words) and 2 * len(words) <= chars <= 12 * len(words) and 10 * dup <= 3 * len(lines)
            kept = kept and len(re.findall("[A-Z]", text)) <= len(re.findall("[a-z]", text))
            want[doc_id, len(words), chars, symbols, dup, rep, failed, kept] += 1
        got = quality.verdicts(df).drop("rejected_by").collect()
        assert Counter(map(tuple, got)) == want
        kept = quality.keep_good(df)
        assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert quality.verdicts(odd.limit(0)).count() == 0
    assert quality.keep_good(odd.limit(0)).count() == 0


def test_quality_order():
    """Conditional worth: what a rule rejects beyond the rules before it, for what its figures cost beyond theirs."""
    rules = tuple(quality.Rule(n, None) for n in "abc")
    # a and b reject the same texts, c another one; a is dear, and c reads what a reads
    figures, seconds = [["big"], ["small"], ["big"]], {"big": 1.0, "small": 0.01}
    sample = [([True, True, False], figures, seconds)] * 3 + [([False, False, True], figures, seconds)] + [([False, False, False], figures, seconds)]
    assert quality.order(sample, rules) == ["b", "c", "a"]
    assert quality.order([], rules) == ["a", "b", "c"]
    rejects, reads, seconds = quality.measure("word " * 50)
    assert rejects[1] and not rejects[0] and "words" in reads[1] and set(reads[1]) <= set(seconds)


def test_quality_samples_all_rows(spark, small):
    """The sample comes from the whole table, long texts included, and is the same in any order of rows."""
    n = small.count()
    found = quality.sampled(small)
    assert n <= 400 and len(found) == n
    wide = small.union(small.withColumn("doc_id", queries.F.col("doc_id") + 1_000_000)).union(small.withColumn("doc_id", queries.F.col("doc_id") + 2_000_000))
    few = [len(quality.sampled(df)) for df in (wide, wide.repartition(3))]
    assert few[0] == few[1] and 300 <= few[0] <= 500


def test_fingerprints(odd, small, monkeypatch):
    for size in (4000, 7):
        monkeypatch.setattr(fingerprints, "RANGE_ROWS", size)
        for df, rows in zip((odd, small), both(odd, small)):
            rows = sorted(((r.doc_id is not None, r.doc_id, r.text or "") for r in rows), key=lambda r: (r[0], r[1] or 0, r[2]))
            want = Counter()
            for k, (_, doc_id, text) in enumerate(rows):
                follow = rows[(k + 1) % len(rows)][2]
                q = len(text) // 4
                edit = text[: len(text) - q] + follow[:q]
                a, b, c = (fingerprints.signatures(x) for x in (text, edit, follow))
                want[doc_id, len(text), hashlib.sha256(edit.encode()).hexdigest(), fingerprints.encode(a), fingerprints.encode(b), fingerprints.jaccard(a, b), fingerprints.jaccard(a, c)] += 1
            assert Counter(map(tuple, fingerprints.fingerprints(df).collect())) == want
    assert fingerprints.fingerprints(odd.limit(0)).count() == 0
    assert fingerprints.decode(fingerprints.encode(frozenset([1, 2**32 - 1]))) == {1, 2**32 - 1}


def brute_signatures(text, chain=3):
    """Anchor by anchor: its chain of the next content words; hashes of all."""
    words = re.findall(r"\w+", text.lower())
    found = set()
    for k, w in enumerate(words):
        if w in fingerprints.ANCHORS:
            after = [x for x in words[k + 1 :] if x not in fingerprints.ANCHORS][:chain]
            if len(after) == chain:
                found.add(" ".join([w, *after]))
    if not found:
        found = {" ".join(words[k : k + chain]) for k in range(len(words)) if k + chain <= len(words)} or ({" ".join(words)} if words else set())
    return frozenset(xxhash.xxh32_intdigest(x) for x in found)


def test_signatures(small):
    texts = [r.text for r in small.filter("length(text) < 3000").limit(80).collect()]
    for text in [*texts, "", "the", "the of and", "one two", "one two three four", "the cat sat on the mat today", "!!", "The The A b c d", "été de la Nuit une fois ici"]:
        assert fingerprints.signatures(text) == brute_signatures(text), text[:50]


def test_similar_pairs(spark, small):
    prints = fingerprints.fingerprints(small).select("fingerprint")
    got = {(r[0], r[1]) if r[0] < r[1] else (r[1], r[0]): r[2] for r in fingerprints.similar_pairs(prints, 0.5).collect()}
    texts = sorted({r[0] for r in prints.collect()} - {""})
    sets = [(t, fingerprints.decode(t)) for t in texts]
    want = {(a, b): x for (a, p), (b, q) in itertools.combinations(sets, 2) if (x := fingerprints.jaccard(p, q)) >= 0.5}
    assert got == want and want
    links = Counter(x for pair in want for x in pair)
    copies = Counter(r[0] for r in prints.collect())
    assert {r.fingerprint: (r.n_docs, r.n_links) for r in fingerprints.class_links(prints, 0.5).collect()} == {f: (n, links[f]) for f, n in copies.items()}
    assert fingerprints.similar_pairs(prints.limit(0)).count() == 0


def test_similar_classes(spark, small):
    """Components over all pairs, by brute force; a family of k variants costs about k edges."""
    prints = fingerprints.fingerprints(small).select("fingerprint").unionByName(spark.createDataFrame([("",), ("",), (None,)], "fingerprint string"))
    rng_sets = [frozenset(range(k, k + 60)) for k in range(0, 40)] + [frozenset(range(10_000, 10_050)) | {20_000 + k} for k in range(150)]
    prints = prints.unionByName(spark.createDataFrame([(fingerprints.encode(x),) for x in rng_sets], "fingerprint string"))
    for threshold in (0.8, 0.5):
        copies = Counter(r[0] for r in prints.collect() if r[0] is not None)
        sets = {f: fingerprints.decode(f) for f in copies}
        root = {f: f for f in sets}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in itertools.combinations(sets, 2):
            if a and b and fingerprints.jaccard(sets[a], sets[b]) >= threshold:
                x, y = sorted((find(a), find(b)))
                root[y] = x
        sizes = Counter(find(f) for f in sets)
        got = {r.fingerprint: (r.n_docs, r.class_fingerprint, r.class_size) for r in fingerprints.similar_classes(prints, threshold).collect()}
        assert got == {f: (n, find(f), sizes[find(f)]) for f, n in copies.items()}
    variants = spark.createDataFrame([(fingerprints.encode(x),) for x in rng_sets[40:]], "fingerprint string")
    at_least = fingerprints.Fraction("0.8")
    assert fingerprints._forest(fingerprints._indexed(variants, at_least), at_least).distinct().count() < 20 * 150 < fingerprints.similar_pairs(variants).count()
    assert fingerprints.similar_classes(prints.limit(0)).count() == 0


def test_similar_pairs_at_the_threshold(spark):
    """Sets that just reach a threshold which is no binary fraction."""
    for t, small_set, large_set in ((0.55, 55, 100), (0.8, 80, 100), (0.7, 7, 10), (0.29, 29, 100), (0.9, 9, 10)):
        sets = [frozenset(range(small_set)), frozenset(range(large_set)), frozenset(range(1, small_set))]
        df = spark.createDataFrame([(fingerprints.encode(x),) for x in sets] + [("",), (None,)], "fingerprint string")
        got = {frozenset(r[:2]) for r in fingerprints.similar_pairs(df, t).collect()}
        want = {frozenset((fingerprints.encode(a), fingerprints.encode(b))) for a, b in itertools.combinations(sets, 2) if len(a & b) * 100 >= round(t * 100) * len(a | b)}
        assert got == want and frozenset(map(fingerprints.encode, sets[:2])) in got


def test_chat(spark):
    rows = [(1, 0, "user", "hi\n"), (1, 1, "assistant", r"\### x: </turn> \b\l\h"), (1, 1, "assistant", r"\### x: </turn> \b\l\h"), (2, None, None, None), (2, 3, "a: b<#", "  "), (None, 1, "assistant", "q"), (3, 1, "user", "")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(chat.turn_rows(df))).collect()}
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1] or -1, r[2] or "", r[3] or "")):
        want[c].append((role or "", text or "", role == "assistant"))
    assert {c: [tuple(t) for t in r.turns] for c, r in got.items()} == dict(want)
    assert chat.formatted(chat.turn_rows(df.limit(0))).count() == 0


def test_chat_layouts(spark):
    def turns(df):
        return [(r.nth, r.role, r.text) for r in chat.turn_rows(df, "id").orderBy("id", "nth").collect()]

    one = [(0, "user", "q"), (1, "assistant", "a")]
    assert turns(spark.createDataFrame([(1, "q", "a", 5)], "id int, prompt string, response string, other int")) == one
    assert turns(spark.createDataFrame([(1, "q", "", "a")], "id int, instruction string, input string, output string")) == one
    assert turns(spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")]), (2, None)], "id int, messages array<struct<role: string, content: string>>")) == one
    with pytest.raises(ValueError):
        chat.turn_rows(spark.createDataFrame([(1, "q")], "id int, question string"), "id")
    js = ['{"prompt":"q","completion":"a"}', '{"conversations":[{"from":"user","value":"q"},{"from":"assistant","value":"a"}]}', '{"x":1}', None, "{", '{"instruction":"q","output":"a"}']
    df = spark.createDataFrame(list(enumerate(js)), "id int, j string")
    got = chat.mixed_json_turns(df, "j", "id").orderBy("id", "nth").collect()
    assert [tuple(r) for r in got] == [(k, *t) for k in (0, 1, 5) for t in one]


def test_chat_fingerprints_select(spark):
    """Tables and records of one layout have one hash, by which alone the mapping is found; several layouts at once are none."""
    by_turn = spark.createDataFrame([(1, 2, "user", "b", "x"), (1, 1, "user", "a", "x")], "conv_id int, turn int, role string, text string, other string")
    assert chat.MAPPINGS[chat.fingerprint(["turn", "role", "text"])] is None
    assert [r.text for r in chat.turn_rows(by_turn).orderBy("nth").collect()] == ["a", "b"]
    both = spark.createDataFrame([(1, "q", "a", "b")], "id int, prompt string, response string, completion string")
    with pytest.raises(ValueError):
        chat.turn_rows(both, "id")
    assert len(chat.turn_rows(both.drop("completion"), "id").collect()) == 2
    js = ['{"prompt":"q","response":null,"id":3}', '{"messages":[{"role":"user","content":"q","name":"n"}],"prompt":"p"}', '{"messages":[{"role":"user","content":"q"}]}', '{"messages":[]}', '{"x":1}', "[1]", None, ""]
    df = spark.createDataFrame(list(enumerate(js)), "id int, j string")
    got = [tuple(r) for r in chat.mixed_json_turns(df, "j", "id").orderBy("id", "nth").collect()]
    assert got == [(0, 0, "user", "q"), (0, 1, "assistant", ""), (2, 0, "user", "q")]
    counts = {tuple(r.paths) if r.layout else None: (r.known, r.n) for r in chat.layout_counts(df, "j").collect()}
    messages = ("messages[].content", "messages[].role")
    assert counts == {("prompt", "response"): (True, 1), (*messages, "prompt"): (False, 1), messages: (True, 2), (): (False, 1), None: (False, 3)}
    for paths, _ in chat.LAYOUTS[1:]:
        record = "{" + ",".join(f'"{p}":"v"' if "[" not in p else f'"{p.split("[")[0]}":[{{' + ",".join(f'"{q.split(".")[1]}":"v"' for q in paths) + "}]" for p in ({p.split("[")[0]: p for p in paths}.values())) + "}"
        assert spark.createDataFrame([(record,)], "j string").select(chat.record_fingerprint(queries.F.col("j"))).first()[0] == chat.fingerprint(list(paths))


def test_chat_query_has_the_probe(spark):
    rows = {r.conv_id: r for r in queries.op5_chat(spark, SF).collect()}
    want = f"user\n{queries.PROBE}\nassistant\n{queries.PROBE}\n"
    assert rows[-7].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert rows[-7].loss_sha256 == hashlib.sha256(queries.PROBE.encode()).hexdigest() and rows[-7].loss_chars == len(queries.PROBE)
    table = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        table[r.conv_id].append((r.role, r.text))
    for c, turns in table.items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        assert rows[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (rows[c].n_turns, rows[c].loss_chars, rows[c].loss_sha256) == (len(turns), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in queries.op6_language(spark, "/root/testdata/sf0.01").collect()}
    held = [r for r in docs.collect() if got[r.doc_id].held_out]
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == r.held_out for i, r in got.items())
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    model = langid.train(odd.filter("lang is not null"))
    out = langid.identify(odd, model).collect()
    assert len(out) == len(ODD) and {r.lang_pred for r in out if r.doc_id in (1, 2, 5, 12)} == {"und"} and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in langid.identify(odd, langid.train(odd.limit(0))).collect()} == {"und"}


def brute_language(train_rows, texts):
    """Naive Bayes over hashed n-grams, letter by letter; (language, score) of each text."""
    import math

    m = 0xFFFFFFFF

    def buckets(text):
        low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
        low = " " + re.sub(" +", " ", low).strip(" ") + " " if low.strip(" ") else " "
        for at in range(len(low)):
            h = 0
            for n in (1, 2, 3):
                if at + n > len(low):
                    break
                h = (h * 0x01000193 & m) ^ (ord(low[at + n - 1]) * 0x9E3779B1 & m) ^ n
                yield ((h ^ h >> 15) * 0x85EBCA6B & m) >> 7 & 32767

    counts = defaultdict(Counter)
    for text, lang in train_rows:
        counts[lang].update(buckets(text or ""))
    out = []
    for text in texts:
        if not any(map(str.isalpha, text or "")):
            out.append(("und", 0.0))
            continue
        score = {lang: sum(math.log((c[b] + 0.5) / (sum(c.values()) + 0.5 * 32768)) for b in buckets(text)) for lang, c in counts.items()}
        best = max(sorted(score), key=score.get)
        out.append((best, 1 / sum(math.exp(x - score[best]) for x in score.values())))
    return out


def test_language_against_brute_force(spark, odd, small):
    docs = small.filter("length(text) < 1500").select("doc_id", "text", "lang").limit(40).unionByName(odd.select("doc_id", "text", "lang"))
    rows = docs.collect()
    learned = [(r.text, r.lang) for r in rows if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    model = langid.train(spark.createDataFrame([(k, *x) for k, x in enumerate(learned)], "doc_id long, text string, lang string"))
    want = Counter((r.doc_id, lang, round(x, 3)) for r, (lang, x) in zip(rows, brute_language(learned, [r.text for r in rows])))
    got = langid.identify(spark.createDataFrame(rows, docs.schema), model).collect()
    assert Counter((r.doc_id, r.lang_pred, round(r.score, 3)) for r in got) == want


def test_language_blocks(monkeypatch):
    text = "Ärger über the words " * 50
    whole = Counter(langid.grams(langid.letters(text)).tolist())
    monkeypatch.setattr(langid, "BLOCK", 37)
    assert Counter(x for g in langid.blocks(text) for x in g.tolist()) == whole


def test_token_files(spark, odd, small, tmp_path):
    tok = WordTokenizer(plain=True)
    for df, rows in zip((odd, small), both(odd, small)):
        got = Counter((r.doc_id, r.n_tokens) for r in tokenfiles.document_counts(df).collect())
        assert got == Counter((d, len(i) // 4) for (d, *_), i in zip(rows, tok.ids([r.text for r in rows])))
    assert tokenfiles.document_counts(odd.limit(0)).count() == 0
    import numpy as np

    ids = [1, 2, 9, 9, 3, 3, 3, 9, 4]
    (tmp_path / "a.bin").write_bytes(np.array(ids, "<u2").tobytes())
    (tmp_path / "b.bin").write_bytes(np.array([9], "<u2").tobytes())
    (tmp_path / "c.bin").write_bytes(b"")
    for size in (1, 2, 3, 100):
        got = tokenfiles.token_counts(tokenfiles.read_blocks(spark, f"file://{tmp_path}/*.bin", size), 9).collect()
        assert sorted((r.file[-5:], r.nth, r.start, r.n_tokens) for r in got) == [("a.bin", 0, 0, 2), ("a.bin", 1, 3, 0), ("a.bin", 2, 4, 3), ("a.bin", 3, 8, 1), ("b.bin", 0, 0, 0)]


def test_token_files_of_other_ends(spark, small, tmp_path):
    """An ordinary id ends no documents; files of a finished run go on request."""
    some = small.limit(5)
    for end in (5, 1000, -1, 1 << 16):
        with pytest.raises(ValueError):
            tokenfiles.document_counts(some, end_id=end)
    folder = f"{tmp_path}/tokens"
    assert len(tokenfiles.document_counts(some, folder=folder).collect()) == 5 and list((tmp_path / "tokens").iterdir())
    tokenfiles.remove_files(folder)
    assert not (tmp_path / "tokens").exists()


def test_token_blocks_cut_inside_documents(spark, small):
    """Blocks far smaller than a document: every cut falls inside one, several blocks hold no separator."""
    some = small.filter("length(text) > 100").repartition(2)
    library = WordTokenizer(plain=True).tokenizer
    want = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) for r in some.collect()}
    for size in (7, 61):
        got = tokenfiles.document_counts(some, block_ids=size).collect()
        assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(want)
        cuts = {(r.file, k * size) for r in got for k in range(r.start // size + 1, (r.start + r.n_tokens) // size + 1)}
        assert len(cuts) > len(want)


PAGE = """<html><head><title>t</title><script>var x="</p>";</script></head><body><nav><a href=/>home</a></nav><div class="ad">buy</div>
<article><h1>Title &amp; more</h1><p>First  line<br>goes <b>on</b>.<p>Second &#233; &lt;tag&gt;<div class="comments"><p>me too</p></div><form>mail</form><ul><li>one<li>two</ul></article><aside>x</aside><footer>&copy; y</footer>"""


def test_html(spark):
    rows = [(1, "http://A.example.com:80/x", PAGE), (2, "https://a.example.com/y?z", PAGE.replace("Second", "Other")), (3, None, None), (4, "nope", "<p>loose"), (5, "http://b.example.com", "<div>" * 3000 + "deep"), (1, "http://A.example.com:80/x", PAGE)]
    got = htmltext.main_text(spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, host string")).collect()
    texts = {r.page_id: r.text for r in got}
    assert texts[1] == "Title & more\nFirst line goes on.\nSecond é <tag>\none\ntwo" and texts[2] == texts[1].replace("Second", "Other")
    assert texts[3] == "" and texts[4] == "loose" and texts[5] == "deep" and len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    # on the table: what stands in article, read with nothing but regular expressions
    import html as h

    table = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op8_html(spark, SF).collect():
        body = re.search(r"<article>(.*)</article>", table[r.page_id], re.S)[1]
        parts = [" ".join(h.unescape(re.sub(r"<[^>]*>", " ", x) if "<br>" in x else re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:h1|p)>", body)]
        assert r.text == "\n".join(x for x in parts if x)


def brute_simhash(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = W.findall(words)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


def test_simhash(odd, small):
    for df, rows in zip((odd, small), both(odd, small)):
        prints = [brute_simhash(r.text) for r in rows]
        nodes = list(set(prints))
        root = {n: n for n in nodes}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in itertools.combinations(nodes, 2):
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
        least = {}
        for r, p in zip(rows, prints):
            if r.doc_id is not None:
                least[find(p)] = min(least.get(find(p), r.doc_id), r.doc_id)
        want = Counter((r.doc_id, simhash.signed(p), least.get(find(p))) for r, p in zip(rows, prints))
        assert Counter(map(tuple, simhash.near_duplicates(df).collect())) == want
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def brute_groups(rows):
    """Groups of one_of_each by comparing all pairs of prints, which are made here bit by bit."""

    def print_of(text):
        words = {re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in W.findall(text or "")}
        hashes, m = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words], (1 << 64) - 1
        out = []
        for band in range(5):
            mixed = []
            for h in hashes:
                g = (h ^ band) * 0x9E3779B97F4A7C15 & m
                g = (g ^ g >> 32) * 0x94D049BB133111EB & m
                mixed.append(g ^ g >> 29)
            out.append(sum(1 << k for k in range(48) if 2 * sum(g >> k & 1 for g in mixed) > len(mixed)))
        return tuple(out)

    def shingles_of(text):
        words = W.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))

    prints = [(print_of(text), shingles_of(text)) for text in rows]
    sketches = {x: simhash.prints(text)[2] for (_, x), text in zip(prints, rows)}

    def alike(x, y):  # near the threshold the sketch decides, whose error is another test's
        exact = len(x & y) / len(x | y)
        return exact if abs(exact - 0.7) > 0.15 else simhash.alike(sketches[x], sketches[y])

    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(root, 2):
        apart = [(x ^ y).bit_count() for x, y in zip(a, b)]
        if min(apart) <= 2 and sum(apart) <= 48 and alike(x, y) >= 0.7:
            root[find((a, x))] = find((b, y))
    return [find(p) for p in prints]


def test_one_of_each(odd, small):
    for df, rows in zip((odd, small), both(odd, small)):
        groups = brute_groups([r.text for r in rows])
        least = {}
        for r, g in zip(rows, groups):
            if r.doc_id is not None:
                least[g] = min(least.get(g, r.doc_id), r.doc_id)
        kept = simhash.one_of_each(df)
        assert kept.columns == df.columns
        assert Counter(r.doc_id for r in kept.collect()) == Counter([*least.values(), *(None for r in rows if r.doc_id is None)])
    assert simhash.one_of_each(odd.limit(0)).count() == 0


def test_one_of_each_recall(spark):
    """Copies with words changed so that their 5-word shingles are alike to 0.8 or more: nine of ten go, and no other document."""
    import random

    rng = random.Random(3)

    def shingles(words):
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) > 600").dropDuplicates(["text"])
    kept = {r.doc_id: r.text for r in simhash.one_of_each(docs).collect()}
    copies = []
    for doc_id, text in kept.items():
        words = text.split()
        for _ in range(max(1, len(words) // 60)):
            words[rng.randrange(len(words))] = rng.choice(("entirely", "other", "words", "than", "before"))
        a, b = shingles(text.split()), shingles(words)
        if len(a & b) >= 0.8 * len(a | b):
            copies.append((doc_id + 1_000_000, " ".join(words), doc_id))
    both_ = spark.createDataFrame([(d, t) for d, t in kept.items()] + [c[:2] for c in copies], "doc_id long, text string")
    got = {r.doc_id for r in simhash.one_of_each(both_).collect()}
    assert len(copies) > 100 and len(set(kept) - got) <= 0.01 * len(kept)  # a copy can stand between two documents that are alike to less than 0.8
    assert sum(d not in got for d, *_ in copies) >= 0.9 * len(copies)


def test_one_of_each_of_one_vocabulary(spark):
    """Texts with the same words in other orders (logs, forms) all stay; copies among them, exact and near, go, though the family shares its print of words."""
    import random

    rng = random.Random(11)
    vocabulary = [f"field{k}" for k in range(60)]
    rows = []
    for k in range(120):
        words = [w for _ in range(12) for w in rng.sample(vocabulary, 60)]
        rows.append((k, " ".join(words)))
        if k % 3 == 0:
            changed = words[:]
            changed[rng.randrange(len(words))] = vocabulary[0]
            rows.append((1000 + k, " ".join(changed)))  # alike to 0.98
        if k % 10 == 0:
            rows.append((2000 + k, " ".join(words)))
    assert len({tuple(simhash.prints(t)[0]) for i, t in rows if i < 1000}) == 1
    got = sorted(r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert [i for i in got if i < 1000] == list(range(120)) and sum(i >= 1000 for i in got) <= 2


def test_sketches():
    def exact(a, b):
        s = [{tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for t in (a, b)]
        return len(s[0] & s[1]) / len(s[0] | s[1])

    short = "a b c d e f g h i j"
    assert simhash.alike(simhash.prints(short)[2], simhash.prints(short + " k")[2]) == pytest.approx(exact(short, short + " k"))
    long = " ".join(f"w{k}" for k in range(3000))
    half = long.replace("w100 ", "x ").replace("w2000 ", "y ") + " z" * 1500
    assert abs(simhash.alike(simhash.prints(long)[2], simhash.prints(half)[2]) - exact(long, half)) < 0.1
    assert simhash.alike(b"", b"") == 1 and simhash.alike(b"", simhash.prints("a")[2]) == 0 and simhash.prints(None) == ([0] * 5, [0] * 4, b"")


def test_links_and_components(spark):
    fps = [0, 1, 3, 7, 15, 31, 1 << 63, (1 << 63) | 3, 0xFFFF << 20, (0xFFFF << 20) ^ 0b101]
    got = {tuple(sorted((r.a, r.b))) for r in simhash.links(spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")).collect()}
    near = {tuple(sorted((simhash.signed(a), simhash.signed(b)))) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 2}
    assert got <= near
    chain = [(k, k + 1) for k in range(60)] + [(100, 200), (150, 200)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 150: 100, 200: 100}


def brute_pii(text):
    found = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = re.sub(r"\D", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (12 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            found.append((kind, m.start(), m.end()))
    return found


def test_pii(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for df in (odd, docs):
        for r, text in [(r, t) for r, t in zip(pii.find(df.coalesce(1)).collect(), [x.text or "" for x in df.coalesce(1).collect()])]:
            base = brute_pii(text)
            assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in base) for x in pii.KINDS)
            assert set(pii.joined(base).split(",")) - {""} <= set(r.spans.split(","))
        out = pii.redact(df)
        assert out.columns == df.columns and out.count() == df.count()
    assert pii.find(odd.limit(0)).count() == pii.redact(odd.limit(0)).count() == 0
    for text in ("a@b", "a@b.c@d.e.f", "x@y.z.@q.r", "..@a.b", "1.2.3.4.5.6.7.8", "1.2.3.4.5", "+1+22222222222", "256.1.1.1 999", "4304158793483661 4304-1587-9348-3661", "é@a.b", "000000000000", "+++1 (2) 345678 "):
        assert sorted(pii.base_spans(text)) == sorted(brute_pii(text)), text


@pytest.mark.parametrize(
    "text,span",
    [
        ("write john.doe (at) example [dot] com now", ("email", "john.doe (at) example [dot] com")),
        ("ask john dot smith at mail dot example dot org please", ("email", "john dot smith at mail dot example dot org")),
        ("call plus four four two zero seven nine four six zero nine five eight ok", ("phone", "plus four four two zero seven nine four six zero nine five eight")),
        ("ip one nine two dot one six eight dot zero dot one x", ("ip", "one nine two dot one six eight dot zero dot one")),
        ("to jоhn@exаmple.com", ("email", "jоhn@exаmple.com")),
        ("x j​ohn@ex​ample.org", ("email", "j​ohn@ex​ample.org")),
        ("He looked at the dot in the point at home", None),
        ("Un deux mots et trois choses, le un et un", None),
    ],
)
def test_disguises(text, span):
    got = [(k, text[a:b]) for k, a, b in pii.added_spans(text, pii.base_spans(text))]
    assert got == ([span] if span else [])
    if span:
        assert span[1] not in pii.redacted(text)


NUMBERS = ["0" * 5000 + ".1.2.3", "1.2.3." + "0" * 4999 + "255", "1.2.3." + "0" * 5000 + "256", "9" * 5000 + ".1.1.1", "1.1.1.1." + "7" * 5000, "4" * 5000, "4304 1587 9348 3661 " + "0" * 5000, "+" + "1" * 5000, "+1 (" + "2" * 5000 + ")", "a" * 5000 + "@" + "5" * 5000 + ".de", "one " * 5000 + "dot two", "０" * 5000 + ".１.２.３"]


def test_pii_of_very_long_numbers(spark):
    """Each kind with figures beyond what int() converts: in each kind the result is a span or none, never an error."""
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(list(enumerate(NUMBERS)), "doc_id long, text string")).collect()}
    assert [got[k].n_ip for k in range(len(NUMBERS))] == [1, 1, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0]
    assert [got[k].n_email for k in (8, 9)] == [0, 1] and {got[k].n_card + got[k].n_phone for k in got} == {0}
    assert got[11].spans == "ip:0:5006"
    texts = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(list(enumerate(NUMBERS)), "doc_id long, text string")).collect()}
    assert texts[0] == texts[1] == "<IP>" and texts[3] == NUMBERS[3] and texts[9] == "<EMAIL>"


def test_pii_of_a_text_of_30_million_characters():
    text = "see 0012.0.0.1 or a.b@c.de and 4304 1587 9348 3661 " + "word " * 3_000_000 + "0" * 15_000_000 + ".1.2.3"
    assert [s[0] for s in pii.ordered(pii.base_spans(text))] == ["ip", "email", "card", "ip"] and pii.redacted(text).count("<IP>") == 2


def brute_kept(text):
    """The corpus rules, by regular expressions alone."""
    words, lines = W.findall(text), [x for x in text.split("\n") if W.search(x)]
    chars, dup = sum(map(len, words)), [x for k, x in enumerate(lines) if x in lines[:k]]
    size = lambda xs: sum(len(x.strip(" \t\n\x0b\x0c\r").encode()) for x in xs)
    bad_lines = 10 * len(dup) > 3 * len(lines) and 10 * size(dup) > 3 * size(lines)
    return not (
        len(words) < 10 or 100 * brute_repeat(words) > 20 * len(words) or 10 * len(re.findall(r"[#*$%&|<>]", text)) > len(words) or not 2 * len(words) <= chars <= 12 * len(words) or bad_lines
        or len(re.findall("[A-Z]", text)) > len(re.findall("[a-z]", text))
    )


def brute_redacted(text):
    """Base spans only: the small table has no disguises, which the test looks at too."""
    out, at, end = [], 0, -1
    for start, kind, stop in sorted((a, ("email", "ip", "card", "phone").index(k), b) for k, a, b in brute_pii(text)):
        if start < end:
            end = at = max(end, stop)
            continue
        out.append(text[at:start] + ("<EMAIL>", "<IP>", "<CARD>", "<PHONE>")[kind])
        at = end = stop
    return "".join(out) + text[at:]


def brute_mix(rows):
    """{doc_id: copies} of rows (doc_id, text, source)."""
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(W.findall(text))
    out = {}
    for source, target in brute_targets(sizes).items():
        times = int(target / sizes[source]) if sizes[source] else 0
        more = target - times * sizes[source]
        h = lambda name, d: int(hashlib.md5(f"{name}:{d}".encode()).hexdigest()[:15], 16)
        own = [(d, len(W.findall(t)), h("mix-1", d) < (more / sizes[source] if sizes[source] else 0) * 2.0**60) for d, t, s in rows if s == source]
        need = more - sum(n for _, n, hit in own if hit)
        before, flipped = 0, set()
        for d, n, hit in sorted(own, key=lambda o: h("mix-1-again", o[0])):
            if need and hit == (need < 0) and n <= abs(need):
                if before + n / 2 > abs(need):
                    break
                before += n
                flipped.add(d)
        out |= {d: times + (hit != (d in flipped)) for d, _, hit in own}
    return out


def test_mixing_is_by_draw(spark):
    """The draw at the fraction decides for nearly all documents; the correction touches few, whose words are what the draws missed."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got, rows = mixing.mix_report(docs).collect(), docs.select("doc_id", "text", "source").collect()
    expected = brute_mix([(r.doc_id, r.text or "", r.source) for r in rows])
    assert {r.doc_id: r.drawn + r.corrected for r in got} == expected
    assert 0 < sum(r.corrected != 0 for r in got) < 0.1 * len(got)
    alone = mixing.mix_report(docs, correct=False).collect()
    assert {r.doc_id: r.taken for r in alone} == {r.doc_id: r.size * r.drawn for r in got}
    words = Counter(r.doc_id for r in mixing.mix(docs).select("doc_id").collect())  # copies follow both steps
    assert all(words[d] == n for d, n in expected.items())
    by = defaultdict(lambda: [0, 0, 0, 0.0])
    for r in got:
        x = by[r.source_size]
        x[0], x[1], x[2], x[3] = x[0] + r.size * r.drawn, x[1] + abs(r.corrected) * r.size, x[2] + r.taken, r.target
    for drawn, corrected, taken, target in by.values():
        assert corrected <= 1.5 * abs(target - drawn) and abs(taken - target) <= max(0.5 * abs(target - drawn), 0.05 * target)


def test_pipeline(spark, small):
    """Against a version of all stages that shares no function with the operators."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "personal_data", "source_mix", "sequences"]
    good = [r for r in small.collect() if brute_kept(r.text)]
    groups, least = brute_groups([r.text for r in good]), {}
    for r, g in zip(good, groups):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    clean = [(r.doc_id, brute_redacted(r.text), r.source) for r in good if r.doc_id in set(least.values())]
    assert {r.doc_id: r.text for r in pii.redact(small).collect() if r.doc_id in {d for d, *_ in clean}} == {d: t for d, t, _ in clean}
    tok, want = Tokenizer.from_file(vocabulary()), Counter()
    copies = brute_mix(clean)
    for d, text, _ in clean:
        ids = [*tok.encode(text, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            piece = ids[k : k + 2048]
            want[d, k // 2048, len(piece), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in piece))] += copies[d]
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got) == +want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    assert all(a + n == b for x in bins.values() for (a, n), (b, _) in itertools.pairwise(sorted(x)))
    assert sorted(2048 - sum(n for _, n in x) for x in bins.values()) == brute_best_fit([r.length for r in got], 2048)


def test_pipeline_with_awkward_rows(spark, odd, tmp_path):
    """Nulls, empty and repeated rows, extra columns with clashing names, and an empty table go through all stages."""
    import corpus_pipeline

    more = odd.union(odd.filter("doc_id = 4")).withColumn("node", queries.F.lit("x")).withColumn("bands", queries.F.lit(1)).withColumn("ids", queries.F.lit(2)).withColumn("_own", queries.F.lit(3))
    more.write.parquet(str(tmp_path / "some/documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    kept = {r.doc_id for r in got}
    assert kept <= {3, 4, None, 9, 10} and {None} <= kept and 4 not in kept  # 4 repeats 3; the others have too few words
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    assert all(a + n == b for x in bins.values() for (a, n), (b, _) in itertools.pairwise(sorted(x)))
    more.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    docs = more
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == more.columns, name


def test_language_of_nothing(spark, odd):
    model = langid.train(odd.filter("lang is not null"))
    assert langid.identify(odd.limit(0), model).count() == 0
    assert langid.letters("😀a𝐀𐐀").tolist() == [32, 97, 0x1D400, 0x10428, 32]  # letters of all planes, no emoji


def test_languages_beyond_the_bound(spark, monkeypatch):
    """More languages than the matrix is made for are an error, never left out."""
    rows = [(k, "some words", lang) for k, lang in enumerate(["c", "c", "b", "a", "d"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.train(df)[0] == ["a", "b", "c", "d"]
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    with pytest.raises(ValueError):
        langid.train(df)


def test_languages_are_drawn_one_by_one(spark):
    """A language of three rows among 4,000 of another is learned from all three; one without a text of letters is none of the model's."""
    rows = [(k, f"the words of text {k} in this tongue", "en") for k in range(4000)] + [(5000 + k, "слова этого текста на языке", "ru") for k in range(3)]
    rows += [(6000, "", "zz"), (6001, None, "zz"), (6002, "... 12 !", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, matrix = langid.train(df, language_rows=50)
    assert langs == ["en", "ru"] and matrix.shape[1] == 2
    preds, _ = langid.score(["Привет мир как дела", "text in words", "slova"], langs, matrix)
    assert preds[:2] == ["ru", "en"]
    # about as many rows as asked teach the large language: its rarest n-grams tell how many
    e_bucket = int(langid.grams(langid.letters("e"), (1,))[1])
    p_small, p_all = (float(langid.train(df, language_rows=n)[1][e_bucket, 0]) for n in (50, 10_000))
    assert p_small < p_all - 0.5  # with fewer rows smoothing weighs more


def test_token_files_with_control_strings(spark):
    """A control token's string in a text is no document end."""
    rows = [(k, f"some words {k} <|endoftext|> more <|ENDOFTEXT|>" if k % 2 else "plain text") for k in range(9)]
    found = {r.doc_id: r.n_tokens for r in tokenfiles.document_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    own = WordTokenizer(plain=True).tokenizer
    assert found == {k: len(own.encode(t, add_special_tokens=False).ids) for k, t in rows}


def test_range_lookup(spark):
    for cuts in ([5], [1, 4, 9], list(range(0, 300, 7))):
        rows = spark.range(-3, 310).select("id", fingerprints._range_of(queries.F.col("id"), cuts).alias("at")).collect()
        assert all(r["at"] == sum(c < r["id"] for c in cuts) for r in rows)


def test_columns_with_clashing_names(spark, small):
    """Helper columns give way to the documents' own."""
    names = ("_source", "_times", "_upto", "_more", "_copies", "_copy", "_kept_id", "_nth", "_rows", "host", "component_id")
    wide = small.select("*", *(queries.F.lit(k).alias(n) for k, n in enumerate(names)))
    for f in (mixing.mix, simhash.one_of_each, quality.keep_good, pii.redact):
        assert f(wide).columns == wide.columns
        assert sorted(r.doc_id for r in f(wide).collect()) == sorted(r.doc_id for r in f(small).collect())


def test_pii_in_very_long_texts():
    """Long white space and thousands of identifiers take no quadratic time; added spans touch no other."""
    gap = " " * 300_000
    assert pii.added_spans(f"x{gap}ab [at] cd.org{gap}y", []) == [("email", 300_001, 300_001 + len("ab [at] cd.org"))]
    text = "".join(f"u{k}@h.org or v{k} [at] h [dot] org, " for k in range(20_000))
    base = pii.base_spans(text)
    added = pii.added_spans(text, base)
    assert len(base) == len(added) == 20_000 and all(text[a:b].endswith("org") and text[a] == "v" for _, a, b in added)
    spans = sorted((a, b) for _, a, b in base + added)
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))


@pytest.mark.parametrize(
    "text,span",
    [
        ("ask john at mail\ndot example\tdot org now", ("email", "john at mail\ndot example\tdot org")),
        ("at 10 dot 20 dot 0 dot 1 here", ("ip", "10 dot 20 dot 0 dot 1")),
        ("at 10 dot 20 dot 0 dot 999 here", None),
        ("Absatz 1 punkt 2 punkt 3", None),
    ],
)
def test_disguises_with_any_white_space(text, span):
    test_disguises(text, span)


def planted_disguises(n):
    """(text, kind, span) with one disguised identifier in prose; n of them, and as many texts of like words without any."""
    import random

    rng = random.Random(7)
    names, hosts, ends = ("anna", "jo.doe", "info", "max_m", "c3po", "li-wei"), ("example", "posta", "my-firm", "mail.uni"), ("com", "org", "de", "it", "io", "fr")
    digits = "zero one two three four five six seven eight nine".split()
    prose = "the meeting is in the second room and we look at the point of the plan, dot by dot, for one or two days".split()

    def say(words):
        k = rng.randrange(3, len(prose))
        return " ".join(prose[:k]) + f" : {words} ; " + " ".join(prose[k:])

    def email():
        a, b, c = rng.choice(names), rng.choice(hosts), rng.choice(ends)
        return rng.choice([
            f"{a} at {b.replace('.', ' dot ')} dot {c}", f"{a} AT {b.replace('.', ' DOT ')} DOT {c}", f"{a} (at) {b} (dot) {c}", f"{a}[at]{b}[dot]{c}", f"{a} {{at}} {b} {{dot}} {c}", f"{a} [@] {b}.{c}", f"{a}＠{b}.{c}",
            f"{a[0]}\u200b{a[1:]}@{b}.{c}", f"{a}@{b}\u2024{c}", f"{a.replace('a', 'а').replace('o', 'о')}@{b.replace('e', 'е').replace('o', 'о')}.{c}", f"{a}  at\t{b}\ndot  {c}",
        ])

    def ip():
        parts = [rng.randrange(256) for _ in range(4)]
        spoken = [" ".join(digits[int(d)] for d in str(p)) for p in parts]
        return rng.choice([" dot ".join(spoken), " DOT ".join(spoken), " dot ".join(map(str, parts)), "[.]".join(map(str, parts)), "(dot)".join(map(str, parts)), ".".join(map(str, parts)).translate({48 + k: 0xFF10 + k for k in range(10)})])

    def phone():
        d = [rng.randrange(1, 10)] + [rng.randrange(10) for _ in range(rng.randrange(9, 12))]
        spoken = [digits[x] for x in d]
        return rng.choice(["plus " + " ".join(spoken), "plus " + "-".join(spoken), "+" + "".join(chr(0xFF10 + x) for x in d), "plus " + ", ".join(spoken)])

    kinds = (("email", email), ("ip", ip), ("phone", phone))
    found = []
    for k in range(n):
        kind, make = kinds[k % 3]
        span = make()
        found.append((say(span), kind, span))
    return found, [say(" ".join(rng.sample(prose, 6))) for _ in range(n)]


def test_disguises_recall_and_precision():
    planted, clean = planted_disguises(600)
    hits = made = 0
    for text, kind, span in planted:
        got = [(k, text[a:b]) for k, a, b in pii.added_spans(text, pii.base_spans(text))]
        base = [(k, text[a:b]) for k, a, b in pii.base_spans(text)]
        hits += (kind, span) in got + base
        made += len(got)
    wrong = sum(len(pii.added_spans(t, pii.base_spans(t))) for t in clean)
    recall, precision = hits / len(planted), hits / (made + wrong)
    assert recall >= 0.9 and precision >= 0.9, (recall, precision)


def test_pii_memory_of_a_very_long_text():
    """A text of 30 million characters full of disguises: memory follows the text, not a list of its characters."""
    import subprocess
    import sys

    code = """
import resource, sys
sys.path.insert(0, sys.argv[1])
from scriptorium.llm import pii
part = "слово за словом, " * 2000 + "mail jo [at] example [dot] org and x\u200by "
text = part * (30_000_000 // len(part))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
spans = pii.added_spans(text, pii.base_spans(text))
assert len(spans) == text.count("jo [at]") and all(text[a:b] == "jo [at] example [dot] org" for _, a, b in spans)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    out = subprocess.run([sys.executable, "-c", code, pii.__file__.rsplit("/", 3)[0]], check=True, capture_output=True, text=True)
    assert float(out.stdout) < 500, out.stdout


def test_html_nested_very_deep():
    page = "<html><body>" + "<div class='a/b x'>" * 20_000 + "<p>deep words of a text</p>"
    root = htmltext.parse(page)
    path = htmltext.best(root).path
    assert path.count(" ") == 20_001 and htmltext.extract(root, [path]) == "deep words of a text"


def test_html_without_broadcast(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    dealt = htmltext.main_text(pages, broadcast_bytes=0)
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, htmltext.main_text(pages).collect()))


@pytest.mark.parametrize(
    "name",
    ["content has-sidebar", "no-sidebar", "content-side-left", "elementor-widget", "widget", "page has-sidebar", "content no-sidebar", "post-header-wrap", "layout with-header", "article-share story", "legal-news", "form-group", "post reply-to", "sidebar-page", "footer-less"],
)
def test_html_in_containers_with_noisy_names(name):
    page = f'<body><div class="{name}"><article><h1>Head</h1><p>The words of the article.</p><div class="sidebar"><p>apart</p></div></article></div><div class="footer"><p>imprint</p></div>'
    root = htmltext.parse(page)
    assert htmltext.extract(root, [htmltext.best(root).path]) == "Head\nThe words of the article."


def test_html_names_of_boilerplate():
    """Names that are or begin with a boilerplate word go, where they don't hold most of the page."""
    for name in ("sidebar", "sidebar-left", "ad_slot", "ad-unit-3", "cookie-bar", "comments-section", "related-articles", "share-bar", "nav-links", "footer-widgets"):
        page = f'<body><div class=main-col><p>The words of the article go on and on.</p><div class="{name}"><p>apart</p></div></div>'
        root = htmltext.parse(page)
        assert htmltext.extract(root, []) == "The words of the article go on and on.", name
    for name in ("ad-hoc", "admin", "related-work", "social-history", "navy", "comment-free", "legal-text", "formula"):
        root = htmltext.parse(f'<body><article><p>The words of the article.</p><div class="{name}"><p>within</p></div></article>')
        assert htmltext.extract(root, []) == "The words of the article.\nwithin", name


def test_html_keeps_formulas_and_labels():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> be.</p><fieldset><label>Note</label> <b>well</b></fieldset></article><form><label>Name</label></form>"
    assert htmltext.extract(htmltext.parse(page), []) == "Let x=1 be.\nNote well"


def test_html_pages_of_rare_layouts(spark):
    """Five layouts of one host, the rarer ones too; votes that tie; a layout that one page has; an empty table. A block that says the same on all pages goes by the votes."""
    text = "The words of this article go on for a while and then they end. "
    own = lambda k: f"{text * (k % 3 + 1)}Number {k}."
    pages = [(f"<body><div class=box-{'abcde'[k % 5]}><p>{own(k)}</p></div><div class=box-x><p>blurb</p></div>" if k % 5 else f"<body><article><p>{own(k)}</p></article>") for k in range(40)]
    pages.append(f"<body><section class=odd><p>{text}</p></section><div class=box-x><p>blurb</p></div>")
    df = spark.createDataFrame([(k, "https://h.example/x", p, 1) for k, p in enumerate(pages)], "page_id long, url string, html string, path int")
    for size in (0, 10**6):
        got = {r.page_id: r.text for r in htmltext.main_text(df, broadcast_bytes=size).collect()}
        assert len(got) == 41 and got[40] == text.strip() + "\nblurb"  # no other page votes with this one
        for k in range(40):
            assert got[k] == own(k)
            alone = htmltext.extract(htmltext.parse(pages[k]), {})
            assert alone == (own(k) if k % 5 == 0 else own(k) + "\nblurb")
        assert htmltext.main_text(df.limit(0), broadcast_bytes=size).count() == 0


def hosts_for_votes():
    """(host, html, text of the article) of planted hosts whose pages can't be told from boilerplate one by one."""
    out = []
    for k in range(24):
        body, more = f"Article {k} " + "tells a story of some length. " * (2 + k % 5), f"The second part of article {k}."
        # a promotion of its own words on every eighth page, and one that is longer than the article on two of them
        promo = f"<div class=box><p>{('Buy number %d now. ' % k) * (8 if k % 16 == 0 else 2)}</p></div>" if k % 8 == 0 else ""
        out.append(("promo.example", f"<body><div class=post><p>{body}</p></div>{promo}", body.strip()))
        # a second part on most pages, headline in a container of its own, loose words between, the same imprint everywhere
        second = f"<div class=more><p>{more}</p></div>" if k % 4 else ""
        html = f"<body><div class=wrap><div class=title><h1>Head {k}</h1></div><div class=entry><p>{body}</p></div>By <b>Ann {k}</b>, today{second}</div><div class=box><p>All rights are ours.</p></div>"
        out.append(("parts.example", html, f"Head {k}\n{body.strip()}\nBy Ann {k}, today" + (f"\n{more}" if k % 4 else "")))
        # two containers on the winning path
        out.append(("twice.example", f"<body><div class=post><p>{body}</p></div>" + (f"<div class=post><p>{more}</p></div>" if k % 2 else ""), body.strip() + (f"\n{more}" if k % 2 else "")))
    # copies of one page have one voice: the promotion on them is no part of the article by their number
    copy = "<body><div class=post><p>Copied words of an article.</p></div><div class=box><p>Buy this copy.</p></div>"
    out += [("promo.example", copy, "Copied words of an article.")] * 200
    return out


def test_html_by_votes(spark):
    planted = hosts_for_votes()
    df = spark.createDataFrame([(k, f"https://{h}/{k}", page) for k, (h, page, _) in enumerate(planted)], "page_id long, url string, html string").repartition(4)
    for size in (0, 10**6):
        got = {r.page_id: r.text for r in htmltext.main_text(df, broadcast_bytes=size).collect()}
        assert [got[k] for k in range(len(planted))] == [text for *_, text in planted]
    alone = [htmltext.extract(htmltext.parse(page), {}) for _, page, _ in planted]
    assert sum(a != text for a, (*_, text) in zip(alone, planted)) >= 27  # what the votes change


def brute_votes(pages):
    """Ballots counted with dictionaries: for each host its winning leads in order, with their parts."""
    leads, parts = defaultdict(lambda: [0, set()]), defaultdict(lambda: [set(), set()])
    for host, page in pages:
        for lead, part, seen, text in htmltext.ballot(htmltext.parse(page)):
            if part is None:
                leads[host, lead][0] += 1
                leads[host, lead][1].add(seen)
            else:
                parts[host, lead, part][0].add(seen)
                parts[host, lead, part][1].add(text)
    out = defaultdict(list)
    for (host, lead), (votes, seen) in leads.items():
        if votes >= 2:
            mine = frozenset(p for (h, at, p), (s, t) in parts.items() if (h, at) == (host, lead) and 4 * len(s) >= len(seen) and 4 * len(t) > len(s))
            out[host].append((-len(seen), -votes, htmltext.signed(lead), lead, mine if len(seen) >= 4 else None))
    return {h: {lead: (n, mine) for n, (*_, lead, mine) in enumerate(sorted(rows, key=lambda r: r[:3]))} for h, rows in out.items()}


def test_html_votes_against_brute_force(spark):
    """Vote and extraction over a whole table and the planted hosts, with nothing of Spark."""
    table = [(re.search("//([^/]*)", r.url)[1].lower(), r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()] + [(h, page) for h, page, _ in hosts_for_votes()]
    df = spark.createDataFrame([(k, f"http://{h}/", page) for k, (h, page) in enumerate(table)], "page_id long, url string, html string").repartition(3)
    won = brute_votes(table)
    got = {r.page_id: r.text for r in htmltext.main_text(df).collect()}
    assert [got[k] for k in range(len(table))] == [htmltext.extract(htmltext.parse(page), won.get(h, {})) for h, page in table]


def test_html_keeps_all_parts():
    long, short = "The words of the article go on. " * 9, "An intro of some words."
    for page in (
        f"<body><div class=post><div class=title><h1>{short}</h1></div><div class=entry><p>{long}</p></div></div>",
        f"<body>\n<div>\n<section class=intro><p>{short}</p></section>\n<section class=body><p>{long}</p></section>\n</div>",
        f"<body><article><p>{short}</p></article><div class=rest><p>{long}</p></div>",
    ):
        root = htmltext.parse(page)
        assert htmltext.extract(root, [htmltext.best(root).path]) == f"{short}\n{long.strip()}"
        assert htmltext.extract(root, ["body div section.intro", "body div.post div.title", "body article"]) == f"{short}\n{long.strip()}"
    teaser = f"<body><div class=lead><p>{short}</p></div><article><p>{long}</p></article>"
    assert htmltext.extract(htmltext.parse(teaser), ["body div.lead", "body article"]) == long.strip()
    assert htmltext.extract(htmltext.parse("<body><div><a href=x>only a link</a></div>"), ["body p", "body div"]) == "only a link"


def test_pipeline_keeps_clean_documents_with_a_short_line_twice(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id in (30, 3314, 3326, 3723, 8061, 9916)")
    junk = "One line of some words that comes again.\n" * 2 + "Another line that is here."
    both = docs.unionByName(spark.createDataFrame([(-1, junk, "en", "a", len(junk))], docs.schema))
    assert {r.doc_id for r in corpus_pipeline.quality_rules(spark, both, SF).collect()} == {30, 3314, 3326, 3723, 8061, 9916}


@pytest.mark.parametrize(
    "text,span",
    [
        ("ask anna at posta dot it please", ("email", "anna at posta dot it")),
        ("it is x at firma dot at, yes", ("email", "x at firma dot at")),
        *((f"ask anna at posta dot {end} now", ("email", f"anna at posta dot {end}")) for end in ("be", "co", "me", "pt", "in")),
        ("ask user at example.com please", ("email", "user at example.com")),
        ("ask jo dot doe at mail dot example dot museum please", ("email", "jo dot doe at mail dot example dot museum")),
        ("mail jo at example dot museum please", ("email", "jo at example dot museum")),
        ("(one dot two dot three dot four)", ("ip", "one dot two dot three dot four")),
        ('"one dot two dot three dot four"', ("ip", "one dot two dot three dot four")),
        ("It was available at example.com and we met at home.It rained", None),
        ("He looked at the dot in it, and at one point it fell", None),
    ],
)
def test_disguises_of_any_domain(text, span):
    test_disguises(text, span)


def test_one_of_each_with_repeated_ids(spark):
    a, b, c = ("the first text about boats and rivers and lakes", "another story of cities at night in winter", "some third thing with mountains, goats and snow")
    rows = [(5, a), (5, b), (7, a), (8, b), (3, c), (5, c), (5, b)]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted([(3, c), (5, a), (5, b)])
