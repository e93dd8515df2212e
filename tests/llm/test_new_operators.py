"""Exact dedup, ranked search and whitening against brute-force versions."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from scriptorium.llm import contentsort, lexical, queries, whitening

SF = "/root/testdata/sf0.001"
CLASHING = "doc_id long, text string, _text string, _hash long, kept boolean, _row int, n long, term string"
ODD = [(5, None), (1, ""), (2, " "), (3, "a b"), (8, "a b"), (8, "a b"), (None, "a b"), (None, "alone"), (4, "A  b"), (9, "x " * 200_000), (7, "x " * 200_000), (10, "été"), (11, None), (12, "a b c"), (13, "a a a b")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "q", 1, True, 2, 3, "z") for i, t in ODD], CLASHING).repartition(3)


def brute_groups(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = {t: (max if keep == "largest" else min)([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    return sorted((str(i), str(best[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), best


@pytest.mark.parametrize("least", [1, 256])
@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_duplicates(spark, odd, monkeypatch, least, keep):
    monkeypatch.setattr(contentsort, "LEAST_HOT", least)  # 1: nearly all groups are split and meet again
    small = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for docs in (odd, small.union(small.filter("doc_id < 40"))):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = contentsort.exact_duplicates(docs, keep=keep).collect()
        want, best = brute_groups(rows, keep)
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
        kept = [r for r in got if r.kept]
        assert len(kept) == len(best) and all(r.doc_id == r.keep_id for r in kept)
        one = contentsort.one_of_equals(docs, keep=keep)
        assert one.columns == docs.columns and sorted((t or "", str(i)) for i, t, *_ in one.collect()) == sorted((t, str(i)) for t, i in best.items())


def test_exact_duplicates_normalised_and_empty(spark, odd):
    got = {r.doc_id: r.keep_id for r in contentsort.exact_duplicates(odd, contentsort.squeezed).collect() if r.doc_id is not None}
    assert got[4] == 3 and got[2] == 1 and got[12] == 12
    none = odd.limit(0)
    assert contentsort.exact_duplicates(none).count() == 0 and contentsort.one_of_equals(none).count() == 0
    with pytest.raises(ValueError):
        contentsort.exact_duplicates(odd, keep="first")


def test_exact_duplicates_one_exchange(odd):
    rows = odd.select("doc_id", contentsort.as_is(queries.F.col("text")).alias("_text"))
    plan = contentsort._sorted(rows, "largest")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange hashpartitioning") == 1  # the latter counts hashes, for the hot ones
    assert "Python" not in plan and "Arrow" not in plan


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs, items, k=50):
    terms = lambda t: TERM.findall((t or "").translate(LOW))
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, length, df = len(held), sum(n for *_, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms(text)}
        scores = [(-sum(w[t] * ((10**9 * c[t]) // (1000 * c[t] + 20 * (50 + 50 * n * n_docs // length))) for t in w if t in c), i is None, i or 0) for i, c, n in held]
        out += [(item, nth + 1, None if null else i, -s) for nth, (s, null, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:k])]
    return sorted(out, key=str)


def found(docs, items, **options):
    return sorted(map(tuple, lexical.ranked(docs, items, **options).collect()), key=str)


def test_ranked(spark, odd, monkeypatch):
    small = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    asked = [tuple(r) for r in items.collect()]
    want = brute_search([tuple(r) for r in small.collect()], asked)
    assert found(small, items) == want
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 500)  # several blocks of items
    monkeypatch.setattr(lexical, "GATHER", 2000)  # and many of documents
    assert found(small.repartition(5), items) == want
    awkward = [(1, "A b"), (1, "a B"), (2, None), (3, ""), (4, "été alone"), (5, "nowhere"), (None, "c"), (6, "x " * 10_000)]
    df = spark.createDataFrame([(*a, "z") for a in awkward], "item_id long, text string, doc_id string")
    for k in (2, 50):
        assert found(odd, df, k=k) == brute_search(ODD, awkward, k)
    assert found(odd.limit(0), df) == [] == found(odd, df.limit(0))


def test_ranked_prunes_safely(spark):
    """A rare term's k-th impact is above all that the common ones add up to: those are no longer looked up, and nothing is lost."""
    rows = [(i, "the of and " * (1 + i % 7) + ("zebra " * (1 + i % 3) if i % 40 == 0 else "")) for i in range(400)]
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string"), [(1, "the zebra of and"), (2, "the of")]
    known = {t: k for k, t in enumerate(sorted([b"the", b"of", b"and", b"zebra"]))}
    forward = lexical._forward(docs, known)
    n_docs, length, df = lexical._figures(forward, 4)
    w = np.array([lexical.weight(n_docs, int(d)) for d in df])
    high, kth = lexical._term_bounds(forward, w, n_docs, length, 5)
    seed, order, sought = lexical.plan(np.arange(4), high, kth)
    assert seed > 0 and list(sought) == [known[b"zebra"]] and len(order) == 4
    brute = brute_search(rows, asked, 5)
    assert found(docs, spark.createDataFrame(asked, "item_id long, text string"), k=5) == brute and any(r[3] >= seed for r in brute)


def test_terms():
    assert lexical.terms("Don't PANIC, été_42\x7fÀ b") == [b"don", b"t", b"panic", "été".encode(), b"42", "À b".encode()] and lexical.terms(None) == []


def brute_whitening(rows, k=4):
    kept = [(i, [None if c is None else float(c) for c in v]) for i, v in rows if v is not None]
    kept = [(i, v) for i, v in kept if all(c is not None and math.isfinite(c) and abs(256 * c) < 2**62 for c in v)]
    width = max(len(v) for _, v in kept)
    x = np.array([[math.floor(256 * c) for c in v] + [0] * (width - len(v)) for _, v in kept], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, vectors = np.linalg.eigh(c.T @ c / n)
    top = np.argsort(-e)[:k]
    e = np.maximum(e, 0)
    z = (x - s / n) @ vectors[:, top] * np.where(e[top] > 1e-9, 1 / np.sqrt(np.where(e[top] > 1e-9, e[top], 1)), 0)
    far = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return [(i, far[m], n, z[m], e[top] / max(e.sum(), 1e-300)) for m, (i, _) in enumerate(kept)]


def check_whitening(got, want):
    rows = defaultdict(list)
    for r in got:
        rows[r.vec_id].append(r)
    signs = {}
    assert Counter(r.vec_id for r in got) == Counter({i: 0 for i in ()} | Counter(i for i, *_ in want for _ in range(len(want[0][3]))))
    for i, far, n, z, share in want:
        for r in rows[i]:
            c = r.component - 1
            assert (r.n, r.deviation) == (n, far) and abs(r.explained - share[c]) <= 1e-9 and r.identity_error <= 1e-9
            if abs(z[c]) > 1e-6:
                assert signs.setdefault(c, np.sign(z[c] * r.whitened)) == np.sign(z[c] * r.whitened)
            assert abs(abs(r.whitened) - abs(z[c])) < 1e-8


def test_whitening(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute_whitening([(r.vec_id, r.embedding) for r in df.collect()])
    check_whitening(queries.op13_whitening(spark, SF).collect(), want)
    twice = df.union(df.filter("vec_id % 3 = 0").withColumn("vec_id", queries.F.col("vec_id") + 1_000_000))
    check_whitening(whitening.whitened(twice).collect(), brute_whitening([(r.vec_id, r.embedding) for r in twice.collect()]))


def test_covariance_tiles(spark, monkeypatch):
    """Tiles that don't divide the dimensions, several row-blocks, entries beyond two bytes."""
    rng = np.random.default_rng(5)
    x = rng.integers(-900, 900, (1300, 11))
    x[3, 4] = 1 << 20
    df = spark.createDataFrame([(whitening.encode(r), 11) for r in x], "cells binary, width int").repartition(3)
    centred = x - x.sum(axis=0) / len(x)
    n, sums = whitening._sums(df, 11)
    assert n == 1300 and list(sums) == x.sum(axis=0).tolist()
    for tile, rows in ((3, 8192), (4, 100), (11, 8192), (32, 1)):
        monkeypatch.setattr(whitening, "SALT_ROWS", rows)
        assert np.allclose(whitening.covariance(df, n, sums, tile), centred.T @ centred / n, rtol=1e-12)


def test_whitening_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, -0.0]), (2, None), (3, [1.0, None, 2.0]), (4, [nan, 1.0, 1.0]), (5, [inf, 1.0, 1.0]), (6, [0.5, -1.25, 3.0]), (6, [0.5, -1.25, 3.0]), (None, [0.1, 0.2, 0.3]), (7, [4.0, 0.25, 1.0]), (8, [2.0]), (9, []), (10, [1e300, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, n long, cells string").repartition(2)
    got = whitening.whitened(df).collect()
    assert Counter(r.vec_id for r in got) == {1: 3, 6: 6, None: 3, 7: 3, 8: 3, 9: 3} and {r.n for r in got} == {6}
    want = [w for w in brute_whitening(rows, 3)]
    for i, far, *_ in want:
        assert far in {r.deviation for r in got if r.vec_id == i}
    assert whitening.whitened(df.limit(0)).count() == 0 and whitening.whitened(df.filter("vec_id = 2")).count() == 0
    one = whitening.whitened(df.filter("vec_id = 6")).collect()  # one different vector: no variance
    assert {(r.n, r.deviation, r.whitened, r.explained) for r in one} == {(1, 0, 0.0, 0.0)} and len(one) == 6
    flat = spark.createDataFrame([(k, [float(k), 2.0 * k, 1.0]) for k in range(20)], "vec_id long, embedding array<float>")
    got = whitening.whitened(flat).collect()
    assert all(r.whitened == 0 for r in got if r.component > 1) and max(r.identity_error for r in got) < 1e-9
    large = spark.createDataFrame([(k, [1e15 * k, 1.0]) for k in range(3)], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whitened(large).collect()} == {None, 0}  # beyond a long; the middle one is the mean
    with pytest.raises(ValueError):
        whitening.fit(spark.createDataFrame([(b"\x02", 5000)], "cells binary, width int"))
