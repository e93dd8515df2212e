"""What larger tables ask for: texts that are moved once, tasks of bounded size, rules that Java runs fast; and the same results on odd texts."""

import math
import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as E  # noqa: E402
from scriptorium.operators import chapters, cohesion, language, media, phrases  # noqa: E402
from scriptorium.operators import text as T  # noqa: E402
from scriptorium.plans import rules as R  # noqa: E402
from scriptorium.plans import session  # noqa: E402

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def exchanges(df) -> list[str]:
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].split("\n") if "Exchange" in line]


@pytest.mark.parametrize("name", ["semantic_chunks", "sentence_cohesion", "topics_topk"])
def test_words_are_not_moved(spark, name):
    """Texts are dealt over the cores; no word is dealt by gap or by text."""
    assert len(exchanges(E.queries()[name](spark, SF))) == 1


def test_only_tied_words_are_moved(spark):
    """Words that are in no pair with the next are gone before chains are made."""
    df = spark.createDataFrame([(1, "a b c d e f, a b c")], "k int, t string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("e", "f")], "word string, next string")
    found = language.phrases(df, pairs, "t", "k", 2)
    assert "LeftSemi" in plan(found)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0, "a b"), (1, 4, "e f"), (1, 6, "a b")]


def test_large_tables_are_dealt_too(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    size = os.path.getsize(f"{SF}/documents.parquet")
    monkeypatch.setattr(session, "SPREAD_BYTES", size // 40)
    assert session.spread(docs, "doc_id").rdd.getNumPartitions() >= 40


def test_white_space_of_both_engines(spark):
    """The property that Java reads fast holds the same characters as the list."""
    chars = spark.createDataFrame([(chr(k),) for k in range(1, 0x30000) if not 0xD800 <= k < 0xE000], "c string")
    for listed, fast in ((R.SPACE, R.JAVA_SPACE), (R.STRIP, R.JAVA_STRIP)):
        assert chars.filter(F.col("c").rlike(f"[{listed}]") != F.col("c").rlike(f"[{fast}]")).count() == 0
        assert chars.filter(F.col("c").rlike(f"[{fast}]")).count() >= 25


def test_rules_ask_for_the_property():
    assert not [r for r in R.CLEAN + R.MODERN + R.PLAIN if not r.literal and "2028" in r.java]


def test_addresses_with_and_without_the_faster_rule(spark):
    rule = next(r for r in R.MODERN if r.faster)
    texts = ["a@b.com_x@y.org", "a@b.c@d.ef", "..@x.yz%q@r.stu.", "no@where x@y.z1.ab", "a" * 50 + "@" + "b.cc" * 3]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_replace("t", rule.pattern, rule.replacement)
    assert df.filter(rule.spark(F.col("t")) != plain).count() == 0


def test_contents_with_odd_titles(spark):
    """Positions by characters, ASCII case alone, titles that are patterns or empty."""
    text = "x İ 😀 ONE(.*) first É two\\E second é TWO\\e third"
    toc = [(1, 1, "one(.*)"), (1, 2, "é"), (1, 3, "two\\E"), (1, 4, "none"), (1, 5, ""), (1, 6, "İ")]
    low = lambda s: s.translate(str.maketrans(chapters.UPPER, chapters.LOWER))
    want = {}
    for (_, pos, title), nxt in zip(toc, [*(t[2] for t in toc[1:]), None]):
        at = low(text).find(low(title))
        rest = text[at + len(title) :] if at >= 0 else text
        end = low(rest).find(low(nxt)) if nxt is not None else -1
        body = (rest[:end] if end >= 0 else rest).strip()
        if body:
            want[pos] = body
    df = chapters.by_toc(spark.createDataFrame([(1, text)], "k int, t string"), spark.createDataFrame(toc, "k int, pos int, title string"), "t", "k")
    assert {r.chapter_num: r.content for r in df.collect()} == want
    assert "translate(" not in plan(df)


def test_depths_of_a_text(spark):
    texts = spark.createDataFrame([(1, " ".join(f"river water {w} stone. " * 2 for w in ("bank", "money", "cloud", "paper")))], "k int, t string")
    found = cohesion.cohesion(texts, "t", "k").orderBy("gap")
    want = [r.depth for r in cohesion.depths(found, "k").orderBy("gap").collect()]
    import numpy as np

    assert cohesion._depths(np.array([r.cohesion for r in found.collect()])) == pytest.approx(want, abs=0)


def test_gaps_of_slices(spark, monkeypatch):
    """Texts that are counted apart give what they give together; null and one-sentence texts have no gaps."""
    import pyarrow as pa

    rows = [[["aaaa", "bbbb"], ["aaaa"], []], None, [["cccc"]], [["dddd"], ["dddd", "aaaa"]], []]
    lists = pa.array(rows, pa.list_(pa.list_(pa.string())))
    assert [b for _, b in cohesion._slices(lists, 3)][-1] == 5 and len(list(cohesion._slices(lists, 3))) > 1
    row, gap, cosine = cohesion._cosines(lists, 3)
    assert list(zip(row.tolist(), gap.tolist())) == [(0, 1), (0, 2), (3, 1)]
    assert cosine.tolist() == pytest.approx([1 / math.sqrt(2), 0.0, 1 / math.sqrt(2)])


def test_descriptions_like_their_sql(spark):
    """A capital is one letter, and quotes before a last line end stay."""
    several = [c for c in map(chr, range(1, 0x1FFFF)) if not 0xD800 <= ord(c) < 0xE000 and len(c.upper()) > 1]
    texts = [*several, 'He said "no"\n', '"\n', "'a'\n", "", None, *(c + " b. " * 60 for c in several[:5])]
    sql = E.oracle_sql()["description_truncate"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.d for r in df.select("doc_id", media.clean_description(F.col("text"), 150).alias("d")).collect()}
    assert got == dict(con.execute(sql).fetchall())


def test_backoff_of_failed_events(spark):
    """The schedule is that of a table's events, as the SQL has it."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    want = sorted(con.execute(E.oracle_sql()["backoff_schedule"]).fetchall())
    assert sorted(tuple(r) for r in E.queries()["backoff_schedule"](spark, SF).collect()) == want and len({w[0] for w in want}) > 1


def test_rules_in_one_pass(spark):
    """Cleaning, normalising and lowering run over batches; odd texts become what they become in DuckDB and, rule by rule, in Java."""
    random = __import__("random").Random(3)
    bits = ["# ", "#", "Chapter 3", "Page 4 of 5", "[12]", "[٣]", "<b>", "<", ">", "**", "*", '"', "![a](b)", "![", "](", ")", "—", "…", "& ", "5%", "$3", "\\1", "\\", "’", " ", "  ", "\t", "\n", "\n\n", "\r\n", "\x0b", "\x1c", "\x85", " ", "　", "\x00", "😀", "é", "word", "End.", "no,", "hm?", "ah!", "[PAUSE: 0.5]", "[HEADER_END]", "[CHAPTER_START: x", "]", "a@b.co", "http://x.y", "+1 (23) 45-67-89"]
    texts = [None, "", " ", "\x1c　\n", " \x85", "\\", *("".join(random.choices(bits, k=random.randint(1, 30))) for _ in range(2000))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(2)
    con = duckdb.connect()
    con.execute("CREATE TABLE d (k INT, t VARCHAR)")
    con.executemany("INSERT INTO d VALUES (?, ?)", list(enumerate(texts)))
    for name, rules in (("clean", R.CLEAN), ("modern", R.MODERN), *R.LOWERINGS.items()):
        new = T.clean(F.col("t")) if name == "clean" else T.normalise(F.col("t")) if name == "modern" else T.lower(F.col("t"), name)
        assert "ArrowEvalPython" in plan(df.select(new))
        java = F.when(F.col("t").rlike(f"[^{R.JAVA_STRIP}]"), R.apply(F.col("t"), rules)).otherwise(F.col("t")) if name == "clean" else R.apply(F.col("t"), rules)
        got = df.select("k", new.alias("n"), java.alias("j")).collect()
        assert [r for r in got if r.n != r.j] == []
        blank = "k < 0" if name != "clean" else f"len(regexp_extract_all(t, '[^{R.STRIP}]')) = 0"
        want = dict(con.execute(f"SELECT k, CASE WHEN {blank} THEN t ELSE {R.apply_duck('t', rules)} END FROM d").fetchall())
        assert {r.k: r.n for r in got} == want


def test_strip_and_words_of_all_white_space(spark):
    """Ends are cut and words counted as the rules' patterns say, for each character that is white space or next to it."""
    near = [chr(c) for k in (*range(1, 0x30), 0x85, 0xA0, 0x1680, 0x180E, 0x2000, 0x200A, 0x200B, 0x2028, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF) for c in {max(k - 1, 1), k, k + 1}]
    texts = [None, "", " ", "   ", *near, *(f"{c}a{c}{c}b {c}é{c}" for c in near), *(f" {c} " for c in near), *(f"x{c} y" for c in near), "😀  a", " 😀"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    listed = F.regexp_replace("t", f"^[{R.STRIP}]+|[{R.STRIP}]+$", "")
    words = F.coalesce(F.size(F.regexp_extract_all("t", F.lit(f"[^{R.STRIP}]+"), F.lit(0))), F.lit(0))
    assert df.filter((T.strip(F.col("t")) != listed) | (T.word_count(F.col("t")) != F.greatest(words, F.lit(0)))).collect() == []
    assert "regexp" not in T.strip(F.col("t"))._jc.toString()


def test_windows_of_words(spark):
    """Long chapters are cut as slices of their words are; no word becomes a string of its own."""
    chars = [" ", "  ", "\n", "　", "\x1c\t", "\x85 "]
    texts = ["".join(f"{'w' * (i % 3 + 1)}{i}{chars[i * n % 6]}" for i in range(n)) for n in range(40)] + ["\n a b  c d e ", None]
    rows = [(k, "t", t, len(t.split()) if t is not None else None) for k, t in enumerate(texts)] + [(99, "t", " ", 50)]
    got = chapters.split_long(spark.createDataFrame(rows, "k int, title string, content string, word_count long"), 7, parts_in="n")
    assert plan(got).count("regexp_extract_all") == 1 and "array_join" not in plan(got)
    want = []
    for k, title, t, n in rows:
        if n is None or n <= 7:
            want.append((k, title, t, n, 1, 1))
            continue
        w = t.split()
        parts = [w[i : i + 7] for i in range(0, len(w), 7)] or [[]]
        want += [(k, f"t - Part {i + 1}" if len(parts) > 1 else "t", " ".join(p), len(p), i + 1, len(parts)) for i, p in enumerate(parts)]
    assert sorted((r.k, r.title, r.content, r.word_count, r.part, r.n) for r in got.collect()) == sorted(want)
    long = chapters.split_long(spark.createDataFrame([(1, "t", "word " * 300_000, 300_000)], "k int, title string, content string, word_count long"), 5000)
    assert {r.word_count for r in long.collect()} == {5000}


def test_modern_texts_are_dealt_again(spark):
    """The window, the grouping and the join find normalised texts dealt by their key; each exchange moves texts, none sentences."""
    lines = exchanges(E.queries()["modern_stats"](spark, SF))
    assert not [line for line in lines if "ENSURE_REQUIREMENTS" in line]


def test_phrase_topics_move_texts_once(spark, tmp_path, monkeypatch):
    """Texts are read and dealt by one shuffle, words only as packed pairs, however few bytes of pairs may be broadcast."""
    monkeypatch.setattr(language, "BROADCAST_BYTES", 0)
    df = E.queries()["phrase_topics"](spark, SF)
    ours = sorted(map(tuple, df.collect()))
    assert len(ours) > 0 and "LeftSemi" not in plan(df)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert ours == sorted(db.execute(E.oracle_sql()["phrase_topics"]).fetchall())


ODD = ["new york city hall of new york city hall of fame", " a  b a b,a b \n a b ", None, "", "  ", "É À é à É À. é à", "x1y x y x y 9", "new york\nnew york new york " * 40, "ſß ǅa " * 5, "the end", "a"]


@pytest.mark.parametrize("least, lift", [(3, 20), (2, 2), (1, 1)])
def test_topics_of_packed_pairs(spark, least, lift):
    """The same topics as by rows of words: odd letters and spaces, empty texts, chains of more than four words, numbers as text."""
    df = spark.createDataFrame([(k, t) for k, t in enumerate(ODD * 7)], "k long, t string").repartition(5)
    by_rows = language.topics(language.phrases(df, language.phrase_pairs(df, "t", "k", least, lift), "t", "k"), "k")
    assert sorted(map(tuple, phrases.topics(df, "t", "k", least, lift).collect())) == sorted(map(tuple, by_rows.collect()))
    assert phrases.topics(df.limit(0), "t", "k", least, lift).count() == 0 and phrases.topics(df.filter("t = ''"), "t", "k", least, lift).count() == 0


def test_phrase_topics_of_odd_texts(spark, tmp_path):
    """As SQL has it, capitals that Java makes two characters or another letter among them."""
    rows = [(k, t) for k, t in enumerate((ODD + ["İx Ab " * 9, "ΟΔΟΣ ΑΣ. ΟΔΟΣ ΑΣ"]) * 7)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(db.execute(E.oracle_sql()["phrase_topics"]).fetchall())
    assert len(want) > 50 and sorted(map(tuple, E.queries()["phrase_topics"](spark, str(tmp_path)).collect())) == want


def test_pairs_packed_and_unpacked():
    np, pa = pytest.importorskip("numpy"), pytest.importorskip("pyarrow")
    names = pa.array([f"w{k:04d}" for k in range(3000)])
    first, second = np.sort(np.arange(5000) * 7 % 3000), np.where(np.arange(5000) % 5 == 0, -1, np.arange(5000) * 11 % 3000)
    n = np.arange(5000, dtype=np.int64) ** 3
    own, a, b, m = phrases.unpack(phrases.pack(names, first, second, n))
    spelled = lambda names, a, b: [(names[int(x)].as_py(), names[int(y)].as_py() if y >= 0 else None) for x, y in zip(a, b)]
    assert spelled(own, a, b) == spelled(names, first, second) and (m == n).all()
