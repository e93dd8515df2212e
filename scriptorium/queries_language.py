"""Registered queries of proper nouns, phrases, entities and cohesion, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import cohesion, language, modern, phrases
from .operators import text as T
from .plans import rules as R
from .plans.session import parts_of
from .queries import books, documents, query, table, wc
from .queries_books import _confidence_sql, _MODERN_BOOKS

# ---- proper nouns -----------------------------------------------------------------------------------------------


def _sentences(t: str) -> str:
    return rf"string_split_regex(regexp_replace({t}, '([.!?])[{R.STRIP}]+', '\1' || chr(1), 'g'), chr(1) || '|\n+')"


def _proper_sql(src: str, t: str) -> str:
    inside = f"SELECT unnest(regexp_extract_all(s, '\\p{{L}}+')[2:]) AS w FROM (SELECT unnest({_sentences(t)}) AS s FROM ({src}))"
    counted = f"SELECT lower(w) AS word, count(*) FILTER (WHERE regexp_matches(w, '^\\p{{Lu}}.*\\p{{Ll}}')) AS capitals, count(*) FILTER (WHERE regexp_matches(w, '^\\p{{Ll}}')) AS smalls FROM ({inside}) GROUP BY 1"
    return f"SELECT * FROM ({counted}) WHERE capitals >= 2 AND 5 * capitals >= 4 * (capitals + smalls)"


_PROPER = _proper_sql("SELECT text FROM documents", "text")


@query(_PROPER)
def proper_nouns(spark, sf_dir):
    return language.proper_nouns(documents(spark, sf_dir))


def _headings_sql(src: str, key: str) -> str:
    """Sentence candidates with the proper-noun branch: the conditions of both, written out by themselves."""
    parts = f"SELECT {key}, unnest(l) AS title, unnest(range(1, len(l) + 1)) AS i FROM (SELECT {key}, string_split(regexp_replace(txt, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)) AS l FROM ({src}))"
    placed = f"SELECT *, CAST(coalesce(sum(length(title) + 1) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM ({parts})"
    upper = "(regexp_matches(title, '\\p{Lu}') AND NOT regexp_matches(title, '[\\p{Ll}\\p{Lt}]'))"
    title = "(len(regexp_extract_all(title, '[\\p{Lu}\\p{Lt}\\p{Ll}]+')) > 0 AND len(list_filter(regexp_extract_all(title, '[\\p{Lu}\\p{Lt}\\p{Ll}]+'), lambda w: NOT regexp_matches(w, '^[\\p{Lu}\\p{Lt}]\\p{Ll}*$'))) = 0)"
    named = "list_has_any(list_transform(list_filter(regexp_extract_all(title, '\\p{L}+'), lambda w: regexp_matches(w, '^\\p{Lu}.*\\p{Ll}')), lambda w: lower(w)), names)"
    return f"SELECT {key}, start, title, {_confidence_sql('title')} AS confidence FROM ({placed}), (SELECT list(word) AS names FROM ({_PROPER})) WHERE title <> '' AND {wc('title')} <= 10 AND ({upper} OR {title} OR {named})"


@query(_headings_sql(_MODERN_BOOKS, "book_id"))
def sentence_headings_proper(spark, sf_dir):
    texts = books(spark, sf_dir).select("book_id", T.normalise(F.col("raw")).alias("t"))
    return modern.sentence_candidates(texts, "t", "book_id", proper_nouns(spark, sf_dir)).drop("method")


# ---- phrases ----------------------------------------------------------------------------------------------------

_RUNS = "SELECT doc_id, unnest(l) AS run, unnest(range(1, len(l) + 1)) AS r FROM (SELECT doc_id, regexp_extract_all(lower(text), '\\p{L}+(?: \\p{L}+)*') AS l FROM documents)"
_NEAR = f"SELECT doc_id, r, unnest(l) AS word, unnest(list_append(l[2:], NULL)) AS next, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, r, string_split(run, ' ') AS l FROM ({_RUNS}))"
_PAIRS = f"""SELECT p.word, p.next, p.n FROM (SELECT word, next, count(*) AS n FROM ({_NEAR}) WHERE next IS NOT NULL GROUP BY 1, 2) p
 JOIN (SELECT word, count(*) AS n FROM ({_NEAR}) GROUP BY 1) a ON p.word = a.word JOIN (SELECT word, count(*) AS n FROM ({_NEAR}) GROUP BY 1) b ON p.next = b.word, (SELECT count(*) AS total FROM ({_NEAR}))
 WHERE p.n >= 3 AND CAST(p.n AS HUGEINT) * total >= 20 * CAST(a.n AS HUGEINT) * b.n"""


@query(_PAIRS)
def phrase_pairs(spark, sf_dir):
    return language.phrase_pairs(documents(spark, sf_dir), "text", "doc_id")


_PHRASES = f"""SELECT doc_id, CAST(min(pos) AS BIGINT) AS pos, string_agg(word, ' ' ORDER BY pos) AS phrase FROM (SELECT *, (row_number() OVER (PARTITION BY doc_id, chain ORDER BY pos) - 1) // 4 AS part
 FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS chain FROM (SELECT *, CASE WHEN lag(tied) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS fresh
 FROM (SELECT n.doc_id, n.word, row_number() OVER (PARTITION BY n.doc_id ORDER BY r, i) - 1 AS pos, p.word IS NOT NULL AS tied FROM ({_NEAR}) n LEFT JOIN ({_PAIRS}) p ON n.word = p.word AND n.next = p.next))))
 GROUP BY doc_id, chain, part HAVING count(*) > 1"""


@query(f"SELECT doc_id, rank, phrase AS topic, n FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS BIGINT) AS rank FROM (SELECT doc_id, phrase, count(*) AS n, min(pos) AS first FROM ({_PHRASES}) GROUP BY 1, 2)) WHERE rank <= 5")
def phrase_topics(spark, sf_dir):
    """The five most frequent phrases of each document."""
    docs = table(spark, sf_dir, "documents")
    return phrases.topics(docs, "text", "doc_id", parts=parts_of(docs))


# ---- entities ---------------------------------------------------------------------------------------------------

_CHAINS = "SELECT entity, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\\p{Lu}\\p{L}*(?: \\p{Lu}\\p{L}*){0,2}')) AS entity FROM documents) GROUP BY 1 HAVING count(*) >= 2"
_EACH = f"SELECT entity, n, w, p.word IS NOT NULL AS known FROM (SELECT entity, n, unnest(string_split(entity, ' ')) AS w FROM ({_CHAINS})) LEFT JOIN ({_PROPER}) p ON lower(w) = p.word"
_GAZETTEER = f"""SELECT entity, CAST(max(n) AS BIGINT) AS n FROM (SELECT entity, n FROM ({_EACH}) GROUP BY 1, 2 HAVING bool_and(known)
 UNION ALL SELECT w, CAST(sum(n) AS BIGINT) FROM ({_EACH}) WHERE known AND regexp_matches(w, '^\\p{{Lu}}.*\\p{{Ll}}') GROUP BY 1) GROUP BY 1"""


@query(_GAZETTEER)
def entity_gazetteer(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return language.gazetteer(docs, language.proper_nouns(docs))


@query()
def document_entities(spark, sf_dir):
    """Spans of the gazetteer's names; an automaton has no SQL form, tests hold it against a search of every name."""
    return language.entities(table(spark, sf_dir, "documents"), entity_gazetteer(spark, sf_dir), "text", "doc_id")


# ---- cohesion ---------------------------------------------------------------------------------------------------

_SAID = f"SELECT doc_id, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, {_sentences("text")} AS l FROM documents)"
_COUNTS = f"SELECT doc_id, i, word, count(*) AS c FROM (SELECT doc_id, i, unnest(regexp_extract_all(lower(s), '\\p{{L}}+')) AS word FROM ({_SAID})) WHERE length(word) > 3 GROUP BY 1, 2, 3"
_SIDES = f"SELECT doc_id, gap, word, CAST(sum(CASE WHEN i <= gap THEN c ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN i > gap THEN c ELSE 0 END) AS BIGINT) AS b FROM (SELECT *, unnest(range(i - 3, i + 3)) AS gap FROM ({_COUNTS})) GROUP BY 1, 2, 3"
_COHESION = f"""SELECT g.doc_id, CAST(g.gap AS BIGINT) AS gap, round(coalesce(dot / sqrt(CAST(aa AS DOUBLE) * bb), 0.0), 6) AS cohesion FROM (SELECT doc_id, unnest(range(1, n)) AS gap FROM (SELECT doc_id, max(i) AS n FROM ({_SAID}) GROUP BY 1)) g
 LEFT JOIN (SELECT doc_id, gap, CAST(sum(a * b) AS DOUBLE) AS dot, sum(a * a) AS aa, sum(b * b) AS bb FROM ({_SIDES}) GROUP BY 1, 2 HAVING sum(a * a) > 0 AND sum(b * b) > 0) x ON g.doc_id = x.doc_id AND g.gap = x.gap"""


@query(_COHESION)
def sentence_cohesion(spark, sf_dir):
    """Likeness of what stands before and after each gap between sentences."""
    return cohesion.cohesion(documents(spark, sf_dir), "text", "doc_id").select("doc_id", "gap", F.round("cohesion", 6).alias("cohesion"))


@query()
def semantic_chunks(spark, sf_dir):
    """Chunks cut at the deepest valleys of cohesion; tests hold them against a version without Spark, and their join gives the text back."""
    rows = cohesion.chunks(documents(spark, sf_dir), "text", "doc_id")
    return rows.select("doc_id", "id", "chunk", "method", T.word_count(F.col("chunk")).alias("word_count"))
