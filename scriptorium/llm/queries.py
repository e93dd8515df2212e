"""The queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, contentsort, fingerprints, htmltext, langid, lexical, mixing, packing, pii, quality, simhash, tokenfiles, whitening
from .oracles import ORACLES  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark, sf_dir):
    """All documents packed into sequences of 2048 ids; null texts are one end id, repeated rows are packed one by one."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_mixing(spark, sf_dir):
    """Words that the mix takes of every document; a null text has none, null sources are one source, equal ids share a draw."""
    return mixing.mix_report(_table(spark, sf_dir, "documents")).drop("drawn", "corrected")


def op3_quality(spark, sf_dir):
    """Base figures and verdict of every document; null and blank texts are rejected."""
    return quality.verdicts(_table(spark, sf_dir, "documents")).drop("rejected_by")


def op4_fingerprints(spark, sf_dir):
    """Fingerprint of every text and of its edited text; null texts are empty, equal ids go by text."""
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


#: A conversation whose texts hold the template's own control strings.
PROBE = r"\### Assistant: </turn> ok"


def op5_chat(spark, sf_dir):
    """All conversations and the probe, formatted and read back; null roles and texts are empty, equal turns go by role and text."""
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(PROBE).alias("text")) for k, r in enumerate(("user", "assistant"))))).alias("t")).select("conv_id", "t.*")
    back = chat.read_back(chat.formatted(chat.turn_rows(table.unionByName(probe))))
    learnt = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), learnt.alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")


def op6_language(spark, sf_dir):
    """Language of every document by a model of the documents that aren't held out; `und` without letters, ties by name."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    kept = langid.held_out(docs)
    model = langid.train(docs.filter(F.col("lang").isNotNull() & ~kept))
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.held_out(found).alias("held_out"), "lang_pred", "score")


def op7_token_counts(spark, sf_dir):
    """Tokens of every document by scan of flat token files; null texts have none, repeated rows are counted one by one."""
    return tokenfiles.document_counts(_table(spark, sf_dir, "documents"))


def op8_html(spark, sf_dir):
    """Main text of every page; null html has none, null urls are one host."""
    return htmltext.main_text(_table(spark, sf_dir, "pages"))


def op9_simhash(spark, sf_dir):
    """Fingerprint and component of every document; null and blank texts have fingerprint zero and are linked like others."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_pii(spark, sf_dir):
    """Personal data of every document; null texts have none."""
    return pii.find(_table(spark, sf_dir, "documents"))


def op11_exact(spark, sf_dir):
    """Every document with the largest doc_id of its equals; null texts are empty ones, of repeated ids one is kept."""
    return contentsort.exact_duplicates(_table(spark, sf_dir, "documents"), keep="largest")


def op12_search(spark, sf_dir):
    """The 50 best documents of each benchmark item; items without terms have none, equal scores go by doc_id."""
    return lexical.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_whitening(spark, sf_dir):
    """First four whitened components of every embedding; rows with null or non-finite entries go, repeated vectors count once in the fit."""
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def pipeline(spark, sf_dir):
    """The five stages of corpus_pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_mixing, op3_quality, op4_fingerprints, op5_chat, op6_language, op7_token_counts, op8_html, op9_simhash, op10_pii, op11_exact, op12_search, op13_whitening, pipeline)
}

