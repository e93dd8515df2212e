"""Token counts of documents in flat, unindexed token files by separator scan.

A token file is a run of unsigned 16- or 32-bit ids in which an end-of-document id closes each document; nothing
says where documents begin. Files are read in blocks of equal size, each on its own and cut without regard to
documents: a vectorised search finds a block's separators, and what is left over at its two ends is stitched with
the neighbours' by a prefix scan over one summary of a few numbers for each block.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import reachable
from .common import checkpoint, file_system, gathered, map_batches, shared_folder, small_batches
from .tokenizing import AT_ONCE, WordTokenizer, worker_tokenizer

BLOCK_IDS = 1 << 18
#: Bytes of blocks that one task reads.
TASK_BYTES = 32 << 20
#: The end-of-document id of the default vocabulary.
END_ID = 49407


def id_width(tokenizer: str | None = None) -> int:
    """Bytes of an id in a token file of this vocabulary: 2 where all ids fit, else 4."""
    return 2 if WordTokenizer(tokenizer).size <= 1 << 16 else 4


def check_end(end_id: int, tokenizer: str | None = None) -> None:
    """An end-of-document id that a text could hold would cut documents: it must be a control token's or lie beyond the vocabulary, and fit the files' ids."""
    tok = WordTokenizer(tokenizer)
    special = {tok.tokenizer.token_to_id(t) for t in tok.special}
    if end_id < 0 or (end_id < tok.size and end_id not in special) or end_id >= 1 << (8 * id_width(tokenizer)):
        raise ValueError(f"{end_id} can't end documents: it is an ordinary id of this vocabulary, or no id of its files")


def write_files(docs: DataFrame, folder: str, end_id: int = END_ID, tokenizer: str | None = None, width: int = 2) -> DataFrame:
    """Writes one flat token file for each partition into a folder that all executors share; (file, nth, doc_id) of what went in.

    A text that holds a control token's string is ordinary text, so only document ends are separators. A task that
    is run again writes a file of its own; the manifest, which is checkpointed, names the files that count.
    """
    check_end(end_id, tokenizer)
    small_batches(reachable(docs.sparkSession))
    schema = pa.schema([("file", pa.string()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])

    def run(batches):
        task = TaskContext.get()
        own, name, nth = worker_tokenizer(tokenizer, plain=True), f"part-{task.partitionId():06d}-{task.taskAttemptId()}.ids", 0
        kind, out = f"<u{width}", None
        end = np.array([end_id], kind).tobytes()
        for batch in gathered(batches, AT_ONCE):
            if not batch.num_rows:
                continue
            if out is None:
                store, path = file_system(folder)
                store.create_dir(path)
                out = store.open_output_stream(f"{path}/{name}")
            for found in own.ids(batch.column(1)):
                out.write(np.frombuffer(found, "<u4").astype(kind).tobytes() + end)
            ids = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([nth]), pa.array([ids], pa.list_(pa.int64()))], schema=schema)
            nth += len(ids)
        if out is not None:
            out.close()

    written = checkpoint(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "file string, first long, doc_ids array<long>"))
    return written.select("file", "first", F.posexplode("doc_ids").alias("k", "doc_id")).select("file", (F.col("first") + F.col("k")).alias("nth"), "doc_id")


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def read_blocks(spark: SparkSession, path: str, block_ids: int = BLOCK_IDS, width: int = 2, only: DataFrame | None = None) -> DataFrame:
    """Blocks (file, block, block_ids) of flat files of any size: ranges, read one by one by the task that scans them.

    file is the whole path; `only` restricts files to names in its column file. Spark lists the files without
    reading them. The stores are those that pyarrow opens (local or mounted paths, hdfs, s3, gs).
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    if only is not None:
        names = only.select(F.col("file").alias("name")).distinct()
        files = files.join(names, _name(F.col("file")) == F.col("name"), "left_semi")
    size = block_ids * width
    files = checkpoint(files.filter("length > 0"))  # a row for each file
    total = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    ranges = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("block"), F.lit(block_ids).cast("long").alias("block_ids"))
    # neighbours of about a task's bytes stay together, and so does an opened file
    return ranges.repartition(tasks, "file", F.floor(F.col("block") * size / TASK_BYTES))


def scan_blocks(blocks: DataFrame, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """(file, block, at, n, ends): a block's place in its file, its ids and the places of its separators. A task holds one block at a time."""

    def make():
        opened = [None, None]

        def scanned(file: str, block: int, block_ids: int):
            if opened[0] != file:
                store, at = file_system(file)
                opened[:] = file, store.open_input_file(at)
            opened[1].seek(block * block_ids * width)
            ids = np.frombuffer(opened[1].read(block_ids * width), f"<u{width}")
            return file, block, block * block_ids, len(ids), np.flatnonzero(ids == end_id).tolist()

        return lambda batch: list(zip(*map(scanned, *(batch.column(k).to_pylist() for k in range(3)))))

    return map_batches(blocks, make, "file string, block long, at long, n long, ends array<int>")


def token_counts(blocks: DataFrame, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """(file, nth, start, n_tokens) of every document: ids before its end-of-document id, which isn't counted.

    Ids after a file's last separator are a document that isn't closed; it counts if it has any ids. Empty documents
    (two separators in a row) count 0. An empty file or no blocks give no rows.
    """
    scanned = checkpoint(scan_blocks(blocks, end_id, width))
    closed = F.size("ends")
    summary = scanned.select("file", "block", "at", "n", closed.alias("closed"), F.when(closed > 0, F.col("at") + F.element_at("ends", -1) + 1).alias("opens"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("file").orderBy("block")
    stitched = summary.select(
        "file", "block", F.coalesce(F.sum("closed").over(before), F.lit(0)).alias("docs"),
        F.coalesce(F.max("opens").over(before), F.lit(0)).alias("open"),  # where the document that reaches into the block began
        F.lead("block").over(after).isNull().alias("final"),
    )
    placed = scanned.join(stitched, ["file", "block"])
    starts = F.concat(F.array("open"), F.transform("ends", lambda e: F.col("at") + e + 1))
    stops = F.concat(F.transform("ends", lambda e: F.col("at") + e), F.when(F.col("final"), F.array(F.col("at") + F.col("n"))).otherwise(F.array().cast("array<bigint>")))
    spans = placed.select("file", "docs", F.size("ends").alias("closed"), F.posexplode(F.arrays_zip(F.slice(starts, F.lit(1), F.size(stops)).alias("start"), stops.alias("stop"))).alias("k", "s"))
    counted = spans.select("file", (F.col("docs") + F.col("k")).alias("nth"), F.col("s.start").alias("start"), (F.col("s.stop") - F.col("s.start")).alias("n_tokens"), (F.col("k") < F.col("closed")).alias("ended"))
    return counted.filter(F.col("ended") | (F.col("n_tokens") > 0)).drop("ended")


def remove_files(folder: str) -> None:
    """Removes a finished run's token files, once its counts are written elsewhere."""
    store, path = file_system(folder)
    store.delete_dir(path)


def document_counts(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS, folder: str | None = None) -> DataFrame:
    """doc_id, file, nth, start, n_tokens of every row, through flat token files in the shared folder (or the one given) and their scan.

    Null and empty texts have no tokens. Rows with equal or null ids are counted one by one. Extra columns are
    ignored; no documents, no rows. The files stay until their owner clears them: remove_files does, for a folder that was given.
    """
    spark = docs.sparkSession
    folder, width = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}", id_width(tokenizer)
    manifest = write_files(docs, folder, end_id, tokenizer, width)
    store, path = file_system(folder)
    store.create_dir(path)  # no documents, no files
    blocks = read_blocks(spark, folder, block_ids, width, manifest)
    counts = token_counts(blocks, end_id, width).withColumn("file", _name(F.col("file")))
    return counts.join(manifest, ["file", "nth"]).select("doc_id", "file", "nth", "start", "n_tokens")
