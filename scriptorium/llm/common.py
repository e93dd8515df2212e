"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..plans.session import reachable

#: ASCII white space, the separators of a "word" ([^\x20\x09-\x0D]+). bytes.split() cuts at exactly these six.
SPACES = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD)

#: Rows of one Arrow batch; long texts make small batches necessary, for an executor's memory.
BATCH_ROWS = 256


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds what a Python worker holds at once, by rows (Spark bounds it by bytes too where it can).

    The setting is the session's and stays: Spark reads it when a plan runs, which is after it was made.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_folder(spark: SparkSession) -> str:
    """This run's folder within spark.checkpoint.dir, which all executors and the driver see.

    Only a local session that names no folder (tests on one machine) gets a temporary one; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage with a copy in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it; any store that pyarrow opens."""
    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri)


#: Keys with more than a HOT-th of the rows are hot; there are fewer than HOT of them, whatever the data.
HOT = 1000


def join_keyed(big: DataFrame, small: DataFrame, key: str, count: str) -> DataFrame:
    """big joined with small, which has one row for each key and in `count` the rows of big with that key.

    The hot keys' rows of small are broadcast, so that big's rows stay where they are, and the others meet by shuffle. Both
    are read twice: give checkpoints.
    """
    total = small.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(small.filter(F.col(count) * HOT > total).drop(count))
    cold = small.filter(F.col(count) * HOT <= total).drop(count)
    return big.join(hot, key).unionByName(big.join(hot.select(key), key, "left_anti").join(cold, key))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until df has no such column."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        out.append(name)
    return out


def struct(schema: str | StructType) -> StructType:
    return schema if isinstance(schema, StructType) else _parse_datatype_string(schema)


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold `size` bytes, so that work for different values of a batch is done less often."""
    held, held_bytes = [], 0
    for batch in batches:
        held.append(batch)
        held_bytes += batch.nbytes
        if held_bytes >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, held_bytes = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


#: What frees the caches that a worker keeps from task to task; a worker may next serve an operator that has no use for them.
CACHES: list[Callable[[], None]] = []


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list | pa.RecordBatch | None]], schema: str | StructType, gather: int = 0, caches: bool = False) -> DataFrame:
    """One pass over Arrow batches, of `gather` bytes or more if given: make() runs once in each task, what it returns turns a batch into columns.

    A worker's caches are freed first, unless they serve this operator. Sets the session's rows of an Arrow batch, see small_batches.
    """
    small_batches(reachable(df.sparkSession))
    arrow = to_arrow_schema(struct(schema))

    def run(batches):
        if not caches:
            for free in CACHES:
                free()
            pa.default_memory_pool().release_unused()
        step = make()
        for batch in gathered(batches, gather) if gather else batches:
            if batch.num_rows:
                out = step(batch)
                if isinstance(out, pa.RecordBatch):
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out.columns, arrow)], schema=arrow)
                elif out is not None:
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)
