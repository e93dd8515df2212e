"""Session set-up that operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: weakref.WeakSet = weakref.WeakSet()
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package if it isn't installed: from where the driver has it, and on a cluster from a copy that Spark ships to every executor, once."""
    sc = spark.sparkContext
    env = sc.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH")]))
    if not sc.master.startswith("local") and sc not in _SHIPPED:
        _SHIPPED.add(sc)
        archive = os.path.join(tempfile.mkdtemp(prefix="package-"), "scriptorium.zip")  # on the driver, which serves it
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, names in os.walk(os.path.join(ROOT, "scriptorium")):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.relpath(path, ROOT))
        sc.addPyFile(archive)
    return spark


def scratch(spark: SparkSession) -> str:
    """A new folder for files between two steps, within spark.checkpoint.dir, which the driver and all executors see.

    Only a local session that names no such folder gets a temporary one; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(named or tempfile.mkdtemp(prefix='scratch-')).rstrip('/')}/scriptorium-{uuid.uuid4().hex}"


#: Bytes of a table's files, as Spark estimates them, that one partition of spread() gets at most, and partitions for each core at least: some texts take longer.
SPREAD_BYTES, TASKS_A_CORE = 16 << 20, 2


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A table of files dealt over all cores by its keys, for long chains of expressions: as it lies it may be one row group and so one core's work, whatever its size."""
    return df.repartition(parts_of(df), *keys)


def parts_of(df: DataFrame) -> int:
    """In how many partitions spread() deals a table of files."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism, -(-size // SPREAD_BYTES))


def deal_to(spark: SparkSession, n: int) -> list[int]:
    """n numbers; repartition(n) by a column of them gives each its own partition, as their hashes differ modulo n."""
    found, seen = {}, 0
    while len(found) < n:
        held = spark.range(seen, seen + 64 * n, 1, 1).select(F.col("id").cast("int").alias("k"))
        for k, place in held.select("k", F.pmod(F.hash("k"), F.lit(n))).collect():
            found.setdefault(place, k)
        seen += 64 * n
    return [found[place] for place in range(n)]


def once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """df with a column that is computed once for each row, however often it is used.

    Catalyst merges projections and then repeats a long chain of expressions wherever its result is used; a generator of one row is
    a boundary that it doesn't merge.
    """
    return df.select("*", F.explode(F.array(column)).alias(name))
