"""A cache that stays between runs: entries by key in buckets, of which a write touches only its own.

A write goes to a folder of its own first (_pending), whole, and then over the buckets it touches. A run that stops in between
leaves either no complete pending write, and the cache is as it was, or one, and readers see it in place of its buckets until the next
write puts it there. So a batch that is written twice, or once more after a crash, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .files import latest, store

BUCKETS = 64
_PENDING = "_pending"


def _there(uri: str) -> bool:
    disk, path = store(uri)
    return disk.get_file_info(path).type.name != "NotFound"


def _drop(uri: str) -> None:
    disk, path = store(uri)
    if _there(uri):
        disk.delete_dir(path)


def _rows(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    kept = StructType([*schema.fields, StructField("_bucket", IntegerType())])
    return spark.read.schema(kept).parquet(folder) if _there(folder) else spark.createDataFrame([], kept)


def _complete(folder: str) -> bool:
    return _there(f"{folder}/{_PENDING}/_SUCCESS")


def read_cache(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The entries of a cache, none where the folder isn't there; a complete pending write counts."""
    held = _rows(spark, folder, schema)
    if _complete(folder):
        new = _rows(spark, f"{folder}/{_PENDING}", schema)
        held = held.join(F.broadcast(new.select("_bucket").distinct()), "_bucket", "left_anti").unionByName(new)  # BUCKETS rows at most
    return held.select(*schema.names)


def _apply(spark: SparkSession, folder: str, schema: StructType) -> None:
    """Puts a complete pending write over its buckets; the same however often it is done."""
    if _complete(folder):
        pending = _rows(spark, f"{folder}/{_PENDING}", schema)
        pending.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(folder)
    _drop(f"{folder}/{_PENDING}")


def write_cache(new: DataFrame, folder: str, key: str, order: str, buckets: int = BUCKETS) -> None:
    """Adds entries to a cache, which is made if it isn't there; of equal keys that with the highest order stays, of equal orders the new one.

    Only buckets with new keys are read and written. One writer at a time. Null keys are entries of one key. No new entries change nothing.
    """
    spark, schema = new.sparkSession, new.schema
    _apply(spark, folder, schema)  # what a run before this one left
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    own = new.withColumn("_bucket", bucket)
    touched = [r[0] for r in own.select("_bucket").distinct().collect()]  # `buckets` rows at most
    if not touched:
        return
    old = _rows(spark, folder, schema).filter(F.col("_bucket").isin(touched))  # other buckets aren't listed
    nth = latest(old, own, key, order)
    once = nth.dropDuplicates([key])  # of new entries that tie one stays
    once.repartition("_bucket").write.mode("overwrite").parquet(f"{folder}/{_PENDING}")
    _apply(spark, folder, schema)


def expire(spark: SparkSession, folder: str, schema: StructType, order: str, least) -> None:
    """Removes entries whose order is below `least`; only buckets that hold such are written, those left empty go."""
    _apply(spark, folder, schema)
    rows = _rows(spark, folder, schema)
    old = F.coalesce(F.col(order) < F.lit(least), F.lit(False))
    touched = [tuple(r) for r in rows.groupBy("_bucket").agg(F.count_if(old).alias("old"), F.count_if(~old).alias("kept")).filter("old > 0").collect()]
    left = [b for b, _, kept in touched if kept]
    if left:
        rows.filter(F.col("_bucket").isin(left) & ~old).repartition("_bucket").write.mode("overwrite").parquet(f"{folder}/{_PENDING}")
        _apply(spark, folder, schema)
    for b, _, kept in touched:
        if not kept:
            _drop(f"{folder}/_bucket={b}")
