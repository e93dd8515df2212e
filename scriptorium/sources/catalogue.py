"""Small tables beside the books: cache indexes, voices, models, image listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "image_path: string, description: string, confidence: double, model_used: string, timestamp: double"


def cache_index(index: DataFrame, column: str = "json") -> DataFrame:
    """(cache_key, entry) of JSON objects from key to entry; a broken index has no rows."""
    entries = F.from_json(F.col(column), f"map<string, struct<{ENTRY}>>", {"mode": "PERMISSIVE"})
    return index.select(F.explode(entries).alias("cache_key", "entry"))


def voices(files: DataFrame, static: list[str], path: str = "path") -> DataFrame:
    """Names of voice files (.pt), in order; the static list where there is none."""
    spark = files.sparkSession
    found = files.filter(F.col(path).endswith(".pt")).select(F.regexp_extract(path, r"([^/]*)\.pt$", 1).alias("voice")).distinct()
    listed = spark.createDataFrame([(v,) for v in static], "voice string")
    return (found if found.take(1) else listed).orderBy("voice")


def available(requests: DataFrame, catalogue: DataFrame, name: str) -> DataFrame:
    """Requests whose model or voice the catalogue has."""
    return requests.join(catalogue.select(name).distinct(), name, "left_semi")


def existing_images(images: DataFrame, files: DataFrame, path: str = "file_path") -> DataFrame:
    """Images with a path that the listing has."""
    return images.filter(F.coalesce(F.col(path), F.lit("")) != "").join(files.select(F.col("path").alias(path)).distinct(), path, "left_semi")


def image_fields(images: DataFrame, *keys: str) -> DataFrame:
    """keys, file_path, alt_text ('' where there is none), position and format of images."""
    return images.select(*keys, "file_path", F.coalesce("alt_text", F.lit("")).alias("alt_text"), "position", "format")


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and length of the files in a folder, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")
