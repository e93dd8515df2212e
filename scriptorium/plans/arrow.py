"""One pass of numpy or plain Python over Arrow batches, for the few steps that column expressions can't say."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from .session import reachable


#: Rows of a batch, set for the session: texts may be long, and a worker holds a batch.
BATCH_ROWS = 256


def over_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list | None]], schema: str | StructType) -> DataFrame:
    """make() runs once in each task; what it returns turns a batch into columns, or None for no rows."""
    reachable(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches):
        step = make()
        for batch in batches:
            out = step(batch) if batch.num_rows else None
            if out is not None:
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)

    return df.mapInArrow(run, kind)


def over_texts(text: Column, step: Callable[[pa.Array], pa.Array]) -> Column:
    """A column of strings, batch by batch."""
    spark = SparkSession.active()
    reachable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def run(texts: pa.Array) -> pa.Array:
        return step(texts)

    return F.arrow_udf(run, "string")(text)
