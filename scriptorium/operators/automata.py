"""Finite automata over long streams of events: states by composed transitions, so that one key's events are many tasks' work.

An event is a map from each state to the next. Maps combine associatively: a block of events is one map, blocks are put together in order,
and each block is walked from the state that those before it lead to.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..plans.session import reachable

# What the message of a graphics error holds, in any of these spellings.
GRAPHICS_ERRORS = ("MTLCommandBuffer", "Metal", "failed assertion", "Completed handler", "commit call")
#: Graphics errors of an engine until it is given up.
MOST_ERRORS = 3


def _sorted(df: DataFrame, key: str, block: str, order: str) -> DataFrame:
    return df.repartition(key, block).sortWithinPartitions(key, block, order)


def states(df: DataFrame, key: str, block: str, order: str, move: str, start: int = 0) -> DataFrame:
    """df with state (int) after each event, by its map `move` (array<int>: the next state of each state, the same length everywhere); null maps change nothing.

    Events of a key go by block, then by order, which must tell a block's events apart. Blocks are any part of the events that are
    next to each other, such as days: the columns of a block's map are all that moves between them.
    """
    reachable(df.sparkSession)
    slim = StructType([df.schema[key], df.schema[block], StructField("_map", ArrayType(IntegerType()))])
    slim_arrow = to_arrow_schema(slim)

    def compose(batches):
        now, held, done = None, None, []
        for batch in batches:
            for k, b, m in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if now != (k, b):
                    if now is not None:
                        done.append((*now, held))
                    now, held = (k, b), None
                if m is not None:
                    held = m if held is None else [m[s] for s in held]
        if now is not None:
            done.append((*now, held))
        yield pa.RecordBatch.from_arrays([pa.array([d[c] for d in done], f.type) for c, f in enumerate(slim_arrow)], schema=slim_arrow)

    blocks = _sorted(df.select(key, block, order, move), key, block, order).select(key, block, move).mapInArrow(compose, slim)
    listed = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(block).alias("b"), F.col("_map").alias("m")))).alias("_l"))  # a map for each block
    after = lambda s, x: F.when(x["m"].isNull(), s).otherwise(F.element_at(x["m"], s + 1))
    walk = F.aggregate("_l", F.struct(F.lit(start).alias("s"), F.array().cast("array<int>").alias("all")), lambda a, x: F.struct(after(a["s"], x).alias("s"), F.concat(a["all"], F.array(a["s"])).alias("all")), lambda a: a["all"])
    starts = listed.select(F.col(key).alias("_key"), F.explode(F.arrays_zip(F.col("_l.b").alias("b"), walk.alias("s"))).alias("x")).select("_key", F.col("x.b").alias("_block"), F.col("x.s").alias("_start"))
    met = df.join(starts, df[key].eqNullSafe(starts["_key"]) & df[block].eqNullSafe(starts["_block"])).drop("_key", "_block")
    out = StructType([*df.schema.fields, StructField("state", IntegerType())])
    out_arrow = to_arrow_schema(out)
    at = {c: df.columns.index(c) for c in (key, block, move)}

    def apply(batches):
        now, state = None, start
        for batch in batches:
            keys, parts, maps, starts_ = (batch.column(c).to_pylist() for c in (at[key], at[block], at[move], batch.num_columns - 1))
            found = []
            for k, b, m, s in zip(keys, parts, maps, starts_):
                if now != (k, b):
                    now, state = (k, b), s
                state = state if m is None else m[state]
                found.append(state)
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns[:-1], out_arrow)), pa.array(found, pa.int32())], schema=out_arrow)

    return _sorted(met, key, block, order).mapInArrow(apply, out)


def graphics_error(message: Column) -> Column:
    found = F.lit(False)
    for phrase in GRAPHICS_ERRORS:
        found = found | message.contains(phrase)
    return F.coalesce(found, F.lit(False))


def degradation(df: DataFrame, key: str, block: str, order: str, message: str, most: int = MOST_ERRORS) -> DataFrame:
    """df with errors (graphics errors of the engine so far, `most` at most) and level: 0 as it is, 1 the plain way after the first, 2 given up after `most`.

    Messages of other kinds, null ones too, change nothing.
    """
    up = [min(s + 1, most) for s in range(most + 1)]
    moved = df.withColumn("_move", F.when(graphics_error(F.col(message)), F.array(*map(F.lit, up))))
    found = states(moved, key, block, order, "_move").drop("_move").withColumnRenamed("state", "errors")
    return found.withColumn("level", F.when(F.col("errors") == 0, 0).when(F.col("errors") < most, 1).otherwise(2))


def retry(level: Column, attempt: Column, failed: Column, retries: int = 3) -> Column:
    """What an engine does after an attempt (from 0): "done" if it didn't fail, "give up" at level 2, "again" at once after a graphics error, "wait" while attempts are left, else "fail".

    failed says what the attempt ended with: null, "graphics" or another class of error.
    """
    return F.when(failed.isNull(), "done").when(level >= 2, "give up").when((failed == "graphics") & (attempt < retries), "again").when(attempt < retries, "wait").otherwise("fail")
