"""Whitening of embeddings by a tiled covariance.

A vector becomes whole numbers x = floor(256 * c). The fit list is each different x once. Its dimensions are cut into
tiles, and a pair of tiles is a key: rows are gathered to row-blocks, a row-block's columns of one tile (a column block) go
to every pair that its tile belongs to, and where both column blocks of a row-block meet they are centred, multiplied
and added up. A task so holds one tile product and two column blocks, however many dimensions and rows there are. Pairs are salted by
row-block, since there are few of them. Only the sums of tiles, D * D numbers, come to the driver, which assembles the
covariance and takes its eigenvectors; D is MAX_DIMENSIONS at most.

Column blocks carry x in two bytes an entry where that holds them and eight where not.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import reachable
from .common import CACHES, checkpoint, gathered, small_batches

SCALE, COMPONENTS = 256, 4
#: Columns of a tile, rows of a row-block, and dimensions that the driver's D x D matrix is made for.
TILE, BLOCK_ROWS, MAX_DIMENSIONS = 32, 512, 4096
#: Rows from which on a pair of tiles is worth another task; each one hands on a tile of sums.
SALT_ROWS = 8192
#: Components whose eigenvalue is below this share of the greatest are flat: nothing to scale.
FLAT = 1e-12


class Whitening(NamedTuple):
    """n vectors of the fit list, their sums S, components as rows, eigenvalues, shares of the trace, and the largest deviation of whitened from identity."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float


def _run(df: DataFrame, run, schema: str, gather: int = 0) -> DataFrame:
    small_batches(reachable(df.sparkSession), BLOCK_ROWS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for free in CACHES:
            free()
        yield from run(gathered(batches, gather) if gather else batches)

    return df.mapInArrow(task, schema)


def encode(x: np.ndarray) -> bytes:
    """One vector of whole numbers: a byte for the width and little-endian entries; equal vectors have equal bytes."""
    small = not len(x) or (x.min() >= -(1 << 15) and x.max() < 1 << 15)
    return b"\x02" + x.astype("<i2").tobytes() if small else b"\x08" + x.astype("<i8").tobytes()


def decode(cells: bytes, width: int) -> np.ndarray:
    """The vector in `width` dimensions; a shorter one has zeros at its end."""
    x = np.frombuffer(cells, "<i2" if cells[0] == 2 else "<i8", offset=1).astype(np.int64)
    return x if len(x) == width else np.concatenate([x, np.zeros(width - len(x), np.int64)])


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.stack([decode(c.as_py(), width) for c in column])


def integral(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, cells, width) of the rows whose vector is there with finite entries whose x is a long; the others go."""

    def run(batches):
        for batch in batches:
            kept, cells, width = [], [], []
            column = batch.column(1)
            flat = column.flatten()
            at = np.cumsum([0, *(v or 0 for v in column.value_lengths().to_pylist())])
            bad = np.asarray(flat.is_null().to_numpy(zero_copy_only=False), bool)
            x = np.floor(SCALE * flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64))
            bad |= ~(np.abs(x) < 2.0**63)  # NaN and infinities too
            x = np.where(bad, 0, x).astype(np.int64)
            before = np.concatenate([[0], np.cumsum(bad)])
            for k in np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False)):
                a, b = at[k], at[k + 1]
                if before[a] == before[b]:
                    kept.append(k)
                    cells.append(encode(x[a:b]))
                    width.append(b - a)
            if kept:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.array(cells, pa.binary()), pa.array(width, pa.int32())], names=["vec_id", "cells", "width"])

    chosen = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("embedding"))
    return _run(chosen, run, "vec_id long, cells binary, width int")


def _sums(fit: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """Number of vectors and the exact sum of each dimension."""

    def run(batches):
        n, total = 0, [0] * width
        for batch in batches:
            x = matrix(batch.column(0), width)
            n += len(x)
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            total = [t + (int(h) << 32) + int(v) for t, h, v in zip(total, high, low)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([str(v) for v in (n, *total)])], names=["dimension", "total"])

    rows = _run(fit.select("cells"), run, "dimension int, total string").groupBy("dimension").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # a row for each dimension
    found = {r.dimension: int(r.total) for r in rows}
    return found.get(-1, 0), np.array([found.get(d, 0) for d in range(width)], object)


def _column_blocks(fit: DataFrame, width: int, tile: int, salts: int) -> DataFrame:
    """(i, j, salt, row_block, side, cells, n_rows): every column block once for each pair of tiles that it belongs to."""
    tiles = -(-width // tile)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for nth, batch in enumerate(batches):
            x, block = matrix(batch.column(0), width), (part << 32) + nth
            rows = []
            for t in range(tiles):
                cells = encode(x[:, t * tile : (t + 1) * tile].ravel())
                for other in range(tiles):
                    rows.append((min(t, other), max(t, other), int(t > other), cells))
            i, j, side, cells = zip(*rows)
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([(part * 31 + nth) % salts] * n, pa.int32()), pa.array([block] * n, pa.int64()), pa.array(side, pa.int32()), pa.array(cells, pa.binary()), pa.array([len(x)] * n, pa.int32())],
                names=["i", "j", "salt", "row_block", "side", "cells", "n_rows"],
            )

    return _run(fit.select("cells"), run, "i int, j int, salt int, row_block long, side int, cells binary, n_rows int")


def covariance(fit: DataFrame, n: int, sums: np.ndarray, tile: int = TILE) -> np.ndarray:
    """D x D covariance, divisor n, of the fit list (cells): tile products of centred column blocks, summed by tile."""
    width = len(sums)
    pairs = -(-width // tile) * (-(-width // tile) + 1) // 2
    partitions = int(fit.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = max(1, min(-(-4 * partitions // pairs), -(-n // SALT_ROWS)))
    mean = np.array([int(s) / n for s in sums])

    def run(batches):
        key, product, left = None, None, None
        for batch in batches:
            for i, j, salt, block, side, cells, rows in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (i, j, salt):
                    if key:
                        yield _tile(key, product)
                    key, product = (i, j, salt), 0.0
                t = j if side else i
                x = decode(cells, rows * min(tile, width - t * tile)).reshape(rows, -1) - mean[t * tile : (t + 1) * tile]
                if i == j:
                    product = product + x.T @ x
                elif side:  # the left block of this row-block came just before
                    product = product + left.T @ x
                else:
                    left = x
        if key:
            yield _tile(key, product)

    blocks = _column_blocks(fit, width, tile, salts).repartition("i", "j", "salt").sortWithinPartitions("i", "j", "salt", "row_block", "side")
    partial = _run(blocks, run, "i int, j int, cell int, total double")
    whole = partial.groupBy("i", "j", "cell").agg(F.sum("total").alias("total")).collect()  # D * D / 2 numbers and half a tile's at most
    out = np.zeros((width, width))
    for i, j, cell, total in whole:
        a, b = divmod(cell, min(tile, width - j * tile))
        out[i * tile + a, j * tile + b] = out[j * tile + b, i * tile + a] = total / n
    return out


def _tile(key: tuple, product: np.ndarray) -> pa.RecordBatch:
    n = product.size
    return pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.int32()), pa.array([key[1]] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(product.ravel())], names=["i", "j", "cell", "total"])


def _scales(model: Whitening) -> np.ndarray:
    """1 / sqrt(e) of each component, 0 for flat ones."""
    e = model.eigenvalues
    flat = e <= FLAT * max(float(e[0]) if len(e) else 0.0, 0.0)
    return np.where(flat, 0.0, 1 / np.sqrt(np.where(flat, 1.0, e)))


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """Measured over the fit list: whitened once more, its covariance summed, against the identity; flat components are left out."""
    k, mean, scale = len(model.components), np.array([int(s) / model.n for s in model.sums]), _scales(model)

    def run(batches):
        product, total = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            z = ((matrix(batch.column(0), len(mean)) - mean) @ model.components.T) * scale
            product, total = product + z.T @ z, total + z.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k + k), pa.int32()), pa.array([*product.ravel(), *total])], names=["cell", "total"])

    cells = {r.cell: r.total for r in _run(fit.select("cells"), run, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect()}
    got = np.array([cells.get(c, 0.0) for c in range(k * k + k)]) / model.n
    centre = got[k * k :]
    gap = np.abs(got[: k * k].reshape(k, k) - np.outer(centre, centre) - np.diag((scale > 0).astype(float)))
    return float(gap.max(initial=0.0))


def fit(x: DataFrame, components: int = COMPONENTS, tile: int = TILE) -> Whitening | None:
    """The whitening of rows (cells, width) of `integral`; None without rows. Vectors that are shorter than the longest count as zero in what they lack."""
    width, least = x.agg(F.max("width"), F.min("width")).first()
    if width is None:
        return None
    if width > MAX_DIMENSIONS:
        raise ValueError(f"{width} dimensions; the driver's matrix is made for {MAX_DIMENSIONS}")
    listed = checkpoint((x.select("cells") if least == width else _padded(x, width)).distinct())
    n, sums = _sums(listed, width)
    v = covariance(listed, n, sums, tile)
    e, vectors = np.linalg.eigh(v)
    first = np.argsort(-e, kind="stable")[: min(components, width)]
    e = np.maximum(e, 0.0)
    trace = float(np.trace(v))
    explained = e[first] / trace if trace > 0 else np.zeros(len(first))
    model = Whitening(n, sums, vectors[:, first].T.copy(), e[first], explained, 0.0)
    return model._replace(identity_error=_identity_error(listed, model))


def _padded(x: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encode(decode(c.as_py(), width)) for c in batch.column(0)], pa.binary())], names=["cells"])

    return _run(x.select("cells"), run, "cells binary")


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Sum over dimensions of (n * x - S)**2, exact."""
    bound = n * int(np.abs(x).max(initial=0)) + max((abs(int(s)) for s in sums), default=0)
    if bound * bound * max(len(sums), 1) < 1 << 62:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    return [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]


def whiten(x: DataFrame, model: Whitening | None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row of x and component.

    A component without variance whitens to 0. A deviation beyond a long is null. Rows with equal or null ids are kept;
    without a model (no rows) there are none.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.sums):
        return x.sparkSession.createDataFrame([], schema)
    sent = x.sparkSession.sparkContext.broadcast(model)  # D * (components + 1) numbers

    def run(batches):
        own = sent.value
        k, mean, scale = len(own.components), np.array([int(s) / own.n for s in own.sums]), _scales(own)
        for batch in batches:
            cells = matrix(batch.column(1), len(mean))
            z = ((cells - mean) @ own.components.T) * scale
            far = [d if d < 1 << 63 else None for d in deviations(cells, own.n, own.sums)]
            rows = np.repeat(np.arange(len(cells)), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1), len(cells)), pa.int32()), pa.array([own.n] * len(rows), pa.int64()), pa.array(far, pa.int64()).take(pa.array(rows)), pa.array(z.ravel()), pa.array(np.tile(own.explained, len(cells))), pa.array([own.identity_error] * len(rows))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return _run(x.select("vec_id", "cells"), run, schema)


def whitened(vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Fit and application at once: see fit and whiten.

    Rows whose vector is null or has null or non-finite entries, or ones whose x is no long, go; empty vectors have zeros in all dimensions.
    Repeated vectors count once in the fit, whatever their number. Extra columns are ignored.
    """
    x = integral(vectors, id_column, column)
    return whiten(x, fit(x, components))
