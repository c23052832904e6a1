"""Whitening of embeddings by their principal components, with Spark's ``BlockMatrix``.

1. Vectors become whole numbers (``floor(64 * c) + 1000000``), so counts, sums and deviations are exact. Distinct vectors
   are the fit list; its rows and all rows are packed into numbered blocks, each task into its own, and stored.
2. Blocks of the fit list, centred by the exact sums, make a ``BlockMatrix`` of one column of blocks. Its transpose times itself
   is the scatter; the middle dimension is split over tasks, so no task gets more than its share of the blocks.
3. ``eigh`` of the small scatter gives the whitening matrix. All blocks lie in a square grid, which a ``BlockMatrix`` with the
   whitening matrix down its diagonal projects: a grid has as many tasks as there are partitions, a column their root.

Blocks that a task can't fill end with rows of zeros, which change neither product. The driver holds the numbers of the blocks
(``BlockMatrix`` does), at most ``MAX_BLOCKS``, one matrix of dimension x dimension, and sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from bioloom.session import stored

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this, times ``SCALE``, count as this much.
LARGEST = 1 << 45
#: Entries of a block, as far as there are at most so many blocks.
BLOCK_CELLS, MAX_BLOCKS = 1 << 17, 1 << 20
#: Bytes of blocks that one task multiplies for the scatter.
TASK_BYTES = 64 << 20
#: Components of a smaller share of the largest eigenvalue are rounding and have no whitened form.
LEAST_SHARE = 1e-10

_INDEXED = StructType([StructField("_1", StructType([StructField("_1", LongType()), StructField("_2", LongType())])), StructField("_2", MatrixUDT())])
_MATRIX = pa.struct([("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())), ("rowIndices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_())])


class Fit(NamedTuple):
    """What whitening knows of the fit list: its size, exact sums, eigenvectors by column, eigenvalues and the trace of the covariance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def matrix(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def whole_numbers(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """``key, x`` of the rows whose vector has only finite entries: each entry times 64, rounded down, plus a million."""
    entries = F.col(f"`{column}`").cast("array<double>")
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform("entries", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("long") + SHIFT)
    return vectors.select(F.col(f"`{key}`").alias("key"), entries.alias("entries")).where(F.col("entries").isNotNull() & finite).select("key", scaled.alias("x"))


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _packed(rows: DataFrame, width: int, height: int) -> DataFrame:
    """Rows of vectors as stored blocks of up to ``height``: ``block`` (numbered from 0 without gaps), ``keys``, ``cells``."""
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[pa.Array] = []
        cells: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            ids, data = pa.concat_arrays(keys), np.concatenate(cells)
            keys.clear()
            cells.clear()
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([data.astype("<i8").tobytes()], pa.binary())], ["keys", "cells"])

        held = 0
        for batch in batches:
            data = _numbers(batch.column(1), width)
            at = 0
            while at < len(data):
                take = min(height - held, len(data) - at)
                keys.append(batch.column(0).slice(at, take))
                cells.append(data[at : at + take])
                held, at = held + take, at + take
                if held == height:
                    yield block()
                    held = 0
        if held:
            yield block()

    made = stored(rows.mapInArrow(run, f"keys array<{kind}>, cells binary").withColumn("at", F.monotonically_increasing_id()), "blocks")
    # The upper bits of these ids are the task that wrote the block, the lower 33 its place there. There is a row a task.
    task = F.shiftrightunsigned("at", 33)
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = made.groupBy(task.alias("task")).count().select("task", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("first"))
    number = F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return made.join(F.broadcast(first), task == F.col("task")).select(number.alias("block"), "keys", "cells")


def _integers(cells: pa.Scalar, width: int) -> np.ndarray:
    return np.frombuffer(cells.as_buffer(), "<i8").reshape(-1, width)


def _sums(blocks: DataFrame, width: int) -> tuple[int, list[int]]:
    """How many vectors the blocks hold and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cells in batch.column(0):
                data = _integers(cells, width)
                sums = [len(data), *data.sum(axis=0).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), pa.array(sums, pa.int64())], ["at", "value"])

    rows = blocks.select("cells").mapInArrow(run, "at int, value long").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    found = {r["at"]: int(r["value"]) for r in rows}
    return found.get(0, 0), [found.get(i + 1, 0) for i in range(width)]


def differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exact: longs, or Python's integers where a long may not hold them."""
    if n * (LARGEST + SHIFT) < 1 << 62 or (x.size and n * int(np.abs(x).max()) < 1 << 62):
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sum of squared differences of each row; none where it is no long."""
    apart = differences(x, n, sums)
    about = (apart.astype(np.float64) ** 2).sum(axis=1)
    if apart.dtype != object and (about < 1 << 62).all():
        return (apart * apart).sum(axis=1).tolist()
    exact = [sum(int(v) ** 2 for v in row) if near < 1 << 64 else None for row, near in zip(apart, about.tolist(), strict=True)]
    return [v if v is not None and v < 1 << 63 else None for v in exact]


def _matrix(blocks: DataFrame, place: Callable[[int], tuple[int, int]], width: int, height: int, fit: tuple[int, list[int]]) -> DataFrame:
    """Centred blocks at their places, as rows of a ``BlockMatrix``."""
    n, sums = fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                centred = np.zeros((height, width))
                x = _integers(cells, width)
                centred[: len(x)] = differences(x, n, sums).astype(np.float64) / n
                yield _one_block(place(number), centred)

    return blocks.select("block", "cells").mapInArrow(run, _INDEXED)


def _one_block(place: tuple[int, int], cells: np.ndarray) -> pa.RecordBatch:
    """A dense block, row by row (which Spark calls transposed)."""
    values = pa.ListArray.from_arrays([0, cells.size], pa.array(cells.ravel()))
    nothing = pa.array([None], pa.list_(pa.int32()))
    parts = [pa.array([1], pa.int8()), pa.array([cells.shape[0]], pa.int32()), pa.array([cells.shape[1]], pa.int32()), nothing, nothing, values, pa.array([True])]
    at = pa.array([{"_1": place[0], "_2": place[1]}], pa.struct([("_1", pa.int64()), ("_2", pa.int64())]))
    return pa.RecordBatch.from_arrays([at, pa.StructArray.from_arrays(parts, fields=list(_MATRIX))], ["_1", "_2"])


def _block_matrix(blocks: DataFrame, height: int, width: int, rows: int, columns: int) -> BlockMatrix:
    """A ``BlockMatrix`` of a DataFrame's blocks; its own constructor would pickle every number."""
    return BlockMatrix(callMLlibFunc("createBlockMatrix", blocks, height, width, rows, columns), height, width, rows, columns)


def _multiply(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """The product with the middle dimension split over tasks, an option that Python's ``multiply`` doesn't pass on."""
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def components(scatter: np.ndarray, n: int, sums: list[int], most: int) -> Fit:
    """Eigenvectors and eigenvalues of the covariance, by falling eigenvalue; of each the largest entry is positive."""
    covariance = (scatter + scatter.T) / (2 * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    # A dimension without any spread leaves no component at all.
    some = int(((values > 0) & (values >= LEAST_SHARE * max(values[0], 0.0)))[:most].sum())
    vectors = vectors[:, :some] * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0)[0] < 0, -1.0, 1.0)[:some]
    return Fit(n, sums, vectors, values[:some].copy(), float(np.trace(covariance)))


def _projected(spark: SparkSession, blocks: DataFrame, many: int, width: int, height: int, fit: Fit) -> DataFrame:
    """``block, cells``: the rows of each block times the whitening matrix, stored."""
    side = max(1, math.isqrt(many - 1) + 1)
    weights, kept = fit.matrix, fit.matrix.shape[1]

    def diagonal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield _one_block((i, i), weights)

    grid = _block_matrix(_matrix(blocks, lambda b: (b // side, b % side), width, height, (fit.n, fit.sums)), height, width, -(-many // side) * height, side * width)
    whitening = _block_matrix(spark.range(side).mapInArrow(diagonal, _INDEXED), width, kept, side * width, side * kept)
    found = callMLlibFunc("getMatrixBlocks", grid.multiply(whitening)._java_matrix_wrapper._java_model)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                cells = block["values"].values.to_numpy(zero_copy_only=False)
                cells = cells.reshape(height, kept) if block["isTransposed"].as_py() else cells.reshape(kept, height).T
                packed = np.ascontiguousarray(cells, "<f8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([place["_1"] * side + place["_2"]], pa.int64()), pa.array([packed], pa.binary())], ["block", "cells"])

    return stored(found.mapInArrow(plain, "block long, cells binary"), "projected")


def _identity_error(projected: DataFrame, fit: Fit) -> float:
    """The largest entry of what the covariance of the projected fit list differs from the identity by."""
    kept = len(fit.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                cells = np.frombuffer(packed.as_buffer(), "<f8").reshape(-1, kept)
                yield pa.RecordBatch.from_arrays([pa.array(range(kept * kept), pa.int32()), pa.array((cells.T @ cells).ravel())], ["at", "value"])

    sums = projected.select("cells").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    covariance = np.zeros(kept * kept)
    for row in sums:
        covariance[row["at"]] = row["value"] / fit.n
    return float(np.abs(covariance.reshape(kept, kept) - np.eye(kept)).max())


def fit_and_project(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", most: int = COMPONENTS, cells: int = BLOCK_CELLS) -> tuple[Fit, DataFrame | None, float]:
    """The fit, a row ``key, deviation, whitened`` (an array by component) of each vector with finite entries, and the identity error.

    Null vectors and those with null or infinite entries or none at all have no row, nor have those of another length than most (of
    equally many the longer). Each row counts once for itself and each distinct vector once for the fit; null and repeated keys
    stay. Fewer than two distinct vectors have no component, and then there are no rows. A component whose eigenvalue is below
    ``LEAST_SHARE`` of the largest has none either. ``deviation`` is null where a long can't hold it. Entries of over 2**45 / 64 count as
    that much. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    rows = whole_numbers(vectors, key, column)
    sizes = rows.where(F.size("x") > 0).groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    nothing = Fit(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    if not sizes:
        return nothing, None, 0.0
    width, many = sizes[0]["width"], sizes[0]["count"]
    height = max(1, cells // width, -(-2 * many // MAX_BLOCKS))
    rows = rows.where(F.size("x") == width)
    fitted = _packed(rows.select("x").distinct().select(F.lit(0).alias("key"), "x"), width, height)
    n, sums = _sums(fitted, width)
    fit_blocks = fitted.count()
    column_of_blocks = _block_matrix(_matrix(fitted, lambda b: (b, 0), width, height, (n, sums)), height, width, fit_blocks * height, width)
    splits = max(-(-2 * 8 * fit_blocks * height * width // TASK_BYTES), min(fit_blocks, spark.sparkContext.defaultParallelism))
    scatter = _multiply(column_of_blocks.transpose(), column_of_blocks, splits).toLocalMatrix().toArray()
    fit = components(scatter, n, sums, most)
    if not len(fit.values):
        return fit, None, 0.0
    own = _packed(rows, width, height)
    # Blocks of the fit list come first, then those of all rows; one product projects both.
    both = fitted.select("block", "cells").unionByName(own.select((F.col("block") + fit_blocks).alias("block"), "cells"))
    projected = _projected(spark, both, fit_blocks + own.count(), width, height, fit)
    error = _identity_error(projected.where(F.col("block") < fit_blocks), fit)
    kept, kind = len(fit.values), rows.schema["key"].dataType.simpleString()

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [deviations(_integers(c, width), n, sums) for c in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.int64()))], ["block", "keys", "deviations"])

    def by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, deviation, packed in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                cells = np.frombuffer(packed.as_buffer(), "<f8").reshape(-1, kept)[: len(keys)]
                whitened = pa.ListArray.from_arrays(np.arange(len(cells) + 1) * kept, pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([keys.values, deviation.values, whitened], ["key", "deviation", "whitened"])

    known = own.mapInArrow(measured, f"block long, keys array<{kind}>, deviations array<long>")
    joined = known.join(projected.select((F.col("block") - fit_blocks).alias("block"), F.col("cells").alias("projected")), "block")
    return fit, joined.select("keys", "deviations", "projected").mapInArrow(by_row, f"key {kind}, deviation long, whitened array<double>"), error


def whiten_embeddings(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row a vector and component: place on the component in its deviations, the component's share, and the fit's figures."""
    fit, rows, error = fit_and_project(vectors, key, column)
    kind = vectors.schema[key].dataType.simpleString()
    if rows is None:
        empty = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], empty)
    shares = F.array(*[F.lit(float(v / fit.trace)) for v in fit.values])
    by_component = rows.select(F.col("key").alias(key), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return by_component.select(
        key, (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, "at").alias("explained"),
        F.lit(error).alias("identity_error"),
    )
