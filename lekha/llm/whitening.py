"""Whitening of embeddings with MLlib block matrices.

Entries become integers, so counts, sums and squared deviations are exact. The
centred rows are indexed into a ``BlockMatrix``; its transpose times itself is
the scatter matrix, whose eigenvectors (``eigh`` on a dimension x dimension
array, the only thing the driver computes) form the whitening matrix; the
block matrix times that matrix is the projection, and the projection's own
transpose product measures how near its covariance comes to the identity.

A product lists its blocks on the driver, so rows are multiplied in slabs of at
most ``slab_rows`` rows: the slabs' scatter matrices add up, their projections
are a union. MLlib sends all blocks of one product entry to one task unless the
inner dimension is split; ``_times`` splits it.

Defined cases: rows whose vector is null, empty or holds null, NaN, infinite or
unrepresentable entries (2^56 or more in absolute value) are dropped, as are
vectors of another length than the commonest (ties: the longer). Null and
repeated ids and repeated rows are rows like any other. Directions without
variance (eigenvalue at most 1e-13 of the trace) give no component, so a table
of equal rows gives no rows, and neither does an empty one. Deviations are
decimals of 38 digits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

_POSITION = 33  # monotonically_increasing_id keeps a row's place in its partition in these low bits
_BLOCKS_A_TASK = 16


@dataclass
class Whitening:
    """``rows``: the kept columns, ``deviation`` and ``whitened`` (one entry per component); the rest holds for the whole table."""

    rows: DataFrame
    n: int
    eigenvalues: list[float]
    explained: list[float]
    identity_error: float


def _entries(batch: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    return pc.list_flatten(batch.column(name)).to_numpy(zero_copy_only=False).reshape(-1, d)


def _wide(x: np.ndarray, factor: int) -> np.ndarray:
    """Long entries, or Python integers where their product with ``factor`` may leave a long."""
    most = max((abs(int(v)) for v in (x.min(), x.max())), default=0) if x.size else 0
    return x if most * factor < 1 << 62 else x.astype(object)


def _sums(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, low, high = [0] * d, [None] * d, [None] * d
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _entries(batch, "x", d)
            total = [a + int(b) for a, b in zip(total, _wide(x, len(x)).sum(axis=0))]
            low = [int(b) if a is None else min(a, int(b)) for a, b in zip(low, x.min(axis=0))]
            high = [int(b) if a is None else max(a, int(b)) for a, b in zip(high, x.max(axis=0))]
        yield pa.record_batch({
            "pos": pa.array(range(d), pa.int32()), "total": pa.array(total, pa.decimal128(38, 0)),
            "low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64())})
    return run


def _centred(d: int, n: int, sums: Sequence[int], widest: int):
    """Adds each row's exact squared deviation and its entries less the mean, both from n * x - sum."""
    as_array = np.array(sums, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _entries(batch, "x", d)
            if max(n * widest, *map(abs, sums)) < 1 << 62:
                z = x * n - as_array.astype(np.int64)
            else:
                z = x.astype(object) * n - as_array
            far = _wide(z, d * max((abs(int(v)) for v in (z.min(), z.max())), default=0)) if z.size else z
            squares = pa.array([int(v) for v in (far * far).sum(axis=1)], pa.decimal128(38, 0))
            flat = pa.array((z / n).astype(np.float64).reshape(-1))
            centred = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, d), pa.int32()), flat)
            yield pa.record_batch({"id": batch.column("id"), "kept": batch.column("kept"), "deviation": squares, "centred": centred})
    return run


def _blocks(rows: DataFrame, n: int, d: int, per_block: int, wide: int) -> BlockMatrix:
    """``rows(index, vector)`` as blocks of ``per_block`` rows and ``wide`` columns."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("vector").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, d).toBlockMatrix(per_block, wide)


def _times(left: BlockMatrix, right: BlockMatrix, inner_blocks: int = 1) -> BlockMatrix:
    """left x right, its inner dimension dealt to as many tasks as its blocks need; sums of partial products follow."""
    splits = max(1, inner_blocks // _BLOCKS_A_TASK)
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def _square(m: BlockMatrix, inner_blocks: int) -> np.ndarray:
    return _times(m.transpose(), m, inner_blocks).toLocalMatrix().toArray()


def _slabs(sizes: list[tuple[int, int]], most: int) -> list[list[tuple[int, int]]]:
    """Neighbouring partitions (number, rows), cut before a slab would pass ``most`` rows; each keeps one at least."""
    out: list[list[tuple[int, int]]] = []
    held = 0
    for number, rows in sorted(sizes):
        if not out or held + rows > most:
            out.append([])
            held = 0
        out[-1].append((number, rows))
        held += rows
    return out


def whiten(table: DataFrame, vector: str = "embedding", keep: Sequence[str] = ("vec_id",), components: int = 32, scale: int = 64,
           shift: int = 1_000_000, slab_rows: int = 1 << 26, block_bytes: int = 4 << 20) -> Whitening:
    """Project every usable row of ``table`` on the leading unit eigenvectors of the covariance, each scaled to variance 1.

    Entries c count as floor(scale * c) + shift. Components are numbered by
    falling eigenvalue. See the module for what is dropped.
    """
    spark = table.sparkSession
    v = F.col("v")
    usable = F.coalesce(F.forall(v, lambda c: F.coalesce(F.abs(c) < float(1 << 56), F.lit(False))), F.lit(False)) & (F.size(v) > 0)
    rows = table.select(F.struct(*keep).alias("kept"), F.col(vector).cast("array<double>").alias("v")).where(usable)
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    kept_type = rows.schema["kept"].dataType.simpleString()
    if length is None:
        return Whitening(spark.createDataFrame([], f"kept {kept_type}, deviation decimal(38,0), whitened array<double>")
                         .select("kept.*", "deviation", "whitened"), 0, [], [], 0.0)
    d = length["d"]
    whole = F.transform(v, lambda c: F.floor(c * scale).cast("long") + shift)
    rows = stored(rows.where(F.size("v") == d).select(F.monotonically_increasing_id().alias("id"), "kept", whole.alias("x")),
                  "whitening-rows")

    partition = F.shiftright("id", _POSITION)
    sizes = [(r["p"], r["n"]) for r in rows.groupBy(partition.alias("p")).agg(F.count("*").alias("n")).collect()]
    n = sum(size for _, size in sizes)
    stats = (rows.select("x").mapInArrow(_sums(d), "pos int, total decimal(38,0), low long, high long")
             .groupBy("pos").agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
             .orderBy("pos").collect())
    sums = [int(r["total"]) for r in stats]
    widest = max(max(abs(r["low"]), abs(r["high"])) for r in stats)

    per_block, wide = max(16, block_bytes // (8 * d)), min(d, 1024)
    slabs = []
    for slab in _slabs(sizes, slab_rows):
        starts = np.cumsum([0] + [size for _, size in slab]).tolist()
        places = spark.createDataFrame([(p, start) for (p, _), start in zip(slab, starts)], "p long, start long")
        inside = F.col("id").between(slab[0][0] << _POSITION, ((slab[-1][0] + 1) << _POSITION) - 1)
        centred = (rows.where(inside)
                   .mapInArrow(_centred(d, n, sums, widest), f"id long, kept {kept_type}, deviation decimal(38,0), centred array<double>")
                   .join(F.broadcast(places), partition == F.col("p"))  # one row per partition of the table
                   .select((F.col("start") + F.col("id").bitwiseAND((1 << _POSITION) - 1)).alias("index"), "kept", "deviation",
                           F.col("centred").alias("vector")))
        slabs.append((centred, starts[-1], math.ceil(starts[-1] / per_block)))
    matrices = [_blocks(centred, size, d, per_block, wide) for centred, size, _ in slabs]

    covariance = sum(_square(m, blocks) for m, (_, _, blocks) in zip(matrices, slabs)) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")
    trace = float(np.trace(covariance))
    order = [k for k in order if values[k] > 1e-13 * trace][:components]
    if not order:
        return Whitening(rows.limit(0).select("kept.*", F.lit(None).cast("decimal(38,0)").alias("deviation"),
                                              F.lit(None).cast("array<double>").alias("whitened")), n, [], [], 0.0)
    weights = vectors[:, order] / np.sqrt(values[order])
    parts = [((i, 0), Matrices.dense(len(w), len(order), w.reshape(-1, order="F").tolist()))
             for i, w in enumerate(weights[at: at + wide] for at in range(0, d, wide))]
    whitener = BlockMatrix(spark.sparkContext.parallelize(parts, 1), wide, len(order), d, len(order))

    projections = [_times(m, whitener) for m in matrices]
    identity = sum(_square(p, blocks) for p, (_, _, blocks) in zip(projections, slabs)) / n
    out = None
    for projection, (centred, _, _) in zip(projections, slabs):
        projected = callMLlibFunc("getIndexedRows", projection.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
        whitened = projected.select("index", vector_to_array("vector").alias("whitened"))
        part = centred.drop("vector").join(whitened, "index").select("kept.*", "deviation", "whitened")
        out = part if out is None else out.unionAll(part)
    return Whitening(out, n, values[order].tolist(), (values[order] / trace).tolist(),
                     float(np.abs(identity - np.eye(len(order))).max()))
