"""Vector columns in tasks: the usable rows of an Arrow batch as matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, float64 matrix) for each length of vector; null, empty vectors and those with null or non-finite entries are left out."""
    column = column.cast(pa.list_(pa.float64()))
    values, offsets = column.values, column.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(offsets)
    good = np.isfinite(pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False))
    bad = np.concatenate([[0], np.cumsum(~good)])
    usable = column.is_valid().to_numpy(zero_copy_only=False) & (sizes > 0) & (bad[offsets[1:]] == bad[offsets[:-1]])
    flat = values.to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[usable]):
        rows = np.flatnonzero(usable & (sizes == size))
        yield rows, flat[offsets[rows][:, None] + np.arange(size)]


def coded(rows: DataFrame, encode: Callable[[np.ndarray], tuple[np.ndarray, list[bytes]]], id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, code) of the usable rows; encode gives the places of the matrix's rows that count and their codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, x in matrices(batch.column(1)):
                kept, codes = encode(x)
                dims = np.full(len(codes), x.shape[1], np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places[kept])), pa.array(dims), pa.array(codes, pa.binary())], names=["id", "dim", "code"])

    chosen = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    return chosen.mapInArrow(run, "id long, dim int, code binary")


def commonest_dim(distinct: DataFrame) -> int | None:
    """The number of entries that most of the rows (dim, ..) have; of equally common ones the largest; None without rows."""
    row = distinct.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    return row and row["dim"]
