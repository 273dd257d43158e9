"""Operator 11: whitening of embeddings by Chan's merging.

Vectors become whole numbers (floor of 256 times each entry). The fit list has
each distinct vector once: it comes from a grouping by the vectors' bytes, which
Spark sums before the shuffle, so copies never meet in one task. Each partition
of the list computes its count, local mean and centred scatter, block by block;
two such summaries merge by Chan's formula, and ``treeReduce`` merges those of
all partitions. One summary, d x d numbers, reaches the driver, which takes the
eigenvectors of the covariance. A second pass over the fit list projects it and
merges the summaries of the projected rows: their covariance must be the
identity, and its largest deviation is part of the result.

Sums are exact: summaries carry them as whole numbers beside the means.

Defined results: vectors that are null, empty or hold null or non-finite entries
give no rows; of vectors of different lengths only those of the length that most
distinct vectors have (the longer of equally common ones) take part; entries
beyond a 64-bit integer are its largest or smallest; repeated rows give rows
each; a null id stays null; a component without variance (a few equal vectors,
more components than vectors) has a null ``whitened``, explains nothing and is
left out of the identity's check (0 if no component has variance); a deviation
beyond a 64-bit integer is null; an empty table gives no rows; other columns are
ignored. Memory: blocks of at most BLOCK_BYTES and two summaries a task.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolith.llm.common import release, staged, table
from phonolith.llm.vectors import coded, commonest_dim

SCALE = 256
COMPONENTS = 4
#: Components whose variance is a smaller share of the largest have none: rounding of the eigenvalues.
LEAST_SHARE = 1e-12
BLOCK_BYTES = 4_000_000
LARGEST = (1 << 63) - 1
RESULT = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# --- vectors as whole numbers, and as bytes ---------------------------------------


def whole(c: np.ndarray) -> np.ndarray:
    """floor(256 * c) as 64-bit integers."""
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(SCALE * c)
        return np.where(x >= 2.0**63, LARGEST, np.where(x < -(2.0**63), -LARGEST - 1, x.astype(np.int64)))


def _encoded(c: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Each vector in the fewest bytes (1, 2, 4 or 8) that hold its entries; equal vectors have equal codes."""
    x = whole(c)
    low, high = x.min(axis=1), x.max(axis=1)
    width = np.select([(low >= -(1 << 8 * w - 1)) & (high < 1 << 8 * w - 1) for w in (1, 2, 4)], [1, 2, 4], 8)
    codes = np.empty(len(x), object)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        data, size, head = x[rows].astype(f"<i{w}").tobytes(), int(w) * x.shape[1], bytes([w])
        codes[rows] = [head + data[at : at + size] for at in range(0, len(data), size)]
    return np.arange(len(x)), codes.tolist()


def _decoded(codes: list[bytes], dim: int) -> np.ndarray:
    x = np.empty((len(codes), dim), np.int64)
    widths = np.array([c[0] for c in codes], np.int64)
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        x[rows] = np.frombuffer(b"".join([codes[i][1:] for i in rows]), f"<i{w}").reshape(len(rows), dim)
    return x


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, their vectors), of bounded size; the last column has the codes."""
    rows = max(1, BLOCK_BYTES // (8 * dim))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, _decoded(part.column(part.num_columns - 1).to_pylist(), dim)


# --- summaries ------------------------------------------------------------------


@dataclass(frozen=True)
class Summary:
    n: int
    #: Exact sums of each dimension, Python's whole numbers; None where rows are not whole.
    sums: np.ndarray | None
    mean: np.ndarray
    #: Sum of the products of the centred rows.
    scatter: np.ndarray


def summary(x: np.ndarray) -> Summary:
    sums = None
    if x.dtype == np.int64:
        # High and low halves apart, so that no sum overflows.
        sums = (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        mean = (sums / len(x)).astype(np.float64)
    else:
        mean = x.mean(axis=0)
    centred = x - mean
    return Summary(len(x), sums, mean, centred.T @ centred)


def merged(a: Summary, b: Summary) -> Summary:
    """Chan's formula for two summaries of different rows."""
    n, step = a.n + b.n, b.mean - a.mean
    sums = None if a.sums is None else a.sums + b.sums
    mean = a.mean + step * (b.n / n) if sums is None else (sums / n).astype(np.float64)
    return Summary(n, sums, mean, a.scatter + b.scatter + np.outer(step, step) * (a.n * b.n / n))


def summarised(fit: DataFrame, dim: int, project=None) -> Summary:
    """The summary of all rows (code) of fit, or of what project makes of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for _, x in _blocks(batches, dim):
            more = summary(x if project is None else project(x))
            own = more if own is None else merged(own, more)
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own)], pa.binary())], names=["summary"])

    rows = fit.select("code").mapInArrow(run, "summary binary").rdd
    return rows.map(lambda r: pickle.loads(r[0])).treeReduce(merged)


# --- the operator ------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """The fitted map. basis: unit eigenvectors as columns, by falling variance."""

    n: int
    sums: np.ndarray
    basis: np.ndarray
    variance: np.ndarray
    explained: np.ndarray

    @property
    def open(self) -> np.ndarray:
        """Which components have variance."""
        return self.variance > LEAST_SHARE * max(self.variance[0], 0.0)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact; of Python's whole numbers where 64 bits might not hold their squares' sum."""
        reach = self.n * max(abs(int(x.min())), abs(int(x.max()))) + max(abs(int(s)) for s in self.sums)
        if x.shape[1] * reach**2 <= LARGEST:
            return self.n * x - self.sums.astype(np.int64)
        return self.n * x.astype(object) - self.sums

    def project(self, deviations: np.ndarray) -> np.ndarray:
        """Whitened rows, of the components with variance."""
        centred = deviations.astype(np.float64) / self.n if deviations.dtype != object else (deviations / self.n).astype(np.float64)
        return centred @ (self.basis[:, self.open] / np.sqrt(self.variance[self.open]))


def fitted(total: Summary, components: int) -> Whitening:
    covariance = total.scatter / total.n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(covariance))
    variance = np.maximum(values[order], 0.0)
    return Whitening(total.n, total.sums, vectors[:, order], variance, variance / trace if trace > 0 else np.zeros(len(order)))


def whitened(rows: DataFrame, components: int = COMPONENTS, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for each usable row and component."""
    spark = rows.sparkSession
    own = staged(coded(rows, _encoded, id_col, vector_col), "codes")
    distinct = staged(own.select("dim", "code").distinct(), "distinct")
    dim = commonest_dim(distinct)
    if dim is None:
        return spark.createDataFrame([], RESULT)
    fit = distinct.where(F.col("dim") == dim)
    model = fitted(summarised(fit, dim), components)
    error = 0.0
    if model.open.any():
        again = summarised(fit, dim, lambda x: model.project(model.deviations(x)))
        error = float(np.abs(again.scatter / again.n - np.eye(len(again.mean))).max())
    release(distinct)
    shipped = spark.sparkContext.broadcast(model)  # d x components numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        k = len(m.variance)
        for part, x in _blocks(batches, dim):
            off = m.deviations(x)
            total = (off * off).sum(axis=1).tolist()
            white = np.full((len(x), k), np.nan)
            white[:, m.open] = m.project(off)
            flat = white.ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, m.n, np.int64)),
                    pa.array([t if t <= LARGEST else None for t in total for _ in range(k)], pa.int64()),
                    pa.array(flat, mask=np.isnan(flat)),
                    pa.array(np.tile(m.explained, len(x))),
                    pa.array(np.full(len(x) * k, error)),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return own.where(F.col("dim") == dim).select("id", "code").mapInArrow(run, RESULT)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES = {"op11_embedding_whitening": op11_embedding_whitening}
ORACLE: dict = {}
