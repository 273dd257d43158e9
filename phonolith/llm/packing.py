"""Operator 10: best-fit packing under several capacities.

Every document becomes token ids (a public tokenizer's file) and an end id.
Documents longer than a sequence are cut into full pieces; the first piece
takes the remainder. Pieces are packed as vectors: tokens, documents and
attention cost (length squared), each as a share of its capacity.

A piece's vector depends on its length alone, so vector best-fit runs on the
histogram of lengths, which has at most ``max_tokens`` entries whatever the
number of documents. A bin is filled greedily: of the lengths that fit under
every constraint, the one with the best score against the residual capacities
goes in (weighted dot product, or the smallest residual norm), until none fits.
The contents found are repeated for as many bins as the histogram provides,
then the next bin is filled. Several score settings run and the one with the
fewest bins counts. The plan (lengths, bins, places) is broadcast; it has a
few rows for each length. Each piece finds its place by its rank among the
pieces of its length; ranks are dealt in slices, so that no length, however
common, is one task's work.

Text that spells a special token (``<|endoftext|>``) is encoded as plain text, as
with the tokenizer's ``encode_special_tokens``.

Defined results: null or empty text is the end id alone; ties of length are
ranked by document id, piece and checksum; repeated rows are packed
separately; a very long text is encoded whole and cut into pieces (some tens of
bytes of memory for each of its bytes); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phonolith.llm.common import staged, table

#: Scores tried on the histogram: (name, weights of tokens, documents, attention cost).
SCORES = (
    ("dot", (1.0, 0.2, 0.2)),
    ("norm", (1.0, 0.2, 0.2)),
)
#: Distinct chunks whose ids a task remembers, then it starts afresh; longer chunks are
#: not remembered. Together some 190 MB at most.
MEMO = 500_000
MEMO_CHARS = 32
#: The pattern's white space. WIDE characters of it are encoded apart.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WIDE = 4096
#: Pieces in a slice of one length, about.
SLICE_PIECES = 500_000


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence. The defaults of the last two never bind: a
    sequence of n tokens has at most n documents and a cost of at most n*n."""

    max_tokens: int = 1024
    max_docs: int | None = None
    max_cost: int | None = None

    def capacities(self) -> np.ndarray:
        return np.array([self.max_tokens, self.max_docs or self.max_tokens, self.max_cost or self.max_tokens**2], dtype=np.float64)


# --- tokens -------------------------------------------------------------------


def byte_ranks(tokenizer_json: str) -> dict[bytes, int]:
    """Token bytes -> id, of a byte-level BPE file whose ids are its merge ranks."""
    model = json.loads(tokenizer_json)
    special = {t["content"] for t in model["added_tokens"]}
    # Byte-level files spell each byte as a printable character: itself if it is one, else from U+0100 on.
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spelled = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
    return {bytes(spelled[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}


class ChunkMemo(dict):
    """Text between two spaces -> the ids of ' ' + text as little-endian bytes, remembered.

    A single space before a non-space always opens a new pre-token, so the parts
    between such spaces are encoded independently; texts with other spaces are
    encoded whole. Very long white space never meets the tokenizer's pattern, which
    would try its end from every place: but for its last character (if other text
    follows) it is one pre-token.
    """

    loose = re.compile(r" (?:\s|\Z)").search
    #: The pattern's white space (Unicode's property), many of it.
    wide = re.compile(rf"[{SPACES}]{{{WIDE},}}").finditer

    def __init__(self, tokenizer_json: str):
        import tiktoken
        from public_tokenizers import PATTERN

        super().__init__()
        self.file = tokenizer_json
        self.plain = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=byte_ranks(tokenizer_json), special_tokens={}).encode_ordinary

    @cached_property
    def single(self):
        """Encodes a text as one pre-token; made when a text needs it."""
        import tiktoken

        return tiktoken.Encoding("single", pat_str=r"(?s:.+)", mergeable_ranks=byte_ranks(self.file), special_tokens={}).encode_ordinary

    def __missing__(self, chunk: str) -> bytes:
        found = np.array(self.plain(" " + chunk), dtype="<u4").tobytes()
        if len(chunk) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[chunk] = found
        return found

    def ids(self, text: str) -> bytes:
        if len(text) >= WIDE:
            out, at = [], 0
            for found in self.wide(text):
                end = found.end() - (found.end() < len(text))
                out += [self.close(text[at : found.start()]), np.array(self.single(text[found.start() : end]), dtype="<u4").tobytes()]
                at = end
            if out:
                return b"".join([*out, self.close(text[at:])])
        return self.close(text)

    def close(self, text: str) -> bytes:
        """The ids of a text without very long white space."""
        if self.loose(text):
            return np.array(self.plain(text), dtype="<u4").tobytes()
        first, *others = text.split(" ")
        return np.array(self.plain(first), dtype="<u4").tobytes() + b"".join(map(self.__getitem__, others))


@lru_cache(maxsize=2)
def chunk_memo(tokenizer_json: str) -> ChunkMemo:
    """One for each worker process and file."""
    return ChunkMemo(tokenizer_json)


def pieces_of(total: int, max_tokens: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces; all but the first are full."""
    first = total % max_tokens or max_tokens
    return [(0, first)] + [(s, max_tokens) for s in range(first, total, max_tokens)]


def tokenized(docs: DataFrame, tokenizer_path: str, max_tokens: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, piece, start, length, crc): one row per piece."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shipped = spark.sparkContext.broadcast(f.read())
    end = np.array([end_id], dtype="<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = chunk_memo(shipped.value)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = memo.ids(text.as_py() or "") + end
                for k, (at, n) in enumerate(pieces_of(len(ids) // 4, max_tokens)):
                    rows.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + n)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["id", "piece", "start", "length", "crc"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, crc long")


# --- the plan on the histogram ---------------------------------------------------


def _fill(counts: np.ndarray, vectors: np.ndarray, score: str, weights: np.ndarray) -> dict[int, int]:
    """Contents of one bin: {length: how many}; vectors are shares of the capacities."""
    residual = np.ones(vectors.shape[1])
    left = counts.copy()
    inside: dict[int, int] = {}
    while True:
        fits = np.flatnonzero((left > 0) & (vectors <= residual + 1e-12).all(axis=1))
        if not len(fits):
            return inside
        v = vectors[fits]
        value = (v * residual * weights).sum(axis=1) if score == "dot" else -(weights * (residual - v) ** 2).sum(axis=1)
        best = int(fits[len(fits) - 1 - np.argmax(value[::-1])])
        inside[best] = inside.get(best, 0) + 1
        left[best] -= 1
        residual = residual - vectors[best]


def best_fit(histogram: dict[int, int], limits: Limits = Limits(), scores=SCORES) -> list[tuple[int, dict[int, int]]]:
    """[(number of bins, {length: how many in each})] with the fewest bins of all scores tried."""
    caps = limits.capacities()
    sizes = np.arange(limits.max_tokens + 1, dtype=np.float64)
    vectors = np.stack([sizes, np.ones_like(sizes), sizes**2], axis=1) / caps
    best: list | None = None
    for score, weights in scores:
        counts = np.zeros(limits.max_tokens + 1, dtype=np.int64)
        for size, n in histogram.items():
            counts[size] = n
        if (alone := (counts > 0) & (vectors > 1 + 1e-12).any(axis=1)).any():
            raise ValueError(f"a piece of {int(np.flatnonzero(alone)[0])} tokens exceeds a capacity by itself")
        plan = []
        while counts.any():
            inside = _fill(counts, vectors, score, np.array(weights))
            times = min(int(counts[s]) // n for s, n in inside.items())
            for s, n in inside.items():
                counts[s] -= times * n
            plan.append((times, inside))
        if best is None or sum(t for t, _ in plan) < sum(t for t, _ in best):
            best = plan
    return best or []


def placement(plan: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first bin, pieces in a bin, offset in the bin), by rank."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    first_bin = 0
    for times, inside in plan:
        offset = 0
        for size, n in sorted(inside.items(), reverse=True):
            out.setdefault(size, []).append((ranks.get(size, 0), first_bin, n, offset))
            ranks[size] = ranks.get(size, 0) + times * n
            offset += size * n
        first_bin += times
    return {size: np.array(rows, dtype=np.int64) for size, rows in out.items()}


# --- the operator -----------------------------------------------------------------


def pack(pieces: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds sequence_id and offset to written rows (id, piece, start, length, crc, row); row tells equal pieces apart."""
    spark = pieces.sparkSession
    # One row for each length: at most max_tokens rows come to the driver.
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # As many slices as the commonest length needs, so that no window's partition grows with the corpus.
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), max(histogram.values(), default=0) // SLICE_PIECES + 1)
    pieces = pieces.withColumn("slice", F.pmod(F.xxhash64("id", "piece", "crc", "row"), F.lit(slices)).cast("int"))
    sizes = staged(pieces.groupBy("length", "slice").agg(F.count("*").alias("n")), "histogram")
    shipped = spark.sparkContext.broadcast(placement(best_fit(histogram, limits)))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "slice").orderBy("id", "piece", "crc", "row")
    ranked = pieces.withColumn("rank", F.row_number().over(within)).join(bases, ["length", "slice"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("rank") - 1).drop("base", "slice")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shipped.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, edges):
                size = int(length[rows[0]])
                p = places[size]
                k = np.searchsorted(p[:, 0], rank[rows], side="right") - 1
                nth = rank[rows] - p[k, 0]
                sequence[rows] = p[k, 1] + nth // p[k, 2]
                offset[rows] = p[k, 3] + nth % p[k, 2] * size
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("id", "piece", "start", "length", "crc")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "crc", "sequence_id", "offset"])

    kind = pieces.schema["id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, crc long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, *, limits: Limits = Limits(), end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    pieces = tokenized(docs, tokenizer_path, limits.max_tokens, end_id, id_col, text_col)
    return pack(staged(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces"), limits)


def report(docs: DataFrame, **options) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), **options)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
ORACLE: dict = {}
