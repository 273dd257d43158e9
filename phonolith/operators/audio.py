"""The kernels over rows: contents in, facts, processed clips or embeddings out, in Arrow batches.

Rows are independent; nothing is shuffled. A file must fit in a task, as a
decoded file must anyway. Files are opened by their path inside the task, one
after the other; a table that brings a column ``content`` is read from that
instead (then as many files as an Arrow batch has rows are in memory).
"""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolith.functions import kernels
from phonolith.functions.numbers import CLIP_MIN_SEC, clip_frames
from phonolith.functions.text import embedding_document, nocase
from phonolith.operators.search import MODEL_ID
from phonolith.schema import Catalog
from phonolith.sources import codecs, files, wav


def _each_file(paths: DataFrame, one: Callable[..., tuple], schema: str, *columns: str) -> DataFrame:
    """The row one(path, content, columns ...) of each file, each a batch of its own."""
    kinds = [f.split() for f in schema.split(", ")]
    types = pa.schema([(name, {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "double": pa.float64()}[kind]) for name, kind in kinds])
    given = "content" in paths.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, *rest = (c[i].as_py() for c in batch.columns)
                content = rest.pop() if given else None
                try:
                    row = one(path, content if given else files.content(path), *rest)
                except (OSError, pa.ArrowException) as error:
                    row = (path, *[None] * (len(kinds) - 2), str(error))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types.types)], schema=types)

    return paths.select("path", *columns, *["content"] * given).mapInArrow(run, schema)


def clips(paths: DataFrame, config: kernels.PostProcess = kernels.PostProcess()) -> DataFrame:
    """paths (path, start, end in seconds; null for all) -> (path, wav, frames, technique, error)."""

    def one(path: str, content: bytes, start: float | None, end: float | None) -> tuple:
        try:
            x, rate = codecs.decode(content, path.rpartition(".")[2].lower())
            if start is not None and end is not None:
                if not (math.isfinite(start) and math.isfinite(end)) or end - start < CLIP_MIN_SEC:
                    raise ValueError("clip is too short or not finite")
                first, last = max(0, min(math.floor(start * rate), len(x) - 1)), max(1, min(math.ceil(end * rate), len(x)))
                if (last - first) / rate < CLIP_MIN_SEC - 1e-6:
                    raise ValueError("clip is too short within the file")
                x = x[first:last]
            found = kernels.post_process(x, rate, config)
            loop = (found.loop_start, found.loop_end) if config.embed_smpl_chunk and found.technique != "passthrough" else None
            return path, wav.float_wav(found.samples, rate, loop), len(found.samples), found.technique, None
        except ValueError as error:
            return path, None, None, None, str(error)

    return _each_file(paths, one, "path string, wav binary, frames long, technique string, error string", "start", "end")


def decode_reports(paths: DataFrame) -> DataFrame:
    """(path, format, channels, sample_rate, bits, data_size, frames, decode_ms, error) of each file."""

    def one(path: str, content: bytes) -> tuple:
        header = wav.sniff(content)
        began = time.perf_counter()
        try:
            frames, error = len(codecs.decode(content, path.rpartition(".")[2].lower())[0]), None
        except ValueError as e:
            frames, error = None, str(e)
        facts = (header.audio_format, header.channels, header.sample_rate, header.bits_per_sample, header.data_size) if header else (None,) * 5
        return path, *facts, frames, (time.perf_counter() - began) * 1000, error

    return _each_file(paths, one, "path string, format long, channels long, sample_rate long, bits long, data_size long, frames long, decode_ms double, error string")


def signal_kinds(signals: DataFrame) -> DataFrame:
    """signals (asset_id, sample_rate, samples array<float>) -> (asset_id, correlation, hz, kind)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, *kernels.classify(np.asarray(x, np.float32), int(r))) for i, r, x in frame[["asset_id", "sample_rate", "samples"]].itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["asset_id", "correlation", "hz", "kind"])

    return signals.mapInPandas(run, "asset_id long, correlation double, hz double, kind int")


class HashingProvider:
    """Text vectors without a model: signed hashes of words and their trigrams, at unit length.

    It is the same everywhere and needs no download; a model takes its place
    through the same two members.
    """

    #: Bytes of remembered words' vectors, and hashes of parts; what is full starts afresh. Longer words are not kept.
    WORDS_BYTES, PARTS, LONG, CHUNK = 64 << 20, 200_000, 64, 4096

    def __init__(self, dim: int = 384, model_id: str = MODEL_ID):
        self.dim, self.model_id = dim, model_id
        self._parts: dict[str, tuple[int, float]] = {}
        self._rows: dict[str, int] = {}
        self._vectors: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"dim": self.dim, "model_id": self.model_id}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def _vector(self, word: str) -> np.ndarray:
        v = np.zeros(self.dim, np.float32)
        for part in {word, *(word[i : i + 3] for i in range(len(word) - 2))}:
            if (found := self._parts.get(part)) is None:
                h = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little")
                found = h % self.dim, 1.0 if h >> 63 else -1.0
                if len(part) <= self.LONG:
                    if len(self._parts) >= self.PARTS:
                        self._parts.clear()
                    self._parts[part] = found
            v[found[0]] += found[1]
        return v

    def _sum(self, words: list[str]) -> np.ndarray:
        """The words' vectors added up; whole numbers, so their order does not matter."""
        if self._vectors is None:
            self._vectors = np.zeros((max(self.CHUNK, self.WORDS_BYTES // (4 * self.dim)), self.dim), np.float32)
        v, rows = np.zeros(self.dim, np.float32), self._rows
        for at in range(0, len(words), self.CHUNK):
            if len(rows) + self.CHUNK > len(self._vectors):
                rows.clear()
            own = []
            for word in words[at : at + self.CHUNK]:
                if (row := rows.get(word)) is None:
                    if len(word) > self.LONG:
                        v += self._vector(word)
                        continue
                    row = rows[word] = len(rows)
                    self._vectors[row] = self._vector(word)
                own.append(row)
            v += self._vectors[own].sum(axis=0)
        return v

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = self._sum(text.lower().split())
            norm = float(np.linalg.norm(v))
            out.append((v / norm if norm > 1e-8 else v).tolist())
        return out


def documents_to_embed(catalog: Catalog) -> DataFrame:
    """(asset_id, document) of every asset whose document is not blank; tags are gathered by asset."""
    links = catalog.asset_tags.join(catalog.tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    names = F.transform(F.array_sort(F.collect_list(F.struct(nocase(F.col("name")).alias("key"), "name"))), lambda x: x["name"])
    tags = links.groupBy("asset_id").agg(F.array_join(names, " ").alias("_tags"))
    joined = catalog.assets.join(tags, F.col("id") == F.col("asset_id"), "left").drop("asset_id")
    return joined.select(F.col("id").alias("asset_id"), embedding_document(F.coalesce("_tags", F.lit(""))).alias("document")).where("document <> ''")


def embed(documents: DataFrame, provider, now: int, batch: int = 32) -> DataFrame:
    """Rows for the embeddings table; the provider is called with batches of texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, vectors = frame["document"].tolist(), []
            for at in range(0, len(texts), batch):
                part = provider.embed(texts[at : at + batch])
                if len(part) != len(texts[at : at + batch]) or any(len(v) != provider.dim for v in part):
                    raise ValueError("the provider returned another number of vectors or dimensions")
                vectors += part
            yield pd.DataFrame({"asset_id": frame["asset_id"], "vector": vectors, "model_id": provider.model_id, "created_at": now})

    return documents.mapInPandas(run, "asset_id long, vector array<float>, model_id string, created_at long")


__all__ = ["HashingProvider", "clip_frames", "clips", "decode_reports", "documents_to_embed", "embed", "signal_kinds"]
