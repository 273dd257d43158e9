"""Operator 3: token counts by linear longest-match.

Greedy longest-match word pieces need only their number here, so no piece is
ever built. The vocabulary is a byte trie with failure links; every node stores
how many tokens following its link pops. A word is read once, byte by byte.

Pieces are those of a byte-level vocabulary: a word is spelled with a leading
space, so pieces that begin with a space open a word and all others continue
it. Every single byte is a piece, so each word has an answer.

Defined results: null, empty or word-free text has no words and no tokens;
equal rows each get their row; a null id is passed through; very long words are
read in linear time; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolith.llm.common import table
from phonolith.llm.packing import byte_ranks

#: Distinct words whose counts a task remembers; then it starts afresh.
MEMO = 500_000
#: Longer words are counted without being remembered.
MEMO_BYTES = 64


class Automaton:
    """Trie over bytes: step[node << 8 | byte] -> node, link[node], popped[node]; the root is 0."""

    def __init__(self, pieces: Iterable[bytes]):
        self.step: dict[int, int] = {}
        ends = [False]
        parents: list[tuple[int, int]] = [(0, 0)]
        for piece in pieces:
            at = 0
            for byte in piece:
                if (to := self.step.get(at << 8 | byte)) is None:
                    to = self.step[at << 8 | byte] = len(ends)
                    ends.append(False)
                    parents.append((at, byte))
                at = to
            ends[at] = at != 0
        if missing := [b for b in range(256) if not ends[self.step.get(b, 0)]]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.link, self.popped = [0] * len(ends), [0] * len(ends)
        children: dict[int, list[int]] = {}
        for node in range(1, len(ends)):
            children.setdefault(parents[node][0], []).append(node)
        queue = deque(children.get(0, []))
        while queue:
            node = queue.popleft()
            queue.extend(children.get(node, ()))
            if ends[node]:
                self.link[node], self.popped[node] = 0, 1
                continue
            # Not a piece: pop what the parent pops, then go on until this byte fits.
            parent, byte = parents[node]
            at, popped = self.link[parent], self.popped[parent]
            while (to := self.step.get(at << 8 | byte)) is None:
                popped += self.popped[at]
                at = self.link[at]
            self.link[node], self.popped[node] = to, popped

    def count(self, word: bytes) -> int:
        """The number of greedy longest-match pieces of the bytes."""
        step, link, popped = self.step.get, self.link, self.popped
        at = total = 0
        for byte in word:
            while (to := step(at << 8 | byte)) is None:
                total += popped[at]
                at = link[at]
            at = to
        while at:
            total += popped[at]
            at = link[at]
        return total


class WordMemo(dict):
    """word -> number of pieces of ' ' + word, remembered."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.count = automaton.count

    def __missing__(self, word: bytes) -> int:
        found = self.count(b" " + word)
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[word] = found
        return found


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words long, n_tokens long), one row per row of docs."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(Automaton(byte_ranks(f.read())))  # bounded by the vocabulary
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordMemo(shipped.value)
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column(1):
                words = (text.as_py() or "").encode().split()
                n_words.append(len(words))
                n_tokens.append(sum(map(memo.__getitem__, words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["id", "n_words", "n_tokens"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_words long, n_tokens long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_tokens")


QUERIES = {"op3_token_counts": op3_token_counts}
ORACLE: dict = {}
