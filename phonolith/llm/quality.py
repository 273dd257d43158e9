"""Operator 5: quality rules on repetition, from a suffix array of the words.

Many texts are handled together: their words become numbers, each text ends in
a sentinel of its own, and every number carries its text, so nothing matches
across texts. Prefix doubling sorts the suffixes (only those not yet unique are
sorted again). The longest common prefix with the neighbour before is compared
word by word only where it can't follow from the position before it; elsewhere
it is one less than there. The deepest interval of common prefixes that holds a
suffix has the larger of its two neighbours' values: this is the longest
maximal repeat that begins there. The union of the spans of at least
``min_repeat`` words is the covered part. Texts are rejected if they are too
short, if repeated 8-word windows cover too much (both fixed base rules), or if
the maximal repeats cover too large a share or the longest spans too much.

Defined results: null, empty or word-free text has zeros everywhere and fails
the base rules (fewer than 20 words); repeated rows each get their row; null
ids and further columns pass through; empty tables give no rows; a very long
text is a batch of its own (under 100 bytes of memory a word).
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolith.llm.common import mark, table

#: What separates words, and the symbols that are counted.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Words of texts that are sorted together.
BATCH_WORDS = 200_000
#: Bytes of a text that are split into words at a time.
CHUNK = 4_000_000
#: Words that all open comparisons go forward together, before each is ended by itself.
TOGETHER = 32

_space = re.compile(rb"[ \t-\r]").search


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    window: int = 8
    max_window_share: float = 0.30
    #: Shortest repeat that counts for the covered share and the longest repeat, in words.
    min_repeat: int = 3
    max_covered: float = 0.40
    max_longest: float = 0.30


def suffix_order(first: np.ndarray) -> np.ndarray:
    """The suffix array; first: a number for each word, each text's last one unique."""
    n = len(first)
    order = np.argsort(first, kind="stable").astype(np.int32)
    new = np.empty(n, bool)
    new[:1] = True
    new[1:] = first[order[1:]] != first[order[:-1]]
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), np.int32(0)))
    active, step = order[~(new & np.append(new[1:], True))], 1
    while len(active):
        key = rank[active].astype(np.int64) * n + rank[active + step]
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        del by
        old, at = rank[active], np.arange(len(active), dtype=np.int32)
        group = np.ones(len(active), bool)
        group[1:] = old[1:] != old[:-1]
        new = np.ones(len(active), bool)
        new[1:] = key[1:] != key[:-1]
        del key
        old -= np.maximum.accumulate(np.where(group, at, np.int32(0)))
        order[old + at] = active
        rank[active] = old + np.maximum.accumulate(np.where(new, at, np.int32(0)))
        active = active[~(new & np.append(new[1:], True))]
        step *= 2
    return order


def _shared(first: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words follow alike from each a and b (which differ)."""
    length = np.zeros(len(a), np.int32)
    left = np.arange(len(a))
    for step in range(TOGETHER):
        left = left[first[a[left] + step] == first[b[left] + step]]
        if not len(left):
            return length
        length[left] += 1
    for k in left:
        x, y, size = int(a[k]) + TOGETHER, int(b[k]) + TOGETHER, TOGETHER
        while True:
            # The later one's sentinel ends it, at the latest.
            apart = first[x : x + size] != first[y : y + size][: len(first) - x] if x > y else first[x : x + size][: len(first) - y] != first[y : y + size]
            at = int(apart.argmax())
            if apart[at]:
                length[k] = x + at - int(a[k])
                break
            x, y, size = x + size, y + size, 2 * size
    return length


def shared_before(first: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each position the common prefix with the suffix before it in the order."""
    before = np.full(len(first), -1, np.int32)
    before[order[1:]] = order[:-1]
    # If the words before both are alike, the position before this one has one more in common.
    begins = np.ones(len(first), bool)
    begins[1:] = (before[1:] < 1) | (first[before[1:] - 1] != first[:-1])
    at = np.flatnonzero(begins & (before >= 0)).astype(np.int32)
    length = np.zeros(len(first), np.int32)
    length[at] = _shared(first, at, before[at])
    origin = np.maximum.accumulate(np.where(begins, np.arange(len(first), dtype=np.int32), np.int32(0)))
    return length[origin] - (np.arange(len(first), dtype=np.int32) - origin)


def longest_here(first: np.ndarray) -> np.ndarray:
    """For each position the length of the longest repeat that begins there."""
    order = suffix_order(first)
    length = shared_before(first, order)
    after = length[order[1:]]
    out = length.copy()
    out[order[:-1]] = np.maximum(length[order[:-1]], after)
    return out


def covered(length: np.ndarray, least: int) -> np.ndarray:
    """Which positions lie in the union of the spans of at least so many words."""
    at = np.flatnonzero(length >= least)
    ends = np.bincount(at + length[at], minlength=len(length) + 1)[: len(length) + 1]
    begins = np.bincount(at, minlength=len(length) + 1)
    return np.cumsum(begins - ends)[: len(length)] > 0


def numbered(text: str | None, number: defaultdict) -> np.ndarray:
    """A number for each word of the text, from 1."""
    data, at, parts = (text or "").encode(), 0, []
    while at < len(data):
        end = at + CHUNK
        end = found.start() if end < len(data) and (found := _space(data, end)) else len(data)
        words = data[at:end].split()
        parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def repetition(texts: list[np.ndarray], different: int, rules: Rules) -> np.ndarray:
    """Rows (words in repeated windows, words in repeats, longest repeat), for the numbered words of each text."""
    if not texts:
        return np.zeros((0, 3), np.int64)
    sizes = np.array([len(w) for w in texts], np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1)
    end = np.zeros(1, np.int32)
    first = owner.astype(np.int64)
    first *= different + 1
    first += np.concatenate([part for words in texts for part in (words, end)])
    length = longest_here(first)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, owner, np.where(length >= rules.min_repeat, length, 0))
    parts = [np.bincount(owner[covered(length, least)], minlength=len(texts)) for least in (rules.window, rules.min_repeat)]
    return np.stack([*parts, longest], axis=1)


def _plain_counts(text: str) -> tuple[int, int, int]:
    """(code points in words, symbols, repeated lines)."""
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def measured(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (default: all) of each row with the measures of its text; no shuffle."""
    keep = docs.columns if keep is None else keep
    # A kept text is not sent twice.
    width, at = len(keep), keep.index(text_col) if text_col in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ready(batch, rows, plain, texts, different):
            part = np.concatenate([np.array(plain, np.int64).reshape(-1, 4), repetition(texts, different, rules)], axis=1)
            columns = [batch.column(i).slice(rows[0], len(rows)) for i in range(width)]
            return pa.RecordBatch.from_arrays([*columns, *[pa.array(part[:, i]) for i in range(7)]], names=[*[mark(f"c{i}") for i in range(width)], *[mark(n) for n in MEASURES]])

        for batch in batches:
            rows, plain, texts, held, number = [], [], [], 0, defaultdict(count(1).__next__)
            for i, text in enumerate(batch.column(at)):
                text = text.as_py() or ""
                # At most every second byte begins a word.
                if rows and held + len(text) // 2 > BATCH_WORDS:
                    yield ready(batch, rows, plain, texts, len(number))
                    rows, plain, texts, held, number = [], [], [], 0, defaultdict(count(1).__next__)
                words = numbered(text, number)
                rows.append(i)
                texts.append(words)
                plain.append((len(words), *_plain_counts(text)))
                held += len(words)
            if rows:
                yield ready(batch, rows, plain, texts, len(number))

    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    schema = ", ".join([*[f"{mark(f'c{i}')} {k}" for i, k in enumerate(kinds)], *[f"{mark(n)} long" for n in MEASURES]])
    source = docs.select(*[F.col(c).alias(mark(f"c{i}")) for i, c in enumerate(keep)], *([F.col(text_col).alias(mark("text"))] if at == width else []))
    out = source.mapInArrow(run, schema)
    n, window, part, longest = (F.col(mark(x)) for x in ("n_words", "n_repeat_words", "covered_words", "longest_repeat"))
    failed = (n < rules.min_words) | (100 * window > F.lit(100 * rules.max_window_share) * n)
    good = (part <= F.lit(rules.max_covered) * n) & (longest <= F.lit(rules.max_longest) * n)
    return out.withColumn(mark("base_failed"), failed).withColumn(mark("kept"), ~failed & good)


def keep_good(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The documents that no rule rejects, all columns as they were."""
    good = measured(docs, rules, text_col).where(mark("kept"))
    return good.select(*[F.col(mark(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = measured(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(F.col(mark("c0")).alias("doc_id"), *[F.col(mark(n)).alias(n) for n in (*MEASURES, "base_failed", "kept")])


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLE: dict = {}
