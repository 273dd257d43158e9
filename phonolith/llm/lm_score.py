"""Operator 4: language-model scoring by prediction by partial matching (PPM).

The model is a byte-context trie of fixed order with the escape estimate of
method C and symbol exclusion, learnt from the training rows and then fixed.
A text is scored as its words joined by single spaces, after ``order`` start
bytes and closed by an end byte.

The trie is counted as numbers: a context and its symbol (a gram) are the bytes
of one 64-bit integer. Tasks count the longest contexts of their texts; sums by
number give the deepest level, and shorter contexts are sums of longer ones.
What a byte costs depends only on its gram, so every level keeps, beside counts,
how much of the level above each context excludes. The trie stays distributed.

Texts are scored in one pass, whatever the size of the trie: the costs of the
most frequent grams (at most ``hot_grams``) are broadcast, and bytes with other
grams leave their gram, which one join with the costs of the rest resolves.
Grams that the deepest level lacks go down the trie's levels, each of them once.
Words are treated alike (for the plain unigram score beside it): at most
``hot_words`` are broadcast, the others are joined.

Defined results: null, empty or word-free text is the end alone; rows with the
same id and text score alike; a null id counts as the id text '' when rows are
held out; a very long text is one batch (some 40 bytes of memory a byte); with
nothing to learn from, bytes cost log10(1/255) and every word is unknown; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolith.llm.common import LOWER_BYTES, crc_mod, release, staged, table
from phonolith.llm.language_id import counted

ORDER = 6
#: Bytes that no UTF-8 text contains: before the text, and after it.
START, END = 0xFE, 0xFF
#: What can follow a context: every byte but START.
SYMBOLS = 255
#: Most grams and words whose costs are broadcast (some 35 and 30 MB in a worker).
HOT_GRAMS = 1_500_000
HOT_WORDS = 200_000
#: Longer words are never broadcast.
HOT_BYTES = 64
#: Distinct numbers or words that a task sums before it passes them on, and numbers that wait to be summed.
HELD = 3_000_000
HELD_WORDS = 300_000
WAITING = 1_000_000
#: Grams are dealt into 2**BUCKET_BITS buckets, words into WORD_BUCKETS. STIR makes a gram's high bits depend on all, UNSTIR undoes it.
BUCKET_BITS, WORD_BUCKETS = 12, 512
STIR = np.uint64(0x9E3779B97F4A7C15)
UNSTIR = np.uint64(pow(int(STIR), -1, 1 << 64))
#: Rows of sums that are passed on together.
PASSED = 200_000
#: Bytes of texts that are scored or counted together.
BATCH_BYTES = 500_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER_BYTES).split()


def grams_of(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of context and symbol for each byte and end of each text, how many each text has)."""
    opening, closing = bytes([START]) * order, bytes([END])
    data = np.frombuffer(b"".join(x for t in texts for x in (opening, t, closing)), np.uint8)
    code = data[order:].astype(np.int64)
    for back in range(1, order + 1):
        code |= data[order - back : len(data) - back].astype(np.int64) << 8 * back
    return code[data[order:] != START], np.array([len(t) + 1 for t in texts], np.int64)


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, list[list[bytes]]]]:
    """(batch, first row, words of consecutive rows), of bounded size or one text."""
    for batch in batches:
        first, held, size = 0, [], 0
        for i, text in enumerate(batch.column(column)):
            text = text.as_py() or ""
            if held and size + len(text) > BATCH_BYTES:
                yield batch, first, held
                first, held, size = i, [], 0
            held.append(words_of(text))
            size += len(text)
        if held:
            yield batch, first, held


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers as eight planes of bytes, so that what small ones have in common compresses."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def packed_grams(codes: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, grams, counts) of distinct grams: stirred, rising and as differences in each bucket."""
    stirred = codes.astype(np.uint64) * STIR
    order = np.argsort(stirred)
    stirred, n = stirred[order], n[order]
    edges = np.searchsorted(stirred >> np.uint64(64 - BUCKET_BITS), np.arange((1 << BUCKET_BITS) + 1, dtype=np.uint64))
    for bucket in np.flatnonzero(np.diff(edges)):
        rows = slice(edges[bucket], edges[bucket + 1])
        yield int(bucket), _planes(np.diff(stirred[rows], prepend=np.uint64(0))), _planes(n[rows])


def unpacked_grams(grams: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    return (np.cumsum(_from_planes(grams), dtype=np.uint64) * UNSTIR).astype(np.int64), _from_planes(n).astype(np.int64)


def packed_words(tokens: Counter) -> Iterator[tuple[int, bytes, bytes]]:
    """The same of words; their buckets follow on those of the grams."""
    parts: dict[int, list[bytes]] = {}
    for word in tokens:
        parts.setdefault((1 << BUCKET_BITS) + zlib.crc32(word) % WORD_BUCKETS, []).append(word)
    for bucket, words in parts.items():
        yield bucket, pickle.dumps(words), _planes(np.array([tokens[w] for w in words], np.int64))


def counts(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(word binary, gram long, n): training counts; one of word and gram is null, the end is the empty word.

    Tasks pass their sums on as one row for each bucket of grams or words, and add
    up one bucket at a time, so that neither rows nor a task's memory grow with
    the number of different grams that a task finds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: Counter = Counter()
        sums, waiting, total = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0

        def passed(packed: Iterator[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
            rows = list(packed)
            for at in range(0, len(rows), 512):
                bucket, what, n = zip(*rows[at : at + 512])
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(what, pa.binary()), pa.array(n, pa.binary())], names=["bucket", "what", "n"])

        def summed():
            return counted(*(np.concatenate([sums[k], *[w[k] for w in waiting]]) for k in (0, 1)))

        for _, _, texts in _batches(batches, 0):
            for words in texts:
                tokens.update(words)
            tokens[b""] += len(texts)
            if len(tokens) > HELD_WORDS:
                yield from passed(packed_words(tokens))
                tokens.clear()
            waiting.append(counted(grams_of([b" ".join(w) for w in texts], order)[0]))
            total += len(waiting[-1][0])
            if total > WAITING:
                sums, waiting, total = summed(), [], 0
                if len(sums[0]) > HELD:
                    yield from passed(packed_grams(*sums))
                    sums = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        sums, waiting = summed(), []
        yield from passed(packed_words(tokens))
        yield from passed(packed_grams(*sums))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket, waiting, size = None, None, [], 0

        def added() -> None:
            nonlocal held, waiting, size
            if bucket >> BUCKET_BITS:
                held = Counter() if held is None else held
                for words, n in waiting:
                    for word, m in zip(pickle.loads(words), _from_planes(n).tolist()):
                        held[word] += m
            else:
                parts = [unpacked_grams(*w) for w in waiting]
                parts = parts if held is None else [held, *parts]
                held = counted(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))
            waiting, size = [], 0

        def done() -> Iterator[pa.RecordBatch]:
            if bucket is None:
                return
            added()
            words = bool(bucket >> BUCKET_BITS)
            names, n = (pa.array(list(held), pa.binary()), np.array(list(held.values()), np.int64)) if words else held
            for at in range(0, len(n), PASSED):
                own = names[at : at + PASSED]
                columns = [own, pa.nulls(len(own), pa.int64())] if words else [pa.nulls(len(own), pa.binary()), pa.array(own)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n[at : at + PASSED])], names=["word", "gram", "n"])

        for batch in batches:
            for i, b in enumerate(batch.column(0).to_pylist()):
                if b != bucket:
                    yield from done()
                    bucket, held = b, None
                waiting.append((batch.column(1)[i].as_py(), batch.column(2)[i].as_py()))
                size += len(waiting[-1][1]) // 8
                if size > WAITING:
                    added()
        yield from done()

    packed = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket int, what binary, n binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merged, "word binary, gram long, n long")


# --- the trie --------------------------------------------------------------------


def _low(column: Column, size: int) -> Column:
    return column.bitwiseAND(F.lit((1 << 8 * size) - 1))


def trie(grams: DataFrame, order: int = ORDER) -> tuple[list[DataFrame], list[DataFrame]]:
    """From (gram, n) of the deepest level: for each number of context bytes the nodes (gram, n) and contexts (ctx, t, q, ex, down).

    t: the context's count, q: its different symbols; ex: what is left of the
    next shorter context once this one's symbols are excluded, symbols and
    escape together; down: the share of that which is escape, as a count.
    """
    # Each level is written out once: it is read several times, and plans stay small.
    levels = [staged(grams, "level")]
    for k in range(order - 1, -1, -1):
        levels.insert(0, staged(levels[0].groupBy(_low(F.col("gram"), k + 1).alias("gram")).agg(F.sum("n").alias("n")), "level"))
    contexts: list[DataFrame] = []
    for k, own in enumerate(levels):
        ctx = own.groupBy(F.shiftright("gram", 8).alias("ctx")).agg(F.sum("n").alias("t"), F.count("*").alias("q"))
        if k == 0:
            contexts.append(staged(ctx.select("ctx", "t", "q", F.lit(0).cast("long").alias("ex"), F.lit(0).cast("long").alias("down")), "contexts"))
            continue
        shorter = levels[k - 1].select(F.col("gram").alias("short"), F.col("n").alias("m"))
        counted = own.join(shorter, _low(F.col("gram"), k) == F.col("short"))
        ctx = counted.groupBy(F.shiftright("gram", 8).alias("ctx")).agg(F.sum("n").alias("t"), F.count("*").alias("q"), F.sum("m").alias("x"))
        above = contexts[k - 1].select(F.col("ctx").alias("short"), F.col("t").alias("t1"), F.col("q").alias("q1"))
        joined = ctx.join(above, _low(F.col("ctx"), k - 1) == F.col("short"))
        contexts.append(staged(joined.select("ctx", "t", "q", (F.col("t1") - F.col("x") + F.col("q1") - F.col("q")).alias("ex"), (F.col("q1") - F.col("q")).alias("down")), "contexts"))
    return levels, contexts


def known_costs(levels: list[DataFrame], contexts: list[DataFrame]) -> DataFrame:
    """(gram, n, cost) of the deepest level; cost: log10 probability of the symbol after its context."""
    deepest = levels[-1].join(contexts[-1], F.shiftright("gram", 8) == F.col("ctx"))
    return deepest.select("gram", "n", (F.log10("n") - F.log10(F.col("t") + F.col("q"))).alias("cost"))


def escaped_costs(grams: DataFrame, levels: list[DataFrame], contexts: list[DataFrame]) -> DataFrame:
    """(gram, cost) of distinct grams that the deepest level lacks, down the trie level by level."""
    seen = contexts[0].agg(F.coalesce(F.sum("q"), F.lit(0))).first()[0]
    log = lambda c: F.log10(F.greatest(F.col(c), F.lit(1)))
    open_grams = grams.select("gram", F.lit(0.0).alias("cost"), F.lit(False).alias("entered"), F.lit(0.0).alias("left"), F.lit(0.0).alias("escape"))
    done = []
    for k in range(len(levels) - 1, -1, -1):
        own = contexts[k].withColumn("has", F.lit(True))
        nodes = levels[k].select(F.col("gram").alias("node"), "n")
        step = open_grams.join(own, _low(F.shiftright("gram", 8), k) == F.col("ctx"), "left").join(nodes, _low(F.col("gram"), k + 1) == F.col("node"), "left")
        found = F.col("n").isNotNull()
        total = F.log10(F.col("t") + F.col("q"))
        more = (
            F.when(F.col("has").isNull(), 0.0)
            .when(F.col("entered"), F.when(found, log("n") - F.col("left")).otherwise(F.col("escape")))
            .otherwise(F.when(found, log("n") - total).otherwise(log("q") - total))
        )
        entered = F.col("has").isNotNull()
        escape = F.when(F.col("down") > 0, log("down") - log("ex")).otherwise(0.0)
        step = step.select(
            "gram",
            (F.col("cost") + more).alias("cost"),
            (F.col("entered") | entered).alias("entered"),
            F.when(entered, log("ex")).otherwise(F.col("left")).alias("left"),
            F.when(entered, escape).otherwise(F.col("escape")).alias("escape"),
            found.alias("found"),
        )
        step = staged(step, "escapes")
        done.append(step)
        open_grams = step.where(~F.col("found")).drop("found")
    last = open_grams.select("gram", (F.col("cost") - F.lit(math.log10(max(1, SYMBOLS - seen)))).alias("cost"))
    for step in done:
        last = last.unionByName(step.where("found").select("gram", "cost"))
    return last


def frequent(rows: DataFrame, most: int) -> DataFrame:
    """The rows (.., n) whose n is so large that at most ``most`` rows have it."""
    # Counted by a few hundred steps of n, so that nothing is sorted; at most that many rows come here.
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(((r["step"], r["rows"]) for r in rows.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    least, held = None, 0
    for at, size in sizes:
        if held + size > most:
            break
        least, held = at, held + size
    return rows.where(F.lit(False) if least is None else step >= least)


class HashTable:
    """Numbers (not negative) to values, by open addressing; at most three of four slots are taken."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(4 * len(keys) // 3).bit_length()))
        size = 1 << 64 - int(self.shift)
        self.keys, self.values, self.last = np.full(size, -1, np.int64), np.zeros(size), size - 1
        slots, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            at = slots[left]
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]
            self.values[at] = np.where(self.keys[at] == keys[left], values[left], self.values[at])
            left = left[self.keys[at] != keys[left]]
            slots[left] = slots[left] + 1 & self.last

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, indices of the keys that are not there)."""
        slots = self._slots(keys)
        there = self.keys[slots]
        out = self.values[slots]
        missing = [np.zeros(0, np.int64)]
        left = np.flatnonzero(there != keys)
        there = there[left]
        while len(left):
            gone = there == -1
            missing.append(left[gone])
            left = left[~gone]
            slots[left] = slots[left] + 1 & self.last
            there = self.keys[slots[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[slots[left[hit]]]
            left, there = left[~hit], there[~hit]
        return out, np.concatenate(missing)


def _costs(table: HashTable, texts: list[list[bytes]], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(sum of the costs of the grams in the table, the other grams) of each text."""
    grams, sizes = grams_of([b" ".join(w) for w in texts], order)
    cost, missing = table.get(grams)
    cost[missing] = 0.0
    missing.sort()
    ends = np.cumsum(sizes)
    return np.add.reduceat(cost, ends - sizes), np.split(grams[missing], np.searchsorted(missing, ends[:-1]))


# --- the operator ------------------------------------------------------------------


def scored(docs: DataFrame, training: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, hot_grams: int = HOT_GRAMS, hot_words: int = HOT_WORDS) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score), one row per row of docs."""
    spark = docs.sparkSession
    both = staged(counts(training, text_col, order), "counts")
    known = both.where("gram IS NULL").select("word", "n")
    total, vocabulary = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    floor = 0.1 / (total + 0.1 * (vocabulary + 1))
    cost_of = F.log10(F.lit(floor / 0.1) * (F.coalesce(F.col("n"), F.lit(0)) + 0.1))
    inner = known.where((F.length("word") > 0) & (F.length("word") <= HOT_BYTES))
    best = frequent(inner, hot_words).select("word", cost_of.alias("cost")).toArrow()
    hot = dict(zip(best.column("word").to_pylist(), best.column("cost").to_pylist()))
    ends = known.where(F.length("word") == 0).select("n").first()
    closing = (math.log10(floor), 0) if ends is None else (math.log10(floor * (ends["n"] + 0.1) / 0.1), 1)
    levels, contexts = trie(both.where("gram IS NOT NULL").select("gram", "n"), order)
    costs = staged(known_costs(levels, contexts), "costs")
    best = frequent(costs, hot_grams).select("gram", "cost").toArrow()
    # At most hot_words and hot_grams entries.
    shipped = spark.sparkContext.broadcast((hot, HashTable(best.column("gram").to_numpy(), best.column("cost").to_numpy())))
    del best, hot
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, hot_table = shipped.value[0].get, shipped.value[1]
        part, row = TaskContext.get().partitionId() << 40, 0
        for batch, first, texts in _batches(batches, 1):
            n_tokens, n_known, base, rare = [], [], [], []
            for words in texts:
                logs = list(map(lookup, words))
                rest = [w for w, x in zip(words, logs) if x is None] if None in logs else []
                rare.append(rest)
                n_tokens.append(len(words) + 1)
                n_known.append(len(words) - len(rest) + closing[1])
                base.append(sum(filter(None, logs)) + closing[0])
            keys = np.arange(part + row, part + row + len(texts), dtype=np.int64)
            row += len(texts)
            score, missed = _costs(hot_table, texts, order)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), batch.column(0).slice(first, len(texts)), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(score), pa.array(rare, pa.list_(pa.binary())), pa.array(missed, pa.list_(pa.int64()))],
                names=["row", "id", "n_tokens", "n_known", "base", "score", "rare", "missed"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = staged(rows.mapInArrow(run, f"row long, id {kind}, n_tokens long, n_known long, base double, score double, rare array<binary>, missed array<long>"), "scores")
    shipped.destroy()  # the rows are written; the driver needs the memory

    left = out.select("row", F.explode("missed").alias("gram"))
    unknown = staged(left.select("gram").distinct().join(costs, "gram", "left_anti"), "unknown")
    rest = staged(costs.select("gram", "cost").unionByName(escaped_costs(unknown, levels, contexts)), "rest")
    release(*levels, *contexts, costs, unknown)
    more = left.join(rest, "gram").groupBy("row").agg(F.sum("cost").alias("more"))
    words = out.select("row", F.explode("rare").alias("word")).join(known, "word", "left")
    sums = words.groupBy("row").agg(F.sum(cost_of).alias("logs"), F.count("n").alias("found"))
    done = out.drop("rare", "missed").join(sums, "row", "left").join(more, "row", "left")
    return done.select(
        "id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, docs.where(crc_mod(F.col("doc_id"), 10) != 0))
    return found.select(F.col("id").alias("doc_id"), (crc_mod(F.col("id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op4_lm_scoring": op4_lm_scoring}
ORACLE: dict = {}
