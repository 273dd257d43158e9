"""Near copies for the pipeline: all texts whose 5-word shingle sets have a Jaccard similarity of at least 0.8.

Operator 2's links come first: SimHashes of the shingle sets that differ in at
most 2 bits. Each is verified, as such fingerprints are no proof. At 0.8 most
pairs differ in more bits, so the rest comes from an exact filter by prefixes: the
shingles of all texts have one order, rare ones first, and of a set of n the first
n - ceil(0.8 n) + 1 are its prefix. Two sets of similarity 0.8 share a shingle of
their prefixes. (The order is by counts of 2**20 hash cells over all texts; any
order would be right, rarer ones first make fewer candidates.)

Nothing is skipped, and little is compared twice:

* Texts with the same lower-cased words are one class and never meet each other.
* First each class meets one class of each of its shingles (the hub). What that
  links is one component, and its classes need not meet again.
* Under a shingle of at most ``FEW`` classes, pairs of different components are
  counted: two sets whose prefixes share c shingles, none of them of a larger
  key, overlap by at most c and what lies beyond a prefix. Only pairs that may
  reach the overlap are verified.
* Larger keys are compared whole, in blocks of ``BLOCK`` by ``BLOCK`` classes: a
  task gets each class's hashes once and multiplies the blocks' incidence
  matrices. A class that also stands under its key's dominant one (the largest
  key of that key's hub) meets only classes that don't, as pairs under the
  dominant key meet there. Only one link of two components leaves a block.

Defined results: fewer than 5 words are one shingle; null, empty or word-free
texts are one class; a null id is an id like any other (of copies an id stays
before it); repeated rows are rows of their own; a very long text is one row
(some 100 bytes of memory a word); an empty table gives no rows; other columns
are ignored. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonolith.llm import simhash
from phonolith.llm.common import LOWER_BYTES, release, staged
from phonolith.llm.components import components

SHINGLE = 5
SEED = 42
#: Keys of more classes than this are compared in blocks.
FEW = 16
#: Classes of a side of a block at most, and shingles of one about.
BLOCK = 256
BLOCK_SHINGLES = 1_000_000
#: Hash cells of the shingles' counts, and shingles that wait to be counted.
CELLS = 1 << 20
WAITING = 1_000_000
#: Different words whose hashes a task remembers, then it starts afresh.
WORDS = 300_000
#: Columns of an incidence matrix at once.
COLUMNS = 4096

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)
_TIMES = np.random.default_rng(SEED).integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        found = self[word] = _hash(word)
        return found


def shingles(found: list[bytes], hashes: WordHashes | None = None) -> np.ndarray:
    """The hashes of the different shingles of a list of words, rising."""
    if len(found) < SHINGLE:
        return np.array([_hash(b" ".join(found))], np.uint64)
    of = np.fromiter(map((WordHashes() if hashes is None else hashes).__getitem__, found), np.uint64, len(found))
    n = len(found) - SHINGLE + 1
    mixed = of[:n] * _TIMES[0]
    for i in range(1, SHINGLE):
        mixed += of[i : i + n] * _TIMES[i]
    # Sums of words' hashes, stirred so that each bit depends on all.
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def overlaps(size: int, other: int) -> int:
    """The fewest common shingles of two sets of these sizes and similarity 0.8."""
    return -(-4 * (size + other) // 9)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """In whole numbers: at least 4/5."""
    return len(np.intersect1d(a, b, assume_unique=True)) >= overlaps(len(a), len(b))


def prefix_size(n: int) -> int:
    return n - -(-4 * n // 5) + 1


# --- passes over the texts -----------------------------------------------------------------


def _fingerprint(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def _each(batch: pa.RecordBatch, column: int, of) -> Iterator:
    """of(words) for each text, once for equal texts of a batch."""
    seen: dict = {}
    for text in batch.column(column):
        text = text.as_py()
        if text not in seen:
            seen[text] = of(words(text))
        yield seen[text]


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, fp, size, sim) for each row: fp names its words, size counts its shingles, sim is their SimHash.

    Rows with ``cells`` instead are a task's counts of hash cells.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, waiting, total, cells = WordHashes(), [], 0, np.zeros(CELLS, np.uint32)

        def of(split: list[bytes]) -> tuple:
            found = shingles(split, hashes)
            waiting.append((found & np.uint64(CELLS - 1)).astype(np.int32))
            name = int.from_bytes(xxhash.xxh64_digest(b" ".join(split), seed=SEED), "big", signed=True)
            return name, len(found), _fingerprint(found)

        def counted() -> None:
            nonlocal total, cells
            if waiting:
                cells += np.bincount(np.concatenate(waiting), minlength=CELLS).astype(np.uint32)
            waiting.clear()
            total = 0

        schema = None
        for batch in batches:
            found = []
            for row in _each(batch, 2, of):
                found.append(row)
                total += row[1]
                if total > WAITING:
                    counted()
            fp, size, sim = zip(*found) if found else ((), (), ())
            columns = [batch.column(0), batch.column(1), pa.array(fp, pa.int64()), pa.array(size, pa.int32()), pa.array(sim, pa.int64()), pa.nulls(len(found), pa.binary())]
            out = pa.RecordBatch.from_arrays(columns, names=["id", "text_key", "fp", "size", "sim", "cells"])
            schema = out.schema
            yield out
        counted()
        if schema is not None:
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, f.type) for f in schema][:5], pa.array([_packed(cells)], pa.binary())], schema=schema)

    return rows.mapInArrow(run, f"id {kind}, text_key long, fp long, size int, sim long, cells binary")


def _packed(cells: np.ndarray) -> bytes:
    """Counts of cells, only those above 0 if these are few."""
    at = np.flatnonzero(cells)
    return pickle.dumps(cells if 3 * len(at) > CELLS else (at.astype(np.int32), cells[at]))


def _unpacked(packed: bytes) -> np.ndarray:
    found = pickle.loads(packed)
    if isinstance(found, np.ndarray):
        return found
    cells = np.zeros(CELLS, np.uint32)
    cells[found[0]] = found[1]
    return cells


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums stop at the largest number, far beyond what an order needs."""
    total = a + b
    return np.where(total < a, np.uint32(2**32 - 1), total)


def cell_counts(marked: DataFrame) -> np.ndarray:
    """The sum of all cells' counts, CELLS numbers whatever the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            for row in batch.column(0):
                more = _unpacked(row.as_py())
                own = more if own is None else _added(own, more)
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([_packed(own)], pa.binary())], names=["cells"])

    rows = marked.where(F.col("cells").isNotNull()).select("cells").mapInArrow(run, "cells binary")
    if rows.isEmpty():
        return np.zeros(CELLS, np.uint32)
    return _unpacked(rows.rdd.map(lambda r: bytes(r[0])).treeReduce(lambda a, b: _packed(_added(_unpacked(a), _unpacked(b)))))


def prefixes(docs: DataFrame, counts: np.ndarray, text_col: str) -> DataFrame:
    """(text_key, tokens) for each row."""
    shipped = docs.sparkSession.sparkContext.broadcast(counts)  # 4 MB
    rows = docs.select(F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, cells = WordHashes(), shipped.value

        def of(split: list[bytes]) -> np.ndarray:
            found = shingles(split, hashes)
            order = np.lexsort((found, cells[(found & np.uint64(CELLS - 1)).astype(np.int64)]))
            return found[order[: prefix_size(len(found))]].view(np.int64)

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(_each(batch, 1, of)), pa.list_(pa.int64()))], names=["text_key", "tokens"])

    return rows.mapInArrow(run, "text_key long, tokens array<long>")


def hash_sets(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(fp, hashes) of the wanted (fp, text_key): all shingles of a class, 8 bytes each."""
    own = docs.select(F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    # Texts are looked up by 20 bits first, so that few others are shuffled.
    short = F.col("text_key").bitwiseAND(F.lit((1 << 20) - 1))
    near = own.withColumn("short", short).join(F.broadcast(wanted.select(short.alias("short")).distinct()), "short", "left_semi").drop("short")
    texts = near.join(wanted.select("text_key"), "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [shingles(words(t.as_py()), hashes).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["fp", "hashes"])

    return staged(texts.join(wanted, "text_key").select("fp", "text").mapInArrow(run, "fp long, hashes binary"), "sets")


# --- candidates and their verification ------------------------------------------------------


def may_reach(c: Column, size: Column, other: Column) -> Column:
    """Whether sets of these sizes whose prefixes share c shingles can be similar."""
    beyond = lambda n: F.ceil(n * 4 / F.lit(5)) - 1
    return (c + F.greatest(beyond(size), beyond(other)) >= F.ceil((size + other) * 4 / F.lit(9))) & (5 * F.least(size, other) >= 4 * F.greatest(size, other))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(i)] for i in (2, 3))
        keep = pa.array([similar(x, y) for x, y in zip(a, b)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])


def verified(docs: DataFrame, distinct: DataFrame, pairs: DataFrame, text_col: str) -> DataFrame:
    """The similar ones of the staged pairs (u, v), which go."""
    needed = pairs.select(F.col("u").alias("fp")).unionByName(pairs.select(F.col("v").alias("fp"))).distinct()
    wanted = staged(distinct.join(needed, "fp", "left_semi").select("fp", "text_key"), "wanted")
    sets = hash_sets(docs, wanted, text_col)
    side = lambda c, name: sets.select(F.col("fp").alias(c), F.col("hashes").alias(name))
    out = staged(pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(_verified, "u long, v long"), "links")
    release(pairs, wanted, sets)
    return out


def simhash_pairs(distinct: DataFrame) -> DataFrame:
    """Pairs that operator 2 links: classes of a fingerprint with its first one, first ones of linked fingerprints."""
    sims = staged(distinct.groupBy("sim").agg(F.min(F.struct("fp", "size")).alias("first")), "sims")
    linked = simhash.links(sims.select(F.col("sim").alias("fp")))
    same = distinct.join(sims, "sim").select(F.col("fp").alias("u"), F.col("first.fp").alias("v"), F.col("size").alias("a"), F.col("first.size").alias("b"))
    side = lambda c, name: sims.select(F.col("sim").alias(c), F.col("first.fp").alias(f"{c}_fp"), F.col("first.size").alias(name))
    other = linked.join(side("u", "a"), "u").join(side("v", "b"), "v").select(F.col("u_fp").alias("u"), F.col("v_fp").alias("v"), "a", "b")
    near = same.unionByName(other).where((F.col("u") != F.col("v")) & (5 * F.least("a", "b") >= 4 * F.greatest("a", "b")))
    out = staged(near.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "simhash-pairs")
    release(sims, linked)
    return out


def shared_keys(distinct: DataFrame) -> DataFrame:
    """(token, fp, size, n, hub, hub_size) of the prefix shingles that several classes have."""
    placed = distinct.select("fp", "size", F.explode("tokens").alias("token"))
    # Written out, so that the join shuffles both sides and Spark can split a hot key.
    keys = staged(placed.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct("fp", "size")).alias("hub")).where("n > 1"), "keys")
    out = staged(placed.join(keys, "token").select("token", "fp", "size", "n", F.col("hub.fp").alias("hub"), F.col("hub.size").alias("hub_size")), "shared")
    release(keys)
    return out


def hub_pairs(shared: DataFrame) -> DataFrame:
    met = shared.where(F.col("fp") != F.col("hub")).groupBy(F.col("fp").alias("u"), F.col("hub").alias("v")).agg(F.count("*").alias("c"), F.first("size").alias("a"), F.first("hub_size").alias("b"))
    return met.where(may_reach(F.col("c"), F.col("a"), F.col("b"))).select("u", "v")


def counted_pairs(live: DataFrame) -> DataFrame:
    """Pairs under keys of few classes that may be similar."""
    few = live.where(F.col("n") <= FEW)
    other = few.select("token", F.col("fp").alias("v"), F.col("size").alias("b"), F.col("part").alias("other"))
    met = few.select("token", F.col("fp").alias("u"), F.col("size").alias("a"), "part").join(other, "token").where("u > v AND part <> other")
    met = met.groupBy("u", "v").agg(F.count("*").alias("c"), F.first("a").alias("a"), F.first("b").alias("b"))
    return staged(met.where(may_reach(F.col("c"), F.col("a"), F.col("b"))).select("u", "v"), "pairs")


def block_links(left: pa.Table, right: pa.Table) -> list[tuple[int, int]]:
    """Similar pairs of different components, one for each two components."""

    def side(rows: pa.Table) -> tuple:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("hashes").combine_chunks()]
        sizes = np.array(list(map(len, sets)))
        return rows.column("fp").to_numpy(), rows.column("part").to_numpy(), sizes, np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)

    (fp, part, size, mine, of), (fp2, part2, size2, theirs, of2) = side(left), side(right)
    common = np.intersect1d(mine, theirs)
    both = np.zeros((len(fp), len(fp2)), np.int64)

    def places(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(common, hashes)
        there = common[np.minimum(at, len(common) - 1)] == hashes
        return rows[there], at[there]

    if len(common):
        one, two = places(mine, of), places(theirs, of2)
        for first in range(0, len(common), COLUMNS):
            dense = []
            for (rows, at), n in ((one, len(fp)), (two, len(fp2))):
                inside = (at >= first) & (at < first + COLUMNS)
                matrix = np.zeros((n, min(COLUMNS, len(common) - first)), np.float32)
                matrix[rows[inside], at[inside] - first] = 1
                dense.append(matrix)
            both += (dense[0] @ dense[1].T).astype(np.int64)
    near = (9 * both >= 4 * (size[:, None] + size2[None, :])) & (part[:, None] != part2[None, :])
    found = {tuple(sorted((int(part[i]), int(part2[j])))): (int(fp[i]), int(fp2[j])) for i, j in zip(*np.nonzero(near))}
    return list(found.values())


def large_key_links(docs: DataFrame, distinct: DataFrame, live: DataFrame, text_col: str) -> DataFrame:
    """Links (u, v) of all pairs under keys of more than FEW classes."""
    hot = staged(live.where(F.col("n") > FEW).select("token", "fp", "size", "n", "part", "hub"), "hot")
    rank = F.struct("n", "token")
    # The dominant key of each key: the largest one that its hub stands under.
    largest = hot.groupBy("fp").agg(F.max(rank).alias("top")).select(F.col("fp").alias("hub"), "top")
    keys = hot.groupBy("token").agg(F.first("n").alias("n"), F.first("hub").alias("hub")).join(largest, "hub", "left")
    ruled = staged(keys.select("token", F.when(F.col("top") > rank, F.col("top.token")).alias("ruler")), "rulers")
    there = hot.select(F.col("token").alias("ruler"), "fp", F.lit(True).alias("inside"))
    marked = hot.join(ruled, "token").join(there, ["ruler", "fp"], "left").select("token", "fp", "size", "part", F.coalesce("inside", F.lit(False)).alias("inside"))
    marked = staged(marked, "marked")
    chunks = lambda n, size: F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(size / F.lit(BLOCK_SHINGLES))).cast("int")
    outside = ~F.col("inside")
    shape = marked.groupBy("token").agg(
        chunks(F.count_if(outside), F.coalesce(F.sum(F.when(outside, F.col("size"))), F.lit(0))).alias("lefts"),
        chunks(F.count("*"), F.sum("size")).alias("rights"),
    )
    marked2 = marked.join(staged(shape.where("lefts > 0"), "shape"), "token")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    left = marked2.where(outside).withColumn("i", place("lefts")).withColumn("j", upto("rights")).withColumn("left", F.lit(True))
    right = marked2.withColumn("j", place("rights")).withColumn("i", upto("lefts")).withColumn("left", F.lit(False))
    columns = ["token", "i", "j", "left", "fp", "part"]
    blocks = left.select(columns).unionByName(right.select(columns))
    wanted = staged(distinct.join(hot.select("fp").distinct(), "fp", "left_semi").select("fp", "text_key"), "wanted")
    sets = hash_sets(docs, wanted, text_col)

    def run(rows: pa.Table) -> pa.Table:
        one, two = rows.filter(rows.column("left")), rows.filter(pc.invert(rows.column("left")))
        found = block_links(one, two) if len(one) and len(two) else []
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    # Spark's estimates leave out how often a row was exploded; without the hint the driver might broadcast all blocks.
    out = staged(blocks.join(sets.hint("merge"), "fp").groupBy("token", "i", "j").applyInArrow(run, "u long, v long"), "block-links")
    release(hot, ruled, marked, wanted, sets)
    return out


# --- the operator ---------------------------------------------------------------------------


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, root): one row per row of docs; root names the group of near copies."""
    marked = staged(classes(docs, id_col, text_col), "classes")
    rows = marked.where(F.col("cells").isNull())
    counts = cell_counts(marked)
    named = staged(rows.groupBy("fp").agg(F.min("text_key").alias("text_key"), F.first("size").alias("size"), F.first("sim").alias("sim")), "named")
    # Equal texts have equal prefixes; Spark keeps one of each task before it shuffles.
    own = prefixes(docs, counts, text_col).groupBy("text_key").agg(F.first("tokens").alias("tokens"))
    distinct = staged(named.join(own, "text_key"), "distinct")
    release(named)
    shared = shared_keys(distinct)
    met = simhash_pairs(distinct)
    first = verified(docs, distinct, staged(hub_pairs(shared).unionByName(met).distinct(), "pairs"), text_col)
    release(met)
    roots = components(first)
    live = shared.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("part", F.coalesce("root", "fp")).drop("root")
    live = staged(live, "parts")
    # Keys whose classes are all linked already are done with.
    open_keys = staged(live.groupBy("token").agg((F.min("part") != F.max("part")).alias("open")).where("open").select("token"), "open")
    again = staged(live.join(open_keys, "token"), "live")
    release(shared, live, open_keys)
    second = verified(docs, distinct, counted_pairs(again), text_col)
    third = large_key_links(docs, distinct, again, text_col)
    release(again, roots)
    last = components(first.unionByName(second).unionByName(third))
    out = staged(distinct.select("fp").join(last.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    release(distinct, first, second, third, last)
    return rows.select("id", "text_key", "fp").join(out, "fp").select("id", "text_key", "root")


def keep_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of near copies the row with the smallest id (then text hash); all columns as they were."""
    return simhash.keep_least(docs, near_copies(docs, id_col, text_col), id_col, text_col)
