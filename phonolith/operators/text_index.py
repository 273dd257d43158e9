"""A search index: trigrams of words, postings of words, and top-k pages by block bounds.

A search token has no white space, so each of its occurrences lies within one
word (a run without ASCII white space) of a lower-cased text column. The index
therefore has three tables, all written below one folder:

* ``grams`` (bucket, gram, word): each distinct word under its trigrams, in
  folders by the trigram's bucket. The rarest trigram of a token is looked up,
  and ``contains`` is asked of that trigram's words only, never of texts.
* ``postings`` (bucket, word, segment, block, ids, tfs, lengths, and the row's
  ``n``, ``most``, ``shortest``, ``longest``): a word's assets, in blocks of
  ``BLOCK`` ids, in folders by the word's bucket. Ids are offsets in their block
  in rising order, so Parquet stores their differences (its second format). Tasks
  pack what they read, so a block has a row for each slice of texts with its ids,
  and what is shuffled is about the index itself, once.
* ``live`` (id, segment, length): which segment's postings hold for an asset.

Counts of assets and of occurrences follow from the postings, so BM25 is exactly
that of a scan of the texts, which are not read.

Changes append a segment and write ``live`` anew; what an asset had in earlier
segments is not live any more, nor is what a failed attempt left. ``built`` again
when many postings are stale.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add, and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolith.functions.text import occurrences
from phonolith.operators.filters import filtered
from phonolith.operators.search import B, K1, LEAST_IDF, TOKEN_CHARS, SearchResults, index_tokens, lexical_candidates, lexical_kind, lexical_order
from phonolith.schema import RESULT_COLUMNS, TEXT_COLUMNS, Catalog, SearchQuery, SortField

#: Ids in a block; an entry of a posting is at most one asset.
BLOCK = 65_536
#: Assets for each bucket (folder), about.
BUCKET_ASSETS = 500_000
MAX_BUCKETS = 4096
#: Blocks that the first round of a top-k search reads; each further one reads twice as many.
FIRST_BLOCKS = 8
#: Bytes of text whose words a task packs at once.
SLICE_BYTES = 16 << 20
#: Rounding of a bound.
SLACK = 1e-12
POSTINGS = "word string, segment string, block long, n int, most int, shortest int, longest int, ids array<int>, tfs array<int>, lengths array<int>, bucket int"
_FORMAT = {"parquet.writer.version": "v2"}


@dataclass(frozen=True)
class TextIndex:
    folder: str
    buckets: int
    block: int
    grams: DataFrame
    postings: DataFrame
    live: DataFrame
    #: Whether every posting is live.
    exact: bool


def _bucket(column: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def _written(rows: DataFrame, keys: list[str], path: str, buckets: int, more: Sequence[Column] = ()) -> None:
    """Rows in folders by bucket; several tasks write to a folder, as many in all as a shuffle has, and sort a part each. More columns are made after the shuffle."""
    parts = -(-2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // buckets)
    dealt = F.pmod(F.xxhash64(*keys[1:]), F.lit(parts))
    rows.repartition("bucket", dealt).sortWithinPartitions(*keys).select(*keys, *more).write.mode("append").options(**_FORMAT).partitionBy("bucket").parquet(path)


def text_length() -> Column:
    return reduce(add, [F.greatest(F.lit(0), F.coalesce(F.length(c), F.lit(0)) - (TOKEN_CHARS - 1)) for c in TEXT_COLUMNS])


def _packed(words: pa.Array, ids: np.ndarray, lengths: np.ndarray, block: int) -> pa.RecordBatch:
    """The postings (word, block, entries) of texts, given as lists of words; entries are the ids, then the counts, then the lengths."""
    flat, of = pc.list_flatten(words), pc.list_parent_indices(words).to_numpy()
    long = pc.greater_equal(pc.utf8_length(flat), TOKEN_CHARS)
    flat, of = flat.filter(long).dictionary_encode(), of[long.to_numpy(zero_copy_only=False)]
    # Texts in the order of their ids, so that entries of one word and block follow each other in that order.
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    keys, tfs = np.unique(flat.indices.to_numpy().astype(np.int64) * len(ids) + place[of], return_counts=True)
    word, row = keys // max(1, len(ids)), order[keys % max(1, len(ids))]
    places, lengths = np.floor_divide(ids[row], block), lengths[row]
    first = np.flatnonzero(np.r_[True, (np.diff(word) != 0) | (np.diff(places) != 0)][: len(word)])
    own = np.r_[first, len(word)]
    # Where an entry's three numbers stand in its row.
    at, n = 3 * np.repeat(first, np.diff(own)) + np.arange(len(word)) - np.repeat(first, np.diff(own)), np.repeat(np.diff(own), np.diff(own))
    entries = np.empty(3 * len(word), np.int32)
    entries[at], entries[at + n], entries[at + 2 * n] = ids[row] - places * block, tfs, lengths
    columns = [flat.dictionary.take(pa.array(word[first])), pa.array(places[first]), pa.ListArray.from_arrays(pa.array((3 * own).astype(np.int32)), pa.array(entries))]
    return pa.RecordBatch.from_arrays(columns, names=["word", "block", "entries"])


def packed_postings(assets: DataFrame, block: int) -> DataFrame:
    """The postings of each slice of the texts that a task reads, for all words that a token can lie in."""
    text = F.concat_ws(" ", *[F.lower(F.coalesce(F.col(c), F.lit(""))) for c in TEXT_COLUMNS])
    rows = assets.where(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), text_length().cast("long").alias("length"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy())
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
                part = batch.slice(at, upto - at)
                words = pc.split_pattern_regex(part.column(2), "[ \\t\\n\\x0B\\f\\r]+")
                found = _packed(words, part.column(0).to_numpy(), part.column(1).to_numpy(), block)
                # Rows of many entries: Spark takes them in smaller batches.
                for first in range(0, found.num_rows, 65_536):
                    yield found.slice(first, 65_536)
                at = upto

    return rows.mapInArrow(run, "word string, block long, entries array<int>")


def unpacked() -> list[Column]:
    """The columns of a posting row and its facts, of its packed entries."""
    n = (F.size("entries") / 3).cast("int")
    part = lambda i: F.slice("entries", n * i + 1, n)
    facts = [n.alias("n"), F.array_max(part(1)).alias("most"), F.array_min(part(2)).alias("shortest"), F.array_max(part(2)).alias("longest")]
    return [*facts, part(0).alias("ids"), part(1).alias("tfs"), part(2).alias("lengths")]


def _append(assets: DataFrame, folder: str, buckets: int, block: int, segment: str) -> None:
    bucket = lambda c: _bucket(F.col(c), buckets).alias("bucket")
    postings = packed_postings(assets, block).select(bucket("word"), "word", "block", "entries")
    _written(postings, ["bucket", "word", "block"], f"{folder}/postings", buckets, [F.lit(segment).alias("segment"), *unpacked()])
    # The new segment's words only; a word that another segment has as well is there twice.
    own = assets.sparkSession.read.schema(POSTINGS).parquet(f"{folder}/postings").where(F.col("segment") == segment).select("word").distinct()
    starts = F.sequence(F.lit(1), F.length("word") - (TOKEN_CHARS - 1))
    grams = own.select("word", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substr(F.col("word"), i, F.lit(TOKEN_CHARS))))).alias("gram"))
    _written(grams.select(bucket("gram"), "gram", "word"), ["bucket", "gram", "word"], f"{folder}/grams", buckets)


def _read(spark: SparkSession, folder: str, live: str, buckets: int, block: int, exact: bool) -> TextIndex:
    # With the columns' types given, tables without rows can be read, and no file is opened for them.
    grams = spark.read.schema("gram string, word string, bucket int").parquet(f"{folder}/grams")
    postings = spark.read.schema(POSTINGS).parquet(f"{folder}/postings")
    return TextIndex(folder, buckets, block, grams, postings, spark.read.schema("id long, segment string, length long").parquet(f"{folder}/{live}"), exact)


def built(assets: DataFrame, folder: str, buckets: int | None = None, block: int = BLOCK) -> TextIndex:
    """A new index of all assets in an empty folder."""
    segment, folder = uuid.uuid4().hex, folder.rstrip("/")
    buckets = buckets or min(MAX_BUCKETS, 1 + assets.count() // BUCKET_ASSETS)
    _append(assets, folder, buckets, block, segment)
    assets.select("id", F.lit(segment).alias("segment"), text_length().cast("long").alias("length")).write.parquet(f"{folder}/live-{segment}")
    return _read(assets.sparkSession, folder, f"live-{segment}", buckets, block, True)


def changed(index: TextIndex, assets: DataFrame, gone: DataFrame) -> TextIndex:
    """The index after inserts and updates (assets: their new rows) and deletes (gone: column id)."""
    segment = uuid.uuid4().hex
    _append(assets, index.folder, index.buckets, index.block, segment)
    left = index.live.join(gone.select("id").unionByName(assets.select("id")).distinct(), "id", "left_anti")
    new = assets.select("id", F.lit(segment).alias("segment"), text_length().cast("long").alias("length"))
    left.unionByName(new).write.parquet(f"{index.folder}/live-{segment}")
    return _read(assets.sparkSession, index.folder, f"live-{segment}", index.buckets, index.block, False)


# --- words and postings of a search ---------------------------------------------------


def _grams_of(token: str) -> list[str]:
    return sorted({token[i : i + TOKEN_CHARS] for i in range(len(token) - TOKEN_CHARS + 1)})


def _under(index: TextIndex, grams: Sequence[str]) -> DataFrame:
    """The rows of some trigrams; only their buckets' folders are listed."""
    there = F.col("bucket").isin(*[_bucket(F.lit(g), index.buckets) for g in grams]) & F.col("gram").isin(*grams)
    return index.grams.where(there)


def matched_words(index: TextIndex, tokens: Sequence[str]) -> DataFrame | None:
    """(token, bucket, word, occ) of all words that contain a token (by number), and how often; None if some token is nowhere."""
    grams = sorted({g for t in tokens for g in _grams_of(t)})
    # One row for each trigram of the search.
    sizes = dict(_under(index, grams).groupBy("gram").agg(F.count("*")).collect())
    if any(g not in sizes for g in grams):
        return None
    parts = []
    for i, token in enumerate(tokens):
        rarest = min(_grams_of(token), key=lambda g: (sizes[g], g))
        words = _under(index, [rarest]).where(F.contains("word", F.lit(token))).select("word").distinct()
        parts.append(words.select(F.lit(i).alias("token"), _bucket(F.col("word"), index.buckets).alias("bucket"), "word", occurrences(F.col("word"), token).alias("occ")))
    return reduce(DataFrame.unionByName, parts)


def matched_postings(index: TextIndex, tokens: Sequence[str]) -> DataFrame | None:
    words = matched_words(index, tokens)
    return None if words is None else index.postings.join(words, ["bucket", "word"])


def hits_of(index: TextIndex, postings: DataFrame) -> DataFrame:
    """(token, id, tf, length) of matched postings; whole arrays are shuffled by block, and entries added up where they arrive."""
    dealt = postings.select("token", "occ", "segment", "block", "ids", "tfs", "lengths").repartition("token", "block")
    entries = F.inline(F.arrays_zip("ids", "tfs", "lengths"))
    rows = dealt.select("token", "block", "occ", "segment", entries)
    rows = rows.select("token", "block", "segment", (F.col("block") * index.block + F.col("ids")).alias("id"), (F.col("tfs") * F.col("occ")).alias("tf"), F.col("lengths").cast("long").alias("length"))
    if not index.exact:
        rows = rows.join(index.live.select("id", "segment"), ["id", "segment"], "left_semi")
    return rows.groupBy("token", "block", "id").agg(F.sum("tf").alias("tf"), F.first("length").alias("length")).drop("block")


@dataclass(frozen=True)
class Weights:
    """What BM25 needs of the whole library."""

    n: int
    average: float
    idf: tuple[float, ...]

    def part(self, token: int, tf: Column, length: Column) -> Column:
        return self.idf[token] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.average))


def weights(index: TextIndex, postings: DataFrame, tokens: Sequence[str]) -> Weights:
    """One pass over the postings' ids and one over ``live``; a row for each token comes here."""
    row = index.live.agg(F.count("*").alias("n"), F.avg("length").alias("average")).first()
    if index.exact:
        # An asset may have several of a token's words; blocks are counted by themselves.
        found = postings.groupBy("token", "block").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("n")).groupBy("token").agg(F.sum("n"))
    else:
        found = hits_of(index, postings).groupBy("token").agg(F.count("*"))
    counts = dict(found.collect())
    n = row["n"]
    # Through Spark, as the scan's logarithms are.
    logs = F.array(*[F.log(F.lit((n - counts.get(i, 0) + 0.5) / (counts.get(i, 0) + 0.5))) for i in range(len(tokens))])
    idf = index.live.sparkSession.range(1).select(logs).first()[0]
    return Weights(n, row["average"], tuple(x if x > 0 else LEAST_IDF for x in idf))


def scored_hits(index: TextIndex, postings: DataFrame, tokens: Sequence[str], w: Weights) -> DataFrame:
    """(id, score) of the assets with all tokens; score is BM25 with the sign of the scan's (lower is better)."""
    of = [F.max(F.when(F.col("token") == i, F.col("tf"))).alias(f"tf{i}") for i in range(len(tokens))]
    rows = hits_of(index, postings).groupBy("id").agg(F.first("length").alias("length"), *of)
    rows = rows.where(reduce(and_, [F.col(f"tf{i}").isNotNull() for i in range(len(tokens))]))
    return rows.select("id", (-reduce(add, [w.part(i, F.col(f"tf{i}"), F.col("length")) for i in range(len(tokens))])).alias("score"))


# --- searches -----------------------------------------------------------------------------


def indexed_candidates(index: TextIndex, catalog: Catalog, q: SearchQuery, strict: bool = False) -> DataFrame:
    """As search.lexical_candidates, without the notes; texts are not read if the search has tokens."""
    tokens = index_tokens(q.text)
    if lexical_kind(q.text, strict) != "fts" or not tokens:
        return lexical_candidates(catalog, q, strict).drop("notes")
    hits = filtered(catalog, q).drop("notes")
    postings = matched_postings(index, tokens)
    if postings is None:
        return hits.where(F.lit(False)).withColumn("score", F.lit(None).cast("double"))
    return hits.join(scored_hits(index, postings, tokens, weights(index, postings, tokens)), "id")


def indexed_search(index: TextIndex, catalog: Catalog, q: SearchQuery, best_first: bool = False, strict: bool = False) -> SearchResults:
    """A lexical page and total through the index; the page has no notes (``with_notes`` adds them)."""
    found = indexed_candidates(index, catalog, q, strict)
    page = found.orderBy(*lexical_order(q, best_first)).offset(q.offset).limit(q.limit)
    return SearchResults(page.select(*[c for c in RESULT_COLUMNS if c in found.columns], "score"), found, q.offset, False)


def with_notes(page: DataFrame, assets: DataFrame) -> DataFrame:
    """The page's rows with their texts; its ids (a page's worth) are literals, so the scan skips other row groups."""
    ids = [r["id"] for r in page.select("id").collect()]
    return page.join(F.broadcast(assets.where(F.col("id").isin(ids)).select("id", "notes")), "id", "left")


@dataclass(frozen=True)
class TopHits:
    page: DataFrame
    #: Blocks that hold all tokens, and how many of them were read.
    blocks: int
    read: int


def block_bounds(index: TextIndex, postings: DataFrame, tokens: Sequence[str], w: Weights, best: bool) -> list[tuple[int, float]]:
    """(block, the best or least score that an asset in it can have), best first; from the rows' facts, without their entries."""
    # A word's entry for an asset is in one of its rows, so the largest row counts.
    own = postings.groupBy("block", "token", "word").agg(F.max(F.col("most") * F.col("occ")).alias("most"), F.min("shortest").alias("shortest"), F.max("longest").alias("longest"))
    facts = own.groupBy("block", "token").agg(F.sum("most").alias("most"), F.min("shortest").alias("shortest"), F.max("longest").alias("longest"))
    of = lambda i, c: F.max(F.when(F.col("token") == i, F.col(c)))
    one = F.lit(1)
    part = [w.part(i, of(i, "most"), of(i, "shortest")) if best else w.part(i, F.when(of(i, "most").isNotNull(), one), of(i, "longest")) for i in range(len(tokens))]
    bounds = facts.groupBy("block").agg((-reduce(add, part)).alias("bound")).where(F.col("bound").isNotNull())
    # One row for each block of ids.
    return [(r["block"], r["bound"]) for r in bounds.orderBy(F.asc("bound") if best else F.desc("bound"), "block").collect()]


def top_hits(index: TextIndex, catalog: Catalog, q: SearchQuery, best_first: bool = True, first_blocks: int = FIRST_BLOCKS) -> TopHits:
    """The page of a search by relevance, reading blocks until no other one can have a hit that belongs to it.

    Rounds are jobs over a rising number of blocks, those of the best bounds first;
    offset + limit hits come here after each.
    """
    tokens = index_tokens(q.text)
    if q.sort_by is not SortField.RELEVANCE or lexical_kind(q.text) != "fts" or not tokens:
        raise ValueError("only a search with tokens that is sorted by relevance has bounds")
    best = best_first or q.sort_dir.value == "asc"
    spark, wanted = catalog.assets.sparkSession, q.offset + q.limit
    postings = matched_postings(index, tokens)
    order, held, read, bounds = lexical_order(q, best_first), [], 0, []
    if postings is not None:
        w = weights(index, postings, tokens)
        bounds = block_bounds(index, postings, tokens, w, best)
        allowed = filtered(catalog, q).select("id")
        while read < len(bounds):
            part = [b for b, _ in bounds[read : read + max(first_blocks, read)]]
            own = scored_hits(index, postings.where(F.col("block").isin(part)), tokens, w).join(allowed, "id", "left_semi")
            rows = [(r["id"], r["score"]) for r in own.orderBy(*order).limit(wanted).collect()]
            held = sorted(held + rows, key=lambda r: (r[1] if best else -r[1], r[0]))[:wanted]
            read += len(part)
            # Equal scores are ordered by id, so a bound that is reached is read.
            if len(held) == wanted and read < len(bounds) and (held[-1][1] - bounds[read][1]) * (1 if best else -1) < -SLACK * abs(bounds[read][1]):
                break
    top = spark.createDataFrame(held[q.offset :], "id long, score double")
    columns = [c for c in RESULT_COLUMNS if c != "notes"]
    found = catalog.assets.where(F.col("id").isin([i for i, _ in held[q.offset :]])).select(*columns).join(F.broadcast(top), "id")
    return TopHits(found.orderBy(*order).select(*columns, "score"), len(bounds), read)
