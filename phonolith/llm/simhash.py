"""Operator 2: SimHash near-duplicates by multi-index hashing.

Fingerprints are 64 bits: a bit is 1 if more than half of the text's 3-word
shingles (repeats included) have it set in their XXH64. Only distinct
fingerprints are compared; exact copies never meet each other.

Multi-index hashing: a fingerprint has two 32-bit segments. If two fingerprints
differ in at most 2 bits, one segment differs in at most 1. Each fingerprint is
stored in a table under both segments and looks up the Hamming ball of radius 1
around each; every match is verified by its complete distance. Of two segments
that differ in one bit, only the one with a 0 there looks up the other, so the
balls are half as large and no pair comes twice from the same segment.

Where more than ``BUCKET`` distinct fingerprints share a segment, comparing them
with each other would be quadratic. All fingerprints that look up such a bucket
take another exact way: two fingerprints differ in at most 2 bits if and only if
their radius-1 balls of the complete 64 bits meet, and at most 65 distinct
fingerprints lie around one meeting point, so it links them to its smallest.

Defined results: null, empty or word-free text has fingerprint 0, which links
like any other; fewer than 3 words are one shingle; repeated rows and equal
texts share a fingerprint; a null id belongs to its component but is never the
smallest (a component of null ids only has a null id); empty tables give no
rows; a very long text is one row (some 8 bytes of memory a word); other columns
are ignored or passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolith.llm.common import LOWER_BYTES, checked, mark, release, staged, table
from phonolith.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 2
SEGMENTS = 2
#: More distinct fingerprints than this under one segment go the meeting-point way.
BUCKET = 256

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: str | None) -> int:
    """The SimHash of a text as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    hashes = np.array(list(map(_hash, shingles)), dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[str | None, int] = {}
        out = np.empty(batch.num_rows, dtype=np.int64)
        for i, text in enumerate(batch.column(2)):
            text = text.as_py()
            if (found := seen.get(text)) is None:
                found = seen[text] = fingerprint(text)
            out[i] = found
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["id", "text_key", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, fp long) for each row; text_key is a hash of the text as it is."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints, f"id {kind}, text_key long, fp long")


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def _segment(fp: Column, number: int) -> Column:
    """The segment's 32 bits, with its number above them."""
    return F.shiftright(fp, 32 * number).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(number << 32))


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) that connect exactly what links of at most 2 differing bits connect.

    fps: distinct fingerprints, column fp.
    """
    stored = fps.select("fp", F.explode(F.array(*[_segment(F.col("fp"), i) for i in range(SEGMENTS)])).alias("key"))
    # Written out, so that the join shuffles both sides and Spark can split a hot segment.
    sizes = staged(stored.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket), "buckets")
    flagged = stored.join(sizes, "key", "left").select("key", F.when(F.col("n").isNull(), F.col("fp")).alias("other"))
    shelf = flagged.where(F.col("other").isNotNull()).unionByName(sizes.select("key", F.lit(None).cast("long").alias("other")))

    def ball(number: int) -> Column:
        key = _segment(F.col("fp"), number)
        flips = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: key.bitwiseOR(_bit(i)))
        return F.array_union(F.array(key), F.filter(flips, lambda x: x != key))

    asked = fps.select("fp", F.explode(F.concat(*[ball(i) for i in range(SEGMENTS)])).alias("key"))
    differing = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    # Spark's estimates leave the explosion out and would have the driver broadcast 34 rows of each fingerprint.
    met = asked.join(shelf.hint("merge"), (asked["key"] == shelf["key"]) & (F.col("other").isNull() | ((differing <= DISTANCE) & (F.col("fp") != F.col("other")))))
    met = staged(met.select("fp", "other").distinct(), "links")
    release(sizes)
    crowd = met.where(F.col("other").isNull()).select("fp")
    around = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(_bit(i))))
    points = crowd.select("fp", F.explode(around).alias("point")).groupBy("point").agg(F.collect_list("fp").alias("fps"))
    points = points.where(F.size("fps") > 1).select(F.explode("fps").alias("u"), F.array_min("fps").alias("v"))
    out = staged(met.where(F.col("other").isNotNull()).select(F.col("fp").alias("u"), F.col("other").alias("v")).unionByName(points), "links")
    release(met)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(id, text_key, fp, root, component): one row per row of docs.

    root names the component by a fingerprint, component by the smallest id reachable.
    """
    marked = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = staged(marked.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    linked = links(classes.select("fp"), bucket)
    roots = components(linked)
    named = staged(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    least = staged(named.groupBy("root").agg(F.min("first").alias("component")), "components")
    by_fp = staged(named.join(least, "root").select("fp", "root", "component"), "by-fingerprint")
    release(classes, linked, roots, named, least)
    return marked.join(by_fp, "fp").select("id", "text_key", "fp", "root", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component one row: that with the smallest id (then text hash); all columns as they were."""
    return keep_least(docs, near_duplicates(docs, id_col, text_col), id_col, text_col)


def keep_least(docs: DataFrame, grouped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each root of grouped (id, text_key, root) one row of docs, as in keep_one."""
    least = grouped.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("kept"))
    kept = least.select(F.col("kept.id").alias(mark("id")), F.col("kept.text_key").alias(mark("key")))
    own = checked(docs).withColumn(mark("hash"), F.xxhash64(text_col))
    same = F.col(id_col).eqNullSafe(F.col(mark("id"))) & (F.col(mark("hash")) == F.col(mark("key")))
    rows = own.join(kept, same, "left_semi")
    return rows.dropDuplicates([id_col, mark("hash")]).drop(mark("hash"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


QUERIES = {"op2_simhash_near_dedup": op2_simhash_near_dedup}
ORACLE: dict = {}
