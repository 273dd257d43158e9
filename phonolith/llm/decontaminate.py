"""Operator 1: benchmark decontamination.

A broadcast hash set of the benchmark's word n-grams is probed by every word
window of every document. Words are hashed once, windows are hashes of those
numbers; only a window whose hash is found is cut out and compared word by word
before it counts. DataFrame functions only.

Defined results
---------------
* null or empty text, and text without words: no words, nothing hit.
* an item with fewer than ``n`` words (but not none) is one shorter window.
* equal windows of several items hit all of these items; overlapping hits count
  each document word once.
* a very long text is probed window by window and never copied for each of them.
* repeated rows (same id, same text) each get their row; a null id is a value.
* an item with a null id marks words as hit but adds no id to the list.
* an empty document table gives no rows; an empty benchmark hits nothing.
* further columns of either table are ignored (reports) or passed through
  unchanged (filters), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolith.llm.common import LOWER, UPPER, checked, lower_ascii, mark, table, without

#: Runs of these are what lies between words (after A-Z is lower-cased).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Up to so many distinct benchmark windows of so many bytes in all are broadcast;
#: beyond that the windows are joined by a shuffle on the window hash.
MAX_BROADCAST_WINDOWS = 500_000
MAX_BROADCAST_BYTES = 64_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def benchmark_windows(benchmark: DataFrame, item_id: str, item_text: str, n: int) -> DataFrame:
    """Distinct windows with their items: gram array<string>, gram_hash long, items array<string>."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(item_text)).alias("w"))
    rows = rows.where(F.size("w") > 0).withColumn("len", F.least(F.lit(n), F.size("w")))
    rows = rows.select("item", "w", "len", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("at"))
    rows = rows.select("item", F.expr("slice(w, at, len)").alias("gram"))
    return rows.groupBy("gram").agg(F.collect_set("item").alias("items")).withColumn("hashes", word_hashes("gram")).withColumn("gram_hash", window_hash(F.lit(0), F.size("gram"), n)).drop("hashes")


def window_hash(at: Column, size: Column, n: int) -> Column:
    """The hash of size (at most n) of the column ``hashes`` from a place on; nulls add nothing, so no array is cut out."""
    return F.xxhash64(*[F.when(size > k, F.get("hashes", at + k)) for k in range(n)])


def word_hashes(words_col: str) -> Column:
    return F.transform(words_col, lambda w: F.xxhash64(w))


def _starts(size: int) -> Column:
    """Where the windows of this length start, for a column n_words."""
    each = F.transform(F.sequence(F.lit(0), F.col("n_words") - size), lambda i: F.struct(i.alias("at"), F.lit(size).alias("len")))
    return F.when(F.col("n_words") >= size, each).otherwise(F.array().cast("array<struct<at:int,len:int>>"))


def hits(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10) -> DataFrame:
    """One row per (id, text): key columns, copies, n_words, spans array<struct<at,len>>, items array<string>.

    One scan of the documents and one shuffle: every text adds a row of its own
    (``at`` = -1) to its hits, so neither counts nor clean documents need a join.
    """
    grams = benchmark_windows(benchmark, item_id, item_text, n)
    # The lengths are at most n integers; with the counts and bytes (as they lie in memory) they decide the plan.
    size = F.length(F.array_join("gram", "")) + F.length(F.array_join("items", "")) + 16 * (F.size("gram") + F.size("items")) + 64
    lengths = grams.groupBy(F.size("gram").alias("len")).agg(F.count("*").alias("windows"), F.sum(size).alias("bytes")).collect()
    small = sum(r["windows"] for r in lengths) <= MAX_BROADCAST_WINDOWS and sum(r["bytes"] for r in lengths) <= MAX_BROADCAST_BYTES
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), words(F.col(text_col)).alias("w"))
    texts = texts.select("id", "text_key", "w", F.size("w").alias("n_words"), word_hashes("w").alias("hashes"))
    starts = F.concat(
        F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("len"))),
        *[_starts(length) for length in sorted(r["len"] for r in lengths)],
    )
    windows = texts.select("id", "text_key", "w", "n_words", "hashes", F.explode(starts).alias("s"))
    # A text's own row has the text's hash as its key, so that these rows never meet in one partition.
    key = F.when(F.col("s.at") >= 0, window_hash(F.col("s.at"), F.col("s.len"), n)).otherwise(F.col("text_key"))
    windows = windows.select("id", "text_key", "n_words", "w", F.col("s.at").alias("at"), F.col("s.len").alias("len"), key.alias("h"))
    if not small:
        # The words travel with their window, not the whole text.
        windows = windows.withColumn("w", F.expr("CASE WHEN at >= 0 THEN slice(w, at + 1, len) END"))
    known = grams.select(F.col("gram").alias("known"), "gram_hash", "items")
    found = windows.join(F.broadcast(known) if small else known, F.col("h") == F.col("gram_hash"), "left")
    own = F.expr("slice(w, at + 1, len)") if small else F.col("w")
    hit = F.col("known").isNotNull() & (own == F.col("known"))
    found = found.where((F.col("at") < 0) | hit)
    # A row of its own whose key happens to be a window's is no hit.
    found = found.withColumn("items", F.when(F.col("at") >= 0, F.col("items")))
    return found.groupBy("id", "text_key").agg(
        F.count_if(F.col("at") < 0).alias("copies"),
        F.max("n_words").alias("n_words"),
        F.collect_set(F.when(F.col("at") >= 0, F.struct("at", "len"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )


def hit_words() -> Column:
    """The places of the words inside any of a text's ``spans``, each once."""
    return F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1))))


def report(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items (sorted), contaminated."""
    found = hits(docs, benchmark, **names)
    out = found.select(
        F.col("id").alias(names.get("id_col", "doc_id")),
        F.col("n_words").cast("long").alias("n_words"),
        F.size(hit_words()).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.array_sort("items").alias("items"),
        (F.size("spans") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(mark("copy")),
    )
    return out.drop(mark("copy"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The documents without any hit, all columns as they were."""
    found = hits(checked(docs), benchmark, **names).where(F.size("spans") > 0)
    bad = found.select(F.col("id").alias(mark("id")), F.col("text_key").alias(mark("key")))
    own = docs.withColumn(mark("hash"), F.xxhash64(names.get("text_col", "text")))
    same = F.col(names.get("id_col", "doc_id")).eqNullSafe(F.col(mark("id"))) & (F.col(mark("hash")) == F.col(mark("key")))
    return own.join(bad, same, "left_anti").drop(mark("hash"))


def remove_spans(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """All documents; the words of a hit are cut out of the text with the separators after them."""
    text_col = names.get("text_col", "text")
    found = hits(checked(docs), benchmark, **names).where(F.size("spans") > 0)
    bad = found.select(
        F.col("id").alias(mark("id")),
        F.col("text_key").alias(mark("key")),
        F.array_sort(hit_words()).alias(mark("cut")),
    )
    own = docs.withColumn(mark("hash"), F.xxhash64(text_col))
    same = F.col(names.get("id_col", "doc_id")).eqNullSafe(F.col(mark("id"))) & (F.col(mark("hash")) == F.col(mark("key")))
    joined = own.join(bad, same, "left")
    cut = F.col(mark("cut"))
    word = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"({word}[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*)"), F.lit(1))
    lead = F.regexp_extract(F.col(text_col), "^([\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*)", 1)
    # A column of its own, so that the text is taken apart once and not for every run.
    joined = joined.withColumn(mark("pieces"), F.when(cut.isNotNull(), pieces))
    kept = F.array_join(without(F.col(mark("pieces")), cut), "")
    cleaned = F.when(cut.isNull(), F.col(text_col)).otherwise(F.concat(lead, kept))
    return joined.withColumn(text_col, cleaned).select(*docs.columns)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op1_benchmark_decontamination": op1_benchmark_decontamination}

ORACLE = {
    "op1_benchmark_decontamination": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM g
), p AS (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k
), h AS (
  SELECT p.doc_id, p.i, p.k, g.item_id FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM p) p JOIN g USING (k, gram)
), c AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
}
