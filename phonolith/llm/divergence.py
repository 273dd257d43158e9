"""Operator 13: divergence of sources, by dense blocks of groups and terms.

Each language keeps the terms of at least ``min_docs`` of its documents. A group
is a source of a language. Tasks count the terms and documents of each group;
sums by (language, source, term), then by (language, term), give the kept terms
and their counts by group.

Kept terms are dealt into blocks, and the groups of a language into chunks of at
most ``CHUNK``; a tile is one block and two chunks. A task lays a tile out as two
dense ``int64`` matrices, groups by terms, of p, broadcasts all pairs of their
rows (some of them at a time) and sums the terms' values into the tile's matrix
of pairs. Spark sums these partial matrices over the blocks. The ten best terms
of each group in a block are a heap that Spark merges, at most ten rows for each
task and group.

All arithmetic is in whole numbers: p by long division in base 1000, so counts up
to 9e15 are exact (more is an error); squares are below 2**61.

Defined results: null text, language or source count as ''; repeated rows are
documents of their own; a group without terms is a group like any other; a
language without kept terms has pairs of value 0 and no terms; a language with
one source has no pairs; ties are ranked by the item's bytes; a very long text is
one row (some 100 bytes of memory for each of its different words beside the
text); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phonolith.llm.common import LOWER_BYTES, release, staged, table

MIN_DOCS = 10
TOP = 10
#: Fixed values of the contract: p is a share of SCALE, each count is raised by SMOOTH.
SCALE_STEPS, STEP, SMOOTH = 3, 1000, 2
#: Groups in a chunk at most, cells of a matrix of a tile about, numbers of a broadcast at most.
CHUNK = 512
CELLS = 32_768
BROADCAST = 1_000_000
#: Different (language, source, term) that a task holds before it passes them on.
HELD = 400_000
LARGEST = ((1 << 63) - 1) // STEP

#: A-Z to a-z, other ASCII characters but letters to spaces.
_TERMS = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256)).translate(LOWER_BYTES)


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; a null term counts the group's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = defaultdict(Counter)
        within: dict = defaultdict(Counter)
        groups: Counter = Counter()

        def passed(key: tuple) -> pa.RecordBatch:
            n, holding = counts.pop(key), within.pop(key)
            found = [t.decode("utf-8", "surrogatepass") for t in n]
            columns = [pa.array([key[0]] * len(n), pa.string()), pa.array([key[1]] * len(n), pa.string()), pa.array(found, pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([holding[t] for t in n], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            langs, sources = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, text in enumerate(batch.column(0)):
                key = langs[i] or "", sources[i] or ""
                words = terms(text.as_py())
                counts[key].update(words)
                within[key].update(set(words))
                groups[key] += 1
            if sum(map(len, counts.values())) > HELD:
                for key in list(counts):
                    yield passed(key)
        for key in list(counts):
            yield passed(key)
        seen = list(groups)
        columns = [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.nulls(len(seen), pa.string()), pa.array([0] * len(seen), pa.int64()), pa.array([groups[k] for k in seen], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    found = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# --- tiles ---------------------------------------------------------------------


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / total), in long division."""
    rest, out = counts + SMOOTH, np.zeros_like(counts)
    if rest.size and int(max(rest.max(), totals.max())) > LARGEST:
        raise OverflowError(f"counts above {LARGEST} are not exact")
    for _ in range(SCALE_STEPS):
        rest = rest * STEP
        digit = rest // totals
        out = out * STEP + digit
        rest = rest - digit * totals
    return out + 1


def values(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)), by broadcasting."""
    off = p - q
    # Unsigned division is the faster one; nothing here is negative.
    return ((off * off).view(np.uint64) // (p + q).view(np.uint64)).view(np.int64)


def pair_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum over the terms (columns) of the values of each row of a with each row of b."""
    out = np.zeros((len(a), len(b)), np.int64)
    step = max(1, BROADCAST // max(1, b.size))
    for at in range(0, len(a), step):
        out[at : at + step] = values(a[at : at + step, None, :], b[None, :, :]).sum(axis=2)
    return out


_TILE = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def tile(rows: pa.Table, top: int = TOP) -> pa.Table:
    """One tile's pairs and best terms.

    rows: a row for each group of the chunks (term null; n: its kept occurrences, total: kept terms of the
    language, block_terms: terms of the block, lang_n: kept occurrences of the language) and for each count
    (n of the group, total of the language).
    """
    head = rows.filter(rows.column("term").is_null())
    body = rows.filter(rows.column("term").is_valid())
    lang = head.column("lang")[0].as_py()
    sources, chunks, sizes = head.column("source").to_pylist(), head.column("chunk").to_numpy(), head.column("n").to_numpy()
    here = sorted(range(len(sources)), key=lambda i: (chunks[i], sources[i].encode()))
    sources, chunks, sizes = [sources[i] for i in here], chunks[here], sizes[here]
    place = {s: i for i, s in enumerate(sources)}
    vocabulary, block_terms, lang_n = (head.column(c)[0].as_py() for c in ("total", "block_terms", "lang_n"))
    coded = body.column("term").combine_chunks().dictionary_encode()
    names, column = coded.dictionary, coded.indices.to_numpy()
    counts = np.zeros((len(sources), len(names)), np.int64)
    at = np.array([place[s] for s in body.column("source").to_pylist()], np.int64)
    counts[at, column] = body.column("n").to_numpy()
    totals = np.zeros(len(names), np.int64)
    totals[column] = body.column("total").to_numpy()
    smooth = 2 * vocabulary
    p = shares(counts, (sizes + smooth)[:, None])
    first, last = (rows.column(c)[0].as_py() for c in ("low", "high"))
    left, right = np.flatnonzero(chunks == first), np.flatnonzero(chunks == last)
    sums = pair_sums(p[left], p[right])
    # Terms of the block that none of these groups has.
    absent = block_terms - len(names)
    if absent:
        empty = shares(np.zeros((len(sources), 1), np.int64), (sizes + smooth)[:, None])
        sums += absent * pair_sums(empty[left], empty[right])
    i, j = np.nonzero(left[:, None] != right[None, :])
    one, other, value = left[i], right[j], sums[i, j]
    if first != last:
        one, other, value = np.concatenate([one, other]), np.concatenate([other, one]), np.concatenate([value, value])
    named = pa.array(sources, pa.string())
    out = [(named.take(pa.array(one)), "pair", named.take(pa.array(other)), value)]
    if first == last and len(names):
        q = shares(totals, np.full(len(names), lang_n + smooth))
        ascending = np.argsort(np.argsort(np.array([t.encode() for t in names.to_pylist()], object)))
        score = values(p, q[None, :])
        good = (counts > 0) & (p > q[None, :])
        for g in range(len(sources)):
            mine = np.flatnonzero(good[g])
            best = mine[np.lexsort((ascending[mine], -score[g, mine]))[:top]]
            out.append((pa.array([sources[g]] * len(best), pa.string()), "term", names.take(pa.array(best)), score[g, best]))
    tables = [pa.table([pa.array([lang] * len(v), pa.string()), s, pa.array([part] * len(v), pa.string()), item, pa.array(v)], schema=_TILE) for s, part, item, v in out]
    return pa.concat_tables(tables)


# --- the operator ------------------------------------------------------------------


def audit(docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP, chunk: int = CHUNK, cells: int = CELLS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank)."""
    counts = staged(counted(docs, text_col, lang_col, source_col), "counts")
    by_term = counts.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"))
    kept = staged(by_term.where(F.col("docs") >= min_docs).select("lang", "term", "total"), "kept")
    own = staged(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "own")
    langs = kept.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("total").alias("lang_n"))
    sizes = own.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    there = counts.where(F.col("term").isNull()).select("lang", "source")
    groups = there.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = staged(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "vocabulary", "lang_n")]), "groups")
    release(counts)
    # Blocks by the language's terms, chunks by its groups; a group's chunk and a term's block follow from their hashes.
    shape = groups.groupBy("lang").agg(F.count("*").alias("g"), F.first("vocabulary").alias("vocabulary"))
    shape = staged(shape.select("lang", F.ceil(F.col("g") / chunk).cast("int").alias("chunks"), F.greatest(F.lit(1), F.ceil(F.col("vocabulary") * F.least(F.col("g"), F.lit(2 * chunk)) / cells)).cast("int").alias("blocks")), "shape")
    chunk_of = lambda c: F.pmod(F.xxhash64(c), F.col("chunks")).cast("int")
    block_of = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    filled = kept.join(shape, "lang").groupBy("lang", block_of.alias("block")).agg(F.count("*").alias("block_terms"))
    # Every pair of chunks that a chunk is in, as (low, high).
    tiles_of = lambda own: F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(own, o).alias("low"), F.greatest(own, o).alias("high")))
    head = groups.join(shape, "lang").withColumn("chunk", chunk_of("source"))
    head = head.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(filled, ["lang", "block"], "left")
    head = head.select("lang", "block", "source", "chunk", "chunks", F.lit(None).cast("string").alias("term"), "n", F.col("vocabulary").alias("total"), F.coalesce("block_terms", F.lit(0)).alias("block_terms"), "lang_n")
    none = F.lit(None).cast("long")
    body = own.join(shape, "lang").select("lang", block_of.alias("block"), "source", chunk_of("source").alias("chunk"), "chunks", "term", "n", "total", none.alias("block_terms"), none.alias("lang_n"))
    dealt = head.unionByName(body).withColumn("tile", F.explode(tiles_of(F.col("chunk")))).select("lang", "block", F.col("tile.low").alias("low"), F.col("tile.high").alias("high"), "source", "chunk", "term", "n", "total", "block_terms", "lang_n")
    found = dealt.groupBy("lang", "block", "low", "high").applyInArrow(lambda rows: tile(rows, top), "lang string, source string, part string, item string, value long")
    found = staged(found, "tiles")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    best = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.unionByName(best)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


#: The same in SQL: term counts, shares in 128-bit numbers, pairs of a language's sources over its kept terms.
SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents
), words AS (
  SELECT d, lang, source, unnest(terms) AS term FROM docs
), counts AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT d) AS docs FROM words GROUP BY lang, source, term
), kept AS (
  SELECT lang, term, sum(n) AS total FROM counts GROUP BY lang, term HAVING sum(docs) >= 10
), langs AS (
  SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang
), groups AS (
  SELECT g.lang, g.source, coalesce(l.v, 0) AS v, coalesce(l.n, 0) AS lang_n, coalesce((SELECT sum(c.n) FROM counts c JOIN kept k ON k.lang = c.lang AND k.term = c.term WHERE c.lang = g.lang AND c.source = g.source), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs l ON l.lang = g.lang
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2)) // (g.n + 2 * g.v) AS HUGEINT) AS p,
    CAST(1 + (CAST(1000000000 AS HUGEINT) * (k.total + 2)) // (g.lang_n + 2 * g.v) AS HUGEINT) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM cells WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

QUERIES = {"op13_source_divergence": op13_source_divergence}
ORACLE = {"op13_source_divergence": SQL}
