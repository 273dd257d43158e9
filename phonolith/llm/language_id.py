"""Operator 8: language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent letter n-grams (1 to 3
letters, words padded with a blank on both sides), by falling count and then
by code. A document's own profile is compared with each language's by the
out-of-place distance: the sum of rank differences, and the profile's length
for an n-gram that the language lacks. The nearest language wins.

n-grams are 64-bit numbers of three code points, so counting is sorting.
Learning counts n-grams of all rows given; counts are summed in each task, then
by n-gram. The top of each language is first taken within hashed parts, so
the driver gets at most (languages x parts x profile length) rows; more than
``MAX_LANGUAGES`` different values of the language column are an error.

Letters are Unicode's letters and the marks that combine with them; digits of
any kind, signs and numbers like superscripts are not.

Defined results: null text or text without a letter is ``und`` with score 0;
a very long text is counted in chunks that end between words;
ties go to the language whose name sorts first; rows with null language teach
nothing; if nothing can be learnt, everything is ``und``; repeated rows count
as often as they occur; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phonolith.llm.common import SQL_CRC_TABLE, crc_mod, sql_crc_mod, staged, table

#: Entries of a profile, of a language and of a document.
PROFILE = 400
#: Hashed parts in which a language's top is taken first.
PARTS = 8
#: Characters of a text that are turned into n-grams at a time.
CHUNK = 1_000_000
#: A task passes its sums on when it holds so many n-grams.
HELD = 2_000_000
#: Profiles of so many languages are 32 MB at most.
MAX_LANGUAGES = 5_000

_other = regex.compile(r"[^\p{L}\p{M}]+").sub
_letter = regex.compile(r"\p{L}").search


def letters(text: str | None) -> str:
    """The text's words of letters in lower case, blanks between and around; '' without a letter."""
    found = _other(" ", (text or "").lower()).strip()
    return f" {found} " if _letter(found) else ""


def _grams(padded: str) -> np.ndarray:
    """Codes of the 1- to 3-grams that have no blank inside; 21 bits a letter, first letter highest."""
    points = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    blank = points == 32
    two = points[:-1] << 42 | points[1:] << 21
    three = two[:-1] | points[2:]
    return np.concatenate([(points << 42)[~blank], two[~(blank[:-1] & blank[1:])], three[~blank[1:-1]]])


def counted(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and their (summed) counts."""
    if weights is None:
        codes = np.sort(codes)
        at = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
        return codes[at], np.diff(np.append(at, len(codes)))
    # Mostly a few sorted runs after each other, which a stable sort merges.
    order = np.argsort(codes, kind="stable")
    codes, weights = codes[order], weights[order]
    at = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[at], np.add.reduceat(weights, at) if len(at) else weights


def gram_counts(padded: str) -> tuple[np.ndarray, np.ndarray]:
    """n-gram codes and counts of a text from letters(); long texts are cut at blanks, in chunks."""
    if len(padded) <= CHUNK:
        return counted(_grams(padded))
    parts, at = [], 0
    while at < len(padded) - 1:
        end = padded.rfind(" ", at + 1, at + CHUNK)
        if end <= at:
            end = padded.find(" ", at + 1)
        parts.append(counted(_grams(padded[at : end + 1])))
        at = end
    # A blank at a cut belongs to both chunks, as it does to both words.
    return counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The codes of the profile, best first; codes must be sorted."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> dict[str, np.ndarray]:
    """language -> n-gram codes, best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        total = 0

        def passed():
            for lang, parts in held.items():
                codes, counts = counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if padded := letters(text.as_py()):
                    texts.setdefault(lang, []).append(padded)
            for lang, own in texts.items():
                part, size_now = [], 0
                for padded in own:
                    part.append(padded)
                    size_now += len(padded)
                    if size_now >= CHUNK:
                        held.setdefault(lang, []).append(gram_counts("".join(part)))
                        total, part, size_now = total + len(held[lang][-1][0]), [], 0
                if part:
                    held.setdefault(lang, []).append(gram_counts("".join(part)))
                    total += len(held[lang][-1][0])
            if total > HELD:
                yield from passed()
                held, total = {}, 0
        yield from passed()

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sums = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.desc("n"), "gram"))
    # In parts first, so that no task has all n-grams of a language.
    top = sums.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(PARTS))).withColumn("place", first("part")).where(F.col("place") <= size)
    top = staged(top.select("lang", "gram", first().alias("place")).where(F.col("place") <= size), "profiles")
    if (languages := top.select("lang").distinct().count()) > MAX_LANGUAGES:
        raise ValueError(f"{languages} languages; at most {MAX_LANGUAGES} profiles can be sent to the tasks")
    found = top.toArrow().sort_by([("lang", "ascending"), ("place", "ascending")])  # languages x size rows
    names, first_rows = np.unique(found.column("lang").to_numpy(zero_copy_only=False).astype(object), return_index=True) if len(found) else ([], [])
    return dict(zip(names, np.split(found.column("gram").to_numpy(), first_rows[1:])))


class Profiles:
    """All languages' ranks by n-gram, for comparison with a document's profile: 12 bytes an entry at most."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.names, self.size = list(profiles), size
        sizes = list(map(len, profiles.values()))
        codes = np.concatenate([*profiles.values(), np.zeros(0, np.int64)])
        order = np.argsort(codes, kind="stable")
        self.codes, starts = np.unique(codes[order], return_index=True)
        #: Entries of the n-gram i are those from starts[i] to starts[i + 1].
        self.starts = np.append(starts, len(codes)).astype(np.int32)
        self.languages = np.repeat(np.arange(len(sizes), dtype=np.int16), sizes)[order]
        self.ranks = np.concatenate([*[np.arange(n, dtype=np.int16) for n in sizes], np.zeros(0, np.int16)])[order]

    def nearest(self, padded: str) -> tuple[str, float]:
        """(language, 1 minus the share of the largest possible distance)."""
        if not padded or not self.names:
            return "und", 0.0
        own = ranked(*gram_counts(padded), self.size)
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        known = np.flatnonzero(self.codes[at] == own)
        first, last = self.starts[at[known]], self.starts[at[known] + 1]
        many = last - first
        entries = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
        # What each n-gram in common takes from the largest distance.
        nearer = self.size - np.abs(self.ranks[entries].astype(np.int64) - np.repeat(known, many))
        apart = self.size * len(own) - np.bincount(self.languages[entries], nearer, minlength=len(self.names)).astype(np.int64)
        best = int(np.argmin(apart))
        return self.names[best], float(1 - apart[best] / (self.size * len(own)))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """(id, lang_pred, score), one row per row of docs; no shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(Profiles(profiles, size))  # languages x size entries
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = shipped.value.nearest
        for batch in batches:
            found = [nearest(letters(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    found = predict(docs, learn(docs.where(~held_out)))
    return found.select(F.col("id").alias("doc_id"), (crc_mod(F.col("id"), 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language_id": op8_language_id}


def _sql() -> str:
    held_out = f"{sql_crc_mod('doc_id', 4)} = 2"
    best = "row_number() OVER (PARTITION BY {} ORDER BY n DESC, gram)"
    return f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, lang, {held_out} AS held_out, CASE WHEN regexp_matches(text, '\\p{{L}}') THEN string_split(' ' || trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{M}}]+', ' ', 'g')) || ' ', '') END AS c FROM documents, {SQL_CRC_TABLE}
), p AS (SELECT doc_id, lang, held_out, c, unnest(range(1, len(c) + 1)) AS i FROM d WHERE c IS NOT NULL
), x AS (
  SELECT doc_id, lang, held_out, c[i] AS one, c[i + 1] AS two, c[i + 2] AS three FROM p
), g AS MATERIALIZED (
  SELECT doc_id, lang, held_out, gram, count(*) AS n FROM (
    SELECT doc_id, lang, held_out, unnest([CASE WHEN one <> ' ' THEN one END, one || two, CASE WHEN two <> ' ' THEN one || two || three END]) AS gram FROM x
  ) WHERE gram IS NOT NULL GROUP BY ALL
), l AS (
  SELECT lang, gram, {best.format('lang')} - 1 AS rank FROM (SELECT lang, gram, sum(n) AS n FROM g WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, gram) QUALIFY rank < {PROFILE}
), o AS MATERIALIZED (SELECT doc_id, gram, {best.format('doc_id')} - 1 AS rank FROM g QUALIFY rank < {PROFILE}
), a AS (
  SELECT doc_id, k.lang, sum(coalesce(abs(l.rank - o.rank), {PROFILE})) AS apart, count(*) AS own
  FROM o CROSS JOIN (SELECT DISTINCT lang FROM l) k LEFT JOIN l ON l.lang = k.lang AND l.gram = o.gram GROUP BY doc_id, k.lang
), b AS (SELECT doc_id, lang, 1 - apart / ({PROFILE} * own) AS score FROM a QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY apart, lang) = 1)
SELECT d.doc_id, d.held_out, coalesce(b.lang, 'und') AS lang_pred, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM d LEFT JOIN b ON d.doc_id = b.doc_id
"""


ORACLE = {"op8_language_id": _sql()}
