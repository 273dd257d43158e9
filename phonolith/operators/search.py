"""Lexical (trigram + BM25), vector and hybrid search.

A search is one candidate DataFrame with a ``score``; the total counts it and
the page orders it, always with the id last so that pages are the same each time.
Corpus statistics of BM25 are one aggregate row, joined by broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add, and_, or_
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonolith.functions.numbers import cosine, unit_interval
from phonolith.functions.text import like_pattern, nocase, occurrences, search_text
from phonolith.operators.filters import filtered
from phonolith.schema import RESULT_COLUMNS, TEXT_COLUMNS, Catalog, SearchMode, SearchQuery, SortDirection, SortField, ValidationError

#: BM25 and fusion weights, shortest token of the trigram index.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
VECTOR_WEIGHT, LEXICAL_WEIGHT, SPREAD_EPS = 0.65, 0.35, 1e-8
TOKEN_CHARS = 3
MODEL_ID = "phonolith-hash-v1"


class EmbeddingProvider(Protocol):
    model_id: str
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def index_tokens(text: str) -> list[str]:
    return [t for t in search_text(text).split() if len(t) >= TOKEN_CHARS]


def token_match(token: str) -> Column:
    return reduce(or_, [F.coalesce(F.contains(F.lower(F.col(c)), F.lit(token)), F.lit(False)) for c in TEXT_COLUMNS])


def lexical_kind(text: str, strict: bool = False) -> str:
    """'none', 'like' or 'fts' by the cleaned text's length; strict refuses what a query parser would."""
    cleaned = search_text(text)
    if not cleaned:
        return "none"
    if len(cleaned) < TOKEN_CHARS:
        return "like"
    if strict and any(c in cleaned for c in "-.'/,"):
        raise ValidationError(f"the search text has operators: {cleaned!r}")
    return "fts"


def lexical_match(text: str, strict: bool = False) -> Column:
    kind = lexical_kind(text, strict)
    if kind == "none":
        return F.lit(True)
    if kind == "like":
        return nocase(F.col("filename")).like(like_pattern(search_text(text)))
    found = index_tokens(text)
    return reduce(and_, map(token_match, found)) if found else F.lit(False)


def with_bm25(hits: DataFrame, assets: DataFrame, text: str) -> DataFrame:
    """hits and bm25 (lower is better); statistics are of all assets, in one pass and one row."""
    found = index_tokens(text)
    length = reduce(add, [F.greatest(F.lit(0), F.coalesce(F.length(c), F.lit(0)) - 2) for c in TEXT_COLUMNS])
    stats = assets.agg(F.count("*").alias("_n"), F.avg(length).alias("_avg"), *[F.count_if(token_match(t)).alias(f"_n{i}") for i, t in enumerate(found)])
    terms = []
    for i, t in enumerate(found):
        tf = reduce(add, [F.coalesce(occurrences(F.lower(F.col(c)), t), F.lit(0)) for c in TEXT_COLUMNS])
        idf = F.log((F.col("_n") - F.col(f"_n{i}") + 0.5) / (F.col(f"_n{i}") + 0.5))
        idf = F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF))
        terms.append(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("_avg"))))
    return hits.crossJoin(F.broadcast(stats)).withColumn("bm25", -reduce(add, terms)).drop("_n", "_avg", *[f"_n{i}" for i in range(len(found))])


def lexical_candidates(catalog: Catalog, q: SearchQuery, strict: bool = False) -> DataFrame:
    """All filtered hits; ``score`` is bm25 where there is one."""
    hits = filtered(catalog, q).where(lexical_match(q.text, strict))
    if lexical_kind(q.text) == "fts" and index_tokens(q.text):
        return with_bm25(hits, catalog.assets, q.text).withColumnRenamed("bm25", "score")
    return hits.withColumn("score", F.lit(None).cast("double"))


def lexical_order(q: SearchQuery, best_first: bool = False) -> list[Column]:
    """By default a falling order puts the worst bm25 first, as the score is lower for better hits."""
    up = q.sort_dir is SortDirection.ASC
    if q.sort_by is SortField.NAME:
        first = F.col("filename").asc() if up else F.col("filename").desc()
    elif q.sort_by is SortField.DURATION:
        first = F.col("duration_ms").asc_nulls_last() if up else F.col("duration_ms").desc_nulls_last()
    elif q.sort_by is SortField.DATE:
        first = F.col("indexed_at").asc() if up else F.col("indexed_at").desc()
    elif lexical_kind(q.text) == "fts":
        first = F.col("score").asc() if up or best_first else F.col("score").desc()
    else:
        first = F.col("filename").asc()
    return [first, F.col("id").asc()]


def vector_candidates(catalog: Catalog, q: SearchQuery, vector: list[float], model_id: str = MODEL_ID) -> DataFrame:
    """Filtered assets that have a vector of the model; ``similarity`` without a cut-off."""
    stored = catalog.embeddings.where(F.col("model_id") == model_id).select("asset_id", "vector")
    wanted = F.lit([float(x) for x in vector]) if vector else F.array().cast("array<double>")
    joined = filtered(catalog, q).join(stored, F.col("id") == F.col("asset_id"))
    return joined.withColumn("similarity", cosine(F.col("vector"), wanted)).drop("asset_id", "vector")


def score_order(q: SearchQuery) -> list[Column]:
    """By falling score; ties by name or duration if asked for (null is the shortest), then id."""
    up = q.sort_dir is SortDirection.ASC
    ties = {SortField.NAME: F.col("filename"), SortField.DURATION: F.coalesce(F.col("duration_ms"), F.lit(-(2**63)))}
    tie = ties.get(q.sort_by)
    return [F.col("score").desc(), *([] if tie is None else [tie.asc() if up else tie.desc()]), F.col("id").asc()]


def hybrid_candidates(catalog: Catalog, q: SearchQuery, vector: list[float], model_id: str = MODEL_ID) -> DataFrame:
    """Vector candidates; the score adds the lexical hit's bm25, scaled over all filtered lexical hits."""
    hits = lexical_candidates(catalog, q).select(F.col("id").alias("hit"), F.col("score").alias("bm25"))
    near = vector_candidates(catalog, q, vector, model_id)
    joined = near.join(hits, F.col("id") == F.col("hit"), "left")
    if lexical_kind(q.text) == "fts":
        spread = hits.agg(F.min("bm25").alias("_low"), F.max("bm25").alias("_high"))  # one row
        joined = joined.crossJoin(F.broadcast(spread))
        scaled = (F.col("_high") - F.col("bm25")) / (F.col("_high") - F.col("_low") + SPREAD_EPS)
        lexical = F.when(F.col("hit").isNull(), 0.0).when(F.col("_high") - F.col("_low") < SPREAD_EPS, 1.0).otherwise(scaled)
        joined = joined.withColumn("_lexical", lexical).drop("_low", "_high")
    else:
        joined = joined.withColumn("_lexical", F.when(F.col("hit").isNull(), 0.0).otherwise(1.0))
    score = VECTOR_WEIGHT * unit_interval(F.col("similarity")) + LEXICAL_WEIGHT * F.col("_lexical")
    return joined.withColumn("score", score).drop("hit", "bm25", "_lexical")


@dataclass(frozen=True)
class SearchResults:
    page: DataFrame
    candidates: DataFrame
    offset: int
    #: Whether the page's score column means anything.
    scored: bool

    @property
    def total(self) -> DataFrame:
        return self.candidates.agg(F.count("*").alias("total"))


def search(catalog: Catalog, q: SearchQuery, provider: EmbeddingProvider | None = None, vector: list[float] | None = None, model_id: str | None = None, best_first: bool = False, strict: bool = False) -> SearchResults:
    """Page and total; vector and hybrid modes embed the text with the provider unless a vector is given."""
    text = q.text.strip()
    if q.mode is SearchMode.LEXICAL or not text and vector is None:
        found, order, scored = lexical_candidates(catalog, q, strict), lexical_order(q, best_first), False
    else:
        if vector is None:
            if provider is None:
                raise ValidationError("vector search needs an embedding provider or a vector")
            vector = provider.embed([text if q.mode is SearchMode.VECTOR else search_text(text)])[0]
        model = model_id or (provider.model_id if provider else MODEL_ID)
        if q.mode is SearchMode.VECTOR:
            found = vector_candidates(catalog, q, vector, model).withColumn("score", F.col("similarity"))
        else:
            found = hybrid_candidates(catalog, q, vector, model)
        order, scored = score_order(q), True
    page = found.orderBy(*order).offset(q.offset).limit(q.limit).select(*[c for c in RESULT_COLUMNS if c in found.columns], "score")
    return SearchResults(page, found, q.offset, scored)
