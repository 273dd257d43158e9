"""Registered queries over the catalog and, for each that SQL can express, its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolith.functions import numbers as N
from phonolith.functions import text as S
from phonolith.operators import audio, browse, search, signal, text_index, vector_index, writes
from phonolith.operators.filters import filtered, tagged_any
from phonolith.operators.paging import page_at
from phonolith.plans.adapters import ASSET_TAGS_SQL, ASSETS_SQL, EMBEDDINGS_SQL, MODEL_ID, SAMPLES_SQL, TAGS_SQL, assets, catalog, query_vector, samples, table
from phonolith.schema import SearchMode, SearchQuery, SortDirection, SortField
from phonolith.sources import files
from phonolith.sources.scratch import scratch_folder, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

WITH = {"a": ASSETS_SQL, "t": TAGS_SQL, "l": ASSET_TAGS_SQL, "e": EMBEDDINGS_SQL, "s": SAMPLES_SQL}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None, views: str = "a") -> None:
    """Register a query; views names the shared views that its SQL needs."""
    QUERIES[name] = query
    if sql is not None:
        parts = [WITH[v] for v in views] + ([sql.strip()[5:].strip()] if sql.strip().startswith("WITH ") else [])
        body = "" if sql.strip().startswith("WITH ") else sql
        ORACLE[name] = f"WITH {', '.join(parts)} {body}" if parts else sql


# --- lexical search -----------------------------------------------------------------


def lexical(q: SearchQuery, *columns: str, best_first: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        page = search.search(catalog(spark, sf_dir), q, best_first=best_first).page
        return page.withColumn("score", F.round("score", 6)).select("id", *columns)

    return run


def bm25_sql(tokens: list[str], where: str = "true") -> str:
    """Hits with bm25 for tokens over the text columns of assets; the filters apply to the hits only."""
    columns = ("filename", "folder", "category", "publisher", "notes")
    # These tokens do not overlap with themselves.
    tf = lambda t: " + ".join(f"coalesce((length({c}) - length(replace(lower({c}), '{t}', ''))) // {len(t)}, 0)" for c in columns)
    length = " + ".join(f"greatest(0, coalesce(length({c}), 0) - 2)" for c in columns)
    tfs = ", ".join(f"({tf(t)}) AS tf{i}" for i, t in enumerate(tokens))
    idf = lambda i: f"CASE WHEN ln((n - n{i} + 0.5e0) / (n{i} + 0.5e0)) > 0 THEN ln((n - n{i} + 0.5e0) / (n{i} + 0.5e0)) ELSE 1e-6 END"
    score = " + ".join(f"({idf(i)}) * tf{i} * 2.2e0 / (tf{i} + 1.2e0 * (0.25e0 + 0.75e0 * len / avg_len))" for i in range(len(tokens)))
    return f"""WITH x AS (SELECT *, ({length}) AS len, {tfs} FROM assets),
 st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len) AS avg_len, {', '.join(f'count(*) FILTER (tf{i} > 0) AS n{i}' for i in range(len(tokens)))} FROM x),
 hits AS (SELECT x.*, -({score}) AS bm25 FROM x, st WHERE {' AND '.join(f'tf{i} > 0' for i in range(len(tokens)))} AND ({where}))"""


NAMES = ("filename", "folder")
WAV_OR_MP3 = "extension IN ('wav', 'mp3')"
PAGE = "id, filename, folder, round(bm25, 6) AS score"

add("lexical_search_bm25", lexical(SearchQuery("tion"), *NAMES, "score"), f"{bm25_sql(['tion'])} SELECT {PAGE} FROM hits ORDER BY bm25 DESC, id LIMIT 50")
add("lexical_best_first", lexical(SearchQuery("tion"), *NAMES, "score", best_first=True), f"{bm25_sql(['tion'])} SELECT {PAGE} FROM hits ORDER BY bm25, id LIMIT 50")
add("lexical_multi_token", lexical(SearchQuery("the src1", sort_dir=SortDirection.ASC), *NAMES, "score"), f"{bm25_sql(['the', 'src1'])} SELECT {PAGE} FROM hits ORDER BY bm25, id LIMIT 50")
add("lexical_stopwords", lexical(SearchQuery('(ing) AND "the" or  ent', limit=20), *NAMES, "score"), f"{bm25_sql(['ing', 'the', 'ent'])} SELECT {PAGE} FROM hits ORDER BY bm25 DESC, id LIMIT 20")
add("lexical_short_tokens_empty", lexical(SearchQuery("a b"), *NAMES), "SELECT id, filename, folder FROM assets WHERE false")
add("lexical_like_short", lexical(SearchQuery("th"), *NAMES), "SELECT id, filename, folder FROM assets WHERE lower(filename) LIKE '%th%' ORDER BY filename, id LIMIT 50")
add("lexical_like_wildcard", lexical(SearchQuery("_n"), *NAMES), "SELECT id, filename, folder FROM assets WHERE lower(filename) LIKE '%_n%' ORDER BY filename, id LIMIT 50")
add("lexical_blank", lexical(SearchQuery("  "), *NAMES), "SELECT id, filename, folder FROM assets ORDER BY filename, id LIMIT 50")
add("lexical_filtered", lexical(SearchQuery("ing", favorites_only=True, sort_dir=SortDirection.ASC), *NAMES, "score"), f"{bm25_sql(['ing'], 'favorite')} SELECT {PAGE} FROM hits ORDER BY bm25, id LIMIT 50")
add("search_total", lambda s, d: search.search(catalog(s, d), SearchQuery("tion", extensions=["wav", "mp3"])).total, f"{bm25_sql(['tion'], WAV_OR_MP3)} SELECT count(*) AS total FROM hits")

# --- lexical search through the index ---------------------------------------------------


@cache
def _text_index(application: str, sf_dir: str) -> text_index.TextIndex:
    spark = SparkSession.active()
    return text_index.built(assets(spark, sf_dir), scratch_folder(spark, "text-index"), buckets=16, block=256)


def indexed(q: SearchQuery, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = _text_index(spark.sparkContext.applicationId, sf_dir)
        return text_index.indexed_search(index, catalog(spark, sf_dir), q).page.withColumn("score", F.round("score", 6)).select("id", *columns)

    return run


def indexed_top(q: SearchQuery, best_first: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = _text_index(spark.sparkContext.applicationId, sf_dir)
        found = text_index.top_hits(index, catalog(spark, sf_dir), q, best_first, first_blocks=1)
        return found.page.withColumn("score", F.round("score", 6)).select("id", *NAMES, "score")

    return run


def index_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of every third asset change, every fifth goes, copies of every seventh come; then a search."""
    whole = catalog(spark, sf_dir)
    before = whole.assets.where("id % 7 <> 3")
    index = text_index.built(before, scratch_folder(spark, "text-index"), buckets=4, block=256)
    edited = before.where("id % 3 = 0").withColumn("notes", F.concat(F.lit("Mention of tion "), "notes"))
    index = text_index.changed(index, edited, before.where("id % 5 = 0").select("id"))
    came = whole.assets.where("id % 7 = 3").withColumn("notes", F.concat("notes", F.lit(" tion MEN")))
    index = text_index.changed(index, came, before.where("id % 5 = 0").select("id"))
    now = before.where("id % 3 <> 0").unionByName(edited).where("id % 5 <> 0").unionByName(came)
    page = text_index.indexed_search(index, replace(whole, assets=now), SearchQuery("tion men", limit=200)).page
    return page.select("id", *NAMES, F.round("score", 6).alias("score"))


def index_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each token the words that contain it, the assets with them and its occurrences, from the postings alone."""
    index = _text_index(spark.sparkContext.applicationId, sf_dir)
    tokens = ["tion", "ing", "src1"]
    found = text_index.hits_of(index, text_index.matched_postings(index, tokens))
    name = F.element_at(F.array(*map(F.lit, tokens)), F.col("token") + 1).alias("name")
    return found.groupBy(name).agg(F.count("*").alias("n_assets"), F.sum("tf").cast("long").alias("n_occurrences"), F.sum("length").alias("length"))


CHANGED = """assets AS (SELECT * REPLACE (CASE WHEN id % 7 = 3 THEN notes || ' tion MEN' WHEN id % 3 = 0 THEN 'Mention of tion ' || notes ELSE notes END AS notes) FROM first_assets WHERE id % 7 = 3 OR id % 5 <> 0)"""
_changed = bm25_sql(["tion", "men"]).replace("WITH x AS", f"WITH {ASSETS_SQL.replace('assets AS', 'first_assets AS', 1)}, {CHANGED}, x AS", 1)
add("index_search_bm25", indexed(SearchQuery("tion"), *NAMES, "score"), ORACLE["lexical_search_bm25"], "")
add("index_multi_token", indexed(SearchQuery("the src1", sort_dir=SortDirection.ASC), *NAMES, "score"), ORACLE["lexical_multi_token"], "")
add("index_stopwords", indexed(SearchQuery('(ing) AND "the" or  ent', limit=20), *NAMES, "score"), ORACLE["lexical_stopwords"], "")
add("index_filtered", indexed(SearchQuery("ing", favorites_only=True, sort_dir=SortDirection.ASC), *NAMES, "score"), ORACLE["lexical_filtered"], "")
add("index_nothing", indexed(SearchQuery("tion zzqqzz"), *NAMES), "SELECT id, filename, folder FROM assets WHERE false")
add("index_top_best", indexed_top(SearchQuery("tion"), True), ORACLE["lexical_best_first"], "")
add("index_top_worst", indexed_top(SearchQuery("tion"), False), ORACLE["lexical_search_bm25"], "")
add("index_top_multi", indexed_top(SearchQuery("the src1", sort_dir=SortDirection.ASC), False), ORACLE["lexical_multi_token"], "")
add("index_after_changes", index_after_changes, f"{_changed} SELECT {PAGE} FROM hits ORDER BY bm25 DESC, id LIMIT 200", "")
add("index_audit", index_audit, " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_assets, CAST(sum(tf0) AS BIGINT) AS n_occurrences, CAST(sum(len) AS BIGINT) AS length FROM ({bm25_sql([t])} SELECT * FROM x WHERE tf0 > 0)" for t in ("tion", "ing", "src1")))

# --- filters and sorts -----------------------------------------------------------------


def filter_query(**filters) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: filtered(catalog(s, d), SearchQuery(**filters)).select("id", "path")


TAGGED = "id IN (SELECT asset_id FROM asset_tags JOIN tags ON tags.id = tag_id WHERE lower(name) IN ('toxic', 'lq'))"
FILTERS = {
    "extension": (dict(extensions=["wav", "flac"]), "extension IN ('wav', 'flac')"),
    "extension_case": (dict(extensions=["WAV"]), "extension = 'WAV'"),
    "duration": (dict(duration_min=5000, duration_max=20000), "duration_ms BETWEEN 5000 AND 20000"),
    "sample_rate": (dict(sample_rates=[48000, 22050]), "sample_rate IN (48000, 22050)"),
    "channels": (dict(channels=2), "channels = 2"),
    "favorite": (dict(favorites_only=True), "favorite"),
    "publisher": (dict(publisher="src3"), "publisher = 'src3'"),
    "publisher_blank": (dict(publisher=""), "publisher = ''"),
    "tags": (dict(tags=["TOXIC", "LQ"]), TAGGED),
    "folder": (dict(folder_root="/lib/src1"), "(folder = '/lib/src1' OR starts_with(folder, '/lib/src1/'))"),
    "folder_root": (dict(folder_root="/"), "true"),
    "folder_empty": (dict(folder_root=""), "false"),
    "folder_trailing_slash": (dict(folder_root="/lib/src1/"), "(folder = '/lib/src1/' OR starts_with(folder, '/lib/src1//'))"),
    "all": (
        dict(extensions=["wav", "mp3", "aif"], duration_min=1000, sample_rates=[44100, 96000], channels=1, tags=["hq"], folder_root="/lib"),
        "extension IN ('wav', 'mp3', 'aif') AND duration_ms >= 1000 AND sample_rate IN (44100, 96000) AND channels = 1 AND starts_with(folder, '/lib/') AND id IN (SELECT asset_id FROM asset_tags WHERE tag_id = 1)",
    ),
}
for _name, (_filters, _where) in FILTERS.items():
    add(f"filter_{_name}", filter_query(**_filters), f"SELECT id, path FROM assets WHERE {_where}", "atl")

SORTS = {SortField.NAME: "filename", SortField.DURATION: "duration_ms", SortField.DATE: "indexed_at"}
for _field, _column in SORTS.items():
    for _dir in SortDirection:
        _q = SearchQuery(sort_by=_field, sort_dir=_dir, offset=25, limit=40)
        add(f"sort_{_field.value}_{_dir.value}", lexical(_q, "filename", "duration_ms"), f"SELECT id, filename, duration_ms FROM assets ORDER BY {_column} {_dir.value} NULLS LAST, id LIMIT 40 OFFSET 25")



def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that begins after two thirds of all hits."""
    q = SearchQuery("ing", sort_by=SortField.NAME, sort_dir=SortDirection.ASC)
    found = search.lexical_candidates(catalog(spark, sf_dir), q)
    return page_at(found, search.lexical_order(q), found.count() * 2 // 3, 50).select("id", "filename", F.round("score", 6).alias("score"))


add("page_deep", deep_page, f"{bm25_sql(['ing'])}, p AS (SELECT *, row_number() OVER (ORDER BY filename, id) AS nth, count(*) OVER () AS n FROM hits) SELECT id, filename, round(bm25, 6) AS score FROM p WHERE nth > n * 2 // 3 AND nth <= n * 2 // 3 + 50")

# --- vectors ------------------------------------------------------------------------------

COS = "list_sum(list_transform(list_zip(v, q.w), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(v, lambda x: x * x))) * sqrt(list_sum(list_transform(q.w, lambda x: x * x))))"
NEAR = f"near AS (SELECT assets.*, {COS} AS sim FROM assets JOIN emb ON id = asset_id, (SELECT v AS w FROM emb WHERE asset_id = 7) q)"


def vector_page(q: SearchQuery, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        page = search.search(catalog(spark, sf_dir), q, vector=query_vector(spark, sf_dir), model_id=MODEL_ID).page
        return page.withColumn("score", F.round("score", 5)).select("id", "score", *columns)

    return run


VECTOR, BOTH = SearchMode.VECTOR, SearchMode.BOTH
add("vector_topk", vector_page(SearchQuery("x", VECTOR, limit=20)), f"WITH {NEAR} SELECT id, round(sim, 5) AS score FROM near ORDER BY sim DESC, id LIMIT 20", "ae")
add("vector_filtered", vector_page(SearchQuery("x", VECTOR, channels=2, folder_root="/lib", limit=20, sort_by=SortField.DURATION)), f"WITH {NEAR} SELECT id, round(sim, 5) AS score FROM near WHERE channels = 2 AND starts_with(folder, '/lib/') ORDER BY sim DESC, coalesce(duration_ms, -9223372036854775808) DESC, id LIMIT 20", "ae")
add("vector_total", lambda s, d: search.search(catalog(s, d), SearchQuery("x", VECTOR), vector=query_vector(s, d), model_id=MODEL_ID).total, "SELECT count(*) AS total FROM assets JOIN emb ON id = asset_id", "ae")
add("vector_other_model", lambda s, d: search.search(catalog(s, d), SearchQuery("x", VECTOR), vector=[1.0] * 64, model_id="stale").page.select("id", "score"), "SELECT id, 0e0 AS score FROM assets WHERE false")

UNIT = "0.65e0 * greatest(0e0, least(1e0, (sim + 1) / 2))"
HYBRID = "CASE WHEN bm25 IS NULL THEN 0e0 WHEN hi - lo < 1e-8 THEN 1e0 ELSE (hi - bm25) / (hi - lo + 1e-8) END"
add("hybrid_topk", vector_page(SearchQuery("tion", BOTH, limit=30)), f"{bm25_sql(['tion'])}, r AS (SELECT min(bm25) AS lo, max(bm25) AS hi FROM hits), {NEAR}, f AS (SELECT near.id, {UNIT} + 0.35e0 * {HYBRID} AS score FROM near LEFT JOIN (SELECT id, bm25 FROM hits) h ON near.id = h.id, r) SELECT id, round(score, 5) AS score FROM f ORDER BY score DESC, id LIMIT 30", "ae")
add("hybrid_like", vector_page(SearchQuery("th", BOTH, limit=30)), f"WITH {NEAR}, f AS (SELECT id, {UNIT} + 0.35e0 * CASE WHEN lower(filename) LIKE '%th%' THEN 1 ELSE 0 END AS score FROM near) SELECT id, round(score, 5) AS score FROM f ORDER BY score DESC, id LIMIT 30", "ae")



@cache
def _vector_index(application: str, sf_dir: str) -> vector_index.VectorIndex:
    spark = SparkSession.active()
    return vector_index.built(catalog(spark, sf_dir), MODEL_ID, scratch_folder(spark, "vector-index"), cell=64)


def indexed_vectors(q: SearchQuery) -> Callable[[SparkSession, str], DataFrame]:
    """All cells, quantised, and the exact order of the best."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = _vector_index(spark.sparkContext.applicationId, sf_dir)
        page = vector_index.vector_page(index, catalog(spark, sf_dir), q, query_vector(spark, sf_dir), probed=1.0).page
        return page.select("id", F.round("score", 5).alias("score"))

    return run


def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the index finds nine of ten of the 20 nearest of each vector whose id is divisible by 100."""
    index = _vector_index(spark.sparkContext.applicationId, sf_dir)
    queries = index.vectors.where("asset_id % 100 = 0").select(F.col("asset_id").alias("query_id"), "vector")
    return vector_index.recall(index, queries, 20).select("n_queries", "k", (F.col("recall") >= 0.9).alias("reached"))


add("vector_index_topk", indexed_vectors(SearchQuery("x", VECTOR, limit=20)), ORACLE["vector_topk"], "")
add("vector_index_filtered", indexed_vectors(SearchQuery("x", VECTOR, channels=2, folder_root="/lib", limit=20, sort_by=SortField.DURATION)), ORACLE["vector_filtered"], "")
add("vector_index_recall", vector_index_recall, "SELECT count(*) AS n_queries, CAST(20 AS INTEGER) AS k, true AS reached FROM embeddings WHERE vec_id % 100 = 0", "")

# --- folders, facets, tags -------------------------------------------------------------------

add("folder_counts", lambda s, d: browse.folder_counts(assets(s, d)), "SELECT folder, count(*) AS n_assets FROM assets GROUP BY folder")
add("folder_subtree_list", lambda s, d: browse.browse_folder(assets(s, d), "/lib/src1").select("id", "filename"), "SELECT id, filename FROM assets WHERE folder = '/lib/src1' OR starts_with(folder, '/lib/src1/') ORDER BY filename, id LIMIT 500")
add("folder_subtree_count", lambda s, d: browse.folder_count(assets(s, d), "/lib/src1"), "SELECT count(*) AS n_assets FROM assets WHERE folder = '/lib/src1' OR starts_with(folder, '/lib/src1/')")
add("folder_count_all", lambda s, d: browse.folder_count(assets(s, d), "/"), "SELECT count(*) AS n_assets FROM assets")
add("folder_count_none", lambda s, d: browse.folder_count(assets(s, d), ""), "SELECT CAST(0 AS BIGINT) AS n_assets")
add(
    "folder_tree_rollup",
    lambda s, d: browse.folder_tree(assets(s, d)),
    """WITH c AS (SELECT folder, string_split(substr(folder, 2), '/') AS p, count(*) AS n FROM assets GROUP BY folder),
    r AS (SELECT n, p, unnest(range(1, len(p) + 1)) AS i FROM c),
    g AS (SELECT '/' || array_to_string(p[1:i], '/') AS path, i, p[i] AS name, sum(CASE WHEN i = len(p) THEN n ELSE 0 END) AS own_count, sum(n) AS total_count FROM r GROUP BY ALL)
    SELECT path, CASE WHEN i > 1 THEN regexp_replace(path, '/[^/]*$', '') END AS parent, name, CAST(i - 1 AS INTEGER) AS depth, CAST(own_count AS BIGINT) AS own_count, CAST(total_count AS BIGINT) AS total_count FROM g""",
)
add("publishers", lambda s, d: browse.publisher_counts(assets(s, d)), "SELECT publisher, count(*) AS n_assets FROM assets WHERE publisher <> '' GROUP BY publisher")
add("filter_options", lambda s, d: browse.filter_options(assets(s, d)).select(F.array_join("extensions", ",").alias("extensions"), F.array_join(F.transform("sample_rates", lambda x: x.cast("string")), ",").alias("sample_rates"), "min_duration", "max_duration", F.array_join("publishers", ",").alias("publishers")), "SELECT (SELECT string_agg(DISTINCT extension, ',' ORDER BY extension) FROM assets) AS extensions, (SELECT string_agg(CAST(r AS VARCHAR), ',' ORDER BY r) FROM (SELECT DISTINCT sample_rate AS r FROM assets)) AS sample_rates, coalesce(min(duration_ms), 0) AS min_duration, coalesce(max(duration_ms), 0) AS max_duration, (SELECT string_agg(DISTINCT publisher, ',' ORDER BY publisher) FROM assets WHERE publisher <> '') AS publishers FROM assets")
add("filter_options_flat", lambda s, d: browse.filter_values(assets(s, d)), "SELECT DISTINCT 'extension' AS kind, extension AS value FROM assets UNION SELECT 'sample_rate', CAST(sample_rate AS VARCHAR) FROM assets UNION SELECT 'publisher', publisher FROM assets WHERE publisher <> ''")
add("all_tags_counts", lambda s, d: browse.tag_counts(catalog(s, d)), "SELECT tags.id, name, count(asset_id) AS n_assets FROM tags LEFT JOIN asset_tags ON tags.id = tag_id GROUP BY tags.id, name", "tl")
add("tags_for_asset", lambda s, d: browse.tags_of_asset(catalog(s, d), 1), "SELECT id, name FROM tags JOIN asset_tags ON id = tag_id WHERE asset_id = 1", "tl")
add("tag_filter_any_nocase", lambda s, d: tagged_any(catalog(s, d), ["hQ", "tOXIC"]).distinct(), "SELECT DISTINCT asset_id FROM asset_tags WHERE tag_id IN (1, 3)", "l")
add("similar_assets", lambda s, d: browse.similar_assets(assets(s, d), 21).select("id", "path"), "SELECT id, path FROM assets WHERE folder = (SELECT folder FROM assets WHERE id = 21) AND extension = (SELECT extension FROM assets WHERE id = 21) AND id <> 21 ORDER BY md5(id || '-42'), id LIMIT 12")
add("category_suggestions", lambda s, d: browse.category_suggestions(assets(s, d), 4), "SELECT DISTINCT category FROM assets WHERE folder = (SELECT folder FROM assets WHERE id = 4) AND trim(category) <> '' ORDER BY lower(category), category LIMIT 16")
add("semantic_status", lambda s, d: browse.semantic_status(catalog(s, d), MODEL_ID), "SELECT (SELECT count(*) FROM assets) AS asset_count, count(*) AS embedding_count, count(*) > 0 AS model_ready, count(*) > 0 AS search_ready FROM emb", "ae")
add("asset_by_id", lambda s, d: assets(s, d).where("id = 12").select("id", "path", "duration_ms"), "SELECT id, path, duration_ms FROM assets WHERE id = 12")
add("asset_by_path", lambda s, d: assets(s, d).where(F.col("path") == "/lib/src1/en/doc_1.flac").select("id", "path"), "SELECT id, path FROM assets WHERE path = '/lib/src1/en/doc_1.flac'")
add("asset_ids", lambda s, d: assets(s, d).select("id").orderBy("id"), "SELECT id FROM assets ORDER BY id")
add("indexed_paths", lambda s, d: assets(s, d).select("path", "modified_at"), "SELECT path, modified_at FROM assets")

# --- ingest and changes -------------------------------------------------------------------------


def scan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assets(spark, sf_dir).select("id", "path", "modified_at")
    indexed = rows.where("id % 19 <> 0")
    listing = rows.where("id % 17 <> 0").withColumn("modified_at", F.when(F.col("id") % 13 == 0, F.col("modified_at") - 5).otherwise(F.col("modified_at")))
    return files.difference(listing, indexed, "/lib")


DIFF = """WITH i AS (SELECT path, modified_at FROM assets WHERE id % 19 <> 0),
 n AS (SELECT path, CASE WHEN id % 13 = 0 THEN modified_at - 5 ELSE modified_at END AS modified_at FROM assets WHERE id % 17 <> 0),
 diff AS (SELECT path, CASE WHEN i.modified_at IS NULL THEN 'new' WHEN n.modified_at IS NULL THEN 'missing' WHEN i.modified_at <> n.modified_at THEN 'changed' ELSE 'unchanged' END AS status FROM i FULL JOIN n USING (path))"""
add("scan_diff", scan_diff, f"{DIFF} SELECT path, status FROM diff")
add("scan_stats", lambda s, d: files.scan_stats(scan_diff(s, d)), f"{DIFF} SELECT count(*) FILTER (status IN ('new', 'changed')) AS indexed, count(*) FILTER (status = 'unchanged') AS skipped, count(*) FILTER (status = 'missing') AS missing, CAST(0 AS BIGINT) AS errors FROM diff")


def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the rows are there; every row comes twice."""
    rows = assets(spark, sf_dir)
    new = rows.drop("id", "favorite", "rating", "notes", "play_count")
    return writes.insert_assets(rows.where("id % 2 = 0"), new.unionByName(new)).select("id", "path", "rating")


add("insert_ignore", insert_ignore, "SELECT id, path, rating FROM assets WHERE id % 2 = 0 UNION ALL SELECT (SELECT max(id) FROM assets WHERE id % 2 = 0) + row_number() OVER (ORDER BY path), path, 0 FROM assets WHERE id % 2 = 1")


def update_technical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assets(spark, sf_dir)
    changed = rows.where("id % 3 = 0").withColumn("duration_ms", F.lit(1).cast("long")).withColumn("rating", F.lit(5))
    return writes.update_technical(rows, changed).select("id", "duration_ms", "rating", "favorite")


add("update_technical", update_technical, "SELECT id, CASE WHEN id % 3 = 0 THEN 1 ELSE duration_ms END AS duration_ms, rating, favorite FROM assets")
add("delete_cascade", lambda s, d: (lambda c: c.assets.agg(F.count("*").alias("n_assets")).crossJoin(c.asset_tags.agg(F.count("*").alias("n_links"))).crossJoin(c.embeddings.agg(F.count("*").alias("n_vectors"))))(writes.delete_assets(catalog(s, d), assets(s, d).where("id % 5 = 0").select("id"))), "SELECT (SELECT count(*) FROM assets WHERE id % 5 <> 0) AS n_assets, (SELECT count(*) FROM asset_tags WHERE asset_id % 5 <> 0 OR asset_id NOT IN (SELECT id FROM assets)) AS n_links, (SELECT count(*) FROM emb WHERE asset_id % 5 <> 0 OR asset_id NOT IN (SELECT id FROM assets)) AS n_vectors", "ale")


def user_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select((F.col("event_id") % 300).alias("asset_id"), F.when(F.col("event_id") % 3 == 0, F.col("user_id") % 2 == 0).alias("favorite"), F.when(F.col("event_id") % 3 == 1, (F.col("user_id") % 6).cast("int")).alias("rating"), F.col("event_id").alias("at"))


add("rating_update", lambda s, d: writes.with_user_state(assets(s, d), user_log(s, d)).select("id", "favorite", "rating"), "SELECT id, coalesce(f, favorite) AS favorite, coalesce(r, rating) AS rating FROM assets LEFT JOIN (SELECT event_id % 300 AS k, max_by(user_id % 2 = 0, event_id) FILTER (event_id % 3 = 0) AS f, max_by(CAST(user_id % 6 AS INTEGER), event_id) FILTER (event_id % 3 = 1) AS r FROM events GROUP BY k) ON k = id")
add("bulk_rating", lambda s, d: writes.set_rating(assets(s, d), [1, 2, 3], 5).select("id", "rating"), "SELECT id, CASE WHEN id IN (1, 2, 3) THEN 5 ELSE rating END AS rating FROM assets")
add("bulk_favorite", lambda s, d: writes.set_favorite(assets(s, d), [1, 2, 3], True).select("id", "favorite"), "SELECT id, favorite OR id IN (1, 2, 3) AS favorite FROM assets")
add("add_tag", lambda s, d: browse.tag_counts(writes.add_tag(writes.add_tag(catalog(s, d), [1, 2, 3], " Fresh ", trim=True), [1, 4], "fRESH")), "SELECT id, name, count(asset_id) AS n_assets FROM (SELECT * FROM tags UNION ALL SELECT 5, 'Fresh') t LEFT JOIN (SELECT * FROM asset_tags UNION ALL SELECT id, 5 FROM assets WHERE id IN (1, 2, 3, 4)) l ON id = tag_id GROUP BY id, name", "atl")
add("remove_tag", lambda s, d: browse.tag_counts(writes.remove_tag(catalog(s, d), 1, 1)), "SELECT id, name, count(asset_id) AS n_assets FROM tags LEFT JOIN (SELECT * FROM asset_tags WHERE NOT (asset_id = 1 AND tag_id = 1)) ON id = tag_id GROUP BY id, name", "tl")


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = catalog(spark, sf_dir).embeddings
    new = e.where("asset_id % 4 = 0").withColumn("vector", F.transform("vector", lambda x: -x)).withColumn("created_at", F.lit(9).cast("long"))
    return writes.upsert_embeddings(e, new, 64).select("asset_id", F.round(F.element_at("vector", 1).cast("double"), 5).alias("first"), "created_at")


add("upsert_latest", upsert_latest, "SELECT asset_id, round(CASE WHEN asset_id % 4 = 0 THEN -v[1] ELSE v[1] END, 5) AS first, CAST(CASE WHEN asset_id % 4 = 0 THEN 9 ELSE 0 END AS BIGINT) AS created_at FROM emb", "e")

# --- text expressions -----------------------------------------------------------------------------

JOINED = lambda text, seps: f"array_to_string(list_filter(string_split_regex({text}, '{seps}'), lambda w: w <> ''), ' ')"
add(
    "embedding_document",
    lambda s, d: audio.documents_to_embed(catalog(s, d)),
    rf"""WITH g AS (SELECT asset_id, string_agg(name, ' ' ORDER BY lower(name), name) AS names FROM asset_tags JOIN tags ON id = tag_id GROUP BY asset_id),
    w AS (SELECT assets.*, names, {JOINED('filename', '[_. -]')} AS nt, {JOINED('folder', '[/_ -]')} AS ft FROM assets LEFT JOIN g ON id = asset_id)
    SELECT id AS asset_id, trim(regexp_replace(concat_ws(' ', nullif(filename, ''), CASE WHEN nt <> '' AND nt <> filename THEN nt END, folder, ft, trim(category), trim(publisher), nullif(trim(notes), ''), names), '\s+', ' ', 'g')) AS document FROM w""",
    "atl",
)


def path_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+:/", ""), "[?#].*$", "")
    pages = table(spark, sf_dir, "pages").select("page_id", F.rtrim(path, F.lit("/")).alias("path"))
    return pages.select("page_id", *[c.alias(n) for n, c in S.parsed_path("/", F.col("path")).items()])


add(
    "path_parse",
    path_parse,
    """WITH p AS (SELECT page_id, rtrim(regexp_replace(regexp_replace(url, '^[a-z]+:/', ''), '[?#].*$', ''), '/') AS path FROM pages),
    f AS (SELECT page_id, CASE WHEN regexp_replace(path, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END AS folder, string_split(path, '/')[-1] AS name FROM p),
    d AS (SELECT *, list_filter(string_split(folder, '/'), lambda x: x <> '') AS dirs FROM f)
    SELECT page_id, folder, CASE WHEN strpos(substr(name, 2), '.') > 0 THEN regexp_replace(name, '[.][^.]*$', '') ELSE name END AS filename, lower(CASE WHEN strpos(substr(name, 2), '.') > 0 THEN string_split(name, '.')[-1] ELSE '' END) AS extension,
    dirs[1] AS publisher, CASE WHEN len(dirs) >= 2 THEN array_to_string(dirs[2:], ' > ') END AS category FROM d""",
    "",
)
add("folder_normalize", lambda s, d: table(s, d, "documents").select("doc_id", S.normalized_folder(F.concat(F.lit("/C:\\"), "source", F.lit("\\"), "lang")).alias("folder")), "SELECT doc_id, 'C:/' || source || '/' || lang AS folder FROM documents", "")
add(
    "format_labels",
    lambda s, d: assets(s, d).select("id", S.duration_label(F.col("duration_ms") * 37).alias("duration"), S.size_label(F.col("file_size") * F.col("file_size")).alias("size"), S.rate_label(F.col("sample_rate") + F.when(F.col("id") % 5 == 0, F.col("id") % 900 - F.col("sample_rate")).otherwise(0)).alias("rate")),
    """WITH b AS (SELECT id, duration_ms * 37 AS ms, file_size * file_size AS z, CASE WHEN id % 5 = 0 THEN id % 900 ELSE sample_rate END AS r FROM assets),
    c AS (SELECT *, CAST(floor(ms / 1000) AS BIGINT) AS w, CAST(least(9, floor((ms / 1000 - floor(ms / 1000)) * 10 + 0.5e0)) AS BIGINT) AS f FROM b)
    SELECT id, CASE WHEN ms IS NULL THEN '—' WHEN w < 3600 THEN printf('%d:%02d.%d', w // 60, w % 60, f) ELSE printf('%d:%02d:%02d.%d', w // 3600, w % 3600 // 60, w % 60, f) END AS duration,
    CASE WHEN z < 1024 THEN z || ' B' WHEN z < 1048576 THEN printf('%.1f KB', floor(z / 1024e0 * 10 + 0.5e0) / 10) WHEN z < 1073741824 THEN printf('%.1f MB', floor(z / 1048576e0 * 10 + 0.5e0) / 10) ELSE printf('%.1f GB', floor(z / 1073741824e0 * 10 + 0.5e0) / 10) END AS size,
    CASE r WHEN 44100 THEN '44.1 kHz' WHEN 48000 THEN '48 kHz' WHEN 96000 THEN '96 kHz' WHEN 22050 THEN '22.05 kHz' ELSE r || ' Hz' END AS rate FROM c""",
)
add("export_names", lambda s, d: assets(s, d).select("id", S.clip_name(F.concat("filename", F.lit(":x?.wav")), F.col("id") / 8, F.col("id") / 8 + 0.125).alias("clip"), S.full_name(F.concat("filename", F.lit(".v2.flac"))).alias("full_file")), "SELECT id, printf('%s_%.3f-%.3fs.wav', filename || '_x_', id / 8e0, id / 8e0 + 0.125e0) AS clip, filename || '.v2.wav' AS full_file FROM assets")
add(
    "clip_frame_range",
    lambda s, d: assets(s, d).where("duration_ms IS NOT NULL").select("id", N.clip_frames(F.col("id") % 7 * 0.3, F.col("id") % 7 * 0.3 + F.col("id") % 5 * 0.04, F.col("sample_rate"), F.floor(F.col("duration_ms") * F.col("sample_rate") / 1000)).alias("c")).select("id", "c.first", "c.last_exclusive", "c.error"),
    """WITH x AS (SELECT id, id % 7 * 0.3e0 AS s, id % 7 * 0.3e0 + id % 5 * 0.04e0 AS e, sample_rate AS r, CAST(floor(duration_ms * sample_rate / 1000) AS BIGINT) AS n FROM assets WHERE duration_ms IS NOT NULL),
    y AS (SELECT *, greatest(0, least(CAST(floor(s * r) AS BIGINT), n - 1)) AS a, greatest(1, least(CAST(ceil(e * r) AS BIGINT), n)) AS b0 FROM x),
    z AS (SELECT *, least(CASE WHEN b0 <= a THEN a + 1 ELSE b0 END, n) AS b FROM y),
    q AS (SELECT *, CASE WHEN e <= s THEN 'clip end must be after start' WHEN e - s < 0.05e0 THEN 'clip is too short' WHEN n <= 0 THEN 'no audio samples' WHEN (b - a) / CAST(r AS DOUBLE) < 0.05e0 - 1e-6 THEN 'clip is too short within the file' END AS error FROM z)
    SELECT id, CASE WHEN error IS NULL THEN a END AS first, CASE WHEN error IS NULL THEN b END AS last_exclusive, error FROM q""",
)
add("clip_clamped", lambda s, d: assets(s, d).select("id", N.clamped_clip(F.col("id") % 40 * 0.5, F.col("id") % 40 * 0.5 + F.col("id") % 9, F.coalesce("duration_ms", F.lit(0)) / 1000).alias("c")).select("id", F.round("c.start", 6).alias("start"), F.round("c.end", 6).alias("end")), "WITH x AS (SELECT id, id % 40 * 0.5e0 AS s, least(id % 40 * 0.5e0 + id % 9, coalesce(duration_ms, 0) / 1000) AS e, coalesce(duration_ms, 0) AS d FROM assets), y AS (SELECT id, least(s, e - 0.05e0) AS s, e, d FROM x) SELECT id, round(CASE WHEN d > 0 AND e - s >= 0.05e0 THEN greatest(0, s) END, 6) AS start, round(CASE WHEN d > 0 AND e - s >= 0.05e0 THEN e END, 6) AS \"end\" FROM y")
add("peak_levels", lambda s, d: table(s, d, "events").select("event_id", F.round(N.linear_to_db(F.col("value") / 100), 6).alias("db"), N.nearest_peak_level(F.col("value") / 100).alias("preset")), "WITH x AS (SELECT event_id, value / 100 AS v FROM events), y AS (SELECT event_id, v, unnest([-12, -6, -3, -1, 0]) AS p FROM x) SELECT event_id, round(CASE WHEN v > 0 THEN 20 * log10(v) ELSE -96 END, 6) AS db, CAST(arg_min(p, abs(v - pow(10e0, p / 20e0))) AS INTEGER) AS preset FROM y GROUP BY event_id, v", "")

# --- signals ----------------------------------------------------------------------------------------

add(
    "signal_autocorr_blocks",
    lambda s, d: signal.autocorrelation(samples(s, d), 24, block=32).select("asset_id", "lag", (F.round("value", 8) + 0.0).alias("value")),
    "SELECT a.asset_id, b.frame - a.frame AS lag, round(sum(a.sample * b.sample), 8) + 0e0 AS value FROM samples a JOIN samples b ON a.asset_id = b.asset_id AND b.frame BETWEEN a.frame AND a.frame + 24 GROUP BY a.asset_id, b.frame - a.frame",
    "s",
)
add("signal_peaks", lambda s, d: signal.peaks(written(samples(s, d), scratch_folder(s, "samples")), 8).select("asset_id", "bucket", F.round("low", 6).alias("low"), F.round("high", 6).alias("high")), "WITH z AS (SELECT asset_id, count(*) AS n, greatest(1, count(*) // 8) AS chunk FROM samples GROUP BY asset_id), b AS (SELECT asset_id, least(frame // chunk, 7) AS bucket, min(greatest(-1, least(1, sample))) AS low, max(greatest(-1, least(1, sample))) AS high FROM samples JOIN z USING (asset_id) GROUP BY ALL), a AS (SELECT asset_id, unnest(range(0, 8)) AS bucket FROM z) SELECT asset_id, CAST(bucket AS INTEGER) AS bucket, round(coalesce(low, 0), 6) AS low, round(coalesce(high, 0), 6) AS high FROM a LEFT JOIN b USING (asset_id, bucket)", "s")
add("signal_rms_peak", lambda s, d: signal.levels(samples(s, d)).select("asset_id", F.round("peak", 6).alias("peak"), F.round("rms", 6).alias("rms")), "SELECT asset_id, round(max(abs(sample)), 6) AS peak, round(sqrt(avg(sample * sample)), 6) AS rms FROM samples GROUP BY asset_id", "s")
add("signal_normalize", lambda s, d: signal.normalized(samples(s, d), 0.5).select("asset_id", "frame", F.round("sample", 6).alias("sample")), "SELECT asset_id, frame, round(sample * (0.5e0 / max(abs(sample)) OVER (PARTITION BY asset_id)), 6) AS sample FROM samples", "s")
add("signal_silence_bounds", lambda s, d: signal.silence_bounds(samples(s, d), 100, -7.0, 20, 32), "WITH p AS (SELECT asset_id, frame, max(abs(sample)) OVER (PARTITION BY asset_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS level FROM samples), g AS (SELECT asset_id, min(frame) FILTER (level >= pow(10, -0.35e0)) AS a, max(frame) FILTER (level >= pow(10, -0.35e0)) AS b, count(*) AS n FROM p GROUP BY asset_id) SELECT asset_id, CASE WHEN a >= 2 THEN a ELSE 0 END AS first, CASE WHEN a IS NULL THEN 0 WHEN n - b - 1 >= 2 THEN b + 1 ELSE n END AS last_exclusive FROM g", "s")
add("signal_zero_crossings", lambda s, d: signal.zero_crossings(samples(s, d)), "SELECT asset_id, frame FROM (SELECT *, lag(sample) OVER (PARTITION BY asset_id ORDER BY frame) AS before FROM samples) WHERE before < 0 AND sample >= 0", "s")
add("signal_chunks", lambda s, d: signal.chunks(samples(s, d), 10).select("asset_id", "chunk", "first_frame", "n_frames", F.round("peak", 6).alias("peak")), "SELECT asset_id, frame // 20 AS chunk, min(frame) AS first_frame, count(*) AS n_frames, round(max(abs(sample)), 6) AS peak FROM samples GROUP BY ALL", "s")
add("signal_mono", lambda s, d: signal.mono(samples(s, d).select("asset_id", (F.floor(F.col("frame") / 2)).alias("frame"), "sample")).select("asset_id", "frame", F.round("sample", 6).alias("sample")), "SELECT asset_id, frame // 2 AS frame, round(avg(sample), 6) AS sample FROM samples GROUP BY ALL", "s")
add("signal_autocorr_lag", lambda s, d: signal.autocorrelation(samples(s, d), 3).select("asset_id", F.round("autocorrelation", 6).alias("r")), "SELECT asset_id, round(sum(sample * coalesce(later, 0)) / sum(sample * sample), 6) AS r FROM (SELECT *, lead(sample, 3) OVER (PARTITION BY asset_id ORDER BY frame) AS later FROM samples) GROUP BY asset_id", "s")
add("signal_amdf_lag", lambda s, d: signal.amdf(samples(s, d), 3).select("asset_id", F.round("amdf", 6).alias("amdf")), "SELECT asset_id, round(avg(abs(sample - later)), 6) AS amdf FROM (SELECT *, lead(sample, 3) OVER (PARTITION BY asset_id ORDER BY frame) AS later FROM samples) WHERE later IS NOT NULL GROUP BY asset_id", "s")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = signal.beside(samples(spark, sf_dir), lambda w: F.lead("sample", 1).over(w), "b", 0, 1)
    return later.where("b IS NOT NULL").select("asset_id", F.col("sample").alias("a"), "b")


add("signal_crosscorr", lambda s, d: signal.cross_correlation(pairs(s, d)).select("asset_id", F.round("correlation", 6).alias("correlation")), "SELECT asset_id, round(greatest(-1, least(1, sum(sample * b) / greatest(sqrt(sum(sample * sample)) * sqrt(sum(b * b)), 1.1920929e-7))), 6) AS correlation FROM (SELECT *, lead(sample) OVER (PARTITION BY asset_id ORDER BY frame) AS b FROM samples) WHERE b IS NOT NULL GROUP BY asset_id", "s")


def trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = samples(spark, sf_dir)
    return signal.trimmed(x, signal.silence_bounds(x, 100, -7.0, 20, 32)).groupBy("asset_id").agg(F.count("*").alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"))


add("signal_trimmed", trimmed, "WITH p AS (SELECT asset_id, frame, max(abs(sample)) OVER (PARTITION BY asset_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS level FROM samples), g AS (SELECT asset_id, min(frame) FILTER (level >= pow(10, -0.35e0)) AS a, max(frame) FILTER (level >= pow(10, -0.35e0)) AS b, count(*) AS n FROM p GROUP BY asset_id), h AS (SELECT asset_id, n AS total, CASE WHEN a >= 2 THEN a ELSE 0 END AS f, CASE WHEN a IS NULL THEN 0 WHEN n - b - 1 >= 2 THEN b + 1 ELSE n END AS l FROM g) SELECT asset_id, CASE WHEN l > f THEN l - f ELSE total END AS n, CAST(0 AS BIGINT) AS first, CASE WHEN l > f THEN l - f ELSE total END - 1 AS last FROM h", "s")


add("embed_documents", lambda s, d: audio.embed(audio.documents_to_embed(catalog(s, d)), audio.HashingProvider(64), 0).select("asset_id", F.size("vector").alias("dim"), "model_id"), "SELECT id AS asset_id, CAST(64 AS INTEGER) AS dim, 'phonolith-hash-v1' AS model_id FROM assets")
