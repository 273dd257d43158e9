"""Facets, folders, tags, similar assets and status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolith.functions.text import ancestors, is_drive, nocase, normalized_folder, segments
from phonolith.operators.filters import below_folder
from phonolith.schema import Catalog


def browse_folder(assets: DataFrame, root: str, offset: int = 0, limit: int = 500) -> DataFrame:
    return assets.where(below_folder(root)).orderBy("filename", "id").offset(offset).limit(limit)


def folder_count(assets: DataFrame, root: str) -> DataFrame:
    return assets.where(below_folder(root)).agg(F.count("*").alias("n_assets"))


def folder_counts(assets: DataFrame) -> DataFrame:
    return assets.groupBy("folder").agg(F.count("*").alias("n_assets"))


def publisher_counts(assets: DataFrame) -> DataFrame:
    return assets.where(F.col("publisher") != "").groupBy("publisher").agg(F.count("*").alias("n_assets"))


def folder_tree(assets: DataFrame) -> DataFrame:
    """(path, parent, name, depth, own_count, total_count) of every folder and all folders above.

    Counts by folder are summed before the ancestors are exploded, so the
    shuffle carries folders, not assets.
    """
    own = assets.groupBy(normalized_folder(F.col("folder")).alias("folder")).agg(F.count("*").alias("n"))
    size = F.size(segments(F.col("folder")))
    rows = own.select("n", size.alias("size"), F.posexplode(ancestors(F.col("folder"))).alias("at", "path"))
    totals = rows.groupBy("path").agg(F.sum(F.when(F.col("at") + 1 == F.col("size"), F.col("n")).otherwise(0)).alias("own_count"), F.sum("n").alias("total_count"), F.min("at").alias("depth"))
    name = F.element_at(F.split("path", "/"), -1)
    parent = F.regexp_replace("path", "/[^/]*$", "")
    return totals.select("path", F.when((F.col("depth") == 0) | is_drive(F.col("path")), F.lit(None).cast("string")).otherwise(parent).alias("parent"), name.alias("name"), F.col("depth").cast("int").alias("depth"), "own_count", "total_count")


def nested(tree_rows: list) -> list[dict]:
    """The display form of folder_tree's rows (a page of them), children by name."""
    nodes = {r["path"]: {"name": r["name"], "path": r["path"], "count": r["total_count"], "children": []} for r in tree_rows}
    roots = []
    for r in sorted(tree_rows, key=lambda r: r["name"]):
        (nodes[r["parent"]]["children"] if r["parent"] in nodes else roots).append(nodes[r["path"]])
    return roots


def filter_options(assets: DataFrame) -> DataFrame:
    """One row: the sorted choices of each filter and the range of durations (0, 0 without any)."""
    return assets.agg(
        F.array_sort(F.collect_set("extension")).alias("extensions"),
        F.array_sort(F.collect_set("sample_rate")).alias("sample_rates"),
        F.coalesce(F.min("duration_ms"), F.lit(0)).alias("min_duration"),
        F.coalesce(F.max("duration_ms"), F.lit(0)).alias("max_duration"),
        F.array_sort(F.collect_set(F.when(F.col("publisher") != "", F.col("publisher")))).alias("publishers"),
    )


def filter_values(assets: DataFrame) -> DataFrame:
    """(kind, value): the same choices as rows, for libraries with very many publishers."""
    kinds = F.array(
        F.struct(F.lit("extension").alias("kind"), F.col("extension").alias("value")),
        F.struct(F.lit("sample_rate").alias("kind"), F.col("sample_rate").cast("string").alias("value")),
        F.struct(F.lit("publisher").alias("kind"), F.when(F.col("publisher") != "", F.col("publisher")).alias("value")),
    )
    return assets.select(F.explode(kinds).alias("x")).select("x.kind", "x.value").where(F.col("value").isNotNull()).distinct()


def tags_of_asset(catalog: Catalog, asset_id: int) -> DataFrame:
    own = catalog.asset_tags.where(F.col("asset_id") == asset_id).select("tag_id")
    return catalog.tags.join(own, F.col("id") == F.col("tag_id"), "left_semi").orderBy(nocase(F.col("name")), "id")


def tag_counts(catalog: Catalog) -> DataFrame:
    """(id, name, n_assets) of every tag, unused ones included; links are counted before the join."""
    counts = catalog.asset_tags.groupBy("tag_id").agg(F.count("asset_id").alias("n"))
    return catalog.tags.join(counts, F.col("id") == F.col("tag_id"), "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n_assets"))


def similar_assets(assets: DataFrame, asset_id: int, limit: int = 12, seed: int = 42) -> DataFrame:
    """Assets of the same folder and extension in a seeded random order."""
    own = F.broadcast(assets.where(F.col("id") == asset_id).select(F.col("folder").alias("f"), F.col("extension").alias("e")).limit(1))
    same = assets.join(own, (F.col("folder") == F.col("f")) & (F.col("extension") == F.col("e")), "left_semi")
    return same.where(F.col("id") != asset_id).orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(f"-{seed}"))), "id").limit(limit)


def category_suggestions(assets: DataFrame, asset_id: int, limit: int = 16) -> DataFrame:
    own = F.broadcast(assets.where(F.col("id") == asset_id).select(F.col("folder").alias("f")).limit(1))
    siblings = assets.join(own, F.col("folder") == F.col("f"), "left_semi").where(F.trim("category") != "")
    return siblings.select("category").distinct().orderBy(nocase(F.col("category")), "category").limit(limit)


def semantic_status(catalog: Catalog, model_id: str) -> DataFrame:
    counts = catalog.embeddings.where(F.col("model_id") == model_id).agg(F.count("*").alias("embedding_count"))
    total = catalog.assets.agg(F.count("*").alias("asset_count"))
    ready = F.col("embedding_count") > 0
    return total.crossJoin(counts).select("asset_count", "embedding_count", ready.alias("model_ready"), ready.alias("search_ready"))
