"""Catalog changes as new DataFrames; a snapshot is written by sources.snapshots.

Nothing is changed in place: inserts, updates and deletes are joins on the key,
and what users set (favorite, rating) is a log whose latest entry holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from phonolith.functions.text import nocase
from phonolith.schema import TECHNICAL_COLUMNS, Catalog, ValidationError
from phonolith.sources.scratch import scratch_folder, written


def latest(rows: DataFrame, keys: list[str], *newest_first: Column) -> DataFrame:
    """One row for each key, the first in the order."""
    window = Window.partitionBy(*keys).orderBy(*newest_first)
    return rows.withColumn("_nth", F.row_number().over(window)).where("_nth = 1").drop("_nth")


def numbered(new: DataFrame, start: DataFrame, order: str, id_col: str = "id") -> DataFrame:
    """Ids after the largest of start, in the order of a unique column, without a single-partition window.

    Rows are dealt into ranges by boundary values and numbered within each range,
    after the counts of the ranges before it. Ranges depend on the values alone,
    so a task that runs again, or a plan that merges partitions, gives the same
    ids. The boundaries are the values with the smallest hashes, at most one for
    each shuffle partition; they decide how even the ranges are, not the ids.
    """
    wanted = max(1, int(new.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1)
    drawn = new.where(F.col(order).isNotNull()).select(order).orderBy(F.xxhash64(order), order).limit(wanted).collect()
    bounds = F.array(*[F.lit(v) for v in sorted({r[0] for r in drawn})]).cast(ArrayType(new.schema[order].dataType))
    ranged = new.withColumn("_range", F.size(F.filter(bounds, lambda v: v <= F.col(order))))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    # A few rows, one for each range.
    before = sizes.select(F.col("_range").alias("_of"), F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    base = F.broadcast(start.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_base")))
    placed = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(order)))
    placed = placed.join(F.broadcast(before), F.col("_range") == F.col("_of")).crossJoin(base)
    return placed.withColumn(id_col, F.col("_base") + F.col("_before") + F.col("_at")).drop("_range", "_of", "_at", "_before", "_base")


def inserted_rows(assets: DataFrame, new: DataFrame) -> DataFrame:
    """The new rows whose path is not there yet, one for each path (the first by file facts)."""
    fresh = new.join(assets.select("path"), "path", "left_anti")
    return latest(fresh, ["path"], *[F.col(c) for c in new.columns if c != "path" and c != "peaks"])


def insert_assets(assets: DataFrame, new: DataFrame) -> DataFrame:
    """The new rows are written to the shared folder first, as numbering them reads them three times."""
    fresh = written(inserted_rows(assets, new), scratch_folder(assets.sparkSession, "inserted"))
    rows = numbered(fresh, assets, "path")
    defaults = {"favorite": F.lit(False), "rating": F.lit(0), "notes": F.lit(None).cast("string"), "play_count": F.lit(0).cast("long")}
    full = rows.select([F.col(c) if c in rows.columns else defaults.get(c, F.lit(None)).cast(assets.schema[c].dataType).alias(c) for c in assets.columns])
    return assets.unionByName(full)


def update_technical(assets: DataFrame, changed: DataFrame) -> DataFrame:
    """Overwrite what comes from the file; id, favorite, rating, notes and play count stay."""
    own = [c for c in TECHNICAL_COLUMNS if c in assets.columns and c in changed.columns]
    new = changed.dropDuplicates(["path"]).select("path", F.struct(*own).alias("_new"))
    joined = assets.join(new, "path", "left")
    return joined.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in assets.columns])


def delete_assets(catalog: Catalog, ids: DataFrame) -> Catalog:
    """Assets with their tag links and embeddings; ids: one column ``id``."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    without = lambda df, key: df.join(gone, F.col(key) == F.col("_gone"), "left_anti")
    return replace(catalog, assets=without(catalog.assets, "id"), asset_tags=without(catalog.asset_tags, "asset_id"), embeddings=without(catalog.embeddings, "asset_id"), peaks=without(catalog.peaks, "asset_id"))


def wiped(catalog: Catalog) -> Catalog:
    return Catalog(*(df.where(F.lit(False)) for df in (catalog.assets, catalog.tags, catalog.asset_tags, catalog.embeddings, catalog.peaks)))


def update_peaks(peaks: DataFrame, new: DataFrame) -> DataFrame:
    """new (asset_id, peaks) take the place of what their assets had; an asset without a row has no peaks."""
    kept = peaks.join(new.select(F.col("asset_id").alias("_new")), F.col("asset_id") == F.col("_new"), "left_anti")
    return kept.unionByName(new.select(*peaks.columns))


def check_rating(rating: int) -> int:
    if not 0 <= rating <= 5:
        raise ValidationError("rating must be between 0 and 5")
    return rating


def with_user_state(assets: DataFrame, log: DataFrame) -> DataFrame:
    """log (asset_id, favorite?, rating?, at): of each field the latest value that is not null holds."""
    by_time = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.struct("at", c)))
    last = log.groupBy("asset_id").agg(by_time("favorite").alias("_favorite"), by_time("rating").alias("_rating"))
    joined = assets.join(last, F.col("id") == F.col("asset_id"), "left")
    new = {"favorite": F.coalesce("_favorite", "favorite"), "rating": F.coalesce("_rating", "rating")}
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in assets.columns])


Ids = DataFrame | Sequence[int]


def among(df: DataFrame, ids: Ids, key: str = "id") -> DataFrame:
    """df with _there, true for the rows whose key is one of ids: a column ``id``, or some numbers."""
    if not isinstance(ids, DataFrame):
        ids = df.sparkSession.createDataFrame([(i,) for i in ids], "id long")
    chosen = ids.select(F.col("id").alias("_id")).distinct().withColumn("_there", F.lit(True))
    return df.join(chosen, F.col(key) == F.col("_id"), "left").drop("_id")


def set_column(assets: DataFrame, ids: Ids, name: str, value) -> DataFrame:
    marked = among(assets, ids)
    return marked.select(*[F.when(F.col("_there"), F.lit(value)).otherwise(F.col(c)).alias(c) if c == name else F.col(c) for c in assets.columns])


def set_favorite(assets: DataFrame, ids: Ids, value: bool) -> DataFrame:
    return set_column(assets, ids, "favorite", value)


def set_rating(assets: DataFrame, ids: Ids, rating: int) -> DataFrame:
    return set_column(assets, ids, "rating", check_rating(rating))


def toggle_favorite(assets: DataFrame, asset_id: int) -> tuple[DataFrame, bool]:
    row = assets.where(F.col("id") == asset_id).select("favorite").first()
    if row is None:
        raise LookupError(f"asset {asset_id} was not found")
    return set_favorite(assets, [asset_id], not row["favorite"]), not row["favorite"]


def add_tag(catalog: Catalog, ids: Ids, name: str, trim: bool = False) -> Catalog:
    """Link a tag; an equal name (ASCII case ignored) is one tag, spelled as it was first. Bulk requests trim.

    A blank name or an empty list changes nothing; an empty table of ids still makes the tag.
    """
    name = name.strip() if trim else name
    if not name or (not isinstance(ids, DataFrame) and not ids):
        return catalog
    spark = catalog.assets.sparkSession
    there = catalog.tags.where(nocase(F.col("name")) == nocase(F.lit(name)))
    new = numbered(spark.createDataFrame([(name,)], "name string"), catalog.tags, "name").select("id", "name")
    new = new.join(F.broadcast(there.select(F.lit(True).alias("_there")).limit(1)), F.lit(True), "left_anti")
    tags = catalog.tags.unionByName(new)
    tag = tags.where(nocase(F.col("name")) == nocase(F.lit(name))).select(F.col("id").alias("tag_id"))
    chosen = among(catalog.assets, ids).where("_there").select(F.col("id").alias("asset_id"))
    links = chosen.crossJoin(F.broadcast(tag))  # one tag
    return replace(catalog, tags=tags, asset_tags=catalog.asset_tags.unionByName(links.select(*catalog.asset_tags.columns)).dropDuplicates(["asset_id", "tag_id"]))


def remove_tag(catalog: Catalog, asset_id: int, tag_id: int) -> Catalog:
    """Only the link goes; the tag stays, perhaps unused."""
    return replace(catalog, asset_tags=catalog.asset_tags.where(~((F.col("asset_id") == asset_id) & (F.col("tag_id") == tag_id))))


def upsert_embeddings(embeddings: DataFrame, new: DataFrame, dim: int) -> DataFrame:
    """Each asset's latest vector; a new vector of another length is an error when it is read."""
    checked = new.withColumn("vector", F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.size("vector").cast("string"))).cast("array<float>")))
    both = embeddings.withColumn("_new", F.lit(0)).unionByName(checked.withColumn("_new", F.lit(1)))
    return latest(both, ["asset_id"], F.col("_new").desc(), F.col("created_at").desc_nulls_last(), F.xxhash64("vector")).drop("_new")
