"""Catalog-shaped views of the synthetic tables, as DataFrames and as the same SQL.

A document is an asset: its whole text is the asset's notes, which searches
read; the file name is made of the text's first characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phonolith.schema import EXTENSIONS, Catalog

MODEL_ID = "synthetic-64"
RATES = (44100, 48000, 96000, 22050)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _choice(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    ext = _choice(EXTENSIONS, i % 6)
    folder = F.concat(F.lit("/lib/"), F.col("source"), F.lit("/"), F.col("lang"))
    return table(spark, sf_dir, "documents").select(
        i.alias("id"),
        F.concat(folder, F.lit("/doc_"), i.cast("string"), F.lit("."), ext).alias("path"),
        F.regexp_replace(F.substr("text", F.lit(1), F.lit(48)), "[^A-Za-z0-9]+", "_").alias("filename"),
        ext.alias("extension"),
        folder.alias("folder"),
        F.when(i % 11 != 0, F.col("n_chars") * 10).alias("duration_ms"),
        _choice(RATES, i % 4).alias("sample_rate"),
        (1 + i % 2).cast("int").alias("channels"),
        F.lit(16).alias("bit_depth"),
        (F.col("n_chars") * 4).alias("file_size"),
        F.col("lang").alias("category"),
        F.col("source").alias("publisher"),
        (i % 10 == 0).alias("favorite"),
        (i % 6).cast("int").alias("rating"),
        F.col("text").alias("notes"),
        F.lit(0).cast("long").alias("play_count"),
        (F.lit(1690000000) + (i * 104729) % 100000).alias("modified_at"),
        (F.lit(1700000000) + (i * 7919) % 100000).alias("indexed_at"),
    )


ASSETS_SQL = """assets AS (
  SELECT doc_id AS id, '/lib/' || source || '/' || lang || '/doc_' || doc_id || '.' || (['wav','flac','mp3','ogg','aiff','aif'])[doc_id % 6 + 1] AS path,
    regexp_replace(substr(text, 1, 48), '[^A-Za-z0-9]+', '_', 'g') AS filename, (['wav','flac','mp3','ogg','aiff','aif'])[doc_id % 6 + 1] AS extension,
    '/lib/' || source || '/' || lang AS folder, CASE WHEN doc_id % 11 <> 0 THEN n_chars * 10 END AS duration_ms, (CAST([44100, 48000, 96000, 22050] AS INTEGER[]))[doc_id % 4 + 1] AS sample_rate,
    CAST(1 + doc_id % 2 AS INTEGER) AS channels, CAST(16 AS INTEGER) AS bit_depth, n_chars * 4 AS file_size, lang AS category, source AS publisher, doc_id % 10 = 0 AS favorite,
    CAST(doc_id % 6 AS INTEGER) AS rating, text AS notes, CAST(0 AS BIGINT) AS play_count, CAST(1690000000 + (doc_id * 104729) % 100000 AS BIGINT) AS modified_at,
    CAST(1700000000 + (doc_id * 7919) % 100000 AS BIGINT) AS indexed_at FROM documents)"""

#: Tag names of the synthetic labels, mixed in case on purpose.
TAGS = ((1, "HQ"), (2, "lq"), (3, "Toxic"), (4, "unused"))
TAGS_SQL = "tags AS (SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'HQ'), (2, 'lq'), (3, 'Toxic'), (4, 'unused')) t(id, name))"
ASSET_TAGS_SQL = "asset_tags AS (SELECT DISTINCT doc_id AS asset_id, CAST(unnest(CASE WHEN toxic = 1 THEN [2 - quality, 3] ELSE [2 - quality] END) AS BIGINT) AS tag_id FROM labels)"
EMBEDDINGS_SQL = "emb AS (SELECT vec_id AS asset_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    labels = table(spark, sf_dir, "labels")
    own = F.when(F.col("toxic") == 1, F.array(2 - F.col("quality"), F.lit(3))).otherwise(F.array(2 - F.col("quality")))
    links = labels.select(F.col("doc_id").alias("asset_id"), F.explode(own.cast("array<bigint>")).alias("tag_id")).distinct()
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("asset_id"), F.col("embedding").alias("vector"), F.lit(MODEL_ID).alias("model_id"), F.lit(0).cast("long").alias("created_at"))
    peaks = vectors.select("asset_id", F.col("vector").alias("peaks"))
    return Catalog(assets(spark, sf_dir), spark.createDataFrame(TAGS, "id long, name string"), links, vectors, peaks)


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 7) -> list[float]:
    """One stored vector as the query."""
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]] if row else []


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as one signal for each user: (asset_id, frame, sample).

    Frames are numbered within each hour, after the counts of the hours before,
    so a user with very many events is many window partitions.
    """
    events = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", F.col("ts").cast("timestamp")))
    counts = events.groupBy("user_id", "hour").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("user_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("user_id", "hour", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = events.withColumn("nth", F.row_number().over(Window.partitionBy("user_id", "hour").orderBy("ts", "event_id"))).join(before, ["user_id", "hour"])
    return placed.select(F.col("user_id").alias("asset_id"), (F.col("before") + F.col("nth") - 1).cast("long").alias("frame"), (F.col("value") / 100 - 0.5).alias("sample"))


SAMPLES_SQL = "samples AS (SELECT user_id AS asset_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value / 100 - 0.5e0 AS sample FROM events)"
