"""Pages far into a sorted result, without a task that holds all rows before them.

The sort keys are dealt into ranges and written; the ranges' sizes (one number
each) tell which of them the page lies in, and only these are read and sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonolith.sources.scratch import scratch_folder

#: Sort keys of searches; those that a result has are written.
KEYS = ("filename", "duration_ms", "indexed_at", "score", "id")


def page_at(found: DataFrame, order: list[Column], offset: int, limit: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The rows of found from offset on, in order; the order must end in the unique column ``id``."""
    spark = found.sparkSession
    if limit <= 0:
        return found.where(F.lit(False))
    folder = scratch_folder(spark, "pages")
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    narrow = found.select(*[c for c in keys if c in found.columns])
    dealt = narrow.repartitionByRange(ranges, *order).withColumn("_part", F.spark_partition_id())
    dealt.write.partitionBy("_part").parquet(folder)
    written = spark.read.schema(dealt.schema).parquet(folder)
    before, chosen, first = 0, [], None
    for part, n in sorted((r["_part"], r["n"]) for r in written.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        if before < offset + limit and before + n > offset:
            chosen.append(part)
            first = before if first is None else first
        before += n
    if first is None:
        return found.where(F.lit(False))
    # Rows of one or a few ranges; a page's worth of ids comes here, to be looked up by literals.
    ids = [r["id"] for r in written.where(F.col("_part").isin(chosen)).orderBy(*order).offset(offset - first).limit(limit).select("id").collect()]
    return found.where(F.col("id").isin(ids)).orderBy(*order)
