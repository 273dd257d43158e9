"""Bring a catalog up to date with a file tree: list, difference, extract, insert, update, delete, count.

Only new and changed files are opened. The tree is listed once and the facts are
extracted once; both are written to the shared folder before they are used.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolith.operators import writes
from phonolith.schema import Catalog
from phonolith.sources import files
from phonolith.sources.control import Marker
from phonolith.sources.scratch import scratch_folder, written
from phonolith.sources.snapshots import TABLES


@dataclass(frozen=True)
class Ingested:
    catalog: Catalog
    #: One row: indexed, skipped, missing, errors, duration_ms.
    stats: DataFrame
    #: (path, error) of files that could not be read.
    errors: DataFrame


def ingest(
    catalog: Catalog,
    root: str,
    *,
    resolution: int = 800,
    now: int | None = None,
    progress: Callable[[str, int], None] = lambda phase, n: None,
    list_with: Callable[[SparkSession, str], DataFrame] = files.walk,
    cancel: Marker | None = None,
) -> Ingested:
    """progress is told the phases enumerating, indexing and complete with the number of files that each concerns.

    Once cancel is set (by any process), tasks open no further file and Cancelled
    is raised; the catalog given stays as it is. A folder that can't be listed is
    an error, and what the catalog has below it is not missing.
    """
    spark, began, root = catalog.assets.sparkSession, time.monotonic(), files.plain(root)
    now = int(time.time()) if now is None else now
    folder = scratch_folder(spark, "ingest")
    stop = cancel.check if cancel is not None else lambda: None
    stop()
    listing = written(list_with(spark, root), f"{folder}/listing")
    unread = listing.sparkSession.createDataFrame([], "path string, error string")
    if "error" in listing.columns:
        unread = listing.where("error IS NOT NULL").select("path", "error")
        listing = listing.where("error IS NULL").drop("error")
    progress("enumerating", listing.count())
    stop()
    diff = written(files.difference(listing, catalog.assets, root, unread=unread), f"{folder}/difference")
    touched = diff.where(F.col("status").isin("new", "changed"))
    progress("indexing", touched.count())
    facts = written(files.extract(touched, resolution, cancel), f"{folder}/facts")
    stop()
    rows = written(files.asset_rows(listing, facts, root, now), f"{folder}/rows")
    state = lambda name: diff.where(F.col("status") == name).select("path")
    gone = catalog.assets.join(state("missing"), "path", "left_semi").select("id")
    left = writes.delete_assets(catalog, gone)
    kept = writes.update_technical(left.assets, rows.join(state("changed"), "path", "left_semi").drop("peaks"))
    grown = writes.insert_assets(kept, rows.join(state("new"), "path", "left_semi").drop("peaks"))
    grown = written(grown, f"{folder}/assets")
    peaks = rows.select("path", "peaks").join(grown.select("path", F.col("id").alias("asset_id")), "path").select("asset_id", "peaks")
    failed = facts.where(F.col("error").isNotNull()).select("path", "error")
    done = replace(left, assets=grown, peaks=writes.update_peaks(left.peaks, peaks))
    progress("complete", touched.count())
    stats = files.scan_stats(diff, failed, int((time.monotonic() - began) * 1000)).withColumn("errors", F.col("errors") + unread.count())
    return Ingested(done, stats, failed.unionByName(unread))


def ingest_roots(catalog: Catalog, roots: list[str], **options) -> Ingested:
    """One root after the other; a root that can't be listed is one error. stats: a row for each root and their sum."""
    stats, errors = [], []
    for root in roots:
        try:
            found = ingest(catalog, root, **options)
        except (OSError, PySparkException, Py4JError, pa.ArrowException) as error:  # the other roots go on
            stats.append((root, None))
            errors.append(catalog.assets.sparkSession.createDataFrame([(root, str(error)[:1000])], "path string, error string"))
            continue
        # Written, so that the plans of many roots don't pile up.
        place = scratch_folder(catalog.assets.sparkSession, "catalog")
        catalog = Catalog(*(written(getattr(found.catalog, name), f"{place}/{name}") for name in TABLES))
        stats.append((root, found.stats))
        errors.append(found.errors)
    none = catalog.assets.sparkSession.createDataFrame([], "path string, error string")
    return Ingested(catalog, files.stats_of_roots(stats), reduce(DataFrame.unionByName, errors, none))
