"""File trees: listing, difference to the catalog, and extraction of facts and peaks.

Folders are listed level by level (``walk``): a level's folders are dealt to
tasks, which list them, and what they find is written before the next level. The
driver learns how many folders there are, never their names. ``list_files`` uses
Spark's own file source instead, whose index is made on the driver and which hides
names that begin with ``_``.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolith.functions.kernels import peak_pairs
from phonolith.functions.text import parsed_path
from phonolith.schema import EXTENSIONS
from phonolith.sources import codecs
from phonolith.sources.control import Marker
from phonolith.sources.scratch import scratch_folder, written
from phonolith.sources.wav import DECODERS

LISTING = "path string, extension string, file_size long, modified_at long"
STATS = ("indexed", "skipped", "missing", "errors", "duration_ms")
#: Files that a task reads, and rows of a batch, about.
TASK_FILES = 256
TASK_FOLDERS = 64
BATCH_FILES = 64
SCANNED = "path string, sample_rate int, channels int, bit_depth int, duration_ms long, peaks array<float>, error string"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Audio files below root: (path, extension, file_size, modified_at)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    path = F.regexp_replace("path", "^file:(?=/)(/(?=//))?(//)?", "")
    extension = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    listed = files.select(path.alias("path"), extension.alias("extension"), F.col("length").alias("file_size"), F.unix_timestamp("modificationTime").alias("modified_at"))
    return listed.where(F.col("extension").isin(*EXTENSIONS))


def plain(root: str) -> str:
    """A folder's address as paths of listings have it: local ones without a scheme."""
    return re.sub("^file:(//)?(?=/)", "", root).rstrip("/") or "/"


WALKED = "path string, extension string, file_size long, modified_at long, folder boolean, error string"


def _entries(folder: str, skip_hidden: bool) -> list[tuple]:
    """(path, extension, size, time, whether a folder, error) of what a folder holds; an error is one row."""
    from pyarrow import fs

    local = "://" not in folder
    store, base = (fs.LocalFileSystem(), folder) if local else fs.FileSystem.from_uri(folder)
    lead = "" if local else folder[: folder.index("://") + 3]
    try:
        found = store.get_file_info(fs.FileSelector(base, recursive=False))
    except (OSError, pa.ArrowException) as error:
        return [(folder, None, None, None, False, str(error))]
    rows = []
    for entry in found:
        name, path = entry.base_name, lead + entry.path
        if skip_hidden and name.startswith("."):
            continue
        if entry.type == fs.FileType.Directory:
            # A link to a folder above would never end.
            if not (local and os.path.islink(path)):
                rows.append((path, None, None, None, True, None))
        elif (extension := name.rpartition(".")[2].lower() if "." in name else "") in EXTENSIONS:
            rows.append((path, extension, entry.size, int(entry.mtime_ns // 1_000_000_000) if entry.mtime_ns else 0, False, None))
    return rows


def walk(spark: SparkSession, root: str, skip_hidden: bool = True) -> DataFrame:
    """(path, extension, file_size, modified_at, error): audio files below root; a folder that can't be listed is a row with an error.

    Entries that begin with a dot are left out unless asked for; links to folders are not followed.
    """
    place = scratch_folder(spark, "walk")
    root = plain(root)
    kinds = [("path", pa.string()), ("extension", pa.string()), ("file_size", pa.int64()), ("modified_at", pa.int64()), ("folder", pa.bool_()), ("error", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = _entries(folder, skip_hidden)
                for at in range(0, len(rows), 10_000):
                    columns = zip(*rows[at : at + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], names=[n for n, _ in kinds])

    level, depth = spark.createDataFrame([(root,)], "path string"), 0
    while True:
        found = written(dealt(level, TASK_FOLDERS).mapInArrow(run, WALKED), f"{place}/level={depth}")
        if depth == 0 and (failed := found.where((F.col("path") == root) & F.col("error").isNotNull()).first()):
            raise FileNotFoundError(failed["error"])
        level, depth = found.where("folder").select("path"), depth + 1
        if level.isEmpty():
            break
    everything = spark.read.schema(WALKED).parquet(place)
    return everything.where("NOT folder").drop("folder", "level")


def list_tree(spark: SparkSession, root: str, skip_hidden: bool = True) -> DataFrame:
    """The audio files of walk; folders that can't be listed are left out."""
    return walk(spark, root, skip_hidden).where("error IS NULL").drop("error")


def list_local(spark: SparkSession, root: str, skip_hidden: bool = True) -> DataFrame:
    """The same by walking a folder the driver sees; entries that begin with a dot are left out unless asked for."""
    if not os.path.exists(root):
        raise FileNotFoundError(root)

    def fail(error: OSError) -> None:
        raise error

    rows = []
    for folder, names, files in os.walk(root, onerror=fail):
        names[:] = sorted(n for n in names if not (skip_hidden and n.startswith(".")))
        for name in files:
            extension = name.rpartition(".")[2].lower() if "." in name else ""
            if extension in EXTENSIONS and not (skip_hidden and name.startswith(".")):
                facts = os.stat(os.path.join(folder, name))
                rows.append((os.path.join(folder, name), extension, facts.st_size, int(facts.st_mtime)))
    return spark.createDataFrame(sorted(rows), LISTING)


def difference(listing: DataFrame, indexed: DataFrame, root: str | None = None, legacy_prefix: bool = False, unread: DataFrame | None = None) -> DataFrame:
    """(path, status): new, changed (another time), unchanged or missing, in one full outer join on the path.

    With a root, only catalog rows below it can be missing; legacy_prefix also
    claims siblings whose name begins with the root's. Rows below a folder that
    could not be listed (unread: path) are not missing.
    """
    there = indexed.select("path", F.col("modified_at").alias("_then"))
    if root is not None:
        prefix = root.rstrip("/") if legacy_prefix else root.rstrip("/") + "/"
        there = there.where(F.startswith("path", F.lit(prefix)))
    if unread is not None:
        there = there.join(F.broadcast(unread.select(F.concat("path", F.lit("/")).alias("_below"))), F.startswith("path", F.col("_below")), "left_anti")
    joined = listing.select("path", F.col("modified_at").alias("_now")).join(there, "path", "full")
    status = F.when(F.col("_then").isNull(), "new").when(F.col("_now").isNull(), "missing").when(F.col("_then") != F.col("_now"), "changed").otherwise("unchanged")
    return joined.select("path", status.alias("status"))


def scan_stats(diff: DataFrame, errors: DataFrame | None = None, duration_ms: int | None = None) -> DataFrame:
    """One row: indexed, skipped, missing, errors and, if given, how long the scan took."""
    counts = diff.agg(
        F.count_if(F.col("status").isin("new", "changed")).alias("indexed"),
        F.count_if(F.col("status") == "unchanged").alias("skipped"),
        F.count_if(F.col("status") == "missing").alias("missing"),
    )
    if errors is None:
        found = counts.select("*", F.lit(0).cast("long").alias("errors"))
    else:
        both = counts.crossJoin(errors.agg(F.count("*").alias("errors")))  # one row each
        found = both.withColumn("indexed", F.col("indexed") - F.col("errors"))
    return found if duration_ms is None else found.withColumn("duration_ms", F.lit(duration_ms).cast("long"))


def stats_of_roots(stats: list[tuple[str, DataFrame | None]]) -> DataFrame:
    """(root, indexed, skipped, missing, errors, duration_ms) of each root and their sum under a null root; a root without stats failed and is one error."""
    rows = None
    for root, own in stats:
        spark = own.sparkSession if own is not None else SparkSession.active()
        if own is None:
            own = spark.range(1).select(*[F.lit(int(c == "errors")).cast("long").alias(c) for c in STATS])
        one = own.select(F.lit(root).alias("root"), *STATS)
        rows = one if rows is None else rows.unionByName(one)
    total = rows.agg(*[F.sum(c).alias(c) for c in STATS]).select(F.lit(None).cast("string").alias("root"), *STATS)
    return rows.unionByName(total)


def scanned_facts(path: str, content: bytes, resolution: int) -> tuple:
    """Header facts and peaks of a file; unreadable headers are an error, unreadable samples give no peaks."""
    extension = path.rpartition(".")[2].lower()
    facts = codecs.facts_of(content, extension)
    try:
        x, rate = codecs.decode(content, extension)
        peaks = peak_pairs(x.mean(axis=1), resolution).ravel().tolist()
    except ValueError:
        x, rate, peaks = None, None, []
    if facts is not None:
        return path, facts.sample_rate, facts.channels, facts.bit_depth, facts.duration_ms, peaks, None
    if x is None:
        return path, None, None, None, None, None, f"not a readable {extension} file"
    return path, rate, x.shape[1], None, len(x) * 1000 // rate, peaks, None


def content(path: str) -> bytes:
    """A file's bytes; local paths have no scheme."""
    if "://" not in path:
        with open(path, "rb") as source:
            return source.read()
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    with store.open_input_stream(place, compression=None) as source:
        return source.read()


def opened(path: str) -> tuple[int, Callable[[int, int], bytes]]:
    """(size, function of offset and length) of a file, for reading parts of it."""
    from pyarrow import fs

    store, place = (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)
    source = store.open_input_file(place)
    return source.size(), lambda at, n: source.read_at(max(0, min(n, source.size() - at)), at)


def dealt(paths: DataFrame, each: int = TASK_FILES) -> DataFrame:
    """Paths only, in as many partitions as reading so many files each needs."""
    tasks = max(paths.sparkSession.sparkContext.defaultParallelism, paths.count() // each + 1)
    return paths.select("path").repartition(tasks, "path")


def read_contents(paths: DataFrame) -> DataFrame:
    """(path, content, error) of the given paths. Tasks open these files and no others; contents are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    data, error = content(path), None
                except (OSError, pa.ArrowException) as e:
                    data, error = None, str(e)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([data], pa.binary()), pa.array([error], pa.string())], names=["path", "content", "error"])

    return dealt(paths).mapInArrow(run, "path string, content binary, error string")


_SCANNED = pa.schema([("path", pa.string()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("bit_depth", pa.int32()), ("duration_ms", pa.int64()), ("peaks", pa.list_(pa.float32())), ("error", pa.string())])


def extract(paths: DataFrame, resolution: int = 800, cancel: Marker | None = None) -> DataFrame:
    """Facts, peaks and an error for files that can't be read, of each path; a task holds one file at a time.

    Formats without a decoder are read by their edges. Once cancel is set, tasks open no further file and end without rows.
    """

    def one(path: str) -> tuple:
        try:
            extension = path.rpartition(".")[2].lower()
            if extension in codecs.BY_EDGES and extension not in DECODERS:
                facts = codecs.edge_facts(*opened(path), extension)
                wrong = None if facts else f"not a readable {extension} file"
                return (path, facts.sample_rate, facts.channels, facts.bit_depth, facts.duration_ms, [], None) if facts else (path, None, None, None, None, None, wrong)
            return scanned_facts(path, content(path), resolution)
        except (OSError, pa.ArrowException) as e:
            return path, None, None, None, None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_FILES):
                rows = []
                for path in batch.column(0).slice(at, BATCH_FILES).to_pylist():
                    if cancel is not None and cancel.is_set():
                        return
                    rows.append(one(path))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _SCANNED)], schema=_SCANNED)

    return dealt(paths).mapInArrow(run, SCANNED)


def asset_rows(listing: DataFrame, facts: DataFrame, root: str, now: int) -> DataFrame:
    """Rows for the catalog from the listing and the extracted facts; files with an error are left out."""
    good = facts.where(F.col("error").isNull()).drop("error")
    joined = listing.drop("extension").join(good, "path")
    parts = parsed_path(root, F.col("path"))
    return joined.select("path", *[c.alias(n) for n, c in parts.items()], "duration_ms", "sample_rate", "channels", "bit_depth", "file_size", "modified_at", F.lit(now).cast("long").alias("indexed_at"), "peaks")
