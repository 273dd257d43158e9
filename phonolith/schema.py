"""The catalog's relations, the search request and its enums."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The catalog's columns.
ASSETS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("filename", T.StringType(), False),
        T.StructField("extension", T.StringType(), False),
        T.StructField("folder", T.StringType(), False),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("sample_rate", T.IntegerType()),
        T.StructField("channels", T.IntegerType()),
        T.StructField("bit_depth", T.IntegerType()),
        T.StructField("file_size", T.LongType(), False),
        T.StructField("category", T.StringType()),
        T.StructField("publisher", T.StringType()),
        T.StructField("favorite", T.BooleanType(), False),
        T.StructField("rating", T.IntegerType(), False),
        T.StructField("notes", T.StringType()),
        T.StructField("play_count", T.LongType(), False),
        T.StructField("modified_at", T.LongType(), False),
        T.StructField("indexed_at", T.LongType(), False),
    ]
)
#: Peaks are wide and rarely read, so they have a table of their own.
PEAKS = T.StructType([T.StructField("asset_id", T.LongType(), False), T.StructField("peaks", T.ArrayType(T.FloatType()))])
TAGS = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType(), False)])
ASSET_TAGS = T.StructType([T.StructField("asset_id", T.LongType(), False), T.StructField("tag_id", T.LongType(), False)])
EMBEDDINGS = T.StructType(
    [
        T.StructField("asset_id", T.LongType(), False),
        T.StructField("vector", T.ArrayType(T.FloatType()), False),
        T.StructField("model_id", T.StringType()),
        T.StructField("created_at", T.LongType()),
    ]
)
#: What a search returns of an asset.
RESULT_COLUMNS = [f.name for f in ASSETS if f.name not in ("modified_at", "indexed_at")]
#: What ingest overwrites when a file changes; the rest belongs to the user.
TECHNICAL_COLUMNS = ["filename", "extension", "folder", "duration_ms", "sample_rate", "channels", "bit_depth", "file_size", "category", "publisher", "modified_at", "indexed_at"]
TEXT_COLUMNS = ["filename", "folder", "category", "publisher", "notes"]
EXTENSIONS = ("wav", "flac", "mp3", "ogg", "aiff", "aif")


class ValidationError(ValueError):
    """A request that the catalog refuses."""


class SearchMode(Enum):
    LEXICAL = "lexical"
    VECTOR = "vector"
    BOTH = "both"


class SortField(Enum):
    RELEVANCE = "relevance"
    NAME = "name"
    DURATION = "duration"
    DATE = "date"


class SortDirection(Enum):
    ASC = "asc"
    DESC = "desc"


@dataclass(frozen=True)
class SearchQuery:
    text: str = ""
    mode: SearchMode = SearchMode.LEXICAL
    extensions: list[str] = field(default_factory=list)
    duration_min: int | None = None
    duration_max: int | None = None
    sample_rates: list[int] = field(default_factory=list)
    channels: int | None = None
    favorites_only: bool = False
    tags: list[str] = field(default_factory=list)
    publisher: str | None = None
    folder_root: str | None = None
    sort_by: SortField = SortField.RELEVANCE
    sort_dir: SortDirection = SortDirection.DESC
    offset: int = 0
    limit: int = 50


@dataclass(frozen=True)
class Catalog:
    """One snapshot of the library."""

    assets: DataFrame
    tags: DataFrame
    asset_tags: DataFrame
    embeddings: DataFrame
    peaks: DataFrame
