"""Search filters, all conjunctive; each is a Column, but for tags, which are a semi join."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonolith.functions.text import nocase, normalize_folder
from phonolith.schema import Catalog, SearchQuery


def below_folder(root: str, folder: Column | None = None) -> Column:
    """The folder is root or lies below it; ``/`` means all, an empty root nothing."""
    folder = F.col("folder") if folder is None else folder
    root = normalize_folder(root)
    if root == "":
        return F.lit(False)
    if root == "/":
        return F.lit(True)
    return (folder == root) | F.startswith(folder, F.lit(f"{root}/"))


def conditions(q: SearchQuery) -> Column:
    found: list[Column] = []
    if q.extensions:
        found.append(F.col("extension").isin(q.extensions))
    if q.duration_min is not None:
        found.append(F.col("duration_ms") >= q.duration_min)
    if q.duration_max is not None:
        found.append(F.col("duration_ms") <= q.duration_max)
    if q.sample_rates:
        found.append(F.col("sample_rate").isin(q.sample_rates))
    if q.channels is not None:
        found.append(F.col("channels") == q.channels)
    if q.favorites_only:
        found.append(F.col("favorite"))
    if q.publisher is not None:
        found.append(F.col("publisher") == q.publisher)
    if q.folder_root is not None:
        found.append(below_folder(q.folder_root))
    return reduce(and_, found, F.lit(True))


def tagged_any(catalog: Catalog, names: list[str]) -> DataFrame:
    """asset_id of the assets with any of the tags, ASCII case ignored."""
    wanted = catalog.tags.where(nocase(F.col("name")).isin([n.translate({c: c + 32 for c in range(65, 91)}) for n in names]))
    return catalog.asset_tags.join(wanted, F.col("tag_id") == F.col("id"), "left_semi").select("asset_id")


def filtered(catalog: Catalog, q: SearchQuery) -> DataFrame:
    out = catalog.assets.where(conditions(q))
    if q.tags:
        tagged = tagged_any(catalog, q.tags)
        out = out.join(tagged, out["id"] == tagged["asset_id"], "left_semi")
    return out
