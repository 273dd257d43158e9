"""String expressions: paths, ASCII case, search text, display formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def nocase(text: Column) -> Column:
    """ASCII case folding; other letters stay (``Ä`` is not ``ä``)."""
    return F.translate(text, UPPER, UPPER.lower())


def normalized_folder(folder: Column) -> Column:
    """Backslashes become slashes; no slash before a drive such as ``C:``."""
    return F.regexp_replace(F.translate(folder, "\\", "/"), "^/([A-Za-z]:)(/|$)", "$1$2")


def normalize_folder(folder: str) -> str:
    return re.sub(r"^/([A-Za-z]:)(?=/|$)", r"\1", folder.replace("\\", "/"))


def is_drive(segment: Column) -> Column:
    return segment.rlike("^[A-Za-z]:$")


def segments(folder: Column) -> Column:
    """The folder's names, root first."""
    return F.filter(F.split(normalized_folder(folder), "/"), lambda s: s != "")


def ancestors(folder: Column) -> Column:
    """The folder itself and all folders above it, as absolute paths; none for ``/``."""
    names = segments(folder)
    lead = F.when(is_drive(F.element_at(names, 1)), F.lit("")).otherwise(F.lit("/"))
    paths = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.concat(lead, F.array_join(F.slice(names, 1, i), "/")))
    return F.when(F.size(names) > 0, paths).otherwise(F.array().cast("array<string>"))


def parsed_path(root: Column | str, path: Column) -> dict[str, Column]:
    """folder, filename, extension, publisher and category of a file below root."""
    root = F.lit(root.rstrip("/")) if isinstance(root, str) else F.rtrim(root, F.lit("/"))
    name = F.element_at(F.split(path, "/"), -1)
    folder = F.regexp_replace(path, "/[^/]*$", "")
    folder = normalized_folder(F.when(folder == "", F.lit("/")).otherwise(folder))
    dirs = F.filter(F.split(F.substr(folder, F.length(root) + 1), "/"), lambda s: s != "")
    dirs = F.when(F.startswith(folder, root), dirs).otherwise(F.array().cast("array<string>"))
    return {
        "folder": folder,
        "filename": F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""),
        "extension": F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1)),
        "publisher": F.when(F.size(dirs) >= 1, F.element_at(dirs, 1)),
        "category": F.when(F.size(dirs) >= 2, F.array_join(F.slice(dirs, F.lit(2), F.size(dirs) - 1), " > ")),
    }


def like_pattern(text: str) -> str:
    """A contains pattern in which only ``%`` and ``_`` are special."""
    return "%" + text.replace("\\", "\\\\") + "%"


def search_text(text: str) -> str:
    """The search text without query operators: lower case, single spaces, inner and/or/not removed."""
    out = re.sub(r'[():^*"]', " ", text).lower()
    for word in (" and ", " or ", " not "):
        while word in out:
            out = out.replace(word, " ")
    return " ".join(out.split())


def occurrences(text: Column, token: str) -> Column:
    """How often the token occurs in the text, overlaps included."""
    return F.regexp_count(text, F.lit(f"(?={re.escape(token)})"))


def tokens(text: Column, separators: str) -> Column:
    """The non-empty parts between separators, joined by single spaces."""
    return F.array_join(F.filter(F.split(text, separators), lambda s: s != ""), " ")


def embedding_document(tag_names: Column) -> Column:
    """The text that stands for an asset: names, folders, facts and tags; needs the catalog's text columns."""
    name, folder = F.col("filename"), F.col("folder")
    words, places = tokens(name, "[_\\- .]"), tokens(folder, "[/\\\\_\\- ]")
    part = lambda c: F.when(F.trim(c) != "", F.trim(c))
    parts = [
        F.when(name != "", name),
        F.when((words != "") & (words != name), words),
        F.when(folder != "", folder),
        F.when(places != "", places),
        *[part(F.col(c)) for c in ("category", "publisher", "notes")],
        F.when(tag_names != "", tag_names),
    ]
    return F.trim(F.regexp_replace(F.concat_ws(" ", *parts), r"\s+", " "))


def _padded(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def duration_label(ms: Column) -> Column:
    """``0:SS.f``, ``M:SS.f`` or ``H:MM:SS.f``; a dash for null."""
    whole = F.floor(ms / 1000)
    tenth = F.least(F.lit(9), F.floor((ms / 1000 - whole) * 10 + 0.5))
    tail = F.concat(_padded(whole % 60), F.lit("."), tenth.cast("string"))
    short = F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), tail)
    long = F.concat(F.floor(whole / 3600).cast("string"), F.lit(":"), _padded(F.floor((whole % 3600) / 60)), F.lit(":"), tail)
    return F.when(ms.isNull(), F.lit("—")).when(whole < 3600, short).otherwise(long)


def _one_decimal(x: Column) -> Column:
    return F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10)


def size_label(size: Column) -> Column:
    label = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        label = F.when(size < 1024**power, label).otherwise(F.concat(_one_decimal(size / 1024**power), F.lit(f" {unit}"))) if power == 1 else F.when(size >= 1024**power, F.concat(_one_decimal(size / 1024**power), F.lit(f" {unit}"))).otherwise(label)
    return label


def rate_label(rate: Column) -> Column:
    fixed = {44100: "44.1 kHz", 48000: "48 kHz", 96000: "96 kHz", 22050: "22.05 kHz"}
    label = F.when(rate >= 1000, F.concat(_one_decimal(rate / 1000), F.lit(" kHz"))).otherwise(F.concat(rate.cast("string"), F.lit(" Hz")))
    for value, text in fixed.items():
        label = F.when(rate == value, F.lit(text)).otherwise(label)
    return label


def safe_stem(filename: Column) -> Column:
    """A name for an export: no path or control characters, at most 120 characters, ``clip`` if nothing is left."""
    stem = F.regexp_replace(F.element_at(F.split(filename, "/"), -1), r"(?<=.)\.[^.]*$", "")
    safe = F.trim(F.substr(F.regexp_replace(stem, r'[/\\:*?"<>|\p{Cntrl}]', "_"), F.lit(1), F.lit(120)))
    return F.when((safe == "") | (safe == "."), F.lit("clip")).otherwise(F.regexp_replace(safe, r"\.+$", ""))


def clip_name(filename: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s_%.3f-%.3fs.wav", safe_stem(filename), start.cast("double"), end.cast("double"))


def full_name(filename: Column) -> Column:
    return F.concat(safe_stem(filename), F.lit(".wav"))


def unique_name(basename: str, taken: set[str]) -> str:
    """The name, or the first of ``_2``, ``_3`` ... that is not taken."""
    if basename not in taken:
        return basename
    stem = basename.removesuffix(".wav")
    return next(f"{stem}_{n}.wav" for n in range(2, 10_000) if f"{stem}_{n}.wav" not in taken)
