"""Settings from a TOML file: missing file or keys mean defaults, a wrong file is an error."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path

from phonolith.schema import ValidationError


@dataclass(frozen=True)
class General:
    scan_roots: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Indexing:
    parallel_workers: int = 0
    peak_resolution: int = 800
    skip_hidden_dirs: bool = True
    watch_scan_roots: bool = False


@dataclass(frozen=True)
class Playback:
    buffer_cache_count: int = 10
    auto_play: bool = True
    loop_playback: bool = False
    clip_notch_ms: int = 100


@dataclass(frozen=True)
class Search:
    default_sort: str = "relevance"
    results_per_page: int = 50
    default_search_mode: str = "lexical"


@dataclass(frozen=True)
class Settings:
    general: General = General()
    indexing: Indexing = Indexing()
    playback: Playback = Playback()
    search: Search = Search()


def _filled(default, found: dict):
    known = {f.name: getattr(default, f.name) for f in fields(default)}
    values = {}
    for name, value in found.items():
        if name not in known:
            continue
        if is_dataclass(known[name]):
            if not isinstance(value, dict):
                raise ValidationError(f"{name} must be a section")
            value = _filled(known[name], value)
        elif type(value) is not type(known[name]):
            raise ValidationError(f"{name} must be {type(known[name]).__name__}")
        values[name] = value
    return replace(default, **values)


def load_settings(path: str) -> Settings:
    if not Path(path).exists():
        return Settings()
    try:
        return _filled(Settings(), tomllib.loads(Path(path).read_text(encoding="utf-8")))
    except tomllib.TOMLDecodeError as error:
        raise ValidationError(f"{path}: {error}") from error


def save_settings(settings: Settings, path: str) -> None:
    def text(value) -> str:
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, list):
            return "[" + ", ".join(map(text, value)) + "]"
        return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"' if isinstance(value, str) else str(value)

    lines = []
    for section in fields(settings):
        own = getattr(settings, section.name)
        lines += [f"[{section.name}]", *[f"{f.name} = {text(getattr(own, f.name))}" for f in fields(own)], ""]
    Path(path).write_text("\n".join(lines), encoding="utf-8")
