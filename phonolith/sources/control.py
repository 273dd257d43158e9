"""Cancelling work inside tasks: a marker in a folder that the driver and all executors see."""

from __future__ import annotations

from dataclasses import dataclass


class Cancelled(RuntimeError):
    """The work was cancelled; nothing of it is kept."""


@dataclass(frozen=True)
class Marker:
    """A file that is there once the work is cancelled; any process may set it."""

    path: str

    def _place(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if ":/" in self.path else f"file://{self.path}")

    def set(self) -> None:
        store, place = self._place()
        store.create_dir(place.rpartition("/")[0], recursive=True)
        with store.open_output_stream(place, compression=None):
            pass

    def is_set(self) -> bool:
        from pyarrow import fs

        store, place = self._place()
        return store.get_file_info(place).type != fs.FileType.NotFound

    def check(self) -> None:
        if self.is_set():
            raise Cancelled(self.path)
