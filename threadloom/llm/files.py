"""Byte files in the folder that driver and executors share, through whatever file system its URI names."""

from __future__ import annotations

from pyarrow import fs as pafs

from threadloom.scratch import remove_dir

__all__ = ["Ranges", "Writer", "make_dir", "open_fs", "remove_dir"]


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    fs, path = open_fs(uri)
    fs.create_dir(path, recursive=True)


class Writer:
    """A file written from front to back; ``at`` is the next byte's offset."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.uri, self.at = uri, 0
        self._out = fs.open_output_stream(path)

    def write(self, data: bytes) -> int:
        start = self.at
        self._out.write(data)
        self.at += len(data)
        return start

    def close(self) -> None:
        self._out.close()


class Ranges:
    """Range reads; the last few files stay open."""

    def __init__(self, most_open: int = 16):
        self._open: dict[str, object] = {}
        self._most = most_open

    def _file(self, uri: str):
        if uri not in self._open:
            if len(self._open) >= self._most:
                self._open.pop(next(iter(self._open))).close()
            fs, path = open_fs(uri)
            self._open[uri] = fs.open_input_file(path)
        return self._open[uri]

    def read(self, uri: str, offset: int, length: int) -> bytes:
        return self._file(uri).read_at(length, offset)

    def size(self, uri: str) -> int:
        return self._file(uri).size()
