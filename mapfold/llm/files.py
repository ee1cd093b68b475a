"""Byte files that Python tasks write to, and read from, the shared folder.

The folder's URI decides the file system. A task writes under a name of its
own and returns it with its rows; only names that a finished task returned are
read, so a lost or repeated task leaves at worst a file that nobody reads.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    system, path = at(uri)
    system.create_dir(path, recursive=True)


class NewFile:
    """A file that is moved to its name when it is whole."""

    def __init__(self, folder: str, suffix: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
        self.system, self.path = at(self.uri)
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.stream = self.system.open_output_stream(f"{self.path}.part")
        self.size = 0

    def write(self, data: bytes) -> int:
        """Where data begins."""
        start, self.size = self.size, self.size + len(data)
        self.stream.write(data)
        return start

    def close(self) -> str:
        self.stream.close()
        self.system.move(f"{self.path}.part", self.path)
        return self.uri


class OldFile:
    def __init__(self, uri: str):
        system, path = at(uri)
        self.file = system.open_input_file(path)

    def read(self, start: int, length: int) -> bytes:
        return self.file.read_at(max(0, min(length, self.size - start)), start)

    @property
    def size(self) -> int:
        return self.file.size()

    def close(self) -> None:
        self.file.close()
