"""Files in the shared folder, by its URI, from executors and driver."""

from __future__ import annotations

import uuid
from typing import IO

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI (file:, hdfs:, s3:, gs:, ...)."""
    return fs.FileSystem.from_uri(uri)


class Committed:
    """An output file that appears under its name only when it is whole.

    It is written under a name of its own, and renamed at the end; so a task that fails leaves no
    file by that name, and of two attempts at one task each replaces the other's equal file.
    """

    def __init__(self, folder: str, name: str) -> None:
        self._fs, root = at(folder)
        self._fs.create_dir(root, recursive=True)
        self.path = f"{root}/{name}"
        self._temporary = f"{root}/_temporary-{uuid.uuid4().hex}-{name}"
        self.stream: IO[bytes] = self._fs.open_output_stream(self._temporary, compression=None)

    def commit(self) -> None:
        self.stream.close()
        self._fs.move(self._temporary, self.path)

    def abort(self) -> None:
        self.stream.close()
        self._fs.delete_file(self._temporary)
