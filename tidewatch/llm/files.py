"""Binary files in the shared folder, from any worker. Names are never used twice, so a task that runs again harms none."""

from __future__ import annotations

import uuid
from collections import OrderedDict

from pyarrow import fs as pafs


def system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI (file, hdfs, s3, gs), and the path in it."""
    return pafs.FileSystem.from_uri(path)


def create(folder: str, name: str):
    """(path, stream) of a new file; folders are made as needed."""
    where, inner = system(folder)
    where.create_dir(inner, recursive=True)
    name = f"{name}-{uuid.uuid4().hex}"
    return f"{folder}/{name}", where.open_output_stream(f"{inner}/{name}")


def open_random(path: str):
    where, inner = system(path)
    return where.open_input_file(inner)


class OpenFiles:
    """The files read last, at most `most` of them."""

    def __init__(self, most: int = 64):
        self.most, self.files = most, OrderedDict()

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path in self.files:
            self.files.move_to_end(path)
        else:
            self.files[path] = open_random(path)
            if len(self.files) > self.most:
                self.files.popitem(last=False)[1].close()
        f = self.files[path]
        f.seek(offset)
        return f.read(length)
