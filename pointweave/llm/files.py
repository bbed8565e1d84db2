"""Files in the folder that driver and executors share, on any store that PyArrow opens (file, hdfs, s3, gs)."""

from __future__ import annotations

import uuid

from pyarrow import fs


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI, and the folder's path in it."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def own_name(kind: str) -> str:
    """A name that no other attempt of the same task has; only a finished attempt's names get into a manifest."""
    return f"{kind}-{uuid.uuid4().hex}"


class Folder:
    def __init__(self, uri: str):
        self.fs, self.path = store(uri)
        self.fs.create_dir(self.path, recursive=True)

    def write(self, name: str):
        return self.fs.open_output_stream(f"{self.path}/{name}", compression=None)

    def read(self, name: str):
        return self.fs.open_input_file(f"{self.path}/{name}")

    def stream(self, name: str):
        return self.fs.open_input_stream(f"{self.path}/{name}", compression=None)

    def delete(self, name: str) -> None:
        self.fs.delete_file(f"{self.path}/{name}")
