"""Files through PyArrow, of executors too: local ones, hdfs, s3 and gs."""

from __future__ import annotations

import uuid

from pyarrow import fs

from pointweave.sources import mcap


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the path inside it."""
    if path.startswith("s3a:"):
        path = "s3:" + path[4:]
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str, ending: str) -> list[fs.FileInfo]:
    """The file, or all files with that ending in the folder and those inside, by name."""
    store, inside = opened(path)
    info = store.get_file_info(inside)
    if info.is_file:
        return [info]
    return sorted((i for i in store.get_file_info(fs.FileSelector(inside, recursive=True)) if i.path.endswith(ending)), key=lambda i: i.path)


def definitions_of(root: str, path: str) -> mcap.Container:
    """A container's definitions. root: any path or URI of its store."""
    store, _ = opened(root)
    with store.open_input_file(path) as file:
        return mcap.read_definitions(lambda n, at: file.read_at(n, at), file.size())


class Staged:
    """Files of one attempt of a task: written under a name of their own, moved to theirs when the job is committed."""

    def __init__(self, folder: str):
        self.store, self.folder = opened(folder)
        self.folder = self.folder.rstrip("/")
        self.own = f"{self.folder}/_attempt-{uuid.uuid4().hex}"
        self.names: list[str] = []

    def create(self, name: str):
        self.names.append(name)
        path = f"{self.own}/{len(self.names)}"
        self.store.create_dir(self.own, recursive=True)
        return self.store.open_output_stream(path)


def settle(folder: str, attempts: list[tuple[str, list[str]]]) -> None:
    """Move the files of finished attempts (their folder and names) to where they belong."""
    store, inside = opened(folder)
    inside = inside.rstrip("/")
    for own, names in attempts:
        for k, name in enumerate(names):
            target = f"{inside}/{name}"
            store.create_dir(target.rsplit("/", 1)[0], recursive=True)
            if store.get_file_info(target).is_file:
                store.delete_file(target)
            store.move(f"{own}/{k + 1}", target)
        if names:
            store.delete_dir(own)


def discard(folder: str) -> None:
    """Delete what attempts have left that weren't finished."""
    store, inside = opened(folder)
    found = store.get_file_info(fs.FileSelector(inside, allow_not_found=True))
    for i in found:
        if i.base_name.startswith("_attempt-"):
            store.delete_dir(i.path)
