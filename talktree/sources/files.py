"""Files of a store, opened where Python runs: on executors by sources and sinks, on the driver for listings.

Stores that Arrow's file systems know are reached: local and mounted folders, S3, GCS, and HDFS where its
native library is installed.  ``reachable`` tells; what it rejects goes by way of Spark's own readers.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs

CHUNK = 1 << 20


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or an absolute path, and the path in it."""
    return fs.FileSystem.from_uri(uri)


def below(folder: str, name: str) -> str:
    """The URI of a path below a folder; a name may have any characters."""
    return f"{folder.rstrip('/')}/{quote(name) if '://' in folder or folder.startswith('file:') else name}"


def reachable(uri: str) -> bool:
    """Whether Python can look at the path."""
    try:
        store, path = located(uri)
        store.get_file_info(path)
    except (pa.ArrowException, OSError, NotImplementedError):
        return False
    return True


def listed(uri: str) -> list[tuple[str, str, int]]:
    """(path below the folder, URI, size) of every file; a file by itself is listed by its name."""
    store, path = located(uri)
    info = store.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type == fs.FileType.File:
        return [(posixpath.basename(path), uri, info.size)]
    found = store.get_file_info(fs.FileSelector(path, recursive=True))
    names = [(posixpath.relpath(i.path, path), i.size) for i in found if i.type == fs.FileType.File]
    return sorted((name, below(uri, name), size) for name, size in names)


def opened(uri: str) -> BinaryIO:
    """A file to read by seeks."""
    store, path = located(uri)
    return store.open_input_file(path)


def chunks(stream: BinaryIO, size: int = CHUNK) -> Iterator[bytes]:
    while part := stream.read(size):
        yield part


def made(uri: str) -> BinaryIO:
    """A file to write from its beginning; folders above it are made."""
    store, path = located(uri)
    store.create_dir(posixpath.dirname(path), recursive=True)
    return store.open_output_stream(path)


def moved(old: str, new: str) -> None:
    """Gives a whole file its name; one that has it already is replaced."""
    store, path = located(old)
    goal = located(new)[1]
    store.create_dir(posixpath.dirname(goal), recursive=True)
    store.move(path, goal)


def removed(uri: str) -> None:
    """Deletes a file, or a folder with what it holds, if it is there."""
    store, path = located(uri)
    kind = store.get_file_info(path).type
    if kind == fs.FileType.Directory:
        store.delete_dir(path)
    elif kind == fs.FileType.File:
        store.delete_file(path)


def same(one: str, other: str) -> bool:
    """Whether both files are there and hold the same bytes."""
    a, b = (store.get_file_info(path) for store, path in (located(one), located(other)))
    if fs.FileType.NotFound in (a.type, b.type) or a.size != b.size:
        return False
    with opened(one) as x, opened(other) as y:
        return all(p == q for p, q in zip(chunks(x), chunks(y)))
