"""Export inputs as a data source: files, the members of ZIPs, and the elements of conversation files.

A ZIP's directory is found from its end by seeks and checked before anything is unpacked; each member
is then a partition of its own, read in chunks, so neither a ZIP nor a member is ever held whole.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql import functions as F

from talktree.functions.batches import bounded_batches
from talktree.functions.values import file_type
from talktree.sources import files
from talktree.sources.framing import frame

#: Limits on ZIP files: members, bytes of the directory and of names, a member's bytes, and how much more it may hold than it takes up.
MAX_MEMBERS, MAX_DIRECTORY_BYTES, MAX_NAME_BYTES = 100_000, 128 << 20, 32 << 10
MAX_MEMBER_BYTES, MAX_RATIO = 1 << 40, 1_000
#: Members are read side by side, small ones several to a task; elements are parsed as well, so fewer of theirs.
TASK_BYTES, ELEMENT_TASK_BYTES = 32 << 20, 4 << 20
NAME = "talktree_export"
SCHEMAS = {
    "members": "archive string, path string, size long, compressed long, sha256 string, problem string",
    "elements": "source_file string, array_index long, element string, problem string",
    "files": "path string, sha256 string, size long",
}
_END, _END64, _LOCATOR, _ENTRY = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02"
_ROWS, _BATCH_BYTES = 1024, 4 << 20


def directory_extent(stream: BinaryIO) -> tuple[int, int, int]:
    """(entries, offset, bytes) of a ZIP's directory as its end records say, ZIP64 included."""
    size = stream.seek(0, 2)
    at = max(size - (1 << 16) - 22, 0)
    stream.seek(at)
    tail = stream.read()
    k = len(tail) - 22
    while k >= 0 and not (tail.startswith(_END, k) and k + 22 + int.from_bytes(tail[k + 20 : k + 22], "little") == len(tail)):
        k = tail.rfind(_END, 0, k + 3)
    if k < 0:
        raise ValueError("zip_end_not_found")
    disk, first, here, entries, length, offset = struct.unpack_from("<4H2L", tail, k + 4)
    end = at + k
    if 0xFFFF in (here, entries) or 0xFFFFFFFF in (length, offset):
        stream.seek(max(end - 20, 0))
        mark, _, where, disks = struct.unpack("<4sLQL", stream.read(20).ljust(20, b"\0"))
        if mark == _LOCATOR:
            stream.seek(where)
            record = stream.read(56)
            if len(record) < 56 or not record.startswith(_END64) or disks > 1:
                raise ValueError("zip_end_invalid")
            disk, first, here, entries, length, offset = struct.unpack_from("<2L4Q", record, 16)
            end = where
    if disk or first or here != entries:
        raise ValueError("zip_several_disks")
    if offset + length > end:
        raise ValueError("zip_directory_invalid")
    return entries, offset, length


def check_directory(stream: BinaryIO) -> None:
    """Raises if a ZIP's directory is beyond the limits, before its entries are made objects."""
    entries, offset, length = directory_extent(stream)
    if entries > MAX_MEMBERS:
        raise ValueError("zip_member_limit_exceeded")
    if length > MAX_DIRECTORY_BYTES:
        raise ValueError("zip_directory_too_large")
    stream.seek(offset)
    raw, at = stream.read(length), 0
    for _ in range(entries):
        if not raw.startswith(_ENTRY, at) or at + 46 > length:
            raise ValueError("zip_directory_invalid")
        name, extra, comment = struct.unpack_from("<3H", raw, at + 28)
        if name > MAX_NAME_BYTES:
            raise ValueError("zip_name_too_long")
        at += 46 + name + extra + comment


def zip_members(stream: BinaryIO) -> list[zipfile.ZipInfo]:
    """A ZIP's files, if its directory and all of its entries keep to the limits."""
    check_directory(stream)
    with zipfile.ZipFile(stream) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
    for i in infos:
        if i.file_size > MAX_MEMBER_BYTES or i.file_size > MAX_RATIO * max(i.compress_size, 1024):
            raise ValueError("zip_member_too_large")
        if i.flag_bits & 1:
            raise ValueError("zip_member_encrypted")
        name = i.filename.replace("\\", "/")
        if name.startswith("/") or ".." in name.split("/"):
            raise ValueError("zip_member_path_unsafe")
    return infos


class Part(InputPartition):
    """Some members: (URI, name in the ZIP or None, path shown, bytes, bytes taken up)."""

    def __init__(self, members: list[tuple[str, str | None, str, int, int]]):
        super().__init__(None)
        self.members = members


class ExportReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.what, self.path = options.get("what", "members"), options["path"]
        self.only = set(json.loads(options["only"])) if "only" in options else None
        self.limit, self.tasks = int(options.get("element_bytes", "0")), int(options.get("tasks", "1"))

    def found(self) -> list[tuple[str, str | None, str, int, int]]:
        """All members by name; files that are no ZIPs are members themselves."""
        out = []
        for name, uri, size in files.listed(self.path):
            if self.what != "files" and name.lower().endswith(".zip"):
                with files.opened(uri) as stream:
                    out += [(uri, i.filename, i.filename, i.file_size, i.compress_size) for i in zip_members(stream)]
            else:
                out.append((uri, None, name, size, size))
        return out

    def partitions(self) -> list[Part]:
        groups: list[list] = []
        held = 0
        chosen = [m for m in self.found() if self.only is None or m[2] in self.only]
        most = min(ELEMENT_TASK_BYTES, sum(m[3] for m in chosen) // self.tasks) if self.what == "elements" else TASK_BYTES
        for member in chosen:
            if not groups or held + member[3] > most:
                groups.append([])
                held = 0
            groups[-1].append(member)
            held += member[3]
        return [Part(g) for g in groups]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        for uri, inner, path, size, taken in partition.members:
            with files.opened(uri) as stream:
                yield from self._read(stream, uri, inner, path, size, taken)

    def _read(self, stream: BinaryIO, uri: str, inner: str | None, path: str, size: int, taken: int) -> Iterator[pa.RecordBatch]:
        if self.what == "elements":
            yield from element_batches(path, frame(_bytes(stream, inner), **({"limit": self.limit} if self.limit else {})))
            return
        digest, problem = hashlib.sha256(), None
        try:
            for chunk in _bytes(stream, inner):
                digest.update(chunk)
        except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError):
            problem = "zip_member_damaged"
        sha = None if problem else digest.hexdigest()
        if self.what == "files":
            yield pa.RecordBatch.from_pylist([{"path": path, "sha256": sha, "size": size}])
        else:
            row = {"archive": uri if inner else None, "path": path, "size": size, "compressed": taken, "sha256": sha, "problem": problem}
            yield pa.RecordBatch.from_pylist([row], pa.schema([(k, pa.int64() if k in ("size", "compressed") else pa.string()) for k in row]))


def _bytes(stream: BinaryIO, inner: str | None) -> Iterator[bytes]:
    """A member's bytes in chunks; at its end its checksum is compared."""
    if inner is None:
        yield from files.chunks(stream)
        return
    with zipfile.ZipFile(stream) as z, z.open(inner) as member:
        yield from files.chunks(member)


def _damage_told(path: str, elements: Iterator) -> Iterator:
    """The elements, and a problem in place of those that a damaged member doesn't give."""
    index = 0
    try:
        for row in elements:
            index = row[0] + 1
            yield row
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError):
        yield index, None, "zip_member_damaged"


def element_batches(path: str, elements: Iterator[tuple[int, str | None, str | None]]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for row in _damage_told(path, elements):
        rows.append(row)
        held += len(row[1] or "")
        if len(rows) >= _ROWS or held >= _BATCH_BYTES:
            yield _element_batch(path, rows)
            rows, held = [], 0
    if rows:
        yield _element_batch(path, rows)


def _element_batch(path: str, rows: list[tuple[int, str | None, str | None]]) -> pa.RecordBatch:
    index, text, problem = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(index, pa.int64()), pa.array(text, pa.string()), pa.array(problem, pa.string())], ["source_file", "array_index", "element", "problem"])


class ExportSource(DataSource):
    """``spark.read.format("talktree_export").option("what", "members" | "elements" | "files").load(path)``.

    ``only``: a JSON list of member paths to read.  ``element_bytes``: a larger element is reported and passed over.
    ``tasks``: elements are spread over so many tasks, if there are as many members.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMAS[self.options.get("what", "members")]

    def reader(self, schema) -> ExportReader:
        return ExportReader(dict(self.options))


def _read(spark: SparkSession, path: str, what: str, **options: str) -> DataFrame:
    spark.dataSource.register(ExportSource)
    bounded_batches(spark)
    return spark.read.format(NAME).option("what", what).options(**options).load(path)


def members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, path, size, compressed, sha256, problem, file_type) of all files of an input and of its ZIPs."""
    return _read(spark, path, "members").withColumn("file_type", file_type(F.col("path")))


def elements(spark: SparkSession, path: str, only: list[str], element_bytes: int = 0) -> DataFrame:
    """(source_file, array_index, element, problem) of some members, small ones several to a task where there are more than cores."""
    return _read(spark, path, "elements", only=json.dumps(only), element_bytes=str(element_bytes), tasks=str(spark.sparkContext.defaultParallelism))


def input_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size) of an input's own files."""
    return _read(spark, path, "files")
