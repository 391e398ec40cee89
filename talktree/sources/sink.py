"""A sink of files: rows (path, content) become files, or members of ZIPs, written by executors.

Rows of one path that follow each other are pieces of one file, so a file is never held whole.  A file
is written in an attempt's own folder and moved to its place when it is whole, and only if it differs
from what is there; a task that is killed leaves nothing in place, and what it began goes with the
attempt's folder.  ZIPs, one for each task, get their names when all tasks have ended.
"""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from talktree.functions.batches import bounded_batches
from talktree.sources import files

NAME = "talktree_files"
_ATTEMPT = ".attempt-"


@dataclass
class Written(WriterCommitMessage):
    written: int = 0
    unchanged: int = 0
    part: str | None = None  # a ZIP that waits for its name
    task: int = 0


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            yield path, content.encode() if isinstance(content, str) else content or b""


def safe_path(path: str) -> str:
    """A path below the folder; one that leads out of it is an error."""
    parts = path.replace("\\", "/").split("/")
    if path.startswith("/") or any(p in ("", ".", "..") for p in parts) or parts[0].startswith(_ATTEMPT):
        raise ValueError("output_path_unsafe")
    return path


class FileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"].rstrip("/")
        self.zipped = options.get("as", "files") == "zip"
        self.summary = options.get("summary")
        self.attempt = f"{self.folder}/{_ATTEMPT}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        out = Written(task=task.partitionId())
        own = f"{self.attempt}/{task.partitionId()}-{task.taskAttemptId()}"
        if self.zipped:
            self._write_zip(_pieces(iterator), f"{own}.zip", out)
        else:
            self._write_files(_pieces(iterator), own, out)
        return out

    def _write_files(self, pieces: Iterator[tuple[str, bytes]], own: str, out: Written) -> None:
        for count, (path, run) in enumerate(groupby(pieces, key=lambda x: x[0])):
            place, part = files.below(self.folder, safe_path(path)), f"{own}-{count}"
            with files.made(part) as stream:
                for _, content in run:
                    stream.write(content)
            if files.same(part, place):
                files.removed(part)
                out.unchanged += 1
            else:
                files.moved(part, place)
                out.written += 1

    def _write_zip(self, pieces: Iterator[tuple[str, bytes]], own: str, out: Written) -> None:
        first = next(pieces, None)
        if first is None:
            return
        with files.made(own) as stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as z:
            for path, run in groupby(chain([first], pieces), key=lambda x: x[0]):
                with z.open(_entry(path), "w", force_zip64=True) as member:
                    for _, content in run:
                        member.write(content)
                out.written += 1
        out.part = own

    def commit(self, messages: list[Written | None]) -> None:
        told = [m for m in messages if m is not None]
        for m in told:
            if m.part:
                files.moved(m.part, f"{self.folder}/part-{m.task:05d}.zip")
        files.removed(self.attempt)
        if self.summary:
            with files.made(self.summary) as f:
                f.write(json.dumps({"written": sum(m.written for m in told), "unchanged": sum(m.unchanged for m in told)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files.removed(self.attempt)


def _entry(path: str) -> zipfile.ZipInfo:
    """A member with a fixed time, so equal rows make equal archives."""
    info = zipfile.ZipInfo(safe_path(path), (1980, 1, 1, 0, 0, 0))
    info.compress_type = zipfile.ZIP_DEFLATED
    return info


class FileSink(DataSource):
    """``df.write.format("talktree_files").option("as", "files" | "zip").mode("append").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(dict(self.options))


def write_rows(rows: DataFrame, folder: str, form: str = "files") -> dict[str, int]:
    """Writes (path, content) rows below a folder that ``files.reachable`` accepts; how many were written and left alone.

    With several rows for a path, they must follow each other in one partition, in order.  Null content is empty.
    Files that no row names stay.  Of one path in several partitions the last to end wins.
    """
    spark = rows.sparkSession
    spark.dataSource.register(FileSink)
    bounded_batches(spark)
    summary = f"{folder.rstrip('/')}/{_ATTEMPT}{uuid.uuid4().hex}.json"
    rows.select("path", "content").write.format(NAME).option("as", form).option("summary", summary).mode("append").save(folder)
    with files.opened(summary) as f:
        counts = json.loads(f.read())
    files.removed(summary)
    return counts
