"""Export inputs by way of Spark's own reader of files, and which of their members hold conversations.

Paths may lie in any store that Spark reads, but a file is opened whole by one task; where Python can
reach the store, :mod:`talktree.sources.members` reads by chunks instead.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talktree.functions.values import file_type
from talktree.sources import files, members
from talktree.sources.framing import frame
from talktree.sources.members import element_batches

#: Names of conversation files, whole or in numbered shards.
WHOLE = "conversations.json"
SHARD = r"(?i)^(?:.*/)?conversations-(\d+)\.json$"
#: Limits on ZIP files: members, a member's bytes, and how much more it may hold than it takes up.
MAX_MEMBERS, MAX_MEMBER_BYTES, MAX_RATIO = 200_000, 2_000_000_000, 1_000
_MAC = re.compile(r"(?:^|/)(?:__MACOSX(?:/|$)|\._|\.DS_Store$)")

ELEMENTS = "source_file string, array_index long, element string, problem string"


def is_metadata_path(path: str) -> bool:
    """Files that a system adds to archives."""
    return bool(_MAC.search(path.replace("\\", "/")))


def _checked(z: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    """A ZIP's files, if its directory keeps to the limits."""
    infos = [i for i in z.infolist() if not i.is_dir()]
    if len(infos) > MAX_MEMBERS:
        raise ValueError("zip_member_limit_exceeded")
    for i in infos:
        if i.file_size > MAX_MEMBER_BYTES or i.file_size > MAX_RATIO * max(i.compress_size, 1024):
            raise ValueError("zip_member_too_large")
        if i.flag_bits & 1:
            raise ValueError("zip_member_encrypted")
        name = i.filename.replace("\\", "/")
        if name.startswith("/") or ".." in name.split("/"):
            raise ValueError("zip_member_path_unsafe")
    return infos


def find_input(names: list[str]) -> str:
    """The input among a folder's file names: its only ZIP, else its conversation file."""
    zips = sorted(n for n in names if n.lower().endswith(".zip"))
    if len(zips) == 1:
        return zips[0]
    if len(zips) > 1:
        raise ValueError("several_zip_files")
    if WHOLE in names or any(re.match(SHARD, n) for n in names):
        return "."
    raise ValueError("no_input_found")


def resolve_input(path: str) -> str:
    """The input that a path means: in a folder, what ``find_input`` picks; any other path itself."""
    if not files.reachable(path) or (names := [n for n, *_ in files.listed(path)]) == [path.rstrip("/").rsplit("/", 1)[-1]]:
        return path
    top = [n for n in names if "/" not in n]
    found = find_input(top if any(n.lower().endswith(".zip") for n in top) else [n.rsplit("/", 1)[-1] for n in names])
    return path if found == "." else files.below(path, found)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files (path, content) to their members; ZIPs are opened, others are members themselves."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not zipfile.is_zipfile(io.BytesIO(content)):
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(content)]), pa.array([content], pa.binary())], ["path", "size", "content"])
                continue
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for i in _checked(z):
                    yield pa.RecordBatch.from_arrays([pa.array([i.filename]), pa.array([i.file_size]), pa.array([z.read(i)], pa.binary())], ["path", "size", "content"])


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """``(path, size, content, sha256, file_type)`` of all files in a ZIP, a file or a folder; system files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    rows = files.mapInArrow(_members, "path string, size long, content binary")
    rows = rows.where(~F.regexp_replace("path", r"\\", "/").rlike(_MAC.pattern))
    return rows.withColumns({"sha256": F.sha2("content", 256), "file_type": file_type(F.col("path"))})


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sha256, size)`` of the input files themselves."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def selected_sources(members: DataFrame) -> DataFrame:
    """Members that hold conversations, in order: numbered shards if there are any, else the whole file.

    Two members of one number, or several whole files, are an error.
    """
    rows = members.withColumn("shard", F.expr(f"try_cast(nullif(regexp_extract(path, r'{SHARD}', 1), '') as bigint)"))
    shards = rows.where("shard is not null")
    whole = rows.where("shard is null").where(F.element_at(F.split("path", "/"), -1) == WHOLE).withColumn("shard", F.lit(-1).cast("long"))
    picked = shards if shards.limit(1).count() else whole
    twice = picked.groupBy("shard").count().where("count > 1").limit(1).count()
    if twice:
        raise ValueError("duplicate_conversation_source")
    return picked.orderBy("shard")


def _split_array(text: str) -> Iterator[str]:
    """Elements of a top-level JSON array, as text; raises for anything else."""
    for _, element, problem in frame([text.encode()]):
        if problem:
            raise ValueError(problem)
        yield element


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield from element_batches(path, frame([content]))


def read_elements(sources: DataFrame) -> DataFrame:
    """``(source_file, array_index, element, problem)``: the JSON text of each conversation in the selected members, or what is wrong with it."""
    return sources.select("path", "content").mapInArrow(_elements, ELEMENTS)


#: So many elements that can't be imported are shown.
MAX_SHOWN = 50


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Why each element can't be imported, or null, and the first invalid ones of each task."""
    from talktree.functions.values import load_json
    from talktree.operators.ingest import problem

    def judge(text: str | None, told: str | None) -> str | None:
        if told:
            return told
        try:
            found = problem(load_json(text))
        except (ValueError, RecursionError):
            return "invalid_json"
        return found[0] if found else None

    for batch in batches:
        source, index, text, told = (c.to_pylist() for c in batch.columns)
        yield pa.RecordBatch.from_arrays([pa.array(source, pa.string()), pa.array(index, pa.int64()), pa.array([judge(*x) for x in zip(text, told)], pa.string())], ["source_file", "array_index", "warning_type"])


def invalid_elements(elements: DataFrame) -> DataFrame:
    """``(source_file, array_index, warning_type)`` of elements that can't be imported; none of what they hold."""
    judged = elements.select("source_file", "array_index", "element", "problem").mapInArrow(_judged, "source_file string, array_index long, warning_type string")
    return judged.where("warning_type is not null")


def invalid_sample(elements: DataFrame, n: int = MAX_SHOWN) -> DataFrame:
    """The first ``n`` invalid elements by file and place, the same however the input is partitioned; each task hands on n at most."""
    return invalid_elements(elements).orderBy("source_file", "array_index", "warning_type").limit(n)


def duplicate_ids(elements: DataFrame) -> DataFrame:
    """``elements``, how many have an id, and how many of these repeat one."""
    ids = elements.select(F.coalesce(F.get_json_object("element", "$.id"), F.get_json_object("element", "$.conversation_id")).alias("id"))
    return ids.agg(F.count("*").alias("elements"), F.count("id").alias("with_id"), (F.count("id") - F.countDistinct("id")).alias("duplicate_ids"))


def inspect(listed: DataFrame, elements: DataFrame) -> dict[str, DataFrame]:
    """What an input holds: files by type, the first invalid elements, and how many elements and repeated ids there are."""
    return {
        "files": listed.groupBy("file_type").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")),
        "invalid": invalid_sample(elements),
        "elements": duplicate_ids(elements),
    }


def inspect_input(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``inspect`` of a ZIP, a JSON file or a folder, read by chunks where Python reaches it."""
    where = resolve_input(path)
    if not files.reachable(where):
        found = read_members(spark, where)
        return inspect(found, read_elements(selected_sources(found)))
    found = members.members(spark, where)
    chosen = [r.path for r in selected_sources(found.select("path")).collect()]  # a name for each conversation file
    return inspect(found, members.elements(spark, where, chosen))
