"""Snapshots of an archive, and imports into them.

A snapshot is a list of parts.  An import compares the incoming conversations with the stored ones and
writes one part, with whole rows of those that are new or changed; readers take each conversation from
the last part that has it.  Parts are Parquet folders that never change and belong to one attempt; the
list becomes the next snapshot by a rename that fails if another writer was first, so readers see either
snapshot whole and a loser harms nothing.  Small parts are merged from time to time, by tiers.

What searches derive is stored beside each part, so only new parts are ever indexed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from talktree.functions.text import is_generated_note
from talktree.operators import index
from talktree.operators.archive import Archive
from talktree.operators.ingest import parsed_once, split_parsed
from talktree.schema import CONVERSATIONS, FILE_INDEX, IMPORT_RUNS, NODES, SCHEMA_VERSION, SOURCE_FILES, TABLES, WARNINGS
from talktree.sources import files, members
from talktree.sources.exports import fingerprint, read_elements, read_members, resolve_input, selected_sources

_OWN = ("last_import_run_id", "display_revision")
#: Which stored fields belong to which domain of change.
DOMAINS = {"title": ("title",), "query": ("source_file", "create_time", "update_time"), "address": ("exported_id", "current_node"), "graph": ("current_node",)}
NODE_DOMAINS = {"message": ("content_text", "raw_message_json"), "address": ("message_id",), "graph": ("parent_node_id", "children_json", "is_on_current_path"), "query": ("role", "content_type", "create_time", "update_time")}


def differs(fields: list[str], old: str = "o", new: str = "n") -> Column:
    """Whether any field differs, null being equal to null."""
    out = F.lit(False)
    for f in fields:
        out = out | ~F.col(f"{old}.{f}").eqNullSafe(F.col(f"{new}.{f}"))
    return out


def _fields(schema) -> list[str]:
    return [f.name for f in schema if f.name not in _OWN]


def conversation_outcomes(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """``(conversation_id, outcome, domains)``: inserted, updated, unchanged, or kept if only stored."""
    fields = _fields(CONVERSATIONS)
    both = stored.alias("o").join(incoming.alias("n"), F.col("o.conversation_id") == F.col("n.conversation_id"), "full_outer")
    here, there = F.col("n.conversation_id").isNotNull(), F.col("o.conversation_id").isNotNull()
    outcome = F.when(~here, "kept").when(~there, "inserted").when(differs(fields), "updated").otherwise("unchanged")
    changed = F.array_compact(F.array(*(F.when(here & there & differs(list(f)), d) for d, f in DOMAINS.items())))
    return both.select(F.coalesce("n.conversation_id", "o.conversation_id").alias("conversation_id"), outcome.alias("outcome"), F.when(here & ~there, F.array(*map(F.lit, (*DOMAINS, "message")))).otherwise(changed).alias("domains"))


def node_changes(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """``(conversation_id, node_id, action, domains)`` for conversations that come in: add, delete, update or same."""
    ids = incoming.select("conversation_id").distinct()
    o, n = stored.join(ids, "conversation_id", "left_semi").alias("o"), incoming.alias("n")
    key = (F.col("o.conversation_id") == F.col("n.conversation_id")) & (F.col("o.node_id") == F.col("n.node_id"))
    here, there = F.col("n.node_id").isNotNull(), F.col("o.node_id").isNotNull()
    action = F.when(~here, "delete").when(~there, "add").when(differs(_fields(NODES)), "update").otherwise("same")
    domains = F.array_compact(F.array(*(F.when(differs(list(f)), d) for d, f in NODE_DOMAINS.items())))
    every = F.array(*map(F.lit, NODE_DOMAINS))
    return o.join(n, key, "full_outer").select(
        F.coalesce("n.conversation_id", "o.conversation_id").alias("conversation_id"), F.coalesce("n.node_id", "o.node_id").alias("node_id"), action.alias("action"), F.when(here & there, domains).otherwise(every).alias("domains")
    )


def merged(stored: DataFrame, incoming: DataFrame, outcomes: DataFrame, run: int) -> DataFrame:
    """Stored rows of conversations that stay as they are, and incoming rows of those that are new or changed."""
    changed = outcomes.where(F.col("outcome").isin("inserted", "updated")).select("conversation_id")
    new = incoming.join(changed, "conversation_id", "left_semi").withColumn("last_import_run_id", F.lit(run).cast("long"))
    return stored.join(changed, "conversation_id", "left_anti").unionByName(new.select(*stored.columns))


#: Tables whose rows belong to a conversation and are replaced with it; the others only grow.
KEYED = ("conversations", "nodes")
#: Keyed rows are dealt into folders by id, so that a few conversations are found in a few folders.
BUCKETS = 8
#: So many parts of like size are merged into one.
FANOUT = 4
#: Marks a part's index as whole; another name for another layout, so that an older index is built anew.
_READY = "ready-2"
_INDEX = ("nodes", "conversations", "paths", "postings")


class SnapshotConflict(RuntimeError):
    """Another writer has published the snapshot first."""


def _stored(name: str) -> StructType:
    """A table's columns as a part has them."""
    return StructType([*TABLES[name].fields, StructField("bucket", IntegerType())]) if name in KEYED else TABLES[name]


def bucket_of(conversation_id: str = "conversation_id") -> Column:
    return F.pmod(F.xxhash64(conversation_id), F.lit(BUCKETS)).cast("int")


class Store:
    """An archive's snapshots in a folder of any store that Spark writes to and that renames without overwriting."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._lists: dict[int, dict] = {}  # lists of parts, which never change

    def _path(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _delete(self, path: str) -> bool:
        fs, where = self._path(path)
        return fs.delete(where, True)

    def version(self) -> int:
        """Number of the current snapshot, 0 if there is none."""
        return max(self.versions(), default=0)

    def versions(self) -> list[int]:
        return sorted(int(n.removeprefix("snapshot-")) for n in self._names(self.folder) if n.startswith("snapshot-"))

    def _snapshot(self, version: int) -> str:
        return f"{self.folder}/snapshot-{version:06d}"

    def _list(self, version: int) -> dict:
        """A snapshot's list of parts.  A snapshot of another layout is an error."""
        if not version:
            return {"parts": {}, "generations": {}}
        if version not in self._lists:
            fs, folder = self._path(f"{self._snapshot(version)}/layout")
            text = ""
            for s in fs.listStatus(folder):
                if s.getPath().getName()[0] not in "_.":
                    stream = fs.open(s.getPath())
                    text += self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                    stream.close()
            found = json.loads(text)
            if found.get("schema_version") != SCHEMA_VERSION or "parts" not in found:
                raise ValueError("unsupported_schema_version")
            self._lists[version] = found
        return self._lists[version]

    def layout(self, version: int | None = None) -> int:
        """The layout number that a snapshot was written with."""
        return self._list(version or self.version())["schema_version"]

    def generations(self, version: int | None = None) -> dict[str, int]:
        """The snapshot at which each domain last changed; what depends on a domain holds while its number stays."""
        return dict(self._list(self.version() if version is None else version)["generations"])

    def _read(self, part: dict, name: str, schema=None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        rows = reader.parquet(f"{self.folder}/data/{part['id']}/{name}")
        return index.unpacked(rows) if name == "index/postings" else rows

    def _latest(self, parts: list[dict], name: str, schema=None) -> DataFrame:
        """Rows of the last part that has their conversation; only the ids of later parts are joined."""
        tagged = [self._read(p, name, schema).withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
        rows = reduce(DataFrame.unionByName, tagged)
        if len(parts) == 1:
            return rows.drop("_part")
        ids = [self._read(p, "conversations", CONVERSATIONS).select("conversation_id", F.lit(i).alias("_last")) for i, p in enumerate(parts) if i]
        last = reduce(DataFrame.union, ids).groupBy("conversation_id").agg(F.max("_last").alias("_last"))
        return rows.join(last, "conversation_id", "left").where(F.col("_part") == F.coalesce("_last", F.lit(0))).drop("_part", "_last")

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table of a snapshot; empty in an empty store."""
        return self._table(name, version).select(*TABLES[name].names)

    def _table(self, name: str, version: int | None = None) -> DataFrame:
        """A table with its bucket column, if it has one."""
        parts = self._list(self.version() if version is None else version)["parts"].get(name, [])
        schema = _stored(name)
        if not parts:
            return self.spark.createDataFrame([], schema)
        if name in KEYED:
            return self._latest(parts, name, schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/data/{p['id']}/{name}" for p in parts))

    def archive(self, version: int | None = None) -> Archive:
        version = self.version() if version is None else version
        return Archive(self.table("conversations", version), self.table("nodes", version))

    def _write_part(self, tables: dict[str, DataFrame]) -> dict:
        """Writes the tables of one part to a folder of its own."""
        part = uuid.uuid4().hex
        for name, rows in tables.items():
            rows = rows.select(*TABLES[name].names)
            where = f"{self.folder}/data/{part}/{name}"
            if name in KEYED:
                rows = rows.withColumn("bucket", bucket_of()).repartition("bucket", "conversation_id").sortWithinPartitions("bucket", "conversation_id")
                rows.write.partitionBy("bucket").parquet(where)
            else:
                rows.coalesce(1).write.parquet(where)  # notes of one run
        rows = self._read({"id": part}, "conversations", CONVERSATIONS).count() if "conversations" in tables else 0
        return {"id": part, "rows": rows, "tables": sorted(tables)}

    def _commit(self, base: int, parts: dict[str, list[dict]], domains: list[str]) -> int:
        """Publishes the list of parts as the snapshot after ``base``, or raises SnapshotConflict."""
        version = base + 1
        generations = self._list(base)["generations"] | {d: version for d in domains}
        found = {"schema_version": SCHEMA_VERSION, "version": version, "parts": parts, "generations": generations}
        attempt = f"{self.folder}/attempts/{uuid.uuid4().hex}"
        fs, where = self._path(f"{attempt}/layout/list.json")
        out = fs.create(where, False)
        out.write(json.dumps(found).encode())
        out.close()
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        source, goal = self._path(attempt)[1], self._path(self._snapshot(version))[1]
        try:
            if fs.exists(goal):
                raise SnapshotConflict("snapshot_already_published")
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(goal).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(source, goal, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
            # where another writer's snapshot came in between, a local store copies into it and doesn't fail
            if fs.delete(jvm.org.apache.hadoop.fs.Path(goal, source.getName()), True):
                raise SnapshotConflict("snapshot_already_published")
        except Py4JJavaError as e:
            if not fs.exists(goal):
                raise
            raise SnapshotConflict("snapshot_already_published") from e
        finally:
            self._delete(attempt)
        return version

    @contextmanager
    def _kept_if_published(self, part: dict) -> Iterator[None]:
        """Deletes a part's folder if what follows fails."""
        try:
            yield
        except BaseException:
            self._delete(f"{self.folder}/data/{part['id']}")
            raise

    def publish(self, tables: dict[str, DataFrame], base: int | None = None, domains: tuple[str, ...] = ()) -> int:
        """Writes a part with rows of some tables and publishes it after snapshot ``base``.

        Keyed tables take whole conversations, rows and nodes, which replace those of the same ids.
        """
        base = self.version() if base is None else base
        if any(n in tables for n in KEYED) and not all(n in tables for n in KEYED):
            raise ValueError("conversations_need_their_nodes")
        part = self._write_part(tables)
        with self._kept_if_published(part):
            parts = {n: list(p) for n, p in self._list(base)["parts"].items()}
            for name in part["tables"]:
                if name not in KEYED or part["rows"]:
                    parts.setdefault(name, []).append({"id": part["id"], "rows": part["rows"]})
            return self._commit(base, parts, list(domains))

    def append(self, name: str, rows: DataFrame) -> int:
        """Publishes a snapshot with rows added to one table, such as the export log; what others publish meanwhile stays."""
        if name in KEYED:
            raise ValueError("conversations_are_imported")
        part = self._write_part({name: rows})
        with self._kept_if_published(part):
            while True:
                base = self.version()
                parts = {n: list(p) for n, p in self._list(base)["parts"].items()}
                parts.setdefault(name, []).append({"id": part["id"], "rows": 0})
                try:
                    return self._commit(base, parts, [])
                except SnapshotConflict:
                    continue

    def compact(self) -> int:
        """Merges the newest parts while they are together large beside the one before; returns the current version.

        A row is rewritten about once each time the archive grows ``FANOUT``-fold.  Tables read the same before and after.
        """
        base = self.version()
        parts = {n: list(p) for n, p in self._list(base)["parts"].items()}
        keyed = parts.get("conversations", [])
        take = mergeable([p["rows"] for p in keyed])
        long = [n for n, p in parts.items() if n not in KEYED and len(p) >= FANOUT * FANOUT]
        if not take and not long:
            return base
        tables = {n: self._latest(keyed[len(keyed) - take :], n, _stored(n)) for n in KEYED} if take else {}
        tables |= {n: self._table(n, base) for n in long}
        part = self._write_part(tables)
        with self._kept_if_published(part):
            for n in KEYED if take else ():
                parts[n] = [*parts[n][: len(keyed) - take], {"id": part["id"], "rows": part["rows"]}]
            for n in long:
                parts[n] = [{"id": part["id"], "rows": 0}]
            return self._commit(base, parts, [])

    def vacuum(self, keep: int = 10) -> int:
        """Deletes snapshots but the last ``keep``, and tables of parts that none of these lists; returns how many tables went.

        A writer at work has parts that nothing lists yet, so this needs a time without one.
        """
        versions = self.versions()
        used = {(p["id"], n) for v in versions[-keep:] for n, ps in self._list(v)["parts"].items() for p in ps}
        used |= {(part, "index") for part, n in used if n == "nodes"}
        for v in versions[:-keep]:
            self._delete(self._snapshot(v))
        return sum(self._delete(f"{self.folder}/data/{part}/{n}") for part in self._names(f"{self.folder}/data") for n in self._names(f"{self.folder}/data/{part}") if (part, n) not in used)

    def _names(self, path: str) -> list[str]:
        fs, folder = self._path(path)
        return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []

    def import_elements(self, elements: DataFrame, sources: DataFrame | None = None, input_path: str = "", input_sha: str | None = None, attempts: int = 3) -> dict:
        """Imports (source_file, array_index, element) rows; returns counts by outcome and the domains that changed.

        Elements are parsed once.  If another writer publishes meanwhile, they are compared anew with what it left,
        ``attempts`` times in all, and then SnapshotConflict is raised.
        """
        staged = f"{self.folder}/attempts/{uuid.uuid4().hex}"
        try:
            parsed = parsed_once(elements, staged)
            for left in reversed(range(attempts)):
                try:
                    out = self._import_parsed(parsed, sources, input_path, input_sha)
                    break
                except SnapshotConflict:
                    if not left:
                        raise
        finally:
            self._delete(staged)
        self.compact()
        return out

    def _import_parsed(self, parsed: DataFrame, sources: DataFrame | None, input_path: str, input_sha: str | None) -> dict:
        base = self.version()
        got = split_parsed(parsed)
        compared = f"{self.folder}/attempts/{uuid.uuid4().hex}"
        try:
            self._compared(got, base).write.parquet(compared)  # small rows that all of what follows asks for
            return self._import_compared(got, self.spark.read.parquet(compared), sources, base, input_path, input_sha)
        finally:
            self._delete(compared)

    def _compared(self, got: dict[str, DataFrame], base: int) -> DataFrame:
        """``(conversation_id, outcome, domains)`` of an import after snapshot ``base``, nodes included."""
        every = sorted({*DOMAINS, *NODE_DOMAINS})
        if not self._list(base)["parts"].get("conversations"):  # nothing to compare with
            return got["conversations"].select("conversation_id", F.lit("inserted").alias("outcome"), F.array(*map(F.lit, every)).alias("domains"))
        stored = {n: self._table(n, base) for n in KEYED}
        outcomes = conversation_outcomes(stored["conversations"], got["conversations"])
        # the few buckets that come in are found when the query runs, and the others are not read
        near = got["conversations"].select(bucket_of().alias("bucket")).distinct()
        changes = node_changes(stored["nodes"].join(F.broadcast(near), "bucket", "left_semi").drop("bucket"), got["nodes"]).where("action <> 'same'")
        touched = F.array_compact(F.array(*(F.max(F.when(F.array_contains("domains", d), d)) for d in NODE_DOMAINS)))
        moved = changes.groupBy("conversation_id").agg(touched.alias("_moved"))
        outcome = F.when((F.col("outcome") == "unchanged") & F.col("_moved").isNotNull(), "updated").otherwise(F.col("outcome"))
        none = F.array().cast("array<string>")
        return outcomes.join(moved, "conversation_id", "left").select("conversation_id", outcome.alias("outcome"), F.array_union("domains", F.coalesce("_moved", none)).alias("domains"))

    def _import_compared(self, got: dict[str, DataFrame], outcomes: DataFrame, sources: DataFrame | None, base: int, input_path: str, input_sha: str | None) -> dict:
        run = base + 1
        now = datetime.now(timezone.utc).isoformat(timespec="seconds")
        notes = got["import_warnings"].select(F.lit(run).cast("long").alias("import_run_id"), "source_file", "array_index", "warning_type", "keys_json", "raw_json", F.lit(now).alias("created_at"))
        summary = {r.outcome: r["count"] for r in outcomes.groupBy("outcome").count().collect()}
        domains = sorted(r.d for r in outcomes.select(F.explode("domains").alias("d")).distinct().collect())
        new = outcomes.where(F.col("outcome").isin("inserted", "updated")).select("conversation_id")
        taken = (lambda rows: rows.join(new, "conversation_id", "left_semi")) if "unchanged" in summary else lambda rows: rows
        tables = {n: taken(got[n]).withColumn("last_import_run_id", F.lit(run).cast("long")) for n in KEYED} if {"inserted", "updated"} & set(summary) else {}
        tables["import_warnings"] = notes.select(*WARNINGS.names)
        tables["import_runs"] = self.spark.createDataFrame([(run, input_path, "elements", input_sha, None, now, now, "ok", json.dumps(summary, sort_keys=True))], IMPORT_RUNS)
        if sources is not None:
            tables["source_files"] = sources.select(F.lit(run).cast("long").alias("import_run_id"), *SOURCE_FILES.names[1:])
            tables["file_index"] = _file_rows(sources, run)
        self.publish(tables, base, tuple(domains))
        return {"run": run, "outcomes": summary, "dirty_domains": domains}

    def import_path(self, path: str) -> dict:
        """Imports a ZIP, a JSON file or a folder.

        Members are read side by side by executors, in chunks.  An input in a store that only Spark's own
        readers reach is opened whole by one task for each file.
        """
        where = resolve_input(path)
        streamed = files.reachable(where)
        staged = f"{self.folder}/attempts/{uuid.uuid4().hex}"
        try:
            found = members.members(self.spark, where) if streamed else read_members(self.spark, where).select(F.lit(None).cast("string").alias("archive"), "path", "size", "sha256", "file_type")
            found.write.parquet(staged)
            found = self.spark.read.parquet(staged)
            picked = selected_sources(found.select("path")).select("path")
            chosen = [r.path for r in picked.collect()]  # a name for each conversation file
            is_json = F.lower("path").rlike(r"conversations(-[0-9]+)?\.json$")
            marked = found.join(picked.distinct().withColumn("_picked", F.lit(True)), "path", "left")
            sources = marked.select(F.col("path").alias("source_path"), "file_type", "size", "sha256", is_json.alias("is_conversation_json"), F.coalesce("_picked", F.lit(False)).alias("is_selected_conversation_source"))
            if streamed:
                elements = members.elements(self.spark, where, chosen)
                whole = members.input_files(self.spark, where) if found.where("archive is not null").limit(1).count() else found.select("path", "sha256", "size")
            else:
                elements, whole = read_elements(selected_sources(read_members(self.spark, where))), fingerprint(self.spark, where)
            sha = input_sha256(whole)
            return self.import_elements(elements, sources, path, sha) | {"input_sha256": sha}
        finally:
            self._delete(staged)

    def build_index(self, version: int | None = None) -> str:
        """Writes what searches derive from a snapshot: texts and their normal forms, titles, paths and postings.

        Each part has an index of its own, published by a marker; parts that have one are left alone, so after
        an import only what it brought is indexed.
        """
        version = self.version() if version is None else version
        for part in self._list(version)["parts"].get("conversations", []):
            if not self._has_index(part):
                self._index_part(part)
        return f"{self.folder}/data"

    def _index_part(self, part: dict) -> None:
        folder = f"{self.folder}/data/{part['id']}/index"
        archive = Archive(self._read(part, "conversations", CONVERSATIONS), self._read(part, "nodes", NODES))
        nodes = archive.texts.withColumn("generated", is_generated_note(F.col("content_type"), F.col("text"))).repartition("conversation_id").sortWithinPartitions("conversation_id", "node_id")
        nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
        archive.titled.write.mode("overwrite").parquet(f"{folder}/conversations")
        archive.paths.write.mode("overwrite").parquet(f"{folder}/paths")
        stored = Archive(self.spark.read.parquet(f"{folder}/conversations"), self.spark.read.parquet(f"{folder}/nodes"), complete=True)
        index.write(stored, f"{folder}/postings")
        index.lengths(stored).write.mode("overwrite").parquet(f"{folder}/lengths")
        fs, mark = self._path(f"{folder}/{_READY}")
        if not fs.exists(mark):
            fs.create(mark, False).close()

    def _has_index(self, part: dict) -> bool:
        fs, mark = self._path(f"{self.folder}/data/{part['id']}/index/{_READY}")
        return fs.exists(mark)

    def has_index(self, version: int | None = None) -> bool:
        """Whether every part of the snapshot has its index."""
        parts = self._list(self.version() if version is None else version)["parts"].get("conversations", [])
        return bool(parts) and all(self._has_index(p) for p in parts)

    def indexed(self, version: int | None = None) -> tuple[Archive, DataFrame | None]:
        """The archive with stored derived columns and paths, and its postings; without an index, the plain archive."""
        version = self.version() if version is None else version
        if not version or not self.has_index(version):
            return self.archive(version), None
        parts = self._list(version)["parts"]["conversations"]
        nodes, conversations, paths, postings = (self._latest(parts, f"index/{name}") for name in _INDEX)
        return Archive(conversations, nodes, paths, complete=True), postings

    def lengths(self, version: int | None = None) -> DataFrame:
        """How many messages and stretches each conversation of an indexed snapshot has, for scores from postings."""
        return self._latest(self._list(self.version() if version is None else version)["parts"]["conversations"], "index/lengths")


def mergeable(rows: list[int]) -> int:
    """How many of the newest parts to merge, given each part's rows from the oldest; 0 for none.

    From the newest back, parts are taken while they hold no more than ``FANOUT`` times what is taken already.
    """
    take, held = 0, 0
    for n in reversed(rows):
        if take and n > FANOUT * max(held, 1):
            break
        take, held = take + 1, held + n
    return take if take >= FANOUT else 0


def input_sha256(files: DataFrame) -> str | None:
    """One hash for an input of (path, sha256, size) files: that of its only file, else of all contents.

    Names don't count.  Hashes are hashed by their first three digits and then once more, so no list holds them all.
    """
    whole = lambda hashes: F.sha2(F.array_join(F.sort_array(F.collect_list(hashes)), "\n"), 256)
    groups = files.groupBy(F.substring("sha256", 1, 3)).agg(F.count("*").alias("n"), F.min("sha256").alias("one"), whole(F.col("sha256")).alias("many"))
    row = groups.agg(F.sum("n").alias("n"), F.min("one").alias("one"), whole(F.col("many")).alias("many")).first()
    return row.many if (row.n or 0) > 1 else row.one


def _file_rows(sources: DataFrame, run: int) -> DataFrame:
    path = F.col("source_path")
    return sources.select(
        F.lit(run).cast("long").alias("import_run_id"), "source_path", "file_type", F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1)).alias("extension"), "size", "sha256",
        F.lit(None).cast("string").alias("related_conversation_id"), F.lit(None).cast("string").alias("related_message_id"),
    ).select(*FILE_INDEX.names)
