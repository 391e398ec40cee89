"""Conversation elements to typed rows: validation, flattening, hashes and warnings."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talktree.functions.batches import bounded_batches
from talktree.functions.text import clean, message_content
from talktree.functions.values import canonical_id, canonical_json, id_text, load_json, sha256, to_flag, to_time
from talktree.schema import CONVERSATIONS, MAX_ID_CHARS, MAX_NODES, NODES, WARNINGS

#: Fields of a conversation that are kept as metadata.
METADATA_FIELDS = (
    "async_status", "atlas_mode_enabled", "context_scopes", "conversation_origin", "conversation_template_id", "disabled_tool_ids",
    "gizmo_type", "is_do_not_remember", "memory_scope", "moderation_results", "voice",
)

PARSED = "kind string, row string, conversation_id string, source_file string, array_index long"


class Warnings(list):
    """Warnings of one element: (type, keys, raw); they never hold content."""

    def note(self, kind: str, keys: Any = None, raw: Any = None) -> None:
        self.append((kind, None if keys is None else canonical_json(keys), None if raw is None else canonical_json(raw)))

    def shown(self, value: Any, field: str) -> str | None:
        """A scalar as text that can be shown."""
        if value is None:
            return None
        text = value if isinstance(value, str) else str(value)
        if clean(text) != text:
            self.note("unicode_text_normalized", {"field": field, "nul": "\0" in text})
        return clean(text)

    def time(self, value: Any, field: str) -> float | None:
        number, bad = to_time(value)
        if bad:
            self.note(bad, {"field": field, "value_type": type(value).__name__})
        return number


def _graph_ids(value: dict) -> Iterator[tuple[str, Any, bool]]:
    """Every id that is stored: (field, value, whether blanks around it are cut off)."""
    yield "id", value.get("id"), True
    yield "conversation_id", value.get("conversation_id"), True
    yield "current_node", value.get("current_node"), False
    for key, node in value["mapping"].items():
        yield "mapping_node_key", key, False
        if isinstance(node, dict):
            yield "node_id", node.get("id"), False
            yield "parent", node.get("parent"), False
            for child in node["children"] if isinstance(node.get("children"), list) else ():
                yield "children", child, False
            if isinstance(node.get("message"), dict):
                yield "message_id", node["message"].get("id"), False


def problem(value: Any) -> tuple[str, Any, Any] | None:
    """Why an element can't be imported: a warning's type, keys and raw part."""
    kind = lambda x: type(x).__name__
    if not isinstance(value, dict):
        return "invalid_element_type", None, {"type": kind(value)}
    keys = sorted(value)
    if conversation_id_of(value) is None:
        found = "id" in value or "conversation_id" in value
        types = {f"{f}_type": kind(value[f]) if f in value else "missing" for f in ("id", "conversation_id")}
        return "invalid_conversation_id" if found else "missing_id", keys, types
    if "mapping" not in value:
        return "missing_mapping", keys, None
    mapping = value["mapping"]
    if not isinstance(mapping, dict):
        return "invalid_mapping_type", keys, {"id_type": kind(value.get("id")), "mapping_type": kind(mapping)}
    if not mapping:
        return "empty_mapping", keys, None
    if len(mapping) > MAX_NODES:
        return "conversation_node_limit_exceeded", {"limit": MAX_NODES}, None
    for field, given, strip in _graph_ids(value):
        text = id_text(given, strip)
        if text is None:
            continue
        if not text and field != "parent":
            return "canonical_id_empty", {"field": field, "length": 0, "value_type": kind(given)}, None
        if len(text) > MAX_ID_CHARS:
            return "canonical_id_too_long", {"field": field, "length": len(text), "limit": MAX_ID_CHARS, "value_type": kind(given)}, None
        if text and canonical_id(given, strip) is None:
            return "canonical_id_invalid_unicode", {"field": field, "length": len(text)}, None
    return None


def conversation_id_of(value: dict) -> str | None:
    return canonical_id(value.get("id"), True) or canonical_id(value.get("conversation_id"), True)


def raw_path(mapping: dict, current: str | None, notes: Warnings) -> set[str]:
    """Nodes from the current one to its root as exported."""
    seen: dict[str, None] = {}
    if current and current not in mapping:
        notes.note("current_node_missing", [current])
        return set()
    node = current
    while node:
        if node in seen:
            notes.note("parent_cycle", [*seen, node])
            break
        entry = mapping[node]
        if not isinstance(entry, dict):
            notes.note("current_path_invalid_node", [node])
            break
        seen[node] = None
        above = entry.get("parent")
        parent = canonical_id(above)
        if above is None or above == "":
            break
        if parent is None:
            notes.note("parent_invalid", [node])
            break
        if parent not in mapping:
            notes.note("parent_missing", [node, parent])
            break
        node = parent
    return set(seen)


def _node(cid: str, key: str, node: dict, on_path: set[str], notes: Warnings) -> tuple[dict, dict]:
    """A node's row, and what of it goes into the conversation's hash."""
    message = node.get("message") if isinstance(node.get("message"), dict) else None
    author = message.get("author") if message and isinstance(message.get("author"), dict) else {}
    kind, text, found = message_content(message)
    kind = notes.shown(kind, "content_type")
    text = notes.shown(text, "content_text") or ""
    times = message if message is not None else node
    children = node["children"] if isinstance(node.get("children"), list) else []
    metadata = {"node_metadata": node.get("metadata") if isinstance(node.get("metadata"), dict) else None, "message_metadata": message.get("metadata") if message else None, "content_notes": found}
    row = {
        "conversation_id": cid, "node_id": key, "parent_node_id": canonical_id(node.get("parent")), "children_json": canonical_json(children),
        "message_id": canonical_id(message.get("id")) if message else None, "role": notes.shown(author.get("role"), "role"), "author_name": notes.shown(author.get("name"), "author_name"),
        "create_time": notes.time(times.get("create_time"), "node_create_time"), "update_time": notes.time(times.get("update_time"), "node_update_time"),
        "content_type": kind, "content_text": text, "content_hash": sha256(canonical_json({"content_type": kind, "content_text": text})), "metadata_json": canonical_json(metadata),
        "is_on_current_path": int(key in on_path), "raw_message_json": None if message is None else canonical_json(message), "last_import_run_id": None,
    }
    row["display_revision"] = sha256(canonical_json([text, row["raw_message_json"]]))
    core = {k: v for k, v in row.items() if k not in ("conversation_id", "last_import_run_id", "display_revision")}
    return row, core


def parse_element(text: str, source: str, index: int) -> tuple[dict | None, list[dict], Warnings]:
    """One element's conversation row, node rows and warnings; no rows if it can't be imported."""
    notes = Warnings()
    try:
        value = load_json(text)
    except (ValueError, RecursionError):
        notes.note("invalid_json", None, {"length": len(text)})
        return None, [], notes
    if bad := problem(value):
        notes.note(*bad)
        return None, [], notes
    cid, mapping, current = conversation_id_of(value), value["mapping"], canonical_id(value.get("current_node"))
    title = value.get("title")
    if isinstance(title, (list, dict)):
        notes.note("invalid_title_type", {"title_type": type(title).__name__})
        title = None
    title = notes.shown(title, "title")
    on_path = raw_path(mapping, current, notes)
    nodes, core = [], []
    for key, node in mapping.items():
        if not isinstance(node, dict):
            notes.note("invalid_node_type", [key], {"node_id": key, "type": type(node).__name__})
            continue
        row, part = _node(cid, key, node, on_path, notes)
        nodes.append(row)
        core.append(part)
    conversation = {
        "conversation_id": cid, "exported_id": canonical_id(value.get("conversation_id"), True), "title": title,
        "create_time": notes.time(value.get("create_time"), "conversation_create_time"), "update_time": notes.time(value.get("update_time"), "conversation_update_time"),
        "current_node": current, "source_file": source, "source_array_index": index,
        "aggregate_hash": sha256(canonical_json({"current_node": current, "nodes": sorted(core, key=lambda n: n["node_id"])})), "last_import_run_id": None,
        "is_archived": to_flag(value.get("is_archived")), "is_starred": to_flag(value.get("is_starred")), "default_model_slug": notes.shown(value.get("default_model_slug"), "default_model_slug"),
        "metadata_json": canonical_json({k: value[k] for k in METADATA_FIELDS if k in value}),
    }
    return conversation, nodes, notes


#: Rows that are handed on at once: so many, or so many characters of them.
_ROWS, _CHARS = 1024, 1 << 20


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for batch in batches:
        for source, index, text, problem in zip(*batch.columns):
            source, index, problem = source.as_py(), index.as_py(), problem.as_py()
            conversation, nodes, notes = parse_element(text.as_py(), source, index) if problem is None else (None, [], Warnings([(problem, None, None)]))
            cid = None if conversation is None else conversation["conversation_id"]
            found = [("warning", {"source_file": source, "array_index": index, "warning_type": k, "keys_json": a, "raw_json": b}) for k, a, b in notes]
            if conversation is not None:
                found += [("conversation", conversation), *(("node", n) for n in nodes)]
            for kind, row in found:
                rows.append((kind, canonical_json(row), cid, source, index))
                held += len(rows[-1][1])
                if len(rows) >= _ROWS or held >= _CHARS:
                    yield _parsed(rows)
                    rows, held = [], 0
    if rows:
        yield _parsed(rows)


def _parsed(rows: list[tuple]) -> pa.RecordBatch:
    *texts, index = zip(*rows)
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in texts), pa.array(index, pa.int64())], ["kind", "row", "conversation_id", "source_file", "array_index"])


def parse_elements(elements: DataFrame) -> DataFrame:
    """Tagged rows of all elements: warnings, conversations and nodes as JSON, to be kept once and split.

    A source may say in a column ``problem`` why it has no element at a place; that becomes a warning.
    """
    bounded_batches(elements.sparkSession)
    problem = F.col("problem") if "problem" in elements.columns else F.lit(None).cast("string").alias("problem")
    return elements.select("source_file", "array_index", "element", problem).mapInArrow(_parse, PARSED)


def parsed_once(elements: DataFrame, folder: str) -> DataFrame:
    """``parse_elements``, kept in a new folder, so that what is split from it is parsed once."""
    parse_elements(elements).write.parquet(folder)
    return elements.sparkSession.read.parquet(folder)


def _typed(parsed: DataFrame, kind: str, schema) -> DataFrame:
    return parsed.where(F.col("kind") == kind).select(F.from_json("row", schema).alias("r"), "source_file", "array_index")


def shard_number(source: str = "source_file"):
    return F.coalesce(F.expr(f"try_cast(nullif(regexp_extract({source}, '-([0-9]+)[.]json$', 1), '') as bigint)"), F.lit(-1))


def split_parsed(parsed: DataFrame) -> dict[str, DataFrame]:
    """conversations, nodes and warnings of parsed elements; of a repeated id the last occurrence wins.

    Each earlier occurrence gives a ``duplicate_conversation_id`` warning.
    """
    order = Window.partitionBy("conversation_id").orderBy(F.desc("_shard"), F.desc("source_file"), F.desc("array_index"))
    seen = parsed.where("kind = 'conversation'").select("conversation_id", "source_file", "array_index", shard_number().alias("_shard")).withColumn("_n", F.row_number().over(order))
    last = seen.where("_n = 1").select("conversation_id", "source_file", "array_index")
    keep = parsed.join(last, ["conversation_id", "source_file", "array_index"], "left_semi")
    extra = seen.where("_n > 1").select("source_file", "array_index", F.lit("duplicate_conversation_id").alias("warning_type"), F.lit(None).cast("string").alias("keys_json"), F.lit(None).cast("string").alias("raw_json"))
    notes = _typed(parsed, "warning", WARNINGS).select("r.source_file", "r.array_index", "r.warning_type", "r.keys_json", "r.raw_json")
    return {"conversations": _typed(keep, "conversation", CONVERSATIONS).select("r.*"), "nodes": _typed(keep, "node", NODES).select("r.*"), "import_warnings": notes.unionByName(extra)}


