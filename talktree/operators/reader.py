"""Reading one conversation: its messages page by page, counts, display chunks and copies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talktree.functions.text import RAW_LIMIT, contains, highlight_column, is_empty_node, is_generated_note, is_internal
from talktree.functions.values import canonical_json, load_json
from talktree.operators.archive import Archive
from talktree.operators.search import MAX_MESSAGES, _without_excluded, reading_keys
from talktree.plans.predicates import conversation_time, every, excluded, has_role, in_dates, in_source, positive
from talktree.plans.query import Query

_NODE = ["conversation_id", "node_id"]
PREVIEW = 20_000


def visible() -> Column:
    """Messages of the talk itself."""
    return ~empty() & ~internal()


def empty() -> Column:
    return is_empty_node(F.col("message_id"), F.col("content_text"), F.col("raw_message_json"))


def internal() -> Column:
    return is_internal(F.col("role"), F.col("content_type"), F.col("content_text"))


def node_counts(archive: Archive) -> DataFrame:
    """``(conversation_id, node_count, current_path_nodes)``; the second counts flags as stored."""
    flagged = F.sum(F.when(F.col("is_on_current_path") == 1, 1).otherwise(0))
    counts = archive.nodes.groupBy("conversation_id").agg(F.count("*").alias("node_count"), flagged.alias("current_path_nodes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return archive.conversations.select("conversation_id").join(counts, "conversation_id", "left").select("conversation_id", zero("node_count"), zero("current_path_nodes"))


def get_conversation(archive: Archive, conversation_id: str) -> DataFrame:
    """One conversation with its counts and path metadata; no row if there is none."""
    only = Archive(archive.conversations.where(F.col("conversation_id") == conversation_id), archive.nodes.where(F.col("conversation_id") == conversation_id))
    return only.conversations.join(only.meta, "conversation_id")


def of_conversation(archive: Archive, conversation_id: str, path: str = "current") -> DataFrame:
    """The nodes of a conversation on a path, with ``_index`` from 0 in reading order."""
    nodes = archive.texts.where(F.col("conversation_id") == conversation_id)
    if path == "current":
        one = Archive(archive.conversations.where(F.col("conversation_id") == conversation_id), archive.nodes.where(F.col("conversation_id") == conversation_id))
        return nodes.join(one.paths.select(*_NODE, F.col("position").alias("_index"), F.col("source").alias("_source")), _NODE)
    order = Window.partitionBy("conversation_id").orderBy(*reading_keys())
    return nodes.withColumns({"_index": F.row_number().over(order) - 1, "_source": F.lit("all")})


def visibility_counts(archive: Archive, path: str = "all") -> DataFrame:
    """Per conversation: all nodes, those hidden as empty or internal, and the visible rest."""
    nodes = archive.nodes
    if path == "current":
        nodes = nodes.join(archive.paths.select(*_NODE), _NODE, "left_semi")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    inner = ~empty() & internal()
    return nodes.groupBy("conversation_id").agg(F.count("*").alias("total"), count(visible()).alias("visible_total"), count(empty()).alias("empty_hidden_count"), count(inner).alias("internal_hidden_count"))


def _reading(archive: Archive, conversation_id: str, path: str, include_internal: bool) -> DataFrame:
    rows = of_conversation(archive, conversation_id, path)
    if not include_internal:
        rows = rows.where(visible())
    order = Window.partitionBy("conversation_id").orderBy("_index")
    return rows.withColumn("page_index", F.row_number().over(order) - 1)


def highlight_rows(archive: Archive, q: Query, path: str) -> DataFrame:
    """``(conversation_id, node_id)`` of the messages whose matches a reader marks."""
    if not q.has_body or q.scope == "title":
        return archive.nodes.where(F.lit(False)).select(*_NODE)
    conv = archive.titled.select("conversation_id", "title_norm", "source_norm", conversation_time().alias("_time"))
    rows = _without_excluded(archive.texts.join(conv, "conversation_id"), archive, q)
    titles = every(contains(F.col("title_norm"), t, q.match_mode) for t in (q.title, q.required_title) if t)
    norm = F.col("norm")
    required = every(contains(norm, f, q.match_mode) for f in q.required_phrases if f)
    fit = has_role(q, F.col("role")) & in_source(q, F.col("source_norm")) & in_dates(q, F.col("_time")) & titles & positive(q, norm) & required & ~excluded(q, norm)
    rows = rows.where(fit & (F.col("text") != "") & ~is_generated_note(F.col("content_type"), F.col("text")))
    if q.path == "current" and path == "all":
        rows = rows.join(archive.paths.select(*_NODE), _NODE, "left_semi")
    return rows.select(*_NODE)


def get_messages(archive: Archive, conversation_id: str, path: str = "current", limit: int = 50, offset: int = 0, include_internal: bool = True, around: str | None = None, q: Query | None = None) -> DataFrame:
    """A page of a conversation's messages in reading order, with highlights of a query's terms.

    ``around`` moves the page to a node: it begins there, or earlier so that it is full.
    """
    limit = max(1, min(MAX_MESSAGES, limit))
    rows = _reading(archive, conversation_id, path, include_internal)
    if around is not None:
        at = rows.agg(F.max(F.when(F.col("node_id") == around, F.col("page_index"))).alias("at"), F.count("*").alias("total"))
        first = F.coalesce(F.greatest(F.lit(0), F.least(F.col("at"), F.col("total") - limit)), F.lit(0))
        rows = rows.join(F.broadcast(at.select(first.alias("_first"))), F.col("page_index").between(F.col("_first"), F.col("_first") + limit - 1)).drop("_first")
    else:
        rows = rows.where(F.col("page_index").between(offset, offset + limit - 1))
    if q is not None:
        one = Archive(archive.conversations.where(F.col("conversation_id") == conversation_id), archive.nodes.where(F.col("conversation_id") == conversation_id))
        marked = highlight_rows(one, q, path).select(*_NODE, F.lit(True).alias("_marked"))
        rows = rows.join(marked, _NODE, "left")
        text = F.when(F.col("_marked"), F.col("text")).otherwise(F.lit(""))
        rows = rows.withColumn("highlight_ranges", highlight_column(text, q.highlight_terms, q.match_mode)).drop("_marked")
    return rows.withColumn("is_internal", internal()).orderBy("page_index")


def around_target(archive: Archive, conversation_id: str, node_id: str, path: str = "current", include_internal: bool = True) -> DataFrame:
    """One row: whether a node is there, on the path, in the asked collection, and visible in it."""
    one = Archive(archive.conversations.where(F.col("conversation_id") == conversation_id), archive.nodes.where(F.col("conversation_id") == conversation_id))
    node = one.nodes.where(F.col("node_id") == node_id).select(*_NODE, visible().alias("_visible"))
    node = node.join(one.paths.select(*_NODE, F.lit(True).alias("_on")), _NODE, "left")
    on = F.coalesce(F.max("_on"), F.lit(False))
    row = node.agg((F.count("*") > 0).alias("found"), on.alias("in_effective_collection"), F.coalesce(F.max("_visible"), F.lit(False)).alias("_visible"))
    asked = F.col("found") & (F.lit(path == "all") | F.col("in_effective_collection"))
    return row.select("found", "in_effective_collection", asked.alias("in_requested_collection"), (asked & (F.lit(include_internal) | F.col("_visible"))).alias("visible"))


def display_chunk(archive: Archive, conversation_id: str, node_id: str, offset: int = 0, limit: int = 65_536) -> DataFrame:
    """A stretch of one message's text by characters, with the whole length and a revision that changes with it."""
    text = F.col("text")
    rows = archive.texts.where((F.col("conversation_id") == conversation_id) & (F.col("node_id") == node_id))
    end = F.least(F.length(text), F.lit(offset + limit))
    return rows.select(
        *_NODE, F.substring(text, offset + 1, limit).alias("chunk"), F.length(text).alias("total_chars"), (end < F.length(text)).alias("has_more"), F.when(end < F.length(text), end).alias("next_offset"), F.sha2(text, 256).alias("revision")
    )


@F.pandas_udf(T.StringType())
def _without_metadata(raw: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        if text is None or len(text) > RAW_LIMIT:
            return text
        try:
            value = load_json(text)
        except (ValueError, RecursionError):
            return text
        if isinstance(value, dict):
            value.pop("metadata", None)
        return canonical_json(value)

    return raw.map(one)


def raw_preview(archive: Archive, conversation_id: str, node_id: str, limit: int = PREVIEW) -> DataFrame:
    """The beginning of a stored raw message without its metadata, and whether that is all."""
    rows = archive.nodes.where((F.col("conversation_id") == conversation_id) & (F.col("node_id") == node_id))
    shown = F.coalesce(_without_metadata(F.col("raw_message_json")), F.lit(""))
    rows = rows.select(*_NODE, shown.alias("_shown"), F.octet_length(F.coalesce("raw_message_json", F.lit(""))).alias("raw_bytes"))
    return rows.select(*_NODE, F.substring("_shown", 1, limit).alias("raw_preview"), (F.length("_shown") > limit).alias("raw_preview_truncated"), "raw_bytes")


def copy_messages(archive: Archive, conversation_id: str, node_ids: list[str]) -> DataFrame:
    """``role:`` and text of the listed messages, in the order of the list, and how many are missing."""
    wanted = archive.conversations.sparkSession.createDataFrame([(i, n) for i, n in enumerate(node_ids)], "pos int, node_id string")
    rows = F.broadcast(wanted).join(archive.texts.where(F.col("conversation_id") == conversation_id), "node_id", "left")
    shown = F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.struct("pos", F.concat(F.coalesce("role", F.lit("message")), F.lit(":\n"), F.col("text")).alias("t")))
    parts = F.array_sort(F.collect_list(shown))
    return rows.agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("text"), F.sum(F.when(F.col("conversation_id").isNull(), 1).otherwise(0)).alias("missing"))
