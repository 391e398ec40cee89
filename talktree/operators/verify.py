"""Archive statistics and integrity checks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talktree.functions.values import finite
from talktree.operators.archive import Archive
from talktree.operators.graph import on_cycles
from talktree.schema import MAX_ID_CHARS, TABLES

_SAFE_ID = r"^[^\x00-\x1f\x7f-\x9f]*\z"


def stats(archive: Archive) -> DataFrame:
    """One row: how many conversations, nodes and flagged nodes, and the first and last finite times."""
    c = archive.conversations.agg(
        F.count("*").alias("conversations"),
        *(f(finite(F.col(t))).alias(f"{n}_{t}") for t in ("create_time", "update_time") for n, f in (("earliest", F.min), ("latest", F.max))),
    )
    n = archive.nodes.agg(F.count("*").alias("nodes"), F.coalesce(F.sum(F.when(F.col("is_on_current_path") == 1, 1)), F.lit(0)).alias("current_path_nodes"))
    return c.join(F.broadcast(n), F.lit(True))


def scope_totals(nodes: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row: conversations, nodes and bytes of text of all nodes, or of the conversations in ``ids``."""
    if ids is not None:
        nodes = nodes.join(ids.select("conversation_id").distinct(), "conversation_id", "left_semi")
    size = F.coalesce(F.sum(F.octet_length("content_text")), F.lit(0))
    return nodes.agg(F.countDistinct("conversation_id").alias("conversations"), F.count("*").alias("nodes"), size.alias("text_bytes"))


def missing_current(archive: Archive) -> DataFrame:
    """Conversations whose current node they do not have."""
    c = archive.conversations.where("current_node is not null").select("conversation_id", F.col("current_node").alias("node_id"))
    return c.join(archive.nodes, ["conversation_id", "node_id"], "left_anti")


def broken_parents(archive: Archive) -> DataFrame:
    """Nodes whose parent their conversation does not have."""
    child = archive.nodes.where("parent_node_id is not null").select("conversation_id", "node_id", "parent_node_id")
    parent = archive.nodes.select("conversation_id", F.col("node_id").alias("parent_node_id"))
    return child.join(parent, ["conversation_id", "parent_node_id"], "left_anti")


def without_nodes(archive: Archive) -> DataFrame:
    return archive.conversations.join(archive.nodes, "conversation_id", "left_anti").select("conversation_id")


def orphans(archive: Archive) -> DataFrame:
    """Nodes without a conversation."""
    return archive.nodes.join(archive.conversations, "conversation_id", "left_anti").select("conversation_id", "node_id")


def violation_samples(archive: Archive, limit: int = 20) -> DataFrame:
    """The first few nodes without a conversation."""
    return orphans(archive).orderBy("conversation_id", "node_id").limit(limit)


def reference_violations(archive: Archive, others: dict[str, tuple[DataFrame, str, DataFrame, str]] | None = None) -> DataFrame:
    """``(table, violations)``: rows that refer to a row that is not there, for nodes and any other (child, column, parent, column)."""
    found = orphans(archive).agg(F.lit("nodes").alias("table"), F.count("*").alias("violations"))
    for name, (child, column, parent, key) in (others or {}).items():
        keys = parent.select(F.col(key).alias(column)).distinct()
        lost = child.where(F.col(column).isNotNull()).join(keys, column, "left_anti")
        found = found.unionByName(lost.agg(F.lit(name).alias("table"), F.count("*").alias("violations")))
    return found


def _not_finite(x: str) -> Column:
    return F.when(F.isnan(x) | (F.abs(F.col(x)) == F.lit(math.inf)), 1).otherwise(0)


def non_finite_times(archive: Archive) -> DataFrame:
    """How many times are NaN or infinite."""
    each = [t.agg(F.coalesce(F.sum(_not_finite("create_time") + _not_finite("update_time")), F.lit(0)).alias("n")) for t in (archive.conversations, archive.nodes)]
    return each[0].union(each[1]).agg(F.sum("n").alias("non_finite_timestamps"))


def unsafe_ids(archive: Archive) -> DataFrame:
    """``(field, incompatible)``: stored ids that are too long or hold control characters, children included."""
    bad = lambda c: ~c.rlike(_SAFE_ID) | (F.length(c) > MAX_ID_CHARS)
    c, n = archive.conversations, archive.nodes
    child = n.select(F.explode(F.from_json("children_json", "array<string>")).alias("id"))
    fields = [(c, "conversation_id"), (c, "current_node"), (n, "node_id"), (n, "parent_node_id"), (n, "message_id")]
    counts = [t.agg(F.lit(f).alias("field"), F.coalesce(F.sum(F.when(bad(F.col(f)), 1)), F.lit(0)).alias("incompatible")) for t, f in fields]
    counts.append(child.agg(F.lit("children").alias("field"), F.coalesce(F.sum(F.when(bad(F.col("id")), 1)), F.lit(0)).alias("incompatible")))
    out = counts[0]
    for more in counts[1:]:
        out = out.union(more)
    return out


def warning_counts(warnings: DataFrame, latest: bool = False) -> DataFrame:
    """``(warning_type, count)``, most first; of the latest import only if asked."""
    if latest:
        last = warnings.agg(F.max("import_run_id").alias("_run"))
        warnings = warnings.join(F.broadcast(last), F.col("import_run_id") == F.col("_run"), "left_semi")
    return warnings.groupBy("warning_type").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "warning_type")


def path_diagnostics(archive: Archive) -> DataFrame:
    """One row of counts over all conversations' path metadata."""
    m = archive.meta
    source = F.col("current_collection_source")
    has_current = archive.conversations.select("conversation_id", (F.coalesce("current_node", F.lit("")) != "").alias("_has"))
    count = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0))
    some = lambda kind: F.col(f"{kind}_cycle_detected") | F.col(f"{kind}_missing_parent") | F.col(f"{kind}_cross_conversation_parent")
    return m.join(has_current, "conversation_id").agg(
        count(source == "current_node").alias("selected_current_node"),
        count(source == "raw_flags").alias("selected_raw_flags"),
        count(source == "fallback_all").alias("selected_fallback_all"),
        count((source == "current_node") & (F.col("current_path_nodes") == 0)).alias("valid_current_node_zero_flags"),
        count(F.col("raw_flag_leaf_count") > 1).alias("multiple_flag_leaves"),
        count((source == "raw_flags") & F.col("_has")).alias("invalid_current_node_flags_used"),
        count(F.col("cycle_detected")).alias("cycle_detected"),
        count(F.col("selected_chain_cycle_detected")).alias("selected_chain_cycles"),
        count(F.col("raw_flag_cycle_detected")).alias("raw_flag_cycles"),
        count(F.col("selected_chain_missing_parent")).alias("missing_parent_in_selected_chain"),
        count(F.col("selected_chain_cross_conversation_parent")).alias("cross_conversation_parent_in_selected_chain"),
        count(some("selected_chain")).alias("partial_selected_chain"),
        count(F.col("raw_flag_missing_parent")).alias("missing_parent_in_raw_flag_topology"),
        count(F.col("raw_flag_cross_conversation_parent")).alias("cross_conversation_parent_in_raw_flag_topology"),
        count(some("raw_flag")).alias("partial_raw_flag_topology"),
        count((source == "current_node") & (F.col("flags_missing") > 0)).alias("flags_missing_current_chain_nodes"),
    )


def cycle_counts(archive: Archive) -> DataFrame:
    """One row: nodes on circles of parents, and circles."""
    return archive.meta.agg(F.coalesce(F.sum("parent_cycle_nodes"), F.lit(0)).alias("parent_cycle_nodes"), F.coalesce(F.sum("parent_cycle_components"), F.lit(0)).alias("parent_cycle_components"))


def cycle_nodes(archive: Archive) -> DataFrame:
    return on_cycles(archive.nodes)


def verify(archive: Archive, warnings: DataFrame | None = None) -> dict:
    """All checks as one report; each is one aggregated row."""
    one = lambda df: df.first().asDict()
    report = one(stats(archive)) | one(cycle_counts(archive)) | one(non_finite_times(archive))
    report |= {"missing_current_node": missing_current(archive).count(), "broken_parent_links": broken_parents(archive).count(), "conversations_with_zero_nodes": without_nodes(archive).count()}
    report["foreign_key_violations"] = orphans(archive).count()
    report["effective_current_diagnostics"] = one(path_diagnostics(archive))
    if warnings is not None:
        report |= {"warnings_by_type": [r.asDict() for r in warning_counts(warnings).collect()], "latest_warnings_by_type": [r.asDict() for r in warning_counts(warnings, latest=True).collect()]}
    report["ok"] = not any(report[k] for k in ("missing_current_node", "broken_parent_links", "conversations_with_zero_nodes", "parent_cycle_nodes", "foreign_key_violations", "non_finite_timestamps"))
    return report


def schema_problems(tables: dict[str, DataFrame]) -> list[str]:
    """What differs from the layout: missing tables, missing columns, other types."""
    out = []
    for name, want in TABLES.items():
        if name not in tables:
            out.append(f"missing table: {name}")
            continue
        have = dict(tables[name].dtypes)
        for f in want:
            if f.name not in have:
                out.append(f"missing column: {name}.{f.name}")
            elif have[f.name] != f.dataType.simpleString():
                out.append(f"type of {name}.{f.name}: {have[f.name]}, not {f.dataType.simpleString()}")
    return out
