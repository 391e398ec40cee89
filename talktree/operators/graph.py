"""The message graph: each conversation's effective path and its diagnostics.

Precedence: the chain from a valid current node to its root; else the chain of flagged nodes from
the flagged leaf with the smallest id; else all nodes.  All edges lie inside a conversation, which
has a bounded number of nodes, so nodes are dealt by conversation once and sorted.  Parents become row
numbers, and whole slabs of conversations are resolved by array operations: chains a step at a time for
all conversations, circles by doubling steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NODE_COLUMNS = ["conversation_id", "node_id", "parent_node_id", "flag", "create_time", "update_time", "current_node", "foreign"]
PATH_SCHEMA = "conversation_id string, node_id string, depth long, source string, position long"
_FLAGS = [
    "cycle_detected", "missing_parent", "cross_conversation_parent", "partial_chain",
    "selected_chain_cycle_detected", "raw_flag_cycle_detected", "selected_chain_missing_parent", "raw_flag_missing_parent",
    "selected_chain_cross_conversation_parent", "raw_flag_cross_conversation_parent",
]
META_SCHEMA = (
    "conversation_id string, node_count long, current_path_nodes long, raw_flag_leaf_count long, current_node_exists boolean, current_collection_source string, "
    "current_path_fallback_to_all boolean, effective_path string, flags_missing long, parent_cycle_nodes long, parent_cycle_components long, " + ", ".join(f"{f} boolean" for f in _FLAGS)
)


#: Nodes that are taken at once, besides the rest of the last conversation.
_SLAB = 1 << 17
#: In place of a parent's row: there is none, or it is in no row of the conversation.
NONE, LOST = -1, -2


def parent_rows(group: np.ndarray, node: pa.Array, parent: pa.Array) -> np.ndarray:
    """The row of each row's parent in its own group, NONE or LOST.  Of rows that repeat an id the last counts."""
    n = len(group)
    names = pa.chunked_array([node, parent], pa.string()).combine_chunks().dictionary_encode()
    code = names.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.index(names.dictionary, "").as_py()  # -1, as for null, if there is none
    key = group * (len(names.dictionary) + 1) + code[:n]
    order = np.argsort(key, kind="stable")
    wanted = group * (len(names.dictionary) + 1) + code[n:]
    at = np.searchsorted(key[order], wanted, "right") - 1
    row = order[np.maximum(at, 0)]
    out = np.where((at >= 0) & (key[row] == wanted), row, LOST)
    out[(code[n:] == -1) | (code[n:] == blank)] = NONE
    return out


def ring_rows(up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row lies on a circle of ``up``, and whether it is the first row of its circle.

    Steps are doubled until they are longer than any chain: what is then still reached lies on circles.  The
    least row met on the way names a circle.
    """
    n = len(up)
    step, least = np.append(np.where(up >= 0, up, n), n), np.arange(n + 1)
    for _ in range(max(n, 1).bit_length()):
        least = np.minimum(least, least[step])
        step = step[step]
        if (step == n).all():
            return np.zeros(n, bool), np.zeros(n, bool)
    on = np.zeros(n + 1, bool)
    on[step] = True
    on = on[:n]
    return on, on & (least[:n] == np.arange(n))


def walk(leaf: np.ndarray, up: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chains from each leaf (NONE: no chain), all a step at a time: (chain, row, depth) of their rows, and for each
    chain whether it runs into itself and the row whose parent is not ``within``, NONE if there is none."""
    seen = np.zeros(len(up), bool)
    ring, end = np.zeros(len(leaf), bool), np.full(len(leaf), NONE)
    chain = np.flatnonzero(leaf >= 0)
    row = leaf[chain]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    depth = 0
    while len(row):
        seen[row] = True
        out.append((chain, row, np.full(len(row), depth)))
        above = up[row]
        inside = above >= 0
        inside[inside] = within[above[inside]]
        lost = (above != NONE) & ~inside
        end[chain[lost]] = row[lost]
        again = inside.copy()
        again[inside] = seen[above[inside]]
        ring[chain[again]] = True
        on = inside & ~again
        chain, row = chain[on], above[on]
        depth += 1
    if not out:
        return *(np.zeros(0, np.int64) for _ in range(3)), ring, end
    return *(np.concatenate(x) for x in zip(*out)), ring, end


def cycles(parents: dict[str, str | None]) -> tuple[int, int]:
    """How many nodes are on circles of parents, and how many circles there are."""
    nodes = list(parents)
    up = parent_rows(np.zeros(len(nodes), np.int64), pa.array(nodes, pa.string()), pa.array(list(parents.values()), pa.string()))
    on, first = ring_rows(up)
    return int(on.sum()), int(first.sum())


@dataclass
class Slab:
    """Rows of whole conversations, in order, and what follows for each conversation."""

    rows: pa.Table
    group: np.ndarray  # the conversation of each row
    first: np.ndarray  # the first row of each conversation
    real: np.ndarray  # whether a row is a node; a conversation without any has one row that is none
    up: np.ndarray
    flag: np.ndarray
    current: np.ndarray  # the row of the current node, or NONE

    @classmethod
    def of(cls, rows: pa.Table) -> Slab:
        cid = rows.column("conversation_id").combine_chunks()
        node, parent = (rows.column(c).combine_chunks() for c in ("node_id", "parent_node_id"))
        new = np.append(True, pc.not_equal(cid[1:], cid[:-1]).to_numpy(zero_copy_only=False)) if len(cid) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        given = rows.column("current_node").combine_chunks()
        same = pc.fill_null(pc.and_(pc.equal(node, given), pc.not_equal(given, "")), False).to_numpy(zero_copy_only=False)
        current = np.full(len(first), NONE)
        current[group[same]] = np.flatnonzero(same)
        flag = rows.column("flag").combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)
        return cls(rows, group, first, node.is_valid().to_numpy(zero_copy_only=False), parent_rows(group, node, parent), flag, current)

    def count(self, which: np.ndarray) -> np.ndarray:
        return np.bincount(self.group[which], minlength=len(self.first))

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """How many flagged leaves each conversation has, and the row of the first by id, or NONE."""
        inner = np.zeros(len(self.up), bool)
        inner[self.up[self.flag & (self.up >= 0)]] = True
        leaf = np.flatnonzero(self.flag & ~inner & self.real)  # rows are sorted by id
        out = np.full(len(self.first), NONE)
        out[self.group[leaf[::-1]]] = leaf[::-1]
        return np.bincount(self.group[leaf], minlength=len(self.first)), out

    def chains(self) -> tuple:
        """``walk`` from each conversation's leaf, and the leaves."""
        leaf = np.where(self.current >= 0, self.current, self.leaves()[1])
        return *walk(leaf, self.up, (self.current >= 0)[self.group] | self.flag), leaf

    def by_time(self, which: np.ndarray) -> np.ndarray:
        """Rows by conversation and, in it, as a reader shows them: those without a creation time last."""
        made, changed = (self.rows.column(c).combine_chunks() for c in ("create_time", "update_time"))
        time = pc.fill_null(pc.coalesce(made, changed), 0.0).to_numpy(zero_copy_only=False)[which]
        return which[np.lexsort((which, time, made.is_null().to_numpy(zero_copy_only=False)[which], self.group[which]))]


def _source(slab: Slab, leaf: np.ndarray) -> np.ndarray:
    return np.where(slab.current >= 0, "current_node", np.where(leaf >= 0, "raw_flags", "fallback_all"))


def _paths(slab: Slab) -> list:
    chain, row, depth, _, _, leaf = slab.chains()
    rest = slab.by_time(np.flatnonzero(slab.real & (leaf < 0)[slab.group]))
    length = np.bincount(chain, minlength=len(leaf))
    begin = np.searchsorted(slab.group[rest], slab.group[rest], "left")
    at = np.concatenate([row, rest])
    position = np.concatenate([length[chain] - 1 - depth, np.arange(len(rest)) - begin])
    depth = pa.array(np.concatenate([depth, np.zeros(len(rest), np.int64)]), mask=np.append(np.zeros(len(row), bool), np.ones(len(rest), bool)))
    taken = slab.rows.take(pa.array(at))
    return [taken.column("conversation_id").combine_chunks(), taken.column("node_id").combine_chunks(), depth, pa.array(_source(slab, leaf)[slab.group[at]]), pa.array(position)]


def _metadata(slab: Slab) -> list:
    n, (leaves, _) = len(slab.first), slab.leaves()
    chain, row, _, ring, end, leaf = slab.chains()
    foreign = slab.rows.column("foreign").combine_chunks().fill_null(False).to_numpy(zero_copy_only=False) & (slab.up == LOST)
    nodes, flagged = slab.count(slab.real), slab.count(slab.flag & slab.real)
    exists = slab.current >= 0
    away = np.zeros(n, bool)
    away[end >= 0] = foreign[end[end >= 0]]
    selected = ring, (end >= 0) & ~away, away
    on, first = ring_rows(np.where(slab.real, slab.up, NONE))
    inside = slab.up >= 0
    inside[inside] = slab.flag[slab.up[inside]]
    flags_on, _ = ring_rows(np.where(slab.flag & inside, slab.up, NONE))
    out_of = slab.flag & (slab.up != NONE) & ~inside
    raw = slab.count(flags_on) > 0, slab.count(out_of & ~foreign) > 0, slab.count(out_of & foreign) > 0
    unflagged = row[~slab.flag[row] & exists[chain]]
    fallback = (leaf < 0) & (nodes > 0)
    both = [a | b for a, b in zip(selected, raw)]
    flags = [*both, both[0] | both[1] | both[2], *(x for pair in zip(selected, raw) for x in pair)]
    ids = slab.rows.column("conversation_id").combine_chunks().take(pa.array(slab.first))
    counts = [nodes, flagged, leaves, exists, _source(slab, leaf), fallback, np.where(fallback, "all", "current"), slab.count(unflagged), slab.count(on), slab.count(first), *flags]
    return [ids, *(pa.array(x) for x in counts)]


def _on_rings(slab: Slab) -> list:
    taken = slab.rows.take(pa.array(np.flatnonzero(ring_rows(slab.up)[0])))
    return [taken.column("conversation_id").combine_chunks(), taken.column("node_id").combine_chunks()]


def _by_slab(make: Callable[[Slab], list], schema: pa.Schema):
    """Runs ``make`` on whole conversations of batches that are sorted by conversation, many at a time."""

    def emit(rows: pa.Table) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(make(Slab.of(rows)), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < _SLAB:
                continue
            rows = pa.Table.from_batches(held)
            last = rows.column("conversation_id")[-1]
            cut = pc.index(rows.column("conversation_id"), last).as_py()  # the last conversation may go on
            held = rows.slice(cut).to_batches()
            if cut:
                yield emit(rows.slice(0, cut))
        if held:
            yield emit(pa.Table.from_batches(held))

    return run


def _arrow_schema(spec: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in spec.split(", "))])


def foreign_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``foreign``: whether another conversation has a node of the parent's id."""
    homes = nodes.groupBy(F.col("node_id").alias("_p")).agg(F.min("conversation_id").alias("_lo"), F.max("conversation_id").alias("_hi"))
    joined = nodes.join(homes, F.col("parent_node_id") == F.col("_p"), "left")
    other = (F.col("_lo") != F.col("conversation_id")) | (F.col("_hi") != F.col("conversation_id"))
    return joined.withColumn("foreign", F.coalesce(other, F.lit(False))).drop("_p", "_lo", "_hi")


def _prepared(conversations: DataFrame, nodes: DataFrame, how: str, mark_foreign: bool) -> DataFrame:
    """Slim nodes with their conversation's current node, sorted by conversation; foreign parents only bear on diagnostics."""
    slim = nodes.select("conversation_id", "node_id", "parent_node_id", (F.coalesce("is_on_current_path", F.lit(0)) == 1).alias("flag"), "create_time", "update_time")
    current = conversations.select("conversation_id", "current_node")
    slim = foreign_parents(slim) if mark_foreign else slim.withColumn("foreign", F.lit(False))
    rows = slim.join(current, "conversation_id", how).select(_NODE_COLUMNS)
    return rows.repartition("conversation_id").sortWithinPartitions("conversation_id", "node_id")


def effective_paths(conversations: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(conversation_id, node_id, depth, source, position)``: the nodes of each effective path.

    depth counts up from the leaf, null where all nodes are taken; position counts down from the root.
    """
    return _prepared(conversations, nodes, "inner", False).mapInArrow(_by_slab(_paths, _arrow_schema(PATH_SCHEMA)), PATH_SCHEMA)


def path_metadata(conversations: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row for each conversation: counts, where its path comes from, and diagnostics."""
    return _prepared(conversations, nodes, "right", True).mapInArrow(_by_slab(_metadata, _arrow_schema(META_SCHEMA)), META_SCHEMA)


def on_cycles(nodes: DataFrame) -> DataFrame:
    """``(conversation_id, node_id)`` of nodes on circles of parents."""
    schema = "conversation_id string, node_id string"
    slim = nodes.select("conversation_id", "node_id", "parent_node_id", F.lit(False).alias("flag"), F.lit(None).cast("string").alias("current_node"))
    return slim.repartition("conversation_id").sortWithinPartitions("conversation_id", "node_id").mapInArrow(_by_slab(_on_rings, _arrow_schema(schema)), schema)
