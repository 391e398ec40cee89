"""Effective paths and diagnostics of generated graphs, held against a walk over plain dicts."""

import random

import pytest

from talktree.operators import verify
from talktree.operators.archive import Archive
from talktree.operators.graph import cycles, effective_paths, on_cycles, path_metadata


def generated(seed: int) -> dict:
    """Conversations of up to nine nodes: parents at random, lost, elsewhere or in circles; flags and current nodes at random."""
    rng, out = random.Random(seed), {}
    for k in range(150):
        ids = [f"n{k}_{j}" for j in range(rng.randint(0, 9))]
        rng.shuffle(ids)
        rows = []
        for j, n in enumerate(ids):
            draw = rng.random()
            earlier = rng.choice(ids[:j]) if j else None
            parent = earlier if draw < 0.7 else rng.choice(ids) if draw < 0.85 else None if draw < 0.92 else "lost" if draw < 0.96 else f"n{(k + 1) % 150}_0"
            rows.append((n, parent, int(rng.random() < rng.choice([0, 0.5, 1]))))
        out[f"c{k:03d}"] = (rng.choice([None, "lost", *ids, *ids]), rows)
    return out


def walked(current, rows, everywhere):
    """(source, path from the root, selected, raw): each of the two as (circle, lost parent, parent elsewhere)."""
    parent, flag = {n: p for n, p, _ in rows}, [n for n, _, f in rows if f]

    def state(p, inside):
        return (False, False, False) if p is None or p in inside else (False, p not in everywhere or p in parent, p in everywhere and p not in parent)

    def up(node, inside):
        path = []
        while node is not None and node in inside and node not in path:
            path.append(node)
            node = parent[node]
        return path[::-1], (node is not None and node in path, *state(node, inside)[1:])

    circle = any(n in [*_steps(parent, n, flag)] for n in flag)
    ends = [state(parent[n], flag) for n in flag]
    raw = (circle, any(e[1] for e in ends), any(e[2] for e in ends))
    if current in parent:
        return ("current_node", *up(current, parent), raw)
    leaves = sorted(n for n in flag if n not in [parent[m] for m in flag])
    if leaves:
        return ("raw_flags", *up(leaves[0], flag), raw)
    order = {n: i for i, (n, _, _) in enumerate(rows)}
    return ("fallback_all", sorted(parent, key=order.get), (False, False, False), raw)


def _steps(parent, node, inside):
    """Nodes above ``node`` without leaving ``inside``, until one comes again."""
    seen = set()
    node = parent[node]
    while node in inside and node not in seen:
        seen.add(node)
        yield node
        node = parent[node]


@pytest.fixture(scope="module", params=[1, 2])
def graphs(request, spark):
    cases = generated(request.param)
    conversations = [(c, current) for c, (current, _) in cases.items()]
    nodes = [(c, n, p, f, float(i), None) for c, (_, rows) in cases.items() for i, (n, p, f) in enumerate(rows)]
    archive = Archive(
        spark.createDataFrame(conversations, "conversation_id string, current_node string"),
        spark.createDataFrame(nodes, "conversation_id string, node_id string, parent_node_id string, is_on_current_path int, create_time double, update_time double").repartition(3),
    )
    everywhere = {n for _, rows in cases.values() for n, _, _ in rows}
    return cases, archive, {c: walked(current, rows, everywhere) for c, (current, rows) in cases.items()}


def test_paths(graphs):
    cases, archive, want = graphs
    got: dict = {}
    for r in effective_paths(archive.conversations, archive.nodes).collect():
        got.setdefault(r.conversation_id, []).append((r.position, r.node_id, r.source, r.depth))
    for c, (source, path, *_) in want.items():
        rows = sorted(got.get(c, []))
        assert [r[1] for r in rows] == path, (c, cases[c])
        assert {r[2] for r in rows} <= {source}
        assert [r[3] for r in rows] == ([None] * len(path) if source == "fallback_all" else list(range(len(path)))[::-1])
    assert {w[0] for w in want.values()} == {"current_node", "raw_flags", "fallback_all"}


def test_metadata(graphs):
    cases, archive, want = graphs
    rows = {r.conversation_id: r for r in path_metadata(archive.conversations, archive.nodes).collect()}
    assert set(rows) == set(cases)
    for c, (source, path, selected, raw) in want.items():
        r, (current, nodes) = rows[c], cases[c]
        assert (r.node_count, r.current_collection_source, r.current_path_nodes) == (len(nodes), source, sum(f for _, _, f in nodes)), c
        assert (r.selected_chain_cycle_detected, r.selected_chain_missing_parent, r.selected_chain_cross_conversation_parent) == selected, (c, cases[c])
        assert (r.raw_flag_cycle_detected, r.raw_flag_missing_parent, r.raw_flag_cross_conversation_parent) == raw, (c, cases[c])
        assert (r.cycle_detected, r.missing_parent, r.cross_conversation_parent) == tuple(a or b for a, b in zip(selected, raw))
        assert r.partial_chain == any(selected + raw) and r.current_path_fallback_to_all == (source == "fallback_all" and bool(nodes))
        assert r.current_node_exists == (current in {n for n, _, _ in nodes})
        assert r.flags_missing == (sum(n in path and not f for n, _, f in nodes) if source == "current_node" else 0)


def test_cycles(graphs):
    cases, archive, _ = graphs
    want = set()
    for c, (_, rows) in cases.items():
        parent = {n: p for n, p, _ in rows}
        want |= {(c, n) for n in parent if n in [*_steps(parent, n, parent)]}
    assert {(r.conversation_id, r.node_id) for r in on_cycles(archive.nodes).collect()} == want
    row = verify.cycle_counts(archive).first()
    assert row.parent_cycle_nodes == len(want) and 0 < row.parent_cycle_components <= len(want)
    assert cycles({"a": "a"}) == (1, 1) and cycles({"a": "b", "b": None}) == (0, 0)


def test_diagnostics(graphs):
    cases, archive, want = graphs
    d = verify.path_diagnostics(archive).first()
    count = lambda f: sum(map(f, want.items()))
    assert (d.selected_current_node, d.selected_raw_flags, d.selected_fallback_all) == tuple(count(lambda x, s=s: x[1][0] == s) for s in ("current_node", "raw_flags", "fallback_all"))
    assert d.invalid_current_node_flags_used == count(lambda x: x[1][0] == "raw_flags" and bool(cases[x[0]][0]))
    assert d.selected_chain_cycles == count(lambda x: x[1][2][0]) and d.partial_raw_flag_topology == count(lambda x: any(x[1][3]))
