"""Cursors, lists with counts, and stored columns with gaps."""

import pytest
from pyspark.sql import functions as F

from talktree.operators import continuation as C
from talktree.operators import search
from talktree.operators.archive import Archive
from talktree.operators.store import Store
from talktree.plans.query import parse_query
from tests.test_import_export import conversation
from tests.test_sources import elements

KEY = b"secret"


def test_stretches_joined_are_the_whole(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    store.import_elements(elements(spark, [conversation(f"c{i}", reply="answer needle" if i % 2 else "answer") for i in range(7)]))
    q = parse_query("answer", path="all")
    for reply in ("gone", "gone again"):
        want = [tuple(r) for r in search.message_hits(store.archive(), q).select("conversation_id", "node_id").orderBy("conversation_id", "node_id").collect()]
        got, cursor = [], None
        while not got or cursor:
            part = C.scan_messages(store, q, KEY, 3, cursor)
            got += [tuple(r) for r in part.hits.select("conversation_id", "node_id").collect()]
            if cursor is None:  # an import comes between
                store.import_elements(elements(spark, [conversation("c0", reply=reply), conversation("c5b", reply="answer")]))
            cursor = part.cursor
        assert got == want and len(got) > 6
        store.build_index()
    cursor = C.scan_messages(store, q, KEY, 3).cursor
    for bad, key, asked, why in (
        (cursor, KEY, parse_query("answer", path="current"), C.OTHER_QUERY), (cursor, b"other", q, C.INVALID), (cursor[:-2] + "AA", KEY, q, C.INVALID), ("", KEY, q, C.INVALID), ("é", KEY, q, C.INVALID), ("A" * 60, KEY, q, C.INVALID),
    ):
        with pytest.raises(C.CursorError, match=why):
            C.scan_messages(store, asked, key, 3, bad)
    assert C.query_digest(parse_query("answer  ", path="all")) == C.query_digest(q) != C.query_digest(parse_query("answer role:user", path="all"))
    old = C.scan_messages(store, q, KEY, 3).cursor
    store.import_elements(elements(spark, [conversation("z")]))
    store.vacuum(keep=1)
    with pytest.raises(C.CursorError, match=C.STALE):
        C.scan_messages(store, q, KEY, 3, old)
    assert C.scan_messages(store, parse_query("nowhere", path="all"), KEY).cursor is None


def test_chunks(spark):
    text = "añb🙂" * 25 + "e"
    rows = spark.createDataFrame([("c", "n", text), ("c", "m", text), ("c", "e", ""), ("d", "n", None)], "conversation_id string, node_id string, text string")
    one = lambda **k: {(r.conversation_id, r.node_id): r for r in C.display_chunks(rows, "key", 10, **k).collect()}
    read, cursor = "", None
    for _ in range(20):
        got = one(cursor=F.lit(cursor)) if cursor else one()
        r = got["c", "n"]
        assert r.problem is None and r.total_chars == 101
        if cursor:
            assert got["c", "m"].problem == C.INVALID_CHUNK and got["c", "m"].chunk is None  # a cursor is for one message
        read, cursor = read + r.chunk, r.next_cursor
        if not r.has_more:
            break
    assert read == text and cursor is None
    start = one()["c", "n"].next_cursor
    for bad in (start[:-1] + ("0" if start[-1] != "0" else "1"), start.replace(".10.", ".11."), "x", "", "1.2.3", f"{start}.4"):
        assert one(cursor=F.lit(bad))["c", "n"].problem == C.INVALID_CHUNK
    assert one(cursor=F.lit(start), anchor=F.lit(3))["c", "n"].problem == C.INVALID_CHUNK
    stale = C.display_chunks(rows.withColumn("text", F.concat("text", F.lit("."))), "key", 10, cursor=F.lit(start)).where("conversation_id = 'c' and node_id = 'n'").first()
    assert stale.problem == C.STALE_CHUNK and stale.chunk is None
    r = one(anchor=F.lit(50))["c", "n"]
    assert (r.offset, r.anchor_in_chunk, r.chunk) == (45, 5, text[45:55])
    assert one(anchor=F.lit(2))["c", "n"].offset == 0 and one(offset=F.lit(-4))["c", "n"].offset == 0
    r = one(offset=F.lit(500))["c", "n"]
    assert r.chunk == "" and not r.has_more and one()["c", "e"].chunk == "" and one()["d", "n"].chunk is None


def test_lists_with_counts(spark):
    c = spark.createDataFrame([(f"c{i}", f"t{i}", float(i), None, None, "f") for i in range(5)], "conversation_id string, title string, create_time double, update_time double, current_node string, source_file string")
    n = spark.createDataFrame([(f"c{i}", str(k), k % 2) for i in range(4) for k in range(i)], "conversation_id string, node_id string, is_on_current_path int")
    a = Archive(c, n)
    pick = lambda **k: [(r.place, r.conversation_id, r.node_count, r.current_path_nodes, r.total, r.selected_in_results) for r in search.listed(a, "oldest", **k).collect()]
    assert pick(limit=2, offset=1) == [(1, "c1", 1, 0, 5, False), (2, "c2", 2, 1, 5, False)]
    assert pick(limit=1, selected_id="c3") == [(0, "c0", 0, 0, 5, True), (None, "c3", 3, 1, 5, True)]
    assert pick(limit=1, selected_id="c0") == [(0, "c0", 0, 0, 5, True)] and pick(limit=1, selected_id="no")[0][-1] is False
    assert pick(limit=9, after=2.0, before=4.0, selected_id="c0") == [(0, "c2", 2, 1, 2, False), (1, "c3", 3, 1, 2, False)]
    assert pick(limit=9, after=99.0) == []
    with pytest.raises(ValueError, match="invalid_sort:odd"):
        search.listed(a, "odd")
    for call in (lambda: search.list_order("relevance"), lambda: search.conversation_order("x"), lambda: search.search_messages(a, parse_query("x"), "side")):
        with pytest.raises(ValueError, match="invalid_(sort|order)"):
            call()


def test_gaps_in_stored_columns_are_filled(spark):
    c = spark.createDataFrame([("a", "ＴＩＴＬＥ", None, "F", None), ("b", "X", "stored", None, "g")], "conversation_id string, title string, title_norm string, source_file string, source_norm string")
    n = spark.createDataFrame([("a", "1", "Text", None, None, None), ("a", "2", "Text", None, "own", "kept")], "conversation_id string, node_id string, content_text string, raw_message_json string, text string, norm string")
    rows = {r.conversation_id: (r.title_norm, r.source_norm) for r in Archive(c, n).titled.collect()}
    assert rows == {"a": ("title", "f"), "b": ("stored", "g")}
    assert {r.node_id: (r.text, r.norm) for r in Archive(c, n).texts.collect()} == {"1": ("Text", "text"), "2": ("own", "kept")}
    assert {r.node_id: r.norm for r in Archive(c, n, complete=True).texts.collect()} == {"1": None, "2": "kept"}
