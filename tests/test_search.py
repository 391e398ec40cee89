"""Search semantics on a small corpus, and relations that must hold between searches."""

import pytest
from pyspark.sql import functions as F

from talktree.operators import index, reader, search
from talktree.operators.archive import Archive
from talktree.plans.query import parse_query

NODES = [
    # conversation, node, parent, role, text, type
    ("w1", "a", None, "user", "Hello C++ and gpt-5.5", "text"),
    ("w1", "b", "a", "assistant", "General greeting, 全角 mix", "text"),
    ("w1", "c", "b", "tool", "tool output hello", "text"),
    ("w1", "d", "a", "user", "branch only hello", "text"),
    ("w2", "a", None, "user", "nothing here", "text"),
    ("w2", "b", "a", "assistant", "[non-text content: image]", "image"),
    ("w3", "a", None, "system", "hello rules", "text"),
    ("w3", "b", "a", "user", "plain", "text"),
    ("w3", "c", "b", "assistant", None, "text"),
]
CONVERSATIONS = [("w1", "Latin title", 100.0, None, "c", "conversations-1.json"), ("w2", "中文 标题 hello", 90000.0, 200000.0, "b", "conversations-2.json"), ("w3", None, None, None, "zz", "other.json")]


@pytest.fixture(scope="module")
def archive(spark):
    nodes = [(c, n, p, f"{c}{n}", r, float(i), None, k, t, 0, None) for i, (c, n, p, r, t, k) in enumerate(NODES)]
    return Archive(
        spark.createDataFrame(CONVERSATIONS, "conversation_id string, title string, create_time double, update_time double, current_node string, source_file string"),
        spark.createDataFrame(nodes, "conversation_id string, node_id string, parent_node_id string, message_id string, role string, create_time double, update_time double, content_type string, content_text string, is_on_current_path int, raw_message_json string"),
    )


def hits(archive, text, **options):
    return sorted((r.conversation_id, r.node_id) for r in search.message_hits(archive, parse_query(text, **options)).collect())


def found(archive, text, **options):
    return {r.conversation_id: (r.hit_count, r.score) for r in search.search_conversations(archive, parse_query(text, **options)).collect()}


@pytest.mark.parametrize(
    "text, options, expected",
    [
        ("hello", {}, [("w1", "a"), ("w1", "c"), ("w3", "a")]),
        ("hello", {"path": "all"}, [("w1", "a"), ("w1", "c"), ("w1", "d"), ("w3", "a")]),
        ("c++", {}, [("w1", "a")]),
        ("ＧＰＴ-5.5", {}, [("w1", "a")]),
        ("全角", {}, [("w1", "b")]),
        ("hello role:tool_system", {}, [("w1", "c"), ("w3", "a")]),
        ("hello -rules", {}, [("w1", "a"), ("w1", "c")]),
        ("hello -latin", {}, [("w3", "a")]),
        ("hello title:latin", {}, [("w1", "a"), ("w1", "c")]),
        ("hello scope:title", {}, []),
        ("title:latin", {}, []),
        ("image", {}, []),
        ("hell", {"match_mode": "word"}, []),
        ("nothing or rules", {}, [("w2", "a"), ("w3", "a")]),
        ('"only hello"', {"path": "all"}, [("w1", "d")]),
        ("here after:1970-01-03", {}, [("w2", "a")]),
        ("here before:1970-01-02", {}, []),
        ("hello source:other", {}, [("w3", "a")]),
    ],
)
def test_messages(archive, text, options, expected):
    assert hits(archive, text, **options) == expected


def test_conversations(archive):
    assert found(archive, "hello") == {"w1": (2, 20.0), "w2": (0, 60.0), "w3": (1, 10.0)}
    assert found(archive, "hello scope:message", path="all") == {"w1": (3, 30.0), "w3": (1, 10.0)}
    assert set(found(archive, "-branch")) == {"w1", "w2", "w3"}
    assert set(found(archive, "-branch", path="all")) == {"w2", "w3"}
    assert set(found(archive, "role:tool")) == {"w1"}
    assert set(found(archive, "source:conversations")) == {"w1", "w2"}
    assert set(found(archive, "title:latin role:user")) == {"w1"}
    assert [r.conversation_id for r in search.search_conversations(archive, parse_query("")).collect()] == ["w2", "w1", "w3"]


@pytest.mark.parametrize("sort, first", [("relevance", "w2"), ("oldest", "w3"), ("created", "w2"), ("updated", "w2"), ("title", "w3")])
def test_orders(archive, sort, first):
    assert search.search_conversations(archive, parse_query("hello"), sort).first().conversation_id == first


def test_scores_and_order(archive):
    rows = search.search_messages(archive, parse_query('hello "hello c++"', path="all")).collect()
    assert [(r.node_id, r.score, list(r.reasons)) for r in rows] == [("a", 62.0, ["current path", "exact phrase", "message match", "substring"])]
    assert rows[0].match.offset == 0 and rows[0].match.length == 9
    display = search.search_messages(archive, parse_query("hello"), order="display").where("conversation_id = 'w1'").collect()
    assert [r.node_id for r in display] == ["a", "c"]


def test_relations(archive):
    one, two = set(hits(archive, "hello", path="all")), set(hits(archive, "hello only", path="all"))
    assert two <= one
    assert set(hits(archive, "plain or rules", path="all")) == set(hits(archive, "plain", path="all")) | set(hits(archive, "rules", path="all"))
    counts = reader.visibility_counts(archive).collect()
    assert all(r.total == r.visible_total + r.empty_hidden_count + r.internal_hidden_count for r in counts)


@pytest.mark.parametrize("text", ["hello", '"hello rules"', "branch or rules", "hello -only", "ab"])
def test_index_changes_nothing(archive, text):
    q = parse_query(text, path="all")
    by_index = search.message_hits(index.narrowed(archive, index.build(archive), q), q)
    assert sorted((r.conversation_id, r.node_id) for r in by_index.collect()) == hits(archive, text, path="all")


def test_index_plan():
    assert index.plan(parse_query("ab")) is None
    assert index.plan(parse_query("abc or ab")) is None
    assert index.plan(parse_query("abc def")) == [["abc", "def"]]
    assert index.plan(parse_query("abc or def", exact="xyz")) == [["abc", "xyz"], ["def", "xyz"]]


def test_bm25(archive):
    rows = {r.node_id + r.conversation_id: r.bm25 for r in index.bm25(archive, parse_query("hello")).collect()}
    assert set(rows) == {"aw1", "cw1", "dw1", "aw3"} and all(x < 0 for x in rows.values())
    q = parse_query("hello", path="all")
    scored = search.search_messages(archive, q, bm25=index.bm25(archive, q)).collect()
    assert [r.bm25 for r in scored] == sorted(r.bm25 for r in scored)


@pytest.mark.parametrize("text", ["hello", "hello rules", '"hello rules" plain', "zzz", "ab"])
def test_bm25_from_postings(archive, text):
    q = parse_query(text)
    plain, by_index = (sorted((r.conversation_id, r.node_id, round(r.bm25, 9)) for r in index.bm25(archive, q, p).collect()) for p in (None, index.build(archive)))
    assert plain == by_index


def test_scan_in_stretches(archive):
    found = search.message_hits(archive, parse_query("hello", path="all"))
    last = search.last_key(found).first()
    assert (last.conversation_id, last.node_id) == max((r.conversation_id, r.node_id) for r in found.collect())
    assert not search.after_key(found, *last).count()
    assert tuple(search.last_key(found.limit(0)).first()) == (None, None)


def test_enrichment(archive):
    q = parse_query("hello", path="all")
    rows = {r.conversation_id: r for r in search.enrich(archive, q, search.search_conversations(archive, q).select("conversation_id")).collect()}
    assert [s.node_id for s in rows["w1"].snippets] == ["a", "c", "d"] and rows["w1"].has_branch_hits and rows["w1"].has_internal_hits
    assert rows["w2"].snippets is None and not rows["w2"].has_internal_hits


def test_reader(archive):
    page = reader.get_messages(archive, "w1", limit=2, q=parse_query("hello")).collect()
    assert [(r.node_id, [(x.start, x.end) for x in r.highlight_ranges]) for r in page] == [("a", [(0, 5)]), ("b", [])]
    assert [r.node_id for r in reader.get_messages(archive, "w1", include_internal=False).collect()] == ["a", "b"]
    assert [r.node_id for r in reader.get_messages(archive, "w1", path="all", limit=2, around="d").collect()] == ["c", "d"]
    assert [r.node_id for r in reader.get_messages(archive, "w1", path="all", limit=2, offset=1).collect()] == ["b", "c"]
    t = reader.around_target(archive, "w1", "d").first()
    assert (t.found, t.in_effective_collection, t.in_requested_collection, t.visible) == (True, False, False, False)
    assert reader.display_chunk(archive, "w1", "a", 6, 3).first().chunk == "C++"
    copied = reader.copy_messages(archive, "w1", ["b", "a", "none"]).first()
    assert copied.text.startswith("assistant:\nGeneral") and copied.text.endswith("user:\nHello C++ and gpt-5.5") and copied.missing == 1
    assert reader.get_conversation(archive, "w3").first().current_collection_source == "fallback_all"


def test_pages(archive):
    rows = search.list_conversations(archive)
    assert [r.conversation_id for r in search.page(rows, 1, 1).collect()] == ["w1"]
    assert search.page_info(3, 1, 1, 1) == {"total": 3, "limit": 1, "offset": 1, "has_more": True, "next_offset": 2}
    assert [r.conversation_id for r in search.suggest(archive, "TITLE").collect()] == ["w1"]
    assert search.diagnostics(parse_query("-x"))["kind"] == "filter"


def test_projections(archive, spark):
    from talktree.operators import verify

    long = archive.conversations.withColumn("title", F.repeat(F.lit("x"), 5000))
    row = search.summaries(long).first()
    assert (len(row.title), row.title_truncated, row.title_length, row.source_file_truncated) == (4096, True, 5000, False)
    assert {r.total_rows for r in search.with_total(archive.conversations).collect()} == {3}
    assert search.has_more(archive.conversations, 2) and not search.has_more(archive.conversations, 2, 1)
    raw = archive.nodes.withColumn("raw_message_json", F.lit('{"id": 1, "metadata": {"secret": 2}, "content": "c"}'))
    preview = reader.raw_preview(Archive(archive.conversations, raw), "w1", "a").first()
    assert preview.raw_preview == '{"content":"c","id":1}' and not preview.raw_preview_truncated
    lost = Archive(archive.conversations.where("conversation_id <> 'w1'"), archive.nodes)
    assert [r.node_id for r in verify.violation_samples(lost, 2).collect()] == ["a", "b"]


def test_sql_functions(spark):
    from talktree.functions.register import register

    assert "search_norm" in register(spark)
    row = spark.sql("SELECT search_norm('ＡＢ  c') a, search_match('The cat', 'CAT', 'word') b, search_match('cats', 'cat', 'word') c, display_text('', '{\"content\":{\"content_type\":\"text\",\"parts\":[\"p\"]}}') d, id_is_safe('a\\n') e").first()
    assert (row.a, row.b, row.c, row.d, row.e) == ("ab c", True, False, "p", False)


def test_postings_take_one_python_step(spark, archive):
    """A task of the index holds one Python worker, not one for each derived column besides."""
    plan = index.build(archive)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
    texts = ["Plain  Text", "ﬁne Ｆｕｌｌ", None, "", "[non-text content: x]", "a\0bc", "ab"]
    raws = [None, None, '{"content":{"content_type":"text","parts":["Found É"]}}', None, '{"content":{"content_type":"text","parts":["shown"]}}', None, "{}"]
    rows = spark.createDataFrame([(f"c{i}", "n", t, r) for i, (t, r) in enumerate(zip(texts, raws))], "conversation_id string, node_id string, content_text string, raw_message_json string")
    other = Archive(rows.select("conversation_id").distinct(), rows)
    stored = Archive(other.conversations, other.texts)
    assert sorted(map(repr, index.build(other).collect())) == sorted(map(repr, index.build(stored).collect())) != []
