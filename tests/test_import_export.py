"""Imports, snapshots, exports and the stream."""

import hashlib
import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from talktree.operators import export, verify
from talktree.operators.ingest import MAX_NODES, parse_element, problem
from talktree.operators.store import Store
from talktree.sources.exports import _split_array, is_metadata_path, read_members, selected_sources
from talktree.streaming.imports import import_stream


def message(i, role, parts, t=0.0, kind="text"):
    return {"id": i, "author": {"role": role}, "create_time": t, "content": {"content_type": kind, "parts": parts}}


def conversation(cid="c1", title="First", reply="answer"):
    return {
        "id": cid, "title": title, "create_time": 1.0, "update_time": 2.0, "current_node": "a2",
        "mapping": {
            "root": {"id": "root", "parent": None, "children": ["u1"], "message": None},
            "u1": {"id": "u1", "parent": "root", "children": ["a1", "branch"], "message": message("m1", "user", ["question"], 3.0)},
            "a1": {"id": "a1", "parent": "u1", "children": ["a2"], "message": message("m2", "assistant", [reply], 4.0)},
            "a2": {"id": "a2", "parent": "a1", "children": [], "message": message("m3", "assistant", ["one", "two"], 5.0)},
            "branch": {"id": "branch", "parent": "u1", "children": [], "message": message("m4", "tool", ["side"], 6.0)},
        },
    }


def zipped(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, value in members.items():
            z.writestr(name, value if isinstance(value, (str, bytes)) else json.dumps(value))
    return f"file://{path}"


def test_array_elements():
    text = '[{"a": 1}, {"b": }, "x, y", 3, [1, 2], NaN, {"c": "]"}]'
    assert list(_split_array(text)) == ['{"a": 1}', '{"b": }', '"x, y"', "3", "[1, 2]", "NaN", '{"c": "]"}']
    assert list(_split_array(" [ ] ")) == []
    with pytest.raises(ValueError):
        list(_split_array("{}"))


@pytest.mark.parametrize(
    "value, kind",
    [
        (3, "invalid_element_type"), ({}, "missing_id"), ({"id": []}, "invalid_conversation_id"), ({"id": "a"}, "missing_mapping"), ({"id": "a", "mapping": 1}, "invalid_mapping_type"),
        ({"id": "a", "mapping": {}}, "empty_mapping"), ({"id": "a", "mapping": {str(i): {} for i in range(MAX_NODES + 1)}}, "conversation_node_limit_exceeded"),
        ({"id": "a", "mapping": {"": {}}}, "canonical_id_empty"), ({"id": "a", "mapping": {"x" * 600: {}}}, "canonical_id_too_long"), ({"id": "a", "mapping": {"x\n": {}}}, "canonical_id_invalid_unicode"),
    ],
)
def test_problems(value, kind):
    assert problem(value)[0] == kind
    assert parse_element(json.dumps(value), "f", 0)[0] is None


def test_parse_element():
    c, nodes, notes = parse_element(json.dumps(conversation()), "conversations.json", 4)
    by = {n["node_id"]: n for n in nodes}
    assert (c["conversation_id"], c["title"], c["source_array_index"], c["current_node"]) == ("c1", "First", 4, "a2") and not notes
    assert [n for n in by if by[n]["is_on_current_path"]] == ["root", "u1", "a1", "a2"]
    assert by["a2"]["content_text"] == "one\n\ntwo" and by["root"]["raw_message_json"] is None
    again = parse_element(json.dumps(conversation()), "other.json", 0)[0]
    assert again["aggregate_hash"] == c["aggregate_hash"] != parse_element(json.dumps(conversation(reply="x")), "f", 0)[0]["aggregate_hash"]
    odd = conversation() | {"title": ["no"], "create_time": "soon", "current_node": "nowhere"}
    assert [k for k, *_ in parse_element(json.dumps(odd), "f", 0)[2]] == ["invalid_title_type", "current_node_missing", "invalid_timestamp"]
    assert [k for k, *_ in parse_element('{"id": NaN}', "f", 0)[2]] == ["invalid_json"]


def test_sources(spark, tmp_path):
    path = zipped(tmp_path / "x.zip", {"conversations.json": [], "conversations-2.json": [], "d/conversations-10.json": [], "chat.html": "h", "__MACOSX/conversations-3.json": "{}"})
    members = read_members(spark, path)
    assert {r.path: r.file_type for r in members.collect()} == {"conversations.json": "json", "conversations-2.json": "json", "d/conversations-10.json": "json", "chat.html": "html"}
    assert [r.path for r in selected_sources(members).collect()] == ["conversations-2.json", "d/conversations-10.json"]
    twice = zipped(tmp_path / "y.zip", {"conversations-1.json": [], "d/conversations-1.json": []})
    with pytest.raises(ValueError, match="duplicate"):
        selected_sources(read_members(spark, twice))
    assert is_metadata_path("a/._b") and not is_metadata_path("a/b")


def test_import_twice_and_export(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path / 'store'}")
    assert store.version() == 0 and store.archive().conversations.count() == 0
    first = zipped(tmp_path / "1.zip", {"conversations-0.json": [conversation(), 5], "conversations-1.json": [conversation("c2"), conversation(title="Later")]})
    out = store.import_path(first)
    assert out["outcomes"] == {"inserted": 2}
    assert {r.warning_type: r["count"] for r in verify.warning_counts(store.table("import_warnings")).collect()} == {"duplicate_conversation_id": 1, "invalid_element_type": 1}
    assert {r.conversation_id: r.title for r in store.table("conversations").collect()} == {"c1": "Later", "c2": "First"}
    assert store.layout() == 1 and not verify.schema_problems({n: store.table(n) for n in ("conversations", "nodes", "import_runs", "source_files", "file_index", "import_warnings", "exports")})

    again = store.import_path(first)
    assert again["outcomes"] == {"unchanged": 2} and again["dirty_domains"] == []
    second = store.import_path(zipped(tmp_path / "2.zip", {"conversations.json": [conversation(title="Later", reply="new")]}))
    assert second["outcomes"].get("kept") == 1 and second["outcomes"].get("updated") == 1 and "message" in second["dirty_domains"]
    assert store.table("nodes").where("conversation_id = 'c1' and node_id = 'a1'").first().content_text == "new"
    assert store.table("nodes", 1).where("conversation_id = 'c1' and node_id = 'a1'").first().content_text == "answer"

    archive = store.archive()
    report = verify.verify(archive, store.table("import_warnings"))
    assert report["ok"] and report["conversations"] == 2 and report["nodes"] == 10
    texts = {(r.conversation_id, r.format): r.content for r in export.rendered(archive).collect()}
    assert texts["c1", "md"].startswith("# Later\n\n- conversation_id: `c1`\n- create_time: 1970-01-01 00:00:01\n") and texts["c1", "md"].endswith("## Assistant 1970-01-01 00:00:05\n\none\n\ntwo\n")
    assert "side" not in texts["c1", "txt"] and "USER 1970-01-01 00:00:03\n" + "-" * 72 + "\nquestion\n" in texts["c1", "txt"]
    rows = export.write_export(archive, f"file://{tmp_path / 'out'}").collect()
    assert [r.output_path for r in rows] == sorted(r.output_path for r in rows) and len(rows) == 4
    lines = spark.read.text(f"file://{tmp_path / 'out'}/manifest_jsonl").collect()
    assert [list(json.loads(r.value)) for r in lines] == [export.MANIFEST] * 4
    log = export.export_log(spark.createDataFrame(rows), "2024-01-01", {"path": "current"})
    store.append("exports", log)
    assert export.latest_exports(store.table("exports").union(log)).count() == 4


def test_file_names(spark):
    rows = [("a", "T", 0.0, None), ("A", "T", 0.0, None), ("b", None, None, None), ("x_001", "U", 0.0, None), ("x", "U", 0.0, None), ("X", "U", 0.0, None)]
    df = spark.createDataFrame(rows, "conversation_id string, title string, create_time double, update_time double")
    names = [(r.conversation_id, r.output_path) for r in export.file_names(df, ("md",)).collect()]
    assert len({n.casefold() for _, n in names}) == len(rows)
    assert dict(names)["b"] == "undated_untitled_b.md" and {dict(names)["a"], dict(names)["A"]} == {"1970-01-01_T_a_002.md", "1970-01-01_T_A_001.md"}


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    store = Store(spark, f"file://{tmp_path / 'store'}")
    for i, value in enumerate(([conversation()], [conversation(title="Second"), conversation("c9")])):
        (folder / f"conversations-{i}.json").write_text(json.dumps(value))
        import_stream(spark, f"file://{folder}", store, f"file://{tmp_path / 'mark'}").awaitTermination()
    assert {r.conversation_id: r.title for r in store.table("conversations").collect()} == {"c1": "Second", "c9": "First"}
    assert store.table("import_runs").count() == 2


def test_verify_finds_damage(spark, tmp_path):
    from talktree.operators.archive import Archive

    c = spark.createDataFrame([("a", "x", float("nan"), None), ("b", None, 0.0, float("inf"))], "conversation_id string, current_node string, create_time double, update_time double")
    n = spark.createDataFrame([("a", "y", "gone", 0.0, None, 0, "[]", None), ("zz", "q", None, 0.0, None, 0, '["bad\\n"]', "m")], "conversation_id string, node_id string, parent_node_id string, create_time double, update_time double, is_on_current_path int, children_json string, message_id string")
    archive = Archive(c, n)
    report = verify.verify(archive)
    assert not report["ok"]
    assert [report[k] for k in ("missing_current_node", "broken_parent_links", "conversations_with_zero_nodes", "foreign_key_violations", "non_finite_timestamps")] == [1, 1, 1, 1, 2]
    assert {r.field: r.incompatible for r in verify.unsafe_ids(archive).collect()}["children"] == 1
    assert verify.schema_problems({})[0] == "missing table: conversations"


def test_zip_reader_keeps_bytes(spark, tmp_path):
    raw = io.BytesIO(b"\x00\xff").getvalue()
    row = read_members(spark, zipped(tmp_path / "b.zip", {"p.png": raw})).first()
    assert bytes(row.content) == raw and row.file_type == "image" and row.size == 2
    assert read_members(spark, zipped(tmp_path / "c.zip", {"p.png": raw})).select(F.length("sha256")).first()[0] == 64


def test_index_of_a_snapshot_and_files(spark, tmp_path):
    from talktree.operators import index, search
    from talktree.plans.query import parse_query

    store = Store(spark, f"file://{tmp_path / 'store'}")
    store.import_path(zipped(tmp_path / "1.zip", {"conversations.json": [conversation(), conversation("c2", reply="needle in hay")]}))
    assert store.indexed()[1] is None
    store.build_index()
    archive, postings = store.indexed()
    q = parse_query("needle")
    hits = search.message_hits(index.narrowed(archive, postings, q), q).select("conversation_id", "node_id").collect()
    assert hits == search.message_hits(store.archive(), q).select("conversation_id", "node_id").collect() and len(hits) == 1
    assert "ArrowEvalPython" not in search.message_hits(archive, q)._jdf.queryExecution().executedPlan().toString()

    content = export.rendered(store.archive()).join(export.file_names(store.archive().conversations), ["conversation_id", "format"])
    folder = str(tmp_path / "files")
    assert export.write_files(content, folder) == {"written": 4, "unchanged": 0}
    assert export.write_files(content, folder) == {"written": 0, "unchanged": 4}
    assert sorted(p.suffix for p in (tmp_path / "files").iterdir()) == [".md", ".md", ".txt", ".txt"]
    rows = export.manifest(store.archive(), export.rendered(store.archive()))
    log = export.export_log(rows, "2024-01-01", {})
    assert export.changed(rows, log).count() == 0 and export.changed(rows, log.limit(0)).count() == 4


def test_command_line(spark, tmp_path, capsys):
    from talktree.__main__ import main

    place = f"file://{tmp_path / 'store'}"
    source = zipped(tmp_path / "1.zip", {"conversations.json": [conversation(), conversation("c2", title="Other")]})
    run = lambda *a: (main([place, *a], spark), [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")])
    assert run("import", source)[1][0]["outcomes"] == {"inserted": 2}
    assert run("inspect", source)[1][-1]["elements"] == 2
    assert run("stats")[1][0]["nodes"] == 10 and run("verify")[0] == 0
    assert [r["conversation_id"] for r in run("list", "--sort", "title")[1]] == ["c1", "c2"]
    assert [r["conversation_id"] for r in run("search", "question title:other")[1]] == ["c2"]
    main([place, "index"], spark)
    assert {r["node_id"] for r in run("search", "answer", "--messages")[1]} == {"a1"}
    assert run("search", "role:nobody")[0] == 2
    assert [r["node_id"] for r in run("show", "c1", "--hide-internal")[1]] == ["u1", "a1", "a2"]
    assert run("export", str(tmp_path / "out"), "--format", "md")[1] == [{"written": 2, "unchanged": 0}]


def test_layout_and_input_hash(spark, tmp_path):
    from talktree.operators.store import input_sha256

    store = Store(spark, f"file://{tmp_path / 'store'}")
    source = zipped(tmp_path / "1.zip", {"conversations.json": [conversation()]})
    out = store.import_path(source)
    assert out["input_sha256"] == hashlib.sha256((tmp_path / "1.zip").read_bytes()).hexdigest()
    rows = [("b", "00ff"), ("a", "00ff"), ("c", "1234")]
    hashes = {input_sha256(spark.createDataFrame(r, "path string, sha256 string")) for r in (rows, rows[::-1])}
    assert len(hashes) == 1 and hashes != {input_sha256(spark.createDataFrame(rows[1:], "path string, sha256 string"))}
    assert input_sha256(spark.createDataFrame([], "path string, sha256 string")) is None
    spark.createDataFrame([('{"schema_version": 99}',)], "value string").coalesce(1).write.mode("overwrite").text(f"{store.folder}/snapshot-000001/layout")
    with pytest.raises(ValueError, match="unsupported_schema_version"):
        Store(spark, store.folder).archive()


def test_manifest_pair(spark, tmp_path, monkeypatch):
    row = dict.fromkeys(export.MANIFEST, "x") | {"include_internal": True, "create_time": None}
    kinds = ", ".join(f"{n} {'boolean' if n == 'include_internal' else 'string'}" for n in export.MANIFEST)
    rows = spark.createDataFrame([tuple(row[n] for n in export.MANIFEST)], kinds)
    folder = tmp_path / "out"
    export.write_manifests(rows.limit(0), str(folder))
    before = {p.name: p.read_text() for p in folder.iterdir()}
    assert before == {"manifest.jsonl": "", "manifest.csv": ",".join(export.MANIFEST) + "\n"}
    replace = os.replace

    def failing(old, new):
        if old.endswith(".part-manifest.csv"):
            raise OSError("no space")
        replace(old, new)

    monkeypatch.setattr(export.os, "replace", failing)
    with pytest.raises(OSError):
        export.write_manifests(rows, str(folder))
    assert {n: (folder / n).read_text() for n in before} == before
    monkeypatch.undo()
    export.write_manifests(rows, str(folder))
    assert json.loads((folder / "manifest.jsonl").read_text()) == row and len((folder / "manifest.csv").read_text().splitlines()) == 2
    assert sorted(p.name for p in folder.iterdir()) == ["manifest.csv", "manifest.jsonl"]


def test_limits(spark, tmp_path):
    from talktree.functions.values import load_json
    from talktree.operators import search
    from talktree.sources.exports import find_input

    for bad in ("[" * 300 + "]" * 300, "[1e999]", "[NaN]", "[" + "1" * 2000 + "]"):
        with pytest.raises(ValueError):
            load_json(bad)
    assert load_json('{"a": [1, "]", 2.5e3, null]}') == {"a": [1, "]", 2500.0, None]}
    bomb = zipped(tmp_path / "b.zip", {"conversations.json": "x"})
    with zipfile.ZipFile(tmp_path / "b.zip", "a", zipfile.ZIP_DEFLATED) as z:
        z.writestr("big", b"0" * 30_000_000)
    with pytest.raises(Exception, match="zip_member_too_large"):
        read_members(spark, bomb).count()
    with pytest.raises(Exception, match="zip_member_path_unsafe"):
        read_members(spark, zipped(tmp_path / "u.zip", {"../x": "y"})).count()
    assert find_input(["a.zip", "x"]) == "a.zip" and find_input(["conversations-3.json"]) == "."
    for names in (["a.zip", "b.zip"], ["x"]):
        with pytest.raises(ValueError):
            find_input(names)
    rows = spark.range(10).selectExpr("id", "repeat('x', 50) as t").coalesce(1)
    assert search.bounded_page(rows, 200).count() == 3 and search.bounded_page(rows, 197).count() == 2


def test_parsed_rows_go_on_in_batches():
    import pyarrow as pa

    from talktree.operators import ingest

    n = 500
    texts = [f'{{"id":"c{i}","mapping":{{"a":{{"id":"a"}}}}}}' for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(["f.json"] * n), pa.array(range(n)), pa.array(texts), pa.array([None] * n, pa.string())], ["source_file", "array_index", "element", "problem"])
    got = list(ingest._parse(iter([batch])))
    assert len(got) <= 2 and sum(b.num_rows for b in got) == 2 * n
    assert [x for b in got for x in b.column("conversation_id").to_pylist()] == [f"c{i}" for i in range(n) for _ in "ab"]
