"""Inputs in chunks and by member, the file sink, and snapshots as parts."""

import contextlib
import io
import json
import os
import random
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from talktree.operators import index, search
from talktree.operators.store import FANOUT, SnapshotConflict, Store, mergeable
from talktree.plans.query import parse_query
from talktree.sources import exports, files, members
from talktree.sources.framing import frame
from talktree.sources.sink import write_rows
from tests.test_import_export import conversation, zipped


def framed(raw, n, **limit):
    return list(frame((raw[i : i + n] for i in range(0, len(raw), n)), **limit))


def test_elements_are_the_same_for_any_chunks():
    rng = random.Random(1)

    def value(depth=0):
        kind = rng.randrange(7 if depth < 3 else 4)
        if kind < 3:
            return "".join(rng.choices('ab"\\[]{},é日\n', k=rng.randrange(12)))
        if kind == 3:
            return rng.choice([None, True, -1.5e3, 7])
        if kind == 4:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        return {f'{i}"': value(depth + 1) for i in range(rng.randrange(4))}

    for t in range(60):
        want = [value() for _ in range(rng.randrange(6))]
        raw = b"\xef\xbb\xbf" * (t % 2) + b" " * (t % 3) + json.dumps(want, ensure_ascii=t % 2 == 0, indent=t % 4 or None).encode() + b"\n"
        raw = raw if not (t % 2 and t % 3) else raw.replace(b"\xef\xbb\xbf" + b" " * (t % 3), b"\xef\xbb\xbf", 1)
        for n in (1, 2, 3, 7, 5000):
            got = framed(raw, n)
            assert [json.loads(x) for _, x, _ in got] == want and [i for i, *_ in got] == list(range(len(want))) and not any(p for *_, p in got)


@pytest.mark.parametrize("n", [1, 4, 1000])
def test_what_is_wrong_is_told_in_its_place(n):
    assert framed(b'[1,"\xff",{"a":1}, ,3] x', n) == [(0, "1", None), (1, None, "invalid_utf8"), (2, '{"a":1}', None), (3, "", None), (4, "3", None), (5, None, "text_after_array")]
    assert framed(b'["' + b"a" * 50 + b'",2]', n, limit=20) == [(0, None, "element_too_large"), (1, "2", None)]
    assert framed(b"[1,2", n) == [(0, "1", None), (1, "2", None), (2, None, "array_not_closed")]
    for raw in (b"{}", b"", b"  ", b"\xff\xfe[\0]\0"):
        assert framed(raw, n) == [(0, None, "top_level_not_array")]
    assert framed(b"[]", n) == framed(b" [ ]\n", n) == [] and framed(b"[1,]", n) == [(0, "1", None)]


def test_members_and_elements_of_a_zip(spark, tmp_path):
    good = [conversation(), conversation("c2")]
    path = zipped(tmp_path / "x.zip", {"conversations-1.json": good, "conversations-0.json": [5, conversation("c3")], "a/chat.html": "h", "naïve #1%.txt": "x"})
    found = members.members(spark, path)
    assert {r.path: r.file_type for r in found.collect()} == {"conversations-1.json": "json", "conversations-0.json": "json", "a/chat.html": "html", "naïve #1%.txt": "other"}
    assert {r.path: r.sha256 for r in found.collect()} == {r.path: r.sha256 for r in exports.read_members(spark, path).collect()}
    rows = members.elements(spark, path, ["conversations-0.json", "conversations-1.json"])
    assert rows.rdd.getNumPartitions() == 2
    plain = exports.read_elements(exports.selected_sources(exports.read_members(spark, path)))
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr) and rows.count() == 4
    assert [(r.array_index, r.warning_type) for r in exports.invalid_sample(rows).collect()] == [(0, "invalid_element_type")]


def test_a_damaged_member_is_told(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("conversations.json", json.dumps([conversation(str(i)) for i in range(50)]))
    data = bytearray(raw.getvalue())
    data[len(data) // 2] ^= 0xFF
    (tmp_path / "d.zip").write_bytes(bytes(data))
    path = f"file://{tmp_path / 'd.zip'}"
    assert members.members(spark, path).first().problem == "zip_member_damaged"
    assert members.elements(spark, path, ["conversations.json"]).where("problem is not null").first().problem in ("zip_member_damaged", "invalid_utf8", "array_not_closed")


def test_limits_hold_before_a_member_is_read(spark, tmp_path, monkeypatch):
    def check(name):
        with files.opened(str(tmp_path / name)) as f:
            return members.zip_members(f)

    zipped(tmp_path / "ok.zip", {f"f{i}": "x" for i in range(5)})
    assert len(check("ok.zip")) == 5
    plain = (tmp_path / "ok.zip").read_bytes()
    comment = b"PK\x05\x06 in a comment " * 9
    assert members.directory_extent(io.BytesIO(plain[:-2] + len(comment).to_bytes(2, "little") + comment))[0] == 5
    monkeypatch.setattr(members, "MAX_MEMBERS", 4)
    with pytest.raises(ValueError, match="zip_member_limit_exceeded"):
        check("ok.zip")
    monkeypatch.undo()
    monkeypatch.setattr(members, "MAX_NAME_BYTES", 1)
    with pytest.raises(ValueError, match="zip_name_too_long"):
        check("ok.zip")
    monkeypatch.undo()
    raw = (tmp_path / "ok.zip").read_bytes()
    (tmp_path / "cut.zip").write_bytes(raw[:40])
    (tmp_path / "torn.zip").write_bytes(raw[100:])
    for name, why in (("cut.zip", "zip_end_not_found"), ("torn.zip", "zip_directory_invalid")):
        with pytest.raises(ValueError, match=why):
            check(name)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 3)
    zipped(tmp_path / "big.zip", {f"f{i}": "x" for i in range(6)})  # with a ZIP64 end
    assert len(check("big.zip")) == 6
    zipped(tmp_path / "u.zip", {"../x": "y"})
    with pytest.raises(Exception, match="zip_member_path_unsafe"):
        members.members(spark, str(tmp_path / "u.zip")).count()


def test_import_goes_on_past_bad_bytes(spark, tmp_path, monkeypatch):
    raw = json.dumps([conversation()]).encode()[:-1] + b',"\xff",' + json.dumps(conversation("c2")).encode() + b"]"
    path = zipped(tmp_path / "x.zip", {"conversations.json": raw})
    for streamed in (True, False):
        monkeypatch.setattr(files, "reachable", lambda uri, s=streamed: s)
        store = Store(spark, f"file://{tmp_path / f'store{streamed}'}")
        assert store.import_path(path)["outcomes"] == {"inserted": 2}
        assert [(r.warning_type, r.array_index) for r in store.table("import_warnings").collect()] == [("invalid_utf8", 1)]
        assert store.table("source_files").first().sha256 == store.table("file_index").first().sha256


def test_a_folder_means_its_zip_or_its_files(tmp_path):
    zipped(tmp_path / "x.zip", {"conversations.json": []})
    assert exports.resolve_input(str(tmp_path)) == str(tmp_path / "x.zip") and exports.resolve_input(str(tmp_path / "x.zip")) == str(tmp_path / "x.zip")
    zipped(tmp_path / "y.zip", {})
    with pytest.raises(ValueError, match="several_zip_files"):
        exports.resolve_input(str(tmp_path))
    (tmp_path / "in" / "deep").mkdir(parents=True)
    with pytest.raises(ValueError, match="no_input_found"):
        exports.resolve_input(str(tmp_path / "in"))
    (tmp_path / "in" / "deep" / "conversations-3.json").write_text("[]")
    assert exports.resolve_input(f"file://{tmp_path}/in") == f"file://{tmp_path}/in"


def test_sink_writes_whole_files_or_none(spark, tmp_path):
    folder = tmp_path / "out"
    rows = spark.createDataFrame([("a.txt", "one"), ("a.txt", " two"), ("d/ü #.txt", "x"), ("c.txt", None)], "path string, content string").coalesce(1)
    assert write_rows(rows, f"file://{folder}") == {"written": 3, "unchanged": 0}
    assert (folder / "a.txt").read_text() == "one two" and (folder / "d" / "ü #.txt").read_text() == "x" and (folder / "c.txt").read_bytes() == b""
    assert write_rows(rows.where("path <> 'c.txt'").union(spark.createDataFrame([("c.txt", "new")], rows.schema)), str(folder)) == {"written": 1, "unchanged": 2}
    bad = spark.createDataFrame([("e.txt", "y"), ("../f.txt", "z")], rows.schema).coalesce(1)
    with pytest.raises(Exception, match="output_path_unsafe"):
        write_rows(bad, str(folder))
    assert sorted(os.listdir(folder)) in (["a.txt", "c.txt", "d"], ["a.txt", "c.txt", "d", "e.txt"]) and not (tmp_path / "f.txt").exists()
    assert write_rows(rows.repartition(3, "path"), str(tmp_path / "z"), "zip")["written"] == 3
    assert {r.path: r.size for r in members.members(spark, str(tmp_path / "z")).collect()} == {"a.txt": 7, "d/ü #.txt": 1, "c.txt": 0}
    assert write_rows(rows.limit(0), str(tmp_path / "none")) == {"written": 0, "unchanged": 0}


def elements(spark, values):
    return spark.createDataFrame([("conversations.json", i, json.dumps(v)) for i, v in enumerate(values)], "source_file string, array_index long, element string")


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet") and "import" not in os.path.basename(d))


def test_an_import_writes_what_changed(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    rng = random.Random(2)
    reply = lambda: "".join(rng.choices("abcdefghij klmnopqrst", k=8000))
    values = [conversation(f"c{i}", reply=reply()) for i in range(200)]
    store.import_elements(elements(spark, values))
    whole = size_of(tmp_path / "data")
    values[7] = conversation("c7", title="Other", reply=reply())
    out = store.import_elements(elements(spark, values))
    assert out["outcomes"] == {"unchanged": 199, "updated": 1} and out["dirty_domains"] == ["message", "title"]
    assert size_of(tmp_path / "data") - whole < 0.03 * whole
    assert store.table("conversations").where("title = 'Other'").count() == 1 and store.table("nodes").count() == 1000
    assert store.table("conversations", 1).where("title = 'Other'").count() == 0
    assert store.generations() == {"title": 2, "message": 2, "query": 1, "address": 1, "graph": 1}


def test_parts_are_merged_by_tiers(spark, tmp_path):
    assert [mergeable(x) for x in ([], [5], [100, 1, 1], [100, 1, 1, 1, 1], [1, 1, 1, 1], [1000, 10, 10, 10, 1])] == [0, 0, 0, 4, 4, 0]
    rows, copied = [], 0
    for _ in range(300):
        rows.append(1)
        take = mergeable(rows)
        if take:
            copied += sum(rows[-take:])
            rows[-take:] = [sum(rows[-take:])]
    assert sum(rows) == 300 and len(rows) < 4 * FANOUT and copied < 300 * 10
    store = Store(spark, f"file://{tmp_path}")
    for i in range(FANOUT + 1):
        store.import_elements(elements(spark, [conversation(f"c{i}"), conversation("same", title=str(i))]))
    assert len(store._list(store.version())["parts"]["nodes"]) < FANOUT
    assert {r.conversation_id: r.title for r in store.table("conversations").collect()} == {f"c{i}": "First" for i in range(FANOUT + 1)} | {"same": str(FANOUT)}
    assert store.table("nodes").count() == 5 * (FANOUT + 2) and store.table("conversations", 2).where("conversation_id = 'same'").first().title == "1"
    before = sorted(map(tuple, store.table("nodes").collect()), key=repr)
    assert store.vacuum(keep=1) > 0 and len(store.versions()) == 1
    assert sorted(map(tuple, Store(spark, store.folder).table("nodes").collect()), key=repr) == before


def test_of_two_writers_one_wins(spark, tmp_path):
    store, other = (Store(spark, f"file://{tmp_path}") for _ in range(2))
    store.import_elements(elements(spark, [conversation()]))
    base = store.version()
    log = spark.createDataFrame([("c1", "md", "x", "h", "t", "{}")], store.table("exports").schema)
    assert store.publish({"exports": log}, base) == base + 1
    kept = sorted(os.listdir(tmp_path / "data"))
    with pytest.raises(SnapshotConflict):
        other.publish({"exports": log.union(log)}, base)
    assert sorted(os.listdir(tmp_path / "data")) == kept and os.listdir(tmp_path / "attempts") == []
    assert store.table("exports", base + 1).count() == 1 and store.table("conversations", base + 1).count() == 1
    runs = [threading.Thread(target=Store(spark, store.folder).import_elements, args=(elements(spark, [conversation(f"t{i}"), conversation("both", title=str(i))]),)) for i in range(3)]
    for r in runs:
        r.start()
    for r in runs:
        r.join()
    assert {r.conversation_id for r in store.table("conversations").collect()} == {"c1", "both", "t0", "t1", "t2"}
    assert store.table("import_runs").count() == 4 and other.append("exports", log) == store.version() and store.table("exports").count() == 2


def test_of_writers_at_the_same_moment_one_wins(spark, tmp_path):
    gate = threading.Barrier(8)

    class Waiting(Store):
        def _snapshot(self, version):
            gate.wait(60)
            return super()._snapshot(version)

    for t in range(80):
        folder, won = f"file://{tmp_path}/{t}", []

        def write(i, folder=folder, won=won):
            with contextlib.suppress(SnapshotConflict):
                Waiting(spark, folder)._commit(0, {"exports": [{"id": str(i), "rows": 0}]}, [])
                won.append({"id": str(i), "rows": 0})

        runs = [threading.Thread(target=write, args=(i,)) for i in range(8)]
        for r in runs:
            r.start()
        for r in runs:
            r.join()
        assert won == Store(spark, folder)._list(1)["parts"]["exports"] and os.listdir(tmp_path / str(t) / "snapshot-000001") == ["layout"]


def test_the_index_follows_the_imports(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    assert store.indexed()[1] is None
    store.import_elements(elements(spark, [conversation(f"c{i}", reply="needle in hay 🙂 needles" if i % 2 else "straw") for i in range(6)]))
    store.build_index()
    first = set(os.listdir(tmp_path / "data"))
    times = {d: os.path.getmtime(tmp_path / "data" / d / "index") for d in first if (tmp_path / "data" / d / "index").exists()}
    store.import_elements(elements(spark, [conversation("c1", reply="straw"), conversation("c2", reply="a needle"), conversation("n", title="Needle")]))
    assert store.indexed()[1] is None and store.has_index(1)
    store.build_index()
    assert times == {d: os.path.getmtime(tmp_path / "data" / d / "index") for d in times}
    whole = Store(spark, f"file://{tmp_path}/whole")
    whole.publish({n: store.table(n) for n in ("conversations", "nodes")})
    whole.build_index()
    (a, p), (b, o) = store.indexed(), whole.indexed()
    rows = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    assert rows(p) == rows(o) and rows(a.paths) == rows(b.paths) and rows(store.lengths()) == rows(whole.lengths())
    for text in ("needle", "needle hay", '"in hay 🙂"', "straw needles", "question 🙂 n"):
        q = parse_query(text, path="all")
        scan = {tuple(r)[:2]: round(r.bm25, 9) for r in index.bm25(store.archive(), q).collect()}
        assert {tuple(r)[:2]: round(r.bm25, 9) for r in index.bm25_postings(a, p, q, store.lengths()).collect()} == scan
        assert rows(search.message_hits(index.narrowed(a, p, q), q).select("conversation_id", "node_id")) == rows(search.message_hits(store.archive(), q).select("conversation_id", "node_id"))
    for text in ("needle", "needle -straw", '"in hay 🙂" or straw', 'exact answer', "question title:first", "ne"):
        for path in ("all", "current"):
            q = parse_query(text, path=path)
            page = index.relevance_page(a, p, q, 5, store.lengths())
            if text == "ne":
                assert page is None
                continue
            want = search.search_messages(a, q, bm25=index.bm25(store.archive(), q)).limit(5).select("conversation_id", "node_id", "score", "snippet").collect()
            assert page.select("conversation_id", "node_id", "score", "snippet").collect() == want
    plan = index.bm25_postings(a, p, parse_query("needle"), store.lengths())._jdf.queryExecution().executedPlan().toString()
    assert "In(trigram" in plan and "content_text" not in plan


def test_postings_by_blocks(spark, monkeypatch):
    from talktree.operators.archive import Archive

    rng = random.Random(4)
    texts = ["", "ab", "abc", "aaaaa", "🙂🙂🙂🙂"] + ["".join(rng.choices("ab🙂é ", k=rng.randrange(40))) for _ in range(60)]
    rows = spark.createDataFrame([(f"c{i}", "n", t, t) for i, t in enumerate(texts)], "conversation_id string, node_id string, text string, norm string").coalesce(1)
    want = {(t[k : k + 3], f"c{i}"): [j for j in range(len(t) - 2) if t[j : j + 3] == t[k : k + 3]] for i, t in enumerate(texts) for k in range(len(t) - 2)}
    got = index.build(Archive(rows, rows)).collect()
    assert {(r.trigram, r.conversation_id): r.positions for r in got} == want and len(got) == len(want)
    assert all(r["size"] == len(texts[int(r.conversation_id[1:])]) - 2 for r in got)
    assert rows.select(F.count("*")).first()[0] == len(texts)


def test_small_files_share_a_task(tmp_path):
    import json

    for i in range(50):
        (tmp_path / f"conversations-{i}.json").write_text(json.dumps([{"id": str(i)}]))
    (tmp_path / "conversations-50.json").write_text(json.dumps(["x" * members.ELEMENT_TASK_BYTES]))
    reader = members.ExportReader({"what": "elements", "path": f"file://{tmp_path}"})
    parts = reader.partitions()
    assert len(parts) <= 3 and sum(len(p.members) for p in parts) == 51
    assert sorted(path for p in parts for b in reader.read(p) for path in b.column("source_file").to_pylist()) == sorted(f"conversations-{i}.json" for i in range(51))


def test_stored_postings_are_packed(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    store.import_elements(elements(spark, [conversation(f"c{i}", reply="the same words") for i in range(40)]))
    store.build_index()
    archive, postings = store.indexed()
    stored = spark.read.parquet(*(str(p) for p in (tmp_path / "data").glob("*/index/postings")))
    assert stored.count() < postings.count() / 10
    key = lambda r: (r.trigram, r.conversation_id, r.node_id, r.positions, r["size"])
    assert sorted(map(key, postings.collect())) == sorted(map(key, index.build(archive).collect())) != []


def test_a_first_import_compares_with_nothing(spark, tmp_path, monkeypatch):
    from talktree.operators import store as module

    asked = []
    monkeypatch.setattr(module, "node_changes", lambda *a, f=module.node_changes: asked.append(1) or f(*a))
    store = Store(spark, f"file://{tmp_path}")
    first = store.import_elements(elements(spark, [conversation("c1"), conversation("c2")]))
    assert first["outcomes"] == {"inserted": 2} and first["dirty_domains"] == ["address", "graph", "message", "query", "title"] and asked == []
    then = store.import_elements(elements(spark, [conversation("c1"), conversation("c2", reply="other")]))
    assert then["outcomes"] == {"unchanged": 1, "updated": 1} and then["dirty_domains"] == ["message"] and asked == [1]


def test_few_small_files_are_spread(tmp_path):
    for i in range(20):
        (tmp_path / f"conversations-{i:02}.json").write_text(json.dumps([{"id": str(i)}]))
    options = {"what": "elements", "path": f"file://{tmp_path}"}
    sizes = {n: [len(p.members) for p in members.ExportReader(options | {"tasks": n}).partitions()] for n in ("1", "4", "50")}
    assert sizes["1"] == [20] and 4 <= len(sizes["4"]) <= 8 and sizes["50"] == [1] * 20 and sum(sizes["4"]) == 20
    assert members.ExportReader(options | {"only": "[]", "tasks": "4"}).partitions() == []
