"""Queries that write inputs, archives and exports from the test tables and read them back, and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talktree.operators import continuation, export, index, ingest, search, store, verify
from talktree.operators.archive import Archive
from talktree.operators.store import Store
from talktree.plans.query import parse_query
from talktree.queries import _manifest_sql, _NODE, BIND, _elements, _export_sql, _has, _MD, _MD_NODE
from talktree.schema import TABLES
from talktree.sources import exports, members
from talktree.sources.bind import bound, turns, work_folder
from talktree.sources.sink import write_rows
from talktree.streaming.imports import import_stream

#: Conversations to a file, so that the number of files grows with the tables.
SHARD = 64
_LIMIT = 200


def _as_files(elements: DataFrame, folder: str, form: str) -> None:
    """Writes (path, place, element) rows as JSON arrays, each a file or a member, element by element."""
    in_file = Window.partitionBy("path").orderBy("place")
    before = F.when(F.row_number().over(in_file) == 1, "[").otherwise(",\n")
    after = F.when(F.lead("place").over(in_file).isNull(), "]").otherwise("")
    pieces = elements.select("path", "place", F.concat(before, F.col("element"), after).alias("content"))
    write_rows(pieces.sortWithinPartitions("path", "place"), folder, form)


def _shard(number: str = "conv_id"):
    return F.concat(F.lit("conversations-"), F.floor(F.col(number) / SHARD).cast("string"), F.lit(".json"))


def _small(spark: SparkSession, sf_dir: str) -> str:
    """A folder of ZIPs: an element with the turns of each conversation, some of them too large and some no JSON."""
    each = turns(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("n"))
    fill = F.when(F.col("conv_id") % 16 == 5, F.repeat(F.lit("é,]"), _LIMIT)).otherwise("a\\\"]")
    text = F.concat(F.lit('{"id":"'), F.col("conv_id").cast("string"), F.lit('","n":'), F.col("n").cast("string"), F.lit(',"x":["'), fill, F.lit('"]}'))
    text = F.when(F.col("conv_id") % 10 == 3, F.lit('{"id":}')).otherwise(text)
    folder = work_folder(spark)
    _as_files(each.select(_shard().alias("path"), F.col("conv_id").alias("place"), text.alias("element")), folder, "zip")
    return folder


_SMALL = f"""WITH e AS (
    SELECT conv_id, 'conversations-' || (conv_id // {SHARD}) || '.json' AS path, CASE WHEN conv_id % 10 = 3 THEN '{{"id":}}' ELSE
        '{{"id":"' || conv_id || '","n":' || n || ',"x":["' || CASE WHEN conv_id % 16 = 5 THEN repeat('é,]', {_LIMIT}) ELSE 'a\\"]' END || '"]}}' END AS element
    FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
)"""


def zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of ZIPs that executors wrote, hashed in chunks."""
    return members.members(spark, _small(spark, sf_dir)).select("path", "size", "sha256", "file_type")


def zip_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that hold conversations, in the order of their numbers."""
    found = exports.selected_sources(members.members(spark, _small(spark, sf_dir)).select("path"))
    return found.select("path", F.col("shard").cast("long").alias("shard"))


def zip_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of ZIPs, one at a time; those beyond a limit are reported in their place."""
    folder = _small(spark, sf_dir)
    paths = [r.path for r in members.members(spark, folder).select("path").collect()]
    return members.elements(spark, folder, paths, _LIMIT).select("source_file", "array_index", "element", "problem")


def invalid_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _small(spark, sf_dir)
    paths = [r.path for r in members.members(spark, folder).select("path").collect()]
    return exports.invalid_sample(members.elements(spark, folder, paths, _LIMIT), 20)


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.duplicate_ids(_elements(spark, sf_dir))


def _whole_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The binding's conversations as export elements in files of SHARD conversations, none twice."""
    rows = _elements(spark, sf_dir).where("array_index < 1000000 and element like '{_%'")
    return rows.select(_shard("array_index").alias("path"), F.col("array_index").alias("place"), "element")


def folder_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of numbered files, imported file by file."""
    folder = work_folder(spark)
    _as_files(_whole_elements(spark, sf_dir), f"{folder}/in", "files")
    store = Store(spark, f"{folder}/store")
    store.import_path(f"{folder}/in")
    return store.table("conversations").select("conversation_id", "title", "source_file", "source_array_index", "last_import_run_id")


def import_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an import notes of its files."""
    folder = work_folder(spark)
    _as_files(_whole_elements(spark, sf_dir), f"{folder}/in", "files")
    store = Store(spark, f"{folder}/store")
    store.import_path(f"{folder}/in")
    files = store.table("file_index").select("import_run_id", "source_path", "extension")
    return store.table("source_files").join(files, ["import_run_id", "source_path"]).select("import_run_id", "source_path", "file_type", "extension", "is_conversation_json", "is_selected_conversation_source")


def _second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth conversation with another title and, after its first text, the word 'thingnder'."""
    a = bound(spark, sf_dir)
    tenth = F.col("conversation_id").cast("long") % 10 == 0
    text = F.when(F.col("node_id") == "000000", F.concat("content_text", F.lit(" thingnder"))).otherwise(F.col("content_text"))
    return _as_elements(Archive(a.conversations.where(tenth).withColumn("title", F.concat(F.lit("new "), "title")), a.nodes.where(tenth).withColumn("content_text", text)))


def _as_elements(archive: Archive) -> DataFrame:
    message = F.struct(F.col("message_id").alias("id"), F.struct(F.col("role")).alias("author"), F.col("create_time"), F.struct(F.lit("text").alias("content_type"), F.array("content_text").alias("parts")).alias("content"))
    node = F.struct(F.col("node_id").alias("id"), F.col("parent_node_id").alias("parent"), F.array().cast("array<string>").alias("children"), message.alias("message"))
    mapping = archive.nodes.groupBy("conversation_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("node_id", node.alias("node"))))).alias("mapping"))
    text = F.to_json(F.struct(F.col("conversation_id").alias("id"), "title", "create_time", "current_node", "mapping"))
    return archive.conversations.join(mapping, "conversation_id").select("source_file", F.col("source_array_index").alias("array_index"), text.alias("element"))


def _twice(spark: SparkSession, sf_dir: str, indexed: bool = False) -> Store:
    """An archive after two imports, indexed after each if asked."""
    store = Store(spark, work_folder(spark))
    store.import_elements(_as_elements(bound(spark, sf_dir)))
    if indexed:
        store.build_index()
    store.import_elements(_second(spark, sf_dir))
    if indexed:
        store.build_index()
    return store


def second_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message after two imports, each conversation from the last that had it."""
    store = _twice(spark, sf_dir)
    titles = store.table("conversations").select("conversation_id", "title")
    nodes = store.table("nodes").select(*_NODE, F.sha2("content_text", 256).alias("text_sha256"), F.col("last_import_run_id").alias("run"))
    return nodes.join(titles, "conversation_id")


def earlier_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first snapshot still reads as it did, after a second and a merge of parts."""
    store = _twice(spark, sf_dir)
    return store.table("conversations", 1).select("conversation_id", "title", F.col("last_import_run_id").alias("run"))


def changed_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot in which each domain of change last changed."""
    rows = sorted(_twice(spark, sf_dir).generations().items())
    return spark.createDataFrame(rows, "domain string, version long")


def followed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search by postings whose second part holds only what the second import brought."""
    archive, postings = _twice(spark, sf_dir, True).indexed()
    q = parse_query("thing nder", path="all")
    return search.message_hits(index.narrowed(archive, postings, q), q).select(*_NODE)


def scored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 from stored postings alone, after two imports."""
    store = _twice(spark, sf_dir, True)
    return index.bm25_postings(*store.indexed(), parse_query("thingnder thing"), store.lengths()).select(*_NODE, F.round("bm25", 6).alias("bm25"))


def relevance_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty messages by relevance, chosen by postings; only their texts are read."""
    store = _twice(spark, sf_dir, True)
    archive, postings = store.indexed()
    page = index.relevance_page(archive, postings, parse_query('"thing" -than', path="current"), 40, store.lengths())
    return page.select(*_NODE, F.sha2("text", 256).alias("text_sha256"))


def exported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown files as executors wrote them, read back."""
    archive, folder = bound(spark, sf_dir), work_folder(spark)
    content = export.rendered(archive, ("md",), path="all", include_internal=True)
    export.write_files(content.join(export.file_names(archive.conversations, ("md",)), ["conversation_id", "format"]), folder)
    found = members.members(spark, folder)
    return found.select(F.regexp_extract("path", r"([0-9]{12})\.md$", 1).alias("conversation_id"), "sha256")


def path_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty hits on effective paths by relevance and as a reader shows them."""
    a, q = bound(spark, sf_dir), parse_query("the", path="current")
    pick = lambda order: search.page(search.search_messages(a, q, order), 40).select(F.lit(order).alias("order"), *_NODE)
    return pick("relevance").union(pick("display"))


def query_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the search language makes of odd queries about each turn."""
    forms = F.array(
        F.concat(F.lit("role:"), F.col("role"), F.lit(" -title:x a"), F.col("turn").cast("string")), F.concat(F.lit("role:no"), F.col("role"), F.lit(" path:all")),
        F.concat(F.lit("before:soon after:1970-01-0"), (F.col("turn") % 9 + 1).cast("string")), F.concat(F.lit('"open '), F.col("role")),
    )
    asked = turns(spark, sf_dir).select("conv_id", "turn", F.element_at(forms, (F.col("turn") % 4 + 1).cast("int")).alias("raw"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_query(x) for x in batch.column("raw").to_pylist()]
            rows = [pa.array(x, k) for x, k in (([q.role for q in found], pa.string()), ([q.path for q in found], pa.string()), ([q.after for q in found], pa.float64()), (["|".join(q.terms) for q in found], pa.string()), (["|".join(q.phrases) for q in found], pa.string()), (["|".join(q.errors) for q in found], pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *rows], ["conv_id", "turn", "role", "path", "after", "terms", "phrases", "errors"])

    return asked.mapInArrow(parsed, "conv_id long, turn long, role string, path string, after double, terms string, phrases string, errors string")


def continued_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan in stretches, each from the cursor of the one before, while an import comes between."""
    store = Store(spark, work_folder(spark))
    store.import_elements(_as_elements(bound(spark, sf_dir)))
    q, secret, out, cursor = parse_query("the", path="all"), b"key", None, None
    limit = max(1, search.message_hits(store.archive(), q).count() // 3)
    while True:
        got = continuation.scan_messages(store, q, secret, limit, cursor)
        part = got.hits.select(*_NODE)
        out, cursor = part if out is None else out.union(part), got.cursor
        if cursor is None:
            return out
        if store.version() == 1:
            store.import_elements(_second(spark, sf_dir))


def chunk_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message read from an offset, then on from the cursor, whose text has changed where the turn's number is odd."""
    rows = bound(spark, sf_dir).texts.select(*_NODE, "text")
    first = continuation.display_chunks(rows, "key", 16, offset=F.lit(3))
    changed = rows.withColumn("text", F.when(F.col("node_id").cast("int") % 2 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    both = changed.join(first.where("has_more").select(*_NODE, F.col("chunk").alias("before"), "next_cursor"), _NODE)
    then = continuation.display_chunks(both, "key", 16, cursor=F.col("next_cursor"))
    return then.join(first.select(*_NODE, F.col("chunk").alias("before")), _NODE).select(*_NODE, "before", "chunk", "offset", "has_more", "next_offset", "problem")


def chunk_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A piece of each message around its first match."""
    rows = bound(spark, sf_dir).texts.where(F.contains("norm", F.lit("the"))).select(*_NODE, "text")
    at = F.locate("the", F.lower("text")) - 1
    return continuation.display_chunks(rows, "key", 20, anchor=at).select(*_NODE, "chunk", "offset", "anchor_in_chunk", "total_chars", "has_more")


def listed_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a list, and a selected conversation that is not on it."""
    rows = search.listed(bound(spark, sf_dir), "title", after=86_400.0, limit=6, offset=6, selected_id="000000000002")
    return rows.select("place", "conversation_id", "title", "node_count", "current_path_nodes", "total", "selected_in_results")


def patched_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits where every third stored normal form is missing."""
    a = bound(spark, sf_dir)
    some = lambda c: F.when(F.col("conversation_id").cast("long") % 3 != 0, F.col(c))
    archive = Archive(a.titled.withColumn("title_norm", some("title_norm")), a.texts.withColumn("norm", some("norm")))
    return search.message_hits(archive, parse_query("the title:the", path="all")).select(*_NODE)


def totals_of_some(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the conversations that a search found."""
    a = bound(spark, sf_dir)
    return verify.scope_totals(a.nodes, search.message_hits(a, parse_query("thing", path="all")))


def _one_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("id", F.concat(F.lit("x"), F.col("conv_id").cast("string")))


def _odd_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An element for each conversation, of fourteen kinds by number, most of them not to be imported."""
    node = '"mapping":{"a":{"id":"a"}}'
    kinds = [
        "3", "{}", '{"id":[]}', '{"id":"a"}', '{"id":"a","mapping":1}', '{"id":"a","mapping":{}}', '{"id":"a","mapping":{"":{}}}', '{"id":"a","mapping":{"a\\n":{}}}', '{"id":NaN,' + node + "}",
        '{"id":"a","create_time":1e999,' + node + "}", '{"id":"a","n":' + "1" * 1001 + "," + node + "}", '{"id":"a","n":' + "[" * 300 + "]" * 300 + "," + node + "}", '{"id":"a","mapping":{"' + "y" * 600 + '":{}}}', "{",
    ]
    text = F.element_at(F.array(*map(F.lit, kinds)), (F.col("conv_id") % len(kinds) + 1).cast("int"))
    return _one_each(spark, sf_dir).select(F.lit("f.json").alias("source_file"), F.col("conv_id").alias("array_index"), text.alias("element"))


_ODD = (
    "invalid_element_type missing_id invalid_conversation_id missing_mapping invalid_mapping_type empty_mapping canonical_id_empty canonical_id_invalid_unicode invalid_json invalid_json invalid_json invalid_json "
    "canonical_id_too_long invalid_json"
).split()


def element_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each element can't be imported: its type, ids, mapping, or what its JSON may not hold."""
    notes = ingest.split_parsed(ingest.parsed_once(_odd_elements(spark, sf_dir), work_folder(spark)))["import_warnings"]
    return notes.select("array_index", "warning_type")


def ingest_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, times, flags, ids and metadata of conversations, each in several forms by number."""
    c = F.col("conv_id")
    pick = lambda *forms: F.element_at(F.array(*map(F.lit, forms)), (c % len(forms) + 1).cast("int"))
    text = F.concat(
        F.lit('{"id":" '), F.col("id"), F.lit(' ","conversation_id":'), pick("null", '" e "', "7"), F.lit(',"title":'), pick('"T"', "5", '["no"]', "null"), F.lit(',"create_time":'), pick("1.5", '"2.5"', '"soon"', "true", "null"),
        F.lit(',"is_archived":'), pick("true", '" No "', "0", '"maybe"', "null"), F.lit(',"voice":'), pick('"v"', "null"), F.lit(',"other":1,"mapping":{"a":{"id":"a","message":{"id":"m","content":{"content_type":"text","parts":["p'), c.cast("string"), F.lit('"]}}}}}'),
    )
    rows = _one_each(spark, sf_dir).select(F.lit("f.json").alias("source_file"), c.alias("array_index"), text.alias("element"))
    got = ingest.split_parsed(ingest.parsed_once(rows, work_folder(spark)))
    nodes = got["nodes"].select("conversation_id", "message_id", "content_hash", "display_revision")
    return got["conversations"].select("conversation_id", "exported_id", "title", "create_time", F.col("is_archived").cast("long").alias("is_archived"), "metadata_json").join(nodes, "conversation_id")


def input_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash for a folder of files, whatever their names and order."""
    files = members.members(spark, _small(spark, sf_dir)).select("path", "sha256", "size")
    return spark.createDataFrame([(store.input_sha256(files),)], "input_sha256 string")


def streamed_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that arrive in two goes, each imported when it is seen."""
    folder, rows = work_folder(spark), _whole_elements(spark, sf_dir)
    kept = Store(spark, f"{folder}/store")
    for k in (0, 1):
        _as_files(rows.where(F.col("place") % 2 == k).withColumn("path", F.concat(F.lit(f"conversations-{k}"), F.regexp_extract("path", "-(.*)", 1))), f"{folder}/in", "files")
        import_stream(spark, f"{folder}/in", kept, f"{folder}/mark").awaitTermination()
    return kept.table("conversations").select("conversation_id", "title", "last_import_run_id")


def written_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files a second export writes after every third text has changed."""
    folder = work_folder(spark)
    rows = bound(spark, sf_dir).conversations.select(F.concat("conversation_id", F.lit(".txt")).alias("output_path"), F.col("title").alias("content"), F.col("source_array_index").alias("k"))
    export.write_files(rows, folder)
    counts = export.write_files(rows.withColumn("content", F.when(F.col("k") % 3 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))), folder)
    return spark.createDataFrame([(counts["written"], counts["unchanged"])], "written long, unchanged long")


def manifest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a manifest, by name."""
    archive = bound(spark, sf_dir)
    return export.manifest(archive, export.rendered(archive, ("md",))).select("output_path", "conversation_id").limit(12)


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page is followed by another, at the last page's beginning and before it."""
    rows = search.list_conversations(bound(spark, sf_dir), "title")
    n = rows.count()
    return spark.createDataFrame([(k, search.has_more(rows, 5, max(n - k, 0))) for k in (4, 5, 6)], "back long, has_more boolean")


def empty_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a query with an empty phrase, which says nothing."""
    return search.message_hits(bound(spark, sf_dir), parse_query('"" the " "', path="all")).select(*_NODE)


def query_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters beside a search text: the text wins; and how the query would be run."""
    asked = turns(spark, sf_dir).select("conv_id", "turn", F.concat(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("role:"), F.col("role"), F.lit(" "))).otherwise(""), F.when(F.col("turn") % 3 == 0, "word").otherwise("")).alias("raw"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_query(x, role="tool", path="all", exclude='gone "two words"', limits=True, scope="side" if x == "word" else None) for x in batch.column("raw").to_pylist()]
            rows = [[q.role for q in found], [q.path for q in found], ["|".join(q.exclude) for q in found], [search.diagnostics(q)["kind"] for q in found], ["|".join(q.errors) for q in found]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(x, pa.string()) for x in rows)], ["conv_id", "turn", "role", "path", "exclude", "kind", "errors"])

    return asked.mapInArrow(parsed, "conv_id long, turn long, role string, path string, exclude string, kind string, errors string")


def layout_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs from the layout in an archive whose nodes lack a column and whose titles are numbers."""
    kept = _twice(spark, sf_dir)
    tables = {n: kept.table(n) for n in TABLES}
    broken = tables | {"nodes": tables["nodes"].drop("role"), "conversations": tables["conversations"].withColumn("title", F.length("title"))}
    broken.pop("exports")
    rows = [(kept.layout(), len(verify.schema_problems(tables)), len(verify.schema_problems(broken)), tables["import_runs"].count())]
    return spark.createDataFrame(rows, "layout long, problems long, problems_of_broken long, runs long")


STORED: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        zip_members, zip_sources, zip_elements, invalid_sample, duplicate_ids, folder_import, import_lineage, second_import, earlier_snapshot, changed_generations, followed_search, scored_postings, relevance_page, exported_files,
        path_orders, query_errors, continued_scan, chunk_steps, chunk_anchors, listed_with_counts, patched_norms, totals_of_some,
        element_problems, ingest_scalars, input_hash, streamed_import, written_twice, manifest_order, probes, empty_fragments, query_overrides, layout_checks,
    )
}

#: n after the second import, with its run; the first text of each tenth conversation is longer.
_AFTER = f"""{BIND}, l AS (
    SELECT n.* REPLACE (text || CASE WHEN conv_id % 10 = 0 AND turn = 0 THEN ' thingnder' ELSE '' END AS text, CASE WHEN conv_id % 10 = 0 AND turn = 0 THEN trim(norm || ' thingnder') ELSE norm END AS norm),
        CASE WHEN conv_id % 10 = 0 THEN 2 ELSE 1 END::BIGINT AS run FROM n
)"""
_TF = "(length(norm) - length(replace(norm, '{0}', ''))) // length('{0}')"

STORED_SQL: dict[str, str] = {
    "zip_members": f"""{_SMALL}, f AS (SELECT path, '[' || string_agg(element, ',' || chr(10) ORDER BY conv_id) || ']' AS content FROM e GROUP BY 1)
        SELECT path, octet_length(encode(content))::BIGINT AS size, sha256(content) AS sha256, 'json' AS file_type FROM f""",
    "zip_sources": f"{_SMALL} SELECT path, conv_id // {SHARD} AS shard FROM e GROUP BY ALL",
    "zip_elements": f"""{_SMALL} SELECT path AS source_file, row_number() OVER (PARTITION BY path ORDER BY conv_id) - 1 AS array_index,
        CASE WHEN octet_length(encode(element)) <= {_LIMIT} THEN element END AS element, CASE WHEN octet_length(encode(element)) > {_LIMIT} THEN 'element_too_large' END AS problem FROM e""",
    "invalid_sample": f"""{_SMALL}, p AS (SELECT path AS source_file, row_number() OVER (PARTITION BY path ORDER BY conv_id) - 1 AS array_index, element FROM e)
        SELECT source_file, array_index, CASE WHEN octet_length(encode(element)) > {_LIMIT} THEN 'element_too_large' WHEN element = '{{"id":}}' THEN 'invalid_json' ELSE 'missing_mapping' END AS warning_type
        FROM p ORDER BY ALL LIMIT 20""",
    "duplicate_ids": "SELECT count(*) + count(*) FILTER (conv_id % 5 = 0) + 2 AS elements, count(*) + count(*) FILTER (conv_id % 5 = 0) AS with_id, count(*) FILTER (conv_id % 5 = 0) AS duplicate_ids FROM (SELECT DISTINCT conv_id FROM conversations)",
    "folder_import": f"""{BIND} SELECT conversation_id, title, 'conversations-' || (conv_id // {SHARD}) || '.json' AS source_file,
        row_number() OVER (PARTITION BY conv_id // {SHARD} ORDER BY conv_id) - 1 AS source_array_index, 1::BIGINT AS last_import_run_id FROM c""",
    "import_lineage": f"""SELECT DISTINCT 1::BIGINT AS import_run_id, 'conversations-' || (conv_id // {SHARD}) || '.json' AS source_path, 'json' AS file_type, '.json' AS extension,
        true AS is_conversation_json, true AS is_selected_conversation_source FROM conversations""",
    "second_import": f"{_AFTER} SELECT l.conversation_id, node_id, sha256(text) AS text_sha256, run, CASE WHEN run = 2 THEN 'new ' || title ELSE title END AS title FROM l JOIN c USING (conversation_id)",
    "earlier_snapshot": f"{BIND} SELECT conversation_id, title, 1::BIGINT AS run FROM c",
    "changed_generations": "SELECT * FROM (VALUES ('address', 1), ('graph', 1), ('message', 2), ('query', 1), ('title', 2)) t(domain, version) WHERE EXISTS (SELECT 1 FROM conversations WHERE conv_id % 10 = 0)",
    "followed_search": f"{_AFTER} SELECT conversation_id, node_id FROM l WHERE {_has('thing')} AND {_has('nder')}",
    "scored_postings": f"""{_AFTER}, f AS (SELECT conversation_id, node_id, greatest(length(norm) - 2, 0)::DOUBLE AS size, {_TF.format("thingnder")} AS a, {_TF.format("thing")} AS b FROM l WHERE coalesce(text, '') <> ''),
        t AS (SELECT count(*) AS total, avg(size) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM f)
        SELECT conversation_id, node_id, round(-greatest(ln((total - da + 0.5) / (da + 0.5)), 0.000001) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * size / mean)) - greatest(ln((total - db + 0.5) / (db + 0.5)), 0.000001) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * size / mean)), 6) AS bm25
        FROM f, t WHERE a > 0 OR b > 0""",
    "relevance_page": f"""{_AFTER}, f AS (SELECT l.*, greatest(length(norm) - 2, 0)::DOUBLE AS size, {_TF.format("thing")} AS tf FROM l WHERE coalesce(text, '') <> ''),
        t AS (SELECT count(*) AS total, avg(size) AS mean, count(*) FILTER (tf > 0) AS df FROM f), k AS (SELECT conversation_id, c.create_time, CASE WHEN conv_id % 10 = 0 THEN 'new ' || title_norm ELSE title_norm END AS title_norm FROM c)
        SELECT f.conversation_id, f.node_id, sha256(f.text) AS text_sha256 FROM f JOIN k USING (conversation_id) JOIN p USING (conversation_id, node_id), t
        WHERE tf > 0 AND NOT {_has('than', 'f.norm')} AND NOT {_has('than', 'k.title_norm')}
        ORDER BY -greatest(ln((total - df + 0.5) / (df + 0.5)), 0.000001) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)), k.create_time DESC, f.conversation_id, f.create_time, f.node_id LIMIT 40""",
    "exported_files": f"SELECT conversation_id, sha256 FROM ({_export_sql(_MD, _MD_NODE, 'true')})",
    "path_orders": f"""{BIND}, h AS (SELECT n.*, p.depth FROM n JOIN p USING (conversation_id, node_id) WHERE {_has('the')})
        (SELECT 'relevance' AS "order", h.conversation_id, h.node_id FROM h JOIN c USING (conversation_id) ORDER BY c.create_time DESC, h.conversation_id, h.create_time, h.node_id LIMIT 40)
        UNION ALL (SELECT 'display', conversation_id, node_id FROM h ORDER BY depth DESC, node_id, conversation_id LIMIT 40)""",
    "query_errors": """SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN role END AS role, CASE WHEN turn % 4 = 1 THEN 'all' ELSE 'current' END AS path, CASE WHEN turn % 4 = 2 THEN (turn % 9) * 86400.0::DOUBLE END AS after,
        CASE turn % 4 WHEN 0 THEN 'a' || turn ELSE '' END AS terms, CASE turn % 4 WHEN 3 THEN 'open ' || role ELSE '' END AS phrases,
        CASE turn % 4 WHEN 0 THEN 'negated_modifier_not_supported:title' WHEN 1 THEN 'invalid_role:no' || role WHEN 2 THEN 'invalid_before' ELSE '' END AS errors FROM conversations""",
    "continued_scan": f"{BIND} SELECT conversation_id, node_id FROM n WHERE {_has('the')}",
    "chunk_steps": f"""{BIND} SELECT conversation_id, node_id, substr(text, 4, 16) AS before, CASE WHEN turn % 2 = 0 THEN substr(text, 20, 16) END AS chunk, CASE WHEN turn % 2 = 0 THEN 19 END AS "offset",
        turn % 2 = 0 AND length(text) > 35 AS has_more, CASE WHEN turn % 2 = 0 AND length(text) > 35 THEN 35 END AS next_offset, CASE WHEN turn % 2 = 1 THEN 'display_cursor_stale' END AS problem
        FROM n WHERE length(text) > 19""",
    "chunk_anchors": f"""{BIND}, h AS (SELECT *, strpos(lower(text), 'the') - 1 AS a FROM n WHERE {_has('the')}), o AS (SELECT *, greatest(a - 10, 0) AS o FROM h)
        SELECT conversation_id, node_id, substr(text, (o + 1)::INT, 20) AS chunk, o::INTEGER AS "offset", (a - o)::INTEGER AS anchor_in_chunk, length(text)::INTEGER AS total_chars, o + 20 < length(text) AS has_more FROM o""",
    "listed_with_counts": f"""{BIND}, l AS (SELECT *, row_number() OVER (ORDER BY lower(coalesce(title, '')), conversation_id) - 1 AS k, count(*) OVER () AS total FROM c WHERE create_time >= 86400)
        SELECT CASE WHEN k BETWEEN 6 AND 11 THEN k END::INTEGER AS place, conversation_id, title, (SELECT count(*) FROM n WHERE n.conversation_id = l.conversation_id) AS node_count, 0::BIGINT AS current_path_nodes, total,
            EXISTS (SELECT 1 FROM l WHERE conv_id = 2) AS selected_in_results FROM l WHERE k BETWEEN 6 AND 11 OR conv_id = 2""",
    "patched_norms": f"{BIND} SELECT n.conversation_id, n.node_id FROM n JOIN c USING (conversation_id) WHERE {_has('the')} AND {_has('the', 'title_norm')}",
    "totals_of_some": f"""{BIND} SELECT count(DISTINCT conversation_id) AS conversations, count(*) AS nodes, coalesce(sum(octet_length(encode(text))), 0)::BIGINT AS text_bytes
        FROM n WHERE conversation_id IN (SELECT conversation_id FROM n WHERE {_has('thing')})""",
    "element_problems": f"SELECT DISTINCT conv_id AS array_index, {_ODD!r}[(conv_id % {len(_ODD)} + 1)::INT] AS warning_type FROM conversations",
    "ingest_scalars": """SELECT 'x' || conv_id AS conversation_id, [NULL, 'e', '7'][(conv_id % 3 + 1)::INT] AS exported_id, ['T', '5', NULL, NULL][(conv_id % 4 + 1)::INT] AS title, ([1.5, 2.5, NULL, 1, NULL]::DOUBLE[])[(conv_id % 5 + 1)::INT] AS create_time,
        ([1, 0, 0, NULL, NULL]::BIGINT[])[(conv_id % 5 + 1)::INT] AS is_archived, ['{"voice":"v"}', '{"voice":null}'][(conv_id % 2 + 1)::INT] AS metadata_json, 'm' AS message_id,
        sha256('{"content_text":"p' || conv_id || '","content_type":"text"}') AS content_hash,
        sha256('["p' || conv_id || '","{\\"content\\":{\\"content_type\\":\\"text\\",\\"parts\\":[\\"p' || conv_id || '\\"]},\\"id\\":\\"m\\"}"]') AS display_revision FROM (SELECT DISTINCT conv_id FROM conversations)""",
    "input_hash": f"""{_SMALL}, f AS (SELECT sha256('[' || string_agg(element, ',' || chr(10) ORDER BY conv_id) || ']') AS h FROM e GROUP BY path), g AS (SELECT sha256(string_agg(h, chr(10) ORDER BY h)) AS m, min(h) AS one, count(*) AS n FROM f GROUP BY substr(h, 1, 3))
        SELECT CASE WHEN sum(n) > 1 THEN sha256(string_agg(m, chr(10) ORDER BY m)) ELSE min(one) END AS input_sha256 FROM g""",
    "streamed_import": f"{BIND} SELECT conversation_id, title, (conv_id % 2 + 1)::BIGINT AS last_import_run_id FROM c",
    "written_twice": "SELECT count(*) FILTER (conv_id % 3 = 0) AS written, count(*) FILTER (conv_id % 3 <> 0) AS unchanged FROM (SELECT DISTINCT conv_id FROM conversations)",
    "manifest_order": f"SELECT output_path, conversation_id FROM ({_manifest_sql()}) WHERE format = 'md' ORDER BY output_path LIMIT 12",
    "probes": "SELECT back, back > 5 AND (SELECT count(DISTINCT conv_id) FROM conversations) > 5 AS has_more FROM (VALUES (4), (5), (6)) t(back)",
    "empty_fragments": f"{BIND} SELECT conversation_id, node_id FROM n WHERE {_has('the')}",
    "query_overrides": """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role ELSE 'tool' END AS role, 'all' AS path, 'gone|two words' AS exclude, CASE WHEN turn % 3 = 0 THEN 'search' ELSE 'filter' END AS kind,
        CASE WHEN turn % 6 = 3 THEN 'invalid_scope:side' ELSE '' END AS errors FROM conversations""",
    "layout_checks": "SELECT 1 AS layout, 0 AS problems, 3 AS problems_of_broken, 2 AS runs FROM conversations LIMIT 1",
}
