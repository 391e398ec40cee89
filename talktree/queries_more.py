"""More queries over the test tables, on a richer binding, and DuckDB SQL that gives the same rows.

The rich binding adds to :mod:`talktree.sources.bind`, by rule on both sides: flags, conversations
without a current node, raw messages whose stored text is empty or a placeholder, texts beyond
Latin-1, and nodes that hold nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talktree.functions.register import register
from talktree.functions.values import cut_utf8
from talktree.operators import export, graph, reader, search, store, verify
from talktree.operators.archive import Archive
from talktree.plans.query import parse_query
from talktree.queries import _DAMAGE, BIND, _damaged, _elements, _has, _older, _whole
from talktree.sources.bind import bound, turns

_NODE = ["conversation_id", "node_id"]
_WIDE = " ＦＵＬＬ ﬁt Å Σ"
_CID = "0" * 12


def rich(spark: SparkSession, sf_dir: str) -> Archive:
    a = bound(spark, sf_dir)
    c, t, text = F.col("conversation_id").cast("long"), F.col("node_id").cast("long"), F.col("content_text")
    recovered, parts, wide, bare = t % 4 == 3, (t % 4 == 1) & (c % 2 == 1), (c % 7 == 1) & (t % 4 == 0), t == 6
    content = lambda kind, parts: F.to_json(F.struct(F.struct(F.lit(kind).alias("content_type"), parts.alias("parts")).alias("content")))
    nested = F.concat(F.lit('{"content":{"content_type":"multimodal_text","parts":['), F.to_json(F.struct(text.alias("text"))), F.lit(',"tail"]}}'))
    nodes = a.nodes.withColumns(
        {
            "is_on_current_path": F.when((c % 3 != 2) & (t <= 2), 1).when((c % 5 == 0) & (t == 4), 1).otherwise(0),
            "raw_message_json": F.when(bare, None).when(recovered, content("text", F.array(text))).when(parts, nested),
            "message_id": F.when(~bare, F.col("message_id")),
            "content_text": F.when(bare | recovered, "").when(parts, "[non-text content: image]").when(wide, F.concat(text, F.lit(_WIDE))).otherwise(text),
        }
    )
    current = F.when(c % 4 == 1, None).when(c % 4 == 3, "zzz").otherwise(F.col("current_node"))
    return Archive(a.conversations.withColumn("current_node", current), nodes)


_NORM = "trim(regexp_replace(replace(lower({}), 'ß', 'ss'), '[\\x09-\\x0D\\x1C-\\x20]+', ' ', 'g'))"
#: r: rich nodes; k: rich conversations; y: rich paths.
RICH = f"""{BIND}, r AS (
    SELECT n.* EXCLUDE (text, norm), n.text AS own, (CASE WHEN conv_id % 3 <> 2 AND turn <= 2 THEN 1 WHEN conv_id % 5 = 0 AND turn = 4 THEN 1 ELSE 0 END) AS flag,
        CASE WHEN turn = 6 THEN '' WHEN turn % 4 = 3 THEN text WHEN turn % 4 = 1 AND conv_id % 2 = 1 THEN text || chr(10) || chr(10) || 'tail' WHEN conv_id % 7 = 1 AND turn % 4 = 0 THEN text || '{_WIDE}' ELSE text END AS text,
        CASE WHEN turn = 6 THEN '' WHEN turn % 4 = 1 AND conv_id % 2 = 1 THEN {_NORM.format("text || ' tail'")} WHEN turn % 4 <> 3 AND conv_id % 7 = 1 AND turn % 4 = 0 THEN {_NORM.format("text || ' full fit å σ'")} ELSE norm END AS norm
    FROM n
), k AS (SELECT c.* REPLACE (CASE WHEN conv_id % 4 IN (1, 3) THEN NULL ELSE current_node END AS current_node) FROM c
), leaf AS (
    SELECT conversation_id, min(node_id) AS node_id, count(*) AS leaves FROM r WHERE flag = 1 AND NOT EXISTS (SELECT 1 FROM r x WHERE x.conversation_id = r.conversation_id AND x.flag = 1 AND x.parent_node_id = r.node_id) GROUP BY 1
), y AS (
    SELECT r.conversation_id, r.node_id, r.parent_node_id, 0::BIGINT AS depth, CASE WHEN k.current_node IS NULL THEN 'raw_flags' ELSE 'current_node' END AS source
    FROM r JOIN k USING (conversation_id) LEFT JOIN leaf ON leaf.conversation_id = k.conversation_id WHERE r.node_id = coalesce(k.current_node, leaf.node_id)
    UNION ALL
    SELECT r.conversation_id, r.node_id, r.parent_node_id, y.depth + 1, y.source FROM y JOIN r ON r.conversation_id = y.conversation_id AND r.node_id = y.parent_node_id AND (y.source = 'current_node' OR r.flag = 1)
), path AS (
    SELECT conversation_id, node_id, depth, source, max(depth) OVER (PARTITION BY conversation_id) - depth AS position FROM y
    UNION ALL
    SELECT conversation_id, node_id, NULL, 'fallback_all', row_number() OVER (PARTITION BY conversation_id ORDER BY create_time, node_id) - 1 FROM r WHERE conversation_id NOT IN (SELECT conversation_id FROM y)
)"""


def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as a reader sees them, recovered from raw messages, and their normal forms."""
    return rich(spark, sf_dir).texts.select(*_NODE, F.sha2("text", 256).alias("text_sha256"), F.sha2("norm", 256).alias("norm_sha256"))


def flagged_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rich(spark, sf_dir).paths.select(*_NODE, "depth", "source", "position")


def flagged_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = rich(spark, sf_dir).meta
    return m.select("conversation_id", "current_path_nodes", "raw_flag_leaf_count", "current_node_exists", "current_collection_source", "flags_missing")


def raw_flag_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _damaged(rich(spark, sf_dir)).meta
    return m.select("conversation_id", "raw_flag_cycle_detected", "raw_flag_missing_parent", "raw_flag_cross_conversation_parent")


def flagged_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits on effective paths of every source, in recovered and folded texts."""
    return search.message_hits(rich(spark, sf_dir), parse_query("the")).select(*_NODE)


def folded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.message_hits(rich(spark, sf_dir), parse_query('"full ﬁt å"', path="all")).select(*_NODE)


def hidden_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader.visibility_counts(rich(spark, sf_dir)).select("conversation_id", "total", "empty_hidden_count")


def highlight_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader.highlight_rows(rich(spark, sf_dir), parse_query("the", path="all"), "all")


def highlight_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reader.get_messages(bound(spark, sf_dir), _CID, path="all", limit=20, q=parse_query("the", path="all"))
    return rows.select("node_id", F.size("highlight_ranges").cast("long").alias("ranges"), F.get("highlight_ranges", F.lit(0))["start"].cast("long").alias("first_start"))


def first_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.search_messages(bound(spark, sf_dir), parse_query("the", path="all"))
    return rows.select(*_NODE, F.col("match.offset").cast("long").alias("offset"), F.col("match.length").cast("long").alias("length"), F.col("match.term").alias("term"))


def raw_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader.raw_preview(rich(spark, sf_dir), _CID, "000003").select(*_NODE, F.sha2("raw_preview", 256).alias("sha256"), "raw_preview_truncated", F.col("raw_bytes").cast("long").alias("raw_bytes"))


def copy_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader.copy_messages(bound(spark, sf_dir), _CID, ["000001", "000000", "none"]).select(F.sha2("text", 256).alias("sha256"), "missing")


def display_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = reader.display_chunk(bound(spark, sf_dir), _CID, "000001", 4, 16)
    return row.select(*_NODE, "chunk", F.col("total_chars").cast("long").alias("total_chars"), "has_more", "revision")


def one_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader.get_conversation(bound(spark, sf_dir), _CID).select("conversation_id", "title", "node_count", "current_collection_source")


def list_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first seven conversations by each order of a list."""
    a, out = bound(spark, sf_dir), None
    for sort in ("created", "oldest", "updated", "title"):
        one = search.page(search.list_conversations(a, sort), 7).select(F.lit(sort).alias("sort"), "conversation_id")
        out = one if out is None else out.union(one)
    return out


def search_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first seven conversations by each other order of a search."""
    a, out = bound(spark, sf_dir), None
    for sort in ("newest", "oldest", "created", "title"):
        one = search.page(search.search_conversations(a, parse_query("the", path="all"), sort), 7).select(F.lit(sort).alias("sort"), "conversation_id")
        out = one if out is None else out.union(one)
    return out


def message_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty hits by relevance and as a reader shows them."""
    a, q = bound(spark, sf_dir), parse_query("the", path="all")
    pick = lambda order: search.page(search.search_messages(a, q, order), 40).select(F.lit(order).alias("order"), *_NODE)
    return pick("relevance").union(pick("display"))


def export_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.selected(bound(spark, sf_dir), date_from=86_400.0).select("conversation_id").limit(9)


def page_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.with_total(search.page(search.list_conversations(bound(spark, sf_dir), "title"), 12)).select("conversation_id", "total_rows")


def long_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bound(spark, sf_dir).conversations.withColumn("title", F.repeat("title", 200))
    return search.summaries(c).select("conversation_id", F.sha2("title", 256).alias("sha256"), "title_truncated", F.col("title_length").cast("long").alias("title_length"))


def bounded_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.page(search.list_conversations(bound(spark, sf_dir), "title"), 50).select("conversation_id")
    return search.bounded_page(rows, 500)


def name_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of ids that make one file name are numbered."""
    c = F.col("source_array_index")
    cid = F.concat(F.lit("x"), F.floor(c / 2).cast("string"), F.when(c % 2 == 0, "/").otherwise("_"))
    rows = bound(spark, sf_dir).conversations.withColumns({"conversation_id": cid, "title": F.lit("A: b"), "create_time": F.lit(0.0)})
    return export.file_names(rows, ("md",))


def utf8_beginnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", cut_utf8(F.col("text"), 37).alias("beginning"))


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    turns(spark, sf_dir).createOrReplaceTempView("talktree_turns")
    return spark.sql("SELECT conv_id, turn, sha2(search_norm(text), 256) AS norm_sha256, search_match(text, 'THE', 'word') AS matched, sha2(display_text(text, NULL), 256) AS shown_sha256, id_is_safe(role) AS safe FROM talktree_turns")


def unsafe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = bound(spark, sf_dir)
    bad = F.when(F.col("node_id") == "000001", F.concat("message_id", F.lit("\x07"))).otherwise(F.col("message_id"))
    nodes = a.nodes.withColumn("message_id", bad).withColumn("children_json", F.when(F.col("node_id") == "000000", F.lit('["ok", "a\\u0001"]')).otherwise("[]"))
    return verify.unsafe_ids(Archive(a.conversations, nodes))


def non_finite_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = bound(spark, sf_dir)
    odd = F.when(F.col("node_id") == "000000", F.lit(float("nan"))).when(F.col("node_id") == "000001", F.lit(float("inf"))).otherwise(F.col("create_time"))
    return verify.non_finite_times(Archive(a.conversations, a.nodes.withColumn("create_time", odd)))


def violation_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = bound(spark, sf_dir)
    return verify.violation_samples(Archive(a.conversations.where("source_array_index % 7 <> 0"), a.nodes), 15)


def foreign_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.foreign_parents(_damaged(bound(spark, sf_dir)).nodes).select(*_NODE, "foreign")


def latest_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).select((F.col("conv_id") % 3).alias("import_run_id"), F.concat(F.lit("kind_"), F.col("role")).alias("warning_type"))
    return verify.warning_counts(rows, latest=True)


def merged_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which run each conversation is from after an import of the newer archive."""
    from talktree.schema import CONVERSATIONS

    new = bound(spark, sf_dir)
    old, come = _whole(_older(new).conversations, CONVERSATIONS), _whole(new.conversations, CONVERSATIONS)
    out = store.merged(old, come, store.conversation_outcomes(old, come), 9)
    return out.select("conversation_id", "title", F.coalesce("last_import_run_id", F.lit(0)).alias("run"))


def changed_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that differ from what the export log says was last written."""
    c = bound(spark, sf_dir).conversations
    rows = c.select("conversation_id", F.lit("md").alias("format"), F.col("conversation_id").alias("output_path"), F.sha2("conversation_id", 256).alias("output_hash"))
    number = F.col("conversation_id").cast("long")
    log = export.export_log(rows.where(number % 3 != 0), "2024-01-01", {}).union(export.export_log(rows.where(number % 3 == 1).withColumn("output_hash", F.lit("newer")), "2024-01-02", {}))
    return export.changed(rows, log).select("conversation_id")


def stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import, its index, and a search by way of the stored postings."""
    from talktree.operators import index
    from talktree.sources.bind import work_folder

    kept = store.Store(spark, work_folder(spark))
    kept.import_elements(_elements(spark, sf_dir))
    kept.build_index()
    archive, postings = kept.indexed()
    q = parse_query("thing nder", path="all")
    return search.message_hits(index.narrowed(archive, postings, q), q).select(*_NODE)


MORE: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        display_texts, flagged_paths, flagged_metadata, raw_flag_topology, flagged_search, folded_search, hidden_nodes, highlight_eligible, highlight_counts, first_matches, raw_preview, copy_visible, display_chunk,
        one_conversation, list_sorts, search_sorts, message_orders, export_order, page_with_total, long_summaries, bounded_page, name_clashes, utf8_beginnings, sql_functions, unsafe_ids, non_finite_times,
        violation_samples, foreign_parents, latest_warnings, merged_import, changed_exports, stored_search,
    )
}

_RECENT = {"created": "create_time DESC", "oldest": "create_time", "updated": "create_time DESC", "newest": "create_time DESC", "title": "lower(coalesce(title, ''))"}
_THE = f"({_has('the', 'title_norm')} OR EXISTS (SELECT 1 FROM n WHERE n.conversation_id = c.conversation_id AND {_has('the')}))"


def _sorts(sorts: tuple[str, ...], where: str) -> str:
    order = lambda s: _RECENT[s] + (", title NULLS FIRST" if where != "true" and s != "title" else "")
    return BIND + " UNION ALL ".join(f"(SELECT '{s}' AS sort, conversation_id FROM c WHERE {where} ORDER BY {order(s)}, conversation_id LIMIT 7)" for s in sorts)


MORE_SQL: dict[str, str] = {
    "display_texts": f"{RICH} SELECT conversation_id, node_id, sha256(text) AS text_sha256, sha256(norm) AS norm_sha256 FROM r",
    "flagged_paths": f"{RICH} SELECT conversation_id, node_id, depth, source, position FROM path",
    "flagged_metadata": f"""{RICH} SELECT k.conversation_id, (SELECT sum(flag) FROM r WHERE r.conversation_id = k.conversation_id)::BIGINT AS current_path_nodes, coalesce(leaves, 0)::BIGINT AS raw_flag_leaf_count, k.current_node IS NOT NULL AS current_node_exists,
        (SELECT max(source) FROM path WHERE path.conversation_id = k.conversation_id) AS current_collection_source,
        (SELECT count(*) FROM y JOIN r USING (conversation_id, node_id) WHERE y.conversation_id = k.conversation_id AND y.source = 'current_node' AND flag = 0) AS flags_missing FROM k LEFT JOIN leaf ON leaf.conversation_id = k.conversation_id""",
    "raw_flag_topology": f"""{RICH}, d AS (
            SELECT r.* REPLACE (CASE WHEN conv_id % 5 = 2 AND turn = 0 THEN '000001' ELSE parent_node_id END AS parent_node_id) FROM r WHERE NOT (conv_id % 5 = 0 AND turn = 1) AND conv_id % 7 <> 0
        ), o AS (
            SELECT d.conversation_id, EXISTS (SELECT 1 FROM d x WHERE x.conversation_id = d.conversation_id AND x.node_id = d.parent_node_id) AS home, EXISTS (SELECT 1 FROM d x WHERE x.conversation_id <> d.conversation_id AND x.node_id = d.parent_node_id) AS away
            FROM d WHERE flag = 1 AND parent_node_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d x WHERE x.conversation_id = d.conversation_id AND x.node_id = d.parent_node_id AND x.flag = 1)
        )
        SELECT c.conversation_id, conv_id % 5 = 2 AND conv_id % 3 <> 2 AND EXISTS (SELECT 1 FROM d WHERE d.conversation_id = c.conversation_id AND turn = 1) AS raw_flag_cycle_detected,
            EXISTS (SELECT 1 FROM o WHERE o.conversation_id = c.conversation_id AND (home OR NOT away)) AS raw_flag_missing_parent, EXISTS (SELECT 1 FROM o WHERE o.conversation_id = c.conversation_id AND NOT home AND away) AS raw_flag_cross_conversation_parent FROM c""",
    "flagged_search": f"{RICH} SELECT conversation_id, node_id FROM r WHERE {_has('the')} AND EXISTS (SELECT 1 FROM path WHERE path.conversation_id = r.conversation_id AND path.node_id = r.node_id)",
    "folded_search": f"{RICH} SELECT conversation_id, node_id FROM r WHERE contains(norm, 'full fit å')",
    "hidden_nodes": f"{RICH} SELECT conversation_id, count(*) AS total, count(*) FILTER (turn = 6) AS empty_hidden_count FROM r GROUP BY 1",
    "highlight_eligible": f"{RICH} SELECT conversation_id, node_id FROM r WHERE {_has('the')}",
    "highlight_counts": f"{BIND} SELECT node_id, ((length(text) - length(replace(lower(text), 'the', ''))) // 3)::BIGINT AS ranges, CASE WHEN contains(lower(text), 'the') THEN (strpos(lower(text), 'the') - 1)::BIGINT END AS first_start FROM n WHERE conv_id = 0 AND turn < 20",
    "first_matches": f"{BIND} SELECT conversation_id, node_id, (strpos(lower(text), 'the') - 1)::BIGINT AS \"offset\", 3::BIGINT AS length, 'the' AS term FROM n WHERE {_has('the')}",
    "raw_preview": f"""{RICH}, j AS (SELECT conversation_id, node_id, '{{"content":{{"content_type":"text","parts":[' || to_json(own)::VARCHAR || ']}}}}' AS x FROM r WHERE conv_id = 0 AND turn = 3)
        SELECT conversation_id, node_id, sha256(x) AS sha256, false AS raw_preview_truncated, octet_length(encode(x))::BIGINT AS raw_bytes FROM j""",
    "copy_visible": f"{BIND} SELECT sha256(string_agg(role || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY turn DESC)) AS sha256, 1::BIGINT AS missing FROM n WHERE conv_id = 0 AND turn < 2",
    "display_chunk": f"{BIND} SELECT conversation_id, node_id, substr(text, 5, 16) AS chunk, length(text) AS total_chars, length(text) > 20 AS has_more, sha256(text) AS revision FROM n WHERE conv_id = 0 AND turn = 1",
    "one_conversation": f"{BIND} SELECT conversation_id, title, (SELECT count(*) FROM n WHERE conv_id = 0) AS node_count, 'current_node' AS current_collection_source FROM c WHERE conv_id = 0",
    "list_sorts": _sorts(("created", "oldest", "updated", "title"), "true"),
    "search_sorts": _sorts(("newest", "oldest", "created", "title"), _THE),
    "message_orders": f"""{BIND} (SELECT 'relevance' AS "order", n.conversation_id, n.node_id FROM n JOIN c USING (conversation_id) WHERE {_has('the')} ORDER BY c.create_time DESC, n.conversation_id, n.create_time, n.node_id LIMIT 40)
        UNION ALL (SELECT 'display', conversation_id, node_id FROM n WHERE {_has('the')} ORDER BY create_time, node_id LIMIT 40)""",
    "export_order": f"{BIND} SELECT conversation_id FROM c WHERE create_time >= 86400 ORDER BY create_time, conversation_id LIMIT 9",
    "page_with_total": f"{BIND} SELECT conversation_id, count(*) OVER () AS total_rows FROM (SELECT conversation_id FROM c ORDER BY lower(coalesce(title, '')), conversation_id LIMIT 12)",
    "long_summaries": f"{BIND} SELECT conversation_id, sha256(substr(repeat(title, 200), 1, 4096)) AS sha256, length(title) * 200 > 4096 AS title_truncated, length(title) * 200 AS title_length FROM c",
    "bounded_page": f"""{BIND}, i AS (SELECT '{{"conversation_id":"' || conversation_id || '"}}' AS item, row_number() OVER (ORDER BY lower(coalesce(title, '')), conversation_id) AS place FROM c)
        SELECT item FROM (SELECT item, sum(length(item) + 1) OVER (ORDER BY place) AS total FROM i WHERE place <= 50) WHERE total <= 500""",
    "name_clashes": f"""{BIND}, x AS (SELECT conv_id // 2 AS k, 'x' || (conv_id // 2) || CASE WHEN conv_id % 2 = 0 THEN '/' ELSE '_' END AS conversation_id, count(*) OVER (PARTITION BY conv_id // 2) AS m FROM c)
        SELECT conversation_id, 'md' AS format, '1970-01-01_A__b_x' || k || CASE WHEN m = 1 THEN '' WHEN ends_with(conversation_id, '/') THEN '_001' ELSE '_002' END || '.md' AS output_path FROM x""",
    "utf8_beginnings": "SELECT doc_id, substr(text, 1, (SELECT max(k) FROM range(38) t(k) WHERE octet_length(encode(substr(text, 1, k::INT))) <= 37)::INT) AS beginning FROM documents",
    "sql_functions": f"SELECT conv_id, turn, sha256({_NORM.format('text')}) AS norm_sha256, regexp_matches({_NORM.format('text')}, '(^|[^a-z0-9_])the($|[^a-z0-9_])') AS matched, sha256(text) AS shown_sha256, true AS safe FROM conversations",
    "unsafe_ids": f"""{BIND} SELECT unnest(['conversation_id', 'current_node', 'node_id', 'parent_node_id', 'message_id', 'children']) AS field,
        unnest([0, 0, 0, 0, (SELECT count(*) FROM n WHERE turn = 1), (SELECT count(*) FROM n WHERE turn = 0)])::BIGINT AS incompatible""",
    "non_finite_times": "SELECT count(*) AS non_finite_timestamps FROM conversations WHERE turn < 2",
    "violation_samples": f"{BIND} SELECT conversation_id, node_id FROM n WHERE conv_id % 7 = 0 ORDER BY 1, 2 LIMIT 15",
    "foreign_parents": f"{BIND}{_DAMAGE} SELECT d.conversation_id, d.node_id, EXISTS (SELECT 1 FROM d x WHERE x.conversation_id <> d.conversation_id AND x.node_id = d.parent_node_id) AS \"foreign\" FROM d",
    "latest_warnings": "SELECT 'kind_' || role AS warning_type, count(*) AS count FROM conversations WHERE conv_id % 3 = (SELECT max(conv_id % 3) FROM conversations) GROUP BY 1",
    "merged_import": f"{BIND} SELECT conversation_id, title, CASE WHEN conv_id % 11 = 0 OR (conv_id % 4 = 0 AND title <> 'old') THEN 9 ELSE 0 END::BIGINT AS run FROM c",
    "changed_exports": f"{BIND} SELECT conversation_id FROM c WHERE conv_id % 3 IN (0, 1)",
    "stored_search": f"{BIND} SELECT conversation_id, node_id FROM n WHERE {_has('thing')} AND {_has('nder')}",
}

