"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contaminated
from .hard_negatives import hard_negatives
from .html_text import extract_pages
from .importance import importance_sample
from .language_id import identify_languages, train_profiles
from .licenses import scan_licenses
from .near_dedup import NearDupParams, near_duplicates
from .packing import PackingParams, pack_documents
from .quality import quality_rules, train_quality
from .secrets import secret_counts, train_secrets
from .sentence_pieces import piece_digests
from .substring_dedup import substring_dedup
from .warc import archive_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules(docs, train_quality(docs, _table(spark, sf_dir, "labels")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secret_counts(docs, train_secrets(docs, _table(spark, sf_dir, "labels")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), PackingParams(added_tokens=True))


def op5_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return identify_languages(docs, train_profiles(docs))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return near_duplicates(docs, params=NearDupParams(shingle=4)).select("doc_id", "n_shingles", "component_id", "kept")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_secret_scan": op2_secret_scan,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_warc_archives": op5_warc_archives,
    "op6_language_id": op6_language_id,
    "op7_license_scan": op7_license_scan,
    "op8_decontamination": op8_decontamination,
    "op9_near_dedup": op9_near_dedup,
    "op10_html_text": op10_html_text,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_sentence_pieces": op13_sentence_pieces,
}

ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": """
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
        ), win AS (
            SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)
        ), first AS (
            SELECT h, min(doc_id) AS f FROM win GROUP BY h
        ), gone AS (
            SELECT DISTINCT doc_id, i + k AS j FROM win JOIN first USING (h), range(50) t(k) WHERE f < doc_id
        ), word AS (
            SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS j FROM w
        ), kept AS (
            SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS t FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
        )
        SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
    """,
    "op9_near_dedup": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
        ), sh AS (
            SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
        ), n AS (
            SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
        ), pairs AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL
        ), links AS (
            SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
        ), reach AS (
            SELECT doc_id, doc_id AS r FROM w UNION SELECT y, r FROM reach JOIN links ON x = doc_id
        )
        SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
    """,
    "op5_warc_archives": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first FROM p
        )
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
            list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                (((('0x' || substr(hex, (k // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (k % 4))::INT) & 31) + 1)::INT, 1) FOR k IN range(32)], 'string_agg', '') AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM f
    """,
    "op12_importance_resampling": """
        WITH RECURSIVE step AS (
            SELECT i, 0 AS k, i::UINTEGER AS c FROM range(256) t(i)
            UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384::UINTEGER, c >> 1) ELSE c >> 1 END FROM step WHERE k < 8
        ), crc AS MATERIALIZED (
            SELECT list(c::BIGINT ORDER BY i) AS tab FROM step WHERE k = 8
        ), d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
        ), b AS (
            SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark
        ), df AS MATERIALIZED (
            SELECT doc_id, array_to_string(ws[i:i + n - 1], ' ') AS f, count(*) AS c
            FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, range(1, 4) t(n)) GROUP BY ALL
        ), bf AS MATERIALIZED (
            SELECT array_to_string(ws[i:i + n - 1], ' ') AS f, count(*) AS c FROM (SELECT ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM b, range(1, 4) t(n)) GROUP BY ALL
        ), hx AS (
            SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)
        ), feature AS MATERIALIZED (
            SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295, [('0x' || substr(h, k::INT * 2 + 1, 2))::BIGINT FOR k IN range(len(h) // 2)]),
                lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255) + 1]))) % 10000 AS bucket
            FROM hx, crc
        ), s AS (
            SELECT bucket, sum(c) AS s FROM df JOIN feature USING (f) GROUP BY bucket
        ), t AS (
            SELECT bucket, sum(c) AS t FROM bf JOIN feature USING (f) GROUP BY bucket
        ), total AS (
            SELECT (SELECT coalesce(sum(c), 0) FROM df) AS all_s, (SELECT coalesce(sum(c), 0) FROM bf) AS all_t
        ), gain AS (
            SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS g
            FROM s LEFT JOIN t USING (bucket), total
        ), w AS (
            SELECT doc_id, sum(c) AS n, sum(c * g) AS w FROM df JOIN feature USING (f) JOIN gain USING (bucket) GROUP BY doc_id
        ), scored AS (
            SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(w, 0)::BIGINT AS weight, len(ws) >= 20 AS able,
                coalesce(w, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
            FROM d LEFT JOIN w USING (doc_id)
        ), placed AS (
            SELECT *, CASE WHEN able THEN row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) END AS place FROM scored
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 5 * count(*) // 100 FROM scored WHERE able) THEN place END AS rank FROM placed
    """,
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS x
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), pair AS MATERIALIZED (
            SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
        ), pos AS (
            SELECT a, b, score FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
        )
        SELECT a AS anchor_id, pos.b AS positive_id, (row_number() OVER w)::INTEGER AS rank, n.b AS negative_id, pos.score AS positive_score, n.score AS negative_score
        FROM pos JOIN pair n USING (a) WHERE NOT n.same AND 50 * pos.score <= 100 * n.score AND 100 * n.score <= 95 * pos.score
        WINDOW w AS (PARTITION BY a, pos.b ORDER BY n.score DESC, n.b) QUALIFY rank <= 3
    """,
}
