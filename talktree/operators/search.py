"""Search over messages and conversations, conversation lists and title suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talktree.functions.text import bounded, contains, is_internal, match_column, normalize, snippet_column
from talktree.operators.archive import Archive
from talktree.plans.predicates import conversation_time, every, excluded, has_role, in_dates, in_source, message_filters, message_text, title_text
from talktree.plans.query import Query

MAX_CONVERSATIONS, MAX_MESSAGES, MAX_SUGGESTIONS = 100, 300, 20
_NODE = ["conversation_id", "node_id"]


def page(df: DataFrame, limit: int, offset: int = 0, maximum: int = MAX_CONVERSATIONS) -> DataFrame:
    """One page of an ordered result; the limit is at least 1 and at most ``maximum``."""
    limit = max(1, min(maximum, limit))
    return df.offset(offset).limit(limit) if offset > 0 else df.limit(limit)


def page_info(total: int, count: int, limit: int, offset: int = 0) -> dict:
    """What comes with a page of ``count`` rows out of ``total``."""
    more = offset + count < total
    return {"total": total, "limit": limit, "offset": offset, "has_more": more, "next_offset": offset + count if more else None}


PAGE_BYTES = 2 << 20


def bounded_page(items: DataFrame, size: int = PAGE_BYTES) -> DataFrame:
    """Items of an ordered page as JSON, up to the last that keeps the page within ``size`` bytes.

    The page is small already; its running size is taken over its rows in order.
    """
    rows = items.withColumn("_at", F.monotonically_increasing_id())
    value = F.to_json(F.struct(*items.columns))
    rows = rows.select("_at", value.alias("item"), F.octet_length(value).alias("_size"))
    total = F.sum(F.col("_size") + 1).over(Window.partitionBy(F.lit(0)).orderBy("_at"))
    return rows.withColumn("_total", total).where(F.col("_total") <= size).orderBy("_at").select("item")


def conversation_order(sort: str = "relevance") -> list[Column]:
    """Sort columns of conversation searches; they need ``score`` for relevance.  An unknown sort is an error."""
    recent, first = conversation_time(), F.coalesce("create_time", "update_time", F.lit(0.0))
    cid, title = F.col("conversation_id"), F.col("title").asc_nulls_first()
    orders = {
        "newest": [recent.desc(), title, cid],
        "updated": [recent.desc(), title, cid],
        "oldest": [first.asc(), title, cid],
        "created": [first.desc(), title, cid],
        "title": [F.lower(F.coalesce("title", F.lit(""))).asc(), cid],
    }
    return _known("sort", sort, orders | {"relevance": [F.desc("score"), recent.desc(), cid]})


def list_order(sort: str = "updated") -> list[Column]:
    """Sort columns of plain lists.  An unknown sort is an error."""
    recent, first = conversation_time(), F.coalesce("create_time", "update_time", F.lit(0.0))
    title = F.lower(F.coalesce("title", F.lit("")))
    orders = {"created": first.desc(), "oldest": first.asc(), "title": title.asc(), "updated": recent.desc()}
    return [_known("sort", sort, orders), F.col("conversation_id")]


def _known(kind: str, value: str, choices: dict):
    if value not in choices:
        raise ValueError(f"invalid_{kind}:{value}")
    return choices[value]


#: How much of each scalar a summary shows.
SUMMARY = {"title": 4_096, "source_file": 4_096, "current_node": 512}


def summaries(conversations: DataFrame) -> DataFrame:
    """Conversations as lists show them: long scalars cut, with ``_truncated`` and ``_length`` beside them."""
    keep = [c for c in conversations.columns if c not in SUMMARY and not c.endswith("_norm")]
    cut = [(c, bounded(F.col(c), n)) for c, n in SUMMARY.items() if c in conversations.columns]
    return conversations.select(*keep, *(x[part].alias(c + end) for c, x in cut for part, end in (("text", ""), ("truncated", "_truncated"), ("length", "_length"))))


def with_total(df: DataFrame) -> DataFrame:
    """A small result with its number of rows beside each row."""
    return df.join(F.broadcast(df.agg(F.count("*").alias("total_rows"))), F.lit(True))


def has_more(df: DataFrame, limit: int, offset: int = 0) -> bool:
    """Whether a page is followed by another, without counting the whole."""
    return df.offset(offset).limit(limit + 1).count() > limit


def list_conversations(archive: Archive, sort: str = "updated", after: float | None = None, before: float | None = None) -> DataFrame:
    """All conversations in a date range, in order."""
    q = Query(after=after, before=before)
    return archive.conversations.where(in_dates(q, conversation_time())).orderBy(*list_order(sort))


def listed(archive: Archive, sort: str = "updated", after: float | None = None, before: float | None = None, limit: int = 50, offset: int = 0, selected_id: str | None = None) -> DataFrame:
    """A page of a list as rows with counts, ``total`` and whether ``selected_id`` is in the list at all.

    ``place`` counts from the offset; a selected conversation that is in the list but not on the page follows
    with a null place.  Counts are made for the rows that are shown only.
    """
    q = Query(after=after, before=before)
    every_one = archive.conversations.where(in_dates(q, conversation_time()))
    shown = page(every_one.orderBy(*list_order(sort)), limit, max(offset, 0)).withColumn("_at", F.monotonically_increasing_id())
    shown = shown.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_at")) - 1 + max(offset, 0)).drop("_at")  # a page
    chosen = F.col("conversation_id") == F.lit(selected_id)
    extra = every_one.where(F.coalesce(chosen, F.lit(False))).join(shown.select("conversation_id"), "conversation_id", "left_anti")
    rows = shown.unionByName(extra.withColumn("place", F.lit(None).cast("int")))
    counts = archive.nodes.join(F.broadcast(rows.select("conversation_id")), "conversation_id", "left_semi").groupBy("conversation_id")
    counts = counts.agg(F.count("*").alias("node_count"), F.sum(F.coalesce((F.col("is_on_current_path") == 1).cast("long"), F.lit(0))).alias("current_path_nodes"))
    overall = every_one.agg(F.count("*").alias("total"), F.coalesce(F.max(chosen), F.lit(False)).alias("selected_in_results"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("node_count", "current_path_nodes")}
    rows = summaries(rows).join(F.broadcast(counts), "conversation_id", "left").withColumns(zero).join(F.broadcast(overall), F.lit(True))
    return rows.orderBy(F.col("place").asc_nulls_last())


def message_hits(archive: Archive, q: Query, bm25: DataFrame | None = None) -> DataFrame:
    """Messages whose own text fits the query, with their conversation's columns; no order.

    Queries without body text, and those of titles only, have no message hits.  ``bm25`` gives
    (conversation_id, node_id, bm25) of an index; without it that score is null.
    """
    nodes = archive.texts
    conv = archive.titled.select(
        "conversation_id", "title", "title_norm", "source_file", "source_norm", F.col("create_time").alias("conversation_create_time"), F.col("update_time").alias("conversation_update_time")
    )
    if not q.has_body or q.scope == "title":
        nodes = nodes.where(F.lit(False))
    body = message_text(q, F.col("norm"), F.col("text"), F.col("content_type")) & (F.col("text") != "")
    hits = nodes.where(body).join(conv, "conversation_id")
    time = conversation_time("conversation_create_time", "conversation_update_time")
    hits = hits.where(message_filters(q, F.col("role"), F.col("title_norm"), F.col("source_norm"), time))
    hits = hits.join(bm25, _NODE, "left") if bm25 is not None else hits.withColumn("bm25", F.lit(None).cast("double"))
    if q.path == "current":
        hits = hits.join(archive.paths_of(hits).select(*_NODE), _NODE, "left_semi")
    return hits


def bonus(score: Column) -> Column:
    """0 to 25 points for an index score; none without one."""
    return F.when(score.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 25.0 - F.least(F.lit(25.0), F.abs(score))))


def search_messages(archive: Archive, q: Query, order: str = "relevance", bm25: DataFrame | None = None) -> DataFrame:
    """Message hits with score, reasons, snippet and place of the match, in order.

    ``order`` is ``relevance`` or ``display``, the order in which a reader shows them; another is an error.
    """
    _known("order", order, dict.fromkeys(("relevance", "display")))
    hits = message_hits(archive, q, bm25)
    terms = q.highlight_terms
    if q.path == "current":
        current = F.lit(True)
    else:
        on = archive.paths_of(hits).select(*_NODE, F.lit(True).alias("_on"))
        hits = hits.join(on, _NODE, "left")
        current = F.coalesce("_on", F.lit(False))
    norm = F.col("norm")
    phrases = [contains(norm, p, q.match_mode) for p in (*q.phrases, *q.required_phrases) if p]
    words = [contains(norm, t, q.match_mode) for t in q.terms if t]
    points = lambda parts, n: sum((F.when(p, float(n)).otherwise(0.0) for p in parts), F.lit(0.0))
    score = F.lit(10.0) + F.when(current, 5.0).otherwise(0.0) + points(phrases, 35) + points(words, 12) + bonus(F.col("bm25"))
    found_by = "exact phrase" if bm25 is not None and (q.phrases or q.required_phrases) else "substring"
    reasons = F.array(F.lit(found_by), F.when(current, "current path"), F.when(any_of(phrases), "exact phrase"), F.when(any_of(words), "message match"))
    hits = hits.withColumns(
        {
            "effective_visible_in_current_view": current,
            "score": score,
            "reasons": F.array_sort(F.array_distinct(F.array_compact(reasons))),
            "snippet": snippet_column(F.col("text"), terms, q.match_mode),
            "match": match_column(F.col("text"), terms, q.match_mode),
            "is_internal": is_internal(F.col("role"), F.col("content_type"), F.col("text")),
        }
    )
    if order == "display":
        return display_order(hits, archive, q.path)
    recent = conversation_time("conversation_create_time", "conversation_update_time")
    return hits.orderBy(F.coalesce("bm25", F.lit(0.0)), recent.desc(), "conversation_id", F.col("create_time").asc_nulls_first(), "node_id")


def any_of(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def reading_keys() -> list[Column]:
    """Order of nodes by time: those without a creation time last."""
    return [F.col("create_time").isNull(), F.coalesce("create_time", "update_time", F.lit(0.0)), F.col("node_id")]


def display_order(hits: DataFrame, archive: Archive, path: str) -> DataFrame:
    """Hits as a reader shows them: chains from their root, then conversations taken whole by time."""
    if path != "current":
        return hits.orderBy(*reading_keys(), "conversation_id")
    place = archive.paths_of(hits).select(*_NODE, F.col("source").alias("_source"), F.col("depth").alias("_depth"))
    whole = F.col("_source") == "fallback_all"
    keys = [whole, F.when(~whole, F.col("_depth")).desc_nulls_last(), F.when(whole, F.col("create_time").isNull()), F.when(whole, F.coalesce("create_time", "update_time", F.lit(0.0))), F.col("node_id"), F.col("conversation_id")]
    return hits.join(place, _NODE).orderBy(*keys).drop("_source", "_depth")


def _without_excluded(found: DataFrame, archive: Archive, q: Query) -> DataFrame:
    """Drops conversations with an excluded fragment in the title or in a message on the searched path."""
    if not q.exclude:
        return found
    if q.scope != "message":
        clean = archive.titled.where(~excluded(q, F.col("title_norm"))).select("conversation_id")
        found = found.join(clean, "conversation_id", "left_semi")
    if q.scope != "title":
        bad = archive.texts.where(excluded(q, F.col("norm")))
        if q.path == "current":
            bad = bad.join(archive.paths_of(bad).select(*_NODE), _NODE, "left_semi")
        found = found.join(bad.select("conversation_id").distinct(), "conversation_id", "left_anti")
    return found


def filter_conversations(archive: Archive, q: Query) -> DataFrame:
    """Conversations that pass the filters of a query without search text; each scores 1."""
    found = archive.titled.where(in_dates(q, conversation_time()) & in_source(q, F.col("source_norm")))
    if q.role:
        said = archive.nodes.where(has_role(q, F.col("role")))
        if q.path == "current":
            said = said.join(archive.paths_of(said).select(*_NODE), _NODE, "left_semi")
        found = found.join(said.select("conversation_id").distinct(), "conversation_id", "left_semi")
    found = _without_excluded(found, archive, q)
    why = [("source match", bool(q.source)), ("role filter", bool(q.role)), ("date filter", q.after is not None or q.before is not None), ("exclude filter", bool(q.exclude))]
    reasons = [w for w, on in why if on] or ["filter match"]
    extra = {"hit_count": F.lit(0).cast("long"), "score": F.lit(1.0), "message_match": F.lit(False), "title_match": F.lit(False), "reasons": F.array(*map(F.lit, reasons))}
    return found.withColumns(extra)


def grouped_matches(archive: Archive, q: Query, bm25: DataFrame | None = None) -> DataFrame:
    """``(conversation_id, hit_count, score, message_match, title_match)`` of message and title hits together."""
    parts = []
    if q.scope != "title" and (q.has_body or q.role):
        if q.has_body:
            hits = message_hits(archive, q, bm25)
        else:  # a role and a title: every message of that role counts
            hits = message_hits(archive, _with_any_body(q), bm25)
        counts = hits.groupBy("conversation_id").agg(F.count("*").alias("hit_count"), F.max(bonus(F.col("bm25"))).alias("_bonus"))
        parts.append(counts.select("conversation_id", "hit_count", (F.col("hit_count") * 10.0 + F.col("_bonus")).alias("score"), F.lit(True).alias("message_match"), F.lit(False).alias("title_match")))
    if q.scope != "message" and not q.role:
        titles = archive.titled.where(title_text(q, F.col("title_norm"), F.col("source_norm")) & in_dates(q, conversation_time()))
        parts.append(titles.select("conversation_id", F.lit(0).cast("long").alias("hit_count"), F.lit(60.0).alias("score"), F.lit(False).alias("message_match"), F.lit(True).alias("title_match")))
    if not parts:
        return archive.conversations.where(F.lit(False)).select("conversation_id", *(F.lit(None).cast(k).alias(n) for n, k in (("hit_count", "long"), ("score", "double"), ("message_match", "boolean"), ("title_match", "boolean"))))
    union = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    found = union.groupBy("conversation_id").agg(F.sum("hit_count").alias("hit_count"), F.sum("score").alias("score"), F.max("message_match").alias("message_match"), F.max("title_match").alias("title_match"))
    return _without_excluded(found, archive, q)


def _with_any_body(q: Query) -> Query:
    """The query with one empty required phrase: every text has that."""
    return Query(**{**q.__dict__, "required_phrases": [""]})


def search_conversations(archive: Archive, q: Query, sort: str = "relevance", bm25: DataFrame | None = None) -> DataFrame:
    """Conversations that fit a query, in order: a list, a filtered list or scored matches."""
    if not q.is_search:
        return list_conversations(archive, sort if sort != "relevance" else "updated")
    if not q.has_text:
        return filter_conversations(archive, q).orderBy(*conversation_order(sort))
    found = grouped_matches(archive, q, bm25)
    why = F.array_compact(F.array(F.when(F.col("message_match"), "message match"), F.when(F.col("title_match"), "title match")))
    return found.join(archive.titled, "conversation_id").withColumn("reasons", why).orderBy(*conversation_order(sort))


def enrich(archive: Archive, q: Query, conversations: DataFrame, bm25: DataFrame | None = None, snippets: int = 3) -> DataFrame:
    """Adds to a page of conversations the first snippets by time and whether hits are internal or off the path."""
    hits = message_hits(archive, q, bm25).join(conversations.select("conversation_id"), "conversation_id", "left_semi")
    hits = hits.join(archive.paths_of(hits).select(*_NODE, F.lit(True).alias("_on")), _NODE, "left").withColumn("_on", F.coalesce("_on", F.lit(False)))
    inner = is_internal(F.col("role"), F.col("content_type"), F.col("text"))
    flags = hits.groupBy("conversation_id").agg(F.max(inner).alias("has_internal_hits"), F.max(~F.col("_on")).alias("has_branch_hits"))
    rank = F.row_number().over(Window.partitionBy("conversation_id").orderBy(*reading_keys()))
    top = hits.withColumn("_rank", rank).where(F.col("_rank") <= snippets)
    top = top.withColumn("snippet", snippet_column(F.col("text"), q.highlight_terms, q.match_mode))
    shown = F.struct(F.col("_rank").alias("rank"), "node_id", "role", "content_type", "snippet", F.col("_on").alias("effective_visible_in_current_view"), inner.alias("is_internal"))
    lists = top.groupBy("conversation_id").agg(F.array_sort(F.collect_list(shown)).alias("snippets"))
    return conversations.join(lists, "conversation_id", "left").join(flags, "conversation_id", "left").withColumns(
        {"has_internal_hits": F.coalesce("has_internal_hits", F.lit(False)), "has_branch_hits": F.coalesce("has_branch_hits", F.lit(False))}
    )


def is_selected(found: DataFrame, conversation_id: str) -> DataFrame:
    """Whether a conversation is among the results, as one row with ``selected_in_results``."""
    return found.where(F.col("conversation_id") == conversation_id).agg((F.count("*") > 0).alias("selected_in_results"))


def after_key(found: DataFrame, conversation_id: str, node_id: str) -> DataFrame:
    """Hits behind a (conversation, node) key, in key order: the next stretch of a long scan."""
    behind = (F.col("conversation_id") > conversation_id) | ((F.col("conversation_id") == conversation_id) & (F.col("node_id") > node_id))
    return found.where(behind).orderBy(*_NODE)


def last_key(found: DataFrame) -> DataFrame:
    """The greatest (conversation, node) key of some hits, as one row: where a long scan goes on with ``after_key``."""
    return found.agg(F.max(F.struct(*_NODE)).alias("_key")).select(*(F.col(f"_key.{n}").alias(n) for n in _NODE))


def suggest(archive: Archive, text: str, limit: int = 10) -> DataFrame:
    """The latest conversations whose title holds the text."""
    needle = normalize(text)
    fit = every([F.contains("title_norm", F.lit(needle))]) if needle else F.lit(True)
    found = archive.titled.where(fit).orderBy(conversation_time().desc(), "conversation_id")
    return page(found.select("conversation_id", "title", F.octet_length(F.coalesce("title", F.lit(""))).alias("title_bytes")), limit, maximum=MAX_SUGGESTIONS)


def diagnostics(q: Query, bm25: DataFrame | None = None) -> dict:
    """How a query would be run."""
    kind = "list" if not q.is_search else "search" if q.has_text else "filter"
    return {"kind": kind, "candidate_backend": "trigram" if bm25 is not None else "scan", "path": q.path, "scope": q.scope, "match_mode": q.match_mode, "or_mode": q.or_mode, "errors": list(q.errors)}
