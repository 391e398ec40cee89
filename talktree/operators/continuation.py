"""Cursors: a long scan goes on where it stopped, and a long message is read piece by piece.

A cursor is opaque to its holder.  It says which snapshot and which query, or which text, it belongs to and
where it stands, and is signed with the caller's secret; one that is altered, or that meets another query
or a text that has changed, is refused.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talktree.operators import index, search
from talktree.operators.store import Store
from talktree.plans.query import Query

VERSION = 1
#: Why a cursor is refused.
INVALID, STALE, OTHER_QUERY = "invalid_search_continuation", "search_continuation_stale", "search_continuation_query_mismatch"
INVALID_CHUNK, STALE_CHUNK = "invalid_display_cursor", "display_cursor_stale"
#: An anchor stands at most so many characters behind its chunk's beginning.
MAX_LEAD = 4_096
MAX_CHUNK = 65_536


class CursorError(ValueError):
    """A cursor that can't be used; its text is the reason."""


def _signed(payload: bytes, secret: bytes) -> str:
    return base64.urlsafe_b64encode(payload + hmac.new(secret, payload, hashlib.sha256).digest()).rstrip(b"=").decode()


def _opened(cursor: str, secret: bytes) -> list:
    try:
        raw = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4))
        payload, mark = raw[:-32], raw[-32:]
        if _signed(payload, secret) != cursor or not hmac.compare_digest(mark, hmac.new(secret, payload, hashlib.sha256).digest()):
            raise CursorError(INVALID)
        found = json.loads(payload)
    except (ValueError, TypeError) as e:
        raise CursorError(INVALID) from e
    if not isinstance(found, list) or len(found) != 5 or found[0] != VERSION:
        raise CursorError(INVALID)
    return found


def query_digest(q: Query) -> str:
    """Equal for queries that ask the same."""
    asked = {k: v for k, v in asdict(q).items() if k not in ("original", "errors")}
    return hashlib.sha256(json.dumps(asked, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


@dataclass
class Stretch:
    """Hits of a scan in key order, and the cursor that the next stretch begins with, None at the end."""

    hits: DataFrame
    cursor: str | None


def scan_messages(store: Store, q: Query, secret: bytes, limit: int = 1000, cursor: str | None = None) -> Stretch:
    """The next ``limit`` hits of a search over messages, in key order.

    The first stretch takes the store's current snapshot and the others stay with it, so stretches joined are
    the whole result whatever is imported meanwhile.  Raises CursorError for a cursor of another query, of a
    snapshot that is gone, or that nobody here signed.
    """
    version, key = store.version(), None
    if cursor is not None:
        _, version, digest, *key = _opened(cursor, secret)
        if digest != query_digest(q):
            raise CursorError(OTHER_QUERY)
        if version and version not in store.versions():
            raise CursorError(STALE)
    archive, postings = store.indexed(version)
    if postings is not None:
        archive = index.narrowed(archive, postings, q)
    hits = search.message_hits(archive, q)
    hits = search.after_key(hits, *key) if key else hits.orderBy("conversation_id", "node_id")
    keys = [tuple(r) for r in hits.select("conversation_id", "node_id").limit(limit + 1).collect()]
    if len(keys) <= limit:
        return Stretch(hits, None)
    last = keys[limit - 1]
    body = json.dumps([VERSION, version, query_digest(q), *last], ensure_ascii=False).encode()
    return Stretch(hits.limit(limit), _signed(body, secret))


def _mark(body: Column, secret: str) -> Column:
    """A keyed hash in two steps, of which the outer hides the inner."""
    key = hashlib.sha256(secret.encode()).hexdigest()
    return F.sha2(F.concat(F.lit(key), F.sha2(F.concat(F.lit(key), body), 256)), 256)


def _identity() -> Column:
    return F.sha2(F.concat_ws("\x1f", "conversation_id", "node_id"), 256)


def chunk_cursor(offset: Column, revision: Column, secret: str) -> Column:
    """A cursor: version, place, revision, and the mark of these and of the message."""
    head = F.concat_ws(".", F.lit(str(VERSION)), offset.cast("string"), revision)
    return F.concat_ws(".", head, _mark(F.concat_ws(".", head, _identity()), secret))


def display_chunks(messages: DataFrame, secret: str, limit: int = MAX_CHUNK, offset: Column | None = None, cursor: Column | None = None, anchor: Column | None = None) -> DataFrame:
    """A piece of the ``text`` of each message: from ``offset``, from a cursor, or around an anchor.

    Where an anchor is given, the piece begins half its length before, ``MAX_LEAD`` characters at most; else
    where a cursor is given, at its place; else at the offset.  Places count characters, so none is split.
    ``problem`` is invalid_display_cursor for a cursor that was not made for this message, or that comes with an
    anchor, and display_cursor_stale if the text has changed since; then there is no chunk.
    """
    text, limit = F.col("text"), max(1, min(limit, MAX_CHUNK))
    revision = F.sha2(text, 256)
    none = F.lit(None).cast("string")
    cursor = none if cursor is None else cursor
    anchor = F.lit(None).cast("int") if anchor is None else anchor
    start = F.greatest(F.coalesce(F.lit(0) if offset is None else offset, F.lit(0)), F.lit(0))
    parts = F.split(cursor, r"\.")
    place = F.when(F.size(parts) == 4, parts[1].try_cast("int"))
    known = F.when(F.size(parts) == 4, parts[3]) == _mark(F.concat_ws(".", parts[0], parts[1], parts[2], _identity()), secret)
    problem = (
        F.when(cursor.isNull(), none)
        .when(anchor.isNotNull() | place.isNull() | ~F.coalesce(known, F.lit(False)) | (parts[0] != str(VERSION)), INVALID_CHUNK)
        .when(parts[2] != revision, STALE_CHUNK)
    )
    around = F.greatest(anchor - F.least(F.lit(limit // 2), F.lit(MAX_LEAD)), F.lit(0))
    at = F.when(anchor.isNotNull(), around).when(cursor.isNotNull(), place).otherwise(start).cast("int")
    rows = messages.withColumns({"problem": problem, "offset": F.least(at, F.length(text)), "total_chars": F.length(text), "revision": revision})
    rows = rows.withColumn("chunk", F.when(F.col("problem").isNull(), F.substring(text, F.col("offset") + 1, F.lit(limit))))
    end = F.col("offset") + F.length("chunk")
    more = end < F.col("total_chars")
    return rows.select(
        "conversation_id", "node_id", "chunk", F.when(F.col("problem").isNull(), F.col("offset")).alias("offset"), F.length("chunk").alias("returned_chars"), "total_chars", F.coalesce(more, F.lit(False)).alias("has_more"),
        F.when(more, end).alias("next_offset"), F.when(more, chunk_cursor(end, revision, secret)).alias("next_cursor"), "revision", F.when(anchor.isNotNull() & F.col("problem").isNull(), anchor - F.col("offset")).alias("anchor_in_chunk"), "problem",
    )
