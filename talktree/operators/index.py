"""Trigram postings over normalised texts: candidates for searches, and their BM25 scores.

The index never decides what is a hit; it narrows down what the exact predicate is run on.  A posting
has the places of its trigram in the message and the message's length, so how often a longer stretch
occurs follows from places that fit together, and scores need no text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talktree.functions.batches import bounded_batches
from talktree.functions.text import normalize, recover
from talktree.operators import search
from talktree.operators.archive import Archive
from talktree.plans.predicates import conversation_time, message_filters
from talktree.plans.query import Query

#: Constants of BM25 and of its smallest inverse document frequency.
K1, B, MIN_IDF = 1.2, 0.75, 1e-6
_NODE = ["conversation_id", "node_id"]
POSTINGS = "trigram string, conversation_id string, node_id string, positions array<int>, size int"
_LISTED = [*_NODE, "positions", "size"]
PACKED = "trigram string, conversation_id array<string>, node_id array<string>, positions array<array<int>>, size array<int>"
#: Characters whose postings are made at once: some 20 MB of arrays.
_BLOCK = 1 << 18


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of rows as ``Archive.norms`` gives them, a block of messages at a time."""
    for batch in batches:
        kept, texts, held = [], [], 0
        for i, (norm, text, raw) in enumerate(zip(*(batch.column(c) for c in ("norm", "text", "raw")))):
            found = norm.as_py() if norm.is_valid else normalize(recover(text.as_py(), raw.as_py()))
            if len(found) >= 3:
                kept.append(i)
                texts.append(found)
                held += len(found)
            if held >= _BLOCK:
                yield _block_postings(batch.take(pa.array(kept)), texts)
                kept, texts, held = [], [], 0
        if kept:
            yield _block_postings(batch.take(pa.array(kept)), texts)


def _block_postings(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
    """Postings of some messages, each of three characters or more: places grouped by message and trigram."""
    size = np.array([len(t) - 2 for t in texts], np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
    of = np.repeat(np.arange(len(texts)), size)
    place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    at = place + np.repeat(np.cumsum(size + 2) - size - 2, size)
    key = chars[at] << 42 | chars[at + 1] << 21 | chars[at + 2]
    order = np.lexsort((place, key, of))
    of, key, place = of[order], key[order], place[order]
    first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (key[1:] != key[:-1]))) if len(of) else np.zeros(0, np.int64)
    grams, which = np.unique(key[first], return_inverse=True)
    names = [chr(g >> 42) + chr(g >> 21 & 0x1FFFFF) + chr(g & 0x1FFFFF) for g in grams.tolist()]
    rows = pa.array(of[first])
    positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(of)).astype(np.int32)), pa.array(place.astype(np.int32)))
    columns = [pa.array(names, pa.string()).take(pa.array(which)), batch.column("conversation_id").take(rows), batch.column("node_id").take(rows), positions, pa.array(size[of[first]].astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, ["trigram", *_NODE, "positions", "size"])


def build(archive: Archive) -> DataFrame:
    """``(trigram, conversation_id, node_id, positions, size)``: each distinct three-character stretch of each message.

    ``positions`` are where it begins, in characters from 0; ``size`` is how many stretches the message has.
    """
    bounded_batches(archive.nodes.sparkSession)
    return archive.norms.mapInArrow(_postings, POSTINGS)


def lengths(archive: Archive) -> DataFrame:
    """``(conversation_id, messages, size)``: how many messages have a text, and their stretches together."""
    rows = archive.texts.where(F.col("text") != "")
    return rows.groupBy("conversation_id").agg(F.count("*").alias("messages"), F.sum(_size()).alias("size"))


def _size() -> Column:
    return F.greatest(F.length("norm") - 2, F.lit(0)).cast("long")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each trigram of a block, with its postings there as lists."""
    for block in _postings(batches):
        grams = block.column("trigram").dictionary_encode()
        of = grams.indices.to_numpy()
        rows = block.take(pa.array(np.argsort(of, kind="stable")))
        ends = pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=len(grams.dictionary)))).astype(np.int32))
        yield pa.RecordBatch.from_arrays([grams.dictionary, *(pa.ListArray.from_arrays(ends, rows.column(c)) for c in _LISTED)], ["trigram", *_LISTED])


def unpacked(stored: DataFrame) -> DataFrame:
    """Postings as ``build`` gives them, of a table that ``write`` made; trigrams are chosen before lists are unpacked."""
    return stored.select("trigram", F.inline(F.arrays_zip(*_LISTED)))


def write(archive: Archive, folder: str) -> None:
    """Writes the postings packed by trigram and block, and sorted, so that a look-up reads few row groups."""
    bounded_batches(archive.nodes.sparkSession)
    archive.norms.mapInArrow(_packed, PACKED).repartition("trigram").sortWithinPartitions("trigram").write.mode("overwrite").parquet(folder)


def _parts(fragment: str) -> list[str]:
    norm = normalize(fragment)
    return [] if '"' in norm else [p for p in norm.split(" ") if len(p) >= 3]


def plan(q: Query) -> list[list[str]] | None:
    """Groups of stretches: a candidate has all of some group.  None if the index can't narrow the query down.

    In OR mode every fragment must have a stretch, or else texts that only have the short one would
    be missed.  Required fragments hold in every group.
    """
    wanted = [_parts(f) for f in (*q.phrases, *q.terms) if normalize(f)]
    required = [p for f in q.required_phrases for p in _parts(f)]
    if q.or_mode and wanted:
        if not all(wanted):
            return [required] if required else None
        return [[*w, *required] for w in wanted]
    whole = [p for w in wanted for p in w] + required
    return [whole] if whole else None


def candidates(postings: DataFrame, q: Query) -> DataFrame | None:
    """``(conversation_id, node_id)`` that can be hits; None for all."""
    groups = plan(q)
    return None if groups is None else _with_any(postings, groups)


def _with_any(postings: DataFrame, groups: list[list[str]]) -> DataFrame:
    """Messages with every trigram of all stretches of some group."""
    out = None
    for parts in groups:
        grams = sorted({p[i : i + 3] for p in parts for i in range(len(p) - 2)})
        found = postings.where(F.col("trigram").isin(grams)).groupBy(*_NODE).agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select(*_NODE)
        out = found if out is None else out.union(found)
    return out.distinct()


def narrowed(archive: Archive, postings: DataFrame, q: Query) -> Archive:
    """The archive with only candidate messages; paths and titles stay those of the whole.

    Exclusions look at all messages of a conversation, so with them the archive stays whole.
    """
    found = None if q.exclude else candidates(postings, q)
    if found is None:
        return archive
    return Archive(archive.conversations, archive.texts.join(found, _NODE, "left_semi"), whole=archive, complete=archive.complete)


def _stretches(q: Query) -> list[str]:
    return list(dict.fromkeys(p for f in (*q.phrases, *q.terms, *q.required_phrases) for p in _parts(f)))


def _bm25(frequencies: list[Column], frequency_of: list[Column]) -> Column:
    """The score of a row with ``_n``, ``_avg`` and ``_size``, given each stretch's frequency and number of messages."""
    score = F.lit(0.0)
    for f, d in zip(frequencies, frequency_of):
        idf = F.log((F.col("_n") - d + 0.5) / (d + 0.5))
        score = score - F.greatest(idf, F.lit(MIN_IDF)) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_size") / F.greatest(F.col("_avg"), F.lit(1e-9))))
    return score


def _grams(part: str) -> dict[int, str]:
    """Trigrams of a stretch by offset, as few as cover it."""
    return {i: part[i : i + 3] for i in (*range(0, len(part) - 3, 3), len(part) - 3)}


def _begins(grams: list[str], text: str) -> Column:
    """The places where a text of three characters or more begins, from the grouped lists ``_p0``...; null if a trigram is missing."""

    def shifted(gram: str, offset: int) -> Column:
        return F.transform(F.col(f"_p{grams.index(gram)}"), lambda x: x - offset)

    return reduce(F.array_intersect, [shifted(g, i) for i, g in _grams(text).items()])


def _frequency(grams: list[str], text: str) -> Column:
    # size() of null is -1 where the session says so
    return F.greatest(F.coalesce(F.size(_begins(grams, text)), F.lit(0)), F.lit(0))


def _grouped(postings: DataFrame, grams: list[str]) -> DataFrame:
    """A row for each message with any of the trigrams: its length and the places of each."""
    lists = [F.max(F.when(F.col("trigram") == g, F.col("positions"))).alias(f"_p{k}") for k, g in enumerate(grams)]
    return postings.where(F.col("trigram").isin(grams)).groupBy(*_NODE).agg(F.max("size").cast("double").alias("_size"), *lists)


def bm25_postings(archive: Archive, postings: DataFrame, q: Query, sizes: DataFrame | None = None) -> DataFrame:
    """``bm25`` from postings: no text is read, and of the postings only those of the query's trigrams.

    A stretch occurs where all its trigrams do at their offsets.  ``sizes`` is a stored ``lengths`` table;
    without one it is made from the archive's texts.
    """
    parts = _stretches(q)
    grams = sorted({g for p in parts for g in _grams(p).values()})
    rows = _grouped(postings, grams)
    rows = rows.select(*_NODE, "_size", *(_frequency(grams, p).alias(f"_f{i}") for i, p in enumerate(parts)))
    hit = reduce(lambda a, b: a | b, (F.col(f"_f{i}") > 0 for i in range(len(parts))), F.lit(False))
    rows = rows.where(hit)
    known = sizes if sizes is not None else lengths(archive)
    overall = known.agg(F.coalesce(F.sum("messages"), F.lit(0)).alias("_n"), (F.sum("size") / F.sum("messages")).alias("_avg"))
    having = rows.agg(*(F.coalesce(F.sum((F.col(f"_f{i}") > 0).cast("long")), F.lit(0)).alias(f"_d{i}") for i in range(len(parts))), F.lit(1).alias("_one"))
    totals = overall.join(F.broadcast(having), F.lit(True))  # one row beside one row
    score = _bm25([F.col(f"_f{i}") for i in range(len(parts))], [F.col(f"_d{i}") for i in range(len(parts))])
    return rows.join(F.broadcast(totals), F.lit(True)).select(*_NODE, score.alias("bm25"))


def bm25(archive: Archive, q: Query, postings: DataFrame | None = None) -> DataFrame:
    """``(conversation_id, node_id, bm25)`` of messages with any of the query's stretches; more negative is better.

    A stretch's frequency is how often it occurs, overlaps included; a message's length is its
    number of trigrams.  With ``postings`` stretches are looked for only in messages that have all
    their trigrams; of the others only the length is read.
    """
    parts = _stretches(q)
    rows = archive.texts.where(F.col("text") != "")
    size = F.greatest(F.length("norm") - 2, F.lit(0)).cast("double")
    if not parts:
        return rows.where(F.lit(False)).select(*_NODE, F.lit(None).cast("double").alias("bm25"))
    count = lambda p: F.regexp_count(F.col("norm"), F.lit("(?=" + re.sub(r"([^a-z0-9])", lambda m: "\\x{%x}" % ord(m[1]), p) + ")"))
    overall = [F.count("*").alias("_n"), F.avg("_size").alias("_avg")]
    having = [F.coalesce(F.sum(F.when(F.col(f"_f{i}") > 0, 1).otherwise(0)), F.lit(0)).alias(f"_d{i}") for i in range(len(parts))]
    every_row = rows
    if postings is not None:
        rows = rows.join(_with_any(postings, [[p] for p in parts]), _NODE, "left_semi")
    rows = rows.select(*_NODE, size.alias("_size"), *(F.when(F.contains("norm", F.lit(p)), count(p)).otherwise(0).alias(f"_f{i}") for i, p in enumerate(parts)))
    if postings is None:
        totals = rows.agg(*overall, *having)
    else:  # one row beside one row
        totals = every_row.select(size.alias("_size")).agg(*overall).join(F.broadcast(rows.agg(*having)), F.lit(True))
    score = _bm25([F.col(f"_f{i}") for i in range(len(parts))], [F.col(f"_d{i}") for i in range(len(parts))])
    hit = F.lit(False)
    for i in range(len(parts)):
        hit = hit | (F.col(f"_f{i}") > 0)
    return rows.where(hit).join(F.broadcast(totals), F.lit(True)).select(*_NODE, score.alias("bm25"))


def exact_hits(postings: DataFrame, q: Query) -> DataFrame | None:
    """``(conversation_id, node_id)`` of messages whose text fits the query, told by places alone; None where that can't be.

    It can where fragments are looked for anywhere in a text and all have three characters or more.
    """
    wanted = [normalize(f) for f in (*q.phrases, *q.terms) if normalize(f)]
    needed, without = ([normalize(f) for f in fs if normalize(f)] for fs in (q.required_phrases, q.exclude))
    texts = [*wanted, *needed, *without]
    if q.match_mode != "contains" or q.scope == "title" or not (wanted or needed) or min(map(len, texts)) < 3:
        return None
    grams = sorted({g for t in texts for g in _grams(t).values()})
    has = lambda t: _frequency(grams, t) > 0
    fit = reduce((lambda a, b: a | b) if q.or_mode else (lambda a, b: a & b), map(has, wanted)) if wanted else F.lit(True)
    fit = reduce(lambda a, b: a & b, map(has, needed), fit) & ~reduce(lambda a, b: a | b, map(has, without), F.lit(False))
    return _grouped(postings, grams).where(fit).select(*_NODE)


def relevance_page(archive: Archive, postings: DataFrame, q: Query, limit: int = 20, sizes: DataFrame | None = None) -> DataFrame | None:
    """The first ``limit`` rows of ``search_messages`` by relevance, or None where ``exact_hits`` is.

    Which messages are shown follows from postings and from columns without text; only the texts that are shown
    are read.  The archive has to be an indexed one.
    """
    found = exact_hits(postings, q)
    if found is None:
        return None
    scores = bm25_postings(archive, postings, q, sizes)
    plain = archive.nodes.select(*_NODE, "role", "create_time", "generated").where(~F.col("generated"))
    conv = archive.titled.select("conversation_id", "title_norm", "source_norm", conversation_time().alias("_time"))
    rows = plain.join(found, _NODE).join(conv, "conversation_id").where(message_filters(q, F.col("role"), F.col("title_norm"), F.col("source_norm"), F.col("_time")))
    if q.path == "current":
        rows = rows.join(archive.paths_of(rows).select(*_NODE), _NODE, "left_semi")
    order = [F.coalesce("bm25", F.lit(0.0)), F.desc("_time"), F.col("conversation_id"), F.col("create_time").asc_nulls_first(), F.col("node_id")]
    shown = rows.join(scores, _NODE, "left").orderBy(*order).select(*_NODE, "bm25").limit(max(1, min(limit, search.MAX_MESSAGES)))
    keys = [tuple(r) for r in shown.collect()]  # a page
    kept = archive.nodes.sparkSession.createDataFrame(keys, "conversation_id string, node_id string, bm25 double")
    pruned = archive.nodes.where(F.col("conversation_id").isin([k[0] for k in keys]))  # read by row groups
    nodes = pruned.join(F.broadcast(kept.select(*_NODE)), _NODE, "left_semi")
    return search.search_messages(Archive(archive.conversations, nodes, whole=archive, complete=True), q, bm25=kept)
