"""Exact substring deduplication over a log-structured fingerprint index.

A window is ``window`` consecutive words of one document.  Of each window's word n-grams the one
with the smallest hash is its anchor, so equal windows have equal anchors at equal places.  All
consecutive windows with one anchor make a block: about one for each 20 words.  A block's
fingerprint is (anchor hash, context hash), the second over all words that its windows span.

The index holds, for each fingerprint, the smallest document that has it, as immutable sorted runs:
tables bucketed and sorted by anchor and context.  A new batch makes a run of its own:

* it is merge-joined with each older run, bucket by bucket as the files are sorted, which gives each of the
  batch's fingerprints its smallest document; a block whose fingerprint a smaller document has is repeated
  as a whole;
* where an anchor of the batch has several contexts, the windows of one document for each context are
  verified one by one by a 128-bit digest of their words, against all others of that anchor;
* then runs are compacted by tiers, by merge joins again.

A fingerprint is one row of a run, however many documents share it, so no bucket is hot; where rows of the
batch's documents are joined, it is with a plain table, so that a hot side can be split.  The work follows
the number of blocks and of contested windows, not the number of equal pairs.
"""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .shared import Scratch

_U = np.uint64


@dataclass(frozen=True)
class SubstringParams:
    """``first_batch``: the share of the id range that :func:`substring_dedup` indexes first.  ``max_runs`` runs are there at most."""

    window: int = 50
    gram: int = 8
    max_runs: int = 2
    first_batch: float = 0.25


@dataclass
class _Blocks:
    of: np.ndarray
    first: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    context: np.ndarray


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest value of values[i : i + width]."""
    n = len(values) - width + 1
    low, at, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        a, b = low[: len(low) - step], low[step:]
        right = b < a
        low, at = np.where(right, b, a), np.where(right, at[step:], at[: len(low) - step])
        span += step
    return at[:n]


def _hashes(block: W.Block) -> tuple[W.Words, np.ndarray, np.ndarray]:
    w = W.words(block)
    return w, W.span_hashes(block.data, w.start, w.end), W.span_hashes(block.data, w.start, w.end, 1)


def _blocks(w: W.Words, one: np.ndarray, two: np.ndarray, p: SubstringParams) -> _Blocks:
    at, of = W.gram_starts(w.bounds, p.window)
    if not len(at):
        none = np.zeros(0, np.int64)
        return _Blocks(none, none, none, none.view(np.uint64), none.view(np.uint64))
    grams = W.gram_hashes(one, np.arange(len(w) - p.gram + 1), p.gram)
    place = _sliding_argmin(grams, p.window - p.gram + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (of[1:] != of[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(at)))
    first = at[head]
    context = W.gram_hashes(two, first, count + p.window - 1, 1) ^ W.mix((place[head] - first).astype(np.uint64) + _U(977))
    return _Blocks(of[head], first, count, grams[place[head]], context)


def _fingerprints(p: SubstringParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for block in W.blocks(batch.column(1)):
                b = _blocks(*_hashes(block), p)
                yield pa.RecordBatch.from_arrays([pa.array(b.anchor.view(np.int64)), pa.array(b.context.view(np.int64)), pa.array(ids[block.first + b.of])], ["anchor", "context", "id"])

    return run


def _has(b: _Blocks, lists: pa.Array, block: W.Block) -> np.ndarray:
    """Whether each fingerprint block's context is in its document's list."""
    part = lists.slice(block.first, block.n)
    of = np.repeat(np.arange(block.n), part.value_lengths().to_numpy())
    listed = part.flatten().to_numpy().astype(np.int64).view(np.uint64)
    key = lambda d, c: W.mix(c + d.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    return np.isin(key(b.of, b.context), key(of, listed))


def _windows(p: SubstringParams):
    """(id, text, contested contexts) to the digests of the contested windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for block in W.blocks(batch.column(1)):
                w, one, two = _hashes(block)
                b = _blocks(w, one, two, p)
                hit = _has(b, batch.column(2), block)
                first, count, of = b.first[hit], b.count[hit], b.of[hit]
                rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                at, of = np.repeat(first, count) + rank, np.repeat(of, count)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(W.gram_hashes(one, at, p.window).view(np.int64)),
                        pa.array(W.gram_hashes(two, at, p.window, 1).view(np.int64)),
                        pa.array(ids[block.first + of]),
                        pa.array((at - w.bounds[of]).astype(np.int32)),
                    ],
                    ["w1", "w2", "id", "at"],
                )

    return run


def kept_texts(block: W.Block, w: W.Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each text joined by one space: all bytes, and where each text starts and ends."""
    kept = np.flatnonzero(keep)
    of = w.of[kept]
    joined = np.append(of[1:] == of[:-1], False)[: len(kept)]
    data = block.data.copy()
    data[w.end[kept[joined]]] = 0x20
    chosen = W.cover(w.start[kept], w.end[kept] + joined, len(data))
    total = np.concatenate([[0], np.cumsum(chosen)])
    return data[chosen], total[block.offsets]


def _removal(p: SubstringParams, with_text: bool):
    """(id, text, repeated contexts, repeated window starts) to the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in W.blocks(batch.column(1)):
                w, one, two = _hashes(block)
                b = _blocks(w, one, two, p)
                hit = _has(b, batch.column(2), block)
                part = batch.column(3).slice(block.first, block.n)
                of = np.repeat(np.arange(block.n), part.value_lengths().to_numpy())
                single = w.bounds[of] + part.flatten().to_numpy().astype(np.int64)
                gone = W.cover(np.concatenate([b.first[hit], single]), np.concatenate([b.first[hit] + b.count[hit] + p.window - 1, single + p.window]), len(w))
                text, cut = kept_texts(block, w, ~gone)
                raw = text.tobytes()
                parts = [raw[x:y] for x, y in zip(cut[:-1], cut[1:])]
                columns = [
                    batch.column(0).slice(block.first, block.n),
                    pa.array(np.diff(w.bounds)),
                    pa.array(W.sums(gone, w.bounds)),
                    pa.array([hashlib.sha256(x).hexdigest() for x in parts]),
                ]
                names = ["id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    columns.append(pa.array([x.decode("utf-8") for x in parts]))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


@dataclass
class Run:
    """A sorted run: a table of (anchor, context, id), its folder, and how many rows it has."""

    table: str
    path: str
    rows: int


def to_compact(rows: list[int], most: int) -> int:
    """How many of the newest runs to make one, given their rows from the oldest: those that are together
    large beside the next, if there are ``most`` of them, and no fewer than what leaves ``most`` runs."""
    take, held = 0, 0
    for n in reversed(rows):
        if take and n > most * max(held, 1):
            break
        take, held = take + 1, held + n
    take = take if take >= most else 0
    return max(take, len(rows) - most + 1 if len(rows) > most else 0)


class FingerprintIndex:
    """Sorted runs of historical block fingerprints, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, params: SubstringParams | None = None):
        self.params = params or SubstringParams()
        self.spark, self.scratch = spark, Scratch(spark)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[Run] = []
        self.last: int | None = None
        # a bucket of a run is one sorted file; this lets a join take it as sorted
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def _written(self, rows: DataFrame, name: str) -> Run:
        """A run of rows that are unique by anchor and context."""
        path, table = self.scratch.path(name), f"talktree_run_{uuid.uuid4().hex}"
        writer = rows.select("anchor", "context", "id").write.format("parquet").option("path", path)
        writer.bucketBy(self.buckets, "anchor", "context").sortBy("anchor", "context").saveAsTable(table)
        run = Run(table, path, 0)
        run.rows = self._plain(run).count()
        return run

    def _table(self, run: Run) -> DataFrame:
        return self.spark.table(run.table).hint("merge")

    def _plain(self, run: Run) -> DataFrame:
        """The run's rows, not as a bucketed table."""
        return self.spark.read.schema("anchor long, context long, id long").parquet(run.path)

    def _merged(self, x: DataFrame, y: DataFrame, how: str) -> DataFrame:
        """Two runs merge-joined, with the smallest document of each fingerprint."""
        x, y = x.alias("x"), y.alias("y")
        same = (F.col("x.anchor") == F.col("y.anchor")) & (F.col("x.context") == F.col("y.context"))
        key = lambda c: F.coalesce(f"x.{c}", f"y.{c}") if how == "full_outer" else F.col(f"x.{c}")
        return x.join(y, same, how).select(key("anchor").alias("anchor"), key("context").alias("context"), F.least("x.id", "y.id").alias("id"))

    def _drop(self, *runs: Run) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run.table}")
            self.scratch.remove(run.path)

    def compact(self) -> None:
        """Makes the newest runs one where their sizes ask for it."""
        take = to_compact([r.rows for r in self.runs], self.params.max_runs)
        if take:
            old = self.runs[-take:]
            rows = self._table(old[0])
            for run in old[1:]:
                rows = self._merged(rows, self._table(run), "full_outer")
            self.runs[-take:] = [self._written(rows, "compacted")]
            self._drop(*old)

    def close(self) -> None:
        """Drops the runs."""
        self._drop(*self.runs)
        self.runs = []

    def add(self, batch: DataFrame, store: DataFrame, with_text: bool = False) -> DataFrame:
        """Judges the (id, text) rows of ``batch`` against the index and each other, and indexes them.

        ``store`` has the text of every document that is indexed, the batch's included.  Batches come
        by ascending id, for a later one with smaller ids would not change what was said of earlier ones;
        a batch with an id below an earlier batch's largest is an error.
        Only windows at anchors that the batch has are verified, so history is not gone through again.
        """
        p, keep = self.params, self.scratch.keep
        ends = batch.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
        if self.last is not None and ends.lo is not None and ends.lo < self.last:
            raise ValueError("batches have to come by ascending id")
        self.last = ends.hi if ends.hi is not None else self.last
        prints = keep(batch.where("id is not null").mapInArrow(_fingerprints(p), "anchor long, context long, id long"), "prints")
        own = prints.groupBy("anchor", "context").agg(F.min("id").alias("id"))
        new = self._written(own.repartition(self.buckets, "anchor", "context"), "run")
        owners, there = self._plain(new), self._plain(new)
        if self.runs:
            merged = self._table(new)
            for run in self.runs:
                merged = self._merged(merged, self._table(run), "left")
            owners = keep(merged, "owners")
            fresh = owners.select("anchor").distinct().hint("shuffle_hash")
            there = owners
            for run in self.runs:  # what history has at the batch's anchors
                there = there.union(self._plain(run).join(fresh, "anchor", "left_semi"))
            there = keep(there.groupBy("anchor", "context").agg(F.min("id").alias("id")), "there")
        repeated = prints.join(owners.withColumnRenamed("id", "owner"), ["anchor", "context"]).where("id > owner").select("id", "context")
        repeated = repeated.groupBy("id").agg(F.collect_set("context").alias("whole"))

        several = there.groupBy("anchor").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("n > 1 and lo < hi").select("anchor")
        contested = there.join(several, "anchor").groupBy("id").agg(F.collect_set("context").alias("contested"))
        windows = store.join(contested, "id").select("id", "text", "contested").mapInArrow(_windows(p), "w1 long, w2 long, id long, at int")
        windows = keep(windows, "windows")
        low = windows.groupBy("w1", "w2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("w1", "w2", "lo")
        starts = windows.join(low, ["w1", "w2"]).where("id > lo").groupBy("id").agg(F.collect_set("at").alias("starts"))

        found = repeated.join(starts, "id", "full_outer")
        empty = lambda c, t: F.coalesce(F.col(c), F.expr(f"cast(array() as array<{t}>)")).alias(c)
        todo = batch.join(found, "id", "left").select("id", "text", empty("whole", "bigint"), empty("starts", "int"))
        out = todo.mapInArrow(_removal(p, with_text), "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
        judged = keep(out, "judged")
        self.scratch.drop(prints, windows, owners, there)
        self.runs.append(new)
        self.compact()
        return judged


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: SubstringParams | None = None, with_text: bool = False) -> DataFrame:
    """``(id_col, n_words, n_removed, kept_sha256[, kept_text])`` per row of ``docs``.

    A word is removed if a window covers it whose words also start in a document with a smaller id;
    windows are judged on the input.  The rows are indexed in two batches by ascending id, so the
    second is merged with the first one's run.  Null and empty texts, and those of fewer words than
    a window, lose nothing.  A row with a null id is kept whole and supplies nothing.  Rows that
    repeat an id lose only what smaller ids have.  Other columns are not read.
    """
    p = params or SubstringParams()
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ends = rows.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    index = FingerprintIndex(spark, p)
    if ends.lo is None:
        out = index.add(rows, rows, with_text)
    else:
        cut = ends.lo + int((ends.hi - ends.lo) * p.first_batch)
        early, late = rows.where(F.col("id") <= cut), rows.where((F.col("id") > cut) | F.col("id").isNull())
        out = index.add(early, early, with_text)
        gc.collect()
        out = out.union(index.add(late, rows, with_text))
    index.close()
    return out.withColumnRenamed("id", id_col)
