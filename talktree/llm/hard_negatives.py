"""Hard negatives by product quantisation with stored residual norms.

Vectors are cut into short parts, each replaced by the nearest of its codebook's centroids; a row of
the index keeps these codes, the norm of what they leave out, and the integer vector.  For an anchor,
tables of inner products with all centroids give every row's approximate score by look-ups.  The exact
score lies within the product of the anchor's norm and the row's residual norm, so bounds on scores
leave out only rows that cannot be among the answers, and exact integer scores settle the rest.

Anchors are a stated part of the rows.  They are taken in chunks of bounded bytes, and for each chunk
all rows are read once; a task keeps a few rows for each anchor, however many it reads.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

_ROWS, _ANCHORS = 2048, 256
_PAIRS = 1 << 16
_EXACT = 2.0**53
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class NegativeParams:
    """``scale``: components become floor(scale * x).  ``low``, ``high``: a negative's score as percents of the positive's.

    ``width``: components to a part.  ``centroids``: at most 256.  ``sample`` rows train the codebooks.
    ``chunk_bytes`` of anchors travel with a pass over the rows; ``rows_per_task`` at least are read by one task.
    """

    scale: int = 256
    every: int = 50
    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    width: int = 2
    centroids: int = 256
    sample: int = 4096
    chunk_bytes: int = 32 << 20
    rows_per_task: int = 4096
    tasks: int = 512


def valid_rows(rows: DataFrame, params: NegativeParams, vector: str = "embedding") -> DataFrame:
    """vec_id, label and ints of the rows that take part.

    A null id, label, vector or component and a component that is not finite keep a row out.  Of rows
    that repeat an id one counts, the one with the smallest label and then vector.
    """
    x = F.col(vector)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ints = F.transform(x, lambda v: F.floor(v.cast("double") * params.scale).cast("long"))
    one = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))
    one = one.select("vec_id", F.struct(F.col("label").cast("long").alias("label"), ints.alias("ints")).alias("row"))
    return one.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.ints")


@dataclass
class Codebooks:
    """``centers[m, k]`` is centroid k of part m; vectors are padded with zeros to ``dim``."""

    centers: np.ndarray
    dim: int
    width: int

    def parts(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors of the sample's dimension, cut and padded: (part, row, width)."""
        m, _, w = self.centers.shape
        out = np.zeros((len(vectors), m * w))
        k = min(vectors.shape[1], self.dim)
        out[:, :k] = vectors[:, :k]
        return out.reshape(len(vectors), m, w).transpose(1, 0, 2)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and norms of the residuals; components beyond ``dim`` are residual as a whole."""
        x = self.parts(vectors)
        codes = np.empty((len(vectors), len(x)), np.uint8)
        left = np.square(vectors[:, self.dim :].astype(float)).sum(1)
        for m, part in enumerate(x):
            codes[:, m] = _nearest(part, self.centers[m])
            left += np.square(part - self.centers[m][codes[:, m]]).sum(1)
        return codes, np.sqrt(left)

    def table(self, anchors: np.ndarray) -> np.ndarray:
        """(part, centroid, anchor): inner products of anchors with all centroids."""
        return np.einsum("mkw,maw->mka", self.centers, self.parts(anchors))


def _nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (np.square(centers).sum(1) - 2 * points @ centers.T).argmin(1)


def train_codebooks(sample: np.ndarray, params: NegativeParams, rounds: int = 8) -> Codebooks:
    """Lloyd's algorithm on each part of at most ``params.sample`` vectors, from evenly spaced distinct points."""
    dim = sample.shape[1]
    parts = max(1, math.ceil(dim / params.width))
    books = Codebooks(np.zeros((parts, params.centroids, params.width)), dim, params.width)
    for m, x in enumerate(books.parts(sample)):
        seen = np.unique(x, axis=0)
        if not len(seen):
            continue
        seen = seen[np.random.default_rng(m).permutation(len(seen))]
        c = seen[np.arange(params.centroids) % len(seen)].copy()
        for _ in range(rounds if len(seen) > params.centroids else 0):
            near = _nearest(x, c)
            n = np.bincount(near, minlength=len(c))
            for k in range(params.width):
                c[:, k] = np.where(n > 0, np.bincount(near, x[:, k], len(c)) / np.maximum(n, 1), c[:, k])
        books.centers[m] = c
    return books


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix, shorter lists padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if not len(size) or (size == size[0]).all():
        return flat.reshape(len(size), size[0] if len(size) else 0)
    out = np.zeros((len(size), size.max()), flat.dtype)
    out[np.arange(size.max()) < size[:, None]] = flat
    return out


def build_index(rows: DataFrame, books: Codebooks) -> DataFrame:
    """Every row with its codes and residual norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, left = books.encode(_matrix(batch.column("ints")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left)], names=[*batch.schema.names, "codes", "residual"])

    return rows.mapInArrow(run, f"{_ddl(rows)}, codes binary, residual double")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


@dataclass
class Anchors:
    """A chunk of anchors; ``low`` and ``high`` are (anchor, positive), the scores that negatives may have, once positives are known."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def part(self, at: slice) -> "Anchors":
        return Anchors(self.ids[at], self.labels[at], self.vectors[at], None if self.low is None else self.low[at], None if self.high is None else self.high[at])


def exact_scores(a: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of a[i] and x[j] as longs; one beyond a long stops at its end."""
    k = min(a.shape[1], x.shape[1])
    a, x = a[:, :k], x[:, :k]
    out = np.empty(len(i), np.int64)
    most = lambda v: float(np.abs(v.astype(float)).max(initial=0))
    small = most(a) * most(x) * max(k, 1) < _EXACT
    if small and 4 * len(i) > len(a) * len(x):
        return (a.astype(float) @ x.astype(float).T)[i, j].astype(np.int64)
    for s in range(0, len(i), _PAIRS):
        at = slice(s, s + _PAIRS)
        if small:
            out[at] = np.einsum("pk,pk->p", a[i[at]].astype(float), x[j[at]].astype(float)).astype(np.int64)
        else:
            exact = (a[i[at]].astype(object) * x[j[at]].astype(object)).sum(1) if k else np.zeros(len(i[at]), object)
            out[at] = [min(max(int(v), -_LONG), _LONG) for v in exact]
    return out


class Best:
    """The ``k`` rows with the highest scores, ties by smaller id, of each of ``n`` slots."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot = slot[order]
        kept = np.arange(len(slot)) - np.searchsorted(slot, slot, "left") < self.k
        self.slot, self.score, self.id = slot[kept], score[order[kept]], ids[order[kept]]

    def floor(self) -> np.ndarray:
        """The k-th score of each slot, minus infinity where fewer are held."""
        out = np.full(self.n, -np.inf)
        count = np.bincount(self.slot, minlength=self.n)
        ends = np.cumsum(count)
        full = count >= self.k
        out[full] = self.score[ends[full] - 1]
        return out


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, -k]


class Scan:
    """Rows of the index against a chunk of anchors: bounds first, exact scores for what they leave."""

    def __init__(self, books: Codebooks, anchors: Anchors, params: NegativeParams):
        self.books, self.params = books, params
        self.seen, self.scored = 0, 0
        self.parts = [anchors.part(slice(s, s + _ANCHORS)) for s in range(0, len(anchors.ids), _ANCHORS)]
        self.tables: list[np.ndarray | None] = [None] * len(self.parts)
        self.norms = [np.sqrt(np.square(p.vectors.astype(float)).sum(1)) for p in self.parts]
        slots = 1 if anchors.low is None else params.positives
        self.best = [Best(len(p.ids) * slots, params.positives if anchors.low is None else params.negatives) for p in self.parts]

    def bounds(self, p: int, codes: np.ndarray, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, row): no score is below the first or above the second."""
        table = self.tables[p]
        if table is None:
            table = self.books.table(self.parts[p].vectors)
            if len(self.parts) <= 8:  # else they would take more room than the anchors' chunk
                self.tables[p] = table
        score = np.zeros((len(codes), table.shape[2]))
        for m in range(len(table)):
            score += table[m][codes[:, m]]
        wide = np.outer(residual, self.norms[p])
        wide += 1e-9 * np.abs(score) + 1e-6 * (1 + wide)  # rounding of the look-ups and norms
        return (score - wide).T, (score + wide).T

    def add(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, codes: np.ndarray, residual: np.ndarray) -> None:
        for p, a in enumerate(self.parts):
            under, over = self.bounds(p, codes, residual)
            same = a.labels[:, None] == labels
            if a.low is None:
                self._positives(p, a, under, over, same & (a.ids[:, None] != ids), ids, x)
            else:
                self._negatives(p, a, under, over, ~same, ids, x)
            self.seen += under.size

    def _positives(self, p: int, a: Anchors, under: np.ndarray, over: np.ndarray, able: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        best, k = self.best[p], self.params.positives
        floor = np.maximum(best.floor(), _kth(np.where(able, under, -np.inf), k))
        i, j = np.nonzero(able & (over >= floor[:, None]))
        self.scored += len(i)
        best.add(i, exact_scores(a.vectors, x, i, j), ids[j])

    def _negatives(self, p: int, a: Anchors, under: np.ndarray, over: np.ndarray, able: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        best, k, n = self.best[p], self.params.negatives, self.params.positives
        floors = best.floor().reshape(-1, n)
        wanted, open_ = [], np.zeros(able.shape, bool)
        for s in range(n):
            low, high = a.low[:, s], a.high[:, s]
            sure = able & (over <= high[:, None]) & (under >= low[:, None])
            floor = np.maximum(np.maximum(floors[:, s], low), _kth(np.where(sure, under, -np.inf), k))
            wanted.append(able & (under <= high[:, None]) & (over >= floor[:, None]))
            open_ |= wanted[-1]
        i, j = np.nonzero(open_)
        self.scored += len(i)
        score = exact_scores(a.vectors, x, i, j)
        for s in range(n):
            fit = wanted[s][i, j] & (score >= a.low[i, s]) & (score <= a.high[i, s])
            best.add(i[fit] * n + s, score[fit], ids[j[fit]])

    def results(self) -> Iterator[pa.RecordBatch]:
        slots = self.params.positives if self.parts and self.parts[0].low is not None else 1
        for a, b in zip(self.parts, self.best):
            yield pa.RecordBatch.from_arrays([pa.array(a.ids[b.slot // slots]), pa.array(b.slot % slots + 1), pa.array(b.id), pa.array(b.score)], names=["anchor_id", "slot", "other_id", "score"])


_FOUND = "anchor_id long, slot long, other_id long, score long"


def scan_index(index: DataFrame, books: Codebooks, anchors: Anchors, params: NegativeParams) -> DataFrame:
    """Each task's best rows for every anchor of a chunk and, once positives are known, every positive."""
    sent = index.sparkSession.sparkContext.broadcast(anchors)  # params.chunk_bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scan(books, sent.value, params)
        for batch in batches:
            for s in range(0, batch.num_rows, _ROWS):
                part = batch.slice(s, _ROWS)
                codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                scan.add(part.column("vec_id").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("ints")), codes, part.column("residual").to_numpy())
        yield from scan.results()

    return index.mapInArrow(run, _FOUND)


def _first(found: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of each anchor and slot, with their rank; tasks have left a few rows for each."""
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _chunks(anchors: DataFrame, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of the column ``at`` with at most ``size`` anchors each; only the sizes of small blocks come to the driver."""
    block = F.expr(f"at div {size}")  # at counts the rows of a partition, so no block has more
    sizes = [tuple(r) for r in anchors.groupBy(block.alias("block")).agg(F.count("*")).orderBy("block").collect()]
    begin, held = None, 0
    for b, n in sizes:
        if begin is not None and held + n > size:
            yield begin * size, b * size
            begin, held = None, 0
        begin, held = (b if begin is None else begin), held + n
    if begin is not None:
        yield begin * size, (sizes[-1][0] + 1) * size


def _taken(anchors: DataFrame, begin: int, end: int) -> pa.Table:
    return anchors.where((F.col("at") >= begin) & (F.col("at") < end)).orderBy("vec_id").toArrow()


def hard_negatives(rows: DataFrame, params: NegativeParams = NegativeParams()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of ``rows`` (vec_id, embedding, label).

    Anchors are rows whose id is a multiple of ``every``; their positives are the first rows of their label,
    and each positive's negatives the first rows of other labels whose score lies in its window.  Rows of
    ``valid_rows`` take part.  Vectors of different lengths meet on the components they share; empty ones
    score 0.  Equal scores go by the smaller id.  An anchor without a positive, or a positive without a row
    in its window, gives nothing.  Other columns are not looked at.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    # a lot of the id spreads rows evenly, and reading a few of the smallest is a sample that does not change
    lot = F.xxhash64("vec_id", F.lit(7))
    plain = scratch.keep(valid_rows(rows, params), "rows")
    count, dim = plain.agg(F.count("*"), F.max(F.size("ints"))).first()
    taken = plain.orderBy(lot, "vec_id").limit(params.sample).select("ints").toArrow()
    books = train_codebooks(_matrix(taken.column(0)).astype(float), params)
    tasks = min(params.tasks, max(1, math.ceil(count / params.rows_per_task)))
    index = scratch.keep(build_index(plain.repartition(tasks, "vec_id"), books), "index")
    size = max(1, params.chunk_bytes // (8 * (max(dim or 0, 1) + 2 * params.positives + 2)))
    anchors = scratch.keep(plain.where(F.col("vec_id") % params.every == 0).withColumn("at", F.monotonically_increasing_id()), "anchors")
    out = None
    for begin, end in _chunks(anchors, size):
        chunk = _taken(anchors, begin, end)
        some = Anchors(*(chunk.column(c).to_numpy() for c in ("vec_id", "label")), _matrix(chunk.column("ints")))
        found = _first(scan_index(index, books, some, params), params.positives)
        positives = scratch.keep(found.select("anchor_id", F.col("rank").alias("slot"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        # a few rows for each anchor of the chunk
        known = positives.select("anchor_id", "slot", "positive_score").toArrow()
        some.low, some.high = np.ones((2, len(some.ids), params.positives), np.int64) * [[[1]], [[0]]]  # no score fits
        at = np.searchsorted(some.ids, known.column("anchor_id").to_numpy()), known.column("slot").to_numpy() - 1
        score = known.column("positive_score").to_numpy().astype(object)
        some.low[at] = [-(-params.low * int(v) // 100) for v in score]
        some.high[at] = [params.high * int(v) // 100 for v in score]
        near = _first(scan_index(index, books, some, params), params.negatives)
        part = near.join(positives, ["anchor_id", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        part = scratch.keep(part, "negatives")
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out
