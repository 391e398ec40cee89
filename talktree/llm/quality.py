"""Quality rules: a logistic regression on hashed word and character n-grams, with calibrated odds.

The model is trained on labelled rows on the driver, from at most ``max_rows`` of them, chosen by a
hash of the id: three quarters fit the weights and the rest Platt's two calibration constants.
Scoring runs in Arrow batches over whole texts: each text's features are the shares of its hashed
words, word pairs and character n-grams, so its log-odds are sums of table look-ups.
A text is kept if it passes the base rules and its calibrated probability reaches the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import bounded_batches

_U = np.uint64
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class QualityParams:
    """``max_rows`` bounds the labelled sample.

    ``threshold`` is on the calibrated P(quality = 1): 0.35 is where the expected losses are equal if
    rejecting a good text costs 13 and keeping a bad one 7.  A text right at it is kept.
    """

    max_rows: int = 3000
    word_bits: int = 10
    char_bits: int = 11
    char_grams: tuple[int, ...] = (2, 3)
    l2: float = 1e-3
    threshold: float = 0.35
    min_words: int = 20
    max_repeat_percent: int = 30
    repeat_window: int = 8


@dataclass
class QualityModel:
    params: QualityParams
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -40, 40)))


def _characters(block: W.Block) -> tuple[np.ndarray, np.ndarray]:
    """Each character's UTF-8 bytes as one number, and the bounds of the texts."""
    lead = np.flatnonzero((block.data & 0xC0) != 0x80)
    size = np.clip(np.diff(np.append(lead, len(block.data))), 0, 4)
    padded = np.concatenate([block.data, np.zeros(4, np.uint8)])
    four = np.ndarray(len(block.data) + 1, "<u4", padded, strides=(1,))
    return four[lead] & np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)[size], np.searchsorted(lead, block.offsets)


def _feature_groups(block: W.Block, w: W.Words, h: np.ndarray, p: QualityParams) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature, table slots and the text of each."""
    words, chars = 1 << p.word_bits, 1 << p.char_bits
    groups = [((h >> _U(64 - p.word_bits)).astype(np.int64), w.of)]
    at, of = W.gram_starts(w.bounds, 2)
    pair = (W.gram_hashes(h, at, 2) >> _U(64 - p.word_bits)).astype(np.int64)
    pair[h[at] == h[at + 1]] = 0  # one slot for any word said twice
    groups.append((pair + words, of))
    base = 2 * words
    char, bounds = _characters(block)
    for k, n in enumerate(p.char_grams):
        at, of = W.gram_starts(bounds, n)
        code = np.full(len(at), k + 1, np.uint32)
        for j in range(n):
            code = (code ^ char[at + j]) * np.uint32(0x01000193)
            code ^= code >> np.uint32(15)
        slot = (code * np.uint32(2654435761)) >> np.uint32(32 - p.char_bits)
        groups.append((slot.astype(np.int64) + base + k * chars, of))
    return groups


def _width(p: QualityParams) -> int:
    return (2 << p.word_bits) + len(p.char_grams) * (1 << p.char_bits)


def feature_rows(texts: pa.Array, p: QualityParams) -> np.ndarray:
    """Dense shares of each feature, a row for each text; for the bounded training sample only."""
    out = []
    for block in W.blocks(texts):
        w = W.words(block)
        h = W.span_hashes(block.data, w.start, w.end)
        x = np.zeros((block.n, _width(p)), np.float32)
        for slot, of in _feature_groups(block, w, h, p):
            np.add.at(x, (of, slot), np.float32(1) / np.maximum(np.bincount(of, minlength=block.n), 1)[of].astype(np.float32))
        out.append(x)
    return np.concatenate(out) if out else np.zeros((0, _width(p)), np.float32)


def _fit(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2 logistic regression by accelerated gradient steps; scales ``x`` in place."""
    scale = (1 / np.maximum(x.std(axis=0), 1e-5)).astype(np.float32) / np.sqrt(np.float32(x.shape[1]))
    x *= scale
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    vw, vb = w.copy(), b
    step = np.float32(4 / (float((x * x).sum(axis=1).mean()) + 1))
    for k in range(steps):
        d = ((1 / (1 + np.exp(-np.clip(x @ vw + vb, -40, 40)))) - y).astype(np.float32) / len(y)
        nw, nb = vw - step * (x.T @ d + l2 * vw), vb - step * float(d.sum())
        m = k / (k + 3)
        vw, vb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    return w * scale, float(b)


def _platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of calibrated log-odds, by damped Newton steps on smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    ab = np.array([1.0, 0.0])
    x = np.stack([logit, np.ones_like(logit)], axis=1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ ab, -40, 40)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (q - target))
        ab = ab - step * min(1, 2 / (np.abs(step).max() + 1e-9))
    return float(ab[0]), float(ab[1])


def train_quality(docs: DataFrame, labels: DataFrame, params: QualityParams | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fits and calibrates the model on at most ``max_rows`` labelled texts.

    Null labels and labels without a document are left out.  With no example of one class the
    weights are zero and the probability is the prior's, 1 if there are no labels at all.
    """
    p = params or QualityParams()
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "y").limit(p.max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    got = rows.select("id", F.coalesce("text", F.lit("")).alias("text"), "y").toArrow().sort_by([("id", "ascending"), ("text", "ascending")])
    y = got["y"].to_numpy().astype(np.float32) if got.num_rows else np.zeros(0, np.float32)
    if not got.num_rows or y.min() == y.max():
        return QualityModel(p, np.zeros(_width(p), np.float32), 0.0, 0.0, 40.0 if not got.num_rows or y.min() > 0 else -40.0)
    x = feature_rows(got["text"].combine_chunks(), p)
    held = np.arange(len(y)) % 4 == 0
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        held[:] = True
        weights, bias = _fit(x.copy(), y, p.l2)
    else:
        weights, bias = _fit(x[~held], y[~held], p.l2)
    slope, shift = _platt(x[held] @ weights + bias, y[held])
    return QualityModel(p, weights, bias, slope, shift)


def base_counts(block: W.Block, w: W.Words, h: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    data, n = block.data, block.n
    point = ((data & 0xC0) != 0x80) & ~W.SEPARATOR[data]
    inner = np.zeros(len(data) + 1, bool)
    inner[block.offsets] = True
    newline = data == 0x0A
    begin = np.flatnonzero((np.append(True, newline)[: len(data)] | inner[:-1]) if len(data) else newline)
    end = np.append(begin[1:], len(data)) if len(begin) else begin
    end = end - newline[end - 1] if len(end) else end
    has = np.searchsorted(w.start, end) > np.searchsorted(w.start, begin)
    begin, end = begin[has], end[has]
    line = W.span_hashes(data, begin, end)
    of = np.searchsorted(block.offsets, begin, "right") - 1
    order = np.lexsort((line, of))
    same = (line[order][1:] == line[order][:-1]) & (of[order][1:] == of[order][:-1])
    dup_lines = np.bincount(of[order][1:][same], minlength=n)

    at, of = W.gram_starts(w.bounds, window)
    gram = W.gram_hashes(h, at, window)
    order = np.lexsort((gram, of))
    same = (gram[order][1:] == gram[order][:-1]) & (of[order][1:] == of[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    repeated = W.cover(at[twice], at[twice] + window, len(w))
    return {
        "n_words": np.diff(w.bounds),
        "word_chars": W.sums(point, block.offsets),
        "n_symbols": W.sums(SYMBOLS[data], block.offsets),
        "n_dup_lines": dup_lines,
        "n_repeat_words": W.sums(repeated, w.bounds),
    }


def _score(model: QualityModel):
    p = model.params
    weights = model.weights.astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in W.blocks(batch.column(1)):
                w = W.words(block)
                h = W.span_hashes(block.data, w.start, w.end)
                base = base_counts(block, w, h, p.repeat_window)
                logit = np.full(block.n, model.bias, np.float64)
                for slot, of in _feature_groups(block, w, h, p):
                    logit += np.bincount(of, weights[slot], minlength=block.n) / np.maximum(np.bincount(of, minlength=block.n), 1)
                probability = model.probability(logit)
                failed = (base["n_words"] < p.min_words) | (100 * base["n_repeat_words"] > p.max_repeat_percent * base["n_words"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.n), *(pa.array(v.astype(np.int64)) for v in base.values()), pa.array(failed), pa.array(~failed & (probability >= p.threshold)), pa.array(probability, pa.float64())],
                    ["id", *base, "base_failed", "kept", "quality_probability"],
                )

    return run


def quality_rules(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality_probability)`` per row.

    A null or blank text has no words, fails the base rules and is not kept.  Null and repeated ids
    give a row each; texts are scored whole, however long.  Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    schema = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality_probability double"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_score(model), schema).withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, with all their columns and no shuffle.

    Rows with a null or blank text go; null and repeated ids are no matter, as rows are judged one by one.
    """
    bounded_batches(docs.sparkSession)
    score, at = _score(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], ["id", "text"])
                kept = pa.Table.from_batches(list(score(iter([part])))).column("kept").combine_chunks()
                yield batch.filter(kept)

    return docs.mapInArrow(run, docs.schema)
