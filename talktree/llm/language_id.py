"""Language identification by rank-order profiles of character n-grams (Cavnar and Trenkle 1994).

A text is lower-cased, its words of letters are padded with a space on both sides, and its n-grams
of 1 to 3 characters are counted over the whole text.  A profile lists the ``profile`` most frequent
n-grams in order.  A document's distance to a language is the sum over its own profile of how far
out of place each n-gram is, ``profile`` for one that the language's profile lacks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import bounded_batches

_U = np.uint64
_BITS = 21


@dataclass(frozen=True)
class LanguageParams:
    """``max_rows`` bounds the labelled texts that profiles are learnt from; ``grams`` is the longest n-gram, 3 at most."""

    profile: int = 300
    grams: int = 3
    max_rows: int = 4000
    folds: int = 5


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: 2 for a letter, 1 for a mark on one, else 0."""
    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def _points(block: W.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points, non-letters as one space, each text between spaces; the text of each; whether it has a letter."""
    texts = [block.text(i).decode("utf-8").lower() for i in range(block.n)]
    size = np.array([len(t) + 2 for t in texts], np.int64)
    joined = " " + "  ".join(texts) + " "
    point = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
    of = np.repeat(np.arange(block.n), size)
    kind = _letters()[point]
    letter = kind > 0
    point[~letter] = 0x20
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | (of[1:] != of[:-1])
    has = np.bincount(of[kind == 2], minlength=block.n) > 0
    return point[keep], of[keep], has


def _ranked(block: W.Block, p: LanguageParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text its most frequent n-grams in order: (text, rank, n-gram), and whether it has a letter."""
    point, of, has = _points(block)
    codes, texts = [], []
    wide = point.astype(np.uint64)
    code = wide
    for n in range(1, p.grams + 1):
        if n > 1:
            code = (code[:-1] << _U(_BITS)) | wide[n - 1 :]
        same = of[: len(code)] == of[n - 1 :]
        inner = np.ones(len(code), bool)
        for j in range(1, n - 1):
            inner &= point[j : j + len(code)] != 0x20
        solid = same & inner & ((point[: len(code)] != 0x20) if n == 1 else True)
        codes.append(code[solid])
        texts.append(of[: len(code)][solid])
    code, text = np.concatenate(codes), np.concatenate(texts)
    order = np.lexsort((code, text)) if block.n > 1 else np.argsort(code)
    code, text = code[order], text[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(code)))
    code, text = code[head], text[head]
    order = np.lexsort((code, -count, text))
    code, text = code[order], text[order]
    first = np.searchsorted(text, np.arange(block.n))
    rank = np.arange(len(text)) - first[text]
    top = rank < p.profile
    return text[top], rank[top], code[top], has


def _count_grams(p: LanguageParams):
    """(lang, text) to counts of n-grams, summed over each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(0).to_numpy(zero_copy_only=False)
            totals: dict[str, tuple[list, list]] = {}
            for block in W.blocks(batch.column(1)):
                for name in set(lang[block.first : block.first + block.n]):
                    mine = np.flatnonzero(lang[block.first : block.first + block.n] == name)
                    sub = [block.text(i) for i in mine]
                    own = W.Block(0, np.frombuffer(b" ".join(sub) + b" ", np.uint8), np.array([0, sum(map(len, sub)) + len(sub)]))
                    code, count = _all_counts(own, p)
                    have = totals.setdefault(name, ([], []))
                    have[0].append(code)
                    have[1].append(count)
            for name, (codes, counts) in totals.items():
                code, back = np.unique(np.concatenate(codes), return_inverse=True)
                n = np.bincount(back, np.concatenate(counts)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    return run


def _all_counts(block: W.Block, p: LanguageParams) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a block's texts taken together, and their counts."""
    point, of, _ = _points(block)
    wide = point.astype(np.uint64)
    code, codes = wide, []
    for n in range(1, p.grams + 1):
        if n > 1:
            code = (code[:-1] << _U(_BITS)) | wide[n - 1 :]
        keep = np.ones(len(code), bool)
        for j in range(1, n - 1):
            keep &= point[j : j + len(code)] != 0x20
        if n == 1:
            keep &= point != 0x20
        codes.append(code[keep])
    return np.unique(np.concatenate(codes), return_counts=True)


def train_profiles(docs: DataFrame, params: LanguageParams | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[int]]:
    """Each language's most frequent n-grams, learnt from at most ``max_rows`` labelled texts that are not held out.

    Held out are rows whose crc32 of the id as text is 0 modulo ``folds``.  Rows without a language,
    text or id are left out; no rows give no profiles.
    """
    p = params or LanguageParams()
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("id is not null and lang is not null and text is not null")
    rows = rows.where(F.crc32(F.col("id").cast("string").cast("binary")) % p.folds != 0)
    chosen = rows.select("id").orderBy(F.xxhash64("id"), "id").limit(p.max_rows).distinct()
    rows = rows.join(F.broadcast(chosen), "id").select("lang", "text")
    counts = rows.mapInArrow(_count_grams(p), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "gram")), asc=False), 1, p.profile * 2).alias("x"))
    out = {}
    for row in top.collect():  # a row for each language, of a fixed length
        grams = sorted(((-g["n"], g["gram"] & 0xFFFFFFFFFFFFFFFF) for g in row.x))
        out[row.lang] = [g for _, g in grams[: p.profile]]
    return out


def _predict(profiles: dict[str, list[int]], p: LanguageParams):
    names = sorted(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unique(np.array([g for name in names for g in profiles[name]], np.uint64))
        place = np.full((len(known) + 1, len(names)), p.profile, np.int64)
        for j, name in enumerate(names):
            place[np.searchsorted(known, np.array(profiles[name], np.uint64)), j] = np.arange(len(profiles[name]))
        missing = len(known)
        for batch in batches:
            for block in W.blocks(batch.column(1), W.BLOCK_BYTES // 4):
                text, rank, code, has = _ranked(block, p)
                if len(known):
                    at = np.minimum(np.searchsorted(known, code), missing - 1)
                    at = np.where(known[at] == code, at, missing)
                else:
                    at = np.full(len(code), missing)
                total = np.zeros((block.n, max(len(names), 1)))
                count = np.bincount(text, minlength=block.n)
                for j in range(len(names)):
                    off = np.where(place[at, j] == p.profile, p.profile, np.abs(place[at, j] - rank))
                    total[:, j] = np.bincount(text, off, minlength=block.n)
                best = total.argmin(axis=1)
                share = total.min(axis=1) / np.maximum(count * p.profile, 1)
                known_text = has & bool(names)
                pred = [names[b] if ok else "und" for b, ok in zip(best, known_text)]
                score = np.where(known_text, np.clip(1 - share, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    return run


def identify_languages(docs: DataFrame, profiles: dict[str, list[int]], params: LanguageParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, held_out, lang_pred, score)`` per row; the score is 1 minus the share of the largest distance.

    Null texts and those without a letter are ``und`` with score 0, and so are all without profiles.
    Equal distances go to the first language by name.  A null id is not held out.  Only the text
    bears on a prediction; other columns are not read.
    """
    p = params or LanguageParams()
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.withColumn("id", F.col("id").cast("long")).mapInArrow(_predict(profiles, p), "id long, lang_pred string, score double")
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % p.folds == 0, F.lit(False))
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "lang_pred", "score")
