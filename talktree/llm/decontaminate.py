"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters, digits and non-ASCII characters, A-Z in lower case.  Seeds are word pairs of
a test item, found in a document next to each other or with one word between.  A copy that reaches
the score keeps a known number of the item's pairs: of the full score it may lose a share, a word
changed or left out costs 3 and breaks two pairs, a word at an end costs 2 and breaks one, and a pair is lost
to two words put in, which cost 2.  So the commonest pairs of an item can be left out of the look-up
and several seeds be asked for in one stretch without losing a copy; how often the items' pairs occur is
counted over all documents.  Passages with so many seeds are aligned with the item.  A long part of an item
counts by its own length and share of matches, and its pairs are kept and counted in the same way.  The items are a
stated query set: they are taken in blocks of bounded size, and each block is held against all
documents in one scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .alignment import align, holds_run
from .shared import bounded_batches

_U = np.uint64
_SIEVE_BITS = 20
_PAIR = _U(0xA24BAED4963EE407)
#: Seeds of items that are held at once, or those of one text.
_ENTRIES = 1 << 20


@dataclass(frozen=True)
class DecontaminationParams:
    """A document is contaminated if an item's score, of 1 for a full copy, reaches ``min_score`` with ``min_matches`` words, all but one if it has no more.

    So it is, whatever the score, if ``part`` or more aligned words in a row match at ``part_share`` or more.
    Items of fewer than ``min_item`` words are looked for word for word, as no edit leaves enough of them.  Of
    ``stretch`` consecutive word pairs one is a seed at least, however common.
    """

    stretch: int = 5
    min_item: int = 5
    min_score: float = 0.5
    min_matches: int = 8
    part: int = 20
    part_share: float = 0.8
    block_bytes: int = 8 << 20


def _plain(block: W.Block) -> tuple[W.Words, np.ndarray]:
    """A block's words and their fingerprints."""
    low = W.LOWER[block.data]
    w = W.words(block, W.NOT_PLAIN)
    return w, W.span_hashes(low, w.start, w.end)


def _sieve(values: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _SIEVE_BITS, bool)
    out[(values >> _U(64 - _SIEVE_BITS)).astype(np.int64)] = True
    return out


def _find(values: np.ndarray, known: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``values`` that are in the sorted ``known``, and where there."""
    at = np.flatnonzero(sieve[(values >> _U(64 - _SIEVE_BITS)).astype(np.int64)])
    to = np.searchsorted(known, values[at])
    to[to == len(known)] = 0
    hit = known[to] == values[at] if len(known) else np.zeros(len(at), bool)
    return at[hit], to[hit]


def _count_pairs(vocabulary: np.ndarray):
    sieve = _sieve(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for block in W.blocks(batch.column(0)):
                w, h = _plain(block)
                start, _ = W.gram_starts(w.bounds, 2)
                _, to = _find(_pairs(h[start], h[start + 1]), vocabulary, sieve)
                total += np.bincount(to, minlength=len(vocabulary))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])

    return run


@dataclass
class ItemIndex:
    """A block of items: words of each, and seeds as sorted fingerprints of word pairs with item and place."""

    ids: list
    words: list[np.ndarray]
    seed: np.ndarray
    item: np.ndarray
    place: np.ndarray


def _pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return W.mix(x + y * _PAIR)


def _whole(n: int, p: DecontaminationParams) -> tuple[int, int, int]:
    """For an item of n words: how many of its pairs may be left out, how many seeds a copy then has, and in how many words."""
    loss = 2 * n * (1 - p.min_score)
    stay = n - 1 - int(loss / 1.5 + 1e-9)
    hits = max(1, (stay + 1) // 2)
    return max(0, stay - hits), hits, n + int(loss + 1e-9)


def _partial(p: DecontaminationParams) -> tuple[int, int, int]:
    """The same for a part that is enough by itself; one of twice the least length holds a shorter one."""
    stay = min(n - 1 - 2 * int(n * (1 - p.part_share) + 1e-9) for n in range(p.part, 2 * p.part))
    hits = max(1, (stay + 1) // 2)
    return max(0, stay - hits), hits, 2 * p.part - 1


def build_index(ids: list, words: list[np.ndarray], frequency: dict[int, int], p: DecontaminationParams) -> ItemIndex:
    """Chooses each item's seeds by the rarity of the word pairs."""
    seeds: list[tuple[int, int, int]] = []
    for k, w in enumerate(words):
        if len(w) < max(p.min_item, 2):  # these go by _short
            continue
        n = len(w) - 1
        total = np.array([frequency.get(int(x), 0) for x in _pairs(w[:-1], w[1:])])
        chosen = {i + int(total[i : i + p.stretch].argmin()) for i in range(max(1, n - p.stretch + 1))}
        chosen |= set(np.argsort(total, kind="stable")[: n - _whole(len(w), p)[0]].tolist())
        for i in range(n - p.part + 2):
            chosen |= set((i + np.argsort(total[i : i + p.part - 1], kind="stable")[: p.part - 1 - _partial(p)[0]]).tolist())
        at = np.array(sorted(chosen))
        seeds += [(int(g), k, int(i)) for g, i in zip(_pairs(w[at], w[at + 1]), at)]
    seeds.sort()
    return ItemIndex(ids, words, np.array([s[0] for s in seeds], np.uint64), np.array([s[1] for s in seeds], np.int64), np.array([s[2] for s in seeds], np.int64))


def _passages(first: np.ndarray, last: np.ndarray, reach: int, n: int) -> list[tuple[int, int]]:
    """Word ranges of a text of n words that hold the copies with seeds from first to last, overlapping ones joined."""
    out: list[list[int]] = []
    for y, x in sorted(zip(last.tolist(), first.tolist())):
        a, b = max(0, y + 2 - reach), min(n, x + reach)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _short(index: ItemIndex, p: DecontaminationParams):
    """A function that gives (text, item, first place) of items of fewer than ``min_item`` words in some texts."""
    by_size: dict[int, list[tuple[int, int]]] = {}
    for k, w in enumerate(index.words):
        if 0 < len(w) < max(p.min_item, 2):
            by_size.setdefault(len(w), []).append((int(W.gram_hashes(w, np.zeros(1, np.int64), len(w))[0]), k))
    tables = {}
    for n, entries in by_size.items():
        entries.sort()
        tables[n] = np.array([g for g, _ in entries], np.uint64), np.array([k for _, k in entries], np.int64)

    def find(w: W.Words, h: np.ndarray) -> Iterator[tuple[int, int, int]]:
        for n, (grams, items) in tables.items():
            start, of = W.gram_starts(w.bounds, n)
            seen = W.gram_hashes(h, start, n)
            at = np.flatnonzero(np.isin(seen, grams))
            pair, first = np.unique(np.stack([of[at].astype(np.uint64), seen[at]], axis=1), axis=0, return_index=True)
            for (d, g), i in zip(pair, at[first]):  # the first place of each in a text
                for k in items[np.searchsorted(grams, g, "left") : np.searchsorted(grams, g, "right")].tolist():
                    yield int(d), k, int(start[i] - w.bounds[int(d)])

    return find


def _search(index: ItemIndex, p: DecontaminationParams):
    short = _short(index, p)
    once = np.ones(len(index.seed), bool)
    once[1:] = (index.seed[1:] != index.seed[:-1]) | (index.item[1:] != index.item[:-1])
    owner = index.item[once]
    known, first, count = np.unique(index.seed[once], return_index=True, return_counts=True)
    sieve = _sieve(known)
    rules = np.array([_whole(len(w), p)[1:] for w in index.words], np.int64).reshape(-1, 2)

    few, span = _partial(p)[1:]
    parts = np.array([len(w) >= p.part for w in index.words], bool)

    def judge(words: np.ndarray, item: int, x: np.ndarray, y: np.ndarray):
        """The best alignment of an item with the passages of one text, if good enough."""
        target = index.words[item]
        size = len(target)
        least = min(p.min_matches, size if size > p.min_matches else size - 1)
        whole = p.min_score * 2 * size
        part = p.part * (3 * p.part_share - 1) if parts[item] else whole  # a good part's least score
        share = p.part * p.part_share if parts[item] else p.min_score * size
        best = None
        open_ = _passages(x, y, max(int(rules[item, 1]), span), len(words))
        while open_:
            a, b = open_.pop()
            if np.isin(target, words[a:b]).sum() < min(share, p.min_score * size):
                continue
            found = align(target, words[a:b])
            if (found.score >= whole and found.matches >= least) or (parts[item] and holds_run(target, words[a:b], found, p.part, p.part_share)):
                if best is None or (found.score, -a) > (best[0].score, -best[1]):
                    best = (found, a)
            if found.score >= min(whole, part) - 1e-9 and (best is None or best[0] is not found):  # it may hide a good one beside it
                open_ += [(a, a + found.b_start), (a + found.b_end, b)]
        if best is None:
            return None
        return best[0].score / (2 * size), best[0].matches, best[1] + best[0].b_start, best[1] + best[0].b_end

    def seeds(w: W.Words, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places, texts and numbers of the seeds in some texts at a time, so that few are held at once."""
        found = []
        for gap in (1, 2):
            start, of = W.gram_starts(w.bounds, gap + 1)
            where, seed = _find(_pairs(h[start], h[start + gap]), known, sieve)
            found.append((start[where], of[where], seed))
        at, doc, seed = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(at, kind="stable")
        at, doc, seed = at[order], doc[order], seed[order]
        total = np.concatenate([[0], np.cumsum(count[seed])])
        lo = 0
        while lo < len(at):
            hi = int(np.searchsorted(total, total[lo] + _ENTRIES, "right")) - 1
            hi = int(np.searchsorted(doc, doc[hi])) if hi < len(at) else len(at)
            hi = hi if hi > lo else int(np.searchsorted(doc, doc[lo], "right"))
            yield at[lo:hi], doc[lo:hi], seed[lo:hi]
            lo = hi

    def crowds(at: np.ndarray, doc: np.ndarray, seed: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Text, item, and the first and last seed of each stretch with as many seeds as a copy has."""
        many = count[seed]
        rank = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        item = owner[np.repeat(first[seed], many) + rank]
        at, group = np.repeat(at, many), np.repeat(doc, many) * len(index.words) + item
        order = np.argsort(group, kind="stable")
        at, group, item = at[order], group[order], item[order]
        near = []
        for hits, words, which in ((rules[item, 0], rules[item, 1], True), (few, span, parts[item])):
            k = np.arange(len(at))
            j = k + hits - 1
            last = np.minimum(j, len(at) - 1)
            ok = (j < len(at)) & which & (group == group[last]) & (at[last] - at < words)
            near.append((k[ok], last[ok]))
        k, j = (np.concatenate(x) for x in zip(*near))
        order = np.argsort(k, kind="stable")
        k, j = k[order], j[order]
        cut = np.flatnonzero(np.append(True, group[k[1:]] != group[k[:-1]])) if len(k) else []
        for x, y in zip(cut, np.append(cut[1:], len(k))):
            yield *divmod(int(group[k[x]]), len(index.words)), at[k[x:y]], at[j[x:y]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block in W.blocks(batch.column(1)):
                w, h = _plain(block)
                rows += [(block.first + d, index.ids[k], len(index.words[k]), 1.0, len(index.words[k]), x, x + len(index.words[k])) for d, k, x in short(w, h)]
                for some in seeds(w, h):
                    for d, i, x, y in crowds(*some):
                        lo, hi = w.bounds[d], w.bounds[d + 1]
                        if (got := judge(h[lo:hi], i, x - lo, y - lo)) is not None:
                            rows.append((block.first + d, index.ids[i], len(index.words[i]), *got))
            columns = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int64()) for c in columns[1:3]), pa.array(columns[3], pa.float64()), *(pa.array(c, pa.int64()) for c in columns[4:])],
                ["doc_id", "item_id", "item_words", "score", "n_matches", "start_word", "end_word"],
            )

    return run


def contaminated(docs: DataFrame, items: DataFrame, params: DecontaminationParams | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, item_words, score, n_matches, start_word, end_word)``: each document and item that it holds, best passage only.

    ``item_words`` is the item's length: a short one may be held by chance, so a caller who drops documents
    sets a least length of his own.  An item without words is held by nothing.

    Null and empty texts on either side hold nothing; equal passages give the first.  Repeated rows
    on either side give a row each; a null id is carried as null.  Without items the result is empty.
    """
    p = params or DecontaminationParams()
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tests = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    size = tests.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-int(size) // p.block_bytes)
    schema = "doc_id long, item_id long, item_words long, score double, n_matches long, start_word long, end_word long"
    out = None
    for k in range(blocks):
        got = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").toArrow()
        ids, words = got["item_id"].to_pylist(), []
        for chunk in W.blocks(got["text"].combine_chunks()):
            w, h = _plain(chunk)
            words += [h[w.bounds[i] : w.bounds[i + 1]] for i in range(chunk.n)]
        if not any(len(x) for x in words):
            continue
        vocabulary = np.unique(np.concatenate([_pairs(x[:-1], x[1:]) for x in words]))
        counts = rows.select("text").mapInArrow(_count_pairs(vocabulary), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        frequency = {int(vocabulary[r.pair]): r.n for r in counts.collect()}  # a row for each word pair of the item block at most
        found = rows.mapInArrow(_search(build_index(ids, words, frequency, p), p), schema)
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out
