import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from talktree.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.text("ab \n\té 😀", max_size=12), min_size=1, max_size=6)


@given(TEXTS, st.integers(1, 20))
@settings(max_examples=150, deadline=None)
def test_words_and_blocks(texts, limit):
    got = []
    for block in W.blocks(pa.array([*texts, None]), limit):
        w = W.words(block)
        for i in range(block.n):
            got.append([block.data[s:e].tobytes().decode() for s, e in zip(w.start[w.bounds[i] : w.bounds[i + 1]], w.end[w.bounds[i] : w.bounds[i + 1]])])
        assert (w.of == np.repeat(np.arange(block.n), np.diff(w.bounds))).all()
    assert got == [WORD.findall(t) for t in [*texts, ""]]


@given(TEXTS)
@settings(max_examples=100, deadline=None)
def test_hashes_follow_words(texts):
    seen: dict = {}
    grams: dict = {}
    for block in W.blocks(pa.array(texts), 8):
        w = W.words(block)
        h = W.span_hashes(block.data, w.start, w.end)
        for s, e, x in zip(w.start, w.end, h.tolist()):
            assert seen.setdefault(block.data[s:e].tobytes(), x) == x
        at, of = W.gram_starts(w.bounds, 2)
        for i, x in zip(at, W.gram_hashes(h, at, 2).tolist()):
            assert grams.setdefault((int(h[i]), int(h[i + 1])), x) == x
            assert w.of[i] == w.of[i + 1]
    assert len(set(seen.values())) == len(seen) and len(set(grams.values())) == len(grams)


def test_slices_and_large_arrays():
    column = pa.array(["x", None, "a b", "c"]).slice(1)
    assert [b.text(i) for b in W.blocks(column) for i in range(b.n)] == [b"", b"a b", b"c"]
    assert [b.text(0) for b in W.blocks(column.cast(pa.large_string()), 1)] == [b"", b"a b", b"c"]
    assert not list(W.blocks(pa.array([], pa.string())))


def test_cover_and_sums():
    assert W.cover(np.array([1, 2]), np.array([3, 3]), 5).tolist() == [False, True, True, False, False]
    assert W.sums(np.array([1, 2, 3]), np.array([0, 0, 2, 3])).tolist() == [0, 3, 3]


def test_doubled_words_and_sequences_differ():
    a, b = "ab", "ba"
    for _ in range(9):
        a, b = a + b, b + a
    block = next(W.blocks(pa.array([f"{a} {b}"])))
    w = W.words(block)
    for which in (0, 1):
        h = W.span_hashes(block.data, w.start, w.end, which)
        assert h[0] != h[1]
        x, y = h[:1], h[1:]
        for _ in range(9):
            x, y = np.concatenate([x, y]), np.concatenate([y, x])
        assert W.gram_hashes(x, np.array([0]), len(x), which) != W.gram_hashes(y, np.array([0]), len(y), which)


def test_gram_sizes_agree():
    h = np.random.default_rng(1).integers(0, 1 << 63, 300, dtype=np.uint64)
    at = np.arange(200)
    for n in (1, 2, 5, 50, 100):
        assert (W.gram_hashes(h, at, n) == W.gram_hashes(h, at, np.full(200, n))).all()
    both = W.gram_hashes(np.concatenate([h, h]), np.array([3, 303]), np.array([77, 77]))
    assert both[0] == both[1]
