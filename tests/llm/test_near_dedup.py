import random
import re

import numpy as np
import pytest

from talktree.llm import near_dedup as N
from talktree.llm.components import components
from talktree.llm.shared import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, n, percent=80):
    """id -> (set size, smallest reachable id), by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus():
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    rows, base = [], text(60)
    for k in range(90):  # copies of one text with a few words changed: some pairs are links, some not
        w = base[:]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"e{rng.randint(0, 9999)}"
        rows.append(" ".join(w))
    for _ in range(40):
        rows += [" ".join(text(rng.randint(1, 40)))]
    rows += [rows[100], rows[100].upper(), "  " + rows[100].replace(" ", "\n\t"), "", None, " \n ", "one", "ONE", "one two three", "one two", "É x y z", "é x y z"]
    passage = text(25)
    rows += [" ".join(text(30) + passage + text(30)) for _ in range(30)]
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("params", [N.NearDupParams(shingle=4), N.NearDupParams(shingle=4, small_group=4, cell=7), N.NearDupParams()])
def test_against_all_pairs(spark, params):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, n string, k int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(df, params=params).collect()}
    want = brute(rows, params.shingle)
    assert got == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in N.near_duplicates(df, params=params).collect())


def test_edges_of_the_input(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (7, "a b c"), (7, "a b c"), (9, "a b c")], "doc_id long, text string")
    rows = sorted(((r.doc_id or 0), r.component_id, r.kept) for r in N.near_duplicates(odd).collect())
    assert rows == [(0, None, True), (0, None, True), (7, 7, True), (7, 7, True), (9, 7, False)]


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = np.concatenate([a[:320], rng.integers(0, 1 << 63, 80, dtype=np.uint64)])
    values, of = np.concatenate([a, b, a[:1]]), np.repeat([0, 1, 3], [400, 400, 1])
    s = N.fast_similarity_sketch(values, of, 4, 512, 3)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    assert (s[[0, 1, 3]] != full).all() and (s[2] == full).all()
    assert abs((s[0] == s[1]).mean() - 320 / 480) < 0.1
    assert (N.fast_similarity_sketch(a[::-1].copy(), np.zeros(400, np.int64), 1, 512, 3) == s[0]).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(40)] + [(1000, k) for k in range(1001, 1040)] + [(5, 5)]
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in components(df, Scratch(spark)).collect()}
    assert got == {v: find(v) for v in root if any(v in e and e[0] != e[1] for e in edges)}
    assert components(df.where("a < 0"), Scratch(spark)).count() == 0


def test_repeated_ids_keep_their_own_links(spark):
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, b + " more"), (3, a + " other"), (4, "x")]
    got = sorted((r.doc_id, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_doubled_words_are_not_linked(spark):
    x, y = "ab", "ba"
    for _ in range(9):
        x, y = x + y, y + x
    rows = [(1, f"{x} q w e r"), (2, f"{y} q w e r"), (3, f"{x}  q w e r")]
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_long_text(spark):
    long_ = " ".join(f"w{i * i % 9973}" for i in range(400_000))
    rows = [(5, long_), (6, long_ + " end"), (7, long_[: len(long_) // 2])]
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[6] == 5 and got[5] == 5


def test_family_of_a_template_stays_linear(spark):
    """1,200 texts alike at about 0.7, which bands do catch: no pair is linked, and few are compared."""
    template = [f"t{i}" for i in range(300)]
    rows = []
    for k in range(1200):
        words = template + [f"u{k}x{i}" for i in range(60)]
        rows.append((k, " ".join(words)))
    rows += [(1200 + k, rows[k][1] + " z") for k in range(0, 1200, 100)]
    seen = []
    confirm = N._Linker.confirm

    def counted(self, pairs):
        seen.append(pairs.count())
        confirm(self, pairs)

    N._Linker.confirm = counted
    try:
        got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    finally:
        N._Linker.confirm = confirm
    assert got == {i: (i - 1200 if i >= 1200 else i) for i, _ in rows}
    assert sum(seen) < 6 * len(rows), seen


@pytest.mark.parametrize("n", [300, 1200])
def test_family_made_of_modules_stays_linear(spark, n):
    """Texts of one template and 8 of many modules, each module in about 10 texts: no two are linked, but all share rare shingles."""
    rng = random.Random(9)
    template = [f"t{i}" for i in range(300)]
    modules = [[f"m{j}x{i}" for i in range(10)] for j in range(n * 8 // 10)]
    rows = []
    for k in range(n):
        words = template[:]
        for j in rng.sample(range(len(modules)), 8):
            words += modules[j]
        rows.append((k, " ".join(words)))
    rows += [(n + k, rows[k][1] + " z") for k in range(0, n, 50)]
    compared, confirm = [], N._Linker.confirm

    def counted(self, pairs):
        compared.append(pairs.count())
        confirm(self, pairs)

    def counted_cells(self, rows, mixed):
        sizes = rows.groupBy("k").count().collect()
        compared.append(sum(r["count"] ** 2 for r in sizes))
        cells(self, rows, mixed)

    cells = N._Linker.cells
    N._Linker.confirm, N._Linker.cells = counted, counted_cells
    try:
        got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    finally:
        N._Linker.confirm, N._Linker.cells = confirm, cells
    assert got == {i: (i - n if i >= n else i) for i, _ in rows}
    assert sum(compared) < 60 * n, compared
