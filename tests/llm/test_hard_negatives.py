import math
import random

import numpy as np
import pytest

from talktree.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, p):
    """All results, by scoring every pair with Python's integers."""
    own = {}
    for i, vec, label in rows:
        if i is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        ints = [math.floor(p.scale * float(np.float32(x))) for x in vec]
        own[i] = min(own.get(i, (label, ints)), (label, ints))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, vec) in own.items():
        if a % p.every:
            continue
        score = {i: dot(vec, v) for i, (_, v) in own.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for pos in [i for i in order if own[i][0] == label][: p.positives]:
            fit = [i for i in order if own[i][0] != label and p.low * score[pos] <= 100 * score[i] <= p.high * score[pos]]
            out += [(a, pos, k + 1, i, score[pos], score[i]) for k, i in enumerate(fit[: p.negatives])]
    return sorted(out)


def got(spark, rows, p, parts=3):
    out = H.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(parts), p)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert [k for _, k in out.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    return sorted(map(tuple, out.collect()))


def corpus(n=900, dim=10, seed=4):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 0.3) for _ in range(dim)] for _ in range(6)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, 0.15))) for x in rng.choice(base)], rng.randrange(4)) for i in range(n)]
    return rows + [(n + i, list(rows[3][1]), 1 + i % 2) for i in range(200)]  # a vector that many rows share


@pytest.mark.parametrize("p", [H.NegativeParams(), H.NegativeParams(every=7, width=3, centroids=16, sample=100, chunk_bytes=4000, rows_per_task=100)])
def test_against_all_pairs(spark, p):
    rows = corpus()
    want = brute(rows, p)
    assert want and got(spark, rows, p) == want  # recall and precision are 1


def test_edges_of_the_input(spark):
    p = H.NegativeParams(every=2)
    assert got(spark, [], p) == []
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 0), (0, [1.0, 0.5], 0), (0, [0.2, 0.5], 1), (1, [1.0, 1.0], 0), (2, None, 0), (3, [0.9, None], 0), (4, [nan, 1.0], 1), (6, [inf, 1.0], 1)]
    rows += [(8, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (9, [1.0], 1), (10, [], 1), (11, [0.5, 0.5, 9.0], 1), (13, [0.5, 0.5, 9.0], 1), (12, [-1.0, -1.0], 0), (15, [0.6, 0.7], 1)]
    assert got(spark, rows, p) == brute(rows, p) != []
    extra = spark.createDataFrame([(0, [1.0], 0, 1, 2), (1, [1.0], 0, 1, 2), (2, [0.6], 1, 1, 2)], "vec_id long, embedding array<double>, label int, at int, rank int")
    assert [tuple(r) for r in H.hard_negatives(extra, p).where("anchor_id = 0").collect()] == [(0, 1, 1, 2, 65536, 39168)]
    large = [(i, [4e5 * (i + 1), 3e5], i % 2) for i in range(5)]  # scores beyond what doubles hold
    assert got(spark, large, p) == brute(large, p) != []


def test_bounds_hold_and_leave_rows_out():
    rng = np.random.default_rng(1)
    x = rng.integers(-80, 80, (3000, 32))
    x[:1000] = x[0] + rng.integers(-6, 6, (1000, 32))
    p = H.NegativeParams()
    books = H.train_codebooks(x[::3].astype(float), p)
    codes, residual = books.encode(x)
    anchors = H.Anchors(np.arange(40), np.zeros(40, np.int64), x[:2000:50])
    scan = H.Scan(books, anchors, p)
    under, over = scan.bounds(0, codes, residual)
    exact = anchors.vectors @ x.T
    assert (under <= exact).all() and (exact <= over).all()
    scan.add(np.arange(100, 3100), np.zeros(3000, np.int64), x, codes, residual)
    assert 40 * 5 <= scan.scored < 0.2 * scan.seen
    order = np.argsort(-exact[7], kind="stable")[:5]
    best = scan.best[0]
    assert best.score[best.slot == 7].tolist() == exact[7][order].tolist() and best.id[best.slot == 7].tolist() == (order + 100).tolist()
