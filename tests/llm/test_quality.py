import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from talktree.llm import quality as Q
from talktree.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, window=8):
    w = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    places: dict = {}
    for i in range(len(w) - window + 1):
        places.setdefault(tuple(w[i : i + window]), []).append(i)
    covered = {k for p in places.values() if len(p) > 1 for i in p for k in range(i, i + window)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


@given(st.lists(st.text("ab é#|\n\t ", max_size=60), min_size=1, max_size=5), st.integers(1, 40), st.integers(1, 3))
@settings(max_examples=200, deadline=None)
def test_base_counts(texts, limit, window):
    got = []
    for block in W.blocks(pa.array(texts), limit):
        w = W.words(block)
        c = Q.base_counts(block, w, W.span_hashes(block.data, w.start, w.end), window)
        got += list(zip(*(v.tolist() for v in c.values())))
    assert got == [brute(t, window) for t in texts]


def corpus(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("re", "on", "ta", "li", "men", "so")) for _ in range(rng.randint(1, 3)))
    out = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(25, 80))]
        good = i % 4 != 0
        if not good:
            w = [x + rng.choice(("$$$", "%%%", "###")) for x in w] if i % 8 else [x.upper() + "!!" for x in w]
        out.append((i, " ".join(w), int(good)))
    return out


def test_model_on_held_out_rows(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([(i, t, 9) for i, t, _ in rows], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i < 300] + [(9999, 1), (None, 1), (5, None)], "doc_id long, quality int")
    model = Q.train_quality(docs, labels, Q.QualityParams(max_rows=250))
    got = {r.doc_id: r for r in Q.quality_rules(docs, model).collect()}
    wrong = [i for i, _, q in rows if got[i].kept != bool(q)]
    assert len(wrong) <= 3
    held = [got[i].quality_probability for i, _, q in rows if i >= 300 and q]
    assert np.mean(held) > 0.9  # calibrated odds of good rows
    kept = sorted(r.doc_id for r in Q.keep_quality(docs, model).collect())
    assert kept == sorted(i for i in got if got[i].kept)


def test_edges_of_the_input(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "word " * 30), (1, "a b")], "doc_id long, text string")
    none = Q.train_quality(docs, spark.createDataFrame([], "doc_id long, quality int"))
    rows = Q.quality_rules(docs, none).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in rows) == [(0, 30, True, False), (1, 0, True, False), (1, 2, True, False), (2, 0, True, False)]
    one = Q.train_quality(docs, spark.createDataFrame([(1, 0)], "doc_id long, quality int"))
    assert one.probability(np.zeros(1))[0] < 0.01
    assert Q.quality_rules(docs.where("false"), none).count() == 0 and Q.keep_quality(docs.where("false"), none).count() == 0
