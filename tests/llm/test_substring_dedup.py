import hashlib
import random
import re

import pytest

from talktree.llm.substring_dedup import FingerprintIndex, SubstringParams, substring_dedup, to_compact

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    first, words = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        words[i] = WORD.findall(t or "")
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n, v=50: [f"w{rng.randint(0, v)}" for _ in range(n)]
    shared = [text(30) for _ in range(4)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += text(rng.randint(0, 12))
            s = rng.choice(shared)
            a = rng.randint(0, 12)
            w += s[a : a + rng.randint(5, 30)]
        rows.append((i * 2, ("\n" if i % 3 else "  ").join(w)))
    loop = "la " * 60
    return rows + [(400, None), (402, ""), (404, loop), (406, loop + "end"), (408, rows[40][1]), (410, "é x " * 30)]


@pytest.mark.parametrize("window, gram, first", [(10, 3, 0.25), (10, 10, 0.5), (12, 1, 0.0), (50, 8, 0.25)])
def test_against_brute_force(spark, window, gram, first):
    rows = corpus(window)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, id int").repartition(3)
    out = substring_dedup(df, params=SubstringParams(window=window, gram=gram, first_batch=first), with_text=True)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in out.collect()}
    assert got == brute(rows, window)


def test_batches_one_by_one(spark):
    rows = corpus(3)
    p = SubstringParams(window=10, gram=4, max_runs=3)
    df = spark.createDataFrame(rows, "id long, text string")
    index, got = FingerprintIndex(spark, p), {}
    for lo in range(0, 500, 80):
        batch = df.where(f"id >= {lo} and id < {lo + 80}")
        for r in index.add(batch, df.where(f"id < {lo + 80}")).collect():
            got[r.id] = (r.n_words, r.n_removed, r.kept_sha256)
    assert len(index.runs) <= 3
    assert got == {i: v[:3] for i, v in brute(rows, 10).items()}


def test_edges_of_the_input(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    t = " ".join(f"x{i}" for i in range(60))
    rows = spark.createDataFrame([(None, t), (1, t), (1, t), (2, t)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup(rows).collect()) == [(0, 0), (1, 0), (1, 0), (2, 60)]


def test_runs_are_merge_joined_and_compacted_by_tiers(spark):
    assert [to_compact(x, 3) for x in ([], [9], [9, 1, 1], [5, 1, 1], [20, 1, 1, 1], [1, 1, 1], [100, 30, 9, 1])] == [0, 0, 0, 3, 3, 3, 2]
    rows, p = corpus(5), SubstringParams(window=10, gram=4, max_runs=3)
    df = spark.createDataFrame(rows, "id long, text string")
    index, plans, merged = FingerprintIndex(spark, p), [], FingerprintIndex._merged

    def seen(self, x, y, how):
        out = merged(self, x, y, how)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    FingerprintIndex._merged = seen
    try:
        for lo in range(0, 500, 80):
            index.add(df.where(f"id >= {lo} and id < {lo + 80}"), df.where(f"id < {lo + 80}")).count()
    finally:
        FingerprintIndex._merged = merged
    single = [x for x in plans if x.count("SortMergeJoin") == 1]
    assert single and not any("Exchange" in x or "Sort [" in x or "Aggregate" in x for x in single)
    whole = {(r.anchor, r.context): r.id for run in index.runs for r in index._plain(run).collect()}
    again = FingerprintIndex(spark, p)
    again.add(df, df).count()
    assert {k: min(r.id for run in index.runs for r in index._plain(run).where(f"anchor = {k[0]} and context = {k[1]}").collect()) for k in list(whole)[:5]} == {k: r for k, r in ((tuple(r)[:2], r.id) for r in again._plain(again.runs[0]).collect()) if k in list(whole)[:5]}
    assert {k for k in whole} == {(r.anchor, r.context) for r in again._plain(again.runs[0]).collect()}
    with pytest.raises(ValueError, match="ascending"):
        index.add(df.where("id = 4"), df)
    tables = len(spark.catalog.listTables())
    index.close()
    again.close()
    assert len(spark.catalog.listTables()) < tables or tables == 0
