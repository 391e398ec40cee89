import hashlib
import math
import re
import zlib
from collections import Counter

from talktree.llm.importance import ImportanceParams, importance_sample, importance_weights

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = WORD.findall((text or "").translate(LOW))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(rows, target, p):
    """A list of (doc_id, n_features, weight, score, rank) for unique ids."""
    bucket = lambda f: zlib.crc32(f.encode()) % p.buckets
    docs = {i: features(t) for i, t in rows}
    s = Counter(bucket(f) for _, fs in docs.values() for f in fs)
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + p.buckets) / ((s[b] + 1) * (all_t + p.buckets)))) for b in s}
    out = {}
    for i, (n, fs) in docs.items():
        w = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"{p.seed}:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [i, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None]
    able = sorted((i for i in out if docs[i][0] >= p.min_words), key=lambda i: (-out[i][3], i))
    for k, i in enumerate(able[: p.percent * len(able) // 100]):
        out[i][4] = k + 1
    return sorted(tuple(x) for x in out.values())


def corpus():
    words = "Über die the Model model's naïve data-set 42 x9 É́ЖЗ 日本 the of of of A".split()
    rows = [(3 * k, " ".join(words[(k * j + j // 3) % len(words)] for j in range(k % 37))) for k in range(150)]
    odd = ["", None, " ,;.\n", "one", "ONE two", "a\x00b\x7fc  d ", "_lead trail_", "same " * 40, "same " * 40, "word " * 30_000, "ÀÉ" * 20_000]
    return rows + [(1000 + k, t) for k, t in enumerate(odd)]


TARGET = ["The model of the data", "naïve naïve model", "", None, "日本 data"]


def run(spark, rows, target, p, schema="doc_id long, text string"):
    docs = spark.createDataFrame(rows, schema).repartition(3)
    return importance_sample(docs, spark.createDataFrame([(x,) for x in target], "text string"), p)


def test_against_plain_version(spark):
    for p in (ImportanceParams(), ImportanceParams(buckets=50, percent=40, min_words=3)):
        got = run(spark, corpus(), TARGET, p)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert all(kind == "bigint" for _, kind in got.dtypes)
        assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == brute(corpus(), TARGET, p)


def test_ranks_are_gapless_over_many_ranges(spark):
    rows = [(k, f"w{k % 7} " * 25) for k in range(3000)]
    got = run(spark, rows, TARGET, ImportanceParams()).where("rank is not null").orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, 151))
    assert all((-a.score, a.doc_id) < (-b.score, b.doc_id) for a, b in zip(got, got[1:]))


def test_edges_of_the_input(spark):
    assert run(spark, [], TARGET, ImportanceParams()).count() == 0
    p = ImportanceParams(percent=100, min_words=2)
    rows = [(None, "a b c"), (None, "a b c"), (7, "a b c"), (7, "a b c"), (8, None)]
    got = sorted(map(tuple, run(spark, rows, TARGET, p).collect()), key=repr)
    assert sorted(r[1] for r in got) == [0, 6, 6, 6, 6]  # rows that repeat an id are documents of their own
    assert sorted((r[4] or 0) for r in got if r[0] == 7) == [1, 2]
    assert all(r[3] is None and r[4] is None for r in got if r[0] is None)
    assert [r[2] for r in run(spark, [(1, "x y")], [], p).collect()] == [sum(r[2] for r in brute([(1, "x y")], [], p))]
    extra = spark.createDataFrame([(1, "x y", 5, 6, 7, 8, 9, 1)], "doc_id long, text string, row int, pos int, word int, b1 int, bucket int, rank int")
    goal = spark.createDataFrame([("x", 1, 2)], "text string, row int, gain int")
    assert importance_weights(extra, goal).select("doc_id", "n_words", "n_features").first() == (1, 2, 3)
