import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from talktree.llm import language_id as L
from talktree.llm import words as W

PARTS = {"aa": ["tion", "the", "ing", "of", "and"], "bb": ["heit", "sch", "ung", "über", "der"], "cc": ["ción", "que", "los", "mente", "ñar"]}


def text(lang, n, rng):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def brute_profile(t, size, longest=3):
    counts: Counter = Counter()
    s = " " + "".join(c if c.isalpha() else " " for c in t.lower()) + " "
    s = " " + " ".join(s.split()) + " " if s.split() else " "
    for n in range(1, longest + 1):
        for i in range(len(s) - n + 1):
            g = s[i : i + n]
            if " " not in g[1:-1] and g != " ":
                counts[g] += 1
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))
    return [g for g, _ in sorted(((code(g), -c) for g, c in counts.items()), key=lambda x: (x[1], x[0]))][:size]


@pytest.mark.parametrize("texts", [["Ab  ab, c!", "", "1 2", "x", "Über über ÜBER"], ["a b", "b a"], ["long " * 50]])
def test_ranks(texts):
    p = L.LanguageParams(profile=20)
    for block in W.blocks(pa.array(texts), 12):
        of, rank, code, has = L._ranked(block, p)
        for i in range(block.n):
            t = block.text(i).decode()
            assert code[of == i].tolist() == brute_profile(t, 20)
            assert rank[of == i].tolist() == list(range((of == i).sum()))
            assert has[i] == any(c.isalpha() for c in t)


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    rows = [(i, text(lang, rng.randint(3, 40), rng), lang) for i in range(300) for lang in [rng.choice(list(PARTS))]]
    df = spark.createDataFrame([(*r, "zz") for r in rows] + [(1000, None, "aa", "s"), (1001, "12 !?", "bb", "s"), (None, "the of and", None, "s")], "doc_id long, text string, lang string, score string")
    profiles = L.train_profiles(df)
    assert set(profiles) == set(PARTS)
    got = {r.doc_id: r for r in L.identify_languages(df, profiles).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if got[i].held_out]) > 0.97
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1000].score == 0 and got[None].lang_pred == "aa" and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())


def test_held_out_rows_are_not_learnt(spark):
    rng = random.Random(2)
    rows = [(i, text("aa", 20, rng), "aa") for i in range(60)]
    changed = [(i, t if zlib.crc32(str(i).encode()) % 5 else "zzz qqq", x) for i, t, x in rows]
    a, b = (L.train_profiles(spark.createDataFrame(r, "doc_id long, text string, lang string")) for r in (rows, changed))
    assert a == b


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "the", None)], "doc_id long, text string, lang string")
    assert L.train_profiles(df) == {}
    assert L.identify_languages(df, {}).first().lang_pred == "und"
    assert L.identify_languages(df.where("false"), {}).count() == 0
