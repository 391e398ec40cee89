import hashlib
import os
import random

import numpy as np
import pytest

from talktree.llm import sentence_pieces as S
from talktree.llm import words as W
from talktree.llm.registry import QUERIES

sentencepiece = pytest.importorskip("sentencepiece")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=S.default_model())


@pytest.fixture(scope="module")
def table():
    return S.PieceTable(S.default_model())


def texts(table):
    rng = random.Random(1)
    signs = list("ab cdeth  in\n\t.,'\"()=<>0x1é́日本語ЖЗ𝒳 ▁\x00🙂")
    pieces = list(table.vocabulary.score)
    out = ["", " ", "   ", "▁", "▁▁a", "<s> </s> <unk> <0x0A>", "﻿a", "a" * 5000, "日本" * 3000, " " * 3000, "".join(rng.choices("0123456789abcdef", k=4000))]
    out += ["".join(rng.choices(signs, k=rng.randint(1, 60))) for _ in range(600)]
    return out + ["".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(2000)]


def as_rows(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)


def test_ids_and_texts_equal_the_library(spark, library, table):
    rows = [*texts(table), None]
    out = S.decode_documents(S.encode_documents(as_rows(spark, rows))).collect()
    assert len(out) == len(rows)
    for r in out:
        want = library.encode(rows[r.doc_id] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == want, r.text
        assert r.decoded == library.decode(want), r.text


def test_any_ids_decode_as_the_library_does(library, table):
    rng = random.Random(2)
    some = [[rng.choice([rng.randrange(32000), rng.randrange(260), 259, 28705]) for _ in range(rng.randint(0, 8))] for _ in range(3000)]
    got = table.decode(np.array([i for x in some for i in x]), np.cumsum([0, *map(len, some)]))
    assert [x.decode() for x in got] == [library.decode(x) for x in some]


def test_prefix_table_has_the_last_piece_of_every_prefix(library, table):
    v = table.vocabulary
    for text in (" international", " 日本語 naïve", " <unk>()=", "   x", " xxxxxxxx"):
        for k in range(1, len(text) + 1):
            want = library.encode(text[1:k]) if k > 1 else []
            assert v.ids(text[:k]) == (want or v.ids(" "))


def test_a_full_table_is_emptied(library):
    small, rng = S.PieceTable(S.default_model(), limit=5), random.Random(3)
    for _ in range(20):
        text = "".join(rng.choices("abc de1", k=50))
        block = W.Block(0, np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        ids, bounds = small.encode(block)
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True) and bounds.tolist() == [0, len(ids)]


def test_edges_of_the_input(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.piece_digests(empty).collect() == []
    odd = spark.createDataFrame([(None, None, 1, "a"), (3, "x", 2, "b"), (3, "x", 2, "b")], "doc_id long, text string, decoded_ int, kept string")
    rows = S.piece_digests(odd).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 2), (3, 3), (3, 3)]
    assert S.encode_documents(odd, out="n").columns == [*odd.columns, "n"]
    with pytest.raises(ValueError):
        S.encode_documents(odd, out="KEPT")
    none = spark.createDataFrame([(None,), (b"",)], "ids binary")
    assert [r.decoded for r in S.decode_documents(none).collect()] == ["", ""]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_query_against_the_library(spark, library):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op13_sentence_pieces"](spark, DATA).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        r = got[doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
