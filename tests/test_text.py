"""Text and value functions, the column forms held against the plain ones."""

import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talktree.functions import text as X
from talktree.functions import values as V

CASES = ["", "Plain  ASCII\ttext ", "Straße ÄÖ é", "ﬁne “quotes” – dash", "a b　c", "x\x1cy\x85z", "ẞ İ ſ K", "é combined", "日本 ｆｕｌｌ", "nul\0here", "ÿ×÷µ", "\n\r\n"]


def test_normalized_column_matches_function(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*CASES, None])], "i int, t string")
    got = {r.i: r.n for r in df.select("i", X.normalized(F.col("t")).alias("n")).collect()}
    for i, t in enumerate([*CASES, None]):
        assert got[i] == X.normalize(t), repr(t)


@given(st.text(max_size=30))
@settings(max_examples=200, deadline=None)
def test_map_gives_the_normalised_text(t):
    norm, starts, ends = X.normalized_map(t)
    assert len(norm) == len(starts) == len(ends)
    assert all(a < b for a, b in zip(starts, ends)) and starts == sorted(starts)
    if t.isascii():
        assert norm == X.normalize(t)


def brute_word(norm, needle):
    spans = [(m.start(), m.end()) for m in re.finditer("[a-z0-9_]+", needle)]
    word = lambda c: bool(re.fullmatch("[a-z0-9_]", c))
    for i in range(len(norm) - len(needle) + 1):
        if norm.startswith(needle, i):
            edges = [(i, i + len(needle)), *((i + a, i + b) for a, b in spans)]
            if not any((a > 0 and word(norm[a - 1])) or (b < len(norm) and word(norm[b])) for a, b in edges):
                return True
    return False


@given(st.text("ab_.+ ", max_size=12), st.text("ab_.+", min_size=1, max_size=4))
@settings(max_examples=300, deadline=None)
def test_word_mode(norm, needle):
    if re.search("[a-z0-9_]", needle):
        assert (X.find(norm, needle, "word") >= 0) == brute_word(norm, needle)


def test_contains_column(spark):
    texts = ["the cat", "theme", "c++ code", "a.b", "x_the", "(the)"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for needle in ("the", "c++", "a.b", "."):
        for mode in ("contains", "word"):
            got = [r.x for r in df.select(X.contains(F.col("t"), needle, mode).alias("x")).collect()]
            assert got == [X.find(t, needle, mode) >= 0 for t in texts], (needle, mode)


@pytest.mark.parametrize(
    "t, yes",
    [("[non-text content: image]", True), ("  [non-text part: int] \n", True), ("[non-text content: ]", False), ("[non-text content: a] b", False), ("[non-text content: a\nb]", False), ("text", False), ("", False)],
)
def test_placeholder(spark, t, yes):
    assert X.is_placeholder_text(t) is yes
    assert spark.range(1).select(X.is_placeholder(F.lit(t))).first()[0] is yes


def test_message_content():
    c = lambda content: X.message_content({"content": content})[:2]
    assert X.message_content(None) == (None, "", []) and c(None) == (None, "")
    assert c("s") == ("unknown", "[non-text content: str]")
    assert c({"content_type": "text", "parts": ["a", "", "b"]}) == ("text", "a\n\nb")
    assert c({"content_type": "text", "parts": "plain"}) == ("text", "plain")
    assert c({"content_type": "image", "parts": []}) == ("image", "[non-text content: image]")
    assert c({"content_type": "x", "note_b": {"deep": [1, "t"]}, "a": "first"}) == ("x", "a: first\n\nnote b: deep: [non-text part: int]\n\nt")
    assert c({"content_type": "text", "parts": [{"text": "in dict"}, {"value": "v"}]}) == ("text", "in dict\n\nv")
    deep = "end"
    for _ in range(12):
        deep = [deep]
    assert c({"content_type": "text", "parts": deep})[1] == ""


def test_display_text(spark):
    raw = '{"content": {"content_type": "text", "parts": ["found"]}}'
    rows = [("own", raw), ("", raw), ("[non-text content: x]", raw), ("", "{"), (None, None), ("", '{"content": {"content_type": "thoughts", "parts": ["no"]}}')]
    df = spark.createDataFrame(rows, "t string, r string")
    got = [r.d for r in df.select(X.display_text(F.col("t"), F.col("r")).alias("d")).collect()]
    assert got == ["own", "found", "found", "", "", ""] == [X.recover(t, r) for t, r in rows]


def test_snippet_and_highlights():
    t = "x" * 100 + " Needle\nin " + "y" * 100
    s = X.snippet(t, ["needle"])
    assert s.startswith("...") and s.endswith("...") and "Needle in" in s
    assert X.snippet("short", ["none"]) == "short" and X.snippet("", ["a"]) == ""
    assert X.highlights("ab ab", ["ab"]) == [(0, 2), (3, 5)]
    assert X.highlights("abab", ["ab"]) == [(0, 4)]
    assert X.highlights("😀 ab", ["ab"]) == [(3, 5)]
    assert X.first_match("The the", ["the"], "contains") == (0, 3, "the")


def test_values(spark):
    assert V.canonical_id(" a ", True) == "a" and V.canonical_id(3) == "3" and V.canonical_id(True) is None and V.canonical_id("a\n") is None
    assert V.to_time("1.5") == (1.5, None) and V.to_time("x")[1] == "invalid_timestamp" and V.to_time("1e999")[1] == "non_finite_timestamp"
    assert [V.to_flag(x) for x in (True, "Yes", "off", "?", None, 2)] == [1, 1, 0, None, None, 1]
    df = spark.createDataFrame([(0.0,), (1.9,), (-0.5,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in df.select(V.time_text(F.col("x"))).collect()] == ["1970-01-01 00:00:00", "1970-01-01 00:00:01", "1969-12-31 23:59:59", "", ""]


def test_times_of_any_year_and_zone(spark):
    times = {253402300799.0: "9999-12-31 23:59:59", 253402300800.0: "10000-01-01 00:00:00", 517899412399.5: "18381-07-31 03:53:19", 9223372036854.0: "294247-01-10 04:00:54",
             -62135596800.0: "0001-01-01 00:00:00", -62167219200.5: "-1-12-31 23:59:59", -78259700000.0: "-510-01-18 10:26:40", 1679797800.0: "2023-03-26 02:30:00", 1678588200.0: "2023-03-12 02:30:00"}
    df = spark.createDataFrame([(x,) for x in times], "x double")
    try:
        for zone in ("Europe/Berlin", "America/New_York", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert {r.x: r.t for r in df.select("x", V.time_text(F.col("x")).alias("t")).collect()} == times
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_file_names(spark):
    rows = [(0, 'a/b:c*"d', "i" * 300), (1, "con", "c"), (2, " .. ", "LPT¹.x"), (3, "t" * 500, "id"), (4, "é" * 300, "ü" * 120), (5, "日本 \t語\x85", "n"), (6, None, "x. "), (7, "E\u0301", "e"), (8, "É", "e"), (9, "a\x00b\x1f", "z")]
    df = spark.createDataFrame(rows, "i int, t string, c string")
    name = V.export_name(F.col("t"), F.col("c"), F.lit(0.0), F.lit("md"))
    got = {r.i: r for r in df.select("i", V.safe_name(F.col("t")).alias("s"), name.alias("n")).withColumn("k", V.name_key(F.col("n"))).collect()}
    assert [got[i].s for i in (0, 1, 2, 5, 6, 9)] == ["a_b_c_d", "_con", "untitled", "日本__語", "untitled", "a\ufffdb"]
    assert all(len(r.n.encode()) <= 240 and r.n.startswith("1970-01-01_") and r.n.endswith(".md") for r in got.values())
    assert got[3].n == "1970-01-01_" + "t" * 80 + "_id.md" or len(got[3].n) <= 240
    assert got[2].n == "1970-01-01_untitled__LPT¹.x.md" and got[6].n == "1970-01-01_untitled_x.md"
    assert got[7].k == got[8].k and got[7].s == got[8].s == "É"
    cuts = spark.createDataFrame([("aé😀b",)], "t string").select(*(V.cut_utf8(F.col("t"), n).alias(f"c{n}") for n in range(10))).first()
    assert list(cuts) == ["aé😀b".encode()[:n].decode("utf-8", "ignore") for n in range(10)]


def test_highlights_of_decomposed_text():
    syllables = unicodedata.normalize("NFD", "한국어 é")
    assert X.highlights(f"x {syllables} y", ["한국어"]) == [(2, 2 + len(unicodedata.normalize("NFD", "한국어")))]
    assert X.normalized_map(syllables)[0] == X.normalize(syllables)
