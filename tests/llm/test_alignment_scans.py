"""Alignment, license scans and benchmark decontamination."""

import random

import numpy as np
import pyarrow as pa
import pytest

from talktree.llm import decontaminate as D
from talktree.llm import licenses as L
from talktree.llm import words as W
from talktree.llm.alignment import align


def smith_waterman(a, b, low=None, high=None):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            if low is None or low <= j - i <= high:
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


@pytest.mark.parametrize("seed", range(4))
def test_align(seed):
    rng = random.Random(seed)
    for _ in range(250):
        a, b = (np.array([rng.randint(0, 5) for _ in range(rng.randint(1, 14))]) for _ in range(2))
        band = (None, None) if rng.random() < 0.5 else (rng.randint(-6, 0), rng.randint(0, 6))
        x = align(a, b, *band)
        assert x.score == smith_waterman(a, b, *band)
        if x.score:
            assert smith_waterman(a[x.a_start : x.a_end], b[x.b_start : x.b_end]) >= x.score
            assert a[x.a_start] == b[x.b_start] and a[x.a_end - 1] == b[x.b_end - 1] and x.matches >= 1
    assert align(np.array([]), np.array([1])).score == 0


def words(n, rng, v=300):
    return [f"w{rng.randint(0, v)}" for _ in range(n)]


def test_contamination(spark):
    rng = random.Random(7)
    items = [words(rng.randint(12, 40), rng) for _ in range(12)]
    docs, want = [], {}
    for i in range(150):
        w = words(rng.randint(20, 200), rng)
        if i % 5 == 0:
            k = rng.randrange(12)
            part = items[k][:]
            if i % 10 == 0:  # an edited copy: a tenth of the words changed, one left out, one put in
                for _ in range(len(part) // 10):
                    part[rng.randrange(len(part))] = "edited"
                del part[rng.randrange(len(part))]
                part.insert(rng.randrange(len(part)), "new")
            at = rng.randint(0, len(w))
            w = w[:at] + [x.upper() + "," for x in part] + w[at:]
            want[i] = k
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame([(*d, 5) for d in docs] + [(900, None, 5), (901, "", 5)], "doc_id long, text string, item_id int")
    tests = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)] + [(50, None), (51, ""), (52, "too short")], "item_id long, text string")
    for p in (D.DecontaminationParams(), D.DecontaminationParams(block_bytes=400)):
        got = {r.doc_id: r for r in D.contaminated(df, tests, p).collect()}
        assert {i: r.item_id for i, r in got.items()} == want
        full = [r for i, r in got.items() if i % 10]
        assert all(r.score == 1 and r.n_matches == r.end_word - r.start_word == len(items[r.item_id]) for r in full)
    assert D.contaminated(df, tests.where("false")).count() == 0 and D.contaminated(df.where("false"), tests).count() == 0


def test_seeds_cover_every_stretch():
    rng = random.Random(1)
    w = np.array([rng.randint(0, 1 << 60) for _ in range(30)], np.uint64)
    p = D.DecontaminationParams()
    index = D.build_index([1], [w], {int(x): rng.randint(0, 99) for x in w}, p)
    places = sorted(index.place.tolist())
    assert places[0] < p.stretch and max(np.diff(places)) <= p.stretch


def test_winnow():
    rng = random.Random(1)
    for n in (0, 1, 2, 5, 40):
        v = np.array([rng.randint(0, 9) for _ in range(n)], np.uint64)
        got = set(L.winnow(v, 4).tolist())
        want = set()
        for i in range(max(1, n - 3)) if n else ():
            part = v[i : i + 4].tolist()
            want.add(i + len(part) - 1 - part[::-1].index(min(part)))
        assert got == want


def test_licenses(spark):
    mit = L.TEMPLATES["MIT-text"]
    edited = mit.replace("free of charge, ", "").replace("copies", "copied works")
    docs = [
        (1, "é😀 text. Released under the MIT License. more"), (2, "LICENSED UNDER CC BY-NC 4.0.\nx"), (3, mit), (4, "pre " + edited + " post"), (5, "no license here"), (6, None), (7, ""),
        (8, "Licensed under the Apache License, Version 2.0. And again: licensed under the apache license version 2.0"), (9, "permission is hereby granted, free of charge, to any person"),
    ]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, license string")
    rows = L.scan_licenses(df).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.license, r.start, r.end, r.coverage))
    assert {i: [x[0] for x in v] for i, v in got.items()} == {1: ["MIT"], 2: ["CC-BY-NC-4.0"], 3: ["MIT-text"], 4: ["MIT-text"], 8: ["Apache-2.0", "Apache-2.0"]}
    assert docs[0][1][got[1][0][1] : got[1][0][2]] == "Released under the MIT License" and got[3][0][3] == 1.0 and 0.8 <= got[4][0][3] < 1
    assert docs[7][1][got[8][1][1] : got[8][1][2]] == "licensed under the apache license version 2.0"
    assert L.scan_licenses(df.where("false")).count() == 0 and L.scan_licenses(df, {}).count() == 0 and L.scan_licenses(df, {"short": "a b"}).count() == 0


def test_index_of_templates():
    index = L.index_templates({"b": "one two three four five", "a": "one two three"}, L.LicenseParams())
    assert index.names == ["a", "b"] and list(index.print_) == sorted(index.print_)
    assert pa.array(index.template.tolist()).unique().to_pylist()


def test_every_copy_that_reaches_the_score_is_found(spark):
    rng = random.Random(11)
    items = [words(rng.randint(16, 59), rng, 2000) for _ in range(30)]
    docs, want = [], set()
    for i in range(600):
        k = rng.randrange(30)
        part = items[k][:]
        kind = i % 6
        if kind < 3:  # every third, fourth or fifth word changed
            part = [f"edit{j}" if j % (3 + kind) == rng.choice((2, 2, 1)) else x for j, x in enumerate(part)]
        elif kind == 3:
            part = [x if rng.random() > 0.3 else f"edit{j}" for j, x in enumerate(part)]
        elif kind == 4:
            part = [y for j, x in enumerate(part) for y in (x, f"new{j}")][:-1]
        else:
            part = part[: len(part) // 2 + 1]
        text = words(rng.randint(0, 90), rng, 2000) + part + words(rng.randint(0, 90), rng, 2000)
        docs.append((i, " ".join(text)))
        code = {x: n for n, x in enumerate(dict.fromkeys(items[k] + text))}
        x = align(*(np.array([code[y] for y in z]) for z in (items[k], text)))
        if x.score >= len(items[k]) and x.matches >= 8:
            want.add((i, k, x.score / (2 * len(items[k]))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    tests = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.score) for r in D.contaminated(df, tests).collect()}
    assert want <= got and len(want) > 300


def test_long_parts_and_short_items(spark):
    rng = random.Random(5)
    items = [words(59, rng, 5000), words(400, rng, 5000), words(6, rng, 5000), words(5, rng, 5000), words(8, rng, 5000)]
    around = lambda part: " ".join([*words(60, rng, 5000), *part, *words(60, rng, 5000)])
    edited = [x if j % 6 != 5 else "edit" for j, x in enumerate(items[1][200:224])]
    short = [[x if j != 2 else "edit" for j, x in enumerate(items[k])] for k in (2, 3, 4)]
    parts = [items[0][15:44], items[1][100:290], edited, *short, items[0][20:37], [*items[2][:2], "a", "b", *items[2][4:]], [x if j % 2 else "edit" for j, x in enumerate(items[1][:40])]]
    df = spark.createDataFrame([(i, around(x)) for i, x in enumerate(parts)], "doc_id long, text string")
    tests = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: r for r in D.contaminated(df, tests).collect()}
    assert {i: r.item_id for i, r in got.items()} == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3, 5: 4}
    assert (got[1].start_word, got[1].end_word, got[1].n_matches) == (60, 250, 190)


def test_edited_headers_and_whole_notices(spark):
    header = L.TEMPLATES["Apache-2.0-header"]
    texts = [header.replace("express or implied", "expressed or implied"), header.replace("obtain a copy", "get a copy"), L._BSD_TERMS + L._BSD_WARRANTY, L.TEMPLATES["BSD-3-Clause-text"], L.TEMPLATES["MIT-full-text"], L.TEMPLATES["BSD"]]
    df = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((r.doc_id, r.license) for r in L.scan_licenses(df).collect())
    assert got == list(enumerate(["Apache-2.0-header", "Apache-2.0-header", "BSD-2-Clause-text", "BSD-3-Clause-text", "MIT-full-text", "BSD"]))


def test_copies_close_together(spark):
    line = "Released under the MIT License."
    texts = ["\n".join([line] * n) for n in (1, 2, 7)] + [f"{line} x {line} y z {line}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [(r.doc_id, r.start) for r in L.scan_licenses(df).collect()]
    assert sorted(rows) == [(i, k) for i, t in enumerate(texts) for k in range(len(t)) if t.startswith(line, k)]


def test_licenses_against_all_pairs(spark):
    """Every template aligned with every whole text, without fingerprints or bands."""
    rng = random.Random(3)
    p, names, texts = L.LicenseParams(), sorted(L.TEMPLATES), []
    for i in range(120):
        w = L.TEMPLATES[rng.choice(names)].split()
        for _ in range(int(len(w) * rng.choice([0, 0.05, 0.1, 0.25]))):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 99)}"
        texts.append(" ".join(words(rng.randint(0, 30), rng) + (w if i % 6 else []) + words(rng.randint(0, 30), rng)))
    texts += [L._gnu("Lesser General Public License", "2.1", "library"), L.TEMPLATES["BSD-2-Clause-text"]]
    df = spark.createDataFrame([*enumerate(texts), (None, texts[1]), (None, texts[1])], "doc_id long, text string")
    got = {}
    for r in L.scan_licenses(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len({(r.license, r.start) for r in got[None]}) * 2 == len(got.get(None, []))
    index, close = L.index_templates(L.TEMPLATES, p), []
    for d, text in enumerate(texts):
        block = next(W.blocks(pa.array([text])))
        h = L._plain(block)[1]
        for t, target in enumerate(index.words):
            if len(target) < p.gram:
                continue
            x = align(target, h)
            said = L._texts(text)[max(0, x.b_start - x.a_start) : x.b_end + len(target) - x.a_end]
            if x.matches >= p.min_coverage * len(target) and L.telling(said) == L.telling(L._texts(L.TEMPLATES[names[t]])):  # else it is another license
                a, b = (int(v) for v in (L._plain(block)[0].start[x.b_start], L._plain(block)[0].end[x.b_end - 1]))
                close.append((d, index.names[t], any(r.start < b and a < r.end and r.n_matches >= x.matches for r in got.get(d, []))))
    assert len(close) > 100 and sum(ok for _, _, ok in close) >= 0.98 * len(close), [c for c in close if not c[2]]
    assert [r.license for r in got[120]] == ["LGPL-2.1-header"] and [r.license for r in got[121]] == ["BSD-2-Clause-text"]


def test_contamination_of_repeated_rows_and_null_ids(spark):
    item = " ".join(f"i{k}" for k in range(20))
    df = spark.createDataFrame([(1, f"x {item} y"), (1, f"x {item} y"), (None, item), (2, "w " * 200_000 + item)], "doc_id long, text string")
    tests = spark.createDataFrame([(7, item), (7, item)], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.score) for r in D.contaminated(df, tests).collect())
    assert got == [(i, 7, 1.0) for i in (0, 0, 1, 1, 1, 1, 2, 2)]


def licenses_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in L.scan_licenses(df).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.coverage))
    return [sorted(got.get(i, [])) for i in range(len(texts))]


def test_no_license_goes_by_the_name_of_another(spark):
    line = "This work is licensed under {}."
    apart = {
        line.format("the GNU General Public License, version 2"): "GPL-2.0", line.format("the GNU Lesser General Public License, version 3"): "LGPL-3.0",
        line.format("the GNU General Public License, version 3.0"): "GPL-3.0", line.format("the GNU Affero General Public License, version 3"): "AGPL-3.0",
        line.format("a Creative Commons Attribution 3.0 Unported License"): "CC-BY-3.0", line.format("a Creative Commons Attribution-ShareAlike 4.0 International License"): "CC-BY-SA-4.0-line",
        line.format("a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"): "CC-BY-NC-SA-4.0-line",
        "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0", "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "Licensed under CC BY 4.0.": "CC-BY-4.0-short", L._BSD_TERMS: "BSD-2-Clause-conditions",
        f"{L._BSD_TERMS} {L._BSD_THIRD}": "BSD-3-Clause-conditions", L.TEMPLATES["MPL-1.1-header"]: "MPL-1.1-header", L.TEMPLATES["LGPL-3.0-header"]: "LGPL-3.0-header",
    }
    none = [line.format(x) for x in ("the GNU General Public License, version 1", "the GNU Lesser General Public License, version 4", "a Creative Commons Attribution 2.5 International License")]
    none += ["Licensed under the Apache License, Version 1.1.", "Licensed under CC BY-NC 3.0.", L.TEMPLATES["MPL-2.0"].replace("v. 2.0", "v. 1.1"), L._gnu("General Public License", "1"), L._gnu("Library General Public License", "2")]
    got = licenses_of(spark, [f"x {t} y" for t in (*apart, *none)])
    assert [[n for n, _ in g] for g in got] == [[n] for n in apart.values()] + [[]] * len(none)
    whole = licenses_of(spark, [L.TEMPLATES[n] for n in sorted(L.TEMPLATES)])
    assert [[n for n, c in g if c == 1] for g in whole] == [[n] for n in sorted(L.TEMPLATES)]
    assert L.telling("version 2 0 or v 1 1 of the gnu library license 3 no 7 sharealike 4 0".split()) == ["2", "1", "1", "library", "3", "sharealike", "4"]


def test_repeats_take_linear_time(spark):
    import time

    line, run = "Released under the MIT License.", L._scan(L.index_templates(L.TEMPLATES, L.LicenseParams()), L.LicenseParams())
    def scan(text):
        began = time.process_time()
        rows = sum(b.num_rows for b in run(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])])))
        return rows, time.process_time() - began
    rows, seconds = scan("\n".join([line] * 32_000))
    assert rows == 32_000 and seconds < 5
    rows, seconds = scan("\n".join(["Released under this MIT License."] * 8_000))
    assert seconds < 10
    notices = "\n\n".join(f"Copyright {i} Someone\n{L.TEMPLATES[n]}" for i, n in enumerate(sorted(L.TEMPLATES) * 40))
    rows, seconds = scan(notices)
    assert len(notices) > 500_000 and rows >= 40 * len(L.TEMPLATES) and seconds < 20


def test_items_of_a_few_words_are_found_whole(spark):
    items = [(1, "alpha beta gamma delta"), (2, "Alpha, beta"), (3, "omega"), (4, "alpha beta"), (5, "?!"), (6, "alpha gamma"), (7, "one two three four five six seven eight")]
    docs = [(1, "x ALPHA beta-gamma delta y"), (2, "alpha gamma beta"), (3, "omega omega"), (4, None), (5, "alpha bet"), (6, "x one two three four five six seven eight"), (7, "beta alpha " * 50_000 + "omega")]
    df, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.item_words, r.score, r.n_matches, r.start_word, r.end_word) for r in D.contaminated(df, tests).collect())
    assert got == [
        (1, 1, 4, 1.0, 4, 1, 5), (1, 2, 2, 1.0, 2, 1, 3), (1, 4, 2, 1.0, 2, 1, 3), (2, 6, 2, 1.0, 2, 0, 2), (3, 3, 1, 1.0, 1, 0, 1), (6, 7, 8, 1.0, 8, 1, 9),
        (7, 2, 2, 1.0, 2, 1, 3), (7, 3, 1, 1.0, 1, 100_000, 100_001), (7, 4, 2, 1.0, 2, 1, 3),
    ]
    assert D.contaminated(df, tests.where("item_id in (3, 5)")).count() == 2
