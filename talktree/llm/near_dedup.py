"""MinHash near-duplicate detection with fast similarity sketches (Dahlgaard, Knudsen, Thorup 2017).

A text's set holds its distinct word shingles (the whole word sequence if it has fewer words).
Equal sets are folded first.  Each remaining set gets a sketch of ``bands * rows`` coordinates:
round after round every element is hashed to one coordinate with a value that grows with the round,
the first ``t`` rounds to a random coordinate and the next ``t`` to the round's own one, until each
coordinate has a value; that guarantees that all are filled, with Chernoff-type concentration.
Bands of coordinates make candidate pairs, and links are confirmed on the full sets of words.

Equal sets, by 128 bits of two independent fingerprints, are one class with a number of its own, so
rows that repeat an id don't stand in for each other.  A bucket is held together by its head; what that
leaves in different components is compared.  In large groups only classes are that share a rare shingle
with one of another component: two linked sets share one of the smaller set's n - 2sn/(1+s) rarest and the
larger one's n - sn rarest, which texts with only a template in common don't.  They are compared within
small buckets of these shingles, where sizes, one-bit coordinates and the shingle's ranks allow a link; what
shares only large ones is compared group by group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .shared import Scratch

_U = np.uint64
#: 64-bit words of one-bit coordinates that tell quickly how far two sets differ.
BIT_WORDS = 4
_BITS = [f"b{i}" for i in range(BIT_WORDS)]
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class NearDupParams:
    """Two sets are linked if ``100 * |A & B| >= percent * |A | B|``.

    At similarity 0.8 a pair shares no band of 8 rows among 64 with probability 8e-6, and differs in
    more than ``max_bits`` of 256 one-bit coordinates with probability 1e-9; at 0.25 pairs hardly
    ever share a band, so passages that many texts have in common don't make them candidates.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 64
    rows: int = 8
    max_bits: int = 56
    small_group: int = 64
    cell: int = 512
    lower: bool = True
    seed: int = 1


def shingle_hashes(block: W.Block, shingle: int, lower: bool, families: int = 1) -> tuple[list[np.ndarray], np.ndarray]:
    """Fingerprints of each shingle of a block's texts, of one or two families, and the text it is from."""
    if lower:
        block = W.Block(block.first, W.LOWER[block.data], block.offsets)
    w = W.words(block)
    at, of = W.gram_starts(w.bounds, shingle)
    count = np.diff(w.bounds)
    short = np.flatnonzero((count > 0) & (count < shingle))
    places = np.concatenate([at, w.bounds[short]])
    sizes = np.concatenate([np.full(len(at), shingle), count[short]]) if len(short) else shingle
    of = np.concatenate([of, short])
    order = np.argsort(of, kind="stable") if len(short) else slice(None)
    grams = (W.gram_hashes(W.span_hashes(block.data, w.start, w.end, k), places, sizes, k) for k in range(families))
    return [g[order] for g in grams], of[order]


def distinct_sets(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Places of the distinct (text, value) pairs, by text and value."""
    order = np.lexsort((values, of))
    values, of = values[order], of[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    return order[new]


def fast_similarity_sketch(values: np.ndarray, of: np.ndarray, n: int, t: int, seed: int) -> np.ndarray:
    """n rows of t coordinates; rows without elements stay at the largest value."""
    out = np.full(n * t, _FULL)
    salts = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, size=2 * t, dtype=np.uint64)
    for r in range(2 * t):
        if not len(values):
            break
        x = W.mix(values + salts[r])
        bin_ = ((x >> _U(32)) * _U(t) >> _U(32)).astype(np.int64) if r < t else np.full(len(x), r - t)
        key = of * t + bin_
        open_ = out[key] >> _U(54) >= _U(r)
        np.minimum.at(out, key[open_], (_U(r) << _U(54)) | (W.mix(x[open_]) >> _U(10)))
        if r < 8 or r % 16 == 0 or r >= t:
            unfilled = (out.reshape(n, t) == _FULL).any(axis=1)
            stay = unfilled[of]
            values, of = values[stay], of[stay]
    return out.reshape(n, t)


def _sketches(p: NearDupParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in W.blocks(batch.column(1)):
                grams, of = shingle_hashes(block, p.shingle, p.lower, 2)
                once = distinct_sets(grams[0], of)
                grams, of = [g[once] for g in grams], of[once]
                size = np.bincount(of, minlength=block.n)
                bounds = np.concatenate([[0], np.cumsum(size)])
                prints = []
                for g in grams:
                    total = np.zeros(len(g) + 1, np.uint64)
                    np.cumsum(W.mix(g), out=total[1:])
                    prints.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
                sketch = fast_similarity_sketch(grams[0], of, block.n, p.bands * p.rows, p.seed)
                flat = sketch.reshape(-1)
                band = W.gram_hashes(flat, np.arange(block.n * p.bands) * p.rows, p.rows) + np.tile(np.arange(p.bands, dtype=np.uint64), block.n)
                band = W.mix(band).view(np.int64)
                low = (W.mix(sketch[:, : 64 * BIT_WORDS].copy()) & _U(1)).astype(np.uint8)
                bits = np.packbits(low, axis=1).view(np.uint64).view(np.int64)
                has = size > 0
                kept = np.repeat(has, p.bands)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * p.bands)]).astype(np.int32)), pa.array(band[kept]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.n), batch.column(2).slice(block.first, block.n), pa.array(size.astype(np.int64)), pa.array(prints[0]), pa.array(prints[1]), lists, *(pa.array(bits[:, i].copy()) for i in range(BIT_WORDS))],
                    ["id", "tx", "n", "f1", "f2", "bands", *_BITS],
                )

    return run


def _alike(p: NearDupParams) -> Column:
    """Whether the sizes and one-bit coordinates of sets x and y allow the similarity."""
    differ = sum((F.bit_count(F.col(f"x.{b}").bitwiseXOR(F.col(f"y.{b}"))) for b in _BITS), F.lit(0))
    return (100 * F.least("x.n", "y.n") >= p.percent * F.greatest("x.n", "y.n")) & (differ <= p.max_bits)


def _shingles(p: NearDupParams):
    """Rows (uid, text) to (uid, n, g): a row for each distinct shingle of each set of n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in W.blocks(batch.column(1)):
                (g,), of = shingle_hashes(block, p.shingle, p.lower)
                once = distinct_sets(g, of)
                g, of = g[once], of[once]
                n = np.bincount(of, minlength=block.n)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(block.first + of)), pa.array(n[of]), pa.array(g.view(np.int64))], ["uid", "n", "g"])

    return run


def word_set(text: str | None, p: NearDupParams) -> set[tuple[bytes, ...]]:
    """The shingles themselves; words of bytes are cut at the same separators as everywhere here."""
    raw = (text or "").encode("utf-8")
    w = (raw.lower() if p.lower else raw).split()
    return set(zip(*(w[k:] for k in range(p.shingle)))) if len(w) >= p.shingle else {tuple(w)} if w else set()


def _linked(x: set, y: set, percent: int) -> bool:
    both = len(x & y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(p: NearDupParams):
    """Rows (a, b, text_a, text_b) to the linked (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, set()
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                b = batch.column(1)[i].as_py()
                if b != last:
                    last, known = b, word_set(batch.column(3)[i].as_py(), p)
                keep.append(_linked(word_set(batch.column(2)[i].as_py(), p), known, p.percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


class _Cell:
    """The sets that one cell's outliers are: compared with each member of the group that follows."""

    def __init__(self, p: NearDupParams):
        self.p, self.ids, self.n, self.bits, self.sets = p, [], [], [], []
        self.root: dict[int, int] = {}
        self.fixed = None

    def find(self, c: int) -> int:
        while self.root.get(c, c) != c:
            c = self.root[c]
        return c

    def add(self, id_: int, comp: int, n: int, bits: list[int], text: str) -> None:
        self.ids.append((id_, comp))
        self.n.append(n)
        self.bits.append(bits)
        self.sets.append(word_set(text, self.p))

    def meet(self, id_: int, comp: int, n: int, bits: list[int], text: str) -> Iterator[tuple[int, int]]:
        if self.fixed is None:
            self.fixed = np.array(self.n), np.array(self.bits, np.int64).reshape(-1, BIT_WORDS).view(np.uint64)
        sizes, words = self.fixed
        far = np.bitwise_count(words ^ np.array(bits, np.int64).view(np.uint64)).sum(axis=1)
        near = np.flatnonzero((far <= self.p.max_bits) & (100 * np.minimum(sizes, n) >= self.p.percent * np.maximum(sizes, n)))
        own = None
        for i in near.tolist():
            other, c = self.ids[i]
            one, two = self.find(comp), self.find(c)
            if one == two:
                continue
            if own is None:
                own = word_set(text, self.p)
            if _linked(own, self.sets[i], self.p.percent):
                self.root[max(one, two)] = min(one, two)
                yield min(id_, other), max(id_, other)


def _meet(p: NearDupParams):
    """Rows (k, ob, mb, role, uid, comp, n, bits.., text), cell by cell with outliers first, to links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell = None, None
        for batch in batches:
            links = []
            for head, ob, mb, role, id_, comp, n, *bits, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (head, ob, mb) != key:
                    key, cell = (head, ob, mb), _Cell(p)
                if role == 0:
                    cell.add(id_, comp, n, bits, text)
                else:
                    links += cell.meet(id_, comp, n, bits, text)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    return run


class _Linker:
    """Links between classes, found bucket by bucket; ``comp`` has each linked class's component."""

    def __init__(self, p: NearDupParams, scratch: Scratch, sizes: DataFrame, texts: DataFrame):
        self.p, self.scratch, self.sizes, self.texts = p, scratch, sizes, texts
        self.links: DataFrame | None = None
        self.comp: DataFrame | None = None

    def confirm(self, pairs: DataFrame) -> None:
        """Adds those of the pairs (a, b) that are linked."""
        text = lambda x: self.texts.select(F.col("uid").alias(x), F.col("text").alias(f"t{x}"))
        wide = pairs.select("a", "b").join(text("b"), "b").join(text("a"), "a").select("a", "b", "ta", "tb")
        self.add(wide.mapInArrow(_confirm(self.p), "a long, b long"))

    def add(self, links: DataFrame) -> None:
        new = self.scratch.keep(links, "links")
        self.links = new if self.links is None else self.links.union(new)

    def settle(self) -> None:
        """Brings the components up to the links."""
        self.comp = self.scratch.keep(components(self.links, self.scratch).select(F.col("id").alias("uid"), F.col("component").alias("c")), "components")

    def placed(self, rows: DataFrame) -> DataFrame:
        """Adds ``c``, the class's component, itself if it is alone."""
        return rows.join(self.comp, "uid", "left").withColumn("c", F.coalesce("c", "uid"))

    def star(self, members: DataFrame) -> DataFrame:
        """Holds every class of the buckets (k, uid, size) against the head that it meets most often; gives (k, uid, head)."""
        mates = members.groupBy("uid").agg(F.sum("size").alias("mates"))
        ranked = members.select("k", "uid").join(mates, "uid")
        heads = ranked.groupBy("k").agg(F.max(F.struct("mates", (-F.col("uid")).alias("x"))).alias("m")).select("k", (-F.col("m.x")).alias("head"))
        buckets = self.scratch.keep(members.select("k", "uid").join(heads, "k"), "buckets")
        pairs = buckets.where("uid <> head").groupBy("head", "uid").agg(F.count("*").alias("shared"))
        pairs = pairs.alias("g").join(self.sizes.alias("x"), F.col("g.uid") == F.col("x.uid")).join(self.sizes.alias("y"), (F.col("g.head") == F.col("y.uid")) & _alike(self.p)).select("g.*")
        self.confirm(pairs.groupBy("uid").agg(F.max(F.struct("shared", (-F.col("head")).alias("x"))).alias("m")).select(F.col("uid").alias("a"), (-F.col("m.x")).alias("b")))
        return buckets

    def mixed(self, rows: DataFrame, key: str) -> DataFrame:
        """Groups of (key, uid) with several components: (key, big, size, out), the largest one and how many are outside it."""
        parts = self.placed(rows).groupBy(key, "c").agg(F.count("*").alias("m"))
        both = parts.groupBy(key).agg(F.max(F.struct("m", (-F.col("c")).alias("x"))).alias("big"), F.sum("m").alias("size"), F.count("*").alias("kinds")).where("kinds > 1")
        return self.scratch.keep(both.select(key, (-F.col("big.x")).alias("big"), "size", (F.col("size") - F.col("big.m")).alias("out")), "mixed")

    def pairs(self, rows: DataFrame) -> None:
        """Compares the members (k, uid) of small buckets that lie in different components.

        With ``rank``, the shingle's place by rarity in each set, no more can be common than the lesser parts before and after it.
        """
        p = self.p
        named = self.placed(rows).join(self.sizes, "uid")
        apart = (F.col("x.k") == F.col("y.k")) & (F.col("x.uid") < F.col("y.uid")) & (F.col("x.c") != F.col("y.c"))
        if "rank" in rows.columns:
            most = F.least("x.rank", "y.rank") + F.least(F.col("x.n") - F.col("x.rank"), F.col("y.n") - F.col("y.rank"))
            apart = apart & ((100 + p.percent) * most >= p.percent * (F.col("x.n") + F.col("y.n")))
        self.confirm(named.alias("x").join(named.alias("y"), apart & _alike(p)).select(F.col("x.uid").alias("a"), F.col("y.uid").alias("b")).distinct())

    def cells(self, rows: DataFrame, mixed: DataFrame) -> None:
        """Compares classes outside a large bucket's main component with all its members, in cells of bounded size."""
        p = self.p
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, for cells are small but take long
        big = self.placed(rows.select("k", "uid")).join(mixed, "k")
        slots = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / p.cell)).cast("long")
        deal = lambda n, salt: F.pmod(F.xxhash64("uid", F.lit(salt)), slots(n))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), slots(n) - 1))
        outer = big.where("c <> big").withColumn("ob", deal("out", 1)).withColumn("mb", each("size")).withColumn("role", F.lit(0))
        inner = big.withColumn("mb", deal("size", 2)).withColumn("ob", each("out")).withColumn("role", F.lit(1))
        some = ["k", "ob", "mb", "role", "uid", "c"]
        both = outer.select(*some).union(inner.select(*some)).join(self.sizes, "uid").join(self.texts, "uid")
        both = both.select(*some, "n", *_BITS, "text").repartition(tasks, "k", "ob", "mb").sortWithinPartitions("k", "ob", "mb", "role", "uid")
        self.add(both.mapInArrow(_meet(p), "a long, b long"))

    def rare(self, uids: DataFrame) -> DataFrame:
        """Buckets (k, uid, rank, first, size) of the classes' rarest shingles; ``first`` where it is among those that the smaller set of a pair needs."""
        p = self.p
        grams = self.scratch.keep(self.texts.join(uids, "uid").select("uid", "text").mapInArrow(_shingles(p), "uid long, n long, g long"), "shingles")
        often = grams.groupBy("g").agg(F.count("*").alias("often")).where("often > 1")
        order = Window.partitionBy("uid").orderBy(F.coalesce("often", F.lit(1)), "g")
        ranked = grams.join(often, "g", "left").withColumn("rank", F.row_number().over(order))
        share = lambda top, under: F.col("n") - F.ceil(F.col("n") * top / under).cast("long") + 1
        first = (F.col("rank") <= share(2 * p.percent, 100 + p.percent)).alias("first")
        kept = ranked.where((F.col("rank") <= share(p.percent, 100)) & F.col("often").isNotNull()).select(F.col("g").alias("k"), "uid", "rank", first)
        kept = self.scratch.keep(kept, "rare")
        good = kept.groupBy("k").agg(F.count("*").alias("size"), F.max("first").alias("any")).where("any and size > 1").select("k", "size")
        return self.scratch.keep(kept.join(good, "k"), "rare")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: NearDupParams | None = None) -> DataFrame:
    """``(id_col, n_shingles, component_id, kept)`` per row of ``docs``.

    component_id is the smallest id reachable over links, the row's own included; kept is whether
    it is the row's own.  Null, empty and blank texts have an empty set and no links.  Rows whose
    id is null are linked with nothing and kept, with a null component.  Rows that repeat an id
    give a row each, each with the links of its own text.  Very long texts are taken whole.  Other
    columns are not read, so their names can't clash.

    Candidates: each band bucket has a head, the class with the most bucket mates; every class is first
    held against the head that it meets most often.  What this leaves in different components of a
    bucket is then compared: in small groups pair by pair, in large ones by the buckets of their rare shingles,
    small ones of these pair by pair; what is in large ones is compared once for its group, in cells of ``cell`` sets outside
    the main component by as many members.  So no pair that shares a bucket is lost, and none is written out for a group of copies that its head
    holds together.
    """
    p = params or NearDupParams()
    scratch = Scratch(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("tx", F.xxhash64("text"))
    schema = "id long, tx long, n long, f1 long, f2 long, bands array<long>" + "".join(f", {b} long" for b in _BITS)
    sk = scratch.keep(source.select("id", "text", "tx").mapInArrow(_sketches(p), schema), "sketches")

    classes = sk.where("n > 0 and id is not null").groupBy("f1", "f2").agg(F.min(F.struct("id", "tx")).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), *(F.first(b).alias(b) for b in _BITS))
    classes = scratch.keep(classes.withColumn("uid", F.monotonically_increasing_id()), "classes")
    rows = classes.select("uid", F.explode("bands").alias("k"))
    shared = rows.groupBy("k").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("k", "size")
    members = scratch.keep(rows.join(shared, "k"), "members")
    near = classes.join(members.select("uid").distinct(), "uid").select("uid", F.col("rep.id").alias("id"), F.col("rep.tx").alias("tx"))
    texts = scratch.keep(source.join(near, ["id", "tx"]).dropDuplicates(["uid"]).select("uid", "text"), "texts")

    link = _Linker(p, scratch, classes.select("uid", "n", *_BITS), texts)
    buckets = link.star(members)
    link.settle()
    groups = scratch.keep(buckets.select("head", "uid").distinct(), "groups")
    mixed = link.mixed(groups, "head")
    small = buckets.join(mixed.where(F.col("size") <= p.small_group).select("head"), "head", "left_semi")
    link.pairs(small.select("k", "uid"))
    large = mixed.where(F.col("size") > p.small_group).select("head")
    if large.limit(1).count():
        rare = link.rare(groups.join(large, "head", "left_semi").select("uid").distinct())
        open_ = link.mixed(rare, "k")
        link.pairs(rare.join(open_.where(F.col("size") <= p.small_group).select("k"), "k", "left_semi").select("k", "uid", "rank"))
        left = rare.join(open_.where(F.col("size") > p.small_group).select("k"), "k", "left_semi").select("uid").distinct()
        wide = scratch.keep(groups.join(large, "head", "left_semi").join(left, "uid", "left_semi").select(F.col("head").alias("k"), "uid"), "open")
        link.settle()
        link.cells(wide, link.mixed(wide, "k"))
    link.settle()

    found = link.placed(classes.select("f1", "f2", "uid", F.col("rep.id").alias("rep")))
    least = found.groupBy("c").agg(F.min("rep").alias("component"), F.count("*").alias("m")).where("m > 1").select("c", "component")
    found = scratch.keep(found.join(least, "c", "left").select("f1", "f2", F.coalesce("component", "rep").alias("component")), "found")
    scratch.drop(*(t for t, _ in scratch.kept if t is not sk and t is not found))
    out = sk.select("id", "n", "f1", "f2").join(found, ["f1", "f2"], "left")
    component = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("component")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )
