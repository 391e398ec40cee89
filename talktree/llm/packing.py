"""Best-fit packing of token pieces by a distributed grouping genetic algorithm.

Documents are cut into pieces of at most ``capacity`` tokens.  Pieces that fill a sequence alone get
one; the others are dealt to shards of about ``shard_items``.  Each shard is worked on by a few
islands, populations of groupings of its pieces into bins.  A child takes one parent's bins, gets
well-filled bins of the other injected whole, loses its own bins that hold a piece twice, and has
the displaced pieces put back, in place of shorter ones where that fills a bin better and else by best fit.  After an epoch each island's elite migrates to the next
island of the shard.  Full bins of the best grouping are final; pieces of the rest are dealt anew to
fewer shards, level by level, until one shard is left or it no longer pays.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import words as W
from .shared import Scratch, bounded_batches, distinct_name
from .token_ids import default_vocabulary, token_table


#: Most tasks that the islands of one level are dealt to.
MAX_TASKS = 100_000


@dataclass(frozen=True)
class PackingParams:
    """``full``: a bin with at least this share of its capacity in use is final.

    ``added_tokens``: the content of an added token in a text has the token's id, as in ``tokenizers``.
    """

    capacity: int = 1024
    end_id: int = 2
    vocabulary: str | None = None
    added_tokens: bool = False
    shard_items: int = 16_384
    islands: int = 2
    population: int = 3
    generations: int = 4
    epochs: int = 2
    full: float = 0.9985
    max_levels: int = 4
    seed: int = 7


def _pieces(p: PackingParams, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(path, p.end_id, p.added_tokens)
        for batch in batches:
            for block in W.blocks(batch.column(1), W.BLOCK_BYTES // 2):
                ids, bounds = table.encode(block)
                size = np.diff(bounds)
                count = -(-size // p.capacity)
                of = np.repeat(np.arange(block.n), count)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                head = size - (count - 1) * p.capacity
                start = np.where(piece == 0, 0, head[of] + (piece - 1) * p.capacity)
                length = np.where(piece == 0, head[of], p.capacity)
                raw = memoryview(ids.astype("<u4").tobytes())
                at = (bounds[:-1][of] + start) * 4
                crc = [zlib.crc32(raw[x:y]) for x, y in zip(at.tolist(), (at + length * 4).tolist())]
                doc = batch.column(0).take(pa.array(block.first + of))
                yield pa.RecordBatch.from_arrays(
                    [doc, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return run


def token_pieces(docs: DataFrame, params: PackingParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: every document's ids, the end id after them, cut into pieces."""
    p = params or PackingParams()
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pieces(p, p.vocabulary or default_vocabulary()), "doc_id long, piece int, start long, length long, ids_crc32 long")


class Grouping:
    """Bins of items; the free space of a bin indexes it for best fit."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []

    def place(self, items: list[int]) -> None:
        """Best fit, in the order given: each item goes where it leaves the least space."""
        by_free: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        mask = 0
        for b, room in enumerate(self.free):
            by_free[room].append(b)
            mask |= 1 << room
        lengths, bins, free, capacity = self.lengths, self.bins, self.free, self.capacity
        for i in items:
            size = lengths[i]
            fits = mask >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                b = by_free[room].pop()
                if not by_free[room]:
                    mask ^= 1 << room
                bins[b].append(i)
                room -= size
                free[b] = room
            else:
                b, room = len(bins), capacity - size
                bins.append([i])
                free.append(room)
            by_free[room].append(b)
            mask |= 1 << room

    def exchange(self, loose: list[int]) -> list[int]:
        """Puts loose items in place of shorter ones, or of two, where that leaves a bin fuller; returns what is loose then."""
        lengths = self.lengths
        rest = sorted((lengths[i], i) for i in loose)
        for b, items in enumerate(self.bins):
            while self.free[b] and rest:
                sizes = {lengths[i]: i for i in items}  # one of each length will do
                some, best = sorted(sizes), (0, [], -1)
                for n, x in enumerate(some):
                    for out in ([x], *([x, y] for y in some[n + 1 :])):
                        k = bisect_left(rest, (sum(out) + self.free[b] + 1, -1)) - 1
                        if k >= 0 and rest[k][0] - sum(out) > best[0]:
                            best = (rest[k][0] - sum(out), out, k)
                gain, out, k = best
                if not gain:
                    break
                given = rest.pop(k)[1]
                for x in out:
                    insort(rest, (x, sizes[x]))
                    items.remove(sizes[x])
                items.append(given)
                self.free[b] -= gain
        return [i for _, i in rest]

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones."""
        c = self.capacity
        return (-len(self.bins), sum((c - f) * (c - f) for f in self.free))

    def solution(self) -> list[int]:
        out = [0] * len(self.lengths)
        for b, items in enumerate(self.bins):
            for i in items:
                out[i] = b
        return out

    @classmethod
    def of(cls, solution: list[int], lengths: list[int], capacity: int) -> "Grouping":
        g = cls(lengths, capacity)
        g.bins = [[] for _ in range(max(solution, default=-1) + 1)]
        for i, b in enumerate(solution):
            g.bins[b].append(i)
        g.free = [capacity - sum(lengths[i] for i in b) for b in g.bins]
        return g

    def _without(self, gone: set[int]) -> tuple["Grouping", list[int]]:
        child = Grouping(self.lengths, self.capacity)
        loose: list[int] = []
        for b, (items, free) in enumerate(zip(self.bins, self.free)):
            if b in gone:
                loose += items
            else:
                child.bins.append(items[:])
                child.free.append(free)
        return child, loose


def cross(one: Grouping, two: Grouping, rng: random.Random) -> Grouping:
    """``one`` with some well-filled bins of ``two`` injected whole."""
    order = sorted(range(len(two.bins)), key=lambda b: (two.free[b], b))
    good = order[: max(1, len(order) // 2)]
    given = rng.sample(good, max(1, len(good) // 4))
    taken = {i for b in given for i in two.bins[b]}
    clash = {b for b, items in enumerate(one.bins) if not taken.isdisjoint(items)}
    child, loose = one._without(clash)
    for b in given:
        child.bins.append(two.bins[b][:])
        child.free.append(two.free[b])
    loose = child.exchange([i for i in loose if i not in taken])
    loose.sort(key=lambda i: -one.lengths[i])
    child.place(loose)
    return child


def mutate(g: Grouping, rng: random.Random) -> Grouping:
    """Empties the worst bins and some others, and puts their items back in mixed order."""
    order = sorted(range(len(g.bins)), key=lambda b: -g.free[b])
    few = max(1, len(order) // 50)
    gone = set(order[: 2 * few]) | set(rng.sample(order, min(few, len(order))))
    child, loose = g._without(gone)
    loose = child.exchange(loose)
    loose.sort(key=lambda i: -g.lengths[i] * rng.uniform(0.8, 1.2))
    child.place(loose)
    return child


def evolve(lengths: list[int], capacity: int, p: PackingParams, seed: int, given: list[list[int]]) -> list[int]:
    """The best grouping after an epoch that starts with the ``given`` ones; stops at the lower bound."""
    rng = random.Random(seed)
    least = -(-sum(lengths) // capacity)
    population = [Grouping.of(s, lengths, capacity) for s in given]
    if not population:
        first = Grouping(lengths, capacity)
        first.place(sorted(range(len(lengths)), key=lambda i: -lengths[i]))
        population = [first]
    while len(population) < p.population and len(population[0].bins) > least:
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i] * rng.uniform(0.9, 1.1))
        other = Grouping(lengths, capacity)
        other.place(order)
        population.append(other)
    population.sort(key=Grouping.fitness, reverse=True)
    for _ in range(p.generations):
        if len(population[0].bins) <= least:
            break
        children = [mutate(population[0], rng)]
        for k in range(1, len(population)):
            children.append(cross(population[0], population[k], rng))
        population = sorted(population + children, key=Grouping.fitness, reverse=True)[: p.population]
    return population[0].solution()


def _epoch(p: PackingParams, number: int):
    """Rows (shard, island, lengths, elites) to (shard, island, lengths, solution)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for shard, island, lengths, elites in zip(f["shard"], f["island"], f["lengths"], f["elites"]):
                lengths = [int(x) for x in lengths]
                given = [[int(b) for b in s] for s in elites] if elites is not None else []
                seed = zlib.crc32(f"{p.seed}/{shard}/{island}/{number}".encode())
                out.append(evolve(lengths, p.capacity, p, seed, given))
            yield pd.DataFrame({"shard": f["shard"], "island": f["island"], "lengths": f["lengths"], "solution": out, "bins": [max(s, default=-1) + 1 for s in out]})

    return run


def _solve(ranked: DataFrame, p: PackingParams, scratch: Scratch, count: int, islands: int, epochs: int) -> DataFrame:
    """(shard, rank, length) of ``count`` shards to (shard, rank, bin) by islands with elite migration."""
    schema = "shard long, island int, lengths array<int>, solution array<int>, bins int"
    lists = ranked.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("length").cast("int").alias("length")))).alias("x"))
    shards = lists.select("shard", F.col("x.length").alias("lengths"))
    tasks = min(count * islands, MAX_TASKS)
    state = shards.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("elites", F.lit(None).cast("array<array<int>>"))
    for number in range(epochs):
        # A number, for the rows are few and small but take long: they are not to be put together.
        state = state.repartition(tasks, "shard", "island").select("shard", "island", "lengths", "elites")
        done = scratch.keep(state.mapInPandas(_epoch(p, number), schema), "epoch")
        if number + 1 < epochs:
            own = done.select("shard", "island", "lengths", "solution")
            sent = done.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.lit(None).cast("array<int>").alias("lengths"), "solution")
            state = own.union(sent).groupBy("shard", "island").agg(F.first("lengths", ignorenulls=True).alias("lengths"), F.collect_list("solution").alias("elites"))
    best = done.groupBy("shard").agg(F.min(F.struct("bins", "island")).alias("m")).select("shard", F.col("m.island").alias("island"))
    return done.join(best, ["shard", "island"]).select("shard", F.posexplode("solution").alias("rank", "bin"))


def pack(pieces: DataFrame, params: PackingParams | None = None) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the rows of ``pieces``, which has a ``length`` of 1 to the capacity.

    Every row is an item of its own, equal rows too; other columns are carried along, except that
    columns of the two new names are replaced.  No pieces give no rows.  Sequence numbers are any
    distinct numbers; offsets are gapless from 0.
    """
    p = params or PackingParams()
    scratch = Scratch(pieces.sparkSession)
    pieces = pieces.drop(*(c for c in pieces.columns if c.lower() in ("sequence_id", "offset")))
    columns = pieces.columns
    name = distinct_name(columns, "_key")
    pieces = scratch.keep(pieces.withColumn(name, F.monotonically_increasing_id()), "pieces")
    key = F.col(name).alias("_key")
    alone = pieces.where(F.col("length") >= p.capacity).select(key, (-1 - F.col(name)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    loose = pieces.where(F.col("length") < p.capacity).select(key, "length")
    placed, count = [alone], loose.count()
    for level in range(p.max_levels):
        if not count:
            break
        shards = max(1, -(-count // p.shard_items))
        last = shards == 1 or level == p.max_levels - 1
        dealt = loose.withColumn("shard", F.pmod(F.xxhash64("_key", F.lit(level)), F.lit(shards)))
        ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("length"), "_key")) - 1)
        ranked = scratch.keep(ranked, "ranked")
        solved = _solve(ranked, p, scratch, shards, p.islands, p.epochs)
        inside = Window.partitionBy("shard", "bin")
        got = ranked.join(solved, ["shard", "rank"]).withColumn("fill", F.sum("length").over(inside))
        got = got.withColumn("offset", F.sum("length").over(inside.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)))
        number = ((F.lit(level).cast("long") * F.lit(1 << 58)) + F.col("shard") * F.lit(1 << 20) + F.col("bin")).alias("sequence_id")
        got = scratch.keep(got.select("_key", "length", "fill", number, F.coalesce("offset", F.lit(0)).cast("long").alias("offset")), "level")
        stays = F.lit(True) if last else F.col("fill") >= F.lit(int(p.capacity * p.full))
        placed.append(got.where(stays).select("_key", "sequence_id", "offset"))
        scratch.drop(ranked)
        if last:
            break
        loose = got.where(~stays).select("_key", "length")
        count = loose.count()
    where = placed[0]
    for more in placed[1:]:
        where = where.union(more)
    return pieces.join(where.withColumnRenamed("_key", name), name).select(*columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, params: PackingParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, a row for each piece.

    A null text is packed as an empty one: its only token is the end id.  Null and repeated ids give
    pieces of their own.  Very long texts are cut into pieces; other columns are not read.
    """
    p = params or PackingParams()
    return pack(token_pieces(docs, p, id_col, text_col), p)
