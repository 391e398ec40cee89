"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, component)`` for every end of ``edges`` (a, b: long); component is the smallest reachable id.

    Alternating star contraction: the large-star step hooks each larger neighbour to the smallest
    one, the small-star step hooks the smaller ones.  Rounds go on while the edges change; each is written to the shared folder.
    A step aggregates before it shuffles and then joins hubs against one row per vertex, which the
    engine can split, so a hub with many neighbours does not meet in one task.  Self-loops and
    repeated edges do no harm; no edges give no rows.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = scratch.keep(now, "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b")
        before, now = now, scratch.keep(small.distinct(), "edges")
        scratch.drop(before)
    heads = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(heads)
