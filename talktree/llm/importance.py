"""Target-distribution importance resampling over a table of word positions.

Texts are exploded into one row for each word with its position; windows over a document's positions
put the following words beside each word, so a row makes the n-grams that start there.  An n-gram's
bucket is the CRC-32 of its UTF-8 bytes modulo a fixed number.  Counts of the buckets in the corpus and
in target texts give each bucket a gain, a log ratio in thousandths; a document's weight is the sum of
the gains of its n-grams.  Weights with Gumbel noise that depends on the id alone make a weighted
sample without replacement: the highest scores are drawn.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII without letters and digits.
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class ImportanceParams:
    """``orders``: n-grams of 1 to so many words.  ``percent`` of the documents with ``min_words`` or more are drawn."""

    orders: int = 3
    buckets: int = 10_000
    percent: int = 5
    min_words: int = 20
    seed: int = 42


def _lower(word: Column) -> Column:
    """A-Z in lower case and nothing else; ``lower`` does just that to words of ASCII, and fast."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def word_positions(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys``, pos and word of every word; a text without words keeps one row or two whose word is null.

    Rows are dealt out by the keys before they are exploded, so windows over a key need no further shuffle.
    The keys must tell rows apart.
    """
    words = F.split(F.coalesce(text, F.lit("")), _SEPARATORS)
    dealt = texts.select(*keys, text).repartition(*keys).sortWithinPartitions(*keys)
    out = dealt.select(*keys, F.posexplode(words).alias("pos", "raw"))
    return out.select(*keys, "pos", _lower(F.nullif("raw", F.lit(""))).alias("word"))


def ngram_buckets(positions: DataFrame, keys: list[str], params: ImportanceParams) -> DataFrame:
    """``keys``, word and b1, b2...: the buckets of the n-grams that start at each position, null where the text ends."""
    after = Window.partitionBy(*keys).orderBy("pos")
    ahead = positions.select(*keys, "word", *(F.lead("word", k).over(after).alias(f"w{k}") for k in range(1, params.orders)))
    words = [F.col("word"), *(F.col(f"w{k}") for k in range(1, params.orders))]

    def bucket(n: int) -> Column:
        parts = [x for w in words[:n] for x in (F.lit(" "), w)][1:]
        return (F.crc32(F.concat(*parts).cast("binary")) % params.buckets).cast("int")

    return ahead.select(*keys, "word", *(bucket(n).alias(f"b{n}") for n in range(1, params.orders + 1)))


def bucket_counts(grams: DataFrame, params: ImportanceParams) -> DataFrame:
    """bucket and n, the n-grams in it; at most ``params.buckets`` rows."""
    each = grams.select(F.explode(F.array(*(f"b{n}" for n in range(1, params.orders + 1)))).alias("bucket"))
    return each.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, params: ImportanceParams) -> DataFrame:
    """bucket and gain from two tables of ``bucket_counts``, for every bucket of the corpus."""
    s = corpus.select("bucket", F.col("n").alias("s"))
    t = target.select("bucket", F.col("n").alias("t"))
    every = Window.partitionBy(F.lit(0))  # rows are buckets, so there are few
    both = s.join(t, "bucket", "full_outer").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    both = both.select("bucket", "s", "t", F.sum("s").over(every).alias("all_s"), F.sum("t").over(every).alias("all_t"))
    up = (F.col("t") + 1).cast("double") * (F.col("all_s") + params.buckets).cast("double")
    down = (F.col("s") + 1).cast("double") * (F.col("all_t") + params.buckets).cast("double")
    return both.select("bucket", F.floor(1000 * F.ln(up / down)).cast("long").alias("gain"))


def gumbel_noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a standard Gumbel value, from a hash of seed and id; null for a null id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def importance_weights(docs: DataFrame, target: DataFrame, params: ImportanceParams = ImportanceParams(), scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of ``docs`` against the texts of ``target``.

    Each row is a document of its own, whether or not ids repeat or are null.  Rows with a null or empty
    text, or one of separators alone, have no words, no features and weight 0.  Columns other than doc_id
    and text are not looked at.  With an empty ``target`` weights still follow the corpus.
    """
    keys = ["doc_id", "row"]
    own = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    grams = ngram_buckets(word_positions(own, keys), keys, params)
    goal = target.select("text").withColumn("row", F.monotonically_increasing_id())
    wanted = ngram_buckets(word_positions(goal, ["row"]), ["row"], params)
    gains = bucket_gains(bucket_counts(grams, params), bucket_counts(wanted, params), params)
    gains = (scratch or Scratch(docs.sparkSession)).keep(gains, "gains")
    orders = range(1, params.orders + 1)
    for n in orders:  # at most params.buckets rows are broadcast
        grams = grams.join(F.broadcast(gains.select(F.col("bucket").alias(f"b{n}"), F.col("gain").alias(f"g{n}"))), f"b{n}", "left")
    worth = sum((F.coalesce(f"g{n}", F.lit(0)) for n in orders), F.lit(0))
    found = sum((F.col(f"b{n}").isNotNull().cast("long") for n in orders), F.lit(0))
    out = grams.groupBy(*keys).agg(F.count("word").alias("n_words"), F.sum(found).alias("n_features"), F.sum(worth).alias("weight"))
    return out.select("doc_id", "n_words", "n_features", F.col("weight").cast("long"))


def ranked(scores: DataFrame, order: list[Column], scratch: Scratch) -> DataFrame:
    """``scores`` with place, 1 for the first row in ``order``, without one task that sees all rows.

    Rows are sorted by ranges; a row's place is its place in the range and the sizes of the ranges before.
    """
    at = F.monotonically_increasing_id()
    rows = scratch.keep(scores.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at), "ranges")
    part = F.shiftright("at", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return rows.withColumn("part", part).join(F.broadcast(before), "part").withColumn("place", place).drop("part", "before", "at")


def importance_sample(docs: DataFrame, target: DataFrame, params: ImportanceParams = ImportanceParams()) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``; rank is null for those not drawn.

    Drawn are the highest scores among documents of ``min_words`` words or more, ties to the smaller id and
    then to more features.  A null id has no noise, so no score, and is never drawn nor counted.
    """
    scratch = Scratch(docs.sparkSession)
    score = F.col("weight") + gumbel_noise(F.col("doc_id"), params.seed)
    able = (F.col("n_words") >= params.min_words) & F.col("doc_id").isNotNull()
    scored = scratch.keep(importance_weights(docs, target, params, scratch).withColumns({"score": score, "able": able}), "scores")
    count = scored.where("able").count() * params.percent // 100
    order = [F.desc("able"), F.desc("score"), F.asc("doc_id"), F.desc("n_features")]
    placed = ranked(scored, order, scratch)
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= count, F.col("place")).cast("long").alias("rank"))
