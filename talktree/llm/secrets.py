"""Secret scans with DataFrame functions only: fixed patterns and character Markov models.

Three patterns give the base spans.  Longer runs of key-like characters are then judged by two
first-order Markov models over characters, one of random strings and one of ordinary identifiers:
a run, or a part of it, is a secret if its mean log-likelihood ratio per step reaches a threshold.  Both models are
trained from labelled samples; steps are counted with add-one smoothing.  The result of training is
one table of at most ``SIZE * SIZE`` numbers, which is a constant of the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds in the order that breaks ties, and their patterns; fixed values.
PATTERNS = {
    "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
#: Cheaper patterns that a text with a valid match of the kind has; greedy runs of these kinds can't be found otherwise.
_LIKELY = {"assign": PATTERNS["assign"], "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}
_FOUND = {"assign": PATTERNS["assign"], "access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
KINDS = [*PATTERNS, "markov"]
#: Characters of a candidate run, by their code.
_RUN = "[A-Za-z0-9+/_=-]"
#: A part of a run between separators.
_PART = "[A-Za-z0-9+]+"
_FIRST, SIZE = 43, 80

_SPANS = "array<struct<start:int,kind:int,end:int,from:int,to:int>>"
#: Doublings; a text has room for fewer matches than two to this power.
_LEVELS = 28


@dataclass(frozen=True)
class SecretParams:
    """``sample_rows`` bounds the labelled texts and ``random_rows`` the random strings that models are trained on."""

    min_run: int = 20
    threshold: float = 0.35
    sample_rows: int = 2000
    random_rows: int = 4000
    smoothing: float = 1.0


def _bind(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, join) -> Column:
    """Each value joined with all before it, by doubling: an array is copied once a level, not once a value."""

    def level(x: Column, step: Column) -> Column:
        far = F.zip_with(F.slice(x, 1, F.size(x) - step), F.slice(x, step + 1, F.size(x)), join)
        return F.when(F.size(x) > step, F.concat(F.slice(x, F.lit(1), step), far)).otherwise(x)

    return F.aggregate(F.array(*(F.lit(1 << k) for k in range(_LEVELS))), values, level)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs (start, end, from, to, part): code points, bytes, the group's text.

    What lies between matches and the matches themselves have the same order, so ends are running
    sums of their lengths.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    pairs = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("hit"), part.alias("part"))

    def placed(pairs: Column) -> Column:
        sizes = F.transform(pairs, lambda x: F.struct((F.length(x["gap"]) + F.length(x["hit"])).alias("p"), (F.octet_length(x["gap"]) + F.octet_length(x["hit"])).alias("b")))
        ends = running(sizes, lambda x, y: F.struct((x["p"] + y["p"]).alias("p"), (x["b"] + y["b"]).alias("b")))
        return F.zip_with(
            pairs,
            ends,
            lambda x, e: F.struct((e["p"] - F.length(x["hit"])).alias("start"), e["p"].alias("end"), (e["b"] - F.octet_length(x["hit"])).alias("from"), e["b"].alias("to"), x["part"].alias("part")),
        )

    return _bind(pairs, placed)


def _span(m: Column, kind: int) -> Column:
    return F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["from"].alias("from"), m["to"].alias("to"))


def _spans_of(text: Column, kind: str) -> Column:
    found = matches(text, _FOUND[kind], 2 if kind == "assign" else 0)
    if kind == "assign":
        found = F.filter(found, lambda m: F.length(m["part"]) >= 8)
    spans = F.transform(found, lambda m: _span(m, KINDS.index(kind)))
    return F.when(text.rlike(_LIKELY[kind]), spans).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def base_spans(text: Column) -> Column:
    """All spans of the three patterns, by start and then kind."""
    return F.array_sort(F.concat(*(_spans_of(text, k) for k in PATTERNS)))


def _around(spans: Column, size: Column) -> Column:
    """Byte ranges (from, to, next) before each sorted span and after the last, ``next`` where the following one starts; a span that touches those before has none of its own."""

    def ranges(spans: Column) -> Column:
        ends = running(F.transform(spans, lambda x: x["to"]), lambda x, y: F.greatest(x, y))
        starts = F.concat(F.transform(spans, lambda x: x["from"]), F.array(size))
        return _bind(ends, lambda e: F.zip_with(F.arrays_zip(F.concat(F.array(F.lit(0)), e).alias("a"), starts.alias("b")), F.concat(e, F.array(size)), lambda x, y: F.struct(x["a"].alias("from"), x["b"].alias("to"), y.alias("next"))))

    return _bind(spans, ranges)


def _piece(raw: Column, r: Column) -> Column:
    """The text of a byte range, empty if it ends before it starts."""
    return F.substring(raw, r["from"] + 1, F.greatest(r["to"] - r["from"], F.lit(0))).cast("string")


def _blanked(text: Column, spans: Column) -> Column:
    """The text with spaces in the place of sorted spans, which are ASCII."""
    whole = lambda raw: F.array_join(F.transform(_around(spans, F.octet_length(raw)), lambda r: F.concat(_piece(raw, r), F.repeat(F.lit(" "), r["next"] - F.greatest(r["from"], r["to"])))), "")
    return F.when(F.size(spans) > 0, _bind(text.cast("binary"), whole)).otherwise(text)


def named(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _steps(tokens: DataFrame) -> DataFrame:
    """Counts of adjacent character codes over the ``token`` column."""
    pairs = tokens.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring(F.col("token"), i, F.lit(2)))).alias("s"))
    return pairs.groupBy((F.ascii("s") - _FIRST).alias("x"), (F.ascii(F.substring("s", 2, 1)) - _FIRST).alias("y")).agg(F.count("*").alias("n"))


def random_strings(spark: SparkSession, rows: int) -> DataFrame:
    """Labelled samples of random strings: digests written in base 64, hexadecimal and upper-case base 36."""
    seed = F.sha2(F.concat(F.lit("random/"), F.col("id").cast("string")), 256)
    forms = F.array(F.regexp_replace(F.base64(F.unhex(seed)), "=", ""), F.substring(seed, 1, 40), F.upper(F.conv(F.substring(seed, 1, 15), 16, 36)), F.translate(F.base64(F.unhex(seed)), "+/=", "-_"))
    return spark.range(rows).select(F.explode(forms).alias("token")).where("length(token) > 1")


def _good_texts(docs: DataFrame, labels: DataFrame, params: SecretParams, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Texts of at most ``sample_rows`` documents whose label is 1."""
    good = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    good = good.orderBy(F.xxhash64("id"), "id").limit(params.sample_rows)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(good), "id")


def identifiers(docs: DataFrame, labels: DataFrame, params: SecretParams, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Samples of ordinary identifiers: key-like runs, outside base spans, of texts labelled good.

    The label tells prose from junk and not secrets, so what the fixed patterns find is taken out first.
    """
    text = F.col("text")
    for pattern in PATTERNS.values():
        if pattern != PATTERNS["hex"]:
            text = F.regexp_replace(text, pattern, " ")
    text = F.regexp_replace(text, "[0-9a-f]{32,}", " ")
    rows = _good_texts(docs, labels, params, id_col, text_col, label_col)
    return rows.select(F.explode(F.regexp_extract_all(text, F.lit(f"{_RUN}{{2,}}"), F.lit(0))).alias("token")).where("token rlike '[A-Za-z]'")


def labelled_secrets(docs: DataFrame, labels: DataFrame, params: SecretParams, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Samples of secrets, which the fixed patterns label: values of 16 or more characters with a digit."""
    values = (F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(2 if k == "assign" else 0)) for k in PATTERNS)
    rows = _good_texts(docs, labels, params, id_col, text_col, label_col)
    return rows.select(F.explode(F.concat(*values)).alias("token")).where("length(token) >= 16 and token rlike '[0-9]' and token rlike '[A-Za-z]'")


def train_ratio(random: DataFrame, ordinary: DataFrame, smoothing: float = 1.0) -> list[float]:
    """log P(y | x, random) - log P(y | x, ordinary) for codes x and y, row by row; both samples may be empty."""
    import math

    tables = []
    for tokens in (random, ordinary):
        counts = [[smoothing] * SIZE for _ in range(SIZE)]
        for r in _steps(tokens).collect():  # SIZE * SIZE rows at most
            if 0 <= r.x < SIZE and 0 <= r.y < SIZE:
                counts[r.x][r.y] += r.n
        tables.append([[math.log(c / sum(row)) for c in row] for row in counts])
    return [round(tables[0][x][y] - tables[1][x][y], 4) for x in range(SIZE) for y in range(SIZE)]


def _table(ratio: list[float]) -> Column:
    return F.split(F.lit(" ".join(map(str, ratio))), " ").cast("array<double>")


def _steps_sum(raw: Column, first: Column, last: Column, ratio: list[float]) -> Column:
    """Sum of the ratios of the steps to the characters first + 1 to last, counted from 1, of ASCII bytes."""
    code = lambda i: F.ascii(F.substring(raw, i, F.lit(1)).cast("string")) - _FIRST
    total = F.aggregate(F.sequence(first, last - 1), F.lit(0.0), lambda acc, i: acc + F.element_at(_table(ratio), code(i) * SIZE + code(i + 1) + 1))
    return F.when(last > first, total).otherwise(F.lit(0.0))


def log_ratio(token: Column, ratio: list[float]) -> Column:
    """Mean log-likelihood ratio of a run's steps."""
    return _bind(token.cast("binary"), lambda raw: _steps_sum(raw, F.lit(1), F.octet_length(raw), ratio) / F.greatest(F.octet_length(raw) - 1, F.lit(1)))


def _joins(rest: Column, ratio: list[float], params: SecretParams) -> Column:
    """Joined neighbouring parts between separators, of min_run or more characters, that reach the threshold, as structs (start, end, from, to).

    Over all parts the sum of what each step has over the threshold is kept; a part is joined with the
    ones from the lowest place of this sum on, and of those with the same first part the longest counts.
    """

    def scored(raw: Column, parts: Column) -> Column:
        over = lambda a, z: _steps_sum(raw, a, z, ratio) - params.threshold * F.greatest(z - a, F.lit(0))

        def own(x: Column, i: Column) -> Column:
            link = F.when(i > 0, over(F.get(parts, i - 1)["end"], x["start"] + 1)).otherwise(F.lit(0.0))
            return F.struct(x["start"].alias("start"), x["end"].alias("end"), over(x["start"] + 1, x["end"]).alias("own"), link.alias("link"))

        return F.transform(parts, own)

    def joined(parts: Column) -> Column:
        def placed(total: Column) -> Column:
            lows = running(F.zip_with(F.transform(parts, lambda x, i: F.struct(x["own"].alias("own"), i.alias("i"))), total, lambda x, t: F.struct((t - x["own"]).alias("low"), x["i"].alias("i"))), lambda x, y: F.least(x, y))
            pick = lambda x, y: F.struct(y["i"].alias("first"), F.get(parts, y["i"])["start"].alias("start"), x["end"].alias("end"), (x["t"] - y["low"]).alias("value"))
            return F.zip_with(F.zip_with(parts, total, lambda x, t: F.struct(x["end"].alias("end"), t.alias("t"))), lows, pick)

        return _bind(running(F.transform(parts, lambda x: x["link"] + x["own"]), lambda x, y: x + y), placed)

    def last(good: Column) -> Column:
        return F.filter(good, lambda x, i: F.coalesce(F.get(good, i + 1)["first"] != x["first"], F.lit(True)))

    parts = _bind(matches(rest["part"], _PART), lambda q: _bind(rest["part"].cast("binary"), lambda raw: scored(raw, q)))
    good = F.filter(_bind(parts, joined), lambda x: (x["value"] >= 0) & (x["end"] - x["start"] >= params.min_run))
    move = lambda x: F.struct((rest["start"] + x["start"]).alias("start"), (rest["start"] + x["end"]).alias("end"), (rest["from"] + x["start"]).alias("from"), (rest["from"] + x["end"]).alias("to"))
    return F.transform(_bind(good, last), move)


def markov_spans(text: Column, base: Column, ratio: list[float], params: SecretParams) -> Column:
    """Spans of key-like runs that the models take for random, outside base spans.

    What base spans leave of a run is judged as a whole, and if that is no secret by its parts, so that
    words before or after a secret don't hide it.
    """
    rests = matches(_blanked(text, base), f"{_RUN}{{{params.min_run},}}")
    whole = lambda r: F.array(F.struct(*(r[x].alias(x) for x in ("start", "end", "from", "to"))))
    found = F.flatten(F.transform(rests, lambda r: F.when(log_ratio(r["part"], ratio) >= params.threshold, whole(r)).otherwise(_joins(r, ratio, params))))
    spans = F.transform(found, lambda m: _span(m, KINDS.index("markov")))
    return F.when(text.rlike(f"{_RUN}{{{params.min_run}}}"), spans).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def with_secrets(docs: DataFrame, ratio: list[float], params: SecretParams | None = None, text_col: str = "text", out: tuple[str, str] = ("base_spans", "secret_spans")) -> DataFrame:
    """Adds two columns to ``docs``: the base spans and all spans, as structs (start, kind, end, from, to).

    Kinds are numbers into :data:`KINDS`; start and end are code points, from and to bytes, ends exclusive.  A null text
    counts as empty.  Rows are judged one by one, so ties and repeats need no rule; ``out`` names
    the columns, which replace any of those names.
    """
    p = params or SecretParams()
    text = F.coalesce(F.col(text_col), F.lit(""))
    base, every = out
    found = docs.withColumn(base, base_spans(text))
    return found.withColumn(every, F.array_sort(F.concat(F.col(base), markov_spans(text, F.col(base), ratio, p))))


def secret_counts(docs: DataFrame, ratio: list[float], params: SecretParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_assign, n_access, n_hex, base_sha256, spans, n_markov)`` per row of ``docs``."""
    rows = with_secrets(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), ratio, params, "_text", ("_base", "_all"))
    count = lambda kind: F.size(F.filter("_all", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return rows.select(F.col("_id").alias(id_col), count("assign"), count("access"), count("hex"), F.sha2(named(F.col("_base")), 256).alias("base_sha256"), named(F.col("_all")).alias("spans"), count("markov"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch of touching or overlapping spans replaced by ``mark``; null for a null text."""

    def pieces(raw: Column, around: Column) -> Column:
        marked = lambda r, i: (i < F.size(around) - 1) & ((i == 0) | (r["to"] > r["from"]))
        return F.array_join(F.transform(around, lambda r, i: F.concat(_piece(raw, r), F.when(marked(r, i), F.lit(mark)).otherwise(F.lit("")))), "")

    out = _bind(text.cast("binary"), lambda raw: _bind(_around(F.array_sort(spans), F.octet_length(raw)), lambda around: pieces(raw, around)))
    return F.when(text.isNotNull(), out)


def train_secrets(docs: DataFrame, labels: DataFrame, params: SecretParams | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[float]:
    """The models' log-ratio table: random strings and the secrets of labelled texts against the identifiers of labelled texts."""
    p = params or SecretParams()
    ordinary = identifiers(docs, labels, p, id_col, text_col, label_col)
    random = random_strings(docs.sparkSession, p.random_rows).union(labelled_secrets(docs, labels, p, id_col, text_col, label_col))
    return train_ratio(random, ordinary, p.smoothing)
