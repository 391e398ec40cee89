"""The engine's scalar functions under SQL names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talktree.functions.text import find, normalize, recover
from talktree.functions.values import canonical_id

#: SQL names, in the order of their definition below.
NAMES = ("search_norm", "search_match", "display_text", "id_is_safe")


@F.pandas_udf(T.StringType())
def _norm(x: pd.Series) -> pd.Series:
    return x.map(lambda t: normalize(t if isinstance(t, str) else None))


@F.pandas_udf(T.BooleanType())
def _match(x: pd.Series, fragment: pd.Series, mode: pd.Series) -> pd.Series:
    one = lambda t, f, m: not normalize(f) or find(normalize(t), normalize(f), m or "contains") >= 0
    return pd.Series([one(t, f, m) for t, f, m in zip(x, fragment, mode)])


@F.pandas_udf(T.StringType())
def _display(x: pd.Series, raw: pd.Series) -> pd.Series:
    return pd.Series([recover(t, r) for t, r in zip(x, raw)])


@F.pandas_udf(T.BooleanType())
def _safe(x: pd.Series) -> pd.Series:
    return x.map(lambda t: t is None or canonical_id(t) is not None)


def register(spark: SparkSession) -> tuple[str, ...]:
    """Makes the functions known to SQL: norm(text), match(text, fragment, mode), display(text, raw), safe(id)."""
    for name, function in zip(NAMES, (_norm, _match, _display, _safe)):
        spark.udf.register(name, function)
    return NAMES
