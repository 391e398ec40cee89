"""The test tables as an archive.

``conversations(conv_id, turn, role, text)`` is a list of turns: each turn's parent is the one before
and the last is current.  A fork, a title, times and a source are derived from the turns by rule, so
that every operator has something to do.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talktree.operators.archive import Archive

DAY = 86_400.0
TITLE_CHARS = 60


def work_folder(spark: SparkSession) -> str:
    """A new folder for a query's own archive, below the shared folder that the session names."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{(root or 'file://' + tempfile.mkdtemp(prefix='talktree-')).rstrip('/')}/archive-{uuid.uuid4().hex}"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def bound(spark: SparkSession, sf_dir: str) -> Archive:
    """conversation_id and node_id are zero-padded texts.

    Turns beyond 1 whose number is odd hang on turn 1 rather than the turn before if the
    conversation's number is divisible by 3, which makes branches.  Titles are the beginning of turn
    0, a conversation's time is its number in days, a turn's time adds its number in seconds, and
    the source is one of four files by number.
    """
    rows = turns(spark, sf_dir)
    cid = F.lpad(F.col("conv_id").cast("string"), 12, "0")
    node = lambda c: F.lpad(c.cast("string"), 6, "0")
    forked = (F.col("turn") > 1) & (F.col("turn") % 2 == 1) & (F.col("conv_id") % 3 == 0)
    parent = F.when(F.col("turn") == 0, None).when(forked, F.lit(1)).otherwise(F.col("turn") - 1)
    nodes = rows.select(
        cid.alias("conversation_id"), node(F.col("turn")).alias("node_id"), node(parent).alias("parent_node_id"), F.lit("[]").alias("children_json"),
        F.concat_ws("/", cid, F.col("turn").cast("string")).alias("message_id"), "role", F.lit(None).cast("string").alias("author_name"),
        (F.col("conv_id") * DAY + F.col("turn")).alias("create_time"), F.lit(None).cast("double").alias("update_time"), F.lit("text").alias("content_type"), F.col("text").alias("content_text"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), F.lit(None).cast("string").alias("metadata_json"), F.lit(0).alias("is_on_current_path"), F.lit(None).cast("string").alias("raw_message_json"),
    )
    conversations = rows.groupBy("conv_id").agg(F.max("turn").alias("last"), F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("first")).select(
        cid.alias("conversation_id"), F.substring("first", 1, TITLE_CHARS).alias("title"), (F.col("conv_id") * DAY).alias("create_time"), F.lit(None).cast("double").alias("update_time"),
        node(F.col("last")).alias("current_node"), F.concat(F.lit("conversations-"), (F.col("conv_id") % 4).cast("string"), F.lit(".json")).alias("source_file"), F.col("conv_id").alias("source_array_index"),
        F.sha2(F.coalesce("first", F.lit("")), 256).alias("aggregate_hash"),
    )
    return Archive(conversations, nodes)
