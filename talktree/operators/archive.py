"""An archive: its tables, with what searches derive from them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talktree.functions.text import display_text, norm_in_jvm, normalized
from talktree.operators.graph import effective_paths, path_metadata


@dataclass
class Archive:
    """``conversations`` and ``nodes``; derived columns are stored ones where the tables have them.

    A stored derived value that is null is made for its row, unless the columns are ``complete``.
    Where ``nodes`` are only some of an archive's, ``whole`` is the archive that paths are taken from.
    """

    conversations: DataFrame
    nodes: DataFrame
    stored_paths: DataFrame | None = None
    whole: Archive | None = None
    complete: bool = False

    @cached_property
    def titled(self) -> DataFrame:
        """Conversations with ``title_norm`` and ``source_norm``."""
        c = self._derived(self.conversations, "title_norm", normalized(F.col("title")))
        return self._derived(c, "source_norm", normalized(F.col("source_file")))

    @cached_property
    def texts(self) -> DataFrame:
        """Nodes with ``text``, what a reader sees, and ``norm``, what a search sees."""
        own = {"content_text", "raw_message_json"} <= set(self.nodes.columns)
        n = self._derived(self.nodes, "text", display_text(F.col("content_text"), F.col("raw_message_json"))) if own else self.nodes
        return self._derived(n, "norm", normalized(F.col("text")))

    @property
    def norms(self) -> DataFrame:
        """``(conversation_id, node_id, norm, text, raw)``: normal forms, null where they are still to be made of text and raw message.

        One Python step that takes these needs no other before it; ``texts`` takes one for each derived column.
        """
        none = F.lit(None).cast("string")
        if {"text", "norm"} & set(self.nodes.columns):
            return self.texts.select("conversation_id", "node_id", "norm", none.alias("text"), none.alias("raw"))
        norm = norm_in_jvm(F.col("content_text"), F.col("raw_message_json"))
        rest = [F.when(norm.isNull(), F.col(c)).alias(n) for c, n in (("content_text", "text"), ("raw_message_json", "raw"))]
        return self.nodes.select("conversation_id", "node_id", norm.alias("norm"), *rest)

    def _derived(self, rows: DataFrame, name: str, made: Column) -> DataFrame:
        if name not in rows.columns:
            return rows.withColumn(name, made)
        return rows if self.complete else rows.withColumn(name, F.coalesce(name, made))

    @property
    def paths(self) -> DataFrame:
        """The stored paths, or all of them computed."""
        if self.whole is not None:
            return self.whole.paths
        return self.stored_paths if self.stored_paths is not None else effective_paths(self.conversations, self.nodes)

    def paths_of(self, ids: DataFrame) -> DataFrame:
        """The paths of some conversations, given as a ``conversation_id`` column; only their nodes are walked."""
        if self.whole is not None:
            return self.whole.paths_of(ids)
        if self.stored_paths is not None:
            return self.stored_paths
        some = ids.select("conversation_id").distinct()
        return effective_paths(self.conversations.join(some, "conversation_id", "left_semi"), self.nodes.join(some, "conversation_id", "left_semi"))

    @cached_property
    def meta(self) -> DataFrame:
        return self.whole.meta if self.whole is not None else path_metadata(self.conversations, self.nodes)
