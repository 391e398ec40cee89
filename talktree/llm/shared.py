"""The shared folder for intermediate tables, and how operators write to it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from talktree.functions.batches import bounded_batches


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    A cluster names that directory.  Where it is unset on a local master, as in tests, a temporary
    folder is taken and set in the session; elsewhere executors would not see each other's files, so
    that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='talktree-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/talktree-{uuid.uuid4().hex}"


class Scratch:
    """Tables written once to the shared folder; reading them back cuts the lineage."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.count = spark, shared_folder(spark), 0
        self.kept: list[tuple[DataFrame, str]] = []
        bounded_batches(spark)

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.folder}/{self.count:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        table = self.read(path, df.schema)
        self.kept.append((table, path))
        return table

    def read(self, path: str, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path)

    def remove(self, path: str) -> None:
        """Deletes a folder."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that this kept and that no result still reads."""
        for table, path in [x for x in self.kept if any(x[0] is t for t in tables)]:
            self.remove(path)
        self.kept = [x for x in self.kept if not any(x[0] is t for t in tables)]


def distinct_name(taken: list[str], name: str) -> str:
    """``name``, or ``name`` with underscores in front, so that it clashes with none of ``taken``."""
    while name.lower() in {x.lower() for x in taken}:
        name = f"_{name}"
    return name
