"""Intermediate tables in the folder that the whole cluster shares.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading it back, so a lost
executor costs one stage and never the chain before it.  Where the setting is absent (tests on one machine)
a temporary folder takes its place.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


ROWS_PER_FILE = 100_000


def root(spark: SparkSession) -> str:
    """The shared scratch folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit
        pass


class Scratch:
    """Tables of one operator run: ``save`` writes one and reads it back, ``drop`` removes those no longer needed."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base, self.n = spark, f"{root(spark)}/{label}-{uuid.uuid4().hex}", 0
        atexit.register(_remove, spark, self.base)

    def save(self, df: DataFrame, name: str = "t", rows: int | None = None) -> DataFrame:
        """``rows``, where an upper bound of them is known, sets the number of files, about ROWS_PER_FILE each."""
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
        path = f"{self.base}/{self.n:03d}-{name}"
        self.n += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := getattr(t, "_scratch_path", None):
                _remove(self.spark, path)
