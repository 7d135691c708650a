"""Reading the given tables by path, and what all operators on texts share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_ROWS = 1_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of TEXT_ROWS rows, unless the session sets another number.

    Spark's default of 10,000 texts per batch is held several times over, in the executor and in its Python workers.
    """
    if ROWS_SETTING not in spark.conf.getAll:
        spark.conf.set(ROWS_SETTING, str(TEXT_ROWS))


def fold(doc_id: str, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id falls in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % k, F.lit(0))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def columns(df: DataFrame) -> list[Column]:
    """All columns by name, whatever characters the names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


HOT_SHARE = 256


def join_keyed(rows: DataFrame, keyed: DataFrame, on: list[str], total: int) -> DataFrame:
    """``rows``, ``total`` in number, joined with ``keyed``, which has one row a key and its count of rows as n.

    Keys of more than a 256th of all rows, of which there are fewer than 256, are broadcast, so no task gets all rows of one; the
    others are shuffled.
    """
    hot = F.broadcast(keyed.where(F.col("n") * HOT_SHARE > total).drop("n"))
    rest = rows.join(hot.select(*on), on, "left_anti").join(keyed.where(F.col("n") * HOT_SHARE <= total).drop("n"), on)
    return rows.join(hot, on).unionByName(rest)
