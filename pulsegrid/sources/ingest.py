"""Recordings in, tables out: exploding array tracks, incremental builds, Parquet or gzip CSV sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.contract import FEATURE_NAMES, check_columns
from pulsegrid.functions.arrays import finite

FEATURE_TABLE = T.StructType([T.StructField(c, T.DoubleType()) for c in FEATURE_NAMES] + [T.StructField("subject", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("label_name", T.StringType()), T.StructField("t_start", T.DoubleType())])


def samples(recording: DataFrame) -> DataFrame:
    """(subject, stream, values) to (subject, stream, sample_idx, v); non-finite values become null."""
    out = recording.select("subject", "stream", F.posexplode("values").alias("sample_idx", "v"))
    return out.select("subject", "stream", F.col("sample_idx").cast("long").alias("sample_idx"), finite(F.col("v").cast("double")).alias("v"))


def _axis(k: int) -> Column:
    return F.transform("values", lambda r: F.element_at(r, k + 1))


def split_axes(acc: DataFrame) -> DataFrame:
    """(subject, values array<array<double>>) of n x 3 to three streams."""
    axes = F.explode(F.array(*[F.struct(F.lit(f"acc_{c}").alias("stream"), _axis(k).alias("values")) for k, c in enumerate("xyz")])).alias("s")
    return acc.select("subject", axes).select("subject", "s.stream", "s.values")


def select_subjects(df: DataFrame, subjects: list[str] | None = None) -> DataFrame:
    """A subset, or all; on a table partitioned by subject the filter prunes partitions."""
    return df if subjects is None else df.where(F.col("subject").isin(list(subjects)))


def pending(subjects: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Subjects still to build."""
    every = subjects.select("subject").distinct()
    return every if force else every.join(done.select("subject"), "subject", "left_anti")


def combine(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def write_features(df: DataFrame, path: str) -> None:
    """One directory per subject; only the subjects in ``df`` are replaced, so a subject without rows leaves nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("subject").parquet(path)


def load_features(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([f for f in FEATURE_TABLE if f.name != "subject"] + [FEATURE_TABLE["subject"]])
    return check_columns(spark.read.schema(schema).parquet(path)).select(FEATURE_TABLE.names)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    out = df.write.mode("overwrite")
    if partition_by:
        out = out.partitionBy(*partition_by)
    if fmt == "parquet":
        out.parquet(path)
    elif fmt == "csv":
        out.option("header", True).option("compression", "gzip").csv(path)
    elif fmt == "json":
        out.json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
