"""Stand-in recordings, feature tables and predictions derived from the given tables (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STREAMS = ["acc_x", "acc_y", "acc_z", "eda", "hr", "temp"]


def _rows(spark: SparkSession, sf_dir: str, key: str = "l_suppkey") -> DataFrame:
    order = Window.partitionBy(key).orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return df.withColumn("subject", F.col("l_suppkey").cast("string")).withColumn("sample_idx", (F.row_number().over(order) - 1).cast("long"))


def wide_1hz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per second and subject: all streams and the label."""
    q, d = F.col("l_quantity"), F.col("l_discount")
    block = F.pmod(F.floor(F.col("sample_idx") / 150), F.lit(5))
    return _rows(spark, sf_dir).select(
        "subject", "sample_idx", F.col("l_tax").alias("acc_x"), d.alias("acc_y"), (1 + q / 300).alias("acc_z"),
        (q * 0.2).alias("eda"), (F.col("l_extendedprice") / 500).alias("hr"), (30 + d * 50).alias("temp"),
        F.when(block < 4, block + 1).otherwise(0).cast("int").alias("label"),
    )


def samples_1hz(spark: SparkSession, sf_dir: str, streams: list[str] = STREAMS) -> DataFrame:
    """Long form: subject, stream, sample_idx, v."""
    return wide_1hz(spark, sf_dir).unpivot(["subject", "sample_idx"], streams, "stream", "v")


def labels_1hz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_1hz(spark, sf_dir).select("subject", "sample_idx", "label")


def half_rate(labels: DataFrame) -> DataFrame:
    """Every second label of a track, as a track of half the rate."""
    return labels.where("sample_idx % 2 = 0").withColumn("sample_idx", F.floor(F.col("sample_idx") / 2))


def pulse_64hz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pulse wave of 60 to 110 beats a minute by subject, with noise from prices: subject, sample_idx, v."""
    rate = 1.0 + F.pmod(F.col("l_suppkey"), F.lit(10)) / 12
    wave = F.sin(F.col("sample_idx") / 64 * rate * 2 * 3.141592653589793)
    return _rows(spark, sf_dir).select("subject", "sample_idx", (wave + F.col("l_discount") / 10).alias("v"))


def recording_arrays(spark: SparkSession, sf_dir: str, stream: str = "eda") -> DataFrame:
    """One array per subject and stream: subject, stream, values."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return df.select(F.col("vec_id").cast("string").alias("subject"), F.lit(stream).alias("stream"), F.col("embedding").cast("array<double>").alias("values"))


FEATS = ["eda_scl_mean", "eda_range", "eda_scr_count", "eda_scr_amp_sum", "z1", "z2", "z3", "gaps"]


def features(spark: SparkSession, sf_dir: str, key: str = "l_suppkey") -> DataFrame:
    """A feature table with all rungs of the divisor cascade and one column with gaps.

    With key='subject' the same rows come dealt out by subject: numbering them takes somewhat longer, a step by subject then needs no exchange.
    """
    df = _rows(spark, sf_dir, key)
    return df.select(
        "subject", (F.lit(1) + F.col("sample_idx") % 3).cast("int").alias("label"), (F.col("sample_idx") * 5).cast("double").alias("t_start"),
        F.col("l_quantity").alias("eda_scl_mean"), F.col("l_extendedprice").alias("eda_range"), F.col("l_discount").alias("eda_scr_count"), F.col("l_tax").alias("eda_scr_amp_sum"),
        F.when(F.col("sample_idx") < 100, 0.0).otherwise(F.col("l_tax")).alias("z1"),
        F.when(F.col("l_suppkey") % 10 == 0, 1.0).otherwise(F.col("l_quantity")).alias("z2"),
        F.lit(1.0).alias("z3"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("gaps"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, y, yhat in 1..3."""
    flag = F.col("l_returnflag")
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return df.select(F.col("l_suppkey").cast("string").alias("subject"), (1 + F.col("l_linenumber") % 3).cast("int").alias("y"), F.when(flag == "A", 1).when(flag == "N", 2).otherwise(3).cast("int").alias("yhat"))


#: The same stand-ins as SQL common table expressions.
SQL_REC = """rec AS (
    SELECT CAST(l_suppkey AS VARCHAR) AS subject, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
           row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i
    FROM lineitem
), wide AS (
    SELECT subject, i, l_tax AS acc_x, l_discount AS acc_y, 1 + l_quantity / 300 AS acc_z, l_quantity * 0.2 AS eda,
           l_extendedprice / 500 AS hr, 30 + l_discount * 50 AS temp,
           CASE WHEN (i // 150) % 5 < 4 THEN (i // 150) % 5 + 1 ELSE 0 END::INTEGER AS label
    FROM rec
), dur AS (SELECT subject, count(*) * 1.0 AS duration FROM wide GROUP BY subject
), grid AS (
    SELECT subject, unnest(range(0, floor((duration - 60) / 5)::BIGINT + 1)) AS w FROM dur WHERE duration >= 60
)"""
SQL_FEAT = """rec AS (
    SELECT CAST(l_suppkey AS VARCHAR) AS subject, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
           row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i
    FROM lineitem
), feat AS (
    SELECT subject, (1 + i % 3)::INTEGER AS label, (i * 5)::DOUBLE AS t_start, l_quantity AS eda_scl_mean, l_extendedprice AS eda_range,
           l_discount AS eda_scr_count, l_tax AS eda_scr_amp_sum, CASE WHEN i < 100 THEN 0.0 ELSE l_tax END AS z1,
           CASE WHEN l_suppkey % 10 = 0 THEN 1.0 ELSE l_quantity END AS z2, 1.0::DOUBLE AS z3,
           CASE WHEN l_linenumber <> 3 THEN l_quantity END AS gaps
    FROM rec
)"""
SQL_PRED = """pred AS (
    SELECT CAST(l_suppkey AS VARCHAR) AS subject, (1 + l_linenumber % 3)::INTEGER AS y,
           CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS yhat FROM lineitem
)"""


def defective(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(samples, labels) with one kind of fault for every acceptance check."""
    s = F.col("subject").cast("int")
    long = samples_1hz(spark, sf_dir, ["acc_x", "acc_y", "acc_z", "eda", "hr", "temp"])
    long = long.where(~((s % 7 == 0) & (F.col("stream") == "temp")) & ~((s % 5 == 0) & (F.col("stream") == "acc_z") & (F.col("sample_idx") >= 500)))
    v = F.when((F.col("stream") == "eda") & (F.col("sample_idx") % 97 == 3), F.lit(None).cast("double"))
    v = v.when((F.col("stream") == "eda") & (s % 11 == 0) & (F.col("sample_idx") == 10), -1.0).when((F.col("stream") == "temp") & (s % 13 == 0), F.col("v") + 20).otherwise(F.col("v"))
    labels = labels_1hz(spark, sf_dir).withColumn("label", F.when((s % 3 == 0) & (F.col("label") == 3), 4).otherwise(F.col("label")).cast("int"))
    return long.withColumn("v", v), labels


SQL_DEFECT = SQL_REC + """, dlong AS (
    SELECT subject, i, stream, CASE WHEN stream = 'eda' AND i % 97 = 3 THEN NULL
             WHEN stream = 'eda' AND subject::INT % 11 = 0 AND i = 10 THEN -1.0
             WHEN stream = 'temp' AND subject::INT % 13 = 0 THEN v + 20 ELSE v END AS v
    FROM (
        SELECT subject, i, 'acc_x' AS stream, acc_x AS v FROM wide UNION ALL SELECT subject, i, 'acc_y', acc_y FROM wide
        UNION ALL SELECT subject, i, 'acc_z', acc_z FROM wide UNION ALL SELECT subject, i, 'eda', eda FROM wide
        UNION ALL SELECT subject, i, 'hr', hr FROM wide UNION ALL SELECT subject, i, 'temp', temp FROM wide
    ) WHERE NOT (subject::INT % 7 = 0 AND stream = 'temp') AND NOT (subject::INT % 5 = 0 AND stream = 'acc_z' AND i >= 500)
), dlab AS (
    SELECT subject, i, CASE WHEN subject::INT % 3 = 0 AND label = 3 THEN 4 ELSE label END AS label FROM wide
)"""
