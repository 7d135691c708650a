"""A training corpus from ``documents``: drop toxic and poor texts, cut repeated passages, keep one near copy, pack.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and its result is written as Parquet and
read again as the next one's docs.  All but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import linededup, neardup, packing, quality, toxicity
from pulsegrid.llm.scratch import Scratch
from pulsegrid.llm.tables import columns, fold, read, unused

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose toxicity score is below one half.

    A null or empty text has the score of the bias alone and stays; repeated rows are judged alike; with no usable label all
    stay; an empty table gives no rows.  Further columns, of any name, are handed on.
    """
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    toxic = unused(docs, "toxic_score")
    return toxicity.scored(docs, model.score, names=(toxic,)).where(F.col(toxic) < 0.5).select(*columns(docs))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are more likely than not of a grade above the lowest.

    A null, empty or blank text is judged by the thresholds alone: it stays where most rated documents are above the lowest grade.
    Repeated rows are judged alike; with no usable rating all stay; an empty table gives no rows.  Further columns, of any name,
    are handed on.
    """
    model = quality.fit(docs, read(spark, sf_dir, "labels"), fold("doc_id", 5) != 0, quality.editorial_grade())
    names = tuple(unused(docs, f"quality_{k}") for k in range(model.params.grades))  # expected grade, P(>= 1), P(>= 2)
    return toxicity.scored(docs, model.score, names=names).where(F.col(names[1]) >= 0.5).select(*columns(docs))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later copies of line runs of 50 words or more; a document left without a line goes.

    Null, empty and blank texts have no lines and stay; rows equal in id and text count as one document and stay as
    many rows; n_chars follows the text where lines were cut; an empty table gives no rows.  Further columns, of any
    name, are handed on.
    """
    before, removed = unused(docs, "lines_before"), unused(docs, "lines_removed")
    out = linededup.dedupe(docs, min_words=50, counts=(before, removed)).where((F.col(removed) == 0) | (F.col(removed) < F.col(before)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*columns(docs))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of each class of near copies.

    Null texts are alike to nothing and stay; equal texts, empty ones included, are one class; of rows equal in id and text one
    stays; a null id stays only in a class without another; an empty table gives no rows.
    """
    return neardup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens.

    A null or empty text is its end id; null ids and repeated rows are packed like others; an empty table gives no rows;
    further columns are left out.
    """
    return packing.pack(docs, TOKENIZER, window=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("line dedup", cut_repeated_lines),
    ("near dedup", keep_one_copy),
    ("packing", pack),
]

#: Trained models and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch, docs = Scratch(spark, "corpus"), read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, f"stage{k}")
    return docs
