"""Corpus pipeline: language identification, near-duplicates, personal data, source mix, packing.

Each stage takes all that its predecessor kept and returns the columns of ``documents``; the last returns the packed
pieces with their token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decant.llm import langid, minhash, mixing, packing, pii
from decant.session import arrow_rows, materialise


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Predicts every document by a model of the labelled ones.

    Documents without a letter go. Where held-out labels show that the model can decide, a document without a label takes
    the predicted language, and those go whose score is below the least one that counts, unless their own label says
    the same or is a language that the model has not learned.
    """
    model = langid.train(docs)
    least = langid.least_score(docs, model)
    if least is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    known = langid.predict(docs.withColumnRenamed("lang", "lang_own"), model, keep_docs=True).filter(F.col("lang_pred") != langid.UNKNOWN)
    own = F.col("lang_own")
    stays = (F.col("score") >= least) | (own.isNotNull() & ((own == F.col("lang_pred")) | ~own.isin(model.languages)))
    return known.filter(stays).withColumn("lang", F.coalesce(own, "lang_pred")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8) stays."""
    with arrow_rows(spark):
        return minhash.deduplicate(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; no document goes."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or go, so that the sources' words come to their target weights."""
    return mixing.repeat(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences of 2048."""
    return packing.pack(docs, capacity=2048, with_ids=True)


STAGES = [("language", language), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mix", mix), ("pack", pack)]
#: Tokenizers, signatures and the language model are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written and read again, so a lost executor repeats no stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with arrow_rows(spark):
        for name, stage in STAGES[:-1]:
            docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
