"""A corpus pipeline: five stages, each of which works on all documents that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import decontaminate, langid, mixing, quality, simhash
from tideline.plans.scratch import delete_folder, scratch_dir

#: Least probability of the identified language.
SURE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score predicts label 1.

    The model learns from all documents and the labels of those that aren't
    held out. Null and empty texts are scored like any other; repeated rows and
    ties share one fate; very long texts are read whole; an empty table stays
    empty; columns of any name pass through.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels.where(~quality.held_out()))
    return quality.accepted(docs, model)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the known languages, with a score of SURE or more.

    Null, empty and letterless texts are in none and go; where no row has a
    language all stay; repeated rows share one fate, of tied languages the first
    by name counts; very long texts are read whole; an empty table stays empty;
    columns of any name pass through.
    """
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.accepted(docs, model, SURE)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of least doc_id.

    Null and empty texts are one group; of rows that repeat an id and text one
    stays; a null id stands only for a group without others; very long texts are
    compared whole; an empty table stays empty; columns of any name pass through.
    """
    return simhash.keep_one_of_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; repeated rows share one fate; very long
    texts are searched whole; an empty table, or an empty benchmark, changes
    nothing; columns of any name pass through.
    """
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document.

    A null text has no words, a null source is a source of its own; rows that
    repeat an id are drawn one by one, ties stand by id; very long texts count
    whole; an empty table gives an empty result; other columns don't return.
    """
    return mixing.mix_sources(docs)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("dedup", dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mixing", mixing_stage),
]

#: The models of the first two stages can't be expressed in SQL; a test holds run() against a plain version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written to the shared folder and read back, then the one before it deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        out = f"{scratch_dir(spark)}/corpus-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(out)
        if before:
            delete_folder(spark, before)
        docs, before = spark.read.parquet(out), out
    return docs
