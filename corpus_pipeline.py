"""A training corpus from documents: each stage takes what the one before it kept.

Toxic documents go; one document of each near-duplicate group stays; repeated passages are cut; documents with benchmark
items go; the rest is encoded. Every stage's result is written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import state
from quillspark.llm import bpe, decontaminate, near_dup, substring, toxicity
from quillspark.llm.frames import materialise
from quillspark.llm.queries import table

#: Stages on word shingles link texts of this similarity or more.
NEAR = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs, model, "__toxicity").filter(F.col("__toxicity") < toxicity.CUT).drop("__toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near_duplicates(docs, NEAR)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.dedup_documents(docs).drop("__n_words", "__n_removed")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.with_leaks(docs, table(spark, sf_dir, "benchmark"), "__leaks").filter("__leaks = 0").drop("__leaks")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage read and wrote on its way is deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        if i + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with state.scope(spark) as own:
            own.adopt(docs)
            docs = materialise(stage(spark, docs, sf_dir), name)
            own.keep(docs)
