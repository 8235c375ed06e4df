"""From raw documents to token ids: language ID, quality, near duplicates, mixing, byte-level BPE.

Rows of any kind go through: a null or empty text has no letter and goes at language ID; null ids, sources and languages
are values like others; of repeated rows the near-duplicate stage keeps one; an empty table gives an empty result at
every stage; further columns of documents are kept up to the mix, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import langid, quality
from larkspur.llm.bpe import bpe_digests
from larkspur.llm.common import by_place, materialize, release
from larkspur.llm.mixing import mix
from larkspur.llm.near_duplicates import drop_near_duplicates
from larkspur.llm.queries import vocabulary
from larkspur.session import ship


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter or unlike all languages go."""
    ship(spark)
    model = langid.train(langid.learnable(docs))
    return by_place(docs, lambda rows: langid.identify(rows, model, tuple(rows.columns)).where("not rejected"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules score 0.5 or more."""
    ship(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return by_place(docs, lambda rows: quality.score_quality(rows, model, tuple(rows.columns)).where("predicted = 1"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least doc_id."""
    ship(spark)
    return drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for, shuffled."""
    return mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes of each document of the mix."""
    ship(spark)
    path, pattern = vocabulary("byte_bpe_multi_50k.tiktoken")
    return bpe_digests(docs, path, pattern)


STAGES = [
    ("language ID", language_stage),
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources", mixing_stage),
    ("byte-level BPE", encoding_stage),
]

#: Trained models and token ids can't be had from SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another over documents, each written as Parquet and read again; what no later one reads is removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
