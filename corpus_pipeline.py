"""A training corpus from ``documents``: five stages, each written as Parquet and reread by the next.

Toxic documents go; of near copies one stays; documents with benchmark passages go; what is left is
repeated by fitted rates (every document at least once); and its token ids are written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from provgraph.llm import decontaminate, mixing, ngram_join, token_files, toxicity
from provgraph.llm.shared import Stage

#: Tokens of the mixed corpus over those of its input, and the most times a document stands in it.
BUDGET, MOST = 1.25, 4.0


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted to the labelled ones among them, does not find toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit_severity(docs, toxicity.label_grades(labels)))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class that links of 0.8 between sets of five-word shingles make."""
    return ngram_join.keep_one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in benchmark phrases."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that token totals of the labelled domains come near their target weights.

    Rates are at least 1, so that every document stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.repeat_by_rate(docs, mixing.label_domains(labels), mixing.WEIGHTS, BUDGET, 1.0, MOST)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files of the corpus, read back: one row for each time that a document stands in it."""
    return token_files.token_file_digest(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity_stage), ("near copies", near_copies_stage), ("benchmark", benchmark_stage), ("mixing", mixing_stage), ("token files", token_stage)]

#: SQL has neither the fitted models nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = Stage(spark, "pipeline")
    for k, (_, function) in enumerate(STAGES):
        docs = stage.put(function(spark, docs, sf_dir), f"stage{k}")
        if k:
            stage.drop(f"stage{k - 1}")
    return docs
