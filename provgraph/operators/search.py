"""Search in texts and names."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.functions.text import words
from provgraph.plans.lineage import cut


def search_like(texts: DataFrame, term: str, limit: int = 20) -> DataFrame:
    """(id, excerpt) of the first texts, by id, that contain a term in any case."""
    hit = F.contains(F.lower("text"), F.lit(term.lower()))
    return texts.where(hit).orderBy("id").limit(limit).select("id", F.left("text", F.lit(500)).alias("excerpt"))


def search_bm25(texts: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of texts that have all terms, by BM25 over all texts.

    Counts are made inside each row and kept, so texts are read once and nothing is exploded.
    """
    found = texts.select("id", words(F.col("text")).alias("w"))
    for k, t in enumerate(terms):
        found = found.withColumn(f"f{k}", _times("w", t))
    found = cut(found.withColumn("n", F.size("w")).drop("w"))  # a few numbers a text, so texts are read once
    stats = found.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *(F.count_if(F.col(f"f{k}") > 0).alias(f"d{k}") for k in range(len(terms)))).first()
    score = F.lit(0.0)
    for k in range(len(terms)):
        idf = F.log(F.lit((stats.docs - stats[f"d{k}"] + 0.5) / (stats[f"d{k}"] + 0.5) + 1))
        score = score + idf * F.col(f"f{k}") * (k1 + 1) / (F.col(f"f{k}") + k1 * (1 - b + b * F.col("n") / float(stats.mean or 1)))
    every = F.lit(True)
    for k in range(len(terms)):
        every = every & (F.col(f"f{k}") > 0)
    return found.where(every).select("id", F.round(score, 6).alias("score"))


def _times(column: str, term: str):
    return F.size(F.filter(column, lambda x: x == term))


def find_fuzzy(names: DataFrame, query: str, least: float = 0.35, limit: int = 20) -> DataFrame:
    """(id, name, ratio): names like a query by the ratio of matching blocks, the best first."""

    @F.pandas_udf("double")
    def ratio(name: pd.Series) -> pd.Series:
        return name.map(lambda x: difflib.SequenceMatcher(None, query.lower(), (x or "").lower()).ratio())

    # a ratio is at most 2 * shorter / total length
    short, total = F.least(F.length("name"), F.lit(len(query))), F.length("name") + len(query)
    found = names.where(2 * short / total >= least).select("id", "name", ratio("name").alias("ratio")).where(F.col("ratio") >= least)
    return found.orderBy(F.desc("ratio"), "name").limit(limit)
