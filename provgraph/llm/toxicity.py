"""Toxicity as cumulative-link ordinal regression on sparse word features.

Severity has ordered grades 0, 1, 2, ...; P(grade > k) = sigmoid(w . x - t_k) with one weight vector w
for all thresholds t_0 < t_1 < ...; x says which words a text has, hashed to 2**18 buckets. The model
is fitted on the driver to a bounded sample of labelled rows; buckets whose share among toxic and other
rows does not differ by a z-test have weight 0. Every text gets its expected severity, the sum over k
of P(grade > k).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.llm.shared import Stage
from provgraph.llm.words import ALNUM, U, hashes, slices, spans

BITS = 18
#: Most labelled rows that a model is fitted to; of more, those with the smallest hash of their id.
SAMPLE = 20_000
#: A bucket takes part if its shares differ by so many standard errors.
Z = 5.0
#: A text is toxic if P(grade > 0) is at least this.
LIMIT = 0.5


def presence(data: np.ndarray, offsets: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of the distinct buckets of each text, and the texts' numbers of words.

    ``weight``: leave out buckets whose weight is 0.
    """
    starts, ends, first = spans(data, offsets, ALNUM)
    bucket = (hashes(data, starts, ends) >> U(64 - BITS)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    if weight is not None:
        kept = weight[bucket] != 0
        text, bucket = text[kept], bucket[kept]
    pair = np.unique(text << BITS | bucket)
    return pair >> BITS, pair & ((1 << BITS) - 1), np.diff(first)


@dataclass
class Severity:
    """Weights of the buckets and the ordered thresholds; without thresholds every text has severity 0."""

    weight: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_features: int, ridge: float = 1.0, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model, by Adam on the penalised likelihood."""
    top = int(grades.max())
    flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    share = np.array([(grades > k).mean() for k in range(top)])
    start = -np.log(share / (1 - share))
    x = np.concatenate([np.zeros(n_features), [start[0]], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, rounds + 1):
        w, gaps = x[:n_features], np.exp(x[n_features + 1 :])
        t = x[n_features] + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(owner, w[flat], minlength=len(rows))
        above = 1 / (1 + np.exp(np.clip(t[None, :] - score[:, None], -60, 60)))
        upper = np.concatenate([np.ones((len(rows), 1)), above, np.zeros((len(rows), 1))], axis=1)
        here = np.arange(len(rows))
        p = np.maximum(upper[here, grades] - upper[here, grades + 1], 1e-12)
        slope = upper * (1 - upper)
        d_score = (slope[here, grades] - slope[here, grades + 1]) / p
        d_t = np.zeros(top)
        np.add.at(d_t, np.maximum(grades - 1, 0), np.where(grades > 0, -slope[here, grades] / p, 0))
        np.add.at(d_t, np.minimum(grades, top - 1), np.where(grades < top, slope[here, grades + 1] / p, 0))
        g = np.zeros_like(x)
        g[:n_features] = np.bincount(flat, d_score[owner], minlength=n_features) - ridge * w
        g[n_features] = d_t.sum()
        g[n_features + 1 :] = np.cumsum(d_t[::-1])[::-1][1:] * gaps
        g /= len(rows)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return x[:n_features], x[n_features] + np.concatenate([[0], np.cumsum(np.exp(x[n_features + 1 :]))])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in slices(batches, "text"):
        text, bucket, _ = presence(data, offsets)
        ends = np.searchsorted(text, np.arange(len(offsets))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.astype(np.int32)))], ["grade", "buckets"])


def fit_severity(docs: DataFrame, grades: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, z: float = Z) -> Severity:
    """Fit to ``grades`` (id, grade: 0 and up) joined with the texts.

    At most ``sample`` labelled ids are used, those with the smallest hash, so the sample does not
    depend on order or partitions; a label whose document is missing counts among them and is unused.
    Null grades and ids are ignored; of several grades of one id the highest counts, of several texts the
    smallest. Without toxic or without clean labelled documents (an empty table, say) nothing is learned:
    every text has severity 0.
    """
    spark = docs.sparkSession
    labelled = grades.where(f"grade is not null and {id_col} is not null").groupBy(id_col).agg(F.max("grade").alias("grade"))
    chosen = labelled.orderBy(F.xxhash64(id_col), id_col).limit(sample)  # bounded, so it may be broadcast
    stage = Stage(spark, "toxicity")
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), id_col)
    rows = rows.groupBy(id_col).agg(F.first("grade").alias("grade"), F.min("text").alias("text"))  # so rows are bounded too
    held = stage.put(rows.select(F.col("grade").cast("int"), "text").mapInArrow(_features, "grade int, buckets array<int>"), "sample")
    number = {r.grade: r["count"] for r in held.groupBy("grade").count().collect()}
    bad, good = sum(n for g, n in number.items() if g > 0), number.get(0, 0)
    weight = np.zeros(1 << BITS)
    if not bad or not good:
        return Severity(weight, np.zeros(0))
    seen = held.select("grade", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count_if(F.col("grade") > 0).alias("a"), F.count_if(F.col("grade") == 0).alias("b"))
    p = (F.col("a") + F.col("b")) / (bad + good)
    gap = (F.col("a") / bad - F.col("b") / good) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / bad + 1 / good))
    used = np.array(sorted(r.bucket for r in seen.where((F.abs(gap) >= z) & (F.col("a") + F.col("b") >= 5)).select("bucket").collect()), dtype=np.int64)
    wanted = spark.createDataFrame([(int(b), k) for k, b in enumerate(used)], "bucket int, feature int")
    numbered = held.select("grade", "buckets", F.monotonically_increasing_id().alias("row"))
    found = numbered.select("row", "grade", F.explode_outer("buckets").alias("bucket")).join(F.broadcast(wanted), "bucket", "left")
    table = found.groupBy("row").agg(F.first("grade").alias("grade"), F.array_sort(F.collect_list("feature")).alias("features")).orderBy("row").toArrow()
    rows_ = [np.array(x, dtype=np.int64) for x in table.column("features").to_pylist()]
    values = np.array(table.column("grade").to_pylist(), dtype=np.int64)
    present = np.unique(np.append(values, 0))
    w, thresholds = fit_ordinal(rows_, np.searchsorted(present, values), len(used))
    weight[used] = w
    stage.drop("sample")
    return Severity(weight, thresholds)


def _score(model: Severity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            text, bucket, n_words = presence(data, offsets, model.weight)
            score = np.bincount(text, model.weight[bucket], minlength=len(offsets) - 1)
            above = model.above(score)
            grade = (above >= 0.5).sum(axis=1)
            first = above[:, 0] if above.shape[1] else np.zeros(len(score))
            made = [pa.array(n_words, pa.int64()), pa.array(above.sum(axis=1)), pa.array(first), pa.array(grade, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["id", "n_words", "severity", "p_toxic", "grade"])

    return run


def score_severity(docs: DataFrame, model: Severity, id_col: str = "doc_id", text_col: str = "text", limit: float = LIMIT) -> DataFrame:
    """(id, n_words, severity, p_toxic, grade, toxic) of every whole text.

    ``severity``: the expected grade; ``grade``: the median one. Null and empty texts have no words and
    get the severity of a text without features. Repeated rows and null ids stay, an empty table gives no
    rows, texts of any length are read whole, and the order of buckets or rows plays no part; other
    columns go. A text exactly at ``limit`` is toxic.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_score(model), f"id {kind}, n_words long, severity double, p_toxic double, grade int")
    return out.withColumn("toxic", F.col("p_toxic") >= limit).withColumnRenamed("id", id_col)


def label_grades(labels: DataFrame) -> DataFrame:
    """Grades from a table (doc_id, quality, toxic): 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1)).when(F.col("toxic") == 0, 0).alias("grade"))


def drop_toxic(docs: DataFrame, model: Severity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not find toxic, unchanged, without a shuffle."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, text_col):
            text, bucket, _ = presence(data, offsets, model.weight)
            above = model.above(np.bincount(text, model.weight[bucket], minlength=len(offsets) - 1))
            kept = above[:, 0] < LIMIT if above.shape[1] else np.ones(len(above), dtype=bool)
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, columns)


def op4(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_severity(docs, fit_severity(docs, label_grades(labels)))
