"""Claims between documents and what may be exported from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.functions.paths import stem
from provgraph.operators.similarity import matching_pairs


def document_evidence(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Evidence (source_id, target_id, kind, signal_group, weight) between two tables (id, path, text, sha256, mtime_ns, media, prints).

    Contents: similar texts (jaccard of at least 0.15 or containment of a half; at most 0.72), the target's
    very bytes among the media in the source (0.85), media of one fingerprint in both (0.80). Only a pair
    that contents support also gets evidence from an equal stem (0.30) and from times at most an hour
    apart (0.25). Texts and media meet by equal shingles, digests and fingerprints, never pair by pair,
    and texts in cells of bounded size, without a row for each shingle that a pair shares.
    """
    text = lambda df: df.select("id", "text")
    alike = matching_pairs(text(sources), others=text(targets))
    weight = F.least(F.lit(0.72), 0.35 + 0.5 * F.greatest(F.col("jaccard"), 0.65 * F.col("containment")))
    row = lambda df, kind, group, w: df.select("source_id", "target_id", F.lit(kind).alias("kind"), F.lit(group).alias("signal_group"), w.alias("weight"))
    by_text = row(alike.withColumnsRenamed({"a": "source_id", "b": "target_id"}), "normalized-text-similarity", "document-text", weight)
    held = sources.select(F.col("id").alias("source_id"), F.explode("media").alias("sha256")).distinct()
    by_bytes = row(held.join(targets.select(F.col("id").alias("target_id"), "sha256"), "sha256"), "embedded-media-identity", "embedded-media", F.lit(0.85))
    prints = lambda df, name: df.select(F.col("id").alias(name), F.explode("prints").alias("print")).distinct()
    by_print = row(prints(sources, "source_id").join(prints(targets, "target_id"), "print").select("source_id", "target_id").distinct(), "embedded-media-fingerprint-match", "embedded-media", F.lit(0.80))
    found = by_text.unionByName(by_bytes).unionByName(by_print)
    end = lambda df, name: df.select(F.col("id").alias(f"{name}_id"), F.lower(stem(F.col("path"))).alias(f"{name}_stem"), F.col("mtime_ns").alias(f"{name}_time"))
    pairs = found.select("source_id", "target_id").distinct().join(end(sources, "source"), "source_id").join(end(targets, "target"), "target_id")
    by_name = row(pairs.where("source_stem = target_stem"), "filename-stem", "naming", F.lit(0.30))
    by_time = row(pairs.where(seconds_apart(F.col("source_time"), F.col("target_time")) <= 3600), "timestamp-proximity", "timing", F.lit(0.25))
    return found.unionByName(by_name).unionByName(by_time)


def seconds_apart(a, b):
    """Seconds between two times in nanoseconds, to the millisecond; null and zero times are no times."""
    return F.when((a != 0) & (b != 0), F.round(F.abs(a - b) / 1e9, 3))


def document_edges(evidence: DataFrame) -> DataFrame:
    """(source_id, target_id, relation, score) from ``document_evidence``: the strongest weight of each signal group counts."""
    group = evidence.groupBy("source_id", "target_id", "signal_group").agg(F.max(F.least("weight", F.lit(0.99))).alias("w"), F.bool_or(F.col("kind") == "embedded-media-identity").alias("same"))
    claim = group.groupBy("source_id", "target_id").agg(F.product(1 - F.col("w")).alias("miss"), F.bool_or("same").alias("same"))
    return claim.select("source_id", "target_id", F.when(F.col("same"), "embedded_bytes_match").otherwise("content_matches").alias("relation"), F.round(F.least(F.lit(0.99), 1 - F.col("miss")), 4).alias("score"))
