"""Evidence folded into scored claims, and producer ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provgraph.functions.enums import COMPETING, PRODUCERS
from provgraph.functions.scoring import assurance, confidence, verified


def _flags(evidence: DataFrame) -> dict:
    """What the tie-break priority of a claim depends on, of each item; nothing where modes are not given."""
    if "mode" not in evidence.columns:
        return {}
    kind = F.coalesce(F.col("kind"), F.lit("")) if "kind" in evidence.columns else F.lit("")
    trusted = F.coalesce(F.col("trusted"), F.lit(False)) if "trusted" in evidence.columns else F.lit(False)
    mode = F.coalesce(F.col("mode"), F.lit(""))
    return {"f_prov": kind.isin("w3c-prov-import", "w3c-prov-import-envelope"), "f_declared": kind.contains("declaration"), "f_captured": mode == "captured", "f_imported": mode == "imported", "f_trusted": trusted, "f_static": mode.isin("static", "explicit"), "f_content": mode == "content"}


def _priority() -> Column:
    """Fixed order: imported provenance 3, captured declaration 1, captured 2, trusted import 3, static 4, content 5, else 6."""
    c = F.col
    return F.when(c("f_prov"), 3).when(c("f_declared") & c("f_captured"), 1).when(c("f_captured"), 2).when(c("f_imported") & c("f_trusted"), 3).when(c("f_static"), 4).when(c("f_content"), 5).otherwise(6)


def rescore(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, score, confidence, assurance) anew from the stored evidence of stored claims (claim_id, assurance, evidence_ids).

    Evidence of a verified claim counts as allowed to be exact; that of any other does not. Claims none of
    whose evidence is stored have score 0.
    """
    parts = claims.select("claim_id", (F.col("assurance") == "verified").alias("exact_allowed"), F.explode_outer("evidence_ids").alias("evidence_id"))
    items = parts.join(evidence.select("evidence_id", "signal_group", "weight", "active"), "evidence_id", "left")
    items = items.select(F.col("claim_id").alias("source_id"), F.lit("").alias("target_id"), F.lit("").alias("relation"), "signal_group", "weight", F.coalesce("active", F.lit(False)).alias("active"), "exact_allowed")
    return fold_evidence(items).select(F.col("source_id").alias("claim_id"), "score", "confidence", "assurance")


def fold_evidence(evidence: DataFrame) -> DataFrame:
    """Claims by (source_id, target_id, relation) from evidence (…, signal_group, weight, active, exact_allowed).

    Correlated signals count once: the largest weight of a group, at most 0.99. Groups combine as
    1 - product(1 - weight), at most 0.99, to 4 places. An active item that may be exact, with weight 1,
    makes the score 1. Both levels aggregate before their shuffle.
    """
    key = ["source_id", "target_id", "relation"]
    live = F.when(F.col("active"), F.least(F.greatest("weight", F.lit(0.0)), F.lit(0.99)))
    flags = _flags(evidence)
    group = evidence.groupBy(*key, "signal_group").agg(F.max(live).alias("w"), F.bool_or(F.col("active") & F.col("exact_allowed") & (F.col("weight") >= 1)).alias("exact"), F.count("*").alias("n"), *(F.bool_or(v).alias(k) for k, v in flags.items()))
    claim = group.groupBy(*key).agg(F.product(1 - F.coalesce("w", F.lit(0.0))).alias("miss"), F.bool_or("exact").alias("exact"), F.sum("n").alias("n_evidence"), *(F.bool_or(k).alias(k) for k in flags))
    score = F.when(F.col("exact"), F.lit(1.0)).otherwise(F.round(F.least(F.lit(0.99), 1 - F.col("miss")), 4))
    claim = claim.select(*key, score.alias("score"), "n_evidence", *([_priority().alias("priority")] if flags else []))
    return claim.withColumn("confidence", confidence(F.col("score"))).withColumn("assurance", assurance(F.col("confidence")))


def claim_basis(evidence: DataFrame) -> DataFrame:
    """The basis of each claim from those of its active evidence."""
    has = lambda b: F.bool_or(F.col("active") & (F.col("basis") == b))
    flags = evidence.groupBy("source_id", "target_id").agg(*(F.coalesce(has(b), F.lit(False)).alias(b[0]) for b in ("confirmation", "declaration", "observation", "inference")))
    out = F.when(F.col("c"), "confirmation").when(F.col("d") & ~F.col("o") & ~F.col("i"), "declaration").when(F.col("o") & ~F.col("i"), "observation").otherwise("inference")
    return flags.select("source_id", "target_id", out.alias("basis"))


def evidence_summary(evidence: DataFrame) -> DataFrame:
    """Per claim the last active observation, tie-break priority (1 first), and the competing group."""
    last = F.max(F.when(F.col("active"), F.col("observed_at"))).alias("observed_at")
    flags = _flags(evidence)
    group = F.when(F.col("relation").isin(COMPETING), F.concat(F.lit("origin:"), F.col("target_id")))
    found = evidence.groupBy("source_id", "target_id", "relation").agg(last, *(F.bool_or(v).alias(k) for k, v in flags.items()))
    return found.withColumn("priority", _priority()).drop(*flags).withColumn("competing_group", group)


def best_producer(claims: DataFrame, minimum: float = 0.3) -> DataFrame:
    """For every target its best producer: the only verified one if there is just one, else the top score.

    Ties go to the higher evidence priority, then the smaller source id. One window by target; candidates below ``minimum`` are left out.
    """
    found = claims.where((F.col("score") >= minimum) & F.col("relation").isin(PRODUCERS)).withColumn("sure", verified(F.col("relation"), F.col("assurance")))
    every = Window.partitionBy("target_id")
    found = found.withColumn("n_sure", F.count_if("sure").over(every)).withColumn("n_candidates", F.count("*").over(every))
    only = F.col("sure") & (F.col("n_sure") == 1)
    order = every.orderBy(F.desc(only), F.desc("score"), "priority", "source_id")
    top = found.withColumn("at", F.row_number().over(order)).where("at = 1")
    return top.select("target_id", F.col("source_id").alias("best_source_id"), "score", "assurance", "n_candidates", (F.col("n_sure") == 1).alias("unique_producer"))


def tied_alternatives(claims: DataFrame, minimum: float = 0.0) -> DataFrame:
    """Targets whose top score several producers share."""
    found = claims.where((F.col("score") >= minimum) & F.col("relation").isin(PRODUCERS))
    top = found.groupBy("target_id", "score").count()
    best = top.groupBy("target_id").agg(F.max(F.struct("score", "count")).alias("m"))
    return best.where("m.count > 1").select("target_id", F.col("m.score").alias("top_score"), F.col("m.count").alias("n_tied"))
