"""Scores as columns: labels, assurance, evidence priority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provgraph.functions.enums import ASSURANCE, BASIS, CONFIDENCE, VERIFIED_CAUSAL

#: Least score of a chain that makes what it reaches probably stale, not just possibly.
STRONG = 0.8


def confidence(score: Column) -> Column:
    out = F.lit("unknown")
    for label, least in reversed(CONFIDENCE):
        out = F.when(score >= least, label).otherwise(out)
    return out


def assurance(label: Column) -> Column:
    out = F.lit("insufficient")
    for name, value in ASSURANCE.items():
        out = F.when(label == name, value).otherwise(out)
    return out


def basis_of_mode(mode: Column) -> Column:
    out = F.lit("inference")
    for name, value in BASIS.items():
        out = F.when(mode == name, value).otherwise(out)
    return out


def verified(relation: Column, assured: Column) -> Column:
    return relation.isin(VERIFIED_CAUSAL) & (assured == "verified")


def grade(newer: Column, all_verified: Column, least: Column) -> Column:
    """Staleness of a chain: how surely something downstream of a newer upstream is out of date."""
    stale = F.when(all_verified, "definitely_stale").when(least >= STRONG, "probably_stale").otherwise("possibly_stale")
    return F.when(newer.isNull(), "unknown").when(newer, stale).when(all_verified, "current").otherwise("unknown")
