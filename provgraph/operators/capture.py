"""What a recorded run tells: from two snapshots to evidence of what it made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.functions.paths import short_id
from provgraph.operators.snapshots import compare, renames

# States of a run that has ended, and the weight of evidence from runs that were not closed cleanly.
TERMINAL = ["completed", "failed", "interrupted", "recovered", "incomplete"]
WEIGHTS = {"recovered": 0.75, "incomplete": 0.50}


def boundary_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, path, previous_path) between two snapshots; a rename is neither a creation nor a deletion."""
    changed = compare(before, after)
    moved = renames(changed)
    plain = changed.select("path", "change").join(moved.select(F.col("path_from").alias("path"), F.lit("deleted").alias("change")), ["path", "change"], "left_anti").join(moved.select(F.col("path_to").alias("path"), F.lit("created").alias("change")), ["path", "change"], "left_anti")
    return plain.select("change", "path", F.lit(None).cast("string").alias("previous_path")).unionByName(moved.select(F.lit("renamed").alias("change"), F.col("path_to").alias("path"), F.col("path_from").alias("previous_path")))


def run_evidence(changes: DataFrame, runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Evidence of every change (run_id, change, path) of recorded runs (run_id, status, direct_runtime).

    Only a creation or modification in a run that was executed directly and ended by itself tells a cause,
    and may be exact; anything else is an observation at the run's boundaries. Recovered and incomplete runs
    weigh less. Paths that are no artifact's get a virtual id.
    """
    known = artifacts.select("path", "artifact_id")
    each = changes.join(runs.where(F.col("status").isin(TERMINAL)).select("run_id", "status", "direct_runtime"), "run_id").join(known, "path", "left")
    target = F.coalesce("artifact_id", short_id(F.lit("file"), F.col("path")))
    cause = F.col("direct_runtime") & F.col("change").isin("created", "modified") & F.col("status").isin("completed", "failed", "interrupted")
    relation = F.when(cause, "was_generated_by").when(F.col("change") == "renamed", "observed_rename_during").otherwise(F.concat(F.lit("observed_"), F.col("change"), F.lit("_during")))
    weight, kind = F.lit(1.0), F.lit("task-boundary-diff")
    for state, less in WEIGHTS.items():
        weight, kind = F.when(F.col("status") == state, less).otherwise(weight), F.when(F.col("status") == state, f"{state}-task-boundary-diff").otherwise(kind)
    return each.select(F.col("run_id").alias("source_id"), target.alias("target_id"), relation.alias("relation"), F.when(F.col("change") == "renamed", F.regexp_replace(kind, "task-boundary-diff", "captured-rename")).otherwise(kind).alias("kind"), F.lit("captured").alias("mode"), F.lit("captured-run").alias("signal_group"), weight.alias("weight"), F.lit(True).alias("active"), F.coalesce(cause, F.lit(False)).alias("exact_allowed"), F.when(cause, "confirmation").otherwise("observation").alias("basis"))
