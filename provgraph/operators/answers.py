"""Answers about origins, runs and files, for all targets at once; one target is a filter on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provgraph.functions.enums import EDITABLE, EXPORTED, KINDS, PRODUCERS, UPSTREAM
from provgraph.functions.paths import suffix
from provgraph.functions.scoring import verified
from provgraph.operators import graph


def producers(claims: DataFrame, minimum: float = 0.3) -> DataFrame:
    """Every producer of every target (target_id, rank, source_id, relation, score, priority, assurance, best, unique_producer).

    Ranked by score, evidence priority and source; best is the only verified one if there is just one,
    else the first.
    """
    priority = F.col("priority") if "priority" in claims.columns else F.lit(6)
    found = claims.where((F.col("score") >= minimum) & F.col("relation").isin(PRODUCERS)).withColumn("priority", priority).withColumn("sure", F.coalesce(verified(F.col("relation"), F.col("assurance")), F.lit(False)))
    every = Window.partitionBy("target_id")
    order = every.orderBy(F.desc("score"), "priority", "source_id", "relation")
    found = found.withColumn("rank", F.row_number().over(order)).withColumn("unique_producer", F.count_if("sure").over(every) == 1)
    return found.select("target_id", "rank", "source_id", "relation", "score", "priority", "assurance", F.when(F.col("unique_producer"), F.col("sure")).otherwise(F.col("rank") == 1).alias("best"), "unique_producer")


def why(claims: DataFrame, minimum: float = 0.3, depth: int = 3) -> DataFrame:
    """``producers`` with the chain of what is upstream of each: (…, chain), ids from the farthest one to the target.

    Each step takes the best edge among relations that carry an origin, ties to the smaller source; a
    step goes back to a node that the chain has been at, as no cycle is guarded against.
    """
    out = producers(claims, minimum).withColumn("chain", F.array("source_id", "target_id"))
    up = claims.where((F.col("score") >= minimum) & F.col("relation").isin(UPSTREAM))
    up = up.groupBy(F.col("target_id").alias("node")).agg(F.min(F.struct((-F.col("score")).alias("s"), "source_id")).alias("m")).select("node", F.col("m.source_id").alias("before"))
    for _ in range(max(0, depth - 1)):
        out = out.join(up, F.element_at("chain", 1) == F.col("node"), "left").withColumn("chain", F.when(F.col("before").isNotNull(), F.concat(F.array("before"), F.col("chain"))).otherwise(F.col("chain"))).drop("node", "before")
    return out


def conclusion(sure: Column, source: Column, found: Column) -> Column:
    """What can be said of a target's origin."""
    told = F.concat(F.lit("Verified: "), F.coalesce(source, F.lit("recorded activity")), F.lit(" produced this artifact version."))
    return F.when(sure, told).when(found, "Candidate origins exist, but none is a unique verified producer.").otherwise("No supported origin claim was found.")


def edge_conclusion(relation: Column, assured: Column, active: Column) -> Column:
    """What can be said of one claim."""
    said = F.when(~active, "This claim is not active.").when(F.coalesce(verified(relation, assured), F.lit(False)), "Verified: a recorded activity caused this relation.")
    said = said.when(assured == "strong-candidate", "Strong evidence, but causality is not verified.").when(assured.isin("candidate", "weak-signal"), "A relationship is supported, but causality is not verified.")
    return said.otherwise("Evidence is insufficient.")


def alternatives(claims: DataFrame, minimum: float = 0.0) -> DataFrame:
    """``producers`` at any score with ``tied``: whether the first two have one score, and so none is unique."""
    found = producers(claims, minimum)
    best = Window.partitionBy("target_id").orderBy("rank")
    second = F.max(F.when(F.col("rank") == 2, F.col("score"))).over(Window.partitionBy("target_id"))
    tied = F.coalesce(F.first("score").over(best) == second, F.lit(False))
    return found.withColumn("tied", tied).withColumn("unique_producer", F.col("unique_producer") & ~F.col("tied"))


def receipt(changes: DataFrame, artifacts: DataFrame, versions: DataFrame) -> DataFrame:
    """(run_id, change, path, previous_path, artifact_id, version_id): every path that a run changed, with its current version.

    ``changes``: (run_id, change, path, previous_path). Paths that are no artifact's have nulls.
    """
    current = versions.groupBy("artifact_id").agg(F.max_by("version_id", F.struct("observed_at", "version_id")).alias("version_id"))
    known = artifacts.select("path", "artifact_id").join(current, "artifact_id", "left")
    return changes.join(known, "path", "left").select("run_id", "change", "path", "previous_path", "artifact_id", "version_id")


def run_show(runs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Runs with their clusters (label, n_members) as a sorted array."""
    held = clusters.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("label", "n_members"))).alias("clusters"))
    return runs.join(held, "run_id", "left")


def agent_run(runs: DataFrame, changes: DataFrame, run_id: str | None = None) -> DataFrame:
    """(run_id, prefix, file_count) of the paths that a run changed, by default the last one to end."""
    from provgraph.operators.filesets import tree_rollup
    from provgraph.operators.store import latest_run

    one = latest_run(runs) if run_id is None else runs.where(F.col("run_id") == run_id)
    mine = changes.join(F.broadcast(one.select("run_id").limit(1)), "run_id", "left_semi")  # one row
    return tree_rollup(mine.select("path"))


def reproduce(claims: DataFrame, runs: DataFrame) -> DataFrame:
    """(target_id, status, working_directory, command): a plan to make each target again; nothing is ever run.

    ready: its best producer is verified and its run's command is known whole; manual-review: the command
    is missing or redacted; insufficient-evidence: no verified producer.
    """
    best = producers(claims, 0.0).where("best")
    sure = F.coalesce(verified(F.col("relation"), F.col("assurance")), F.lit(False))
    held = best.select("target_id", F.col("source_id").alias("run_id"), sure.alias("sure")).join(runs.select("run_id", "cwd", "command"), "run_id", "left")
    whole = (F.coalesce(F.size("command"), F.lit(0)) > 0) & ~F.exists(F.coalesce("command", F.array()), lambda x: x.contains("[REDACTED]"))
    status = F.when(~F.col("sure"), "insufficient-evidence").when(whole, "ready").otherwise("manual-review")
    shown = F.when(F.col("sure"), F.col("command"))
    return held.select("target_id", status.alias("status"), F.when(F.col("sure"), F.coalesce("cwd", F.lit("."))).alias("working_directory"), shown.alias("command"))


def file_history(claims: DataFrame, targets: DataFrame, minimum: float = 0.3, depth: int = 5) -> DataFrame:
    """(target_id, side, other_id, relation, score, depth): what each target comes from, and all that comes from it."""
    wanted = targets.select("target_id").distinct()
    up = producers(claims, minimum).join(wanted, "target_id", "left_semi").select("target_id", F.lit("upstream").alias("side"), F.col("source_id").alias("other_id"), "relation", "score", F.lit(1).alias("depth"))
    down = graph.impact(claims, wanted.select(F.col("target_id").alias("root_id")), minimum, depth)
    return up.unionByName(down.select(F.col("root_id").alias("target_id"), F.lit("downstream").alias("side"), F.col("target_id").alias("other_id"), "relation", "score", "depth"))


def source_chain(claims: DataFrame, targets: DataFrame, minimum: float = 0.3, steps: int = 8) -> DataFrame:
    """(target_id, n_steps, chain): the strongest edges backward from each target, from the farthest node on."""
    moved = graph.walk(claims, targets.select(F.col("target_id").alias("start_id")).distinct(), minimum, steps, forward=False)
    return moved.groupBy(F.col("start_id").alias("target_id")).agg(F.count("*").alias("n_steps"), F.reverse(F.array_sort(F.collect_list(F.struct("step", "source_id")))).alias("s")).select("target_id", "n_steps", F.array_join(F.concat("s.source_id", F.array("target_id")), ">").alias("chain"))


def kind_pairs(claims: DataFrame, artifacts: DataFrame, sources: list[str], targets: list[str], minimum: float = 0.3) -> DataFrame:
    """(source, target, relation, assurance) of claims between paths of two sets of suffixes.

    Both ends are filtered before they are joined.
    """
    end = lambda name, kinds: artifacts.where(F.lower(suffix(F.col("path"))).isin(kinds)).select(F.col("artifact_id").alias(f"{name}_id"), F.col("path").alias(name))
    kept = claims.where(F.col("score") >= minimum)
    return kept.join(end("source", sources), "source_id").join(end("target", targets), "target_id").select("source", "target", "relation", "assurance")


def code_to_image(claims: DataFrame, artifacts: DataFrame, minimum: float = 0.3) -> DataFrame:
    return kind_pairs(claims, artifacts, [*KINDS["code"], "ipynb"], KINDS["image"], minimum)


def document_export(claims: DataFrame, artifacts: DataFrame, minimum: float = 0.3) -> DataFrame:
    return kind_pairs(claims, artifacts, EDITABLE, EXPORTED, minimum)


#: Views by name; each takes its own tables.
VIEWS = {"source-chain": source_chain, "file-history": file_history, "code-to-image": code_to_image, "document-export": document_export, "agent-run": agent_run, "pipeline": graph.pipeline_chains, "orphans": graph.orphans}


def view(name: str, *tables, **options) -> DataFrame:
    if name not in VIEWS:
        raise KeyError(f"no view {name}; there are {', '.join(sorted(VIEWS))}")
    return VIEWS[name](*tables, **options)
