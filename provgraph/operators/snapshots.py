"""Snapshots, their differences, runs and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of two snapshots (path, bytes, sha256): created, deleted, modified; renames stay both."""
    b, a = (df.select("path", F.col("bytes").alias(f"{n}_bytes"), F.col("sha256").alias(f"{n}_sha"), F.lit(True).alias(n)) for df, n in ((before, "b"), (after, "a")))
    both = b.join(a, "path", "full_outer")
    change = F.when(F.col("b").isNull(), "created").when(F.col("a").isNull(), "deleted").when(~F.col("b_sha").eqNullSafe(F.col("a_sha")) | ~F.col("b_bytes").eqNullSafe(F.col("a_bytes")), "modified")
    return both.select("path", change.alias("change"), "b_sha", "a_sha").where("change is not null")


def renames(changes: DataFrame) -> DataFrame:
    """(path_from, path_to, sha256): contents deleted at one path only and created at one only."""
    gone = changes.where("change = 'deleted' and b_sha is not null").groupBy(F.col("b_sha").alias("sha256")).agg(F.count("*").alias("n"), F.min("path").alias("path_from"))
    come = changes.where("change = 'created' and a_sha is not null").groupBy(F.col("a_sha").alias("sha256")).agg(F.count("*").alias("m"), F.min("path").alias("path_to"))
    return gone.where("n = 1").join(come.where("m = 1"), "sha256").select("path_from", "path_to", "sha256")


def incremental_plan(before: DataFrame, after: DataFrame) -> DataFrame:
    """(state, n): files added, changed, deleted and reused between two listings (path, bytes, mtime_ns)."""
    b, a = (df.select("path", F.struct("bytes", "mtime_ns").alias(n)) for df, n in ((before, "b"), (after, "a")))
    state = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "deleted").when(F.col("a") == F.col("b"), "reused").otherwise("changed")
    return b.join(a, "path", "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def current_versions(versions: DataFrame) -> DataFrame:
    """(artifact_id, version_id): the version last observed, of equal times the largest id."""
    return versions.groupBy("artifact_id").agg(F.max_by("version_id", F.struct("observed_at", "version_id")).alias("version_id"))


def fold_decisions(log: DataFrame) -> DataFrame:
    """(claim_id, status) after a log (claim_id, seq, action: confirm, reject or undo, undoes: the seq of a decision).

    A rejection makes a claim rejected; taking it back makes it active, unless another rejection is still in
    force; taking a confirmation back makes it withdrawn. The last such change holds. Of several undos of
    one decision the first counts; one of no decision, or before it, does nothing.
    """
    undo = log.where("action = 'undo'").groupBy(F.col("undoes").alias("seq")).agg(F.min("seq").alias("undone"))
    d = log.where("action <> 'undo'").select("claim_id", "seq", (F.col("action") == "reject").alias("no")).join(undo, "seq", "left")
    made = F.struct("seq", F.col("no").cast("int").alias("up"), F.when(F.col("no"), "rejected").alias("status"))
    back = F.struct(F.col("undone").alias("seq"), (-F.col("no").cast("int")).alias("up"), F.when(F.col("no"), "active").otherwise("withdrawn").alias("status"))
    events = d.select("claim_id", F.inline(F.array_compact(F.array(made, F.when(F.col("undone") > F.col("seq"), back)))))
    open_ = F.sum("up").over(Window.partitionBy("claim_id").orderBy("seq"))
    told = events.withColumn("open", open_).withColumn("status", F.when((F.col("status") == "active") & (F.col("open") > 0), None).otherwise(F.col("status")))
    return told.groupBy("claim_id").agg(F.coalesce(F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))), F.lit("active")).alias("status"))


def reconcile_virtual(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """Claims with ends at ``@missing/…`` moved to the real node of that path, where one exists."""
    real = nodes.where(~F.col("path").startswith("@")).select("path", "id")
    out = claims
    for end in ("source_id", "target_id"):
        known = real.select(F.concat(F.lit("@missing/"), F.col("path")).alias(end), F.col("id").alias("real"))
        out = out.join(known, end, "left").withColumn(end, F.coalesce("real", end)).drop("real")
    return out


def run_states(events: DataFrame) -> DataFrame:
    """(key, state, n_starts): open, closed or untouched boundaries of an event log (key, seq, type).

    ``start`` opens, ``stop`` closes; a start while open changes nothing.
    """
    last = F.max_by("type", F.when(F.col("type").isin("start", "stop"), F.col("seq")))
    return events.groupBy("key").agg(F.when(F.count_if(F.col("type").isin("start", "stop")) == 0, "untouched").when(last == "start", "open").otherwise("closed").alias("state"), F.count_if(F.col("type") == "start").alias("n_starts"))
