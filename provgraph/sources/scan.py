"""Listing a workspace, and refreshing an index of it: only what changed is read again."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provgraph.functions.paths import basename, excluded, kind

#: Version of the rules by which files are recognised; files indexed under another one are read again.
RECOGNITION = 3
#: Largest file whose digest is taken.
DIGEST_BYTES = 50 << 20


def listing(spark: SparkSession, root: str, exclude: list[str] = (), secret: list[str] = (), include: list[str] = (), digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """(path, size, mtime_ns, kind, content, sha256) of the files below a folder, paths relative to it.

    Excluded and secret globs are tested on the path before content is used, so Spark reads no content of
    such files. A file above ``digest_bytes`` has no digest. Spark's reader lists no empty files.
    """
    top = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(top)
    marked = F.concat(F.regexp_replace(F.lit(top), "^file:/*", "/"), F.lit("/"))
    plain = F.regexp_replace(F.col("path"), "^file:/*", "/")
    rows = found.select(F.when(F.startswith(plain, marked), F.substr(plain, F.length(marked) + 1)).otherwise(plain).alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "content")
    rows = rows.where(~excluded(F.col("path"), list(include), list(exclude), list(secret)))
    return rows.withColumn("kind", kind(F.col("path"))).withColumn("sha256", digest(F.col("content"), F.col("size"), digest_bytes))


def digest(content: Column, size: Column, most: int = DIGEST_BYTES) -> Column:
    """The digest of a file's bytes; null above a size."""
    return F.when(size <= most, F.sha2(content, 256))


def refresh_plan(indexed: DataFrame, current: DataFrame, extractors: str, renames: DataFrame | None = None) -> DataFrame:
    """(path, artifact_id, state, previous_path) of an index against a listing (path, size, mtime_ns, sha256).

    States: reused (size, time, recognition and extractor versions are as indexed), changed, added,
    deleted, renamed. A path that went keeps its id under a new path if ``renames`` (path_from, path_to)
    declares it once, or else if one deleted and one added file alone have its digest.
    """
    b = indexed.select("path", "artifact_id", F.col("size").alias("b_size"), F.col("mtime_ns").alias("b_time"), F.col("sha256").alias("b_sha"), ((F.col("recognition") == RECOGNITION) & (F.col("extractors") == extractors)).alias("b_same"))
    a = current.select("path", "size", "mtime_ns", "sha256", F.lit(True).alias("here"))
    both = b.join(a, "path", "full_outer")
    same = (F.col("b_size") == F.col("size")) & (F.col("b_time") == F.col("mtime_ns")) & F.col("b_same")
    state = F.when(F.col("here").isNull(), "deleted").when(F.col("artifact_id").isNull(), "added").when(F.coalesce(same, F.lit(False)), "reused").otherwise("changed")
    both = both.select("path", "artifact_id", "b_sha", "sha256", state.alias("state"))
    gone, come = both.where("state = 'deleted'"), both.where("state = 'added'")
    lone = lambda df, by, name: df.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("sha256")).agg(F.min("path").alias(name), F.count("*").alias("n")).where("n = 1").drop("n")
    by_digest = lone(gone, "b_sha", "path_from").join(lone(come, "sha256", "path_to"), "sha256").select("path_from", "path_to", F.lit(1).alias("rank"))
    moved = by_digest
    if renames is not None:
        once = lambda by: renames.groupBy(by).agg(F.count("*").alias("n")).where("n = 1").select(by)
        declared = renames.join(once("path_from"), "path_from", "left_semi").join(once("path_to"), "path_to", "left_semi")
        declared = declared.join(gone.select(F.col("path").alias("path_from")), "path_from", "left_semi").join(come.select(F.col("path").alias("path_to")), "path_to", "left_semi")
        declared = declared.select("path_from", "path_to")
        rest = by_digest.join(declared.select("path_from"), "path_from", "left_anti").join(declared.select("path_to"), "path_to", "left_anti")
        moved = declared.withColumn("rank", F.lit(0)).unionByName(rest)
    ids = gone.select(F.col("path").alias("path_from"), F.col("artifact_id").alias("kept"))
    moved = moved.drop("rank").join(ids, "path_from")
    out = both.select("path", "artifact_id", "state").join(moved.select(F.col("path_to").alias("path"), F.col("path_from").alias("previous_path"), "kept"), "path", "left").join(moved.select(F.col("path_from").alias("path"), F.lit(True).alias("left_it")), "path", "left")
    out = out.where(F.col("left_it").isNull())
    return out.select("path", F.coalesce("artifact_id", "kept", F.concat(F.lit("file:"), F.left(F.sha2(F.col("path"), 256), F.lit(24)))).alias("artifact_id"), F.when(F.col("kept").isNotNull(), "renamed").otherwise(F.col("state")).alias("state"), "previous_path")


def to_extract(plan: DataFrame, current: DataFrame, cache: DataFrame, adapter: str, version: str) -> DataFrame:
    """Files (path, sha256) that an adapter has to read: new or changed ones, unless the cache (path, sha256, adapter, version) has the same path with the same digest."""
    fresh = plan.where("state in ('added', 'changed', 'renamed')").select("path").join(current, "path")
    known = cache.where((F.col("adapter") == adapter) & (F.col("version") == version)).select("path", "sha256")
    return fresh.join(known, ["path", "sha256"], "left_anti")


def scan(spark: SparkSession, root: str, indexed: DataFrame, extractors: str, renames: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(index, plan): the refreshed index of a folder, deleted files marked, and what became of each path."""
    current = listing(spark, root, **options)
    plan = refresh_plan(indexed.where(~F.coalesce("deleted", F.lit(False))), current, extractors, renames)
    here = plan.where("state <> 'deleted'").join(current.drop("content"), "path")
    held = here.select("path", "artifact_id", "kind", "size", "mtime_ns", "sha256", F.lit(RECOGNITION).alias("recognition"), F.lit(extractors).alias("extractors"), F.lit(False).alias("deleted"))
    gone = indexed.join(held.select("artifact_id"), "artifact_id", "left_anti").withColumn("deleted", F.lit(True)).select(*held.columns)
    return held.unionByName(gone), plan


def git_renames(spark: SparkSession, root: str, commits: int = 200) -> DataFrame:
    """(path_from, path_to, commit) of renames that git tells of the last commits; none outside a repository."""
    try:
        told = subprocess.run(["git", "-C", str(Path(root)), "log", f"-{commits}", "--name-status", "-M", "--diff-filter=R", "--format=%x00%H"], capture_output=True, text=True, timeout=30, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        told = ""
    rows = []
    for block in told.split("\0")[1:]:
        commit, *lines = block.strip().split("\n")
        rows += [(*line.split("\t")[1:3], commit) for line in lines if line.startswith("R")]
    return spark.createDataFrame(rows, "path_from string, path_to string, commit string")


def rename_edges(renames: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Evidence of renames between known paths."""
    end = lambda name, key: artifacts.select(F.col("path").alias(key), F.col("artifact_id").alias(name))
    found = renames.join(end("source_id", "path_from"), "path_from").join(end("target_id", "path_to"), "path_to")
    return found.select("source_id", "target_id", F.lit("observed_rename").alias("relation"), F.lit("git-rename").alias("kind"), F.lit("git").alias("signal_group"), F.lit(0.90).alias("weight"))


def names(path: Column) -> Column:
    return basename(path)
