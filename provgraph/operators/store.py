"""Readers and writers of the claim store: ordered lists, lookups, search, decisions, supersession, rebuilds.

Append-only tables (evidence, decisions, transitions, versions) are the truth; claims and all that follows
from them are computed anew and written beside the old table, which is then swapped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provgraph.functions.paths import basename, path_key, short_id, suffix

#: Tables that a rebuild keeps; all others are derived.
PRESERVED = ["artifacts", "versions", "locations", "digests", "aliases", "runs", "transitions", "evidence", "decisions"]


def real(path: str = "path", deleted: str | None = "deleted") -> Column:
    """Whether a row is a file rather than a virtual node, and not deleted."""
    there = ~F.col(path).startswith("@")
    return there & ~F.coalesce(F.col(deleted), F.lit(False)) if deleted else there


def files(artifacts: DataFrame, include_deleted: bool = False) -> DataFrame:
    """All files by path."""
    return artifacts.where(F.lit(include_deleted) | ~F.coalesce("deleted", F.lit(False))).orderBy("path", "artifact_id")


def lookup(artifacts: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """The artifacts whose path, id or digest is one of ``values`` (one column of that name)."""
    return artifacts.join(values.select(column).distinct(), column, "left_semi")


def edges(claims: DataFrame, minimum: float = 0.0, include_inactive: bool = False) -> DataFrame:
    """Claims of at least a score, active ones unless asked, the best first, then by id."""
    kept = claims.where(F.col("score") >= minimum)
    kept = kept if include_inactive or "status" not in claims.columns else kept.where("status = 'active'")
    return kept.orderBy(F.desc("score"), "claim_id")


def resolve(requests: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(requested, artifact_id): the artifact at a path, else the only one whose path ends in it, else null.

    Every tail of a path at a slash is a key, so no request meets every path.
    """
    exact = artifacts.select(F.col("path").alias("requested"), F.col("artifact_id").alias("exact"))
    parts = F.split("path", "/")
    tails = artifacts.select("artifact_id", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.when(i <= F.size(parts), F.array_join(F.slice(parts, i, F.size(parts)), "/")))).alias("tail")).where("tail is not null")
    asked = requests.select("requested").distinct()
    only = tails.join(asked, F.col("tail") == F.col("requested"), "left_semi").groupBy(F.col("tail").alias("requested")).agg(F.min("artifact_id").alias("one"), F.count("*").alias("n"))
    found = asked.join(exact, "requested", "left").join(only, "requested", "left")
    return found.select("requested", F.coalesce("exact", F.when(F.col("n") == 1, F.col("one"))).alias("artifact_id"))


def by_alias(aliases: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(alias, artifact_id): what an alias was last seen to stand for; ties to the larger id."""
    last = aliases.groupBy("alias").agg(F.max_by("artifact_id", F.struct("last_seen", "artifact_id")).alias("artifact_id"))
    return last.join(artifacts.select("artifact_id"), "artifact_id", "left_semi").select("alias", "artifact_id")


def texts(records: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Text records of files that are not deleted."""
    return records.join(artifacts.where(~F.coalesce("deleted", F.lit(False))).select(F.col("artifact_id").alias("file_id"), "path"), "file_id")


def replace_texts(records: DataFrame, fresh: DataFrame) -> DataFrame:
    """Text records with those of every file in ``fresh`` (file_id, source, …) replaced."""
    return records.join(fresh.select("file_id").distinct(), "file_id", "left_anti").unionByName(fresh)


def decorated(claims: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Claims with the paths of both ends, null where an end is no artifact."""
    end = lambda name: artifacts.select(F.col("artifact_id").alias(f"{name}_id"), F.col("path").alias(f"{name}_path"))
    return claims.join(end("source"), "source_id", "left").join(end("target"), "target_id", "left")


def names_containing(artifacts: DataFrame, term: str) -> DataFrame:
    """Artifacts whose path or label has a term in it, in any case."""
    held = F.lower(F.lit(term))
    return artifacts.where(F.contains(F.lower("path"), held) | F.contains(F.lower("label"), held))


def find(artifacts: DataFrame, term: str, records: DataFrame, kind: str | None = None, status: str | None = None, paths: DataFrame | None = None, since: str | None = None, until: str | None = None, limit: int | None = None) -> DataFrame:
    """(artifact_id, path, matched): files by name or by text, each once, with what matched.

    Filters: kind; status current or deleted; ``paths`` (path) of a run; last_seen from ``since`` to
    ``until``, both included, compared as text.
    """
    named = names_containing(artifacts, term).select("artifact_id", F.lit("filename").alias("by_name"))
    told = records.where(F.contains(F.lower("text"), F.lower(F.lit(term)))).select(F.col("file_id").alias("artifact_id"), F.lit("text").alias("by_text")).distinct()
    matched = named.join(told, "artifact_id", "full_outer").select("artifact_id", F.array_join(F.array_compact(F.array("by_name", "by_text")), ",").alias("matched"))
    found = artifacts.join(matched, "artifact_id")
    deleted = F.coalesce(F.col("deleted"), F.lit(False))
    for on, test in ((kind, F.col("kind") == kind), (since, F.col("last_seen") >= since), (until, F.col("last_seen") <= until)):
        found = found.where(test) if on is not None else found
    found = found.where(deleted) if status == "deleted" else found.where(~deleted)
    found = found.join(paths.select("path").distinct(), "path", "left_semi") if paths is not None else found
    found = found.orderBy("path", "artifact_id")
    return (found.limit(limit) if limit is not None else found).select("artifact_id", "path", "matched")


def unsuppressed(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """Claims with status ``rejected`` where an active rejection names the claim or its ends and relation.

    Two joins rather than one on either condition.
    """
    no = decisions.where("action = 'reject' and status = 'active'")
    by_id = no.where("claim_id is not null").select("claim_id", F.lit(True).alias("r1")).distinct()
    key = ["source_id", "target_id", "relation"]
    by_key = no.where("source_id is not null").select(*key, F.lit(True).alias("r2")).distinct()
    found = claims.join(by_id, "claim_id", "left").join(by_key, key, "left")
    status = F.col("status") if "status" in claims.columns else F.lit("active")
    return found.withColumn("status", F.when(F.col("r1") | F.col("r2"), "rejected").otherwise(status)).select(*dict.fromkeys([*claims.columns, "status"]))


def upserted(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Rows of ``stored`` with those of ``fresh`` in their place by key, the last of each (by ``seq``, if given)."""
    if "seq" in fresh.columns:
        fresh = fresh.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))).where("_at = 1").drop("_at", "seq")
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def superseded(claims: DataFrame, rescanned: DataFrame) -> DataFrame:
    """Claims with status ``superseded`` where their source path was scanned again and did not give them anew.

    ``rescanned``: (source_path, claim_id) of all paths scanned, claim_id null for paths that gave none.
    """
    again = rescanned.where("claim_id is not null").select("claim_id", F.lit(True).alias("again")).distinct()
    seen = rescanned.select("source_path", F.lit(True).alias("seen")).distinct()
    found = claims.join(again, "claim_id", "left").join(seen, "source_path", "left")
    gone = F.coalesce(F.col("seen"), F.lit(False)) & F.col("again").isNull() & (F.col("status") == "active")
    return found.withColumn("status", F.when(gone, "superseded").otherwise(F.col("status"))).select(*claims.columns)


def observed_versions(versions: DataFrame, listing: DataFrame) -> DataFrame:
    """Versions (artifact_id, sha256, observed_at) with those of a listing that are new; a known one is not observed again."""
    fresh = listing.where("sha256 is not null").select("artifact_id", "sha256", "observed_at").join(versions.select("artifact_id", "sha256"), ["artifact_id", "sha256"], "left_anti")
    return versions.select("artifact_id", "sha256", "observed_at").unionByName(fresh)


def virtual_nodes(wanted: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(path, artifact_id, kind, label, is_new): ends of claims (path, kind) as artifacts, virtual where none is there.

    A path that is an artifact's is that; any other gets ``@missing/`` before it, unless it is virtual
    already, and one stable id however often it is wanted.
    """
    w = wanted.where("path is not null").groupBy("path").agg(F.min("kind").alias("kind"))
    kind = F.when(F.col("path").startswith("@origin/"), "external-origin").otherwise(F.col("kind"))
    found = w.join(artifacts.select("path", F.col("artifact_id").alias("own")), "path", "left")
    label = F.when(F.col("path").startswith("@"), F.substring_index("path", "/", -1)).otherwise(basename(F.col("path")))
    stands = F.when(F.col("own").isNotNull() | F.col("path").startswith("@"), F.col("path")).otherwise(F.concat(F.lit("@missing/"), F.col("path")))
    node = F.when(kind == "file", "missing-file").otherwise(kind)
    return found.select("path", F.coalesce("own", short_id(kind, F.col("path"))).alias("artifact_id"), node.alias("kind"), label.alias("label"), stands.alias("virtual_path"), F.col("own").isNull().alias("is_new"))


def resolved_candidates(candidates: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Candidates (source_path, target_path, relation, …) with source_id and target_id."""
    ends = candidates.select(F.inline(F.array(F.struct(F.col("source_path").alias("path"), F.lit("file").alias("kind")), F.struct(F.col("target_path").alias("path"), F.lit("file").alias("kind")))))
    ids = virtual_nodes(ends, artifacts).select("path", "artifact_id")
    out = candidates
    for end in ("source", "target"):
        out = out.join(ids.withColumnsRenamed({"path": f"{end}_path", "artifact_id": f"{end}_id"}), f"{end}_path")
    return out


def transitions(states: DataFrame) -> DataFrame:
    """(run_id, seq, status) where a run's status changed, from every status told (run_id, seq, status)."""
    before = F.lag("status").over(Window.partitionBy("run_id").orderBy("seq"))
    return states.withColumn("before", before).where(~F.col("status").eqNullSafe(F.col("before")) | F.col("before").isNull()).select("run_id", "seq", "status")


def latest_run(runs: DataFrame) -> DataFrame:
    """The finalised run that ended last, ties to the larger id; no row without one."""
    done = runs.where(F.col("status").isin("completed", "failed", "interrupted", "recovered", "incomplete"))
    return done.orderBy(F.desc("finished_at"), F.desc("run_id")).limit(1)


def counted(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of the tables that a rebuild preserves."""
    out = None
    for name in PRESERVED:
        if name in tables:
            one = tables[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
            out = one if out is None else out.unionByName(one)
    return out


def prepared_rebuild(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables that are kept; the others empty, to be computed anew."""
    return {name: df if name in PRESERVED else df.limit(0) for name, df in tables.items()}


def adapters_for(artifacts: DataFrame, registry: dict[str, list[str]], enabled: list[str]) -> DataFrame:
    """(artifact_id, adapter): the enabled adapters that take files of a suffix."""
    pairs = [(s, name) for name in enabled for s in registry.get(name, [])]
    if not pairs:
        return artifacts.select("artifact_id", F.lit("").alias("adapter")).limit(0)
    table = artifacts.sparkSession.createDataFrame(pairs, "suffix string, adapter string")  # bounded by the registry
    return artifacts.withColumn("suffix", F.lower(suffix(F.col("path")))).join(F.broadcast(table), "suffix").select("artifact_id", "adapter")


def same_path(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of artifacts of two tables whose paths are the same but for case."""
    key = lambda df, name: df.select(path_key(F.col("path")).alias("key"), F.col("path").alias(name))
    return key(left, "left_path").join(key(right, "right_path"), "key").select("left_path", "right_path")
