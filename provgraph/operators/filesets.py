"""File-set analytics over artifacts (artifact_id, path, kind, sha256, …)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provgraph.functions.paths import basename, directory, prefixes, series, stem, suffix, template


def duplicates(artifacts: DataFrame) -> DataFrame:
    """(sha256, n, paths): contents that stand at several paths; sorted and joined."""
    return artifacts.groupBy("sha256").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths")).where("n > 1")


def sweeps(artifacts: DataFrame, least: int = 3) -> DataFrame:
    """(directory, template, member_count): names that differ in their last number only."""
    p = F.col("path")
    return artifacts.groupBy(directory(p).alias("directory"), F.concat(series(stem(p)), F.lit("."), suffix(p)).alias("template")).agg(F.count("*").alias("member_count")).where(F.col("member_count") >= least)


def project_map(artifacts: DataFrame) -> DataFrame:
    """(directory, file_count, kinds): how many files of which kinds."""
    return artifacts.groupBy(directory(F.col("path")).alias("directory")).agg(F.count("*").alias("file_count"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def tree_rollup(artifacts: DataFrame) -> DataFrame:
    """(prefix, file_count): files at or below every directory; counted per directory before prefixes multiply rows."""
    leaves = artifacts.groupBy(directory(F.col("path")).alias("d")).count()
    every = leaves.select(F.explode(F.array_distinct(prefixes(F.concat("d", F.lit("/x"))))).alias("prefix"), "count")
    return every.groupBy("prefix").agg(F.sum("count").alias("file_count"))


def conventions(artifacts: DataFrame) -> DataFrame:
    """(suffix, usual_directory, share, total, scattered_across): where files of each suffix mostly are.

    Suffixes of two files or more; ties of directories go to the one whose first path comes first.
    """
    p = F.col("path")
    each = artifacts.where(suffix(p) != "").groupBy(suffix(p).alias("suffix"), directory(p).alias("d")).agg(F.count("*").alias("n"), F.min("path").alias("first"))
    out = each.groupBy("suffix").agg(F.sum("n").alias("total"), F.count("*").alias("scattered_across"), F.min(F.struct((-F.col("n")).alias("n"), "first", "d")).alias("m"))
    return out.where("total >= 2").select("suffix", F.col("m.d").alias("usual_directory"), F.round(-F.col("m.n") / F.col("total"), 2).alias("share"), "total", "scattered_across")


# Tokens of names that accrete instead of being replaced.
DRIFT = r"(?i)(?:^|[-_.\s])(?:final|finalfinal|new|old|copy|backup|bak|tmp|temp|draft|v\d+|version\d+|\d{4}-\d{2}-\d{2}|\d{8})(?:$|[-_.\s])"


def layout_findings(artifacts: DataFrame, crowded: int = 40, long: int = 60, deep: int = 6) -> DataFrame:
    """(finding, n): lone files, long and drifting names, deep paths, crowded directories."""
    p = F.col("path")
    own = artifacts.agg(F.count_if(F.length(basename(p)) > long).alias("long_name"), F.count_if(F.size(F.split(p, "/")) > deep).alias("deep_path"), F.count_if(basename(p).rlike(DRIFT)).alias("drift_name"))
    dirs = artifacts.groupBy(directory(p).alias("d")).count().agg(F.count_if(F.col("count") == 1).alias("single_file"), F.count_if(F.col("count") >= crowded).alias("crowded"))
    flat = lambda df: df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*df.columns))).alias("finding", "n"))
    return flat(own).unionByName(flat(dirs))


def suggest_placement(requests: DataFrame, artifacts: DataFrame, least_share: float = 0.67) -> DataFrame:
    """(requested, status, suggested_path, basis) for each requested path.

    An existing path stays; a name that stands at one path only goes there; else the usual directory of
    its suffix if its share is large enough; else there is not enough evidence.
    """
    p = F.col("path")
    names = artifacts.groupBy(basename(p).alias("name")).agg(F.count("*").alias("n"), F.min("path").alias("only"))
    r = requests.select("requested", basename(F.col("requested")).alias("name"), suffix(F.col("requested")).alias("suffix"))
    r = r.join(artifacts.select(F.col("path").alias("requested")).distinct().withColumn("exists", F.lit(True)), "requested", "left").join(names, "name", "left").join(conventions(artifacts), "suffix", "left")
    many, usual = F.col("n") > 1, F.col("share") >= least_share
    status = F.when(F.col("exists"), "existing").when(F.col("n") == 1, "existing-name").when(many, "insufficient-evidence").when(usual, "convention").otherwise("insufficient-evidence")
    target = F.concat("usual_directory", F.when(F.col("usual_directory") != "", "/").otherwise(""), "name")
    path = F.when(F.col("exists"), F.col("requested")).when(F.col("n") == 1, F.col("only")).when(many, None).when(usual, target)
    basis = F.when(F.col("exists"), "path").when(F.col("n") == 1, "name").when(many, "several directories").when(usual, "suffix").otherwise("none")
    return r.select("requested", status.alias("status"), path.alias("suggested_path"), basis.alias("basis"))


def run_clusters(changes: DataFrame, least: int = 10) -> DataFrame:
    """(run_id, label, n_members, representatives): families of paths that a run created.

    A family shares directory, suffix in lower case and the template of its names. Representatives: the
    first three, the middle and the last.
    """
    p = F.col("path")
    ext = F.when(suffix(p) != "", F.concat(F.lit("."), F.lower(suffix(p)))).otherwise("")
    label = F.concat(F.when(directory(p) != "", directory(p)).otherwise("."), F.lit("/"), template(stem(p)), F.lit("*"), ext)
    out = changes.where("change = 'created'").groupBy("run_id", label.alias("label")).agg(F.array_sort(F.collect_set("path")).alias("m"))
    n = F.size("m")
    shown = F.array_distinct(F.concat(F.slice("m", 1, 3), F.array(F.element_at("m", F.floor(n / 2).cast("int") + 1), F.element_at("m", -1))))
    return out.where(n >= least).select("run_id", "label", n.cast("long").alias("n_members"), F.array_join(shown, ",").alias("representatives"))


def timeline(events: DataFrame) -> DataFrame:
    """(at, path, what, event, previous): events in order of time and path, each with the one before it of its kind.

    The one before is looked up within a day, and for the first of a day it is the last of the day before
    that has any, so no kind is sorted in one task.
    """
    e = events.select("at", "path", "what", "event", F.to_date("at").alias("day"))
    last = e.groupBy("what", "day").agg(F.max(F.struct("at", "path")).alias("m"))
    carried = last.select("what", "day", F.lag("m.path").over(Window.partitionBy("what").orderBy("day")).alias("carried"))  # a row a day
    within = F.lag("path").over(Window.partitionBy("what", "day").orderBy("at", "path"))
    return e.withColumn("within", within).join(carried, ["what", "day"]).select("at", "path", "what", "event", F.coalesce("within", "carried").alias("previous"))
