"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.functions import text as T
from provgraph.functions.enums import CLASSES, EDITABLE, EXPORTED, PRODUCERS, STALE
from provgraph.operators import claims as C
from provgraph.operators import answers, capture, documents, exports, filesets, graph, search, similarity, snapshots, store
from provgraph.sources import extract, scan
from provgraph.sources.corpus import ctes, table, view
from provgraph.streaming.runs import pending

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


_LABEL = "CASE WHEN score >= 1.0 THEN 'exact' WHEN score >= 0.8 THEN 'strong' WHEN score >= 0.55 THEN 'probable' WHEN score >= 0.3 THEN 'weak' ELSE 'unknown' END"
_ASSURED = "CASE WHEN score >= 1.0 THEN 'verified' WHEN score >= 0.8 THEN 'strong-candidate' WHEN score >= 0.55 THEN 'candidate' WHEN score >= 0.3 THEN 'weak-signal' ELSE 'insufficient' END"
_CLAIMS = ctes("evidence") + f""", grouped AS (
  SELECT source_id, target_id, relation, signal_group, max(CASE WHEN active THEN least(greatest(weight, 0), 0.99) END) AS w, bool_or(active AND exact_allowed AND weight >= 1) AS exact, count(*) AS n,
  bool_or(kind = 'w3c-prov-import') AS prov, bool_or(contains(kind, 'declaration')) AS decl, bool_or(mode = 'captured') AS capt, bool_or(mode = 'imported') AS imp, bool_or(trusted) AS tru, bool_or(mode IN ('static', 'explicit')) AS stat, bool_or(mode = 'content') AS cont
  FROM evidence GROUP BY ALL), scored AS (
  SELECT source_id, target_id, relation, CASE WHEN bool_or(exact) THEN 1.0::DOUBLE ELSE round(least(0.99, 1 - product(1 - coalesce(w, 0))), 4)::DOUBLE END AS score, sum(n)::BIGINT AS n_evidence,
  CASE WHEN bool_or(prov) THEN 3 WHEN bool_or(decl) AND bool_or(capt) THEN 1 WHEN bool_or(capt) THEN 2 WHEN bool_or(imp) AND bool_or(tru) THEN 3 WHEN bool_or(stat) THEN 4 WHEN bool_or(cont) THEN 5 ELSE 6 END AS priority
  FROM grouped GROUP BY ALL), claims AS (SELECT *, {_LABEL} AS confidence, {_ASSURED} AS assurance FROM scored)"""
_EDGES = _CLAIMS + ", " + ctes("declared") + """, edges AS (SELECT source_id, target_id, relation, score, assurance FROM claims
  UNION ALL SELECT source_id, target_id, relation, score::DOUBLE, assurance FROM declared)"""
_WORDS = r"regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+')"
_SHINGLES = "list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))"


def claims(spark, d: str) -> DataFrame:
    return C.fold_evidence(view(spark, d, "evidence"))


def edges(spark, d: str, scored: bool = False) -> DataFrame:
    """``scored``: without claims of score 0, which are those that only inactive evidence is given for; it adds to no score."""
    declared = view(spark, d, "declared").withColumn("score", F.col("score").cast("double"))
    made = C.fold_evidence(view(spark, d, "evidence").where("active")) if scored else claims(spark, d)
    return made.select("source_id", "target_id", "relation", "score", "assurance").unionByName(declared)


def roots(spark, d: str, letter: str, name: str, key: str) -> DataFrame:
    """All nodes of one table."""
    return table(spark, d, name).select(F.concat(F.lit(f"{letter}:"), F.col(key).cast("string")).alias("root_id")).distinct()


@query("score_claims", f"WITH {_CLAIMS} SELECT source_id, target_id, score, confidence, assurance, n_evidence FROM claims")
def score_claims(spark, d):
    return claims(spark, d).drop("relation", "priority")


@query("confidence_histogram", f"WITH {_CLAIMS} SELECT confidence, count(*) AS n_claims FROM claims GROUP BY confidence")
def confidence_histogram(spark, d):
    return claims(spark, d).groupBy("confidence").agg(F.count("*").alias("n_claims"))


_FLAGS = ", ".join(f"coalesce(bool_or(active AND basis = '{b}'), false) AS {b[0]}" for b in ("confirmation", "declaration", "observation", "inference"))


@query("evidence_basis", f"""WITH {ctes("evidence")}, f AS (SELECT source_id, target_id, {_FLAGS} FROM evidence GROUP BY ALL)
SELECT source_id, target_id, CASE WHEN c THEN 'confirmation' WHEN d AND NOT o AND NOT i THEN 'declaration' WHEN o AND NOT i THEN 'observation' ELSE 'inference' END AS basis FROM f""")
def evidence_basis(spark, d):
    return C.claim_basis(view(spark, d, "evidence"))


@query("evidence_observed", f"""WITH {ctes("evidence")} SELECT source_id, target_id, max(observed_at) FILTER (active) AS observed_at, 'origin:' || target_id AS competing_group FROM evidence GROUP BY source_id, target_id""")
def evidence_observed(spark, d):
    return C.evidence_summary(view(spark, d, "evidence")).select("source_id", "target_id", "observed_at", "competing_group")


@query("why_best_producer", f"""WITH {_CLAIMS}, found AS (SELECT *, assurance = 'verified' AS sure FROM claims WHERE score >= 0.3),
counted AS (SELECT *, count(*) FILTER (sure) OVER (PARTITION BY target_id) AS n_sure, count(*) OVER (PARTITION BY target_id) AS n_candidates FROM found),
ranked AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY (sure AND n_sure = 1) DESC, score DESC, priority, source_id) AS at_ FROM counted)
SELECT target_id, source_id AS best_source_id, score, assurance, n_candidates, n_sure = 1 AS unique_producer FROM ranked WHERE at_ = 1""")
def why_best_producer(spark, d):
    return C.best_producer(claims(spark, d))


@query("alternatives_ties", f"""WITH {_CLAIMS}, top AS (SELECT target_id, score, count(*) AS n, rank() OVER (PARTITION BY target_id ORDER BY score DESC) AS r FROM claims GROUP BY target_id, score)
SELECT target_id, score AS top_score, n AS n_tied FROM top WHERE r = 1 AND n > 1""")
def alternatives_ties(spark, d):
    return C.tied_alternatives(claims(spark, d))


_PATHS = ctes("artifacts") + r""", p AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS name,
  regexp_extract(path, '\.([^./]+)$', 1) AS ext, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]+$', '') AS stem FROM artifacts)"""


@query("duplicates", f"WITH {ctes('artifacts')} SELECT sha256, count(*) AS n, string_agg(path, ',' ORDER BY path) AS paths FROM artifacts GROUP BY sha256 HAVING count(*) > 1")
def duplicates(spark, d):
    return filesets.duplicates(view(spark, d, "artifacts"))


@query("sweeps", f"WITH {_PATHS} SELECT dir AS directory, regexp_replace(stem, '\\d+(\\D*)$', '#\\1') || '.' || ext AS template, count(*) AS member_count FROM p GROUP BY ALL HAVING count(*) >= 3")
def sweeps(spark, d):
    return filesets.sweeps(view(spark, d, "artifacts"))


@query("project_map", f"WITH {_PATHS} SELECT dir AS directory, count(*) AS file_count, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds FROM p GROUP BY dir")
def project_map(spark, d):
    return filesets.project_map(view(spark, d, "artifacts"))


@query("tree_rollup", f"""WITH {_PATHS}, x AS (SELECT path, string_split(dir, '/') AS parts FROM p),
e AS (SELECT unnest(list_transform(range(0, len(parts) + 1), lambda i: array_to_string(list_slice(parts, 1, i), '/'))) AS prefix FROM x)
SELECT prefix, count(*) AS file_count FROM e GROUP BY prefix""")
def tree_rollup(spark, d):
    return filesets.tree_rollup(view(spark, d, "artifacts"))


_CONVENTIONS = _PATHS + """, each AS (SELECT ext, dir, count(*) AS n, min(path) AS first_path FROM p GROUP BY ext, dir),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ext ORDER BY n DESC, first_path) AS r, sum(n) OVER (PARTITION BY ext) AS total, count(*) OVER (PARTITION BY ext) AS spread FROM each),
conventions AS (SELECT ext AS suffix, dir AS usual_directory, round(n / total, 2) AS share, total::BIGINT AS total, spread AS scattered_across FROM ranked WHERE r = 1 AND total >= 2)"""


@query("conventions", f"WITH {_CONVENTIONS} SELECT * FROM conventions")
def conventions(spark, d):
    return filesets.conventions(view(spark, d, "artifacts"))


@query("layout_findings", f"""WITH {_PATHS}, dirs AS (SELECT dir, count(*) AS n FROM p GROUP BY dir)
SELECT 'long_name' AS finding, count(*) AS n FROM p WHERE length(name) > 60
UNION ALL SELECT 'deep_path', count(*) FROM p WHERE len(string_split(path, '/')) > 6
UNION ALL SELECT 'drift_name', count(*) FROM p WHERE regexp_matches(name, '(?i)(?:^|[-_.\\s])(?:final|finalfinal|new|old|copy|backup|bak|tmp|temp|draft|v\\d+|version\\d+|\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{8}})(?:$|[-_.\\s])')
UNION ALL SELECT 'single_file', count(*) FROM dirs WHERE n = 1 UNION ALL SELECT 'crowded', count(*) FROM dirs WHERE n >= 40""")
def layout_findings(spark, d):
    return filesets.layout_findings(view(spark, d, "artifacts"))


_ASKED = ["src0/en/new.pdf", "src1/en/sweep_dpi1.pdf", "elsewhere/sweep_dpi1.pdf", "notes.xyz", "img/plot.png"]


@query("suggest_placement", f"""WITH {_CONVENTIONS}, r AS (SELECT requested, regexp_extract(requested, '([^/]*)$', 1) AS name, regexp_extract(requested, '\\.([^./]+)$', 1) AS suffix
  FROM (VALUES {", ".join(f"('{x}')" for x in _ASKED)}) v(requested)), names AS (SELECT name, count(*) AS n, min(path) AS only_path FROM p GROUP BY name),
j AS (SELECT r.*, requested IN (SELECT path FROM p) AS found, n, only_path, share, usual_directory FROM r LEFT JOIN names USING (name) LEFT JOIN conventions USING (suffix))
SELECT requested, CASE WHEN found THEN 'existing' WHEN n = 1 THEN 'existing-name' WHEN n > 1 THEN 'insufficient-evidence' WHEN share >= 0.67 THEN 'convention' ELSE 'insufficient-evidence' END AS status,
 CASE WHEN found THEN requested WHEN n = 1 THEN only_path WHEN n > 1 THEN NULL WHEN share >= 0.67 THEN usual_directory || CASE WHEN usual_directory <> '' THEN '/' ELSE '' END || name END AS suggested_path,
 CASE WHEN found THEN 'path' WHEN n = 1 THEN 'name' WHEN n > 1 THEN 'several directories' WHEN share >= 0.67 THEN 'suffix' ELSE 'none' END AS basis FROM j""")
def suggest_placement(spark, d):
    return filesets.suggest_placement(spark.createDataFrame([(x,) for x in _ASKED], "requested string"), view(spark, d, "artifacts"))


_DIFF = ctes("before_snapshot", "after_snapshot") + """, diff AS (SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'created' WHEN a.path IS NULL THEN 'deleted'
  WHEN b.sha256 IS DISTINCT FROM a.sha256 OR b.bytes IS DISTINCT FROM a.bytes THEN 'modified' END AS change, b.sha256 AS b_sha, a.sha256 AS a_sha
  FROM before_snapshot b FULL JOIN after_snapshot a ON a.path = b.path)"""


def changes(spark, d) -> DataFrame:
    return snapshots.compare(view(spark, d, "before_snapshot"), view(spark, d, "after_snapshot"))


@query("snapshot_diff", f"WITH {_DIFF} SELECT path, change FROM diff WHERE change IS NOT NULL")
def snapshot_diff(spark, d):
    return changes(spark, d).select("path", "change")


@query("rename_detect", f"""WITH {_DIFF}, g AS (SELECT b_sha AS sha256, count(*) AS n, min(path) AS path_from FROM diff WHERE change = 'deleted' GROUP BY b_sha HAVING count(*) = 1),
c AS (SELECT a_sha AS sha256, count(*) AS n, min(path) AS path_to FROM diff WHERE change = 'created' GROUP BY a_sha HAVING count(*) = 1) SELECT path_from, path_to, sha256 FROM g JOIN c USING (sha256)""")
def rename_detect(spark, d):
    return snapshots.renames(changes(spark, d))


@query("incremental_plan", f"""WITH {ctes("before_snapshot", "after_snapshot")} SELECT CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'deleted' WHEN a.bytes = b.bytes AND a.mtime_ns = b.mtime_ns THEN 'reused' ELSE 'changed' END AS state, count(*) AS n
FROM before_snapshot b FULL JOIN after_snapshot a ON a.path = b.path GROUP BY 1""")
def incremental_plan(spark, d):
    return snapshots.incremental_plan(view(spark, d, "before_snapshot"), view(spark, d, "after_snapshot"))


_PARTS = "SELECT p_partkey AS artifact_id, concat('part/run_', cast(p_partkey AS varchar(20)), '.csv') AS path FROM part"


@query("receipt", f"""WITH {ctes("run_changes", "versions")}, parts AS ({_PARTS}), current AS (SELECT artifact_id, arg_max(version_id, (observed_at, version_id)) AS version_id FROM versions GROUP BY artifact_id)
SELECT run_id, change, path, NULL::VARCHAR AS previous_path, artifact_id, version_id FROM run_changes LEFT JOIN parts USING (path) LEFT JOIN current USING (artifact_id)""")
def receipt(spark, d):
    parts = spark.sql(_PARTS.replace("FROM part", "FROM {part}"), part=table(spark, d, "part"))
    changed = view(spark, d, "run_changes").withColumn("previous_path", F.lit(None).cast("string"))
    return answers.receipt(changed, parts, view(spark, d, "versions"))


_RUNS = "SELECT concat('run:', cast(l_orderkey % 50 AS varchar(20))) AS run_id, CASE (l_orderkey % 50) % 6 WHEN 0 THEN 'failed' WHEN 1 THEN 'recovered' WHEN 2 THEN 'incomplete' WHEN 3 THEN 'in_progress' ELSE 'completed' END AS status, (l_orderkey % 50) % 2 = 0 AS direct_runtime FROM lineitem"


@query("run_evidence", f"""WITH {ctes("run_changes")}, parts AS ({_PARTS}), runs AS (SELECT DISTINCT * FROM ({_RUNS})), e AS (SELECT *, direct_runtime AND change IN ('created', 'modified') AND status IN ('completed', 'failed') AS cause FROM run_changes JOIN runs USING (run_id) LEFT JOIN parts USING (path) WHERE status <> 'in_progress')
SELECT run_id AS source_id, artifact_id::VARCHAR AS target_id, CASE WHEN cause THEN 'was_generated_by' ELSE 'observed_' || change || '_during' END AS relation, CASE WHEN status IN ('recovered', 'incomplete') THEN status || '-' ELSE '' END || 'task-boundary-diff' AS kind,
 CASE status WHEN 'recovered' THEN 0.75 WHEN 'incomplete' THEN 0.5 ELSE 1.0 END::DOUBLE AS weight, cause AS exact_allowed, CASE WHEN cause THEN 'confirmation' ELSE 'observation' END AS basis FROM e""")
def run_evidence(spark, d):
    parts = spark.sql(_PARTS.replace("FROM part", "FROM {part}"), part=table(spark, d, "part")).withColumn("artifact_id", F.col("artifact_id").cast("string"))
    runs = spark.sql(_RUNS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, d, "lineitem")).distinct()
    return capture.run_evidence(view(spark, d, "run_changes"), runs, parts).select("source_id", "target_id", "relation", "kind", "weight", "exact_allowed", "basis")


_COMMANDS = "SELECT concat('p:', cast(p_partkey AS varchar(20))) AS run_id, p_brand AS cwd, CASE WHEN p_size % 7 = 0 THEN '--token=[REDACTED]' ELSE p_name END AS word FROM part"


@query("reproduce_plan", f"""WITH {_CLAIMS}, runs AS ({_COMMANDS}), found AS (SELECT *, assurance = 'verified' AS sure FROM claims),
counted AS (SELECT *, count(*) FILTER (sure) OVER (PARTITION BY target_id) AS n_sure FROM found), ranked AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY (sure AND n_sure = 1) DESC, score DESC, priority, source_id, relation) AS r FROM counted)
SELECT target_id, CASE WHEN NOT sure THEN 'insufficient-evidence' WHEN word IS NOT NULL AND NOT contains(word, '[REDACTED]') THEN 'ready' ELSE 'manual-review' END AS status, CASE WHEN sure THEN coalesce(cwd, '.') END AS working_directory, CASE WHEN sure THEN word END AS command FROM ranked LEFT JOIN runs ON run_id = source_id WHERE r = 1""")
def reproduce_plan(spark, d):
    runs = spark.sql(_COMMANDS.replace("FROM part", "FROM {part}"), part=table(spark, d, "part")).select("run_id", "cwd", F.array("word").alias("command"))
    return answers.reproduce(claims(spark, d), runs).withColumn("command", F.array_join("command", " "))


@query("producers_ranked", f"""WITH {_CLAIMS}, found AS (SELECT *, assurance = 'verified' AS sure FROM claims), ranked AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, priority, source_id, relation) AS rank, count(*) FILTER (sure) OVER (PARTITION BY target_id) = 1 AS alone FROM found),
tops AS (SELECT target_id, max(score) FILTER (rank = 1) = max(score) FILTER (rank = 2) AS tied FROM ranked GROUP BY target_id)
SELECT target_id, rank::INTEGER AS rank, source_id, score, priority, CASE WHEN alone THEN sure ELSE rank = 1 END AS best, coalesce(tied, false) AS tied, alone AND NOT coalesce(tied, false) AS unique_producer FROM ranked JOIN tops USING (target_id)""")
def producers_ranked(spark, d):
    return answers.alternatives(claims(spark, d)).select("target_id", "rank", "source_id", "score", "priority", "best", "tied", "unique_producer")


_DOCS = "SELECT concat('doc:', substr(source_id, 3)) AS source_id, concat('doc:', substr(target_id, 3)) AS target_id, relation, score, assurance FROM claims WHERE target_id LIKE 'p:%'"
_ENDS = _PATHS + f", pairs AS (SELECT s.path AS source, t.path AS target, relation, assurance, s.ext AS a, t.ext AS b FROM ({_DOCS}) c JOIN p s ON s.artifact_id = source_id JOIN p t ON t.artifact_id = target_id WHERE score >= 0.3)"


def doc_claims(spark, d: str) -> DataFrame:
    return spark.sql(_DOCS.replace("FROM claims", "FROM {claims}"), claims=claims(spark, d))


@query("code_to_image", f"WITH {_CLAIMS}, {_ENDS} SELECT source, target, relation, assurance FROM pairs WHERE a IN ('py', 'ipynb') AND b = 'png'")
def code_to_image(spark, d):
    return answers.code_to_image(doc_claims(spark, d), view(spark, d, "artifacts"))


@query("document_export", f"WITH {_CLAIMS}, {_ENDS} SELECT source, target, relation, assurance FROM pairs WHERE a IN ('md', 'docx', 'html') AND b IN ('pdf', 'png')")
def document_export(spark, d):
    return answers.document_export(doc_claims(spark, d), view(spark, d, "artifacts"))


@query("file_lookup", f"""WITH {_PATHS}, asked AS (SELECT name AS requested FROM p UNION SELECT path FROM p UNION SELECT 'none/' || name FROM p), tails AS (SELECT artifact_id, unnest(list_transform(range(2, len(string_split(path, '/')) + 1), lambda i: array_to_string(list_slice(string_split(path, '/'), i, 99), '/'))) AS tail FROM p),
alone AS (SELECT tail, min(artifact_id) AS one FROM tails GROUP BY tail HAVING count(*) = 1) SELECT requested, coalesce(p.artifact_id, one) AS artifact_id FROM asked LEFT JOIN p ON p.path = requested LEFT JOIN alone ON tail = requested""")
def file_lookup(spark, d):
    files = view(spark, d, "artifacts")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    asked = files.select(F.explode(F.array(name, "path", F.concat(F.lit("none/"), name))).alias("requested"))
    return store.resolve(asked, files)


@query("find_files", f"""WITH {ctes("artifacts")}, t AS (SELECT doc_id, contains(lower(text), 'license') AS told FROM documents)
SELECT artifact_id, path, CASE WHEN contains(lower(path), 'license') AND told THEN 'filename,text' WHEN told THEN 'text' ELSE 'filename' END AS matched FROM artifacts JOIN t USING (doc_id) WHERE kind = 'document' AND (told OR contains(lower(path), 'license'))""")
def find_files(spark, d):
    held = view(spark, d, "artifacts").withColumn("label", F.col("path")).withColumn("deleted", F.lit(False))
    said = table(spark, d, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("file_id"), "text")
    return store.find(held, "license", said, kind="document")


_REFRESH = ctes("before_snapshot", "after_snapshot") + """, both_ AS (SELECT coalesce(b.path, a.path) AS path, 'id:' || b.path AS id, b.sha256 AS bs, a.sha256 AS as_, CASE WHEN a.path IS NULL THEN 'deleted' WHEN b.path IS NULL THEN 'added' WHEN a.bytes = b.bytes AND a.mtime_ns = b.mtime_ns THEN 'reused' ELSE 'changed' END AS state FROM before_snapshot b FULL JOIN after_snapshot a ON a.path = b.path),
g AS (SELECT bs AS sha, min(path) AS f FROM both_ WHERE state = 'deleted' GROUP BY bs HAVING count(*) = 1), c AS (SELECT as_ AS sha, min(path) AS t FROM both_ WHERE state = 'added' GROUP BY as_ HAVING count(*) = 1), moved AS (SELECT f, t FROM g JOIN c USING (sha))"""


@query("refresh_plan", f"""WITH {_REFRESH} SELECT path, CASE WHEN f IS NOT NULL THEN 'id:' || f ELSE coalesce(id, 'file:' || left(sha256(path), 24)) END AS artifact_id, CASE WHEN f IS NOT NULL THEN 'renamed' ELSE state END AS state, f AS previous_path FROM both_ LEFT JOIN moved ON t = path WHERE path NOT IN (SELECT f FROM moved)""")
def refresh_plan(spark, d):
    before, after = (view(spark, d, n).withColumnRenamed("bytes", "size") for n in ("before_snapshot", "after_snapshot"))
    indexed = before.withColumns({"artifact_id": F.concat(F.lit("id:"), F.col("path")), "recognition": F.lit(scan.RECOGNITION), "extractors": F.lit("v1")})
    return scan.refresh_plan(indexed, after, "v1")


@query("run_change_counts", f"WITH {ctes('run_changes')} SELECT run_id, change, count(*) AS n FROM run_changes GROUP BY ALL")
def run_change_counts(spark, d):
    return view(spark, d, "run_changes").groupBy("run_id", "change").agg(F.count("*").alias("n"))


@query("run_clusters", f"""WITH {ctes("run_changes")}, m AS (SELECT run_id, regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)\\.[^./]*$', 1), '\\d+', '{{n}}', 'g'), '(?i)[_-]?(final|draft|debug|diagnostic|intermediate)$', '-{{stage}}') || '*.' || lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS label,
  list_sort(list(DISTINCT path)) AS m FROM run_changes WHERE change = 'created' GROUP BY ALL)
SELECT run_id, label, len(m)::BIGINT AS n_members, array_to_string(list_transform(list_sort(list_distinct([1, 2, 3, len(m) // 2 + 1, len(m)])), lambda i: m[i]), ',') AS representatives FROM m WHERE len(m) >= 10""")
def run_clusters(spark, d):
    return filesets.run_clusters(view(spark, d, "run_changes"))


_IMPACT = f"""WITH RECURSIVE {_EDGES}, live AS MATERIALIZED (SELECT *, relation IN ('was_generated_by', 'confirmed_export') AND assurance = 'verified' AS sure FROM edges WHERE score >= 0.3),
walk(root_id, node, depth) AS (SELECT 's:' || s_suppkey, 's:' || s_suppkey, 0 FROM supplier UNION SELECT root_id, target_id, depth + 1 FROM walk JOIN live ON node = source_id WHERE depth < 3),
least AS (SELECT root_id, node, min(depth) AS depth FROM walk GROUP BY ALL)"""


@query("impact_levels", _IMPACT + """, hit AS (SELECT t.root_id, t.node AS target_id, t.depth, e.relation, e.score, row_number() OVER (PARTITION BY t.root_id, t.node ORDER BY e.sure DESC, e.score DESC, e.source_id DESC) AS r
FROM least t JOIN live e ON e.target_id = t.node JOIN least s ON s.root_id = t.root_id AND s.node = e.source_id AND s.depth = t.depth - 1 WHERE t.depth > 0)
SELECT root_id, target_id, depth, relation, score FROM hit WHERE r = 1""")
def impact_levels(spark, d):
    return graph.impact(edges(spark, d), roots(spark, d, "s", "supplier", "s_suppkey"), 0.3, 3)


@query("shortest_path", _IMPACT + " SELECT root_id, node AS target_id, depth AS hops FROM least WHERE node LIKE 'c:%'")
def shortest_path(spark, d):
    goals = table(spark, d, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("target_id"))
    return graph.shortest_path(edges(spark, d), roots(spark, d, "s", "supplier", "s_suppkey"), goals, 0.3, 3, paths=False)


@query("k_hop", f"""WITH RECURSIVE {_EDGES}, both_ AS MATERIALIZED (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges),
walk(root_id, node_id, hop) AS (SELECT 'n:' || n_nationkey, 'n:' || n_nationkey, 0 FROM nation UNION SELECT root_id, b, hop + 1 FROM walk JOIN both_ ON a = node_id WHERE hop < 2)
SELECT root_id, node_id, min(hop) AS hop FROM walk GROUP BY ALL""")
def k_hop(spark, d):
    return graph.k_hop(edges(spark, d), roots(spark, d, "n", "nation", "n_nationkey"), 2)


_MADE = "SELECT source_id, concat('doc:', substr(target_id, 3)) AS target_id, relation, score FROM claims WHERE target_id LIKE 'p:%'"


@query("orphans", f"""WITH {_CLAIMS}, {ctes("artifacts")}, made AS ({_MADE}) SELECT artifact_id, path, kind FROM artifacts WHERE kind IN ('image', 'document', 'data') AND artifact_id NOT IN (SELECT target_id FROM made WHERE score >= 0.995 AND relation IN ({", ".join(repr(r) for r in PRODUCERS)}))""")
def orphans(spark, d):
    return graph.orphans(view(spark, d, "artifacts"), made(spark, d).where((F.col("score") >= 0.995) & F.col("relation").isin(PRODUCERS)).select("target_id").distinct())


def made(spark, d: str) -> DataFrame:
    """Claims on parts, as claims on the documents of the same number."""
    return spark.sql(_MADE.replace("FROM claims", "FROM {claims}"), claims=claims(spark, d))


_STALE = f"""WITH {_EDGES}, {ctes("times")}, live AS (SELECT *, relation IN ('was_generated_by', 'confirmed_export') AND assurance = 'verified' AS sure FROM edges WHERE score >= 0.3 AND relation IN ({", ".join(repr(r) for r in STALE)}) AND source_id <> target_id)"""
_GRADE = "CASE WHEN u.mtime > v.mtime THEN CASE WHEN sure_all THEN 'definitely_stale' WHEN least_ >= 0.8 THEN 'probably_stale' ELSE 'possibly_stale' END WHEN u.mtime IS NULL OR v.mtime IS NULL THEN 'unknown' WHEN sure_all THEN 'current' ELSE 'unknown' END"


@query("stale_direct", _STALE + f""", e AS (SELECT source_id AS upstream, target_id AS downstream, sure AS sure_all, score AS least_ FROM live), g AS (SELECT upstream, downstream, 1 AS depth, {_GRADE} AS state
FROM e LEFT JOIN times u ON u.node = upstream LEFT JOIN times v ON v.node = downstream) SELECT * FROM g WHERE state LIKE '%stale'""")
def stale_direct(spark, d):
    return graph.stale_direct(edges(spark, d), view(spark, d, "times"))


_LEVEL = """, t{k} AS MATERIALIZED (SELECT f.root_id, f.node AS via, e.target_id, e.relation, least(f.least_, e.score) AS least_, f.sure_all AND e.sure AS sure_all, list_append(f.turn, {{'s': -e.score, 't': e.target_id, 'r': e.relation}}) AS turn
  FROM l{j} f JOIN live e ON e.source_id = f.node WHERE e.target_id <> f.root_id),
l{k} AS MATERIALIZED (SELECT root_id, target_id AS node, arg_min(least_, turn) AS least_, arg_min(sure_all, turn) AS sure_all, min(turn) AS turn FROM t{k} WHERE (root_id, target_id) NOT IN (SELECT root_id, node FROM ({seen})) GROUP BY root_id, target_id)"""


@query("stale_chain", _STALE + ", l0 AS (SELECT node AS root_id, node, 1.0::DOUBLE AS least_, true AS sure_all, []::STRUCT(s DOUBLE, t VARCHAR, r VARCHAR)[] AS turn FROM times WHERE mtime IS NOT NULL)" + "".join(_LEVEL.format(k=k, j=k - 1, seen=" UNION ALL ".join(f"SELECT root_id, node FROM l{i}" for i in range(k))) for k in range(1, 6)) + ", every AS (" + " UNION ALL ".join(f"SELECT *, {k} AS depth FROM t{k}" for k in range(1, 6)) + f""")
SELECT root_id AS upstream, target_id AS downstream, via, relation, depth, {_GRADE} AS state FROM every JOIN times u ON u.node = root_id LEFT JOIN times v ON v.node = target_id""")
def stale_chain(spark, d):
    return graph.stale_chains(edges(spark, d, scored=True), view(spark, d, "times"))


@query("stale_counts", "SELECT upstream, " + ", ".join(f"count(*) FILTER (state = '{x}') AS {x}" for x in ("definitely_stale", "probably_stale", "possibly_stale", "current", "unknown")) + f""", CASE WHEN count(*) FILTER (state = 'definitely_stale') > 0 THEN 'definitely_stale' WHEN count(*) FILTER (state = 'probably_stale') > 0 THEN 'probably_stale' WHEN count(*) FILTER (state = 'possibly_stale') > 0 THEN 'possibly_stale' WHEN count(*) FILTER (state = 'current') > 0 THEN 'current' ELSE 'unknown' END AS overall_state
FROM ({ORACLE_SQL['stale_chain']}) q GROUP BY upstream""")
def stale_counts(spark, d):
    return graph.stale_counts(stale_chain(spark, d))


@query("walk_chain", f"""WITH {_EDGES}, best AS (SELECT source_id, target_id, relation FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, target_id, relation) AS r FROM edges WHERE score >= 0.3) WHERE r = 1),
w1 AS (SELECT n.s AS start_id, b.* FROM (SELECT DISTINCT 'n:' || s_nationkey AS s FROM supplier) n JOIN best b ON b.source_id = n.s), w2 AS (SELECT start_id, b.* FROM w1 JOIN best b ON b.source_id = w1.target_id),
w3 AS (SELECT start_id, b.* FROM w2 JOIN best b ON b.source_id = w2.target_id), w4 AS (SELECT start_id, b.* FROM w3 JOIN best b ON b.source_id = w3.target_id)
SELECT start_id, 1 AS step, source_id, target_id, relation FROM w1 UNION ALL SELECT start_id, 2, source_id, target_id, relation FROM w2
UNION ALL SELECT start_id, 3, source_id, target_id, relation FROM w3 UNION ALL SELECT start_id, 4, source_id, target_id, relation FROM w4""")
def walk_chain(spark, d):
    starts = table(spark, d, "supplier").select(F.concat(F.lit("n:"), F.col("s_nationkey").cast("string")).alias("start_id")).distinct()
    return graph.walk(edges(spark, d), starts)


@query("pipeline_chains")
def pipeline_chains(spark, d):
    found = edges(spark, d)
    return graph.pipeline_chains(found, found.select(F.col("source_id").alias("start_id")).distinct())


def texts(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


@query("shingle_jaccard", f"""WITH t AS (SELECT item_id, {_WORDS} AS w FROM benchmark), d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
a AS (SELECT item_id, {_SHINGLES} AS s FROM t), b AS (SELECT doc_id, {_SHINGLES} AS s FROM d), x AS (SELECT item_id, len(s) AS n, unnest(s) AS g FROM a), y AS (SELECT doc_id, len(s) AS m, unnest(s) AS g FROM b),
p AS (SELECT item_id, doc_id, n, m, count(*) AS c FROM x JOIN y USING (g) GROUP BY ALL)
SELECT item_id, doc_id, round(c / (n + m - c), 6) AS jaccard, round(c / least(n, m), 6) AS containment FROM p WHERE c / (n + m - c) >= 0.15 OR c / least(n, m) >= 0.5""")
def shingle_jaccard(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return similarity.similar_pairs(items, texts(spark, d)).select(F.col("a").alias("item_id"), F.col("b").alias("doc_id"), "jaccard", "containment")


_PAIRS = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT doc_id, {_SHINGLES} AS s FROM d WHERE len(w) >= 5), x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS c FROM x a JOIN x b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT a, b, round(c / (n + m - c), 6) AS j, round(c / least(n, m), 6) AS t FROM p WHERE c / (n + m - c) >= 0.15 OR c / least(n, m) >= 0.5)"""


@query("content_matches", _PAIRS + " SELECT a AS source_id, b AS target_id, round(least(0.72, 0.35 + 0.5 * greatest(j, 0.65 * t)), 4) AS score, 'content_matches' AS relation FROM k")
def content_matches(spark, d):
    return similarity.content_matches(similarity.matching_pairs(texts(spark, d)))


@query("benchmark_containment", f"""WITH t AS (SELECT item_id, {_WORDS} AS w FROM benchmark), d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
a AS (SELECT item_id, {_SHINGLES} AS s FROM t), b AS (SELECT doc_id, {_SHINGLES} AS s FROM d), x AS (SELECT item_id, len(s) AS n, unnest(s) AS g FROM a), y AS (SELECT doc_id, len(s) AS m, unnest(s) AS g FROM b),
p AS (SELECT item_id, doc_id, n, m, count(*) AS c FROM x JOIN y USING (g) GROUP BY ALL) SELECT item_id, doc_id, round(c / least(n, m), 6) AS containment FROM p WHERE c / least(n, m) >= 0.5""")
def benchmark_containment(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return similarity.similar_pairs(items, texts(spark, d), jaccard=2.0, containment=0.5).select(F.col("a").alias("item_id"), F.col("b").alias("doc_id"), "containment")


_EXPORTS = _PATHS + f""", t AS (SELECT artifact_id, ext, stem, mtime_ns, {_WORDS} AS w FROM p JOIN documents USING (doc_id)), s AS (SELECT *, {_SHINGLES} AS s FROM t WHERE len(w) >= 5),
x AS (SELECT artifact_id AS a, stem AS sa, mtime_ns AS ta, len(s) AS n, unnest(s) AS g FROM s WHERE ext IN ('docx', 'md', 'html')), y AS (SELECT artifact_id AS b, stem AS sb, mtime_ns AS tb, len(s) AS m, unnest(s) AS g FROM s WHERE ext IN ('pdf', 'png')),
k AS (SELECT a, b, sa, sb, ta, tb, n, m, count(*) AS c FROM x JOIN y USING (g) GROUP BY ALL), w AS (SELECT *, least(0.72, 0.35 + 0.5 * greatest(round(c / (n + m - c), 6), 0.65 * round(c / least(n, m), 6))) AS w1, CASE WHEN lower(sa) = lower(sb) THEN 0.3 ELSE 0 END AS w2,
 CASE WHEN ta <> 0 AND tb <> 0 AND abs(ta - tb) <= 3600000000000 THEN 0.25 ELSE 0 END AS w3 FROM k WHERE c / (n + m - c) >= 0.15 OR c / least(n, m) >= 0.5)"""


@query("document_edges", f"WITH {_EXPORTS} SELECT a AS source_id, b AS target_id, 'content_matches' AS relation, round(least(0.99, 1 - (1 - w1) * (1 - w2) * (1 - w3)), 4)::DOUBLE AS score FROM w")
def document_edges(spark, d):
    held = view(spark, d, "artifacts").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    none = F.array().cast("array<string>")
    held = held.select(F.col("artifact_id").alias("id"), "path", "text", "sha256", "mtime_ns", none.alias("media"), none.alias("prints"))
    of = lambda kinds: held.where(F.regexp_extract("path", r"\.([^./]+)$", 1).isin(kinds))
    return documents.document_edges(documents.document_evidence(of(EDITABLE), of(EXPORTED)))


@query("references")
def references(spark, d):
    pages = table(spark, d, "pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("text"))
    return extract.references(pages)


@query("page_references", r"""WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)(?:href|src)\s*=\s*["'']([^"'']+)["'']', 1)) AS raw_ref FROM pages)
SELECT page_id, raw_ref, CASE WHEN NOT regexp_matches(raw_ref, '^(#|data:|mailto:|javascript:|[A-Za-z][A-Za-z0-9+.-]*://)') THEN nullif(string_split(string_split(raw_ref, '#')[1], '?')[1], '') END AS clean_ref FROM r""")
def page_references(spark, d):
    raw = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(T.REFERENCES["attribute"]), F.lit(1))).alias("raw_ref"))
    return raw.select("page_id", "raw_ref", T.cleaned_reference(F.col("raw_ref")).alias("clean_ref"))


@query("search_like", "SELECT doc_id AS id, left(text, 500) AS excerpt FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id LIMIT 20")
def search_like(spark, d):
    return search.search_like(texts(spark, d), "license")


@query("search_bm25", f"""WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents), f AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'licensed')) AS a, len(list_filter(w, lambda x: x = 'under')) AS b FROM t),
s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM f)
SELECT doc_id AS id, round(ln((docs - da + 0.5) / (da + 0.5) + 1) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln((docs - db + 0.5) / (db + 0.5) + 1) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score FROM f, s WHERE a > 0 AND b > 0""")
def search_bm25(spark, d):
    return search.search_bm25(texts(spark, d), ["licensed", "under"])


@query("find_fuzzy")
def find_fuzzy(spark, d):
    return search.find_fuzzy(view(spark, d, "artifacts").select(F.col("artifact_id").alias("id"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name")), "sumary_11_final")


@query("redact_secrets", r"""SELECT doc_id AS id, regexp_replace(text, '(?i)(password|passwd|token|secret|api[-_]?key|authorization)(\s*[:=]\s*)([^\s,;]+)', '\1\2[REDACTED]', 'g') AS redacted FROM documents
WHERE regexp_matches(text, '(?i)(password|passwd|token|secret|api[-_]?key|authorization)(\s*[:=]\s*)([^\s,;]+)')""")
def redact_secrets(spark, d):
    return texts(spark, d).where(F.col("text").rlike(T.SECRET)).select("id", T.redacted(F.col("text")).alias("redacted"))


@query("safe_url", r"""SELECT page_id, CASE WHEN lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) IN ('http', 'https', 'ftp') THEN lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)) || coalesce(nullif(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ''), '/') END AS safe_url FROM pages""")
def safe_url(spark, d):
    return table(spark, d, "pages").select("page_id", T.safe_url(F.col("url")).alias("safe_url"))


@query("decision_fold", f"""WITH {ctes("decision_log")}, u AS (SELECT undoes AS seq, min(seq) AS undone FROM decision_log WHERE action = 'undo' GROUP BY undoes), d AS (SELECT claim_id, decision_log.seq, action = 'reject' AS no, undone FROM decision_log LEFT JOIN u ON u.seq = decision_log.seq WHERE action <> 'undo'),
e AS (SELECT claim_id, seq, no::INTEGER AS up, CASE WHEN no THEN 'rejected' END AS status FROM d UNION ALL SELECT claim_id, undone, -(no::INTEGER), CASE WHEN no THEN 'active' ELSE 'withdrawn' END FROM d WHERE undone > seq),
r AS (SELECT *, sum(up) OVER (PARTITION BY claim_id ORDER BY seq) AS open_ FROM e) SELECT claim_id, coalesce(arg_max(status, seq) FILTER (status IS NOT NULL AND NOT (status = 'active' AND open_ > 0)), 'active') AS status FROM r GROUP BY claim_id""")
def decision_fold(spark, d):
    return snapshots.fold_decisions(view(spark, d, "decision_log"))


@query("current_version", f"WITH {ctes('versions')} SELECT artifact_id, version_id FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY observed_at DESC, version_id DESC) AS r FROM versions) WHERE r = 1")
def current_version(spark, d):
    return snapshots.current_versions(view(spark, d, "versions"))


@query("rescore", f"""WITH {_CLAIMS}, stored AS (SELECT e.source_id || '>' || e.target_id AS claim_id, c.assurance = 'verified' AS sure, e.signal_group, e.weight, e.active FROM evidence e JOIN claims c USING (source_id, target_id, relation)),
again AS (SELECT claim_id, signal_group, max(CASE WHEN active THEN least(greatest(weight, 0), 0.99) END) AS w, bool_or(active AND sure AND weight >= 1) AS exact FROM stored GROUP BY ALL),
total AS (SELECT claim_id, CASE WHEN bool_or(exact) THEN 1.0::DOUBLE ELSE round(least(0.99, 1 - product(1 - coalesce(w, 0))), 4)::DOUBLE END AS score FROM again GROUP BY claim_id) SELECT claim_id, score, {_ASSURED} AS assurance FROM total""")
def rescore(spark, d):
    evidence = view(spark, d, "evidence")
    claim = F.concat("source_id", F.lit(">"), "target_id").alias("claim_id")
    ids = evidence.groupBy(claim).agg(F.collect_list("evidence_id").alias("evidence_ids"))
    stored = claims(spark, d).select(claim, "assurance").join(ids, "claim_id")
    return C.rescore(stored, evidence).select("claim_id", "score", "assurance")


_MISSING = "SELECT l_orderkey * 10 + l_linenumber AS claim_id, concat('@missing/part/', cast(l_partkey AS varchar(20))) AS source_id, concat('o:', cast(l_orderkey AS varchar(20))) AS target_id FROM lineitem"


@query("virtual_reconcile", f"WITH m AS ({_MISSING}) SELECT claim_id, coalesce('p:' || p_partkey, source_id) AS source_id, target_id FROM m LEFT JOIN part ON source_id = '@missing/part/' || p_partkey AND p_partkey % 2 = 0")
def virtual_reconcile(spark, d):
    nodes = table(spark, d, "part").where("p_partkey % 2 = 0").selectExpr("concat('part/', p_partkey) AS path", "concat('p:', p_partkey) AS id")
    return snapshots.reconcile_virtual(spark.sql(_MISSING.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, d, "lineitem")), nodes).select("claim_id", "source_id", "target_id")


@query("prov_candidate_rank", f"WITH {_CLAIMS} SELECT source_id, target_id, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, source_id)::INTEGER AS rank FROM claims")
def prov_candidate_rank(spark, d):
    return graph.candidate_rank(claims(spark, d))


_CLASS = "CASE " + " ".join(f"WHEN relation IN ({', '.join(repr(r) for r in v)}) THEN '{k}'" for k, v in CLASSES.items()) + " ELSE 'Influence' END"


@query("prov_relation_class", f"WITH {ctes('typed_edges')} SELECT relation, {_CLASS} AS prov_class, count(*) AS n FROM typed_edges GROUP BY relation")
def prov_relation_class(spark, d):
    return exports.provenance_class(view(spark, d, "typed_edges"))


_SIDE = "concat(source_id, '|', relation, '|', target_id)"


@query("graph_normalized_diff", f"""WITH {_EDGES}, l AS (SELECT DISTINCT {_SIDE} AS key FROM edges WHERE score >= 0.5), r AS (SELECT DISTINCT {_SIDE} AS key FROM edges WHERE score < 0.9)
SELECT 'left' AS side, key FROM (SELECT * FROM l EXCEPT SELECT * FROM r) UNION ALL SELECT 'right', key FROM (SELECT * FROM r EXCEPT SELECT * FROM l)""")
def graph_normalized_diff(spark, d):
    e = edges(spark, d).withColumnsRenamed({"source_id": "source_path", "target_id": "target_path"})
    return exports.normalized_difference(e.where("score >= 0.5"), e.where("score < 0.9"))


_EVENTS = "SELECT node AS path, substr(node, 1, 1) AS what, 'first_seen' AS event, mtime AS at FROM times WHERE node NOT LIKE 'o:%' UNION ALL SELECT node, substr(node, 1, 1), 'run_start', mtime FROM times WHERE node LIKE 'o:%'"


@query("timeline", f"""WITH {ctes("times")}, e AS ({_EVENTS}) SELECT e.at, path, what, event, lag(path) OVER (PARTITION BY what ORDER BY e.at, path) AS previous FROM e""")
def timeline(spark, d):
    return filesets.timeline(spark.sql(_EVENTS.replace("FROM times", "FROM {times}"), times=view(spark, d, "times")))


_STATES = f"""WITH {ctes("boundary_events")}, s AS (SELECT key, CASE WHEN count(*) FILTER (type IN ('start', 'stop')) = 0 THEN 'untouched' WHEN arg_max(type, seq) FILTER (type IN ('start', 'stop')) = 'start' THEN 'open' ELSE 'closed' END AS state, count(*) FILTER (type = 'start') AS n_starts FROM boundary_events GROUP BY key)"""


@query("run_state_machine", _STATES + " SELECT key, state, n_starts FROM s")
def run_state_machine(spark, d):
    return snapshots.run_states(view(spark, d, "boundary_events"))


@query("pending_runs", f"""WITH {ctes("boundary_events")}, s AS (SELECT key, coalesce(max(seq) FILTER (type = 'stop'), -1) AS stopped FROM boundary_events GROUP BY key)
SELECT key, arg_min(boundary_events.at, seq) AS started_at FROM boundary_events JOIN s USING (key) WHERE type = 'start' AND seq > stopped GROUP BY key""")
def pending_runs(spark, d):
    return pending(view(spark, d, "boundary_events"))


@query("run_transitions_log", f"""WITH {ctes("boundary_events")} SELECT run_id, seq, status FROM (SELECT key AS run_id, seq, type AS status, lag(type) OVER (PARTITION BY key ORDER BY seq) AS before FROM boundary_events) WHERE before IS DISTINCT FROM status""")
def run_transitions_log(spark, d):
    return store.transitions(view(spark, d, "boundary_events").select(F.col("key").alias("run_id"), "seq", F.col("type").alias("status")))


@query("overview_counts", f"""WITH {_EDGES} SELECT (SELECT count(DISTINCT n) FROM (SELECT source_id AS n FROM edges UNION ALL SELECT target_id FROM edges)) AS nodes, count(*) AS edges,
 count(*) FILTER (relation = 'was_generated_by' AND assurance = 'verified') AS verified, count(*) FILTER (NOT (relation = 'was_generated_by' AND assurance = 'verified')) AS inferred FROM edges""")
def overview_counts(spark, d):
    return exports.overview(edges(spark, d))


@query("top_edges", f"WITH {_EDGES} SELECT source_id, target_id, relation, score FROM edges ORDER BY score DESC, source_id, target_id LIMIT 80")
def top_edges(spark, d):
    return exports.top_edges(edges(spark, d))


assert set(PRODUCERS) < set(STALE)
