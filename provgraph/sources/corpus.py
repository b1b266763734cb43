"""Canonical views over the driver's tables, as SQL that Spark and DuckDB both run.

Each view is written once; ``{sha}`` is the only word that differs. ``view`` gives a DataFrame, ``ctes``
the same definitions as common table expressions for an oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from provgraph.functions.enums import KINDS, RELATIONS

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

_EXT = "CASE doc_id % 8 WHEN 0 THEN 'md' WHEN 1 THEN 'pdf' WHEN 2 THEN 'docx' WHEN 3 THEN 'png' WHEN 4 THEN 'py' WHEN 5 THEN 'csv' WHEN 6 THEN 'ipynb' ELSE 'html' END"
_KIND = "CASE " + " ".join(f"WHEN ext IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in KINDS.items()) + " ELSE 'file' END"
_MODE = "CASE (l_suppkey + l_linenumber) % 7 WHEN 0 THEN 'captured' WHEN 1 THEN 'explicit' WHEN 2 THEN 'static' WHEN 3 THEN 'content' WHEN 4 THEN 'heuristic' WHEN 5 THEN 'metadata' ELSE 'imported' END"
_EVIDENCE = "CASE l_partkey % 5 WHEN 0 THEN 'task-boundary-diff' WHEN 1 THEN 'pipeline-declaration' WHEN 2 THEN 'static-callsite' WHEN 3 THEN 'normalized-text-similarity' ELSE 'w3c-prov-import' END"
_RELATION = "CASE l_orderkey % " + str(len(RELATIONS)) + " " + " ".join(f"WHEN {k} THEN '{r}'" for k, r in enumerate(RELATIONS)) + " END"
_ID = "concat('{side}:', cast(l_orderkey AS varchar(20)), ':', cast(l_linenumber AS varchar(20)), ':', cast(l_partkey AS varchar(20)), ':', cast(l_suppkey AS varchar(20)), ':', cast(cast(l_extendedprice * 100 AS bigint) AS varchar(20))) AS evidence_id"
_BASIS = "CASE l_linenumber % 4 WHEN 0 THEN 'confirmation' WHEN 1 THEN 'observation' WHEN 2 THEN 'declaration' ELSE 'inference' END"

VIEWS = {
    "artifacts": f"""SELECT artifact_id, doc_id, concat(dir, '/', stem, '.', ext) AS path, {_KIND} AS kind, sha256, size, mtime_ns
      FROM (SELECT doc_id, concat('doc:', cast(doc_id AS varchar(20))) AS artifact_id, concat(source, '/', lang) AS dir, {_EXT} AS ext,
        CASE WHEN doc_id % 11 = 0 THEN concat('summary_', cast(doc_id AS varchar(20)), '_final_v', cast(doc_id % 4 AS varchar(20))) ELSE concat('sweep_dpi', cast(doc_id AS varchar(20))) END AS stem,
        {{sha}} AS sha256, n_chars AS size, ((doc_id * 7919) % 100000) * 1000000000 AS mtime_ns FROM documents) d""",
    "evidence": f"""SELECT concat('s:', cast(l_suppkey AS varchar(20))) AS source_id, concat('p:', cast(l_partkey AS varchar(20))) AS target_id, 'was_generated_by' AS relation, l_returnflag AS signal_group,
        round(l_discount * 10, 2) AS weight, l_linestatus = 'O' AS active, round(l_discount * 10, 2) >= 1.0 AND l_returnflag = 'N' AS exact_allowed, {_BASIS} AS basis, l_shipdate AS observed_at, {_MODE} AS mode, {_EVIDENCE} AS kind, l_quantity > 25 AS trusted, {_ID.replace('{side}', 's')} FROM lineitem
      UNION ALL SELECT concat('p:', cast(l_partkey AS varchar(20))), concat('o:', cast(l_orderkey AS varchar(20))), 'was_generated_by', l_returnflag,
        round(l_discount * 10, 2), l_linestatus = 'O', round(l_discount * 10, 2) >= 1.0 AND l_returnflag = 'N', {_BASIS}, l_shipdate, {_MODE}, {_EVIDENCE}, l_quantity > 25, {_ID.replace('{side}', 'p')} FROM lineitem""",
    "typed_edges": f"""SELECT concat('p:', cast(l_partkey AS varchar(20))) AS source_id, concat('o:', cast(l_orderkey AS varchar(20))) AS target_id, {_RELATION} AS relation FROM lineitem""",
    "declared": """SELECT concat('n:', cast(s_nationkey AS varchar(20))) AS source_id, concat('s:', cast(s_suppkey AS varchar(20))) AS target_id, 'declares_read' AS relation, 0.92 AS score, 'strong-candidate' AS assurance FROM supplier
      UNION ALL SELECT concat('o:', cast(o_orderkey AS varchar(20))), concat('c:', cast(o_custkey AS varchar(20))), 'declares_read', 0.92, 'strong-candidate' FROM orders""",
    "times": """SELECT concat('o:', cast(o_orderkey AS varchar(20))) AS node, o_orderdate AS mtime FROM orders
      UNION ALL SELECT concat('p:', cast(l_partkey AS varchar(20))), max(l_shipdate) FROM lineitem GROUP BY l_partkey
      UNION ALL SELECT concat('s:', cast(l_suppkey AS varchar(20))), min(l_shipdate) FROM lineitem GROUP BY l_suppkey""",
    "run_changes": """SELECT DISTINCT concat('run:', cast(l_orderkey % 50 AS varchar(20))) AS run_id, CASE l_returnflag WHEN 'N' THEN 'created' WHEN 'A' THEN 'modified' ELSE 'deleted' END AS change,
        concat('part/run_', cast(l_partkey AS varchar(20)), '.csv') AS path FROM lineitem""",
    "before_snapshot": """SELECT concat('part/', cast(l_partkey AS varchar(20))) AS path, max(cast(l_quantity AS bigint)) AS bytes, max(l_linenumber) AS mtime_ns, concat('d', cast(max(cast(l_quantity AS bigint)) * 1000 + max(l_suppkey) AS varchar(20))) AS sha256
      FROM lineitem WHERE l_orderkey % 2 = 0 AND l_partkey % 5 <> 1 GROUP BY l_partkey""",
    "after_snapshot": """SELECT concat(CASE WHEN l_partkey % 5 = 2 THEN 'moved/' ELSE 'part/' END, cast(l_partkey AS varchar(20))) AS path, max(cast(l_quantity AS bigint)) AS bytes, max(l_linenumber) AS mtime_ns,
        concat('d', cast(max(cast(l_quantity AS bigint)) * 1000 + max(l_suppkey) AS varchar(20))) AS sha256
      FROM lineitem WHERE (l_orderkey % 2 = 0 OR l_partkey % 3 = 0) AND l_partkey % 5 <> 3 GROUP BY l_partkey""",
    "boundary_events": "SELECT user_id AS key, event_id AS seq, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'stop' ELSE 'touch' END AS type, ts AS at FROM events",
    "decision_log": "SELECT cast(floor(event_id / 12) AS bigint) AS claim_id, event_id AS seq, CASE WHEN event_id % 4 = 3 THEN 'undo' WHEN user_id % 2 = 0 THEN 'reject' ELSE 'confirm' END AS action, CASE WHEN event_id % 4 = 3 THEN event_id - 1 - user_id % 3 END AS undoes FROM events",
    "versions": "SELECT l_partkey AS artifact_id, l_shipdate AS observed_at, l_orderkey * 10 + l_linenumber AS version_id FROM lineitem",
}
_DEPENDS = {name: [t for t in TABLES if re.search(rf"FROM {t}\b", sql)] for name, sql in VIEWS.items()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A canonical view as a DataFrame."""
    sql = VIEWS[name].replace("{sha}", "sha2(text, 256)")
    for t in _DEPENDS[name]:
        sql = re.sub(rf"FROM {t}\b", f"FROM {{{t}}}", sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in _DEPENDS[name]})


def ctes(*names: str) -> str:
    """The same views for DuckDB, as ``a AS (...), b AS (...)``."""
    return ", ".join(f"{n} AS ({VIEWS[n].replace('{sha}', 'sha256(text)')})" for n in names)
