"""Scoring goldens, traversal fixtures, redaction, and a few registered queries against DuckDB."""

import duckdb
import pytest

from provgraph.functions.text import redacted_command
from provgraph.operators import claims, graph, snapshots
from provgraph.plans import registry
from provgraph.sources.corpus import TABLES

DATA = "/root/testdata/sf0.001"


def fold(spark, rows):
    df = spark.createDataFrame([("a", "b", "was_generated_by", g, w, True, x) for g, w, x in rows], "source_id string, target_id string, relation string, signal_group string, weight double, active boolean, exact_allowed boolean")
    return claims.fold_evidence(df).first()


def test_correlated_signals_count_once(spark):
    r = fold(spark, [("name", 0.4, False)] * 4)
    assert (r.score, r.confidence) == (0.4, "weak")


def test_independent_signals_combine(spark):
    r = fold(spark, [("text", 0.65, False), ("media", 0.70, False)])
    assert (r.score, r.confidence) == (0.895, "strong")


def test_only_authorised_evidence_is_exact(spark):
    assert fold(spark, [("x", 1.0, False)]).score == 0.99
    r = fold(spark, [("x", 1.0, True)])
    assert (r.score, r.assurance) == (1.0, "verified")


def test_impact_levels(spark):
    edges = spark.createDataFrame([("data", "render", "declares_read", 0.9, "candidate"), ("render", "figure", "can_generate", 0.9, "candidate"), ("figure", "data", "references", 0.9, "candidate")], "source_id string, target_id string, relation string, score double, assurance string")
    roots = spark.createDataFrame([("data",)], "root_id string")
    assert {(r.target_id, r.depth) for r in graph.impact(edges, roots).collect()} == {("render", 1), ("figure", 2)}


def test_renames_need_unique_contents(spark):
    shape = "path string, bytes long, sha256 string"
    before = spark.createDataFrame([("old", 1, "a"), ("x", 2, "b"), ("y", 2, "b")], shape)
    after = spark.createDataFrame([("new", 1, "a"), ("z", 2, "b")], shape)
    assert [tuple(r) for r in snapshots.renames(snapshots.compare(before, after)).collect()] == [("old", "new", "a")]


def test_redacted_command(spark):
    df = spark.createDataFrame([(["tool", "--password", "abc", "--token=x", "https://u:secret@h"],)], "a array<string>")
    assert df.select(redacted_command(df.a)).first()[0] == ["tool", "--password", "[REDACTED]", "--token=[REDACTED]", "https://u:[REDACTED]@h"]


@pytest.mark.parametrize("name", ["why_best_producer", "impact_levels", "stale_chain", "conventions", "rename_detect", "shingle_jaccard"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.QUERIES[name](spark, DATA)
    rel = con.sql(registry.ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(rel.columns)
    rows = lambda rs, cs: sorted(repr([r[cs.index(c)] for c in order]) for r in rs)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(rel.fetchall(), rel.columns)


def test_chains_start_at_every_source(spark):
    starts = {r.start_id[:2] for r in registry.QUERIES["pipeline_chains"](spark, DATA).select("start_id").distinct().collect()}
    assert "p:" in starts
