"""Scans, extraction and imports on small inputs with known results."""

import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from provgraph.functions import paths as P
from provgraph.functions import text as T
from provgraph.operators import claims as C
from provgraph.operators import documents
from provgraph.sources import extract, importers, scan
from provgraph.sources.structured import StructuredError, yaml


def test_refresh_plan_keeps_ids_over_renames(spark):
    old = [("a", "1", 1, 1, "x"), ("b", "2", 2, 2, "y"), ("old.txt", "3", 1, 1, "z"), ("twin1", "4", 1, 1, "t"), ("twin2", "5", 1, 1, "t"), ("declared", "6", 1, 1, "q")]
    new = [("a", 1, 1, "x"), ("b", 3, 3, "yy"), ("c", 1, 1, "w"), ("new.txt", 1, 9, "z"), ("twin3", 1, 1, "t"), ("moved", 1, 1, "changed")]
    indexed = spark.createDataFrame([(*r, scan.RECOGNITION, "v1") for r in old], "path string, artifact_id string, size long, mtime_ns long, sha256 string, recognition int, extractors string")
    current = spark.createDataFrame(new, "path string, size long, mtime_ns long, sha256 string")
    renames = spark.createDataFrame([("declared", "moved")], "path_from string, path_to string")
    got = {r.path: (r.state, r.previous_path, r.artifact_id if r.state != "added" else None) for r in scan.refresh_plan(indexed, current, "v1", renames).collect()}
    assert got == {"a": ("reused", None, "1"), "b": ("changed", None, "2"), "c": ("added", None, None), "new.txt": ("renamed", "old.txt", "3"), "twin1": ("deleted", None, "4"), "twin2": ("deleted", None, "5"), "twin3": ("added", None, None), "moved": ("renamed", "declared", "6")}
    assert {r.state for r in scan.refresh_plan(indexed, current, "v2").where("path = 'a'").collect()} == {"changed"}


def test_scan_of_a_folder(spark, tmp_path):
    for name, body in {"src/a.py": "open('data/x.csv')", "data/x.csv": "1,2", ".git/config": "no", "keys/id_rsa": "secret", "note.txt": "x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    listed = scan.listing(spark, str(tmp_path), exclude=[".git/**"], secret=["*id_rsa*"], digest_bytes=10)
    got = {r.path: (r.kind, r.size, r.sha256 is None) for r in listed.collect()}
    assert got == {"src/a.py": ("code", 18, True), "data/x.csv": ("data", 3, False), "note.txt": ("document", 1, False)}
    none = spark.createDataFrame([], "path string, artifact_id string, kind string, size long, mtime_ns long, sha256 string, recognition int, extractors string, deleted boolean")
    index, plan = scan.scan(spark, str(tmp_path), none, "v1", exclude=[".git/**"], secret=["*id_rsa*"])
    assert {r.state for r in plan.collect()} == {"added"}
    index = spark.createDataFrame(index.collect(), none.schema)
    (tmp_path / "note.txt").rename(tmp_path / "moved.txt")
    again, plan = scan.scan(spark, str(tmp_path), index, "v1", exclude=[".git/**"], secret=["*id_rsa*"])
    assert {r.path: r.state for r in plan.collect()} == {"src/a.py": "reused", "data/x.csv": "reused", "moved.txt": "renamed"}
    assert again.where("deleted").count() == 0
    cache = listed.where("path = 'data/x.csv'").select("path", "sha256", F.lit("text").alias("adapter"), F.lit("1").alias("version"))
    fresh = plan.withColumn("state", F.lit("changed"))
    now = scan.listing(spark, str(tmp_path), exclude=[".git/**"], secret=["*id_rsa*"])
    assert {r.path for r in scan.to_extract(fresh, now, cache, "text", "1").collect()} == {"src/a.py", "moved.txt"}


SCRIPT = """
import pandas as pd, json
from pathlib import Path
base = Path("data") / "raw"
src = base / "in.csv"
df = pd.read_csv(src)
df.to_csv(f"out/clean.csv")
open("log.txt", "w")
open("cfg.yaml")
Path("note.md").read_text()
plt.savefig(name)
pd.read_parquet(unknown)
"""


def test_python_calls():
    found, warning = extract.python_calls(SCRIPT, "a.py")
    assert warning is None
    assert {(c["source_path"], c["target_path"], c["relation"], c["weight"]) for c in found} == {
        ("data/raw/in.csv", "a.py", "declares_read", 0.65), ("a.py", "out/clean.csv", "can_generate", 0.65), ("a.py", "log.txt", "can_generate", 0.65), ("cfg.yaml", "a.py", "declares_read", 0.65),
        ("note.md", "a.py", "declares_read", 0.65), ("a.py", "@unresolved/a.py:11:plt.savefig", "can_generate", 0.25), ("a.py", "@unresolved/a.py:12:pd.read_parquet", "declares_read", 0.25)}
    assert extract.python_calls("def (", "b.py")[1]


def test_notebooks_keep_their_lines():
    cells = [{"cell_type": "code", "source": ["%matplotlib inline\n", "!pip install x\n", "open('a.txt')\n"]}, {"cell_type": "code", "source": "%%bash\nopen('no.txt')"}, {"cell_type": "code", "source": "%%time\nx = %ls\nopen('b.txt')\ny = 5 % 2\npd.read_csv?"}, {"cell_type": "markdown", "source": "open('no.txt')"}]
    found, told = extract.notebook_calls(json.dumps({"cells": cells}), "n.ipynb")
    assert not told and {(c["source_path"], c["line"], c["cell"]) for c in found} == {("a.txt", 3, 0), ("b.txt", 3, 2)}


def test_javascript_calls():
    source = "// fs.readFileSync('no.txt')\nconst a = fs.readFileSync('in.json');\nwriteFile(\"out.json\", x);\nimport y from './lib/util.js';\nimport z from 'react';\n`readFile('no')`; require(`a${b}`);"
    got = {(c["source_path"], c["target_path"], c["relation"], c["line"]) for c in extract.javascript_calls(source, "src/m.js")}
    assert got == {("in.json", "src/m.js", "declares_read", 2), ("src/m.js", "out.json", "can_generate", 3), ("src/lib/util.js", "src/m.js", "imports", 4)}


def _zip(parts):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return held.getvalue()


def test_extraction_of_files(spark):
    docx = _zip({"word/document.xml": "<w:document xmlns:w='w'><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>world</w:t></w:r></w:p></w:document>", "word/media/i.png": b"png", "word/_rels/document.xml.rels": "<R><r Target='../data/x.csv' TargetMode='External'/><r Target='https://a/b' TargetMode='External'/></R>"})
    bomb = _zip({"word/document.xml": b"0" * 5_000_000})
    dtd = _zip({"word/document.xml": "<!DOCTYPE x [<!ENTITY a 'b'>]><x>&a;</x>"})
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 7, 9)
    jpg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x0b\x08" + struct.pack(">HH", 20, 30) + b"\0" * 6
    pdf = b"%PDF\n1 0 obj stream\nBT (final ) Tj (report) Tj ET\nendstream"
    rows = {"d/a.docx": docx, "bomb.docx": bomb, "dtd.docx": dtd, "i.png": png, "i.jpg": jpg, "p.pdf": pdf, "u.txt": "é".encode("utf-16"), "bad.txt": b"\xff\x00\xfa", "s.py": b"open('q.txt')", "e.md": b"", "n.bin": None}
    got = {r.path: r for r in extract.extracted(spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in rows.items()], "path string, content binary")).collect()}
    assert got["d/a.docx"].text == "Hello world" and len(got["d/a.docx"].media) == 1
    assert [(c.target_path, c.weight) for c in got["d/a.docx"].candidates] == [("data/x.csv", 0.48)]
    assert all(got[x].warnings and not got[x].text for x in ("bomb.docx", "dtd.docx", "bad.txt"))
    assert (got["i.png"].width, got["i.png"].height, got["i.jpg"].width, got["i.jpg"].height) == (7, 9, 30, 20)
    assert got["p.pdf"].text.split() == ["final", "report"]
    assert (got["u.txt"].text, got["u.txt"].encoding, got["e.md"].text) == ("é", "utf-16", "") and got["s.py"].candidates[0].source_path == "q.txt"


def test_references(spark):
    text = "see [x](../data/a.csv) and <img src='pic.png?v=2'>\n![y](https://a/b.png) url( \"s.css\" ) 'notes.md' \"no suffix\"\n[self](r.md) [x](../data/a.csv#top) [x](../data/a.csv)"
    texts = spark.createDataFrame([("docs/r.md", text), ("n", None)], "path string, text string")
    known = spark.createDataFrame([("docs/pic.png",), ("notes.md",), ("docs/notes.md",)], "path string")
    got = {(r.line, r.target) for r in extract.references(texts, known).collect()}
    assert got == {(1, "data/a.csv"), (1, "docs/pic.png"), (2, "s.css"), (2, "notes.md"), (3, "r.md"), (3, "data/a.csv")}


DVC = "stages:\n  train:\n    cmd: python t.py\n    deps:\n      - t.py\n      - data/x.csv\n    params: [params.yaml, {other.yaml: [lr]}, lr]\n    outs:\n    - model.bin\n    metrics:\n      - m.json:\n          cache: false\n"
LOCK = "stages:\n  train:\n    cmd: python t.py\n    deps:\n    - path: t.py\n      md5: 1\n    outs:\n    - path: model.bin\n      md5: 2\n"


def load(spark, adapter, text, trusted=False, **more):
    row = {"path": "src/manifest", "content": bytearray(text.encode())} | {k: bytearray(v.encode()) for k, v in more.items()}
    form = "path string, content binary" + "".join(f", {k} binary" for k in more)
    return importers.imported(spark.createDataFrame([tuple(row.values())], form), adapter, trusted)


def edges_of(records):
    return {(r.source, r.target, r.relation): {e.kind: (e.weight, e.exact_allowed) for e in r.evidence} for r in importers.edges(records).collect()}


def test_yaml():
    assert yaml("a: 1\nb:\n- x\n- y: 2\n  z: 'q: r'\nc: {d: [1, 2.5], e: true}\nf: |\n  one\n  two\ng:   # none\n") == {"a": 1, "b": ["x", {"y": 2, "z": "q: r"}], "c": {"d": [1, 2.5], "e": True}, "f": "one\ntwo", "g": None}
    assert yaml("") == {} and yaml("- 1\n-\n  a: b\n") == [1, {"a": "b"}]
    with pytest.raises(StructuredError):
        yaml("a: 1\n   b: 2\n")


def test_dvc(spark):
    got = edges_of(load(spark, "dvc", DVC, lock=LOCK))
    reads = {k for k in got if k[2] == "declares_read"}
    makes = {k for k in got if k[2] == "can_generate"}
    assert {k[0] for k in reads} == {"dvc-file:src/t.py", "dvc-file:src/data/x.csv", "dvc-param:src/params.yaml", "dvc-param:src/other.yaml"} and {k[1] for k in makes} == {"dvc-file:src/model.bin", "dvc-file:src/m.json"}
    locked = {k: v for k, v in got.items() if "dvc-lock-record" in v}
    assert {k[0] if k[2] == "declares_read" else k[1] for k in locked} == {"dvc-file:src/t.py", "dvc-file:src/model.bin"}
    assert importers.warnings_of(load(spark, "dvc", "stages: [1]", lock="")).count() == 1


def test_pipeline_declarations(spark):
    text = "steps:\n  - name: plot\n    command: python plot.py --token=abc\n    inputs: [data/a.csv]\n    outputs: fig/a.png\n    expected_outputs: fig/*.svg\n"
    got = edges_of(load(spark, "pipeline-declaration", text))
    key = "pipeline:src/manifest:plot"
    assert set(got) == {("file:data/a.csv", key, "declares_read"), (key, "file:fig/a.png", "can_generate"), (key, "pattern:src/manifest:plot:fig/*.svg", "expected_output")}
    assert all(v == {"pipeline-declaration": (0.92, False)} for v in got.values())
    declared = spark.createDataFrame([("plot", ["p"], "o"), ("plot", ["p"], "other"), ("none", [], "o")], "step string, command array<string>, output string")
    ran = spark.createDataFrame([("r1", 1, "completed", "direct-runtime", ["p"], "o"), ("r2", 2, "completed", "direct-runtime", ["p"], "o"), ("r3", 3, "failed", "direct-runtime", ["p"], "o"), ("r4", 4, "completed", "clean-boundary", ["p"], "other")], "run_id string, seq int, status string, capture_quality string, command array<string>, path string")
    assert {(r.step, r.output): (r.run_id, r.relation) for r in importers.corroborated(declared, ran).collect()} == {("plot", "o"): ("r2", "was_generated_by"), ("plot", "other"): (None, "can_generate"), ("none", "o"): (None, "can_generate")}


@pytest.mark.parametrize("trusted", [False, True])
def test_lineage_events(spark, trusted):
    event = {"eventType": "COMPLETE", "eventTime": "2026-01-01T00:00:00Z", "run": {"runId": "1", "facets": {"parent": {}, "environmentVariables": {"TOKEN": "abc"}}}, "job": {"namespace": "n", "name": "j"}, "producer": "p", "inputs": [{"namespace": "file", "name": "a.csv"}], "outputs": [{"namespace": "s3", "name": "b"}]}
    records = load(spark, "openlineage", json.dumps(event) + "\n" + json.dumps({"eventType": "START"}), trusted)
    got = edges_of(records)
    assert {k[2] for k in got} == {"run_of", "was_associated_with", *(("observed_used_during", "was_generated_by") if trusted else ("declares_read", "can_generate"))}
    assert {x for v in got.values() for x in v.values()} == {(0.9, True) if trusted else (0.65, False)}
    assert [(r.id, r.status) for r in importers.runs(records).orderBy("id").collect()] == [("run:openlineage:1", "completed"), ("run:openlineage:event-2", "in_progress")]
    assert not any("abc" in r.body for r in records.collect())


def test_code_graph_and_endpoints(spark):
    graph = {"schema": 1, "nodes": [{"id": "f", "path": "a.py"}, {"id": "d", "path": "x.csv"}], "edges": [{"source": "f", "target": "d", "relation": "reads"}, {"source": "f", "target": "d", "relation": "writes"}, {"source": "f", "target": "gone"}]}
    records = load(spark, "codegraph", json.dumps(graph))
    assert set(edges_of(records)) == {("codegraph:d", "codegraph:f", "used"), ("codegraph:f", "codegraph:d", "generated")}
    assert importers.warnings_of(records).count() == 1
    artifacts = spark.createDataFrame([("a.py", "id:a")], "path string, artifact_id string")
    found, lost = importers.resolved(records.unionByName(records), artifacts)
    got = found.collect()
    assert len(got) == 2 and lost.count() == 0 and all("id:a" in (r.source_id, r.target_id) for r in got)
    assert {r.score for r in C.fold_evidence(importers.evidence_of(found)).collect()} == {0.65}


def test_run_manifest_keeps_nothing_private(spark):
    value = {"id": "7", "task": "do password=hunter2 now", "status": "odd", "command": ["x", "--token", "t0p", "https://u:pw1@h/"], "session_ref": "sess9", "metadata": {"prompt": "say", "safe": "yes", "note": "secret: zz9"}, "changes": {"created": ["a.txt"], "deleted": ["b.txt"]}}
    records = load(spark, "agent-run", json.dumps(value), True)
    said = " ".join(r.body for r in records.collect())
    assert not any(x in said for x in ("hunter2", "t0p", "pw1", "sess9", "zz9", "say")) and "safe" in said
    assert {k[2] for k in edges_of(records)} == {"was_generated_by", "observed_deleted_during"}
    assert importers.runs(records).first().status == "incomplete"


@pytest.mark.parametrize("trusted", [False, True])
def test_foreign_provenance(spark, trusted):
    graph = {"@graph": [{"@id": "e1", "@type": "prov:Entity"}, {"@id": "a1", "@type": ["prov:Activity"], "prov:used": {"@id": "e1"}}, {"@id": "g", "@type": "prov:Agent"}, {"@id": "u", "@type": importers.PROV + "Usage", "prov:activity": {"@id": "a1"}, "prov:entity": {"@id": "e1"}}, {"@id": "s", "@type": "prov:Association", "prov:activity": {"@id": "a1"}, "prov:agent": {"@id": "g"}}]}
    got = edges_of(load(spark, "w3c-prov", json.dumps(graph), trusted))
    assert {k[2] for k in got} == {"observed_used_during" if trusted else "declares_read", "was_associated_with"}


def test_own_provenance_round_trip(spark):
    from provgraph.operators.exports import provenance_export

    nodes = spark.createDataFrame([("run:1", "run", "r", "@run/1"), ("f1", "file", "a", "a.txt"), ("f2", "file", "b", "b.txt")], "id string, kind string, label string, path string")
    claims = spark.createDataFrame([("c1", "run:1", "f1", "was_generated_by", 1.0), ("c2", "f1", "f2", "derived_from", 0.6), ("c3", "run:1", "f2", "generated", 0.6)], "claim_id string, source_id string, target_id string, relation string, score double")
    items = [json.loads(r.item) for r in provenance_export(nodes, claims).collect()]
    assert {(x["tfl:internalRelation"], x["@type"], x["tfl:candidateRank"]) for x in items if "tfl:internalRelation" in x} == {("was_generated_by", "prov:Influence", 1), ("derived_from", "prov:Derivation", 1), ("generated", "prov:Generation", 2)}
    got = edges_of(load(spark, "w3c-prov", json.dumps({"@graph": items}), True))
    assert set(got) == {("run:1", "f1", "was_generated_by"), ("f1", "f2", "derived_from"), ("run:1", "f2", "generated")}


def test_document_edges(spark):
    text = " ".join(f"w{k}" for k in range(30))
    form = "id string, path string, text string, sha256 string, mtime_ns long, media array<string>, prints array<string>"
    hour = 3600 * 10**9
    sources = spark.createDataFrame([("s1", "a/Report.docx", text, "x1", hour, ["i1"], []), ("s2", "b/other.md", "unrelated words only here now", "x2", hour, [], ["p"])], form)
    targets = spark.createDataFrame([("t1", "out/report.pdf", text, "x3", 2 * hour, [], []), ("t2", "i.png", None, "i1", 9 * hour, [], ["p"]), ("t3", "out/other.pdf", "nothing alike in this text at all", "x4", hour, [], [])], form)
    got = {(r.source_id, r.target_id): (r.relation, r.score) for r in documents.document_edges(documents.document_evidence(sources, targets)).collect()}
    assert got == {("s1", "t1"): ("content_matches", round(1 - 0.28 * 0.7 * 0.75, 4)), ("s1", "t2"): ("embedded_bytes_match", 0.85), ("s2", "t2"): ("content_matches", 0.8)}


def test_text_and_path_functions(spark):
    row = spark.createDataFrame([("a token: abc, x", {"prompt": "p", "url": "https://u:pw@h/", "k": "secret=s"}, r"C:\Ä\X.txt")], "t string, m map<string,string>, p string")
    got = row.select(T.redacted(F.col("t")).alias("t"), T.safe_metadata(F.col("m")).alias("m"), P.path_key(F.col("p")).alias("p"), T.private_reference(F.lit("x"), "session").alias("r"), P.template(F.lit("run_12_Final")).alias("n")).first()
    assert (got.t, got.m, got.p, len(got.r), got.n) == ("a token: [REDACTED], x", {"url": "https://u:[REDACTED]@h/", "k": "secret=[REDACTED]"}, "c:/ä/x.txt", 24, "run_{n}-{stage}")
