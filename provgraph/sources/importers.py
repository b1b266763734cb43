"""Readers of other tools' records: provenance graphs, pipelines, lineage events, code graphs, run manifests.

``imported`` parses manifests (path, content), one Arrow row each, to records; ``nodes``, ``edges``,
``runs`` and ``warnings_of`` are their tables, and ``resolved`` joins edges to artifacts. Records that are
not trusted are candidates: their weight is lower, and none may be exact.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import shlex
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.functions.text import CREDENTIAL, SECRET, SENSITIVE
from provgraph.sources.extract import tidy
from provgraph.sources.structured import StructuredError, load

# Relations of a code graph; all others are references. Reads go from the file to the code.
CODE_RELATIONS = {"read": "used", "reads": "used", "write": "generated", "writes": "generated", "generates": "generated", "import": "imports", "imports": "imports", "call": "calls", "calls": "calls", "references": "references"}
# The state of a run after an event.
EVENT_STATUS = {"COMPLETE": "completed", "ABORT": "interrupted", "FAIL": "incomplete", "START": "in_progress", "RUNNING": "in_progress"}
# Facets that tell nothing private.
FACETS = ["schema", "dataSource", "lifecycleStateChange", "version", "datasetType", "outputStatistics", "inputStatistics", "nominalTime", "parent", "tags", "sourceCodeLocation", "ownership", "documentation"]
STATUSES = ["completed", "complete", "interrupted", "recovered", "incomplete", "in_progress"]
PROV = "http://www.w3.org/ns/prov#"

EVIDENCE = "array<struct<kind:string,mode:string,weight:double,signal_group:string,basis:string,assurance:string,exact_allowed:boolean,status:string,trusted:boolean>>"
NODE = "key string, kind string, label string, path string, metadata string"
EDGE = f"source string, target string, relation string, evidence {EVIDENCE}, adapter string, mode string, source_path string"
RUN = "id string, task string, started_at string, finished_at string, cwd string, command array<string>, exit_code int, status string, created array<string>, modified array<string>, deleted array<string>, metadata string"


class Records:
    """What a manifest gives."""

    def __init__(self, adapter: str, path: str, trusted: bool):
        self.adapter, self.path, self.trusted = adapter, path, trusted
        self.rows: list[tuple[str, dict]] = []

    def node(self, key: str, kind: str, label: str, path: str, metadata: dict | None = None) -> str:
        self.rows.append(("node", {"key": key, "kind": kind, "label": label, "path": path, "metadata": json.dumps(metadata or {}, sort_keys=True)}))
        return key

    def file(self, path: str, prefix: str, kind: str = "file") -> str:
        return self.node(f"{prefix}:{path}", kind, posixpath.basename(path), path)

    def edge(self, source: str, target: str, relation: str, evidence: list[dict], mode: str = "imported", **more) -> None:
        self.rows.append(("edge", {"source": source, "target": target, "relation": relation, "evidence": evidence, "adapter": self.adapter, "mode": mode, "source_path": self.path} | more))

    def warn(self, text: str) -> None:
        self.rows.append(("warning", {"text": text}))

    def fact(self, kind: str, mode: str, weight: float, group: str, **more) -> dict:
        return {"kind": kind, "mode": mode, "weight": weight, "signal_group": group, "basis": {"explicit": "declaration"}.get(mode, "observation"), "assurance": None, "exact_allowed": False, "status": "active", "trusted": False} | more

    def told(self, kind: str, trusted: float, group: str) -> dict:
        """Evidence of a record that is only as good as the trust in it."""
        sure = {"basis": "confirmation", "assurance": "verified", "exact_allowed": True, "trusted": True} if self.trusted else {"assurance": "candidate"}
        return self.fact(kind, "imported", trusted if self.trusted else 0.65, "trusted-provenance" if self.trusted else group, **sure)


def private(value):
    """A value without sensitive keys, with secrets and credentials redacted."""
    if isinstance(value, dict):
        return {str(k): private(v) for k, v in value.items() if not re.search(SENSITIVE, str(k))}
    if isinstance(value, list):
        return [private(v) for v in value]
    return hidden(value) if isinstance(value, str) else value


def hidden(text: str) -> str:
    return re.sub(CREDENTIAL, r"\1[REDACTED]\3", re.sub(SECRET, r"\1\2[REDACTED]", text))


def hidden_command(words: list | None) -> list[str] | None:
    if not isinstance(words, list):
        return None
    out, hide = [], False
    for w in map(str, words):
        out.append("[REDACTED]" if hide else hidden(w))
        hide = not hide and bool(re.fullmatch(r"(?i)--?(password|passwd|token|secret|api[-_]?key)", w))
    return out


def listed(x) -> list:
    return x if isinstance(x, list) else [] if x is None else [x]


def _objects(x) -> list[dict]:
    return [v for v in listed(x) if isinstance(v, dict)]


def _json(text: str):
    """A JSON value, or the list of those of all lines."""
    try:
        return json.loads(text)
    except ValueError:
        return [json.loads(line) for line in text.splitlines() if line.strip()]


# ---- provenance graphs


def provenance(text: str, out: Records) -> None:
    """A PROV graph in JSON-LD: an export of this engine by its own terms, any other by qualified and plain relations."""
    graph = json.loads(text).get("@graph", [])
    if not isinstance(graph, list):
        return out.warn("@graph must be a list")
    items = [x for x in graph if isinstance(x, dict) and x.get("@id")]
    kinds = lambda x: {t.replace(PROV, "prov:") for t in map(str, listed(x.get("@type")))}
    relations = {"prov:Usage", "prov:Generation", "prov:Derivation", "prov:Association", "prov:Influence"}
    keys: dict[str, str] = {}
    for x in items:
        if kinds(x) & relations or x.get("tfl:internalNode") is False:
            continue
        iri = str(x["@id"])
        mark = hashlib.sha256(iri.encode()).hexdigest()[:24]
        kind = "activity" if "prov:Activity" in kinds(x) else "agent" if "prov:Agent" in kinds(x) else "entity"
        path = str(x.get("tfl:path") or f"@prov/{mark}")
        keys[iri] = out.node(str(x.get("tfl:internalId") or f"prov:{mark}"), str(x.get("tfl:kind") or kind), str(x.get("label") or posixpath.basename(path) or iri), path, private(x.get("tfl:metadata") or {}))
    own = [x for x in items if kinds(x) & relations]
    if any(x.get("tfl:internalRelation") for x in own):
        inside = set(keys.values())
        for x in own:
            if not (relation := x.get("tfl:internalRelation")):
                continue
            a, b = x.get("tfl:internalSource"), x.get("tfl:internalTarget")
            if a not in inside or b not in inside:
                out.warn(f"relation without an end: {a} -> {b}")
                continue
            held = [out.fact(str(e.get("kind")), str(e.get("mode")), float(e.get("weight") or 0), str(e.get("signal_group"))) | {k: e[k] for k in ("basis", "assurance", "status") if k in e} | {"exact_allowed": bool(e.get("exact_allowed")) and out.trusted} for e in _objects(x.get("tfl:evidence"))]
            held.append(out.told("w3c-prov-import-envelope", 0.0, "import-context") | {"weight": 0.0, "signal_group": "import-context"} if held else out.told("w3c-prov-import", 0.90, "imported-provenance"))
            where = x.get("tfl:adapterMetadata")
            out.edge(a, b, str(relation), held, str(x.get("tfl:capturedOrInferred") or "imported"), adapter=str(x.get("tfl:adapter") or out.adapter), source_path=(where.get("source_path") if isinstance(where, dict) else out.path) or out.path)
        return None
    told = [out.told("w3c-prov-import", 0.90, "imported-provenance")]
    use, make = ("observed_used_during", "was_generated_by") if out.trusted else ("declares_read", "can_generate")
    refs = lambda x, name: [keys[i] for v in listed(x.get(f"prov:{name}", x.get(PROV + name))) if isinstance(v, dict) and (i := str(v.get("@id"))) in keys]
    for x in items:
        if me := keys.get(str(x["@id"])):
            for name, relation, forward in (("used", use, True), ("wasGeneratedBy", make, True), ("wasDerivedFrom", "derived_from", True), ("wasAssociatedWith", "was_associated_with", False)):
                for other in refs(x, name):
                    out.edge(*((other, me) if forward else (me, other)), relation, told)
    qualified = {"prov:Usage": ("entity", "activity", use), "prov:Generation": ("activity", "entity", make), "prov:Derivation": ("usedEntity", "generatedEntity", "derived_from"), "prov:Association": ("activity", "agent", "was_associated_with")}
    for x in own:
        for kind, (a, b, relation) in qualified.items():
            if kind in kinds(x) and (left := refs(x, a)) and (right := refs(x, b)):
                out.edge(left[0], right[0], relation, told)
    return None


# ---- pipelines


def _command(x) -> list[str]:
    if isinstance(x, str):
        try:
            return shlex.split(x)
        except ValueError:
            return x.split()
    return [str(v) for v in x] if isinstance(x, list) else []


def _paths(x) -> list[str]:
    return [p for v in listed(x) if (p := tidy(v if isinstance(v, str) else str(next(iter(v), "")) if isinstance(v, dict) else ""))]


def pipeline(text: str, out: Records) -> None:
    """A pipeline declaration: steps with inputs, outputs and patterns of outputs.

    Whether a step ran as declared is a join with captured runs (``corroborated``).
    """
    steps = load(text, out.path).get("steps") or []
    if isinstance(steps, dict):
        steps = [{"name": k} | (v if isinstance(v, dict) else {}) for k, v in steps.items()]
    for k, step in enumerate(listed(steps)):
        if not isinstance(step, dict):
            out.warn(f"step {k + 1} is not a mapping")
            continue
        name, command = str(step.get("name") or f"step-{k + 1}"), _command(step.get("command") or step.get("cmd"))
        patterns = _paths(step.get("expected_output_patterns") or step.get("expected_outputs"))
        key = out.node(f"pipeline:{out.path}:{name}", "activity", name, f"@pipeline/{out.path}/{name}", {"command": hidden_command(command), "parameters": private(step.get("parameters", step.get("params", {}))), "expected_output_patterns": patterns})
        told = [out.fact("pipeline-declaration", "explicit", 0.92, f"declaration:{key}")]
        for p in _paths(step.get("inputs")):
            out.edge(out.file(p, "file"), key, "declares_read", told, "explicit")
        for p in _paths(step.get("outputs")):
            out.edge(key, out.file(p, "file"), "can_generate", told, "explicit")
        for p in patterns:
            out.edge(key, out.node(f"pattern:{out.path}:{name}:{p}", "pattern", p, f"@pattern/{p}"), "expected_output", told, "explicit")


def staged(text: str, out: Records, lock: str | None = None) -> None:
    """A data pipeline of stages (dvc.yaml), with the record of its last run (dvc.lock) where there is one."""
    stages = load(text, "dvc.yaml").get("stages") or {}
    ran = (load(lock, "dvc.lock").get("stages") or {}) if lock else {}
    if not isinstance(stages, dict):
        return out.warn("stages must be a mapping")
    for name, stage in stages.items():
        if not isinstance(stage, dict):
            out.warn(f"stage {name} is not a mapping")
            continue
        key = out.node(f"dvc-stage:{out.path}:{name}", "activity", str(name), f"@dvc/{out.path}/{name}", {"command": hidden(str(stage.get("cmd") or "")), "wdir": stage.get("wdir")})
        told = out.fact("dvc-stage-declaration", "explicit", 0.92, f"dvc-stage:{name}")
        here = posixpath.join(posixpath.dirname(out.path), str(stage.get("wdir") or ""))
        place = lambda p: f"@external/{p}" if "://" in p else tidy(posixpath.join(here, p))  # noqa: E731, B023
        entry = lambda v: v if isinstance(v, str) else str(next(iter(v), "")) if isinstance(v, dict) else ""
        for role, relation in (("deps", "declares_read"), ("outs", "can_generate"), ("metrics", "can_generate")):
            for item in filter(None, map(entry, listed(stage.get(role)))):
                held = [told]
                record = ran.get(name) if isinstance(ran, dict) else None
                if isinstance(record, dict) and any(v.get("path") == item for r in (role, "outs") for v in _objects(record.get(r))):
                    held.append(out.fact("dvc-lock-record", "imported", 0.96, "trusted-provenance"))
                if role == "metrics":
                    held.append(out.fact("dvc-metric", "explicit", 0.75, "dvc-role"))
                node = out.file(place(item), "dvc-file", "dataset" if "://" in item else "file")
                out.edge(*((node, key) if role == "deps" else (key, node)), relation, held, "explicit")
        for item in listed(stage.get("params")):
            p = entry(item)
            if isinstance(item, dict) or p.lower().endswith((".yaml", ".yml", ".json", ".toml")):
                held = [told, out.fact("dvc-parameter-dependency", "explicit", 0.90, "dvc-params")]
                out.edge(out.file(place(p), "dvc-param", "configuration"), key, "declares_read", held, "explicit")
    return None


# ---- events, code graphs, run manifests


def events(text: str, out: Records) -> None:
    """Lineage events: jobs, runs, who ran them, and the data sets that they read and wrote."""
    safe = lambda x: private({k: v for k, v in x.items() if k in FACETS}) if isinstance(x, dict) else {}
    part = lambda x, k: x[k] if isinstance(x.get(k), dict) else {}
    for n, event in enumerate(_objects(_json(text))):
        run, job, state = part(event, "run"), part(event, "job"), str(event.get("eventType") or "OTHER").upper()
        number, space, name = str(run.get("runId") or f"event-{n + 1}"), str(job.get("namespace") or "default"), str(job.get("name") or "unknown-job")
        told = [out.told("openlineage-run-event", 0.90, "imported-provenance")]
        at = out.node(f"openlineage-job:{space}:{name}", "job", name, f"@openlineage/job/{space}/{name}", {"facets": safe(job.get("facets"))})
        me = out.node(f"run:openlineage:{number}", "activity", f"{name} {number}", f"@run/openlineage/{number}", {"event_type": state})
        out.edge(at, me, "run_of", told)
        if by := event.get("producer"):
            agent = out.node(f"openlineage-agent:{by}", "agent", str(by), "@agent/openlineage/" + hashlib.sha256(str(by).encode()).hexdigest()[:16])
            out.edge(me, agent, "was_associated_with", told)
        for side, relation in (("inputs", "observed_used_during" if out.trusted else "declares_read"), ("outputs", "was_generated_by" if out.trusted else "can_generate")):
            for d in _objects(event.get(side)):
                place, title = str(d.get("namespace") or "default"), str(d.get("name") or "unknown-dataset")
                path = tidy(title[7:]) if title.startswith("file://") else tidy(title) if place in ("file", "local", ".") and not title.startswith("/") else f"@dataset/{place}/{title}"
                node = out.node(f"openlineage-dataset:{place}:{title}", "dataset", title, path, {"facets": safe(d.get("facets")), "io_facets": safe(d.get("inputFacets") or d.get("outputFacets"))})
                out.edge(*((node, me) if side == "inputs" else (me, node)), relation, told)
        when = event.get("eventTime")
        out.rows.append(("run", {"id": me, "task": name, "started_at": when if state in ("START", "RUNNING") else None, "finished_at": when if state in ("COMPLETE", "ABORT", "FAIL") else None, "cwd": ".", "status": EVENT_STATUS.get(state, "unknown"), "created": [], "modified": [], "deleted": [], "metadata": json.dumps({"job": {"namespace": space, "name": name}, "facets": safe(run.get("facets")), "trusted": out.trusted}, sort_keys=True)}))


def code_graph(text: str, out: Records) -> None:
    """A graph of code symbols and their relations."""
    value = json.loads(text)
    if not isinstance(value, dict):
        return out.warn("a code graph must be an object")
    if not re.search(r"(^|codegraph-v)1$", str(value.get("schema") or value.get("schema_version"))):
        out.warn("unknown schema; only plain fields are read")
    keys = {}
    for k, n in enumerate(_objects(value.get("nodes"))):
        name = str(n.get("id") or n.get("key") or f"node-{k + 1}")
        path = tidy(str(n["path"])) if n.get("path") else f"@codegraph/{name}"
        keys[name] = out.node(f"codegraph:{name}", str(n.get("kind") or "code-symbol"), str(n.get("label") or posixpath.basename(path)), path, private(n.get("metadata") or {}))
    for e in _objects(value.get("edges")):
        a, b, relation = str(e.get("source")), str(e.get("target")), str(e.get("relation") or "references").lower()
        if a not in keys or b not in keys:
            out.warn(f"edge with an unknown end: {a} -> {b}")
            continue
        ends = (keys[b], keys[a]) if relation in ("read", "reads") else (keys[a], keys[b])
        told = out.fact("external-code-graph", "imported", 0.90 if out.trusted else 0.65, "trusted-provenance" if out.trusted else "imported-codegraph", trusted=out.trusted)
        out.edge(*ends, CODE_RELATIONS.get(relation, "references"), [told])
    return None


def run_manifest(text: str, out: Records) -> None:
    """A manifest of one run and the files that it changed; nothing private of it is kept."""
    value = json.loads(text)
    if not isinstance(value, dict):
        return out.warn("a run manifest must be an object")
    mark = lambda x, name: f"{name}-{hashlib.sha256(str(x).encode()).hexdigest()[:16]}"
    me = f"run:manifest:{value.get('id') or hashlib.sha256(text.encode()).hexdigest()[:16]}"
    platform = str(value.get("agent_platform") or value.get("platform") or "generic")
    changes = value.get("changes") if isinstance(value.get("changes"), dict) else {}
    paths = {k: [tidy(p) for p in listed(changes.get(k)) if isinstance(p, str)] for k in ("created", "modified", "deleted")}
    metadata = private(value.get("metadata") or {}) | {f"{k}_ref": mark(value[f"{k}_ref"], k) for k in ("session", "handoff") if value.get(f"{k}_ref")} | {"agent_platform": platform, "trusted": out.trusted}
    task = hidden(" ".join(str(value.get("task") or f"{platform} task").split()))
    task = task[:239] + "…" if len(task) > 240 else task
    status = str(value.get("status") or "incomplete")
    out.rows.append(("run", {"id": me, "task": task, "started_at": value.get("started_at"), "finished_at": value.get("finished_at"), "cwd": tidy(str(value.get("cwd") or ".")) or ".", "command": hidden_command(value.get("command")), "exit_code": value["exit_code"] if isinstance(value.get("exit_code"), int) else None, "status": status if status in STATUSES else "incomplete", "metadata": json.dumps(metadata, sort_keys=True)} | paths))
    out.node(me, "activity", task, f"@run/{me}", metadata)
    told = [out.told("agent-run-manifest", 0.95, "imported-agent-run")]
    for change, those in paths.items():
        relation = "was_generated_by" if out.trusted and change != "deleted" else f"observed_{change}_during"
        for p in those:
            out.edge(me, out.file(p, "agent-run-file"), relation, told)
    return None


READERS = {"w3c-prov": provenance, "dvc": staged, "openlineage": events, "codegraph": code_graph, "agent-run": run_manifest, "pipeline-declaration": pipeline}


def _parse(adapter: str, trusted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                out = Records(adapter, at["path"][k].as_py(), trusted)
                more = {"lock": (at["lock"][k].as_py() or b"").decode("utf-8-sig", "replace") or None} if adapter == "dvc" else {}
                try:
                    READERS[adapter]((at["content"][k].as_py() or b"").decode("utf-8-sig"), out, **more)
                except (ValueError, StructuredError, AttributeError, KeyError, TypeError) as e:
                    out.warn(f"unable to parse: {e}"[:300])
                yield pa.RecordBatch.from_arrays([pa.array([out.path] * len(out.rows), pa.string()), pa.array([r for r, _ in out.rows], pa.string()), pa.array([json.dumps(b, ensure_ascii=False) for _, b in out.rows], pa.string())], ["manifest", "record", "body"])

    return run


def imported(manifests: DataFrame, adapter: str, trusted: bool = False) -> DataFrame:
    """(manifest, record, body) of manifests (path, content; for stages also lock) by one of ``READERS``."""
    columns = ["path", "content", *(["lock"] if adapter == "dvc" else [])]
    return manifests.select(*(F.col(c).cast("string" if c == "path" else "binary") for c in columns)).mapInArrow(_parse(adapter, trusted), "manifest string, record string, body string")


def _table(records: DataFrame, record: str, form: str) -> DataFrame:
    return records.where(F.col("record") == record).select("manifest", F.from_json("body", form).alias("b")).select("manifest", "b.*")


def nodes(records: DataFrame) -> DataFrame:
    """One node for each key."""
    return _table(records, "node", NODE).groupBy("key").agg(*(F.min_by(c, F.struct("manifest", "path", c)).alias(c) for c in ("kind", "label", "path", "metadata")))


def edges(records: DataFrame) -> DataFrame:
    return _table(records, "edge", EDGE)


def runs(records: DataFrame) -> DataFrame:
    return _table(records, "run", RUN)


def warnings_of(records: DataFrame) -> DataFrame:
    return _table(records, "warning", "text string")


def resolved(records: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims' evidence, edges without an end): edges joined to artifacts by the paths of their nodes, else to virtual ids.

    An edge's id follows from its adapter, ends, relation and source path, so an edge that is imported
    again is the same one.
    """
    known = artifacts.select("path", "artifact_id")
    ids = nodes(records).join(known, "path", "left").select("key", F.coalesce("artifact_id", F.when(F.col("key").startswith("run:"), F.col("key")), F.concat("kind", F.lit(":"), F.left(F.sha2("key", 256), F.lit(24)))).alias("id"))
    e = edges(records)
    for end in ("source", "target"):
        e = e.join(ids.withColumnsRenamed({"key": end, "id": f"{end}_id"}), end, "left")
    whole = F.col("source_id").isNotNull() & F.col("target_id").isNotNull()
    named = e.where(whole).withColumn("claim_id", F.concat(F.lit("edge:"), F.left(F.sha2(F.to_json(F.array("adapter", "source", "target", "relation", "source_path")), 256), F.lit(32))))
    last = named.groupBy("claim_id").agg(*(F.min(c).alias(c) for c in ("source_id", "target_id", "relation", "adapter", "mode", "source_path")), F.array_distinct(F.flatten(F.collect_list("evidence"))).alias("evidence"))
    return last, e.where(~whole).select("source", "target", "relation")


def evidence_of(claims: DataFrame) -> DataFrame:
    """Evidence rows of ``resolved`` claims, as ``operators.claims.fold_evidence`` takes them."""
    x = claims.select("claim_id", "source_id", "target_id", "relation", F.explode("evidence").alias("e"))
    return x.select("claim_id", "source_id", "target_id", "relation", "e.signal_group", "e.weight", (F.col("e.status") == "active").alias("active"), "e.exact_allowed", "e.basis", "e.mode", "e.kind", "e.trusted")


def corroborated(declared: DataFrame, captured: DataFrame) -> DataFrame:
    """Declared outputs (step, command, output) with the last run that made them by the same command.

    ``captured``: (run_id, seq, status, capture_quality, command, path) of changed paths. The relation is
    was_generated_by where a direct run is found, else can_generate.
    """
    good = captured.where((F.col("capture_quality") == "direct-runtime") & F.col("status").isin("completed", "complete", "interrupted"))
    last = good.groupBy(F.col("command"), F.col("path").alias("output")).agg(F.max_by("run_id", F.struct("seq", "run_id")).alias("run_id"))
    found = declared.join(last, ["command", "output"], "left")
    return found.select("step", "output", "run_id", F.when(F.col("run_id").isNotNull() & (F.size("command") > 0), "was_generated_by").otherwise("can_generate").alias("relation"))
