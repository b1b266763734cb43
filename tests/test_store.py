"""The claim store, capture, exports and the stream of run states."""


from pyspark.sql import functions as F

from provgraph.functions.paths import excluded
from provgraph.functions.text import safe_url
from provgraph.operators import capture, exports, origin, similarity, snapshots, store
from provgraph.sources import config
from provgraph.streaming import runs

ARTIFACTS = [("1", "src/a.py", "code", "a.py", False, "2026-01-02"), ("2", "lib/a.py", "code", "a.py", False, "2026-01-03"), ("3", "docs/final panel.png", "image", "final panel.png", False, "2026-01-04"), ("4", "gone.txt", "document", "gone.txt", True, "2026-01-01"), ("5", "@missing/x", "missing-file", "x", False, "2026-01-05")]


def artifacts(spark):
    return spark.createDataFrame(ARTIFACTS, "artifact_id string, path string, kind string, label string, deleted boolean, last_seen string")


def test_lookups(spark):
    a = artifacts(spark)
    asked = spark.createDataFrame([("src/a.py",), ("a.py",), ("final panel.png",), ("gone.txt",), ("nil",)], "requested string")
    assert {r.requested: r.artifact_id for r in store.resolve(asked, a).collect()} == {"src/a.py": "1", "a.py": None, "final panel.png": "3", "gone.txt": "4", "nil": None}
    assert [r.artifact_id for r in store.files(a).collect()] == ["5", "3", "2", "1"] and a.where(store.real()).count() == 3
    aliases = spark.createDataFrame([("x", "1", 1), ("x", "2", 2), ("y", "9", 1)], "alias string, artifact_id string, last_seen int")
    assert [tuple(r) for r in store.by_alias(aliases, a).collect()] == [("x", "2")]
    records = spark.createDataFrame([("1", "panel here"), ("4", "panel too")], "file_id string, text string")
    found = lambda **k: {r.artifact_id: r.matched for r in store.find(a, "Panel", records, **k).collect()}
    assert found() == {"1": "text", "3": "filename"} and found(kind="code") == {"1": "text"} and found(status="deleted") == {"4": "text"}
    assert found(since="2026-01-03") == {"3": "filename"} and found(limit=1) == {"3": "filename"}
    assert {r.file_id for r in store.texts(records, a).collect()} == {"1"}
    assert store.same_path(a, spark.createDataFrame([("SRC/A.py",)], "path string")).count() == 1


def test_claims_and_decisions(spark):
    claims = spark.createDataFrame([("c1", "a", "b", "used", 0.5, "active", "p1"), ("c2", "a", "c", "used", 0.9, "active", "p1"), ("c3", "x", "y", "calls", 0.7, "active", "p2")], "claim_id string, source_id string, target_id string, relation string, score double, status string, source_path string")
    no = spark.createDataFrame([("c1", None, None, None, "reject", "active"), (None, "x", "y", "calls", "reject", "active"), ("c2", None, None, None, "reject", "undone")], "claim_id string, source_id string, target_id string, relation string, action string, status string")
    held = store.unsuppressed(claims, no)
    assert {r.claim_id: r.status for r in held.collect()} == {"c1": "rejected", "c2": "active", "c3": "rejected"}
    assert [r.claim_id for r in store.edges(held, 0.1).collect()] == ["c2"]
    again = spark.createDataFrame([("p1", "c1"), ("p3", None)], "source_path string, claim_id string")
    assert {r.claim_id: r.status for r in store.superseded(claims, again).collect()} == {"c1": "active", "c2": "superseded", "c3": "active"}
    fresh = spark.createDataFrame([("c1", 1), ("c1", 2)], "claim_id string, seq int").withColumn("score", F.col("seq") / 10)
    assert {r.claim_id: r.score for r in store.upserted(claims.select("claim_id", "score"), fresh, "claim_id").collect()} == {"c1": 0.2, "c2": 0.9, "c3": 0.7}
    states = spark.createDataFrame([("r", 1, "created"), ("r", 2, "created"), ("r", 3, "completed")], "run_id string, seq int, status string")
    assert [r.seq for r in store.transitions(states).orderBy("seq").collect()] == [1, 3]
    versions = spark.createDataFrame([("1", "A", 1), ("1", "B", 2)], "artifact_id string, sha256 string, observed_at int")
    assert store.observed_versions(versions, versions.withColumn("observed_at", F.lit(3))).count() == 2
    assert {r.name: r.n for r in store.counted({"runs": states, "claims": claims}).collect()} == {"runs": 3}
    assert {k: v.count() for k, v in store.prepared_rebuild({"runs": states, "claims": claims}).items()} == {"runs": 3, "claims": 0}


def test_decisions_fold_by_their_ids(spark):
    log = [("a", 1, "reject", None), ("a", 2, "reject", None), ("a", 3, "undo", 1), ("b", 4, "reject", None), ("b", 5, "undo", 4), ("b", 6, "undo", 4), ("c", 7, "confirm", None), ("c", 8, "undo", 7), ("d", 9, "confirm", None), ("e", 10, "reject", None), ("e", 11, "undo", 99), ("f", 12, "reject", None), ("f", 13, "reject", None), ("f", 14, "undo", 12), ("f", 15, "undo", 13)]
    got = snapshots.fold_decisions(spark.createDataFrame(log, "claim_id string, seq int, action string, undoes int"))
    assert {r.claim_id: r.status for r in got.collect()} == {"a": "rejected", "b": "active", "c": "withdrawn", "d": "active", "e": "rejected", "f": "active"}


def test_settings_and_urls(spark):
    s = config.settings('[lineage]\nexclude = ["tmp/**"]\nmin_confidence = 0.5\nunknown = 1\n')
    assert s.exclude[-1] == "tmp/**" and ".git/**" in s.exclude and s.min_confidence == 0.5 and config.settings().include == []
    urls = ["https://u:p@Host.net:8080/a?b#c", "HTTP://x.org", "file:///etc/passwd", "mailto:a@b", "data:x", None]
    frame = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in frame.select(safe_url(F.col("u"))).collect()] == ["https://host.net:8080/a", "http://x.org/", "file:///[local-path-redacted]", None, None, None]
    paths = spark.createDataFrame([("a.py",), (".git/x",), ("dir/id_rsa",), ("my secret.txt",), ("venv/lib/a.py",), ("src/venv.py",)], "p string")
    assert [r.p for r in paths.where(~excluded(F.col("p"), [], s.exclude, s.redaction_patterns)).collect()] == ["a.py", "dir/id_rsa", "src/venv.py"]


def test_virtual_ends(spark):
    a = artifacts(spark)
    found = store.resolved_candidates(spark.createDataFrame([("src/a.py", "new.csv", "can_generate"), ("@origin/u", "new.csv", "downloaded_from")], "source_path string, target_path string, relation string"), a).collect()
    ids = {r.relation: (r.source_id, r.target_id) for r in found}
    assert ids["can_generate"][0] == "1" and ids["can_generate"][1] == ids["downloaded_from"][1] and ids["downloaded_from"][0].startswith("external-origin:")
    held = store.adapters_for(a, {"text": ["py"], "image": ["png"], "off": ["py"]}, ["text", "image"])
    assert {(r.artifact_id, r.adapter) for r in held.collect()} == {("1", "text"), ("2", "text"), ("3", "image")}


def test_download_origins(spark):
    rows = [("a.zip", "https://u:p@H.org/x?t=1", "windows-zone"), ("a.zip", "https://h.org/x", "windows-zone"), ("a.zip", "file:///home/me", "linux-xattr"), ("b", "javascript:x", "linux-xattr"), ("b", "http://h.org", "unheard-of")]
    got = origin.origin_evidence(spark.createDataFrame(rows, "path string, url string, source string")).collect()
    assert sorted((r.target_path, r.url, r.weight, r.confidence) for r in got) == [("a.zip", "file:///[local-path-redacted]", 0.66, "moderate"), ("a.zip", "https://h.org/x", 0.78, "strong")]


def test_capture(spark):
    form = "path string, bytes long, sha256 string"
    before = spark.createDataFrame([("old.txt", 1, "a"), ("m.txt", 1, "b"), ("d.txt", 1, "c")], form)
    after = spark.createDataFrame([("new.txt", 1, "a"), ("m.txt", 1, "bb"), ("c.txt", 1, "d")], form)
    changes = capture.boundary_changes(before, after)
    assert {(r.change, r.path, r.previous_path) for r in changes.collect()} == {("renamed", "new.txt", "old.txt"), ("modified", "m.txt", None), ("deleted", "d.txt", None), ("created", "c.txt", None)}
    run = lambda status, direct: spark.createDataFrame([("r", status, direct)], "run_id string, status string, direct_runtime boolean")
    told = lambda status, direct: {(r.relation, r.weight, r.exact_allowed) for r in capture.run_evidence(changes.withColumn("run_id", F.lit("r")), run(status, direct), artifacts(spark)).collect()}
    assert told("completed", True) == {("was_generated_by", 1.0, True), ("observed_deleted_during", 1.0, False), ("observed_rename_during", 1.0, False)}
    assert told("recovered", True) == {("observed_created_during", 0.75, False), ("observed_modified_during", 0.75, False), ("observed_deleted_during", 0.75, False), ("observed_rename_during", 0.75, False)}
    assert told("in_progress", True) == set()


def test_exports(spark, tmp_path):
    claims = spark.createDataFrame([("c1", "a", "b", "used", 0.9, "active"), ("c2", "b", "c", "used", 0.9, "active"), ("c3", "c", "d", "used", 0.95, "rejected")], "claim_id string, source_id string, target_id string, relation string, score double, status string")
    nodes = spark.createDataFrame([(x, f"dir/{x}.txt", "file") for x in "abcd"], "id string, path string, kind string")
    evidence = spark.createDataFrame([("c1", f"e{k}", "k", "f" * 500) for k in range(9)], "claim_id string, evidence_id string, kind string, facts string")
    kept, ends = exports.explorer(claims, nodes, evidence, n=1)
    row = kept.first()
    assert row.claim_id == "c1" and len(row.evidence) == 6 and len(row.evidence[0].facts) == 400 and {r.id for r in ends.collect()} == {"a", "b"}
    shown = claims.withColumnsRenamed({"source_id": "source_path", "target_id": "target_path"})
    assert exports.explorer_filter(shown, 0.9, "used", "C").count() == 2
    notes = exports.notes(nodes, claims)
    text = {r.id: r.text for r in notes.collect()}
    assert text["a"].startswith("# dir/a.txt") and "→" in text["a"] and "←" in text["b"] and sorted(map(tuple, exports.notes(nodes, claims).collect())) == sorted(map(tuple, notes.collect()))
    first = notes.orderBy("note").select("note", "text")
    stored = first.withColumn("written_sha", F.sha2("text", 256))
    assert {r.state for r in exports.preserved_notes(first, stored).collect()} == {"unchanged"}
    edited = stored.withColumn("text", F.concat("text", F.lit("mine")))
    assert {r.state for r in exports.preserved_notes(first, edited).collect()} == {"conflict"}
    exports.graph_json({"claims": claims}, str(tmp_path))
    assert spark.read.json(str(tmp_path / "claims")).count() == 3
    assert exports.markdown("t", claims.select("claim_id")).count("\n| c") == 4 and "==>" not in exports.mermaid(claims)
    got = exports.overview(claims.withColumn("assurance", F.lit("candidate"))).first()
    assert (got.nodes, got.edges, got.verified, got.inferred) == (4, 3, 0, 3)


def test_run_states_as_a_stream(spark, tmp_path):
    rows = [("a", 1, "start", "10:00"), ("a", 2, "start", "10:01"), ("a", 3, "stop", "10:05"), ("b", 4, "start", "10:00"), ("c", 5, "stop", "10:00"), ("a", 6, "touch", "14:00")]
    stamp = F.to_timestamp(F.concat(F.lit("2026-01-01 "), F.col("at")))
    frame = spark.createDataFrame(rows, "key string, seq long, type string, at string").withColumn("at", stamp)
    (tmp_path / "in").mkdir()
    for k, part in enumerate((frame.where("seq < 6"), frame.where("seq = 6"), spark.createDataFrame([("z", 9, "touch", "18:00")], "key string, seq long, type string, at string").withColumn("at", stamp), spark.createDataFrame([("b", 10, "stop", "18:30")], "key string, seq long, type string, at string").withColumn("at", stamp))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = runs.run_transitions(stream).writeStream.format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = [(r.key, r.status) for r in spark.table("states").collect()]
    assert {x for x in got if x[0] == "a"} == {("a", "in_progress"), ("a", "completed")}
    assert [x[1] for x in got if x[0] == "b"] == ["in_progress", "incomplete", "recovered"] and not [x for x in got if x[0] in "cz"]
    assert {(r.key, r.started_at.hour) for r in runs.pending(frame).collect()} == {("b", 10)}
    keys = spark.createDataFrame([("a", "b/c", "d"), ("a/b", "c", "d"), (None, "x", "y")], "p string, s string, t string").select(runs.run_key(F.col("p"), F.col("s"), F.col("t"))).distinct()
    assert keys.count() == 3


def test_matching_pairs_against_brute_force(spark, monkeypatch):
    import random

    rng = random.Random(4)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randint(5, 60))] for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for _ in range(5):
            c = list(b)
            for _ in range(rng.randint(0, 6)):
                c[rng.randrange(len(c))] = f"n{rng.randrange(99)}"
            texts.append(" ".join(c + base[0][:8]))
    texts += [texts[3], "few words", "", None]
    grams = {i: s for i, t in enumerate(texts) if (s := {tuple(w[k : k + 5]) for w in [(t or "").split()] for k in range(len(w) - 4)})}
    want = set()
    for i, a in grams.items():
        for j, b in grams.items():
            c = len(a & b)
            if i < j and c and (c / len(a | b) >= 0.15 or c / min(len(a), len(b)) >= 0.5):
                want.add((i, j, round(c / len(a | b), 6), round(c / min(len(a), len(b)), 6)))
    for sizes in ((50_000, 400_000), (40, 90)):
        monkeypatch.setattr(similarity, "QUERY_ENTRIES", sizes[0])
        monkeypatch.setattr(similarity, "TEXT_ENTRIES", sizes[1])
        got = similarity.matching_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
        assert sorted((r.a, r.b, r.jaccard, r.containment) for r in got.collect()) == sorted(want)


def test_matching_pairs_of_two_tables_against_brute_force(spark, monkeypatch):
    """Ids of both tables may be equal and of other types; equal texts, texts of one table alone and null ids among them."""
    import random

    from provgraph.operators import similarity

    rng = random.Random(11)
    base = [rng.choices([f"w{k}" for k in range(300)], k=rng.randint(3, 60)) for _ in range(12)]
    made = lambda: " ".join(w if rng.random() > 0.04 else f"x{rng.randrange(10**6)}" for w in rng.choice(base))
    one, two = [made() for _ in range(60)] + ["a b c d e f g", None], [made() for _ in range(50)] + ["a b c d e f g", "", "q r s t u v"]
    left = spark.createDataFrame([(i, t) for i, t in enumerate(one)] + [(None, one[0])], "id long, text string")
    right = spark.createDataFrame([(str(i), t) for i, t in enumerate(two)], "id string, text string")
    sets = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").split()] for i in range(len(w) - 4)}
    want = {}
    for i, x in enumerate(map(sets, one)):
        for j, y in enumerate(map(sets, two)):
            if x and y and (c := len(x & y)) and (c / len(x | y) >= 0.15 or c / min(len(x), len(y)) >= 0.5):
                want[i, str(j)] = (round(c / len(x | y), 6), round(c / min(len(x), len(y)), 6))
    for queries, texts in ((50_000, 400_000), (300, 900)):
        monkeypatch.setattr(similarity, "QUERY_ENTRIES", queries)
        monkeypatch.setattr(similarity, "TEXT_ENTRIES", texts)
        rows = similarity.matching_pairs(left, others=right).collect()
        assert {(r.a, r.b): (r.jaccard, r.containment) for r in rows} == want and len(rows) == len(want) > 100
