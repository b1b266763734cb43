"""Traversals on graphs with cycles and several paths, against plain searches."""

from collections import deque

from provgraph.operators import answers, claims, graph

EDGES = [
    ("a", "b", "was_generated_by", 1.0, "verified"),
    ("a", "c", "derived_from", 0.9, "strong-candidate"),
    ("b", "c", "was_generated_by", 1.0, "verified"),
    ("b", "d", "content_matches", 0.5, "weak-signal"),
    ("c", "a", "declares_read", 0.95, "strong-candidate"),
    ("c", "d", "was_generated_by", 0.85, "strong-candidate"),
    ("d", "b", "used", 0.6, "candidate"),
    ("d", "e", "references", 0.9, "strong-candidate"),
    ("d", "f", "was_generated_by", 1.0, "verified"),
    ("f", "g", "imports", 0.2, "insufficient"),
]
FORM = "source_id string, target_id string, relation string, score double, assurance string"
TIMES = {"a": 20, "b": 10, "c": 30, "d": 5, "e": 1, "f": None}


def by_hand(depth=5, minimum=0.3):
    """Breadth-first, every edge that is traversed, chains by first arrival."""
    from provgraph.functions.enums import STALE

    out = []
    for root, mine in TIMES.items():
        if mine is None:
            continue
        queue, seen = deque([(root, [])]), {root: 0}
        while queue:
            node, chain = queue.popleft()
            if len(chain) == depth:
                continue
            for e in sorted((e for e in EDGES if e[0] == node and e[3] >= minimum and e[2] in STALE and e[1] != root), key=lambda e: (-e[3], e[1], e[2])):
                now = [*chain, e]
                theirs = TIMES.get(e[1])
                sure = all(x[2] in ("was_generated_by", "confirmed_export") and x[4] == "verified" for x in now)
                least = min(x[3] for x in now)
                newer = None if theirs is None else mine > theirs
                state = "unknown" if newer is None else ("definitely_stale" if sure else "probably_stale" if least >= 0.8 else "possibly_stale") if newer else "current" if sure else "unknown"
                out.append((root, e[1], e[0], e[2], len(now), state))
                if len(now) < seen.get(e[1], depth + 1):
                    seen[e[1]] = len(now)
                    queue.append((e[1], now))
    return sorted(out)


def test_stale_chains_tell_every_traversed_edge(spark):
    edges = spark.createDataFrame(EDGES, FORM)
    times = spark.createDataFrame(list(TIMES.items()), "node string, mtime long")
    got = sorted(map(tuple, graph.stale_chains(edges, times).collect()))
    assert got == by_hand()
    direct = sorted((r.upstream, r.downstream, r.state) for r in graph.stale_direct(edges, times).collect())
    assert direct == sorted((u, d, s) for u, d, _, _, _, s in by_hand(1) if s.endswith("_stale"))
    counts = {r.upstream: r.overall_state for r in graph.stale_counts(graph.stale_chains(edges, times)).collect()}
    assert counts["a"] == "definitely_stale"


def test_walk_goes_on_past_nodes_it_has_seen(spark):
    edges = spark.createDataFrame(EDGES, FORM)
    starts = spark.createDataFrame([("a",), ("d",)], "start_id string")
    for forward in (True, False):
        want = []
        for start in ("a", "d"):
            node, seen = start, {start}
            for step in range(1, 9):
                a, b = (0, 1) if forward else (1, 0)
                best = sorted((-e[3], e[b], e[2]) for e in EDGES if e[a] == node and e[3] >= 0.3 and e[b] not in seen)
                if not best:
                    break
                _, to, relation = best[0]
                want.append((start, step, *((node, to) if forward else (to, node)), relation))
                seen.add(to)
                node = to
        assert sorted(map(tuple, graph.walk(edges, starts, forward=forward).collect())) == sorted(want)
    chains = {r.target_id: r.chain for r in answers.source_chain(edges, spark.createDataFrame([("f",)], "target_id string")).collect()}
    assert chains["f"].endswith(">d>f")


def test_impact_and_neighbourhood_in_cycles(spark):
    edges = spark.createDataFrame(EDGES, FORM)
    roots = spark.createDataFrame([("a",)], "root_id string")
    got = {r.target_id: (r.depth, r.relation) for r in graph.impact(edges, roots).collect()}
    assert got == {"b": (1, "was_generated_by"), "c": (1, "derived_from"), "d": (2, "was_generated_by"), "e": (3, "references"), "f": (3, "was_generated_by")}
    assert {r.node_id: r.hop for r in graph.k_hop(edges, roots, 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    goal = spark.createDataFrame([("f",)], "target_id string")
    assert [(r.hops, r.path) for r in graph.shortest_path(edges, roots, goal).collect()] == [(3, "a>c>d>f")]


def test_ambiguous_and_unique_producers(spark):
    rows = [("x.py", "r.png", "can_generate", 0.65, "candidate", 4), ("y.py", "r.png", "can_generate", 0.65, "candidate", 2), ("run", "v.png", "was_generated_by", 1.0, "verified", 2), ("z.py", "v.png", "can_generate", 1.0, "strong-candidate", 1)]
    found = spark.createDataFrame(rows, "source_id string, target_id string, relation string, score double, assurance string, priority int")
    best = {r.target_id: (r.best_source_id, r.unique_producer) for r in claims.best_producer(found).collect()}
    assert best == {"r.png": ("y.py", False), "v.png": ("run", True)}
    every = answers.alternatives(found).collect()
    assert {(r.target_id, r.source_id): (r.rank, r.best, r.tied) for r in every} == {("r.png", "y.py"): (1, True, True), ("r.png", "x.py"): (2, False, True), ("v.png", "z.py"): (1, False, True), ("v.png", "run"): (2, True, True)}
    runs = spark.createDataFrame([("run", ".", ["make", "v.png"])], "run_id string, cwd string, command array<string>")
    assert {r.target_id: (r.status, r.command) for r in answers.reproduce(found, runs).collect()} == {"r.png": ("insufficient-evidence", None), "v.png": ("ready", ["make", "v.png"])}


def test_why_follows_origins_upstream(spark):
    rows = [("s", "t", "was_generated_by", 0.9, "strong-candidate"), ("q", "s", "derived_from", 0.4, "weak-signal"), ("r", "s", "derived_from", 0.6, "candidate"), ("p", "r", "generated", 0.7, "candidate"), ("o", "p", "generated", 0.7, "candidate")]
    got = [r for r in answers.why(spark.createDataFrame(rows, FORM)).collect() if r.target_id == "t"]
    assert [(r.source_id, r.chain, r.best) for r in got] == [("s", ["p", "r", "s", "t"], True)]


def test_rescore_authorises_verified_claims_only(spark):
    evidence = spark.createDataFrame([("e1", "g", 1.0, True), ("e2", "g", 0.65, True), ("e3", "h", 0.70, True), ("e4", "h", 1.0, False)], "evidence_id string, signal_group string, weight double, active boolean")
    stored = spark.createDataFrame([("a", "verified", ["e1"]), ("b", "candidate", ["e1"]), ("c", "candidate", ["e2", "e3", "e4"]), ("d", "verified", ["gone"])], "claim_id string, assurance string, evidence_ids array<string>")
    assert {r.claim_id: (r.score, r.confidence) for r in claims.rescore(stored, evidence).collect()} == {"a": (1.0, "exact"), "b": (0.99, "strong"), "c": (0.895, "strong"), "d": (0.0, "unknown")}


def test_traversals_in_slices_leave_little_on_disk(spark, monkeypatch):
    """Roots in slices give the same rows, and tables that are left take few bytes a row, without copies of what was seen."""
    from pathlib import Path
    from urllib.parse import urlparse

    from pyspark.sql import functions as F

    from provgraph.plans.lineage import cut

    cut(spark.range(1)).count()
    folder = Path(urlparse(spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).path)
    held = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    pairs = [(f"r:{i}", f"m:{(i * 7 + j) % 150}") for i in range(40) for j in range(60)] + [(f"m:{i}", f"t:{(i * 13 + j) % 900}") for i in range(150) for j in range(30)]
    edges = spark.createDataFrame([(a, b, "was_generated_by", 1.0 - len(b) / 100, "verified") for a, b in pairs], FORM).cache()
    roots = spark.createDataFrame([(f"r:{i}",) for i in range(40)], "root_id string").cache()
    goals = spark.createDataFrame([(f"t:{i}",) for i in range(900)], "target_id string").cache()
    times = spark.createDataFrame([(x, len(x)) for x in sorted({x for p in pairs for x in p})], "node string, mtime long").cache()
    runs = {
        "impact": lambda: graph.impact(edges, roots, depth=3),
        "shortest_path": lambda: graph.shortest_path(edges, roots, goals, depth=3),
        "stale_chains": lambda: graph.stale_chains(edges, times, roots),
    }
    for name, run in runs.items():
        monkeypatch.setattr(graph, "SLICE", 10**9, raising=False)
        before = held()
        whole = run()
        rows = sorted(map(tuple, whole.collect()))
        left = held() - before
        assert len(rows) > 20_000 and left < 12 * len(rows) + 60_000, (name, left, len(rows))
        monkeypatch.setattr(graph, "SLICE", 2_500, raising=False)
        assert sorted(map(tuple, run().collect())) == rows
    first = graph.impact(edges, roots, depth=3)
    assert first.groupBy("root_id", "target_id").count().where(F.col("count") > 1).isEmpty()


def test_stale_chains_are_the_same_by_buckets_by_sorting_and_in_lists(spark, monkeypatch):
    """Nodes too large for buckets join by sorting, and turns that no number holds are lists: the same rows, also in two parts of a bucket each."""
    monkeypatch.setitem(globals(), "EDGES", EDGES + [("b", "c", "derived_from", 1.0, "strong-candidate"), ("b", "e", "generated", 0.5, "weak-signal"), ("c", "e", "generated", 0.9, "strong-candidate"), ("e", "d", "used", 0.7, "candidate")])
    edges = spark.createDataFrame(EDGES, FORM)
    times = spark.createDataFrame(list(TIMES.items()), "node string, mtime long")
    for hub, part, depth in ((1_000_000, 3, 5), (0, 3, 5), (3, 3, 5), (1_000_000, 3, 40), (0, 3, 40)):
        monkeypatch.setattr(graph, "HUB", hub)
        monkeypatch.setattr(graph, "PART", part)
        assert sorted(map(tuple, graph.stale_chains(edges, times, depth=depth).collect())) == by_hand(depth), (hub, part, depth)
    roots = spark.createDataFrame([("b",), ("c",), ("f",), ("c",)], "root_id string")
    assert sorted(map(tuple, graph.stale_chains(edges, times, roots).collect())) == [r for r in by_hand() if r[0] in "bcf"]
    assert graph.stale_chains(edges.where("score > 2"), times).isEmpty()


def test_stale_chains_store_no_row_for_each_traversed_edge(spark):
    """Only edges, nodes and the frontiers that are followed twice are stored; ends that nothing leaves, here the leaves, are in none."""
    from pathlib import Path
    from urllib.parse import urlparse

    import pyarrow.parquet as pq

    from provgraph.plans.lineage import cut

    cut(spark.range(1)).count()
    folder = Path(urlparse(spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).path)
    stored = lambda: {p: pq.read_metadata(p).num_rows for p in folder.rglob("cuts-*/**/*.parquet")}
    pairs = [(f"r:{i}", f"m:{j}") for i in range(40) for j in range(40)] + [(f"m:{i}", f"t:{i}:{j}") for i in range(40) for j in range(10)] + [(f"t:{i}:{j}", f"leaf:{i}") for i in range(40) for j in range(10)]
    edges = spark.createDataFrame([(a, b, "was_generated_by", 1.0, "verified") for a, b in pairs], FORM)
    times = spark.createDataFrame([(x, len(x)) for x in sorted({x for p in pairs for x in p})], "node string, mtime long")
    before = stored()
    got = graph.stale_chains(edges, times)
    kept = sum(n for p, n in stored().items() if p not in before)
    rows = got.count()
    assert rows == 40 * (40 + 400 + 400) + 40 * (10 + 10) + 400 and kept < rows / 5, (rows, kept)
