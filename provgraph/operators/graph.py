"""Batch traversal: frontier joins level by level, visited nodes anti-joined, the best edge by aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provgraph.functions.enums import STALE
from provgraph.functions.scoring import STRONG, grade, verified
from provgraph.plans.lineage import Cuts, cut

#: Edges for which all roots are followed at once; with more, roots are followed in slices, one after the other.
SLICE = 6_000_000
#: Rows up to which a frontier is broadcast.
BROADCAST = 100_000
#: Edges in a bucket, about, and rows of one node up to which they may meet in one task.
PART, HUB = 200_000, 1_000_000


def _slices(roots: DataFrame, live: DataFrame) -> list[DataFrame]:
    """``roots`` (root_id, ...) in as many parts by hash as the edges ask for, so that shuffles of one part only are on disk."""
    n = max(1, -(-live.count() // SLICE))
    return [roots.where(F.pmod(F.xxhash64("root_id"), F.lit(n)) == k) for k in range(n)]


def _joined(frontier: DataFrame, live: DataFrame) -> DataFrame:
    """The frontier (root_id, node, ...) with the edges that leave it; broadcast by count, not by the size of a compressed table."""
    return (F.broadcast(frontier) if frontier.count() <= BROADCAST else frontier.hint("merge")).join(live, F.col("node") == F.col("source_id"))


def _unseen(found: DataFrame, seen: list[DataFrame]) -> DataFrame:
    """What of ``found`` (root_id, node, ...) is in none of the tables seen (root_id, node)."""
    before = seen[0]
    for more in seen[1:]:
        before = before.unionByName(more)
    return found.join(before.hint("merge"), ["root_id", "node"], "left_anti")


def impact(edges: DataFrame, roots: DataFrame, minimum: float = 0.3, depth: int = 5) -> DataFrame:
    """(root_id, target_id, depth, relation, score): what is downstream of each root, once, at its least depth.

    Of several edges that reach a target at that depth, the best by (verified, score, source) is told.
    Each level is one join of the frontier with the edges; skewed nodes are split by adaptive execution.
    """
    cuts = Cuts(edges.sparkSession)
    live = cuts.put(edges.where(F.col("score") >= minimum).select("source_id", "target_id", "relation", "score", verified(F.col("relation"), F.col("assurance")).alias("sure")))
    out = None
    for start in _slices(roots.select("root_id"), live):
        frontier = start.select("root_id", F.col("root_id").alias("node"))
        seen = [frontier]
        for level in range(1, depth + 1):
            step = _joined(frontier, live).groupBy("root_id", F.col("target_id").alias("node")).agg(F.max(F.struct("sure", "score", "source_id", "relation")).alias("best"))
            fresh = cuts.put(_unseen(step, seen).select("root_id", F.col("node").alias("target_id"), F.lit(level).alias("depth"), F.col("best.relation").alias("relation"), F.col("best.score").alias("score")))
            out = fresh if out is None else out.unionByName(fresh)
            if fresh.isEmpty():
                break
            frontier = fresh.select("root_id", F.col("target_id").alias("node"))
            seen.append(frontier)
    return out


def k_hop(edges: DataFrame, roots: DataFrame, hops: int = 2) -> DataFrame:
    """(root_id, node_id, hop): undirected neighbourhood of each root, itself at hop 0."""
    ends = cut(edges.select("source_id", "target_id"))
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    both = ends.select(F.inline(F.array(pair("source_id", "target_id"), pair("target_id", "source_id"))))
    seen = roots.select("root_id", F.col("root_id").alias("node_id"), F.lit(0).alias("hop"))
    frontier = seen
    for hop in range(1, hops + 1):
        step = frontier.join(both, F.col("node_id") == F.col("a")).select("root_id", F.col("b").alias("node_id")).distinct()
        frontier = cut(step.join(seen.select("root_id", "node_id"), ["root_id", "node_id"], "left_anti").withColumn("hop", F.lit(hop)))
        seen = cut(seen.unionByName(frontier))
    return seen


def shortest_path(edges: DataFrame, roots: DataFrame, goals: DataFrame, minimum: float = 0.3, depth: int = 5, paths: bool = True) -> DataFrame:
    """(root_id, target_id, hops, path): fewest edges from each root to each goal, one such path.

    Among equal ones the parent reached by the better edge (score, then smaller id) is kept. Without
    ``paths`` no path is carried along, and there is no such column.
    """
    cuts, way = Cuts(edges.sparkSession), ["path"] if paths else []
    live = cuts.put(edges.where(F.col("score") >= minimum).select("source_id", "target_id", "score"))
    wanted = cuts.put(goals.select(F.col("target_id").alias("node")))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted.hint("merge")
    out = None
    for start in _slices(roots.select("root_id"), live):
        frontier = cuts.put(start.select("root_id", F.col("root_id").alias("node"), *([F.array("root_id").alias("path")] if paths else [])))
        levels = [frontier]
        for hops in range(depth + 1):
            found = cuts.put(frontier.join(wanted, "node").select("root_id", F.col("node").alias("target_id"), F.lit(hops).alias("hops"), *(F.array_join(x, ">").alias(x) for x in way)))
            out = found if out is None else out.unionByName(found)
            if hops == depth:
                break
            best = _joined(frontier, live).groupBy("root_id", "target_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "source_id", *way)).alias("best"))
            fresh = best.select("root_id", F.col("target_id").alias("node"), *(F.concat("best.path", F.array("target_id")).alias(x) for x in way))
            frontier = cuts.put(_unseen(fresh, [x.select("root_id", "node") for x in levels]))
            levels.append(frontier)
            if frontier.isEmpty():
                break
        cuts.drop(*levels)
    return out


def walk(edges: DataFrame, starts: DataFrame, minimum: float = 0.3, steps: int = 8, forward: bool = True) -> DataFrame:
    """(start_id, step, source_id, target_id, relation): from each start along its strongest edges to nodes not seen yet.

    Ties go to the smaller next node, then relation. Of each node only the ``steps`` + 1 strongest edges
    to different nodes can ever be taken, as a walk has seen no more nodes than that; so a hub is one short row.
    """
    a, b = ("source_id", "target_id") if forward else ("target_id", "source_id")
    one = edges.where((F.col("score") >= minimum) & (F.col(a) != F.col(b))).groupBy(F.col(a).alias("node"), F.col(b).alias("next")).agg(F.min(F.struct((-F.col("score")).alias("s"), "relation")).alias("e"))
    ranked = one.select("node", F.struct("e.s", "next", "e.relation").alias("e")).withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy("e"))).where(F.col("at") <= steps + 1)
    best = cut(ranked.groupBy("node").agg(F.array_sort(F.collect_list("e")).alias("best")))
    frontier = starts.select("start_id", F.col("start_id").alias("node"), F.array("start_id").alias("path"))
    out = None
    for step in range(1, steps + 1):
        moved = frontier.join(best, "node").withColumn("e", F.get(F.filter("best", lambda e: ~F.array_contains(F.col("path"), e["next"])), F.lit(0))).where("e is not null")
        moved = cut(moved.select("start_id", F.lit(step).alias("step"), "node", "e.next", "e.relation", F.concat("path", F.array("e.next")).alias("path")))
        told = moved.select("start_id", "step", F.col("node" if forward else "next").alias("source_id"), F.col("next" if forward else "node").alias("target_id"), "relation")
        out = told if out is None else out.unionByName(told)
        if moved.isEmpty():
            break
        frontier = moved.select("start_id", F.col("next").alias("node"), "path")
    return out


def pipeline_chains(edges: DataFrame, starts: DataFrame, minimum: float = 0.3, steps: int = 8) -> DataFrame:
    """(start_id, n_steps, chain): walks of two steps or more that are not the tail of a longer one.

    A tail is found by joining walks on their second and later nodes, exploded: no pairwise comparison.
    """
    moved = walk(edges, starts, minimum, steps)
    chains = moved.groupBy("start_id").agg(F.count("*").alias("n_steps"), F.array_sort(F.collect_list(F.struct("step", "target_id"))).alias("s")).where("n_steps >= 2")
    chains = cut(chains.select("start_id", "n_steps", F.concat(F.array("start_id"), F.col("s.target_id")).alias("nodes")))
    tails = chains.select(F.explode(F.transform(F.sequence(F.lit(2), F.size("nodes")), lambda i: F.array_join(F.slice("nodes", i, F.size("nodes")), ">"))).alias("chain")).distinct()
    return chains.select("start_id", "n_steps", F.array_join("nodes", ">").alias("chain")).join(tails, "chain", "left_anti").select("start_id", "n_steps", "chain")


def _stale_edges(edges: DataFrame, minimum: float) -> DataFrame:
    live = edges.where((F.col("score") >= minimum) & F.col("relation").isin(STALE) & (F.col("source_id") != F.col("target_id")))
    return live.select("source_id", "target_id", "relation", "score", F.coalesce(verified(F.col("relation"), F.col("assurance")), F.lit(False)).alias("sure"))


def _graded(found: DataFrame, times: DataFrame) -> DataFrame:
    """(upstream, downstream, via, relation, depth, state) of found (upstream, downstream, via, relation, depth, least, sure_all)."""
    up, down = times.select(F.col("node").alias("upstream"), F.col("mtime").alias("up")), times.select(F.col("node").alias("downstream"), F.col("mtime").alias("down"))
    dated = found.join(up, "upstream").join(down, "downstream", "left").where("up is not null")
    return dated.select("upstream", "downstream", "via", "relation", "depth", grade(F.col("up") > F.col("down"), F.col("sure_all"), F.col("least")).alias("state"))


def stale_direct(edges: DataFrame, times: DataFrame, minimum: float = 0.3) -> DataFrame:
    """Edges whose upstream is newer than their downstream, graded: (upstream, downstream, depth, state)."""
    each = _stale_edges(edges, minimum).select(F.col("source_id").alias("upstream"), F.col("target_id").alias("downstream"), F.col("source_id").alias("via"), "relation", F.lit(1).alias("depth"), F.col("score").alias("least"), F.col("sure").alias("sure_all"))
    return _graded(each, times).where(F.col("state").endswith("_stale")).select("upstream", "downstream", "depth", "state")


def _longest(live: DataFrame, cuts: Cuts, depth: int) -> int:
    """How many edges the longest walk from a root has, ``depth`` at most: by the sources of edges that go on, the sources of edges to these, and so on."""
    way = live.where("goes_on").select("target_id", F.col("source_id").alias("node"), F.col("up").isNotNull().alias("root"))
    starts, length, before = cuts.put(way.select("node", "root").distinct()), 1, -1
    while length < depth and not starts.where("root").isEmpty():
        length, n = length + 1, starts.count()
        if n == before:  # none left: cycles
            return depth
        if length < depth:
            some = starts.select(F.col("node").alias("target_id"))
            starts, before = cuts.put(way.join(F.broadcast(some) if n <= BROADCAST else some.hint("merge"), "target_id", "left_semi").select("node", "root").distinct()), n
    return length


def stale_chains(edges: DataFrame, times: DataFrame, roots: DataFrame | None = None, minimum: float = 0.3, depth: int = 5) -> DataFrame:
    """(upstream, downstream, via, relation, depth, state): every edge that is traversed downstream of each root.

    From a root with a time outgoing relations that pass staleness on are followed, each node once, at its
    least depth, by the chain that comes first in breadth-first order: that of the parent reached first,
    then of the better edge (score, then smaller id and relation). Every edge that leaves such a node, but
    for those back to the root, is graded by the chain that it ends: all of it verified, its least score.
    Without ``roots`` every node with a time is one.

    Edges and frontiers lie in buckets by the node where they meet, so levels join without a shuffle; a
    frontier has no nodes that no edge leaves. The last one and all traversed edges are left to the query
    that reads the result. Where nodes are too large for buckets, levels join by sorting, and skew is split.
    """
    spark, cuts = edges.sparkSession, Cuts(edges.sparkSession)
    found = cuts.put(_stale_edges(edges, minimum))
    end = lambda x, out, into: F.struct(F.col(x).alias("node"), F.lit(out).alias("n_out"), F.lit(into).alias("n_in"))
    ends = found.select(F.inline(F.array(end("source_id", 1, 0), end("target_id", 0, 1))))
    nodes = cuts.put(ends.unionByName(times.select("node", "mtime"), allowMissingColumns=True).groupBy("node").agg(F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in"), F.max("mtime").alias("mtime")))
    n_edges, most_out, most_in = nodes.agg(F.coalesce(F.sum("n_out"), F.lit(0)), F.coalesce(F.max("n_out"), F.lit(0)), F.coalesce(F.max(F.when(F.col("n_out") > 0, F.col("n_in"))), F.lit(0))).first()
    parts, bits, small = max(spark.sparkContext.defaultParallelism, -(-n_edges // PART)), most_out.bit_length(), most_out <= HUB
    join = "shuffle_hash" if small else "merge"

    # the edges, with their rank among those that go on from a node: chains are compared by the ranks of their edges
    after = nodes.select(F.col("node").alias("target_id"), F.col("mtime").alias("down"), (F.coalesce("n_out", F.lit(0)) > 0).alias("goes_on")).repartition(parts, "target_id")
    before = nodes.where("mtime is not null").select(F.col("node").alias("source_id"), F.col("mtime").alias("up"))
    before = before if roots is None else before.join(roots.select(F.col("root_id").alias("source_id")), "source_id", "left_semi")
    order = Window.partitionBy("source_id", "goes_on").orderBy(F.desc("score"), "target_id", "relation", "sure")
    live = found.join(after.hint("shuffle_hash"), "target_id").join(before.repartition(parts, "source_id").hint("shuffle_hash"), "source_id", "left")
    live = cuts.put(live.withColumn("place", F.when(F.col("goes_on"), F.dense_rank().over(order))), "source_id" if small else None, parts)
    cuts.drop(found, nodes)

    # a row's turn: the ranks of its chain's edges, then what of the chain grades it; the least of a node is its first chain
    packed = bits * (depth - 1) <= 60  # in one number; else in a list
    seen_turn = F.lit(-1).cast("long") if packed else F.array(F.lit(-1))
    kind = F.when(F.col("sure_all"), 2).otherwise(0) + F.when(F.col("least") >= STRONG, 1).otherwise(0)
    if packed:
        turn, first, told_kind = (F.shiftright("turn", 2) * F.lit(1 << bits).cast("long") + F.col("place")) * 4 + kind, F.lit(0).cast("long"), F.col("turn").bitwiseAND(3)
    else:
        turn, first, told_kind = F.concat(F.slice("turn", 1, F.size("turn") - 1), F.array("place", kind)), F.array(F.lit(0)), F.element_at("turn", -1)
    last, out, seen, frontier = _longest(live, cuts, depth), None, [], None
    for level in range(1, last + 1):
        if level == 1:
            step = live.where("up is not null").withColumns({"root_id": F.col("source_id"), "least": F.col("score"), "sure_all": F.col("sure"), "turn": first})
        else:
            met = frontier.join(live.drop("up").hint(join), F.col("node") == F.col("source_id")).where("target_id <> root_id")
            step = met.withColumns({"least": F.when(told_kind.bitwiseAND(1) == 1, F.col("score")).otherwise(F.lit(0.0)), "sure_all": (told_kind >= 2) & F.col("sure")})
        state = grade(F.col("up") > F.col("down"), F.col("sure_all"), F.col("least")).alias("state")
        told = step.select(F.col("root_id").alias("upstream"), F.col("target_id").alias("downstream"), F.col("source_id").alias("via"), "relation", F.lit(level).alias("depth"), state)
        out = told if out is None else out.unionByName(told)
        if level == last:
            break
        fits = small and most_in**level <= HUB  # all rows of a node in one task
        fresh = step.where("goes_on").select("root_id", "up", F.col("target_id").alias("node"), turn.alias("turn"))
        for more in seen:
            fresh = fresh.unionByName(more.select("root_id", "up", "node", seen_turn.alias("turn")))
        if fits and level > 1:
            fresh = fresh.repartition(parts, "node")
        frontier = fresh.groupBy("root_id", "up", "node").agg(F.min("turn").alias("turn")).where(F.col("turn") != seen_turn)
        if level < last - 1:
            frontier = cuts.put(frontier if level > 1 or not fits else frontier.repartition(parts, "node"), "node" if fits else None, parts)
            seen.append(frontier)
            if frontier.isEmpty():
                break
    return out


def stale_counts(stale: DataFrame) -> DataFrame:
    """(upstream, state counts, overall_state): how many edges downstream of each root are in each state, and the worst."""
    order = ["definitely_stale", "probably_stale", "possibly_stale", "current", "unknown"]
    worst = F.coalesce(*(F.when(F.col(x) > 0, x) for x in order))
    return stale.groupBy("upstream").agg(*(F.count_if(F.col("state") == x).alias(x) for x in order)).withColumn("overall_state", worst)


def orphans(artifacts: DataFrame, producers: DataFrame) -> DataFrame:
    """Images, documents and data that nothing in ``producers`` (target_id) produces."""
    return artifacts.where(F.col("kind").isin("image", "document", "data")).join(producers.select(F.col("target_id").alias("artifact_id")), "artifact_id", "left_anti").select("artifact_id", "path", "kind")


def candidate_rank(edges: DataFrame) -> DataFrame:
    """(source_id, target_id, rank) of the candidates of each target, by score and then id."""
    order = Window.partitionBy("target_id").orderBy(F.desc("score"), "source_id")
    return edges.select("source_id", "target_id", F.row_number().over(order).alias("rank"))
