"""Set similarity of texts on word shingles, exactly, without a row for each shared shingle of each pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provgraph.functions.text import shingle_hashes, words
from provgraph.plans.lineage import Cuts, cut

#: Entries of queries, and of texts, that a cell of the self join holds.
QUERY_ENTRIES, TEXT_ENTRIES = 50_000, 400_000
#: Shingles of the smaller table up to which it is broadcast (8 bytes and an id each).
BROADCAST = 1_000_000


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(id, n, s): the distinct shingles of each text as hashes; texts of fewer than five words have no row."""
    w = texts.where("id is not null").select("id", words(F.col("text")).alias("w"))  # a column of its own, so words are found once a text
    return w.where(F.size("w") >= 5).select("id", shingle_hashes(F.col("w")).alias("s")).select("id", F.size("s").alias("n"), "s")


def _scores() -> tuple:
    j = F.col("common") / (F.col("a_n") + F.col("b_n") - F.col("common"))
    return j, F.col("common") / F.least("a_n", "b_n")


def similar_pairs(items: DataFrame, texts: DataFrame, jaccard: float = 0.15, containment: float = 0.5) -> DataFrame:
    """(a, b, jaccard, containment) of items and texts (id, text) above either threshold, exactly.

    Shingles of texts that no item has are dropped before anything is shuffled, where the items are few.
    """
    left = cut(shingle_sets(items))
    held = left.select(F.col("id").alias("a"), F.col("n").alias("a_n"), F.explode("s").alias("shingle"))
    total = left.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # explode_outer: for explode the optimizer would filter on the array first, and find the words anew for each of its elements
    right = shingle_sets(texts).select(F.col("id").alias("b"), F.col("n").alias("b_n"), F.explode_outer("s").alias("shingle"))
    pairs = right.join(F.broadcast(held) if total <= BROADCAST else held, "shingle").groupBy("a", "b", "a_n", "b_n").agg(F.count("*").alias("common"))
    j, c = _scores()
    return pairs.where((j >= jaccard) | (c >= containment)).select("a", "b", F.round(j, 6).alias("jaccard"), F.round(c, 6).alias("containment"))


def _side() -> Column:
    """Of which of two tables a text of ``matching_pairs`` is."""
    return F.substring("id", 1, 1)


def postings(sets: DataFrame, two: bool = False) -> DataFrame:
    """(id, p, k, w): shared shingles of each set, those that the very same k sets have as one p of weight w.

    ``two``: of sets of two tables, only shingles that both tables have.

    A passage that many texts share is one entry a text, however long. p hashes the posting list, by
    aggregates that combine before the shuffle; joins back to a frequent shingle are split by adaptive execution.
    """
    each = sets.select("id", F.explode("s").alias("shingle"))
    h = F.xxhash64("id")
    shared = each.groupBy("shingle").agg(F.count("*").alias("k"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(2147483629))).alias("y"), *([F.min(_side()).alias("one"), F.max(_side()).alias("other")] if two else [])).where("k > 1")
    shared = shared.where("one <> other") if two else shared
    shared = shared.select("shingle", F.least("k", F.lit(2147483647)).cast("int").alias("k"), F.xxhash64("k", "x", "y").alias("p"))
    return each.join(shared, "shingle").groupBy("id", "p", "k").agg(F.count("*").cast("int").alias("w"))


def _cell(jaccard: float, containment: float, kind: str):
    """Pairs of a cell's queries and the larger texts in it, by an inverted index."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, n = table.column("id").combine_chunks(), np.asarray(table.column("n"), dtype=np.int64)
        rank = pa.compute.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)
        asks = np.asarray(table.column("asks"))
        lists = table.column("vec").combine_chunks()
        flat, length = lists.flatten(), np.asarray(lists.value_lengths())
        p, w = np.asarray(flat.field("p")), np.asarray(flat.field("w"), dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(length)])
        owner = np.repeat(np.arange(len(n)), length)
        text = ~asks[owner]
        by = np.argsort(p[text], kind="stable")
        posted, poster = p[text][by], owner[text][by]
        left, right, both = [], [], []
        for i in np.flatnonzero(asks).tolist():
            mine = slice(begin[i], begin[i + 1])
            lo, hi = np.searchsorted(posted, p[mine], "left"), np.searchsorted(posted, p[mine], "right")
            count = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
            common = np.bincount(poster[at], weights=np.repeat(w[mine], count), minlength=len(n)).astype(np.int64)
            near = np.flatnonzero(common)
            near = near[(n[near] > n[i]) | (n[near] == n[i]) & (rank[near] > rank[i])]
            c = common[near]
            good = (c / (n[near] + n[i] - c) >= jaccard) | (c / n[i] >= containment)
            left.append(np.full(int(good.sum()), i))
            right.append(near[good])
            both.append(c[good])
        x, y = (np.concatenate(v or [np.zeros(0, np.int64)]).astype(np.int64) for v in (left, right))
        a, b = np.where(rank[x] < rank[y], x, y), np.where(rank[x] < rank[y], y, x)
        return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b)), "common": pa.array(np.concatenate(both or [np.zeros(0, np.int64)]).astype(np.int64)), "a_n": pa.array(n[a]), "b_n": pa.array(n[b])})

    return run


def matching_pairs(texts: DataFrame, jaccard: float = 0.15, containment: float = 0.5, others: DataFrame | None = None) -> DataFrame:
    """(a, b, jaccard, containment), a < b, of texts (id, text) of one table above either threshold, exactly.

    With ``others``, a second such table, a is of the first and b of the second, and queries of one look
    for partners in the other only.

    The smaller set of such a pair has at least t of its n shingles in the other, t following from the
    thresholds, so some of its n - t + 1 rarest ones: only those look for partners, and what stands in
    very many texts seldom does. Queries that look for the same frequent posting list form blocks; each
    block meets the texts of all its lists once, in cells of bounded size, where whole intersections are
    counted. So a pair is made once, where it is found, and never shuffled. Ids are keys.
    """
    two, kind = others is not None, texts.schema["id"].dataType.simpleString()
    if two:
        kind, kinds = "string", (kind, others.schema["id"].dataType.simpleString())
        named = lambda df, side: df.select(F.concat(F.lit(side), F.col("id").cast("string")).alias("id"), "text")
        texts = named(texts, "a").unionByName(named(others, "b"))
    cuts = Cuts(texts.sparkSession)
    sets = cuts.put(shingle_sets(texts))
    least = min(containment, 2 * jaccard / (1 + jaccard)) - 1e-6
    entry = F.struct("k", "p", "w")
    vectors = postings(sets, two).groupBy("id").agg(F.array_sort(F.collect_list(entry)).alias("vec"))
    vectors = cuts.put(vectors.join(sets.select("id", "n"), "id"))
    cuts.drop(sets)
    # the entries before which fewer than n - t + 1 shingles stand, unshared ones first
    single = F.col("n") - F.aggregate("vec", F.lit(0), lambda a, e: a + e["w"])
    may = F.col("n") - F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(least))) + 1
    start = F.struct(single.cast("long").alias("before"), F.array().cast("array<struct<k:int,p:bigint>>").alias("took"))
    step = lambda a, e: F.struct((a["before"] + e["w"]).alias("before"), F.when(a["before"] < may, F.concat(a["took"], F.array(F.struct(e["k"].alias("k"), e["p"].alias("p"))))).otherwise(a["took"]).alias("took"))
    asking = vectors.select("id", "n", "vec", F.aggregate("vec", start, step, lambda a: a["took"]).alias("rare")).where(F.size("rare") > 0)
    asking = asking.select("id", "n", F.size("vec").alias("size"), F.element_at("rare", -1)["p"].alias("home"), F.transform("rare", lambda e: e["p"]).alias("rare"))
    weight = asking.groupBy("home").agg(F.sum("size").alias("total"))
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("total") / QUERY_ENTRIES))
    block = (2 * block + (_side() == "b").cast("int") if two else block).alias("part")  # queries of a block are of one table
    asking = cuts.put(asking.join(weight, "home").select("home", block, "id", "n", "rare"))
    key = ["home", "part"]
    lists = asking.select(*key, "n", F.explode("rare").alias("p")).groupBy(*key, "p").agg(F.min("n").alias("smallest"))
    posted = vectors.select("id", "n", F.size("vec").alias("size"), F.explode("vec").alias("e")).select("id", "n", "size", "e.p")
    met = lists.join(posted, "p").where("n >= smallest")
    met = (met.where((_side() == "b") != (F.col("part") % 2 == 1)) if two else met).select(*key, "id", "size").distinct()
    met = cuts.put(met)
    cells = met.groupBy(*key).agg(F.ceil(F.sum("size") / TEXT_ENTRIES).alias("cells"))
    there = met.join(cells, key).select(*key, F.pmod(F.xxhash64("id", F.lit(3)), F.col("cells")).alias("cell"), "id", F.lit(False).alias("asks"))
    here = asking.join(cells, key).select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("cell"), "id", F.lit(True).alias("asks"))
    rows = there.unionByName(here).join(vectors, "id").select(*key, "cell", "id", "n", "asks", F.transform("vec", lambda e: F.struct(e["p"].alias("p"), e["w"].alias("w"))).alias("vec"))
    found = rows.groupBy(*key, "cell").applyInArrow(_cell(jaccard, containment, kind), f"a {kind}, b {kind}, common long, a_n long, b_n long")
    j, c = _scores()
    if two:  # an id of the first table sorts before one of the second
        found = found.withColumns({x: F.expr(f"substring({x}, 2)").cast(k) for x, k in zip("ab", kinds, strict=True)})
    return found.select("a", "b", F.round(j, 6).alias("jaccard"), F.round(c, 6).alias("containment"))


def content_matches(pairs: DataFrame) -> DataFrame:
    """(source_id, target_id, score, relation): the weight of each pair as a claim."""
    score = F.round(F.least(F.lit(0.72), 0.35 + 0.5 * F.greatest(F.col("jaccard"), 0.65 * F.col("containment"))), 4)
    return pairs.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), score.alias("score"), F.lit("content_matches").alias("relation"))
