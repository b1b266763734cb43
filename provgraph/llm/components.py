"""Connected components by alternating stars, as joins and minima; no links reach the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.llm.shared import Stage

#: Links up to which one task finishes; a round of shuffles costs more than that, however few links are left.
AT_ONCE = 200_000


class Forest:
    """Which of n things are connected."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def tie(self, i: int, j: int) -> bool:
        """Connect two; whether they were apart."""
        a, b = self.top(i), self.top(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of all nodes of links (u, v) that come to one task."""
    held = list(batches)
    if not (n := sum(x.num_rows for x in held)):
        return
    ids = pa.concat_arrays([x.column(k) for k in (0, 1) for x in held])
    rank = pa.compute.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64) - 1
    place = np.empty(int(rank.max()) + 1, dtype=np.int64)
    place[rank] = np.arange(len(rank))
    forest = Forest(len(place))
    for i, j in zip(rank[:n].tolist(), rank[n:].tolist(), strict=True):
        forest.tie(i, j)
    tops = np.array([forest.top(i) for i in range(len(place))], dtype=np.int64)
    yield pa.RecordBatch.from_arrays([ids.take(pa.array(place)), ids.take(pa.array(place[tops]))], ["node", "label"])


def connected_components(links: DataFrame, a: str, b: str, stage: Stage, name: str = "stars", at_once: int = AT_ONCE) -> DataFrame:
    """(node, label): each linked node with the smallest node that it reaches.

    Each round ties every node to the smallest of its neighbours (large star, then small star) and is
    written to the shared folder; it ends when a round changes nothing, after about log(n) rounds.
    Minima are combined before the shuffle, and the joins back are plain inner joins, whose skewed
    keys adaptive execution splits: a node with any number of links is never gathered in one task.
    Once no more than ``at_once`` links are left, one task finishes them, with the same result.
    Null nodes and loops are ignored; no links give no rows.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = stage.put(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), f"{name}0")
    kind = edges.schema["u"].dataType.simpleString()
    seen, turn = None, 0
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        if state[0] <= at_once:
            done = stage.put(edges.coalesce(1).mapInArrow(_labelled, f"node {kind}, label {kind}"), f"{name}-done")
            stage.drop(f"{name}{turn}")
            return done
        seen, turn = tuple(state), turn + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        edges = stage.put(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}{turn}")
        stage.drop(f"{name}{turn - 1}")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
