"""Exact Jaccard join of documents on sets of word n-grams, as a metric-space join.

Jaccard distance and symmetric difference are metrics, and the join is built from their triangle
inequalities. ``radius`` is 1 - threshold; linked sets lie at most a radius apart.

1. *Candidate regions.* The distance to the empty set is a set's size, so linked sets have close sizes:
   sizes fall into geometric classes, and a set near the upper end of its class is replicated into the
   next one. Within a class linked sets differ in at most D n-grams. The n-gram universe is cut by hash
   into about 1.25 * (D + 1) parts; each set tries the first D + 1 parts in which it has anything, and
   D differing n-grams cannot spoil all of them, so linked sets have one such part wholly in common.
   The smallest document with the same part is the pivot of all that have it; a candidate region is
   what has one pivot. A region of more than ``leaf`` members is cut again by other parts, for as long
   as that makes it smaller: sets that only share a common passage fall apart, near copies do not.
2. *Groups.* Members whose distances to 256 fixed pivots (counts in the parts of the universe by another
   hash, which a differing n-gram moves by one at most) do not rule out a link are tied together; what
   is tied makes a group, and no link leaves a group. So each set is fetched once, with its group.
3. *Voronoi regions.* Pivots are drawn from the members of a group; each member belongs to the region of
   its nearest pivot by exact Jaccard distance, and is replicated into the region of every pivot that
   is farther by no more than two radii: linked members x, y have d(y, p) <= d(x, p) + radius for x's
   pivot p, and so d(y, p) <= d(y, own pivot) + 2 radii. Members within the radius are linked to their
   pivot at once. Regions join *recursively*, by pivots of their own, until few members are left, which
   are joined with an inverted index; members that are connected already are not tried again.
4. *Large groups* of more than ``leaf`` members take the first such step distributed, chunk by chunk
   against the group's pivots. Members whose nearest pivot is too far for the windows to tell anything
   meet in a region of their own, with all that may reach them; a group that its pivots hardly cut falls
   into parts of sets that share one of their rarest n-grams, as linked sets do, and loses all others.
   A region or part that stays large falls into rings one radius wide around its pivot, each with
   its inner neighbour replicated into it, cut by hash into blocks that join block by block.

Each region returns a spanning forest of its links, not all pairs. Sets that are equal are one class
representative from step 1 on, so copies are never expanded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.llm.components import Forest, connected_components
from provgraph.llm.shared import Stage
from provgraph.llm.words import SPACED, U, hashes, mix, release, slices, spans

#: Ratio of the sizes that a size class holds.
SIZE_RATIO = 1.7
#: Members up to which a group is joined in one task.
LEAF = 512
#: Members up to which a Voronoi region is joined without pivots of its own.
FEW = 8
#: Pivots that a large group is cut by.
CUT = 32
#: Part of a large group in one of its regions from which on its pivots tell too little.
FLAT = 0.75
#: N-grams of the members that a cell holds of a block, as a multiple of ``leaf``.
BLOCK = 1024
#: Fixed pivots: parts of all n-grams, the distances to which rule out links before sets are fetched.
PIVOTS = 256
#: Entries (document, region) up to which a list of documents is broadcast; a longer one is joined by a shuffle.
BROADCAST = 1_000_000
#: Keys of a bucket, of all documents that share it; entries that a task deals out at once.
BUCKET = 500_000
#: Times that entries dealt out at once may have a key whose documents are gathered in the key's bucket.
HOT = 64
#: Members of candidate regions that are compared by their distances to the fixed pivots in one call.
TOGETHER = 4096
#: Part of a region that must go for it to be cut once more by other parts.
SHRINKS = 0.2


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-grams of ``width`` words.

    A text of fewer words has one n-gram, all of it; one without words has none.
    """
    starts, ends, first = spans(data, offsets, SPACED)
    w = hashes(data, starts, ends)
    grams = np.zeros(max(0, len(w) - width + 1), dtype=U)
    for k in range(width):
        grams += mix(w[k : len(w) - width + 1 + k] + U(k + 1)) * U(2 * k + 1) if len(grams) else U(0)
    grams = mix(grams)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            x = np.sort(grams[a : b - width + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        elif b > a:
            whole = mix(w[a:b] + np.arange(1, b - a + 1, dtype=U)).sum(dtype=U)
            out.append(mix(np.array([whole], dtype=U) + np.array([b - a], dtype=U) * U(0xA24BAED4963EE407)))
        else:
            out.append(np.zeros(0, dtype=U))
    return out


def size_classes(n: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """(class, D, parts) for each size class in which a set of n n-grams takes part."""
    out = []
    c = 0
    while round(SIZE_RATIO ** (c + 1)) <= n:
        c += 1
    while den * n >= num * round(SIZE_RATIO**c):
        most = round(SIZE_RATIO ** (c + 1)) - 1  # the larger set of a pair in this class
        differ = 2 * most * (den - num) // (den + num)
        out.append((c, differ, -(-5 * (differ + 1) // 4)))
        c += 1
    return out


def region_keys(x: np.ndarray, classes: list[tuple[int, int, int]], level: int = 0) -> np.ndarray:
    """A hash for each shared part that can make a region; equal parts of equal classes hash alike.

    ``level``: another one cuts the n-grams into other parts.
    """
    out = []
    x = mix(x + np.array([level], dtype=U)) if level else x
    spread = mix(x + U(0x5851F42D4C957F2D))
    for c, differ, parts in classes:
        if not differ:
            continue  # such sets are linked only when equal
        part = (x % U(parts)).astype(np.int64)
        total = np.zeros(parts, dtype=U)
        np.add.at(total, part, spread)
        used = np.flatnonzero(np.bincount(part, minlength=parts))
        keys = mix(total[used[: differ + 1]] + (used[: differ + 1].astype(U) * U(64) + U(c + 1)) * U(0xD6E8FEB86659FD93))
        if len(used) <= differ:  # too few parts for the guarantee: such sets meet all others of the kind
            keys = np.append(keys, mix(np.array([c + 1], dtype=U)))
        out.append(keys)
    return np.concatenate(out) if out else np.zeros(0, dtype=U)


def _profile(width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list] = {}
        for batch, data, offsets in slices(batches, "text"):
            sets = shingle_sets(data, offsets, width)
            keys, sketches = [], []
            for x in sets:
                if (n := len(x)) not in known:
                    known[n] = size_classes(n, num, den) if n else []
                keys.append(region_keys(x, known[n]))
                sketches.append(np.minimum(np.bincount((x >> U(40)).astype(np.int64) % PIVOTS, minlength=PIVOTS), 255).astype(np.uint8).tobytes())
            sig = [x.view(np.int64) for x in sets]
            one = [int(mix(s.view(U) * U(3)).sum(dtype=U).astype(np.int64)) if len(s) else 0 for s in sig]
            two = [int(mix(s.view(U) ^ U(0x2545F4914F6CDD1D)).sum(dtype=U).astype(np.int64)) if len(s) else 0 for s in sig]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), _lists(keys), pa.array(sketches, pa.binary())], ["id", "n_shingles", "sig1", "sig2", "keys", "sketch"])

    return run


def _deeper(width: int, num: int, den: int, level: int):
    """Keys within regions: of each document (id, regions, text) those of all its regions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            made = []
            for x, regions in zip(shingle_sets(data, offsets, width), batch.column(1).to_pylist(), strict=True):
                keys = region_keys(x, size_classes(len(x), num, den), level)
                made.append(np.concatenate([mix(keys + np.array([hash_of(r)], dtype=U)) for r in regions]))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(made)], ["id", "keys"])

    return run


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat, pa.int64()))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Keys and their ids, from rows (id, keys), about BUCKET at once."""
    keys, ids, held = [], [], 0
    for batch in batches:
        ends = np.cumsum(np.asarray(batch.column(1).value_lengths().fill_null(0)), dtype=np.int64)
        at = 0
        while at < batch.num_rows:  # a batch of documents may have many times as many keys
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + BUCKET - held, side="right")))
            own = np.repeat(np.arange(at, to), np.diff(ends[at:to], prepend=before))
            keys.append(np.asarray(batch.column(1).slice(at, to - at).flatten()).view(U))
            ids.append(batch.column(0).take(pa.array(own)))
            held, at = held + len(own), to
            if held and (held >= BUCKET or to < batch.num_rows):
                yield np.concatenate(keys), pa.concat_arrays(ids)
                keys, ids, held = [], [], 0
    if held:
        yield np.concatenate(keys), pa.concat_arrays(ids)


def _frequent(keys: np.ndarray) -> np.ndarray:
    """Sorted keys that occur more than HOT times."""
    low = (keys & U((1 << 18) - 1)).astype(np.int64)
    known, n = np.unique(keys[np.bincount(low, minlength=1)[low] > HOT], return_counts=True)
    return known[n > HOT]


def _deal(buckets: int):
    """The entries (key, id) as one row for each bucket of keys, keys packed as bytes.

    Of a key with more than HOT entries at hand only the smallest id stays, and the key is named in
    ``hot``: its documents are joined to its pivot later, so a bucket gets at most HOT entries of a key
    from each BUCKET entries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids in _gathered(batches):
            hot = _frequent(keys)
            if len(hot):
                rank = pa.compute.rank(ids, tiebreaker="first").to_numpy().astype(np.int64)
                at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
                is_hot = np.flatnonzero(hot[at] == keys)
                least = np.full(len(hot), len(keys) + 1, dtype=np.int64)
                np.minimum.at(least, at[is_hot], rank[is_hot])
                keep = np.ones(len(keys), dtype=bool)
                keep[is_hot] = rank[is_hot] == least[at[is_hot]]
                keys, ids = keys[keep], ids.filter(pa.array(keep))
            bucket = (keys % U(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            used, first = np.unique(bucket[by], return_index=True)
            packed = keys[by].tobytes()
            bounds = [*(8 * first).tolist(), len(packed)]
            hot_bucket = (hot % U(buckets)).astype(np.int64)
            named = [hot[hot_bucket == x].tobytes() for x in used.tolist()] if len(hot) else [b""] * len(used)
            lists = pa.ListArray.from_arrays(pa.array([*first.tolist(), len(by)], pa.int32()), ids.take(pa.array(by)))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([packed[a:b] for a, b in zip(bounds, bounds[1:])], pa.binary()), lists, pa.array(named, pa.binary())], ["bucket", "packed", "ids", "hot"])
        release()

    return run


def _meet(parts: int):
    """(part, ids, pivots, keys): id and pivot of a bucket's entries that share a key, each pair once, as one row for
    each part of the pivots, packed in lists; and one row, of part -1, with each frequent key and its pivot."""

    def run(table: pa.Table) -> pa.Table:
        release()
        keys = np.frombuffer(b"".join(table.column("packed").to_pylist()), dtype=U)
        ids = pa.concat_arrays([x.flatten() for x in table.column("ids").chunks])
        hot = np.unique(np.frombuffer(b"".join(table.column("hot").to_pylist()), dtype=U))
        rank = pa.compute.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)
        by = np.lexsort((rank, keys))
        k, r = keys[by], rank[by]
        begin = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        run = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(k))))
        is_hot = np.isin(k[begin], hot, assume_unique=True) if len(hot) else np.zeros(len(begin), dtype=bool)
        shared = (r != r[begin[run]]) & ~is_hot[run]
        pairs = np.unique(np.stack([r[begin[run]][shared], r[shared]]), axis=1) if shared.any() else np.zeros((2, 0), dtype=np.int64)
        place = np.empty(int(rank.max()) + 1, dtype=np.int64)
        place[rank] = np.arange(len(rank))
        own, pivot = ids.take(pa.array(place[pairs[1]])), ids.take(pa.array(place[pairs[0]]))
        part = (_hashed(pivot) % U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        used, first = np.unique(part[order], return_index=True)
        ends = [*first.tolist(), len(order), len(order) + int(is_hot.sum())]
        named = begin[is_hot]
        pack = lambda x, last: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays([x.take(pa.array(order)), last]))
        none = pa.nulls(len(named), ids.type)
        held = pa.ListArray.from_arrays(pa.array([0] * (len(used) + 1) + [len(named)], pa.int32()), pa.array(k[named].view(np.int64)))
        return pa.table({"part": pa.array([*used.tolist(), -1], pa.int64()), "ids": pack(own, none), "pivots": pack(pivot, ids.take(pa.array(place[r[named]]))), "keys": held})

    return run


def _hashed(ids: pa.Array) -> np.ndarray:
    """A hash of each id, the same in every task."""
    if pa.types.is_integer(ids.type):
        return mix(ids.cast(pa.int64()).to_numpy(zero_copy_only=False).view(U) + U(0x9E3779B97F4A7C15))
    coded = ids.dictionary_encode()
    known = np.array([hash_of(x) for x in coded.dictionary.to_pylist()], dtype=U)
    return known[coded.indices.to_numpy()] if len(known) else np.zeros(0, dtype=U)


def _merged(table: pa.Table) -> pa.Table:
    """The pairs of all buckets in a part of the pivots, each once."""
    release()
    flat = lambda name: pa.concat_arrays([x.flatten() for x in table.column(name).chunks])
    both = pa.concat_arrays([flat("ids"), flat("pivots")])
    rank = pa.compute.rank(both, tiebreaker="dense").to_numpy().astype(np.int64).reshape(2, -1)
    _, first = np.unique(rank[0] * (rank.max(initial=0) + 1) + rank[1], return_index=True)
    return pa.table({"id": both.take(pa.array(first)), "pivot": both.take(pa.array(first + rank.shape[1]))})


def _regions(stage: Stage, tried: DataFrame, name: str, kind: str) -> DataFrame:
    """(id, pivot): for each key of a document (id, keys) the smallest document that has it, if another.

    Two shuffles of packed entries, by buckets of keys and by parts of pivots, whose number grows with the
    keys. The documents of a key that any task found frequent are all found again by that key, whatever the
    splits of ``tried``.
    """
    total = tried.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    buckets = max(12, -(-total // BUCKET))
    dealt = tried.mapInArrow(_deal(buckets), f"bucket long, packed binary, ids array<{kind}>, hot binary")
    met = stage.put(dealt.groupBy("bucket").applyInArrow(_meet(buckets), f"part long, ids array<{kind}>, pivots array<{kind}>, keys array<long>"), f"{name}-met")
    found = met.where("part >= 0").select("part", "ids", "pivots").groupBy("part").applyInArrow(_merged, f"id {kind}, pivot {kind}")
    hot = stage.put(met.where("part < 0").select(F.inline(F.arrays_zip("keys", "pivots"))).toDF("key", "pivot"), f"{name}-hot")
    if n := hot.count():
        back = tried.select("id", F.explode("keys").alias("key")).join(F.broadcast(hot) if n <= BROADCAST else hot, "key")
        found = found.unionByName(back.where("id <> pivot").select("id", "pivot")).distinct()
    found = stage.put(found, name)
    stage.drop(f"{name}-met", f"{name}-hot")
    return found


def hash_of(value) -> int:
    return int.from_bytes(hashlib.blake2b(str(value).encode(), digest_size=8).digest(), "little")


def _carried(width: int):
    """The set of each document (id, group, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            grams = pa.array([x.tobytes() for x in shingle_sets(data, offsets, width)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), grams], ["group", "id", "grams"])

    return run


class Postings:
    """An inverted index of sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        whole = np.concatenate(sets)
        by = np.argsort(whole, kind="stable")
        whole = whole[by]
        self.posting = np.repeat(np.arange(self.n, dtype=np.int32), [len(x) for x in sets])[by]
        first = np.flatnonzero(np.append(True, whole[1:] != whole[:-1])) if len(whole) else np.zeros(0, dtype=np.int64)
        self.values, self.begin = whole[first], np.append(first, len(whole))

    def common(self, sets: list[np.ndarray]) -> np.ndarray:
        """Sizes of the intersections of every one of some sets with every set of the index."""
        out = np.zeros((len(sets), self.n), dtype=np.int64)
        for i, x in enumerate(sets):
            where = np.minimum(np.searchsorted(self.values, x), len(self.values) - 1)
            where = where[self.values[where] == x]
            if len(where):
                lo, count = self.begin[where], self.begin[where + 1] - self.begin[where]
                which = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
                out[i] = np.bincount(self.posting[which], minlength=self.n)
        return out


def voronoi(grams: list[np.ndarray], pivots: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nearest, distance, window, linked) of sets and pivots.

    ``window``: for each set and pivot, whether the set takes part in the pivot's region, as its home or
    as a replica; ``linked``: whether they are linked, exactly.
    """
    common = Postings(pivots).common(grams)
    union = np.array([len(x) for x in grams])[:, None] + np.array([len(x) for x in pivots])[None, :] - common
    apart = 1 - common / np.maximum(union, 1)
    nearest = apart.argmin(axis=1)
    least = apart[np.arange(len(grams)), nearest]
    window = apart <= least[:, None] + 2 * (1 - num / den) + 1e-9
    return nearest, least, window, den * common >= num * union


def join_members(grams: list[np.ndarray], forest: Forest, members: np.ndarray, num: int, den: int, few: int) -> list[tuple[int, int]]:
    """Links that connect all that is linked among members, by Voronoi regions, recursively."""
    found: list[tuple[int, int]] = []
    todo = [members]
    while todo:
        now = todo.pop()
        if len({forest.top(i) for i in now.tolist()}) < 2:
            continue
        if len(now) <= few:
            found += _inverted(grams, forest, now, num, den)
            continue
        n = int(np.ceil(np.sqrt(len(now))))
        pivots = now[np.unique(np.linspace(0, len(now) - 1, n).astype(np.int64))]
        nearest, _, window, linked = voronoi([grams[i] for i in now], [grams[i] for i in pivots], num, den)
        for i, j in zip(*np.nonzero(linked), strict=True):
            if now[i] != pivots[j] and forest.tie(int(now[i]), int(pivots[j])):
                found.append((int(now[i]), int(pivots[j])))
        for j in range(len(pivots)):
            home = nearest == j
            inside = now[window[:, j]]
            if home.any() and len(inside) > 1:
                if 4 * len(inside) > 3 * len(now):  # hardly smaller: pivots tell little about these sets
                    found += _inverted(grams, forest, now, num, den)
                    break
                todo.append(inside)
    return found


def _inverted(grams: list[np.ndarray], forest: Forest, members: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    ids = members.tolist()
    label = [forest.top(i) for i in ids]
    found = join_cell(ids, [grams[i] for i in ids], np.ones(len(ids), dtype=bool), np.zeros(len(ids)), label, num, den)
    return [(a, b) for a, b in found if forest.tie(a, b)]


def join_cell(ids: list, grams: list[np.ndarray], home: np.ndarray, block: np.ndarray, label: list, num: int, den: int) -> list[tuple]:
    """Links in a cell that, with what is known, connect all that is linked in it.

    ``home``: members whose pairs count; pairs without one are another cell's. ``block``: 0 or 1; if
    both occur, pairs join across them only. ``label``: members of equal label are connected already,
    so members of the most frequent one need not be tried against each other.
    """
    sizes = np.array([len(g) for g in grams], dtype=np.int64)
    names, root = np.unique(np.array(label, dtype=object).astype(str), return_inverse=True)
    rows = np.flatnonzero(root != np.bincount(root).argmax())
    if not len(rows):
        return []
    across = len(set(block.tolist())) > 1
    forest, found, index = Forest(len(names)), [], Postings(grams)
    for at in range(0, len(rows), 256):
        part = rows[at : at + 256]
        common = index.common([grams[i] for i in part])
        linked = den * common >= num * (sizes[None, :] + sizes[part][:, None] - common)
        for i, near in zip(part.tolist(), linked, strict=True):
            near[i] = False
            if not home[i]:
                near &= home
            if across:
                near &= block != block[i]
            for j in np.flatnonzero(near).tolist():
                if forest.tie(int(root[i]), int(root[j])):
                    found.append((ids[i], ids[j]))
    return found


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=U) for x in column.to_pylist()]


def _links(found: list[tuple], kind: pa.DataType) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in found], kind), "b": pa.array([x for _, x in found], kind)})


def _small(num: int, den: int, few: int):
    """Links of whole groups (group, id, grams), many groups at once."""

    def run(table: pa.Table) -> pa.Table:
        release()
        ids, grams = table.column("id").to_pylist(), _sets(table.column("grams"))
        forest, found, of = Forest(len(ids)), [], {}
        for i, g in enumerate(table.column("group").to_pylist()):
            of.setdefault(g, []).append(i)
        for own in of.values():
            own.sort(key=ids.__getitem__)
            found += join_members(grams, forest, np.array(own), num, den, few)
        return _links([(ids[i], ids[j]) for i, j in found], table.schema.field("id").type)

    return run


def _assigned(num: int, den: int):
    """Regions (group, pivot, id, common, n, pivot_n) of a chunk of a group's members (…, is_pivot).

    Members for which windows tell nothing, because their nearest pivot is farther than one less two
    radii, are in the region without a pivot; so is all that may be linked to such a member.
    """
    radius = 1 - num / den

    def run(table: pa.Table) -> pa.Table:
        release()
        flag = np.array(table.column("is_pivot").to_pylist(), dtype=bool)
        grams, ids = _sets(table.column("grams")), table.column("id").combine_chunks()
        at, own = np.flatnonzero(~flag), np.flatnonzero(flag)
        pivots = [grams[j] for j in own]
        rows, cols, common = [], [], []
        for lo in range(0, len(at), 256):
            part = at[lo : lo + 256]
            _, least, window, linked = voronoi([grams[i] for i in part], pivots, num, den)
            near = least < 1 - 2 * radius - 1e-9
            i, j = np.nonzero((window & near[:, None]) | linked)
            far = np.flatnonzero(least >= 1 - 3 * radius - 1e-9)
            rows += [part[i], part[far]]
            cols += [own[j], np.full(len(far), -1)]
            common += [_pairs(grams, part[i], own[j]), np.zeros(len(far), dtype=np.int64)]
        rows, cols = np.concatenate(rows or [at]).astype(np.int64), np.concatenate(cols or [at]).astype(np.int64)
        sizes = np.array([len(x) for x in grams] + [0], dtype=np.int64)
        pivot = ids.take(pa.array(np.where(cols < 0, None, cols).tolist(), pa.int64()))
        return pa.table({"group": table.column("group").combine_chunks().take(pa.array(rows)), "pivot": pivot, "id": ids.take(pa.array(rows)), "common": pa.array(np.concatenate(common or [at]).astype(np.int64)), "n": pa.array(sizes[rows]), "pivot_n": pa.array(sizes[cols])})

    return run


def _pairs(grams: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Size of the intersection of each pair."""
    return np.array([np.isin(grams[a], grams[b], assume_unique=True).sum() for a, b in zip(i.tolist(), j.tolist(), strict=True)], dtype=np.int64)


def _cells(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        release()
        found = join_cell(table.column("id").to_pylist(), _sets(table.column("grams")), np.array(table.column("home").to_pylist(), dtype=bool), np.array(table.column("block").to_pylist()), table.column("label").to_pylist(), num, den)
        return _links(found, table.schema.field("id").type)

    return run


def _tied(num: int, den: int):
    """Members of regions (pivot, id, n_shingles, sketch) that by their distances to the fixed pivots may be linked, as
    a spanning forest of each region; many regions at once."""

    def run(table: pa.Table) -> pa.Table:
        release()
        pivot = pa.compute.rank(table.column("pivot").combine_chunks(), tiebreaker="dense").to_numpy()
        by = np.argsort(pivot, kind="stable")
        n = table.column("n_shingles").to_numpy()[by]
        held = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, PIVOTS)[by]
        ends = np.flatnonzero(np.diff(pivot[by], append=-1)) + 1
        a, b = [], []
        for at, end in zip([0, *ends.tolist()], ends.tolist(), strict=False):
            forest, sizes, counts = Forest(end - at), n[at:end], held[at:end].astype(np.int16)
            for i in range(end - at - 1):
                near = (den + num) * np.abs(counts[i + 1 :] - counts[i]).sum(axis=1) <= (den - num) * (sizes[i + 1 :] + sizes[i])
                for j in (np.flatnonzero(near) + i + 1).tolist():
                    if forest.tie(i, j):
                        a.append(at + i)
                        b.append(at + j)
        ids, kind = table.column("id").combine_chunks(), pa.int64()
        return pa.table({"a": ids.take(pa.array(by[np.array(a, dtype=np.int64)], kind)), "b": ids.take(pa.array(by[np.array(b, dtype=np.int64)], kind))})

    return run


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100, leaf: int = LEAF, few: int = FEW) -> tuple[DataFrame, DataFrame, Stage]:
    """Join documents whose sets of word n-grams have den * intersection >= num * union, exactly.

    Returns ``members`` (id, n_shingles, representative: the smallest id with the same set) and
    ``links`` (a, b: verified links between representatives that connect everything that is linked,
    a spanning set of each region rather than all of its pairs), and the stage that holds both.

    Words are ``[^\\x20\\x09-\\x0D]+``, A-Z as lower case, texts whole, of any length. Null and empty texts
    have an empty set, are linked with nothing and represent themselves; so do rows whose id is null, which
    keep their size. Repeated rows are equal sets; rows of one id and different texts count as one
    document that has the links of all. An empty table has no members. Other columns of ``docs`` are
    ignored, whatever their names. Results do not depend on ``leaf`` and ``few``.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "ngram-join")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    profile = stage.put(rows.mapInArrow(_profile(width, num, den), f"id {kind}, n_shingles long, sig1 long, sig2 long, keys array<long>, sketch binary"), "profile")
    filled = profile.where("n_shingles > 0 and id is not null")
    represents = filled.groupBy("sig1", "sig2", "n_shingles").agg(F.min("id").alias("representative"))
    members = filled.select("id", "n_shingles", "sig1", "sig2").join(represents, ["sig1", "sig2", "n_shingles"]).select("id", "n_shingles", "representative")
    members = stage.put(members.unionByName(profile.where("n_shingles = 0 or id is null").select("id", "n_shingles", F.col("id").alias("representative"))), "members")
    copies = members.where("id <> representative").select("id").distinct()
    tried = filled.select("id", "keys").join(_listed(stage, copies, "copies"), "id", "left_anti")

    sketches = profile.select("id", "n_shingles", "sketch")
    ties, level, before = None, 0, None
    while True:
        found = _regions(stage, tried, f"regions{level}", kind)
        if level:
            stage.drop(f"tried{level}")
        sizes = found.groupBy("pivot").count()
        crowded = stage.put(sizes.where(F.col("count") > leaf).select("pivot"), f"crowded{level}")
        part = found.join(crowded, "pivot", "left_anti")
        part = part.unionByName(part.select(F.col("pivot").alias("id"), "pivot").distinct()).join(sketches, "id")
        buckets = max(12, found.count() // TOGETHER)
        tied = part.select("pivot", "id", "n_shingles", "sketch", F.pmod(F.xxhash64("pivot"), F.lit(buckets)).alias("bucket")).groupBy("bucket").applyInArrow(_tied(num, den), f"a {kind}, b {kind}")
        tied = stage.put(tied.distinct(), f"tied{level}")
        ties = tied if ties is None else ties.unionByName(tied)
        large = found.join(crowded, "pivot", "left_semi")
        left = 0 if crowded.isEmpty() else large.count()
        if not left or before is not None and left > (1 - SHRINKS) * before:
            break
        before, level = left, level + 1
        crowd = rows.join(_by_document(stage, large, f"crowd{level}"), "id").select("id", "regions", "text")
        tried = stage.put(crowd.mapInArrow(_deeper(width, num, den, level), f"id {kind}, keys array<long>"), f"tried{level}")
        stage.drop(f"regions{level - 1}")
    stage.drop("profile")
    if left:  # such regions are part of a group whole: each member is tied to one pivot, and its other pivots to that
        first = large.groupBy("id").agg(F.min("pivot").alias("one"))
        others = large.join(first, "id").where("pivot <> one").select(F.col("pivot").alias("a"), F.col("one").alias("b")).distinct()
        ties = ties.unionByName(first.select(F.col("id").alias("a"), F.col("one").alias("b"))).unionByName(others)

    groups = stage.put(connected_components(ties, "a", "b", stage, "groups").select(F.col("node").alias("id"), F.col("label").alias("group")), "grouped")
    sizes = stage.put(groups.groupBy("group").count(), "sizes")
    carried = stage.put(rows.join(_listed(stage, groups, "listed"), "id").select("id", "group", "text").mapInArrow(_carried(width), f"group {kind}, id {kind}, grams binary"), "carried")
    n = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count_if(F.col("count") > leaf)).first()
    small = carried.join(sizes.where(F.col("count") <= leaf).select("group"), "group") if n[1] else carried
    small = small.groupBy(F.pmod(F.xxhash64("group"), F.lit(max(12, n[0] // 1024))).alias("bucket")).applyInArrow(_small(num, den, few), f"a {kind}, b {kind}")
    links = stage.put(small, "links_small")
    if n[1]:
        links = stage.put(links.unionByName(_large(stage, carried, sizes.where(F.col("count") > leaf), kind, num, den, leaf, few)).distinct(), "links")
    stage.drop("carried", "grouped", "listed", "copies", "sizes", *(f"{x}{k}" for k in range(level + 1) for x in ("tied", "regions", "crowded", "crowd")))
    return members, links, stage


def _listed(stage: Stage, ids: DataFrame, name: str) -> DataFrame:
    """A list of documents, broadcast if short."""
    ids = stage.put(ids, name)
    return F.broadcast(ids) if ids.count() <= BROADCAST else ids


def _by_document(stage: Stage, regions: DataFrame, name: str) -> DataFrame:
    """(id, regions): the pivots of the regions of each document, pivots themselves included."""
    own = regions.select(F.col("pivot").alias("id"), "pivot")
    every = regions.select("id", "pivot").unionByName(own)
    each = stage.put(every.groupBy("id").agg(F.collect_set("pivot").alias("regions")), name)
    return F.broadcast(each) if regions.count() <= BROADCAST else each


def _large(stage: Stage, carried: DataFrame, sizes: DataFrame, kind: str, num: int, den: int, leaf: int, few: int) -> DataFrame:
    """Links within groups of more than ``leaf`` members, cut into Voronoi regions by pivots of each group.

    About CUT members of a group are its pivots, drawn by hash, and its smallest one. Every chunk of
    ``leaf`` members meets all of them.
    """
    sized = carried.join(sizes, "group")
    chunks = F.ceil(F.col("count") / leaf)
    drawn = (F.pmod(F.xxhash64("id", F.lit(1)), F.col("count")) < CUT) | (F.col("id") == F.col("group"))
    member = sized.select("group", F.pmod(F.xxhash64("id", F.lit(2)), chunks).alias("chunk"), "id", "grams", F.lit(False).alias("is_pivot"))
    pivots = sized.where(drawn).select("group", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"), "id", "grams", F.lit(True).alias("is_pivot"))
    near = member.unionByName(pivots).groupBy("group", "chunk").applyInArrow(_assigned(num, den), f"group {kind}, pivot {kind}, id {kind}, common long, n long, pivot_n long")
    union = F.col("n") + F.col("pivot_n") - F.col("common")
    # ring k: distances above k radii, up to k + 1 and that included, in whole numbers; ring 0 is linked to the pivot
    near = near.withColumn("apart", den * (union - F.col("common"))).withColumn("radius", (den - num) * union)
    near = near.withColumn("ring", F.when(F.col("pivot").isNull(), 1).when(F.col("apart") <= F.col("radius"), 0).otherwise(F.expr("(apart - 1) div radius")).cast("int"))
    near = stage.put(near.select("group", "pivot", "id", "n", "ring"), "distances")
    known = near.where("ring = 0 and id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b"))
    labels = stage.put(connected_components(known, "a", "b", stage, "known").withColumnRenamed("node", "id"), "labels")
    near = near.join(labels, "id", "left").select("group", "pivot", "id", "n", "ring", F.coalesce("label", "id").alias("label"))
    every = near.groupBy("group", "pivot").agg(F.count("*").alias("size"), F.min("label").alias("one"), F.max("label").alias("two")).join(sizes, "group")
    every = stage.put(every.select("group", "pivot", "size", "count", (F.col("one") != F.col("two")).alias("open")), "every")
    flat = every.where(F.col("size") > FLAT * F.col("count")).select("group").distinct()
    # regions whose members are all connected already are done; a group that pivots hardly cut falls into parts by rare n-grams
    open_ = every.where("open").join(flat, "group", "left_anti").select(F.col("group").alias("g"), F.col("pivot").alias("p"), "size")
    name = F.xxhash64(F.coalesce(F.col("pivot").cast("string"), F.lit("")), F.col("group").cast("string"), F.col("pivot").isNull())
    cut = near.join(open_, F.col("group").eqNullSafe(F.col("g")) & F.col("pivot").eqNullSafe(F.col("p"))).select(name.alias("region"), "id", "n", "ring", "label", "size")
    flat = stage.put(flat, "flat")
    if not flat.isEmpty():
        parts = _split(stage, carried.join(F.broadcast(flat), "group", "left_semi"), kind, num, den)
        whole = near.join(flat, "group", "left_semi").select("id", "n", "label").distinct().join(parts, "id")
        open_ = whole.groupBy("part").agg(F.count("*").alias("size"), F.min("label").alias("one"), F.max("label").alias("two")).where("one <> two").select("part", "size")
        cut = cut.unionByName(whole.join(open_, "part").select(F.xxhash64(F.col("part").cast("string")).alias("region"), "id", "n", F.lit(1).alias("ring"), "label", "size"))
    near = stage.put(cut, "near")
    sets = carried.select("id", "grams")
    few_ = near.where(F.col("size") <= leaf).select(F.col("region").alias("group"), "id").join(sets, "id")
    done = few_.groupBy("group").applyInArrow(_small(num, den, few), f"a {kind}, b {kind}")
    out = known.unionByName(stage.put(done, "links_regions"))
    crowded = near.where(F.col("size") > leaf)
    if crowded.isEmpty():
        return out
    return out.unionByName(_ringed(crowded.select("region", "id", "n", "ring", "label"), sets, kind, num, den, BLOCK * leaf))


def _dealt(parts: int):
    """The n-grams of each set (group, id, grams), told apart by groups, as rows (bucket, id, sig, n, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, buckets, sigs, sizes, packed = [], [], [], [], []
            for i, (group, grams) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                x = mix(np.frombuffer(grams, dtype=U) ^ np.array([hash_of(group)], dtype=U))
                bucket = (x % U(parts)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                used, first = np.unique(bucket[by], return_index=True)
                packed += [y.tobytes() for y in np.split(x[by], first[1:])]
                buckets += used.tolist()
                at += [i] * len(used)
                sigs += [int(mix(x * U(3)).sum(dtype=U).astype(np.int64))] * len(used)
                sizes += [len(x)] * len(used)
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), batch.column(1).take(pa.array(at, pa.int64())), pa.array(sigs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], ["bucket", "id", "sig", "n", "keys"])
        release()

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Of a bucket's keys those that several sets have, with the number of these sets."""
    release()
    held = [np.frombuffer(x, dtype=U) for x in table.column("keys").to_pylist()]
    _, inverse, count = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
    often = np.split(count[inverse].astype(np.uint32), np.cumsum([len(x) for x in held])[:-1])
    keys, counts = [x[c > 1].tobytes() for x, c in zip(held, often, strict=True)], [c[c > 1].tobytes() for c in often]
    return table.select(["id", "sig", "n"]).append_column("keys", pa.array(keys, pa.binary())).append_column("counts", pa.array(counts, pa.binary()))


def _rarest(num: int, den: int):
    """(id, keys): the rarest keys of each set, of which linked sets have one in common; none if no set can be linked to it.

    Linked sets have num / den of the larger one in common, so in one order of all keys the first
    n - ceil(n * num / den) + 1 of both meet. The order is by number of sets, so keys of one set come first.
    """

    def run(table: pa.Table) -> pa.Table:
        release()
        sizes, counts, keys = (table.column(x).to_pylist() for x in ("n", "counts", "keys"))
        rank = pa.compute.rank(table.column("id").combine_chunks(), tiebreaker="dense").to_pylist()
        of: dict[tuple, list[int]] = {}
        for i, own in enumerate(zip(rank, table.column("sig").to_pylist(), strict=True)):
            of.setdefault(own, []).append(i)
        at, out = [], []
        for rows in of.values():
            x, first = np.unique(np.frombuffer(b"".join(keys[i] for i in rows), dtype=U), return_index=True)
            c = np.frombuffer(b"".join(counts[i] for i in rows), dtype=np.uint32)[first]
            n = sizes[rows[0]]
            if (take := len(x) + (-num * n // den) + 1) > 0:
                at.append(rows[0])
                out.append(x[np.lexsort((x, c))[:take]])
        return pa.table({"id": table.column("id").combine_chunks().take(pa.array(at, pa.int64())), "keys": _lists(out) if out else pa.array([], pa.list_(pa.int64()))})

    return run


def _split(stage: Stage, sets: DataFrame, kind: str, num: int, den: int) -> DataFrame:
    """(id, part) of the sets (group, id, grams) of some groups: no link leaves a part, and what no link reaches has none.

    Sets that share a rare n-gram are tied; each n-gram is counted once and none is compared with another.
    """
    total = sets.agg(F.coalesce(F.sum(F.length("grams")), F.lit(0))).first()[0] // 8
    parts = max(12, -(-total // BUCKET))
    dealt = sets.select("group", "id", "grams").mapInArrow(_dealt(parts), f"bucket long, id {kind}, sig long, n long, keys binary")
    counted = dealt.groupBy("bucket").applyInArrow(_shared, f"id {kind}, sig long, n long, keys binary, counts binary")
    rare = counted.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("bucket")).applyInArrow(_rarest(num, den), f"id {kind}, keys array<long>")
    found = _regions(stage, stage.put(rare, "rare"), "meeting", kind)
    parts_ = connected_components(found, "id", "pivot", stage, "parts")
    out = stage.put(parts_.select(F.col("node").alias("id"), F.col("label").alias("part")), "split")
    stage.drop("rare", "meeting")
    return out


def _ringed(near: DataFrame, sets: DataFrame, kind: str, num: int, den: int, most: int) -> DataFrame:
    """Links within regions of any size: (region, id, n, ring, label) and the sets (id, grams) of n n-grams.

    Linked members stand in one ring or in neighbouring ones; members of ring 0 are connected. What has
    one label is connected already and not tried again. A cell holds about ``most`` n-grams of a block.
    """
    key = ["region", "ring"]
    own = near.where("ring > 0").select(*key, "id", "n", "label", F.lit(True).alias("home"))
    inner = near.select("region", (F.col("ring") + 1).alias("ring"), "id", "n", "label", F.lit(False).alias("home"))
    rings = near.where("ring > 0").select(*key).distinct()
    sizes = own.unionByName(inner.join(rings, key, "left_semi")).groupBy(*key).agg(F.sum(F.when(F.col("home"), F.col("n"))).alias("own"), F.coalesce(F.sum(F.when(~F.col("home"), F.col("n"))), F.lit(0)).alias("inside"), F.min("label").alias("one"), F.max("label").alias("two"))
    sizes = sizes.where("one <> two").select(*key, F.ceil(F.col("own") / most).alias("hb"), F.ceil(F.col("inside") / most).alias("wb"))
    placed = own.unionByName(inner).join(sizes, key)
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("home"), F.col("hb")).otherwise(F.greatest("wb", F.lit(1)))).alias("mine")
    placed = placed.select(*key, "id", "label", "home", "hb", "wb", mine)
    # cells: home block i by itself; home blocks i < j; home block i and inner block j
    every = F.sequence(F.lit(0), F.col("hb") - 1)
    with_home = F.transform(every, lambda j: F.struct(F.least(F.col("mine"), j).cast("long").alias("i"), F.greatest(F.col("mine"), j).cast("long").alias("j"), F.lit(False).alias("window")))
    with_inner = F.when(F.col("wb") > 0, F.transform(F.sequence(F.lit(0), F.col("wb") - 1), lambda j: F.struct(F.col("mine").cast("long").alias("i"), j.cast("long").alias("j"), F.lit(True).alias("window")))).otherwise(F.array().cast("array<struct<i:bigint,j:bigint,window:boolean>>"))
    from_inner = F.transform(every, lambda i: F.struct(i.cast("long").alias("i"), F.col("mine").cast("long").alias("j"), F.lit(True).alias("window")))
    cells = placed.select(*key, "id", "label", "home", "mine", F.explode(F.when(F.col("home"), F.concat(with_home, with_inner)).otherwise(from_inner)).alias("cell"))
    block = F.when(F.col("cell.window"), F.when(F.col("home"), 0).otherwise(1)).otherwise(F.when(F.col("mine") == F.col("cell.i"), 0).otherwise(1)).alias("block")
    cells = cells.select(*key, F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), F.col("cell.window").alias("window"), "id", "label", "home", block)
    return cells.join(sets, "id").groupBy(*key, "i", "j", "window").applyInArrow(_cells(num, den), f"a {kind}, b {kind}")


def ngram_jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id): each document with the smallest id that links reach from it."""
    members, links, stage = ngram_jaccard_join(docs, id_col, text_col, width, num, den)
    found = stage.put(connected_components(links, "a", "b", stage), "components")
    out = members.join(found.withColumnRenamed("node", "representative"), "representative", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("label", "representative").alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its class; of repeated rows with that id, one.

    Documents without words are linked with nothing and all stay, as do rows without an id.
    """
    classes = ngram_jaccard_classes(docs, id_col, text_col, width, num, den)
    dropped = classes.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    kept = docs.join(dropped, id_col, "left_anti")
    repeated = classes.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col)
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    single = kept.join(repeated, id_col, "left_anti")
    return single.unionByName(kept.join(repeated, id_col, "left_semi").dropDuplicates([id_col])).select(*docs.columns)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ngram_jaccard_classes(docs, width=4, num=85, den=100)
