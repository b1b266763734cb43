"""Components of few links, and candidate regions compared together, against their plain definitions."""

import numpy as np
import pyarrow as pa
import pytest

from provgraph.llm import ngram_join, suffix_tree, words
from provgraph.llm.components import Forest, connected_components
from provgraph.llm.shared import Stage


class Noted(Stage):
    def put(self, df, name):
        self.names = [*getattr(self, "names", []), name]
        return super().put(df, name)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_few_links_take_one_task_and_many_the_same_labels(spark, kind):
    rng = np.random.default_rng(3)
    links = [(k, k + 1) for k in range(40)] + [tuple(map(int, x)) for x in rng.integers(100, 160, (30, 2))] + [(5, 5), (None, 7), (3, 4), (4, 3)]
    df = spark.createDataFrame(links, "a long, b long").selectExpr(f"cast(a as {kind}) a", f"cast(b as {kind}) b")
    stage = Noted(spark, "test")
    few = {tuple(r) for r in connected_components(df, "a", "b", stage).collect()}
    assert stage.names == ["stars0", "stars-done"]
    many = {tuple(r) for r in connected_components(df, "a", "b", Stage(spark, "test"), at_once=0).collect()}
    of = {}
    forest = Forest(200)
    for a, b in links:
        if a is not None and a != b:
            forest.tie(a, b)
    for i in {x for a, b in links if a is not None and a != b for x in (a, b)}:
        of.setdefault(forest.top(i), []).append(i if kind == "long" else str(i))
    assert few == many == {(i, min(x)) for x in of.values() for i in x}
    assert connected_components(df.where("a < 0"), "a", "b", Stage(spark, "test")).collect() == []


def test_many_candidate_regions_are_compared_in_one_call():
    rng = np.random.default_rng(4)
    rows = [(int(p), int(p) * 100 + k, 200, np.bincount(rng.integers(0, 256, 200), minlength=256).astype(np.uint8) if k % 3 else np.full(256, p, np.uint8)) for p in (9, 2, 5) for k in range(7)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    made = lambda rows: pa.table({"pivot": [r[0] for r in rows], "id": [r[1] for r in rows], "n_shingles": [r[2] for r in rows], "sketch": [r[3].tobytes() for r in rows]})
    found = ngram_join._tied(80, 100)(made(rows)).to_pylist()
    alone = [x for p in (2, 5, 9) for x in ngram_join._tied(80, 100)(made([r for r in rows if r[0] == p])).to_pylist()]
    assert found == alone and len(found) == 6
    assert all(x["a"] // 100 == x["b"] // 100 and x["a"] % 100 % 3 == x["b"] % 100 % 3 == 0 for x in found)


def test_slices_of_no_batches():
    assert list(words.slices(iter([]), "text")) == []


def test_keys_of_one_batch_are_dealt_out_in_bounded_pieces(monkeypatch):
    monkeypatch.setattr(ngram_join, "BUCKET", 100)
    sizes = [0, 30, 90, 250, 0, 10, 40, 60, 1]
    lists = [[1000 * i + k for k in range(n)] for i, n in enumerate(sizes)] + [None]
    batch = pa.record_batch({"id": pa.array(range(10)), "keys": pa.array(lists, pa.list_(pa.int64()))})
    got = list(ngram_join._gathered(iter([batch, batch])))
    assert max(len(k) for k, _ in got) == 250 and sum(len(k) > 100 for k, _ in got) == 2
    pairs = [(i, int(k)) for keys, ids in got for k, i in zip(keys, ids.to_pylist(), strict=True)]
    assert pairs == 2 * [(i, k) for i, x in enumerate(lists) for k in x or []]


def test_counts_of_contexts_travel_packed_and_add_up():
    rng = np.random.default_rng(5)
    vocabulary = words.mix(np.arange(1, 400, dtype=words.U))
    texts = [" ".join(f"w{k}" for k in np.minimum(rng.zipf(1.3, 300), 300)) for _ in range(60)]
    every = type("Held", (), {"value": np.full(1 << (suffix_tree.MAP_BITS - 3), 255, dtype=np.uint8)})
    batch = pa.record_batch({"text": texts})
    plain = {}
    for _, data, offsets in words.slices(iter([batch]), "text"):
        token, sizes = suffix_tree.tokens(data, offsets)
        context, there = suffix_tree.contexts(token, sizes, 2)[-1]
        for pair in zip(context[there].tolist(), token[there].tolist(), strict=True):
            plain[pair] = plain.get(pair, 0) + 2
    often = np.sort(np.array(sorted(c for c, _ in plain)[:1], dtype=words.U))
    for hot in (often[:0], often, vocabulary):
        rows = [x for _ in range(2) for x in suffix_tree._followed(2, every, every, np.sort(hot), 7)(iter([batch]))]
        assert sum(x.num_rows for x in rows) == 14
        table = pa.Table.from_batches(rows)
        assert sum(table.column(c).nbytes for c in suffix_tree.PACKED) < 24 * 2 * len(plain)
        got = {}
        for b in range(7):
            summed = suffix_tree._summed(3)(table.filter(pa.compute.equal(table.column("bucket"), b)))
            for c, t, n in zip(*(summed.column(c).to_numpy() for c in ("context", "token", "n")), strict=True):
                assert got.setdefault((int(c) % 2**64, int(t) % 2**64), int(n)) == n
        assert got == {pair: n for pair, n in plain.items() if n >= 3}
