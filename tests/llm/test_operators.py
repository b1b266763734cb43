"""Operators on small tables with nulls, empty and repeated rows, against brute force or the libraries."""

import random
import re

import numpy as np
import pytest
import public_tokenizers as P
from tokenizers import Tokenizer

from provgraph.llm import decontaminate, gif, license_scan, mixing, ngram_join, suffix_tree, token_counts, token_files, toxicity, url_filter

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, id string, key string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["the", "of", "Ähre", "blue", "stone", "RIVER", "x1", "über", "idiot", "day"]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(40)]
    near = [b.replace(b.split()[0], "zzz", 1) for b in base[:20]]
    odd = [None, "", " \n\t", "a", "All rights reserved. Licensed under CC BY-NC 4.0 and the GNU General Public License v2", " ".join(words * 3000)]
    return base + near + base[:10] + odd


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "src", len(t or ""), "clash", "clash") for i, t in enumerate(texts)], SHAPE)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


def sets_of(t, k):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def classes_of(sets, num, den=100):
    """The smallest linked number of each set, by brute force."""
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(sets))]


@pytest.mark.parametrize(("width", "num", "leaf", "few"), [(4, 85, 512, 8), (5, 80, 512, 3), (2, 60, 4, 3)])
def test_ngram_join(docs, texts, width, num, leaf, few):
    members, links, _ = ngram_join.ngram_jaccard_join(docs, width=width, num=num, den=100, leaf=leaf, few=few)
    sets = [sets_of(t, width) for t in texts]
    want = classes_of(sets, num)
    if leaf == 512:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_classes(docs, width=width, num=num, den=100).collect()}
        assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}
    pairs = [(r.a, r.b) for r in links.collect()]
    assert all(100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) for a, b in pairs)
    first = {r.id: r.representative for r in members.collect()}
    assert [component(first[i], pairs) for i in range(len(sets))] == want


@pytest.mark.parametrize(("leaf", "num", "block"), [(8, 85, 40), (40, 60, 10), (512, 80, 4096)])
def test_ngram_join_of_crowded_copies(spark, leaf, num, block, monkeypatch):
    """Chains of near copies and documents around one passage, in groups far above ``leaf``: no link is lost."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(leaf + num)
    passage = [f"p{k}" for k in range(12)]
    texts = []
    for chain in range(3):
        words = [f"c{chain}w{k}" for k in range(40)]
        for _ in range(50):
            words = list(words)
            words[rng.randrange(40)] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    texts += [" ".join(passage[: rng.randint(6, 12)] + [f"u{rng.randrange(40)}" for _ in range(rng.randint(0, 6))]) for _ in range(120)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    members, links, _ = ngram_join.ngram_jaccard_join(docs, width=2, num=num, den=100, leaf=leaf, few=3)
    sets = [sets_of(t, 2) for t in texts]
    pairs = [(r.a, r.b) for r in links.collect()]
    assert all(100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) for a, b in pairs)
    first = {r.id: r.representative for r in members.collect()}
    assert [component(first[i], pairs) for i in range(len(sets))] == classes_of(sets, num)

def test_ngram_join_of_a_group_that_pivots_hardly_cut(spark, monkeypatch):
    from pyspark.sql import functions as F

    from provgraph.llm.shared import Stage

    rng = np.random.default_rng(5)
    passage = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([passage, rng.integers(1, 1 << 62, 200).astype(np.uint64)])) for _ in range(90)]
    sets += [np.unique(np.append(x[rng.permutation(500)[: 500 - cut]], np.arange(7, dtype=np.uint64))) for x, cut in zip(sets[:12], (5, 60, 111, 112, 113, 114) * 2, strict=True)]
    sets += [np.unique(np.concatenate([passage, rng.integers(1, 1 << 62, k).astype(np.uint64)])) for k in (0, 20, 30, 40, 60, 76, 80)]
    carried = spark.createDataFrame([(0, i, x.tobytes()) for i, x in enumerate(sets)] + [(0, 3, sets[3].tobytes()), (0, 4, sets[50].tobytes())], "group long, id long, grams binary").cache()
    linked = lambda x, y: 100 * (k := len(np.intersect1d(x, y))) >= 80 * (len(x) + len(y) - k)
    forest = ngram_join.Forest(len(sets))
    known = [(i, j) for i in range(len(sets)) for j in range(i) if linked(sets[i], sets[j]) or {i, j} & {4} and linked(sets[50], sets[(i + j) - 4])]
    for i, j in known:
        forest.tie(i, j)
    seen, whole = [], ngram_join._ringed
    monkeypatch.setattr(ngram_join, "_ringed", lambda near, *more: seen.append(near.select("id").distinct().count()) or whole(near, *more))
    found = ngram_join._large(Stage(spark, "flat"), carried, carried.groupBy("group").agg(F.count("*").alias("count")), "bigint", 80, 100, 16, 4).collect()
    got = ngram_join.Forest(len(sets))
    for r in found:
        assert r.a == r.b or (max(r), min(r)) in known
        got.tie(r.a, r.b)
    assert [got.top(i) for i in range(len(sets))] == [forest.top(i) for i in range(len(sets))]
    assert len(known) > 10 and sum(seen) <= 30  # sets that only share the passage meet nobody


def test_ngram_join_rings_with_exact_ties(spark):
    """Crowded regions keep links of exactly the threshold, also from a pivot's members to those at two radii."""
    rng = random.Random(8)
    x = set(range(1, 21))
    sets = {("tie", 0): x - {1, 2, 3}, ("tie", 1): x, ("tie", 2): x - {4, 5, 6}}
    for region in range(6):
        base = list(range(100, 120 + region))
        for k in range(14):
            sets[f"r{region}", k] = set(rng.sample(base, rng.randint(14, len(base))))
    grams = {f"{p}-{k:02}": (p, np.array(sorted(s), dtype=np.uint64)) for (p, k), s in sets.items()}
    held = {i: set(g.tolist()) for i, (_, g) in grams.items()}
    carried = spark.createDataFrame([(i, bytearray(g.tobytes())) for i, (_, g) in grams.items()], "id string, grams binary")
    for num in (80, 85):
        linked = lambda a, b: 100 * len(a & b) >= num * len(a | b)
        near, known = [], []
        for i, (p, _) in grams.items():
            union = len(held[i] | held[f"{p}-00"])
            apart = 100 * (union - len(held[i] & held[f"{p}-00"]))
            ring = 0 if apart <= (100 - num) * union else (apart - 1) // ((100 - num) * union)
            near.append((p, i, len(held[i]), ring, f"{p}-00" if ring == 0 else i))
            known += [(i, f"{p}-00")] if ring == 0 else []
        links = ngram_join._ringed(spark.createDataFrame(near, "region string, id string, n long, ring int, label string"), carried, "string", num, 100, 90).collect()
        assert all(linked(held[r.a], held[r.b]) for r in links)
        of = lambda pairs: {i: component(i, pairs) for i in held}
        assert of([(r.a, r.b) for r in links] + known) == of([(i, j) for i in held for j in held if i < j and grams[i][0] == grams[j][0] and linked(held[i], held[j])])


def test_voronoi_regions_keep_every_link():
    """Every linked pair shares the region that is home to one of both, for any pivots."""
    rng = np.random.default_rng(2)
    for num in (60, 80, 85):
        sets = [np.sort(rng.choice(30, rng.integers(15, 28), replace=False)).astype(np.uint64) for _ in range(150)]
        nearest, least, window, linked = ngram_join.voronoi(sets, sets[:12], num, 100)
        whole = ngram_join.voronoi(sets, sets, num, 100)[3]
        assert (whole[:, :12] == linked).all() and (least[:12] == 0).all()
        i, j = np.nonzero(whole)
        assert window[j, nearest[i]].all() and len(i) > 150


def component(node, pairs):
    seen, before = {node}, 0
    while len(seen) > before:
        before = len(seen)
        seen |= {x for p in pairs if seen & set(p) for x in p}
    return min(seen)


def test_gif_round_trip_and_rules():
    rng = np.random.default_rng(1)
    for n in (192, 192 * 300, 192 * 7):
        raw = rng.integers(0, 4 if n > 9999 else 256, n).astype(np.uint8).tobytes()
        assert gif.features(gif.decode(gif.encode(raw)))[0] == raw
    # a second frame with a transparent colour leaves what is below; disposal 2 clears
    stream = lambda b: b"\x08" + gif._blocks(gif.lzw_encode(b))
    frame = lambda b, flags, clear: b"!\xf9\x04" + bytes([flags, 5, 0, clear]) + b"\0,\0\0\0\0\2\0\1\0\0" + stream(b)
    media = b"GIF89a\2\0\1\0\xf7\0\0" + gif.GREY + frame(b"\x0a\x14", 4, 0) + frame(b"\x07\x1e", 1 | 2 << 2, 7) + frame(b"\x05\x05", 1, 5) + b";"
    seen = [(f.screen[0, :, 0].tolist(), f.milliseconds) for f in gif.decode(media)]
    assert seen == [([10, 20], 50), ([10, 30], 50), ([0, 0], 50)]


def test_token_counts_and_files(docs, texts):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, P.path("byte_bpe_50k.json")).collect()}
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}
    t, at = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    for r in sorted(token_files.token_file_digest(docs, P.path("word_bpe_49k.json")).collect()):
        n = len(t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids) + 1
        assert (r.start, r.n_tokens) == (at, n)
        at += n
    x = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 5], dtype=np.uint32)
    assert (token_files.unpack(*token_files.pack(x), len(x)) == x).all()


@pytest.mark.parametrize("most", [1 << 24, 40])
def test_decontamination(spark, docs, texts, most):
    items = [(1, texts[0]), (2, "the"), (3, None), (4, texts[1]), (5, "")]
    found = decontaminate.judged(decontaminate.contaminated_spans(docs, spark.createDataFrame(items, "item_id long, text string"), most=most))
    windows = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        k = min(13, len(w))
        for a in range(len(w) - k + 1) if k else ():
            windows.setdefault(tuple(w[a : a + k]), set()).add(i)
    for r in found.collect():
        w = WORD.findall(lower(texts[r.id]))
        hit, ids = set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if owners := windows.get(tuple(w[a : a + k])):
                    hit.update(range(a, a + k))
                    ids |= owners
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(ids))


def test_url_filter(spark):
    rows = [(1, "http://a.example.org/es/1", ""), (2, "https://b.net/x", '<link rel="canonical" href="http://a.example.org/es/1">'), (3, "http://www.b.net/x/?utm_source=f#t", None), (4, None, None), (5, "no", ""), (6, "http://c.net/", '<meta http-equiv="refresh" content="0; url=https://org/">'), (7, "http://org/", ""), (8, "http://d.com/de/1", '<link rel=canonical href="http://c.net">')]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("example.org/es/", "block"), 2: (None, "block"), 3: (None, "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: ("org/", "allow"), 8: ("com/de/", "block")}


def test_suffix_tree_base(docs, texts):
    import math
    import zlib
    from collections import Counter

    tokens = [[*(t or "").encode().lower().split(), None] for t in texts]
    count = Counter(x for i, w in enumerate(tokens) if zlib.crc32(str(i).encode()) % 5 != 1 for x in w)
    total = sum(count.values())
    for r in suffix_tree.score_texts(docs).collect():
        want = sum(math.log10((count[x] + 0.5) / (total + 0.5 * (len(count) + 1))) for x in tokens[r.doc_id])
        assert abs(r.base_score - want) < 1e-6 * max(1, abs(want))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens[r.doc_id]), sum(x in count for x in tokens[r.doc_id]), total)


def test_license_scan(docs, texts):
    for r in license_scan.scan_licenses(docs).collect():
        w = WORD.findall(lower(texts[r.doc_id]))
        at = [(k, label) for phrase, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and 0 <= r.score <= 1
    assert len(license_scan.build_rules()) > 300


def test_toxicity_and_mixing(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["red", "green", "cloud", "hill"], k=20)) + (" idiot scum" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows[:200]], "doc_id long, quality int, toxic int")
    model = toxicity.fit_severity(docs, toxicity.label_grades(labels))
    got = {r.doc_id: r.toxic for r in toxicity.score_severity(docs, model).collect()}
    assert all(got[i] == bool(x) for i, _, x in rows)
    assert toxicity.drop_toxic(docs, model).count() == 240
    mixed, fit = mixing.mix_to_targets(docs, mixing.label_domains(labels), {"good": 0.7, "toxic": 0.3})
    start = np.array(mixed.selectExpr("sum(n_tokens * posterior[0])", "sum(n_tokens * posterior[1])").first())
    assert np.abs(fit.totals - fit.targets).max() < np.abs(start - fit.targets).max()  # 30 % toxic is out of reach of nonnegative rates so soft
    assert min(r.rate for r in mixed.collect()) >= 0


def test_rates_reach_their_targets(spark):
    """Posteriors that hardly differ, and a small domain: targets in reach are met, others as nearly as by brute force."""
    rng = np.random.default_rng(4)
    first, second = 0.15 + 0.1 * rng.random(3000), 0.05 + 0.02 * rng.random(3000)
    posterior = np.stack([first, second, 1 - first - second], axis=1)
    tokens = rng.integers(1, 400, 3000)
    members = spark.createDataFrame([(int(n), p.tolist()) for n, p in zip(tokens, posterior, strict=True)], "n_tokens long, posterior array<double>").coalesce(1).cache()
    names = ["a", "b", "c"]
    fit = mixing.fit_rates(members, names, {"a": 0.235, "b": 0.052, "c": 0.713})
    got = np.array([r[0] for r in members.select(fit.rate(members.posterior)).collect()])
    assert got.min() >= 0 and np.allclose((tokens * got) @ posterior, fit.totals)
    assert np.abs(fit.totals - fit.targets).max() <= 1e-4 * tokens.sum()
    fit = mixing.fit_rates(members, names, {"a": 0.5, "b": 0.2, "c": 0.3}, 1.0, 0.5, 2.0)
    rate, w = np.ones(3000), tokens / tokens.sum()
    for _ in range(60000):
        rate = np.clip(rate - posterior @ ((w * rate) @ posterior - fit.targets / tokens.sum()), 0.5, 2)
    error = lambda totals: np.linalg.norm(totals - fit.targets) / tokens.sum()
    assert 0.01 < error(fit.totals) <= error((tokens * rate) @ posterior) + 1e-4


def test_empty_tables(spark, empty):
    assert ngram_join.ngram_jaccard_classes(empty).count() == 0
    assert token_files.token_file_digest(empty, P.path("word_bpe_49k.json")).count() == 0
    assert suffix_tree.score_texts(empty).count() == 0
    assert decontaminate.contaminated_spans(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("splits", [1, 3])
def test_regions_of_a_frequent_key(spark, kind, splits, monkeypatch):
    """No document of a frequent key is lost, whatever the splits that it was found frequent in."""
    from provgraph.llm.shared import Stage

    n = 3 * ngram_join.HOT
    monkeypatch.setattr(ngram_join, "BUCKET", n // splits)
    name = (lambda k: k) if kind == "long" else (lambda k: f"{k:05}")
    rows = [(name(k), [7, 1000 + k // 2]) for k in range(n)]
    tried = spark.createDataFrame(rows, f"id {kind}, keys array<long>").repartition(splits)
    got = {(r.id, r.pivot) for r in ngram_join._regions(Stage(spark, "frequent"), tried, "found", kind).collect()}
    assert got == {(name(k), name(0)) for k in range(1, n)} | {(name(k + 1), name(k)) for k in range(0, n, 2)}


def test_word_encoder_on_odd_letters():
    """Every class of letter, unassigned ones and control bytes too, against the library on whole texts."""
    draw = np.random.default_rng(3)
    odd = np.concatenate([np.arange(1, 384), np.arange(1, 0x3000, 7), np.arange(0x1F300, 0x1F700, 5), np.full(800, 32), np.full(800, 39), np.full(800, 115)])
    texts = ["".join(map(chr, draw.choice(odd, 60))) for _ in range(1500)]
    texts += ["we'll \x1cx", "İ ŉ ſ Σίσυφος ΟΔΟΣ", "x́y", "x <|endoftext|>yes", "sL₏ ֌s", ""]
    encoder = token_files.WordEncoder(P.path("word_bpe_49k.json"), 400)
    made = encoder.encode(texts)
    want = encoder.library.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, dtype="<u2").tolist() for x in made] == [e.ids for e in want]


def test_suffix_tree_hands_counts_over_in_small_batches(monkeypatch):
    """Counts come in bounded batches without what a context's entry has already; names follow from that entry."""
    import pyarrow as pa

    monkeypatch.setattr(suffix_tree, "HANDED", 7, raising=False)
    rng = random.Random(2)
    made = [" ".join(rng.choices("abcde", k=rng.randint(0, 30))) for _ in range(40)] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(made)})
    every = type("Map", (), {"value": np.full(1 << (suffix_tree.MAP_BITS - 3), 255, dtype=np.uint8)})()
    h = lambda w: int(suffix_tree.tokens(np.frombuffer(w.encode(), dtype=np.uint8), np.array([0, len(w)]))[0][0])
    join = lambda x, y: int(suffix_tree.joined(np.array([x], dtype=np.uint64), np.array([y], dtype=np.uint64))[0])
    key = lambda words: words[0] if len(words) == 1 else join(key(words[:-1]), words[-1])
    for depth in (1, 2, 3):
        out = list(suffix_tree._followed(depth, every, every)(iter([batch])))
        assert max(b.num_rows for b in out) <= 7 and all(b.schema.names == ["context", "token", "n"] for b in out)
        want, parts = {}, {}
        for t in made:
            w = [*map(h, (t or "").split()), 1]
            for i in range(depth, len(w)):
                words = w[i - depth : i]
                want[key(words), w[i]] = want.get((key(words), w[i]), 0) + 1
                parts[key(words)] = words
        u = lambda x: x % 2**64
        got = {(u(r["context"]), u(r["token"])): r["n"] for b in out for r in b.to_pylist()}
        assert got == want
        signed = lambda x: np.array([x], dtype=np.uint64).view(np.int64)
        for (context, token), n in list(want.items())[:20]:
            words = parts[context]
            behind = key(words[1:-1]) if depth > 2 else 0
            row = pa.RecordBatch.from_pydict({c: pa.array(signed(v)) for c, v in {"context": context, "token": token, "ended": words[-1], "behind": behind}.items()} | {"n": pa.array([n]), "total": pa.array([n])})
            r = next(suffix_tree._named(depth)(iter([row]))).to_pylist()[0]
            assert (u(r["key"]), u(r["last"]), u(r["suffix"]), r["depth"]) == (join(context, token), words[-1], key(words[1:]) if depth > 1 else 0, depth)
