"""Odd tables for all operators, and what the other tests leave open, against brute force."""

import hashlib
import math
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from provgraph.llm import decontaminate, gif, license_scan, mixing, ngram_join, suffix_tree, token_counts, token_files, toxicity, url_filter

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

# columns beside the contract's, under names that operators use inside
CLASH = "doc_id long, text string, lang string, source string, n_chars long, id string, keys string, row string, rate string, grade string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LABELS = "doc_id long, quality int, toxic int"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", "x", "x", "x", "x") for i, t in texts], CLASH)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(9)
    words = ["Stone", "river", "über", "gpl", "cc", "by", "idiot", "x1", "the", "of"]
    texts = [(k, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for k in range(40)]
    texts += [(40, None), (41, ""), (42, "  \t"), (None, "no id at all"), (3, texts[3][1]), (3, texts[3][1]), (43, " ".join(rng.choices(words, k=20_000))), (44, "<|endoftext|> special </s>")]
    return texts


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, int(k % 5 == 0)) for k in range(30)] + [(None, 1, 1), (5, None, None)], LABELS)


def all_ten(spark, docs, labels, benchmark, pages):
    return {
        1: ngram_join.ngram_jaccard_classes(docs, width=4, num=85), 2: gif.gif_features(gif.store_texts(docs)), 3: token_counts.count_tokens(docs, P.path("byte_bpe_50k.json")),
        4: toxicity.score_severity(docs, toxicity.fit_severity(docs, toxicity.label_grades(labels))), 5: url_filter.judge_urls(pages), 6: token_files.token_file_digest(docs, P.path("word_bpe_49k.json")),
        7: suffix_tree.score_texts(docs), 8: decontaminate.judged(decontaminate.contaminated_spans(docs, benchmark)), 9: license_scan.scan_licenses(docs), 10: mixing.mix_to_targets(docs, mixing.label_domains(labels), mixing.WEIGHTS)[0],
    }


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for k, df in all_ten(spark, table(spark, []), spark.createDataFrame([], LABELS), spark.createDataFrame([], "item_id long, text string"), pages).items():
        assert df.count() == 0, k


def test_odd_rows_stay(spark, odd, labels):
    pages = spark.createDataFrame([(1, None, None, "x"), (1, "http://a/", "", "x"), (None, "http://a/", "<html>" + "a" * 100_000, "x")], "page_id long, url string, html string, host string")
    docs = table(spark, odd)
    for k, df in all_ten(spark, docs, labels, spark.createDataFrame([(1, "stone river"), (1, None), (None, "x")], "item_id long, text string"), pages).items():
        assert df.count() == (3 if k == 5 else len(odd)), k


def test_without_labels(spark, odd):
    docs, none = table(spark, odd[:5]), spark.createDataFrame([], LABELS)
    mixed, fit = mixing.mix_to_targets(docs, mixing.label_domains(none), mixing.WEIGHTS, low=0.0)
    assert [(r.rate, r.posterior, r.domain) for r in mixed.collect()] == [(1.0, [], None)] * 5 and not fit.domains
    assert mixing.repeat_by_rate(docs, mixing.label_domains(none), mixing.WEIGHTS, 1.25, 1.0, 4.0).count() == 5
    model = toxicity.fit_severity(docs, toxicity.label_grades(none))
    assert {(r.severity, r.toxic) for r in toxicity.score_severity(docs, model).collect()} == {(0.0, False)} and toxicity.drop_toxic(docs, model).count() == 5


def test_media_columns(spark, odd):
    want = {}
    for i, t in odd:
        raw = (t or "").encode()
        held = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        want.setdefault(i, []).append((len(raw), len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-16:])))
    rows = gif.gif_features(gif.store_texts(table(spark, odd))).collect()
    got = {}
    for r in rows:
        got.setdefault(r.id, []).append((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32))
        assert r.error is None and abs(sum(r.red) - 1) < 1e-4
    assert got == want
    large = b"GIF89a" + b"\xff\xff\xff\xff" + b"\x00\x00\x00;"
    assert gif.gif_features(spark.createDataFrame([(1, 1, bytearray(large)), (2, 1, None)], "id long, n_bytes long, media binary")).where("error = 'screen too large'").count() == 1


def test_gif_interlace_local_palette_and_disposal():
    stream = lambda b: b"\x08" + gif._blocks(gif.lzw_encode(b))
    rows = bytes(range(16))
    order = [*range(0, 16, 8), *range(4, 16, 8), *range(2, 16, 4), *range(1, 16, 2)]
    local = bytes(x for g in range(256) for x in (255 - g, g, 0))
    frame = lambda w, h, flags, body, control: b"!\xf9\x04" + control + b"\0," + bytes([0, 0, 0, 0, w, 0, h, 0, flags]) + body
    media = b"GIF89a\1\0\x10\0\xf7\0\0" + gif.GREY + frame(1, 16, 0x40, stream(bytes(order)), bytes([3 << 2, 1, 0, 0])) + frame(1, 16, 0x87, local + stream(rows), bytes([0, 2, 0, 0])) + b";"
    first, second = [(f.screen[:, 0].tolist(), f.milliseconds) for f in gif.decode(media)]
    assert [x[0] for x in first[0]] == list(range(16)) and first[1] == 10
    assert [x[:2] for x in second[0]] == [[255 - k, k] for k in range(16)] and second[1] == 20


def test_token_columns(spark, odd, tmp_path):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    table(spark, odd).write.parquet(str(tmp_path / "documents.parquet"))
    for r in token_counts.op3(spark, str(tmp_path)).where("doc_id is not null").collect():
        text = dict(odd)[r.doc_id] or ""
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024)
    w = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    unique = [(i, x) for i, x in odd if i is not None and i != 3]
    got = {r.doc_id: r.ids_crc32 for r in token_files.token_file_digest(table(spark, unique), P.path("word_bpe_49k.json")).collect()}
    assert got == {i: zlib.crc32(np.array([*w.encode(x or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()) for i, x in unique}


def test_severity_by_hand(spark):
    """Probabilities fall with the threshold, severity is their sum, and the fit is near the best by plain ascent."""
    rng = np.random.default_rng(6)
    rows = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(400)]
    true = np.array([1.5, -1.0, 0.5, 0.0, 2.0, -0.5])
    score = np.array([true[r].sum() for r in rows])
    grades = (score[:, None] + rng.logistic(size=(400, 1)) > np.array([0.5, 2.0])).sum(axis=1)

    def loss(w, t):
        s = np.array([w[r].sum() for r in rows])
        above = np.concatenate([np.ones((400, 1)), 1 / (1 + np.exp(t[None, :] - s[:, None])), np.zeros((400, 1))], axis=1)
        return -np.log(above[np.arange(400), grades] - above[np.arange(400), grades + 1]).sum() + (w**2).sum() / 2

    w, t = toxicity.fit_ordinal(rows, grades, 6)
    best = loss(w, t)
    assert t[0] < t[1] and np.corrcoef(w, true)[0, 1] > 0.9
    for _ in range(300):
        assert loss(w + rng.normal(scale=0.05, size=6), np.sort(t + rng.normal(scale=0.05, size=2))) > best - 0.05
    model = toxicity.Severity(np.zeros(1 << toxicity.BITS), np.array([0.5, 2.0]))
    above = model.above(np.array([-1.0, 0.5, 3.0]))
    assert (np.diff(above, axis=1) < 0).all() and abs(above[1, 0] - 0.5) < 1e-12


def test_repeated_items_count_once(spark):
    docs = table(spark, [(1, "one two three"), (2, "four")])
    items = spark.createDataFrame([(7, "one two"), (7, "one two"), (7, "three"), (8, "one two")], "item_id long, text string")
    for most in (1 << 24, 5):
        got = {r.id: (r.n_items, r.items_sha256, r.n_hit, r.contaminated) for r in decontaminate.judged(decontaminate.contaminated_spans(docs, items, most=most)).collect()}
        assert got == {1: (2, hashlib.sha256(b"7,8").hexdigest(), 3, True), 2: (0, hashlib.sha256(b"").hexdigest(), 0, False)}


def test_licence_detections_against_plain_suppression(spark):
    rules = license_scan.build_rules()
    assert len(license_scan.SIGNATURES) + len(license_scan.NOTICES) > 150
    for r in rules:
        assert r.keywords
    rng = random.Random(2)
    every = [license_scan.Detection(a, a + rng.randint(1, 9), rng.choice(rules)) for a in rng.choices(range(60), k=400)]
    kept = []
    for d in sorted(every, key=lambda d: (-d.rule.priority, d.begin - d.end, d.begin, -d.rule.weight, d.rule.label)):
        if not any(o.begin <= d.begin and d.end <= o.end for o in kept):
            kept.append(d)
    assert license_scan.outermost(every) == kept
    texts = ["Permission is hereby granted, free of charge, to deal in the Software without restriction", "licensed under the MIT license", "GPL-2.0-or-later WITH Classpath-exception", "Redistributions of source code must retain the above copyright notice", "plain words", "gpl x " * 3000]
    got = {r.doc_id: (set(r.labels.split(",")), r.score) for r in license_scan.scan_licenses(table(spark, list(enumerate(texts)))).collect()}
    assert {"mit", "permissive"} <= got[0][0] and "mit" in got[1][0] and {"gpl-or-later", "classpath-exception"} <= got[2][0] and "bsd" in got[3][0] and got[4] == ({""}, 0.0) and "gpl" in got[5][0]
    for n, (found, score) in got.items():  # the plain way: every rule on every text
        form = " ".join(WORD.findall(lower(texts[n])))
        assert {d.label for d in rules if d.base and d.pattern.search(form)} <= found and (score > 0) == any(d.pattern.search(form) for d in rules)


def test_relative_links_and_all_tags(spark):
    link = lambda *hrefs: "".join(f'<link rel="canonical" href="{h}">' for h in hrefs)
    rows = [(1, "http://example.org/es/a/b", ""), (2, "http://n.net/x/y", link("z", "../q/", "?id=3")), (3, "http://n.net/x/z", ""), (4, "http://n.net/q", link("mailto:a@b", "//example.org/es/a/b")), (5, "http://n.net/x/y?id=3", ""), (6, "http://n.net/far", "")]
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow"}


def test_mixing_by_hand(spark, odd, labels):
    """Rates are within their bounds and nothing else is nearer to the targets: against plain projected gradients."""
    docs = table(spark, odd)
    mixed, fit = mixing.mix_to_targets(docs, mixing.label_domains(labels), mixing.WEIGHTS, 1.1, 0.5, 2.0)
    rows = mixed.collect()
    n, p, rate = np.array([r.n_tokens for r in rows]), np.array([r.posterior for r in rows]), np.array([r.rate for r in rows])
    assert np.allclose(p.sum(axis=1), 1) and rate.min() >= 0.5 and rate.max() <= 2 and np.allclose((n * rate) @ p, fit.totals)
    x, w = np.ones(len(n)), n / n.sum()
    for _ in range(20000):
        x = np.clip(x - p @ ((w * x) @ p - fit.targets / n.sum()), 0.5, 2)
    error = lambda r: np.linalg.norm((n * r) @ p - fit.targets) / n.sum()
    assert error(rate) <= error(x) + 1e-3


def test_pipeline_on_small_tables(spark, tmp_path, odd):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(200)]
    clean = [" ".join(rng.choices(words, k=60)) for _ in range(60)]
    item = " ".join(rng.choices(words, k=20))
    texts = [(k, t) for k, t in enumerate(clean)] + [(100, clean[0]), (101, clean[1] + " more"), (102, item + " tail"), (103, None), (104, ""), *((200 + k, " ".join([*rng.choices(words, k=20), *["idiot"] * 5, "scum"])) for k in range(30))]
    documents = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, k % 2, 0) for k in range(50)] + [(200 + k, 0, 1) for k in range(30)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    docs, left = documents, {i for i, _ in texts}
    for name, goes in (("toxicity", {200 + k for k in range(30)}), ("near copies", {100, 101}), ("benchmark", {102}), ("mixing", set())):
        stages[name](spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs, left = spark.read.parquet(str(tmp_path / name)), left - goes
        assert docs.columns == documents.columns and ids(docs) == left, name
    assert docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= math.ceil(corpus_pipeline.MOST)
    t, at = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    rows = sorted(stages["token files"](spark, docs, str(tmp_path)).collect())
    assert len(rows) == docs.count()
    for r in rows:
        assert r.n_tokens == len(t.encode(dict(texts)[r.doc_id] or "", add_special_tokens=False).ids) + 1 and r.start == at
        at += r.n_tokens
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def tree_by_hand(train, depth, least, seen):
    """log10 P of a token after a past, from counts of word tuples in Python."""
    from collections import Counter

    unigram, follow = Counter(), Counter()
    for words in train:
        for i, w in enumerate(words):
            unigram[(w,)] += 1
            for d in range(1, depth + 1):
                if i >= d:
                    follow[tuple(words[i - d : i]), w] += 1
    total, below = sum(unigram.values()), sum(unigram.values()) + 0.5 * (len(unigram) + 1)
    base = lambda w: (unigram[(w,)] + 0.5) / below
    times = lambda c: unigram[c] if len(c) == 1 else follow[c[:-1], c[-1]]
    kept = {}

    def chance(context, w):
        for k in range(len(context)):
            if (c := context[k:]) in kept:
                p, rest = kept[c]
                return p[w] if w in p else rest * chance(c[1:], w)
        return base(w)

    for d in range(1, depth + 1):
        found = {}
        for (c, w), n in follow.items():
            if len(c) == d and None not in c and n >= seen and times(c) >= least:
                found.setdefault(c, {})[w] = n
        for c, n in found.items():
            parent = {w: chance(c[1:], w) for w in n}
            share, whole = {w: x / times(c) for w, x in n.items()}, times(c)
            left, left_parent = max(1 - sum(share.values()), 0), max(1 - sum(parent.values()), 1e-12)
            g = sum(share[w] * math.log(share[w] / parent[w]) for w in n) + (left * math.log(left / left_parent) if left > 1e-12 else 0)
            if 2 * whole * g > len(n) + 4 * math.sqrt(2 * len(n)):
                p = {w: (x + suffix_tree.LENT * parent[w]) / (whole + suffix_tree.LENT) for w, x in n.items()}
                kept[c] = (p, max(1 - sum(p.values()), 1e-12) / left_parent)
    return lambda words: sum(math.log10(chance(tuple(words[max(0, i - depth) : i]), w)) for i, w in enumerate(words)), kept, total


@pytest.mark.parametrize(("depth", "entries"), [(3, 10**6), (2, 25)])
def test_suffix_tree_by_hand(spark, depth, entries):
    rng = random.Random(7)
    phrases = [[f"p{k}{j}" for j in range(6)] for k in range(8)]
    texts = []
    for k in range(160):
        words = []
        while len(words) < 40:
            words += rng.choice(phrases) if rng.random() < 0.5 else [f"x{rng.randrange(30)}"]
        texts.append((k, " ".join(words)))
    tokens = {i: [*t.split(), None] for i, t in texts} | {999: [None]}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    score, kept, total = tree_by_hand([w for i, w in tokens.items() if not held(i)], depth, 12, 3)
    assert len(kept) > 20 and max(map(len, kept)) == depth
    rows = suffix_tree.score_texts(table(spark, [*texts, (999, None)]), depth=depth, least=12, seen=3, entries=entries).collect()
    for r in rows:
        want = score(tokens[r.doc_id])
        assert abs(r.score - want) < 1e-5 * max(1, abs(want)) and r.train_tokens == total
    gain = [(r.score - r.base_score) / r.n_tokens for r in rows if r.held_out]
    assert np.mean(gain) > 0.1
