"""Benchmark decontamination with an FM-index for each training shard.

A shard is a stretch of whole documents. Its text is the sequence of their words as numbers, where
only runs of words that could be part of a benchmark phrase are kept, each run ended by a separator of
its own: two neighbours stay together only if some phrase has them as neighbours, so no occurrence is
lost. The shard's suffixes are sorted, its Burrows-Wheeler transform is stored as a wavelet matrix, and
all phrases are searched backward together through ranks in it. Occurrences are located by walking
back to the next sampled suffix position, and their spans are merged to spans of document words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.llm.shared import Stage
from provgraph.llm.words import ALNUM, HashIndex, U, column_bytes, hashes, slices, spans

#: Words in a phrase.
WIDTH = 13
#: Text bytes in a shard, more only for one longer document.
SHARD = 8 << 20
#: Every so many text positions a suffix position is kept.
SAMPLE = 8
#: Bytes of benchmark text that are sent to the executors at once; more goes in several passes.
BENCHMARK_BYTES = 16 << 20


class WaveletMatrix:
    """Ranks in a sequence of small numbers: one row of prefix counts for each bit."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.ones, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (values >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(values) - int(bit.sum()))
            values = values[np.argsort(bit, kind="stable")]
        begin = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1]) if len(values) else np.zeros(0, dtype=np.int64)
        self.begin = np.full(1 << self.bits, -1, dtype=np.int64)  # where a value's stretch begins in the last row
        self.begin[values[begin]] = begin

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        for k in range(self.bits):
            ones = self.ones[k][at]
            at = np.where((symbol >> (self.bits - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return np.maximum(at - self.begin[symbol], 0) * (self.begin[symbol] >= 0)


class FMIndex:
    """Backward search and located occurrences of phrases in one sequence of words.

    ``text``: numbers from 1 up, 0 between runs and at the end. Separators sort before all words and by
    position, so every suffix has one place and none is compared beyond its run.
    """

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        n = len(text)
        gaps = text == 0
        order = np.where(gaps, np.cumsum(gaps) - 1, text + int(gaps.sum()))
        step = 1
        rank = np.unique(order, return_inverse=True)[1].astype(np.int64)
        while True:
            after = np.zeros(n, dtype=np.int64)
            after[:-step] = rank[step:] + 1
            key = rank * (n + 1) + after
            suffixes = np.argsort(key, kind="stable")
            fresh = np.concatenate([[0], np.cumsum(key[suffixes][1:] != key[suffixes][:-1])])
            rank = np.empty(n, dtype=np.int64)
            rank[suffixes] = fresh
            if fresh[-1] == n - 1:
                break
            step *= 2
        last = text[suffixes - 1]  # the word before each suffix; of the first one, the last separator
        self.n, self.last, self.tree = n, last, WaveletMatrix(last)
        self.count = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max(initial=0)) + 1))])
        kept = (suffixes % sample == 0) | (last == 0)
        self.kept = kept
        self.kept_before = np.cumsum(kept) - kept
        self.positions = suffixes[kept]

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each phrase (a row, its words first) the range of suffixes that begin with it."""
        low, high = np.zeros(len(sizes), dtype=np.int64), np.full(len(sizes), self.n, dtype=np.int64)
        for k in range(int(sizes.max(initial=0))):
            live = np.flatnonzero((sizes > k) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, sizes[live] - 1 - k]
            known = symbol < len(self.count) - 1
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]]))
            low[live] = self.count[symbol] + both[: len(live)]
            high[live] = self.count[symbol] + both[len(live) :]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each suffix row."""
        out, steps, row = np.empty(len(rows), dtype=np.int64), 0, rows.copy()
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.kept[row]
            out[open_[done]] = self.positions[self.kept_before[row[done]]] + steps
            open_, row = open_[~done], row[~done]
            symbol = self.last[row]
            row = self.count[symbol] + self.tree.rank(symbol, row)
            steps += 1
        return out


class Phrases:
    """The distinct phrases of a bounded block of benchmark items, as rows of word numbers."""

    def __init__(self, ids: list, texts: pa.Array, width: int):
        data, offsets = column_bytes(texts)
        starts, ends, first = spans(data, offsets, ALNUM)
        words = hashes(data, starts, ends)
        self.vocabulary = np.unique(words)
        number = np.searchsorted(self.vocabulary, words) + 1
        rows, sizes, owner = [], [], []
        for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            size = min(width, b - a)
            for at in range(a, b - size + 1) if size else ():
                rows.append(np.pad(number[at : at + size], (0, width - size)))
                sizes.append(size)
                owner.append(k)
        self.ids, self.width = ids, width
        every = np.array(rows, dtype=np.int64).reshape(-1, width)
        self.rows, which = np.unique(every, axis=0, return_inverse=True) if len(every) else (every, np.zeros(0, dtype=np.int64))
        self.sizes = (self.rows > 0).sum(axis=1)
        order = np.argsort(which.ravel(), kind="stable")
        self.owner = np.array(owner, dtype=np.int64)[order]
        self.owner_at = np.searchsorted(which.ravel()[order], np.arange(len(self.rows) + 1))
        size = U(len(self.vocabulary) + 1)
        near = [self.rows[:, k].astype(U) * size + self.rows[:, k + 1].astype(U) for k in range(width - 1)]
        ok = [self.rows[:, k + 1] > 0 for k in range(width - 1)]
        self.neighbours = np.unique(np.concatenate([x[m] for x, m in zip(near, ok, strict=True)])) if len(self.rows) and width > 1 else np.zeros(0, dtype=U)
        self.least = int(self.sizes.min(initial=width))
        self.singles = self.rows[self.sizes == 1, 0]

    def open(self) -> None:
        self.words = HashIndex(self.vocabulary)
        spread = self.neighbours * U(0x9E3779B97F4A7C15)
        order = np.argsort(spread)
        self.pairs = HashIndex(spread[order])

    def runs(self, number: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kept words of a shard with separators, and each one's place among the shard's words (-1)."""
        n = len(number)
        joined = np.zeros(n, dtype=bool)  # this word and the next
        if n > 1:
            at = np.flatnonzero((number[:-1] > 0) & (number[1:] > 0))
            pair = (number[at].astype(U) * U(len(self.vocabulary) + 1) + number[at + 1].astype(U)) * U(0x9E3779B97F4A7C15)
            joined[at] = self.pairs.find(pair) >= 0
            joined[first[1:-1][first[1:-1] > 0] - 1] = False
        begin = np.flatnonzero((number > 0) & ~np.append(False, joined[:-1]))
        end = np.flatnonzero((number > 0) & ~joined) + 1
        long = end - begin >= max(2, self.least)
        if len(self.singles):
            long |= (end - begin >= self.least) & (np.isin(number[begin], self.singles) | (end - begin > 1))
        begin, end = begin[long], end[long]
        size = end - begin + 1
        place = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
        gap = np.zeros(len(place), dtype=bool)
        gap[np.cumsum(size) - 1] = True
        return np.where(gap, 0, number[np.minimum(place, n - 1)]), np.where(gap, -1, place)

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[int]]]:
        """For each text of a shard: number of words, merged spans of hit words, items found in it."""
        starts, ends, first = spans(data, offsets, ALNUM)
        m = len(offsets) - 1
        hit_spans, items = [[] for _ in range(m)], [[] for _ in range(m)]
        if not len(self.rows) or not len(starts):
            return np.diff(first), hit_spans, items
        text, place = self.runs(self.words.find(hashes(data, starts, ends)) + 1, first)
        if len(text):
            index = FMIndex(text)
            low, high = index.search(self.rows, self.sizes)
            found = high - low
            which = np.repeat(np.arange(len(low)), found)
            at = index.locate(np.repeat(low - np.concatenate([[0], np.cumsum(found)[:-1]]), found) + np.arange(int(found.sum())))
            word = place[at]
            edge = np.zeros(len(starts) + 1, dtype=np.int64)
            np.add.at(edge, word, 1)
            np.add.at(edge, word + self.sizes[which], -1)
            hit = np.cumsum(edge[:-1]) > 0
            inner = hit[1:] & hit[:-1]
            cut = first[1:-1]
            cut = cut[(cut > 0) & (cut < len(hit))]
            inner[cut - 1] = False
            a, b = np.flatnonzero(hit & ~np.append(False, inner)), np.flatnonzero(hit & ~np.append(inner, False)) + 1
            doc = np.searchsorted(first, a, side="right") - 1
            for d, x, y in zip(doc.tolist(), (a - first[doc]).tolist(), (b - first[doc]).tolist(), strict=True):
                hit_spans[d].append((x, y))
            owners = self.owner_at[which + 1] - self.owner_at[which]
            item = self.owner[np.repeat(self.owner_at[which] - np.concatenate([[0], np.cumsum(owners)[:-1]]), owners) + np.arange(int(owners.sum()))]
            pairs = np.unique(np.stack([np.repeat(np.searchsorted(first, word, side="right") - 1, owners), item]), axis=1)
            for d, i in pairs.T.tolist():
                items[d].append(i)
        return np.diff(first), hit_spans, items


def _scan(phrases: Phrases, id_kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases.open()
        for batch, data, offsets in slices(batches, "text", SHARD):
            n_words, hit, items = phrases.scan(data, offsets)
            span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
            made = [pa.array(n_words, pa.int64()), pa.array([[{"begin": a, "end": b} for a, b in x] for x in hit], pa.list_(span)), pa.array([sorted({str(phrases.ids[i]) for i in x}) for x in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["id", "n_words", "spans", "items"])

    return run


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most: int = BENCHMARK_BYTES) -> DataFrame:
    """(id, n_words, spans, items): the words of each document that are in a phrase of a benchmark item.

    A phrase: ``width`` consecutive words of an item, or all of an item that has fewer (but some).
    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, A-Z as lower case. ``spans``: begin and end
    (exclusive) in words, merged, in order; ``items``: the ids, as strings, of items found.

    The items are sent to the executors if they have at most ``most`` bytes; otherwise in several
    passes over the documents, each with a block of items within that bound (one item is a block of
    its own at least), each written before the next begins, whose spans are then merged. An item counts
    once, however many rows have its id; the phrases of all of them are its phrases. Null and empty texts
    have no words; null items are ignored; repeated documents are judged each; an empty benchmark hits
    nothing, and an empty table of documents gives no rows. Texts of any length are searched whole. Other
    columns are left out, whatever their names.

    What is indexed: of a shard's words those in runs whose neighbours are neighbours in some phrase. No
    phrase occurs elsewhere, so results are those of an index of all words, at a small part of its cost.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    form = f"id {kind}, n_words long, spans array<struct<begin:long,end:long>>, items array<string>"
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null and item is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= most:
        table = items.toArrow()
        return rows.mapInArrow(_scan(Phrases(table.column("item").to_pylist(), table.column("text"), width), kind), form)
    passes = -(-2 * size // most)
    stage = Stage(spark, "decontaminate")
    numbered = stage.put(rows.select(F.monotonically_increasing_id(), "id", "text").toDF("id", "own", "text"), "rows")
    found = None
    for k in range(passes):
        table = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k).toArrow()
        part = numbered.select("id", "text").mapInArrow(_scan(Phrases(table.column("item").to_pylist(), table.column("text"), width), "bigint"), form.replace(f"id {kind}", "id bigint"))
        part = stage.put(part, f"pass{k}")
        found = part if found is None else found.unionByName(part)
    order = F.array_sort(F.flatten(F.collect_list("spans")))
    start = F.expr("cast(array() as array<struct<begin:bigint,end:bigint>>)")

    def merged(out, x):
        last = F.element_at(out, -1)
        meets = (F.size(out) > 0) & (F.get(out, F.size(out) - 1)["end"] >= x["begin"])
        longer = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(last["begin"].alias("begin"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when(meets, longer).otherwise(F.concat(out, F.array(x)))

    each = found.groupBy("id").agg(F.max("n_words").alias("n_words"), F.aggregate(order, start, merged).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return numbered.select("id", "own").join(each, "id").select(F.col("own").alias("id"), "n_words", "spans", "items")


def judged(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and ``contaminated`` (at least a twentieth of the words hit)."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    out = found.select("id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), "spans")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged; rows without an id stay."""
    bad = judged(contaminated_spans(docs, benchmark, width, id_col, text_col)).where("contaminated").select(F.col("id").alias(id_col)).distinct()
    return docs.join(bad, id_col, "left_anti").select(*docs.columns)


def op8(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return judged(contaminated_spans(docs, benchmark)).drop("spans").withColumnRenamed("id", "doc_id")


ORACLE_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
phrase AS (
  SELECT item_id, size, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS words
  FROM (SELECT item_id, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS pos FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM phrase),
place AS (
  SELECT doc_id, size, pos, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS words
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM doc CROSS JOIN sizes WHERE len(w) >= size)),
found AS (SELECT DISTINCT doc_id, item_id, size, pos FROM place JOIN phrase USING (size, words)),
hits AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS word FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
