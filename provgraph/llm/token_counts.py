"""Token counts of a byte-level BPE vocabulary, by rank-synchronous merging of ragged numpy arrays.

A text is cut at special strings, then into chunks at which the vocabulary's own pre-tokenizer never
joins; a chunk's count is computed once and kept in a bounded table. Chunks not seen yet are cut into
pre-tokens, all pre-tokens of a batch are laid end to end as one array of symbols, and in each round
every pre-token merges all places of its own lowest-rank pair at once, until none has a pair left.
What survives are its tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.llm.words import slices, texts

#: White space as the vocabulary's pre-tokenizer has it (Unicode's property; Python's has four more).
_SPACE = r"\t-\r \x85\xa0  -     　"
_CHUNK = regex.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
# The pre-tokenizer pattern of this kind of vocabulary.
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Chunks kept with their counts; beyond it the table is emptied.
KEPT = 300_000
#: Pre-tokens looked at together in one long text.
STEP = 200_000


def byte_characters() -> list[str]:
    """The character by which a byte-level vocabulary writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class RankMerger:
    """Merges of a vocabulary file, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = [t["content"] for t in model["added_tokens"] if t["special"]]
        vocabulary = model["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        first = np.array([vocabulary[a] for a, _ in pairs], dtype=np.int64)
        second = np.array([vocabulary[b] for _, b in pairs], dtype=np.int64)
        whole = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        keys = first << 32 | second
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.whole = keys[order], order, whole[order]
        self.bytes = np.array([vocabulary[c] for c in byte_characters()], dtype=np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair its place in the sorted merges, or -1."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The surviving symbols of all pieces end to end, and the number of them in each piece."""
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        symbols = self.bytes[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), size)
        done_symbols, done_owner = [], []
        never = len(self.rank)
        while len(symbols):
            place = np.full(len(symbols), -1, dtype=np.int64)
            inside = owner[1:] == owner[:-1]
            place[:-1][inside] = self.lookup(symbols[:-1][inside], symbols[1:][inside])
            rank = np.where(place >= 0, self.rank[place], never)
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, begin)
            length = np.diff(np.append(begin, len(symbols)))
            alive = np.repeat(lowest < never, length)
            if not alive.all():
                done_symbols.append(symbols[~alive])
                done_owner.append(owner[~alive])
            take = alive & (rank == np.repeat(lowest, length))
            # of overlapping places of one pair (as in aaa) the first, third and so on are merged
            run = np.flatnonzero(take & ~np.append(False, take[:-1]))
            at = np.flatnonzero(take)
            if len(at):
                start = run[np.searchsorted(run, at, side="right") - 1]
                at = at[(at - start) % 2 == 0]
                symbols[at] = self.whole[place[at]]
                gone = np.zeros(len(symbols), dtype=bool)
                gone[at + 1] = True
                alive &= ~gone
            symbols, owner = symbols[alive], owner[alive]
        flat = np.concatenate(done_symbols) if done_symbols else symbols
        by = np.concatenate(done_owner) if done_owner else owner
        return flat[np.argsort(by, kind="stable")], np.bincount(by, minlength=len(pieces))


class TokenCounter:
    """Counts tokens of texts; ``kept`` bounds its table of chunks."""

    def __init__(self, path: str, kept: int = KEPT):
        self.merger, self.kept = RankMerger(path), kept
        self.chunks: dict[str, int] = {}
        self.cut = regex.compile("|".join(map(regex.escape, self.merger.special))) if self.merger.special else None

    def learn(self, missing: set[str]) -> None:
        chunks = list(missing)
        pieces = [[p.encode() for p in _PIECE.findall(c)] for c in chunks]
        each = sorted({p for ps in pieces for p in ps})
        counts = dict(zip(each, self.merger.merge(each)[1].tolist(), strict=True)) if each else {}
        self.chunks.update((c, sum(map(counts.__getitem__, ps))) for c, ps in zip(chunks, pieces, strict=True))

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings, a stretch of chunks at a time."""
        total, chunks = 0, None
        if len(text) < 2 * STEP:
            return self.sum(_CHUNK.findall(text))
        chunks = (m.group() for m in _CHUNK.finditer(text))
        while part := list(islice(chunks, STEP)):
            total += self.sum(part)
        return total

    def sum(self, chunks: list[str]) -> int:
        try:
            return sum(map(self.chunks.__getitem__, chunks))
        except KeyError:
            if len(self.chunks) > self.kept:
                self.chunks.clear()
            self.learn(set(chunks).difference(self.chunks))
            return sum(map(self.chunks.__getitem__, chunks))

    def has_special(self, text: str) -> bool:
        return self.cut is not None and self.cut.search(text) is not None

    def count(self, text: str) -> int:
        if not self.has_special(text):
            return self.plain(text)
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


_counters: dict[tuple[str, int], TokenCounter] = {}


def counter_of(path: str, kept: int) -> TokenCounter:
    """This process's counter: workers that run several tasks keep what they have learnt."""
    if (path, kept) not in _counters:
        _counters[path, kept] = TokenCounter(path, kept)
    return _counters[path, kept]


def _count(path: str, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path, kept)
        for batch, _, offsets in slices(batches, "text", 1 << 20):
            held = texts(batch, "text")
            got, new = [-1] * len(held), []
            for k, text in enumerate(held):
                if counter.has_special(text) or len(text) >= 2 * STEP:
                    got[k] = counter.count(text)
                    continue
                chunks = _CHUNK.findall(text)
                try:
                    got[k] = sum(map(counter.chunks.__getitem__, chunks))
                except KeyError:
                    new.append((k, chunks))
            if new:
                if len(counter.chunks) > kept:
                    counter.chunks.clear()
                counter.learn({c for _, chunks in new for c in chunks}.difference(counter.chunks))
                for k, chunks in new:
                    got[k] = sum(map(counter.chunks.__getitem__, chunks))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(offsets[1:] - offsets[:-1], pa.int64()), pa.array(got, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", kept: int = KEPT) -> DataFrame:
    """(id, n_bytes, n_tokens) of every whole text, as the vocabulary's own library counts them.

    ``vocabulary``: a byte-level BPE file in JSON, at the same path on every executor. Special strings
    inside a text are one token each, the library's default; nothing is added, cut off or padded.
    Null and empty texts have 0 tokens. Repeated rows and null ids stay; other columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_count(vocabulary, kept), f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)
