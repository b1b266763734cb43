"""Token-id files: frequency-ranked ids in byte-aligned variable-length code with control bytes apart.

File format: a table of blocks in ascending order of document id. A block holds whole documents:
their ids and token counts, the control bytes and the data bytes. Ids are replaced by their rank of
frequency in the corpus (most frequent 0, ties by id), kept with the file. Four ranks share a control
byte, two bits each: the number of data bytes less one, low bits first; data bytes are little-endian.
Reading takes each control byte's four lengths from a table of 256 rows and gathers all ranks at once.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from provgraph.llm.shared import Stage
from provgraph.llm.words import slices, texts

#: Tokens of a block, more only for a single longer document.
BLOCK = 1 << 18
#: Bytes of text that one partition of the sorted corpus should hold.
PARTITION_BYTES = 24 << 20
#: Pre-tokens kept with their ids, and half as many words; beyond it the later half of a table goes.
KEPT = 1_200_000
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
#: Letters that normalizing only lowers, one for one.
_LATIN = regex.compile(r"[\x00-\x7f\xc0-\u012f\u0131-\u017f]+")
_ODD_SPACE = regex.compile(r"[\x1c-\x1f]")
# The pre-tokenizer pattern of this kind of vocabulary.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r \x85\xa0  -     　\p{L}\p{N}]+")
_SPACES = regex.compile(r"[\t-\r \x85\xa0  -     　]+")

#: The letter by which such vocabularies spell each byte: itself if it is seen in print, else one from 256 on.
_SEEN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SPELT = {b: b if b in _SEEN else 256 + k for b, k in zip(range(256), accumulate((b not in _SEEN for b in range(256)), initial=0))}


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of ranks below 2**32."""
    ranks = np.asarray(ranks, dtype=np.uint32)
    size = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    padded = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    padded[: len(ranks)] = size - 1
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    end = np.cumsum(size, dtype=np.int64)
    begin, out = end - size, np.empty(int(end[-1]) if len(end) else 0, dtype=np.uint8)
    out[begin] = ranks & np.uint32(255)
    for k in range(1, int(size.max(initial=0))):
        more = np.flatnonzero(size > k)
        out[begin[more] + k] = ranks[more] >> np.uint32(8 * k) & np.uint32(255)
    return control.tobytes(), out.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of a pair of streams."""
    size = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    end = np.cumsum(size)
    raw = np.frombuffer(data + b"\0\0\0\0", dtype=np.uint8)
    begin = end - size
    out = raw[begin].astype(np.uint32)
    for k in range(1, int(size.max()) if n else 0):
        more = size > k
        out[more] |= raw[begin[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class WordEncoder:
    """Ids of whole texts from a vocabulary whose tokens never reach across white space.

    Words between white space are kept with their ids. New ones are normalized (by the tokenizers
    library where that does more than lower case) and cut into pre-tokens, and each new pre-token goes,
    byte by byte as the vocabulary spells it, through the library's model. Words with special strings
    or letters that the library's Unicode tables class otherwise are encoded by the library one by one.
    """

    def __init__(self, path: str, kept: int = KEPT):
        self.library, self.kept = Tokenizer.from_file(path), kept
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.asked: set[str] = set()
        self.strange: set[str] = set()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def alone(self, word: str) -> bytes:
        return np.array(self.library.encode(word, add_special_tokens=False).ids, dtype="<u2").tobytes()

    @staticmethod
    def _room(table: dict, most: int) -> dict:
        """The table, or if it is full the half that came first, which has the frequent entries."""
        return dict(islice(table.items(), most // 2)) if len(table) > most else table

    def cut(self, words: list[str]) -> list[list[str] | None] | None:
        """The pre-tokens of words without special strings; None if normalizing moves their bounds.

        None also for a word with letters of which the library has another notion.
        """
        out: list = [None] * len(words)
        other = []
        for k, w in enumerate(words):
            if w.isascii() or _LATIN.fullmatch(w):  # normalizing only lowers it
                w = w.lower()
                if w.isalpha():
                    out[k] = [w]
                elif w[:-1].isalpha() and not w[-1].isalnum():
                    out[k] = [w[:-1], w[-1]]
                else:
                    out[k] = _PIECE.findall(w)
            else:
                other.append(k)
        if other:
            formed = self.library.normalizer.normalize_str(" ".join([words[k] for k in other])).split(" ")
            if len(formed) != len(other):
                return None
            strange = self.strange_of(set("".join(formed)))
            for k, w in zip(other, formed, strict=True):
                out[k] = _PIECE.findall(w) if strange.isdisjoint(w) else None
        return out

    def strange_of(self, letters: set[str]) -> set[str]:
        """Those that the library's Unicode tables put into another class than ours, by asking it once."""
        for c in letters.difference(self.asked):
            ours = [m.end() for m in _PIECE.finditer(f"a{c}{c}")]
            if [e for _, (_, e) in self.library.pre_tokenizer.pre_tokenize_str(f"a{c}{c}")] != ours:
                self.strange.add(c)
            self.asked.add(c)
        return self.strange

    def learn(self, missing: set[str]) -> None:
        self.words, self.pieces = self._room(self.words, self.kept // 2), self._room(self.pieces, self.kept)
        new = list(missing.difference(self.words))
        if not new:
            return
        together = " ".join(new)
        odd = [w for w in new if any(x in w for x in self.special)] if any(x in together for x in self.special) else []
        if odd:
            self.words.update((w, self.alone(w)) for w in odd)
            new = list(set(new).difference(odd))
        cut = self.cut(new)
        if cut is None:
            self.words.update((w, self.alone(w)) for w in new)
            return
        if None in cut:
            self.words.update((w, self.alone(w)) for w, ps in zip(new, cut, strict=True) if ps is None)
            new, cut = zip(*[(w, ps) for w, ps in zip(new, cut, strict=True) if ps is not None], strict=True) if any(cut) else ((), ())
        fresh = {p for ps in cut for p in ps}.difference(self.pieces)
        model = self.library.model.tokenize
        for p in fresh:
            spelt = p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(_SPELT)
            self.pieces[p] = array("H", [t.id for t in model(spelt)]).tobytes()
        self.words.update((w, b"".join(map(self.pieces.__getitem__, ps))) for w, ps in zip(new, cut, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, two bytes each, low first."""
        split = [self.split(x) for x in texts]
        found = [list(map(self.words.get, ws)) for ws in split]
        partly = [k for k, ids in enumerate(found) if None in ids]
        if partly:
            self.learn({w for k in partly for w, ids in zip(split[k], found[k], strict=True) if ids is None})
            for k in partly:
                found[k] = [self.words[w] if ids is None else ids for w, ids in zip(split[k], found[k], strict=True)]
        return list(map(b"".join, found))

    @staticmethod
    def split(text: str) -> list[str]:
        return text.split() if _ODD_SPACE.search(text) is None else [w for w in _SPACES.split(text) if w]


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder_of(path: str, kept: int) -> WordEncoder:
    """This process's encoder: workers that run several tasks keep what they have learnt."""
    if (path, kept) not in _encoders:
        _encoders[path, kept] = WordEncoder(path, kept)
    return _encoders[path, kept]


def _encode(path: str, kept: int, end: int):
    """Blocks of 16-bit ids, each document's end id with it, and where the block begins in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, mark = encoder_of(path, kept), np.array([end], dtype="<u2").tobytes()
        ids, held, sizes, count, before, part = [], [], [], 0, 0, None

        def block() -> pa.RecordBatch:
            made = [pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([count], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([sizes], pa.list_(pa.int64())), pa.array([b"".join(held)], pa.large_binary()).cast(pa.binary())]
            return pa.RecordBatch.from_arrays(made, ["part", "before", "n", "ids", "sizes", "tokens"])

        for batch, _, _ in slices(batches, "text", 1 << 21):
            kind, part = batch.column(0).type, batch.column(2)[0].as_py()
            for i, tokens in zip(batch.column(0).to_pylist(), encoder.encode(texts(batch, "text")), strict=True):
                n = len(tokens) // 2 + 1
                if count and count + n > BLOCK:
                    yield block()
                    before += count
                    ids, held, sizes, count = [], [], [], 0
                ids.append(i)
                held += (tokens, mark)
                sizes.append(n)
                count += n
        if ids:
            yield block()

    return run


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, dtype=np.int64)
    for batch in batches:
        for x in batch.column(0).to_pylist():
            total += np.bincount(np.frombuffer(x, dtype="<u2"), minlength=1 << 16)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["token", "n"])


def _pack(rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = [pack(rank[np.frombuffer(x, dtype="<u2")]) for x in batch.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([c for c, _ in streams], pa.binary()), pa.array([d for _, d in streams], pa.binary())], ["part", "before", "n", "ids", "sizes", "control", "data"])

    return run


def _read(token: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, sizes = batch.column(3)[k].values, np.array(batch.column(4)[k].values, dtype=np.int64)
                tokens = token[unpack(batch.column(5)[k].as_py(), batch.column(6)[k].as_py(), int(batch.column(2)[k].as_py()))].astype("<u4")
                raw, ends = memoryview(tokens.tobytes()), np.cumsum(sizes)
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                begin = batch.column(7)[k].as_py() + batch.column(1)[k].as_py() + ends - sizes
                yield pa.RecordBatch.from_arrays([ids, pa.array(begin, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    return run


_BLOCKS = "part int, before long, n long, ids array<{kind}>, sizes array<long>"


def write_token_files(docs: DataFrame, vocabulary: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text", kept: int = KEPT) -> tuple[DataFrame, DataFrame, Stage]:
    """Write the ids of every whole text, each document ended by ``end``, in ascending order of id.

    Returns the file's blocks (part, before, n, ids, sizes, control, data; reread from where Spark
    wrote them, in the shared folder), the ranks (token, rank) and the stage that holds both. The
    corpus is tokenized once: ids go to a staged table, from which frequencies are counted and the
    ranked code is written. Ranks have one row a vocabulary entry (below 65,536), so they fit a driver.

    Null and empty texts have the end id alone; null document ids come first; rows of one id stand
    together in order of their text. Other columns are left out. No rows give an empty file.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "token-files")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    form = _BLOCKS.format(kind=kind)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, spark.sparkContext.defaultParallelism if size > PARTITION_BYTES else 1, -(-size // PARTITION_BYTES))
    ordered = rows.repartitionByRange(parts, "id").sortWithinPartitions("id", "text").withColumn("part", F.spark_partition_id())
    raw = stage.put(ordered.mapInArrow(_encode(vocabulary, kept, end), f"{form}, tokens binary"), "raw")
    counts = raw.select("tokens").mapInArrow(_histogram, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))
    ranked = [r.token for r in counts.orderBy(F.desc("n"), "token").collect()]
    token = np.array(ranked, dtype=np.uint32)
    rank = np.zeros(1 << 16, dtype=np.uint32)
    rank[token] = np.arange(len(token), dtype=np.uint32)
    blocks = stage.put(raw.mapInArrow(_pack(rank), f"{form}, control binary, data binary"), "blocks")
    stage.drop("raw")
    ranks = stage.put(spark.createDataFrame([(t, k) for k, t in enumerate(ranked)], "token int, rank int").coalesce(1), "ranks")
    return blocks, ranks, stage


def read_token_files(blocks: DataFrame, ranks: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in a file: decoded from its bytes.

    ``start`` counts the ids of all documents before it; the sums of the partitions before a block's
    are one row for each partition of the file.
    """
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    token = np.array([r.token for r in ranks.orderBy("rank").collect()], dtype=np.uint32)
    whole = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    begin = whole.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("begin"))
    placed = blocks.join(begin, "part").select("part", "before", "n", "ids", "sizes", "control", "data", "begin")
    return placed.mapInArrow(_read(token), f"id {kind}, start long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame, vocabulary: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write token files of ``docs`` and read them back, one row a document."""
    blocks, ranks, _ = write_token_files(docs, vocabulary, end, id_col, text_col)
    return read_token_files(blocks, ranks).withColumnRenamed("id", id_col)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_file_digest(docs, public_tokenizers.path("word_bpe_49k.json"))
