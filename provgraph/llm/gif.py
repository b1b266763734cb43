"""GIF files as a column type: encoding of 8-bit samples, and a decoder on numpy arrays.

The decoder follows GIF89a: LZW code streams, global and local palettes, interlaced frames, disposal
of frames, transparent colours and frame times. LZW codes are not followed one by one: between two
clear codes the width of each code depends on its number alone, so all are cut out at once; a table
code stands for the output of an earlier code and one sample more, so lengths and then samples are
found by repeated doubling of pointers.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.llm.words import slices

#: Samples in a row, and rows in a frame, of a stored text; with so many rows one frame fits a screen.
ROW, ROWS = 192, 256
#: Most pixels of a screen that is decoded (a quarter of a gigabyte); a larger one is an error of that file.
SCREEN = 1 << 26
#: Hundredths of a second that a frame of a stored text shows.
DELAY = 10
#: Codes after a clear code until the table of 4096 is full.
_FULL = 4096 - 258


def _widths(n: int, start: int) -> np.ndarray:
    """Bits of each of n codes after a clear code, for codes of at least ``start`` bits."""
    table = (1 << (start - 1)) + 2 + np.maximum(np.arange(n) - 1, 0)
    out = np.full(n, start, dtype=np.int64)
    for bits in range(start, 12):
        out[table >= 1 << bits] = bits + 1
    return out


def lzw_encode(samples: bytes) -> bytes:
    """The code stream of 8-bit samples, with a clear code whenever the table is full."""
    codes: list[list[int]] = []
    run: list[int] = []
    table: dict[int, int] = {}
    prefix, following = -1, 258
    emit, known = run.append, table.get
    for x in samples:
        if prefix < 0:
            prefix = x
            continue
        key = prefix << 8 | x
        found = known(key)
        if found is not None:
            prefix = found
            continue
        emit(prefix)
        prefix = x
        table[key] = following
        following += 1
        if following == 4096:
            codes.append(run)
            run, table, following = [], {}, 258
            emit, known = run.append, table.get
    if prefix >= 0:
        emit(prefix)
    codes.append(run)
    out, bits = [np.array([256], dtype=np.int64)], [np.array([9], dtype=np.int64)]
    for k, part in enumerate(codes):
        out.append(np.array([*part, 256 if k + 1 < len(codes) else 257], dtype=np.int64))
        bits.append(_widths(len(part) + 1, 9))
    flat, wide = np.concatenate(out), np.concatenate(bits)
    held = (flat[:, None] >> np.arange(12)) & 1
    return np.packbits(held[np.arange(12) < wide[:, None]].astype(np.uint8), bitorder="little").tobytes()


def _segment(codes: np.ndarray, clear: int) -> np.ndarray:
    """The samples of the codes between two clear codes."""
    n = len(codes)
    if not n:
        return np.zeros(0, dtype=np.uint8)
    parent = codes - clear - 2  # the code whose output, and one sample more, this code stands for
    if (parent >= np.arange(n)).any() or ((codes >= clear) & (parent < 0)).any():
        raise ValueError("LZW code beyond the table")
    plain = parent < 0
    up, size = np.where(plain, np.arange(n), parent), np.where(plain, 0, 1)
    while True:  # size: table codes on the way up so far
        above = up[up]
        size = size + np.where(up != np.arange(n), size[up], 0)
        if (above == up).all():
            break
        up = above
    size = size + 1
    begin = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(n), size)
    within = np.arange(begin[-1]) - begin[owner]
    source = np.where(plain[owner], np.arange(begin[-1]), begin[np.maximum(parent, 0)[owner]] + within)
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    return codes[owner[source]].astype(np.uint8)


def lzw_decode(stream: bytes, smallest: int, n: int) -> np.ndarray:
    """The first n samples of a code stream whose samples have ``smallest`` bits."""
    data = np.frombuffer(stream + b"\0\0\0\0", dtype=np.uint8).astype(np.int64)
    clear, at, most, out, have = 1 << smallest, 0, len(stream) * 8, [], 0
    block = 4200
    widths = _widths(block, smallest + 1)
    held: list[np.ndarray] = []
    count = 0
    while have < n:
        wide = widths if not count else np.full(block, 12)
        ends = at + np.cumsum(wide)
        m = int(np.searchsorted(ends, most, side="right"))
        if not m:
            break
        begin = ends[:m] - wide[:m]
        byte = begin >> 3
        raw = data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16
        codes = (raw >> (begin & 7)) & ((1 << wide[:m]) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        if not len(stop):
            held.append(codes)
            count += m
            at = int(ends[m - 1])
            if m < block:
                break
            continue
        held.append(codes[: stop[0]])
        at = int(ends[stop[0]])
        out.append(_segment(np.concatenate(held), clear))
        have += len(out[-1])
        held, count = [], 0
        if codes[stop[0]] == clear + 1:
            break
    if held:
        out.append(_segment(np.concatenate(held), clear))
    samples = np.concatenate(out) if out else np.zeros(0, dtype=np.uint8)
    if len(samples) < n:
        raise ValueError("LZW stream ends early")
    return samples[:n]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(p := data[i : i + 255])]) + p for i in range(0, len(data), 255)) + b"\0"


GREY = bytes(x for g in range(256) for x in (g, g, g))


def encode(samples: bytes, row: int = ROW, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A GIF whose frames hold the samples in order as indices into a palette of 256 greys.

    The length must be a positive multiple of ``row``. Each frame has up to ``rows`` full rows, is
    left in place (disposal 1), has no transparent colour and shows ``delay`` hundredths of a second.
    """
    if not samples or len(samples) % row:
        raise ValueError(f"samples must be a positive multiple of {row}")
    tall = min(rows, len(samples) // row)
    out = [b"GIF89a", struct.pack("<HHBBB", row, tall, 0xF7, 0, 0), GREY, b"!\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for at in range(0, len(samples), row * tall):
        part = samples[at : at + row * tall]
        out += [b"!\xf9\x04", struct.pack("<BHB", 1 << 2, delay, 0), b"\0,", struct.pack("<HHHHB", 0, 0, row, len(part) // row, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join([*out, b";"])


@dataclass
class Frame:
    """A frame: its indices and place, how long it shows, and the whole screen while it does."""

    left: int
    top: int
    indices: np.ndarray
    milliseconds: int
    disposal: int
    transparent: int
    screen: np.ndarray


def _interlaced(tall: int) -> np.ndarray:
    return np.concatenate([np.arange(a, tall, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(media: bytes) -> Iterator[Frame]:
    """The frames of a GIF, one at a time; ``screen`` is height x width x (red, green, blue, shown)."""
    if media[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    wide, tall, flags, back = struct.unpack("<HHBB", media[6:12])
    at, shared = 13, None
    if flags & 0x80:
        shared = np.frombuffer(media, dtype=np.uint8, count=3 << (flags & 7) + 1, offset=at).reshape(-1, 3)
        at += shared.size
    if wide * tall > SCREEN:
        raise ValueError("screen too large")
    screen = np.zeros((tall, wide, 4), dtype=np.uint8)
    control = (0, 0, -1)

    def joined(at: int) -> tuple[bytes, int]:
        parts = []
        while media[at]:
            parts.append(media[at + 1 : at + 1 + media[at]])
            at += 1 + media[at]
        return b"".join(parts), at + 1

    while at < len(media) and media[at] != 0x3B:
        if media[at] == 0x21:
            label, (body, to) = media[at + 1], joined(at + 2)
            if label == 0xF9:
                bits, delay, clear = struct.unpack("<BHB", body[:4])
                control = (bits >> 2 & 7, delay * 10, clear if bits & 1 else -1)
            at = to
            continue
        if media[at] != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, flags = struct.unpack("<HHHHB", media[at + 1 : at + 10])
        at, palette = at + 10, shared
        if flags & 0x80:
            palette = np.frombuffer(media, dtype=np.uint8, count=3 << (flags & 7) + 1, offset=at).reshape(-1, 3)
            at += palette.size
        smallest = media[at]
        stream, at = joined(at + 1)
        indices = lzw_decode(stream, smallest, w * h).reshape(h, w)
        if flags & 0x40:
            straight = np.empty_like(indices)
            straight[_interlaced(h)] = indices
            indices = straight
        if palette is None:
            raise ValueError("no palette")
        disposal, shown, clear = control
        before = screen.copy() if disposal == 3 else None
        part = screen[top : top + h, left : left + w]
        inside = indices[: part.shape[0], : part.shape[1]]
        colours = np.empty((*inside.shape, 4), dtype=np.uint8)
        colours[..., :3], colours[..., 3] = palette[np.minimum(inside, len(palette) - 1)], 255
        part[:] = colours if clear < 0 else np.where((inside == clear)[..., None], part, colours)
        yield Frame(left, top, indices, shown, disposal, clear, screen)
        if disposal == 2:
            part[:] = 0
        elif disposal == 3:
            screen = before
        control = (0, 0, -1)


def features(frames: Iterator[Frame]) -> tuple[bytes, dict]:
    """The grey samples of all frames in order, read from the screen, and features of the pictures."""
    held, times, shares = [], [], np.zeros((3, 8), dtype=np.int64)
    for f in frames:
        h, w = f.indices.shape
        part = f.screen[f.top : f.top + h, f.left : f.left + w]
        held.append(part[..., 0].tobytes())
        times.append(f.milliseconds)
        for c in range(3):
            shares[c] += np.bincount(part[..., c].ravel(), minlength=256).reshape(8, 32).sum(axis=1)
    return b"".join(held), {"n_frames": len(times), "milliseconds": sum(times), "histogram": shares}


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in slices(batches, "text"):
        sizes = np.diff(offsets)
        whole = data.tobytes()
        media = []
        for a, n in zip(offsets[:-1].tolist(), sizes.tolist(), strict=True):
            media.append(encode(whole[a : a + n].ljust(max(1, -(-n // ROW)) * ROW)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])


_DECODED = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, milliseconds long, red array<double>, green array<double>, blue array<double>, error string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for x in batch.column(2).to_pylist():
            row = dict.fromkeys(("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "milliseconds", "red", "green", "blue", "error"))
            if x is not None:
                row |= {"media_bytes": len(x), "media_sha256": hashlib.sha256(x).hexdigest()}
                try:
                    payload, f = features(decode(x))
                    shares = np.round(f["histogram"] / max(1, len(payload)), 6).tolist()
                    row |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "n_frames": f["n_frames"], "milliseconds": f["milliseconds"], "red": shares[0], "green": shares[1], "blue": shares[2]}
                except (ValueError, IndexError, struct.error, MemoryError) as e:
                    row["error"] = str(e)[:200]
            rows.append(row)
        kinds = {"long": pa.int64(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}
        made = [pa.array([r[n] for r in rows], kinds[k]) for n, k in (x.split() for x in _DECODED.split(", "))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["id", "n_bytes", *(x.split()[0] for x in _DECODED.split(", "))])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text as a GIF of 192 samples a row, padded with spaces.

    Null and empty texts give one row of spaces; repeated rows and equal texts give equal files; other
    columns are left out. One text at a time is held, so memory follows the longest text.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_store, f"id {kind}, n_bytes long, media binary")


def gif_features(media: DataFrame) -> DataFrame:
    """Decode a (id, n_bytes, media) table of GIFs: hashes of the grey samples, timing, histograms.

    A file that is null has null features; one that cannot be decoded has its reason in ``error``.
    """
    kind = media.schema["id"].dataType.simpleString()
    return media.select("id", "n_bytes", "media").mapInArrow(_read, f"id {kind}, n_bytes long, {_DECODED}")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    read = gif_features(store_texts(docs))
    feature = F.concat_ws(";", F.concat(F.lit("frames="), F.col("n_frames")), F.concat(F.lit("ms="), F.col("milliseconds")), F.concat(F.lit("grey="), F.array_join(F.transform("red", lambda x: F.format_string("%.6f", x)), ",")))
    return read.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "n_frames", "milliseconds")
