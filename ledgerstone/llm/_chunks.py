"""Ordered chunks of documents and the hash exchange between them.

Several operators ask the same question of a corpus: which of the n-grams of this chunk also occur
in another chunk? The answer is computed in three bounded steps:

1. ``chunk_docs`` cuts the table into chunks of consecutive rows, by id and then by a hash of the text, of about ``chunk_bytes`` of text each, so
   that the order of chunks is the order of documents;
2. each chunk sends, for every hash bucket, one blob of its *distinct* keys, sorted and delta-coded. A key that fills a
   third of the corpus is one key per chunk, so there is no hot bucket;
3. each bucket answers every blob with one small value per key, in the order of the blob. The chunk
   derives the same keys again from its text and reads the answers by position.

Blobs hold BLOB_KEYS keys on average however many chunks there are, so the rows of an exchange grow as the input does. A bucket holds that much of
every chunk: 2^26 keys, some 0.5 GB in a task, at 131,072 chunks (2 TB in chunks of 16 MB). Beyond, buckets grow in number and blobs shrink, to
LEAST_KEYS at 2^21 chunks; that is also the most there are, so that their bounds, the one thing the driver holds, never pass 32 MB: a larger corpus gets larger chunks (48 MB at 100 TB).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks never get fewer than this, so that small inputs still use all cores.
LEAST_CHUNKS = 64
CHUNK_BYTES = 16 << 20
#: Chunks at most, and tasks they are dealt to at most.
MOST_CHUNKS, MOST_TASKS = 1 << 21, 1 << 16
#: Keys of a blob, keys of a blob at least, keys of a bucket before blobs shrink.
BLOB_KEYS, LEAST_KEYS, BUCKET_KEYS = 512, 32, 1 << 26
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_F1, _F2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33, _S29 = np.uint64(33), np.uint64(29)
_WS = np.zeros(256, bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True


@dataclass(frozen=True)
class Layout:
    """How many chunks there are, of how many bytes of text on average."""

    n: int
    chunk_bytes: float

    def buckets(self, per_byte: float) -> int:
        """Buckets for an exchange of so many keys a byte of text."""
        return max(1, math.ceil(self.chunk_bytes * per_byte / max(LEAST_KEYS, min(BLOB_KEYS, BUCKET_KEYS // self.n))))

    def deal(self, rows: DataFrame, by: str = "chunk", most: int | None = None) -> DataFrame:
        """Rows dealt out evenly by a number: its remainder by the number of tasks."""
        return rows.repartitionById(min(self.n, most or self.n, MOST_TASKS), by)


def place(ids: np.ndarray, hashes: np.ndarray, cut_ids: np.ndarray, cut_hashes: np.ndarray) -> np.ndarray:
    """The first chunk whose last row is not before (id, hash)."""
    lo, hi = np.searchsorted(cut_ids, ids, side="left"), np.searchsorted(cut_ids, ids, side="right")
    out = lo.copy()
    at = np.flatnonzero(hi > lo)  # ids in which a chunk ends
    for i in np.unique(ids[at]):
        own = at[ids[at] == i]
        a, b = lo[own[0]], hi[own[0]]
        out[own] = a + np.searchsorted(cut_hashes[a:b], hashes[own], side="left")
    return out.astype(np.int32)


def chunk_docs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, dealt: bool = True) -> tuple[DataFrame, Layout]:
    """(chunk int, doc_id long, h long, text binary), dealt out by chunk unless the caller does that, and the layout.

    Chunk numbers ascend with the id (null first), and among rows of one id with the 64-bit hash of the text, so a repeated or null id may
    span chunks. Sizes are sorted by range of (id, hash), and every range cuts its own rows to chunks of about even bytes; no text is
    sorted. The driver gets one bound per chunk.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))
    sizes = t.select(order.alias("i"), "h", (F.octet_length("text") + 16).cast("long").alias("size"))  # a row counts too, so that very many empty texts are split
    total = sizes.agg(F.sum("size")).first()[0] or 0
    goal = max(min(chunk_bytes, total / LEAST_CHUNKS), total / MOST_CHUNKS, 1)
    found = pa.schema([("i", pa.int64()), ("h", pa.int64())])

    def cuts(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        i, h, size = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in got]) for c in ("i", "h", "size"))
        upto = np.cumsum(size)
        m = max(1, round(int(upto[-1]) / goal))
        last = np.unique(np.append(np.searchsorted(upto, upto[-1] * np.arange(1, m) / m), len(i) - 1))
        yield pa.record_batch([pa.array(i[last]), pa.array(h[last])], schema=found)

    rows = sizes.repartitionByRange("i", "h").sortWithinPartitions("i", "h").mapInArrow(cuts, "i long, h long").toArrow()
    rows = sorted(set(zip(rows.column("i").to_pylist(), rows.column("h").to_pylist(), strict=True)))
    cut_ids, cut_hashes = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)

    @F.pandas_udf("int")
    def where(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(place(ids.to_numpy(), hashes.to_numpy(), cut_ids, cut_hashes))

    layout = Layout(max(1, len(rows)), total / max(1, len(rows)))
    placed = t.select(where(order, "h").alias("chunk"), "doc_id", "h", F.col("text").cast("binary").alias("text"))
    return layout.deal(placed) if dealt else placed, layout


class Chunk:
    """The documents of one chunk by id (nulls first), hash and text: ids, bytes and offsets."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        ids, hashes, texts = (table.column(c).to_pylist() for c in ("doc_id", "h", "text"))
        self.index = int(table.column("chunk")[0].as_py()) if table.num_rows else -1
        order = sorted(range(len(texts)), key=lambda i: (ids[i] is not None, ids[i] or 0, hashes[i], texts[i]))
        self.ids = [ids[i] for i in order]
        self.hashes = [hashes[i] for i in order]
        self.texts = [texts[i] for i in order]
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in self.texts], dtype=np.int64)]).astype(np.int64)
        self.n = int(self.offsets[-1])

    @cached_property
    def buf(self) -> np.ndarray:
        """All bytes; the padding lets a word be read eight bytes at a time."""
        return np.frombuffer(b"".join([*self.texts, b"\0" * 32]), dtype=np.uint8)

    def words(self, lower: bool = False) -> Words:
        return Words(self, lower)


class Words:
    """Runs of bytes other than space and \\t..\\r, which never cross documents."""

    def __init__(self, chunk: Chunk, lower: bool = False):
        body = chunk.buf[: chunk.n]
        self.buf = chunk.buf
        if lower:
            self.buf = chunk.buf.copy()
            upper = (self.buf >= 65) & (self.buf <= 90)
            self.buf[upper] += 32
        ink = ~_WS[body]
        edge = np.zeros(chunk.n + 1, bool)
        edge[chunk.offsets] = True
        first = ink.copy()
        first[1:] &= ~ink[:-1] | edge[1:-1]
        last = ink
        last[:-1] &= ~ink[1:] | edge[1:-1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, chunk.offsets)  # words of document i: bounds[i]:bounds[i+1]
        self.n = len(self.starts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hashes of the words, eight bytes a round."""
        wide = np.ndarray((len(self.buf) - 8,), dtype="<u8", buffer=self.buf, strides=(1,))
        lens = self.ends - self.starts
        with np.errstate(over="ignore"):
            h = lens.astype(np.uint64) * _M2 + np.uint64(seed * 0x51ED270B + 1)
            live, at = np.arange(self.n), self.starts
            left = lens
            while len(live):
                v = wide[at]
                short = left < 8
                v[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
                h[live] = mix((h[live] ^ v) * _M1 + _M2)
                keep = left > 8
                live, at, left = live[keep], at[keep] + 8, left[keep] - 8
        return h


def distinct(x: np.ndarray) -> np.ndarray:
    """Ascending distinct values; a plain sort, which is much faster here than numpy's unique."""
    x = np.sort(x)
    if len(x) < 2:
        return x
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _S33)
    x = x * _F1
    x ^= x >> _S29
    x *= _F2
    x ^= x >> _S33
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ordered combination of two arrays of hashes."""
    return mix(a * _M1 + (b ^ (b >> _S29)) * _M2)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive items; entry i covers i..i+k-1. Empty if there are fewer than k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, done, power, width = None, 0, h, 1
        while True:
            if k & width:
                out = power[:n].copy() if out is None else pair(out, power[done : done + n])
                done += width
            if width * 2 > k:
                return mix(out + np.uint64(k))
            power = pair(power[: len(power) - width], power[width:])
            width *= 2


def grams_at(h: np.ndarray, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the k items from each of the given starts."""
    a, b = np.zeros(len(at), np.uint64), np.full(len(at), k, np.uint64)
    odd = np.random.default_rng(k).integers(0, 1 << 64, 2 * k, np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(k):
            v = h[at + i]
            a += (v ^ (v >> _S33)) * odd[2 * i]
            b ^= (v + (v << _S29)) * odd[2 * i + 1]
            b = b << np.uint64(9) | b >> np.uint64(55)
        return mix(a), mix(b)


def member(x: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in x whose value is among ascending keys, and its index there. A table of low bits spares most searches."""
    if not len(keys) or not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = x.dtype.type((1 << max(10, min(24, len(keys).bit_length() + 3))) - 1)
    table = np.zeros(int(low) + 1, bool)
    table[keys & low] = True
    at = np.flatnonzero(table[x & low])
    k = np.searchsorted(keys, x[at])
    same = keys[np.minimum(k, len(keys) - 1)] == x[at]
    return at[same], k[same]


def inside(bounds: np.ndarray, k: int, total: int) -> np.ndarray:
    """Mask over window starts: the window of k items lies in one document."""
    n = max(0, total - k + 1)
    ok = np.zeros(n + 1, np.int32)
    lo, hi = bounds[:-1], np.maximum(bounds[1:] - k + 1, bounds[:-1])
    some = hi > lo
    np.add.at(ok, lo[some], 1)
    np.add.at(ok, hi[some], -1)
    return np.cumsum(ok[:n]) > 0


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending uint32 keys as byte planes of their differences; the upper planes are nearly empty and compress well."""
    d = np.diff(keys, prepend=np.uint32(0)).astype("<u4")
    return d.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack_keys(b: bytes) -> np.ndarray:
    d = np.frombuffer(b, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    return np.cumsum(d, dtype=np.uint32)


def split(h: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit key of 64-bit hashes, as one ascending order: bucket << 32 | key, distinct, and the inverse."""
    code = ((h >> np.uint64(33)) % np.uint64(n_buckets)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))
    return code


def by_bucket(codes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Offsets of each bucket in ascending codes."""
    return np.searchsorted(codes, np.arange(n_buckets + 1, dtype=np.uint64) << np.uint64(32))


BLOB = "bucket int, chunk int, payload binary, extra binary"
BLOB_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("payload", pa.binary()), ("extra", pa.binary())])


def blobs(rows: list[tuple[int, int, bytes, bytes]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.table([pa.array(list(c), t) for c, t in zip(cols, BLOB_ARROW.types, strict=True)], schema=BLOB_ARROW)


def rows_of(table: pa.Table) -> list[tuple[int, int, bytes, bytes]]:
    """Rows of a table of blobs by bucket and chunk."""
    return sorted(zip(*(table.column(c).to_pylist() for c in ("bucket", "chunk", "payload", "extra")), strict=True), key=lambda r: r[:2])


def flags(table: pa.Table) -> np.ndarray:
    """One byte per key from the answers to one chunk, in the order of the chunk's codes."""
    got = [np.frombuffer(r[3], np.uint8) for r in rows_of(table)]
    return np.concatenate(got) if got else np.zeros(0, np.uint8)
