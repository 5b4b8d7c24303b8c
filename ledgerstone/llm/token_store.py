"""Token shards as wavelet matrices.

A shard holds the ids of consecutive documents. A wavelet matrix stores them as one bit-plane per bit of the largest id, the highest first;
each plane stably parts the ids below it by their bit. With a running count of ones for every block of 512 bits, it answers, without unpacking the shard,

    access(i)       the id at i
    rank(c, i)      how often c occurs before i
    count(c, i, j)  how often c occurs from i to j
    select(c, k)    where the k-th c stands

File: a Parquet dataset with one row, and so one blob, per shard (``shard``, ``n_docs``, ``n_tokens``, ``blob``), shards ascending in each file and from file to file. A blob is the magic ``WVM2``,
five little-endian uint64 (bits, tokens, documents, bytes of the directory, bytes of the planes), the directory, the planes, then the document ids, a null mask and the documents' lengths.
A plane is cut to pieces of 8 kB, each compressed by itself. The directory (zstd) has, plane by plane, the end of every compressed piece and the running counts. A lookup reads the directory and
decompresses one piece a plane and step; ``fetch``, ``count_tokens`` and ``occurrences`` do that for a whole dataset. Spark's committer writes the files, so a lost executor's task is redone without partial ones.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerstone.llm import _chunks as C
from ledgerstone.llm import _tokens as T
from ledgerstone.llm._shared import release, shared_folder

_MAGIC, _BLOCK, _PIECE = b"WVM2", 512, 8192
#: Up to so many shards, their starts are broadcast. Width of the slots in which positions meet shards.
BROADCAST_SHARDS, _SLOT = 100_000, 1 << 20
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Plane:
    """A bit-plane whose pieces are decompressed when they are looked at; the last few are kept."""

    def __init__(self, raw: memoryview, ends: np.ndarray, size: int):
        self.raw, self.ends, self.size, self.held = raw, ends, size, {}
        self.opened = 0

    def _piece(self, k: int) -> np.ndarray:
        if k not in self.held:
            if len(self.held) >= 4:
                self.held.pop(next(iter(self.held)))
            lo = int(self.ends[k - 1]) if k else 0
            self.held[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.raw[lo : int(self.ends[k])]), np.uint8)
            self.opened += 1
        return self.held[k]

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at):
        """A byte, or a run of bytes of one block: blocks never cross pieces."""
        if isinstance(at, slice):
            k = at.start // _PIECE
            return self._piece(k)[at.start - k * _PIECE : at.stop - k * _PIECE] if at.start < at.stop else np.zeros(0, np.uint8)
        return self._piece(at // _PIECE)[at % _PIECE]

    def whole(self) -> np.ndarray:
        ends, d = self.ends.tolist(), zstandard.ZstdDecompressor()
        return np.frombuffer(b"".join(d.decompress(self.raw[lo:hi]) for lo, hi in zip([0, *ends], ends, strict=False)), np.uint8)


class WaveletMatrix:
    def __init__(self, n: int, planes: list[np.ndarray | Plane], counts: list[np.ndarray] | None = None):
        """planes: packed bits of each level, the highest bit first. counts: ones before each block, if known."""
        self.n, self.planes, self.counts = n, planes, counts or []
        for p in planes if counts is None else []:
            ones = _POP[p].astype(np.int64)
            pad = np.zeros(-(-len(p) // (_BLOCK // 8)) * (_BLOCK // 8), np.int64)
            pad[: len(p)] = ones
            self.counts.append(np.concatenate([[0], np.cumsum(pad.reshape(-1, _BLOCK // 8).sum(1))]))
        self.zeros = [n - int(c[-1]) for c in self.counts]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        kind = np.uint16 if bits <= 16 else np.uint32
        planes, cur = [], ids.astype(kind)
        for b in reversed(range(bits)):
            one = (cur & kind(1 << b)).astype(bool)
            planes.append(np.packbits(one))
            cur = np.concatenate([cur.take(np.flatnonzero(~one)), cur.take(np.flatnonzero(one))])  # by position: much faster than by mask
        return cls(len(ids), planes)

    def decode(self) -> np.ndarray:
        """All ids: the planes' partings undone from the lowest up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        below = np.zeros(self.n, kind)
        for b, p in enumerate(reversed(self.planes)):
            one = np.unpackbits(p.whole() if isinstance(p, Plane) else p, count=self.n).view(bool)
            z = self.n - int(np.count_nonzero(one))
            here = np.empty(self.n, kind)
            here[np.flatnonzero(~one)] = below[:z]
            here[np.flatnonzero(one)] = below[z:] | kind(1 << b)
            below = here
        return below.astype(np.uint32)

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before i."""
        p, k = self.planes[level], i // _BLOCK
        at = int(self.counts[level][k])
        lo, hi = k * (_BLOCK // 8), i // 8
        at += int(_POP[p[lo:hi]].sum())
        if i % 8:
            at += int(_POP[p[hi] >> (8 - i % 8)])
        return at

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level, p in enumerate(self.planes):
            bit = int(p[i // 8] >> (7 - i % 8) & 1)
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _narrow(self, c: int, i: int, j: int) -> tuple[int, int]:
        for level in range(len(self.planes)):
            a, b = self._ones(level, i), self._ones(level, j)
            i, j = (self.zeros[level] + a, self.zeros[level] + b) if c >> (len(self.planes) - 1 - level) & 1 else (i - a, j - b)
        return i, j

    def count(self, c: int, i: int = 0, j: int | None = None) -> int:
        j = self.n if j is None else j
        if c >> len(self.planes) or i >= j:
            return 0
        a, b = self._narrow(c, i, j)
        return b - a

    def rank(self, c: int, i: int) -> int:
        return self.count(c, 0, i)

    def _find(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit in a plane: its block by the directory, then its place there."""
        c = self.counts[level]
        before = c if bit else np.arange(len(c)) * _BLOCK - c
        block = int(np.searchsorted(before, k, side="right")) - 1
        lo = block * (_BLOCK // 8)
        here = np.unpackbits(self.planes[level][lo : min(lo + _BLOCK // 8, len(self.planes[level]))])[: self.n - block * _BLOCK]
        return block * _BLOCK + int(np.flatnonzero(here == bit)[k - int(before[block])])

    def select(self, c: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of c; -1 if there are fewer."""
        if k < 0 or k >= self.count(c):
            return -1
        at = self._narrow(c, 0, self.n)[0] + k
        for level in reversed(range(len(self.planes))):
            bit = c >> (len(self.planes) - 1 - level) & 1
            at = self._find(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, c: int) -> list[int]:
        return [self.select(c, k) for k in range(self.count(c))]


def write_blob(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The blob of one shard. A null document id is kept as such; documents of no ids and a shard of none are allowed."""
    w, z = WaveletMatrix.build(ids), zstandard.ZstdCompressor(level=1)
    pieces = [[z.compress(p[i : i + _PIECE].tobytes()) for i in range(0, len(p), _PIECE)] for p in w.planes]
    ends = [np.cumsum([len(x) for x in p], dtype=np.int64).astype("<u4").tobytes() for p in pieces]
    directory = z.compress(b"".join([*ends, *(c.astype("<u4").tobytes() for c in w.counts)]))
    body = b"".join(x for p in pieces for x in p)
    null = np.array([d is None for d in doc_ids], np.uint8)
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return _MAGIC + struct.pack("<5Q", len(w.planes), w.n, len(doc_ids), len(directory), len(body)) + directory + body + known.tobytes() + null.tobytes() + lengths.astype("<u8").tobytes()


def read_blob(blob: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """The matrix of a blob, its planes still compressed, its document ids and their lengths."""
    if blob[:4] != _MAGIC:
        raise ValueError("not a wavelet shard")
    bits, n, docs, head, size = struct.unpack_from("<5Q", blob, 4)
    directory = zstandard.ZstdDecompressor().decompress(blob[44 : 44 + head])
    width = -(-n // 8)
    n_pieces, n_counts = -(-width // _PIECE), -(-n // _BLOCK) + 1
    planes, counts, at = [], [], 44 + head
    for b in range(bits):
        ends = np.frombuffer(directory, "<u4", n_pieces, 4 * b * n_pieces)
        planes.append(Plane(memoryview(blob)[at : at + size], ends, width))
        at += int(ends[-1]) if n_pieces else 0
        counts.append(np.frombuffer(directory, "<u4", n_counts, 4 * (bits * n_pieces + b * n_counts)).astype(np.int64))
    at = 44 + head + size
    known = np.frombuffer(blob, "<i8", docs, at).tolist()
    null = np.frombuffer(blob, np.uint8, docs, at + 8 * docs)
    return WaveletMatrix(n, planes, counts), [None if z else d for d, z in zip(known, null.tolist(), strict=True)], np.frombuffer(blob, "<u8", docs, at + 9 * docs).astype(np.int64)


def write_shards(docs: DataFrame, path: str, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = C.CHUNK_BYTES // 2) -> None:
    """Encode every whole text, end id last, and write one wavelet blob for each run of consecutive document ids.

    Null and empty texts are one end id. Null ids come first, rows of equal id follow each other in the
    order of Spark's xxhash64 of their text. An empty table gives an empty dataset. Other columns are ignored.
    """
    tokenizer_path = tokenizer_path or T.default_path()
    chunks, layout = C.chunk_docs(docs, id_col, text_col, shard_bytes, dealt=False)
    tasks = min(layout.n, C.MOST_TASKS)
    out = pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("blob", pa.binary())])

    def write(table: pa.Table) -> pa.Table:
        c = C.Chunk(table)
        enc = T.encoder(tokenizer_path, 200_000)  # rare units are most of the library's work
        parts = enc.encode_many(t.decode() for t in c.texts)
        lengths = np.array([len(p) // 4 for p in parts], np.int64)
        ids = np.frombuffer(b"".join(parts), "<u4")
        release()
        return pa.table([[c.index], [len(c.ids)], [len(ids)], [write_blob(ids, c.ids, lengths)]], schema=out)

    # Tasks take neighbouring shards, and a task's file lists them in order.
    chunks = chunks.withColumn("task", F.expr(f"CAST(chunk * {tasks}L div {layout.n} AS INT)")).repartitionById(tasks, "task")
    chunks.groupBy("task", "chunk").applyInArrow(write, "shard int, n_docs long, n_tokens long, blob binary").write.mode("overwrite").parquet(path)


def _started(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Shards with start, the ids before them: prefix sums within groups of shards and over the groups."""
    shards = spark.read.parquet(path)
    sizes = shards.select("shard", "n_tokens", F.expr("shard div 4096").alias("g"))
    inner = F.sum("n_tokens").over(Window.partitionBy("g").orderBy("shard")) - F.col("n_tokens")
    groups = sizes.groupBy("g").agg(F.sum("n_tokens").alias("t"))  # one row for 4096 shards
    groups = groups.select("g", (F.sum("t").over(Window.orderBy("g")) - F.col("t")).alias("base"))
    starts = sizes.withColumn("inner", inner).join(groups, "g").select("shard", (F.col("base") + F.col("inner")).alias("start"))
    few = shards.agg(F.count("*")).first()[0] <= BROADCAST_SHARDS  # 16 bytes each
    return shards.select("shard", *columns).join(F.broadcast(starts) if few else starts, "shard")


def read_shards(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids (little-endian uint32) of every document in a dataset of shards; no rows of an empty one."""
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if with_ids else [])])

    def read(batches):
        for batch in batches:
            for before, blob in zip(batch.column("start").to_pylist(), batch.column("blob"), strict=True):
                w, ids, lengths = read_blob(blob.as_py())
                raw = memoryview(w.decode().astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                for i in range(0, len(ids), 2000):  # rows of a bounded number at a time
                    n, stop = lengths[i : i + 2000], ends[i : i + 2000]
                    cut = [raw[4 * (e - k) : 4 * e] for e, k in zip(stop.tolist(), n.tolist(), strict=True)]
                    columns = [pa.array(ids[i : i + 2000], pa.int64()), pa.array(before + stop - n), pa.array(n), pa.array([zlib.crc32(x) for x in cut], pa.int64())]
                    if with_ids:
                        columns.append(pa.array([bytes(x) for x in cut], pa.binary()))
                    yield pa.record_batch(columns, schema=out)

    return _started(spark, path, "blob").select("start", "blob").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def fetch(positions: DataFrame, path: str, column: str = "position") -> DataFrame:
    """position and token of every row whose position lies in the dataset (repeated ones each time; null and outside ones have no row), by access without unpacking shards."""
    spark = positions.sparkSession
    shards = _started(spark, path, "n_tokens").withColumn("slot", F.explode(F.expr(f"sequence(start div {_SLOT}, (start + n_tokens - 1) div {_SLOT})")))
    p = positions.select(F.col(column).cast("long").alias("position")).where("position >= 0").withColumn("slot", F.expr(f"position div {_SLOT}"))
    found = p.join(shards, "slot").where("position >= start AND position < start + n_tokens").groupBy("shard").agg(F.collect_list(F.struct("position", (F.col("position") - F.col("start")).alias("at"))).alias("asked"))
    out = pa.schema([("position", pa.int64()), ("token", pa.int64())])

    def look(batches):
        for batch in batches:
            for blob, asked in zip(batch.column("blob"), batch.column("asked").to_pylist(), strict=True):
                w = read_blob(blob.as_py())[0]
                yield pa.record_batch([pa.array([a["position"] for a in asked]), pa.array([w.access(a["at"]) for a in asked], pa.int64())], schema=out)

    return spark.read.parquet(path).select("shard", "blob").join(found, "shard").select("blob", "asked").mapInArrow(look, "position long, token long")


def count_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """token and n, how often it occurs in the dataset, for each of the given ids (each once; ids that don't occur have n = 0)."""
    out, wanted = pa.schema([("token", pa.int64()), ("n", pa.int64())]), sorted(set(tokens))

    def count(batches):
        for batch in batches:
            for blob in batch.column("blob"):
                w = read_blob(blob.as_py())[0]
                yield pa.record_batch([pa.array(wanted, pa.int64()), pa.array([w.count(c) for c in wanted], pa.int64())], schema=out)

    found = spark.read.parquet(path).select("blob").mapInArrow(count, "token long, n long")
    none = spark.createDataFrame([(c, 0) for c in wanted], "token long, n long")
    return found.unionAll(none).groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """token and position of every occurrence of the given ids in the dataset, by select without unpacking shards."""
    out, wanted = pa.schema([("token", pa.int64()), ("position", pa.int64())]), sorted(set(tokens))

    def find(batches):
        for batch in batches:
            for before, blob in zip(batch.column("start").to_pylist(), batch.column("blob"), strict=True):
                w = read_blob(blob.as_py())[0]
                for c in wanted:
                    at = w.occurrences(c)
                    yield pa.record_batch([pa.array([c] * len(at), pa.int64()), pa.array([before + i for i in at], pa.int64())], schema=out)

    return _started(spark, path, "blob").select("start", "blob").mapInArrow(find, "token long, position long")


def token_digests(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the shards, read them back, and return doc_id, start, n_tokens and ids_crc32 of every document."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/tokens"
    write_shards(docs, path, **options)
    return read_shards(spark, path, with_ids=False)
