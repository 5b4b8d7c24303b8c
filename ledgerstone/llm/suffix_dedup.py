"""Suffix-array dedup: remove every byte covered by a string of ``least`` bytes that also starts in an earlier document.

Each chunk of consecutive documents is a shard with its own suffix array, built by induced sorting, and permuted common prefixes (``_suffix``). Suffixes whose common prefixes
reach ``least`` bytes form intervals, one per repeated string; all of its starts outside the interval's first document are repeats within the shard. What remains, the *live* starts, is
one document's worth per distinct string, and must still be held against the earlier shards:

1. each live string has an anchor, the 25-byte string in it whose first eight bytes hash lowest. It is the same wherever the string occurs; shards exchange
   their distinct anchors, some 7 in 100 bytes, and go on only with those that another shard has too;
2. an anchor with the bytes around it that any of its strings can reach is its context. A context that an earlier shard also has settles all its strings
   at once, and so does a context that no other shard has and that is the only one of its anchor;
3. the few strings left, at the edges of repeated passages, are exchanged one by one by 96-bit hashes.

Every exchange is by distinct keys of a shard, so a passage in a third of all documents is one key per shard, whatever its length.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerstone.llm import _chunks as C
from ledgerstone.llm import _suffix

SHARD_BYTES = 4 << 20
_PAD = 128
_BLOCK = 1 << 15
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
OUT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
_ODD = np.random.default_rng(7).integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)


class Shard:
    """A chunk's bytes with zeros on both sides, its valid starts and their anchors."""

    def __init__(self, chunk: C.Chunk, least: int):
        self.chunk, self.least, self.width = chunk, least, least // 2
        self.buf = np.concatenate([np.zeros(_PAD, np.uint8), chunk.buf[: chunk.n], np.zeros(_PAD, np.uint8)])
        self.wide = np.ndarray((len(self.buf) - 8,), dtype="<u8", buffer=self.buf, strides=(1,))
        sizes = np.diff(chunk.offsets)
        valid = np.zeros(chunk.n + 1, np.int8)
        long = sizes >= least
        valid[chunk.offsets[:-1][long]] += 1
        valid[chunk.offsets[1:][long] - least + 1] -= 1
        self.valid = np.cumsum(valid[: chunk.n], dtype=np.int8) > 0

    def _loads(self, at: np.ndarray, n: int, lane: int) -> np.ndarray:
        """Hash of the n bytes from each position, eight at a time; the last eight may overlap."""
        steps = [*range(0, n - 7, 8), *([n - 8] if n % 8 else [])]
        out = None
        with np.errstate(over="ignore"):
            for i, o in enumerate(steps):
                v = self.wide[_PAD + o + at] * _ODD[2 * i + lane]
                v ^= v >> np.uint64(32)
                out = v if out is None else out * _ODD[60 + lane] + v
            return C.mix(out)

    def places(self) -> np.ndarray:
        """The anchor of the string at each start: of its places for a width of bytes, the one whose first eight hash lowest, the leftmost if equal."""
        span = self.least - self.width + 1
        n = self.chunk.n - span + 1
        out = np.empty(max(0, n), "<u4")
        for lo in range(0, n, _BLOCK):  # blocks that stay in a core's cache
            hi = min(n, lo + _BLOCK)
            with np.errstate(over="ignore"):
                power = self.wide[_PAD + lo : _PAD + hi + span - 1] * _ODD[48]
            power &= np.uint64(0xFFFFFFFF00000000)
            power |= np.arange(lo, hi + span - 1, dtype=np.uint64)
            best, done, width = None, 0, 1
            while True:  # smallest over the next span places, by doubling
                if span & width:
                    best = power[: hi - lo].copy() if best is None else np.minimum(best, power[done : done + hi - lo], out=best)
                    done += width
                if width * 2 > span:
                    break
                power = np.minimum(power[: len(power) - width], power[width:])
                width *= 2
            out[lo:hi] = best & np.uint64(0xFFFFFFFF)
        return out

    def anchors(self, places: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For ascending starts: distinct anchors, their 64-bit hashes, and how many starts each one has. Anchors ascend with the starts."""
        p = places[starts]
        new = np.ones(len(p), bool)
        new[1:] = p[1:] != p[:-1]
        first = np.flatnonzero(new)
        at = p[first].astype(np.int64)
        return at, self._loads(at, self.width, 0), np.diff(first, append=len(p))

    def contexts(self, p: np.ndarray) -> np.ndarray:
        """Hash of the bytes that strings of an anchor can reach: least - width before it, least from it on, cut at its document."""
        doc = np.searchsorted(self.chunk.offsets, p, side="right") - 1
        before = np.minimum(self.least - self.width, p - self.chunk.offsets[doc])
        after = np.minimum(self.least, self.chunk.offsets[doc + 1] - p)
        masks = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
        out = before.astype(np.uint64) * _ODD[50] + after.astype(np.uint64) * _ODD[51]
        with np.errstate(over="ignore"):
            for i, o in enumerate(range(-(self.least - self.width), self.least, 8)):
                m = masks[np.clip(after - o, 0, 8)] & ~masks[np.clip(-before - o, 0, 8)]
                v = (self.wide[_PAD + p + o] & m) * _ODD[2 * (i % 24)]
                v ^= v >> np.uint64(32)
                out = out * _ODD[61] + v
            return C.mix(out)

    def strings(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._loads(starts, self.least, 0), self._loads(starts, self.least, 1)


class State:
    """What a shard knows after the answers it has got so far; every pass derives the same keys again."""

    def __init__(self, table: pa.Table, told: pa.Table, least: int, n: int):
        stage = np.array(told.column("stage").to_pylist(), np.int64)
        rows = lambda k: told.filter(pa.array(stage == k))
        self.shard = Shard(C.Chunk(table), least)
        c = self.shard.chunk
        bits = rows(0).column("payload").to_pylist()
        self.gone = np.unpackbits(np.frombuffer(bits[0], np.uint8), count=c.n).astype(bool) if bits and c.n else np.zeros(c.n, bool)
        self.live = np.flatnonzero(self.shard.valid & ~self.gone)
        self.p, h, self.of = self.shard.anchors(self.shard.places(), self.live)
        code = C.split(h, n)
        shared = [C.unpack_keys(r[2]).astype(np.uint64) | np.uint64(r[0] << 32) for r in C.rows_of(rows(1))]
        at, _ = C.member(code, np.concatenate([*shared, np.zeros(0, np.uint64)]))
        self.met = at  # anchors that another shard has
        self.code, self.context = code[at], self.shard.contexts(self.p[at])
        o = np.lexsort((self.context, self.code))
        new = np.ones(len(o), bool)
        new[1:] = (self.code[o][1:] != self.code[o][:-1]) | (self.context[o][1:] != self.context[o][:-1])
        self.group = np.empty(len(o), np.int64)
        self.group[o] = np.cumsum(new) - 1
        self.keys, self.contexts = self.code[o][new], self.context[o][new]
        self.verdict = C.flags(rows(2))

    def spread(self, wanted: int) -> np.ndarray:
        """Mask over the live starts whose anchor's context got this verdict: 1 an earlier shard has it, 2 look at the strings."""
        flag = np.zeros(len(self.p), bool)
        flag[self.met[self.verdict[self.group] == wanted]] = True
        return np.repeat(flag, self.of)

    def edge(self, n: int):
        """Starts to be looked at one by one, with their keys as _order gives them."""
        starts = self.live[self.spread(2)]
        return starts, _order(*self.shard.strings(starts), n)


def _order(a: np.ndarray, b: np.ndarray, n: int):
    """Group of each item among the distinct (a, low half of b), which ascend with a; and each group's bucket, a and b."""
    b = b & np.uint64(0xFFFFFFFF)
    o = np.lexsort((b, a))
    new = np.ones(len(o), bool)
    new[1:] = (a[o][1:] != a[o][:-1]) | (b[o][1:] != b[o][:-1])
    group = np.empty(len(o), np.int64)
    group[o] = np.cumsum(new) - 1
    first = o[new]
    return group, (a[first] >> np.uint64(32)) * np.uint64(n) >> np.uint64(32), a[first], b[first].astype("<u4")


def suffix_dedup(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed runs in bytes, end exclusive) and kept (remaining bytes).

    Earlier means a smaller id. Strings never cross documents and are judged on the input; repeats inside one document stay. Null and
    empty texts have no bytes. Rows of equal id are separate documents in the order of Spark's xxhash64 of their text, a null id is the earliest; of two equal rows
    the second loses all its bytes, if it has ``least`` or more. Shorter documents stay whole. An empty table gives no rows.
    """
    if not 16 <= least <= 96:
        raise ValueError("least must be from 16 to 96 bytes")
    spark = docs.sparkSession
    _suffix.register(spark)
    chunks, layout = C.chunk_docs(docs, id_col, text_col, shard_bytes)
    n = layout.buckets(0.08)  # anchors of a byte of text
    joined = pa.schema([("chunk", pa.int32()), ("text", pa.binary()), ("ends", pa.binary())])

    def join(table: pa.Table) -> pa.Table:
        c = C.Chunk(table)
        return pa.table([[c.index], [c.buf[: c.n].tobytes()], [c.offsets[1:].astype("<u4").tobytes()]], schema=joined)

    def send_anchors(table: pa.Table) -> pa.Table:
        s = Shard(C.Chunk(table), least)
        keys = C.distinct(C.split(s.anchors(s.places(), np.flatnonzero(s.valid))[1], n))
        cut = C.by_bucket(keys, n)
        low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return C.blobs([(b, s.chunk.index, C.pack_keys(low[i:j]), None) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i])

    def meet_anchors(table: pa.Table) -> pa.Table:
        rows = C.rows_of(table)
        keys = [C.unpack_keys(r[2]) for r in rows]
        ordered = np.sort(np.concatenate(keys))
        shared = C.distinct(ordered[1:][ordered[1:] == ordered[:-1]])
        return C.blobs([(r[0], r[1], C.pack_keys(k[C.member(k, shared)[0]]), None) for r, k in zip(rows, keys, strict=True)])

    def send_contexts(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return C.blobs([])
        s = State(table, told, least, n)
        cut = C.by_bucket(s.keys, n)
        low = (s.keys & np.uint64(0xFFFFFFFF)).astype("<u4")
        return C.blobs([(b, s.shard.chunk.index, low[i:j].tobytes(), s.contexts[i:j].astype("<u8").tobytes()) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i])

    def meet_contexts(table: pa.Table) -> pa.Table:
        rows = C.rows_of(table)
        key = np.concatenate([np.frombuffer(r[2], "<u4") for r in rows])
        context = np.concatenate([np.frombuffer(r[3], "<u8") for r in rows])
        o = np.lexsort((context, key))  # stable, so equal ones stand by chunk
        k, x = key[o], context[o]
        again = np.zeros(len(o), bool)
        again[1:] = (k[1:] == k[:-1]) & (x[1:] == x[:-1])
        first = np.ones(len(o), bool)
        first[1:] = k[1:] != k[:-1]
        run = np.cumsum(first) - 1
        kinds = np.bincount(run, weights=~again) if len(o) else np.zeros(0)
        verdict = np.empty(len(o), np.uint8)
        verdict[o] = np.where(again, 1, np.where(kinds[run] > 1, 2, 0))
        parts = np.split(verdict, np.cumsum([len(r[2]) // 4 for r in rows])[:-1])
        return C.blobs([(r[0], r[1], None, p.tobytes()) for r, p in zip(rows, parts, strict=True)])

    def send_strings(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return C.blobs([])
        s = State(table, told, least, n)
        _, (_, bucket, a, b) = s.edge(n)
        cut = np.searchsorted(bucket, np.arange(n + 1))
        return C.blobs([(k, s.shard.chunk.index, a[i:j].astype("<u8").tobytes(), b[i:j].tobytes()) for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i])

    def meet_strings(table: pa.Table) -> pa.Table:
        rows = C.rows_of(table)
        a = np.concatenate([np.frombuffer(r[2], "<u8") for r in rows])
        b = np.concatenate([np.frombuffer(r[3], "<u4") for r in rows])
        o = np.lexsort((b, a))
        seen = np.zeros(len(o), np.uint8)
        seen[o[1:]] = (a[o][1:] == a[o][:-1]) & (b[o][1:] == b[o][:-1])
        parts = np.split(seen, np.cumsum([len(r[2]) // 8 for r in rows])[:-1])
        return C.blobs([(r[0], r[1], None, p.tobytes()) for r, p in zip(rows, parts, strict=True)])

    def cut(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _OUT.empty_table()
        s = State(table, told, least, n)
        repeat = s.gone
        repeat[s.live[s.spread(1)]] = True
        starts, (group, *_) = s.edge(n)
        if len(starts):
            seen = C.flags(told.filter(pa.array(np.array(told.column("stage").to_pylist()) == 3)))
            repeat[starts[seen[group] > 0]] = True
        return _result(s.shard.chunk, repeat, least)

    whole = chunks.groupBy("chunk").applyInArrow(join, "chunk int, text binary, ends binary")
    gone = whole.select(F.lit(0).alias("bucket"), "chunk", _suffix.repeats(F.col("text"), F.col("ends"), least).alias("payload"), F.lit(None).cast("binary").alias("extra"), F.lit(0).alias("stage"))
    gone = layout.deal(gone)

    # What a pass answers is dealt out by chunk once and read again by the later passes; a pass deals their union anew, a small part of the text.
    def exchange(sent: DataFrame, meet, stage: int) -> DataFrame:
        return layout.deal(layout.deal(sent, "bucket", n).groupBy("bucket").applyInArrow(meet, C.BLOB).withColumn("stage", F.lit(stage)))

    def ask(told: list[DataFrame], f, schema: str) -> DataFrame:
        return chunks.groupBy("chunk").cogroup(layout.deal(reduce(DataFrame.unionAll, told)).groupBy("chunk")).applyInArrow(f, schema)

    told = [gone, exchange(chunks.groupBy("chunk").applyInArrow(send_anchors, C.BLOB), meet_anchors, 1)]
    told = [*told, exchange(ask(told, send_contexts, C.BLOB), meet_contexts, 2)]
    told = [*told, exchange(ask(told, send_strings, C.BLOB), meet_strings, 3)]
    return ask(told, cut, OUT)


def _result(c: C.Chunk, repeat: np.ndarray, least: int) -> pa.Table:
    """Bytes covered by repeated strings go."""
    edge = np.zeros(c.n + least, np.int8)
    edge[: c.n] = repeat
    edge[least:] -= repeat
    gone = np.cumsum(edge[: c.n], dtype=np.int8) > 0  # at most least strings cover a byte
    spans, removed, kept = [], [], []
    for lo, hi in zip(c.offsets[:-1].tolist(), c.offsets[1:].tolist(), strict=True):
        g = gone[lo:hi]
        removed.append(int(np.count_nonzero(g)))
        if removed[-1]:
            f = np.diff(g.astype(np.int8), prepend=0, append=0)
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(f == 1), np.flatnonzero(f == -1), strict=True)])
            kept.append(c.buf[lo:hi][~g].tobytes())
        else:
            spans.append([])
            kept.append(c.buf[lo:hi].tobytes())
    return pa.table([pa.array(c.ids, pa.int64()), pa.array(np.diff(c.offsets)), pa.array(removed, pa.int64()), pa.array(spans, _OUT.field("spans").type), pa.array(kept, pa.binary())], schema=_OUT)
