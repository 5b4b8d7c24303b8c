"""Substring dedup by fixed-block anchors.

A repeated passage of ``window`` words holds, in each place where it occurs, a whole block of ``window // 2`` words that starts at a multiple of ``window // 2``.
So it suffices to index those non-overlapping blocks and to probe them with every rolling window of a block's length:

1. every chunk sends the distinct hashes of its rolling block-length windows, marked where they
   are a reference block; a bucket answers which of them meet a block elsewhere (anchor hits);
2. only windows around a hit are candidates. They are hashed with 96 bits and exchanged the same
   way; since chunks follow the document order, a bucket answers whether an earlier chunk holds it;
3. in its last pass, a chunk joins the repeated windows (earlier in another chunk or in itself) into maximal runs.

Keys are distinct per chunk, so a passage that is in a third of all documents costs one key per chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerstone.llm import _chunks as C

_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
OUT = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:long,end:long>>"


def _distinct(words: C.Words, block: int, n_buckets: int):
    """Word hashes, codes of the rolling windows of a block's length and their starts; the distinct codes, which of them are reference blocks, and which occur twice."""
    h = words.hashes()
    at = np.flatnonzero(C.inside(words.bounds, block, words.n))
    code = C.split(C.grams(h, block)[at], n_buckets)
    counts = np.maximum(np.diff(words.bounds) - block + 1, 0)
    doc_first = np.repeat(words.bounds[:-1], counts)
    ordered = np.sort(code)
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    keys = ordered[new]
    first = np.flatnonzero(new)
    twice = np.diff(first, append=len(ordered)) > 1
    is_ref = np.zeros(len(keys), bool)
    is_ref[np.searchsorted(keys, np.unique(code[(at - doc_first) % block == 0]))] = True
    return h, code, at, keys, is_ref, twice


def _candidates(words: C.Words, window: int, block: int, n_buckets: int, told: np.ndarray):
    """Starts of the windows that hold an anchor hit, with two lanes of their hash."""
    h, code, at, keys, is_ref, twice = _distinct(words, block, n_buckets)
    hits, _ = C.member(code, keys[(is_ref & twice) | (told > 0)])
    hit = np.zeros(words.n + 1, np.int32)
    hit[at[hits] + 1] = 1
    upto = np.cumsum(hit, dtype=np.int32)
    n = max(0, words.n - window + 1)
    inner = window - block + 1
    live = C.inside(words.bounds, window, words.n)
    live &= (upto[inner : inner + n] - upto[:n]) > 0
    starts = np.flatnonzero(live)
    return starts, *C.grams_at(h, window, starts)


def _order(a: np.ndarray, b: np.ndarray, n_buckets: int):
    """Distinct (bucket, a, b) in a fixed order: index of each item's group, and the group's bucket, a and low half of b."""
    b = b & np.uint64(0xFFFFFFFF)
    o = np.argsort(a, kind="stable")
    if np.any((a[o][1:] == a[o][:-1]) & (b[o][1:] != b[o][:-1])):
        o = np.lexsort((b, a))
    new = np.ones(len(o), bool)
    new[1:] = (a[o][1:] != a[o][:-1]) | (b[o][1:] != b[o][:-1])
    group = np.empty(len(o), np.int64)
    group[o] = np.cumsum(new) - 1
    first = o[new]
    bucket = (a[first] >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)  # ascends with a
    return group, bucket, a[first], b[first].astype("<u4")


def substring_dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = C.CHUNK_BYTES) -> DataFrame:
    """Remove every word covered by a window of words whose sequence also starts earlier in the corpus.

    Earlier means a smaller id, or the same document further left. Windows are judged on the input. Returns
    doc_id, n_words, n_removed, kept_text (kept words joined by one space) and spans, the maximal removed runs in words (end exclusive).

    Null and empty texts have no words: counts 0, kept_text "". Rows with a null id count as the earliest.
    Rows of equal id are separate documents in the order of Spark's xxhash64 of their text; of two equal rows the second is removed.
    Texts of fewer words than a window stay whole. A text longer than a chunk is a chunk by itself and must fit a Python worker some ten times over. An empty table gives no rows. Other columns are ignored.
    """
    if window < 2:
        raise ValueError("window must be 2 words or more")
    block = window // 2
    chunks, layout = C.chunk_docs(docs, id_col, text_col, chunk_bytes)
    n = layout.buckets(1 / 6)  # a window per word

    def send(table: pa.Table) -> pa.Table:
        c = C.Chunk(table)
        _, _, _, keys, is_ref, _ = _distinct(c.words(), block, n)
        cut = C.by_bucket(keys, n)
        low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return C.blobs([(b, c.index, C.pack_keys(low[i:j]), np.packbits(is_ref[i:j]).tobytes()) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i])

    def meet(table: pa.Table) -> pa.Table:
        rows = C.rows_of(table)
        keys = [C.unpack_keys(r[2]) for r in rows]
        refs = [np.unpackbits(np.frombuffer(r[3], np.uint8))[: len(k)] for r, k in zip(rows, keys, strict=True)]
        every, ref = np.concatenate(keys), np.concatenate(refs)
        ordered = np.sort(every)
        shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])  # keys of more than one chunk
        at, k = C.member(every, shared)
        of_ref = np.bincount(k, weights=ref[at], minlength=len(shared))[k]
        hit = np.zeros(len(every), bool)
        hit[at] = (of_ref - ref[at] > 0) | (ref[at] > 0)
        parts = np.split(hit.astype(np.uint8), np.cumsum([len(k) for k in keys])[:-1])
        return C.blobs([(r[0], r[1], None, p.tobytes()) for r, p in zip(rows, parts, strict=True)])

    def send_windows(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return C.blobs([])
        c = C.Chunk(table)
        _, a, b = _candidates(c.words(), window, block, n, C.flags(told))
        _, bucket, a, b = _order(a, b, n)
        cut = np.searchsorted(bucket, np.arange(n + 1))
        return C.blobs([(k, c.index, a[i:j].astype("<u8").tobytes(), b[i:j].tobytes()) for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i])

    def earlier(table: pa.Table) -> pa.Table:
        rows = C.rows_of(table)  # by chunk: the first of equal keys is the earliest
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
        c = C.Chunk(table)
        w = c.words()
        stage = told.column("stage").to_numpy()
        at, a, b = _candidates(w, window, block, n, C.flags(told.filter(pa.array(stage == 1))))
        group, *_ = _order(a, b, n)
        seen = C.flags(told.filter(pa.array(stage == 2)))
        n_groups = int(group.max()) + 1 if len(group) else 0
        repeat = np.ones(len(at), bool)
        if n_groups:
            _, first = np.unique(group, return_index=True)  # starts ascend, so this is the earliest here
            repeat[first] = seen[:n_groups] > 0
        cover = np.zeros(w.n + 1, np.int64)
        np.add.at(cover, at[repeat], 1)
        np.add.at(cover, at[repeat] + window, -1)
        gone = np.cumsum(cover[: w.n]) > 0
        return _result(c, w, gone)

    ask = lambda told, f, schema: chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(f, schema)
    by_bucket = lambda sent, f: layout.deal(layout.deal(sent, "bucket", n).groupBy("bucket").applyInArrow(f, C.BLOB))
    told = by_bucket(chunks.groupBy("chunk").applyInArrow(send, C.BLOB), meet)
    seen = by_bucket(ask(told, send_windows, C.BLOB), earlier)
    answers = layout.deal(told.selectExpr("*", "1 AS stage").unionAll(seen.selectExpr("*", "2 AS stage")))
    return ask(answers, cut, OUT)


def _result(c: C.Chunk, w: C.Words, gone: np.ndarray) -> pa.Table:
    """Kept bytes are those of kept words and one space in place of the byte that ends each."""
    mark = np.zeros(c.n + 1, np.int8)
    kept = ~gone
    mark[w.starts[kept]] += 1
    mark[w.ends[kept]] -= 1
    ink = np.cumsum(mark[: c.n], dtype=np.int8) > 0
    edge = np.zeros(c.n + 1, bool)
    edge[w.ends[kept]] = True
    edge[c.offsets] = False  # the byte there is the next document's
    out = np.where(ink, c.buf[: c.n], np.uint8(0x20))
    keep = ink | edge[: c.n]
    flip = np.diff(gone.astype(np.int8), prepend=0, append=0)
    texts, spans, removed = [], [], []
    for i, (lo, hi) in enumerate(zip(c.offsets[:-1], c.offsets[1:], strict=True)):
        x, y = w.bounds[i], w.bounds[i + 1]
        texts.append(out[lo:hi][keep[lo:hi]].tobytes().rstrip(b" ").decode())
        g = gone[x:y]
        removed.append(int(g.sum()))
        if removed[-1]:
            f = np.diff(g.astype(np.int8), prepend=0, append=0)
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(f == 1), np.flatnonzero(f == -1), strict=True)])
        else:
            spans.append([])
    del flip
    return pa.table([pa.array(c.ids, pa.int64()), pa.array(np.diff(w.bounds).astype(np.int64)), pa.array(removed, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, _OUT.field("spans").type)], schema=_OUT)
