"""Periodic runs of words: maximal stretches that repeat with a period, found on a harmonic grid.

A run of period p and at least 4p words holds a stretch of at least 3p places whose word equals the one p places on, so one of the places 0, 3p, 6p, ... lies in it. Over
all periods that is a harmonic number of grid points, n ln(n) / 3 for n words. From each point whose word recurs p places on, the longest common extension to both
sides is found by binary search over prefix hashes, for all (period, grid point) pairs of a batch of texts at once. Equal words have equal hashes, so an extension
can only come out too long; runs are therefore compared word by word, and a text where that fails is searched again without hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerstone.llm import _chunks as C

#: Bytes of text that are searched together, pairs and words that are held at a time.
BATCH_BYTES, PAIRS = 4 << 20, 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)

OUT = "doc_id long, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, kept_text string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", _RUNS), ("kept_text", pa.string())])


class _Texts:
    """What C.Words reads: bytes of texts one after another, and their offsets."""

    def __init__(self, texts: list[bytes]):
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
        self.n = int(self.offsets[-1])
        self.buf = np.frombuffer(b"".join([*texts, b"\0" * 32]), np.uint8)


def word_numbers(t: _Texts, w: C.Words) -> np.ndarray:
    """Numbers that are equal where words are."""
    ends = np.concatenate([[0], np.cumsum(w.ends - w.starts, dtype=np.int64)])
    body = t.buf[: t.n]
    body = np.ascontiguousarray(body[~C._WS[body]])
    words = pa.Array.from_buffers(pa.large_binary(), w.n, [None, pa.py_buffer(ends), pa.py_buffer(body)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


class PrefixHashes:
    """Hashes of any stretches of a sequence of numbers, from sums of its members' hashes times powers of a base (modulo 2^64)."""

    def __init__(self, numbers: np.ndarray):
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(numbers), _BASE)]), dtype=np.uint64)
            terms = C.mix(numbers.astype(np.uint64) + np.uint64(1)) * self.power[:-1]
            self.upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n members from a hash like those from b, where a <= b."""
        with np.errstate(over="ignore"):
            return (self.upto[a + n] - self.upto[a]) * self.power[b - a] == self.upto[b + n] - self.upto[b]

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """The most members, up to a bound for each pair, that follow a and b (or come before them) alike."""
        lo, hi = np.zeros(len(a), np.int64), most.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live] + 1) // 2
            off = mid if back else 0
            same = self.equal(a[live] - off, b[live] - off, mid)
            lo[live[same]] = mid[same]
            hi[live[~same]] = mid[~same] - 1
            live = live[lo[live] < hi[live]]
        return lo


def _blocks(sizes: np.ndarray, most: int):
    """Slices of consecutive items whose sizes sum to most, or of one larger item."""
    upto, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each, one after another."""
    before = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def find_runs(numbers: np.ndarray, bounds: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of at least ``least`` words and ``times`` periods, by start and then period; numbers of text i are those from bounds[i] to bounds[i + 1]."""
    step = times - 1
    h = PrefixHashes(numbers)
    longest = np.diff(bounds) // times
    found = [np.zeros((3, 0), np.int64)]
    for d0, d1 in _blocks(longest, PAIRS):
        doc = np.repeat(np.arange(d0, d1), longest[d0:d1])
        period = _ranges(np.ones(d1 - d0, np.int64), longest[d0:d1])
        size = bounds[doc + 1] - bounds[doc]
        points = -(-(size - period) // (step * period))
        for i, j in _blocks(points, PAIRS):
            p = np.repeat(period[i:j], points[i:j])
            own = np.repeat(doc[i:j], points[i:j])
            a = bounds[own] + _ranges(np.zeros(j - i, np.int64), points[i:j]) * step * p
            same = np.flatnonzero(numbers[a] == numbers[a + p])
            a, p, own = a[same], p[same], own[same]
            fore = h.extension(a, a + p, bounds[own + 1] - a - p)
            back = h.extension(a, a + p, a - bounds[own], back=True)
            length = fore + back + p
            good = (length >= least) & (length >= times * p)
            found.append(np.unique(np.stack([a - back, a - back + length, p])[:, good], axis=1))
    start, end, period = np.unique(np.concatenate(found, axis=1), axis=1)  # by start, end and period
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    shortest = period[first][np.cumsum(first) - 1]
    start_of = np.searchsorted(bounds, start, "right") - 1
    wrong = set(start_of[period % shortest != 0].tolist())  # a stretch this long has both periods only if one divides the other
    start, end, period, start_of = start[first], end[first], period[first], start_of[first]
    for i, j in _blocks(end - start - period, PAIRS):
        at = _ranges(start[i:j], (end - start - period)[i:j])
        far = np.repeat(period[i:j], (end - start - period)[i:j])
        wrong |= set(np.repeat(start_of[i:j], (end - start - period)[i:j])[numbers[at] != numbers[at + far]].tolist())
    if wrong:
        keep = ~np.isin(start_of, sorted(wrong))
        again = [_plain_runs(numbers[bounds[d] : bounds[d + 1]], least, times) + np.array([[bounds[d]], [bounds[d]], [0]]) for d in sorted(wrong)]
        start, end, period = np.concatenate([np.stack([start, end, period])[:, keep], *again], axis=1)
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _plain_runs(x: np.ndarray, least: int, times: int) -> np.ndarray:
    """Runs of one text by comparing all words a period apart, for every period."""
    out, seen = [], set()
    for p in range(1, len(x) // times + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[False], x[:-p] == x[p:], [False]]).astype(np.int8)))
        for s, e in zip(edge[::2].tolist(), (edge[1::2] + p).tolist(), strict=True):
            if e - s >= max(least, times * p) and (s, e) not in seen:
                seen.add((s, e))
                out.append((s, e, p))
    return np.array(out, np.int64).reshape(-1, 3).T


def _joined(t: _Texts, w: C.Words, gone: np.ndarray) -> list[str]:
    """Each text's kept words, joined by one space."""
    mark = np.zeros(t.n + 1, np.int8)
    mark[w.starts[~gone]] += 1
    mark[w.ends[~gone]] -= 1
    ink = np.cumsum(mark[: t.n], dtype=np.int8) > 0
    after = np.zeros(t.n + 1, bool)
    after[w.ends[~gone]] = True
    after[t.offsets] = False  # the byte there is the next text's
    keep = ink | after[: t.n]
    out = np.where(ink, t.buf[: t.n], np.uint8(0x20))[keep].tobytes()
    ends = np.concatenate([[0], np.cumsum(keep)])[t.offsets]
    return [out[i:j].rstrip(b" ").decode() for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _rows(ids: list, texts: list[str], least: int, times: int) -> pa.RecordBatch:
    t = _Texts([x.encode() for x in texts])
    w = C.Words(t)
    start, end, period = find_runs(word_numbers(t, w), w.bounds, least, times)
    cover = np.zeros(w.n + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, end, -1)
    cut = np.searchsorted(start, w.bounds)
    begin = w.bounds[np.searchsorted(w.bounds, start, "right") - 1] if len(start) else start
    each = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start - begin, end - start, period)], names=["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), each)
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array(np.diff(w.bounds).astype(np.int64)), runs, pa.array(_joined(t, w, np.cumsum(cover[: w.n]) > 0), pa.string())], schema=_OUT)


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Each document's runs (start, length and smallest period, in words, by start and then period) and its text without repeats: doc_id, n_words, runs, kept_text.

    A run is a stretch of at least ``least`` words and ``times`` periods that no neighbouring word extends at that period. In kept_text, words that any run holds after its first
    period are gone and the others are joined by one space. Null, empty and blank texts have no words and no runs, kept_text "". Rows of equal or null id
    are documents of their own. An empty table gives no rows. Nothing is shuffled; a task holds some ``batch_bytes`` of text or one longer text, some forty times over. Other columns are ignored, whatever their names.
    """
    if times < 2 or least < 2:
        raise ValueError("least and times must be 2 or more")
    rows = docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"COALESCE(CAST(`{text_col}` AS STRING), '') AS text")

    def run(batches):
        for batch in batches:
            sizes = np.array([len(x) if (x := s.as_buffer()) is not None else 0 for s in batch.column(1)], np.int64) + 64
            for i, j in _blocks(sizes, batch_bytes):
                yield _rows(batch.column(0).slice(i, j - i).to_pylist(), batch.column(1).slice(i, j - i).to_pylist(), least, times)

    return rows.mapInArrow(run, OUT)
