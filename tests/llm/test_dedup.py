import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerstone.llm import _suffix
from ledgerstone.llm.jaccard_join import jaccard_join, t_occurrence
from ledgerstone.llm.substring_dedup import substring_dedup
from ledgerstone.llm.suffix_dedup import suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def in_order(rows):
    """By id, nulls first, then by Spark's xxhash64 of the text (seed 42, signed)."""
    h = lambda t: (xxhash.xxh64_intdigest((t or "").encode(), 42) + (1 << 63)) % (1 << 64)
    return sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, h(r[1])))


def brute_words(rows, window):
    seen, out = set(), []
    for d, t in in_order(rows):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def brute_bytes(rows, least):
    seen, out = set(), []
    for d, t in in_order(rows):
        b = (t or "").encode()
        gone, new = bytearray(len(b)), set()
        for i in range(len(b) - least + 1):
            k = b[i : i + least]
            if k in seen:
                gone[i : i + least] = b"\1" * least
            new.add(k)
        seen |= new
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def key(x):
    return [(v is not None, v) for v in x]


@pytest.mark.parametrize("chunk_bytes", [1 << 24, 2000])
@pytest.mark.parametrize("window", [20, 5])
def test_substring(docs, rows, window, chunk_bytes):
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(docs, window, chunk_bytes=chunk_bytes).collect()]
    assert sorted(got, key=key) == sorted(brute_words(rows, window), key=key)


def test_substring_spans(docs):
    for r in substring_dedup(docs, 20).collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))


@pytest.mark.parametrize("shard_bytes", [1 << 24, 2000])
def test_suffix(docs, rows, shard_bytes):
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup(docs, 50, shard_bytes=shard_bytes).collect()]
    assert sorted(got, key=key) == sorted(brute_bytes(rows, 50), key=key)


def test_suffix_other_lengths(docs, rows):
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup(docs, 31, shard_bytes=4000).collect()]
    assert sorted(got, key=key) == sorted(brute_bytes(rows, 31), key=key)


def test_suffix_kernel(spark):
    rng = np.random.default_rng(2)
    _suffix.register(spark)
    cases = []
    for _ in range(150):
        k = rng.integers(1, 5)
        cases.append([bytes(97 + rng.integers(0, k, rng.choice([0, 1, 6, 40])).astype(np.uint8)) for _ in range(rng.integers(1, 6))])
    df = spark.createDataFrame([(i, bytearray(b"".join(c)), bytearray(np.cumsum([len(x) for x in c]).astype("<u4").tobytes())) for i, c in enumerate(cases)], "i int, t binary, e binary")
    for least in (1, 3):
        for r in df.select("i", _suffix.repeats(F.col("t"), F.col("e"), least).alias("g")).collect():
            seen, want = set(), []
            for d in cases[r.i]:
                want += [d[i : i + least] in seen and i + least <= len(d) for i in range(len(d))]
                seen |= {d[i : i + least] for i in range(len(d) - least + 1)}
            assert np.unpackbits(np.frombuffer(r.g, np.uint8), count=len(want)).astype(bool).tolist() == want if want else True


def brute_groups(rows, n=5, percent=75):
    sets = []
    for d, t in in_order(rows):
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append((d, frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())))
    group = list(range(len(sets)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, (d, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and d is not None and sets[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(i), top(j)
                group[max(x, y)] = min(x, y)
    return [(d, len(s), sets[top(i)][0]) for i, (d, s) in enumerate(sets)]


@pytest.mark.parametrize("chunk_bytes", [1 << 24, 3000])
def test_jaccard(docs, rows, chunk_bytes):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join(docs, chunk_bytes=chunk_bytes).collect()]
    assert sorted(got, key=key) == sorted(brute_groups(rows), key=key)
    assert len({g[2] for g in got}) < len({g[0] for g in got}) - 5


def test_jaccard_null_ids(spark):
    t = "one two three four five six seven"
    df = spark.createDataFrame([(None, t), (None, t), (2, t), (1, t.upper()), (3, "one")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in jaccard_join(df).collect()), key=key) == [(None, None), (None, None), (1, 1), (2, 1), (3, 3)]


def test_null_ids_are_earliest(spark):
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(5, t), (None, t)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup(df).collect()} == {5: 30, None: 0}
    assert {r.doc_id: r.n_removed for r in suffix_dedup(df).collect()} == {5: len(t), None: 0}


def test_t_occurrence():
    rng = np.random.default_rng(1)
    for _ in range(200):
        lists = [sorted(set(rng.integers(0, 30, rng.integers(1, 25)).tolist())) for _ in range(rng.integers(1, 12))]
        t = int(rng.integers(1, 10))
        n = {i: sum(i in x for x in lists) for i in range(30)}
        assert t_occurrence(lists, t) == {i: c for i, c in n.items() if c >= t}


def test_empty_tables(none):
    assert [f(none).count() for f in (substring_dedup, suffix_dedup, jaccard_join)] == [0, 0, 0]
