import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from ledgerstone.llm import _chunks as C
from ledgerstone.llm.checksum_sql import crc32_sql
from ledgerstone.llm.importance import Features, drawn, importance_weights, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest=2):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), Counter(" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))


def brute(rows, target, longest=2, buckets=10_000):
    at = lambda f: zlib.crc32(f.encode()) % buckets
    raw, aim = Counter(), Counter()
    for _, t in rows:
        for f, n in features(t, longest)[1].items():
            raw[at(f)] += n
    for t in target:
        for f, n in features(t, longest)[1].items():
            aim[at(f)] += n
    s, t = sum(raw.values()), sum(aim.values())
    gain = lambda k: math.floor(1000 * math.log(((aim[k] + 1.0) * (s + buckets)) / ((raw[k] + 1.0) * (t + buckets))))
    out = []
    for d, text in rows:
        w, f = features(text, longest)
        n = sum(f.values())
        out.append((d, w, n, sum(gain(at(x)) * k for x, k in f.items()) // n if n else 0))
    return out


def key(x):
    return [(v is not None, v) for v in x]


@pytest.fixture(scope="module")
def target(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["eau", "le", "The", "ther1", "ça", "of"]) for _ in range(30)) for _ in range(12)] + [None, "", "-- --"]
    return spark.createDataFrame([(t, 1) for t in texts], "text string, _id int"), texts


@pytest.mark.parametrize("chunk_bytes", [1 << 24, 3000])
@pytest.mark.parametrize(("longest", "buckets"), [(2, 10_000), (3, 70_000), (1, 7)])
def test_weights(docs, rows, target, chunk_bytes, longest, buckets):
    got = [(r.doc_id, r.n_words, r.n_features, r.weight) for r in importance_weights(docs, target[0], longest, buckets, with_text=False, chunk_bytes=chunk_bytes).collect()]
    assert sorted(got, key=key) == sorted(brute([r[:2] for r in rows], target[1], longest, buckets), key=key)


def test_draw(docs, rows, target):
    got = resample(docs, target[0], percent=40, least_words=10).collect()
    want = []
    for d, w, n, weight in brute([r[:2] for r in rows], target[1]):
        h = int(hashlib.sha256(f"7:{d}".encode()).hexdigest()[:8], 16)
        want.append((d, w, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    assert sorted((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == sorted(want)
    able = sorted((-w[4], w[0]) for w in want if w[1] >= 10)
    assert sorted((r.rank, -r.score, r.doc_id) for r in got if r.rank) == [(i + 1, *x) for i, x in enumerate(able[: len(able) * 40 // 100])]
    kept = {r.rank: r for r in drawn(docs, target[0], percent=40, least_words=10).collect()}
    texts = {(r[0], r[1]) for r in rows}
    assert sorted(kept) == list(range(1, len(kept) + 1)) and all((r.doc_id, r.text) in texts for r in kept.values())


def test_nulls_and_empty_tables(spark, docs, none, target):
    odd = spark.createDataFrame([(None, "a b c"), (None, None), (None, "a b c"), (1, ""), (1, "x")], "doc_id long, text string")
    got = resample(odd, target[0], percent=100, least_words=1).collect()
    assert sorted(r.rank for r in got if r.rank) == [1, 2, 3] and len(got) == 5
    assert len({r.score for r in got if r.doc_id is None and r.n_words}) == 1
    assert resample(none, target[0]).collect() == []
    plain = importance_weights(docs, target[0].limit(0), with_text=False).collect()
    assert len(plain) == docs.count() and all(r.weight <= 0 or r.n_features for r in plain)


def test_long_text(spark, target):
    text = " ".join(f"w{i % 50_000}" for i in range(600_000))  # some 4 MB
    r = importance_weights(spark.createDataFrame([(1, text), (2, "w1 w2")], "doc_id long, text string"), target[0], with_text=False).collect()
    assert {(x.doc_id, x.n_words, x.n_features) for x in r} == {(1, 600_000, 1_199_999), (2, 2, 3)}


def test_features_of_a_chunk():
    texts = ["A b a b", "", "x", "b b"]
    table = pa.table([pa.array([0] * 4, pa.int32()), pa.array(range(4), pa.int64()), pa.array(range(4), pa.int64()), pa.array([t.encode() for t in texts])], names=["chunk", "doc_id", "h", "text"])
    f = Features(C.Chunk(table), 2, 5)
    got = dict(zip((s.decode() for s in f.strings.to_pylist()), f.counts().tolist(), strict=True))
    assert got == {"a": 2, "b": 4, "x": 1, "a b": 2, "b a": 1, "b b": 1}


def test_checksum_sql():
    for s in ("", "0", "123456789", "eau ça", "日本"):
        assert duckdb.sql(f"SELECT {crc32_sql('s')} FROM (SELECT '{s}' AS s)").fetchall()[0][0] == zlib.crc32(s.encode())
