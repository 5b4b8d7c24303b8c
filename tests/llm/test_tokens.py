import array
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from ledgerstone.llm import _tokens as T
from ledgerstone.llm.packing import assign, pack
from ledgerstone.llm.token_store import WaveletMatrix, count_tokens, fetch, occurrences, read_blob, read_shards, token_digests, write_blob, write_shards
from tests.llm.test_dedup import in_order

ODD = ["don't stop 'super it's IT'S", "İ! İstanbul ΣΑΣ. ς", "á e ́x", "caf\xe9 \xa0b\x85c", "\x1cab\x1fcd", "<|endoftext|> x <|startoftext|>a", "日本語 テスト 123 ①", "ﬁ ſt K", "ÀÉ ß ẞ ŉ", "", "   ", "a­b ﻿c", "🇩🇪 ok!?", "ÿŸ ×÷ª º", "\x00 a\x00b", "plain words, 42 of them!!"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(T.default_path())
    return lambda text: array.array("I", [*t.encode(text or "", add_special_tokens=False).ids, 2])


def test_encoder_equals_library(library, rows):
    enc = T.Encoder(T.default_path(), most=50)  # a small memory is given up again and again
    texts = ODD + [r[1] for r in rows]
    assert enc.encode_many(texts, 3) == [library(t).tobytes() for t in texts]
    assert [enc.encode(t) for t in texts] == [library(t).tobytes() for t in texts]


def test_lookups_unpack_little():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 49000, 600_000).astype("<u4")
    w, _, _ = read_blob(write_blob(ids, [1], np.array([len(ids)])))
    assert w.access(123_456) == ids[123_456]
    assert w.select(int(ids[5]), 0) <= 5
    assert sum(p.opened for p in w.planes) <= 4 * len(w.planes) < sum(-(-len(p) // 8192) for p in w.planes) / 2


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
def test_wavelet_matrix(n):
    rng = random.Random(n)
    ids = [rng.randrange(70) for _ in range(n)]
    w, docs, lengths = read_blob(write_blob(np.array(ids, "<u4"), [7, None], np.array([n, 0])))
    assert (w.decode().tolist(), docs, lengths.tolist()) == (ids, [7, None], [n, 0])
    assert [w.access(i) for i in range(0, n, 13)] == ids[::13]
    for c in (0, 3, 69, 70, 1000):
        assert (w.count(c), w.occurrences(c), w.rank(c, n // 2)) == (ids.count(c), [i for i, x in enumerate(ids) if x == c], ids[: n // 2].count(c))
    assert w.select(3, n) == -1
    assert WaveletMatrix.build(np.array([1 << 20], np.uint32)).decode().tolist() == [1 << 20]


def test_store(spark, docs, rows, library, tmp_path):
    write_shards(docs, f"file://{tmp_path}/t", shard_bytes=2000)
    got = sorted(read_shards(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r.start)
    at = 0
    for r, (d, t) in zip(got, in_order(rows), strict=True):
        ids = library(t)
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids), r.ids_crc32) == (d, at, len(ids), ids.tobytes(), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_digests(docs).count() == len(rows)

    every = [t for _, text in in_order(rows) for t in library(text)]
    asked = spark.createDataFrame([(i,) for i in [*range(0, len(every), 97), 0, len(every), -1, None]], "position long")
    assert sorted(tuple(r) for r in fetch(asked, f"file://{tmp_path}/t").collect()) == sorted((i, every[i]) for i in [*range(0, len(every), 97), 0])
    assert {r.token: r.n for r in count_tokens(spark, f"file://{tmp_path}/t", [2, every[5], 60000, 2]).collect()} == {t: every.count(t) for t in (2, every[5], 60000)}
    assert sorted(r.position for r in occurrences(spark, f"file://{tmp_path}/t", [2]).collect()) == [i for i, t in enumerate(every) if t == 2]
    files = sorted(tmp_path.glob("t/part-*.parquet"))
    shards = [s for f in files for s in pq.read_table(f).column("shard").to_pylist()]
    assert shards == sorted(shards)


def test_empty_store(none):
    assert token_digests(none).count() == 0
    assert pack(none).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_assign_fills_every_sequence(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([0, 1, 5, 60, 64, 65, 200, 999]) for _ in range(rng.randint(0, 60))]
    at, room = defaultdict(int), defaultdict(int)
    for d, start, n, seq, offset in sorted(assign(lengths, 64), key=lambda p: (p[3], p[4])):
        assert offset == room[seq]
        room[seq] += n
    for d, start, n, _, _ in sorted(assign(lengths, 64)):
        assert start == at[d]
        assert n > 0
        at[d] += n
    assert [at[i] for i in range(len(lengths))] == lengths
    assert all(x == 64 or x & (x - 1) == 0 for x in room.values())


def plain_assign(lengths, length, linear=1.0, quadratic=1 / 4096):
    """The rule by plain loops: whole lengths first, then each rest, longest first, to the cheapest sequence with room, cut where there is none."""
    total = sum(lengths)
    size = [length] * (total // length) + [1 << b for b in reversed(range(20)) if total % length >> b & 1]
    used, cost, out, fresh, rest = [0] * len(size), [0.0] * len(size), [], 0, []

    def put(d, start, n, s):
        out.append((d, start, n, s, used[s]))
        used[s] += n
        cost[s] += linear * n + quadratic * n * n

    for d in sorted(range(len(lengths)), key=lambda d: -lengths[d]):
        start = 0
        while lengths[d] - start >= length and fresh < total // length:
            put(d, start, length, fresh)
            start, fresh = start + length, fresh + 1
        rest.append((d, start))
    for d, start in sorted(rest, key=lambda r: (r[1] - lengths[r[0]], r[0])):
        while start < lengths[d]:
            want = lengths[d] - start
            fits = [s for s in range(len(size)) if size[s] - used[s] >= want]
            s = min(fits, key=lambda s: (cost[s], s)) if fits else max(range(len(size)), key=lambda s: (size[s] - used[s], -s))
            n = min(want, size[s] - used[s])
            put(d, start, n, s)
            start += n
    return out


@pytest.mark.parametrize("seed", range(20))
def test_assign_equals_plain_loops(seed):
    rng = random.Random(100 + seed)
    lengths = [rng.choice([0, 1, 5, 60, 64, 65, 200, 999, rng.randint(1, 300)]) for _ in range(rng.randint(0, 80))]
    assert sorted(assign(lengths, 64)) == sorted(plain_assign(lengths, 64))


def test_a_text_beyond_a_group(spark, library):
    docs = spark.createDataFrame([(1, "word and more " * 3000), (2, "x"), (2, "x")], "doc_id long, text string")
    pieces = pack(docs, group_tokens=50).collect()
    assert sum(p.length for p in pieces) == sum(len(library(t)) for t in ("word and more " * 3000, "x", "x"))


def test_costs_are_balanced():
    rng = random.Random(1)
    cost = defaultdict(float)
    for _, _, n, seq, _ in assign([rng.randint(1, 500) for _ in range(3000)], 4096):
        cost[seq] += n + n * n / 4096
    full = sorted(cost.values())[-100:]
    assert max(full) < 1.1 * min(full)


def test_pack(docs, rows, library):
    pieces = pack(docs, group_tokens=3000).collect()
    want = defaultdict(int)
    for r in rows:
        want[r[0], library(r[1]).tobytes()] += 1
    docs_of = defaultdict(list)
    for p in pieces:
        docs_of[p.doc_id].append(p)
        assert zlib.crc32(bytes(p.ids)) == p.ids_crc32
        assert len(p.ids) == 4 * p.length
    assert sum(p.length for p in pieces) == sum(len(library(r[1])) for r in rows)
    for (d, ids), times in want.items():
        mine = docs_of[d]
        assert sum(p.length for p in mine) == times * len(ids) // 4
        assert all(ids[4 * p.start : 4 * (p.start + p.length)] == bytes(p.ids) and p.doc_tokens == len(ids) // 4 for p in mine)
    seq = defaultdict(list)
    for p in pieces:
        seq[p.sequence_id].append(p)
    for ps in seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 4096 or at & (at - 1) == 0


def test_memory_of_an_encoder_is_bounded():
    """Workers outlive a stage: what an encoder remembers stays small, and ids are the library's after it has forgotten."""
    e = T.Encoder(T.default_path())
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda i: "".join(letters[i // 26**k % 26] for k in range(5))
    texts = [" ".join(word(i * 41) for i in range(k, k + 5_000)) for k in range(0, 280_000, 5_000)]
    e.encode_many(texts[:1])
    for k in range(0, len(texts), 4):
        e.encode_many(texts[k : k + 4])
    assert len(e.memory) + len(e.old) <= 250_000
    assert e.encode_many(texts[:1])[0][:-4] == e._whole(texts[0])


def test_a_unit_is_looked_up_once_for_many_texts(library):
    class Counted(dict):
        n = 0

        def get(self, *key):
            Counted.n += 1
            return super().get(*key)

        def __getitem__(self, key):
            Counted.n += 1
            return super().__getitem__(key)

    e = T.Encoder(T.default_path())
    texts = [f"the same words again and again, été {i % 7} " * 50 for i in range(200)]
    e.encode_many(texts)
    e.memory = Counted(e.memory)
    assert e.encode_many(texts) == [library(t).tobytes() for t in texts]
    assert Counted.n < 200


def test_long_texts_and_units(library, monkeypatch):
    """A plain text beyond the arrays' size is cut at white space; a unit of many bytes isn't remembered."""
    monkeypatch.setattr(T, "TOGETHER", 40, raising=False)
    e = T.Encoder(T.default_path())
    texts = ["one two,three " * 30, "x" * 300, "a" * 50 + " b\n\n" + "Ç!" * 60 + "   ", " " * 100, "", None, "it's " + "word " * 40]
    want = [library(t).tobytes() for t in texts]
    assert e.encode_many(texts) == [e.encode(t) for t in texts] == want
    assert max(len(u) for u in [*e.memory, *e.old]) <= 64
