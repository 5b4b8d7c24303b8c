import random
import re

import numpy as np
import pytest

from ledgerstone.llm import periodic_runs as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=6, times=4):
    """Stretches by comparing every word with the one a period on."""
    best = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p):
                best.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in best.items())


def collapsed(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def texts(rng):
    out = [None, "", " \n", "a", "a a a a a", "a a a a a a", "ß ß ß ß ß ß\tß", "a b a b a b a b", "a b " * 40 + "x " + "a b " * 3]
    for _ in range(150):
        w = []
        while len(w) < rng.choice([5, 40, 300]):
            unit = [rng.choice("ab") if rng.random() < 0.7 else rng.choice(["cc", "ç", "d."]) for _ in range(rng.choice([1, 1, 2, 3, 5, 12]))]
            w += unit * rng.choice([1, 1, 2, 4, 5, 9])
        out.append(rng.choice([" ", "\n", "  \t"]).join(w))
    return out


@pytest.mark.parametrize("batch_bytes", [1 << 22, 300])
@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (9, 3)])
def test_runs(spark, batch_bytes, least, times):
    rows = list(enumerate(texts(random.Random(least)))) + [(None, "x " * 9), (3, "a b " * 9), (3, "a b " * 9)]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, runs string, start int").repartition(3)
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.kept_text) for r in P.periodic_runs(docs, least, times, batch_bytes=batch_bytes).collect()]
    want = []
    for d, t in rows:
        w = WORD.findall(t or "")
        runs = brute(w, least, times)
        want.append((d, len(w), runs, collapsed(w, runs)))
    by = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    assert sorted(got, key=by) == sorted(want, key=by)
    assert sum(len(x[2]) for x in want) > 100


def test_wrong_hashes_are_found(monkeypatch):
    """With hashes that are equal for all stretches of one length, runs still come out right."""
    rng = random.Random(3)
    x = np.array([rng.randrange(3) for _ in range(80)] + [7, 8] * 12 + [rng.randrange(3) for _ in range(50)])
    bounds = np.array([0, 60, 60, len(x)])
    want = [(s + b, s + b + n, p) for b, e in zip(bounds[:-1], bounds[1:], strict=True) for s, n, p in brute(x[b:e].tolist())]
    monkeypatch.setattr(P.PrefixHashes, "equal", lambda self, a, b, n: np.ones(len(a), bool))
    assert sorted(zip(*(v.tolist() for v in P.find_runs(x, bounds)), strict=True)) == sorted(want)


def test_small_blocks(monkeypatch):
    rng = random.Random(4)
    w = [t.split() for t in texts(rng) if t]
    numbers = {x: i for i, x in enumerate({x for t in w for x in t})}
    flat, bounds = np.array([numbers[x] for t in w for x in t]), np.cumsum([0, *map(len, w)])
    whole = P.find_runs(flat, bounds)
    monkeypatch.setattr(P, "PAIRS", 7)
    assert all((a == b).all() for a, b in zip(whole, P.find_runs(flat, bounds), strict=True))


def test_long_texts(spark, none):
    same, mixed = "la " * 300_000, " ".join([f"w{i}" for i in range(100_000)] * 5 + ["end"])
    r = {x.doc_id: x for x in P.periodic_runs(spark.createDataFrame([(1, same), (2, mixed)], "doc_id long, text string")).collect()}
    assert [tuple(x) for x in r[1].runs] == [(0, 300_000, 1)] and r[1].kept_text == "la"
    assert [tuple(x) for x in r[2].runs] == [(0, 500_000, 100_000)] and r[2].kept_text.endswith("w99999 end")
    assert P.periodic_runs(none).collect() == []
