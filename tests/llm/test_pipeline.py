import struct
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from ledgerstone.llm import _tokens as T
from ledgerstone.llm import language_id, mixing
from ledgerstone.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import same_rows
from tests.llm.test_dedup import brute_groups
from tests.llm.test_models import WORD, base, plain_rates


def test_stages_against_brute_force(spark, docs, rows):
    columns = docs.columns
    at = docs
    model = language_id.learn(docs)
    known = P.known_language(spark, at, "")
    assert known.columns == columns
    rest = [r for r in rows if not model.predict(r[1])[2]]
    assert sorted(r.doc_id for r in known.collect()) == sorted(r[0] for r in rest)

    one = P.one_of_each_group(spark, known, "")
    assert one.columns == columns
    stay = {d for d, _, c in brute_groups(rest) if d == c}
    got = sorted(r.doc_id for r in one.collect())
    assert got == sorted(stay)
    assert len(got) < len(rest)

    safe = P.without_secrets(spark, one, "")
    assert safe.columns == columns
    before = {r.doc_id: r for r in one.collect()}
    for r in safe.collect():
        old = before[r.doc_id]
        assert ("<SECRET>" in r.text) == bool(base(old.text))
        assert base(r.text) == []
        assert r.n_chars == (len(r.text) if base(old.text) else old.n_chars)

    mixed = P.mixed(spark, safe, "")
    assert mixed.columns == columns
    chosen = {r.doc_id for r in mixing.mix(safe).collect() if r.mix_kept}
    assert {r.doc_id for r in mixed.collect()} == chosen
    others = {r[0]: r[5:] for r in rows}
    assert all(tuple(r[5:]) == others[r.doc_id] for t in (known, one, safe, mixed) for r in t.collect())  # clashing names keep their values

    pieces = P.packed(spark, mixed, "").collect()
    assert {p.doc_id for p in pieces} == chosen
    assert all(zlib.crc32(bytes(p.ids)) == p.ids_crc32 for p in pieces)


def draw(d, t):
    """Spark's xxhash64 of (17, id, text), as a number below 1."""
    h = xxhash.xxh64_intdigest(struct.pack("<i", 17), 42)
    h = xxhash.xxh64_intdigest(struct.pack("<q", d), h)
    return (xxhash.xxh64_intdigest(t.encode(), h) >> 11) / (1 << 53)


def test_run_equals_plain_loops(spark, rows, tmp_path):
    """Every stage by plain loops, one after another, to the ids that are packed."""
    rows = [r[:5] for r in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    model = language_id.learn(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    at = sorted({r for r in rows if not model.predict(r[1])[2]}, key=str)
    stay = {d for d, _, c in brute_groups(at) if d == c}
    at = [r for r in at if r[0] in stay]

    def masked(t):
        out, end = "", 0
        for start, _, stop in base(t):
            if stop > end:
                out += "" if start < end else t[end:start] + "<SECRET>"
                end = stop
        return out + t[end:]

    at = [(d, masked(t), lang, source) for d, t, lang, source, _ in at]
    topics = {r.doc_id: r.topic for r in spark.createDataFrame([r[:2] for r in at], "doc_id long, text string").select("doc_id", mixing.layout_topic(F.col("text")).alias("topic")).collect()}
    cell = lambda r: (r[3], r[2], topics[r[0]])
    tokens = lambda r: len(WORD.findall(r[1]))
    rates = plain_rates([(cell(r), tokens(r)) for r in at], 3)
    library = Tokenizer.from_file(T.default_path())
    want = Counter()
    for r in at:
        rate = rates[cell(r)] if tokens(r) else 0.0
        for _ in range(int(rate) + (draw(r[0], r[1]) < rate - int(rate))):
            want.update([(r[0], i) for i in [*library.encode(r[1], add_special_tokens=False).ids, 2]])
    got = Counter()
    for p in P.run(spark, str(tmp_path)).collect():
        got.update((p.doc_id, int.from_bytes(bytes(p.ids[i : i + 4]), "little")) for i in range(0, len(p.ids), 4))
    assert got == want
    assert len(want) > 500


def test_rows_of_equal_id_and_other_text(spark):
    x, y = (" ".join(f"{c}{i}" for i in range(40)) for c in "xy")
    rows = [(5, x, "en"), (5, y, "en"), (3, y + " more", "en"), (9, x + " more", "en"), (7, "z", "fr"), (7, "z", "en"), (None, x, "en"), (None, x, "en")]
    kept = P.one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()
    assert sorted(((r.doc_id, r.text[:1], r.lang) for r in kept), key=str) == [(3, "y", "en"), (5, "x", "en"), (7, "z", "en"), (None, "x", "en"), (None, "x", "en")]


def test_stages_on_an_empty_table(spark, none):
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, none, "").columns == none.columns
        assert stage(spark, none, "").count() == 0


def test_queries_equal_sql(spark, sf, duck):
    for name, sql in ORACLE_SQL.items():
        same_rows(QUERIES[name](spark, sf), duck, sql)

