import gzip
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerstone.llm import warc


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(2)
    html = [f"<p>{rng.random()}</p>" * rng.randint(1, 60) for _ in range(40)]
    rows = [(i, f"http://a b/{i}\r\nX: y", html[i % 23], i) for i in range(60)]
    rows += [(100, None, None, 1), (101, "u", "", 1), (102, "u", "short", 1), (103, "u", "short", 1), (5, "again", html[5], 1), (None, "n", html[7], 1), (None, "n", "only nulls " * 20, 1), (None, None, "only nulls " * 20, 1)]
    rows += [(200, "é", "ß" * 50, 1), (201, "é", "ß" * 50, 1), (202, "é", "s" * 99, 1), (203, "é", "s" * 99, 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)


def expected(rows, least=100):
    first = {}
    for r in rows:
        b = (r.html or "").encode()
        if len(b) >= least and r.page_id is not None:
            first[b] = min(first.get(b, r.page_id), r.page_id)
    out = []
    for r in rows:
        b = (r.html or "").encode()
        to = first.get(b) if len(b) >= least else None
        to = None if to == r.page_id else to
        out.append((r.page_id, len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to))
    return out


def key(x):
    return [(v is not None, v) for v in x]


@pytest.mark.parametrize("archive_bytes", [1 << 24, 500])
@pytest.mark.parametrize("groups", [100_000, 0])
def test_round_trip(spark, pages, tmp_path, monkeypatch, archive_bytes, groups):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", groups)  # 0: groups meet their pages by a shuffle
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages, path, archive_bytes=archive_bytes)
    records = warc.read_archives(spark, path, with_payload=True)
    rows = pages.collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records.collect()]
    assert sorted(got, key=key) == sorted(expected(rows), key=key)
    assert warc.dangling(records).count() == 0
    back = sorted(((r.page_id, bytes(r.payload)) for r in warc.payloads(records).collect()), key=key)
    assert back == sorted(((r.page_id, (r.html or "").encode()) for r in rows), key=key)


def test_files_are_archives(spark, pages, tmp_path):
    warc.write_archives(pages, f"file://{tmp_path}/w", archive_bytes=500)
    files = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-")]
    assert len(files) > 3
    for f in files:
        whole = gzip.decompress(f.read_bytes())  # by another reader
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: ") and whole.endswith(b"\r\n\r\n")
        assert b"\r\nX: y" not in whole
        records = list(warc.walk(f.read_bytes()))
        for r, following in zip(records, [*records[1:], {"at": f.stat().st_size}], strict=True):  # a member each
            z = zlib.decompressobj(31)
            z.decompress(f.read_bytes()[r["at"] : following["at"]])
            assert z.eof and z.unused_data in (b"", b"\0")


def sound(n=5):
    body = [b"x" * 300_000, b"", b"abc" * 50, b"\r\n\r\n" * 40, b"<p>"][:n]
    return [warc.member(warc.record_bytes(i, "u", b, hashlib.sha256(b).hexdigest(), None, "1970-01-01T00:00:00Z")) for i, b in enumerate(body)]


def test_damage():
    m = sound()
    ids = lambda x: [r["page_id"] if r["error"] is None else "!" for r in warc.walk(b"".join(x))]
    assert ids(m) == [0, 1, 2, 3, 4]
    assert ids([m[0], b"\0\0", m[1]]) == [0, 1]
    assert ids([]) == []
    assert ids([*m[:4], m[4][:-9]]) == [0, 1, 2, 3, "!"]  # cut off
    broken = bytearray(m[0])
    broken[len(broken) // 2] ^= 0xFF
    assert ids([m[1], bytes(broken), m[2]]) == [1, "!", 2]
    plain = zlib.decompress(m[2], 31)
    for bad, why in [
        (plain.replace(b"abcabc", b"abcabd", 1), "block"), (plain.replace(b"WARC/1.1", b"HTTP/1.1", 1), "not a WARC"), (plain[:-4], "longer"), (plain + b"x", "after"),
        (plain.replace(b"\r\n\r\nHTTP", b"1\r\n\r\nHTTP", 1), "shorter"), (plain.replace(b"Type: response", b"Type: warcinfo", 1), "type"),
    ]:
        got = list(warc.walk(m[0] + warc.member(bad) + m[1]))
        assert [r["page_id"] for r in got] == [0, None, 1] and why in got[1]["error"], (why, got[1])
    digest = warc.member(warc.record_bytes(9, None, b"abc", "0" * 64, None, "d"))
    assert "payload" in next(warc.walk(digest))["error"]


def test_long_pages_and_empty_tables(spark, pages, tmp_path):
    text = "".join(random.Random(1).choices("abcdefghij", k=17 << 20))  # a record of 16 MB or more is followed by a byte of padding
    long = spark.createDataFrame([(1, "u", text), (2, "u", "y" * 100), (3, "u", text)], "page_id long, url string, html string").coalesce(1)
    got = sorted((r.page_id, r.payload_bytes, r.record_type) for r in warc.archive_pages(long, f"file://{tmp_path}/l").collect())
    assert got == [(1, 17 << 20, "response"), (2, 100, "response"), (3, 17 << 20, "revisit")]
    assert warc.archive_pages(pages.limit(0)).collect() == []


def test_damage_ends_the_job(spark, pages, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.warc.gz").write_bytes(sound()[0][:-20])
    records = warc.read_archives(spark, f"file://{tmp_path}/d")
    assert records.where("error IS NOT NULL").count() == 1
    with pytest.raises(Exception, match="ends within|gzip"):
        records.where(warc._sound(F.col("error"))).collect()
