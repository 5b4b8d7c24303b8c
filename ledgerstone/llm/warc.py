"""WARC archives of pages: written with one gzip member a record, read by a sequential reader.

Writing. Of pages with equal payloads the one of smallest id is a ``response`` record, which holds the payload, and the others are ``revisit`` records that
refer to it. Tasks build archives of about ``archive_bytes`` and hand each as one value to Spark's text writer, one file a value, so files reach any store that
Spark reaches and appear only once their task has committed. That writer puts a separator after each value. It is the byte 0, and the last byte of a gzip member is the top byte of its
length, 0 below 16 MB; so that byte is left to the writer, and a longer last record is followed by one byte of padding, which gzip readers skip.

Reading. An archive is walked once from front to back: a member is decompressed by pieces of bounded size, its header is parsed, its block is counted against the
stated length and hashed while it passes, and its digests are compared with the stated ones. The reader holds one piece at a time, and the payload only if it is asked for.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerstone.llm._shared import free, shared_folder, shared_table

ARCHIVE_BYTES = 16 << 20
#: Payloads below this many bytes are never revisits.
LEAST_BYTES = 100
#: Groups of equal payloads that are broadcast at most (about 100 bytes each).
BROADCAST_GROUPS = 100_000
#: Bytes that are decompressed at a time, and the longest header of a record.
PIECE, LONGEST_HEADER = 1 << 16, 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "archive string, at long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"
_RECORD = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split(" ") for x in RECORD.split(", "))])


def with_originals(pages: DataFrame, least_bytes: int = LEAST_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is the smallest id of the pages of equal payload, null for that page itself and for payloads below ``least_bytes``.

    Equal means equal SHA-256. Only digests and ids are grouped, summed in each task first. Up to BROADCAST_GROUPS groups of two or more are broadcast; beyond, the
    thousand at most that hold a thousandth of all pages each are, and the others meet their pages by a shuffle in which no key is large.
    """
    spark = pages.sparkSession
    url = F.col(url_col).cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    body = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "utf-8")
    t = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    groups = t.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    groups = shared_table(spark, groups)
    if groups.count() <= BROADCAST_GROUPS:
        met = t.join(F.broadcast(groups.select("digest", "first")), "digest", "left")
    else:
        hot = pages.count() // 1000
        met = t.join(F.broadcast(groups.where(F.col("n") > hot).select("digest", "first")), "digest", "left")
        rest = groups.where(F.col("n") <= hot).select("digest", F.col("first").alias("other"))
        own = F.when(F.col("first").isNull(), F.col("digest")).otherwise(F.concat("digest", F.lit(":"), F.coalesce(F.col("page_id").cast("string"), F.lit("-"))))  # rows that are done are dealt by id
        met = met.withColumn("own", own).join(rest.withColumnRenamed("digest", "own"), "own", "left").withColumn("first", F.coalesce("first", "other")).drop("own", "other")
    return met.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def _field(value: str) -> str:
    """A header value on one line: control characters and spaces are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record, not compressed. The block of a response is an HTTP response with the payload; that of a revisit is its header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_field(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z", **options) -> None:
    """Write a record for each page below path, a folder of any store that Spark reaches.

    Null html is an empty payload, a null url no target. Rows of equal id are records of their own; where they share a payload too, all of the smallest id
    are responses. Rows of null id refer to the smallest id of their payload, and are responses if it has none. An empty table gives no archive. An archive takes whole records, so a
    very long page makes a longer one; a page must fit a Python worker some five times. Other columns are not written. ``date`` is the WARC-Date of all records.
    """

    def build(batches):
        members, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in range(5)), strict=True):
                members.append(member(record_bytes(*(x.as_py() for x in row), date)))
                size += len(members[-1])
                if size >= archive_bytes:
                    yield archive(members)
                    members, size = [], 0
        if members:
            yield archive(members)

    def archive(members):
        body = b"".join(members)
        return pa.record_batch([pa.array([body[:-1] if body[-1] == 0 else body], pa.binary())], names=["body"])

    rows = with_originals(pages, **options).select("page_id", "url", "payload", "digest", "refers_to")
    rows.mapInArrow(build, "body binary").select(F.col("body").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


class Damaged(ValueError):
    """A record that is not what it says."""


class _Block:
    """Decompressed bytes of one member, on demand."""

    def __init__(self, data: memoryview, at: int):
        self.data, self.at, self.z, self.held = data, at, zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Holds at least one byte more, unless the member has ended."""
        before = len(self.held)
        while len(self.held) == before:
            if self.z.eof:
                return False
            tail = self.z.unconsumed_tail
            fed = tail or bytes(self.data[self.at : self.at + PIECE])
            if not tail:
                self.at += len(fed)
            try:
                got = self.z.decompress(fed, PIECE)
            except zlib.error as e:
                raise Damaged(f"gzip: {e}") from None
            if not got and not fed and not self.z.eof:
                raise Damaged("the archive ends within a record")
            self.held += got
        return True

    def take(self, most: int) -> bytes:
        if not self.held:
            self.more()
        got, self.held = self.held[:most], self.held[most:]
        return got

    def header(self) -> list[str]:
        """Lines up to an empty one."""
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            if len(self.held) > LONGEST_HEADER or not self.more():
                raise Damaged("no end of a header")
        lines, self.held = self.held[:end], self.held[end + 4 :]
        return lines.decode("utf-8", "replace").split("\r\n")

    def end(self) -> int:
        """Where the next member begins. The member must be over."""
        if self.held or self.more():
            raise Damaged("bytes after the record")
        return self.at - len(self.z.unused_data)


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _length(fields: dict[str, str]) -> int:
    if not (fields.get("content-length") or "").isdecimal():
        raise Damaged("no content length")
    return int(fields["content-length"])


def read_record(data: memoryview, at: int, with_payload: bool = False) -> tuple[dict, int]:
    """The record whose member begins at ``at``, and where the next one begins."""
    b = _Block(data, at)
    lines = b.header()
    if not lines[0].startswith("WARC/1."):
        raise Damaged("not a WARC record")
    f = _fields(lines)
    left, whole = _length(f), hashlib.sha256()

    class Http(_Block):
        def __init__(self):
            self.held = b""

        def more(self) -> bool:
            nonlocal left
            got = b.take(left) if left else b""
            if left and not got:
                raise Damaged("shorter than its content length")
            left -= len(got)
            whole.update(got)
            self.held += got
            return bool(got)

    http = Http()
    stated = _length(_fields(http.header()))
    digest, n, kept = hashlib.sha256(), 0, []
    while piece := http.take(PIECE):
        digest.update(piece)
        n += len(piece)
        if with_payload:
            kept.append(piece)
    tail = b""
    while len(tail) < 4 and (piece := b.take(4 - len(tail))):
        tail += piece
    if tail != b"\r\n\r\n":
        raise Damaged("longer than its content length")
    following = b.end()
    kind, told = f.get("warc-type"), (f.get("warc-payload-digest") or "").removeprefix("sha256:")
    if kind not in ("response", "revisit"):
        raise Damaged(f"a record of type {kind}")
    if f.get("warc-block-digest") != f"sha256:{whole.hexdigest()}":
        raise Damaged("its block has another digest")
    if kind == "response" and (n != stated or told != digest.hexdigest()):
        raise Damaged("its payload has another digest or length")
    if kind == "revisit" and (n or _page(f.get("warc-refers-to")) is None):
        raise Damaged("a revisit with a payload or without a record to refer to")
    return {
        "page_id": _page(f.get("warc-record-id")), "url": f.get("warc-target-uri"), "record_type": kind, "refers_to": _page(f.get("warc-refers-to")) if kind == "revisit" else None,
        "payload_bytes": stated, "payload_digest": told, "payload": b"".join(kept) if with_payload and kind == "response" else None, "error": None,
    }, following


def walk(content: bytes, with_payload: bool = False) -> Iterator[dict]:
    """All records of an archive in order, with the place where each begins. A damaged one is a row with an error; the walk goes on at the next member that begins with a WARC record."""
    data, at = memoryview(content), 0
    while at < len(data):
        if data[at] == 0:  # padding
            at += 1
            continue
        try:
            record, following = read_record(data, at, with_payload)
        except Damaged as e:
            record, following = dict.fromkeys(_RECORD.names) | {"error": str(e)}, _next_member(data, content, at + 1)
        yield record | {"at": at}
        at = following


def _next_member(data: memoryview, content: bytes, at: int) -> int:
    while (at := content.find(b"\x1f\x8b\x08", at)) >= 0:
        try:
            if zlib.decompressobj(31).decompress(data[at : at + 4096], 7).startswith(b"WARC/1."):
                return at
        except zlib.error:
            pass
        at += 1
    return len(data)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """RECORD rows of all archives below path: a response's length and digest are those of the payload as read, a revisit's those it states, for the payload it refers to.

    A damaged record is a row whose error says why and whose other columns but archive and place are null; the records around it are read. Folders without archives give no rows.
    """

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                for r in walk(content.as_py(), with_payload):
                    rows.append(r | {"archive": name.as_py()})
                    if len(rows) == (64 if with_payload else 4096):
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORD)


def dangling(records: DataFrame) -> DataFrame:
    """(refers_to, payload_digest) of revisits whose response is not among the records or has another digest. Each pair is compared once, however many records revisit it."""
    asked = records.where("record_type = 'revisit'").select("refers_to", "payload_digest").distinct()
    there = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest").distinct()
    return asked.join(there, ["refers_to", "payload_digest"], "left_anti")


def payloads(records: DataFrame) -> DataFrame:
    """(page_id, url, payload) of records that were read with payloads: a revisit gets that of its response. Responses that no record revisits are not shuffled.

    Payloads travel once for each thousand revisits of a response, so that one response of a third of all pages is dealt over many tasks.
    """
    visits = records.where("record_type = 'revisit'").select("page_id", "url", "refers_to", "payload_digest")
    per = visits.groupBy("refers_to", "payload_digest").agg((F.floor(F.count("*") / 1000) + 1).alias("shares"))
    first = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.first("payload").alias("payload"))
    salt = free(records.columns, "salt")
    copies = first.join(per, ["refers_to", "payload_digest"]).withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    dealt = visits.join(per, ["refers_to", "payload_digest"]).withColumn(salt, F.pmod(F.xxhash64("page_id", "url"), F.col("shares")))
    again = dealt.join(copies.drop("shares"), ["refers_to", "payload_digest", salt]).select("page_id", "url", "payload")
    return records.where("record_type = 'response'").select("page_id", "url", "payload").unionByName(again)


def archive_pages(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the pages' archives (to a new folder of the shared one, if no path is given) and read them back. A damaged record ends the job."""
    spark = pages.sparkSession
    path = path or shared_folder(spark)
    write_archives(pages, path, **options)
    return read_archives(spark, path).where(_sound(F.col("error")))


def _sound(error: Column) -> Column:
    return F.when(error.isNull(), F.lit(True)).otherwise(F.raise_error(error).cast("boolean"))
