"""Resampling documents towards a target distribution by importance weights of hashed n-grams.

Features are runs of 1 to ``longest`` words. Their strings are counted in a distributed dictionary:

1. each chunk of documents finds its distinct features and sends every group of the dictionary one blob of strings and counts, so a feature of every document is one
   string a chunk and no group is hot;
2. a group of the dictionary has all counts of its strings. It hashes each distinct string once to a bucket, sums counts by bucket, and answers every blob with its
   strings' buckets, by position;
3. bucket sums of documents and target give each bucket a gain, a log ratio of smoothed shares;
4. each chunk derives its features again and meets the answers, which makes each document's counts of buckets; gains are joined to these and summed.

Strings are told apart as strings everywhere; hashes only deal them to groups. All of it is one plan: texts are shuffled once, compressed, and read twice from the same
shuffle, and so are the answers. The gains, whose number is a parameter, are one row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ledgerstone.llm import _chunks as C
from ledgerstone.llm._shared import free, shared_table
from ledgerstone.sources.shared import positions

#: Bytes of text of a chunk; strings of a blob, of a blob at least, and of a group of the dictionary before blobs shrink (some 0.2 GB in a task).
CHUNK_BYTES = 8 << 20
BLOB_STRINGS, LEAST_STRINGS, GROUP_STRINGS = 8192, 32, 1 << 21
#: Distinct features a byte of a chunk's text, about; sets the number of groups.
PER_BYTE = 1 / 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_INK = np.zeros(256, bool)
_INK[ord("0") : ord("9") + 1] = _INK[ord("a") : ord("z") + 1] = _INK[0x80:] = True

ANSWERS = "bucket int, chunk int, codes binary, sums binary"
_ANSWERS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("codes", pa.binary()), ("sums", pa.binary())])
_SUMS = pa.schema([("code", pa.int32()), ("n", pa.int64())])
COUNTED = "doc_id long, text string, n_words long, codes array<int>"
_COUNTED = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("codes", pa.list_(pa.int32()))])


def _binary(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Strings of the given lengths that lie one after another."""
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _numbered(x: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The place of each value among the distinct ones, and those, in order of appearance."""
    d = x.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary


class Features:
    """A chunk's features: ``strings`` and ``groups`` of the distinct ones, and for each length of runs where they stand (``at``) and which they are (``which``)."""

    def __init__(self, c: C.Chunk, longest: int, n_groups: int):
        low = _LOWER[c.buf[: c.n]]
        ink = _INK[low]
        edge = np.zeros(c.n + 1, bool)
        edge[c.offsets] = True
        first, last = ink.copy(), ink.copy()
        first[1:] &= ~ink[:-1] | edge[1:-1]
        last[:-1] &= ~ink[1:] | edge[1:-1]
        starts = np.flatnonzero(first)
        self.bounds, self.n = np.searchsorted(starts, c.offsets), len(starts)
        word, distinct = _numbered(_binary(low[ink], np.flatnonzero(last) + 1 - starts))
        del low, ink, edge, first, last, starts
        hashes = _string_hashes(distinct)
        gram, own, own_hashes = word, distinct, hashes
        self.at, self.which = [np.arange(self.n)], [word]
        parts, part_hashes = [distinct], [hashes]
        for k in range(2, longest + 1):  # a run is the run without its last word, and that word
            at = np.flatnonzero(C.inside(self.bounds, k, self.n))
            before = np.zeros(self.n, np.int64)
            before[self.at[-1]] = gram
            before = before[at] * max(1, len(distinct)) + word[at + k - 1]
            place, codes = _numbered(pa.array(before))
            del before
            codes = codes.to_numpy()
            order = np.argsort(codes)  # runs that begin alike lie together and compress well
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            gram = rank[place]
            head, tail = np.divmod(codes[order], max(1, len(distinct)))
            del place, codes, order, rank
            own = pc.binary_join_element_wise(own.take(pa.array(head)), distinct.take(pa.array(tail)), pa.scalar(b" ", pa.large_binary()))
            with np.errstate(over="ignore"):
                own_hashes = C.pair(own_hashes[head], hashes[tail])
            self.at.append(at)
            self.which.append(gram + sum(len(p) for p in parts))
            parts.append(own)
            part_hashes.append(own_hashes)
        self.strings = pa.concat_arrays(parts)
        self.groups = ((np.concatenate(part_hashes) >> np.uint64(33)) % np.uint64(n_groups)).astype(np.uint32)
        self.order = np.argsort(self.groups, kind="stable")

    def counts(self) -> np.ndarray:
        return sum(np.bincount(which, minlength=len(self.strings)) for which in self.which)

    def of_documents(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A value of each distinct feature, for all features document by document, and where each document's begin and end."""
        ends = [np.searchsorted(at, self.bounds) for at in self.at]
        out = np.empty(sum(len(at) for at in self.at), value.dtype)
        upto = np.sum(ends, axis=0)
        first = upto[:-1]
        for end, which in zip(ends, self.which, strict=True):
            n = np.diff(end)
            out[np.arange(len(which)) + np.repeat(first - end[:-1], n)] = value[which]
            first = first + n
        return out, upto


def _string_hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hashes that depend on the string alone."""
    ends = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    body = np.frombuffer(strings.buffers()[2], np.uint8) if len(strings) else np.zeros(0, np.uint8)
    place = np.arange(len(body), dtype=np.int64) - np.repeat(ends[:-1], np.diff(ends))
    with np.errstate(over="ignore"):
        mixed = C.mix(body.astype(np.uint64) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        return C.mix(upto[ends[1:]] - upto[ends[:-1]])


def _lines(strings: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The strings, each followed by a line feed, which none holds, and the offsets of each."""
    lines = pc.binary_join_element_wise(strings, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
    ends = np.frombuffer(lines.buffers()[1], np.int64)[: len(lines) + 1] if len(lines) else np.zeros(1, np.int64)
    return memoryview(lines.buffers()[2] or b""), ends


@F.pandas_udf(BinaryType())
def _press(text: pd.Series) -> pd.Series:
    press = zstandard.ZstdCompressor(3).compress
    return text.map(press)


def _chunk(table: pa.Table) -> C.Chunk:
    back = zstandard.ZstdDecompressor().decompress
    return C.Chunk(table.set_column(3, "text", pa.array([back(x) for x in table.column(3).to_pylist()], pa.binary())))


class _Dictionary:
    """Chunks of a table and the dictionary of their features."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int, longest: int, buckets: int):
        placed, self.layout = C.chunk_docs(docs, id_col, text_col, chunk_bytes, dealt=False)
        self.chunks = self.layout.deal(placed.withColumn("text", _press("text")))
        self.n_groups = n_groups = max(1, -(-int(self.layout.chunk_bytes * PER_BYTE) // max(LEAST_STRINGS, min(BLOB_STRINGS, GROUP_STRINGS // self.layout.n))))
        wide = _wide(buckets)

        def send(table: pa.Table) -> pa.Table:
            c = _chunk(table)
            f = Features(c, longest, n_groups)
            counts = f.counts()[f.order].astype("<u4")
            lines, ends = _lines(f.strings.take(pa.array(f.order)))
            cut = np.searchsorted(f.groups[f.order], np.arange(n_groups + 1))
            press, index = zstandard.ZstdCompressor(6).compress, c.index
            del c, f
            return C.blobs([(g, index, press(lines[ends[i] : ends[j]]), press(counts[i:j].tobytes())) for g, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i])

        def meet(table: pa.Table) -> pa.Table:
            rows = C.rows_of(table)
            back = zstandard.ZstdDecompressor().decompress
            text = np.frombuffer(b"".join(back(r[2]) for r in rows), np.uint8)
            counts = [np.frombuffer(back(r[3]), "<u4") for r in rows]
            ends = np.flatnonzero(text == 10)
            which, distinct = _numbered(_binary(text[text != 10], np.diff(ends, prepend=-1) - 1))
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, which, np.concatenate(counts).astype(np.int64))
            code = np.fromiter(map(zlib.crc32, bytes(_lines(distinct)[0]).split(b"\n")), np.int64, len(distinct)) % buckets
            sums = np.zeros(buckets, np.int64)
            np.add.at(sums, code, total)
            some = np.flatnonzero(sums)
            told = np.stack([some, sums[some]]).astype("<i8").tobytes()
            parts = np.split(code[which].astype(wide), np.cumsum([len(n) for n in counts])[:-1])
            own = rows[0][0] % len(rows)  # the group's sums go with one of its answers
            return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([told if k == own else None for k in range(len(rows))], pa.binary())], schema=_ANSWERS)

        def gather(table: pa.Table) -> pa.Table:
            sums = np.zeros(buckets, np.int64)
            for told in table.column("sums").to_pylist():
                if told:
                    code, n = np.frombuffer(told, "<i8").reshape(2, -1)
                    sums[code] += n
            some = np.flatnonzero(sums)
            return pa.table([pa.array(some.astype(np.int32)), pa.array(sums[some])], schema=_SUMS)

        sent = self.chunks.groupBy("chunk").applyInArrow(send, C.BLOB)
        met = self.layout.deal(sent, "bucket", n_groups).groupBy("bucket").applyInArrow(meet, ANSWERS)
        self.answers = self.layout.deal(met)
        #: (code, n) of every bucket with features. Read by a function, so that the plan below stays that of the answers and is run once.
        self.sums = self.answers.groupBy("chunk").applyInArrow(gather, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _wide(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """One row: the gains of all buckets, from (code, n) of raw and target features. A gain is floor(1000 * ln) of the ratio of shares, each count raised by one."""
    none = F.lit(0).cast("long")
    each = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("code"), none.alias("s"), none.alias("t"))
    each = each.unionAll(raw.select("code", "n", none)).unionAll(target.select("code", none, "n")).groupBy("code").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    total = lambda c: (each.agg(F.sum(c)).scalar() + buckets).cast("double")
    ratio = ((F.col("t") + 1).cast("double") * total("s")) / ((F.col("s") + 1).cast("double") * total("t"))
    each = each.select("code", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))
    return each.agg(F.array_sort(F.array_agg(F.struct("code", "gain"))).alias("all")).select(F.col("all.gain").alias("gains"))


def importance_weights(docs: DataFrame, target: DataFrame, longest: int = 2, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", target_text_col: str | None = None, with_text: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Each document's importance weight: doc_id, text (null unless with_text), n_words, n_features, weight.

    Words are runs of letters a-z (A-Z lower-cased), digits and characters beyond ASCII; features are all runs of 1 to ``longest`` of them. weight is the floored mean
    of the gains of a document's features, in thousandths, and 0 for a document without words (null, empty, blank). Rows of equal or null id and
    repeated rows are documents of their own. Empty tables: no documents give no rows, an empty target has a count of 0 in every bucket. A text of any length is
    one document in one chunk, and its memory some 30 times its bytes. Other columns are ignored, whatever their names.
    """
    if longest < 1 or not 1 <= buckets <= 1 << 24:
        raise ValueError("longest must be 1 or more, buckets 1 to 2^24")
    known = _Dictionary(docs, id_col, text_col, chunk_bytes, longest, buckets)
    aim_id = free(target.columns, "_id")
    aim = _Dictionary(target.withColumn(aim_id, F.lit(0)), aim_id, target_text_col or text_col, chunk_bytes, longest, buckets)
    gains = bucket_gains(known.sums, aim.sums, buckets).scalar()  # one row of so many numbers
    n_groups, wide = known.n_groups, _wide(buckets)

    def count(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _COUNTED.empty_table()
        c = _chunk(table)
        f = Features(c, longest, n_groups)
        got = sorted(zip(*(told.column(x).to_pylist() for x in ("bucket", "codes")), strict=True), key=lambda r: r[0])
        code = np.empty(len(f.strings), np.int32)
        code[f.order] = np.frombuffer(b"".join(r[1] for r in got), wide)
        codes, upto = f.of_documents(code)
        texts = pa.array([x.decode() for x in c.texts] if with_text else [None] * len(c.ids), pa.string())
        return pa.table([pa.array(c.ids, pa.int64()), texts, pa.array(np.diff(f.bounds), pa.int64()), pa.LargeListArray.from_arrays(pa.array(upto), pa.array(codes)).cast(_COUNTED.field("codes").type)], schema=_COUNTED)

    rows = known.chunks.groupBy("chunk").cogroup(known.answers.groupBy("chunk")).applyInArrow(count, COUNTED)
    n = F.size("codes").cast("long")
    total = F.aggregate("codes", F.lit(0).cast("long"), lambda sum_, k: sum_ + F.get("gains", k))
    floored = F.expr("(total - pmod(total, n_features)) DIV n_features")
    rows = rows.select("*", gains.alias("gains")).select("doc_id", "text", "n_words", n.alias("n_features"), total.alias("total"))
    return rows.select("doc_id", "text", "n_words", "n_features", F.when(F.col("n_features") > 0, floored).otherwise(0).cast("long").alias("weight"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Draw ``percent`` of the documents of ``least_words`` or more, without replacement, with chances by importance weight: all documents with score and rank.

    The score is the weight plus a Gumbel draw in thousandths, so the highest scores are such a sample. rank is 1, 2, 3 ... by score and then id (null first) over the
    drawn ones and null for the others. The draw is a hash of seed and id: the same on every run, equal for rows of equal id; rows of null id
    hash the seed alone. Ties in score and id rank in an order of the texts' hashes. Options and the remaining columns are those of importance_weights; an empty
    table gives no rows.
    """
    rows = importance_weights(docs, target, id_col=id_col, text_col=text_col, **options)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0))).cast("long")
    rows = shared_table(docs.sparkSession, rows.withColumn("score", F.col("weight") + gumbel))
    able = rows.where(F.col("n_words") >= least_words)
    most = able.count() * percent // 100
    ranked = positions(able, F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.xxhash64("text", "n_words", "n_features", "weight"), name="rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank").cast("long")))
    return ranked.unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """(doc_id, text, rank) of the drawn documents."""
    return resample(docs, target, **options).where("rank IS NOT NULL").select("doc_id", "text", "rank")
