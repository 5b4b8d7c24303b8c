"""Exact top-k search by inner product, pruning ranges and blocks of vectors.

Vectors are rounded down to integers (``floor(scale * x)``), so scores are exact. Vectors lie in id order in ranges, whose number follows from the rows and not from Spark's partitions, and ranges in blocks of ``BLOCK_ROWS`` rows. Either keeps, for each
term (dimension), its largest and smallest value; a block keeps its rows as a forward index. For a query, a bound is the sum over terms of the larger of
weight x maximum and weight x minimum. A range is searched block at a time: every query visits blocks by descending bound and scores them whole, until the bound falls below its
k-th best score; equal bounds are still visited, because ties go to the smaller id. Queries that are at the same block are scored together, by one product of matrices.

Three steps share one bound among ranges:

1. each batch of queries meets the ranges' maxima only, and each query is sent to the range of largest bound, its home;
2. its k-th best score there is its floor;
3. each batch meets the maxima again, and a query goes to those ranges only whose bound reaches its floor, and takes the floor with it.

So vectors are copied as far as bounds let them matter. Where they don't prune (vectors in all directions alike), every query must meet every range, and the cost is that of all
products; then each range of up to ``MOST_ROWS`` rows gives at most k rows for a query.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerstone.llm._chunks import MOST_TASKS, place
from ledgerstone.llm._shared import shared_table

BATCH_ROWS, BLOCK_ROWS, LEAST_ROWS, MOST_ROWS, RANGES = 2048, 128, 1024, 1 << 19, 32
#: Ranges whose maxima meet a batch in one task.
_GROUP = 1024
_NONE = np.iinfo(np.int64).min
_TOP, _LOW = (1 << 63) - 1, -(1 << 63)


def finite_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id long, v array<double>) of the rows whose id is known and whose vector is not null and holds no null, NaN or infinity. Other columns are left out."""
    v = F.col(vector_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return table.where(ok).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def floors(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x): 64-bit integers, or Python's where those don't hold them."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not y.size or np.abs(y).max() < 1 << 62:
        return y.astype(np.int64)
    exact = lambda a, b: math.floor(Fraction(a) * Fraction(scale)) if math.isinf(b) else int(b)
    return np.array([exact(a, b) for a, b in zip(x.ravel().tolist(), y.ravel().tolist(), strict=True)], object).reshape(x.shape)


def to_bytes(v: np.ndarray, x: np.ndarray) -> tuple[str, bytes]:
    """Integers in the narrowest type that holds them; beyond 64 bits, the numbers they come from."""
    if v.dtype == object:
        return "x", x.astype("<f8").tobytes()
    big = int(np.abs(v).max(initial=0))
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if big <= np.iinfo(k).max)
    return kind, v.astype(kind).tobytes()


def from_bytes(kind: str, b: bytes, n: int, dim: int, scale: float) -> np.ndarray:
    if kind == "x":
        return floors(np.frombuffer(b, "<f8").reshape(n, dim), scale)
    return np.frombuffer(b, kind).reshape(n, dim).astype(np.int64)


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Largest possible product of each query with anything between low and high; infinite where floating point would not be exact."""
    if q.dtype == object or high.dtype == object:
        return np.full((len(q), len(high)), np.inf)
    q, high, low = (a.astype(np.float64) for a in (q, high, low))
    with np.errstate(all="ignore"):
        out = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        out[~(np.abs(q) @ np.maximum(np.abs(high), np.abs(low)).T < 1 << 52)] = np.inf
    return out


class Range:
    """Rows in id order, in blocks with term maxima and minima. first: of rows of equal id and vector, the one that stands for a query's own."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, block: int = BLOCK_ROWS):
        self.ids, self.rows = ids, rows
        self.cuts = np.append(np.arange(0, len(rows), block), len(rows))
        self.high = np.stack([rows[a:b].max(axis=0) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)])
        self.low = np.stack([rows[a:b].min(axis=0) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)])
        self.wide = rows.astype(np.float64) if rows.dtype != object else None

    def own(self, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Place of the first row equal to each query in id and vector, or -1."""
        out = np.full(len(ids), -1)
        lo, hi = np.searchsorted(self.ids, ids, side="left"), np.searchsorted(self.ids, ids, side="right")
        for i in np.flatnonzero(hi > lo):
            same = np.flatnonzero((self.rows[lo[i] : hi[i]] == q[i]).all(axis=1))
            if len(same):
                out[i] = lo[i] + same[0]
        return out

    def search(self, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[list[list[tuple[int, int]]], np.ndarray]:
        """Per query its k best (place, score) of at least its floor without its own place, ties to the smaller place; and the number of blocks scored."""
        n, dim = self.rows.shape
        big = max(1, dim) * int(np.abs(q).max(initial=0)) * int(np.abs(self.rows).max(initial=0))
        if self.wide is None or q.dtype == object or big >= 1 << 52 or (big + 1) * n >= 1 << 62:
            return self._plain(q, own, floor, k), np.full(len(q), len(self.cuts) - 1)
        wide, bound = q.astype(np.float64), bounds(q, self.high, self.low)
        order = np.argsort(-bound, axis=1, kind="stable")
        best, least, seen = np.full((len(q), k), _NONE), np.maximum(floor, -(2.0**53)), np.zeros(len(q), np.int64)  # above the -inf of an own place
        live = np.arange(len(q))
        for t in range(len(self.cuts) - 1):
            at = order[live, t]
            go = bound[live, at] >= least[live]
            live, at = live[go], at[go]
            if not len(live):
                break
            seen[live] += 1
            by = np.argsort(at, kind="stable")
            for some in np.split(by, np.flatnonzero(np.diff(at[by])) + 1):
                sel, b = live[some], at[some[0]]
                lo, hi = self.cuts[b], self.cuts[b + 1]
                score = wide[sel] @ self.wide[lo:hi].T
                mine = np.flatnonzero((own[sel] >= lo) & (own[sel] < hi))
                score[mine, own[sel[mine]] - lo] = -np.inf
                good = score >= least[sel][:, None]
                rows = np.flatnonzero(good.any(axis=1))
                if not len(rows):
                    continue
                code = np.where(good[rows], score[rows], 0).astype(np.int64) * n + (n - 1 - np.arange(lo, hi))
                code[~good[rows]] = _NONE
                code = np.concatenate([best[sel[rows]], code], axis=1)
                code = np.partition(code, code.shape[1] - k, axis=1)[:, code.shape[1] - k :]
                best[sel[rows]] = code
                kth = code.min(axis=1)
                full = kth > _NONE
                least[sel[rows[full]]] = np.maximum(least[sel[rows[full]]], kth[full] // n)
        best.sort(axis=1)
        return [[(int(n - 1 - c % n), int(c // n)) for c in row[::-1] if c > _NONE] for row in best], seen

    def _plain(self, q, own, floor, k):
        """The same by whole Python integers, for numbers beyond floating point."""
        rows, out = self.rows.astype(object), []
        for v, o, f in zip(q.astype(object), own.tolist(), floor.tolist(), strict=True):
            score = [(-s, i) for i, s in enumerate((rows * v).sum(axis=1).tolist() if len(v) else [0] * len(rows)) if i != o and s >= f]
            out.append([(i, -s) for s, i in sorted(score)[:k]])
        return out


def _big(score: int) -> str | None:
    """Order of scores beyond a long, as text."""
    if _LOW <= score <= _TOP:
        return None
    digits = str(abs(score))
    return f"{len(digits):05d}{digits}" if score > 0 else f"{99999 - len(digits):05d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


_RANGE = "r long, dim int, n int, high binary, low binary, kind string, ids binary, rows binary"
_RANGE_ARROW = pa.schema([("r", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("high", pa.binary()), ("low", pa.binary()), ("kind", pa.string()), ("ids", pa.binary()), ("rows", pa.binary())])
_BATCH = "b int, dim int, n int, kind string, ids binary, marks binary, rows binary"
_BATCH_ARROW = pa.schema([("b", pa.int32()), ("dim", pa.int32()), ("n", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("marks", pa.binary()), ("rows", pa.binary())])
_SENT = "r long, b int, dim int, n int, kind string, ids binary, marks binary, rows binary, places binary, floor binary"
_SENT_ARROW = pa.schema([("r", pa.int64()), *_BATCH_ARROW, ("places", pa.binary()), ("floor", pa.binary())])


def _arrays(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the lists and all their numbers."""
    return np.asarray(column.value_lengths(), np.int64), column.flatten().to_numpy(zero_copy_only=False)


def cut_ranges(keys: DataFrame, range_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Last (id, h) of every range of at least range_rows rows, but for the last one, and about a quarter more at most.

    Every partition of the sorted keys reports each quarter of a range and its end; the driver gets these reports only, and joins them to ranges in order.
    """
    step = max(1, range_rows // 4)
    found = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("n", pa.int64())])

    def ends(batches):
        n, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = np.arange(step - 1 - n % step, len(ids), step)
            if len(at):
                yield pa.record_batch([pa.array(ids[at]), pa.array(h[at]), pa.array(np.full(len(at), step))], schema=found)
            n, last = n + len(ids), (ids[-1], h[-1])
        if n % step:
            yield pa.record_batch([pa.array([last[0]]), pa.array([last[1]]), pa.array([n % step])], schema=found)

    told = keys.repartitionByRange("id", "h").sortWithinPartitions("id", "h").mapInArrow(ends, "id long, h long, n long").toArrow()
    cuts, held = [], 0
    rows = sorted(zip(*(told.column(c).to_pylist() for c in ("id", "h", "n")), strict=True))
    for i, (key, h, n) in enumerate(rows):
        held += n
        if held >= range_rows or i == len(rows) - 1:
            cuts, held = [*cuts, (key, h)] if not cuts or cuts[-1] != (key, h) else cuts, 0
    return np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)


def index(candidates: DataFrame, range_rows: int, scale: float) -> DataFrame:
    """Ranges of about range_rows rows of one length each, in id order, with their maxima and forward index. Rows of equal id and rounded vector lie in one range, unless they are more than twice range_rows."""
    keyed = candidates.select("id", F.xxhash64(F.transform("v", lambda x: F.floor(x * scale))).alias("h"), "v")
    cut_ids, cut_hashes = cut_ranges(keyed.select("id", "h"), range_rows)

    @F.pandas_udf("int")
    def where(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(place(ids.to_numpy(), hashes.to_numpy(), cut_ids, cut_hashes))

    def build(batches):
        from pyspark import TaskContext

        at, held = TaskContext.get().partitionId() << 24, {}

        def flush(dim):
            nonlocal at
            ids, x = (np.concatenate(p) for p in zip(*held.pop(dim), strict=True))
            x = x.reshape(len(ids), dim)
            v = floors(x, scale)
            order = sorted(range(len(ids)), key=lambda i: (ids[i], v[i].tolist())) if (np.diff(ids) == 0).any() else slice(None)
            ids, x, v = ids[order], x[order], v[order]
            kind, raw = to_bytes(v, x)
            edge = np.full(dim, np.inf) if kind == "x" else None
            high, low = (v.max(axis=0), v.min(axis=0)) if edge is None else (edge, -edge)
            at += 1
            return pa.record_batch([[at - 1], pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), [high.astype("<f8").tobytes()], [low.astype("<f8").tobytes()], [kind], [ids.astype("<i8").tobytes()], [raw]], schema=_RANGE_ARROW)

        now = None
        for batch in batches:
            ranges, ids, (sizes, flat) = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _arrays(batch.column(2))
            starts = np.cumsum(sizes) - sizes
            for part in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(ranges)) + 1):
                if not len(part):
                    continue
                if ranges[part[0]] != now:
                    for dim in list(held):
                        yield flush(dim)
                    now = ranges[part[0]]
                for dim in np.unique(sizes[part]).tolist():
                    some = part[sizes[part] == dim]
                    held.setdefault(dim, []).append((ids[some], flat[(starts[some][:, None] + np.arange(dim)).ravel()]))
                    if sum(len(h[0]) for h in held[dim]) >= 2 * range_rows:
                        yield flush(dim)
        for dim in list(held):
            yield flush(dim)

    dealt = keyed.select(where("id", "h").alias("r"), "id", "h", "v").repartitionById(max(1, min(len(cut_ids), MOST_TASKS)), "r")
    return dealt.sortWithinPartitions("r", "id", "h").select("r", "id", "v").mapInArrow(build, _RANGE)


def search(queries: DataFrame, candidates: DataFrame, k: int = 20, scale: float = 64.0, range_rows: int | None = None, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """The k best candidates of every query by inner product: query_id, rank (from 1), vec_id, score.

    Both tables are (id, v) as finite_vectors gives them. A query's own row (one row of equal id and vector) is no candidate for it. Only vectors of one length meet;
    vectors of length 0 score 0. Fewer than k candidates give fewer rows. Rows of equal id are separate vectors: a candidate id may occur twice for a
    query, and each row of a repeated query id is a query, with ranks of its own. Ties go to the smaller id. Empty tables give no rows. Any finite number takes
    part; scores are compared exactly, and one beyond a long is returned as the nearest long.
    """
    spark = queries.sparkSession
    range_rows = range_rows or max(LEAST_ROWS, min(MOST_ROWS, math.ceil(candidates.count() / RANGES)))
    ranges = shared_table(spark, index(candidates, range_rows, scale))
    q = queries.groupBy("id", "v").agg(F.count("*").alias("times")).withColumn("mark", F.xxhash64("id", "v"))
    n_b = max(1, math.ceil(q.count() / batch_rows))
    times = q.select(F.col("id").alias("query_id"), "mark", "times")

    def batch(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, marks = table.column("id").to_numpy(), table.column("mark").to_numpy()
        sizes, flat = _arrays(table.column("v").combine_chunks() if table.num_rows else table.column("v"))
        starts, out = np.cumsum(sizes) - sizes, []
        for dim in np.unique(sizes).tolist():
            m = np.flatnonzero(sizes == dim)
            x = flat[(starts[m][:, None] + np.arange(dim)).ravel()].reshape(len(m), dim)
            kind, raw = to_bytes(floors(x, scale), x)
            out.append((table.column("b")[0].as_py(), dim, len(m), kind, ids[m].astype("<i8").tobytes(), marks[m].astype("<i8").tobytes(), raw))
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), _BATCH_ARROW.types, strict=True)], schema=_BATCH_ARROW)

    batches = shared_table(spark, q.select("id", "v", "mark", F.pmod(F.xxhash64("mark", F.lit(4)), F.lit(n_b)).cast("int").alias("b")).groupBy("b").applyInArrow(batch, _BATCH))
    n_g = max(1, math.ceil(ranges.count() / _GROUP))
    maxima = ranges.select("r", "dim", "high", "low", F.pmod(F.xxhash64("r"), F.lit(n_g)).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(n_b - 1))).alias("b"))

    def send(home: bool):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out, right = [], right.to_pylist()
            for row in left.to_pylist():
                near = sorted((r for r in right if r["dim"] == row["dim"]), key=lambda r: r["r"])
                if not near:
                    continue
                v = from_bytes(row["kind"], row["rows"], row["n"], row["dim"], scale)
                x = np.frombuffer(row["rows"], "<f8").reshape(v.shape) if row["kind"] == "x" else v
                edge = [np.frombuffer(b"".join(r[e] for r in near), "<f8").reshape(len(near), row["dim"]) for e in ("high", "low")]
                reach = bounds(v, *edge)
                floor = np.full(row["n"], -np.inf)
                if home:
                    goes = np.zeros(reach.shape, bool)
                    goes[np.arange(row["n"]), np.argmax(reach, axis=1)] = True
                else:
                    for f in row["floors"] or []:
                        floor[f["place"]] = max(floor[f["place"]], f["kth"])
                    goes = reach >= floor[:, None]
                ids, marks = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["marks"], "<i8")
                for j in np.flatnonzero(goes.any(axis=0)):
                    m = np.flatnonzero(goes[:, j])
                    kind, raw = to_bytes(v[m], x[m])
                    out.append((near[j]["r"], row["b"], row["dim"], len(m), kind, ids[m].tobytes(), marks[m].tobytes(), raw, m.astype("<i4").tobytes(), floor[m].astype("<f8").tobytes()))
            return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(_SENT_ARROW.types)], schema=_SENT_ARROW)

        return run

    def met(batches: DataFrame, home: bool) -> DataFrame:
        """Queries beside the ranges they are sent to."""
        left = batches.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_g - 1))))
        sent = left.groupBy("b", "g").cogroup(maxima.groupBy("b", "g")).applyInArrow(send(home), _SENT)
        mine = ranges.select("r", F.col("n").alias("r_n"), F.col("kind").alias("r_kind"), F.col("ids").alias("r_ids"), F.col("rows").alias("r_rows"))
        return sent.join(mine, "r")

    def each(batches):
        """Every pair of a range and the queries sent to it, searched."""
        for pairs in batches:
            for j in range(pairs.num_rows):
                p = {c: pairs.column(c)[j].as_py() for c in pairs.schema.names}
                here = Range(np.frombuffer(p["r_ids"], "<i8"), from_bytes(p["r_kind"], p["r_rows"], p["r_n"], p["dim"], scale))
                v, ids = from_bytes(p["kind"], p["rows"], p["n"], p["dim"], scale), np.frombuffer(p["ids"], "<i8")
                yield p, here, ids, here.search(v, here.own(ids, v), np.frombuffer(p["floor"], "<f8"), k)[0]

    floor_arrow = pa.schema([("b", pa.int32()), ("dim", pa.int32()), ("place", pa.int32()), ("kth", pa.float64())])

    def floor_of(batches):
        for p, _, _, found in each(batches):
            rows = [(int(i), float(max(_LOW, min(_TOP, f[-1][1])))) for i, f in zip(np.frombuffer(p["places"], "<i4"), found, strict=True) if len(f) >= k and abs(f[-1][1]) < 1 << 52]
            yield pa.record_batch([pa.array([p["b"]] * len(rows), pa.int32()), pa.array([p["dim"]] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64())], schema=floor_arrow)

    hit = pa.schema([("query_id", pa.int64()), ("mark", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("big", pa.string())])

    def hits(batches):
        for p, here, ids, found in each(batches):
            n, marks = [len(f) for f in found], np.frombuffer(p["marks"], "<i8")
            flat = [x for f in found for x in f]
            yield pa.record_batch([pa.array(np.repeat(ids, n)), pa.array(np.repeat(marks, n)), pa.array(here.ids[np.array([x[0] for x in flat], np.int64)]), pa.array([max(_LOW, min(_TOP, x[1])) for x in flat], pa.int64()), pa.array([_big(x[1]) for x in flat], pa.string())], schema=hit)

    known = met(batches, True).mapInArrow(floor_of, "b int, dim int, place int, kth double").groupBy("b", "dim").agg(F.collect_list(F.struct("place", "kth")).alias("floors"))
    best = met(batches.join(known, ["b", "dim"], "left"), False).mapInArrow(hits, "query_id long, mark long, vec_id long, score long, big string")
    rank = F.row_number().over(Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), F.desc_nulls_last("big"), "vec_id"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= k).join(times, ["query_id", "mark"])
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("query_id", "rank", "vec_id", "score")
