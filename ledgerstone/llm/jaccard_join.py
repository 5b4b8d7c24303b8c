"""Exact similarity self-join of documents on word n-grams, by T-occurrence search.

Two documents link when the Jaccard similarity of their sets of distinct n-grams is at least ``percent`` / 100. The join runs in steps that lose no link:

1. Equal sets are one class, found by a 128-bit signature; the smallest row stands for it.
2. Chunks exchange their distinct n-grams and learn each one's document frequency to the nearest power of two. An n-gram of one class
   only can't be shared; a class with too few shared n-grams for the threshold links with nothing and is done.
3. The other classes order their shared n-grams from rare to frequent and post the shortest prefixes that any link must meet in: of a set of n, the smaller
   of a linked pair shares one of its first n - ceil(6n/7) + 1 (for 75 percent) with the first n - ceil(3n/4) + 1 of the larger, own n-grams counted first.
4. Star round: in each posting list the smallest indexed class is tested against the others. A group of near copies thus costs rows in proportion to its size,
   and most of it is one component afterwards.
5. Rest round: only pairs of *different* components that meet in a list, and that their places there still allow to reach the overlap, are tested.

Tests are T-occurrence searches: candidates are dealt to blocks of even size, each block indexes its sets by n-gram, and every
query of the block merges the short lists with a heap, keeps ids that occur often enough to reach T with the L longest lists' help, and looks them up in those by binary search (DivideSkip).
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerstone.llm import _chunks as C
from ledgerstone.llm._components import components
from ledgerstone.llm._shared import release, shared_table

_SIG = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("sa", pa.int64()), ("sb", pa.int64())])
_SET = pa.schema([("rid", pa.int64()), ("n", pa.int64()), ("own", pa.int64()), ("tokens", pa.list_(pa.int64()))])


class Sets:
    """Distinct n-gram hashes of each document of a chunk, ascending, one after another."""

    def __init__(self, chunk: C.Chunk, k: int):
        w = chunk.words(lower=True)
        h = w.hashes()
        g = C.grams(h, k)
        parts = []
        for x, y in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
            parts.append(C.distinct(g[x : y - k + 1]) if y - x >= k else C.grams(h[x:y], y - x) if y > x else g[:0])
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.flat = np.concatenate([*parts, np.zeros(0, np.uint64)])
        self.of = np.repeat(np.arange(len(parts)), self.sizes)

    def signatures(self) -> tuple[np.ndarray, np.ndarray]:
        out = []
        with np.errstate(over="ignore"):
            for salt in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
                s = np.zeros(len(self.sizes), np.uint64)
                np.add.at(s, self.of, C.mix(self.flat ^ np.uint64(salt)))
                out.append(s.view(np.int64))
        return out[0], out[1]


def t_occurrence(lists: list[list[int]], t: int, mu: float = 0.02) -> dict[int, int]:
    """Ids in at least t of the ascending lists, with their counts, by DivideSkip."""
    if len(lists) < t or t < 1:
        return {}
    lists = sorted(lists, key=len)
    long = min(t - 1, int(t / (mu * math.log2(len(lists[-1]) + 1) + 1)), len(lists))
    short, tail = lists[: len(lists) - long], lists[len(lists) - long :]
    out, last, count = {}, None, 0

    def close() -> None:
        if count < t - long:
            return
        n = count
        for i, one in enumerate(tail):
            if n + len(tail) - i < t:
                return
            at = bisect_left(one, last)
            n += at < len(one) and one[at] == last
        if n >= t:
            out[last] = n

    for x in heapq.merge(*short):
        if x == last:
            count += 1
        else:
            close()
            last, count = x, 1
    close()
    return out


def jaccard_join(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = C.CHUNK_BYTES // 2) -> DataFrame:
    """Per document doc_id, n_shingles (set size), component_id (smallest id reachable by links), and Spark's xxhash64 of its own text and of that of the row that the component is named after (text_hash, component_hash).

    Words are runs other than ASCII white space, A-Z lower-cased. Fewer than n words are one n-gram. Null, empty and blank texts have no set
    and link with nothing. Rows of equal id are separate documents, told apart by text_hash. A row with a null id links with nothing and has a null component. An empty table gives no rows.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    spark = docs.sparkSession
    chunks, layout = C.chunk_docs(docs, id_col, text_col, chunk_bytes)
    buckets = layout.buckets(1 / 6)  # an n-gram per word

    def sign(table: pa.Table) -> pa.Table:
        c = C.Chunk(table)
        s = Sets(c, n)
        a, b = s.signatures()
        rid = (np.int64(c.index) << np.int64(32)) + np.arange(len(c.ids))
        release()
        return pa.table([pa.array(rid), pa.array(c.ids, pa.int64()), pa.array(c.hashes, pa.int64()), pa.array(s.sizes), pa.array(a), pa.array(b)], schema=_SIG)

    base = shared_table(spark, chunks.groupBy("chunk").applyInArrow(sign, "rid long, doc_id long, h long, n long, sa long, sb long"))
    live = base.where("n > 0 AND doc_id IS NOT NULL")
    reps = shared_table(spark, live.groupBy("sa", "sb", "n").agg(F.min("rid").alias("rep")))
    first = reps.select(F.shiftright("rep", 32).cast("int").alias("chunk"), F.col("rep").alias("rid"))

    def mine(c: C.Chunk, table: pa.Table, s: Sets) -> np.ndarray:
        """Mask over the flat n-grams: those of documents that stand for their class."""
        stands = np.zeros(len(c.ids), bool)
        stands[table.column("rid").to_numpy() & 0xFFFFFFFF] = True
        return stands[s.of]

    def send(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return C.blobs([])
        c = C.Chunk(table)
        s = Sets(c, n)
        code = np.sort(C.split(s.flat[mine(c, told, s)], buckets))
        new = np.ones(len(code), bool)
        new[1:] = code[1:] != code[:-1]
        keys, count = code[new], np.minimum(255, np.diff(np.flatnonzero(new), append=len(code))).astype(np.uint8)
        cut = C.by_bucket(keys, buckets)
        low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return C.blobs([(b, c.index, C.pack_keys(low[i:j]), count[i:j].tobytes()) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i])

    def frequencies(table: pa.Table) -> pa.Table:
        rows = C.rows_of(table)
        keys = [C.unpack_keys(r[2]) for r in rows]
        every = np.concatenate(keys)
        count = np.concatenate([np.frombuffer(r[3], np.uint8) for r in rows]).astype(np.int64)
        ordered = np.sort(every)
        shared = C.distinct(np.concatenate([ordered[1:][ordered[1:] == ordered[:-1]], every[count > 1]]))
        at, k = C.member(every, shared)
        total = np.bincount(k, weights=count[at], minlength=len(shared))
        level = np.zeros(len(every), np.uint8)
        level[at] = np.maximum(1, np.ceil(np.log2(np.maximum(total, 2)))).astype(np.uint8)[k]
        parts = np.split(level, np.cumsum([len(k) for k in keys])[:-1])
        return C.blobs([(r[0], r[1], None, p.tobytes()) for r, p in zip(rows, parts, strict=True)])

    def survivors(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _SET.empty_table()
        c = C.Chunk(table)
        s = Sets(c, n)
        kind = np.array(told.column("stage").to_pylist(), np.int64)
        here = mine(c, told.filter(pa.array(kind == 0)), s)
        flat, of = s.flat[here], s.of[here]
        code = C.split(flat, buckets)
        keys = C.distinct(code)
        level = C.flags(told.filter(pa.array(kind == 1)))
        known = level > 0
        at, k = C.member(code, keys[known])
        shared = np.bincount(of[at], minlength=len(c.ids))
        enough = 100 * shared >= percent * s.sizes
        enough[s.sizes == 0] = False
        at, k = at[enough[of[at]]], k[enough[of[at]]]
        doc, token = of[at], flat[at]
        order = np.lexsort((token, level[known][k], doc))
        doc, token = doc[order], token[order].view(np.int64)
        docs_here = C.distinct(doc)
        offsets = np.append(np.searchsorted(doc, docs_here), len(doc)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(token))
        rid = (np.int64(c.index) << np.int64(32)) + docs_here
        release()
        return pa.table([pa.array(rid), pa.array(s.sizes[docs_here]), pa.array(s.sizes[docs_here] - shared[docs_here]), lists], schema=_SET)

    first = layout.deal(first)
    got = chunks.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(send, C.BLOB)
    levels = layout.deal(got, "bucket", buckets).groupBy("bucket").applyInArrow(frequencies, C.BLOB)
    answers = levels.selectExpr("chunk", "bucket", "payload", "extra", "CAST(NULL AS BIGINT) AS rid", "1 AS stage").unionAll(first.selectExpr("chunk", "0", "CAST(NULL AS BINARY)", "CAST(NULL AS BINARY)", "rid", "0"))
    answers = layout.deal(answers)
    sets = shared_table(spark, chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(survivors, "rid long, n long, own long, tokens array<long>"))
    links = link_sets(sets, percent)
    comp = components(links)
    # Ids of the rows that a component or class is named after; one row each.
    label = reps.join(comp, reps.rep == comp.node, "left")
    label = label.select("sa", "sb", "n", F.coalesce("comp", "rep").alias("top"))
    names = base.select(F.col("rid").alias("top"), F.col("doc_id").alias("component_id"), F.col("h").alias("component_hash"))
    label = shared_table(spark, label.join(names, "top").select("sa", "sb", "n", "component_id", "component_hash"))
    key = lambda t: [t[k] for k in ("sa", "sb", "n")]
    alone = base.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("h").alias("text_hash"), F.col("h").alias("component_hash"))
    joined = live.join(label, [x == y for x, y in zip(key(live), key(label), strict=True)]).select("doc_id", live.n.alias("n_shingles"), "component_id", F.col("h").alias("text_hash"), "component_hash")
    return joined.unionAll(alone)


def link_sets(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between sets (rid, n, own, tokens: shared n-grams from rare to frequent) that connect every pair of linked sets."""
    spark = sets.sparkSession
    probe = F.expr(f"n - CAST(ceil({percent} * n / 100.0) AS BIGINT) + 1 - own")
    index = F.expr(f"n - CAST(ceil(2 * {percent} * n / {100 + percent}.0) AS BIGINT) + 1 - own")
    posts = sets.withColumn("p", probe).where("p > 0").select("rid", "n", "own", index.alias("reach"), F.posexplode(F.expr("slice(tokens, 1, CAST(p AS INT))")).alias("i", "token"))
    posts = shared_table(spark, posts.select("token", "rid", "n", (F.col("own") + F.col("i")).alias("place"), (F.col("i") < F.col("reach")).alias("indexed")))
    fits = f"100 * least(n, cn) >= {percent} * greatest(n, cn)"

    center = posts.groupBy("token").agg(F.min(F.when(F.col("indexed"), F.struct("n", "rid"))).alias("c"), F.count("*").alias("m")).where("c IS NOT NULL AND m > 1")
    center = shared_table(spark, center.select("token", F.col("c.n").alias("cn"), F.col("c.rid").alias("cr")))
    star = posts.join(center, "token").where(f"rid <> cr AND {fits}").select(F.least("rid", "cr").alias("q"), F.greatest("rid", "cr").alias("x")).distinct()
    links = _test(sets, shared_table(spark, star), percent)

    comp = components(links)
    where = shared_table(spark, posts.join(comp, posts.rid == comp.node, "left").select("token", "rid", "n", "place", "indexed", F.coalesce("comp", "rid").alias("comp")))
    mixed = shared_table(spark, where.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token"))
    left = mixed.join(where.where("indexed"), "token").select("token", F.col("rid").alias("q"), F.col("n").alias("cn"), F.col("place").alias("i"), F.col("comp").alias("qc"))
    left = shared_table(spark, left)
    able = f"least(cn - i, n - place) >= CAST(ceil({percent} * (n + cn) / {100 + percent}.0) AS BIGINT)"
    rest = left.withColumnRenamed("token", "qt").join(where, F.expr(f"qt = token AND qc <> comp AND (cn < n OR (cn = n AND q < rid)) AND {fits} AND {able}"))
    rest = rest.select("q", F.col("rid").alias("x")).distinct()
    return links.unionAll(_test(sets, shared_table(spark, rest), percent))


def _test(sets: DataFrame, pairs: DataFrame, percent: int, block: int = 500) -> DataFrame:
    """Links that connect all linked ones of the candidate pairs (q, x), found by T-occurrence searches in blocks of about so many pairs: fewer than a block has sets.

    Pairs are dealt out by both sides, so a set that is in very many pairs is once in each block, and blocks stay even.
    """
    spark = sets.sparkSession
    n_blocks = max(C.LEAST_CHUNKS, math.ceil(pairs.count() / block))
    pairs = pairs.withColumn("blk", F.pmod(F.xxhash64("q", "x"), F.lit(n_blocks)).cast("int"))
    queries = pairs.select("blk", F.col("q").alias("rid")).distinct().join(sets.select("rid", "n", "tokens"), "rid")
    found = pairs.select("blk", F.col("x").alias("rid")).distinct().join(sets.select("rid", "n", "tokens"), "rid")
    found = found.select(*[F.col(c).alias(f"x_{c}") for c in found.columns])
    tasks = min(n_blocks, C.MOST_TASKS)
    queries, found = queries.repartitionById(tasks, "blk"), found.repartitionById(tasks, "x_blk")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(q: pa.Table, x: pa.Table) -> pa.Table:
        links, root = [], {}
        release()

        def top(r: int) -> int:
            while (up := root.get(r, r)) != r:
                root[r], r = root.get(up, up), up
            return r

        if q.num_rows and x.num_rows:
            rid, size = x.column("x_rid").to_pylist(), x.column("x_n").to_pylist()
            lists = defaultdict(list)
            for i, tokens in enumerate(x.column("x_tokens").to_pylist()):
                for t in tokens:
                    lists[t].append(i)
            for r, m, tokens in zip(q.column("rid").to_pylist(), q.column("n").to_pylist(), q.column("tokens").to_pylist(), strict=True):
                for i, c in t_occurrence([lists[t] for t in tokens if t in lists], -(-percent * m // 100)).items():
                    a, b = top(r), top(rid[i])
                    if a != b and 100 * c >= percent * (m + size[i] - c):  # a link that connects nothing new is not kept
                        root[max(a, b)] = min(a, b)
                        links.append((min(r, rid[i]), max(r, rid[i])))
        return pa.table([pa.array([p[0] for p in links], pa.int64()), pa.array([p[1] for p in links], pa.int64())], schema=out)

    return shared_table(spark, queries.groupBy("blk").cogroup(found.groupBy("x_blk")).applyInArrow(run, "a long, b long").distinct())
