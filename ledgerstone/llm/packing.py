"""Cost-balanced packing of documents into fixed-length training sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n``: attention stays inside a piece. Documents are packed in groups, each a bounded run of the rows of
one partition, so nothing is shuffled and no task holds more than a group. In a group of t tokens there are t // length full sequences and, for the rest, one sequence for
each power of two in t % length; those lengths need no padding, so every sequence is filled exactly. Then:

1. documents of a whole length or more are cut: their leading pieces fill sequences alone;
2. the remaining pieces, longest first, go to the sequence of lowest cost that has room;
3. a piece that fits nowhere whole is cut over the sequences with the most room.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ledgerstone.llm import _tokens as T
from ledgerstone.llm._shared import release

OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double, ids binary"
_OUT = pa.schema([(n, {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}[t]) for n, t in (x.split(" ") for x in OUT.split(", "))])
#: Sequences of one task are numbered from its partition number times this.
_TASK = 1 << 32


def assign(lengths: list[int], length: int = 4096, linear: float = 1.0, quadratic: float = 1 / 4096) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, n, sequence, offset) of documents of the given token counts; sequences are numbered from 0."""
    order = sorted((i for i, n in enumerate(lengths) if n > 0), key=lambda i: (-lengths[i], i))
    total = sum(lengths[i] for i in order)
    full, rest = divmod(total, length)
    room = np.array([length] * full + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1], np.int64)
    size = room.copy()
    cost = np.zeros(len(room))
    pieces, fresh = [], 0

    def put(doc: int, start: int, n: int, seq: int) -> None:
        pieces.append((doc, start, n, seq, int(size[seq] - room[seq])))
        room[seq] -= n
        cost[seq] += linear * n + quadratic * n * n

    left = {}
    for i in order:
        done = 0
        while lengths[i] - done >= length and fresh < full:
            put(i, done, length, fresh)
            fresh, done = fresh + 1, done + length
        if lengths[i] > done:
            left[i] = done
    for i in sorted(left, key=lambda i: (left[i] - lengths[i], i)):
        done = left[i]
        while done < lengths[i]:
            fits = np.flatnonzero(room >= lengths[i] - done)
            if len(fits):
                seq, n = int(fits[np.argmin(cost[fits])]), lengths[i] - done
            else:
                seq = int(np.argmax(room))
                n = int(room[seq])
            put(i, done, n, seq)
            done += n
    return pieces


def pack(docs: DataFrame, length: int = 4096, group_tokens: int = 2_000_000, linear: float = 1.0, quadratic: float = 1 / 4096, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every token of every document, its end id included; one row per piece.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, the piece's cost and its ids
    (little-endian uint32). Null and empty texts are one end id. Rows of equal or null id are documents of their own. An empty
    table gives no rows. A document beyond ``group_tokens`` is a group by itself. Other columns are ignored.
    """
    if length & (length - 1) or length < 1:
        raise ValueError("length must be a power of two")
    tokenizer_path = tokenizer_path or T.default_path()
    rows = docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"CAST(`{text_col}` AS STRING) AS text")

    def run(batches):
        enc = T.encoder(tokenizer_path)
        at = TaskContext.get().partitionId() * _TASK
        ids, parts, held = [], [], 0

        def flush():
            nonlocal at
            pieces = sorted(assign([len(p) // 4 for p in parts], length, linear, quadratic), key=lambda p: (p[3], p[4]))
            for k in range(0, len(pieces), 4000):
                some = pieces[k : k + 4000]
                cut = [parts[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in some]
                yield pa.record_batch(
                    [
                        pa.array([ids[p[0]] for p in some], pa.int64()), pa.array([p[1] for p in some], pa.int64()), pa.array([p[2] for p in some], pa.int64()), pa.array([zlib.crc32(x) for x in cut], pa.int64()),
                        pa.array([len(parts[p[0]]) // 4 for p in some], pa.int64()), pa.array([at + p[3] for p in some], pa.int64()), pa.array([p[4] for p in some], pa.int64()), pa.array([linear * p[2] + quadratic * p[2] ** 2 for p in some], pa.float64()), pa.array(cut, pa.binary()),
                    ],
                    schema=_OUT,
                )
            at += max((p[3] for p in pieces), default=-1) + 1

        for batch in batches:
            for d, p in zip(batch.column(0).to_pylist(), enc.encode_each(x.as_py() for x in batch.column(1)), strict=True):
                ids.append(d)
                parts.append(p)
                held += len(p) // 4
                if held >= group_tokens:
                    yield from flush()
                    ids, parts, held = [], [], 0
        yield from flush()
        release()

    return rows.mapInArrow(run, OUT)
