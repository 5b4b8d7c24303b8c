"""Language identification by nearest centroid.

A text's features are the bigrams and trigrams of its lower-cased letters, words parted by one space, hashed to ``dims`` places. Weights are
(1 + ln tf) * idf, scaled to length one. Each language has up to ``clusters`` centroids, found by spherical k-means over a bounded labelled sample. A
text gets the language of the nearest centroid by cosine; the cosine is its score. It is rejected if it lies much farther from that centroid than
the language's own sample does for texts of about its length. Short texts lie farther off by nature: what to expect of each length is measured on
pieces of that length cut from the sample.

The model is bounded by its parameters (languages x clusters x dims floats) and goes to the workers with the task. No row is shuffled.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerstone.llm._shared import free, shared_table

UND = "und"
#: Bins of text length; languages whose sizes are broadcast, some 5 MB at most.
BINS, BROADCAST_LANGUAGES = 9, 100_000
#: From this bin on (65 letters) bounds no longer rise.
SETTLED = 4
#: Held out of learning: crc32 of the id as text leaves this remainder by FOLDS.
FOLDS, HELD = 4, 2
_letters: np.ndarray | None = None


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is held out; a null id is not, and doesn't teach either."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == HELD, F.lit(False))


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def features(text: str | None, dims: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places, counts and the number of letters of a whole text."""
    none = np.zeros(0, np.int64), np.zeros(0, np.float32), 0
    if not text:
        return none
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    ink = _is_letter()[c]
    n = int(np.count_nonzero(ink))
    if not n:
        return none
    c = np.where(ink, c, np.uint32(32))
    keep = ink.copy()
    keep[1:] |= ink[:-1]  # of each run of other characters, the first
    c = np.concatenate([[32], c[keep], [32]]).astype(np.uint32)
    with np.errstate(over="ignore"):
        a, b = c * np.uint32(0x9E3779B1), c * np.uint32(0x85EBCA77)
        two = (a[:-1] ^ b[1:]) * np.uint32(0xC2B2AE3D)
        three = (two[:-1] + c[2:] * np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1)
    shift = np.uint32(32 - dims.bit_length() + 1)
    counts = np.bincount(np.concatenate([two >> shift, three >> shift]), minlength=dims)
    at = np.flatnonzero(counts)
    return at, counts[at].astype(np.float32), n


def _length_bin(letters: np.ndarray | int):
    """0 for up to 8 letters, then one bin per doubling, 8 at most."""
    return np.clip(np.ceil(np.log2(np.maximum(letters, 1) / 8)), 0, 8).astype(int)


def pieces(text: str, seed: str) -> list[str]:
    """One piece of a text for each length bin below its own, at a place drawn by the seed: three quarters as many letters as the bin takes, with what stands between them."""
    text = text.lower()
    at = np.flatnonzero(_is_letter()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")])
    out = []
    for b in range(int(_length_bin(len(at)))):
        k = 6 << b
        s = zlib.crc32(f"{b}:{seed}".encode("utf-8", "surrogatepass")) % (len(at) - k + 1)
        out.append(text[at[s] : at[s + k - 1] + 1])
    return out


@dataclass
class Model:
    dims: int
    languages: list[str]
    of: np.ndarray  # language of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # per language and length bin: the smallest accepted cosine

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = (1 + np.log(counts)) * self.idf[at]
        return v / np.sqrt(float(v @ v)) if len(v) else v

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language (UND without letters), cosine, rejected."""
        at, counts, n = features(text, self.dims)
        if not n or not self.languages:
            return UND, 0.0, True
        cos = self.centroids[:, at] @ self.vector(at, counts)
        k = int(np.argmax(cos))
        score = float(min(1.0, max(0.0, cos[k])))
        return self.languages[self.of[k]], score, bool(score < self.least[self.of[k], _length_bin(n)])


def learn(docs: DataFrame, per_language: int = 300, sample_rows: int = 60_000, dims: int = 1 << 14, clusters: int = 3, slack: float = 0.4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on a bounded sample (by a hash of the id) of every language: about per_language documents each, fewer where languages are so many that sample_rows would be passed, whole texts, never a held-out one.

    Features are written to the shared folder; idf, centroids and bounds come from one group per language, and the driver gets those only: some 0.3 MB a
    language at the defaults. A text is rejected below ``slack`` times the median cosine of its language's sample at its length, whole texts and pieces of longer ones; outliers and wrong labels thus don't move the bound.
    Null texts, languages and ids teach nothing; a language of few documents is learned from those. Repeated rows count as often as they occur. An empty table gives a model that knows no language.
    """
    spark = docs.sparkSession
    t = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = t.groupBy("lang").agg(F.count("*").alias("n"))
    n_languages = sizes.count()
    each = max(1, min(per_language, sample_rows // max(1, n_languages)))
    u = F.pmod(F.xxhash64("id", F.lit(8)), F.lit(1 << 30)) / float(1 << 30)
    few = n_languages <= BROADCAST_LANGUAGES  # else Spark decides: no language then holds much of the rows' shuffle by itself
    sample = t.join(F.broadcast(sizes) if few else sizes, "lang").where(u < F.lit(float(each)) / F.col("n")).select("lang", "id", "text")
    schema = pa.schema([("lang", pa.string()), ("id", pa.string()), ("whole", pa.bool_()), ("n", pa.int64()), ("at", pa.binary()), ("counts", pa.binary())])

    def count(batches):
        for b in batches:
            rows = [(lang, i, x is text, *features(x, dims)) for lang, i, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True) for x in (text, *pieces(text, i))]
            rows = [(lang, i, whole, n, at.astype("<u4").tobytes(), counts.astype("<f4").tobytes()) for lang, i, whole, at, counts, n in rows if n]
            yield pa.record_batch([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    got = shared_table(spark, sample.mapInArrow(count, "lang string, id string, whole boolean, n long, at binary, counts binary"))
    seen = pa.schema([("rows", pa.int64()), ("df", pa.binary())])

    def frequencies(table: pa.Table) -> pa.Table:
        df = np.zeros(dims)
        for at in table.column("at").to_pylist():
            df[np.frombuffer(at, "<u4")] += 1
        return pa.table([[table.num_rows], [df.astype("<f8").tobytes()]], schema=seen)

    n, df = 0, np.zeros(dims)
    for r in got.where("whole").groupBy("lang").applyInArrow(frequencies, "rows long, df binary").toLocalIterator():
        n, df = n + r.rows, df + np.frombuffer(r.df, "<f8")
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    model = Model(dims, [], np.zeros(0, int), np.zeros((0, dims), np.float32), idf, np.zeros((0, BINS)))
    found = pa.schema([("lang", pa.string()), ("centroids", pa.binary()), ("least", pa.binary())])

    def fit(table: pa.Table) -> pa.Table:
        parts = [(i, whole, n, np.frombuffer(at, "<u4").astype(np.int64), np.frombuffer(counts, "<f4")) for i, whole, n, at, counts in zip(*(table.column(c).to_pylist() for c in ("id", "whole", "n", "at", "counts")), strict=True)]
        mine = sorted((p for p in parts if p[1]), key=lambda p: (p[0], p[2], p[3].tobytes(), p[4].tobytes()))
        x = np.zeros((len(mine), dims), np.float32)
        for row, p in zip(x, mine, strict=True):
            row[p[3]] = model.vector(*p[3:])
        c = _cluster(x, clusters)
        cos = np.array([(c[:, p[3]] @ model.vector(*p[3:])).max() for p in parts])
        least = slack * _bounds(cos, _length_bin(np.array([p[2] for p in parts])))
        return pa.table([[table.column("lang")[0].as_py()], [c.astype("<f4").tobytes()], [least.astype("<f8").tobytes()]], schema=found)

    rows = sorted(got.groupBy("lang").applyInArrow(fit, "lang string, centroids binary, least binary").collect())
    if rows:
        c = [np.frombuffer(r.centroids, "<f4").reshape(-1, dims) for r in rows]
        model.languages = [r.lang for r in rows]
        model.centroids, model.of = np.concatenate(c), np.repeat(np.arange(len(c)), [len(x) for x in c])
        model.least = np.stack([np.frombuffer(r.least, "<f8") for r in rows])
    return model


def _bounds(cos: np.ndarray, bins: np.ndarray, enough: int = 20) -> np.ndarray:
    """The median of cosines per length bin; from SETTLED on, the same: texts of other languages come no nearer with length, but repetitive ones of the language itself fall behind. A bin of fewer than ``enough`` takes the bound of the next shorter one, which is lower by nature; so no bound exceeds that of a longer bin. A language without any fuller bin has the bounds of what there is, halved."""
    sizes = np.bincount(bins, minlength=BINS)
    need, share = (enough, 1.0) if sizes.max() >= enough else (max(1, sizes.max()), 0.5)
    out = np.zeros(BINS)
    for b in range(BINS):
        out[b] = share * float(np.median(cos[bins == b])) if sizes[b] >= need else out[b - 1] if b else 0.0
    out[SETTLED:] = out[SETTLED]
    return np.minimum.accumulate(out[::-1])[::-1]


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far-apart starts, always the same."""
    mean = x.sum(axis=0)
    seeds = [int(np.argmax(x @ mean))]
    while len(seeds) < min(k, len(x)):
        far = (x @ x[seeds].T).max(axis=1)
        if far.min() > 1 - 1e-6:
            break
        seeds.append(int(np.argmin(far)))
    c = x[seeds]
    for _ in range(rounds):
        which = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[which == j].sum(axis=0) if (which == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of docs, lang_pred, lang_score and lang_rejected; columns of these names are replaced.

    Columns of any other name keep their values; repeated rows are treated alike. A null text and one without letters are ``und``, score 0, rejected; so is everything if the model knows no language.
    Every whole text is read, however long. An empty table gives no rows.
    """
    own = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_rejected")]
    kind = pa.struct([("lang_pred", pa.string()), ("lang_score", pa.float64()), ("lang_rejected", pa.bool_())])

    @F.arrow_udf("lang_pred string, lang_score double, lang_rejected boolean")
    def guess(texts: pa.Array) -> pa.Array:
        got = [model.predict(x.as_py()) for x in texts]
        return pa.StructArray.from_arrays([pa.array([g[i] for g in got], f.type) for i, f in enumerate(kind)], fields=list(kind))

    x = free(docs.columns, "_lang")
    return docs.select(*own, guess(F.col(text_col).cast("string")).alias(x)).select(*own, f"{x}.*")
