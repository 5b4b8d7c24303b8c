"""The queries of this subpackage over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerstone.llm import language_id
from ledgerstone.llm.checksum_sql import crc32_sql
from ledgerstone.llm.importance import resample
from ledgerstone.llm.jaccard_join import jaccard_join
from ledgerstone.llm.mixing import copies, mix
from ledgerstone.llm.packing import pack
from ledgerstone.llm.periodic_runs import periodic_runs
from ledgerstone.llm.quality_rules import judge
from ledgerstone.llm.secrets import joined, scan
from ledgerstone.llm.secrets_sql import scan_sql
from ledgerstone.llm.substring_dedup import substring_dedup
from ledgerstone.llm.suffix_dedup import suffix_dedup
from ledgerstone.llm.token_store import token_digests
from ledgerstone.llm.topk_search import finite_vectors, search
from ledgerstone.llm.warc import archive_pages


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_docs(spark, sf_dir), window=20).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_docs(spark, sf_dir), length=4096).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_docs(spark, sf_dir)).select("doc_id", "source", "lang", F.col("mix_tokens").alias("n_tokens"), F.col("mix_probability").alias("probability"), F.col("mix_kept").alias("kept"), copies().alias("copies"))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = finite_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(v.where("id % 20 = 0"), v, k=20)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_docs(spark, sf_dir))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("secret_spans")
    n = lambda rank: F.size(F.filter(s, lambda x: x["rank"] == rank)).cast("long")
    return scan(_docs(spark, sf_dir).select("doc_id", "text"), with_text=False).select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(s, 2), 256).alias("base_sha256"), joined(s).alias("spans"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup(_docs(spark, sf_dir), least=50)
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    rows = language_id.identify(docs.select("doc_id", "text"), language_id.learn(docs))
    return rows.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_docs(spark, sf_dir), n=5, percent=75).select("doc_id", "n_shingles", "component_id")


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resample(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=25, least_words=20, seed=7, with_text=False)
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op12_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Text in which the words of each tenth document, by a checksum of its id, repeat with a period from some place on.
_PERIODIC = r"""
transform(array(regexp_extract_all(text, r'[^\x20\x09-\x0D]+', 0)), w -> IF(size(w) = 0, '', array_join(transform(sequence(0, size(w) - 1),
  i -> IF(i < g % size(w), w[i], w[g % size(w) + (i - g % size(w)) % (1 + (size(w) - g % size(w)) DIV (3 + g % 8))])), ' ')))[0]
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = _docs(spark, sf_dir).select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    rows = periodic_runs(docs.withColumn("text", F.when(F.col("h") % 10 == 0, F.expr(_PERIODIC)).otherwise(F.col("text"))), least=6, times=4)
    greater = lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), greater)
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    rows = rows.select("doc_id", "runs", "kept_text", best.alias("best"), lines.alias("lines"))
    exponent = F.expr("1000 * best.length DIV best.period").cast("long")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_pack, op3_mix_sources, op4_topk_search, op5_token_store, op6_secret_scan, op7_suffix_dedup, op8_language_id, op9_quality_rules, op10_jaccard_join, op11_importance_resample, op12_warc_archive, op13_periodic_runs)}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE_SQL = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
s AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS i FROM d WHERE len(ws) >= 20),
r AS (SELECT doc_id, i, ROW_NUMBER() OVER (PARTITION BY array_to_string(ws[i:i+19], ' ') ORDER BY doc_id, i) > 1 AS again FROM s),
c AS (SELECT w.doc_id, w.i, w.word, COALESCE(MAX(CASE WHEN r.again THEN 1 ELSE 0 END) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS gone
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id AND w.i = r.i),
g AS (SELECT doc_id, COUNT(*) AS n_words, SUM(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(COALESCE(g.n_words, 0) AS BIGINT) AS n_words, CAST(COALESCE(g.n_removed, 0) AS BIGINT) AS n_removed, sha256(COALESCE(g.kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
""",
    "op4_topk_search": r"""
WITH e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(64 * x) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(COALESCE(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op7_suffix_dedup": r"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, hex(encode(COALESCE(text, ''))) AS h, octet_length(encode(COALESCE(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) AS k FROM (SELECT doc_id, h, unnest(generate_series(0, n - 50)) AS i FROM d WHERE n >= 50)),
f AS (SELECT k, MIN(doc_id) AS first, MAX(doc_id) AS last FROM s GROUP BY k HAVING MIN(doc_id) < MAX(doc_id)),
r AS (SELECT s.doc_id, s.i FROM s JOIN f ON f.k = s.k WHERE s.doc_id > f.first),
p AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS b FROM (SELECT doc_id, h, unnest(generate_series(0, n - 1)) AS i FROM d WHERE doc_id IN (SELECT doc_id FROM r))),
c AS (SELECT p.doc_id, p.i, p.b, COALESCE(MAX(CASE WHEN r.i IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone
      FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.i = p.i),
e AS (SELECT *, LAG(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM c),
g AS (SELECT doc_id, SUM(gone) AS n_removed, COUNT(*) FILTER (gone = 1 AND before = 0) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (gone = 0) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(COALESCE(g.n_removed, 0) AS BIGINT) AS n_removed, CAST(COALESCE(g.n_spans, 0) AS BIGINT) AS n_spans,
  CASE WHEN g.doc_id IS NULL THEN sha256(encode(d.t)) ELSE sha256(unhex(COALESCE(g.kept, ''))) END AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
""",
    "op10_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5_number(array_to_string(ws[i:i+4], ' ')) AS sh FROM (SELECT doc_id, ws, unnest(CASE WHEN len(ws) >= 5 THEN generate_series(1, len(ws) - 4) WHEN len(ws) > 0 THEN [1] ELSE [] END) AS i FROM w)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS d, doc_id AS m FROM w UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.d)
SELECT w.doc_id, CAST(COALESCE(n.n, 0) AS BIGINT) AS n_shingles, MIN(r.m) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.d = w.doc_id GROUP BY 1, 2
""",
    "op6_secret_scan": scan_sql(),
    "op11_importance_resample": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws, 0 AS side FROM documents
           UNION ALL SELECT item_id, regexp_extract_all(translate(COALESCE(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), 1 FROM benchmark),
f AS (SELECT side, doc_id, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS feature FROM w),
c AS (SELECT side, doc_id, feature, COUNT(*) AS n FROM f GROUP BY ALL),
k AS (SELECT feature, {crc32_sql("feature")} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM c)),
b AS (SELECT bucket, SUM(CASE WHEN side = 0 THEN n ELSE 0 END) AS s, SUM(CASE WHEN side = 1 THEN n ELSE 0 END) AS t FROM c JOIN k USING (feature) GROUP BY bucket),
a AS (SELECT SUM(s) AS s_all, SUM(t) AS t_all FROM b),
g AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * (s_all + 10000)::DOUBLE) / (CAST(s + 1 AS DOUBLE) * (t_all + 10000)::DOUBLE))) AS BIGINT) AS gain FROM b, a),
d AS (SELECT doc_id, SUM(n) AS n, SUM(n * gain) AS total FROM c JOIN k USING (feature) JOIN g USING (bucket) WHERE side = 0 GROUP BY doc_id),
v AS (SELECT w.doc_id, len(ws) AS n_words, CAST(COALESCE(d.n, 0) AS BIGINT) AS n_features, CAST(COALESCE((total - ((total % d.n) + d.n) % d.n) // d.n, 0) AS BIGINT) AS weight FROM w LEFT JOIN d ON d.doc_id = w.doc_id WHERE side = 0),
s AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM v),
r AS (SELECT doc_id, ROW_NUMBER() OVER (ORDER BY score DESC, doc_id) AS place, COUNT(*) OVER () AS many FROM s WHERE n_words >= 20)
SELECT s.doc_id, n_features, weight, score, CAST(CASE WHEN place <= 25 * many // 100 THEN place END AS BIGINT) AS rank FROM s LEFT JOIN r ON r.doc_id = s.doc_id
""",
    "op12_warc_archive": """
WITH p AS (SELECT page_id, CAST(octet_length(encode(COALESCE(html, ''))) AS BIGINT) AS payload_bytes, sha256(COALESCE(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, MIN(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest
""",
    "op13_periodic_runs": rf"""
WITH d AS (SELECT doc_id, {crc32_sql("CAST(doc_id AS VARCHAR)")} AS h, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS o FROM documents),
e AS (SELECT *, len(o) AS n, (h // 10) % len(o) AS a, 1 + (len(o) - (h // 10) % len(o)) // (3 + (h // 10) % 8) AS p FROM d),
v AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: CASE WHEN i < a THEN o[i + 1] ELSE o[a + (i - a) % p + 1] END) ELSE o END AS ws FROM e),
w AS (SELECT doc_id, n, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM v),
m AS (SELECT x.doc_id, y.i - x.i AS p, x.i AS i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, p, MIN(i) AS start, COUNT(*) + p AS length FROM (SELECT *, i - ROW_NUMBER() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM m) GROUP BY doc_id, p, island),
r AS (SELECT doc_id, start, length, MIN(p) AS period FROM s WHERE length >= 6 AND length >= 4 * p GROUP BY doc_id, start, length),
b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY length / period::DOUBLE DESC, start, period) AS place FROM r),
q AS (SELECT doc_id, COUNT(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS kept FROM w LEFT JOIN g ON g.doc_id = w.doc_id AND g.i = w.i WHERE g.i IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, COALESCE(n_runs, 0) AS n_runs, b.start, b.length, b.period, CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli, sha256(COALESCE(lines, '')) AS runs_sha256, sha256(COALESCE(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN q ON q.doc_id = d.doc_id LEFT JOIN b ON b.doc_id = d.doc_id AND b.place = 1 LEFT JOIN k ON k.doc_id = d.doc_id
""",
}
