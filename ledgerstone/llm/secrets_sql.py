"""The secret scan as DuckDB SQL, written apart from the operator: spans from the pieces between matches, a sweep for what they leave, the battery over one row per candidate."""

from __future__ import annotations

_PATTERNS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"(AKIA([A-Z0-9]+))",
    "hex": r"((?:)([0-9a-f]+))",
    "run": r"(()[A-Za-z0-9+/_-]{20,})",
}
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Name, pattern, alphabet, collision rate of ordinary text in it: the first that fits.
_ALPHABETS = [
    ("digits", "[0-9]+", _DIGITS, 0.18),
    ("hex", "[0-9a-f]+|[0-9A-F]+", _DIGITS + "abcdef", 0.125),
    ("letters", "[A-Za-z]?[a-z]+", _LOWER, 0.066),
    ("base32", "[A-Z2-7]+", _UPPER + "234567", 0.066),
    ("lower", "[a-z0-9]+", _LOWER + _DIGITS, 0.066),
    ("upper", "[A-Z0-9]+", _UPPER + _DIGITS, 0.066),
    ("alphanumeric", "[A-Za-z0-9]+", _UPPER + _LOWER + _DIGITS, 0.066),
    ("base64", "[A-Za-z0-9+/]+", _UPPER + _LOWER + _DIGITS + "+/", 0.066),
    ("base64url", "[A-Za-z0-9_-]+", _UPPER + _LOWER + _DIGITS + "-_", 0.066),
    ("other", ".*", _UPPER + _LOWER + _DIGITS + "+/-_", 0.066),
]


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _spans(kind: str, rank: int, keep: str) -> str:
    p = _text(_PATTERNS[kind])
    at = "CAST(list_sum(list_transform(list_slice(s, 1, i), lambda x: len(x))) + COALESCE(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: len(x))), 0) AS BIGINT)"
    return (
        f"SELECT doc_id, {rank} AS rank, a, a + len(tok) AS z, tok FROM (SELECT doc_id, i, m[i] AS tok, g[i] AS grp, {at} AS a FROM (SELECT doc_id, m, g, s, unnest(range(1, len(m) + 1)) AS i FROM "
        f"(SELECT doc_id, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, 2) AS g, string_split_regex(t, {p}) AS s FROM d WHERE regexp_matches(t, {p})))) WHERE {keep}"
    )


def _phi(z: str) -> str:
    return f"(1 / (1 + exp(GREATEST(-700, LEAST(700, -0.07056 * pow({z}, 3) - 1.5976 * ({z}))))))"


def _tenths(p: str) -> str:
    return f"CAST(floor(LEAST(200, -10 * log10(GREATEST({p}, 1e-20)))) AS INTEGER)"


def _cut(p: str, level: float) -> str:
    return (
        f"SELECT e, bin, MIN(p) AS least FROM (SELECT e, bin, p, SUM(n) OVER (PARTITION BY e, bin ORDER BY p DESC) AS upto, SUM(n) OVER (PARTITION BY e, bin) AS total "
        f"FROM (SELECT e, bin, {p} AS p, COUNT(*) AS n FROM c8 GROUP BY 1, 2, 3)) WHERE pow(10, -p / 10.0) * total / upto <= {level} GROUP BY 1, 2"
    )


def scan_sql(fdr: float = 0.05, alpha: float = 0.001) -> str:
    kind = "CASE " + " ".join(f"WHEN regexp_full_match(tok, {_text(p)}) THEN '{e}'" for e, p, _, _ in _ALPHABETS) + " END"
    of = lambda k, quote: "CASE e " + " ".join(f"WHEN '{x[0]}' THEN {_text(x[k]) if quote else x[k]}" for x in _ALPHABETS) + " END"
    name = "['assign', 'access', 'hex', 'random'][rank + 1]"
    one = lambda r: f"CAST(COUNT(*) FILTER (rank = {r}) AS BIGINT)"
    return f"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents),
base AS ({_spans("assign", 0, "len(grp) >= 6")} UNION ALL {_spans("access", 1, "len(tok) >= 20")} UNION ALL {_spans("hex", 2, "len(tok) >= 24")}),
run AS ({_spans("run", 3, "true")}),
ev AS (SELECT doc_id, a AS pos, 1 AS c, 0 AS b FROM run UNION ALL SELECT doc_id, z, -1, 0 FROM run UNION ALL SELECT doc_id, a, 0, 1 FROM base UNION ALL SELECT doc_id, z, 0, -1 FROM base),
sw AS (SELECT doc_id, pos, SUM(c) OVER w AS c, SUM(b) OVER w AS b, LEAD(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM ev WINDOW w AS (PARTITION BY doc_id ORDER BY pos RANGE UNBOUNDED PRECEDING)),
cand AS (SELECT doc_id, 3 AS rank, pos AS a, nxt AS z, substr(t, CAST(pos + 1 AS BIGINT), CAST(nxt - pos AS BIGINT)) AS tok FROM sw JOIN d USING (doc_id) WHERE c = 1 AND b = 0 AND nxt - pos >= 20),
c1 AS (SELECT *, {kind} AS e FROM cand),
c2 AS (SELECT *, CAST(len(tok) AS DOUBLE) AS n, {of(2, True)} AS alphabet, CAST({of(3, False)} AS DOUBLE) AS r FROM c1),
c3 AS (SELECT *, CAST(len(alphabet) AS DOUBLE) AS k, list_transform(regexp_extract_all(CASE WHEN e IN ('hex', 'letters') THEN lower(tok) ELSE tok END, '.'), lambda s: strpos(alphabet, s) - 1) AS v FROM c2),
c4 AS (SELECT *, k / n * list_sum(list_transform(list_distinct(v), lambda s: pow(len(list_filter(v, lambda q: q = s)), 2))) - n AS c, CAST(len(list_filter(v, lambda q: 2 * q >= k)) AS DOUBLE) AS h, list_sum(v) / n AS m,
  1 + len(list_filter(range(1, len(v)), lambda i: (2 * v[i] >= k) <> (2 * v[i + 1] >= k))) AS runs FROM c3),
c5 AS (SELECT *, 2 * h * (n - h) / n + 1 AS u, list_sum(list_transform(v, lambda q: pow(q - m, 2))) AS w, list_sum(list_transform(range(1, len(v)), lambda i: (v[i] - m) * (v[i + 1] - m))) AS x FROM c4),
c6 AS (SELECT *, (cbrt(c / (k - 1)) - (1 - 2 / (9 * (k - 1)))) / sqrt(2 / (9 * (k - 1))) AS zc, CASE WHEN (u - 1) * (u - 2) <= 0 THEN 99 ELSE (runs - u) / sqrt((u - 1) * (u - 2) / (n - 1)) END AS zr, CASE WHEN w = 0 THEN 99 ELSE (x / w + 1 / n) * sqrt(n) END AS zs FROM c5),
c7 AS (SELECT *, LEAST(1, 3 * LEAST({_phi('-zc')}, 2 * {_phi('-abs(zr)')}, 2 * {_phi('-abs(zs)')})) AS p_random, {_phi('(c - ((k - 1) + n * (k * r - 1))) / sqrt(2 * ((k - 1) + 2 * n * GREATEST(0, k * r - 1)))')} AS p_text FROM c6),
c8 AS (SELECT *, CASE WHEN n < 32 THEN 0 WHEN n < 48 THEN 1 WHEN n < 80 THEN 2 ELSE 3 END AS bin, {_tenths('p_random')} AS pr, {_tenths('p_text')} AS pt FROM c7),
structured AS ({_cut("pr", alpha)}),
unlike AS ({_cut("pt", fdr)}),
spans AS (SELECT doc_id, rank, a, z FROM base UNION ALL SELECT doc_id, rank, a, z FROM c8 JOIN unlike USING (e, bin) LEFT JOIN structured s USING (e, bin) WHERE c8.pt >= unlike.least AND (s.least IS NULL OR c8.pr < s.least)),
g AS (SELECT doc_id, {one(0)} AS n_assign, {one(1)} AS n_access, {one(2)} AS n_hex, string_agg({name} || ':' || a || ':' || z, ',' ORDER BY a, rank) FILTER (rank < 3) AS b, string_agg({name} || ':' || a || ':' || z, ',' ORDER BY a, rank) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, COALESCE(n_assign, 0) AS n_assign, COALESCE(n_access, 0) AS n_access, COALESCE(n_hex, 0) AS n_hex, sha256(COALESCE(b, '')) AS base_sha256, COALESCE(spans, '') AS spans FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
