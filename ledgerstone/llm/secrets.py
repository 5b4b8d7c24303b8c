"""Secret scans: fixed patterns, and a battery of randomness tests over the other long tokens.

Patterns (kinds assign, access, hex) give the base spans. What they leave of every run of ``[A-Za-z0-9+/_-]``, in pieces of 20 or more characters, is a candidate. Its encoding is
inferred from its characters: the first of ENCODINGS, smallest alphabets first, that holds them all. That fixes an alphabet of K symbols. Then:

* chi-squared: the symbols' counts against the uniform distribution (Wilson-Hilferty normal approximation);
* runs: Wald-Wolfowitz test of the lower against the upper half of the alphabet;
* serial correlation: lag-one correlation of the symbols' places in the alphabet.

The three p-values are combined by Bonferroni's rule. They pass a Benjamini-Hochberg step at ``alpha`` within each stratum of encoding and length: a candidate that it
rejects isn't random. One that it leaves must also be *unlike ordinary text*: under text of the encoding's usual collision rate, the same chi-squared is noncentral with a shift
in proportion to the token's length, and the lower tail is its p-value; those pass a second such step at ``fdr``. So in every stratum
the share of false rejections and of false secrets is bounded apart, and short tokens, whose tests are weak, answer for their own. Survivors are spans of kind ``random``.

All of it is Spark expressions, of linear cost in the text but for a logarithm of the number of matches: positions are prefix sums by doubling, candidates
meet base spans in a sweep over sorted ends. The corpus-wide steps group p-values to tenths of a decimal power;
the driver gets at most two thresholds per stratum, eighty in all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerstone.llm._shared import free, shared_table

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of one character class is never cut short, so a least length in the pattern gives the same spans as one applied afterwards.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
LEAST = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: Encoding: pattern, alphabet (symbols in order), usual collision rate of text in it. By size: a symbol that cannot occur shifts chi-squared in proportion to the length.
ENCODINGS = {
    "digits": (r"^[0-9]+$", "0123456789", 0.18),
    "hex": (r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.125),
    "letters": (r"^[A-Za-z]?[a-z]+$", "abcdefghijklmnopqrstuvwxyz", 0.066),
    "base32": (r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.066),
    "lower": (r"^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789", 0.066),
    "upper": (r"^[A-Z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 0.066),
    "alphanumeric": (r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 0.066),
    "base64": (r"^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.066),
    "base64url": (r"^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 0.066),
    "other": (r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", 0.066),
}
LENGTHS = (32, 48, 80)


def _sql_text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bind(var: str, value: str, body: str) -> str:
    """SQL that evaluates value once and names it."""
    return f"element_at(transform(array({value}), {var} -> {body}), 1)"


def _scan(array: str, zero: str = "0", step: str = "p + q") -> str:
    """Prefix sums (or maxima) of an array by doubling: as many rounds as its size has bits."""
    return f"aggregate(sequence(0, length(bin(size({array}))) - 1), {array}, (acc, r) -> zip_with(acc, slice(concat(array_repeat({zero}, CAST(shiftleft(1, r) AS INT)), acc), 1, size(acc)), (p, q) -> {step}))"


def _find(text: str, pattern: str, rank: int, least: int = 0, some: str = "", token: bool = False) -> str:
    """SQL for the spans of a pattern. The pieces between matches and the matches themselves add up to positions. some: a cheap necessary condition."""
    p = _sql_text(pattern)
    last = ", 'token', m" if token else ""
    none = "CAST(array() AS array<struct<start:int,rank:int,end:int" + (",token:string" if token else "") + ">>)"
    spans = f"zip_with(ms, {_scan('ls')}, (m, z) -> named_struct('start', z - length(m), 'rank', {rank}, 'end', z{last}))"
    if least:  # group 2 decides
        spans = f"filter(zip_with({spans}, regexp_extract_all({text}, {p}, 2), (s, g) -> IF(length(g) >= {least}, s, NULL)), s -> s IS NOT NULL)"
    spans = _bind("ms", f"regexp_extract_all({text}, {p}, 0)", _bind("ls", f"zip_with(slice(split({text}, {p}, -1), 1, size(ms)), ms, (s, m) -> length(s) + length(m))", spans))
    return f"IF({some + ' AND ' if some else ''}{text} RLIKE {p}, {spans}, {none})"


def _left(base: str, found: str) -> str:
    """SQL for what base spans leave of the candidates: pieces of LEAST characters or more, by a sweep over all ends in order."""
    events = (
        f"array_sort(concat(transform({found}, x -> named_struct('at', x.start, 'c', 1, 'b', 0, 'i', 1)), transform({found}, x -> named_struct('at', x.end, 'c', -1, 'b', 0, 'i', 0)), "
        f"transform({base}, x -> named_struct('at', x.start, 'c', 0, 'b', 1, 'i', 0)), transform({base}, x -> named_struct('at', x.end, 'c', 0, 'b', -1, 'i', 0))))"
    )
    depth = lambda f: _scan(f"transform(ev, x -> x.{f})")
    rows = f"zip_with(zip_with({depth('c')}, {depth('b')}, (x, y) -> named_struct('c', x, 'b', y)), zip_with({depth('i')}, ev, (x, y) -> named_struct('i', x, 'at', y.at)), (x, y) -> named_struct('c', x.c, 'b', x.b, 'i', y.i, 'at', y.at))"
    rows = f"zip_with({rows}, slice(transform(ev, x -> x.at), 2, size(ev)), (x, z) -> named_struct('c', x.c, 'b', x.b, 'i', x.i, 'at', x.at, 'z', z))"
    token = f"CAST(substring(CAST({found}[x.i - 1].token AS BINARY), x.at - {found}[x.i - 1].start + 1, x.z - x.at) AS STRING)"  # of bytes: no walk through the token
    cut = _bind("ev", events, f"transform(filter({rows}, x -> x.c = 1 AND x.b = 0 AND x.z - x.at >= {LEAST}), x -> named_struct('start', x.at, 'rank', 3, 'end', x.z, 'token', {token}))")
    return f"IF(size({base}) = 0 OR size({found}) = 0, {found}, {cut})"


def _battery(x: str) -> str:
    """SQL for the statistics of one candidate, a struct with start, end and token."""
    kind = "CASE " + " ".join(f"WHEN {x}.token RLIKE {_sql_text(p)} THEN '{e}'" for e, (p, _, _) in ENCODINGS.items() if p) + " ELSE 'other' END"
    alphabet = "CASE e " + " ".join(f"WHEN '{e}' THEN '{a}'" for e, (_, a, _) in ENCODINGS.items()) + " END"
    usual = "CASE e " + " ".join(f"WHEN '{e}' THEN {r}D" for e, (_, _, r) in ENCODINGS.items()) + " END"
    bind = _bind
    phi = lambda z: f"(1D / (1D + exp(greatest(-700D, least(700D, -0.07056D * pow({z}, 3) - 1.5976D * ({z}))))))"
    two = lambda z: f"(2D * {phi(f'(-abs({z}))')})"
    square = "aggregate(array_distinct(v), 0D, (a, s) -> a + pow(CAST(size(filter(v, q -> q = s)) AS DOUBLE), 2))"
    runs = "(1 + aggregate(zip_with(slice(v, 1, size(v) - 1), slice(v, 2, size(v) - 1), (p, q) -> IF((2 * p >= k) = (2 * q >= k), 0, 1)), 0, (a, s) -> a + s))"
    high = "CAST(size(filter(v, q -> 2 * q >= k)) AS DOUBLE)"
    mean = "(aggregate(v, 0D, (a, q) -> a + q) / n)"
    body = (
        "named_struct('start', x.start, 'end', x.end, 'encoding', e, 'length', CAST(n AS INT), "
        f"'p_random', least(1D, 3D * least({phi('-zc')}, {two('zr')}, {two('zs')})), "
        f"'p_text', {bind('r', usual, phi('(c - ((k - 1D) + n * (k * r - 1D))) / sqrt(2D * ((k - 1D) + 2D * n * greatest(0D, k * r - 1D)))'))})"
    )
    body = bind("zs", bind("m", mean, bind("d", "aggregate(v, 0D, (a, q) -> a + pow(q - m, 2))", "IF(d = 0D, 99D, (aggregate(zip_with(slice(v, 1, size(v) - 1), slice(v, 2, size(v) - 1), (p, q) -> (p - m) * (q - m)), 0D, (a, s) -> a + s) / d + 1D / n) * sqrt(n))")), body)
    body = bind("zr", bind("h", high, bind("u", "2D * h * (n - h) / n + 1D", f"IF((u - 1D) * (u - 2D) <= 0D, 99D, ({runs} - u) / sqrt((u - 1D) * (u - 2D) / (n - 1D)))")), body)
    body = bind("zc", "(cbrt(c / (k - 1D)) - (1D - 2D / (9D * (k - 1D)))) / sqrt(2D / (9D * (k - 1D)))", body)
    body = bind("c", f"k / n * {square} - n", body)
    body = bind("v", f"transform(split(IF(e IN ('hex', 'letters'), lower({x}.token), {x}.token), ''), s -> instr({alphabet}, s) - 1)", body)
    body = bind("k", f"CAST(length({alphabet}) AS DOUBLE)", bind("n", f"CAST(length({x}.token) AS DOUBLE)", body))
    return bind("e", kind, body)


def scan(docs: DataFrame, fdr: float = 0.05, alpha: float = 0.001, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """All columns of docs and ``secret_spans``: array of (start, rank, end) in code points, end exclusive, by start then kind.

    rank is the place in KINDS. A column of that name is replaced; any others keep their values, whatever they are called. Null and empty texts have no spans.
    Equal rows get equal spans. An empty table gives no rows. The thresholds need all texts before the spans are known: with the text in the result, texts are scanned
    twice; without it (``with_text``), once, and what was found is written to the shared folder.
    """
    own = [c for c in docs.columns if c.lower() != "secret_spans" and (with_text or c != text_col)]
    x = free(docs.columns, "_found")
    word = "(" + " OR ".join(f"contains(lower(t), '{w}')" for w in ("password", "passwd", "secret", "token", "apikey", "api_key")) + ")"
    base = f"concat({_find('t', ASSIGN, 0, 6, word)}, {_find('t', ACCESS, 1)}, {_find('t', HEX, 2)})"
    both = _bind("c", _find("t", CANDIDATE, 3, token=True), f"named_struct('base', b, 'tests', transform({_left('b', 'c')}, x -> {_battery('x')}))")
    found = _bind("t", f"coalesce(CAST(`{text_col}` AS STRING), '')", _bind("b", base, both))
    t = docs.select(*[F.col(f"`{c}`") for c in own], F.expr(found).alias(x))
    if not with_text:
        t = shared_table(docs.sparkSession, t)
    tests = t.where(f"size({x}.tests) > 0").select(F.explode(f"{x}.tests").alias("c")).select("c.*")
    cells = tests.groupBy("encoding", F.expr(_length_bin("length")).alias("bin"), F.expr(_p_bin("p_random")).alias("p_random"), F.expr(_p_bin("p_text")).alias("p_text")).agg(F.count("*").alias("n"))
    cells = shared_table(docs.sparkSession, cells)  # both steps read these few counts, not the texts
    structured, unlike = _thresholds(cells, "p_random", alpha), _thresholds(cells, "p_text", fdr)
    beyond = lambda p, bounds: "(" + (" OR ".join(f"(c.encoding = '{e}' AND {_length_bin('c.length')} = {b} AND {_p_bin(f'c.{p}')} >= {least})" for e, b, least in bounds) or "false") + ")"
    random = F.expr(f"transform(filter({x}.tests, c -> NOT {beyond('p_random', structured)} AND {beyond('p_text', unlike)}), c -> named_struct('start', c.start, 'rank', 3, 'end', c.end))")
    return t.select(*[F.col(f"`{c}`") for c in own], F.array_sort(F.concat(F.col(f"{x}.base"), random)).alias("secret_spans"))


def _length_bin(n: str) -> str:
    return "CASE " + " ".join(f"WHEN {n} < {x} THEN {i}" for i, x in enumerate(LENGTHS)) + f" ELSE {len(LENGTHS)} END"


def _p_bin(p: str) -> str:
    return f"CAST(floor(least(200D, -10D * log10(greatest({p}, 1e-20D)))) AS INT)"


def _thresholds(cells: DataFrame, p: str, level: float) -> list[tuple[str, int, int]]:
    """Benjamini-Hochberg per stratum: the smallest p-value bin whose edge, times the tests over those at least as small, is within the level."""
    s = cells.groupBy("encoding", "bin", F.col(p).alias("p")).agg(F.sum("n").alias("n"))
    w = Window.partitionBy("encoding", "bin")
    s = s.withColumn("upto", F.sum("n").over(w.orderBy(F.desc("p")))).withColumn("all", F.sum("n").over(w))
    s = s.where(F.pow(F.lit(10.0), -F.col("p") / 10.0) * F.col("all") / F.col("upto") <= level)
    return [(r.encoding, r.bin, r.least) for r in s.groupBy("encoding", "bin").agg(F.min("p").alias("least")).collect()]


def joined(spans: Column, last: int = 3) -> Column:
    """kind:start:end of the spans up to rank ``last``, comma-joined."""
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["rank"] + 1)
    return F.array_join(F.transform(F.filter(spans, lambda s: s["rank"] <= last), lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "<SECRET>", text_col: str = "text", **options) -> DataFrame:
    """The columns of docs, every secret span in the text replaced by a mark; overlapping spans become one.

    Texts without spans, null and empty ones are unchanged. Repeated rows are masked alike. An empty table gives no rows. Columns of any other name keep their values.
    """
    s, own, many = free(docs.columns, "_spans"), free(docs.columns, "_own"), 32  # beyond, text is cut from an array of its characters: a substring walks from the start
    clash = [c for c in docs.columns if c.lower() == "secret_spans"]
    t = scan(docs.withColumnsRenamed({c: own for c in clash}), text_col=text_col, **options).withColumnsRenamed({"secret_spans": s} | {own: c for c in clash})
    part = lambda a, z: f"IF(size({s}) > {many}, array_join(slice(cs, {a} + 1, {z} - {a}), ''), substring(t, {a} + 1, {z} - {a}))"
    whole = (
        f"concat(array_join(zip_with({s}, slice(concat(array(0), zs), 1, size(zs)), (x, at) -> IF(x.start >= at, concat({part('at', 'x.start')}, {_sql_text(mark)}), '')), ''), "
        f"{part('element_at(zs, -1)', 'length(t)')})"
    )
    ends = _scan(f"transform({s}, x -> x.end)", step="greatest(p, q)")
    masked = _bind("t", f"`{text_col}`", _bind("cs", f"IF(size({s}) > {many}, split(t, ''), CAST(array() AS array<string>))", _bind("zs", ends, whole)))
    return t.withColumn(text_col, F.expr(f"IF(size({s}) > 0, {masked}, `{text_col}`)")).select(*[F.col(f"`{c}`") for c in docs.columns])
