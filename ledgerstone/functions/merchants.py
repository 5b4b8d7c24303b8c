"""Merchant keys from statement descriptions, as Spark SQL expressions.

Evaluate them on distinct descriptions (``with_merchant_key``): a ledger repeats its descriptions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys must equal those of earlier ledgers.
CITIES = ["singapore", "s'pore", "spore", "sgp"]
COUNTRIES = ["sg", "my", "id", "th", "vn", "ph", "hk", "cn", "tw", "jp", "kr", "in", "au", "nz", "us", "ca", "gb", "uk", "ie", "fr", "de", "nl", "it", "es", "ch", "se", "dk", "no", "ae", "sa", "za", "br"]
PROCESSORS = ["sq", "paypal", "pp", "pypl", "stripe"]
TLDS = ["com", "net", "org", "sg", "co", "io", "app", "tv", "ai", "shop", "store", "biz", "info", "my", "uk"]
ALIASES = {"amzn": "amazon", "amzn mktp": "amazon"}
EDGE = " -&/.'\"*,:;#@+_"
KIND_SUFFIX = r"(?i)\s*[-–—]?\s*\b(?:refund|refunded|reversal|reversed|chargeback|credit\s+voucher)\b\s*$"
DOMAIN = r"^(?:www\.)?([a-z0-9][a-z0-9&'-]*)\.([a-z]{2,})"

_WS = r"(?U)\s+"


def lit(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bind(name: str, value: str, body: str) -> str:
    """SQL that evaluates value once and names it in body."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _in(x: str, values: list[str]) -> str:
    return f"{x} IN ({', '.join(map(lit, values))})"


def _strip(x: str) -> str:
    return f"trim(BOTH {lit(EDGE)} FROM {x})"


def _words(x: str) -> str:
    return f"filter(split({x}, {lit(_WS)}), w -> w != '')"


def _squash(x: str) -> str:
    return f"array_join({_words(x)}, ' ')"


def _place(x: str) -> str:
    return _in(_strip(x), CITIES + COUNTRIES)


def _without_places(tokens: str) -> str:
    """Trailing places dropped; one token always stays."""
    return _bind("p", tokens, f"slice(p, 1, greatest(least(size(p), 1), coalesce(array_max(transform(p, (x, i) -> IF({_place('x')}, 0, i + 1))), 0)))")


def _junk(x: str) -> str:
    """A number of three digits or more, or five or more characters that mix letters and digits."""
    return f"(CASE WHEN NOT {x} RLIKE '[0-9]' THEN false WHEN NOT {x} RLIKE {lit(r'\p{L}')} THEN length(regexp_replace({x}, '[^0-9]', '')) >= 3 ELSE length({x}) >= 5 END)"


def _punct(x: str) -> str:
    return f"{x} RLIKE '^[^a-z0-9]+$'"


def _alias(key: str) -> str:
    whens = " ".join(f"WHEN a = {lit(k)} OR startswith(a, {lit(k + ' ')}) THEN concat({lit(v)}, substring(a, {len(k) + 1}))" for k, v in sorted(ALIASES.items(), key=lambda kv: -len(kv[0])))
    return _bind("a", key, f"CASE {whens} ELSE a END")


def _star(text: str) -> str:
    """Which side of the first star names the merchant."""
    gateway = _bind("g", _strip("l[0]"), "size(l) = 1 AND g != '' AND (length(g) <= 3 OR g RLIKE '[0-9]')")
    named = _bind("n", f"slice(filter(transform({_words('r')}, w -> {_strip('w')}), w -> w != '' AND NOT {_punct('w')}), 1, 2)", f"size(n) = 2 AND forall(n, w -> NOT {_junk('w')} AND NOT {_in('w', CITIES + COUNTRIES)})")
    right = "coalesce(nullif(trim(r), ''), trim(b))"
    body = f"CASE WHEN size(l) = 0 OR {_in('array_join(l, chr(32))', PROCESSORS)} THEN {right} WHEN {gateway} AND {named} THEN trim(r) ELSE array_join(l, ' ') END"
    sides = _bind("b", "substring_index(s, '*', 1)", _bind("r", "substring(s, instr(s, '*') + 1)", _bind("l", _without_places(_words("b")), body)))
    return _bind("s", text, f"IF(instr(s, '*') = 0, s, {sides})")


def _normalize(d: str) -> str:
    cut = _bind("k", "array_min(filter(transform(t, (x, i) -> IF(i > 0 AND " + _junk("x") + ", i, NULL)), q -> q IS NOT NULL))", "IF(k IS NULL, t, slice(t, 1, k))")
    key = _alias(_squash(_strip(f"array_join({_without_places(cut)}, ' ')")))
    domain = f"IF(size(t) > 0 AND {_in(f'regexp_extract(t[0], {lit(DOMAIN)}, 2)', TLDS)}, {_alias(f'regexp_extract(t[0], {lit(DOMAIN)}, 1)')}, NULL)"
    rest = f"coalesce(nullif({domain}, ''), nullif({key}, ''), nullif({_strip(_squash('m'))}, ''), o)"
    body = _bind("m", _star(f"regexp_replace(o, {lit(KIND_SUFFIX)}, '')"), _bind("t", f"filter({_words('m')}, w -> NOT {_punct('w')})", rest))
    return _bind("o", f"lower(regexp_replace(coalesce({d}, ''), {lit(r'(?U)^\s+|\s+$')}, ''))", f"IF(o = '', '', {body})")


def normalize(description: str | Column) -> Column:
    """The merchant key of a description column. Never empty for a description that is not blank; '' for blank and null ones."""
    if isinstance(description, Column):
        raise TypeError("give the column's name")
    return F.expr(_normalize(f"`{description}`"))


def merchant_root(key: str | Column) -> Column:
    """The key's first word."""
    return F.substring_index(F.coalesce(F.col(key) if isinstance(key, str) else key, F.lit("")), " ", 1)


def with_merchant_key(df: DataFrame, description: str = "description_raw", out: str = "merchant_key") -> DataFrame:
    """Adds the key; computed once per distinct description and joined back."""
    keys = df.select(F.col(description).alias("_d")).distinct().withColumn(out, normalize("_d"))
    return df.join(keys, F.col(description).eqNullSafe(F.col("_d")), "left").drop("_d")
