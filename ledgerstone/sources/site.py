"""A snapshot of web sites from their stored pages: links, what can be reached from the roots, and pages whose links lead to the snapshot's own files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerstone.functions.merchants import lit
from ledgerstone.sources.shared import snapshot

#: An attribute that leads to another page or file: its name, and its value between double quotes.
LINK = r'\b(href|src)="([^"]*)"'
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")]
_URL = r"(?i)^https?://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _unescaped(raw: str) -> str:
    for entity, plain in _ENTITIES:
        raw = f"replace({raw}, {lit(entity)}, {lit(plain)})"
    return raw


def _tidy(path: str) -> str:
    """A path without . and .. segments; never empty."""
    parts = f"split({path}, '/', -1)"
    kept = f"aggregate({parts}, CAST(array() AS ARRAY<STRING>), (kept, s) -> CASE s WHEN '.' THEN kept WHEN '..' THEN slice(kept, 1, greatest(size(kept) - 1, 1)) ELSE concat(kept, array(s)) END)"
    whole = f"concat(array_join({kept}, '/'), IF(element_at({parts}, -1) IN ('.', '..'), '/', ''))"
    return f"coalesce(nullif({whole}, ''), '/')"


def _key(host: str, path: str, query: str) -> str:
    return f"concat({host}, {path}, IF(length({query}) > 1, {query}, ''))"


def addressed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, query, key, html) of pages with an http or https address. The key is host, path and query: two pages of one key are one, the one of smallest id, and of equal ids the one of least text."""
    u = f"`{url_col}`"
    part = lambda k: f"regexp_extract({u}, {lit(_URL)}, {k})"
    t = pages.where(F.expr(f"{u} RLIKE {lit(_URL)}")).selectExpr(f"CAST(`{id_col}` AS BIGINT) AS page_id", f"lower({part(1)}) AS host", f"{_tidy(part(2))} AS path", f"{part(3)} AS query", f"coalesce(`{html_col}`, '') AS html")
    t = t.withColumn("key", F.expr(_key("host", "path", "query")))
    first = t.groupBy("key").agg(F.min(F.struct("page_id", F.xxhash64("html").alias("h"))).alias("first"))
    return t.join(first, "key").where(F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.xxhash64("html") == F.col("first.h"))).drop("first").dropDuplicates(["key"])


def page_links(site: DataFrame) -> DataFrame:
    """A row for each link of the pages of ``addressed``, in order: key, host, n, name, raw, and where it leads: to_host, to_path, to_query, fragment, to_key. to_host is null for what is no web address."""
    found = site.selectExpr("key", "host", "path", "query", f"posexplode(zip_with(regexp_extract_all(html, {lit(LINK)}, 1), regexp_extract_all(html, {lit(LINK)}, 2), (a, b) -> struct(a AS name, b AS raw))) AS (n, link)")
    found = found.selectExpr("key", "host", "path", "query", "n", "link.name", "link.raw", f"trim({_unescaped('link.raw')}) AS to")
    own = "concat('http://', host)"
    whole = (
        f"CASE WHEN to RLIKE '^[A-Za-z][A-Za-z0-9+.-]*:' THEN to WHEN to LIKE '//%' THEN concat('http:', to) WHEN to LIKE '/%' THEN concat({own}, to) WHEN to LIKE '?%' THEN concat({own}, path, to)"
        f" WHEN to = '' OR to LIKE '#%' THEN concat({own}, path, query, to) ELSE concat({own}, substring_index(path, '/', size(split(path, '/', -1)) - 1), '/', to) END"
    )
    found = found.withColumn("to", F.expr(whole))
    part = lambda k: f"regexp_extract(to, {lit(_URL)}, {k})"
    web = f"to RLIKE {lit(_URL)}"
    found = found.selectExpr("key", "host", "n", "name", "raw", f"IF({web}, lower({part(1)}), NULL) AS to_host", f"IF({web}, {_tidy(part(2))}, NULL) AS to_path", f"{part(3)} AS to_query", f"{part(4)} AS fragment")
    return found.withColumn("to_key", F.expr(_key("to_host", "to_path", "to_query")))


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, depth): what edges (key, to_key) lead to from the roots (key), and in how many steps at least. A round for each step; each holds its new keys only, and they are written before the next."""
    edges = snapshot(edges.select("key", "to_key").where("key <> to_key").distinct())
    parts, depth = [snapshot(roots.select("key").distinct().withColumn("depth", F.lit(0)))], 0
    while parts[-1].limit(1).count():
        depth += 1
        seen = reduce(DataFrame.unionAll, parts).select("key")
        new = parts[-1].select("key").join(edges, "key").select(F.col("to_key").alias("key")).distinct().join(seen, "key", "left_anti")
        parts.append(snapshot(new.withColumn("depth", F.lit(depth))))
    return reduce(DataFrame.unionAll, parts)


def site_snapshot(pages: DataFrame, roots: DataFrame, base: str = "", **columns) -> DataFrame:
    """The pages that links within a host reach from the roots (page_id): page_id, host, depth, file (where it lies below its host's folder) and html with its links rewritten.

    A link within the host leads to the target's file below ``base`` if the target is in the snapshot, else to its path; a fragment stays. Other links, and everything around links, stay as they are. Null html is
    an empty page; pages without a web address and roots that are no page are left out; an empty table gives no rows.
    """
    site = snapshot(addressed(pages, **columns))
    links = snapshot(page_links(site).where("to_host = host"))
    kept = snapshot(reachable(links.join(site.select(F.col("key").alias("to_key")), "to_key", "left_semi"), site.join(roots.select("page_id"), "page_id", "left_semi")))
    file = "concat(rtrim('/', path), IF(length(query) > 1, concat('/q/', left(sha1(substring(query, 2)), 12)), ''), '/')"
    there = site.join(kept, "key").withColumn("file", F.expr(file))
    target = there.select(F.col("key").alias("to_key"), "file")
    new = F.concat(F.lit(base), F.coalesce("file", "to_path"), "fragment")
    for entity, plain in [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'")]:
        new = F.replace(new, F.lit(plain), F.lit(entity))
    told = links.join(kept, "key", "left_semi").join(target, "to_key", "left").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("n", F.concat("name", F.lit('="'), new, F.lit('"'))))).alias("told"))
    rows = there.join(told, "key", "left")
    pieces = f"split(html, {lit(LINK)}, -1)"
    html = f"array_join(transform(zip_with({pieces}, regexp_extract_all(html, {lit(LINK)}, 0), (a, b) -> struct(a, b)), (x, i) -> concat(x.a, coalesce(told[i], x.b, ''))), '')"
    return rows.select("page_id", "host", "depth", "file", F.expr(html).alias("html"))
