import hashlib
import html
import random
import re
from urllib.parse import urljoin, urlsplit

from ledgerstone.sources import site

LINK = re.compile(r'\b(href|src)="([^"]*)"')


def key(url):
    u = urlsplit(url)
    return u.netloc.lower() + (u.path or "/") + (f"?{u.query}" if u.query else "")


def file_of(url):
    u = urlsplit(url)
    return (u.path or "/").rstrip("/") + (f"/q/{hashlib.sha1(u.query.encode()).hexdigest()[:12]}" if u.query else "") + "/"


def crawl(pages, roots, base):
    """A plain loop over a queue."""
    by_key = {}
    for i, u, h in sorted(pages, key=lambda p: p[0]):
        if re.match("https?://", u or ""):
            by_key.setdefault(key(u), (i, u, h or ""))
    target = lambda u, raw: urljoin(u, html.unescape(raw).strip())
    inside = lambda u, t: re.match("https?:", t) and urlsplit(t).netloc.lower() == urlsplit(u).netloc.lower()
    depth, queue = {k: 0 for k, p in by_key.items() if p[0] in roots}, [k for k, p in by_key.items() if p[0] in roots]
    for k in queue:
        for _, raw in LINK.findall(by_key[k][2]):
            t = target(by_key[k][1], raw)
            if inside(by_key[k][1], t) and key(t) in by_key and key(t) not in depth:
                depth[key(t)] = depth[k] + 1
                queue.append(key(t))
    out = []
    for k, n in depth.items():
        i, u, h = by_key[k]

        def new(m, u=u):
            t = target(u, m[2])
            if not inside(u, t):
                return m[0]
            to = file_of(by_key[key(t)][1]) if key(t) in depth else urlsplit(t).path or "/"
            fragment = "#" + urlsplit(t).fragment if urlsplit(t).fragment else ""
            return f'{m[1]}="{html.escape(base + to + fragment)}"'

        out.append((i, urlsplit(u).netloc.lower(), n, file_of(u), LINK.sub(new, h)))
    return sorted(out)


def test_snapshot_equals_a_crawl(spark):
    rng = random.Random(7)
    paths = ["/", "/a", "/a/", "/a/b", "/a/b/c.html", "/d?x=1&y=2", "/d?x=2", "/é", "/a/q"]
    urls = [f"http://{h}{p}" for h in ("One.example", "two.example") for p in paths]
    raws = ["/a", "b", "../a", "./", "..", "c.html", "?x=1&amp;y=2", "/d?x=2#top", "#here", "", "//two.example/a/b", "https://one.example/a/b/c.html", "mailto:x@y", "/none", "/a/./b/../q", " /d?x=1&amp;y=2 ", "/é", "javascript:void(0)", "/a?&lt;"]
    pages = [(i, u, "".join(f'<p>{i}<a class="x" {rng.choice(["href", "src"])}="{rng.choice(raws)}">&amp;$1\\</a>' for _ in range(rng.randint(0, 4)))) for i, u in enumerate(urls)]
    pages += [(50, "http://one.example/a", "later copy"), (51, "ftp://one.example/x", "x"), (52, None, "y"), (53, "http://two.example", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for roots in ([0, 9], [3], [99]):
        got = site.site_snapshot(df, spark.createDataFrame([(r,) for r in roots], "page_id long"), base="/base")
        assert sorted(tuple(r) for r in got.collect()) == crawl(pages, roots, "/base")
    assert site.site_snapshot(df.limit(0), df.select("page_id")).collect() == []


def test_depth_of_a_chain(spark):
    edges = spark.createDataFrame([(f"k{i}", f"k{i + 1}") for i in range(7)] + [("k7", "k2"), ("k3", "k3"), ("z", "y")], "key string, to_key string")
    got = site.reachable(edges, spark.createDataFrame([("k0",)], "key string"))
    assert {r.key: r.depth for r in got.collect()} == {f"k{i}": i for i in range(8)}
