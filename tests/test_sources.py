import http.server
import threading
from datetime import datetime

import pytest

from folioforge.operators import catalog, discover
from folioforge.sources import kinds
from folioforge.sources.fetch import HttpFetcher, TableFetcher, expand, expand_map, fetched

AT = datetime(2024, 2, 3)


def page(title, nav=""):
    return f"<html><head><title>{title}</title></head><body><nav>{nav}</nav><main><h1>{title}</h1><p>" + f"content about {title} and more of it. " * 5 + "</p></main></body></html>"


WEB = {
    "https://s.x/docs": "https://s.x/docs/", "https://s.x/docs/": (200, "text/html", page("Home")), "https://s.x/docs/a": (200, "text/html", page("A")), "https://s.x/docs/b.html": (200, "text/html", page("B")),
    "https://s.x/robots.txt": (200, "text/plain", "Sitemap: https://s.x/index.xml\n"), "https://s.x/index.xml": (200, "application/xml", "<sitemapindex><sitemap><loc>https://s.x/one.xml</loc></sitemap></sitemapindex>"),
    "https://s.x/one.xml": (200, "application/xml", "<urlset><url><loc>https://s.x/docs/a?x=1</loc></url><url><loc>https://s.x/docs/b.html#f</loc></url><url><loc>https://s.x/blog/c</loc></url><url><loc>https://o.x/docs/d</loc></url><url><loc>https://s.x/docs/i.png</loc></url></urlset>"),
    "https://n.x/docs": "https://n.x/docs/", "https://n.x/docs/": (200, "text/html", page("Nav", "".join(f'<a href="/docs/p{i}?q#f">p</a>' for i in range(7)) + '<a href="mailto:x">m</a><a href="#t">t</a>')),
    **{f"https://n.x/docs/p{i}": (200, "text/html", page(f"P{i}")) for i in range(6)},
    "https://c.x/": (200, "text/html", page("Start", '<a href="/one/">1</a>')), "https://c.x/one/": (200, "text/html", page("One", '<a href="two">2</a><a href="https://other.x/">o</a>')), "https://c.x/one/two": (200, "text/html", page("Two", '<a href="/">s</a><a href="/gone">g</a>')),
    "https://l.x/llms.txt": (200, "text/plain", "# P\n- [One](https://l.x/one.md): x\n- [Two](/two)\n- [Gone](/gone)"), "https://l.x/one.md": (200, "text/markdown", "# One"), "https://l.x/two": (200, "text/html", page("Two")),
    "https://f.x/llms-full.txt": (200, "text/plain", "# Everything"), "https://e.x/llms.txt": (200, "text/plain", "# no links"), "https://g.x/llms.txt": (200, "text/plain", "[a](/a)"),
    "https://api.github.com/repos/o/r": (200, "application/json", '{"default_branch":"trunk"}'),
    "https://api.github.com/repos/o/r/git/trees/trunk?recursive=1": (200, "application/json", '{"tree":[{"path":"README.MD","type":"blob"},{"path":"docs/x.md","type":"blob"},{"path":"docs2/y.md","type":"blob"},{"path":"src","type":"tree"},{"path":"a.py","type":"blob"}],"truncated":false}'),
    "https://raw.githubusercontent.com/o/r/trunk/README.MD": (200, "text/plain", "# R"), "https://raw.githubusercontent.com/o/r/trunk/docs/x.md": (200, "text/plain", "# X"), "https://raw.githubusercontent.com/o/r/trunk/docs2/y.md": (200, "text/plain", "# Y"),
}


def pull(spark, kind, root, **how):
    rows = kinds.pull(spark, kinds.Request("name", kind, root, AT, fetcher=TableFetcher(WEB), **how)).orderBy("path").collect()
    assert all(r.source == "name" and r.fetched_at == AT for r in rows)
    return rows


def test_sitemap_site(spark):
    got = pull(spark, "website", "https://s.x/docs")
    assert [(r.url, r.path) for r in got] == [("https://s.x/docs/a", "docs/a"), ("https://s.x/docs/b.html", "docs/b")]


def test_many_sitemaps(spark):
    """All sitemaps of robots.txt and of an index are read, however many, before the source's limit on pages."""
    maps = lambda kind, urls: "".join(f"<{kind}><loc>{u}</loc></{kind}>" for u in urls)
    web = {
        "https://m.x/docs": (200, "text/html", page("Home")),
        "https://m.x/robots.txt": (200, "text/plain", "".join(f"Sitemap: https://m.x/r{i}.xml\n" for i in range(120)) + "Sitemap: https://m.x/index.xml\n"),
        **{f"https://m.x/r{i}.xml": (200, "application/xml", f"<urlset>{maps('url', [f'https://m.x/docs/r{i}'])}</urlset>") for i in range(120)},
        "https://m.x/index.xml": (200, "application/xml", f"<sitemapindex>{maps('sitemap', ['https://m.x/index.xml', *(f'https://m.x/s{i}.xml' for i in range(1100))])}</sitemapindex>"),
        **{f"https://m.x/s{i}.xml": (200, "application/xml", f"<urlset>{maps('url', [f'https://m.x/docs/s{i}'])}</urlset>") for i in range(1100)},
    }
    web |= {f"https://m.x/docs/{k}": (200, "text/html", page(k)) for k in (*(f"r{i}" for i in range(120)), *(f"s{i}" for i in range(1100)))}
    r = kinds.Request("name", "website", "https://m.x/docs", AT, fetcher=TableFetcher(web), max_pages=5000)
    maps_of = kinds._sitemap_pages(spark, r, spark.createDataFrame([("https://m.x/index.xml",)], "url string"))
    assert {x.url for x in maps_of.collect()} == {f"https://m.x/docs/s{i}" for i in range(1100)}
    got = kinds.pull(spark, r).collect()
    assert len(got) == 1220


def test_largest_strategy_and_its_hosts(spark):
    """The sitemap with most pages in scope is taken alone, and hosts that it names are the site's."""
    urls = lambda *u: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in u) + "</urlset>"
    web = {
        "https://w.x/docs/": (200, "text/html", page("Home")), "https://w.x/robots.txt": (200, "text/plain", "Sitemap: https://w.x/small.xml\n"),
        "https://w.x/small.xml": (200, "application/xml", urls("https://w.x/docs/only-here", "https://w.x/docs/a")),
        "https://w.x/sitemap.xml": (200, "application/xml", urls("https://w.x/docs/a", "https://docs.w.x/docs/b", "https://docs.w.x/docs/c", "https://w.x/blog/z")),
        **{u: (200, "text/html", page(u[-1])) for u in ("https://w.x/docs/only-here", "https://w.x/docs/a", "https://docs.w.x/docs/b", "https://docs.w.x/docs/c", "https://w.x/blog/z")},
    }
    got = kinds.pull(spark, kinds.Request("name", "website", "https://w.x/docs/", AT, fetcher=TableFetcher(web))).collect()
    assert sorted(r.url for r in got) == ["https://docs.w.x/docs/b", "https://docs.w.x/docs/c", "https://w.x/docs/a"]


def test_navigation_counts_links_before_the_scope(spark):
    nav = "".join(f'<a href="/other/p{i}">p</a>' for i in range(6)) + '<a href="/docs/a">a</a>'
    web = {"https://v.x/docs/": (200, "text/html", page("Home", nav)), "https://v.x/docs/a": (200, "text/html", page("A"))}
    got = kinds.pull(spark, kinds.Request("name", "website", "https://v.x/docs/", AT, fetcher=TableFetcher(web))).collect()
    assert sorted(r.url for r in got) == ["https://v.x/docs/", "https://v.x/docs/a"]


def test_navigation_site(spark):
    assert [r.path for r in pull(spark, "website", "https://n.x/docs")] == ["docs/index", *(f"docs/p{i}" for i in range(6))]
    assert len(pull(spark, "website", "https://n.x/docs", max_pages=3)) == 3


def test_crawled_site(spark):
    """Links are seen from the page that has them."""
    assert [r.path for r in pull(spark, "website", "https://c.x/")] == ["index", "one/index", "one/two"]
    with pytest.raises(kinds.SourceError):
        pull(spark, "website", "https://none.x/")


def test_link_index(spark):
    got = pull(spark, "llms_txt", "https://l.x")
    assert [(r.path, r.content_type) for r in got] == [("one", "text/markdown"), ("two", "text/html")]
    assert [r.path for r in pull(spark, "llms_txt", "https://f.x/")] == ["llms-full"]
    assert [(r.path, r.content_type) for r in pull(spark, "llms_txt", "https://e.x/llms.txt")] == [("llms", "text/markdown; charset=utf-8")]
    for bad in ("https://g.x", "https://none.x"):
        with pytest.raises(kinds.SourceError):
            pull(spark, "llms_txt", bad)


def test_repository(spark):
    got = pull(spark, "github", "o/r")
    assert [(r.path, r.url) for r in got][:2] == [("README", "https://github.com/o/r/blob/trunk/README.MD"), ("docs/x", "https://github.com/o/r/blob/trunk/docs/x.md")]
    assert [r.path for r in pull(spark, "github", "o/r/docs")] == ["docs/x"] and len(pull(spark, "github", "o/r", max_pages=1)) == 1
    with pytest.raises(kinds.SourceError):
        pull(spark, "github", "o/none")


def test_folder(spark, tmp_path):
    for name, body in {"a.md": "# A", "sub/b.markdown": "# B", "sub/c.TXT": "c", ".git/d.md": "no", "e.png": "no", "a.txt": "same path"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    got = pull(spark, "local", str(tmp_path))
    assert [(r.path, r.body) for r in got] == [("a", "same path"), ("sub/b", "# B"), ("sub/c", "c")] and got[1].url == f"file://{tmp_path}/sub/b.markdown"
    assert len(pull(spark, "local", f"file://{tmp_path}", max_pages=1)) == 1
    (tmp_path / "empty").mkdir()
    for bad in (str(tmp_path / "empty"), str(tmp_path / "missing"), "https://x", ""):
        with pytest.raises(kinds.SourceError):
            pull(spark, "local", bad)
    with pytest.raises(kinds.SourceError):
        pull(spark, "ftp", "x")


class Handler(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        if self.path == "/loop":
            self.send_response(302)
            self.send_header("Location", "/loop")
            self.end_headers()
        elif self.path == "/away":
            self.send_response(302)
            self.send_header("Location", f"http://127.0.0.1:{self.server.server_port}/page")
            self.end_headers()
        elif self.path == "/to":
            self.send_response(302)
            self.send_header("Location", "/page")
            self.end_headers()
        else:
            body = (self.headers.get("X-Key", "") + "|" + self.headers.get("Cookie", "")).encode() if self.path == "/page" else b"x" * 1024
            self.send_response(404 if self.path == "/missing" else 200)
            self.send_header("Content-Type", "Text/HTML; charset=utf-8 ")
            self.end_headers()
            self.wfile.write(body)

    def log_message(self, *a):
        pass


def test_http(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        assert b"c=1" in HttpFetcher(cookies={"c": "1"})(base + "/to", {}).body  # the same host
        moved = HttpFetcher(cookies={"c": "1"})(base.replace("127.0.0.1", "localhost") + "/away", {"Authorization": "x"})
        assert moved.url == base + "/page" and b"c=1" not in moved.body
        urls = spark.createDataFrame([(base + p,) for p in ("/to", "/loop", "/missing", "/big")] + [("",), (None,)], "url string")
        got = {r.url: r for r in fetched(urls, HttpFetcher(max_body=100, cookies={"c": "1"}), {"X-Key": "k"}).collect()}
        ok = got[base + "/to"]
        assert (ok.final_url, ok.status, ok.content_type, bytes(ok.body)) == (base + "/page", 200, "text/html; charset=utf-8", b"k|c=1")
        assert all(got[u].error and got[u].status is None for u in (base + "/loop", base + "/big", base + "/missing", "", None))
        assert HttpFetcher()(base + "/missing", {}).status == 404
    finally:
        server.shutdown()


def test_expand():
    lookup = {"A": "1"}.get
    assert [expand(x, lookup) for x in ("x${A}y", "${B}z", "${open", "plain", "${A}${A}")] == ["x1y", "z", "${open", "plain", "11"]
    assert expand_map({}) is None and expand_map({"k": "${A}"}, lookup) == {"k": "1"}


def test_filter_and_dedupe(spark):
    urls = ["https://h/docs/a", "https://h/docs/a#x", "https://H/docs/a/?q", "https://h/blog", "https://o/docs/b", "https://h/docs/i.PNG", "https://w.h/docs/a"]
    found = spark.createDataFrame(list(zip(urls, range(7), strict=True)), "url string, pos int")
    assert [(r.url, r.path) for r in discover.filtered(found, ["h", "w.h"], "/docs/").orderBy("pos").collect()] == [("https://h/docs/a", "/docs/a"), ("https://H/docs/a/", "/docs/a/")]
    assert discover.filtered(found, ["h"], "/", 1).count() == 1


def test_catalog(spark):
    e = spark.createDataFrame([], catalog.ENTRY)
    e = catalog.added(e, "b", "local", "/b", AT)
    e = catalog.added(e, "a", "github", "o/r", AT, refresh="12h", headers={"k": "v"})
    assert [r.name for r in e.collect()] == ["a", "b"]
    for bad in (("a", "local", "/x"), ("", "local", "/x"), ("c", "ftp", "/x"), ("c", "local", "")):
        with pytest.raises(catalog.CatalogError):
            catalog.added(e, *bad, AT)
    e = catalog.updated(e, "a", last_synced_at=datetime(2024, 2, 2, 13))
    assert [r.name for r in catalog.due(e, AT).collect()] == ["b"] and [r.name for r in catalog.due(e, datetime(2024, 2, 3, 2)).orderBy("name").collect()] == ["a", "b"]
    assert e.where(catalog.stale("last_synced_at", AT)).count() == 0 and e.where(catalog.stale("last_synced_at", datetime(2024, 2, 10))).count() == 1
    assert [r.name for r in catalog.removed(e, "a").collect()] == ["b"] and [r.name for r in catalog.chosen(e, ["b", "none"]).collect()] == ["b"]
    for f in (lambda: catalog.removed(e, "x"), lambda: catalog.updated(e, "x", refresh="1h"), lambda: catalog.chosen(e, ["x"], strict=True)):
        with pytest.raises(catalog.CatalogError):
            f()
    assert catalog.errors_sample(spark.createDataFrame([("s", f"u{i}", f"e{i}") for i in range(5)], "source string, url string, error string")).first().sample == ["e0", "e1", "e2"]
    assert catalog.manifest_map(spark.createDataFrame([("s", "p", "u", "h", AT, 1), ("s", "p", "u", "old", datetime(2023, 1, 1), 1)], "source string, path string, url string, content_hash string, fetched_at timestamp, token_count int")).first().pages["p"].content_hash == "h"


def test_reachable_over_a_hundred_hops(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(104)], "src int, dst int")
    assert sorted(map(tuple, discover.reachable(links, spark.createDataFrame([(0,)], "node int")).collect())) == [(i, i) for i in range(105)]


def test_reachable(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("a", None)], "src string, dst string")
    assert sorted(map(tuple, discover.reachable(links, spark.createDataFrame([("a",)], "node string")).collect())) == [("a", 0), ("b", 1), ("c", 2)]
    assert discover.largest(spark.createDataFrame([("z", "1"), ("a", "1"), ("m", "1"), ("m", "2")], "strategy string, url string")).select("strategy").distinct().first()[0] == "m"
