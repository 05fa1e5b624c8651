import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from folioforge.functions import urls as U
from folioforge.sources import datasource

WEB = {
    "/llms.txt": "# Index\n- [A](/docs/a.md): x\n- [B](docs/b \"t\")\n[m](mailto:a@b) [s](#s) [A again](/docs/a.md#x) [gone](/gone)\n",
    "/docs/a.md": "# A\ntext", "/docs/b": "<p>b</p>", "/robots.txt": "User-agent: *\nSitemap: {top}/index.xml\n",
    "/index.xml": "<sitemapindex><sitemap><loc>{top}/one.xml</loc></sitemap><sitemap><loc>{top}/two.xml</loc></sitemap></sitemapindex>",
    "/one.xml": "<urlset><url><loc> {top}/docs/a.html?x=1 </loc></url><url><loc>{top}/docs/pic.png</loc></url></urlset>", "/two.xml": "<urlset><url><loc>{top}/docs/b</loc></url><url><loc>{top}/other/c</loc></url></urlset>",
    "/docs/a.html": "<html>a</html>", "/repos/o/r": json.dumps({"default_branch": "dev"}), "/raw/o/r/dev/docs/x.md": "# X", "/raw/o/r/dev/docs/y.MDX": "# Y",
    "/repos/o/r/git/trees/dev?recursive=1": json.dumps({"tree": [{"path": p, "type": t} for p, t in (("README.md", "blob"), ("docs", "tree"), ("docs/x.md", "blob"), ("docs/y.MDX", "blob"), ("docs/z.go", "blob"))]}),
}


class Site(BaseHTTPRequestHandler):
    def do_GET(self):
        body = WEB.get(self.path)
        self.send_response(404 if body is None else 200)
        self.send_header("Content-Type", "text/html" if "." not in self.path or self.path.endswith("html") else "text/plain")
        self.end_headers()
        self.wfile.write((body or "").replace("{top}", f"http://{self.headers['Host']}").encode())

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def top():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}"
    s.shutdown()


@pytest.fixture(scope="module")
def read(spark):
    datasource.register(spark)
    return lambda root, **how: spark.read.format("folioforge").options(**how).load(root)


def test_link_index(read, top):
    rows = {r.path: r for r in read(top, kind="llms_txt", name="site").collect()}
    assert set(rows) == {"docs/a", "docs/b", "gone"} and rows["docs/a"].body == "# A\ntext" and rows["docs/b"].content_type == "text/html"
    assert rows["gone"].status == 404 and {r.source for r in rows.values()} == {"site"}
    assert [r.path for r in read(top + "/llms.txt", kind="llms_txt", max_pages=1).collect()] == ["docs/a"]


def test_sitemap_in_scope(read, top):
    found = read(f"{top}/docs/start", kind="website")
    assert sorted((r.path, r.status) for r in found.collect()) == [("docs/a", 200), ("docs/b", 200)]
    assert found.where("path = 'docs/b'").select("path", F.length("body").alias("n")).first().n == 8 and found.count() == 2


def test_repository(read, top):
    rows = sorted((r.path, r.url, r.body, r.content_type) for r in read("o/r/docs", kind="github", api=top, raw=f"{top}/raw").collect())
    assert rows == [(f"docs/{n}", f"https://github.com/o/r/blob/dev/docs/{f}", b, "text/markdown; charset=utf-8") for n, f, b in (("x", "x.md", "# X"), ("y", "y.MDX", "# Y"))]


def test_folder(read, tmp_path):
    for name in ("b.md", "sub/a.txt", ".git/x.md", "c.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"text of {name}")
    rows = sorted((r.path, r.body, r.content_type.split(";")[0]) for r in read(str(tmp_path), kind="local", partitions=2).collect())
    assert rows == [("b", "text of b.md", "text/markdown"), ("sub/a", "text of sub/a.txt", "text/plain")]


@pytest.mark.parametrize("kind,root,says", [("ftp", "x", "unknown kind"), ("github", "nothing", "no repository"), ("local", "/no/such", "no folder"), ("website", "TOP/none/at/all/", "no page")])
def test_errors(read, top, kind, root, says):
    with pytest.raises(Exception, match=says):
        read(root.replace("TOP", top), kind=kind).collect()


def test_paths_are_those_of_columns(spark):
    urls = ["https://h.x", "https://h.x/", "https://h.x/a/", "https://h.x/a/b.html?x#y", "https://H.x/a.htm", "http://u@h.x:80/a.md", "https://h.x/a.md.html", "https://h.x/index.html"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", U.site_path("u").alias("s"), U.index_path("u").alias("i"))
    assert {(r.u, r.s, r.i) for r in df.collect()} == {(u, datasource.page_path(u), datasource.page_path(u, True)) for u in urls}
