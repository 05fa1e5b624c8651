import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from folioforge.operators import discover
from folioforge.sources import kinds
from folioforge.sources.fetch import fetched, host_of

from .test_sources import TableFetcher


class Busy(BaseHTTPRequestHandler):
    """Counts the requests to each host that run at one time."""

    now, most, lock = Counter(), Counter(), threading.Lock()

    def do_GET(self):
        host = self.headers["Host"].split(":")[0]
        with self.lock:
            self.now[host] += 1
            self.most[host] = max(self.most[host], self.now[host])
        time.sleep(0.05)
        with self.lock:
            self.now[host] -= 1
        self.send_response(200)
        self.send_header("Content-Type", "text/plain")
        self.end_headers()
        self.wfile.write(self.path.encode())

    def log_message(self, *a):
        pass


@pytest.fixture
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Busy)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s.server_address[1]
    s.shutdown()


def test_requests_a_host(spark, server):
    """Never more than the limit to one host, over all tasks, and other hosts at the same time; every address once."""
    urls = [(f"http://{h}:{server}/{i}",) for h in ("127.0.0.1", "localhost") for i in range(60)]
    got = fetched(spark.createDataFrame(urls, "url string").repartition(8), a_host=3).collect()
    assert sorted(r.url for r in got) == sorted(u for u, in urls) and all(r.url.endswith(bytes(r.body).decode()) for r in got)
    assert set(Busy.most) == {"127.0.0.1", "localhost"} and max(Busy.most.values()) <= 3 and min(Busy.most.values()) > 1


def test_host_of():
    cases = {"https://A.x:80/p": "a.x", "http://u:p@b.x/": "b.x", None: "", "": "", "no address": "", "http://[bad": ""}
    assert {u: host_of(u) for u in cases} == cases


def test_a_long_crawl_has_a_short_plan(spark, monkeypatch):
    """A chain of pages: what was visited is written now and then, and the crawl finds all of it."""
    monkeypatch.setattr(discover, "ROUNDS", 3)
    n = 11
    web = {f"https://d.x/p{i}": (200, "text/html", f"<html><a href='/p{i + 1}'>n</a></html>") for i in range(n)}
    from datetime import datetime

    r = kinds.Request("d.x", "website", "https://d.x/p0", datetime(2024, 2, 3), fetcher=TableFetcher(web))
    found = kinds.crawl(spark, r, "https://d.x/p0", ["d.x"], "/")
    assert sorted(x.path for x in found.collect()) == sorted(f"/p{i}" for i in range(n + 1))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 4
