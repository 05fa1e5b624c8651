"""Fetching addresses inside tasks, with a fetcher that can be put in its place."""

from __future__ import annotations

import os
import subprocess
import urllib.error
import urllib.request
from collections import defaultdict
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Semaphore
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

TIMEOUT, MAX_BODY, MAX_REDIRECTS, THREADS = 30, 10 << 20, 10, 20
#: Requests to one host at a time, wherever its addresses stand.
A_HOST = 8


@dataclass
class Response:
    url: str
    status: int
    content_type: str = ""
    body: bytes = b""


#: (url, headers) -> Response; raises for what is no response at all.
Fetcher = Callable[[str, Mapping[str, str]], Response]


class _Redirects(urllib.request.HTTPRedirectHandler):
    """What a source is opened with does not follow to another host."""

    max_redirections = MAX_REDIRECTS

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        new = super().redirect_request(req, fp, code, msg, headers, newurl)
        if new is not None and new.host != req.host:
            for name in ("Cookie", "Authorization"):
                new.remove_header(name)
        return new


@dataclass
class HttpFetcher:
    """GET over HTTP. Any status is a response; too many redirects and too long a body are errors."""

    accept: str = "text/markdown, text/html;q=0.9, */*;q=0.5"
    agent: str = "folioforge/1"
    timeout: float = TIMEOUT
    max_body: int = MAX_BODY
    cookies: Mapping[str, str] = field(default_factory=dict)

    def __call__(self, url: str, headers: Mapping[str, str]) -> Response:
        if not url:
            raise ValueError("empty address")
        own = {"Accept": self.accept, "User-Agent": self.agent, **({"Cookie": "; ".join(f"{k}={v}" for k, v in self.cookies.items())} if self.cookies else {}), **headers}
        try:
            with urllib.request.build_opener(_Redirects()).open(urllib.request.Request(url, headers=own), timeout=self.timeout) as r:
                return self._response(r, r.geturl(), r.status)
        except urllib.error.HTTPError as e:
            if 300 <= e.code < 400:
                raise
            return self._response(e, e.geturl() or url, e.code)

    def _response(self, r, url: str, status: int) -> Response:
        body = r.read(self.max_body + 1)
        if len(body) > self.max_body:
            raise ValueError(f"{url}: body over {self.max_body} bytes")
        return Response(url, status, (r.headers.get("Content-Type") or "").strip().lower(), body)


@dataclass
class CommandFetcher:
    """A page as a browser shows it: what a command, with the address as its last word, prints."""

    command: tuple[str, ...] = ("chromium", "--headless", "--disable-gpu", "--virtual-time-budget=1000", "--dump-dom")
    timeout: float = TIMEOUT
    max_body: int = MAX_BODY

    def __call__(self, url: str, headers: Mapping[str, str]) -> Response:
        if not url.startswith(("http://", "https://")):
            raise ValueError(f"{url!r} is no address of a page")
        done = subprocess.run([*self.command, url], capture_output=True, timeout=self.timeout, check=True)
        if len(done.stdout) > self.max_body:
            raise ValueError(f"{url}: body over {self.max_body} bytes")
        return Response(url, 200, "text/html; charset=utf-8", done.stdout)


@dataclass
class TableFetcher:
    """Responses from a table, for tests and replays: address -> (status, content type, body), or an address to go on to."""

    pages: Mapping[str, tuple[int, str, str] | str]

    def __call__(self, url: str, headers: Mapping[str, str]) -> Response:
        for _ in range(MAX_REDIRECTS + 1):
            page = self.pages.get(url, (404, "text/plain", ""))
            if not isinstance(page, str):
                return Response(url, page[0], page[1].strip().lower(), page[2].encode())
            url = page
        raise ValueError(f"{url}: over {MAX_REDIRECTS} redirects")


def host_of(url: str | None) -> str:
    """Host of an address as ``urls.host`` has it: in lower case, without user and port."""
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def is_success(status: Column) -> Column:
    return (status >= 200) & (status < 300)


def expand(text: str, lookup: Callable[[str], str | None] | None = None) -> str:
    """``${NAME}`` replaced by what lookup (the environment) has, or by nothing; what is not closed stays."""
    lookup, out, at = lookup or os.environ.get, [], 0
    while (start := text.find("${", at)) >= 0 and (end := text.find("}", start)) >= 0:
        out += [text[at:start], lookup(text[start + 2 : end]) or ""]
        at = end + 1
    return "".join(out) + text[at:]


def expand_map(values: Mapping[str, str] | None, lookup: Callable[[str], str | None] | None = None) -> dict[str, str] | None:
    return {k: expand(v, lookup) for k, v in values.items()} if values else None


def fetched(urls: DataFrame, fetcher: Fetcher | None = None, headers: Mapping[str, str] | None = None, partitions: int | None = None, a_host: int = A_HOST) -> DataFrame:
    """All columns of urls(url, ...) with final_url, status, content_type, body and error; one row for each.

    Addresses are dealt to tasks by host, so a host's are all in one task; there THREADS requests run at a time, and
    ``a_host`` of them to one host. Hosts take turns inside a task, so that one with many addresses does not hold up the
    others. Headers travel in the task's closure, not in the plan.
    """
    get, headers = fetcher or HttpFetcher(), dict(headers or {})
    names = urls.columns

    def one(url: str | None) -> tuple[str | None, int | None, str | None, bytes | None, str | None]:
        try:
            r = get(url or "", headers)
            return r.url, r.status, r.content_type, r.body, None
        except Exception as e:  # noqa: BLE001  any failure is a row of its own
            return None, None, None, None, f"{type(e).__name__}: {e}"[:500]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict[str, Semaphore] = defaultdict(lambda: Semaphore(a_host))

        def in_turn(url: str | None) -> tuple:
            with slots[host_of(url)]:
                return one(url)

        with ThreadPoolExecutor(THREADS) as pool:
            for batch in batches:
                for at in range(0, batch.num_rows, 4 * THREADS):
                    part = batch.slice(at, 4 * THREADS)
                    hosts = [host_of(u) for u in part.column(part.schema.get_field_index("url")).to_pylist()]
                    for h in hosts:
                        slots[h]  # made here, in one thread
                    turn: dict[str, int] = defaultdict(int)
                    place = []
                    for i, h in enumerate(hosts):
                        place.append((turn[h], i))
                        turn[h] += 1
                    part = part.take(pa.array([i for _, i in sorted(place)], pa.int64()))
                    rows = list(pool.map(in_turn, part.column(part.schema.get_field_index("url")).to_pylist()))
                    cols = list(zip(*rows, strict=True))
                    yield pa.record_batch([*part.columns, *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string()), strict=True))], names=[*names, "final_url", "status", "content_type", "body", "error"])

    kinds = ", ".join(f"`{n}` {urls.schema[n].dataType.simpleString()}" for n in names)
    host = U.host(F.coalesce("url", F.lit("")))
    spread = urls.repartition(partitions, host) if partitions else urls.repartition(host)
    return spread.mapInArrow(run, f"{kinds}, final_url string, status int, content_type string, body binary, error string")


def ok_pages(rows: DataFrame) -> DataFrame:
    """Rows with a 2xx response, the body as text."""
    return rows.where(F.col("error").isNull() & is_success(F.col("status"))).withColumn("body", F.col("body").cast("string"))


def shown(pages: DataFrame, fetcher: Fetcher | None = None) -> DataFrame:
    """Pages fetched again as a browser shows them, with a limit of its own on what runs at a time; for ``escalate``."""
    got = ok_pages(fetched(pages.select("source", "url", "path", "fetched_at"), fetcher or CommandFetcher()))
    return got.select("source", "url", "path", "content_type", "body", "fetched_at")
