"""Sources as a Spark data source: ``spark.read.format("folioforge").option("kind", "llms_txt").load("https://h.x")``.

Planning asks the source what it has (a link index, a repository's tree, sitemaps, a
folder's files) and deals the addresses to partitions by host; tasks fetch them. Columns
are pruned by not decoding what is not asked for. Options: kind, name, max_pages,
partitions, headers (JSON), api and raw (of a repository host), and the path as the root.

Crawls need rounds of joins over what was seen, which ``kinds.pull`` does with tables; a
site without a sitemap is an error here that says so.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import urldefrag, urljoin, urlsplit
from zlib import crc32

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import urls as U
from .fetch import A_HOST, HttpFetcher, expand_map, host_of
from .kinds import EXTENSIONS, MOST, REPOSITORY_EXTENSIONS, SourceError

SCHEMA = "source string, url string, path string, content_type string, status int, body string, error string"
PARTITIONS = 8


@dataclass
class Address:
    """A page: where it is, what its path is, what is fetched if that is another address, a content type to insist on."""

    url: str
    path: str
    fetch: str = ""
    content_type: str = ""


@dataclass
class Part(InputPartition):
    addresses: list[Address]


def page_path(url: str, index: bool = False) -> str:
    """``urls.site_path``, or ``urls.index_path``, of one address."""
    p = urlsplit(url).path
    if p in ("", "/"):
        return host_of(url) if index else "index"
    p = p + "index" if p.endswith("/") else re.sub(r"\.html?$", "", p)
    return (re.sub(r"\.md$", "", p) if index else p).removeprefix("/")


def _text(get, url: str) -> str | None:
    try:
        r = get(url, {})
    except Exception:  # noqa: BLE001  no answer is none
        return None
    return r.body.decode("utf-8", "replace") if 200 <= r.status < 300 else None


def link_index(root: str, most: int, get) -> list[Address]:
    top = re.sub(r"/llms(-full)?\.txt$", "", root).rstrip("/")
    if (_text(get, f"{top}/llms-full.txt") or "").strip():
        return [Address(f"{top}/llms-full.txt", "llms-full", content_type="text/markdown; charset=utf-8")]
    index = f"{top}/llms.txt"
    body = _text(get, index)
    if body is None:
        raise SourceError(f"{index}: no answer")
    links = [urldefrag(urljoin(index, x))[0] for x in re.findall(U.MARKDOWN_LINK, body) if not x.startswith("#") and not x.lower().startswith("mailto:")]
    links = list(dict.fromkeys(links))[:most]
    return [Address(x, page_path(x, True)) for x in links] or [Address(index, "llms", content_type="text/markdown; charset=utf-8")]


def repository(root: str, most: int, get, api: str, raw: str) -> list[Address]:
    m = re.match(U._SPEC, re.sub(r"^https?://", "", root.strip()))
    if not m:
        raise SourceError(f"{root!r} is no repository")
    owner, repo, ref, sub = (x or "" for x in m.groups())
    at, sub = f"{api}/repos/{owner}/{repo}", sub.rstrip("/")
    ref = ref or json.loads(_text(get, at) or "{}").get("default_branch") or "main"
    tree = json.loads(_text(get, f"{at}/git/trees/{ref}?recursive=1") or "{}").get("tree", [])
    files = [x["path"] for x in tree if x.get("type") == "blob" and x["path"].lower().endswith(tuple(REPOSITORY_EXTENSIONS)) and (not sub or x["path"] == sub or x["path"].startswith(sub + "/"))]
    page = f"https://github.com/{owner}/{repo}/blob/{ref}/"
    return [Address(page + f, re.sub(r"\.[^./]*$", "", f), f"{raw}/{owner}/{repo}/{ref}/{f}", "text/markdown; charset=utf-8") for f in files[:most]]


def sitemaps(root: str, most: int, get) -> list[Address]:
    """Addresses of the largest sitemap below the root's folder, indexes of sitemaps followed to a depth of three."""
    origin, folder = "/".join(root.split("/")[:3]), re.sub(r"[^/]*$", "", urlsplit(root).path or "/")
    named = re.findall(U.SITEMAP_LINE.replace("d)", ")"), _text(get, f"{origin}/robots.txt") or "")
    best: list[str] = []
    for start in [named, *([f"{origin}{d}{n}"] for d in sorted({folder, "/"}) for n in U.SITEMAPS)]:
        todo, seen, found = list(start), set(start), []
        for _ in range(4):
            bodies = [b for b in (_text(get, u) for u in todo) if b is not None]
            todo = []
            for b in bodies:
                locs, low = re.findall(U.LOC, b), b.lower()
                if "<sitemapindex" in low or ("<sitemap>" in low and "<urlset" not in low):
                    todo += [x for x in dict.fromkeys(locs) if x not in seen]
                    seen.update(locs)
                else:
                    found += [re.sub(r"[?#].*$", "", x) for x in locs]
        pages = {urlsplit(x).path: x for x in reversed(found) if urlsplit(x).path.startswith(folder) and not re.search(U.NO_PAGE, urlsplit(x).path)}
        pages = sorted(pages.values(), key=found.index)[:most]
        best = pages if len(pages) > len(best) else best
    return [Address(x, page_path(x)) for x in best]


def folder(root: str, most: int) -> list[Address]:
    top = os.path.abspath(os.path.expanduser(root.removeprefix("file://")))
    if not os.path.isdir(top):
        raise SourceError(f"{top} is no folder")
    names = []
    for where, dirs, files in os.walk(top):
        dirs[:] = [d for d in dirs if not d.startswith(".")]
        names += [os.path.relpath(os.path.join(where, f), top) for f in files if os.path.splitext(f)[1].lower() in EXTENSIONS]
    kept = sorted(names)[: most or None]
    return [Address(f"file://{top}/{n}", re.sub(r"\.[^./]*$", "", n), content_type="text/plain; charset=utf-8" if n.lower().endswith(".txt") else "text/markdown; charset=utf-8") for n in kept]


class PageReader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.kind, self.root = schema, options.get("kind", ""), options.get("path", "")
        if self.kind not in MOST:
            raise SourceError(f"unknown kind {self.kind!r}")
        self.name = options.get("name") or self.root
        self.most = int(options.get("max_pages", 0)) or MOST[self.kind]
        self.parts = int(options.get("partitions", PARTITIONS))
        self.headers = expand_map(json.loads(options.get("headers", "{}"))) or {}
        self.api, self.raw = options.get("api", "https://api.github.com"), options.get("raw", "https://raw.githubusercontent.com")

    def _get(self, url: str, headers: dict):
        return HttpFetcher()(url, self.headers | headers)

    def partitions(self) -> list[InputPartition]:
        found = {"llms_txt": lambda: link_index(self.root, self.most, self._get), "github": lambda: repository(self.root, self.most, self._get, self.api, self.raw), "website": lambda: sitemaps(self.root, self.most, self._get), "local": lambda: folder(self.root, self.most)}[self.kind]()
        if not found:
            raise SourceError(f"{self.root}: no page" + (" in a sitemap; kinds.pull also crawls" if self.kind == "website" else ""))
        dealt: dict[int, list[Address]] = {}
        for i, a in enumerate(found):  # files to any task, a host's pages to one, so that its limit holds
            dealt.setdefault(i % self.parts if self.kind == "local" else crc32(host_of(a.fetch or a.url).encode()) % self.parts, []).append(a)
        return [Part(x) for x in dealt.values()]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        names = self.schema.fieldNames()

        def one(a: Address) -> tuple:
            try:
                if self.kind == "local":
                    with open(a.url.removeprefix("file://"), "rb") as f:
                        return a, 200, "", f.read().decode("utf-8", "replace"), None
                r = self._get(a.fetch or a.url, {})
                return a, r.status, r.content_type, r.body.decode("utf-8", "replace"), None
            except Exception as e:  # noqa: BLE001  any failure is a row of its own
                return a, None, "", None, f"{type(e).__name__}: {e}"[:500]

        with ThreadPoolExecutor(A_HOST) as pool:
            for at in range(0, len(partition.addresses), 4 * A_HOST):
                rows = list(pool.map(one, partition.addresses[at : at + 4 * A_HOST]))
                columns = {"source": [self.name] * len(rows), "url": [a.url for a, *_ in rows], "path": [a.path for a, *_ in rows], "content_type": [a.content_type or t for a, _, t, *_ in rows], "body": [r[3] for r in rows], "error": [r[4] for r in rows]}
                arrays = {n: pa.array(c, pa.string()) for n, c in columns.items()} | {"status": pa.array([r[1] for r in rows], pa.int32())}
                yield pa.record_batch([arrays[n] for n in names], names=names)


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folioforge"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)
