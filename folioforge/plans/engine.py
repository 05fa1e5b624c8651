"""The engine as its users call it: seven tools, three of which change something."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog, search
from ..sources import kinds
from ..sources.fetch import Fetcher, shown
from ..sources.store import Store
from . import ingest


class ReadOnly(PermissionError):
    """The engine was opened for reading."""


class Engine:
    """search_docs, get_page, list_sources, get_outline; refresh_source, add_source, remove_source unless read_only."""

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False, fetcher: Fetcher | None = None, clock=datetime.utcnow, browser: Fetcher | None = None):
        self.store, self.read_only, self.fetcher, self.clock, self.browser = Store(spark, root), read_only, fetcher, clock, browser

    @property
    def tools(self) -> list[str]:
        return ["search_docs", "get_page", "list_sources", "get_outline", *([] if self.read_only else ["refresh_source", "add_source", "remove_source"])]

    def search_docs(self, query: str, sources: list[str] | None = None, limit: int = search.LIMIT, as_of: datetime | None = None, global_limit: int | None = None, kind: str | None = None) -> DataFrame:
        """Hits with freshness, the best of each source, of those of one kind if it is given, in order of sources."""
        entries = catalog.chosen(self.store.entries(), sources)
        names = [r.name for r in (entries.where(F.col("kind") == kind) if kind else entries).select("name").collect()]
        hits = search.search(self.store.index(), query, names or [""], limit, global_limit=global_limit)
        fresh = self.store.entries().select(F.col("name").alias("source"), "last_synced_at")
        out = hits.join(fresh, "source", "left").withColumn("stale", catalog.stale("last_synced_at", as_of or self.clock()))
        return out.select("source", "url", "path", "heading_path", "anchor", "snippet", "token_count", "last_synced_at", "stale", "score", "rank").orderBy("source", "rank")

    def get_page(self, source: str, path: str | None = None, url: str | None = None) -> str | None:
        """A page by its path, or by its address; none if there is no such page."""
        if (path is None) == (url is None):
            raise ValueError("a page has a path or an address")
        row = (self.store.page(source, path.removesuffix(".md")) if url is None else self.store.page(source, url=url)).first()
        return row.content if row else None

    def list_sources(self, as_of: datetime | None = None) -> DataFrame:
        return catalog.listed(self.store.entries(), self.store.documents(), as_of or self.clock())

    def get_outline(self, sources: list[str] | None = None) -> DataFrame:
        """A row for each chunk: where it stands and how to get there."""
        chunks = self.store.index().chunks
        chunks = chunks.where(F.col("source").isin(sources)) if sources else chunks
        return chunks.select("source", "path", "url", "title", "heading_path", "anchor", "ord").orderBy("source", "path", "ord")

    def _changing(self) -> None:
        if self.read_only:
            raise ReadOnly("the engine was opened for reading")

    def add_source(self, spec: str, name: str | None = None, kind: str | None = None, refresh: str = catalog.DEFAULT_REFRESH, max_pages: int = 0, headers: dict | None = None, cookies: dict | None = None, pull: bool = False, render: bool = False) -> str:
        self._changing()
        found = self.store.spark.range(1).select(T.detect_kind(F.lit(spec)).alias("kind")).first().kind
        kind = kind or found
        if not kind:
            raise catalog.CatalogError(f"what kind is {spec!r}?")
        name = name or self.store.spark.range(1).select(T.derive_name(F.lit(spec), F.lit(kind)).alias("n")).first().n
        if name in (".", ".."):
            raise catalog.CatalogError(f"{name!r} is no name")
        self.store.save_entries(catalog.added(self.store.entries(), name, kind, spec, self.clock(), refresh, max_pages, headers, cookies))
        if pull:
            self.refresh_source([name], render=render)
        return name

    def refresh_source(self, names: list[str] | None = None, escalate=None, render: bool = False) -> list[ingest.Result]:
        """Pull sources, all of them if none is named. An unknown name is an error. With ``render``, pages that come out
        empty are fetched again by the engine's browser."""
        self._changing()
        if render and escalate is None:
            escalate = lambda pages: shown(pages, self.browser)
        entries = catalog.chosen(self.store.entries(), names, strict=True).collect()
        at = self.clock()
        requests = [kinds.Request(e.name, e.kind, e.root, at, e.max_pages or 0, e.headers or {}, self.fetcher, e.cookies or {}) for e in entries]
        results = ingest.run(self.store, requests, self.clock, escalate)
        now = self.store.entries()
        for r in results:
            if not r.errors:
                now = catalog.updated(now, r.source, last_synced_at=r.ended_at)
        self.store.save_entries(now)
        return [replace(r) for r in results]

    def refresh_due(self, as_of: datetime | None = None) -> list[ingest.Result]:
        """Pull the sources whose interval has passed."""
        names = [r.name for r in catalog.due(self.store.entries(), as_of or self.clock()).collect()]
        return self.refresh_source(names) if names else []

    def remove_source(self, name: str, keep_pages: bool = False) -> None:
        """Forget a source, its index and, unless they are kept, its pages."""
        self._changing()
        self.store.save_entries(catalog.removed(self.store.entries(), name))
        self.store.remove_source(name, keep_pages)

    def compact(self) -> int:
        """Merge what updates have left of the index and delete what no search needs any more."""
        self._changing()
        return self.store.compact_index()

    def reindex(self, sources: list[str] | None = None) -> int:
        self._changing()
        return ingest.rebuilt(self.store, sources).count()
