"""What the parts of the engine look like to each other, so that another can stand in their place.

All of them take and give DataFrames; none holds a page or a chunk in Python. The engine's own parts are
``sources.fetch.HttpFetcher``, the functions in ``sources.kinds.KINDS``, ``operators.render.render``,
``operators.chunking.chunk`` and ``plans.retriever.IndexRetriever``.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import TYPE_CHECKING, Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession

if TYPE_CHECKING:
    from .sources.fetch import Response
    from .sources.kinds import Request


@runtime_checkable
class Fetcher(Protocol):
    """Gets one address, inside a task; raises for what is no response at all."""

    def __call__(self, url: str, headers: Mapping[str, str]) -> Response: ...


@runtime_checkable
class Source(Protocol):
    """Pages of one source: (source, url, path, content_type, body, fetched_at)."""

    def __call__(self, spark: SparkSession, r: Request) -> DataFrame: ...


@runtime_checkable
class Renderer(Protocol):
    """Pages to documents: (source, url, path, title, markdown, token_count, content_hash, status, ...)."""

    def __call__(self, pages: DataFrame) -> DataFrame: ...


@runtime_checkable
class Chunker(Protocol):
    """Documents to chunks: (source, url, path, title, heading_path, anchor, body, token_count, ord)."""

    def __call__(self, docs: DataFrame) -> DataFrame: ...


@runtime_checkable
class Retriever(Protocol):
    """An index of chunks by source."""

    def index(self, source: str, chunks: DataFrame) -> None:
        """Add chunks to those of the source."""

    def reindex(self, source: str, chunks: DataFrame) -> None:
        """Replace the source's chunks as a whole."""

    def search(self, query: str, sources: list[str] | None = None, limit: int = 10, offset: int = 0) -> DataFrame:
        """Ranked hits, the best of each source."""

    def remove(self, source: str) -> None:
        """Forget the source's chunks."""

    def sources(self) -> DataFrame:
        """(source) of what is indexed, by name."""

    def close(self) -> None:
        """Give back what the index holds."""
