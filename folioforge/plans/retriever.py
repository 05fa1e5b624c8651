"""The saved index as a retriever."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search
from ..sources.shared import settled
from ..sources.store import Store

#: Columns of a chunk that are indexed.
CHUNK = ("source", "url", "path", "title", "heading_path", "anchor", "body", "token_count", "ord")


class IndexRetriever:
    """Ranked search over the tables of ``operators.search``, kept in ``<root>/index``."""

    def __init__(self, spark: SparkSession, root: str):
        self.store = Store(spark, root)

    def _chunks(self, source: str, chunks: DataFrame) -> DataFrame:
        return chunks.withColumn("source", F.lit(source)).select(*CHUNK)

    def _saved(self, source: str) -> DataFrame:
        return self.store.index().chunks.where(F.col("source") == source).select(*CHUNK)

    def index(self, source: str, chunks: DataFrame) -> None:
        """Chunks beside those that the source has; one at the same path and place is replaced."""
        new = settled(self._chunks(source, chunks), "new")
        if self.store.exists("index/chunks"):
            new = new.unionByName(self._saved(source).join(new.select("path", "ord").distinct(), ["path", "ord"], "left_anti"))
        self._save(new)

    def reindex(self, source: str, chunks: DataFrame) -> None:
        """The source's chunks replaced as a whole; no chunk at all leaves none."""
        new = settled(self._chunks(source, chunks), "new")
        if new.isEmpty():
            self.remove(source)
        else:
            self._save(new)

    def _save(self, chunks: DataFrame) -> None:
        # written first: the tables that it may be read from are replaced
        self.store.replace_index(settled(chunks, "chunks"))

    def search(self, query: str, sources: list[str] | None = None, limit: int = search.LIMIT, offset: int = 0) -> DataFrame:
        return search.search(self.store.index(), query, sources, limit, offset)

    def remove(self, source: str) -> None:
        self.store.remove_source(source, keep_documents=True)

    def sources(self) -> DataFrame:
        return self.store.index().stats.select("source").distinct().orderBy("source")

    def close(self) -> None:
        """Tables hold nothing open."""
