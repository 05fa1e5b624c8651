"""From pages to an index: render, chunk, store, index, summarise."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog, chunking, render
from ..sources import kinds
from ..sources.shared import settled
from ..sources.store import Store


@dataclass
class Result:
    """What a run did for one source."""

    source: str
    kind: str
    pages: int
    chunks: int
    skipped: int
    errors: list[str]
    started_at: datetime
    ended_at: datetime


def documents_of(pages: DataFrame, escalate=None) -> DataFrame:
    """Rendered pages with status, written once: three readers follow."""
    docs = settled(render.render(pages), "documents")
    return settled(render.escalated(pages, docs, escalate), "escalated") if escalate else docs


def chunks_of(documents: DataFrame, **how) -> DataFrame:
    """Chunks of documents with status ok."""
    return chunking.chunk(documents.where("status = 'ok'").drop("status", "content_hash", "fetched_at", "content_type", "token_count"), **how)


def _indexed(documents: DataFrame) -> DataFrame:
    """(source, path, content_hash) for ``catalog.changes``: what of a document is in its chunks."""
    return documents.select("source", "path", F.sha2(F.concat_ws("\0", F.coalesce("url", F.lit("")), F.coalesce("title", F.lit("")), "content_hash"), 256).alias("content_hash"))


def ingest(store: Store, pages: DataFrame, escalate=None, kept: DataFrame | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """Store and index pages of any number of sources at once, each replaced as a whole by them and the documents
    ``kept``. -> (documents, chunks)

    Only documents that are new or changed since they were stored are chunked and indexed; pages that are gone leave the
    index. The index comes first: if the run ends in between, the next one finds the same changes. With settings of its
    own (``how``) all documents are chunked again.
    """
    docs = documents_of(pages, escalate)
    if kept is not None:  # written first: the tables that it is read from are replaced
        docs = settled(docs.unionByName(kept.select([c for c in kept.columns if c in docs.columns]), allowMissingColumns=True), "merged")
    ok = docs.where("status = 'ok'")
    if how:
        chunks = settled(chunks_of(docs, **how), "chunks")
        store.replace_index(chunks)
        store.replace_documents(ok)
        return docs, chunks
    sources = docs.select("source").distinct()
    changes = settled(catalog.changes(_indexed(store.documents().join(sources, "source", "left_semi")), _indexed(ok)), "changes")
    new = docs.join(changes.where("change != 'removed'"), ["source", "path"], "left_semi")
    store.update_index(chunks_of(new), changes.where("change != 'added'"))
    store.replace_documents(ok)
    return docs, store.index().chunks.join(sources, "source", "left_semi")


def run(store: Store, requests: list[kinds.Request], clock=datetime.utcnow, escalate=None) -> list[Result]:
    """Pull sources and ingest their pages in one go; a source that fails has its error in its result."""
    started, pages, errors = clock(), None, {}
    for r in requests:
        try:
            got = kinds.pull(store.spark, r)
            pages = got if pages is None else pages.unionByName(got)
        except kinds.SourceError as e:
            errors[r.name] = [str(e)]
    counts = {}
    if pages is not None:
        docs, chunks = ingest(store, pages, escalate)
        counts = {x.source: x for x in catalog.run_summary(docs, chunks).collect()}
    ended = clock()
    zero = lambda name: (counts[name].pages, counts[name].chunks, counts[name].skipped) if name in counts else (0, 0, 0)
    return [Result(r.name, r.kind, *zero(r.name), errors.get(r.name, []), started, ended) for r in requests]


def rebuilt(store: Store, sources: list[str] | None = None) -> DataFrame:
    """Chunks again from stored documents, and the index from them."""
    docs = store.documents()
    docs = docs.where(F.col("source").isin(sources)) if sources else docs
    chunks = settled(chunks_of(docs.withColumn("status", F.lit("ok"))), "chunks")
    store.replace_index(chunks)
    return chunks
