"""Named queries over the driver's tables, with equivalent SQL."""

from __future__ import annotations

from . import corpus_queries, search_queries, text_queries

FLAGSHIP = search_queries.search_bm25
QUERIES = {**search_queries.QUERIES, **corpus_queries.QUERIES, **text_queries.QUERIES}
ORACLES = {**search_queries.ORACLES, **corpus_queries.ORACLES, **text_queries.ORACLES}
