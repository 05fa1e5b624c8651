"""Ranked search over the documents, with BM25 in SQL.

SQL has no stemmer here; where a query's words share a stem with other words, the SQL
lists the forms that share it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, search
from ..sources.shared import settled
from .base import corpus, table, values

ONE, TWO, PHRASE = "pathetic", "license released", "of-to that"
COLUMNS = ("source", "path", "score", "rank")


def _index(spark, sf, stemmed=True):
    return search.build(settled(search.tokenized(chunking.chunk(corpus(spark, sf))), "chunks"), stemmed)


def _out(hits):
    return hits.select("source", "path", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


def search_bm25(spark, sf):
    """The flagship: the best chunks of each source for a query of several words."""
    return _out(search.search(_index(spark, sf), "pathetic worthless (idiot)", with_snippet=False))


def search_single_term(spark, sf):
    return _out(search.search(_index(spark, sf), ONE, limit=5, with_snippet=False))


def search_or_terms(spark, sf):
    return _out(search.search(_index(spark, sf), TWO, with_snippet=False))


def search_phrase(spark, sf):
    return _out(search.search(_index(spark, sf), PHRASE, with_snippet=False))


def search_source_filter(spark, sf):
    return _out(search.search(_index(spark, sf), "from", sources=["src1", "src2", "none"], limit=3, offset=1, with_snippet=False))


def search_global(spark, sf):
    return _out(search.search(_index(spark, sf), "scum moron", scope="global", global_limit=10, with_snippet=False))


def search_batch(spark, sf):
    """Every benchmark text as a query, terms not stemmed, the best five documents of all."""
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    out = search.search_batch(_index(spark, sf, stemmed=False), queries, limit=5)
    return out.select("query_id", "source", "path", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


def search_snippet(spark, sf):
    hits = search.search(_index(spark, sf), "trash clown", limit=2)
    return hits.select("source", "path", "snippet", F.col("rank").cast("int").alias("rank"))


def search_printed(spark, sf):
    hits = search.search(_index(spark, sf), "moron", limit=1, with_snippet=False)
    return hits.select("source", T.format_hit("rank", "source", "heading_path", "url", F.lit("-")).alias("line"))


def sanitize_query(spark, sf):
    """Every benchmark text with marks that queries may have, as a query for full-text tables."""
    return table(spark, sf, "benchmark").select("item_id", F.expr(MARKED).alias("query")).select("item_id", search.sanitized_column("query").alias("sanitized"))


#: In the words of both dialects.
MARKED = """'(' || replace(text, ', ', '): *') || CASE item_id % 3 WHEN 0 THEN ' "' || text || '" ()' WHEN 1 THEN '  ' || chr(10) || ' useState()' ELSE '"' END"""

QUERIES = {f.__name__: f for f in (search_bm25, search_single_term, search_or_terms, search_phrase, search_source_filter, search_global, search_batch, search_snippet, search_printed, sanitize_query)}

_DOCS = r"""d AS (SELECT source, lang || '/' || doc_id AS path, regexp_extract_all(translate(lower(text), 'äçèéêíñóöü', 'aceeeinoou'), '[\p{L}\p{N}\p{M}]+') AS t
      FROM documents WHERE strlen(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 24),
    l AS (SELECT source, path, len(t) AS dl FROM d)"""


def _bm25(counts: str, scope: str = "source", by: str = "") -> str:
    """SQL for scores from counts c(by, source, path, phrase, f)."""
    g = "source" if scope == "source" else ""
    k = ", ".join(x for x in (by, g, "phrase") if x)
    s = f"s AS (SELECT {'source, ' if g else ''}count(*) AS n_all, avg(dl) AS avgdl FROM l {'GROUP BY source' if g else ''})"
    n = f"n AS (SELECT {k}, count(*) AS n FROM c GROUP BY {k})"
    on = " AND ".join(f"c.{x} = n.{x}" for x in k.split(", "))
    join = "JOIN s ON s.source = c.source" if g else "CROSS JOIN s"
    first = f"c.{by}, " if by else ""
    return f"""{_DOCS}, {counts}, {s}, {n},
    r AS (SELECT {first}c.source, c.path, -sum(CASE WHEN ln((n_all - n + 0.5) / (n + 0.5)) > 0 THEN ln((n_all - n + 0.5) / (n + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
      FROM c JOIN n ON {on} JOIN l ON l.source = c.source AND l.path = c.path {join} GROUP BY {first}c.source, c.path)"""


def _forms(groups: dict[int, list[str]]) -> str:
    rows = [(p, w) for p, ws in groups.items() for w in ws]
    return f"w AS (SELECT * FROM {values('phrase, term', rows)}), c AS (SELECT source, path, phrase, count(*) AS f FROM (SELECT source, path, unnest(t) AS term FROM d) u JOIN w ON w.term = u.term GROUP BY ALL)"


def _ranked(counts: str, limit: int, offset: int = 0, scope: str = "source", partition: str = "PARTITION BY source", where: str = "true") -> str:
    return f"""WITH {_bm25(counts, scope)} SELECT source, path, round(score, 6) AS score, rank FROM (SELECT source, path, score, row_number() OVER ({partition} ORDER BY round(score, 9), source, path)::INT AS rank FROM r WHERE {where})
    WHERE rank > {offset} AND rank <= {offset + limit}"""


_PAIRS = r"""x AS (SELECT source, path, unnest(t) AS a, unnest(list_concat(t[2:], [NULL])) AS b FROM d),
    c AS (SELECT source, path, 0 AS phrase, count(*) AS f FROM x WHERE a = 'of' AND b = 'to' GROUP BY ALL UNION ALL SELECT source, path, 1, count(*) FROM x WHERE a = 'that' GROUP BY ALL)"""

_BATCH = r"""q AS (SELECT item_id AS query_id, unnest(p) AS w, unnest(range(len(p))) AS phrase FROM (SELECT item_id, list_filter(list_transform(string_split_regex(replace(text, '"', ''), '\s+'), lambda x: trim(x, '():*"''')), lambda x: x <> '') AS p FROM benchmark)),
    qt AS (SELECT query_id, phrase, regexp_extract_all(translate(lower(w), 'äçèéêíñóöü', 'aceeeinoou'), '[\p{L}\p{N}\p{M}]+') AS ts FROM q),
    p AS (SELECT source, path, unnest(t) AS term, unnest(range(len(t))) AS pos FROM d),
    one AS (SELECT query_id, source, path, phrase, count(*) AS f FROM qt JOIN p ON len(ts) = 1 AND term = ts[1] GROUP BY ALL),
    many AS (SELECT query_id, phrase, len(ts) AS size, unnest(ts) AS term, unnest(range(len(ts))) AS place FROM qt WHERE len(ts) > 1),
    start AS (SELECT query_id, source, path, phrase, pos - place AS at FROM many JOIN p USING (term) GROUP BY query_id, source, path, phrase, size, pos - place HAVING count(*) = size),
    c AS (SELECT * FROM one UNION ALL SELECT query_id, source, path, phrase, count(*) FROM start GROUP BY ALL)"""

#: Words of the query of search_snippet, and forms that share their stems.
_TRASH = {0: ["trash", "trashed", "trashes", "trashing"], 1: ["clown", "clowned", "clowning", "clowns"]}
_WORD, _FOLDED = r"'[\p{L}\p{N}\p{M}]+'", "translate(lower(x), 'äçèéêíñóöü', 'aceeeinoou')"
_IN = {p: "(" + ", ".join(f"'{x}'" for x in words) + ")" for p, words in _TRASH.items()}
#: Tokens and what lies between them; windows at each hit (h) and at the start of its sentence (s) are weighed as c, the best
#: becomes the snippet.
_SNIPPET = rf"""WITH top AS ({_ranked(_forms(_TRASH), 2)}),
    b AS (SELECT source, path, rank, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM top JOIN (SELECT source, lang || '/' || doc_id AS path, text FROM documents) USING (source, path)),
    t AS (SELECT source, path, rank, regexp_extract_all(body, {_WORD}) AS toks, string_split_regex(body, {_WORD}) AS seps FROM b),
    w AS (SELECT *, len(toks) AS n, list_transform(toks, lambda x: CASE WHEN {_FOLDED} IN {_IN[0]} THEN 0 WHEN {_FOLDED} IN {_IN[1]} THEN 1 ELSE -1 END) AS ph FROM t),
    i AS (SELECT source, path, n, unnest(ph) AS ph, unnest(range(n)) AS i, unnest(seps[1:n]) AS sep FROM w),
    h AS (SELECT source, path, n, ph, i FROM i WHERE ph >= 0),
    s AS (SELECT source, path, i AS s FROM i WHERE i = 0 OR regexp_matches(sep, '[.:][ \t\r\n]+$')),
    c AS (SELECT h.source, h.path, h.i, h.n, 0 AS kind, h.i AS low FROM h UNION ALL SELECT h.source, h.path, h.i, h.n, 1, max(s.s) FROM h JOIN s ON s.source = h.source AND s.path = h.path AND s.s <= h.i GROUP BY ALL HAVING max(s.s) < h.i AND h.n > 24),
    v AS (SELECT c.source, c.path, c.i, c.n, c.kind, c.low, 999 * count(DISTINCT x.ph) + count(*) AS worth, max(x.i) + 1 - min(x.i) AS wide
      FROM c JOIN h x ON x.source = c.source AND x.path = c.path AND x.i >= c.low AND x.i < c.low + 24 GROUP BY ALL),
    o AS (SELECT source, path, CASE WHEN kind = 1 THEN low ELSE greatest(0, least(i - (24 - wide) // 2, n - 24)) END AS begin FROM v QUALIFY row_number() OVER (PARTITION BY source, path ORDER BY worth + CASE WHEN kind = 0 THEN 0 WHEN low = 0 THEN 120 ELSE 100 END DESC, i, kind) = 1),
    f AS (SELECT w.*, coalesce(begin, 0) AS begin FROM w LEFT JOIN o USING (source, path))
    SELECT source, path, CASE WHEN begin > 0 THEN ' ... ' ELSE '' END || array_to_string(list_transform(range(begin, least(begin + 24, n)), lambda k: CASE WHEN k = begin AND begin > 0 THEN '' ELSE seps[k + 1] END
      || CASE WHEN ph[k + 1] >= 0 THEN '[' || toks[k + 1] || ']' ELSE toks[k + 1] END), '') || CASE WHEN begin + 24 >= n THEN seps[n + 1] ELSE ' ... ' END AS snippet, rank FROM f"""

ORACLES = {
    "search_bm25": _ranked(_forms({0: ["pathetic"], 1: ["worthless"], 2: ["idiot"]}), 10),
    "search_single_term": _ranked(_forms({0: ["pathetic"]}), 5),
    "search_or_terms": _ranked(_forms({0: ["license", "licensed", "licenses", "licensing"], 1: ["release", "released", "releases", "releasing"]}), 10),
    "search_phrase": _ranked(_PAIRS, 10),
    "search_source_filter": _ranked(_forms({0: ["from", "froms"]}), 3, 1, where="source IN ('src1', 'src2', 'none')"),
    "search_global": _ranked(_forms({0: ["scum"], 1: ["moron"]}), 10, scope="global", partition=""),
    "search_batch": f"""WITH {_bm25(_BATCH, "global", "query_id")} SELECT query_id, source, path, round(score, 6) AS score, rank
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), source, path)::INT AS rank FROM r) WHERE rank <= 5""",
    "search_snippet": _SNIPPET,
    "search_printed": _ranked(_forms({0: ["moron"]}), 1).replace("SELECT source, path, round(score, 6) AS score, rank FROM", "SELECT source, rank || '. ' || source || ' › (intro)' || chr(10) || '   file:///' || path || chr(10) || '   -' AS line FROM"),
    "sanitize_query": r"""SELECT item_id, array_to_string(list_transform(list_filter(list_transform(string_split_regex(replace(query, '"', ''), '\s+'), lambda w: trim(w, '():*"' || chr(39))), lambda w: w <> ''), lambda w: '"' || w || '"'), ' OR ') AS sanitized
      FROM (SELECT item_id, """ + MARKED + " AS query FROM benchmark)",
}
