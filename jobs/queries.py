"""The jobs as registered queries: each runs twice into one new folder and returns what stands there then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from folioforge.sources.shared import shared_dir

from . import link_audit, refresh_index


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_refresh_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and term statistics of documents; the second run finds nothing new."""
    out = _folder(spark, "refresh-index")
    for _ in range(2):
        refresh_index.run(spark, f"{sf_dir}/documents.parquet", out, f"{out}/checkpoint")
    return refresh_index.output(spark, out)


def job2_link_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, missing addresses and hosts; the second run writes the same again."""
    out = _folder(spark, "link-audit")
    for _ in range(2):
        link_audit.run(spark, f"{sf_dir}/pages.parquet", out)
    return link_audit.output(spark, out)


QUERIES = {f.__name__: f for f in (job1_refresh_index, job2_link_audit)}

_HOST = r"lower(regexp_extract({}, '^[a-z]+://([^/:?#]+)', 1))"
_PATH = r"regexp_extract({}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"

ORACLES = {
    "job1_refresh_index": r"""
WITH d AS (SELECT source, coalesce(lang, '') || '/' || coalesce(CAST(doc_id AS VARCHAR), '') AS path, max(coalesce(text, '')) AS text FROM documents GROUP BY ALL),
b AS (SELECT source, path, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM d),
t AS (SELECT source, path, unnest(regexp_extract_all(translate(lower(text), 'äçèéêíñóöü', 'aceeeinoou'), '[\p{L}\p{N}\p{M}]+')) AS term FROM d)
SELECT 'chunk' AS kind, source, path || '#0' AS name, CAST(greatest(strlen(body) // 4, 1) AS BIGINT) AS number, CAST(strlen(body) AS BIGINT) AS total, sha256(body) AS content FROM b WHERE strlen(body) >= 24
UNION ALL SELECT 'term', source, term, count(DISTINCT path), count(*), '' FROM t GROUP BY source, term""",
    "job2_link_audit": rf"""
WITH p AS (SELECT page_id, html, regexp_replace(url, '[?#].*$', '') AS url FROM pages),
r AS (SELECT *, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path FROM p),
h AS (SELECT page_id, url, host, regexp_replace(unnest(regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1)), '[?#].*$', '') AS l FROM r),
k AS (SELECT DISTINCT page_id, url, host, CASE WHEN l LIKE 'http%' THEN l ELSE regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || l END AS target FROM h),
l AS (SELECT page_id, url, host, target, {_HOST.format("target")} AS to_host FROM k WHERE target <> url),
o AS (SELECT page_id, url, count(*) FILTER (WHERE host = to_host) AS a, count(*) FILTER (WHERE host <> to_host) AS b FROM l GROUP BY page_id, url),
i AS (SELECT target, to_host, count(DISTINCT url) AS c FROM l GROUP BY target, to_host),
listed AS (SELECT r.host, r.url, r.page_id, min(r.page_id) OVER (PARTITION BY r.host, r.path) AS canonical_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c
  FROM r LEFT JOIN o ON o.page_id = r.page_id AND o.url = r.url LEFT JOIN i ON i.target = r.url),
s AS (SELECT *, CASE WHEN page_id <> canonical_id THEN 'repeat' WHEN c = 0 THEN 'orphan' ELSE 'linked' END AS state FROM listed),
m AS (SELECT to_host AS host, target AS url, c FROM i WHERE to_host IN (SELECT host FROM r) AND target NOT IN (SELECT url FROM r)
  AND NOT regexp_matches({_PATH.format("target")}, '(?i)\.(png|jpe?g|gif|svg|webp|ico|pdf|zip|tar|gz|mp4|mp3|woff2?|ttf|eot|css|js|json|xml|rss|atom)$'))
SELECT 'page' AS kind, host, url, page_id, canonical_id, a, b, c, state FROM s
UNION ALL SELECT 'missing', host, url, 0, 0, 0, 0, c, '' FROM m
UNION ALL SELECT 'host', host, '', 0, (SELECT count(*) FROM m WHERE m.host = s.host), count(*), count(*) FILTER (WHERE state = 'repeat'), count(*) FILTER (WHERE state = 'orphan'), '' FROM s GROUP BY host""",
}
