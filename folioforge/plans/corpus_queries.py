"""Queries over documents, chunks, pages and the catalog, with the same in SQL."""

from __future__ import annotations

import uuid
from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions.tokens import tokens
from ..operators import catalog, chunking, discover, html, render, search, segments
from ..sources import kinds
from ..sources.shared import in_tasks, settled, shared_dir
from ..sources.store import Store
from . import ingest
from .base import AS_OF, conversations, corpus, entries, site_pages, table
from .search_queries import ORACLES as SEARCH

CAP = 200

# Inputs, in the words of both dialects, each made from every row of a given table.

_NL, _AT = "chr(10)", "split_part(url, '/', 3)"
LINK_INDEX = f"""'- [Intro](' || split_part(split_part(url, '#', 1), '?', 1) || '): a' || {_NL} || '- [Adv](/advanced' || page_id || ' "t")' || {_NL} || '[m](mailto:a@b) [s](#s) [Dup](' || split_part(split_part(url, '#', 1), '?', 1) || '#q)'
    || CASE page_id % 3 WHEN 0 THEN ' [b](b' || page_id || '.md) [d](../d)' WHEN 1 THEN ' [e](//' || {_AT} || '/g?x=' || page_id || ')' ELSE '' END"""
SITEMAP = f"""CASE page_id % 4 WHEN 0 THEN '<sitemapindex><sitemap><loc>https://' || {_AT} || '/s.xml</loc></sitemap></sitemapindex>' WHEN 1 THEN '<sitemap><LOC>https://' || {_AT} || '/t.xml</LOC></sitemap>'
    WHEN 2 THEN '<urlset><url><loc> ' || url || ' </loc></url><url><LOC>https://' || {_AT} || '/' || page_id || '</LOC></url></urlset>' ELSE 'nothing' END"""
ROBOTS = f"CASE page_id % 3 WHEN 0 THEN 'User-agent: *' || {_NL} || 'Sitemap: https://' || {_AT} || '/s.xml' || {_NL} || 'sitemap:  https://' || {_AT} || '/' || page_id || '.xml ' || {_NL} WHEN 1 THEN 'User-agent: ' || {_AT} ELSE 'x Sitemap: ' || url END"
REPOSITORIES = f"""CASE page_id % 6 WHEN 0 THEN {_AT} || '/r' || page_id WHEN 1 THEN {_AT} || '/r@v' || page_id WHEN 2 THEN {_AT} || '/r@v1/docs/' || page_id WHEN 3 THEN {_AT} || '/r/sub' || page_id
    WHEN 4 THEN 'github.com/' || {_AT} || '/r' || page_id ELSE 'nothing' END"""
TREE = {"path": "CASE page_id % 5 WHEN 0 THEN 'README' || page_id || '.md' WHEN 1 THEN 'docs/' || page_id || '.md' WHEN 2 THEN 'docs/b' || page_id || '.MDX' WHEN 3 THEN 'docs/x' || page_id || '.go' ELSE 'docs2/' || page_id || '.md' END", "type": "CASE WHEN page_id % 7 = 0 THEN 'tree' ELSE 'blob' END"}
STRATEGIES = "CASE WHEN url LIKE '%?%' THEN 'crawl' WHEN url LIKE '%#%' THEN 'nav' ELSE 'sitemap' END"
FAILED = {"source": _AT, "error": "CASE WHEN page_id % 4 = 0 THEN NULL ELSE 'E: ' || page_id END"}
ROOTS = f"'https://' || {_AT} || CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '/' WHEN 2 THEN '/llms.txt' ELSE '/llms-full.txt' END"


def _store(spark, sf) -> Store:
    """documents, kept in a new store."""
    store = Store(spark, f"{shared_dir(spark)}/folioforge-store-{uuid.uuid4().hex}")
    docs = corpus(spark, sf).withColumns({"token_count": T.estimate_tokens("markdown"), "content_hash": T.content_hash("markdown"), "fetched_at": F.lit(AS_OF).cast("timestamp"), "status": F.lit("ok")})
    store.replace_documents(docs)
    return store


def saved(spark, sf) -> str:
    """Where a new index of documents is saved."""
    path = f"{shared_dir(spark)}/folioforge-index-{uuid.uuid4().hex}"
    search.save(search.build(chunking.chunk(in_tasks(corpus(spark, sf)))), path)
    return path


def versions(spark, sf):
    """(an older version of documents, documents): German texts are new, French ones have
    changed, Spanish ones had other paths."""
    new = corpus(spark, sf)
    old = new.where("path NOT LIKE 'de/%'").withColumns({"markdown": F.when(F.col("path").startswith("fr/"), F.upper("markdown")).otherwise(F.col("markdown")), "path": F.when(F.col("path").startswith("es/"), F.concat("path", F.lit("-old"))).otherwise(F.col("path"))})
    return old, new


def _hashed(docs):
    return docs.select("source", "path", F.sha2("markdown", 256).alias("content_hash"))


def index_update(spark, sf):
    """A saved index of the older version, brought up to date by what changed: the best chunks of each source."""
    old, new = versions(spark, sf)
    path = f"{shared_dir(spark)}/folioforge-index-{uuid.uuid4().hex}"
    search.save(search.build(chunking.chunk(in_tasks(old))), path)
    changes = settled(catalog.changes(_hashed(old), _hashed(new)), "changes")
    fresh = new.join(changes.where("change <> 'removed'"), ["source", "path"], "left_semi")
    segments.update(search.build(chunking.chunk(fresh)), changes.where("change <> 'added'"), path)
    hits = search.search(search.load(spark, path), "pathetic worthless (idiot)", with_snippet=False)
    return hits.select("source", "path", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


def _lines(spark, sf):
    """documents with each line a paragraph, so that packing has something to pack."""
    return corpus(spark, sf).withColumn("markdown", F.replace("markdown", F.lit("\n"), F.lit("\n\n")))


def chunk_by_heading(spark, sf):
    out = chunking.chunk(conversations(spark, sf))
    return out.select("conv_id", F.array_join("heading_path", " › ").alias("heading"), "anchor", F.sha2("body", 256).alias("body_hash"), "token_count", F.col("ord").cast("int").alias("ord"))


def chunk_by_paragraph(spark, sf):
    out = chunking.chunk(_lines(spark, sf), max_tokens=CAP)
    return out.select("path", F.col("ord").cast("int").alias("ord"), "token_count", F.sha2("body", 256).alias("body_hash"))


def chunk_stats(spark, sf):
    out = chunking.chunk(corpus(spark, sf))
    return out.groupBy("source").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.max("token_count").alias("largest"))


def url_to_path(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.site_path("url").alias("site"), U.index_path("url").alias("idx"), U.host("url").alias("host"))


def scope_path(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.scope_path("url").alias("scope"), U.parent_dir("url").alias("parent"))


def url_filter_dedupe(spark, sf):
    """Pages in scope, one for each host and path: every host is a site of its own."""
    pages = table(spark, sf, "pages").select(U.host("url").alias("host"), "url", F.col("page_id").alias("pos"))
    return discover.filtered(pages, None, "/", by=("host",)).select("host", "url", "path", "pos")


def index_urls(spark, sf):
    full, index = U.index_urls("root")
    return table(spark, sf, "pages").select("page_id", F.expr(ROOTS).alias("root")).select("page_id", full.alias("full_url"), index.alias("index_url"))


def html_title(spark, sf):
    @F.pandas_udf("string")
    def title(page: pd.Series) -> pd.Series:
        return page.map(lambda p: html.title(html.parse(p or "")))

    return table(spark, sf, "pages").select("page_id", title("html").alias("title"))


def html_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(U.hrefs("html", "url")).alias("link"))


def nav_links(spark, sf):
    @F.pandas_udf("array<string>")
    def nav(page: pd.Series) -> pd.Series:
        return page.map(lambda p: html.navigation(p or ""))

    found = table(spark, sf, "pages").select("page_id", "url", F.explode(F.array_distinct(nav("html"))).alias("href"))
    return found.select("page_id", U.without(U.resolved("url", "href"), query=True).alias("link")).distinct()


def markdown_links(spark, sf):
    body = table(spark, sf, "pages").select("page_id", F.expr(LINK_INDEX).alias("body"))
    return body.select("page_id", F.posexplode(U.links_of_markdown("body", F.lit("https://e.x/docs/llms.txt"))).alias("pos", "link"))


def render_status(spark, sf):
    docs = render.render(site_pages(spark, sf))
    return docs.groupBy("status").agg(F.count("*").alias("pages"))


def render_html(spark, sf):
    docs = render.render(site_pages(spark, sf))
    return docs.select("source", "path", "title", "status", "token_count", "content_hash", "markdown")


def render_title(spark, sf):
    docs = render.render(site_pages(spark, sf).withColumn("page_id", F.regexp_extract("path", r"-(\d+)$", 1).cast("long")))
    return docs.select("page_id", "title", F.col("markdown").startswith("# ").alias("has_h1"))


def tokenize_df(spark, sf):
    terms = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(tokens("text"))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(spark, sf):
    d = table(spark, sf, "documents").select("source", F.size(tokens("text")).cast("long").alias("dl"))
    return d.groupBy("source").agg(F.count("*").alias("n"), F.sum("dl").alias("total"), F.round(F.avg("dl"), 6).alias("avgdl"))


def distinct_sources(spark, sf):
    """Sources of a saved index."""
    return search.load(spark, saved(spark, sf)).stats.select("source").orderBy("source")


def list_sources(spark, sf):
    e = table(spark, sf, "events")
    pages = e.select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("source"))
    return catalog.listed(entries(spark, sf), pages, AS_OF).select("name", "kind", F.col("page_count").cast("long").alias("page_count"), "refresh_after", "stale")


def stale_sources(spark, sf):
    return entries(spark, sf).where(catalog.stale("last_synced_at", datetime(2024, 2, 6, 4))).select("name")


def due_sources(spark, sf):
    return catalog.due(entries(spark, sf), AS_OF).select("name", "refresh")


def catalog_update(spark, sf):
    e = entries(spark, sf).select("name", "kind", "root", "refresh", F.lit(0).alias("max_pages"), F.lit(None).cast("map<string,string>").alias("headers"), F.lit(None).cast("map<string,string>").alias("cookies"), F.lit(AS_OF).cast("timestamp").alias("added_at"), "last_synced_at")
    e = catalog.added(e, "zz-new", "local", "/tmp/docs", AS_OF)
    e = catalog.updated(e, "user1", refresh="1h")
    return catalog.removed(e, "user2").select("name", "kind", "root", "refresh")


def _documents(spark, sf):
    c = corpus(spark, sf)
    return c.select("source", "url", "path", "title", "markdown", F.octet_length("markdown").alias("n"), F.sha2("markdown", 256).alias("content_hash"), F.lit(AS_OF).cast("timestamp").alias("fetched_at"), F.when(F.octet_length("markdown") < html.EMPTY, "empty").otherwise("ok").alias("status"))


def manifest(spark, sf):
    docs = _documents(spark, sf).withColumn("token_count", F.col("n").cast("int"))
    twice = docs.unionByName(docs.withColumn("fetched_at", F.col("fetched_at") - F.expr("interval 1 day")).withColumn("content_hash", F.lit("old")))
    return catalog.manifest(twice).select("source", "path", "url", "content_hash", "token_count")


def run_summary(spark, sf):
    docs = _documents(spark, sf)
    return catalog.run_summary(docs, ingest.chunks_of(docs.drop("n")))


def get_page(spark, sf):
    """One page through the store, as it is kept."""
    found = _store(spark, sf).page("src7", "en/7")
    return found.select("path", F.sha2(T.split_front_matter("content")[0], 256).alias("page_hash"))


def get_outline(spark, sf):
    c = conversations(spark, sf).select("conv_id", F.lit("conv").alias("source"), F.col("conv_id").cast("string").alias("path"), "markdown")
    return chunking.chunk(c).select("path", F.array_join("heading_path", " › ").alias("heading"), "anchor", F.col("ord").cast("int").alias("ord"))


def page_paths(spark, sf):
    return _store(spark, sf).paths("src1")


def reindex_replace(spark, sf):
    """A saved index after src1 was replaced by its shorter chunks and src2 removed."""
    path, chunks = saved(spark, sf), chunking.chunk(in_tasks(corpus(spark, sf)))
    search.save(search.build(chunks.where("source = 'src1' and octet_length(body) < 1500")), path)
    segments.remove(spark, path, ["src2"])
    return search.load(spark, path).chunks.groupBy("source").agg(F.count("*").alias("chunks"))


def incremental_changes(spark, sf):
    old, new = versions(spark, sf)
    return catalog.changes(_hashed(old), _hashed(new))


def github_spec(spark, sf):
    specs = table(spark, sf, "pages").select("page_id", F.expr(REPOSITORIES).alias("spec"))
    return specs.withColumn("s", U.repository("spec")).select("page_id", "s.owner", "s.repo", "s.ref", "s.subdir").where("owner is not null")


def tree_filter(spark, sf):
    nodes = table(spark, sf, "pages").select(F.col("page_id").alias("pos"), *(F.expr(x).alias(n) for n, x in TREE.items()))
    return kinds.tree_files(nodes, "docs").select("pos", "file", "path")


def sitemap_locs(spark, sf):
    bodies = table(spark, sf, "pages").select("page_id", F.expr(SITEMAP).alias("body"))
    return bodies.select("page_id", U.is_sitemap_index("body").alias("is_index"), F.explode_outer(U.sitemap_locs("body")).alias("loc")).withColumn("loc", F.coalesce("loc", F.lit("")))


def robots_sitemaps(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.expr(ROBOTS).alias("body")).select("page_id", F.explode(U.robots_sitemaps("body")).alias("sitemap"))


def largest_strategy(spark, sf):
    c = table(spark, sf, "pages").select(F.expr(STRATEGIES).alias("strategy"), "url", U.path("url").alias("path"), F.col("page_id").alias("pos"))
    return discover.largest(c).select("strategy", "url", "pos")


def errors_sample(spark, sf):
    fetched = table(spark, sf, "pages").select("url", *(F.expr(x).alias(n) for n, x in FAILED.items()))
    return catalog.errors_sample(fetched).select("source", "n_errors", "first_error", F.array_join("sample", ";").alias("sample"))


def crawl_reachable(spark, sf):
    """Addresses reached over the links of pages, from the first page of each host."""
    p = table(spark, sf, "pages").select("page_id", U.host("url").alias("host"), U.without("url", query=True).alias("url"), U.hrefs("html", "url").alias("links"))
    links = p.select(F.col("url").alias("src"), F.explode("links").alias("dst")).distinct()
    start = p.groupBy("host").agg(F.min_by("url", "page_id").alias("node"))
    return discover.reachable(links, start).select("node", F.col("depth").cast("int").alias("depth"))


QUERIES = {
    f.__name__: f
    for f in (
        chunk_by_heading, chunk_by_paragraph, chunk_stats, url_to_path, scope_path, url_filter_dedupe, index_urls, html_title, html_links, nav_links, markdown_links, render_status, render_html, render_title,
        tokenize_df, corpus_stats, distinct_sources, list_sources, stale_sources, due_sources, catalog_update, manifest, run_summary, get_page, get_outline, page_paths, reindex_replace,
        incremental_changes, github_spec, tree_filter, sitemap_locs, robots_sitemaps, largest_strategy, errors_sample, crawl_reachable, index_update,
    )
}

_HOST = r"lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"
_PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_STEM = r"ltrim(regexp_replace(CASE WHEN p LIKE '%/' THEN p || 'index' ELSE p END, '\.html?$', ''), '/')"
#: Bytes of text of a page's article; a shorter one than 80 is passed over for the whole body.
_ARTICLE = r"strlen(trim(replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1), '<[^>]*>', '', 'g'), '&amp;', '&')))"
_TOKENS = r"regexp_extract_all(translate(lower(text), 'äçèéêíñóöü', 'aceeeinoou'), '[\p{L}\p{N}\p{M}]+')"
_TURNS = """WITH t AS (SELECT conv_id, turn, role, '## ' || role || chr(10) || chr(10) || text AS md, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS nth FROM conversations),
    s AS (SELECT conv_id, 0 AS turn, -1 AS first, '' AS heading, '' AS anchor, '# Conversation ' || conv_id AS body FROM (SELECT DISTINCT conv_id FROM t)
      UNION ALL SELECT conv_id, turn, 0, role, role || CASE WHEN nth = 0 THEN '' ELSE '-' || nth END, regexp_replace(md, '^\\s+|\\s+$', '', 'g') FROM t),
    c AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY first, turn) - 1)::INT AS ord FROM s WHERE strlen(body) >= 24)"""
_ENTRIES = """WITH e AS (SELECT 'user' || user_id AS name, 'website' AS kind, 'https://u' || user_id || '.example/' AS root, list_value('7d', 'manual', '12h', '30d', '')[user_id % 5 + 1] AS refresh,
    max(ts) AS last_synced_at, count(*) AS page_count FROM events GROUP BY user_id)"""



def _flat(x: str) -> str:
    """SQL for an element's text in markdown: no tags, entities of these pages resolved, white space collapsed, marks escaped."""
    text = rf"trim(regexp_replace(regexp_replace(regexp_replace(replace({x}, '&quot;', chr(34)), '<[^>]*>', '', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))"
    return rf"regexp_replace({text}, '([\\`*_\[\]])', '\\\1', 'g')"


#: The pages of the given tables have an article with a heading and paragraphs, some of them bold up to a break; where it is
#: short, the whole body is shown: a list of links, a line, the article and a footer.
_RENDERED = rf"""WITH p AS (SELECT page_id, url, {_HOST} AS source, {_PATH} AS p, html, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS a, {_ARTICLE} < 80 AS short, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin,
      regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pages),
    s AS (SELECT page_id, regexp_extract(a, '(?s)<h1>(.*?)</h1>', 1) AS h, string_split(regexp_replace(a, '(?s)^.*</h1>', ''), '<p>')[2:] AS parts FROM p),
    t AS (SELECT page_id, '# ' || {_flat("h")} || coalesce((SELECT string_agg(chr(10) || chr(10) || CASE WHEN x LIKE '<b>%' THEN '**' || {_flat("x")} || '**' ELSE {_flat("x")} END, '' ORDER BY i)
      FROM (SELECT unnest(parts) AS x, unnest(range(len(parts))) AS i) WHERE {_flat("x")} <> ''), '') AS article FROM s),
    n AS (SELECT page_id, coalesce((SELECT string_agg('- [' || {_flat("x")} || '](' || origin || u || ')', chr(10) ORDER BY i) FROM (SELECT unnest(regexp_extract_all(nav, '<a href="([^"]*)">(.*?)</a>', 2)) AS x,
      unnest(regexp_extract_all(nav, '<a href="([^"]*)">(.*?)</a>', 1)) AS u, unnest(range(1000)) AS i) WHERE x IS NOT NULL), '') AS links, {_flat("regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1)")} AS ad,
      {_flat("replace(replace(regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1), '&copy;', '©'), '&middot;', '·')")} AS foot FROM p),
    m AS (SELECT page_id, CASE WHEN short THEN array_to_string(list_filter([links, ad, article, foot], lambda b: b <> ''), chr(10) || chr(10)) ELSE article END || chr(10) AS markdown FROM p JOIN t USING (page_id) JOIN n USING (page_id))
    SELECT source, CASE WHEN p IN ('', '/') THEN 'index' ELSE {_STEM} END || '-' || page_id AS path, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;?', '&', 'g')) AS title, 'ok' AS status,
      greatest(strlen(markdown) // 4, 1)::INT AS token_count, sha256(markdown) AS content_hash, markdown FROM p JOIN m USING (page_id)"""

ORACLES = {
    "chunk_by_heading": _TURNS + " SELECT conv_id, heading, anchor, sha256(body) AS body_hash, greatest(strlen(body) // 4, 1)::INT AS token_count, ord FROM c",
    "get_outline": _TURNS + " SELECT conv_id::VARCHAR AS path, heading, anchor, ord FROM c",
    "chunk_by_paragraph": rf"""WITH RECURSIVE d AS (SELECT lang || '/' || doc_id AS path, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps,
        regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '^\s+|\s+$', '', 'g') AS whole FROM documents),
      big AS (SELECT path, ps FROM d WHERE strlen(whole) // 4 > {CAP} AND strlen(whole) >= 24),
      p AS (SELECT path, unnest(ps) AS x, unnest(range(1, len(ps) + 1)) AS i FROM big),
      q AS (SELECT path, x, i, greatest(strlen(x) // 4, 1) AS t FROM p),
      r AS (SELECT path, i, 0 AS g, t AS tok FROM q WHERE i = 1
        UNION ALL SELECT q.path, q.i, CASE WHEN r.tok + q.t > {CAP} THEN r.g + 1 ELSE r.g END, CASE WHEN r.tok + q.t > {CAP} THEN q.t ELSE r.tok + q.t END FROM r JOIN q ON q.path = r.path AND q.i = r.i + 1),
      b AS (SELECT r.path, g, string_agg(x, chr(10) || chr(10) ORDER BY r.i) AS body FROM r JOIN q ON q.path = r.path AND q.i = r.i GROUP BY r.path, g),
      f AS (SELECT path, g, body FROM b WHERE strlen(body) >= 24 UNION ALL SELECT path, 0, whole FROM d WHERE strlen(whole) // 4 <= {CAP} AND strlen(whole) >= 24)
      SELECT path, (row_number() OVER (PARTITION BY path ORDER BY g) - 1)::INT AS ord, greatest(strlen(body) // 4, 1)::INT AS token_count, sha256(body) AS body_hash FROM f""",
    "chunk_stats": r"""SELECT source, count(*) AS chunks, sum(n)::BIGINT AS tokens, max(n)::INT AS largest FROM (SELECT source, strlen(b) // 4 AS n FROM (SELECT source, regexp_replace(text, '^\s+|\s+$', '', 'g') AS b FROM documents) WHERE strlen(b) >= 24) GROUP BY source""",
    "url_to_path": rf"SELECT page_id, CASE WHEN p IN ('', '/') THEN 'index' ELSE {_STEM} END AS site, CASE WHEN p IN ('', '/') THEN host ELSE regexp_replace({_STEM}, '\.md$', '') END AS idx, host FROM (SELECT page_id, {_PATH} AS p, {_HOST} AS host FROM pages)",
    "scope_path": rf"""SELECT page_id, CASE WHEN p LIKE '%/' THEN p WHEN regexp_matches(p, '\.\w+$') OR len(string_split(trim(p, '/'), '/')) > 1 THEN regexp_replace(p, '[^/]*$', '') ELSE p END AS scope,
        CASE WHEN p LIKE '%/' THEN p ELSE regexp_replace(p, '[^/]*$', '') END AS parent FROM (SELECT page_id, CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END AS p FROM pages)""",
    "url_filter_dedupe": rf"""WITH p AS (SELECT page_id AS pos, regexp_replace(url, '[?#].*$', '') AS url, {_PATH} AS path, {_HOST} AS host FROM pages),
        k AS (SELECT * FROM p WHERE path LIKE '/%' OR path = '')
        SELECT host, url, path, pos FROM (SELECT *, row_number() OVER (PARTITION BY host, path ORDER BY pos, url) AS n FROM k WHERE NOT regexp_matches(path, '(?i)\.(png|jpe?g|gif|svg|webp|ico|pdf|zip|tar|gz|mp4|mp3|woff2?|ttf|eot|css|js|json|xml|rss|atom)$')) WHERE n = 1""",
    "index_urls": r"SELECT page_id, b || '/llms-full.txt' AS full_url, b || '/llms.txt' AS index_url FROM (SELECT page_id, rtrim(regexp_replace(root, '/llms(-full)?\.txt$', ''), '/') AS b FROM (SELECT page_id, " + ROOTS + " AS root FROM pages))",
    "html_title": r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;?', '&', 'g')) AS title FROM pages",
    "html_links": r"""SELECT DISTINCT page_id, CASE WHEN l LIKE 'http%' THEN l ELSE regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || l END AS link
        FROM (SELECT page_id, url, regexp_replace(unnest(regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1)), '[?#].*$', '') AS l FROM pages)""",
    "nav_links": r"""SELECT DISTINCT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || l AS link
        FROM (SELECT page_id, url, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), 'href="([^"]+)"', 1)) AS l FROM pages)""",
    "markdown_links": rf"""WITH b AS (SELECT page_id, {LINK_INDEX} AS body, {_AT} AS host FROM pages),
        l AS (SELECT page_id, unnest(x) AS l, unnest(range(len(x))) AS i FROM (SELECT page_id, list_filter(regexp_extract_all(body, '\[[^\]]*\]\(([^)\s]+)(?:\s+"[^"]*")?\)', 1), lambda y: y NOT LIKE '#%' AND y NOT LIKE 'mailto:%') AS x FROM b)),
        r AS (SELECT page_id, i, regexp_replace(CASE WHEN l LIKE 'http%' THEN l WHEN l LIKE '//%' THEN 'https:' || l WHEN l LIKE '/%' THEN 'https://e.x' || l WHEN l LIKE '../%' THEN 'https://e.x/' || l[4:] ELSE 'https://e.x/docs/' || l END, '#.*$', '') AS link FROM l),
        f AS (SELECT page_id, link, min(i) AS i FROM r GROUP BY page_id, link)
        SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS pos, link FROM f""",
    "render_status": rf"""SELECT CASE WHEN {_ARTICLE} < 80 AND strlen(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body[^>]*>(.*)', 1), '(?s)<!--.*?-->|<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]*>', '', 'g'))) < 80
        THEN 'empty' ELSE 'ok' END AS status, count(*) AS pages FROM pages GROUP BY 1""",
    "render_html": _RENDERED,
    "render_title": rf"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;?', '&', 'g')) AS title, {_ARTICLE} >= 80 AS has_h1 FROM pages",
    "tokenize_df": f"SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({_TOKENS})) AS term FROM documents) GROUP BY term",
    "corpus_stats": f"SELECT source, count(*) AS n, sum(dl)::BIGINT AS total, round(avg(dl), 6) AS avgdl FROM (SELECT source, len({_TOKENS}) AS dl FROM documents) GROUP BY source",
    "distinct_sources": "SELECT DISTINCT source FROM documents ORDER BY source",
    "list_sources": _ENTRIES + " SELECT name, kind, page_count, CASE WHEN refresh = '' THEN '7d' ELSE refresh END AS refresh_after, last_synced_at + INTERVAL 7 DAY < TIMESTAMP '2024-02-03' AS stale FROM e",
    "stale_sources": _ENTRIES + " SELECT name FROM e WHERE last_synced_at + INTERVAL 7 DAY < TIMESTAMP '2024-02-06 04:00:00'",
    "due_sources": _ENTRIES + " SELECT name, refresh FROM e, (VALUES ('7d', 604800), ('12h', 43200), ('30d', 2592000)) AS v(r, s) WHERE refresh = r AND 1706918400 - floor(epoch(last_synced_at)) > s",
    "catalog_update": _ENTRIES + " SELECT name, kind, root, CASE WHEN name = 'user1' THEN '1h' ELSE refresh END AS refresh FROM e WHERE name <> 'user2' UNION ALL SELECT 'zz-new', 'local', '/tmp/docs', '7d'",
    "manifest": "SELECT source, lang || '/' || doc_id AS path, 'file:///' || lang || '/' || doc_id AS url, sha256(text) AS content_hash, strlen(text)::INT AS token_count FROM documents",
    "run_summary": r"""SELECT source, count(*) FILTER (WHERE n >= 80) AS pages, count(*) FILTER (WHERE n >= 80 AND m >= 24) AS chunks, count(*) FILTER (WHERE n < 80) AS skipped
        FROM (SELECT source, strlen(text) AS n, strlen(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS m FROM documents) GROUP BY source""",
    "get_page": "SELECT lang || '/' || doc_id AS path, sha256(text) AS page_hash FROM documents WHERE source = 'src7' AND lang = 'en' AND doc_id = 7",
    "page_paths": "SELECT lang || '/' || doc_id AS path FROM documents WHERE source = 'src1' ORDER BY path",
    "reindex_replace": r"""SELECT source, count(*) AS chunks FROM (SELECT source, strlen(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS n FROM documents) WHERE n >= 24 AND source <> 'src2' AND (source <> 'src1' OR n < 1500) GROUP BY source""",
    "incremental_changes": """WITH d AS (SELECT source, lang, lang || '/' || doc_id AS path, text FROM documents)
        SELECT source, path, CASE WHEN lang IN ('de', 'es') THEN 'added' ELSE 'changed' END AS change FROM d WHERE lang IN ('de', 'es') OR (lang = 'fr' AND upper(text) <> text)
        UNION ALL SELECT source, path || '-old', 'removed' FROM d WHERE lang = 'es'""",
    "index_update": SEARCH["search_bm25"],
    "github_spec": "SELECT page_id, " + ", ".join(rf"regexp_extract(spec, '^(?:github\.com/)?([^/@]+)/([^/@]+)(?:@([^/]+))?(?:/(.*))?$', {i}) AS {n}" for i, n in enumerate(("owner", "repo", "ref", "subdir"), 1)) + f" FROM (SELECT page_id, {REPOSITORIES} AS spec FROM pages) WHERE spec LIKE '%/%'",
    "tree_filter": r"SELECT page_id AS pos, path AS file, regexp_replace(path, '\.[^./]*$', '') AS path FROM (SELECT page_id, " + ", ".join(f"{x} AS {n}" for n, x in TREE.items()) + r" FROM pages) WHERE type = 'blob' AND regexp_matches(lower(path), '\.(md|markdown|mdx)$') AND path LIKE 'docs/%'",
    "sitemap_locs": r"""SELECT page_id, contains(lower(body), '<sitemapindex') OR (contains(lower(body), '<sitemap>') AND NOT contains(lower(body), '<urlset')) AS is_index, coalesce(l, '') AS loc
        FROM (SELECT page_id, """ + SITEMAP + r""" AS body FROM pages) LEFT JOIN LATERAL (SELECT unnest(regexp_extract_all(body, '(?is)<loc>\s*(.*?)\s*</loc>', 1)) AS l) ON true""",
    "robots_sitemaps": r"SELECT DISTINCT page_id, unnest(regexp_extract_all(body, '(?im)^Sitemap:\s*(\S+)\s*$', 1)) AS sitemap FROM (SELECT page_id, " + ROBOTS + " AS body FROM pages)",
    "largest_strategy": f"WITH c AS (SELECT {STRATEGIES} AS strategy, url, page_id AS pos FROM pages) SELECT strategy, url, pos FROM c WHERE strategy = (SELECT strategy FROM c GROUP BY strategy ORDER BY count(*) DESC, strategy LIMIT 1)",
    "errors_sample": "SELECT source, count(*) AS n_errors, min_by(error, url) AS first_error, array_to_string(list(error ORDER BY url)[1:3], ';') AS sample FROM (SELECT url, " + ", ".join(f"{x} AS {n}" for n, x in FAILED.items()) + " FROM pages) WHERE error IS NOT NULL GROUP BY source",
    "crawl_reachable": rf"""WITH RECURSIVE p AS (SELECT page_id, {_HOST} AS host, regexp_replace(url, '[?#].*$', '') AS url, html FROM pages),
        h AS (SELECT url, regexp_replace(unnest(regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1)), '[?#].*$', '') AS l FROM p),
        l AS (SELECT DISTINCT url AS src, CASE WHEN l LIKE 'http%' THEN l ELSE regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || l END AS dst FROM h),
        n AS (SELECT count(*) AS pages FROM p),
        r AS (SELECT min_by(url, page_id) AS node, 0 AS depth FROM p GROUP BY host UNION SELECT l.dst, r.depth + 1 FROM r JOIN l ON l.src = r.node, n WHERE r.depth < pages)
        SELECT node, min(depth)::INT AS depth FROM r GROUP BY node""",
}
