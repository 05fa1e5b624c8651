"""Queries over text functions, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import chunking
from .base import AS_OF, conversations, table

#: White space that is trimmed from ends, for SQL.
_TRIM = r"'^\s+|\s+$'"

# Inputs, in the words of both dialects, each made from every row of a given table.

_NL = "chr(10)"
_HOST = "split_part(url, '/', 3)"
#: Markdown with line ends of several kinds, blanks before them and runs of empty lines.
MARKDOWN = f"replace(text, {_NL}, CASE doc_id % 3 WHEN 0 THEN chr(13) || {_NL} WHEN 1 THEN ' ' || chr(9) || {_NL} || {_NL} || {_NL} || {_NL} ELSE {_NL} || ' ' || {_NL} END)"
SELF_LINKS = f"CASE turn % 2 WHEN 0 THEN '## ' ELSE '  # ' END || '[' || role || '](#' || role || ') and [' || conv_id || '](http://y)' || {_NL} || 'see [' || role || '](#x)' || {_NL} || coalesce(text, '')"
SPECS = f"""CASE page_id % 7 WHEN 0 THEN url WHEN 1 THEN 'https://' || {_HOST} || '/llms.txt' WHEN 2 THEN './docs/' || page_id || '/' WHEN 3 THEN {_HOST} || '/' || page_id
    WHEN 4 THEN {_HOST} || '/repo@v' || page_id || '/docs' WHEN 5 THEN 'HTTP://' || {_HOST} || '/llms-full.txt' ELSE 'page ' || page_id END"""
LINES = f"""CASE (conv_id + turn) % 8 WHEN 0 THEN '# ' || role WHEN 1 THEN '## ' || role || ' ##' WHEN 2 THEN '####### ' || role WHEN 3 THEN '###' || role WHEN 4 THEN '##' || chr(9) || '[' || role || '](#' || role || ')'
    WHEN 5 THEN '###### ' || split_part(coalesce(text, ''), {_NL}, 1) WHEN 6 THEN '## ' ELSE split_part(coalesce(text, ''), {_NL}, 1) END"""
FRONT = f"""CASE doc_id % 4 WHEN 0 THEN '---' || {_NL} || 'title: "' || source || ': b"' || {_NL} || '# note' || {_NL} || {_NL} || 'k: ' || lang || {_NL} || 'k: w' || doc_id || {_NL} || '---' || {_NL} || {_NL} || text
    WHEN 1 THEN text WHEN 2 THEN '---' || {_NL} || 'open: 1' || {_NL} || text ELSE '---' || {_NL} || 'k: v' || doc_id || {_NL} || '---' || {_NL} || text END"""
PATHS = """CASE page_id % 8 WHEN 0 THEN '/' || split_part(url, '/', 4) || '//' || split_part(url, '/', 5) WHEN 1 THEN '../' || page_id WHEN 2 THEN 'a/./' || split_part(url, '/', 5) || '/' WHEN 3 THEN 'w' || chr(92) || page_id || '.md'
    WHEN 4 THEN 'a/../..' WHEN 5 THEN 'docs/../' || page_id || '/b' WHEN 6 THEN './' ELSE 'a/b/../' || split_part(url, '/', 4) END"""
CONTENT_TYPES = "CASE doc_id % 5 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'text/plain' WHEN 3 THEN '' ELSE 'text/x-markdown; q' END"
BODIES = f"CASE doc_id % 3 WHEN 0 THEN '# ' || text WHEN 1 THEN text ELSE text || {_NL} || '- ' || source END"
REFRESH = "CASE event_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'manual' WHEN 2 THEN event_id || 'd' WHEN 3 THEN user_id || 'h' WHEN 4 THEN user_id || 'm' WHEN 5 THEN event_type WHEN 6 THEN user_id || 's' ELSE 'never' END"
ENTRY = {
    "name": "CASE WHEN user_id % 7 = 0 THEN ' ' ELSE 'user' || user_id END", "kind": "CASE user_id % 5 WHEN 0 THEN '' WHEN 1 THEN event_type WHEN 2 THEN 'local' WHEN 3 THEN 'github' ELSE 'website' END",
    "root": "CASE WHEN event_id % 11 = 0 THEN '' ELSE 'https://u' || user_id END",
}
EXPAND = "CASE doc_id % 5 WHEN 0 THEN 'x$' || '{A}' || source WHEN 1 THEN '$' || '{B}' || source WHEN 2 THEN '$' || '{open' || source WHEN 3 THEN '$A $' || '{A}$' || '{A}' || lang ELSE source END"
FILES = "'f' || page_id || CASE page_id % 6 WHEN 0 THEN '.md' WHEN 1 THEN '.MDX' WHEN 2 THEN '.markdown' WHEN 3 THEN '.txt' WHEN 4 THEN '.png' ELSE '' END"


def _with(spark, sf, name, keys, /, **made):
    """A table's keys and what is made of its columns."""
    return table(spark, sf, name).select(*keys, *(F.expr(x).alias(n) for n, x in made.items()))


def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.estimate_tokens("text").alias("tokens"))


def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.content_hash(T.normalize_markdown("text")).alias("hash"))


def normalize_markdown(spark, sf):
    return _with(spark, sf, "documents", ["doc_id"], x=MARKDOWN).select("doc_id", F.sha2(T.normalize_markdown("x"), 256).alias("hash"))



def strip_self_links(spark, sf):
    return _with(spark, sf, "conversations", ["conv_id", "turn"], x=SELF_LINKS).select("conv_id", "turn", F.sha2(T.strip_self_links("x"), 256).alias("hash"))



def slugify(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.slugify(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("slug"))


def unique_slugs(spark, sf):
    heads = conversations(spark, sf).select("conv_id", F.posexplode(chunking.outline("markdown")).alias("pos", "h")).where("pos > 0")
    return heads.select("conv_id", F.col("pos").cast("int").alias("pos"), F.col("h.anchor").alias("anchor"))


def outline(spark, sf):
    flat = chunking.flat_outline(conversations(spark, sf))
    return flat.select("conv_id", F.col("pos").cast("int").alias("pos"), "level", "text", F.col("offset").cast("int").alias("offset"))


def source_slug(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.source_slug("url").alias("slug"))



def detect_kind(spark, sf):
    return _with(spark, sf, "pages", ["page_id"], spec=SPECS).select("page_id", "spec", T.detect_kind("spec").alias("kind"))



def derive_name(spark, sf):
    return _with(spark, sf, "pages", ["page_id"], spec=SPECS).select("page_id", T.derive_name("spec", T.detect_kind("spec")).alias("name"))



def parse_headings(spark, sf):
    lines = _with(spark, sf, "conversations", ["conv_id", "turn"], line=LINES)
    return lines.select("conv_id", "turn", T.heading_level("line").alias("level"), F.when(T.heading_level("line") > 0, T.heading_text("line")).otherwise("").alias("text"))



def front_matter_split(spark, sf):
    body, fields = T.split_front_matter("raw")
    return _with(spark, sf, "documents", ["doc_id"], raw=FRONT).select("doc_id", F.sha2(body, 256).alias("body_hash"), F.coalesce(F.try_element_at(fields, F.lit("title")), F.lit("")).alias("title"), F.coalesce(F.try_element_at(fields, F.lit("k")), F.lit("")).alias("k"), F.size(fields).alias("n"))



def front_matter_write(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.front_matter(F.lit('A "b"'), F.concat(F.lit("u"), F.col("doc_id").cast("string")), "source", F.lit(AS_OF).cast("timestamp"), F.sha2("text", 256)).alias("front"))


def normalize_path(spark, sf):
    return _with(spark, sf, "pages", ["page_id"], x=PATHS).select("page_id", T.normalize_path("x").alias("path"))



def markdown_title(spark, sf):
    return conversations(spark, sf).select("conv_id", T.markdown_title("markdown").alias("title"))


def is_markdown(spark, sf):
    return _with(spark, sf, "documents", ["doc_id"], ct=CONTENT_TYPES, body=BODIES).select("doc_id", T.is_markdown("ct", "body").alias("md"))



def trim_snippet(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.trim_snippet("text").alias("snippet"))


def human_ago(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", T.human_ago("ts", F.lit(AS_OF).cast("timestamp")).alias("ago"))


def parse_refresh(spark, sf):
    return _with(spark, sf, "events", ["event_id"], x=REFRESH).select("event_id", T.parse_refresh("x").alias("seconds"))



def entry_validate(spark, sf):
    return _with(spark, sf, "events", ["event_id"], **ENTRY).select("event_id", F.coalesce(T.entry_error("name", "kind", "root"), F.lit("ok")).alias("verdict"))



def env_expand(spark, sf):
    return _with(spark, sf, "documents", ["doc_id"], x=EXPAND).select("doc_id", U.expanded("x", {"A": "1"}).alias("y"))



def content_type_map(spark, sf):
    return _with(spark, sf, "pages", ["page_id"], name=FILES).select("page_id", U.content_type_of("name").alias("ct"))



QUERIES = {
    f.__name__: f
    for f in (
        token_estimate, content_hash, normalize_markdown, strip_self_links, slugify, unique_slugs, outline, source_slug, detect_kind, derive_name, parse_headings, front_matter_split,
        front_matter_write, normalize_path, markdown_title, is_markdown, trim_snippet, human_ago, parse_refresh, entry_validate, env_expand, content_type_map,
    )
}

_NORM = r"regexp_replace(regexp_replace(regexp_replace(replace({x}, chr(13) || chr(10), chr(10)), '(?m)[ \t]+$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') || chr(10)"

_KINDS = rf"""(SELECT page_id, spec, CASE WHEN regexp_matches(spec, '^(\.{{1,2}}/|/|~)') THEN 'local' WHEN regexp_matches(spec, '(?i)^https?://') THEN CASE WHEN regexp_matches(spec, '/llms(-full)?\.txt$') THEN 'llms_txt' ELSE 'website' END
        WHEN regexp_matches(spec, '^[A-Za-z0-9._-]+/[A-Za-z0-9._-]+(@[A-Za-z0-9._/-]+)?(/[A-Za-z0-9._/-]+)?$') THEN 'github' ELSE '' END AS kind FROM (SELECT page_id, {SPECS} AS spec FROM pages))"""

ORACLES = {
    "token_estimate": "SELECT doc_id, CASE WHEN strlen(text) = 0 THEN 0 ELSE greatest(strlen(text) // 4, 1) END::INT AS tokens FROM documents",
    "content_hash": f"SELECT doc_id, sha256({_NORM.format(x='text')}) AS hash FROM documents",
    "normalize_markdown": f"SELECT doc_id, sha256({_NORM.format(x='x')}) AS hash FROM (SELECT doc_id, {MARKDOWN} AS x FROM documents)",
    "strip_self_links": r"""SELECT conv_id, turn, sha256(array_to_string(list_transform(string_split(x, chr(10)), lambda l:
        CASE WHEN regexp_matches(l, '^[ \t]*#') THEN regexp_replace(l, '\[([^\]]+)\]\(#[^)]*\)', '\1', 'g') ELSE l END), chr(10))) AS hash FROM (SELECT conv_id, turn, """ + SELF_LINKS + " AS x FROM conversations)",
    "slugify": r"""SELECT page_id, trim(regexp_replace(regexp_replace(lower(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '[^\p{L}\p{Nd} \t_-]', '', 'g'), '[ \t_-]+', '-', 'g'), '-') AS slug FROM pages""",
    "unique_slugs": """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS pos,
        role || CASE WHEN row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1 THEN '' ELSE '-' || (row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1)::VARCHAR END AS anchor
        FROM conversations""",
    "outline": """WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos,
          strlen('## ' || role || chr(10) || chr(10) || coalesce(text, '')) + 2 AS n FROM conversations)
        SELECT conv_id, 0 AS pos, 1 AS level, 'Conversation ' || conv_id AS text, 0 AS offset FROM (SELECT DISTINCT conv_id FROM t)
        UNION ALL SELECT conv_id, pos::INT, 2, role, (strlen('# Conversation ' || conv_id) + 2 + coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT FROM t""",
    "source_slug": r"""SELECT page_id, CASE WHEN s IN ('', '.', '..') THEN 'source' ELSE s END AS slug FROM (SELECT page_id, trim(regexp_replace(lower(regexp_replace(url, '[^A-Za-z0-9.\-_ /]', '', 'g')), '[-_ /]+', '-', 'g'), '-') AS s FROM pages)""",
    "detect_kind": f"SELECT page_id, spec, kind FROM {_KINDS}",
    "derive_name": rf"""SELECT page_id, CASE WHEN kind = 'local' THEN regexp_extract(rtrim(spec, '/'), '([^/]*)$', 1) WHEN kind = 'github' THEN regexp_extract(regexp_replace(spec, '@[^/]*', ''), '^([^/]+/[^/]+)', 1)
        WHEN kind = '' THEN spec ELSE regexp_extract(spec, '(?i)^[a-z]+://([^/:?#]+)', 1) END AS name FROM {_KINDS}""",
    "parse_headings": r"""SELECT conv_id, turn, CASE WHEN t <> '' THEN length(regexp_extract(line, '^(#{1,6})[ \t]', 1)) ELSE 0 END::INT AS level, t AS text FROM (
        SELECT conv_id, turn, line, trim(regexp_replace(trim(regexp_replace(regexp_extract(line, '^#{1,6}[ \t](.*)$', 1), '#+$', '')), '\[([^\]]+)\]\(#[^)]*\)', '\1', 'g')) AS t FROM (SELECT conv_id, turn, """ + LINES + " AS line FROM conversations))",
    "front_matter_split": r"""WITH r AS (SELECT doc_id, raw, regexp_matches(raw, '(?s)^---\n.*?\n---\n') AS has, regexp_extract(raw, '(?s)^---\n(.*?)\n---\n', 1) AS fm, regexp_replace(raw, '(?s)^---\n.*?\n---\n', '') AS rest FROM (SELECT doc_id, """ + FRONT + r""" AS raw FROM documents))
        SELECT doc_id, sha256(CASE WHEN has THEN ltrim(rest, chr(10)) ELSE raw END) AS body_hash, trim(regexp_extract(fm, '(?m)^title: (.*)$', 1), '"') AS title,
          coalesce(regexp_extract_all(fm, '(?m)^k: (.*)$', 1)[-1], '') AS k,
          len(list_distinct(list_filter(regexp_extract_all(fm, '(?m)^([^#:\n][^:\n]*):', 1), lambda y: y <> '')))::INT AS n FROM r""",
    "front_matter_write": r"""SELECT doc_id, '---' || chr(10) || 'title: "A \"b\""' || chr(10) || 'url: "u' || doc_id || '"' || chr(10) || 'source: "' || source || '"' || chr(10) || 'fetched_at: "2024-02-03T00:00:00Z"' || chr(10)
        || 'content_hash: "' || sha256(text) || '"' || chr(10) || '---' || chr(10) || chr(10) AS front FROM documents""",
    # segments are folded one after the other: "." and empty ones go, ".." takes its parent, one without a parent rejects
    "normalize_path": f"""WITH RECURSIVE s AS (SELECT page_id, list_filter(string_split(replace(x, chr(92), '/'), '/'), lambda p: p NOT IN ('', '.')) AS p FROM (SELECT page_id, {PATHS} AS x FROM pages)),
        f AS (SELECT page_id, p, 1 AS i, []::VARCHAR[] AS done, false AS out FROM s
          UNION ALL SELECT page_id, p, i + 1, CASE WHEN p[i] = '..' THEN done[1:greatest(len(done) - 1, 0)] ELSE list_append(done, p[i]) END, out OR (p[i] = '..' AND len(done) = 0) FROM f WHERE i <= len(p))
        SELECT page_id, CASE WHEN out OR len(done) = 0 THEN '' ELSE regexp_replace(array_to_string(done, '/'), '\\.md$', '') || '.md' END AS path FROM f WHERE i > len(p)""",
    "markdown_title": "SELECT DISTINCT conv_id, 'Conversation ' || conv_id AS title FROM conversations",
    "is_markdown": r"""SELECT doc_id, contains(lower(ct), 'text/markdown') OR contains(lower(ct), 'text/x-markdown') OR (ct <> '' AND NOT contains(lower(ct), 'text/html') AND
        regexp_matches(body, '(?m)^(#{1,6}\s|[-*]\s|\d+\.\s|```|>\s|\[.+\]\(.+\))')) AS md FROM (SELECT doc_id, """ + CONTENT_TYPES + " AS ct, " + BODIES + " AS body FROM documents)",
    "trim_snippet": """WITH f AS (SELECT doc_id, replace(text, chr(10), ' ') AS s FROM documents),
        g AS (SELECT doc_id, s, CASE WHEN strlen(s) <= 240 THEN length(s) ELSE list_max(list_filter(range(0, 238), lambda k: strlen(s[1:k]) <= 237)) END AS n FROM f)
        SELECT doc_id, CASE WHEN strlen(s) <= 240 THEN s ELSE s[1:n] || '...' END AS snippet FROM g""",
    "human_ago": """SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 14 * 86400 THEN (s // 86400) || 'd ago'
        ELSE strftime(ts, '%Y-%m-%d') END AS ago FROM (SELECT event_id, ts, epoch(TIMESTAMP '2024-02-03')::BIGINT - floor(epoch(ts))::BIGINT AS s FROM events)""",
    "parse_refresh": r"""SELECT event_id, coalesce(try_cast(regexp_extract(x, '^([0-9]+)[smhd]$', 1) AS BIGINT) * CASE right(x, 1) WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 END, 0)::BIGINT AS seconds FROM (SELECT event_id, """ + REFRESH + " AS x FROM events)",
    "entry_validate": f"""SELECT event_id, CASE WHEN trim(name) = '' THEN 'name required' WHEN trim(kind) = '' THEN 'kind required' WHEN trim(root) = '' THEN 'root required'
        WHEN kind NOT IN ('website', 'llms_txt', 'github', 'local') THEN 'unknown kind' ELSE 'ok' END AS verdict FROM (SELECT event_id, {', '.join(f'{x} AS {n}' for n, x in ENTRY.items())} FROM events)""",
    "env_expand": r"SELECT doc_id, regexp_replace(replace(x, '${A}', '1'), '\$\{[^}]*\}', '', 'g') AS y FROM (SELECT doc_id, " + EXPAND + " AS x FROM documents)",
    "content_type_map": r"""SELECT page_id, CASE WHEN regexp_matches(lower(name), '\.(md|markdown|mdx)$') THEN 'text/markdown; charset=utf-8' WHEN regexp_matches(lower(name), '\.txt$') THEN 'text/plain; charset=utf-8'
        ELSE 'application/octet-stream' END AS ct FROM (SELECT page_id, """ + FILES + " AS name FROM pages)",
}
