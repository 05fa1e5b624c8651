"""Addresses as Column expressions: parts, resolution, page paths and scopes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import C, _c, let

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def part(url: C, k: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query with "?", 5 fragment with "#"; empty if absent."""
    return F.coalesce(F.regexp_extract(_c(url), _PARTS, k), F.lit(""))


def path(url: C) -> Column:
    return part(url, 3)


def host(url: C) -> Column:
    """Host name in lower case, without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), r"^.*@", ""), r":\d*$", ""))


def without(url: C, query: bool = False) -> Column:
    """Without the fragment, and without the query if asked."""
    return F.regexp_replace(_c(url), r"(?s)[?#].*$" if query else r"(?s)#.*$", "")


def _clean(p: Column) -> Column:
    """An absolute path without "." and ".." segments; a path that ends in one of them ends in "/"."""
    parts = F.split(p, "/", -1)
    step = lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))
    folded = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step)
    ends = p.rlike(r"/\.{1,2}$")
    out = F.concat(F.array_join(folded, "/"), F.when(ends, F.lit("/")).otherwise(F.lit("")))
    return F.when(p.rlike(r"(^|/)\.{1,2}(/|$)"), F.when(out.startswith("/"), out).otherwise(F.concat(F.lit("/"), out))).otherwise(p)


def resolved(base: C, ref: C) -> Column:
    """``ref`` seen from ``base``, an absolute address."""
    b, r = _c(base), _c(ref)
    origin = F.concat(part(b, 1), F.lit("://"), part(b, 2))
    base_path = F.when(path(b) == "", F.lit("/")).otherwise(path(b))
    folder = F.regexp_replace(base_path, r"[^/]*$", "")
    tail = F.concat(part(r, 4), part(r, 5))
    return (
        F.when(part(r, 1) != "", F.when(part(r, 2) != "", F.concat(part(r, 1), F.lit("://"), part(r, 2), _clean(path(r)), tail)).otherwise(r))
        .when(part(r, 2) != "", F.concat(part(b, 1), F.lit("://"), part(r, 2), _clean(path(r)), tail))
        .when(path(r).startswith("/"), F.concat(origin, _clean(path(r)), tail))
        .when(path(r) != "", F.concat(origin, _clean(F.concat(folder, path(r))), tail))
        .when(part(r, 4) != "", F.concat(origin, base_path, tail))
        .otherwise(F.concat(without(b), part(r, 5)))
    )


def _stem(p: Column, more: bool) -> Column:
    p = F.when(p.endswith("/"), F.concat(p, F.lit("index"))).otherwise(p)
    p = F.when(p.endswith(".html"), F.regexp_replace(p, r"\.html$", "")).when(p.endswith(".htm"), F.regexp_replace(p, r"\.htm$", "")).otherwise(p)
    if more:
        p = F.regexp_replace(p, r"\.md$", "")
    return F.regexp_replace(p, "^/", "")


def site_path(url: C) -> Column:
    """A page's path from its address: without leading "/" and HTML endings, a folder's is "index"."""
    p = path(url)
    return F.when(p.isin("", "/"), F.lit("index")).otherwise(_stem(p, False))


def index_path(url: C) -> Column:
    """The same for pages of a link index: the top is named by the host, ".md" goes too."""
    p = path(url)
    return F.when(p.isin("", "/"), host(url)).otherwise(_stem(p, True))


def index_urls(root: C) -> tuple[Column, Column]:
    """(full text, link index) addresses of a site or of either of them."""
    top = F.regexp_replace(F.regexp_replace(_c(root), r"/llms(-full)?\.txt$", ""), "/+$", "")
    return F.concat(top, F.lit("/llms-full.txt")), F.concat(top, F.lit("/llms.txt"))


#: Endings that are no pages, links of markdown, of HTML, of sitemaps and of robots files, usual sitemap names.
NO_PAGE = r"(?i)\.(png|jpe?g|gif|svg|webp|ico|pdf|zip|tar|gz|mp4|mp3|woff2?|ttf|eot|css|js|json|xml|rss|atom)$"
MARKDOWN_LINK = r'\[[^\]]*\]\(([^)\s]+)(?:\s+"[^"]*")?\)'
HREF = r"""(?i)href=["']([^"']+)["']"""
LOC = r"(?is)<loc>\s*(.*?)\s*</loc>"
SITEMAP_LINE = r"(?imd)^Sitemap:\s*(\S+)\s*$"
SITEMAPS = ("sitemap.xml", "sitemap_index.xml", "sitemap-0.xml")


def scope_path(url: C) -> Column:
    """The folder in which a site's pages are looked for: that of a file or of a deeper path; a folder, the top and a
    single segment stand for themselves."""
    p = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    file = p.rlike(r"\.\w+$")
    deep = F.size(F.split(F.regexp_replace(p, "^/+|/+$", ""), "/", -1)) > 1
    return F.when(p.endswith("/") | ~(file | deep), p).otherwise(F.regexp_replace(p, r"[^/]*$", ""))


def parent_dir(url: C) -> Column:
    """The folder of an address's path, with "/" at its end."""
    p = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    return F.when(p.endswith("/"), p).otherwise(F.regexp_replace(p, r"[^/]*$", ""))


def in_scope(url: C, scope: C) -> Column:
    return (_c(scope) == "/") | F.startswith(path(url), _c(scope))


def links_of_markdown(body: C, base: C) -> Column:
    """Absolute addresses of inline links, first ones first, each once; none into the page itself, no mail."""
    found = F.filter(F.regexp_extract_all(F.coalesce(_c(body), F.lit("")), F.lit(MARKDOWN_LINK), F.lit(1)), lambda x: (x != "") & ~x.startswith("#") & ~F.lower(x).startswith("mailto:"))
    return F.array_distinct(F.transform(found, lambda x: without(resolved(base, x))))


def hrefs(page: C, base: C) -> Column:
    """Absolute addresses of a page's links without query and fragment, each once."""
    found = F.filter(F.regexp_extract_all(F.coalesce(_c(page), F.lit("")), F.lit(HREF), F.lit(1)), lambda x: ~x.rlike(r"^(?i)(#|javascript:|mailto:)"))
    return F.array_distinct(F.transform(found, lambda x: without(resolved(base, x), query=True)))


def sitemap_locs(body: C) -> Column:
    return F.regexp_extract_all(F.coalesce(_c(body), F.lit("")), F.lit(LOC), F.lit(1))


def is_sitemap_index(body: C) -> Column:
    low = F.lower(_c(body))
    return low.contains("<sitemapindex") | (low.contains("<sitemap>") & ~low.contains("<urlset"))


def robots_sitemaps(body: C) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(_c(body), F.lit("")), F.lit(SITEMAP_LINE), F.lit(1)))


def content_type_of(name: C) -> Column:
    """Content type of a file by its ending."""
    e = F.lower(F.regexp_extract(_c(name), r"(\.[^./]*)$", 1))
    return F.when(e.isin(".md", ".markdown", ".mdx"), "text/markdown; charset=utf-8").when(e == ".txt", "text/plain; charset=utf-8").otherwise("application/octet-stream")


def forced_markdown(content_type: C) -> Column:
    ct = F.lower(F.coalesce(_c(content_type), F.lit("")))
    return F.when(ct.contains("text/markdown") | ct.contains("text/x-markdown"), _c(content_type)).otherwise("text/markdown; charset=utf-8")


_SPEC = r"^(?:github\.com/)?([^/@]+)/([^/@]+)(?:@([^/]+))?(?:/(.*))?$"


def repository(spec: C) -> Column:
    """struct<owner, repo, ref, subdir> of [github.com/]owner/repo[@ref][/subdir]; null if it is none."""
    s = F.regexp_replace(F.trim(_c(spec)), r"^(https?://)", "")
    get = lambda k: F.regexp_extract(s, _SPEC, k)
    return F.when(s.rlike(_SPEC), F.struct(get(1).alias("owner"), get(2).alias("repo"), get(3).alias("ref"), F.regexp_replace(get(4), "/+$", "").alias("subdir")))


def in_subdir(p: C, subdir: C) -> Column:
    return (_c(subdir) == "") | (_c(p) == _c(subdir)) | F.startswith(_c(p), F.concat(_c(subdir), F.lit("/")))


def expanded(text: C, values: dict[str, str]) -> Column:
    """``${NAME}`` replaced by values, unknown names by nothing; what is not closed stays.

    For public values only: they become part of the plan. Secrets are expanded on the driver (sources.fetch.expand).
    """
    pieces = F.regexp_extract_all(_c(text), F.lit(r"(?s)(\$\{[^}]*\}|.[^$]*)"), F.lit(1))
    known = F.create_map(*[F.lit(x) for kv in values.items() for x in kv]) if values else F.create_map(F.lit(""), F.lit(""))
    return F.array_join(F.transform(pieces, lambda x: F.when(x.rlike(r"(?s)^\$\{[^}]*\}$"), F.coalesce(F.try_element_at(known, F.regexp_extract(x, r"(?s)^\$\{([^}]*)\}$", 1)), F.lit(""))).otherwise(x)), "")
