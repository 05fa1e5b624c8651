"""The four kinds of sources. Each gives pages(source, url, path, content_type, body, fetched_at)."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import discover
from ..operators.html import navigation
from .fetch import Fetcher, expand_map, fetched, ok_pages
from .shared import settled

PAGES = ["source", "url", "path", "content_type", "body", "fetched_at"]
EXTENSIONS = (".md", ".markdown", ".mdx", ".txt")
REPOSITORY_EXTENSIONS = (".md", ".markdown", ".mdx")
MOST = {"local": 0, "website": 500, "llms_txt": 500, "github": 1000}


class SourceError(Exception):
    """A source that gives no page at all."""


@dataclass
class Request:
    """What a source is pulled with. ``at`` is the time pages count as fetched."""

    name: str
    kind: str
    root: str
    at: datetime
    max_pages: int = 0
    headers: Mapping[str, str] = field(default_factory=dict)
    fetcher: Fetcher | None = None
    cookies: Mapping[str, str] = field(default_factory=dict)

    @property
    def most(self) -> int:
        return self.max_pages or MOST[self.kind]

    @property
    def sent(self) -> dict[str, str]:
        """Headers of each request, cookies among them, with the driver's environment in them."""
        cookies = expand_map(self.cookies)
        return {**(expand_map(self.headers) or {}), **({"Cookie": "; ".join(f"{k}={v}" for k, v in sorted(cookies.items()))} if cookies else {})}


def _pages(df: DataFrame, r: Request) -> DataFrame:
    """The page columns; of pages with one path the last stays."""
    last = Window.partitionBy("path").orderBy(F.desc("url"))
    df = df.withColumn("n_", F.row_number().over(last)).where("n_ = 1")
    return df.withColumns({"source": F.lit(r.name), "fetched_at": F.lit(r.at).cast("timestamp")}).select(*PAGES)


def _some(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise SourceError(what)
    return df


def local(spark: SparkSession, r: Request) -> DataFrame:
    """Text files below a folder in order of their names; none in folders that start with "."."""
    root = r.root
    scheme = root.split("://", 1)[0] if "://" in root else ""
    if not root or (scheme and scheme != "file"):
        raise SourceError(f"{root!r} is no local folder")
    folder = os.path.abspath(os.path.expanduser(root.removeprefix("file://")))
    if not os.path.isdir(folder):
        raise SourceError(f"{folder} is no folder")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load("file://" + folder)
    base = "file://" + folder
    files = files.withColumn("url", F.regexp_replace("path", "^file:/+", "file:///")).withColumn("name", F.substr("url", F.lit(len(base) + 2)))
    ending = F.lower(F.regexp_extract("name", r"(\.[^./]*)$", 1))
    files = files.where(ending.isin(*EXTENSIONS) & ~F.col("name").rlike(r"(^|/)\.[^/]*/"))
    if r.most:
        files = files.orderBy("name").limit(r.most)
    pages = files.select("url", F.regexp_replace("name", r"\.[^./]*$", "").alias("path"), U.content_type_of("name").alias("content_type"), F.col("content").cast("string").alias("body"))
    return _some(_pages(pages, r), f"no text file below {folder}")


def _get(spark: SparkSession, r: Request, *urls: str) -> DataFrame:
    return fetched(spark.createDataFrame([(u,) for u in urls], "url string"), r.fetcher, r.sent)


def llms_txt(spark: SparkSession, r: Request) -> DataFrame:
    """The full text of a site if it has one, else the pages of its link index, else the index itself."""
    row = spark.range(1).select(*(c.alias(n) for c, n in zip(U.index_urls(F.lit(r.root)), ("full", "index"), strict=True))).first()
    full = ok_pages(_get(spark, r, row['full'])).where(F.trim("body") != "")
    if not full.isEmpty():
        return _pages(full.select("url", F.lit("llms-full").alias("path"), U.forced_markdown("content_type").alias("content_type"), "body"), r)
    index = settled(_some(ok_pages(_get(spark, r, row['index'])), f"{row['index']}: no answer"), "index")
    links = index.select(F.posexplode(U.links_of_markdown("body", F.lit(row['index']))).alias("pos", "url")).orderBy("pos").limit(r.most)
    if links.isEmpty():
        return _pages(index.select("url", F.lit("llms").alias("path"), U.forced_markdown("content_type").alias("content_type"), "body"), r)
    pages = settled(ok_pages(fetched(links.select("url"), r.fetcher, r.sent)), "pages")
    return _some(_pages(pages.select("url", U.index_path("url").alias("path"), "content_type", "body"), r), "no link of the index answers")


def github(spark: SparkSession, r: Request, api: str = "https://api.github.com", raw: str = "https://raw.githubusercontent.com", token: str | None = None) -> DataFrame:
    """Markdown files of a repository's tree, in tree order. The token goes to the API only."""
    spec = spark.range(1).select(U.repository(F.lit(r.root)).alias("s")).first().s
    if spec is None:
        raise SourceError(f"{r.root!r} is no repository")
    token = token or os.environ.get("GITHUB_TOKEN")
    auth = {**r.sent, **({"Authorization": f"Bearer {token}"} if token else {})}
    call = lambda url: ok_pages(fetched(spark.createDataFrame([(url,)], "url string"), r.fetcher, auth))
    ref = spec.ref
    if not ref:
        found = call(f"{api}/repos/{spec.owner}/{spec.repo}").select(F.get_json_object("body", "$.default_branch").alias("b")).first()
        ref = (found.b if found else None) or "main"
    tree = call(f"{api}/repos/{spec.owner}/{spec.repo}/git/trees/{ref}?recursive=1")
    nodes = tree.select(F.posexplode(F.from_json("body", "struct<tree: array<struct<path: string, type: string>>>")["tree"]).alias("pos", "n")).select("pos", "n.*")
    files = tree_files(nodes, spec.subdir).orderBy("pos").limit(r.most)
    files = settled(_some(files, f"no markdown in {r.root}"), "tree")
    full = files.withColumns({"url": F.concat(F.lit(f"{raw}/{spec.owner}/{spec.repo}/{ref}/"), "file"), "page": F.concat(F.lit(f"https://github.com/{spec.owner}/{spec.repo}/blob/{ref}/"), "file")})
    pages = settled(ok_pages(fetched(full, r.fetcher)), "pages")
    return _some(_pages(pages.select(F.col("page").alias("url"), "path", F.lit("text/markdown; charset=utf-8").alias("content_type"), "body"), r), f"no file of {r.root} answers")


def tree_files(nodes: DataFrame, subdir: str = "") -> DataFrame:
    """nodes(pos, path, type) -> (pos, file, path): markdown blobs in a folder, the path without the file's ending."""
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    kept = nodes.where((F.col("type") == "blob") & ending.isin(*REPOSITORY_EXTENSIONS) & U.in_subdir("path", F.lit(subdir)))
    return kept.select("pos", F.col("path").alias("file"), F.regexp_replace("path", r"\.[^./]*$", "").alias("path"))


def _sitemap_pages(spark: SparkSession, r: Request, sitemaps: DataFrame, depth: int = 3) -> DataFrame:
    """(strategy, url, pos) of sitemaps(strategy, url), indexes of sitemaps followed to a depth, each sitemap once for a
    strategy."""
    if "strategy" not in sitemaps.columns:
        sitemaps = sitemaps.withColumn("strategy", F.lit(""))
    found = spark.createDataFrame([], "strategy string, url string, pos int")
    todo = settled(sitemaps.select("strategy", "url").distinct(), "todo")
    seen = todo
    for _ in range(depth + 1):
        if todo.isEmpty():
            break
        got = settled(ok_pages(fetched(todo.select("url").distinct(), r.fetcher, r.sent)).select("url", "body"), "sitemaps")
        locs = got.select("url", U.is_sitemap_index("body").alias("index"), F.posexplode(U.sitemap_locs("body")).alias("pos", "loc"))
        locs = todo.join(locs, "url").select("strategy", "index", "pos", F.col("loc").alias("url"))
        found = found.unionByName(locs.where(~F.col("index")).select("strategy", "url", "pos"))
        todo = settled(locs.where("index").select("strategy", "url").distinct().join(seen, ["strategy", "url"], "left_anti"), "todo")
        seen = seen.unionByName(todo)
    return found


def website(spark: SparkSession, r: Request) -> DataFrame:
    """Pages of a site: those of its largest sitemap in scope, else of its navigation, else what a crawl reaches.

    Each origin's robots.txt, with all sitemaps that it names, and each usual place of a sitemap are strategies; the one
    with most pages in scope is taken, the first of equals. Hosts that a sitemap names count as the site's own. A
    navigation is one if it has over five links, in scope or not.
    """
    entry = settled(_get(spark, r, r.root), "entry")
    first = _some(ok_pages(entry), f"{r.root}: no answer").first()
    parts = spark.range(1).select(*(f(F.lit(u)).alias(f"{f.__name__}{i}") for i, u in enumerate((r.root, first.final_url)) for f in (U.host, U.scope_path, U.parent_dir))).first()
    hosts, scope = sorted({parts.host0, parts.host1}), parts.scope_path1
    if scope.startswith(parts.scope_path0) and parts.scope_path0 != scope:
        scope = parts.scope_path0
    origins = {u.split("/")[0] + "//" + u.split("/")[2] for u in (r.root, first.final_url)}
    robots = ok_pages(_get(spark, r, *(f"{o}/robots.txt" for o in sorted(origins)))).select(F.concat(F.lit("0 "), "url").alias("strategy"), F.explode(U.robots_sitemaps("body")).alias("url"))
    usual = [f"{o}{d}{n}" for o in sorted(origins) for d in sorted({parts.parent_dir1, "/"}) for n in U.SITEMAPS]
    maps = settled(_sitemap_pages(spark, r, robots.unionByName(spark.createDataFrame([(f"1 {i:03}", u) for i, u in enumerate(usual)], "strategy string, url string"))), "locations")
    pages = settled(discover.largest(discover.filtered(maps, None, scope, r.most, by=("strategy",))), "sitemap")
    if pages.isEmpty():
        hosts = sorted({*hosts, *(x.h for x in maps.select(U.host("url").alias("h")).distinct().collect() if x.h)})  # a site's own sitemaps name few
        links = [(u, i) for i, u in enumerate(navigation(first.body))]
        if links:
            nav = spark.createDataFrame(links, "href string, pos int").select(U.without(U.resolved(F.lit(first.final_url), "href"), query=True).alias("url"), "pos")
            nav = settled(nav.where(~U.path("url").rlike(U.NO_PAGE)).groupBy("url").agg(F.min("pos").alias("pos")).unionByName(spark.createDataFrame([(first.final_url, len(links))], "url string, pos int")), "links")
            if nav.count() > 5:
                pages = settled(discover.filtered(nav, hosts, scope, r.most), "navigation")
        if pages.isEmpty():
            pages = crawl(spark, r, first.final_url, hosts, scope)
    got = settled(ok_pages(fetched(pages.select("url"), r.fetcher, r.sent)), "pages")
    return _some(_pages(got.select("url", U.site_path("url").alias("path"), "content_type", "body"), r), f"no page of {r.root} answers")


def crawl(spark: SparkSession, r: Request, start: str, hosts: list[str], scope: str) -> DataFrame:
    """(url, path, pos) reached from a page over links of pages, in scope, breadth first, up to the source's limit.

    What was visited is written as one table every few rounds, so the plan of a long crawl stays short."""
    frontier = spark.createDataFrame([(start, 0)], "url string, pos int")
    seen = settled(discover.filtered(frontier, hosts, "/", None), "seen")
    frontier, n, rounds = seen, seen.count(), 0
    while n < r.most and not frontier.isEmpty():
        got = ok_pages(fetched(frontier.select("url"), r.fetcher, r.sent)).where(F.lower("body").contains("</html"))
        links = got.select(F.posexplode(U.hrefs("body", "url")).alias("pos", "url")).select("url", "pos")
        new = discover.filtered(links, hosts, scope).join(seen.select("path"), "path", "left_anti").select("url", "path", F.lit(n).alias("pos"))
        frontier = settled(new.orderBy("url").limit(r.most - n), "frontier")
        seen, n, rounds = seen.unionByName(frontier), n + frontier.count(), rounds + 1
        if rounds % discover.ROUNDS == 0:
            seen = settled(seen, "seen")
    return seen


KINDS = {"local": local, "llms_txt": llms_txt, "github": github, "website": website}


def pull(spark: SparkSession, r: Request) -> DataFrame:
    if r.kind not in KINDS:
        raise SourceError(f"unknown kind {r.kind!r}")
    return KINDS[r.kind](spark, r)
