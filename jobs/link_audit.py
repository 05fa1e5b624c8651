"""Audit the links between crawled pages, so that a site's index neither misses pages nor repeats them.

    python -m jobs.link_audit --pages URI --out URI [--config jobs/link_audit.json]

Reads page_id, url, html and writes three tables, each as a whole, so a rerun gives the same:

  pages/bucket=N  host, url, path, page_id, canonical_id, n_internal, n_external, n_inbound, state
  missing/bucket=N  host, url, n_inbound: addresses on crawled hosts that pages link to and that were not crawled
  hosts           host, n_pages, n_repeats, n_orphans, n_missing, as JSON lines

A page's address loses query and fragment. Of the pages with one host and path the first by number
is canonical (``canonical_id``), the others repeat it. Links of all pages count, each target once a
page; a page's links to itself do not make it linked. ``state`` is repeat, orphan (no other address
links to it) or linked. Addresses that end like files that are no pages are not missing. Pages
without an address have host and path empty; without HTML they have no links.

Links are counted by target before they meet the pages, so that a page that everything links to is
one row in the join; buckets are dealt by ranges of host, address and the rest, so that a large host is split.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import urls as U

from .common import config, log, logged

CONFIG = {"buckets": 32, "no_page": U.NO_PAGE}
PAGES = "page_id long, url string, html string"


def audited(pages: DataFrame, no_page: str = U.NO_PAGE) -> tuple[DataFrame, DataFrame]:
    """(pages with their counts and states, addresses that were not crawled)."""
    url = U.without(F.coalesce("url", F.lit("")), query=True)
    rows = pages.select("page_id", url.alias("url"), U.host(url).alias("host"), U.path(url).alias("path"), "html")
    rows = rows.withColumn("targets", F.filter(U.hrefs("html", "url"), lambda x: x != F.col("url")))
    inside = F.size(F.filter("targets", lambda x: U.host(x) == F.col("host")))
    about = rows.select("host", "url", "path", "page_id", inside.cast("long").alias("n_internal"), (F.size("targets") - inside).cast("long").alias("n_external"))
    # pages with one address count once as a source
    links = rows.select(F.col("url").alias("from_url"), F.explode("targets").alias("to_url")).distinct()
    inbound = links.groupBy("to_url").agg(F.count("*").alias("n_inbound"))
    first = rows.groupBy("host", "path").agg(F.min("page_id").alias("canonical_id"))
    state = F.when(F.col("page_id") != F.col("canonical_id"), "repeat").when(F.col("n_inbound") == 0, "orphan").otherwise("linked")
    listed = about.join(first, ["host", "path"]).join(inbound.withColumnRenamed("to_url", "url"), "url", "left").withColumn("n_inbound", F.coalesce("n_inbound", F.lit(0)))
    hosts, known = rows.select("host").distinct(), rows.select("url").distinct()
    missing = inbound.select(U.host("to_url").alias("host"), F.col("to_url").alias("url"), "n_inbound").where(~U.path("to_url").rlike(no_page))
    missing = missing.join(known, "url", "left_anti").join(hosts, "host", "left_semi").select("host", "url", "n_inbound")
    return listed.select("host", "url", "path", "page_id", "canonical_id", "n_internal", "n_external", "n_inbound", state.alias("state")), missing


def _write(df: DataFrame, path: str, buckets: int) -> DataFrame:
    dealt = df.withColumn("bucket", F.pmod(F.xxhash64("host"), F.lit(buckets)).cast("int")).repartitionByRange("bucket", *df.columns).sortWithinPartitions("bucket", "host", "url")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)
    return df.sparkSession.read.schema(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", bucket int").parquet(path).drop("bucket")


def run(spark: SparkSession, pages: str, out: str, how: dict | None = None) -> dict[str, int]:
    """Read pages, write the three tables; how many rows each."""
    how = CONFIG | (how or {})
    read = spark.read.schema(PAGES).parquet(pages)
    listed, missing = audited(read, how["no_page"])
    listed, missing = _write(listed, f"{out}/pages", how["buckets"]), _write(missing, f"{out}/missing", how["buckets"])
    absent = missing.groupBy("host").agg(F.count("*").alias("n_missing"))
    hosts = listed.groupBy("host").agg(F.count("*").alias("n_pages"), F.count_if(F.col("state") == "repeat").alias("n_repeats"), F.count_if(F.col("state") == "orphan").alias("n_orphans"))
    hosts.join(absent, "host", "left").withColumn("n_missing", F.coalesce("n_missing", F.lit(0))).write.mode("overwrite").json(f"{out}/hosts")
    n = {"read": read.count(), "pages": listed.count(), "missing": missing.count(), "hosts": spark.read.schema("host string").json(f"{out}/hosts").count()}
    log.info("read %d pages from %s; wrote %d pages, %d missing addresses and %d hosts to %s", n["read"], pages, n["pages"], n["missing"], n["hosts"], out)
    return n


def output(spark: SparkSession, out: str) -> DataFrame:
    """The three tables as one, with 0 where a table has no such column."""
    none = F.lit(0).cast("long")
    pages = spark.read.parquet(f"{out}/pages").select(F.lit("page").alias("kind"), "host", "url", "page_id", "canonical_id", F.col("n_internal").alias("a"), F.col("n_external").alias("b"), F.col("n_inbound").alias("c"), "state")
    missing = spark.read.schema("host string, url string, n_inbound long, bucket int").parquet(f"{out}/missing").select(F.lit("missing").alias("kind"), "host", "url", none.alias("page_id"), none.alias("canonical_id"), none.alias("a"), none.alias("b"), F.col("n_inbound").alias("c"), F.lit("").alias("state"))
    hosts = spark.read.schema("host string, n_pages long, n_repeats long, n_orphans long, n_missing long").json(f"{out}/hosts")
    hosts = hosts.select(F.lit("host").alias("kind"), "host", F.lit("").alias("url"), none.alias("page_id"), F.col("n_missing").alias("canonical_id"), F.col("n_pages").alias("a"), F.col("n_repeats").alias("b"), F.col("n_orphans").alias("c"), F.lit("").alias("state"))
    return pages.unionByName(missing).unionByName(hosts)


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    p.add_argument("--pages", required=True, help="parquet with page_id, url, html")
    p.add_argument("--out", required=True)
    p.add_argument("--config")
    a = p.parse_args()
    logged()
    spark = SparkSession.builder.appName("link_audit").getOrCreate()
    try:
        run(spark, a.pages, a.out, config(spark, a.config, CONFIG))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
