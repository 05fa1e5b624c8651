"""The source catalog: entries, freshness, counts, manifests, run summaries, changes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_FIELDS = (("name", "string"), ("kind", "string"), ("root", "string"), ("refresh", "string"), ("max_pages", "int"), ("headers", "map<string,string>"), ("cookies", "map<string,string>"), ("added_at", "timestamp"), ("last_synced_at", "timestamp"))
ENTRY = ", ".join(f"{n} {t}" for n, t in _FIELDS)
#: The catalog's file: all entries in one object.
FILE = f"sources array<struct<{', '.join(f'{n}: {t}' for n, t in _FIELDS)}>>"
#: Age from which a source is stale, in days.
STALE_DAYS = 7
#: How often a source is due that says nothing.
DEFAULT_REFRESH = "7d"


class CatalogError(ValueError):
    """An entry that is not valid, is there already, or is not there."""


def stale(last_synced: Column | str, as_of: datetime | Column) -> Column:
    """Synced once, and over seven days ago."""
    at = F.lit(as_of) if not isinstance(as_of, Column) else as_of
    last = F.col(last_synced) if isinstance(last_synced, str) else last_synced
    return F.coalesce(last + F.expr(f"interval {STALE_DAYS} days") < at, F.lit(False))


def due(entries: DataFrame, as_of: datetime) -> DataFrame:
    """Entries with a refresh interval that were never synced or not within it."""
    every = T.parse_refresh(F.coalesce("refresh", F.lit("")))
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("last_synced_at").cast("timestamp"))
    return entries.where((every > 0) & (F.col("last_synced_at").isNull() | (age > every)))


def listed(entries: DataFrame, documents: DataFrame, as_of: datetime) -> DataFrame:
    """Sources with their page counts and freshness, by name."""
    pages = documents.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("page_count"))
    out = entries.join(pages, "name", "left")
    return out.select("name", "kind", "root", F.coalesce("page_count", F.lit(0)).alias("page_count"), "last_synced_at", F.coalesce(F.nullif("refresh", F.lit("")), F.lit(DEFAULT_REFRESH)).alias("refresh_after"), stale("last_synced_at", as_of).alias("stale")).orderBy("name")


def added(entries: DataFrame, name: str, kind: str, root: str, at: datetime, refresh: str = DEFAULT_REFRESH, max_pages: int = 0, headers: dict | None = None, cookies: dict | None = None) -> DataFrame:
    """Entries and a new one, by name."""
    spark = entries.sparkSession
    new = spark.createDataFrame([(name, kind, root, refresh, max_pages, headers, cookies, at, None)], ENTRY)
    wrong = new.select(T.entry_error("name", "kind", "root").alias("e")).first().e
    if wrong:
        raise CatalogError(wrong)
    if not entries.where(F.col("name") == name).isEmpty():
        raise CatalogError(f"{name} is there already")
    return entries.unionByName(new).orderBy("name")


def _known(entries: DataFrame, name: str) -> None:
    if entries.where(F.col("name") == name).isEmpty():
        raise CatalogError(f"no source {name}")


def removed(entries: DataFrame, name: str) -> DataFrame:
    _known(entries, name)
    return entries.where(F.col("name") != name)


def updated(entries: DataFrame, name: str, **values) -> DataFrame:
    _known(entries, name)
    return entries.withColumns({k: F.when(F.col("name") == name, F.lit(v).cast(entries.schema[k].dataType)).otherwise(F.col(k)) for k, v in values.items()})


def chosen(entries: DataFrame, names: list[str] | None, strict: bool = False) -> DataFrame:
    """Entries by name; none given means all. Unknown names are dropped, or an error if strict."""
    if not names:
        return entries.orderBy("name")
    out = entries.where(F.col("name").isin(names))
    if strict:
        missing = set(names) - {r.name for r in out.select("name").collect()}
        if missing:
            raise CatalogError(f"no source {sorted(missing)[0]}")
    return out.orderBy("name")


def manifest(documents: DataFrame) -> DataFrame:
    """Flat manifest: a row for each page, the last of a path."""
    pages = documents.groupBy("source", "path").agg(F.max_by(F.struct("url", "content_hash", "fetched_at", "token_count"), F.struct("fetched_at", "url")).alias("p"))
    return pages.select("source", "path", "p.*")


def manifest_map(documents: DataFrame) -> DataFrame:
    """A manifest as a map for each source, for export; a source's pages fit in a row."""
    return manifest(documents).groupBy("source").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", F.struct("url", "content_hash", "fetched_at", "token_count"))))).alias("pages"))


def run_summary(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source, pages, chunks, skipped): what a run did for each source."""
    pages = documents.groupBy("source").agg(F.count_if(F.col("status") == "ok").alias("pages"), F.count_if(F.col("status") == "empty").alias("skipped"))
    counts = chunks.groupBy("source").agg(F.count("*").alias("chunks"))
    return pages.join(counts, "source", "left").select("source", "pages", F.coalesce("chunks", F.lit(0)).alias("chunks"), "skipped")


def errors_sample(fetched: DataFrame, most: int = 3) -> DataFrame:
    """(source, n_errors, first_error, sample): failures of a fetch, the first ``most`` by address."""
    bad = fetched.where(F.col("error").isNotNull())
    least = bad.groupBy("source").agg(F.count("*").alias("n_errors"), F.min_by("error", "url").alias("first_error"))
    from pyspark.sql import Window

    top = bad.withColumn("n_", F.row_number().over(Window.partitionBy("source").orderBy("url"))).where(F.col("n_") <= most)
    return least.join(top.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("n_", "error"))), lambda x: x["error"]).alias("sample")), "source")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source, path, change): pages added, changed or removed between two manifests, by their hashes."""
    a = old.select("source", "path", F.col("content_hash").alias("old_hash"))
    b = new.select("source", "path", F.col("content_hash").alias("new_hash"))
    both = a.join(b, ["source", "path"], "full")
    kind = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "changed")
    return both.select("source", "path", kind.alias("change")).where("change is not null")
