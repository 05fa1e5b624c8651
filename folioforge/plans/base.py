"""What the registered queries share: how the driver's tables become a corpus, and rows as literals on both sides."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The time that tested queries count ages from.
AS_OF = datetime(2024, 2, 3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, ", ".join(f"{c} string" if " " not in c else c for c in columns.split(", ")))


def values(columns: str, rows: list[tuple]) -> str:
    """The same rows for SQL."""

    def one(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, (int, float)):
            return str(x)
        return "'" + x.replace("'", "''") + "'" if "\n" not in x and "\r" not in x else "(" + " || ".join("chr(10)" if p == "\n" else "chr(13)" if p == "\r" else "'" + p.replace("'", "''") + "'" for p in _lines(x)) + ")"

    names = ", ".join(c.split()[0] for c in columns.split(", "))
    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS t({names})"


def _lines(x: str) -> list[str]:
    out, cur = [], ""
    for c in x:
        if c in "\n\r":
            out += [cur, c] if cur else [c]
            cur = ""
        else:
            cur += c
    return [*out, cur] if cur or not out else out


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as (source, url, path, title, markdown)."""
    d = table(spark, sf_dir, "documents")
    path = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"))
    return d.select("source", F.concat(F.lit("file:///"), path).alias("url"), path.alias("path"), F.lit("").alias("title"), F.col("text").alias("markdown"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of each conversation: its number as the title, a section for each turn."""
    t = table(spark, sf_dir, "conversations")
    turn = F.concat(F.lit("## "), "role", F.lit("\n\n"), F.coalesce("text", F.lit("")))
    turns = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("md")))).alias("t"))
    body = F.array_join(F.transform("t", lambda x: x["md"]), "\n\n")
    return turns.select("conv_id", F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n\n"), body, F.lit("\n")).alias("markdown"))


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as (source, url, path, content_type, body, fetched_at); a page's source is its host."""
    from ..functions import urls as U

    p = table(spark, sf_dir, "pages")
    return p.select(U.host("url").alias("source"), "url", F.concat(U.site_path("url"), F.lit("-"), F.col("page_id").cast("string")).alias("path"), F.lit("text/html; charset=utf-8").alias("content_type"), F.col("html").alias("body"), F.lit(AS_OF).cast("timestamp").alias("fetched_at"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog from the log of events: a source for each user, synced at the last event."""
    e = table(spark, sf_dir, "events")
    refresh = F.element_at(F.array(*map(F.lit, ("7d", "manual", "12h", "30d", ""))), (F.pmod("user_id", F.lit(5)) + 1).cast("int"))
    last = e.groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("last_synced_at"))
    return last.select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("name"), F.lit("website").alias("kind"), F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".example/")).alias("root"), refresh.alias("refresh"), "last_synced_at")
