"""Keep a corpus's chunks and term statistics up to date as documents arrive as files.

    python -m jobs.refresh_index --documents URI --out URI [--checkpoint URI] [--config jobs/refresh_index.json]

A stream reads the files that its checkpoint has not seen, takes them in batches and stops. Of each
batch only documents that are new or whose text changed are taken further. What they give is written
by batch, so a batch that is done again after a failure replaces what it left:

  documents/batch=N  source, path, content_hash, markdown, replaces (the batch of the version before)
  chunks/batch=N     source, path, ord, heading_path, anchor, token_count, body
  terms/batch=N      source, term, df, tf: counts of the new texts, less those of the texts replaced

The newest version of a document is that of its last batch; counts of terms add up over batches. No
document is read twice but one that is replaced. Documents that two rows of a batch share keep the
greater text; null texts are empty, null sources a source of their own.
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.tokens import tokens
from folioforge.operators import chunking

from .common import config, log, logged, same, there

CONFIG = {"files_a_batch": 64, "max_tokens": chunking.MAX_TOKENS, "min_body": chunking.MIN_BODY}
DOCUMENTS = "doc_id long, text string, lang string, source string"
STORED = "source string, path string, content_hash string, markdown string, replaces int, batch int"
CHUNKS = "source string, path string, ord int, heading_path array<string>, anchor string, token_count int, body string, batch int"
TERMS = "source string, term string, df long, tf long, batch int"
KEY = ["source", "path"]


def _write(df: DataFrame, out: str, table: str, batch: int) -> None:
    df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/{table}")


def newest(stored: DataFrame) -> DataFrame:
    """(source, path, content_hash, batch) of each document's last version."""
    return stored.groupBy(*KEY).agg(F.max_by("content_hash", "batch").alias("content_hash"), F.max("batch").alias("batch"))


def term_counts(documents: DataFrame) -> DataFrame:
    """(source, term, df, tf) of documents(source, markdown)."""
    found = documents.select("source", tokens("markdown").alias("t"))
    entry = lambda df, tf: lambda t: F.struct(t.alias("term"), F.lit(df).alias("df"), F.lit(tf).alias("tf"))
    each = found.select("source", F.inline(F.concat(F.transform(F.array_distinct("t"), entry(1, 0)), F.transform("t", entry(0, 1)))))
    return each.groupBy("source", "term").agg(F.sum("df").cast("long").alias("df"), F.sum("tf").cast("long").alias("tf"))


def taken(spark: SparkSession, arrived: DataFrame, out: str, batch: int, how: dict) -> dict[str, int]:
    """What one batch brings, written to its partitions."""
    path = F.concat(F.coalesce("lang", F.lit("")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    docs = arrived.select("source", path.alias("path"), F.coalesce("text", F.lit("")).alias("markdown")).groupBy(*KEY).agg(F.max("markdown").alias("markdown"))
    docs = docs.withColumn("content_hash", F.sha2("markdown", 256))
    before = there(spark, f"{out}/documents", STORED).where(F.col("batch") < batch)
    last = newest(before)
    fresh = docs.join(last, same(docs, last, KEY), "left").where(last.content_hash.isNull() | (docs.content_hash != last.content_hash))
    _write(fresh.select(docs.source, docs.path, docs.content_hash, docs.markdown, last.batch.alias("replaces")), out, "documents", batch)

    new = there(spark, f"{out}/documents", STORED).where(F.col("batch") == batch)
    changed = new.where("replaces is not null")
    old = before.join(changed, same(before, changed, KEY) & (before.batch == changed.replaces), "left_semi")
    _write(chunking.chunk(new.select(*KEY, "markdown"), how["max_tokens"], min_body=how["min_body"]), out, "chunks", batch)
    less = term_counts(old).select("source", "term", (-F.col("df")).alias("df"), (-F.col("tf")).alias("tf"))
    terms = term_counts(new).unionByName(less).groupBy("source", "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).where("df != 0 or tf != 0")
    _write(terms, out, "terms", batch)
    n = {"read": arrived.count(), "documents": new.count(), "changed": changed.count()}
    n |= {t: there(spark, f"{out}/{t}", s).where(F.col("batch") == batch).count() for t, s in (("chunks", CHUNKS), ("terms", TERMS))}
    log.info("batch %d: read %d rows; wrote %d documents (%d of them changed), %d chunks, %d term counts to %s", batch, n["read"], n["documents"], n["changed"], n["chunks"], n["terms"], out)
    return n


def _pattern(path: str) -> str:
    """A stream reads a folder or a pattern, no single file; a pattern of one name is either."""
    path = path.rstrip("/")
    return path if set(path) & set("*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, documents: str, out: str, checkpoint: str | None = None, how: dict | None = None) -> list[dict[str, int]]:
    """Take what has arrived since the last run and stop; numbers of each batch. The checkpoint belongs to ``out``."""
    how, done = CONFIG | (how or {}), []
    arriving = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", how["files_a_batch"]).parquet(_pattern(documents))
    # the batch comes in a session of the stream's own
    query = arriving.writeStream.foreachBatch(lambda df, n: done.append(taken(df.sparkSession, df, out, n, how))).option("checkpointLocation", checkpoint or f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%d batches from %s, %d rows read", len(done), documents, sum(n["read"] for n in done))
    return done


def chunks(spark: SparkSession, out: str) -> DataFrame:
    """Chunks of the newest version of each document."""
    all_, last = there(spark, f"{out}/chunks", CHUNKS), newest(there(spark, f"{out}/documents", STORED))
    return all_.join(last, same(all_, last, [*KEY, "batch"]), "left_semi")


def terms(spark: SparkSession, out: str) -> DataFrame:
    """(source, term, df, tf) of the newest versions."""
    found = there(spark, f"{out}/terms", TERMS).groupBy("source", "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
    return found.where("df > 0")


def output(spark: SparkSession, out: str) -> DataFrame:
    """Both as one table: (kind, source, name, number, total, content)."""
    parts = [
        chunks(spark, out).select(F.lit("chunk").alias("kind"), "source", F.concat("path", F.lit("#"), F.col("ord").cast("string")).alias("name"), F.col("token_count").cast("long").alias("number"), F.octet_length("body").cast("long").alias("total"), F.sha2("body", 256).alias("content")),
        terms(spark, out).select(F.lit("term").alias("kind"), "source", F.col("term").alias("name"), F.col("df").alias("number"), F.col("tf").alias("total"), F.lit("").alias("content")),
    ]
    return reduce(DataFrame.unionByName, parts)


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    p.add_argument("--documents", required=True, help="folder of parquet files, or one, with doc_id, text, lang, source")
    p.add_argument("--out", required=True)
    p.add_argument("--checkpoint")
    p.add_argument("--config")
    a = p.parse_args()
    logged()
    spark = SparkSession.builder.appName("refresh_index").getOrCreate()
    try:
        run(spark, a.documents, a.out, a.checkpoint, config(spark, a.config, CONFIG))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
