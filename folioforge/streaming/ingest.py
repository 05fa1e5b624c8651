"""Pages that arrive as files, ingested as a stream: each batch replaces the sources in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..plans.ingest import ingest
from ..sources.store import Store

PAGES = "source string, url string, path string, content_type string, body string, fetched_at timestamp"


def page_stream(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def merged(store: Store, batch: DataFrame) -> None:
    """A batch's pages over those stored of the same sources; the newest of a path stays. Stored documents stay as they
    are; only new pages are rendered."""
    if batch.isEmpty():
        return
    old = store.documents().join(batch.select("source").distinct(), "source", "left_semi")
    kept = old.join(batch.select("source", "path").distinct(), ["source", "path"], "left_anti")
    newest = batch.groupBy("source", "path").agg(F.max_by(F.struct("url", "content_type", "body", "fetched_at"), F.struct("fetched_at", "url")).alias("p")).select("source", "p.url", "path", "p.content_type", "p.body", "p.fetched_at")
    ingest(store, newest, kept=kept)


def start(store: Store, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Ingest what is there and stop, or go on as files come."""
    writer = page_stream(store.spark, folder).writeStream.foreachBatch(lambda df, _: merged(store, df)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def token_rates(pages: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Pages and estimated tokens fetched by source and window; what comes later than ``late`` is not counted."""
    seen = pages.withWatermark("fetched_at", late)
    return seen.groupBy(F.window("fetched_at", window).alias("w"), "source").agg(F.count("*").alias("pages"), F.sum(T.estimate_tokens("body")).alias("tokens")).select("source", F.col("w.start").alias("start"), "pages", "tokens")
