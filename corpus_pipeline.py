"""A training-data pipeline over ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads; ``run``
writes each result to the shared folder and reads it back. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import mixing, packing, simhash, suffix_dedup, toxicity
from folioforge.llm._base import give_back, in_tasks, row_hashes, settled, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: What tells rows apart.
ROW = ["row_a", "row_b"]
#: Documents from this score on go.
TOXIC = 0.7


def _numbered(docs: DataFrame) -> DataFrame:
    """The columns of documents and ROW, 128 bits of hashes of them."""
    return docs.select(*COLUMNS, *(h.alias(n) for h, n in zip(row_hashes(*COLUMNS), ROW, strict=True)))


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go. The lexicon is learned from the labels of the documents given."""
    docs = in_tasks(docs.select(*COLUMNS))
    lexicon = toxicity.learned(docs, table(spark, sf_dir, "labels"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([lexicon.score(toxicity.fold(t)) < TOXIC for t in texts], pa.bool_()))
        give_back()

    return docs.mapInArrow(clean, docs.schema)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: that of the least doc_id."""
    rows = _numbered(in_tasks(docs))
    named = simhash.near_duplicates(rows.select(F.struct("doc_id", *ROW).alias("id"), "text"), "id")
    stay = named.where("id.row_a = component_id.row_a AND id.row_b = component_id.row_b").select("id.row_a", "id.row_b")
    return rows.join(stay, ROW, "left_semi").dropDuplicates(ROW).select(*COLUMNS)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated 200-byte strings go; what is left of a character goes with it, and a document without a word left."""
    rows = _numbered(in_tasks(docs))
    kept = suffix_dedup.repeated_spans(rows.select(F.struct(*ROW).alias("id"), "text"), "id").select("id.row_a", "id.row_b", "kept")

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*batch.columns[:2], pa.array([b.decode("utf-8", "ignore") for b in batch.column(2).to_pylist()], pa.string())], names=[*ROW, "text"])

    left = kept.mapInArrow(text, "row_a long, row_b long, text string").where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    # repeated rows come out of `left` as often as they went in
    about = rows.select(*ROW, "doc_id", "lang", "source").dropDuplicates(ROW)
    return left.join(about, ROW).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights: each document as often as the mix takes it."""
    return mixing.mixed(in_tasks(docs.select(*COLUMNS)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents cut and packed into sequences of 2,048 tokens."""
    return packing.packed(in_tasks(docs.select(*COLUMNS)))


STAGES = [("toxicity", toxic_out), ("simhash", near_copies_out), ("suffix_dedup", repeats_out), ("mixing", mixed), ("packing", packed)]

#: The stages learn, link and round; SQL does not express them. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
