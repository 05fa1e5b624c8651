"""Where a corpus lives: parquet tables partitioned by source, a catalog in JSON, and pages as markdown files.

<root>/catalog.json           entries
<root>/documents/source=.../  documents, replaced by source
<root>/index/...              the tables of operators.search, in segments
<root>/pages/<slug>/**.md     optional export, with front matter
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog, search, segments

DOCUMENT = "source string, url string, path string, title string, markdown string, token_count int, content_hash string, fetched_at timestamp, status string"


class Store:
    """Tables of a corpus under one folder that Spark can read and write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self, name: str) -> bool:
        fs, path = self._fs(name)
        return fs.exists(path)

    def delete(self, name: str) -> None:
        fs, path = self._fs(name)
        fs.delete(path, True)

    # catalog

    def entries(self) -> DataFrame:
        """Entries of the catalog; none if there is no file."""
        if not self.exists("catalog.json"):
            return self.spark.createDataFrame([], catalog.ENTRY)
        raw = self.spark.read.option("multiLine", True).schema(catalog.FILE).json(f"{self.root}/catalog.json")
        return raw.select(F.explode("sources").alias("s")).select("s.*").orderBy("name")

    def save_entries(self, entries: DataFrame) -> None:
        """A catalog is small; it is written beside its place and moved over the old one in one step."""
        rows = [{k: (v.isoformat() if isinstance(v, datetime) else v) for k, v in r.asDict(True).items() if v not in (None, "", {})} for r in entries.orderBy("name").collect()]
        fs, path = self._fs("catalog.json")
        _, part = self._fs("catalog.json.tmp")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps({"sources": rows}, indent=2, ensure_ascii=False).encode()))
        out.close()
        jvm = self.spark._jvm
        over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration()).rename(part, path, over)

    # documents

    def documents(self) -> DataFrame:
        if not self.exists("documents"):
            return self.spark.createDataFrame([], DOCUMENT)
        return self.spark.read.schema(DOCUMENT).parquet(f"{self.root}/documents").withColumn("source", F.col("source").cast("string"))

    def replace_documents(self, documents: DataFrame) -> None:
        """Each source in ``documents`` as a whole; pages of earlier runs go, other sources stay."""
        names = [x.split()[0] for x in DOCUMENT.split(", ")]
        documents.select(*names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(f"{self.root}/documents")

    def page(self, source: str, path: str | None = None, url: str | None = None) -> DataFrame:
        """The page of one path, or of one address, as stored: front matter and markdown."""
        found = self.documents().where((F.col("source") == source) & (F.col("path") == path if url is None else F.col("url") == url)).orderBy("path")
        return found.select("source", "path", F.concat(T.front_matter("title", "url", "source", "fetched_at", "content_hash"), "markdown").alias("content"))

    def paths(self, source: str) -> DataFrame:
        return self.documents().where(F.col("source") == source).select("path").orderBy("path")

    def export(self, documents: DataFrame, folder: str) -> None:
        """Pages as markdown files, written by the tasks that hold them; a path that leaves its folder is left out."""
        rows = documents.select(T.source_slug("source").alias("slug"), T.normalize_path("path").alias("file"), F.concat(T.front_matter("title", "url", "source", "fetched_at", "content_hash"), "markdown").alias("content")).where("file != ''")

        def write(part) -> None:
            from pyarrow import fs

            where, base = fs.FileSystem.from_uri(folder)
            for r in part:
                path = f"{base}/{r.slug}/{r.file}"
                where.create_dir(path.rpartition("/")[0], recursive=True)
                with where.open_output_stream(path + ".tmp") as f:
                    f.write(r.content.encode())
                where.move(path + ".tmp", path)

        rows.foreachPartition(write)

    # index

    def index(self) -> search.Index:
        return search.load(self.spark, f"{self.root}/index")

    def replace_index(self, chunks: DataFrame) -> None:
        search.save(search.build(chunks), f"{self.root}/index")

    def update_index(self, chunks: DataFrame, gone: DataFrame) -> None:
        """Chunks of added and changed pages; those that pages of ``gone(source, path)`` had go."""
        segments.update(search.build(chunks), gone, f"{self.root}/index")

    def compact_index(self) -> int:
        """One segment, and nothing left that it does not need; readers must be done. -> folders deleted."""
        segments.merge(self.spark, f"{self.root}/index", whole=True)
        return len(segments.vacuum(self.spark, f"{self.root}/index"))

    def remove_source(self, source: str, keep_documents: bool = False) -> None:
        """Chunks and postings of a source, and its documents unless they are kept."""
        segments.remove(self.spark, f"{self.root}/index", [source])
        if not keep_documents:
            name = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(source)
            self.delete(f"documents/source={name}")
