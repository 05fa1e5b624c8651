"""Pages to documents: markdown bodies by text functions alone, HTML through a tree in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import html as H
from .chunking import outline

OK, EMPTY = "ok", "empty"


def rendered_html(pages: DataFrame) -> DataFrame:
    """All columns of pages(url, body, ...) but the body, with status, title and raw (markdown as it comes)."""
    names = [c for c in pages.columns if c != "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str, str]] = []
            bodies, urls = batch.column(batch.schema.get_field_index("body")), batch.column(batch.schema.get_field_index("url"))
            for body, url in zip(bodies.to_pylist(), urls.to_pylist(), strict=True):
                root = H.stripped(H.parse(body or ""))
                main = H.main_content(root)
                if len(main.text().strip().encode()) < H.EMPTY:
                    out.append((EMPTY, H.title(root), ""))
                else:
                    out.append((OK, H.title(root), H.markdown(main, url or "")))
            status, title, raw = zip(*out, strict=True) if out else ((), (), ())
            kept = [i for i, n in enumerate(batch.schema.names) if n != "body"]
            yield pa.record_batch([*(batch.column(i) for i in kept), pa.array(status, pa.string()), pa.array(title, pa.string()), pa.array(raw, pa.string())], names=[*(batch.schema.names[i] for i in kept), "status", "title", "raw"])

    kinds = ", ".join(f"`{n}` {pages.schema[n].dataType.simpleString()}" for n in names)
    return pages.mapInArrow(run, f"{kinds}, status string, title string, raw string")


def render(pages: DataFrame) -> DataFrame:
    """pages(source, url, path, content_type, body string, fetched_at) -> documents with status.

    A page under 80 bytes of text, HTML only, has status "empty". fetched_at stays that of the page.
    """
    pages = pages.withColumn("body", F.col("body").cast("string"))
    md = T.is_markdown("content_type", "body")
    plain = pages.where(md).withColumns({"status": F.lit(OK), "raw": F.col("body")}).drop("body")
    plain = plain.withColumn("title", F.lit(None).cast("string"))
    web = rendered_html(pages.where(~md))
    both = web.unionByName(plain).withColumn("markdown", T.normalize_markdown(T.strip_self_links("raw"))).drop("raw")
    return both.withColumns({"title": F.coalesce("title", T.markdown_title("markdown")), "token_count": T.estimate_tokens("markdown"), "content_hash": T.content_hash("markdown")})


def with_outline(documents: DataFrame) -> DataFrame:
    return documents.withColumn("outline", outline("markdown"))


def escalated(pages: DataFrame, documents: DataFrame, escalate) -> DataFrame:
    """Documents with empty pages rendered again from what ``escalate(pages DataFrame)`` fetches for them.

    The second chance is one join on (source, path) and one more rendering of those pages only; what stays empty
    keeps its status.
    """
    empty = documents.where(F.col("status") == EMPTY).select("source", "path")
    again = render(escalate(pages.join(empty, ["source", "path"], "left_semi")))
    better = again.where(F.col("status") == OK)
    rest = documents.join(better.select("source", "path"), ["source", "path"], "left_anti")
    return rest.unionByName(better.select(documents.columns))
