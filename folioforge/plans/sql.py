"""Functions for users of SQL: ``register(spark)`` makes them known to a session.

estimate_tokens(text), slug(text), content_type(name) and stem(word) are scalar;
``chunk_markdown(markdown)`` is a table function, with a row for each chunk:

    SELECT d.path, c.* FROM documents d, LATERAL chunk_markdown(d.markdown) c

It is for SQL only: ``operators.chunking`` does the same in the JVM and is what the
engine uses.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import porter
from ..operators.chunking import MAX_TOKENS, MIN_BODY, SPLIT_LEVEL

CHUNKS = "ord int, heading_path array<string>, anchor string, body string, token_count int"
_HEADING = regex.compile(r"(#{1,6})[ \t](.*)", regex.S)
_SELF_LINK = regex.compile(r"\[([^\]]+)\]\(#[^)]*\)")


def tokens_of(text: str) -> int:
    n = len(text.encode())
    return max(n // 4, 1) if n else 0


def _slug(text: str) -> str:
    kept = regex.sub(r"[^\p{L}\p{Nd} \t_-]", "", text.lower())
    return regex.sub(r"[ \t_-]+", "-", kept).strip("-")


def _heading(line: str) -> tuple[int, str]:
    found = _HEADING.match(line)
    text = _SELF_LINK.sub(r"\1", found[2].rstrip("#").strip()).strip() if found else ""
    return (len(found[1]), text) if text else (0, "")


def sections(markdown: str) -> Iterator[tuple[list[str], str, str]]:
    """(heading path, anchor, body) of what lies between headings of level 2; others use up anchors only."""
    path, anchor, body, used, inside = [], "", [], {}, False
    for line in markdown.split("\n"):
        fence = line.strip().startswith("```")
        level, text = (0, "") if inside or fence else _heading(line)
        inside ^= fence
        if level >= 2:
            base = _slug(text) or "section"
            used[base] = used.get(base, -1) + 1
            if level <= SPLIT_LEVEL:
                yield path, anchor, "\n".join(body).strip()
                path, anchor, body = [text], base if not used[base] else f"{base}-{used[base]}", []
        body.append(line)
    yield path, anchor, "\n".join(body).strip()


def paragraphs(body: str) -> list[str]:
    out, inside = [[]], False
    for line in body.split("\n"):
        fence = line.strip().startswith("```")
        if not line.strip() and not inside and not fence:
            out.append([])
        else:
            out[-1].append(line)
        inside ^= fence
    return [p for p in ("\n".join(x).strip() for x in out) if p]


def packed(parts: list[str], max_tokens: int = MAX_TOKENS) -> list[str]:
    done, some, size = [], [], 0
    for p in parts:
        n = tokens_of(p)
        if some and size + n > max_tokens:
            done.append("\n\n".join(some))
            some, size = [], 0
        some.append(p)
        size += n
    done.append("\n\n".join(some))
    return [b.strip() for b in done if len(b.strip().encode()) >= MIN_BODY]


def chunks(markdown: str | None) -> Iterator[tuple[int, list[str], str, str, int]]:
    """The rows of ``chunk_markdown``."""
    n = 0
    for path, anchor, body in sections(markdown or ""):
        if len(body.encode()) < MIN_BODY:
            continue
        for part in [body] if tokens_of(body) <= MAX_TOKENS else packed(paragraphs(body)) or [body]:
            yield n, path, anchor, part, tokens_of(part)
            n += 1


class ChunkMarkdown:
    def eval(self, markdown: str):
        yield from chunks(markdown)


def register(spark: SparkSession) -> None:
    """Make the functions known to a session, by the names above."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION estimate_tokens(x STRING) RETURNS INT RETURN CASE WHEN octet_length(x) = 0 THEN 0 ELSE greatest(octet_length(x) div 4, 1) END")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION slug(x STRING) RETURNS STRING RETURN trim(BOTH '-' FROM regexp_replace(regexp_replace(lower(x), '[^\\p{L}\\p{Nd} \\t_-]', ''), '[ \\t_-]+', '-'))")

    @F.pandas_udf("string")
    def stem(word: pd.Series) -> pd.Series:
        return word.map(lambda w: None if w is None else porter.stem(w.lower()))

    spark.udf.register("stem", stem)
    spark.udtf.register("chunk_markdown", F.udtf(ChunkMarkdown, returnType=CHUNKS))
