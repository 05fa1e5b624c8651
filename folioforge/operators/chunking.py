"""Outlines and chunks of markdown, as array expressions on each row.

Nothing is shuffled and no row leaves the JVM: a document's lines are an array, its
headings and fences an array of places, and sections are slices between them. Each step
goes over an array once, or sorts it, so time grows with the document's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import let

MAX_TOKENS, SPLIT_LEVEL, MIN_BODY = 800, 2, 24
#: Entries of an array that a scan takes at once: what a step adds to is no longer than this.
SCAN = 128


def _inside(xs: Column, fence) -> Column:
    """For each entry whether the number of fences before it is odd."""
    codes = F.array_join(F.transform(xs, lambda x: F.when(fence(x), F.lit("F")).otherwise(F.lit("x"))), "")
    return F.flatten(F.transform(F.split(codes, "F", -1), lambda run, k: F.array_repeat(k % 2 == 1, F.length(run) + 1)))


def _scanned(xs: Column, zero: Column, step, kind: str) -> Column:
    """The states of a fold after each entry, in blocks: an array that grows by one is copied each time."""
    state = lambda of, last: F.struct(F.array().cast(f"array<{of}>").alias("out"), last.alias("last"))
    grown = lambda s, x, last: F.struct(F.concat(s["out"], F.array(x)).alias("out"), last.alias("last"))

    def over(blocks: Column) -> Column:
        inner = lambda start, block: F.aggregate(block, state(kind, start), lambda s, x: let(step(s["last"], x), lambda v: grown(s, v, v)))
        return F.aggregate(blocks, state(f"array<{kind}>", zero), lambda s, block: let(inner(s["last"], block), lambda r: grown(s, r["out"], r["last"])), lambda s: F.flatten(s["out"]))

    return let(xs, lambda a: over(F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / SCAN).cast("int")), lambda b: F.slice(a, b * SCAN + 1, SCAN))))


def _marks(lines: Column, level, text) -> Column:
    """Headings outside fences: array of (i, level, text), i the line's index from 0."""
    seen = F.transform(
        lines,
        lambda line, i: F.when(line.startswith("#"), F.struct(i.alias("i"), level(line).alias("level"), text(line).alias("text"))).when(
            line.contains("```") & T.trim_space(line).startswith("```"), F.struct(i.alias("i"), F.lit(-1).alias("level"), F.lit("").alias("text"))
        ),
    )
    seen = F.filter(seen, lambda x: x["level"] != 0)
    outside = lambda s: let(_inside(s, lambda x: x["level"] == -1), lambda inside: F.filter(s, lambda x, k: (x["level"] > 0) & ~F.get(inside, k)))
    return let(seen, lambda s: F.when(F.exists(s, lambda x: x["level"] == -1), outside(s)).otherwise(s))


def _anchored(heads: Column) -> Column:
    """Headings with anchors: the slug, or "section"; the n-th repeat of one gets "-n"."""
    based = F.transform(heads, lambda h: F.struct(h["i"].alias("i"), h["level"].alias("level"), h["text"].alias("text"), F.coalesce(F.nullif(T.slugify(h["text"]), F.lit("")), F.lit("section")).alias("base")))

    def nth(sorted_: Column) -> Column:
        # runs of equal slugs: the first of each is N, so what lies between two N is a run's rest
        codes = F.array_join(F.transform(sorted_, lambda x, i: F.when((i == 0) | (F.get(sorted_, i - 1)["base"] != x["base"]), F.lit("N")).otherwise(F.lit("r"))), "")
        runs = F.split(codes, "N", -1)
        counts = F.flatten(F.transform(F.slice(runs, 2, F.size(runs)), lambda run: F.sequence(F.lit(0), F.length(run))))
        return let(counts, lambda n: F.sort_array(F.transform(sorted_, lambda x, i: F.struct(x["k"].alias("k"), F.get(n, i).alias("n")))))

    def numbered(b: Column) -> Column:
        def one(h: Column, n: Column) -> Column:
            return F.struct(h["i"].alias("i"), h["level"].alias("level"), h["text"].alias("text"), F.when(n == 0, h["base"]).otherwise(F.concat(h["base"], F.lit("-"), n.cast("string"))).alias("anchor"))

        by_slug = F.sort_array(F.transform(b, lambda h, k: F.struct(h["base"].alias("base"), k.alias("k"))))
        return let(let(by_slug, nth), lambda places: F.transform(b, lambda h, k: one(h, F.get(places, k)["n"])))

    return let(based, numbered)


def outline(markdown: Column | str) -> Column:
    """array<struct<level, text, anchor, offset>> of a document's headings, H1 among them; offset in bytes."""

    def of_lines(lines: Column) -> Column:
        def placed(heads: Column) -> Column:
            # bytes from one heading to the next, then their running sum
            def span(h: Column, k: Column) -> Column:
                since = F.when(k == 0, F.lit(0)).otherwise(F.get(heads, k - 1)["i"])
                return F.when(h["i"] == 0, F.lit(0)).otherwise(F.octet_length(F.array_join(F.slice(lines, since + 1, h["i"] - since), "\n")) + F.when(h["i"] > since, 1).otherwise(0))

            offsets = _scanned(F.transform(heads, span), F.lit(0), lambda a, b: a + b, "int")
            return let(offsets, lambda at: F.transform(heads, lambda h, k: F.struct(h["level"].alias("level"), h["text"].alias("text"), h["anchor"].alias("anchor"), F.get(at, k).alias("offset"))))

        return let(_anchored(_marks(lines, T.outline_level, T.outline_text)), placed)

    return let(F.split(markdown, "\n", -1), of_lines)


def paragraphs(body: Column | str) -> Column:
    """Trimmed, non-empty paragraphs; blank lines inside fences do not end one."""
    body = F.col(body) if isinstance(body, str) else body
    plain = F.split(body, r"(?U)\n(?:[^\S\n]*\n)+", -1)

    def fenced(lines: Column) -> Column:
        is_fence = lambda line: T.trim_space(line).startswith("```")
        ends = let(_inside(lines, is_fence), lambda inside: F.filter(F.transform(lines, lambda line, i: F.when((T.trim_space(line) == "") & ~F.get(inside, i), i)), lambda i: i.isNotNull()))
        edges = F.concat(F.array(F.lit(-1)), ends, F.array(F.size(lines)))
        return let(edges, lambda e: F.transform(F.slice(e, 1, F.size(e) - 1), lambda a, k: F.array_join(F.slice(lines, a + 2, F.get(e, k + 1) - a - 1), "\n")))

    parts = F.when(body.contains("```"), let(F.split(body, "\n", -1), fenced)).otherwise(plain)
    return F.filter(F.transform(parts, T.trim_space), lambda p: p != "")


def packed(parts: Column, max_tokens: int = MAX_TOKENS, min_body: int = MIN_BODY) -> Column:
    """Paragraphs joined to bodies of at most so many tokens, greedily; a longer paragraph stays whole, a body of too
    few bytes is dropped."""
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("tok"))
    flushed = lambda s: F.when(F.octet_length(T.trim_space(s["cur"])) >= min_body, F.concat(s["done"], F.array(T.trim_space(s["cur"])))).otherwise(s["done"])

    def step(s: Column, p: Column) -> Column:
        t = T.estimate_tokens(p)
        full = (s["tok"] + t > max_tokens) & (s["cur"] != "")
        return F.struct(
            F.when(full, flushed(s)).otherwise(s["done"]).alias("done"),
            F.when(full | (s["cur"] == ""), p).otherwise(F.concat(s["cur"], F.lit("\n\n"), p)).alias("cur"),
            F.when(full, t).otherwise(s["tok"] + t).cast("int").alias("tok"),
        )

    return F.aggregate(parts, state, step, flushed)


def sections(markdown: Column | str, split_level: int = SPLIT_LEVEL, min_body: int = MIN_BODY) -> Column:
    """array<struct<heading_path, anchor, body>>: a document cut at headings of levels 2 to ``split_level``.

    H1 never cuts and is in no path; deeper headings use up anchors but leave path and anchor as they are; a section
    of too few bytes is dropped.
    """
    body_of = lambda lines, a, b: T.trim_space(F.array_join(F.slice(lines, a + 1, F.greatest(b - a, F.lit(0))), "\n"))

    def of_lines(lines: Column) -> Column:
        def cut(heads: Column) -> Column:
            at = F.filter(F.transform(heads, lambda h, k: F.struct(h["i"].alias("i"), h["level"].alias("level"), h["text"].alias("text"), h["anchor"].alias("anchor"), k.alias("k"))), lambda h: h["level"] <= split_level)

            # the headings above each one: those that are not shallower than the next go
            stack = lambda s, h: F.concat(F.filter(s, lambda g: g["level"] < h["level"]), F.array(F.struct(h["level"].alias("level"), h["text"].alias("text"))))
            above = _scanned(heads, F.array().cast("array<struct<level:int,text:string>>"), stack, "array<struct<level:int,text:string>>") if split_level > 2 else F.lit(None)

            def parts(a: Column, above: Column) -> Column:
                path = lambda h: F.array(h["text"]) if split_level <= 2 else F.transform(F.get(above, h["k"]), lambda g: g["text"])
                head = F.struct(F.array().cast("array<string>").alias("heading_path"), F.lit("").alias("anchor"), body_of(lines, F.lit(0), F.coalesce(F.get(a, 0)["i"], F.size(lines))).alias("body"))
                rest = F.transform(a, lambda h, k: F.struct(path(h).alias("heading_path"), h["anchor"].alias("anchor"), body_of(lines, h["i"], F.coalesce(F.get(a, k + 1)["i"], F.size(lines))).alias("body")))
                return F.concat(F.array(head), rest)

            return let(above, lambda up: let(at, lambda a: parts(a, up)))

        heads = F.filter(_marks(lines, T.heading_level, T.heading_text), lambda h: h["level"] >= 2)
        return let(_anchored(heads), cut)

    return F.filter(let(F.split(markdown, "\n", -1), of_lines), lambda s: F.octet_length(s["body"]) >= min_body)


def chunk_array(markdown: Column | str, max_tokens: int = MAX_TOKENS, split_level: int = SPLIT_LEVEL, min_body: int = MIN_BODY) -> Column:
    """array<struct<heading_path, anchor, body>>: sections, those over ``max_tokens`` cut again at paragraphs."""

    def small(s: Column) -> Column:
        bodies = let(packed(paragraphs(s["body"]), max_tokens, min_body), lambda b: F.when(F.size(b) == 0, F.array(s["body"])).otherwise(b))
        return F.when(T.estimate_tokens(s["body"]) <= max_tokens, F.array(s)).otherwise(F.transform(bodies, lambda b: F.struct(s["heading_path"].alias("heading_path"), s["anchor"].alias("anchor"), b.alias("body"))))

    return F.flatten(F.transform(sections(markdown, split_level, min_body), small))


def chunk(docs: DataFrame, max_tokens: int = MAX_TOKENS, split_level: int = SPLIT_LEVEL, min_body: int = MIN_BODY, markdown_col: str = "markdown") -> DataFrame:
    """Documents -> chunks: all columns but the markdown, with heading_path, anchor, body, token_count and ord from 0."""
    keep = [c for c in docs.columns if c not in (markdown_col, "heading_path", "anchor", "body", "token_count", "ord", "outline")]
    split = docs.select(*keep, F.posexplode(chunk_array(F.coalesce(F.col(markdown_col), F.lit("")), max_tokens, split_level, min_body)).alias("ord", "chunk_"))
    return split.select(*keep, "chunk_.heading_path", "chunk_.anchor", "chunk_.body", T.estimate_tokens(F.col("chunk_.body")).alias("token_count"), "ord")


def flat_outline(docs: DataFrame, markdown_col: str = "markdown") -> DataFrame:
    """One row for each heading: all columns but the markdown, with pos, level, text, anchor and offset."""
    keep = [c for c in docs.columns if c != markdown_col]
    return docs.select(*keep, F.posexplode(outline(F.coalesce(F.col(markdown_col), F.lit("")))).alias("pos", "h_")).select(*keep, "pos", "h_.level", "h_.text", "h_.anchor", "h_.offset")
