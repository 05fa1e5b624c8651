"""Ranked full-text search over chunks: an index of plain tables, and BM25 on it.

Tables of an index (parquet, by source; ``segments`` keeps them):
  chunks     what was indexed, with chunk_id
  postings   (source, chunk_id, dl, col, pos, term), a row for each token, dealt by ranges of source and term
  lengths    (source, chunk_id, path, ord, dl)
  vocabulary (term, stem), distinct terms only
  stats      (source, n_all, total), chunks and their tokens by source
  stems      (source, stem, df), chunks that have a stem, of saved indexes: rows add up over segments and sources

Terms are stored unstemmed: a query's stems are looked up in the vocabulary first, and
the few terms that share them select postings, as literals that reach the scan. What is
counted, once for all queries, are units: a phrase's stems, whoever asks for them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import porter
from ..functions.tokens import tokenize, tokens
from ..sources.shared import settled
from . import tallies

K1, B = 1.2, 0.75
#: What an inverse document frequency that is not positive counts as.
LEAST_IDF = 1e-6
LIMIT = 10
SEPARATOR = " › "
#: Marks around what matched, what stands for text left out, tokens of a snippet.
OPEN, CLOSE, CUT, SNIPPET = "[", "]", " ... ", 24
KEY = ("source", "chunk_id")
#: Terms that select postings, and hits that select chunks, as literals that reach the scan; hits that are joined to their
#: chunks by a broadcast. More are joined as tables.
LITERALS, FEW = 1000, 100_000


@dataclass
class Index:
    chunks: DataFrame
    postings: DataFrame
    lengths: DataFrame
    vocabulary: DataFrame
    stats: DataFrame
    stemmed: bool = True
    #: Distinct terms, of an index that is not saved: its vocabulary is stemmed only as far as a query needs it.
    terms: DataFrame | None = None
    #: (source, chunk_id, term), each once, of an index that is not saved; (source, stem, df) of a saved one.
    pairs: DataFrame | None = None
    stems: DataFrame | None = None
    #: The chunks with their tokens, of an index that is not saved; whether they came with them.
    tokenised: DataFrame | None = None
    told: bool = False


def chunk_id(*extra: Column | str) -> Column:
    return F.xxhash64("source", "path", "ord", *extra)


def tokenized(chunks: DataFrame) -> DataFrame:
    """Chunks with chunk_id and tokens_, the tokens of title, heading path and body. Written in between, it saves
    ``build`` from tokenising the same text for postings, lengths and vocabulary."""
    texts = (F.col("title"), F.array_join("heading_path", SEPARATOR), F.col("body"))
    return chunks.withColumns({"chunk_id": chunk_id(), "tokens_": F.array(*(tokens(x) for x in texts))}).withColumn("dl_", _sizes())


def postings(chunks: DataFrame) -> DataFrame:
    """A row for each token of tokenised chunks; no shuffle."""
    return chunks.select(*KEY, _dl(chunks).alias("dl"), F.posexplode("tokens_").alias("col", "t")).select(*KEY, "dl", "col", F.posexplode("t").alias("pos", "term"))


def _some_postings(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """``postings`` of a few terms: other tokens go before they become rows."""
    some = lambda t: F.filter(F.transform(t, lambda x, i: F.when(x.isin(terms), F.struct(i.alias("pos"), x.alias("term")))), lambda s: s.isNotNull())
    return chunks.select(*KEY, _dl(chunks).alias("dl"), F.posexplode("tokens_").alias("col", "t")).select(*KEY, "dl", "col", F.inline(some(F.col("t"))))


def _sizes() -> Column:
    return F.aggregate("tokens_", F.lit(0), lambda n, t: n + F.size(t)).cast("long")


def _dl(chunks: DataFrame) -> Column:
    """Tokens of a chunk, as ``tokenized`` counted them."""
    return F.col("dl_") if "dl_" in chunks.columns else _sizes()


def lengths(chunks: DataFrame) -> DataFrame:
    """Tokens of each chunk over the three columns."""
    return chunks.select(*KEY, "path", "ord", _dl(chunks).alias("dl"))


def vocabulary(terms: DataFrame, stemmed: bool = True) -> DataFrame:
    """(term, stem) of distinct terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([porter.stem(t) for t in batch.column(0).to_pylist()], pa.string())], names=["term", "stem"])

    distinct = terms.select("term").distinct()
    return distinct.mapInArrow(run, "term string, stem string") if stemmed else distinct.withColumn("stem", F.col("term"))


def build(chunks: DataFrame, stemmed: bool = True) -> Index:
    """An index of chunks(source, url, path, title, heading_path, anchor, body, token_count, ord), lazily.

    Saving one takes tokens that chunks came with (``tokenized``) as they are; others are made of the texts as saved, so
    neither texts nor tokens need to be written before.
    """
    told = "tokens_" in chunks.columns
    chunks = chunks if told else tokenized(chunks)
    posts, sizes = postings(chunks), lengths(chunks)
    stats = sizes.groupBy("source").agg(F.count("*").alias("n_all"), F.sum("dl").alias("total"))
    pairs = chunks.select(*KEY, F.explode(F.array_distinct(F.flatten("tokens_"))).alias("term"))
    return Index(chunks.drop("tokens_", "dl_"), posts, sizes, vocabulary(posts, stemmed), stats, stemmed, posts.select("term").distinct(), pairs, tokenised=chunks, told=told)


def stem_counts(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(source, stem, df): chunks with any form of a stem, from the distinct terms of each chunk."""
    return pairs.join(words, "term").select(*KEY, "stem").distinct().groupBy("source", "stem").agg(F.count("*").alias("df"))


def save(index: Index, path: str) -> None:
    """Write an index, each source replaced as a whole, in one step; other sources stay."""
    from . import segments

    segments.save(index, path)


def load(spark: SparkSession, path: str, stemmed: bool = True) -> Index:
    """A saved index; one whose sources are all gone, or that is not there yet, has no rows."""
    from . import segments

    return segments.load(spark, path, stemmed)


def phrases(query: str) -> list[str]:
    """A query's phrases: its words without quotes and edge marks; they are joined by OR."""
    words = (w.strip("():*\"'") for w in regex.split(r"\s+", query.replace('"', "")))
    return [w for w in words if w]


def sanitized(query: str) -> str:
    return " OR ".join(f'"{p}"' for p in phrases(query))


def phrases_column(query: Column | str) -> Column:
    """The phrases of queries in a column."""
    query = F.col(query) if isinstance(query, str) else query
    words = F.split(F.replace(F.coalesce(query, F.lit("")), F.lit('"'), F.lit("")), r"(?U)\s+", -1)
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"""^[():*"']+|[():*"']+$""", "")), lambda w: w != "")


def sanitized_column(query: Column | str) -> Column:
    return F.array_join(F.transform(phrases_column(query), lambda p: F.concat(F.lit('"'), p, F.lit('"'))), " OR ")


def _plan(query: str, stemmed: bool) -> list[tuple[int, int, int, str]]:
    """(phrase, place in it, its length, stem); a phrase without tokens matches nothing and is left out."""
    out = []
    for i, p in enumerate(phrases(query)):
        toks = [porter.stem(t) if stemmed else t for t in tokenize(p)]
        out += [(i, k, len(toks), t) for k, t in enumerate(toks)]
    return out


def _units(plans: dict) -> tuple[list[tuple], list[tuple]]:
    """Plans by query -> units (unit, place, size, stem), and uses (query, unit, times)."""
    numbers: dict[tuple[str, ...], int] = {}
    uses: Counter = Counter()
    for query, plan in plans.items():
        stems: dict[int, list[str]] = {}
        for phrase, _, _, stem in plan:
            stems.setdefault(phrase, []).append(stem)
        for of in stems.values():
            uses[query, numbers.setdefault(tuple(of), len(numbers))] += 1
    return [(n, i, len(of), stem) for of, n in numbers.items() for i, stem in enumerate(of)], [(q, u, n) for (q, u), n in uses.items()]


def planned(queries: DataFrame, stemmed: bool = True) -> DataFrame:
    """queries(query_id, query) -> (query, unit, times, stems): the phrases of any number of queries, each once a query.

    A unit is a phrase's stems; its number is a hash of them. Words are stemmed as the vocabulary is, each once. Phrases
    without tokens are left out, and so are queries without phrases; rows with one id are one query.
    """
    found = queries.select(F.col("query_id").alias("query"), F.monotonically_increasing_id().alias("row"), F.posexplode(phrases_column("query")).alias("phrase", "p")).select("query", "row", "phrase", F.posexplode(tokens("p")).alias("place", "term"))
    stems = found.join(vocabulary(found, stemmed), "term")
    units = stems.groupBy("query", "row", "phrase").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "stem"))), lambda x: x["stem"]).alias("stems"))
    return units.groupBy("query", F.xxhash64("stems").alias("unit"), "stems").agg(F.count("*").cast("int").alias("times"))


def _beginning(stem: str) -> str:
    """What all terms with a stem begin with: it is a term's beginning, but for a last e or i, or the l of a last bl, which
    stemming may put there."""
    return stem[:-1] if stem.endswith(("e", "i", "bl")) else stem


def _counts(posts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``unit_counts`` for units in a table (term, unit, place, size), which may be many."""
    one = posts.join(wanted.where("size = 1").select("term", "unit"), "term").groupBy(*KEY, "dl", "unit").agg(F.count("*").alias("f"))
    hit = posts.join(wanted.where("size > 1"), "term")
    starts = hit.groupBy(*KEY, "dl", "unit", "size", "col", (F.col("pos") - F.col("place")).alias("start")).agg(F.count("*").alias("n")).where("n = size")
    return one.unionByName(starts.groupBy(*KEY, "dl", "unit").agg(F.count("*").alias("f")))


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver's; joined by a broadcast up to FEW."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= FEW else df


def unit_counts(index: Index, units: list[tuple]) -> DataFrame:
    """(source, chunk_id, dl, unit, f): how often each unit stands in each chunk, in any one column.

    Terms of the units' stems come to the driver first; up to LITERALS of them select postings as literals. An index that
    is not saved has its tokens in arrays: only those terms become rows, once, and are written. A token of
    a unit of several votes for the position where the unit would start; starts with all votes count.
    """
    spark = index.chunks.sparkSession
    stems = sorted({u[3] for u in units})
    if not index.stemmed:
        found = [(t, t) for t in stems]
        terms = _rows(spark, found, "term string, stem string")
    else:
        known = index.vocabulary
        if len(stems) <= LITERALS and (index.terms is not None or index.tokenised is not None):
            starts = sorted({_beginning(t) for t in stems})
            # a few beginnings are compared as bytes, which costs far less a token than a pattern
            begins = (lambda t: reduce(Column.__or__, [t.startswith(b) for b in starts])) if len(starts) <= 8 else (lambda t: t.rlike("^(?:" + "|".join(map(regex.escape, starts)) + ")"))
            if index.tokenised is not None:
                some = index.tokenised.select(F.explode(F.filter(F.flatten("tokens_"), begins)).alias("term"))
            else:
                some = index.terms.where(begins(F.col("term")))
            known = vocabulary(some)
        terms = known.where(F.col("stem").isin(stems)) if len(stems) <= LITERALS else known.join(spark.createDataFrame([(t,) for t in stems], "stem string"), "stem")
        terms = terms.select("term", "stem").distinct()  # writers at one time may have added a term twice
        found = [tuple(r) for r in terms.limit(LITERALS + 1).collect()]
    if len(found) <= LITERALS:
        few = [t for t, _ in found]
        posts = settled(_some_postings(index.tokenised, few), "hits") if index.tokenised is not None else index.postings.where(F.col("term").isin(few))
        terms = _rows(spark, found, "term string, stem string")
    else:
        posts = index.postings
    hit = posts.join(terms, "term")
    counts = None
    if any(u[2] == 1 for u in units):
        counts = hit.join(_rows(spark, [(u[0], u[3]) for u in units if u[2] == 1], "unit int, stem string"), "stem").groupBy(*KEY, "dl", "unit").agg(F.count("*").alias("f"))
    if any(u[2] > 1 for u in units):
        starts = hit.join(_rows(spark, [u for u in units if u[2] > 1], "unit int, place int, size int, stem string"), "stem").groupBy(*KEY, "dl", "unit", "size", "col", (F.col("pos") - F.col("place")).alias("start")).agg(F.count("*").alias("n")).where("n = size")
        many = starts.groupBy(*KEY, "dl", "unit").agg(F.count("*").alias("f"))
        counts = many if counts is None else counts.unionByName(many)
    return counts


def weighed(counts: DataFrame, index: Index, units: list[tuple], scope: str = "source") -> DataFrame:
    """(source, chunk_id, unit, part): what a unit adds to a chunk's score by BM25, whoever asks for it.

    Statistics are those of the chunk's source, or of all chunks with scope "global". ``counts`` is used twice with all its
    columns, so that both uses share its shuffle; a saved index has the number of chunks with a single word stored, so only
    phrases of several are counted.
    """
    group = ("source",) if scope == "source" else ()
    stats = index.stats if group else index.stats.agg(F.sum("n_all").alias("n_all"), F.sum("total").alias("total"))
    stats = stats.select(*group, "n_all", (F.col("total") / F.col("n_all")).alias("avgdl"))
    df, stored = None, index.stems is not None and index.stemmed
    if stored and any(u[2] == 1 for u in units):
        single = [(u[0], u[3]) for u in units if u[2] == 1]
        known = index.stems.where(F.col("stem").isin(sorted({t for _, t in single}))) if len(single) <= LITERALS else index.stems
        df = known.groupBy(*group, "stem").agg(F.sum("df").alias("n")).join(_rows(counts.sparkSession, single, "unit int, stem string"), "stem").select(*group, "unit", "n")
    if not stored or any(u[2] > 1 for u in units):
        counted = counts.join(_rows(counts.sparkSession, sorted({(u[0],) for u in units if u[2] > 1}), "unit int"), "unit", "left_semi") if stored else counts
        counted = counted.groupBy(*group, "unit").agg(F.count_if(F.col("f") > 0).alias("n"))
        df = counted if df is None else df.unionByName(counted)
    df = df.join(stats, "source") if group else df.crossJoin(F.broadcast(stats))  # one row
    idf = F.log((F.col("n_all") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    df = df.select(*group, "unit", "avgdl", F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF)).alias("idf"))
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return counts.join(df, [*group, "unit"]).select(*KEY, "unit", part.alias("part"))


def scored(index: Index, plans: dict, kind: str, scope: str = "source", sources: list[str] | None = None) -> DataFrame | None:
    """(query, source, chunk_id, score) by BM25, lower is better; none if no query has a word. Other sources than those
    given have no hits, and a filter changes no statistics."""
    units, uses = _units(plans)
    if not units:
        return None
    some = lambda df: df.where(F.col("source").isin(sources)) if sources else df
    if sources and scope == "source":  # all that counts lies in the partitions of these sources
        index = replace(index, postings=some(index.postings), stats=some(index.stats), stems=some(index.stems) if index.stems is not None else None, terms=None, tokenised=some(index.tokenised) if index.tokenised is not None else None)
    counts = unit_counts(index, units)
    asked = _rows(index.chunks.sparkSession, uses, f"query {kind}, unit int, times int")
    rows = some(weighed(counts, index, units, scope))
    if len(uses) > len(units):  # many queries share units: a chunk's parts are dealt, not what each query makes of them
        rows = rows.repartition(*KEY)
    rows = rows.join(asked, "unit")
    return rows.groupBy("query", *KEY).agg((-F.sum(F.col("part") * F.col("times"))).alias("score"))


def _near(index: Index, plans: dict, kind: str, limit: int) -> DataFrame | None:
    """(query, source, chunk_id, score) of whatever can be among the best of each query, by statistics of all chunks, from
    the tokens of an index that is not saved. No pair of query and chunk is shuffled but the best of each task."""
    units, uses = _units(plans)
    if not units:
        return None
    spark, asked = index.chunks.sparkSession, tallies.Asked(units, index.stemmed)
    all_ = index.stats.agg(F.sum("n_all").alias("n"), F.sum("total").alias("total")).first()
    if not all_.n:
        return None
    n = np.zeros(asked.n)
    for r in tallies.unit_df(index.tokenised, asked).collect():
        n[r.unit] = r.n
    idf = np.log((all_.n - n + 0.5) / (n + 0.5))
    number = {q: i for i, q in enumerate(plans)}
    rows = tallies.best_of(index.tokenised, asked, [(number[q], u, t) for q, u, t in uses], np.where(idf > 0, idf, LEAST_IDF), all_.total / all_.n, K1, B, limit)
    return settled(rows, "scores").join(_rows(spark, [(i, q) for q, i in number.items()], f"n long, query {kind}"), "n").select("query", *KEY, "score")


def best(rows: DataFrame, index: Index, limit: int = LIMIT, offset: int = 0, by: tuple[str, ...] = ("query", "source"), whole: bool = False) -> DataFrame:
    """The best ``limit`` rows of each group with rank from 1; ties by source, path and place. limit 0 or less is 10.

    Paths are looked up only for rows that can be among them: those whose score is, ties included. ``whole`` adds what
    was indexed.
    """
    limit, score = limit if limit > 0 else LIMIT, F.round("score", 9)
    if by:
        near = rows.withColumn("near_", F.rank().over(Window.partitionBy(*by).orderBy(score))).where(F.col("near_") <= offset + limit).drop("near_")
    else:
        rows = settled(rows, "scores")
        worst = rows.select(score.alias("s")).orderBy("s").limit(offset + limit).agg(F.max("s")).first()[0]
        near = rows.where(score <= F.lit(worst))
    found = near.limit(LITERALS + 1).collect()
    if len(found) <= LITERALS:  # they are looked up as literals; nothing is written
        near, ids, small = near.sparkSession.createDataFrame(found, near.schema), sorted({r.chunk_id for r in found}), F.broadcast
        picked = lambda df: df.where(F.col("chunk_id").isin(ids))
    else:
        near, picked = settled(near, "near"), lambda df: df
        small = F.broadcast if near.count() <= FEW else lambda df: df
    placed, order = picked(index.lengths).select(*KEY, "path", "ord").join(small(near), list(KEY)), [score, "source", "path", "ord"]
    top = placed if by else placed.orderBy(*order).limit(offset + limit)
    ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where((F.col("rank") <= offset + limit) & (F.col("rank") > offset))
    return picked(index.chunks).join(small(ranked.drop("path", "ord")), list(KEY)) if whole else ranked


def search(index: Index, query: str, sources: list[str] | None = None, limit: int = LIMIT, offset: int = 0, scope: str = "source", with_snippet: bool = True, global_limit: int | None = None) -> DataFrame:
    """Hits of one query: the best ``limit`` of each source in order of sources, or the best ``global_limit`` of all.

    A blank query is an error; one without a word in it has no hits. Unknown sources have none either. Statistics are
    those of a chunk's source, or with scope "global" those of all sources, also where ``sources`` says which may hit.
    """
    if not query.strip():
        raise ValueError("empty query")
    plan = _plan(query, index.stemmed)
    rows = scored(index, {0: plan}, "int", scope, sources)
    if rows is None:
        hits = index.chunks.where("false").withColumns({"score": F.lit(0.0), "rank": F.lit(0)})
        return hits.withColumn("snippet", F.lit("")) if with_snippet else hits
    hits = best(rows, index, limit, offset, whole=True) if global_limit is None else best(rows, index, global_limit, offset, (), whole=True)
    hits = hits.drop("query").orderBy(*(("source", "rank") if global_limit is None else ("rank",)))
    # after the sort, whose sampling would make them twice
    return hits.withColumn("snippet", snippet_udf(plan, index.stemmed)(F.col("body"))) if with_snippet else hits


def search_batch(index: Index, queries: DataFrame, limit: int = LIMIT, scope: str = "global") -> DataFrame:
    """Hits of any number of queries(query_id, query) at once: (query_id, source, path, ord, score, rank).

    A unit is counted and weighed once for all queries that have it; an index that is not saved is scored by slices of its
    chunks, each of which gives its best. Up to LITERALS queries are planned on the driver, more
    stay a table whose phrases and stems are columns. Rows with one id are one query, null ids too; blank and null queries
    have no hits.
    """
    kind = queries.schema["query_id"].dataType.simpleString()
    few = queries.select("query_id", "query").limit(LITERALS + 1).collect()
    if len(few) <= LITERALS:
        plans: dict = {}
        for n, r in enumerate(few):
            plans.setdefault(r.query_id, []).extend(((n, phrase), *rest) for phrase, *rest in _plan(r.query or "", index.stemmed))
        rows = _near(index, plans, kind, limit if limit > 0 else LIMIT) if index.tokenised is not None and scope == "global" else scored(index, plans, kind, scope)
        if rows is None:
            rows = index.lengths.where("false").select(F.lit(None).cast(kind).alias("query"), *KEY, F.lit(0.0).alias("score"))
    else:
        plan = settled(planned(queries, index.stemmed), "plan")
        units = plan.select("unit", F.posexplode("stems").alias("place", "stem"), F.size("stems").alias("size")).distinct()
        stems = units.select("stem").distinct()
        terms = stems.select("stem", F.col("stem").alias("term")) if not index.stemmed else index.vocabulary.join(stems, "stem").select("term", "stem").distinct()
        wanted = settled(terms.join(units, "stem").select("term", "unit", "place", "size"), "wanted")  # its size decides how it is joined
        counts = settled(_counts(index.postings, wanted), "counts")
        # units are many and their chunks are counted already, so that is what weighs them
        parts = weighed(counts, replace(index, stems=None), [], scope)
        rows = parts.join(plan.select("query", "unit", "times"), "unit").groupBy("query", *KEY).agg((-F.sum(F.col("part") * F.col("times"))).alias("score"))
    return best(rows, index, limit, by=("query",)).select(F.col("query").alias("query_id"), "source", "path", "ord", "score", "rank")


_TOKEN = regex.compile(r"[\p{L}\p{N}\p{Co}\p{M}]+")


@lru_cache(maxsize=1 << 16)
def _word(text: str, stemmed: bool) -> str:
    found = tokenize(text)
    return (porter.stem(found[0]) if stemmed else found[0]) if found else ""


def snippet(body: str, plan: list[tuple[int, int, int, str]], stemmed: bool = True, size: int = SNIPPET) -> str:
    """``size`` tokens of a body around what matched, marked. Without a match in the body, its first tokens.

    Windows are tried at each match, centred on the matches from there on, and at the start of its sentence. A phrase
    in a window is worth 1000, its repeats 1 each, a start of a sentence 100, the start of the text 120; the first of
    the best counts.
    """
    spans = [(m.start(), m.end()) for m in _TOKEN.finditer(body)]
    if not spans:
        return body
    words = [_word(body[a:b], stemmed) for a, b in spans]
    wanted: dict[int, list[str]] = {}
    for phrase, _, _, t in sorted(plan):
        wanted.setdefault(phrase, []).append(t)
    opening: dict[str, list[tuple[int, list[str]]]] = {}
    for phrase, toks in wanted.items():
        opening.setdefault(toks[0], []).append((phrase, toks))
    hits = [(i, i + len(toks), phrase) for i, w in enumerate(words) for phrase, toks in opening.get(w, ()) if words[i : i + len(toks)] == toks]
    sentences = [0] + [i for i, (a, _) in enumerate(spans) if i and regex.search(r"[.:][ \t\r\n]+$", body[spans[i - 1][1] : a])]

    def inside(at: int) -> list[tuple[int, int, int]]:
        return [h for h in hits if at <= h[0] < at + size]

    def worth(found: list[tuple[int, int, int]]) -> int:
        kinds = len({h[2] for h in found})
        return 1000 * kinds + len(found) - kinds

    best_worth, begin = 0, 0
    for start, _, _ in hits:
        found = inside(start)
        if worth(found) > best_worth:
            first, last = found[0][0], found[-1][1]
            # half of what is left goes before, rounded towards zero
            best_worth, begin = worth(found), max(0, min(first - int((size - (last - first)) / 2), len(spans) - size))
        sentence = max(x for x in sentences if x <= start)
        if len(spans) > size and sentence < start:
            value = worth(inside(sentence)) + (100 if sentence else 120)
            if value > best_worth:
                best_worth, begin = value, sentence
    end = min(begin + size, len(spans))
    joined: list[list[int]] = []
    for a, b, _ in hits:  # phrases that overlap share a mark
        if joined and a < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    out, at = [], spans[begin][0] if begin else 0
    for a, b in joined:
        a, b = max(a, begin), min(b, end)
        if a < b:
            out += [body[at : spans[a][0]], OPEN, body[spans[a][0] : spans[b - 1][1]], CLOSE]
            at = spans[b - 1][1]
    whole = begin + size >= len(spans)
    out.append(body[at:] if whole else body[at : spans[end - 1][1]])
    return (CUT if begin else "") + "".join(out) + ("" if whole else CUT)


def snippet_udf(plan: list[tuple[int, int, int, str]], stemmed: bool = True):
    """For the few rows that are left after the best are taken."""

    @F.pandas_udf("string")
    def run(body: pd.Series) -> pd.Series:
        return body.map(lambda b: snippet(b or "", plan, stemmed))

    return run
