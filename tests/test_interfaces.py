import random

import pytest

from folioforge import interfaces
from folioforge.operators import chunking, render
from folioforge.plans import sql
from folioforge.plans.retriever import IndexRetriever
from folioforge.sources import kinds
from folioforge.sources.fetch import CommandFetcher, HttpFetcher, TableFetcher

from .test_search import DOCS


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(s, f"https://{p}", p, t, h, "", b, 1, 0) for s, p, t, h, b in DOCS]
    return spark.createDataFrame(rows, "source string, url string, path string, title string, heading_path array<string>, anchor string, body string, token_count int, ord int")


def test_parts_fit_their_places():
    assert all(isinstance(x, interfaces.Fetcher) for x in (HttpFetcher(), TableFetcher({}), CommandFetcher()))
    assert all(isinstance(f, interfaces.Source) for f in kinds.KINDS.values())
    assert isinstance(render.render, interfaces.Renderer) and isinstance(chunking.chunk, interfaces.Chunker)


def test_retriever(spark, chunks, tmp_path):
    r = IndexRetriever(spark, f"file://{tmp_path}/store")
    assert isinstance(r, interfaces.Retriever)
    paths = lambda *a, **k: {(h.source, h.path) for h in r.search(*a, **k).collect()}
    react, tailwind = chunks.where("source = 'react'"), chunks.where("source = 'tailwind'")
    r.index("react", react.where("path = 'a'"))
    r.index("react", react.where("path <> 'a'"))  # beside what is there
    r.index("tailwind", tailwind)
    assert paths("state") == {("react", "a"), ("react", "b"), ("tailwind", "e")} and paths("state", ["tailwind"]) == {("tailwind", "e")}
    assert [x.source for x in r.sources().collect()] == ["react", "tailwind"]
    r.index("react", react.where("path = 'a'").withColumn("body", chunks.title))  # the same place again
    assert paths("state") == {("react", "b"), ("tailwind", "e")} and r.store.index().chunks.count() == 5
    r.reindex("react", react.where("path = 'c'"))
    assert paths("state") == {("tailwind", "e")} and paths("javascript") == {("react", "c")}
    r.reindex("react", react.limit(0))
    r.remove("tailwind")
    r.close()
    assert r.sources().count() == 0 and paths("state javascript") == set()


def some_markdown():
    rng = random.Random(8)
    line = lambda: " ".join(rng.choice(("word", "and", "more", "text", "é")) for _ in range(rng.randint(1, 60)))
    kinds_ = [line, line, line, lambda: "", lambda: "", lambda: "```", lambda: "# " + line(), lambda: "## Same", lambda: "## [A b](#a-b) ##", lambda: "### Deeper", lambda: "##none", lambda: "## !!", lambda: " \t "]
    return ["", "plain", "## only", *("\n".join(rng.choice(kinds_)() for _ in range(rng.randint(1, 120))) for _ in range(60)), "# T\n" + "\n\n".join(line() * 6 for _ in range(40)), "## Long\n" + "x" * 5000]


def test_sql_functions(spark):
    """The table function gives what the engine's chunks are; scalar functions what the Column functions are."""
    from folioforge.functions import text as T

    sql.register(spark)
    docs = spark.createDataFrame([(i, m) for i, m in enumerate(some_markdown())] + [(999, None)], "id int, markdown string")
    docs.createOrReplaceTempView("some_markdown")
    got = spark.sql("SELECT d.id, c.* FROM some_markdown d, LATERAL chunk_markdown(d.markdown) c").collect()
    want = chunking.chunk(docs).select("id", "ord", "heading_path", "anchor", "body", "token_count").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want))) and len(got) > 100
    row = spark.sql("SELECT estimate_tokens('') AS a, estimate_tokens('abc') AS b, estimate_tokens('éééé') AS c, slug(' A_b  c!-') AS d, stem('Running') AS e").first()
    assert tuple(row) == (0, 1, 2, spark.range(1).select(T.slugify(T.F.lit(" A_b  c!-"))).first()[0], "run")
