import sqlite3

import pytest
from pyspark.sql import functions as F

from folioforge.operators import chunking, search

DOCS = [
    ("react", "a", "Hooks", ["useState"], "useState is a hook. It returns state: a value and a setter for running updates."),
    ("react", "b", "Hooks", ["useEffect"], "useEffect runs effects after paint. Effects may use state, too, and state again."),
    ("react", "c", "Café", [], "javascript-rendered pages are rendered by javascript. The rendered javascript is not a phrase."),
    ("tailwind", "d", "Config", ["Theme"], "Configure the theme in a file. Themes have colors. " * 6),
    ("tailwind", "e", "Generates", ["Plugins"], "Plugins generate classes; a plugin generates many. Nothing about state."),
]
QUERIES = ["state", "state hook", "javascript-rendered", "rendered-javascript", "generating", "theme theme", "cafe", "colors plugin nothing", "useState()", "absent state", '"state" "effects"', "zzz"]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(s, f"https://{p}", p, t, h, "", b, 1, 0) for s, p, t, h, b in DOCS]
    return spark.createDataFrame(rows, "source string, url string, path string, title string, heading_path array<string>, anchor string, body string, token_count int, ord int")


@pytest.fixture(scope="module")
def index(chunks):
    return search.build(chunks)


def gold(rows, query):
    """What a full-text table of the same columns says: (path, score, snippet), best first."""
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE c USING fts5(path UNINDEXED, title, heading, body, tokenize='porter unicode61')")
    con.executemany("INSERT INTO c VALUES (?,?,?,?)", [(p, t, " › ".join(h), b) for _, p, t, h, b in rows])
    q = search.sanitized(query)
    return con.execute("SELECT path, bm25(c), snippet(c, 3, '[', ']', ' ... ', 24) FROM c WHERE c MATCH ? ORDER BY 2", (q,)).fetchall() if q else []


@pytest.mark.parametrize("query", QUERIES)
def test_scores_and_snippets_by_source(index, query):
    got = search.search(index, query).collect()
    for source in ("react", "tailwind"):
        want = {p: (s, sn) for p, s, sn in gold([d for d in DOCS if d[0] == source], query)}
        mine = {r.path: (r.score, r.snippet) for r in got if r.source == source}
        assert mine.keys() == want.keys()
        for p, (score, text) in want.items():
            assert mine[p][0] == pytest.approx(score, abs=1e-9) and mine[p][1] == text


@pytest.mark.parametrize("query", ["state", "state hook rendered", "theme"])
def test_global_scope(index, query):
    got = {r.path: r.score for r in search.search(index, query, scope="global").collect()}
    assert got == pytest.approx({p: s for p, s, _ in gold(DOCS, query)}, abs=1e-9)


def test_limits_and_filters(index):
    assert [r.rank for r in search.search(index, "state hook", limit=1).collect()] == [1, 1]
    assert [r.path for r in search.search(index, "state", sources=["react"], limit=1, offset=1).collect()] == [search.search(index, "state", sources=["react"]).collect()[1].path]
    assert search.search(index, "state", sources=["none"]).count() == 0
    top = search.search(index, "state hook effects", global_limit=2).collect()
    assert [r.rank for r in top] == [1, 2] and top[0].score <= top[1].score
    with pytest.raises(ValueError):
        search.search(index, "   ")
    assert search.search(index, "()").count() == 0


def test_a_filter_changes_no_statistics(index):
    every = {(r.source, r.path): r.score for r in search.search(index, "state hook", scope="global", limit=50).collect()}
    some = {(r.source, r.path): r.score for r in search.search(index, "state hook", scope="global", sources=["tailwind"], limit=50).collect()}
    assert some and some == pytest.approx({k: v for k, v in every.items() if k[0] == "tailwind"}, abs=1e-12)
    top = search.search(index, "state hook", scope="global", sources=["react"], global_limit=1).first()
    assert top.score == pytest.approx(min(v for k, v in every.items() if k[0] == "react"), abs=1e-12)


def test_literals_reach_the_scan(spark, chunks, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    search.save(search.build(chunks), path)
    index = search.load(spark, path)
    units, _ = search._units({0: search._plan("state generating", True)})
    plan = search.unit_counts(index, units)._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan and plan.count("FileScan") == 1
    want = {tuple(r) for r in search.unit_counts(index, units).collect()}
    monkeypatch.setattr(search, "LITERALS", 0)  # as if the terms were too many for literals
    assert {tuple(r) for r in search.unit_counts(index, units).collect()} == want
    monkeypatch.setattr(search, "FEW", 0)
    assert search.search(index, "state").count() == 3


def test_ties_at_the_limit(spark, chunks):
    copies = chunks.where("path = 'a'").drop("path").crossJoin(spark.createDataFrame([(f"p{i:02}",) for i in range(30)], "path string")).select(chunks.columns)
    hits = search.search(search.build(copies), "hook", limit=4, offset=3, with_snippet=False).collect()
    assert [(h.path, h.rank) for h in hits] == [(f"p{i:02}", i + 1) for i in range(3, 7)]
    assert [h.path for h in search.search(search.build(copies), "hook", global_limit=2, with_snippet=False).collect()] == ["p00", "p01"]


def test_sanitized():
    cases = {"react hooks": '"react" OR "hooks"', "useState()": '"useState"', 'say "hello" world': '"say" OR "hello" OR "world"', "": "", "   ": "", "()": ""}
    assert {q: search.sanitized(q) for q in cases} == cases


def test_batch_is_many_searches(spark, chunks):
    index = search.build(chunks)
    queries = spark.createDataFrame([(i, q) for i, q in enumerate(QUERIES)] + [(99, None)], "query_id int, query string")
    got = {(r.query_id, r.path): r.score for r in search.search_batch(index, queries, limit=100).collect()}
    want = {(i, p): s for i, q in enumerate(QUERIES) for p, s, _ in gold(DOCS, q)}
    assert got == pytest.approx(want, abs=1e-9)


def test_save_replaces_sources(spark, chunks, tmp_path):
    path = f"file://{tmp_path}/index"
    search.save(search.build(chunks), path)
    before = {r.path: r.score for r in search.search(search.load(spark, path), "state").collect()}
    assert before == pytest.approx({r.path: r.score for r in search.search(search.build(chunks), "state").collect()})
    search.save(search.build(chunks.where("source = 'react' and path <> 'b'")), path)
    again = search.load(spark, path)
    assert {(r.source, r.path) for r in again.chunks.collect()} == {("react", "a"), ("react", "c"), ("tailwind", "d"), ("tailwind", "e")}
    assert again.vocabulary.count() == again.vocabulary.select("term").distinct().count()
    assert {r.path for r in search.search(again, "state").collect()} == {"a", "e"}


def test_snippet_edges():
    plan = [(0, 0, 1, "x")]
    assert search.snippet("", plan) == "" and search.snippet("...", plan) == "..." and search.snippet("a x", plan) == "a [x]"
    assert search.snippet("w " * 40, plan) == ("w " * 24).strip() + " ... "


def test_stored_statistics_are_those_counted(spark, chunks, tmp_path):
    """A saved index weighs by stored counts of stems, several forms of one in a chunk counted once, phrases as before."""
    path = f"file://{tmp_path}/index"
    more = chunks.withColumn("body", F.concat("body", F.lit(" hook hooks hooked hooking"))).where("path = 'a'").withColumn("path", F.lit("z"))
    index = search.build(chunks.unionByName(more))
    search.save(index, path)
    saved = search.load(spark, path)
    for scope in ("source", "global"):
        for q in ("state hook", "javascript-rendered", "hook hooking", "use-state hook"):
            key = lambda i: sorted((h.source, h.path, round(h.score, 9)) for h in search.search(i, q, scope=scope, limit=50, with_snippet=False).collect())  # noqa: B023, E731
            assert key(saved) == key(index)


@pytest.mark.parametrize("most", [1000, 2])
def test_batch_of_few_and_of_many(spark, chunks, monkeypatch, most):
    """Planned on the driver or as a table: repeated words, rows with one id, null ids, blanks, clashing columns."""
    monkeypatch.setattr(search, "LITERALS", most)
    index = search.build(chunks)
    rows = [(1, "state state hook"), (1, "state"), (None, "hook"), (2, None), (3, " () "), (4, "javascript-rendered state")]
    queries = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "query_id int, query string, source string, score double")
    plan = {(r.query, tuple(r.stems)): r.times for r in search.planned(queries).collect()}
    assert plan == {(1, ("state",)): 3, (1, ("hook",)): 1, (None, ("hook",)): 1, (4, ("javascript", "render")): 1, (4, ("state",)): 1}
    got = {(r.query_id, r.path): r.score for r in search.search_batch(index, queries, limit=100).collect()}
    want = {(q, p): s for q, text in ((4, rows[5][1]), (1, "state state hook state"), (None, "hook")) for p, s, _ in gold(DOCS, text)}
    assert got == pytest.approx(want, abs=1e-9)
    assert search.search_batch(index, queries.limit(0)).collect() == []


def test_sanitized_column_is_the_function(spark):
    cases = ["react hooks", "useState()", 'say "hello" world', "", "   ", "()", "(a) b: *c*", "'x' \"y", "a b c", "don't (stop)", "\t*\n:", "é:é", '""', "a\"b"]
    df = spark.createDataFrame([(c,) for c in cases] + [(None,)], "q string").select("q", search.sanitized_column("q").alias("s"), search.phrases_column("q").alias("p"))
    assert {r.q: (r.s, r.p) for r in df.collect()} == {c: (search.sanitized(c), search.phrases(c)) for c in cases} | {None: ("", [])}


def test_batch_sends_only_the_best(spark, chunks, monkeypatch, tmp_path):
    """Pairs of query and chunk stay in their task but for its best; what comes out is as from a saved index, phrases and ties too."""
    many = chunks.crossJoin(spark.range(40).withColumnRenamed("id", "copy")).withColumns({"path": F.concat("path", F.col("copy").cast("string")), "body": F.concat("body", F.repeat(F.lit(" padding"), (F.col("copy") % 7).cast("int")))}).drop("copy").repartition(2)
    index, sent, settled = search.build(many), [], search.settled
    queries = spark.createDataFrame([(i, q) for i, q in enumerate(QUERIES)] * 2 + [(50 + i, "state effects theme") for i in range(20)] + [(None, "rendered")], "query_id int, query string")

    def spied(df, name):
        out = settled(df, name)
        if name == "scores":
            sent.append(out.count())
        return out

    monkeypatch.setattr(search, "settled", spied)
    key = lambda i: sorted((repr(r.query_id), r.path, round(r.score, 9), r["rank"]) for r in search.search_batch(i, queries, limit=3).collect())
    got = key(index)
    pairs = search.scored(index, {i: search._plan(q, True) for i, q in enumerate(QUERIES)}, "int", "global").count()
    assert len(sent) == 1 and sent[0] < pairs
    search.save(index, f"file://{tmp_path}/index")
    assert got == key(search.load(spark, f"file://{tmp_path}/index"))


def test_tallies_in_small_slices(spark, chunks, monkeypatch):
    """Runs and counts of stems do not depend on how tokens are cut; a phrase does not go on in the next text."""
    from folioforge.operators import tallies

    index = search.build(chunks.unionByName(chunks.limit(1).withColumns({"body": F.lit(""), "title": F.lit(""), "path": F.lit("none"), "heading_path": F.array().cast("array<string>")})))
    batch = index.tokenised.toArrow().to_batches()
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(tallies, "SLICE", size)
        pieces = [p for b in batch for p in tallies._pieces(iter([b]))]
        assert sum(len(p.rows) for p in pieces) == index.chunks.count() and sum(len(p.term) for p in pieces) == index.postings.count()
    monkeypatch.undo()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(tallies.runs(index.tokenised).select("source", "term", F.inline("run")).select("source", "chunk_id", "dl", "col", "pos", "term")) == rows(index.postings.select("source", "chunk_id", "dl", "col", "pos", "term"))
    told = tallies.told(index.tokenised)
    assert rows(told.where("term is null").groupBy("source", "stem").agg(F.sum("df"))) == rows(search.stem_counts(index.pairs, index.vocabulary))
    assert rows(told.where("term is not null").select("term", "stem").distinct()) == rows(index.vocabulary)


def test_few_terms_become_rows(spark):
    """Of an index that is not saved only the tokens that a query asks for leave their arrays; terms that share a stem begin alike."""
    words = "valency valencies sensibility sensible hoping hope hopes hopped pony ponies of off offer to too towed that thatched relational digitizer agree agreed fly flies".split()
    for w in words:
        assert w.startswith(search._beginning(search.porter.stem(w)))
    assert [search._beginning(s) for s in ("of", "to", "hope", "poni", "sensibl")] == ["of", "to", "hop", "pon", "sensib"]
    docs = spark.createDataFrame([("s", f"u{i}", f"p{i}", "", " ".join(words[i:] + words[: i % 3]) + " \u00a0") for i in range(len(words))], "source string, url string, path string, title string, markdown string")
    chunks = search.tokenized(chunking.chunk(docs, min_body=1)).cache()
    index = search.build(chunks)
    rows = lambda df: sorted(map(tuple, df.select("source", "chunk_id", "dl", "col", "pos", "term").collect()))
    assert rows(search._some_postings(chunks, ["of", "hopes"])) == rows(search.postings(chunks).where(F.col("term").isin("of", "hopes")))
    units = [(0, 0, 1, "hope"), (1, 0, 1, "poni"), (2, 0, 2, "of"), (2, 1, 2, "off")]
    counted = lambda x: sorted(map(tuple, search.unit_counts(x, units).select("source", "chunk_id", "dl", "unit", "f").collect()))
    found = search.unit_counts(index, units)
    assert "tokens_" not in found._jdf.queryExecution().optimizedPlan().toString()  # the hits are written; no use reads all tokens again
    assert counted(index) == counted(search.replace(index, tokenised=None, terms=None)) != []
