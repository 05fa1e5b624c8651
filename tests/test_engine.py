import importlib
import sys
from datetime import datetime

import pytest

from folioforge.operators import catalog
from folioforge.plans.engine import Engine, ReadOnly
from folioforge.streaming import ingest as stream

from .test_sources import WEB, TableFetcher

NOW = datetime(2024, 2, 3)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return tmp_path_factory.mktemp("corpus")


@pytest.fixture(scope="module")
def engine(spark, root):
    folder = root / "docs"
    folder.mkdir()
    (folder / "a.md").write_text("# Intro\n\nWelcome to the intro of everything.\n\n## Advanced topics\n\nadvanced usage of the engine is described here.\n")
    (folder / "b.md").write_text("# B\n\nSome other body with plenty of words.\n")
    (folder / "c.txt").write_text("tiny")
    e = Engine(spark, f"file://{root}/store", fetcher=TableFetcher(WEB), clock=lambda: NOW)
    e.add_source(str(folder), name="docs")
    e.add_source("https://s.x/docs")
    e.add_source("https://none.x/llms.txt")
    e.results = {r.source: r for r in e.refresh_source()}
    return e


def test_run_results(engine):
    r = engine.results
    assert (r["docs"].pages, r["docs"].chunks, r["docs"].skipped) == (2, 3, 1) and r["s.x"].pages == 2 and not r["s.x"].errors
    assert r["none.x"].errors and r["none.x"].pages == 0


def test_search_and_page(engine):
    hits = engine.search_docs("advanced").collect()
    assert [(h.source, h.path, h.heading_path, h.stale) for h in hits] == [("docs", "a", ["Advanced topics"], False)]
    assert "[advanced]" in hits[0].snippet and engine.search_docs("advanced", as_of=datetime(2024, 3, 1)).first().stale
    assert engine.search_docs("content", sources=["s.x", "none"]).count() == 2
    text = engine.get_page("docs", "a")
    assert text.startswith('---\ntitle: "Intro"\n') and text.endswith("described here.\n") and engine.get_page("docs", "none") is None


def test_page_by_address_and_hits_by_kind(engine):
    url = engine.store.documents().where("source = 's.x' AND path = 'docs/a'").first().url
    assert engine.get_page("s.x", url=url) == engine.get_page("s.x", "docs/a") is not None and engine.get_page("s.x", url="https://none.x/") is None
    for wrong in ({}, {"path": "a", "url": url}):
        with pytest.raises(ValueError):
            engine.get_page("s.x", **wrong)
    assert {h.source for h in engine.search_docs("content OR advanced", kind="website").collect()} == {"s.x"}
    assert {h.source for h in engine.search_docs("content OR advanced", kind="local").collect()} == {"docs"} and engine.search_docs("content", kind="github").count() == 0


def test_listing_and_outline(engine):
    assert [(r.name, r.page_count, r.stale) for r in engine.list_sources().collect()] == [("docs", 2, False), ("none.x", 0, False), ("s.x", 2, False)]
    assert [(r.path, r.anchor, r.ord) for r in engine.get_outline(["docs"]).collect()] == [("a", "", 0), ("a", "advanced-topics", 1), ("b", "", 0)]
    assert [r.path for r in engine.store.paths("docs").collect()] == ["a", "b"]
    assert engine.refresh_due(datetime(2024, 2, 4)) and engine.reindex() == 5


def test_names(engine):
    for bad in ("what is this", "..", "s.x"):
        with pytest.raises(catalog.CatalogError):
            engine.add_source("https://s.x/docs" if bad == "s.x" else bad, name=".." if bad == ".." else None, kind="local" if bad == ".." else None)
    with pytest.raises(catalog.CatalogError):
        engine.refresh_source(["unknown"])


def test_read_only(spark, root):
    e = Engine(spark, f"file://{root}/store", read_only=True)
    assert e.tools == ["search_docs", "get_page", "list_sources", "get_outline"] and len(Engine(spark, "x").tools) == 7
    for f in (lambda: e.add_source("o/r"), e.refresh_source, lambda: e.remove_source("docs"), e.reindex, e.compact):
        with pytest.raises(ReadOnly):
            f()
    assert e.list_sources(NOW).count() == 3


def test_export(engine, root):
    engine.store.export(engine.store.documents(), f"file://{root}/pages")
    assert (root / "pages/docs/a.md").read_text() == engine.get_page("docs", "a") and (root / "pages/s.x/docs/b.md").exists()


def test_changed_source_is_replaced(spark, engine, root):
    (root / "docs/b.md").unlink()
    (root / "docs/a.md").write_text("# Intro\n\nnothing of the former text is left in this file.\n")
    engine.refresh_source(["docs"])
    assert engine.search_docs("advanced").count() == 0 and [r.path for r in engine.store.paths("docs").collect()] == ["a"]
    assert engine.search_docs("content").count() == 2


def test_stream(spark, engine, root):
    page = lambda p, text, at: ("feed", f"https://f/{p}", p, "text/markdown", text, at)
    schema = stream.PAGES
    folder = f"file://{root}/incoming"
    spark.createDataFrame([page("a", "# A\n\nfirst version of the page, long enough", NOW), page("b", "# B\n\nanother page of the feed, long enough", NOW)], schema).write.parquet(folder)
    stream.start(engine.store, folder, f"file://{root}/ck").awaitTermination()
    spark.createDataFrame([page("a", "# A\n\nsecond version of the page, long enough", datetime(2024, 2, 4))], schema).write.mode("append").parquet(folder)
    stream.start(engine.store, folder, f"file://{root}/ck").awaitTermination()
    docs = {r.path: r.markdown for r in engine.store.documents().where("source = 'feed'").collect()}
    assert set(docs) == {"a", "b"} and "second" in docs["a"]
    html = "<html><head><title>Kept title</title></head><body><main><p>" + "a page whose title is not in its text, " * 5 + "</p></main></body></html>"
    spark.createDataFrame([("feed", "https://f/t", "t", "text/html", html, NOW)], schema).write.mode("append").parquet(folder)
    stream.start(engine.store, folder, f"file://{root}/ck").awaitTermination()
    before = {r.path: (r.title, r.markdown, r.fetched_at, r.content_hash) for r in engine.store.documents().where("source = 'feed'").collect()}
    spark.createDataFrame([page("b", "# B\n\na later page of the feed, long enough", datetime(2024, 2, 5))], schema).write.mode("append").parquet(folder)
    stream.start(engine.store, folder, f"file://{root}/ck").awaitTermination()
    after = {r.path: (r.title, r.markdown, r.fetched_at, r.content_hash) for r in engine.store.documents().where("source = 'feed'").collect()}
    assert after["t"] == before["t"] and after["t"][0] == "Kept title" and "later" in after["b"][1] and after["a"] == before["a"]
    q = stream.token_rates(stream.page_stream(spark, folder)).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("rates").groupBy().sum("pages").first()[0] == 5


def test_compact(engine):
    """Updates leave segments; one is left of them, and searches find the same."""
    from folioforge.operators import segments

    hits = lambda: [(h.source, h.path, round(h.score, 9)) for h in engine.search_docs("page advanced content").collect()]
    before, path = hits(), f"{engine.store.root}/index"
    assert len(segments.current(engine.store.spark, path).segments) > 1 and before
    assert engine.compact() > 0 and len(segments.current(engine.store.spark, path).segments) == 1 and hits() == before
    assert engine.compact() >= 0 and hits() == before


def test_remove(engine):
    engine.remove_source("docs", keep_pages=True)
    assert engine.store.documents().where("source = 'docs'").count() == 1 and engine.store.index().chunks.where("source = 'docs'").count() == 0
    engine.remove_source("s.x")
    assert engine.store.documents().where("source = 's.x'").count() == 0 and [r.name for r in engine.list_sources().collect()] == ["none.x"]
    with pytest.raises(catalog.CatalogError):
        engine.remove_source("s.x")


def test_entry_without_the_optional_part(monkeypatch):
    """The registry stands when the optional folders are not there."""
    import __spark_entry__ as entry

    full = set(entry.queries())
    monkeypatch.setattr(entry, "_has", lambda *names: False)
    rest = set(entry.queries())
    assert rest < full or rest == full
    assert "search_bm25" in rest and not any(n.startswith("op") and n[2].isdigit() for n in rest) and "pipeline" not in rest
    assert set(entry.oracle_sql()) <= rest and importlib.import_module("__spark_entry__") is sys.modules["__spark_entry__"]


def test_cookies_are_sent(spark, tmp_path, monkeypatch):
    """Cookies and headers of an entry reach each request, with the driver's environment in them."""
    monkeypatch.setenv("CORPUS_KEY", "k1")
    web = {"https://l.x/llms.txt": (200, "text/plain", "[One](/one.md)"), "https://l.x/one.md": (200, "text/markdown", "# One\n\nthe page is only for those who have the cookie")}

    class Asking(TableFetcher):
        def __call__(self, url, headers):
            if headers.get("Cookie") != "b=2; session=k1" or headers.get("X-Key") != "k1":
                raise ValueError(f"who are you? {headers}")
            return super().__call__(url, headers)

    e = Engine(spark, f"file://{tmp_path}/store", fetcher=Asking(web), clock=lambda: NOW)
    e.add_source("https://l.x/llms.txt", headers={"X-Key": "${CORPUS_KEY}"}, cookies={"session": "${CORPUS_KEY}", "b": "2"})
    assert [r.errors for r in e.refresh_source()] == [[]] and e.search_docs("cookie").count() == 1
    raw = (tmp_path / "store/catalog.json").read_text()
    assert "${CORPUS_KEY}" in raw and "k1" not in raw and not (tmp_path / "store/catalog.json.tmp").exists()


def test_render_option(spark, tmp_path):
    """Empty pages are fetched again by the browser, from the engine and from the command line."""
    from folioforge.__main__ import parser, run

    shell = "<html><body><main></main></body></html>"
    full = "<html><head><title>App</title></head><body><main><p>" + "javascript-rendered content of the page. " * 4 + "</p></main></body></html>"
    web = {"https://a.x/docs/": (200, "text/html", shell)}
    e = Engine(spark, f"file://{tmp_path}/store", fetcher=TableFetcher(web), browser=TableFetcher({"https://a.x/docs/": (200, "text/html", full)}), clock=lambda: NOW)
    said = []
    assert run(e, parser().parse_args(["add", "https://a.x/docs/", "--name", "app", "--header", "X-A=1", "--cookie", "c=2=3"]), said.append) == 0
    row = e.store.entries().first()
    assert row.headers == {"X-A": "1"} and row.cookies == {"c": "2=3"}
    assert run(e, parser().parse_args(["pull", "app"]), said.append) == 0 and "0 pages, 0 chunks, 1 skipped" in said[-1]
    assert run(e, parser().parse_args(["pull", "app", "--render"]), said.append) == 0 and "1 pages" in said[-1]
    assert e.search_docs("javascript-rendered").count() == 1
