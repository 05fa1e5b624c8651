import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import link_audit, queries, refresh_index
from jobs.common import config

from .conftest import same_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in "documents pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    same_rows(queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLES[name]).df())


def files(spark, folder, name, rows):
    """A file of documents, as another program would put it there."""
    spark.createDataFrame(rows, refresh_index.DOCUMENTS).coalesce(1).write.parquet(f"file://{folder}/new-{name}")
    for i, part in enumerate(sorted((folder / f"new-{name}").glob("part-*.parquet"))):
        shutil.copy(part, folder / "in" / f"{name}-{i}.parquet")


def whole(spark, out):
    return sorted(map(tuple, refresh_index.output(spark, out).collect()), key=repr)


def naive(docs):
    """What the output is for the newest texts, {(source, path): text}."""
    import hashlib
    import re
    from collections import Counter

    out, df, tf = [], Counter(), Counter()
    for (source, path), text in docs.items():
        body = text.strip()
        if len(body.encode()) >= 24:
            out.append(("chunk", source, f"{path}#0", max(len(body.encode()) // 4, 1), len(body.encode()), hashlib.sha256(body.encode()).hexdigest()))
        words = re.findall(r"\w+", text.lower())
        tf.update((source, w) for w in words)
        df.update((source, w) for w in set(words))
    return sorted(out + [("term", s, w, n, tf[s, w], "") for (s, w), n in df.items()], key=repr)


LONG = "a text of more than two dozen letters"


def test_growing_input(spark, tmp_path):
    """Two runs take each file once; a changed text replaces its chunks and counts, one that is the same changes nothing."""
    (tmp_path / "in").mkdir()
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    files(spark, tmp_path, "a", [(1, f"{LONG} one one", "en", "s"), (2, LONG, "en", "s"), (3, None, "en", "s"), (None, f"{LONG} null", None, None), (5, f"{LONG} b", "en", "t"), (5, f"{LONG} a", "en", "t")])
    first = refresh_index.run(spark, source, out)
    assert sum(n["read"] for n in first) == 6 and sum(n["documents"] for n in first) == 5 and sum(n["changed"] for n in first) == 0
    docs = {("s", "en/1"): f"{LONG} one one", ("s", "en/2"): LONG, ("s", "en/3"): "", (None, "/"): f"{LONG} null", ("t", "en/5"): f"{LONG} b"}
    assert whole(spark, out) == naive(docs)
    assert refresh_index.run(spark, source, out) == [] and whole(spark, out) == naive(docs)

    files(spark, tmp_path, "b", [(1, f"{LONG} two", "en", "s"), (2, LONG, "en", "s"), (6, f"{LONG} six", "de", "t"), (None, "short", None, None)])
    second = refresh_index.run(spark, source, out)
    assert [(n["read"], n["documents"], n["changed"]) for n in second] == [(4, 3, 2)]
    docs |= {("s", "en/1"): f"{LONG} two", ("t", "de/6"): f"{LONG} six", (None, "/"): "short"}
    assert whole(spark, out) == naive(docs)

    files(spark, tmp_path, "c", [(1, f"{LONG} one one", "en", "s")])  # back to an earlier text
    refresh_index.run(spark, source, out)
    assert whole(spark, out) == naive(docs | {("s", "en/1"): f"{LONG} one one"})


def test_a_failed_batch_is_done_again(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    files(spark, tmp_path, "a", [(1, f"{LONG} one", "en", "s")])
    refresh_index.run(spark, source, out)
    files(spark, tmp_path, "b", [(1, f"{LONG} two", "en", "s"), (2, LONG, "en", "s")])
    write = refresh_index._write

    def broken(df, out, table, batch):
        if table == "terms":
            raise RuntimeError("the machine went away")
        write(df, out, table, batch)

    monkeypatch.setattr(refresh_index, "_write", broken)
    with pytest.raises(Exception, match="went away"):
        refresh_index.run(spark, source, out)
    monkeypatch.undo()
    assert [n["changed"] for n in refresh_index.run(spark, source, out)] == [1]
    assert whole(spark, out) == naive({("s", "en/1"): f"{LONG} two", ("s", "en/2"): LONG})


def test_small_batches_and_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    assert refresh_index.run(spark, source, out) == [] and whole(spark, out) == []
    for i in range(5):
        files(spark, tmp_path, f"f{i}", [(j, f"{LONG} {'abcde'[i]}", "en", "s") for j in range(i, i + 3)])
    assert len(refresh_index.run(spark, source, out, how={"files_a_batch": 2})) == 3
    chunks = refresh_index.chunks(spark, out)
    assert chunks.count() == 7 and chunks.groupBy("path").count().where("count > 1").isEmpty()
    assert {r.term: r.df for r in refresh_index.terms(spark, out).where(F.col("term").isin(*"bcde")).collect()} | {"text": 7} == {r.term: r.df for r in refresh_index.terms(spark, out).where(F.col("term").isin(*"bcde", "text")).collect()}


def test_config(spark, tmp_path):
    f = tmp_path / "c.json"
    f.write_text('{"max_tokens": 5}')
    assert config(spark, f"file://{f}", refresh_index.CONFIG) == refresh_index.CONFIG | {"max_tokens": 5}
    assert config(spark, "jobs/refresh_index.json", refresh_index.CONFIG) == refresh_index.CONFIG
    f.write_text('{"tokens": 5}')
    with pytest.raises(ValueError, match="tokens"):
        config(spark, f"file://{f}", refresh_index.CONFIG)


def test_link_audit(spark, tmp_path):
    """Repeats, orphans, hubs, missing addresses, nulls, repeated rows; a rerun and a smaller table replace the output."""
    a = lambda *to: "<p>" + "".join(f'<a href="{t}">x</a>' for t in to) + "</p>"
    rows = [
        (1, "https://a.x/", a("/one", "/one#part", "/two?x=1", "https://b.x/", "/gone", "/gone", "/logo.png", "#top", "mailto:a@b", "https://c.x/far")),
        (2, "https://a.x/one", a("/", "one", "/gone")), (3, "https://a.x/two?y", a("/one")), (4, "https://a.x/two", None), (5, "https://A.x/alone", a("alone")), (6, "https://b.x/", a("/")), (6, "https://b.x/", a("/")), (7, None, a("https://a.x/one")), (None, "https://b.x/z", ""),
    ]
    spark.createDataFrame([(*r, 1) for r in rows], link_audit.PAGES + ", bucket int").repartition(3).write.parquet(f"file://{tmp_path}/in")
    for _ in range(2):
        n = link_audit.run(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", {"buckets": 3})
        assert n == {"read": 9, "pages": 9, "missing": 1, "hosts": 3}
        pages = sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/out/pages").select("page_id", "url", "canonical_id", "n_internal", "n_external", "n_inbound", "state").collect()), key=repr)
        assert pages == sorted(
            [
                (1, "https://a.x/", 1, 4, 2, 1, "linked"), (2, "https://a.x/one", 2, 2, 0, 3, "linked"), (3, "https://a.x/two", 3, 1, 0, 1, "linked"), (4, "https://a.x/two", 3, 0, 0, 1, "repeat"), (5, "https://A.x/alone", 5, 0, 0, 0, "orphan"),
                (6, "https://b.x/", 6, 0, 0, 1, "linked"), (6, "https://b.x/", 6, 0, 0, 1, "linked"), (7, "", 7, 0, 1, 0, "orphan"), (None, "https://b.x/z", None, 0, 0, 0, "orphan"),
            ], key=repr)
        missing = spark.read.parquet(f"file://{tmp_path}/out/missing")
        assert [tuple(r) for r in missing.select("host", "url", "n_inbound").collect()] == [("a.x", "https://a.x/gone", 2)]
    spark.createDataFrame(rows[4:5], link_audit.PAGES).write.parquet(f"file://{tmp_path}/less")
    assert link_audit.run(spark, f"file://{tmp_path}/less", f"file://{tmp_path}/out") == {"read": 1, "pages": 1, "missing": 0, "hosts": 1}
    assert [r.kind for r in link_audit.output(spark, f"file://{tmp_path}/out").orderBy("kind").collect()] == ["host", "page"]
    spark.createDataFrame([], link_audit.PAGES).write.parquet(f"file://{tmp_path}/none")
    assert link_audit.run(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/out") == {"read": 0, "pages": 0, "missing": 0, "hosts": 0}


def test_link_audit_plan(spark):
    """No cross join and no broadcast that nobody sized; Python is not needed."""
    pages = spark.createDataFrame([(1, "https://a.x/", "<a href='/b'>")], link_audit.PAGES)
    plan = "".join(df._jdf.queryExecution().executedPlan().toString() for df in link_audit.audited(pages))
    assert "Cartesian" not in plan and "Python" not in plan and "NestedLoop" not in plan


def test_link_audit_config(spark):
    assert config(spark, "jobs/link_audit.json", link_audit.CONFIG) == link_audit.CONFIG


def test_texts_are_tokenised_once_for_both_counts(spark):
    docs = spark.createDataFrame([("a", "x y x"), ("a", "x"), (None, "é z"), ("b", ""), ("b", None)], "source string, markdown string")
    counts = refresh_index.term_counts(docs)
    assert sorted(map(str, (tuple(r) for r in counts.collect()))) == sorted(map(str, [("a", "x", 2, 3), ("a", "y", 1, 1), (None, "e", 1, 1), (None, "z", 1, 1)]))
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Generate") == 1
