import random

import pytest
from pyspark.sql import functions as F

from folioforge.operators import catalog, chunking, search, segments
from folioforge.plans import ingest
from folioforge.plans.base import corpus
from folioforge.sources.store import Store

from .test_queries import SF

QUERY = "alpha beta gamma"


def documents(spark, rows):
    return spark.createDataFrame([(s, f"u/{p}", p, "", t) for s, p, t in rows], "source string, url string, path string, title string, markdown string")


def chunks(spark, rows):
    return chunking.chunk(documents(spark, rows), min_body=1)


def found(index, **how):
    return [(h.source, h.path, h.body, round(h.score, 9), h.rank) for h in search.search(index, QUERY, with_snippet=False, **how).collect()]


def text(rng):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota".split()) for _ in range(rng.randint(5, 40)))


def same_as_rebuilt(spark, path, rows, hits=True):
    got, want = segments.load(spark, path), search.build(chunks(spark, rows))
    assert not hits or found(got) == found(want)
    key = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)
    assert key(got.stats) == key(want.stats) and key(got.lengths) == key(want.lengths) and key(got.postings) == key(want.postings)
    stems = got.stems.groupBy("source", "stem").agg(F.sum("df").alias("df")).where("df != 0")
    assert key(stems) == key(search.stem_counts(want.pairs, want.vocabulary))
    words = got.vocabulary.groupBy("term").count()
    assert words.where("count > 1").isEmpty() and want.vocabulary.join(words, "term", "left_anti").isEmpty()


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/index"


def test_updates_equal_a_rebuild(spark, path, monkeypatch):
    """Pages added, changed and removed, sources replaced and removed, in any order, merged now and then."""
    merge = 3
    monkeypatch.setattr(segments, "MERGE", merge)
    rng = random.Random(merge)
    live = {(f"s{i % 3}", f"p{i}"): text(rng) for i in range(30)}
    as_rows = lambda: [(*k, t) for k, t in live.items()]
    search.save(search.build(chunks(spark, as_rows())), path)
    for step in range(6):
        if step == 3:  # a source as a whole
            live = {k: t for k, t in live.items() if k[0] != "s1"} | {("s1", f"q{i}"): text(rng) for i in range(4)}
            search.save(search.build(chunks(spark, [(*k, t) for k, t in live.items() if k[0] == "s1"])), path)
        elif step == 4:
            live = {k: t for k, t in live.items() if k[0] != "s2"}
            segments.remove(spark, path, ["s2", "none"])
        else:
            changed = {k: text(rng) for k in rng.sample(sorted(live), 4)}
            gone = [k for k in rng.sample(sorted(live), 3) if k not in changed]
            new = {(f"s{step % 3}", f"n{step}-{i}"): text(rng) for i in range(2)} if step != 2 else {}
            live = {k: t for k, t in live.items() if k not in gone} | changed | new
            segments.update(search.build(chunks(spark, [(*k, t) for k, t in (changed | new).items()])), spark.createDataFrame([*changed, *gone], "source string, path string"), path)
        if step in (1, 3, 5):
            same_as_rebuilt(spark, path, as_rows(), hits=step == 3)
    state = segments.current(spark, path)
    assert len(state.segments) < merge + 1
    segments.merge(spark, path, whole=True)
    assert len(segments.current(spark, path).segments) == 1 and segments.current(spark, path).dead is None
    assert segments.vacuum(spark, path) and not segments.vacuum(spark, path)
    same_as_rebuilt(spark, path, as_rows())


def test_one_changed_page_writes_one_page(spark, path):
    rows = [("s", f"p{i}", f"alpha page {i}") for i in range(50)]
    search.save(search.build(chunks(spark, rows)), path)
    before = segments.current(spark, path)
    segments.update(search.build(chunks(spark, [("s", "p7", "alpha beta new")])), spark.createDataFrame([("s", "p7")], "source string, path string"), path)
    after = segments.current(spark, path)
    new = set(after.segments) - set(before.segments)
    assert [after.segments[s] for s in new] == [1] and set(before.segments) <= set(after.segments) and after.dead_chunks == 1
    assert segments._read(spark, path, after, "postings", list(new)).count() == 3


@pytest.mark.parametrize("how,table", [("save", "lengths"), ("save", "pointer"), ("update", "words"), ("merge", "stats")])
def test_a_failure_leaves_the_old_index_whole(spark, path, monkeypatch, table, how):
    rows = [("a", "p", "alpha beta"), ("b", "q", "gamma delta alpha")]
    search.save(search.build(chunks(spark, rows)), path)
    if how == "merge":
        rows.append(("c", "r", "beta"))
        search.save(search.build(chunks(spark, rows[2:])), path)
    write, commit = segments._write, segments._commit

    def broken(index, path, name, t):
        if t == table:
            raise OSError("disk")
        write(index, path, name, t)

    def no_pointer(*a):
        raise OSError("disk")

    monkeypatch.setattr(segments, "_write", broken)
    if table == "pointer":
        monkeypatch.setattr(segments, "_commit", no_pointer)
    new = search.build(chunks(spark, [("a", "p", "theta alpha"), ("d", "x", "alpha alpha")]))
    act = {"save": lambda: search.save(new, path), "update": lambda: segments.update(new, spark.createDataFrame([("a", "p")], "source string, path string"), path), "merge": lambda: segments.merge(spark, path, whole=True)}[how]
    with pytest.raises(OSError, match="disk"):
        act()
    monkeypatch.setattr(segments, "_write", write)
    monkeypatch.setattr(segments, "_commit", commit)
    same_as_rebuilt(spark, path, rows, hits=False)
    act()
    same_as_rebuilt(spark, path, rows if how == "merge" else [("a", "p", "theta alpha"), ("d", "x", "alpha alpha"), rows[1]], hits=False)


def test_readers_keep_their_generation_and_writers_do_not_overwrite(spark, path):
    search.save(search.build(chunks(spark, [("a", "p", "alpha")])), path)
    reader = segments.load(spark, path)
    old = segments.current(spark, path)
    search.save(search.build(chunks(spark, [("a", "p", "alpha beta")])), path)
    assert [h[2] for h in found(reader)] == ["alpha"] and [h[2] for h in found(segments.load(spark, path))] == ["alpha beta"]
    with pytest.raises(segments.Conflict):  # a writer that began before the other one was done
        segments._commit(spark, path, old)
    assert [h[2] for h in found(segments.load(spark, path))] == ["alpha beta"]


def test_empty(spark, path):
    assert found(segments.load(spark, path)) == []
    segments.remove(spark, path, ["a"])
    none = spark.createDataFrame([], "source string, path string")
    segments.update(search.build(chunks(spark, [("a", "p", "alpha")])), none, path)
    assert [h[1] for h in found(segments.load(spark, path))] == ["p"]
    segments.update(search.build(chunks(spark, [("a", "p", "alpha")]).limit(0)), spark.createDataFrame([("a", "p"), ("z", "z")], "source string, path string"), path)
    assert found(segments.load(spark, path)) == [] and segments.load(spark, path).stats.isEmpty()
    segments.update(search.build(chunks(spark, [("a", "p", "alpha")])), none, path)
    assert [h[1] for h in found(segments.load(spark, path))] == ["p"]


def test_ingest_takes_what_changed(spark, tmp_path):
    """A second run over the same sources indexes the changed page only; the index equals one that is built anew."""
    from datetime import datetime

    at = datetime(2024, 2, 3)
    pages = lambda rows: spark.createDataFrame([(s, f"u/{p}", p, "text/markdown", f"# {t}\\n\\n{t} is the text of this page, long enough not to be empty, alpha beta gamma and more of it.\\n", at) for s, p, t in rows], "source string, url string, path string, content_type string, body string, fetched_at timestamp")
    store = Store(spark, f"file://{tmp_path}/store")
    first = [("s", f"p{i}", f"page {i}") for i in range(12)] + [("t", "x", "other")]
    _, made = ingest.ingest(store, pages(first))
    assert made.count() == 13
    second = [(s, p, t + (" new" if p == "p3" else "")) for s, p, t in first if p != "p5"] + [("s", "p99", "late")]
    before = segments.current(spark, f"{store.root}/index")
    _, made = ingest.ingest(store, pages([r for r in second if r[0] == "s"]))
    after = segments.current(spark, f"{store.root}/index")
    assert made.count() == 12 and [after.segments[n] for n in set(after.segments) - set(before.segments)] == [2]
    docs = store.documents()
    assert {r.path for r in docs.where("source = 's'").collect()} == {p for s, p, _ in second if s == "s"}
    want = search.build(ingest.chunks_of(docs.withColumn("status", F.lit("ok"))))
    assert found(store.index()) == found(want) and found(store.index())


def test_documents_through_the_store(spark, tmp_path):
    """Over a given table: an older version is brought up to date by catalog.changes."""
    path = f"file://{tmp_path}/index"
    new = corpus(spark, SF)
    old = new.where("path not like 'de/%'").withColumn("markdown", F.when(F.col("path").startswith("fr/"), F.upper("markdown")).otherwise(F.col("markdown")))
    hashed = lambda d: d.select("source", "path", F.sha2("markdown", 256).alias("content_hash"))
    search.save(search.build(chunking.chunk(old)), path)
    changes = catalog.changes(hashed(old), hashed(new))
    segments.update(search.build(chunking.chunk(new.join(changes.where("change != 'removed'"), ["source", "path"], "left_semi"))), changes, path)
    a, b = (sorted((h.source, h.path, round(h.score, 9)) for h in search.search(i, "pathetic worthless (idiot)", with_snippet=False).collect()) for i in (segments.load(spark, path), search.build(chunking.chunk(new))))
    assert a == b and a


def test_a_save_takes_runs_and_sums(spark, path):
    """Neither a row for each token nor each chunk's terms are dealt: runs of postings and sums of stems are."""
    from dataclasses import replace

    rows = [("a", "p", "alpha beta alpha betas"), ("b", "q", "gamma delta alpha"), ("a", "r", "beta")]
    search.save(replace(search.build(chunks(spark, rows)), postings=None, pairs=None, vocabulary=None, terms=None), path)
    same_as_rebuilt(spark, path, rows, hits=False)


def test_a_save_deals_no_postings_and_keeps_nothing_beside_it(spark, path, monkeypatch, tmp_path):
    """Postings of few sources stay in the task that makes them, in sorted regions; tokens and sums on the way are deleted.
    With more sources than WRITERS they are dealt as before, to the same rows."""
    import os

    from folioforge.operators import tallies
    from folioforge.sources.shared import shared_dir

    rng = random.Random(5)
    rows = [(f"s{i % 3}", f"p{i}", text(rng) if i else "— " * 20) for i in range(40)]
    there = lambda: set(os.listdir(shared_dir(spark).removeprefix("file://")))
    before, frame = there(), type(spark.range(0))
    with monkeypatch.context() as m:
        m.setattr(tallies, "REGION", 50)
        m.setattr(frame, "repartitionByRange", None)
        search.save(search.build(chunks(spark, rows).coalesce(1)), path)
    assert there() == before
    same_as_rebuilt(spark, path, rows, hits=False)
    for source in ("s0", "s1", "s2"):
        seen = segments.load(spark, path).postings.where(F.col("source") == source).coalesce(1).collect()
        falls = sum(a.term > b.term for a, b in zip(seen, seen[1:], strict=False))
        assert 0 < falls < len(seen) / 10  # a region is sorted, not the file
    monkeypatch.setattr(segments, "WRITERS", 2)
    search.save(search.build(chunks(spark, rows)), f"{path}-dealt")
    same_as_rebuilt(spark, f"{path}-dealt", rows, hits=False)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_reindex_replace_keeps_no_tokens(spark):
    """Two saves and a removal leave the index and what is dead in it."""
    import os

    from folioforge.plans.corpus_queries import reindex_replace
    from folioforge.sources.shared import shared_dir

    root = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(root))
    counts = {r.source: r.chunks for r in reindex_replace(spark, SF).collect()}
    made = {x for d in set(os.listdir(root)) - before if "-index-" not in d for x in os.listdir(f"{root}/{d}")}
    assert made <= {"dead", "kept"} and "src2" not in counts and counts["src1"] > 0
