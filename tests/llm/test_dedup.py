import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folioforge.llm import components, itq, simhash, suffix_dedup

from .conftest import SF


def naive_spans(texts, window=200):
    count = Counter(t[s : s + window] for t in texts for s in range(len(t) - window + 1))
    for t in texts:
        hit = np.zeros(len(t) + 1, np.int64)
        for s in range(len(t) - window + 1):
            if count[t[s : s + window]] > 1:
                hit[s] = max(hit[s], 1)
        cover, end = np.zeros(len(t), bool), 0
        for s in np.flatnonzero(hit).tolist():
            cover[max(s, end) : s + window] = True
            end = s + window
        edges = np.flatnonzero(np.diff(np.r_[False, cover, False].astype(int)))
        yield [(a, b) for a, b in edges.reshape(-1, 2).tolist()], bytes(c for c, x in zip(t, cover, strict=True) if not x)


def as_rows(found):
    return sorted((str(r.id), r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in found.collect())


@pytest.mark.parametrize("window,anchor", [(200, 50), (64, 20)])
def test_repeated_spans_edge_rows(edge, edge_rows, window, anchor):
    texts = [(r[1] or "").encode() for r in edge_rows]
    want = sorted((str(r[0]), len(t), tuple(map(tuple, s)), k) for r, t, (s, k) in zip(edge_rows, texts, naive_spans(texts, window), strict=True))
    assert as_rows(suffix_dedup.repeated_spans(edge, window=window, anchor=anchor)) == want


def test_repeated_spans_small_alphabet(spark):
    """Periodic and highly repetitive texts: many ties of the minimizer."""
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab"), n)) for n in (40, 90, 200, 300)] + ["ab" * 100, "ab" * 60 + "c" + "ab" * 60, "a" * 150]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    raw = [t.encode() for t in texts]
    want = sorted((str(i), len(t), tuple(map(tuple, s)), k) for i, (t, (s, k)) in enumerate(zip(raw, naive_spans(raw, 16), strict=True)))
    assert as_rows(suffix_dedup.repeated_spans(docs, window=16, anchor=8)) == want


def test_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 1000)
    rng = np.random.default_rng(4)
    a = "".join(rng.choice(list("abcdefgh "), 5000))
    texts = [a, "x" * 37 + a[1200:3300] + "y" * 90]
    x = suffix_dedup.runs([t.encode() for t in texts], 200, 50)
    assert x["nw"].sum() == sum(len(t) - 199 for t in texts)
    starts = {(t, s) for t, lo, nw in zip(x["text"], x["lo"], x["nw"], strict=True) for s in range(lo, lo + nw)}
    assert len(starts) == x["nw"].sum()


def test_repeated_spans_empty(empty):
    assert suffix_dedup.repeated_spans(empty).count() == 0


def test_op1_digest(spark):
    rows = {r.doc_id: r for r in suffix_dedup.op1_suffix_dedup(spark, SF).collect()}
    docs = sorted((r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    for (i, t), (spans, kept) in zip(docs, naive_spans([t for _, t in docs]), strict=True):
        assert (rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) == (len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())


def naive_fingerprint(text: str) -> int:
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\n", " ").replace("\t", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_edge_rows(edge, edge_rows):
    fps = [naive_fingerprint(r[1] or "") for r in edge_rows]
    roots = union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = {}
    for r, k in zip(edge_rows, roots, strict=True):
        if r[0] is not None:
            least[k] = min(least.get(k, 1 << 60), r[0])
    want = sorted((str(r[0]), f, str(least.get(k))) for r, f, k in zip(edge_rows, fps, roots, strict=True))
    got = sorted((str(r.id), r.fp & (1 << 64) - 1, str(r.component_id)) for r in simhash.near_duplicates(edge).collect())
    assert got == want


def test_simhash_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("group", [2048, 4])
def test_links_connect_all_within_three_bits(spark, monkeypatch, group):
    """Random clusters of near fingerprints, with groups filed once, and twice when they are over the limit."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = np.random.default_rng(7)
    fps = set()
    for _ in range(40):
        base = int(rng.integers(0, 2**63))
        for _ in range(int(rng.integers(1, 12))):
            base ^= sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False))
            fps.add(base)
    fps = sorted(fps)
    want = union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    at = {f: i for i, f in enumerate(signed)}
    assert all((fps[at[r.a]] ^ fps[at[r.b]]).bit_count() <= 64 for r in found)
    assert union(len(fps), [(at[r.a], at[r.b]) for r in found]) == want


def test_ring_never_drops_a_near_pair():
    rng = np.random.default_rng(8)
    x = np.array([sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 4)), replace=False)) for _ in range(3000)], dtype=np.uint64)
    assert simhash._ring(x, 3).all()
    far = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    assert not simhash._ring(far, 3)[np.bitwise_count(far) > 20].any()


def test_dense_group_lookup(monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 8)
    fps = np.arange(256, dtype=np.uint64) << np.uint64(5)
    a, b = simhash.forest(fps)
    assert len(a) == 255 and set(b.tolist()) == {0}


def test_components(spark):
    rng = np.random.default_rng(9)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)] + [(500, 500)]
    roots = union(501, [p for p in pairs if p[0] != p[1]])
    got = {r.node: r.root for r in components.components(spark.createDataFrame([*pairs, (None, 1)], "a long, b long")).collect()}
    assert got == {i: roots[i] for p in pairs if p[0] != p[1] for i in p}


def test_itq_edge_rows(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(6, 16))
    near = [(base[i % 6] + rng.normal(size=16) * 0.05).tolist() for i in range(60)]
    rows = [(i, v, i % 2) for i, v in enumerate(near)]
    rows += [(100, near[0], 0), (100, near[0], 0), (101, near[0], None), (102, None, 0), (103, [0.0] * 16, 0), (104, [float("nan")] + near[0][1:], 0), (105, [None] + near[0][1:], 0), (106, [float("inf")] + near[0][1:], 0), (107, [], 0), (None, near[0], 0), (108, [1.0, 2.0], 0), (109, [2.0, 4.1], 0), (110, [1e300] * 16, 1), (111, [1e-300] * 16, 1)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<double>, label int, cls string, n_links int")
    got = sorted((str(r.id), r.n_links, str(r.component_id), r.kept) for r in itq.near_duplicates(df).collect())
    ok = [i for i, (k, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in ok}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    pairs = [(i, j) for i in ok for j in ok if j < i and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93]
    links = Counter(i for p in pairs for i in p)
    roots = union(len(rows), pairs)
    least = {}
    for i in ok:
        if rows[i][0] is not None:  # a null id links and never names
            least[roots[i]] = min(least.get(roots[i], 1 << 60), rows[i][0])
    want = sorted((str(r[0]), links[i], str(least[roots[i]] if i in unit else r[0]), r[0] is not None and (i not in unit or least[roots[i]] == r[0])) for i, r in enumerate(rows))
    assert got == want


def test_itq_recall_and_blocks(spark, monkeypatch):
    """All pairs at or above 0.93 against brute force, with groups cut into blocks; none below."""
    monkeypatch.setattr(itq, "GROUP", 16)
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = sorted(v.collect(), key=lambda r: r.vec_id)
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r.label for r in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    got = {r.id: r.n_links for r in itq.near_duplicates(v).collect()}
    found = np.array([got[r.vec_id] for r in rows])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.9 * near.sum()


def planted(mean, n=1500, d=64, pairs=300):
    """Vectors that share a direction, and pairs at 0.931 to 0.95 among them."""
    rng = np.random.default_rng(13)
    x = rng.normal(size=(n, d)) / d**0.5
    x[:, 0] += mean / (1 - mean * mean) ** 0.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i, c in enumerate(np.linspace(0.931, 0.95, pairs)):
        way = rng.normal(size=d)
        way -= (way @ x[2 * i]) * x[2 * i]
        x[2 * i + 1] = c * x[2 * i] + (1 - c * c) ** 0.5 * way / np.linalg.norm(way)
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    return x, near.sum(1)


@pytest.mark.parametrize("mean,group,least", [(0.45, 16, 0.98), (0.71, 16, 0.97), (0.83, 1024, 1.0)])
def test_itq_recall_about_a_mean(spark, monkeypatch, mean, group, least):
    """As many tables as pairs at the least cosine need; in a label of few blocks all pairs are compared."""
    monkeypatch.setattr(itq, "GROUP", group)
    x, near = planted(mean)
    got = {r.id: r.n_links for r in itq.near_duplicates(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= near).all() and found.sum() >= least * near.sum()


@pytest.mark.parametrize("mean", [0.45, 0.71])
def test_itq_links_do_not_depend_on_size(spark, monkeypatch, mean):
    """A pair links in a label of many blocks as it does alone: all links of brute force, though the tables miss some."""
    monkeypatch.setattr(itq, "GROUP", 16)
    monkeypatch.setattr(itq, "RECALL", 0.5)
    learn, fitted = itq.learn_tables, []
    monkeypatch.setattr(itq, "learn_tables", lambda *how: fitted.append(learn(*how)) or fitted[-1])
    x, near = planted(mean)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(10_000 + i, v.tolist(), 1 + i // 2) for i, v in enumerate(x[:600])]
    got = {r.id: (r.n_links, r.component_id) for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), tables=2).collect()}
    assert fitted[0] is not None
    assert [got[i][0] for i in range(len(x))] == near.tolist()
    assert all(got[10_000 + i] == (1, 10_000 + i - i % 2) for i in range(600))  # each pair in a label of its own


def test_itq_width_of_large_labels(spark, monkeypatch):
    """A label of more blocks than buckets gets longer codes, and more tables find its pairs."""
    assert [itq.width_of(n, 4) for n in (1, 16, 17, 94, 128, 129)] == [4, 4, 5, 7, 7, 8]
    assert itq.width_of(4096) == itq.WIDTH and itq.width_of(10**6) == 20
    monkeypatch.setattr(itq, "GROUP", 16)
    widths, learn = [], itq.learn_tables
    monkeypatch.setattr(itq, "learn_tables", lambda x, least, tables, width, most: widths.append(width) or learn(x, least, tables, width, most))
    x, near = planted(0.45)
    v = spark.createDataFrame([(i, y.tolist(), 0) for i, y in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.id: r.n_links for r in itq.near_duplicates(v, width=4).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert widths == [7] and (found <= near).all() and found.sum() >= 0.97 * near.sum()


def test_itq_stray_dimension(spark, monkeypatch):
    """A longer vector changes nothing for the others, and two dimensions have rotations of their own."""
    monkeypatch.setattr(itq, "GROUP", 16)
    x, near = planted(0.45)
    y, near_y = planted(0.45, n=900, d=32, pairs=200)
    fitted, learn = [], itq.learn_tables
    monkeypatch.setattr(itq, "learn_tables", lambda x, *how: fitted.append(x.shape) or learn(x, *how))

    def links(rows):
        df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
        got = {r.id: r.n_links for r in itq.near_duplicates(df).collect()}
        return np.array([got[i] for i in range(len(rows))])

    alone, mixed = links(list(x)), links([*x, *y, np.ones(80)])
    assert (mixed[: len(x)] == alone).all() and mixed[-1] == 0
    assert alone.sum() >= 0.98 * near.sum() and mixed[len(x) : -1].sum() >= 0.97 * near_y.sum()
    assert fitted == [(1500, 64), (900, 32), (1500, 64)]


def test_itq_empty(spark):
    assert itq.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_rotation_balances_bits():
    x = np.random.default_rng(1).normal(size=(2000, 16)) * np.linspace(3, 0.2, 16)
    mean, d = itq.learn_rotations(x, 16)
    assert np.allclose(d.T @ d, np.eye(16), atol=1e-8)
    assert (abs(((x - mean) @ d >= 0).mean(0) - 0.5) < 0.05).all()


def test_queries_have_one_row_each(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    out = simhash.op8_simhash(spark, SF)
    assert out.count() == n and out.where(~F.col("fingerprint").rlike("^[0-9a-f]{16}$")).isEmpty()
    assert itq.op9_embeddings(spark, SF).count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()


def test_op9_against_sql(spark):
    import duckdb

    from ..conftest import same_rows

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    same_rows(itq.op9_embeddings(spark, SF).toPandas(), con.sql(itq.ORACLE).df())


def test_op9_sql_with_repeated_and_null_ids(spark):
    import duckdb

    rng = np.random.default_rng(2)
    a = rng.normal(size=8)
    rows = [(1, a, 0), (1, a, 0), (None, a * 2, 0), (2, a + 0.01, 0), (3, -a, 0), (None, -a, 0), (4, a, 1), (5, a, None), (None, rng.normal(size=8), 2), (None, None, 2)]
    rows = [(i, None if v is None else [float(x) for x in v], lab) for i, v, lab in rows]
    got = itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[], label INT)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, con.sql(itq.ORACLE).fetchall()))


def _plain_fingerprint(text, words=3):
    found = [w for w in re.split(rb"[\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text)) if w]
    shingles = [b" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or ([b" ".join(found)] if found else [])
    bits = [sum(xxhash.xxh64_intdigest(s, seed=42) >> i & 1 for s in shingles) for i in range(64)]
    return sum(1 << i for i in range(64) if 2 * bits[i] > len(shingles))


@pytest.mark.parametrize("piece", [1, 5, 64, 10_000])
def test_fingerprints_in_pieces(piece):
    rng = np.random.default_rng(piece)
    texts = [b"", b"  \n", b"One", b"one two", b"a b c", b" a\tb\x0bC d ", b"x" * 300, b"x" * 300 + b" y " + b"Z" * 99, "Привет мир é".encode() * 20, *(bytes(rng.choice(list(b"abC \n\t"), 400).tolist()) for _ in range(20))]
    for t in texts:
        for words in (1, 3, 5):
            assert simhash.fingerprint(t, words, piece) == _plain_fingerprint(t, words)


def test_memory_of_a_long_text():
    """A text of 24 MB takes a few times its size, not 25 times."""
    import tracemalloc

    text = b"several words of a text " * 1_000_000
    tracemalloc.start()
    simhash.fingerprint(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * len(text)
