"""Embedding near-duplicates by iterative quantisation.

Rotations are learned on a bounded sample of each dimension so that signs of the
rotated vectors make balanced codes. Codes are filed in multi-index tables, under a
substring of ``WIDTH`` bits, more in a large label, and the label; vectors that meet in a bucket are
compared by their original components, in double precision. The sample also says how
many tables find ``RECALL`` of the pairs that only just link. An exact check follows: the
last bucket of a label holds all its vectors, so links are those of brute force whatever
the size. Vectors of a label that are no more blocks of ``GROUP`` than tables have that
bucket only. A pair counts in the
first table where it meets only, so counts need no list of pairs: a bucket gives
each vector's number of links and a spanning star of its links.

Equal vectors are one class from the start. A bucket of over ``GROUP`` classes, in the
check of over ``WHOLE`` times as many, is cut into blocks, and each pair of blocks is a
group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import settled, table
from .components import components

#: Most vectors that the rotations are learned on (the first by a hash), and steps of the learning.
FIT_ROWS, STEPS = 20_000, 30
#: Least number of substring tables, and least bits of each. At the least cosine that links, 0.93, an eighth of the bits differ
#: about the origin, more about a mean that is far from it: tables are added until pairs at that cosine meet.
TABLES, WIDTH = 10, 12
#: Share of pairs at the least cosine that must meet in a table, and pairs that it is measured on.
RECALL, TRIALS = 0.99, 4000
GROUP, WHOLE = 1024, 8


def learn_rotations(x: np.ndarray, bits: int, seed: int = 9, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, directions d x bits) from unit vectors: principal axes, then rotations that bring them nearest to signs.

    More bits than dimensions take several rotations, each from its own random start.
    """
    d = x.shape[1]
    mean = x.mean(0) if len(x) else np.zeros(d)
    z = x - mean
    rng, out = np.random.default_rng(seed), []
    cov = z.T @ z if len(z) else np.eye(d)
    axes = np.linalg.eigh(cov)[1][:, ::-1]
    while sum(o.shape[1] for o in out) < bits:
        k = min(d, bits - sum(o.shape[1] for o in out))
        top = axes[:, :k] if not out else axes[:, rng.permutation(d)[:k]]
        v = z @ top
        r = np.linalg.qr(rng.normal(size=(k, k)))[0]
        for _ in range(steps if len(z) else 0):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        out.append(top @ r)
    return mean, np.concatenate(out, axis=1)


def codes(x: np.ndarray, mean: np.ndarray, directions: np.ndarray, tables: int, width: int) -> np.ndarray:
    """The substrings of each vector's code, one column for each table."""
    bits = ((x - mean) @ directions >= 0).reshape(len(x), tables, width)
    return (bits * (1 << np.arange(width))).sum(2).astype(np.int32)


def partners(x: np.ndarray, least: float, seed: int = 93) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors at cosine ``least``: from vectors of the sample into any direction, and towards others of it."""
    rng = np.random.default_rng(seed)
    at = rng.integers(0, len(x), TRIALS)
    out = []
    for way in (rng.normal(size=(TRIALS, x.shape[1])), x[rng.integers(0, len(x), TRIALS)] - x[at]):
        way = way - (way * x[at]).sum(1, keepdims=True) * x[at]
        size = np.linalg.norm(way, axis=1)
        ok = size > 1e-6
        out.append((x[at[ok]], least * x[at[ok]] + (1 - least * least) ** 0.5 * way[ok] / size[ok, None]))
    return out


def width_of(blocks: int, width: int = WIDTH) -> int:
    """Bits of a substring, at least ``width``, so that a group of ``blocks`` blocks has no fewer buckets than blocks."""
    return max(width, (blocks - 1).bit_length())


def learn_tables(x: np.ndarray, least: float, tables: int, width: int, most: int) -> tuple[np.ndarray, np.ndarray, int] | None:
    """(mean, directions, number of tables) that find RECALL of the pairs at cosine ``least``; none if over ``most`` are needed."""
    pairs = partners(x, least)
    while tables <= most:
        mean, directions = learn_rotations(x, tables * width)
        met = [(codes(a, mean, directions, tables, width) == codes(b, mean, directions, tables, width)).any(1) for a, b in pairs]
        if all(m.mean() >= RECALL for m in met if len(m)):
            return mean, directions, tables
        tables += max(2, tables // 4)
    return None


def compared(x: np.ndarray, code: np.ndarray, t: int, weight: np.ndarray, least: float, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of unit vectors ``left`` x ``right`` (all pairs inside one set if right is empty): (number of links of each,
    weighted by the partner's copies; root of each in the links found)."""
    n = len(x)
    links, root = np.zeros(n, np.int64), np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    inside = not len(right)
    other = left if inside else right
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        near = x[rows] @ x[other].T >= least
        if inside:
            near &= np.arange(len(other))[None, :] > np.arange(at, at + len(rows))[:, None]
        i, j = np.nonzero(near)
        a, b = rows[i], other[j]
        if t and len(a):  # a pair that met in an earlier table counted there
            new = ~(code[a, :t] == code[b, :t]).any(1)
            a, b = a[new], b[new]
        links += np.bincount(a, weights=weight[b], minlength=n).astype(np.int64) + np.bincount(b, weights=weight[a], minlength=n).astype(np.int64)
        # each row's partners join its class; the first of a row stands for the row
        for r in np.unique(a).tolist():
            top = find(r)
            for q in np.unique(np.array([find(p) for p in b[a == r].tolist()])).tolist():
                if q != top:
                    root[max(q, top)] = min(q, top)
                    top = min(q, top)
    return links, np.array([find(i) for i in range(n)])


def classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows ``(id, cls)``, with a null cls for vectors that link with nothing; classes ``(cls, label,
    vec, least, copies)`` of equal vectors under one label."""
    v = F.col(vector_col).cast("array<double>")
    finite = ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda c: c != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("vec"), F.coalesce(usable, F.lit(False)).alias("usable"))
    rows = rows.withColumn("cls", F.when(F.col("usable"), F.xxhash64("label", "vec")))
    own = rows.where("usable").groupBy("cls", "label", "vec").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    return rows.select("id", "cls"), own


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, tables: int = TABLES, width: int = WIDTH) -> DataFrame:
    """``(id, n_links, component_id, kept)``, one row for each row of ``vectors``, with all links of brute force.

    Vectors link under equal, non-null labels and dimensions, from cosine ``least`` on. A null label, a null, empty or
    zero vector and one with a null or non-finite component links with nothing: 0 links, its own component. Rows that
    repeat, even with their id, link as rows of their own, and so do those with a null id, which never name a component
    and are never kept; one of null ids only has a null component_id.
    """
    rows, own = classes(vectors, id_col, vector_col, label_col)
    rows, own = settled(rows, "rows"), settled(own, "classes")
    # groups of a label and a dimension, by blocks; those of more blocks than tables go to tables
    groups = settled(own.groupBy(F.col("label").alias("label_"), F.size("vec").alias("d_")).agg(F.ceil(F.count("*") / GROUP).cast("int").alias("blocks_")), "groups")
    fits = {}
    for r in groups.groupBy("d_").agg(F.max("blocks_").alias("most")).where(F.col("most") > tables).orderBy("d_").collect():
        sample = own.where(F.size("vec") == r.d_).orderBy(F.xxhash64("cls"), "cls").limit(FIT_ROWS).select("vec").toArrow()
        x = np.array(sample["vec"].to_pylist(), dtype=np.float64).reshape(-1, r.d_)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        bits = width_of(r.most, width)
        found = learn_tables(x[np.lexsort(x.T[::-1])], least, tables, bits, r.most - 1)
        if found:
            fits[r.d_] = (*found, bits)
    split = F.lit(False)
    for d, (_, _, n, _) in fits.items():
        split = split | ((F.col("d_") == d) & (F.col("blocks_") > n))
    large = groups.where(split).select("label_", "d_", F.lit(True).alias("large"))

    def unit(flat: np.ndarray, d: int) -> np.ndarray:
        y = flat.reshape(-1, d).astype(np.float64)
        y = y / np.abs(y).max(1, keepdims=True)  # squares stay finite
        return y / np.linalg.norm(y, axis=1, keepdims=True)

    def coded(y: np.ndarray) -> np.ndarray:
        mean, directions, n, bits = fits[y.shape[1]]
        return codes(y, mean, directions, n, bits)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column(2).offsets.to_numpy())
            flat = np.split(batch.column(2).flatten().to_numpy(), np.cumsum(size)[:-1])
            split = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            for d, apart in sorted(set(zip(size.tolist(), split.tolist(), strict=True))):
                at = np.flatnonzero((size == d) & (split == apart))
                # all of a group in one bucket, as if in a last table
                code = np.full((len(at), 1), -1, np.int32)
                if apart:
                    code = np.concatenate([coded(unit(np.concatenate([flat[i] for i in at]), d)), code], axis=1)
                n = code.shape[1]
                take = pa.array(np.repeat(at, n))
                yield pa.record_batch(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(np.tile(np.arange(n, dtype=np.int32), len(at))), pa.array(np.full(len(at) * n, d, np.int32)), pa.array(code.ravel())],
                    names=["cls", "label", "t", "d", "sub"],
                )

    kind = own.schema["label"].dataType.simpleString()
    # keys travel without vectors; only those that share a bucket get theirs
    dealt = own.join(F.broadcast(large), (F.col("label") == F.col("label_")) & (F.size("vec") == F.col("d_")), "left").select("cls", "label", "vec", F.coalesce("large", F.lit(False)).alias("large"))
    filed = dealt.mapInArrow(file, f"cls long, label {kind}, t int, d int, sub int").select("cls", "t", F.xxhash64("label", "t", "d", "sub").alias("key"), F.when(F.col("sub") < 0, GROUP * WHOLE).otherwise(GROUP).alias("most"))
    sizes = filed.groupBy("key").agg(F.count("*").alias("n"), F.max("most").alias("most_")).where("n > 1").select(F.col("key").alias("key_"), F.ceil(F.col("n") / F.col("most_")).cast("int").alias("blocks"))
    sizes = settled(sizes, "sizes")  # written, so that the join can be split
    met = filed.join(sizes, F.col("key") == F.col("key_")).withColumn("blk", F.pmod(F.xxhash64("cls", F.lit(1)), "blocks").cast("int"))
    # blocks i <= j make group i * blocks + j; a block goes to each group it is part of
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(F.col("blk"), o.cast("int")) * F.col("blocks") + F.greatest(F.col("blk"), o.cast("int")))
    met = met.withColumn("pair", F.explode(pairs)).select("key", "pair", F.when(F.expr("pair div blocks = pair % blocks"), 0).otherwise(F.expr("if(blk = pair div blocks, 1, 2)")).alias("side"), "t", "cls")
    met = met.join(own.select(F.col("cls").alias("of_"), "copies", "vec"), F.col("cls") == F.col("of_")).drop("of_")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups come in order and whole, at most 2 * GROUP * WHOLE rows or so each; only one is held."""
        held: list[pa.RecordBatch] = []

        def groups(done: bool) -> Iterator[pa.Table]:
            nonlocal held
            whole = pa.Table.from_batches(held)
            key, pair = whole["key"].to_numpy(), whole["pair"].to_numpy()
            cut = np.r_[0, np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1, len(key)]
            last = len(cut) - 1 if done else len(cut) - 2
            held = whole.slice(cut[last]).to_batches()
            sizes = np.diff(cut)
            for i in range(last):
                if sizes[i] > 1:
                    yield whole.slice(cut[i], sizes[i])

        def measured(g: pa.Table) -> pa.RecordBatch | None:
            x = unit(g["vec"].combine_chunks().flatten().to_numpy(), len(g["vec"][0]))
            t = g["t"][0].as_py()
            code = coded(x) if t else np.zeros((len(x), 0), np.int32)
            side, cls, weight = g["side"].to_numpy(), g["cls"].to_numpy(), g["copies"].to_numpy()
            left, right = (np.arange(len(x)), np.zeros(0, np.int64)) if not side.any() else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
            if side.any() and not (len(left) and len(right)):
                return None
            links, root = compared(x, code, t, weight, least, left, right)
            hit = np.flatnonzero(links)
            return pa.record_batch([pa.array(cls[hit]), pa.array(links[hit]), pa.array(cls[root[hit]])], names=["cls", "links", "root"]) if len(hit) else None

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 4096:
                for g in groups(False):
                    if out := measured(g):
                        yield out
        if held:
            for g in groups(True):
                if out := measured(g):
                    yield out

    found = settled(met.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(rerank, "cls long, links long, root long"), "links")
    counts = found.groupBy(F.col("cls").alias("c1")).agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    named = own.select("cls", "least", "copies").join(counts, F.col("cls") == F.col("c1"), "left").join(roots, F.col("cls") == F.col("node"), "left").select("cls", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "cls").alias("root"))
    top = named.groupBy(F.col("root").alias("r1")).agg(F.min("least").alias("component_id"))
    per = named.join(top, F.col("root") == F.col("r1")).select(F.col("cls").alias("of"), "n_links", "component_id")
    out = rows.join(per, F.col("cls") == F.col("of"), "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def op9_embeddings(spark, sf_dir: str) -> DataFrame:
    """Links and component of each vector."""
    out = near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component_id").cast("long").alias("component_id"), "kept")


#: The same by brute force, for a small table; rows are told apart by number, as ids may repeat or be null.
ORACLE = """
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pair AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT r AS node, r AS root FROM v UNION SELECT pair.b, reach.root FROM reach JOIN pair ON pair.a = reach.node),
comp AS (SELECT node, min(vec_id) AS component_id FROM reach JOIN v ON v.r = reach.root GROUP BY node),
link AS (SELECT a, count(*) AS n FROM pair GROUP BY a)
SELECT v.vec_id, coalesce(link.n, 0)::BIGINT AS n_links, component_id::BIGINT AS component_id, coalesce(v.vec_id = component_id, false) AS kept
FROM v JOIN comp ON comp.node = v.r LEFT JOIN link ON link.a = v.r
"""
