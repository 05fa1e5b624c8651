"""Centroid clustering in whole numbers, screened in single precision.

A matrix product in float32 gives each vector's distances to all centroids within
proven bounds; a centroid whose least possible distance is over the largest possible
one of another is out. Where one centroid is left it is the nearest. Where intervals
overlap, those centroids' distances are computed again in whole numbers, and the
lowest number wins a tie. Centroids (a fixed number of a fixed size) travel with the
tasks; each task adds up its vectors by cluster, and only those sums are shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import give_back, id_type, in_tasks, settled, table

#: Centroids, rounds, components of a vector, what a component is multiplied by, what goes before an id in its hash.
K, ROUNDS, DIM, SCALE, SEED = 40, 5, 64, 256, "2"
#: Whole numbers up to this size: distances in 64 bits are exact. Larger ones are computed with Python's integers.
SAFE = 1 << 27
#: Pairs of vectors and centroids whose distances are computed at once, and bits of a part of a sum.
PAIRS, LIMB = 1 << 14, 40


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), of 64 bits where all are within SAFE, else Python's integers."""
    if not len(x) or np.abs(x).max() < SAFE // scale:
        return np.floor(x * scale).astype(np.int64)
    return np.array([[int(v) * scale if abs(v) >= 2.0**53 else math.floor(v * scale) for v in row] for row in x.tolist()], object).reshape(x.shape)


def shortlist(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which centroids can be a vector's nearest, (vectors, centroids).

    With u = 2**-24, a number goes to float32 with a relative error of u at most, and a product of n terms summed in any
    order is off by n u / (1 - n u) times the sum of the terms' sizes at most, which is no more than the product of both
    lengths. Lengths are rounded up, and what float64 adds by its own rounding is in the interval too.
    """
    u, n = 2.0**-24, q.shape[1]
    relative = (1 + u) ** 2 * (1 + n * u / (1 - n * u)) - 1
    squares = (c * c).sum(1).astype(np.float64)
    of_q, of_c = np.sqrt((q.astype(np.float64) ** 2).sum(1)) * (1 + 1e-12), np.sqrt(squares) * (1 + 1e-12)
    product = (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    middle = squares - 2 * product  # the vector's own square is left out: it is the same for all centroids
    reach = 2.001 * relative * of_q[:, None] * of_c + 2.0**-49 * (squares + 2 * np.abs(product))
    return middle - reach <= (middle + reach).min(1, keepdims=True)


def nearest(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, the lowest of a tie; squared distance), both exact."""
    if q.dtype == object or c.dtype == object:
        return _nearest_large(q, c)
    can = shortlist(q, c)
    cluster = can.argmax(1)
    open_ = np.flatnonzero(can.sum(1) > 1)
    step = max(1, PAIRS // len(c))
    for low in range(0, len(open_), step):
        rows = open_[low : low + step]
        at, number = np.nonzero(can[rows])
        distance = np.full((len(rows), len(c)), np.iinfo(np.int64).max)
        distance[at, number] = ((q[rows[at]] - c[number]) ** 2).sum(1)
        cluster[rows] = distance.argmin(1)  # the first of equal ones
    return cluster, ((q - c[cluster]) ** 2).sum(1)


def _nearest_large(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best, distance = np.zeros(len(q), np.int64), np.empty(len(q), object)
    for i, row in enumerate(q.astype(object)):
        all_ = ((c.astype(object) - row) ** 2).sum(1).tolist()
        distance[i] = min(all_)
        best[i] = all_.index(distance[i])
    return best, distance


def _vectors(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, vectors) of the rows whose vector counts: ``dim`` components, none null or not finite."""
    for batch in batches:
        fits = pc.equal(batch.column(1).value_lengths(), dim).fill_null(False)
        ids, lists = batch.column(0).filter(fits), batch.column(1).filter(fits)
        if not len(ids):
            continue
        x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # a null is not a number
        good = np.isfinite(x).all(1)
        yield ids.filter(pa.array(good)), x[good]


def _apart(x: np.ndarray, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, whole numbers) of the vectors: those of ordinary size together, then the others."""
    large = np.abs(x).max(1, initial=0) >= SAFE // scale
    for at in (np.flatnonzero(~large), np.flatnonzero(large)):
        if len(at):
            yield at, whole(x[at], scale)


def _centroids(rows: list[list[int]]) -> np.ndarray:
    return np.array(rows, object if any(abs(v) > SAFE for r in rows for v in r) else np.int64)


def first_centroids(vectors: DataFrame, id_col: str, vector_col: str, k: int, dim: int, scale: int, seed: str) -> list[list[int]]:
    """The ``k`` vectors with the least sha256 of seed:id, a null id as no text; among equal ids the lesser vector first."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _vectors(batches, dim):
            yield pa.record_batch([ids, pa.ListArray.from_arrays(np.arange(0, x.size + 1, dim, dtype=np.int32), x.ravel())], names=["id", "x"])
        give_back()

    found = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x")).mapInArrow(kept, f"id {id_type(vectors, id_col)}, x array<double>")
    least = found.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256).alias("h"), "x").orderBy("h", "x").limit(k)
    return whole(np.array([r.x for r in least.collect()], np.float64).reshape(-1, dim), scale).tolist()


def sums(vectors: DataFrame, centroids: list[list[int]], dim: int = DIM, scale: int = SCALE) -> dict[tuple[int, int], int]:
    """(cluster, component) -> exact sum over the cluster, with component -1 for the number of its vectors.

    ``vectors`` has two columns, id and vector. Each task sends a row for each cluster, component and LIMB bits of the
    sum, so sums of any size are exact; the driver gets no more than clusters times components times parts.
    """
    c = _centroids(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(c), dim + 1), object)
        for _, x in _vectors(batches, dim):
            for _, q in _apart(x, scale):
                cluster, _ = nearest(q, c)
                order = np.argsort(cluster, kind="stable")
                head = np.flatnonzero(np.diff(cluster[order], prepend=-1))
                total[cluster[order[head]], :dim] += np.add.reduceat(q[order], head, axis=0).astype(object)
                total[:, dim] += np.bincount(cluster, minlength=len(c)).astype(object)
        rows = []
        for number, component in zip(*np.nonzero(total), strict=True):
            v, limb = int(total[number, component]), 0
            while v:
                part = abs(v) % (1 << LIMB) * (1 if v > 0 else -1)
                rows.append((int(number), int(component) if component < dim else -1, limb, part))
                v, limb = (v - part) >> LIMB, limb + 1
        if rows:
            yield pa.record_batch([pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["cluster", "component", "limb", "part"])
        give_back()

    parts = vectors.mapInArrow(run, "cluster int, component int, limb int, part long").groupBy("cluster", "component", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"))
    out: dict[tuple[int, int], int] = {}
    for r in parts.collect():
        out[r.cluster, r.component] = out.get((r.cluster, r.component), 0) + (int(r.part) << (LIMB * r.limb))
    return out


def fitted(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED) -> list[list[int]]:
    """Centroids in whole numbers after ``rounds`` rounds; fewer than ``k`` where there are fewer vectors."""
    vectors = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    centroids = first_centroids(vectors, "id", "x", k, dim, scale, seed)
    for _ in range(rounds if centroids else 0):
        total = sums(vectors, centroids, dim, scale)
        for number, centroid in enumerate(centroids):
            n = total.get((number, -1), 0)
            if n:
                centroids[number] = [total.get((number, i), 0) // n for i in range(len(centroid))]
    return centroids


def assigned(vectors: DataFrame, centroids: list[list[int]], id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """``(id, cluster, distance)``, one row for each vector that counts; a distance that 64 bits do not hold is null."""
    c = _centroids(centroids) if centroids else np.zeros((0, dim), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _vectors(batches, dim):
            if not len(c):
                continue
            cluster, distance = np.zeros(len(x), np.int32), np.zeros(len(x), object)
            for at, q in _apart(x, scale):
                cluster[at], distance[at] = nearest(q, c)
            yield pa.record_batch([ids, pa.array(cluster), pa.array([d if d < 1 << 63 else None for d in distance.tolist()], pa.int64())], names=["id", "cluster", "distance"])
        give_back()

    read = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    return read.mapInArrow(run, f"id {id_type(vectors, id_col)}, cluster int, distance long")


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """``(id, cluster, distance, cluster_inertia, inertia, centroid_sha256)``, one row for each row whose vector counts.

    Rows with a null vector, another number of components or one that is null or not finite are left out. A null id is
    kept, as are repeated rows, each with its own row; equal vectors get one cluster. An empty table gives no rows. Sums
    that 64 bits do not hold, and those over a distance that they do not hold, are null.
    """
    spark, kind = vectors.sparkSession, id_type(vectors, id_col)
    vectors = in_tasks(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("x")))
    centroids = fitted(vectors, "id", "x", k, rounds, dim, scale, seed)
    found = settled(assigned(vectors, centroids, "id", "x", dim, scale), "assigned")
    # as many rows as clusters
    of = {r.cluster: None if r.unknown else int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count_if(F.col("distance").isNull()).alias("unknown")).collect()}
    known = lambda v: v if v is not None and v < 1 << 63 else None
    all_ = known(None if None in of.values() else sum(of.values()))
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    about = spark.createDataFrame([(number, known(total), all_, shas[number]) for number, total in of.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select(F.col("id").cast(kind), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    """All of ``embeddings`` in 40 clusters after 5 rounds. One row for each vector of 64 finite components; null, short,
    long and not finite ones are left out, repeated rows and null ids stay, ties go to the lower number."""
    return clustered(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def _round(r: int) -> str:
    return f"""
d{r} AS (SELECT rid, number, CAST(sum((e.x - c.x) * (e.x - c.x)) AS BIGINT) AS d FROM e JOIN c{r} c USING (pos) GROUP BY rid, number),
n{r} AS MATERIALIZED (SELECT rid, number, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, number) = 1),
m{r} AS (SELECT number, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM n{r} JOIN e USING (rid) GROUP BY number, pos),
c{r + 1} AS MATERIALIZED (SELECT number, pos, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{r} LEFT JOIN m{r} USING (number, pos)),"""


#: For tables of ordinary numbers.
ORACLE = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}
),
e AS MATERIALIZED (SELECT rid, unnest(v) AS x, unnest(range({DIM})) AS pos FROM kept),
first AS (SELECT rid, row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS number FROM kept QUALIFY number < {K}),
c0 AS MATERIALIZED (SELECT number, pos, x FROM first JOIN e USING (rid)),{"".join(_round(r) for r in range(ROUNDS))}
last AS (SELECT rid, number, CAST(sum((e.x - c.x) * (e.x - c.x)) AS BIGINT) AS d FROM e JOIN c{ROUNDS} c USING (pos) GROUP BY rid, number QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, number) = 1),
shas AS (SELECT number, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY number)
SELECT vec_id, CAST(number AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY number) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM kept JOIN last USING (rid) JOIN shas USING (number)
"""
