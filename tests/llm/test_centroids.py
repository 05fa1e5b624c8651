import hashlib
import math

import duckdb
import numpy as np
import pytest

from folioforge.llm import centroids

from ..conftest import same_rows
from .conftest import SF


def naive(rows, k, rounds, dim):
    """Brute force in Python's integers."""
    kept = [(i, [math.floor(256 * v) if abs(v) < 2**40 else int(v) * 256 for v in x]) for i, x in rows if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [list(x) for _, x in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(c)) for _, x in kept]

    for _ in range(rounds):
        of = assign()
        for j in range(len(c)):
            mine = [x for (_, x), (_, n) in zip(kept, of, strict=True) if n == j]
            if mine:
                c[j] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
    of = assign()
    total = {j: sum(d for d, n in of if n == j) for j in range(len(c))}
    known = lambda v: v if v < 2**63 else None
    return sorted(
        (str(i), n, str(known(d)), str(known(total[n])), str(known(sum(total.values()))), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, of, strict=True)
    )


def rows_of(df):
    return sorted((str(r.id), r.cluster, str(r.distance), str(r.cluster_inertia), str(r.inertia), r.centroid_sha256) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(i, x, 1, "c", 2) for i, x in rows], "vec_id long, embedding array<double>, cluster int, x string, inertia int").repartition(3)


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(150)]
    rows += [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(150, 300)]  # ties
    rows += [(7, rows[7][1])] * 3 + [(None, rows[3][1]), (None, rows[4][1]), (900, None), (901, []), (902, [1.0] * 5), (903, [1.0] * 7), (904, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (905, [math.nan] * 6), (906, [math.inf] + [0.0] * 5)]
    got = centroids.clustered(table(spark, rows), k=9, rounds=4, dim=6)
    assert got.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert rows_of(got) == naive(rows, 9, 4, 6)


def test_equal_vectors_and_few(spark):
    same = [(i, [0.25, -0.5]) for i in range(50)]
    assert rows_of(centroids.clustered(table(spark, same), k=5, rounds=2, dim=2)) == naive(same, 5, 2, 2)
    few = [(1, [1.0, 2.0]), (2, [3.0, -4.0])]
    assert rows_of(centroids.clustered(table(spark, few), k=5, rounds=2, dim=2)) == naive(few, 5, 2, 2)
    assert centroids.clustered(table(spark, few), k=5, rounds=2, dim=3).collect() == []
    assert centroids.clustered(table(spark, few).limit(0), k=5, rounds=2, dim=2).collect() == []


@pytest.mark.parametrize("size", [1e6, 1e9, 1e300])
def test_large_numbers(spark, size):
    """Beyond 64 bits sums and distances stay exact inside and are null where they do not fit."""
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=3) * (size if i % 3 == 0 else 1)).tolist()) for i in range(40)]
    assert rows_of(centroids.clustered(table(spark, rows), k=4, rounds=3, dim=3)) == naive(rows, 4, 3, 3)


@pytest.mark.parametrize("spread", [1, 300, 100_000, (1 << 27) - 1])
def test_shortlist_keeps_the_nearest(spread):
    """Intervals hold the exact distances, whatever the size; few centroids are left where they are apart."""
    rng = np.random.default_rng(spread)
    q, c = rng.integers(-spread, spread + 1, (400, 64)), rng.integers(-spread, spread + 1, (40, 64))
    c[7], c[20] = c[3], q[5]
    q[11] = q[5]
    exact = ((q[:, None] - c[None]) ** 2).sum(2)
    can = centroids.shortlist(q, c)
    assert can[exact == exact.min(1, keepdims=True)].all()
    cluster, distance = centroids.nearest(q, c)
    assert (cluster == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    if spread > 1:
        assert can.sum(1).mean() < 1.5


def test_close_intervals():
    """Distances that differ by one, far from the origin: single precision can't tell them apart, whole numbers do."""
    base = np.full(64, 1 << 20)
    c = np.stack([base + np.eye(64, dtype=np.int64)[i] * (i % 3) for i in range(20)])
    q = np.stack([base, base + 1, c[13], c[17]])
    exact = ((q[:, None] - c[None]) ** 2).sum(2)
    assert centroids.shortlist(q, c).sum(1).min() > 1
    cluster, distance = centroids.nearest(q, c)
    assert (cluster == exact.argmin(1)).all() and (distance == exact.min(1)).all()


def test_query_and_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    same_rows(centroids.op12_centroids(spark, SF).toPandas(), con.sql(centroids.ORACLE).df())
