"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target of words; each of its documents is due the same number of
copies, target / size, as a whole part and a fraction. Rounding takes two documents
with open fractions and moves words from one to the other, in the direction and
amount that chance picks so that expectations stay, until one of them is whole. The
words of both together do not change, so a source ends within one document of its
target. This runs inside buckets of a source first; each bucket leaves at most one
open document, and those meet in a reduction tree of fan-in ``FAN``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import id_type, n_words, row_hashes, settled, table

#: Documents of a bucket, about, and buckets that meet in a node of the tree.
BUCKET, FAN = 4_000, 64
WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, size)`` -> with ``target``.

    Sources in order of code points, null last, weigh ``weights`` in turn and share ``share`` of all words; a target
    stops at ``most`` times its source's size, and what is over is shared again until none is above. Sources are few
    (one task orders them); a round sends three numbers to the driver.
    """
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    ranked = settled(sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))).withColumn("limit", F.col("size") * F.lit(float(most))), "sources")
    total = (ranked.agg(F.sum("size")).first()[0] or 0) * share
    rate = 0.0
    while True:  # the rate only rises, and with it the set of sources at their limit
        capped = F.col("limit") <= F.lit(rate) * F.col("weight")
        held, weight = ranked.agg(F.sum(F.when(capped, F.col("limit")).otherwise(0.0)), F.sum(F.when(capped, 0).otherwise(F.col("weight")))).first()
        if not weight:
            break
        new = max(0.0, total - held) / weight
        if new <= rate:
            break
        rate = new
    return ranked.withColumn("target", F.when(F.lit(weight or 0) == 0, F.col("limit")).otherwise(F.least(F.col("limit"), F.lit(rate) * F.col("weight"))))


def pivot(size: np.ndarray, mass: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Masses between 0 and size, all but at most one moved to an end; their sum and expectations stay."""
    mass, open_, m = mass.copy(), -1, mass.tolist()
    draw = iter(rng.random(len(m)).tolist())
    s = size.tolist()
    for i in range(len(m)):
        if m[i] <= 0 or m[i] >= s[i]:
            continue
        if open_ < 0:
            open_ = i
            continue
        j = open_
        up, down = min(s[i] - m[i], m[j]), min(m[i], s[j] - m[j])  # from j to i, from i to j
        if next(draw) * (up + down) < down:
            i_full, j_empty = s[i] - m[i] <= m[j], m[j] <= s[i] - m[i]
            m[i], m[j] = (float(s[i]) if i_full else m[i] + up), (0.0 if j_empty else m[j] - up)
        else:
            i_empty, j_full = m[i] <= s[j] - m[j], s[j] - m[j] <= m[i]
            m[i], m[j] = (0.0 if i_empty else m[i] - down), (float(s[j]) if j_full else m[j] + down)
        open_ = i if 0 < m[i] < s[i] else j if 0 < m[j] < s[j] else -1
    return np.array(m)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 5) -> DataFrame:
    """``(id, source, row, row2, size, source_size, target, copies)``, one row for each row of ``docs``.

    row and row2 are hashes of all columns, 128 bits together. A null source is a source; null and empty texts have size 0 and no copy. Order and
    chance come from the rows' contents, so reruns agree; of repeated rows any may get the copies.
    """
    kind = id_type(docs, id_col)
    first, second = row_hashes(*(docs[c] for c in docs.columns))
    base = settled(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), first.alias("row"), second.alias("row2"), n_words(docs[text_col]).alias("size")), "sizes")
    sizes = base.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    goals = targets(sizes, weights, share, most).select(F.col("source").alias("source_"), F.col("size").alias("source_size"), "target", F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET)).cast("long").alias("parts"))
    due = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    rows = (
        base.join(goals, base.source.eqNullSafe(F.col("source_")))
        .withColumn("whole", F.floor(due).cast("long"))
        .withColumn("mass", (due - F.floor(due)) * F.col("size"))
        .withColumn("part", F.pmod("row", "parts"))
        .select("id", "source", "row", "row2", "size", "source_size", "target", "whole", "mass", "part")
    )
    schema = f"id {kind}, source string, row long, row2 long, size long, source_size long, target double, whole long, mass double, part long"

    def level(depth: int, last: bool):
        def run(key, group):
            group = group.sort_by([("row", "ascending"), ("row2", "ascending")])
            rng = np.random.default_rng([seed, depth, zlib.crc32(repr(key[0].as_py()).encode()), key[1].as_py()])
            size, mass = group["size"].to_numpy().astype(float), group["mass"].to_numpy()
            mass = pivot(size, mass, rng)
            if last:  # one open document a source: chance decides
                left = np.flatnonzero((mass > 0) & (mass < size))
                mass[left] = np.where(rng.random(len(left)) * size[left] < mass[left], size[left], 0)
            return group.set_column(group.schema.get_field_index("mass"), "mass", pa.array(mass)).set_column(group.schema.get_field_index("part"), "part", pa.array(np.full(len(mass), key[1].as_py(), np.int64)))

        return run

    whole = (F.col("mass") <= 0) | (F.col("mass") >= F.col("size"))
    most_parts = goals.agg(F.max("parts")).first()[0] or 1
    depth, done, state = 0, [], rows
    while True:
        last = most_parts == 1
        state = settled(state.groupBy("source", "part").applyInArrow(level(depth, last), schema), f"level{depth}")
        done.append(state if last else state.where(whole))
        if last:
            break
        state = state.where(~whole).withColumn("part", F.floor(F.col("part") / FAN).cast("long"))
        most_parts, depth = -(-most_parts // FAN), depth + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("id", "source", "row", "row2", "size", "source_size", "target", (F.col("whole") + F.when((F.col("size") > 0) & (F.col("mass") >= F.col("size")), 1).otherwise(0)).cast("long").alias("copies"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    key = ["row_a_", "row_b_"]
    counts = mix(docs, **how).groupBy(F.col("row").alias(key[0]), F.col("row2").alias(key[1])).agg(F.sum("copies").alias("copies_")).where("copies_ > 0")
    rows = docs.withColumns(dict(zip(key, row_hashes(*(docs[c] for c in docs.columns)), strict=True))).dropDuplicates(key)
    return rows.join(counts, key).withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("copies_").cast("int")))).select(docs.columns)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document: one row for each row of documents. A null source is a source, the last;
    null and empty texts have size 0 and nothing taken."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")
