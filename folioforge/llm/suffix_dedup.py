"""Removal of repeated byte windows by a depth-limited radix sort of suffixes.

A suffix only matters through its first ``window`` bytes, and two suffixes that
agree there are two copies of one window. Sorting is by most-significant-digit
passes, and each pass only looks deeper into suffixes whose digits so far occur
at least twice; a bucket of one is done.

Pass 1: every window is filed under its minimizer, the ``ANCHOR``-byte string of
least hash inside it (leftmost on ties), so equal windows meet under one anchor at
one offset. Consecutive windows with the same anchor form a run; the digit is the
anchor, and a run is one row instead of one row a byte.
Pass 2: runs left over are cut into blocks of ``BLOCK`` windows at fixed offsets
from the anchor; the digit is what all windows of a block share.
Pass 3: the windows of the blocks left over, one row each, by all their bytes.

Digits and contents are hashes; content is taken as equal where 128 bits agree: those
of a digit and of the content in passes 1 and 2, and of the whole window in pass 3.

In passes 1 and 2 whole content that occurs twice settles all windows in it at
once. Every pass counts by a partially aggregated groupBy and returns the count to
the rows by a join that adaptive execution can split; no bucket is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import by_batch, id_type, settled, table, text_bytes

ANCHOR = 50
BLOCK = 16
#: Bytes hashed at once; longer texts are cut into overlapping parts.
PART = 1 << 20
_BITS = 23
_ODD = 0x9E3779B97F4A7C15
_TAB = np.random.default_rng(1).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _pow(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if base not in _powers or len(_powers[base]) < n:
        out = np.full(max(n, PART + 1024), base, dtype=np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def _parts(texts: list[bytes], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of whole texts, or of an overlapping part of a long one: (bytes, ends, index of the text, offset in it)."""
    some, size = [], 0
    for i, text in enumerate(texts):
        if len(text) < window:
            continue
        for at in range(0, len(text) - window + 1, PART):
            piece = text[at : at + PART + window - 1] if at or len(text) > PART else text
            if size + len(piece) > PART and some:
                yield _joined(some)
                some, size = [], 0
            some.append((i, at, piece))
            size += len(piece)
    if some:
        yield _joined(some)


def _joined(some: list[tuple[int, int, bytes]]):
    sizes = np.array([len(x) for _, _, x in some])
    return np.frombuffer(b"".join(x for _, _, x in some), np.uint8), np.cumsum(sizes), np.array([i for i, _, _ in some]), np.array([a for _, a, _ in some])


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    w = 1
    while 2 * w <= width:
        v = np.minimum(v[:-w], v[w:])
        w *= 2
    return np.minimum(v[: len(v) - (width - w)], v[width - w :]) if w < width else v


def runs(texts: list[bytes], window: int, anchor: int) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: text (index), lo (first start), nw (windows), ao (anchor less lo), r (equal
    runs in a row), c (hash of the anchor), f (hash of all the run's bytes and ao)."""
    found: list[dict[str, np.ndarray]] = []
    for b, ends, of, base in _parts(texts, window):
        n = len(b)
        up, down = _pow(_ODD, n + 1), _pow(pow(_ODD, -1, 1 << 64), n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TAB[b] * up[:n], out=sums[1:])
        g = (sums[anchor:] - sums[:-anchor]) * down[: n - anchor + 1]
        g ^= g >> np.uint64(32)
        g *= np.uint64(0xD6E8FEB86659FD93)
        g ^= g >> np.uint64(32)
        mask = np.uint64((1 << _BITS) - 1)
        a = (_least((g & ~mask) | np.arange(len(g), dtype=np.uint64), window - anchor + 1) & mask).astype(np.int64)
        starts = np.r_[0, ends[:-1]]
        owner = np.repeat(np.arange(len(ends)), ends - starts)[: len(a)]
        s = np.flatnonzero(np.arange(len(a)) + window <= ends[owner])  # windows inside one text
        if not len(s):
            continue
        cut = np.flatnonzero((a[s[1:]] != a[s[:-1]]) | (s[1:] != s[:-1] + 1)) + 1
        lo, hi = s[np.r_[0, cut]], s[np.r_[cut - 1, len(s) - 1]]
        at, own = a[lo], owner[lo]
        f = (sums[hi + window] - sums[lo]) * down[lo]
        f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (at - lo).astype(np.uint64)
        c = g[at]
        # equal runs one after the other, as in periodic text, are one row
        same = np.r_[False, (c[1:] == c[:-1]) & (f[1:] == f[:-1]) & (lo[1:] == hi[:-1] + 1) & (own[1:] == own[:-1])]
        first = np.flatnonzero(~same)
        times = np.diff(np.r_[first, len(lo)])
        last = np.r_[first[1:], len(lo)] - 1
        own = own[first]
        found.append({"text": of[own], "lo": lo[first] - starts[own] + base[own], "nw": hi[last] - lo[first] + 1, "ao": (at - lo)[first], "r": times, "c": c[first].view(np.int64), "f": f[first].view(np.int64)})
    keys = ("text", "lo", "nw", "ao", "r", "c", "f")
    return {k: np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in keys}


def _run_rows(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        texts = text_bytes(batch.column(1))
        x = runs(texts, window, anchor)
        if not len(x["lo"]):
            return None
        digest = np.array([xxhash.xxh64_intdigest(t) for t in texts], dtype=np.uint64).view(np.int64)
        return pa.record_batch(
            [batch.column(0).take(pa.array(x["text"])), pa.array(digest[x["text"]]), pa.array(x["lo"]), *(pa.array(x[k].astype(np.int32)) for k in ("nw", "ao", "r")), pa.array(x["c"]), pa.array(x["f"])],
            names=["id", "th", "lo", "nw", "ao", "r", "c", "f"],
        )

    return docs.mapInArrow(by_batch(run), f"id {id_type(docs, 'id')}, th long, lo long, nw int, ao int, r int, c long, f long")


def _pass(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose digit c occurs twice or more, with ``ok``: their whole content f does too, and ``down``: the next
    pass has to look at it. That is all content met once, and one row of each other content it could share a part with.
    """
    # counts are written before they are joined: a join of two plain shuffles is one that adaptive execution can split
    stats = rows.groupBy("c").agg(F.sum("r").alias("n"), F.min("f").alias("f0"), F.max("f").alias("f1")).where("n > 1")
    stats = settled(stats.select("c", (F.col("f0") == F.col("f1")).alias("one")), f"{name}-met")
    met = settled(rows.join(stats, "c"), name)
    mixed = met.where(~F.col("one")).withColumn("row", F.xxhash64("id", "th", "lo"))
    each = settled(mixed.groupBy("c", "f").agg(F.sum("r").alias("n"), F.min("row").alias("least")), f"{name}-each")
    mixed = mixed.join(each, ["c", "f"]).withColumn("ok", F.col("n") > 1).withColumn("down", (F.col("n") == 1) | (F.col("row") == F.col("least")))
    same = met.where("one").withColumn("ok", F.lit(True)).withColumn("down", F.lit(False))
    return same.unionByName(mixed.select(same.columns))


def _packed(docs: DataFrame) -> DataFrame:
    """Texts compressed before they are shuffled: (id, th, z)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, z = text_bytes(batch.column(1)), zstandard.ZstdCompressor(level=1)
        return pa.record_batch([batch.column(0), pa.array(np.array([xxhash.xxh64_intdigest(t) for t in texts], dtype=np.uint64).view(np.int64)), pa.array([z.compress(t) for t in texts], pa.binary())], names=["id", "th", "z"])

    return docs.mapInArrow(by_batch(run), f"id {id_type(docs, 'id')}, th long, z binary")


def _on_text(packed: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Texts with what was gathered for them; the key is the id and a hash of the text, so that repeated ids do no harm."""
    lists = lists.select(F.col("id").alias("id_"), F.col("th").alias("th_"), "found")
    return packed.join(lists, packed.id.eqNullSafe(lists.id_) & (packed.th == lists.th_), how).select("id", "th", "z", "found")


def _unpack(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, list[dict]]]:
    z = zstandard.ZstdDecompressor()
    for i, (packed, found) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
        yield i, z.decompress(packed.as_py()), found.as_py() or []


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of half-open ranges as maximal runs; ranges that touch join."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(s[1:] > e[:-1]) + 1
    return list(zip(s[np.r_[0, cut]].tolist(), e[np.r_[cut - 1, len(e) - 1]].tolist(), strict=True))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, anchor: int = ANCHOR) -> DataFrame:
    """``(id, n_bytes, spans array<struct<start, end>>, kept binary)``, one row for each row of ``docs``.

    spans are the maximal byte runs covered by ``window``-byte strings that start
    at another place too, in any row, the same one included; kept is the rest. A
    null or empty text and one shorter than ``window`` have no spans; rows that
    repeat, even with their id, count as texts of their own.
    """
    if not 8 <= anchor <= window:
        raise ValueError("the anchor must fit in the window")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = id_type(docs, "id")

    first = _pass(_run_rows(docs, window, anchor), "runs")
    left = first.where("down").groupBy("id", "th").agg(F.collect_list(F.struct("lo", F.expr("int(nw div r)").alias("nw"), "ao")).alias("found"))

    def contents(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, lo, nw, ao, body = [], [], [], [], []
        for i, text, found in _unpack(batch):
            for x in found:
                at.append(i)
                lo.append(x["lo"])
                nw.append(x["nw"])
                ao.append(x["ao"])
                body.append(text[x["lo"] : x["lo"] + x["nw"] - 1 + window])
        at = pa.array(at, pa.int64())
        return pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(lo, pa.int64()), pa.array(nw, pa.int32()), pa.array(ao, pa.int32()), pa.array(body, pa.binary())], names=["id", "th", "lo", "nw", "ao", "body"])

    # rows that repeat share id and text: one copy of what is left is enough, the join below returns it to each
    packed = _packed(docs)
    inside = settled(_on_text(packed.dropDuplicates(["id", "th"]), left.withColumn("found", F.array_distinct("found")), "inner").mapInArrow(by_batch(contents), f"id {kind}, th long, lo long, nw int, ao int, body binary"), "contents")

    def blocks(batch: pa.RecordBatch) -> pa.RecordBatch:
        digest = xxhash.xxh64_intdigest
        rows = []
        for i, (lo, nw, ao, body) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)):
            s = 0
            while s < nw:
                d = ao - s  # from the window's start to the anchor
                b = d // BLOCK
                e = min(nw - 1, ao - b * BLOCK)
                core = body[max(0, ao - b * BLOCK) : ao - b * BLOCK - BLOCK + 1 + window]
                rows.append((i, lo, lo + s, e - s + 1, digest(core, b), digest(body[s : e + window], d)))
                s = e + 1
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        at = pa.array(cols[0], pa.int64())
        longs = [pa.array(np.array(c, dtype=np.uint64).view(np.int64)) for c in cols[4:]]
        return pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), *longs, pa.array(np.ones(len(at), np.int32))], names=["id", "th", "run", "lo", "nw", "c", "f", "r"])

    second = _pass(inside.mapInArrow(by_batch(blocks), f"id {kind}, th long, run long, lo long, nw int, c long, f long, r int"), "blocks")
    left2 = second.where("down").groupBy(F.col("id").alias("id_"), F.col("th").alias("th_"), F.col("run").alias("run_")).agg(F.collect_list(F.struct("lo", "nw")).alias("found"))
    deep = inside.join(left2, inside.id.eqNullSafe(F.col("id_")) & (inside.th == F.col("th_")) & (inside.lo == F.col("run_"))).select("id", "th", "lo", "body", "found")

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        digest = xxhash.xxh3_128_digest
        at, start, key = [], [], []
        for i, (lo, body, found) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(2, 5)), strict=True)):
            for x in found:
                for s in range(x["lo"] - lo, x["lo"] - lo + x["nw"]):
                    at.append(i)
                    start.append(lo + s)
                    key.append(digest(body[s : s + window]))
        at = pa.array(at, pa.int64())
        both = np.frombuffer(b"".join(key), np.int64).reshape(-1, 2)
        return pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(start, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["id", "th", "lo", "w", "w2"])

    single = settled(deep.mapInArrow(by_batch(windows), f"id {kind}, th long, lo long, w long, w2 long"), "single")
    equal = settled(single.groupBy("w", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w", "w2"), "windows")
    third = single.join(equal, ["w", "w2"]).select("id", "th", "lo", F.lit(1).alias("nw"))
    covered = first.where("ok").select("id", "th", "lo", "nw").unionByName(second.where("ok").select("id", "th", "lo", "nw")).unionByName(third)
    lists = covered.groupBy("id", "th").agg(F.collect_set(F.struct("lo", "nw")).alias("found"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, spans, kept = [], [], []
        for _, text, found in _unpack(batch):
            at = np.array([(x["lo"], x["lo"] + x["nw"] - 1 + window) for x in found], dtype=np.int64).reshape(-1, 2)
            gone = merged(at[:, 0], at[:, 1])
            edges = [0, *(e for span in gone for e in span), len(text)]
            size.append(len(text))
            spans.append([{"start": a, "end": b} for a, b in gone])
            kept.append(b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
        return pa.record_batch([batch.column(0), pa.array(size, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    return _on_text(packed, lists, "left").mapInArrow(by_batch(cut), f"id {kind}, n_bytes long, spans array<struct<start long, end long>>, kept binary")


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes of each document in 200-byte strings that start elsewhere too, and a digest of the rest."""
    out = repeated_spans(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
