"""SimHash near-duplicate detection with pigeonring filtering.

1. Each text gets a 64-bit fingerprint (majority of the bits of its shingles' XXH64).
2. Only distinct fingerprints are compared. They are cut into six ring segments.
   Of six segments at most three differ, so three are equal: each fingerprint
   is filed under the 20 triples of its segments (32 bits each).
3. Within a triple's group a pair must pass the ring: from some segment on, every
   chain of ``l`` consecutive segments differs in at most ``l * 3 / 6`` bits. Only
   pairs that pass meet the full Hamming check.
4. A group emits a spanning forest of its links, never all pairs. A group of over
   ``GROUP`` fingerprints is filed again, under triples of what is left of it; then
   48 bits are fixed, so no group can hold over 65,536 fingerprints.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import by_batch, id_type, settled, table, text_bytes
from .components import components

SEED = 42
#: Starts of the six segments, and their end.
CUTS = (0, 11, 22, 32, 43, 54, 64)
#: Groups up to this size are compared pair by pair; larger ones are filed again.
GROUP = 2048
#: Bytes of a text whose words are held at once.
PIECE = 1 << 22
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _shingle_bits(found: list[bytes], words: int) -> tuple[np.ndarray, int]:
    """(how often each bit is set in the hashes of the shingles of some words, number of shingles)."""
    counts, n = np.zeros(64, np.int64), max(len(found) - words + 1, 0)
    if not n:
        return counts, 0
    joined = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    starts, ends, digest = (end - size)[:n].tolist(), end[words - 1 :].tolist(), xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        part = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)], dtype=np.uint64)
        counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return counts, n


def fingerprint(text: bytes, words: int = 3, piece: int = PIECE) -> int:
    """The fingerprint of UTF-8 bytes, unsigned; 0 without a word. A text over ``piece`` bytes is read in pieces, cut at
    separators, that take the last words along."""
    counts, n, found, at = np.zeros(64, np.int64), 0, [], 0
    while at < len(text):
        gap = _GAP.search(text, at + piece) if len(text) - at > piece else None
        end = gap.start() if gap else len(text)
        found = found[-(words - 1) :] if words > 1 and n else found if not n else []
        found += text[at:end].lower().split()  # of bytes: A-Z only, and exactly the six separators
        more, k = _shingle_bits(found, words)
        counts, n, at = counts + more, n + k, max(end, at + 1)
    if not n and found:  # fewer words than a shingle has
        counts, n = _shingle_bits([b" ".join(found)], 1)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big") if n else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(id, fp)``, one row for each row of ``docs``; fp a signed long. A null or empty text has fp 0; a null id stays null."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(x, words) for x in text_bytes(batch.column(1))], dtype=np.uint64).view(np.int64)
        return pa.record_batch([batch.column(0), pa.array(fp)], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(by_batch(run), f"id {id_type(docs, id_col)}, fp long")


def _key(parts: list[tuple[int, int]], tag: int, also: list | None = None):
    """Bits [from, to) of fp, hashed with the number of the triple."""
    cut = [F.shiftrightunsigned("fp", a).bitwiseAND((1 << (b - a)) - 1) for a, b in parts]
    return F.xxhash64(F.lit(tag), *(also or []), *cut)


def _thirds(start: int, end: int) -> list[tuple[int, int]]:
    cut = np.linspace(start, end, 7).round().astype(int).tolist()
    return list(zip(cut, cut[1:], strict=False))


def filed(distinct: DataFrame) -> DataFrame:
    """``(key, fp)``: fingerprints under the triples of their segments, groups of two or more only."""
    ring = list(zip(CUTS, CUTS[1:], strict=False))
    keys = F.array(*[F.struct(F.lit(i).alias("t"), _key(list(c), i).alias("key")) for i, c in enumerate(combinations(ring, 3))])
    rows = distinct.select("fp", F.explode(keys).alias("k")).select("k.t", "k.key", "fp")
    sizes = settled(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")  # written, so that the join can be split
    rows = settled(rows.join(sizes, "key"), "filed")
    again = None
    for i, triple in enumerate(combinations(range(6), 3)):
        # the 32 bits that triple i leaves open, in six parts, of which three are equal again
        open_bits = [b for s in range(6) if s not in triple for b in range(CUTS[s], CUTS[s + 1])]
        parts = [open_bits[a:b] for a, b in _thirds(0, 32)]
        pick = [sum(1 << b for p in c for b in p) for c in combinations(parts, 3)]
        sub = F.array(*[F.xxhash64(F.lit(j), F.col("key"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long"))) for j, m in enumerate(pick)])
        again = F.when(F.col("t") == i, sub) if again is None else again.when(F.col("t") == i, sub)
    hot = rows.where(F.col("n") > GROUP).select(F.explode(again).alias("key"), "fp")
    return rows.where(F.col("n") <= GROUP).select("key", "fp").unionByName(hot)


def _ring(x: np.ndarray, most: int) -> np.ndarray:
    """Whether differences (XORs) pass: a chain from some segment stays within its share of ``most`` at every length."""
    seg = np.stack([np.bitwise_count((x >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)) for a, b in zip(CUTS, CUTS[1:], strict=False)])
    found = np.zeros(x.shape, bool)
    for start in range(6):
        run, ok = np.zeros(x.shape, np.uint8), np.ones(x.shape, bool)
        for length in range(1, 7):
            run = run + seg[(start + length - 1) % 6]
            ok &= 6 * run.astype(np.uint16) <= length * most
        found |= ok
    return found


def _near(x: np.ndarray, most: int) -> np.ndarray:
    """Indices of the XORs with at most ``most`` bits: the ring first, the full check for what passes."""
    passed = np.flatnonzero(_ring(x, most))
    return passed[np.bitwise_count(x[passed]) <= most]


def forest(fps: np.ndarray, most: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Links (each member to the least of its class) of distinct fingerprints in one group."""
    fps = np.unique(fps)
    n, root = len(fps), np.arange(len(fps))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def link(left: np.ndarray, right: np.ndarray) -> None:
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)

    if n <= GROUP:
        # breadth first: each fingerprint is compared once with those not reached yet
        rest = np.arange(n)
        while len(rest):
            head, rest, todo = rest[0], rest[1:], [rest[0]]
            while todo and len(rest):
                hit = _near(fps[rest] ^ fps[todo.pop()], most)
                if len(hit):
                    root[rest[hit]] = head
                    todo += rest[hit].tolist()
                    rest = np.delete(rest, hit)
    else:
        # dense: look up what differs in up to `most` of the bits in which the group differs at all
        varied = [b for b in range(64) if int(np.bitwise_or.reduce(fps ^ fps[0])) >> b & 1]
        for k in range(1, most + 1):
            for bits in combinations(varied, k):
                other = fps ^ np.uint64(sum(1 << b for b in bits))
                at = np.minimum(np.searchsorted(fps, other), n - 1)
                hit = np.flatnonzero((fps[at] == other) & (at > np.arange(n)))
                link(hit, at[hit])
    top = np.array([find(i) for i in range(n)])
    own = top != np.arange(n)
    return fps[own], fps[top[own]]


def links(distinct: DataFrame, most: int = 3) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints that connect all pairs of at most ``most`` (up to 3) differing bits."""
    if most > 3:
        raise ValueError("six segments serve up to three differing bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_key, left = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        done = False
        while not done:
            batch = next(batches, None)
            done = batch is None
            if not done:
                left_key = np.r_[left_key, batch.column(0).to_numpy(zero_copy_only=False)]
                left = np.r_[left, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
            if not len(left_key):
                continue
            cut = np.r_[0, np.flatnonzero(left_key[1:] != left_key[:-1]) + 1, len(left_key)]
            last = len(cut) - 1 if done else len(cut) - 2  # the last group may go on in the next batch
            size = np.diff(cut)[:last]
            out_a, out_b = [], []
            two = cut[:last][size == 2]
            if len(two):
                hit = two[_near(left[two] ^ left[two + 1], most)]
                out_a.append(np.maximum(left[hit], left[hit + 1]))
                out_b.append(np.minimum(left[hit], left[hit + 1]))
            for i in np.flatnonzero(size > 2).tolist():
                a, b = forest(left[cut[i] : cut[i + 1]], most)
                out_a.append(a)
                out_b.append(b)
            left_key, left = left_key[cut[last] :], left[cut[last] :]
            if out_a:
                yield pa.record_batch([pa.array(np.concatenate(x).view(np.int64)) for x in (out_a, out_b)], names=["a", "b"])

    rows = filed(distinct)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = 3) -> DataFrame:
    """``(id, fp, component_id)``, one row for each row of ``docs``.

    component_id is the least id reachable by fingerprints that differ in at
    most ``most`` bits. Null and empty texts share fingerprint 0 and so a class;
    repeated rows keep a row each; rows with a null id belong to their class but
    never name it (a class of null ids only has a null component_id).
    """
    own = settled(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = own.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(distinct.select("fp"), most))
    classed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classed.join(named, "root").select(F.col("fp").alias("of"), "component_id")
    return own.join(classes, own.fp == classes.of, "left").select("id", "fp", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """The fingerprint of each document and the least doc_id of its near-duplicate class."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
