"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first (compatibility forms, case, look-alike letters of other
scripts, digits and signs used for letters, invisible characters), so one entry
meets all spellings. The lexicon, its weights and its exception phrases are learned
from labelled rows: words, and beginnings that several words share, whose documents
are mostly toxic; and pairs of words that hold an entry in documents that are not. The weight
of what matches, and that weight against the length of the text, give the score.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import by_batch, id_type, one_in, settled, table

#: Most labelled rows that the lexicon is fitted on (the first by a hash of the id).
FIT_ROWS = 20_000
#: Least labelled documents of an entry, and the least share of them that is toxic.
SUPPORT, PURITY = 6, 0.9
#: Lengths of beginnings of words that may be entries, and how many different words must share one.
STEMS, KIN = (4, 5, 6), 3

_LOOK = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ү": "y", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
}
_FOLD = str.maketrans(_LOOK | dict.fromkeys("​‌‍⁠﻿­", ""))
_SPLIT = regex.compile(r"[^\p{L}\p{M}]+")


def fold(text: str | None) -> str:
    """Words of letters, folded, each between single spaces; empty for null."""
    if not text:
        return ""
    return " " + _SPLIT.sub(" ", unicodedata.normalize("NFKC", text).lower().translate(_FOLD)).strip() + " "


@dataclass
class Lexicon:
    """Entries (" word " whole, " begin" of a word) with weights, exception phrases, and the curve from hits to a score."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-4.0, 4.0, 1.0)
    _built: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_built"} | {"_built": None}

    @property
    def automaton(self):
        if self._built is None:
            a = ahocorasick.Automaton()
            for k, w in self.weights.items():
                a.add_word(k, (len(k), w))
            for k in self.exceptions:
                a.add_word(k, (len(k), None))
            if len(a):
                a.make_automaton()
            self._built = a
        return self._built

    def hits(self, folded: str) -> list[tuple[int, int, float | None]]:
        """(start, end, weight) of what matches; exceptions have no weight."""
        if not len(self.automaton):
            return []
        return [(e + 1 - n, e + 1, w) for e, (n, w) in self.automaton.iter(folded)]

    def matched(self, folded: str) -> tuple[float, int, list[tuple[int, int]]]:
        """(sum of weights, words hit, their spans); a word counts once, by its heaviest entry, and not inside an exception."""
        best: dict[int, tuple[float, int]] = {}
        spared: list[tuple[int, int]] = []
        for s, e, w in self.hits(folded):
            if w is None:
                spared.append((s, e))
            elif s not in best or best[s][0] < w:
                best[s] = (w, e)
        if spared:
            best = {s: x for s, x in best.items() if not any(a <= s and x[1] <= b for a, b in spared)}
        return sum(w for w, _ in best.values()), len(best), [(s, e) for s, (_, e) in sorted(best.items())]

    def features(self, folded: str) -> tuple[float, float]:
        weight, _, _ = self.matched(folded)
        return math.log1p(weight), math.log1p(100 * weight / (1 + folded.count(" ")))

    def score(self, folded: str) -> float:
        a, b, c = self.curve
        x, y = self.features(folded)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, learn, most: int) -> DataFrame:
    """``(text, y)`` of at most ``most`` labelled rows for which ``learn`` holds: the first by a hash of the id, with the
    largest label of an id that has several, and the least text. The ids, at most ``most``, are broadcast; texts are not shuffled."""
    some = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & learn).groupBy(F.col(id_col).alias("id_")).agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("id_"), "id_").limit(most)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return settled(rows.join(F.broadcast(some), rows.id == F.col("id_")).groupBy("id", "y").agg(F.min("text").alias("text")).select("id", "text", "y"), "labelled")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of (1, x) by Newton steps with a small ridge."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(sample: DataFrame, support: int = SUPPORT, purity: float = PURITY) -> Lexicon:
    """A lexicon from ``(id, text, y)``. Counts are taken on the executors; the driver gets every term and exception
    that qualifies, each of which ``support`` rows of the bounded sample must hold, and two numbers for each row."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, t = Counter(), Counter()
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(fold(text).split())
            terms = {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in STEMS if len(w) >= k}
            n.update(terms)
            if y:
                t.update(terms)
        terms = list(n)
        return pa.record_batch([pa.array(terms, pa.string()), pa.array([n[x] for x in terms], pa.int64()), pa.array([t[x] for x in terms], pa.int64())], names=["term", "n", "t"])

    counts = settled(sample.select("text", "y").mapInArrow(by_batch(count), "term string, n long, t long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("t").alias("t")), "terms")
    # the words that begin so, and the most toxic documents of one of them
    whole = counts.where(F.col("term").endswith(" "))
    kin = whole.where("t > 0").select("t", F.explode(F.array(*(F.when(F.length("term") >= k + 2, F.substring("term", 1, k + 1)) for k in STEMS))).alias("begin")).where("begin is not null").groupBy("begin").agg(F.count("*").alias("words"), F.max("t").alias("best"))
    pure = counts.where((F.col("t") >= support) & (F.col("t") >= purity * F.col("n"))).join(kin, F.col("term") == F.col("begin"), "left")
    pure = pure.where(F.col("term").endswith(" ") | (F.col("words") >= KIN) & (F.col("t") - F.col("best") >= support)).collect()
    # of beginnings of the same documents the longest stays
    longer = {r.term[:k]: r.t for r in sorted(pure, key=lambda r: (r.t, r.term)) if not r.term.endswith(" ") for k in range(2, len(r.term))}
    pure = [r for r in pure if longer.get(r.term, 0) < r.t]
    weights: dict[str, float] = {}
    for r in sorted(pure, key=lambda r: (len(r.term.strip()), r.term.endswith(" "), r.term)):  # a beginning stands for all that begins with it
        if not any(r.term[:k] in weights for k in range(2, len(r.term))):
            weights[r.term] = math.log((r.t + 0.5) / (r.n - r.t + 0.5)) / math.log(20)
    plain = Lexicon(weights)

    def pairs(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, t = Counter(), Counter()
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            folded, seen = fold(text), set()
            for s, _, _ in plain.hits(folded):
                e = folded.index(" ", s + 1)
                before, after = folded.rfind(" ", 0, s), folded.find(" ", e + 1)
                seen |= ({folded[before : e + 1]} if before >= 0 else set()) | ({folded[s : after + 1]} if after >= 0 else set())
            n.update(seen)
            if y:
                t.update(seen)
        terms = list(n)
        return pa.record_batch([pa.array(terms, pa.string()), pa.array([n[x] for x in terms], pa.int64()), pa.array([t[x] for x in terms], pa.int64())], names=["term", "n", "t"])

    spared = sample.select("text", "y").mapInArrow(by_batch(pairs), "term string, n long, t long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    spared = spared.where((F.col("n") >= support) & (F.col("t") <= 0.2 * F.col("n"))).collect()
    lexicon = Lexicon(weights, sorted(r.term for r in spared))

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [lexicon.features(fold(t)) for t in batch.column(0).to_pylist()]
        return pa.record_batch([pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64()), batch.column(1)], names=["a", "b", "y"])

    rows = sample.select("text", "y").mapInArrow(by_batch(measure), "a double, b double, y int").toArrow()
    x, y = np.c_[rows["a"].to_numpy(), rows["b"].to_numpy()], rows["y"].to_numpy().astype(float)
    if 0 < y.sum() < len(y):
        order = np.lexsort((y, x[:, 1], x[:, 0]))  # the same sums for any order of rows
        lexicon.curve = tuple(_logistic(x[order], y[order]).tolist())
    return lexicon


def scores(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)``, one row for each row of ``docs``; null and empty texts have the score of a text without a match."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), pa.array([lexicon.score(fold(t)) for t in batch.column(1).to_pylist()], pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(by_batch(run), f"id {id_type(docs, id_col)}, score double")


def spans(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, word, weight)`` for each word that counts towards a score, as it reads after folding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, word = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                folded = fold(text)
                for s, _ in [(s, e) for s, e in lexicon.matched(folded)[2]]:
                    at.append(i)
                    word.append(folded[s + 1 : folded.index(" ", s + 1)])
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(word, pa.string())], names=["id", "word"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {id_type(docs, id_col)}, word string")


def learned(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Lexicon:
    """The lexicon of labelled documents, those with crc32(doc_id) mod 3 = 1 left out."""
    return learn(labelled(docs, labels, "toxic", "doc_id", "text", one_in("doc_id", 3) != 1, most))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of each document: 0 to 1, with a verdict at 0.7. One row for each row of documents; null and empty texts
    have the score of a text without a match, null ids count as held out or not by the empty text."""
    docs = table(spark, sf_dir, "documents")
    out = scores(docs, learned(docs, table(spark, sf_dir, "labels")))
    return out.select(F.col("id").alias("doc_id"), (one_in("id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
