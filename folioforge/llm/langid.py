"""Language identification as inference in a mixture of languages.

A language is a distribution over hashed byte trigrams, counted over all training
texts. A document is a mixture of languages: expectation-maximisation finds the
proportions, and the set of languages is the one whose likelihood, less a penalty
for each language, is best (backwards, the weakest language dropped first).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import id_type, one_in, table, text_bytes

#: Trigrams are hashed to so many buckets.
BUCKETS = 4096
#: Steps of expectation-maximisation with all languages, and after each that is dropped.
STEPS, STEPS_LESS = 10, 5
#: Trigrams overlap: so many count as one observation in the penalty.
OVERLAP = 3
UNKNOWN = "und"
#: Documents at once, and bytes of them.
BLOCK, BLOCK_BYTES = 256, 1 << 22

_LETTER = regex.compile(r"\p{L}")


def has_letter(text: bytes, piece: int = BLOCK_BYTES) -> bool:
    """Whether a text has a letter, looked for in pieces; one that begins inside a character has no letter there."""
    return any(_LETTER.search(text[at : at + piece + 3].decode("utf-8", "replace")) for at in range(0, len(text), piece))


def _keys(b: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of the trigrams of some bytes."""
    b = b.astype(np.uint32)
    return (((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int64)


def trigram_counts(texts: list[bytes], buckets: int = BUCKETS, piece: int = BLOCK_BYTES) -> np.ndarray:
    """Counts of hashed trigrams (after lower-casing A-Z), a row for each text; a text over ``piece`` bytes is counted in
    pieces that share two bytes."""
    out = np.zeros((len(texts), buckets))
    at = 0
    while at < len(texts):
        if len(texts[at]) > piece:
            n = len(texts[at])
            for low in range(-1, n - 1, piece):  # the text stands between two spaces
                part = b" " * (low < 0) + texts[at][max(low, 0) : low + piece + 2].lower() + b" " * (low + piece + 2 > n)
                out[at] += np.bincount(_keys(np.frombuffer(part, np.uint8), buckets), minlength=buckets)
            at += 1
            continue
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= piece):
            size += len(texts[end]) + 2
            end += 1
        # a text stands between two spaces; trigrams that reach into the next text are left out
        b = np.frombuffer(b"".join(b" " + x.lower() + b" " for x in texts[at:end]), np.uint8)
        if len(b) >= 3:
            key = _keys(b, buckets)
            ends = np.cumsum([len(x) + 2 for x in texts[at:end]])
            owner = np.repeat(np.arange(end - at), np.diff(np.r_[0, ends]))[: len(key)]
            inside = np.arange(len(key)) + 3 <= ends[owner]
            out[at:end] = np.bincount(owner[inside] * buckets + key[inside], minlength=(end - at) * buckets).reshape(end - at, buckets)
        at = end
    return out


class Model:
    """Languages in order of their names, and their smoothed trigram distributions."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        counts = counts.reshape(len(languages), counts.size // len(languages) if languages else BUCKETS)
        total = counts.sum(0, keepdims=True)
        back = (total + 0.5) / (total.sum() + 0.5 * counts.shape[1])
        # each language backs off to the mix of all, with the mass of one trigram a bucket at most
        mass = np.minimum(counts.shape[1] / 8, 1 + counts.sum(1, keepdims=True) / 100)
        self.p = ((counts + mass * back) / (counts.sum(1, keepdims=True) + mass)).astype(np.float32)

    def _fit(self, c: np.ndarray, pi: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        n = np.maximum(c.sum(1, keepdims=True), 1)
        for _ in range(steps):
            pi = pi * ((c / (pi @ self.p)) @ self.p.T) / n
            pi /= pi.sum(1, keepdims=True)
        return pi, (c * np.log(pi @ self.p)).sum(1)

    def mixture(self, counts: np.ndarray) -> np.ndarray:
        """Proportions of the languages, a row for each row of counts; zero for those not in its set.

        The penalty counts the languages that are in the set, not those that the steps have brought to zero.
        """
        c = counts.astype(np.float32)
        n, k = c.sum(1), len(self.languages)
        if not n.all():  # without a trigram there is no language
            out = np.zeros((len(c), k), np.float32)
            out[n > 0] = self.mixture(counts[n > 0])
            return out
        pi, like = self._fit(c, np.full((len(c), k), 1 / k, np.float32), STEPS)
        penalty = 0.5 * np.log(np.maximum(n / OVERLAP, 2))
        best, value = pi.copy(), like / OVERLAP - penalty * (pi > 0).sum(1)
        rows = np.flatnonzero((pi > 0).sum(1) > 1)
        while len(rows):  # once a smaller set is worse, still smaller ones are not tried
            less = pi[rows]
            less[np.arange(len(rows)), np.where(less > 0, less, np.inf).argmin(1)] = 0
            less /= less.sum(1, keepdims=True)
            less, like = self._fit(c[rows], less, STEPS_LESS if (less > 0).sum(1).max() > 1 else 0)
            v = like / OVERLAP - penalty[rows] * (less > 0).sum(1)
            better = v > value[rows]
            pi[rows] = less
            best[rows[better]], value[rows[better]] = less[better], v[better]
            rows = rows[better & ((less > 0).sum(1) > 1)]
        return best


def fit(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts over all rows with a language for which ``learn`` holds. The driver gets BUCKETS numbers a language."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & learn).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            texts = text_bytes(batch.column(0))
            for at in range(0, len(texts), BLOCK):
                counts = trigram_counts(texts[at : at + BLOCK])
                for lang in set(langs[at : at + BLOCK]):
                    sums[lang] = sums.get(lang, 0) + counts[langs[at : at + BLOCK] == lang].sum(0)
        for lang, c in sums.items():
            hit = np.flatnonzero(c)
            yield pa.record_batch([pa.array([lang] * len(hit), pa.string()), pa.array(hit.astype(np.int32)), pa.array(c[hit].astype(np.int64))], names=["lang", "bucket", "n"])

    found = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(found["lang"].to_pylist()))
    counts = np.zeros((len(languages), BUCKETS))
    if languages:
        counts[np.searchsorted(languages, found["lang"].to_pylist()), found["bucket"].to_numpy()] = found["n"].to_numpy()
    return Model(languages, counts)


def mixtures(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score, mixture map<string, double>)``, one row for each row of ``docs``.

    score is the share of the leading language. A null text, one without a letter,
    and any text under a model of no languages is ``und`` with score 0 and an empty mixture.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = model.languages
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                texts = text_bytes(part.column(1))
                known = np.array([bool(names) and has_letter(x) for x in texts])
                pred, score, mix = [UNKNOWN] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
                rows = np.flatnonzero(known)
                if len(rows):
                    pi = model.mixture(trigram_counts([texts[i] for i in rows])).astype(float)
                    lead = pi.argmax(1)
                    for i, p, k in zip(rows.tolist(), pi, lead.tolist(), strict=True):
                        pred[i], mix[i] = names[k], [(names[j], float(p[j])) for j in np.flatnonzero(p > 0)]
                    score[rows] = np.minimum(pi.max(1), 1.0)
                yield pa.record_batch([part.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(mix, pa.map_(pa.string(), pa.float64()))], names=["id", "lang_pred", "score", "mixture"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {id_type(docs, id_col)}, lang_pred string, score double, mixture map<string, double>")


def op4_langid(spark, sf_dir: str) -> DataFrame:
    """The leading language of each document and its share: one row for each row of documents, ``und`` and 0 for a null
    text and one without a letter."""
    docs = table(spark, sf_dir, "documents")
    out = mixtures(docs, fit(docs, one_in("doc_id", 4) != 2))
    return out.select(F.col("id").alias("doc_id"), (one_in("id", 4) == 2).alias("held_out"), "lang_pred", "score")
