"""Best-fit packing of token sequences by a configuration linear program.

Only the histogram of piece lengths (as many rows as a sequence has tokens) reaches
the driver. There the configurations, ways to fill one sequence, get weights by
multiplicative updates: each round prices the lengths, a knapsack dynamic program
finds the best configuration with each length in it, those near the best gain
weight, and lengths that they serve get cheaper; prices also bound the number of
sequences from below. Weights are rounded at several scales, what is left goes by
best fit decreasing, on the histogram too, and the plan with the fewest sequences is
taken, best fit alone among them. The plan says which ranks of each length go where;
pieces get their ranks by counts, in parallel.
"""

from __future__ import annotations

import base64
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import give_back, id_type, settled, table

LENGTH = 2048
#: Most rounds of the multiplicative weights, what a round covers of a length at most, and the gap to the lower bound at
#: which rounds end.
ROUNDS, STEP, GAP = 150, 0.05, 0.005
#: How fast prices fall with what is covered, and how near the best a configuration must be; the program runs with each.
WAYS = ((8.0, 0.1), (20.0, 0.03))
#: Pieces that are ranked in one group, about.
GROUP = 8_000
#: Texts of these characters only are split alike by both tokenizer libraries, whatever Unicode version they hold.
_PLAIN = regex.compile(r"[^\x00-ɏ‐-‧€]")
SPECIAL = "<|endoftext|>"
#: Characters of a text that go to a tokenizer at once, about.
LONG = 1 << 16
#: What is a letter, or no white space, in any Unicode version.
_LETTER = regex.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f\u4e00-\u9fa5\u3041-\u3094\u30a1-\u30fa\uac00-\ud7a3]")
_EDGE = regex.compile(r"(?r)(?<=[!-~]|" + _LETTER.pattern + r")[ \n]")


class Tokens:
    """Token ids as the tokenizer file gives them (no special tokens added).

    Texts of Latin letters go through the same vocabulary in tiktoken, which gives the same ids in a quarter of the
    time (tests compare them); all others, and those that spell a special token, through the file itself. A long text
    goes in parts, cut where neither the split into words nor a merge can reach across, so that what a library builds
    for one call stays small; a part without such a place, one endless word, is split by the file's pattern and merged
    word by word.
    """

    def __init__(self, json_name: str = "byte_bpe_50k.json", ranks_name: str | None = "byte_bpe_50k.tiktoken", folder: str | None = None):
        self.json_name, self.ranks_name, self.folder, self._json, self._ranks, self._joins = json_name, ranks_name, folder, None, None, None

    def __getstate__(self):
        return self.__dict__ | {"_json": None, "_ranks": None, "_joins": None}

    def _path(self, name: str) -> str:
        if self.folder:
            return f"{self.folder}/{name}"
        import public_tokenizers

        return str(public_tokenizers.path(name))

    @property
    def exact(self):
        if self._json is None:
            from tokenizers import Tokenizer

            self._json = Tokenizer.from_file(self._path(self.json_name))
        return self._json

    @property
    def quick(self):
        if self._ranks is None:
            import public_tokenizers
            import tiktoken

            with open(self._path(self.ranks_name), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self._joins = np.zeros((256, 256), bool)
            for token in ranks:
                for pair in zip(token, token[1:], strict=False):
                    self._joins[pair] = True
        return self._ranks

    def _apart(self, left: str, right: str) -> bool:
        """Whether no token holds the last byte of ``left`` and the first of ``right`` next to each other."""
        return not self._joins[left.encode("utf-8", "replace")[-1], right.encode("utf-8", "replace")[0]]

    def _cut(self, text: str, low: int, end: int) -> int | None:
        """The last place in (low, end) where ``text`` can be cut without a change of ids."""
        found = _EDGE.search(text, low + 1, end)
        if found:  # before white space that follows a letter or sign: words never reach from these into white space
            return found.start()
        if not self.ranks_name or SPECIAL in text[max(0, low - len(SPECIAL)) : end + len(SPECIAL)]:
            return None
        self.quick  # noqa: B018  makes the table of joins
        for i in range(end - 1, low + 2, -1):
            a, b = text[i - 1], text[i]
            if a in " \t\n\r" and b in " \t\n\r":
                if self._apart(a, b):  # inside one run of white space
                    return i
            elif a.isascii() and b.isascii():
                if a.isalnum() and b.isalnum() and a.isdigit() != b.isdigit():  # between two words
                    return i
                if a.isalpha() and b.isalpha() and _LETTER.match(text[i - 2]) and self._apart(a, b):
                    return i  # inside one word; the letter before keeps 'll and its like whole
            elif _LETTER.match(a) and _LETTER.match(text[i - 2]) and _LETTER.match(b) and self._apart(a, b):
                return i
        return None

    def _parts(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > LONG:
            end, cut = at + LONG, None
            while cut is None and end < len(text):
                cut, end = self._cut(text, max(at, end - LONG - 3), end), end + LONG
            if cut is None:
                break
            yield text[at:cut]
            at = cut
        yield text[at:]

    def _ids(self, text: str) -> np.ndarray:
        if self.ranks_name and SPECIAL not in text and not _PLAIN.search(text):
            if len(text) <= 2 * LONG:
                return self.quick.encode_to_numpy(text, disallowed_special=()).astype("<u4")
            import public_tokenizers

            merge, words = self.quick._core_bpe.encode_single_piece, regex.finditer(public_tokenizers.PATTERN, text)
            return np.fromiter((i for w in words for i in merge(w[0].encode("utf-8"))), "<u4")
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        return self._ids(text) if len(text) <= LONG else np.concatenate([self._ids(x) for x in self._parts(text)])


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = 0, tokens: Tokens | None = None) -> DataFrame:
    """``(id, piece, start, length, ids binary)``: token ids (little-endian, 32 bits) of each row's text and ``end_id``.

    Only what is longer than ``length`` is cut, into pieces of ``length``; the first may be shorter. A null or empty
    text is ``end_id`` alone.
    """
    tokens = tokens or Tokens()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = np.array([end_id], "<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                of, number, start, size, body = [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = np.concatenate([tokens(text), stop])
                    cut = [0] if len(ids) <= length else [0, *range(len(ids) % length or length, len(ids), length)]
                    for k, (a, b) in enumerate(zip(cut, [*cut[1:], len(ids)], strict=True)):
                        of.append(i)
                        number.append(k)
                        start.append(a)
                        size.append(b - a)
                        body.append(ids[a:b].tobytes())
                yield pa.record_batch([part.column(0).take(pa.array(of, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(body, pa.binary())], names=["id", "piece", "start", "length", "ids"])
        give_back()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {id_type(docs, id_col)}, piece int, start long, length long, ids binary")


def _fill(prices: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack over the lengths ``have``: the best value of each capacity up to len(prices) - 1, and the length to take
    first (0: none; of equal ones the longest)."""
    n = len(prices)
    best, take, own = np.zeros(n), np.zeros(n, np.int64), prices[have]
    fits = np.searchsorted(have, np.arange(n), side="right")
    for c in range(int(have[0]), n):
        k = fits[c]
        value = best[c - have[:k]] + own[:k]
        i = k - 1 - int(value[::-1].argmax())
        best[c], take[c] = (value[i], have[i]) if value[i] > best[c - 1] else (best[c - 1], 0)
    return best, take


def _pattern(first: int, length: int, take: np.ndarray) -> tuple[int, ...]:
    found, c = [first], length - first
    while c > 0:
        if take[c]:
            found.append(int(take[c]))
            c -= int(take[c])
        else:
            c -= 1
    return tuple(sorted(found, reverse=True))


def configurations(counts: np.ndarray, rounds: int = ROUNDS, gap: float = GAP, way: tuple[float, float] = WAYS[0]) -> tuple[dict[tuple[int, ...], float], np.ndarray, float]:
    """The covering program by multiplicative weights: (weights of configurations, how far they cover each length, a lower
    bound on the number of sequences).

    Each round prices the lengths, those least covered dearest, and the knapsack finds the best configuration with each
    length in it. Those near the best gain weight, the least covered lengths first, until a length has got its step.
    What all pieces are worth, over the value of the best configuration, bounds the program from below. Rounds end once
    the weights, scaled so that they cover, are within ``gap`` of the best bound. A full piece is left out.
    """
    length, have = len(counts) - 1, np.flatnonzero(counts)
    have = have[have < length]
    n, covered, price, mean = (np.zeros(length + 1) for _ in range(4))
    n[have] = counts[have]
    out: dict[tuple[int, ...], float] = defaultdict(float)
    if not len(have):
        return out, covered, 0.0
    bound, start, total = 0.0, np.log(have / length * n[have]), 0.0  # at first a price is a length
    for t in range(rounds):
        z = start - way[0] * (covered[have] - covered[have].min())
        price[have] = np.exp(z - z.max()) / n[have]
        best, take = _fill(price, have)
        bound, mean = max(bound, price @ n / best[length]), mean + price / best[length]
        if t % 10 == 9:
            bound = max(bound, mean @ n / _fill(mean, have)[0][length])
        near = have[price[have] + best[length - have] >= (1 - way[1]) * best[length]]
        left = n * STEP
        for first in near[np.lexsort((-near, covered[near]))].tolist():
            if left[first] <= 0:
                continue
            p = _pattern(first, length, take)
            use = Counter(p)
            amount = min(left[k] / c for k, c in use.items())
            if amount > 0:
                out[p] += amount
                total += amount
                for k, c in use.items():
                    left[k] -= amount * c
                    if left[k] < 1e-9 * n[k]:
                        left[k] = 0.0
        covered[have] += STEP - left[have] / n[have]
        if covered[have].min() > 0 and total / covered[have].min() <= (1 + gap) * bound:
            break
    return out, covered, bound


def best_fit(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on a histogram: (configuration, times)."""
    length = len(counts) - 1
    free: list[dict[tuple[int, ...], int]] = [{} for _ in range(length + 1)]
    some = np.zeros(length + 1, bool)
    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        while left:
            at = size + int(some[size:].argmax())
            if some[at]:
                bins, n = free[at].popitem()
                some[at] = bool(free[at])
            else:
                at, bins, n = length, (), left
            t = min(at // size, left)
            use = min(n, left // t)
            if use < n and bins:
                free[at][bins] = n - use
                some[at] = True
            into = (*bins, *[size] * t)
            free[at - t * size][into] = free[at - t * size].get(into, 0) + use
            some[at - t * size] = True
            left -= t * use
    return [(p, n) for f in free for p, n in f.items()]


def rounded(counts: np.ndarray, weights: dict[tuple[int, ...], float], scale: float) -> tuple[Counter, np.ndarray]:
    """(times of each configuration, pieces left): weights times ``scale``, the fullest first, whole parts and one more
    whenever the fractions so far make one, as far as there are pieces."""
    left, chosen, open_ = counts.copy(), Counter(), 0.0
    for p, x in sorted(weights.items(), key=lambda i: (-sum(i[0]), -i[1], i[0])):
        times, use = int(x * scale), Counter(p)
        open_ += x * scale - times
        if open_ >= 1:
            times, open_ = times + 1, open_ - 1
        times = min(times, *(int(left[k]) // c for k, c in use.items()))
        if times > 0:
            chosen[p] += times
            for k, c in use.items():
                left[k] -= c * times
    return chosen, left


def plan(counts: np.ndarray, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """(configuration, times) for ``counts[l]`` pieces of length l.

    The program is solved once and rounded at several scales, from where nothing is covered too often to where all is
    covered; what a rounding leaves goes by best fit. The least number of sequences is taken, best fit alone among
    them, so the plan is never worse than that.
    """
    full, rest = len(counts) - 1, counts.copy()
    rest[full] = 0
    plans = [best_fit(rest)]
    have = np.flatnonzero(rest)
    if sum(n for _, n in plans[0]) > -(-int(rest @ np.arange(full + 1)) // full):  # else no plan is better
        for way in WAYS:
            weights, covered, _ = configurations(rest, rounds, way=way)
            tokens, some = np.average(covered[have], weights=(rest * np.arange(full + 1))[have]), covered[have].mean()
            for scale in (0.95 / covered.max(), 1 / covered.max(), 1 / tokens, 1 / some, 1 / max(covered[have].min(), some / 2)):
                chosen, left = rounded(rest, weights, scale)
                plans.append([*chosen.items(), *best_fit(left)])
    best = min(plans, key=lambda p: sum(n for _, n in p))
    return ([((full,), int(counts[full]))] if counts[full] else []) + best


def _ranges(chosen: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, number in a sequence, offset), by length and rank."""
    rows, used, at = [], Counter(), 0
    for p, times in chosen:
        offset = 0
        for size, c in sorted(Counter(p).items(), reverse=True):
            rows.append((size, used[size], at, c, offset))
            used[size] += c * times
            offset += c * size
        at += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(rows: DataFrame, length: int = LENGTH, size_col: str = "length", rounds: int = ROUNDS) -> DataFrame:
    """``rows`` with ``sequence_id`` and ``offset``. Sizes are 1 to ``length``; the table is read twice, so it should be
    written. Rows are ranked inside their size by a hash of their contents, in groups of about GROUP, so a size that a
    third of all rows has is spread as the others are."""
    histogram = rows.groupBy(size_col).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(length + 1, np.int64)
    counts[histogram[size_col].to_numpy()] = histogram["n"].to_numpy()
    if counts[0]:
        raise ValueError("sizes start at 1")
    ranges = _ranges(plan(counts, rounds)) if counts.any() else np.zeros((0, 5), np.int64)
    key = ranges[:, 0] << 40 | ranges[:, 1]

    parts = max(1, int(counts.sum()) // GROUP)
    names = [c for c in rows.columns if c != "ids"]
    marked = rows.withColumn("h_", F.xxhash64(*names)).withColumn("part_", F.pmod("h_", F.lit(parts)))
    before = marked.groupBy(F.col(size_col).alias("s_"), F.col("part_").alias("p_")).agg(F.count("*").alias("n_"))
    before = before.withColumn("before_", F.sum("n_").over(Window.partitionBy("s_").orderBy("p_").rowsBetween(Window.unboundedPreceding, -1))).select("s_", "p_", F.coalesce("before_", F.lit(0)).alias("before_"))
    place = F.row_number().over(Window.partitionBy(size_col, "part_").orderBy("h_")) - 1
    ranked = marked.withColumn("in_", place).join(before, (F.col(size_col) == F.col("s_")) & (F.col("part_") == F.col("p_"))).withColumn("rank_", (F.col("before_") + F.col("in_")).cast("long")).drop("s_", "p_", "before_", "in_", "h_", "part_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in (size_col, "rank_"))
            r = ranges[np.searchsorted(key, size << 40 | rank, side="right") - 1] if len(ranges) else np.zeros((len(size), 5), np.int64)
            each = np.maximum(r[:, 3], 1)
            sequence, offset = r[:, 2] + (rank - r[:, 1]) // each, r[:, 4] + (rank - r[:, 1]) % each * size
            kept = [i for i, n in enumerate(batch.schema.names) if n != "rank_"]
            yield pa.record_batch([*(batch.column(i) for i in kept), pa.array(sequence), pa.array(offset)], names=[*(batch.schema.names[i] for i in kept), "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def packed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Documents packed into sequences of at most ``length`` tokens, each piece with a digest of its ids."""
    cut = pieces(docs, length=length).select(F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(settled(cut, "pieces"), length)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """The place of each piece of each document. A null or empty text is the end id alone; null and repeated ids keep
    their rows."""
    return packed(table(spark, sf_dir, "documents"))
