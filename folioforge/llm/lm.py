"""N-gram language model in an Elias-Fano trie, dealt over the cluster.

Documents are turned to blocks of word numbers once, which stay where they are. For each
order, a block sends its distinct n-grams with their counts to the parts of that level of
the trie, dealt by the context (by context and word, where a context is very common). A
part adds the counts up, writes its entries as rising sequences with quantised
probabilities, and answers each block from that level by context-relative successor
search. An entry's place in its part is its number, the context of the next order. An
answer names counts; with the context's, a block has the same steps of probability.

Smoothing is Dirichlet's: p(w | context) = (c(context w) + MASS p(w | shorter context)) /
(c(context) + MASS), down to the base (c(w) + 1) / (N + V + 1). The trie keeps the first
part of that sum; the weight of the second follows from the context's count. A
document's first words use the contexts that it has.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import elias_fano
from ._base import dealt, give_back, id_type, one_in, settled, table
from .quality import _mixed, _numbers, _planes, _restored, _rising, _risen, _squeezed

#: Words of the longest n-gram, and weight of the shorter context's probability.
ORDER, MASS = 3, 200.0
#: Bytes of text worked on at once, in a block at most, and for each part of a level; least number of parts.
PIECE, BLOCK, SHARE, PARTS = 1 << 20, 16 << 20, 16 << 20, 24
#: Longest word that is its own key; longer ones have their sha256. Words have no spaces, so the end's key is none of theirs.
LONG, END = 64, b" "
#: A context that is more common is dealt by its words too, over so many parts that each has about this many tokens.
COMMON = 1 << 21
#: How levels are dealt to parts; a model that was saved with another one can't be asked.
LAYOUT = 2
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_ODD = np.uint64(0x9E3779B97F4A7C15)

PART = "block long, part long, data array<binary>, entries long, tokens long"
OWN = "block long, ids array<{}>, held array<boolean>, rows array<long>, sizes array<int>, lead array<int>, seq binary, parts binary, counts binary, words binary"


def _key(word: bytes) -> bytes:
    return word if len(word) <= LONG else b"sha256 " + hashlib.sha256(word).digest()


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """A text in pieces of about ``size`` bytes, cut at separators only."""
    at = 0
    while len(text) - at > size:
        gap = _GAP.search(text, at + size)
        if not gap:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


def tokenised(docs: DataFrame, held: Column, parts: int, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", piece_bytes: int = PIECE, block_bytes: int = BLOCK) -> DataFrame:
    """Blocks of word numbers, of up to about ``block_bytes`` of text. A text that goes on in another block takes its last
    words along as contexts (``lead``), so the size of a block does not depend on the longest text."""
    kind = id_type(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        block, row = first, first
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        about: list[tuple] = []
        seqs: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            seq, words = np.concatenate(seqs), list(number)
            often = np.bincount(seq, minlength=len(words))
            order_ = np.argsort(-often, kind="stable")  # the commonest words get the least numbers
            rank = np.empty(len(words), np.int32)
            rank[order_] = np.arange(len(words))
            seq, words = rank[seq], [words[i] for i in order_.tolist()]
            ids, held, rows, sizes, lead = zip(*about, strict=True)
            counted = _counted(np.array(sizes), np.array(lead), ~np.array(held))
            counts = np.bincount(seq[counted], minlength=len(words)).astype(np.int32)
            part = np.array([xxhash.xxh64_intdigest(w) % parts for w in words], np.int32)
            values = [pa.array([block]), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (pa.array(ids, ids_kind), pa.array(held), pa.array(rows), pa.array(sizes, pa.int32()), pa.array(lead, pa.int32())))]
            return pa.record_batch([*values, *(pa.array([x], pa.binary()) for x in (_squeezed(_planes(seq)), _squeezed(_planes(part)), _squeezed(_planes(counts)), _squeezed(b"".join(words) + bytes(map(len, words)))))], names=[x.split()[0] for x in OWN.split(", ")])

        ids_kind = None
        for batch in batches:
            ids_kind = batch.column(0).type
            for id_, is_held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = text.as_buffer() if text.is_valid else None
                tail, row = np.zeros(0, np.int64), row + 1
                last: list[bytes] = []
                for piece in pieces(raw.to_pybytes() if raw else b"", piece_bytes):
                    if size >= block_bytes:
                        yield out()
                        block, size = block + 1, 0
                        number.clear()
                        about.clear()
                        seqs.clear()
                        tail = np.array([number[w] for w in last], np.int64)
                    words = piece.lower().split()  # at the six separators; only A-Z change
                    if words and len(max(words, key=len)) > LONG:
                        words = [_key(w) for w in words]
                    seq = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                    same = bool(about) and about[-1][2] == row
                    if same:  # the text goes on in this block
                        about[-1] = (*about[-1][:3], about[-1][3] + len(seq), about[-1][4])
                        seqs.append(seq.astype(np.int32))
                    else:
                        about.append((id_, is_held, row, len(tail) + len(seq), len(tail)))
                        seqs.append(np.append(tail, seq).astype(np.int32))
                    last = [*last, *words[-order:]][len(last) + min(len(words), order) - order + 1 :] if len(last) + len(words) >= order else [*last, *words]
                    size += len(piece) + 8
                about[-1] = (*about[-1][:3], about[-1][3] + 1, about[-1][4])
                seqs.append(np.array([number[END]], np.int32))
        if about:
            yield out()
        give_back()

    return docs.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, OWN.format(kind))


def _counted(sizes: np.ndarray, lead: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which places of a block are tokens of the rows chosen, and no lead."""
    start = np.cumsum(sizes) - sizes
    inside = np.arange(int(sizes.sum())) - np.repeat(start, sizes)
    return np.repeat(rows, sizes) & (inside >= np.repeat(lead, sizes))


def _order(x: np.ndarray) -> np.ndarray:
    """Places of numbers, none below 0, from the least: one sort of number and place together where 63 bits hold both."""
    bits = max(len(x) - 1, 1).bit_length()
    if int(x.max(initial=0)) >> (63 - bits):
        return np.argsort(x)
    return np.sort((x.astype(np.int64) << bits) | np.arange(len(x))) & ((1 << bits) - 1)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, each value's place among them) of numbers, none below 0."""
    order = _order(x)
    found = x[order]
    new = np.diff(found, prepend=-1) != 0
    at = np.empty(len(x), np.int32)
    at[order] = np.cumsum(new) - 1
    return found[new], at


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers, none below 0, in the bytes that the largest needs."""
    most = int(x.max(initial=0))
    return _squeezed(_planes(x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.int32 if most < 1 << 31 else np.int64)))


def _widened(data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers that ``_narrow`` wrote."""
    raw = _restored(data)
    return _numbers(raw, {1: np.uint8, 2: np.uint16, 4: np.int32}.get(len(raw) // max(n, 1), np.int64)).astype(np.int64)


def _joined(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Pairs as numbers that rise by context and word."""
    top = int(word.max(initial=0)) + 1
    if (int(context.max(initial=0)) + 1) * top < 1 << 63:
        return context * top + word
    (_, i), (words, j) = _distinct(context), _distinct(word)
    return i.astype(np.int64) * len(words) + j


def _pairs(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct pair, by context and word; each pair's place among them)."""
    key = _joined(context, word)
    order = _order(key)
    new = np.diff(key[order], prepend=-1) != 0
    at = np.empty(len(key), np.int32)
    at[order] = np.cumsum(new) - 1
    return order[new], at


def _words(data: bytes, n: int) -> list[bytes]:
    raw = _restored(data)
    edge = np.append(0, np.cumsum(np.frombuffer(raw, np.uint8, n, len(raw) - n).astype(np.int64))).tolist()
    return [raw[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _array(data: bytes, n: int) -> pa.Array:
    """The same words as an array that lies over their bytes."""
    raw = _restored(data)
    edge = np.append(0, np.cumsum(np.frombuffer(raw, np.uint8, n, len(raw) - n))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(edge), pa.py_buffer(raw)])


def _packed(words: pa.Array) -> bytes:
    """Words in a row, then their lengths."""
    edge = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    raw = words.buffers()[2]
    return (raw.slice(edge[0], edge[-1] - edge[0]).to_pybytes() if raw and len(words) else b"") + np.diff(edge).astype(np.uint8).tobytes()


def _turned(order: np.ndarray) -> np.ndarray:
    """Each place's rank, from the places in order."""
    out = np.empty(len(order), np.int32)
    out[order] = np.arange(len(order), dtype=np.int32)
    return out


def _placed(place: np.ndarray) -> list[bytes]:
    """Places that rise but for -1 where there is none: by their steps, and which are there."""
    return [_narrow(np.diff(np.maximum.accumulate(np.append(0, place)))), _squeezed(np.packbits(place >= 0).tobytes())]


def _places(data: list[bytes], n: int) -> np.ndarray:
    there = np.unpackbits(np.frombuffer(_restored(data[1]), np.uint8), count=n).astype(bool)
    return np.where(there, np.cumsum(_widened(data[0], n)), -1)


def _close(ids: np.ndarray, part: int, parts: int, level: int) -> list[bytes]:
    """Contexts' numbers in a part: as they are at the second level, then without what the part says of their places; the
    second item is by how much their words moved them on to another part."""
    if level == 2:
        return [_rising(ids), b""]
    place = ids // parts
    return [_rising(place // parts * parts + ids % parts), _narrow((part - place) % parts)]


def _far(data: list[bytes], n: int, part: int, parts: int, level: int) -> np.ndarray:
    near = _risen(data[0], np.int64)
    if level == 2:
        return near
    return (near // parts * parts + (part - _widened(data[1], n)) % parts) * parts + near % parts


def _cut(part: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, from, to) of each run of equal parts."""
    edge = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else np.zeros(1, np.int64)
    return list(zip(part[edge[:-1]].tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True))


def _row(block: int, part: int, data: list[bytes], entries: int = 0, tokens: int = 0) -> pa.RecordBatch:
    return pa.record_batch([pa.array([block]), pa.array([part]), pa.array([data], pa.list_(pa.binary())), pa.array([entries]), pa.array([tokens])], names=["block", "part", "data", "entries", "tokens"])


def ask_words(blocks: DataFrame) -> DataFrame:
    """Each block's distinct words and counts, for the parts of the first level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, parts, counts, words in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                part, counts = _numbers(_restored(parts), np.int32), _numbers(_restored(counts), np.int32)
                order = np.argsort(part, kind="stable")
                words = _array(words, len(part)).take(pa.array(order))
                for p, a, b in _cut(part[order]):
                    yield _row(block, p, [_squeezed(_packed(words.slice(a, b - a))), _squeezed(_planes(counts[order[a:b]]))], b - a)
        give_back()

    return blocks.select("block", "parts", "counts", "words").mapInArrow(run, PART)


def answer_words(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first level of one part: its words by how common they are, and for each block the places and counts of the
    words it asked with. A level that is there already (block -1) is taken as it is."""
    part, asked, level = key[0].as_py(), [], None
    for batch in batches:
        for block, data, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if block < 0:
                level = _array(data[0], n), _numbers(_restored(data[1]), np.int64)
            else:
                asked.append((block, _array(data[0], n), _numbers(_restored(data[1]), np.int32)))
    if level is None:
        all_ = pa.table({"w": pa.chunked_array([w for _, w, _ in asked]), "n": np.concatenate([n for *_, n in asked]).astype(np.int64)}).group_by("w").aggregate([("n", "sum")])
        all_ = all_.filter(pc.greater(all_["n_sum"], 0)).sort_by([("n_sum", "descending"), ("w", "ascending")])
        level = pa.concat_arrays([pa.array([], pa.binary()), *all_["w"].chunks]), all_["n_sum"].to_numpy()
        yield _row(-1, part, [_squeezed(_packed(level[0])), _squeezed(_planes(level[1]))], len(level[0]), int(level[1].sum()))
    known, counts = level[0], np.append(level[1], 0)
    for block, words, _ in asked:
        place = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        yield _row(block, part, [_narrow(place + 1), _narrow(counts[place])])


@dataclass
class Grams:
    """Distinct n-grams of a block: the number of the one that ends at each place (-1: none), numbers of their entries in
    the trie and their counts."""

    at: np.ndarray
    ids: np.ndarray
    count: np.ndarray


class Block:
    """What a block knows: its words and the answers so far."""

    def __init__(self, own: dict, answers: list[tuple[int, int, list[bytes]]], parts: int, common: int = COMMON):
        self.own, self.parts, self.common = own, parts, common
        self.sizes, self.lead, self.held = (np.array(own[x]) for x in ("sizes", "lead", "held"))
        self.seq = _numbers(_restored(own["seq"]), np.int32)
        self.first = np.zeros(len(self.seq), bool)
        self.first[np.cumsum(self.sizes) - self.sizes] = True
        self.answers = {}
        for level, part, data in sorted(answers, key=lambda x: x[:2]):
            self.answers.setdefault(level, []).append((part, data))
        part = _numbers(_restored(own["parts"]), np.int32)
        order = np.argsort(part, kind="stable")
        ids, count = self._told(1, order, part[order], len(part))
        by = _order(ids + 1)  # words get their order in the trie, so n-grams come in the order in which they are asked for
        self.seq = _turned(by)[self.seq]
        self.words = Grams(self.seq, ids[by], count[by])

    def _told(self, level: int, order: np.ndarray, part: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts; the last level tells no numbers."""
        ids, count = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        told = self.answers.get(level, [])
        if [p for p, _ in told] != [p for p, *_ in _cut(part)]:
            raise RuntimeError("answers are missing")
        for (p, data), (_, a, b) in zip(told, _cut(part), strict=True):
            count[order[a:b]] = _widened(data[-1], b - a)
            if len(data) > 1:
                place = _widened(data[0], b - a) - 1 if level == 1 else _places(data, b - a)
                ids[order[a:b]] = np.where(place < 0, -1, place * self.parts + p)
        return ids, count

    def longer(self, before: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places, numbers there, context's number, word's number) of the distinct n-grams one word longer."""
        here = np.flatnonzero(~self.first[1:] & (before.at[:-1] >= 0)) + 1
        width = max(len(self.words.ids), 1)
        found, at = _distinct(before.at[here - 1].astype(np.int64) * width + self.seq[here])
        return here, at, found // width, found % width

    def asked(self, level: int, before: Grams, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams that can be in the trie, by part, context and word; their parts). From the third level on a context's
        place says its part, so that few numbers lie between the contexts of a part; a word's place says how common it is."""
        ask = np.flatnonzero((before.count[context] > 0) & (self.words.count[word] > 0))
        a, c = before.ids[context[ask]], before.count[context[ask]]
        salt = np.zeros(len(ask), np.uint64)
        often = np.flatnonzero(c > self.common)
        salt[often] = _mixed(self.words.ids[word[ask[often]]].astype(np.uint64) * _ODD) % (-(-c[often] // self.common)).astype(np.uint64)
        if level == 2:
            part = (_mixed(a.astype(np.uint64) * _ODD + salt) % np.uint64(self.parts)).astype(np.int64)
        else:
            part = a // self.parts % self.parts
            part[often] = (part[often] + (salt[often] % np.uint64(self.parts)).astype(np.int64)) % self.parts
        order = np.argsort(part.astype(np.int16 if self.parts < 1 << 15 else np.int64), kind="stable")
        return ask[order], part[order]

    def asks(self, level: int) -> Iterator[pa.RecordBatch]:
        """What it sends to the parts of a level: contexts, their sizes and the counts of those dealt by their words (a part
        adds up the others'), words, n-grams' counts."""
        before = self.words
        for k in range(2, level):
            before = self.grams(k, before)[0]
        here, at, context, word = self.longer(before)
        counts = np.bincount(at[_counted(self.sizes, self.lead, ~self.held)[here]], minlength=len(context))
        ask, part = self.asked(level, before, context, word)
        for p, a, b in _cut(part):
            mine = ask[a:b]
            ids = before.ids[context[mine]]
            head = np.flatnonzero(np.diff(ids, prepend=-1))
            total = before.count[context[mine[head]]]
            data = [_narrow(np.array([len(head)])), *_close(ids[head], p, self.parts, level), _narrow(np.diff(np.append(head, len(ids)))), _narrow(np.where(total > self.common, total, 0)), _narrow(self.words.ids[word[mine]]), _narrow(counts[mine])]
            yield _row(self.own["block"], p, data, b - a)

    def grams(self, level: int, before: Grams) -> tuple[Grams, np.ndarray, np.ndarray]:
        """(n-grams of a level in their order in the trie, their contexts' counts, the shorter n-gram of each)."""
        here, at, context, word = self.longer(before)
        ids, count = self._told(level, *self.asked(level, before, context, word), len(context))
        context = before.count[context]
        if ids.max(initial=-1) >= 0:  # not so of the last level
            by = _order(ids + 1)
            at, ids, count, context = _turned(by)[at], ids[by], count[by], context[by]
        gram, shorter = np.full(len(self.seq), -1, np.int32), np.zeros(len(context), np.int32)
        gram[here] = at
        shorter[at] = before.at[here] if level > 2 else self.seq[here]
        return Grams(gram, ids, count), context, shorter

    def scores(self, order: int, tokens: int, distinct: int, mass: float) -> pa.RecordBatch:
        base = (self.words.count + 1) / (tokens + distinct + 1)
        p, before, lower = base[self.seq], self.words, base
        for k in range(2, order + 1):
            before, context, shorter = self.grams(k, before)
            kept = np.zeros(len(context))
            known = np.flatnonzero(before.count)
            kept[known] = elias_fano.probability(elias_fano.quantised(before.count[known] / (context[known] + mass)))
            lower = kept + mass / (context + mass) * lower[shorter]
            there = before.at >= 0
            p[there] = lower[before.at[there]]
        mine = _counted(self.sizes, self.lead, np.ones(len(self.sizes), bool))
        of = np.repeat(np.arange(len(self.sizes)), self.sizes)[mine]
        word = self.seq[mine]
        n = len(self.sizes)
        sums = [np.bincount(of, x, n) for x in (np.log10(base)[word], np.log10(np.minimum(p[mine], 1)))]
        whole = [np.bincount(of, x, n).astype(np.int64) for x in (None, (self.words.count > 0)[word])]
        return pa.record_batch([self.own["ids"], pa.array(self.held), pa.array(self.own["rows"]), *map(pa.array, (*whole, *sums))], names=["id", "held", "row", "n_tokens", "n_known", "base_score", "score"])


def answer_grams(level: int, parts: int, mass: float, last: bool = False):
    """A level of one part, built from the counts that blocks sent or taken as it is, and each block's answers from it:
    counts, and where a longer n-gram has them as contexts (not ``last``) places before them."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks, asked, data_of_level = key[0].as_py(), [], [], None
        for batch in batches:
            for block, data, rows in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if block < 0:
                    data_of_level = _restored(data[0])
                    continue
                heads = int(_widened(data[0], 1)[0])
                size = _widened(data[3], heads)
                blocks.append(block)
                asked.append((np.repeat(_far(data[1:3], heads, part, parts, level), size), np.repeat(_widened(data[4], heads), size), _widened(data[5], rows), _widened(data[6], rows).astype(np.int32)))
        if not asked:
            return
        context, total, word, n = (np.concatenate([x[i] for x in asked]) for i in range(4))
        edge = np.cumsum([0, *(len(x[0]) for x in asked)]).tolist()
        asked.clear()
        entries, at = _pairs(context, word)
        context, word, total = context[entries], word[entries], total[entries]
        if data_of_level is None:
            count = np.bincount(at, n, len(entries)).astype(np.int64)
            head = np.flatnonzero(np.diff(context, prepend=-1))
            whole = np.repeat(np.add.reduceat(count, head), np.diff(np.append(head, len(count))))
            total = np.where(total > 0, total, whole)
            there = count > 0
            data_of_level = elias_fano.level(context[there], word[there], count[there], count[there] / (total[there] + mass))
            yield _row(-1, part, [_squeezed(data_of_level)], int(there.sum()), int(count.sum()))
        trie = elias_fano.Level(data_of_level)
        place = trie.find(context, word)
        hit = place >= 0
        count = np.zeros(len(entries), np.int64)
        count[hit] = trie.count(place[hit])
        for block, a, b in zip(blocks, edge[:-1], edge[1:], strict=True):
            mine = at[a:b]
            yield _row(block, part, [*([] if last else _placed(place[mine])), _narrow(count[mine])])
        give_back()

    return run


@dataclass
class Model:
    """Levels of the trie, a row for each part, and what the base needs."""

    order: int
    mass: float
    parts: int
    tokens: int
    distinct: int
    levels: list[DataFrame]
    common: int = COMMON

    def save(self, path: str) -> None:
        spark = self.levels[0].sparkSession
        for k, level in enumerate(self.levels, 1):
            level.write.mode("overwrite").parquet(f"{path}/level={k}")
        spark.createDataFrame([(self.order, self.mass, self.parts, self.tokens, self.distinct, self.common, LAYOUT)], "order int, mass double, parts long, tokens long, distinct long, common long, layout int").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        about = spark.read.parquet(f"{path}/about").first()
        if getattr(about, "layout", 1) != LAYOUT:
            raise ValueError(f"the model in {path} was saved by another version; learn it again")
        return Model(*about[:5], [spark.read.schema(PART).parquet(f"{path}/level={k}") for k in range(1, about.order + 1)], about.common)


def _told(answers: list[DataFrame]) -> DataFrame:
    out = None
    for k, x in enumerate(answers, 1):
        x = x.where("block >= 0").select("block", F.lit(k).alias("level"), "part", "data")
        out = x if out is None else out.unionByName(x)
    return out


def _by_block(answers: list[DataFrame], blocks: DataFrame, work, schema: str) -> DataFrame:
    def run(told: pa.Table, own: pa.Table) -> pa.Table:
        about = own.drop_columns(["ids"]).to_pylist()[0] | {"ids": own["ids"].combine_chunks().flatten()}
        out = list(work(about, list(zip(*(told[x].to_pylist() for x in ("level", "part", "data")), strict=True))))
        give_back()
        return pa.Table.from_batches(out) if out else none

    none = pa.Table.from_batches([_row(0, 0, [b""])]).slice(0, 0)
    return _told(answers).groupBy("block").cogroup(blocks.drop("words", "counts").groupBy("block")).applyInArrow(run, schema)


def _levels(blocks: DataFrame, parts: int, order: int, mass: float, model: Model | None = None, common: int = COMMON) -> list[DataFrame]:
    """Of each level a row for each part (block -1), and the answers to the blocks."""
    out: list[DataFrame] = []
    for k in range(1, order + 1):
        asks = ask_words(blocks) if k == 1 else _by_block(out, blocks, lambda own, told, k=k: Block(own, told, parts, common).asks(k), PART)
        if model:
            asks = asks.unionByName(model.levels[k - 1])
        out.append(settled(asks.groupBy("part").applyInArrow(answer_words if k == 1 else answer_grams(k, parts, mass, k == order), PART), f"level{k}"))
    return out


def _scores(blocks: DataFrame, answers: list[DataFrame], model: Model, kind: str) -> DataFrame:
    parts, common, about = model.parts, model.common, (model.order, model.tokens, model.distinct, model.mass)
    work = lambda own, told: [Block(own, told, parts, common).scores(*about)]
    found = _by_block(answers, blocks, work, f"id {kind}, held boolean, row long, n_tokens long, n_known long, base_score double, score double")
    return found.groupBy("row", "id", "held").agg(*(F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score"))).drop("row")


def learned(docs: DataFrame, held: Column, order: int = ORDER, mass: float = MASS, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON) -> tuple[Model, DataFrame]:
    """A model of the texts that are not ``held``, and ``(id, held, n_tokens, n_known, base_score, score)`` of all.

    One row for each row of ``docs``. Null and empty texts are one token, the end. Null ids and repeated rows stay apart;
    without rows to learn from every token is unknown, with probability 1. Words are told apart by all their bytes, those over LONG by sha256.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    parts = max(PARTS, -(-size // SHARE))
    blocks = dealt(tokenised(docs, held, parts, order, id_col, text_col), "blocks", "block", 2 * parts)
    levels = _levels(blocks, parts, order, mass, common=common)
    about = levels[0].where("block < 0").agg(F.sum("tokens"), F.sum("entries")).first()
    model = Model(order, mass, parts, about[0] or 0, about[1] or 0, [x.where("block < 0") for x in levels], common)
    return model, _scores(blocks, levels, model, id_type(docs, id_col))


def scored(model: Model, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The scores of other documents by a model: ``(id, held, n_tokens, n_known, base_score, score)``, held of all true."""
    blocks = dealt(tokenised(docs, F.lit(True), model.parts, model.order, id_col, text_col), "blocks", "block", 2 * model.parts)
    return _scores(blocks, _levels(blocks, model.parts, model.order, model.mass, model, model.common), model, id_type(docs, id_col))


def op11_lm(spark, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents, learned from those whose crc32 of the id is not 2 modulo 7. One row for each
    row; a null or empty text has the end as its only token, a null id counts as the empty text, repeated rows stay."""
    docs = table(spark, sf_dir, "documents")
    model, found = learned(docs, one_in("doc_id", 7) == 2)
    return found.select(F.col("id").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
