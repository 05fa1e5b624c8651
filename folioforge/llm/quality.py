"""Quality classifier on random-indexing word vectors.

Each word has a fixed sparse random index vector, made from its hash; its word vector
is the sum of its neighbours' index vectors over the whole corpus. Sums are kept in a
table dealt by hash, which grows with the vocabulary, and go back to each block of
documents that has the word. A document pools its words' vectors, and next to them how
much it repeats itself, in words and in classes of words: a short word stands for
itself, a longer one for its shape (runs of small letters, capitals, digits and signs).
A two-layer network in numpy is fitted on a bounded sample of labelled rows, and a
temperature on a part kept back makes its probabilities fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import give_back, id_type, one_in, settled, table, text_bytes

#: Classes of shapes, length of a vector, entries of an index vector that are not zero.
CLASSES, DIM, NONZERO = 1024, 48, 4
#: Words of up to so many bytes stand for themselves.
SHORT = 3
#: Most labelled rows that the network is fitted on (the first by a hash of the id), and hidden units.
FIT_ROWS, HIDDEN = 20_000, 32
#: Bytes worked on at once.
PART = 1 << 20
#: Bytes of text in a block at most (a longer text is a block of its own), and for each part of the table of words.
BLOCK, SHARE = 32 << 20, 8 << 20
#: Least number of parts, and turns in which a block counts its words' neighbours.
PARTS, TURNS = 48, 4
#: Entries of a word's sums that are over so much of their root mean square count in its vector, by their sign.
LEVEL = 0.5
EXTRA = 5

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
#: Small letters and all of other scripts are one kind, capitals one, digits one, each sign its own.
_KIND = np.arange(256)
_KIND[97:123] = _KIND[128:] = 97
_KIND[65:91] = 65
_KIND[48:58] = 48
_HASH = np.random.default_rng(10).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _groups(texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """Pieces of about PART bytes; a long text is cut after a separator where there is one."""
    some, size = [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = min(len(text), at + PART)
            if end < len(text):
                cut = max(text.rfind(s, at, end) for s in (b" ", b"\n", b"\t"))
                end = cut + 1 if cut > at else end
            if size + end - at > PART and some:
                yield some
                some, size = [], 0
            some.append((i, text[at:end]))
            size += end - at
            at = end
    if some:
        yield some


def words(pieces: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, class, hash) of each word of the pieces, in order."""
    b = np.frombuffer(b" ".join(x for _, x in pieces) + b" ", np.uint8)
    sep = _SEP[b]
    start = np.flatnonzero(~sep & np.r_[True, sep[:-1]])
    end = np.flatnonzero(sep & np.r_[False, ~sep[:-1]])
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    kind = _KIND[b]
    turn = np.r_[True, kind[1:] != kind[:-1]]
    turn[start] = True
    word = np.repeat(np.arange(len(start)), end - start)  # of each byte in a word
    inside = np.flatnonzero(~sep)
    place = inside - start[word]
    # each word's bytes, and the kinds of its runs, times powers by their place in the word
    def powers(n: int) -> np.ndarray:
        out = np.full(n + 1, _ODD)
        out[0] = 1
        return np.multiply.accumulate(out)

    power = powers(int(place.max()))
    whole = np.add.reduceat(_HASH[b[inside]] * power[place], np.flatnonzero(place == 0))
    first = inside[turn[inside]]
    at = word[turn[inside]]
    head = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    run = np.arange(len(at)) - np.repeat(head, np.diff(np.r_[head, len(at)]))
    shape = np.add.reduceat(_HASH[kind[first]] * power[run], head)
    h = _mixed(whole)
    token = np.where(end - start <= SHORT, h, _mixed(shape ^ _ODD))
    sizes = np.cumsum([len(x) + 1 for _, x in pieces])
    owner = np.array([i for i, _ in pieces])[np.searchsorted(sizes, start, side="right")]
    return owner, (token % np.uint64(CLASSES)).astype(np.int64), h


def measures(texts: list[bytes], heard: list | None = None) -> np.ndarray:
    """How texts repeat themselves: log length, share of words equal to the one before, chance that two words are of one
    class, share of distinct words, and mean letters a word. Zero without a word. ``heard`` gets (owner, hash) of the words."""
    n = len(texts)
    counts, equal, bytes_ = np.zeros((n, CLASSES), np.float32), np.zeros(n), np.array([len(x) for x in texts])
    seen: list[np.ndarray] = []
    for pieces in _groups(texts):
        owner, token, h = words(pieces)
        if not len(owner):
            continue
        if heard is not None:
            heard.append((owner, h))
        low = owner[0]
        counts[low : owner[-1] + 1] += np.bincount((owner - low) * CLASSES + token, minlength=(owner[-1] - low + 1) * CLASSES).reshape(-1, CLASSES)
        same = (owner[1:] == owner[:-1]) & (h[1:] == h[:-1])
        equal += np.bincount(owner[1:][same], minlength=n)
        # distinct words, to 2**40 of a hash with the text's place above it
        seen.append(np.unique(owner.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24)))
    distinct = np.bincount((np.unique(np.concatenate(seen)) >> np.uint64(40)).astype(np.int64), minlength=n) if seen else np.zeros(n)
    size = counts.sum(1)
    least = np.maximum(size, 1)
    share = counts / least[:, None]
    return (np.c_[np.log1p(size) / 5, equal / least, (share * share).sum(1), distinct / least, np.minimum(bytes_ / least, 50) / 10] * (size > 0)[:, None]).astype(np.float32)


@dataclass
class Network:
    """Standardised features, a hidden layer of tanh, a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 40, seed: int = 0) -> Network:
    """Adam on log loss with a little decay; a tenth of the rows is kept back for the temperature. Rows come in a fixed
    order, so a rerun gives the same network. Labels of one kind give a constant."""
    rng = np.random.default_rng(seed)
    x, y = x.astype(np.float64), y.astype(np.float64)
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(DIM + EXTRA), np.ones(DIM + EXTRA))
    d = len(mean)
    prior = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    net = Network(mean, scale, rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), np.zeros(hidden), float(prior))
    if len(y) < 20 or y.min() == y.max():
        return net
    order = rng.permutation(len(x))
    held, rows = order[: len(x) // 10], order[len(x) // 10 :]
    z = (x - mean) / scale
    params = [net.w1, net.b1, net.w2, np.array(net.b2)]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        rng.shuffle(rows)
        for at in range(0, len(rows), 256):
            i = rows[at : at + 256]
            h = np.tanh(z[i] @ params[0] + params[1])
            g = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30))) - y[i]) / len(i)
            gh = np.outer(g, params[2]) * (1 - h * h)
            t += 1
            for k, grad in enumerate((z[i].T @ gh + 1e-4 * params[0], gh.sum(0), h.T @ g + 1e-4 * params[2], g.sum())):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                params[k] = params[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3])
    logits = net.logits(x[held])

    def loss(temperature: float) -> float:
        s = logits / temperature
        return float(np.mean(np.logaddexp(0, s) - y[held] * s))

    net.temperature = float(min(np.exp(np.linspace(-1, 2.5, 141)), key=loss))
    return net


def _cells(h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, sign) of each entry of the words' index vectors that is not zero."""
    step = DIM // NONZERO
    for k in range(NONZERO):
        part = _mixed(h + np.uint64((k + 1) * int(_ODD) % (1 << 64)))
        yield k * step + (part >> np.uint64(33)).astype(np.int64) % step, np.where(part & np.uint64(1), 1, -1)


def keys(h: np.ndarray) -> np.ndarray:
    """What stands for words in the table: 48 bits of their hashes."""
    return h >> np.uint64(16)


def _numbered(x: np.ndarray, some: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, each value's place among them), with less memory than np.unique takes."""
    found, at = np.unique(x), np.empty(len(x), np.int32)
    for low in range(0, len(x), some):
        at[low : low + some] = np.searchsorted(found, x[low : low + some])
    return found, at


def contexts(owner: np.ndarray, h: np.ndarray, low: int = 0, high: int = 1 << 48) -> tuple[np.ndarray, np.ndarray]:
    """(distinct words' keys, from ``low`` to below ``high``; their sums): what follows and what precedes count in
    different places."""
    key = keys(h)
    here = np.flatnonzero((key >= np.uint64(low)) & (key < np.uint64(high))).astype(np.int32)
    found, at = _numbered(key[here])
    del key
    step, n = DIM // NONZERO, len(found)
    sums = np.zeros((n, DIM), np.int32)
    for turn, beside in ((0, 1), (1, -1)):  # what follows, what precedes
        same = np.flatnonzero((here + beside >= 0) & (here + beside < len(h)))
        same = same[owner[here[same] + beside] == owner[here[same]]]
        word, neighbour = at[same] * np.int64(step), h[here[same] + beside]
        del same
        for k, (place, sign) in enumerate(_cells(neighbour)):
            sums[:, (k * step + turn + np.arange(step)) % DIM] += np.bincount(word + (place - k * step), sign, n * step).reshape(n, step).astype(np.int32)
    return found, sums


def vectors_of(sums: np.ndarray) -> np.ndarray:
    """Word vectors of sums: -1, 0 or 1 in each place, by what is over LEVEL of the root mean square."""
    least = LEVEL * np.sqrt((sums.astype(np.float64) ** 2).mean(1, keepdims=True))
    return (sums > least).astype(np.int8) - (sums < -least).astype(np.int8)


def _squeezed(raw: bytes) -> bytes:
    return np.int64(len(raw)).tobytes() + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _restored(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int(np.frombuffer(data[:8], np.int64)[0]), asbytes=True)


def _planes(x: np.ndarray) -> bytes:
    """First bytes of all numbers, then second ones, and so on: alike bytes lie together."""
    return np.ascontiguousarray(x).reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _numbers(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


_TRITS = 3 ** np.arange(5)
_OF_TRITS = (np.arange(243)[:, None] // _TRITS % 3 - 1).astype(np.int8)
_WIDTH = -(-DIM // 5) * 5


def _packed(x: np.ndarray) -> bytes:
    """Rows of whole numbers, exactly: each in the least of four widths that holds it, compressed."""
    most = np.abs(x).max(1, initial=0)
    width = ((most > 1).astype(np.uint8) + (most > 127) + (most > 32767)).astype(np.uint8)
    least = np.zeros((int((width == 0).sum()), _WIDTH), np.int64)
    least[:, :DIM] = x[width == 0]
    trits = ((least + 1).reshape(-1, _WIDTH // 5, 5) @ _TRITS).astype(np.uint8)
    pieces = [width.tobytes(), trits.tobytes(), x[width == 1].astype(np.int8).tobytes(), _planes(x[width == 2].astype(np.int16)), _planes(x[width == 3].astype(np.int64))]
    return np.int32(len(x)).tobytes() + _squeezed(b"".join(pieces))


def _unpacked(data: bytes) -> np.ndarray:
    n, raw = int(np.frombuffer(data[:4], np.int32)[0]), _restored(data[4:])
    width = np.frombuffer(raw, np.uint8, n)
    sizes = np.bincount(width, minlength=4) * (_WIDTH // 5, DIM, 2 * DIM, 8 * DIM)
    _, trits, bytes_, shorts, longs = (raw[a:b] for a, b in zip(np.r_[0, n + np.r_[0, np.cumsum(sizes)[:-1]]].tolist(), (n + np.r_[0, np.cumsum(sizes)]).tolist(), strict=True))
    out = np.empty((n, DIM), np.int64)
    out[width == 0] = _OF_TRITS[np.frombuffer(trits, np.uint8)].reshape(-1, _WIDTH)[:, :DIM]
    out[width == 1] = np.frombuffer(bytes_, np.int8).reshape(-1, DIM)
    out[width == 2] = _numbers(shorts, np.int16).reshape(-1, DIM)
    out[width == 3] = _numbers(longs, np.int64).reshape(-1, DIM)
    return out


def _trits(x: np.ndarray) -> bytes:
    """Rows of -1, 0 and 1."""
    wide = np.ones((len(x), _WIDTH), np.uint8)
    wide[:, :DIM] = x + 1
    return _squeezed((wide.reshape(-1, 5) @ _TRITS.astype(np.uint8)).tobytes())


def _of(data: bytes) -> np.ndarray:
    return _OF_TRITS[np.frombuffer(_restored(data), np.uint8)].reshape(-1, _WIDTH)[:, :DIM]


def _rising(x: np.ndarray) -> bytes:
    """Numbers by their steps, which are small where they rise slowly."""
    return _squeezed(_planes(np.diff(x, prepend=x.dtype.type(0))))


def _risen(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(_numbers(_restored(data), kind), dtype=kind)


def _mark(found: np.ndarray) -> int:
    """A number for a set of words; that of a union is the exclusive or."""
    return int(np.bitwise_xor.reduce(found, initial=0).astype(np.uint64).view(np.int64))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, x)``, one row for each row of ``docs``: the mean of the unit vectors of its words, then its
    ``measures``. A null or empty text and one without a word have zeros.

    Documents come in blocks of up to BLOCK bytes. A block sends its distinct words and their sums to the parts of the
    table of words; a part adds them up and sends each block the vectors, over the whole corpus, of the words it asked
    with. All sums are whole numbers, so any order gives the same.
    """
    kind = id_type(docs, id_col)
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = max(PARTS, -(-(read.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARE))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, list[bytes]]]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            if held and size + batch.column(1).nbytes > BLOCK:
                ids, texts = pa.concat_arrays([b.column(0) for b in held]), [t for b in held for t in text_bytes(b.column(1))]
                number, held, size = number + 1, [], 0
                yield number, ids, texts
                del texts
            if batch.num_rows:
                held.append(batch)
                size += batch.column(1).nbytes
        if held:
            ids, texts = pa.concat_arrays([b.column(0) for b in held]), [t for b in held for t in text_bytes(b.column(1))]
            held.clear()
            yield number + 1, ids, texts

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, texts in blocks(batches):
            owner, h = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
            for pieces in _groups(texts):
                of, _, x = words(pieces)
                owner.append(of.astype(np.int32))
                h.append(x)
            texts.clear()
            owner, h = np.concatenate(owner), np.concatenate(h)
            if not len(h):
                continue
            for turn in range(TURNS):
                found, sums = contexts(owner, h, (turn << 48) // TURNS, (turn + 1 << 48) // TURNS)
                if not len(found):
                    continue
                part = ((found >> np.uint64(16)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)  # in order, as the words
                cut = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
                spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
                yield pa.record_batch(
                    [pa.array(part[cut[:-1]]), pa.array(np.full(len(spans), block)), pa.array(np.full(len(spans), turn, np.int32)), pa.array([_rising(found[a:b]) for a, b in spans], pa.binary()), pa.array([_packed(sums[a:b]) for a, b in spans], pa.binary())],
                    names=["part", "block", "turn", "words", "sums"],
                )
                del found, sums
            del owner, h
            give_back()

    def answer(group: pa.Table) -> pa.Table:
        asked, sums = [_risen(x, np.uint64) for x in group["words"].to_pylist()], group["sums"].to_pylist()
        found, at = np.unique(np.concatenate(asked), return_inverse=True)
        total, cut = np.zeros((len(found), DIM), np.int64), np.cumsum([0, *(len(x) for x in asked)])
        for i, x in enumerate(sums):  # a block's words are distinct
            total[at[cut[i] : cut[i + 1]]] += _unpacked(x)
        vectors = vectors_of(total)
        out = [_trits(vectors[at[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table({"block": group["block"], "part": group["part"], "turn": group["turn"], "mark": pa.array([_mark(x) for x in asked], pa.int64()), "vectors": pa.array(out, pa.binary())})

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block: ids, the further features, and (how often each word, number of words of each text,
        their ranks by how often, how often in the text)."""
        for block, ids, texts in blocks(batches):
            about, owners, hashes, n = [], [], [], len(texts)
            for low in range(0, n, 1024):
                heard: list[tuple[np.ndarray, np.ndarray]] = []
                about.append(measures(texts[low : low + 1024], heard))
                owners += [(o + low).astype(np.int32) for o, _ in heard]
                hashes += [keys(h) for _, h in heard]
            texts.clear()
            owner, h = (np.concatenate(owners), np.concatenate(hashes)) if owners else (np.zeros(0, np.int32), np.zeros(0, np.uint64))
            del owners, hashes
            found, at = _numbered(h)
            del h
            often = np.bincount(at, minlength=len(found))
            rank = np.empty(len(found), np.int32)
            rank[np.argsort(-often, kind="stable")] = np.arange(len(found))  # the commonest words get the least numbers
            pair = owner * np.int64(max(len(found), 1))
            pair += rank[at]
            del owner, at
            pair, times = np.unique(pair, return_counts=True)
            of, place = np.divmod(pair, max(len(found), 1))
            csr = [_squeezed(_planes(often.astype(np.int32))), _squeezed(_planes(np.bincount(of, minlength=n).astype(np.int32))), _rising(place.astype(np.int32)), _squeezed(_planes(times.astype(np.int32)))]
            yield pa.record_batch([pa.array([block]), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids), pa.array([np.concatenate(about).tobytes()], pa.binary()), pa.array([csr], pa.list_(pa.binary())), pa.array([_mark(found)], pa.int64())], names=["block", "ids", "measures", "csr", "mark"])
            give_back()

    def pool(answers: pa.Table, own: pa.Table) -> pa.Table:
        if own.num_rows != 1 or np.bitwise_xor.reduce(answers["mark"].to_numpy(), initial=0) != own["mark"][0].as_py():
            raise RuntimeError("the documents changed between two reads")
        ids = own["ids"].combine_chunks().flatten()
        n = len(ids)
        about = np.frombuffer(own["measures"][0].as_py(), np.float32).reshape(n, EXTRA)
        often, size, place, times = own["csr"][0].as_py()
        often, size, place, times = _numbers(_restored(often), np.int32), _numbers(_restored(size), np.int32), _risen(place, np.int32), _numbers(_restored(times), np.int32)
        mean = np.zeros((n, DIM), np.float32)
        if len(place):
            vec = np.concatenate([_of(x) for x in answers.sort_by([("part", "ascending"), ("turn", "ascending")])["vectors"].to_pylist()])[np.argsort(-often, kind="stable")]
            one = (1 / np.sqrt(np.maximum(np.count_nonzero(vec, axis=1), 1))).astype(np.float32)  # to unit length
            edge = np.r_[0, np.cumsum(size)]
            for low in range(0, n, 256):
                here = np.flatnonzero(size[low : low + 256]) + low
                if len(here):
                    a, b = edge[low], edge[min(low + 256, n)]
                    mean[here] = np.add.reduceat(vec[place[a:b]] * (times[a:b].astype(np.float32) * one[place[a:b]])[:, None], edge[here] - a) / np.add.reduceat(times[a:b], edge[here] - a)[:, None]
        x = np.concatenate([mean, about], axis=1)
        return pa.table({"id": ids, "x": pa.array([r.tobytes() for r in x], pa.binary())})

    asked = read.mapInArrow(ask, "part long, block long, turn int, words binary, sums binary")
    answers = asked.groupBy("part").applyInArrow(answer, "block long, part long, turn int, mark long, vectors binary")
    own = read.mapInArrow(held, f"block long, ids array<{kind}>, measures binary, csr array<binary>, mark long")
    return answers.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(pool, f"id {kind}, x binary")


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> tuple[DataFrame, Network]:
    """Features of all documents, and a network from at most ``most`` labelled ones, crc32(doc_id) mod 5 = 0 left out."""
    found = settled(features(docs), "features")
    some = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (one_in("doc_id", 5) != 0)).groupBy(F.col("doc_id").alias("id_")).agg(F.max("quality").cast("int").alias("y")).orderBy(F.xxhash64("id_"), "id_").limit(most)
    rows = found.join(F.broadcast(some), found.id == F.col("id_")).groupBy("id", "y").agg(F.min("x").alias("x")).select("id", "y", "x").toArrow()
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(-1, DIM + EXTRA)
    order = np.argsort([f"{i}" for i in rows["id"].to_pylist()], kind="stable") if len(x) else np.zeros(0, np.int64)
    return found, train(x[order], rows["y"].to_numpy()[order])


def judged(found: DataFrame, network: Network) -> DataFrame:
    """``(id, score)`` from ``features``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(batch.num_rows, -1)
            yield pa.record_batch([batch.column(0), pa.array(network(x))], names=["id", "score"])

    return found.select("id", "x").mapInArrow(run, f"id {id_type(found, 'id')}, score double")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of each document: 0 to 1, with a verdict at 0.3. One row for each row of documents; null and empty texts
    have the score of zero features."""
    docs = table(spark, sf_dir, "documents")
    out = judged(*fit(docs, table(spark, sf_dir, "labels")))
    return out.select(F.col("id").alias("doc_id"), (one_in("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
