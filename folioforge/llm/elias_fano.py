"""Rising whole numbers in Elias-Fano code, and levels of a trie made of them.

A level is one string of bytes: contexts, pointers to their first entry, words and
counts as rising sequences, and the entries' probabilities in 16 bits. It is read
through a memory map; a search decodes only the runs of RUN numbers that it needs.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

#: Numbers of a run, which has a code of its own.
RUN = 1 << 14
#: Steps of a decade in which probabilities are kept, as the nearest: off by less than 0.03 %. What is not there has ABSENT.
STEPS, ABSENT = 4000, 65535


def _aligned(parts: list[bytes]) -> bytes:
    return b"".join(p + b"\0" * (-len(p) % 8) for p in parts)


def encoded(x: np.ndarray) -> bytes:
    """A sequence that never falls, of numbers under 2**63."""
    x = x.astype(np.int64)
    runs, width, sizes = [], [], [0]
    for at in range(0, len(x), RUN):
        rest = x[at : at + RUN] - x[at]
        n = len(rest)
        low = max(0, int(int(rest[-1]) // n).bit_length() - 1)
        high = (rest >> low) + np.arange(n)
        bits = np.zeros(int(high[-1]) + 1, np.uint8)
        bits[high] = 1
        lows = ((rest[:, None] >> np.arange(low)) & 1).astype(np.uint8)
        runs.append(np.packbits(lows.ravel(), bitorder="little").tobytes() + np.packbits(bits, bitorder="little").tobytes())
        width.append(low)
        sizes.append(sizes[-1] + len(runs[-1]))
    return _aligned([np.int64(len(x)).tobytes(), x[::RUN].tobytes(), np.array(sizes, np.int64).tobytes(), np.array(width, np.uint8).tobytes(), b"".join(runs)])


class Sequence:
    """A sequence in its code, over bytes that may be a memory map."""

    def __init__(self, data: np.ndarray):
        self.n = int(data[:8].view(np.int64)[0])
        k = -(-self.n // RUN)
        self.firsts = data[8 : 8 + 8 * k].view(np.int64)
        self.at = data[8 + 8 * k : 16 + 16 * k].view(np.int64)
        self.width = data[16 + 16 * k : 16 + 17 * k]
        self.data = data[16 + 16 * k + k + -k % 8 :]

    def run(self, r: int) -> np.ndarray:
        n, low = min(RUN, self.n - r * RUN), int(self.width[r])
        code = self.data[self.at[r] : self.at[r + 1]]
        cut = (n * low + 7) // 8
        out = np.flatnonzero(np.unpackbits(code[cut:], bitorder="little"))[:n] - np.arange(n) << low
        if low:
            out |= np.unpackbits(code[:cut], count=n * low, bitorder="little").reshape(n, low) @ (1 << np.arange(low, dtype=np.int64))
        return out + self.firsts[r]

    def take(self, places: np.ndarray) -> np.ndarray:
        """Numbers at places that never fall."""
        out = np.empty(len(places), np.int64)
        cut = np.searchsorted(places, np.arange(0, self.n + RUN, RUN))
        for r in np.flatnonzero(np.diff(cut)).tolist():
            out[cut[r] : cut[r + 1]] = self.run(r)[places[cut[r] : cut[r + 1]] - r * RUN]
        return out

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, number) of the first that is ``x`` or more, for x that never fall; the last place plus one, and -1,
        where there is none."""
        place, found = np.full(len(x), self.n), np.full(len(x), -1, np.int64)
        if not self.n:
            return place, found
        of = np.maximum(np.searchsorted(self.firsts, x, "left") - 1, 0)
        cut = np.searchsorted(of, np.arange(len(self.firsts) + 1))
        for r in np.flatnonzero(np.diff(cut)).tolist():
            values = self.run(r)
            if r + 1 < len(self.firsts):
                values = np.append(values, self.firsts[r + 1])
            at = np.searchsorted(values, x[cut[r] : cut[r + 1]], "left")
            there = at < len(values)
            place[cut[r] : cut[r + 1]][there] = at[there] + r * RUN
            found[cut[r] : cut[r + 1]][there] = values[at[there]]
        return place, found


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(p) * STEPS), 0, ABSENT - 1).astype(np.uint16)


def probability(code: np.ndarray) -> np.ndarray:
    return np.where(code == ABSENT, 0.0, 10.0 ** (-code.astype(np.float64) / STEPS))


def level(context: np.ndarray, word: np.ndarray, count: np.ndarray, p: np.ndarray) -> bytes:
    """A level from entries in order of context and word. Words of a context are kept relative to the last one before it,
    so that all of a level's words make one rising sequence."""
    head = np.flatnonzero(np.diff(context, prepend=-1))
    last = word[np.append(head[1:], len(word)) - 1] if len(word) else word
    base = np.cumsum(np.append(0, last + 1)[:-1]) if len(word) else word
    sizes = np.diff(np.append(head, len(word)))
    parts = [encoded(context[head]), encoded(np.append(head, len(word))), encoded(word + np.repeat(base, sizes)), encoded(np.cumsum(np.append(0, count))), quantised(p).tobytes()]
    return _aligned([np.array([len(x) for x in parts], np.int64).tobytes(), *parts])


class Level:
    """A level under a memory map of a file without a name, which goes with it."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            all_ = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), np.uint8)
        sizes = all_[:40].view(np.int64)
        edge = 40 + np.cumsum(np.append(0, sizes + -sizes % 8))
        parts = [all_[a : a + n] for a, n in zip(edge[:-1].tolist(), sizes.tolist(), strict=True)]
        self.contexts, self.pointers, self.words, self.counts = (Sequence(x) for x in parts[:4])
        self.codes = parts[4].view(np.uint16)

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place of each entry, or -1; pairs come in order. The context's pointers bound its words; the word searched is
        the successor of itself on top of what comes before the context."""
        out = np.full(len(context), -1, np.int64)
        j, found = self.contexts.successor(context)
        here = np.flatnonzero(found == context)
        if not len(here):
            return out
        j = j[here]
        low, high = self.pointers.take(j), self.pointers.take(j + 1)
        base = np.where(low > 0, self.words.take(np.maximum(low - 1, 0)) + 1, 0)
        x = base + word[here]
        inside = x <= self.words.take(high - 1)
        here, x = here[inside], x[inside]
        place, found = self.words.successor(x)
        out[here[found == x]] = place[found == x]
        return out

    def count(self, places: np.ndarray) -> np.ndarray:
        return self.counts.take(places + 1) - self.counts.take(places)
