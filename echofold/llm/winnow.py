"""Content-anchored groups of windows: the part that the exact substring operators share.

A text is a sequence of symbols (bytes or words).  Every window of `window` symbols has an anchor: the place, within the
window, of the smallest hash of `core` consecutive symbols (the leftmost of equal ones).  The anchor depends on the window's content alone, so
equal windows have equal anchors at equal offsets, wherever they stand.  Neighbouring windows that share an anchor form one
group.  A group is known by its anchor's hash and by a 128-bit BLAKE2b digest of its whole content (its variant).  Two
windows can only be equal if their groups have the same anchor hash; if the digests agree too, whole groups are equal, and
only anchors with several variants need a look at their content.  The anchor is only where groups meet: a collision of anchors costs
a comparison, never a wrong answer.

All arithmetic is on unsigned 64-bit integers, which numpy wraps.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import chain, compress

import numpy as np

BASE_1, BASE_2 = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
POSITION_BITS = 24


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


def powers(base: int, n: int) -> np.ndarray:
    size = 1 << max(12, (n - 1).bit_length())
    return _powers(base, size)[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def byte_values(seed: int) -> np.ndarray:
    """A 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(seed | 1))


class Prefix:
    """Polynomial hashes of any spans of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, base: int):
        self.base, n = base, len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(base, n) if n else values, out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """mix() of each span's polynomial and length."""
        back = powers(inverse(self.base), len(self.sums))
        return mix((self.sums[end] - self.sums[start]) * back[start] + (end - start).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))

    def rolling(self, size: int) -> np.ndarray:
        """The hash of every span of the given size."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[size:] - self.sums[:n]) * powers(inverse(self.base), n))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    if rest := width - have:
        x = np.minimum(x[:-rest], x[rest:])
    return x


def groups(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, core: int) -> dict[str, np.ndarray]:
    """Groups of windows of texts that stand one after another: text, first (its first window, from the text's start), n (windows),
    offset (of the anchor from there), anchor (signed 64-bit).

    values: 64-bit values of the symbols; text k is values[starts[k]:ends[k]].
    """
    empty = {k: np.zeros(0, np.int64) for k in ("text", "first", "n", "offset", "anchor")}
    total = len(values)
    if total < window:
        return empty
    if total >= 1 << POSITION_BITS:
        raise ValueError("too many symbols at once")
    cores = Prefix(values, BASE_1).rolling(core)
    low = np.uint64((1 << POSITION_BITS) - 1)
    keyed = (cores & ~low) | np.arange(len(cores), dtype=np.uint64)
    at = (sliding_min(keyed, window - core + 1) & low).astype(np.int64)
    n = len(at)  # windows: total - window + 1
    valid = np.zeros(n + 1, np.int32)
    has = ends - starts >= window
    np.add.at(valid, starts[has], 1)
    np.add.at(valid, np.minimum(ends[has] - window + 1, n), -1)
    valid = np.cumsum(valid)[:n] > 0
    begins = valid.copy()
    first_of_text = np.zeros(n, bool)
    first_of_text[starts[has]] = True
    begins[1:] &= ~valid[:-1] | (at[1:] != at[:-1]) | first_of_text[1:]
    a = np.flatnonzero(begins)
    if not len(a):
        return empty
    stop = np.concatenate(([0], np.cumsum(valid)))
    edge = np.append(a[1:], n)
    size = stop[edge] - stop[a]
    text = np.searchsorted(starts[has], a, side="right") - 1
    return {"text": np.flatnonzero(has)[text], "first": a - starts[has][text], "n": size, "offset": at[a] - a, "anchor": cores[at[a]].view(np.int64)}


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of `size` places lie in any span [start, end)."""
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, np.minimum(starts, size), 1)
    np.add.at(edges, np.minimum(ends, size), -1)
    return np.cumsum(edges[:size]) > 0


def byte_class(test) -> np.ndarray:
    return np.array([bool(test(b)) for b in range(256)])


#: Not in words [^ x20 x09-x0D]+.
WHITE = byte_class(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
#: Not in words of digits, a-z and everything beyond ASCII, once FOLD has lower-cased A-Z.
SIGNS = byte_class(lambda b: b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F)
FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


class WordSpans:
    """Where words stand in texts given as UTF-8, side by side; for the features of classifiers."""

    def __init__(self, texts: list[bytes], blank: np.ndarray = WHITE, fold: np.ndarray | None = None):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.raw = raw if fold is None else fold[raw]
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.offset = np.concatenate(([0], np.cumsum(size)))
        edge = np.diff(blank[self.raw].view(np.int8), prepend=1)
        self.begin, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        cut = np.searchsorted(self.begin, self.offset)
        self.first, self.last = cut[:-1], cut[1:]  # the words of each text

    def values(self) -> np.ndarray:
        """A 64-bit value of each word, good enough to tell the words of one line apart."""
        return Prefix(byte_values(0x5851F42D4C957F2D)[self.raw], BASE_2).spans(self.begin, self.end)


#: Separators of words as bytes.translate tables: bytes.split() then cuts at spaces.  PLAIN_WORDS is None, as split() alone knows
#: the words [^ x20 x09-x0D]+.  FOLDED_WORDS: runs of digits, letters in lower case and everything beyond ASCII.
PLAIN_WORDS = None
FOLDED_WORDS = bytes(0x20 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def digests(content: Iterable[bytes]) -> np.ndarray:
    """128-bit BLAKE2b digests as rows of two signed 64-bit integers."""
    return np.frombuffer(b"".join([blake2b(c, digest_size=16).digest() for c in content]), "<i8").reshape(-1, 2)


#: Longer words are hashed one by one.
LONG_WORD = 64
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(line: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: eight bytes at a time are mixed into what came before, so no algebra tells which spans collide."""
    view = np.ndarray((len(line) + 1,), "<u8", line + bytes(8), strides=(1,))
    size = end - begin
    out = mix(size.astype(np.uint64) * np.uint64(BASE_1))
    active = np.flatnonzero(size <= LONG_WORD)
    at, left = begin[active], size[active]
    while len(active):
        out[active] = mix(out[active] * np.uint64(BASE_2) ^ (view[at] & MASKS[np.minimum(left, 8)]))
        more = left > 8
        active, at, left = active[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = int.from_bytes(blake2b(line[begin[k] : end[k]], digest_size=8).digest(), "little")
    return out


class Words:
    """Words of texts given as UTF-8, side by side: text k has the words first[k] to last[k] - 1 of all."""

    def __init__(self, texts: list[bytes], separators: bytes | None = PLAIN_WORDS):
        self.texts = texts
        self.lists = [t.split() for t in texts] if separators is None else [t.translate(separators).split() for t in texts]
        self.last = np.cumsum(np.fromiter(map(len, self.lists), np.int64, len(self.lists)))
        self.first = np.concatenate(([0], self.last[:-1])) if len(texts) else self.last
        self.line = b" ".join(chain.from_iterable(self.lists))
        spaces = np.flatnonzero(np.frombuffer(self.line, np.uint8) == 0x20)
        n = int(self.last[-1]) if len(texts) else 0
        self.begin, self.end = np.concatenate(([0], spaces + 1))[:n], np.concatenate((spaces, [len(self.line)]))[:n]

    def values(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return word_hashes(self.line, self.begin, self.end)

    def content(self, first: np.ndarray, end: np.ndarray) -> Iterator[bytes]:
        """Spans of words, joined by single spaces."""
        return (self.line[i:j] for i, j in zip(self.begin[first].tolist(), self.end[end - 1].tolist(), strict=True))

    def kept(self, k: int, keep: np.ndarray) -> bytes:
        """The kept words of text k, joined by single spaces."""
        return b" ".join(compress(self.lists[k], keep.tolist()))


def blocks(starts: np.ndarray, ends: np.ndarray, window: int, limit: int = 1 << 19):
    """Texts (or, of longer ones, overlapping parts) in blocks of about `limit` symbols: arrays text, start, end for each block."""
    text, first, last = [], [], []
    room = limit
    for k, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if e - s < window:
            continue
        while True:
            stop = min(e, s + limit)
            text.append(k)
            first.append(s)
            last.append(stop)
            room -= stop - s
            if room <= 0:
                yield np.array(text), np.array(first), np.array(last)
                text, first, last, room = [], [], [], limit
            if stop == e:
                break
            s = stop - window + 1
    if text:
        yield np.array(text), np.array(first), np.array(last)


def all_groups(values, starts: np.ndarray, ends: np.ndarray, window: int, core: int, limit: int = 1 << 19):
    """groups() of any number of texts of any length, block by block.  values: an array, or a function of a slice."""
    for text, first, last in blocks(starts, ends, window, limit):
        a, b = first[0], last[-1]
        g = groups(values[a:b] if isinstance(values, np.ndarray) else values(a, b), first - a, last - a, window, core)
        part = g["text"]
        g["at"] = g["first"] + first[part]  # the first window among all symbols
        g["first"] = g["first"] + (first - starts[text])[part]
        g["text"] = text[part]
        yield g
