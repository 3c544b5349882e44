"""Words of many texts at once: places and 64-bit hashes, computed on Arrow's bytes with numpy."""

from __future__ import annotations

import numpy as np

#: Bytes that are looked at together; a text that is longer is cut between words.
SLICE = 2 << 20
_BASE = 0x9E3779B97F4A7C15
U64 = np.uint64

#: The six bytes of ASCII white space; in UTF-8 they occur in no other character.
WHITE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(_BASE) + U64(seed)) | U64(1)


def not_white() -> np.ndarray:
    out = np.ones(256, bool)
    out[list(WHITE)] = False
    return out


def lower_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)
#: Words that are hashed together.
_TOGETHER = 1 << 17


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, *which: int) -> list[np.ndarray]:
    """For each seed a hash of each span of some bytes: the sum of its numbers of eight bytes, each mixed with its place,
    mixed again.

    Other seeds give independent hashes. A span's bytes pass a bijection that isn't linear before they are added, so
    strings that defeat polynomials with powers of two for a modulus don't meet here."""
    padded = np.empty(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    padded[len(data) :] = 0
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    places = [np.array([(seed * 0x632BE59BD9B4E019 + _BASE) % (1 << 64)], U64) for seed in which]
    out = [np.empty(len(start), U64) for _ in which]
    for at in range(0, len(start), _TOGETHER):
        s = start[at : at + _TOGETHER]
        size = end[at : at + _TOGETHER] - s
        value = eight[s] & _MASK[np.minimum(size, 8)]
        totals = [mix(value ^ mix(p)) for p in places]
        long = np.flatnonzero(size > 8)
        if len(long):
            more = (size[long] - 1) >> 3  # numbers after the first
            for part in _parts(more):
                own, n = long[part], more[part]
                begin = np.cumsum(n) - n
                j = np.arange(1, int(n.sum()) + 1) - np.repeat(begin, n)
                value = eight[np.repeat(s[own], n) + 8 * j]
                value[begin + n - 1] &= _MASK[size[own] - 8 * n]
                for total, p in zip(totals, places):
                    total[own] += np.add.reduceat(mix(value ^ mix(j.astype(U64) * U64(_BASE) + p)), begin)
        for x, total in zip(out, totals):
            x[at : at + _TOGETHER] = mix(total + size.astype(U64) * U64(_BASE))
    return out


def _parts(n: np.ndarray, most: int = 1 << 16):
    """Slices of consecutive spans of together about `most` numbers; one span is never cut."""
    upto, at = np.cumsum(n), 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
        yield slice(at, to)
        at = to


def words(offsets: np.ndarray, data: np.ndarray, is_word: np.ndarray, fold: np.ndarray | None = None, seed: int = 1):
    """Start and end (bytes) of each word of texts that lie one after another, its hash, and per text the number of words before it.

    A word is a longest run of bytes of `is_word` in one text. `fold` maps bytes before hashing.
    """
    begin, end = int(offsets[0]), int(offsets[-1])
    parts = []
    at = begin
    while at < end:
        to = min(at + SLICE, end)
        if to < end and is_word[data[to - 1]]:  # cut between words
            back = np.flatnonzero(~is_word[data[at:to]])
            if len(back):
                to = at + int(back[-1]) + 1
            else:
                step = to
                while step < end:
                    ahead = np.flatnonzero(~is_word[data[step : step + SLICE]])
                    if len(ahead):
                        step += int(ahead[0])
                        break
                    step = min(step + SLICE, end)
                to = step
        parts.append(_slice(data[at:to], at, offsets, is_word, fold, seed))
        at = to
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    start, stop, h = (np.concatenate(x) for x in zip(*parts))
    return start, stop, h, np.searchsorted(start, offsets)


def _slice(a: np.ndarray, base: int, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray | None, seed: int):
    if fold is not None:
        a = fold[a]
    ok = is_word[a]
    starts, ends = ok.copy(), ok.copy()
    starts[1:] &= ~ok[:-1]
    ends[:-1] &= ~ok[1:]
    inner = offsets[np.searchsorted(offsets, base, side="right") : np.searchsorted(offsets, base + len(a))] - base
    starts[inner] = ok[inner]  # a text's first byte starts a word, and ends the one before
    ends[inner - 1] = ok[inner - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s + base, e + base, span_hashes(a, s, e, seed)[0]


def grams(h: np.ndarray, k: int, seed: int = 2) -> np.ndarray:
    """Hash of each k consecutive hashes (across texts too: the caller leaves those out)."""
    n = max(0, len(h) - k + 1)
    total = np.zeros(n, U64)
    for i, r in enumerate(seeds(k, seed)):
        total += h[i : i + n] * r
    return mix(total)


def starts_of(first: np.ndarray, k: int) -> np.ndarray:
    """Positions where a k-gram starts that stays in its text. first: words before each text, and in all at the end."""
    n = int(first[-1])
    ok = np.ones(n, bool)
    for i in range(1, k):
        ok[np.maximum(first[1:] - i, first[:-1])[first[1:] - i >= first[:-1]]] = False
    return np.flatnonzero(ok)
