"""Runs of repeated words: stretches that repeat a few words several times over, found by a suffix automaton.

A run is a stretch of consecutive words with smallest period q, words q apart being identical, of at least `exponent`
periods and `shortest` words, that no neighbouring word extends keeping period q. Words are what stands between the six
ASCII white characters; they are compared byte for byte.

The automaton of a stretch of words is built word by word. Its states pass the ends of their occurrences up the suffix
links, longest states first, the smaller of two ordered sets into the larger. A new pair of neighbouring ends e < f of a
state of length m with f - e <= m / (exponent - 1) says that the stretch from e - m + 1 to f has period f - e, and that it
can't begin earlier; the last f for the same begin and period ends the run. Each run shows itself so: its last end and
the end one period before are neighbours in the state where they first meet. A period that isn't the smallest one of its
stretch shows itself beside the smallest one, and goes.

Most words can't be in a run, so the automaton sees only what is left by two conditions that all words of a run meet:
each lies in a k-gram of words that its document repeats (k is 5 for four periods and six words), and each occurs
`exponent` times in its stretch. Neither needs other documents, so nothing is shuffled.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mnemolake.llm.common import id_and_text, map_batches, small_batches, string_buffers
from mnemolake.llm.words import U64, grams, mix, not_white, seeds, starts_of, words

EXPONENT, SHORTEST = 4, 6
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
#: Words that are joined at a time.
_TOGETHER = 1 << 16


class _Automaton:
    """Suffix automaton of a sequence of numbers. A state's first transition lies in two arrays, others in a dictionary."""

    def __init__(self, sequence: list[int]) -> None:
        self.length, self.link = array("q", [0]), array("q", [-1])
        self.own = array("q", [-1])  # the end that a state is made for; -1: a copy
        self._on, self._to, self._more = array("q", [-1]), array("q", [-1]), {}
        last = 0
        for end, c in enumerate(sequence):
            last = self._extend(last, c, end)

    def _state(self, length: int, link: int, own: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.own.append(own)
        self._on.append(-1)
        self._to.append(-1)
        return len(self.length) - 1

    def _extend(self, p: int, c: int, end: int) -> int:
        on, to, more, link = self._on, self._to, self._more, self.link
        new, q = self._state(end + 1, 0, end), -1
        while p >= 0:
            if on[p] == c:
                q = to[p]
                break
            if on[p] < 0:
                on[p], to[p] = c, new
            elif (rest := more.get(p)) is None:
                more[p] = {c: new}
            elif (there := rest.get(c)) is not None:
                q = there
                break
            else:
                rest[c] = new
            p = link[p]
        if q < 0:
            return new
        if self.length[q] != self.length[p] + 1:
            whole, q = q, self._state(self.length[p] + 1, link[q], -1)
            on[q], to[q] = on[whole], to[whole]
            if whole in more:
                more[q] = dict(more[whole])
            link[whole] = q
            while p >= 0:
                if on[p] == c:
                    if to[p] != whole:
                        break
                    to[p] = q
                elif (rest := more.get(p)) is not None and rest.get(c) == whole:
                    rest[c] = q
                else:
                    break
                p = link[p]
        link[new] = q
        return new


def _merged(large: list[int], small: list[int]) -> Iterator[tuple[int, int]]:
    """Puts `small` into `large`, both ordered, and tells the new neighbours, one from each; ends are negative, so that earlier ones,
    which come later, are appended."""
    if len(small) > 64 and len(small) * 16 > len(large):
        new = set(small)
        large += small
        large.sort()  # two ordered parts: one pass
        yield from ((a, b) for a, b in zip(large, large[1:]) if (a in new) != (b in new))
        return
    before = None
    for x in small:
        k = bisect_left(large, x)
        if k and large[k - 1] != before:
            yield large[k - 1], x
        if k < len(large):
            yield x, large[k]
        large.insert(k, x)
        before = x


def runs(sequence: list[int], exponent: int = EXPONENT, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers from 0 on, by start, then period."""
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    auto = _Automaton(sequence)
    length, link = auto.length, auto.link
    held: list[list[int] | None] = [[-e] if e >= 0 else None for e in auto.own]
    until: dict[tuple[int, int], int] = {}
    for v in np.argsort(-np.frombuffer(length, np.int64), kind="stable").tolist():
        small, held[v] = held[v], None
        up = link[v]
        m = length[up] if up > 0 else 0
        if small is None or m + m // (exponent - 1) < shortest:
            continue
        large = held[up]
        if large is None:
            held[up] = small
            continue
        if len(small) > len(large):
            small, large = large, small
        for f, e in _merged(large, small):
            period = e - f  # both negative
            if period * (exponent - 1) <= m and m + period >= shortest:
                key = (1 - e - m, period)
                until[key] = max(until.get(key, 0), 1 - f)
        held[up] = large
    out: list[tuple[int, int, int]] = []
    reach = {}
    for start, period in sorted(until):  # a smaller period that reaches as far is the stretch's own
        end = until[start, period]
        if end > reach.get(start, -1):
            reach[start] = end
            out.append((start, end - start, period))
    return out


def gram_size(exponent: int, shortest: int) -> int:
    """The longest k such that each k-gram of a run lies in the run a second time, a period away."""
    return max(1, min(max(shortest, exponent * q) - 2 * q + 1 for q in range(1, shortest + 1)))


def _stretches(marks: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
    return zip(edge[::2].tolist(), edge[1::2].tolist())


def candidates(hashes: np.ndarray, first: np.ndarray, exponent: int, shortest: int) -> Iterator[tuple[int, int]]:
    """Stretches of words within a text, all of them in k-grams that their text repeats. first: words before each text."""
    k = gram_size(exponent, shortest)
    at = starts_of(first, k)
    if not len(at):
        return
    text = np.searchsorted(first, at, side="right").astype(U64)
    key = mix(grams(hashes, k)[at] + text * seeds(1, 7)[0])
    order = np.argsort(key)
    again = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(hashes) + 1, np.int32)
    found = at[np.union1d(order[1:][again], order[:-1][again])]
    twice[found] += 1
    twice[found + k] -= 1
    covered = np.cumsum(twice)[:-1] > 0
    starts = np.zeros(len(hashes) + 1, bool)
    starts[first] = True
    for a, b in _stretches(covered):
        inner = (np.flatnonzero(starts[a + 1 : b]) + a + 1).tolist()
        yield from ((x, y) for x, y in zip([a, *inner], [*inner, b]) if y - x >= shortest)


def _frequent(names: np.ndarray, exponent: int, shortest: int, rounds: int = 3) -> Iterator[tuple[int, int]]:
    """Parts of a stretch whose numbers occur `exponent` times in them; after some rounds, what is left as it is."""
    todo = [(0, len(names), rounds)]
    while todo:
        a, b, left = todo.pop()
        _, place, times = np.unique(names[a:b], return_inverse=True, return_counts=True)
        enough = (times >= exponent)[place]
        if left == 0 or enough.all():
            yield a, b
        else:
            todo += [(a + x, a + y, left - 1) for x, y in _stretches(enough) if y - x >= shortest]


def _joined(data: memoryview, start: np.ndarray, end: np.ndarray, keep: np.ndarray | None) -> bytes:
    """The kept words of a text, one space between."""
    parts = [(0, len(start))] if keep is None else _stretches(keep)
    return b" ".join(b" ".join(bytes(data[start[i] : end[min(i + _TOGETHER, b) - 1]]).split()) for a, b in parts for i in range(a, b, _TOGETHER))


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = EXPONENT, shortest: int = SHORTEST) -> DataFrame:
    """Per row of df: doc_id, n_words, runs by start, then period, and the text collapsed.

    Collapsed, a text has its words joined by one space, without those that some run holds after its first period. A null
    text counts as empty: no words, no runs, an empty text. Rows with a null or a repeated id are rows of their own; other
    columns don't matter. A word of any length counts as one; a worker holds the automaton of one stretch at a time.
    """
    small_batches(df.sparkSession)
    is_word = not_white()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, raw = string_buffers(batch.column(1))
        data = memoryview(raw)
        start, end, hashes, first = words(offsets, raw, is_word)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in candidates(hashes, first, exponent, shortest):
            text = int(np.searchsorted(first, a, side="right")) - 1
            known: dict[bytes, int] = {}
            names = np.array([known.setdefault(bytes(data[x:y]), len(known)) for x, y in zip(start[a:b].tolist(), end[a:b].tolist())])
            for x, y in _frequent(names, exponent, shortest):
                found.setdefault(text, []).extend((a - int(first[text]) + x + s, n, q) for s, n, q in runs(names[x:y].tolist(), exponent, shortest))
        collapsed = []
        for text in range(batch.num_rows):
            a, b = int(first[text]), int(first[text + 1])
            keep = None
            if text in found:
                found[text].sort(key=lambda r: (r[0], r[2]))
                keep = np.ones(b - a, bool)
                for s, n, q in found[text]:
                    keep[s + q : s + n] = False
            collapsed.append(_joined(data, start[a:b], end[a:b], keep))
        listed = [found.get(i, []) for i in range(batch.num_rows)]
        flat = [pa.array([r[i] for own in listed for r in own], pa.int64()) for i in range(3)]
        struct = pa.StructArray.from_arrays(flat, ["start", "length", "period"])
        sizes = pa.array(np.concatenate([[0], np.cumsum([len(own) for own in listed])]), pa.int32())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(sizes, struct), pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return map_batches(id_and_text(df, id_col, text_col), run, SCHEMA)
