"""Line deduplication by a segment-partition edit join.

Lines within an edit distance of the threshold share one of threshold + 1 segments: a line is indexed by its segments
under its length, and probes the indexes of its own and of shorter lengths with its substrings at the places an edit
can move a segment to. Lines that meet are verified with a banded bit-parallel edit distance.

1. Rows are gathered in batches, which ask each other (see `asking`) which of their distinct lines are the first of all.
2. Batches ask which segments and probes of those lines others have too. Only lines with such keys leave their batch,
   once, with their content; keys without a partner aren't shuffled as rows. The packed batches themselves are, where
   the answers are joined to them.
3. Lines of one key are compared in pairs. A key that more than BUCKET lines have (hot) is compared block against block
   in tasks of their own; a pair is looked at only under the smallest hot key that it shares, and only the later lines
   leave a task. The work on a hot key still grows with the square of its distinct lines.
4. The later lines of near pairs are told to all batches, which write their rows without them.

A line is what stands between line feeds; distances count bytes of UTF-8, or code points. One edit is allowed for each
LEAST of the shorter line, up to the threshold. Only lines of LEAST or more are compared by distance; equal lines are
found at any length, by two independent hashes of 64 bits. Of the places of a line the first (by doc_id, null first,
then by line) stays, unless an earlier different line is near; other places go. Empty lines always stay.

Nulls and empty texts have no lines to remove. Rows that repeat doc_id and text are one document and treated alike; of
rows that repeat a doc_id with different texts the one whose text hashes lowest counts as earlier. A line of any
frequency and length is an entry for each batch. An empty table gives an empty result. Extra columns, of whatever name,
stay as they are in `rest.row` with keep_rows, else they are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolake.llm import asking
from mnemolake.llm.common import discard, map_batches, materialize, small_batches, string_buffers
from mnemolake.llm.words import U64, mix, span_hashes

#: Edits, the shortest lines that are compared by distance, and the lines of a segment that are compared in pairs.
THRESHOLD, LEAST, BUCKET = 1, 24, 48
#: Edits that the query and the pipeline allow in long lines, and the lines in a block of a hot segment.
EDITS, BLOCK = 4, 1024
#: More edits don't fit the band's bits.
MOST_EDITS = 15


def edits(length: int, threshold: int, least: int) -> int:
    """Edits allowed between a line of a length and one that is as long or longer."""
    return min(threshold, length // max(1, least))


def within(a: bytes | str, b: bytes | str, most: int) -> bool:
    """Whether the edit distance is `most` at most: bit d of a state is diagonal d of the band, one state for each
    number of edits, all diagonals stepped at once."""
    if abs(len(a) - len(b)) > most:
        return False
    low, high = 0, min(len(a), len(b))
    while low < high:  # what both begin with needs no edits
        at = (low + high + 1) // 2
        low, high = (at, high) if a[low:at] == b[low:at] else (low, at - 1)
    a, b = a[low:], b[low:]
    m, n = len(a), len(b)
    width, full = 2 * most + 1, (1 << (2 * most + 1)) - 1
    # state e: diagonals (j - i + most) that i bytes of a and j of b reach with e edits
    state = [0] * (most + 1)
    state[0] = 1 << most
    for e in range(1, most + 1):
        state[e] = state[e - 1] | state[e - 1] << 1 & full
    pad = "\0" if isinstance(b, str) else b"\0"
    padded = pad * most + b + pad * (2 * most + 1)
    for i, c in enumerate(a):
        match, band = 0, padded[i : i + width]
        for d in range(width):
            if band[d] == c and 0 <= i + d - most < n:
                match |= 1 << d
        old, state[0] = state[0], state[0] & match
        for e in range(1, most + 1):
            was = state[e]
            state[e] = (was & match | old | old >> 1 | state[e - 1] << 1) & full
            old = was
        if not state[most]:
            return False
    return bool(state[most] >> (n - m + most) & 1)


def _trimmed(a: bytes | str, b: bytes | str) -> tuple[bytes | str, bytes | str]:
    """Without what both begin and end with, which needs no edits."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        at = (low + high + 1) // 2
        low, high = (at, high) if a[low:at] == b[low:at] else (low, at - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        at = (low + high + 1) // 2
        low, high = (at, high) if a[len(a) - at : len(a) - low] == b[len(b) - at : len(b) - low] else (low, at - 1)
    return a[: len(a) - low], b[: len(b) - low]


def _codes(lines: list[bytes] | list[str]) -> list[np.ndarray]:
    if lines and isinstance(lines[0], str):
        flat = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    else:
        flat = np.frombuffer(b"".join(lines), np.uint8).astype(np.uint32)
    return np.split(flat, np.cumsum([len(x) for x in lines])[:-1])


def within_all(a: list, b: list, most: list[int]) -> np.ndarray:
    """within() for many pairs: the bands of all step together."""
    out, rest = np.zeros(len(a), bool), []
    for k, (x, y, m) in enumerate(zip(a, b, most)):
        if abs(len(x) - len(y)) > m:
            continue
        x, y = _trimmed(x, y)
        if max(len(x), len(y)) <= m:
            out[k] = True
        elif x and y:
            rest.append((len(x), k, x, y, m))
    rest.sort(key=lambda r: r[:2])
    at = 0
    while at < len(rest):
        to = at + 1
        while to < len(rest) and to - at < 4096 and (to - at) * rest[to][0] < 1 << 20:
            to += 1
        part = rest[at:to]
        out[[r[1] for r in part]] = _banded(_codes([r[2] for r in part]), _codes([r[3] for r in part]), np.array([r[4] for r in part]))
        at = to
    return out


def _banded(a: list[np.ndarray], b: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """within() of pairs whose first strings are in order of their lengths; the states are those of within()."""
    k, pairs = int(most.max()), len(a)
    m, n = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    left, right = np.full((pairs, int(m[-1])), 0xFFFFFFFF, np.uint32), np.full((pairs, int(m[-1]) + 2 * k + 1), 0xFFFFFFFE, np.uint32)
    for i, (x, y) in enumerate(zip(a, b)):
        left[i, : len(x)], right[i, k : k + len(y)] = x, y
    left, right = np.ascontiguousarray(left.T), np.ascontiguousarray(right.T)
    kind = np.uint16 if 2 * k + 1 < 16 else np.uint32
    one, full = kind(1), kind((1 << (2 * k + 1)) - 1)
    state = np.zeros((k + 1, pairs), kind)
    state[0] = 1 << k
    for e in range(1, k + 1):
        state[e] = state[e - 1] | state[e - 1] << one & full
    done, live, ended = np.zeros((k + 1, pairs), kind), np.arange(pairs), 0
    for i in range(len(left)):
        to = int(np.searchsorted(m[live], i, side="right"))
        if to > ended:
            done[:, live[ended:to]] = state[:, ended:to]
            ended = to
        if i % 16 == 15:
            stay = ended + np.flatnonzero(state[k, ended:] != 0)
            if len(stay) < 0.7 * len(live):
                live, state, left, right, ended = live[stay], state[:, stay], left[:, stay], right[:, stay], 0
        if ended == len(live):
            break
        match, own = np.zeros(len(live) - ended, kind), left[i, ended:]
        for d in range(2 * k + 1):
            match |= (own == right[i + d, ended:]).astype(kind) << kind(d)
        now = state[:, ended:]
        old = now[0].copy()
        now[0] &= match
        for e in range(1, k + 1):
            was = now[e].copy()
            now[e] = (was & match | old | old >> one | now[e - 1] << one) & full
            old = was
    done[:, live[ended:]] = state[:, ended:]
    return (done[most, np.arange(pairs)] >> (n - m + k).astype(kind) & one).astype(bool)


def segments(length: int, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Start and size of the threshold + 1 segments of lines of a length, the longer ones last."""
    parts = threshold + 1
    size, longer = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = size + (i >= parts - longer)
        out.append((at, n))
        at += n
    return out


def probes(length: int, threshold: int = THRESHOLD) -> list[tuple[int, int, int, int]]:
    """(length of the others, segment, start, size): the substrings of a line that may be segments of a line that is as
    long or shorter. A start is possible if the edits to its left and right fit the threshold."""
    return [p for other in range(length - threshold, length + 1) for p in _probes_of(length, other, threshold)]


def _probes_of(length: int, other: int, threshold: int) -> list[tuple[int, int, int, int]]:
    out, gap = [], length - other
    for i, (at, n) in enumerate(segments(other, threshold)):
        # with i edits at most to the left, or threshold - i to the right
        low = max(at - i, at + gap - (threshold - i), 0)
        high = min(at + i, at + gap + (threshold - i), length - n)
        out += [(other, i, s, n) for s in range(low, high + 1)]
    return out


@lru_cache(maxsize=20_000)
def _asked(length: int, threshold: int, least: int) -> np.ndarray:
    """Rows of a code for length of the shorter line and segment, start, size, own: what a line of a length is indexed by
    and asks for."""
    own = [(length, i, at, n) for i, (at, n) in enumerate(segments(length, edits(length, threshold, least)))]
    others = [other for other in range(max(least, length - threshold), length + 1) if length - other <= edits(other, threshold, least)]
    mine = set(own)
    asked = [p for other in others for p in _probes_of(length, other, edits(other, threshold, least)) if p not in mine]
    rows = np.array([(*p, 1) for p in own] + [(*p, 0) for p in asked], np.int64)
    code = mix((rows[:, 0] * (threshold + 1) + rows[:, 1]).astype(U64)).astype(np.int64)
    return np.column_stack([code, rows[:, 2:]])


#: Bytes of lines whose keys are made together: what that takes stays in a processor's cache.
SLICE = 1 << 18
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base, modulo 2**64, and of its inverse."""
    up, down = np.full(n, _BASE, U64), np.full(n, pow(_BASE, -1, 1 << 64), U64)
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


_UP, _DOWN = _powers(SLICE + 1)


class _Spans:
    """Hashes of any substrings of some code units: sums of powers. What they bring together is verified."""

    def __init__(self, values: np.ndarray):
        n = len(values) + 1
        up, self.down = (_UP, _DOWN) if n <= len(_UP) else _powers(n)
        self.total = np.zeros(n, U64)
        np.cumsum(values * up[: n - 1], out=self.total[1:])

    def __call__(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix((self.total[start + size] - self.total[start]) * self.down[start] + size.astype(U64))


_BYTES = mix(np.arange(256, dtype=U64) + U64(0x2C1B3C6D))


class _Lines:
    """The lines of a batch that aren't empty, distinct ones by number, and where each first stands."""

    def __init__(self, rows: pa.Table):
        self.rows = rows
        column = rows.column("text").combine_chunks()
        offsets, data = string_buffers(column)
        self.data = data[int(offsets[0]) : int(offsets[-1])] if len(offsets) else data
        offsets = offsets - offsets[:1]
        feeds = np.flatnonzero(self.data == 10)
        start, end = np.sort(np.concatenate([offsets[:-1], feeds + 1])), np.sort(np.concatenate([feeds, offsets[1:]]))
        some = np.flatnonzero(end > start)
        self.start, self.end = start[some], end[some]
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.number = some - (np.searchsorted(feeds, offsets)[self.doc] + self.doc)
        h1, h2 = span_hashes(self.data, self.start, self.end, 41, 42)
        # rows are in order of doc and text hash, so the first of equal lines has the first place
        self.place = (rows.column("doc").to_numpy()[self.doc], rows.column("text_hash").to_numpy()[self.doc], self.number)
        order = np.lexsort((h2, h1))
        new = np.ones(len(order), bool)
        new[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
        self.of = np.empty(len(order), np.int64)  # each line's number among the distinct ones
        self.of[order] = np.cumsum(new) - 1
        self.first = order[new]
        self.h1, self.h2 = h1[self.first], h2[self.first]

    def by_bucket(self, buckets: int):
        """Distinct lines in order of the codes of their hashes, with the buckets and their bounds."""
        code = asking.codes(self.h1, buckets)
        order = np.argsort(code, kind="stable")
        return order, *asking.bounds(code[order], buckets)

    def keys(self, lines: np.ndarray, threshold: int, least: int, points: bool):
        """key, own, line: segments of some distinct lines, and what they probe shorter ones with."""
        lines = lines[np.argsort(self.first[lines], kind="stable")]
        where = self.first[lines]
        start, end = self.start[where], self.end[where]
        out, at = [(np.zeros(0, U64), np.zeros(0, bool), lines[:0])], 0
        while at < len(lines):
            to = max(at + 1, int(np.searchsorted(end, start[at] + SLICE, side="right")))
            part = slice(at, to)
            out.append(self._keys(lines[part], start[part], end[part], threshold, least, points))
            at = to
        return tuple(np.concatenate(c) for c in zip(*out))

    def _keys(self, lines: np.ndarray, start: np.ndarray, end: np.ndarray, threshold: int, least: int, points: bool):
        data = self.data[start[0] : end[-1]]
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data)) if points else np.arange(len(data) + 1)
        begin = np.searchsorted(at, start - start[0])
        size = np.searchsorted(at, end - start[0]) - begin
        lengths, which = np.unique(size, return_inverse=True)
        asked = [_asked(int(n), threshold, least) if n >= least else np.zeros((0, 4), np.int64) for n in lengths]
        many = np.array([len(a) for a in asked])
        n = many[which]
        each = np.arange(int(n.sum())) + np.repeat((np.cumsum(many) - many)[which] - (np.cumsum(n) - n), n)
        code, place, part, own = np.concatenate(asked)[each].T
        place = place + np.repeat(begin, n)
        first = at[place]
        key = mix(_Spans(_BYTES[data])(first, at[place + part] - first) ^ code.astype(U64))
        return key, own == 1, np.repeat(lines, n)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers, and each one's number among them."""
    order = np.argsort(x)
    s = x[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    number = np.empty(len(s), np.int64)
    number[order] = np.cumsum(new) - 1
    return s[new], number


_ID = ["h1", "h2"]
_PLACE = ["doc", "text_hash", "line"]
_ENTRY = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("doc", "<i8"), ("hash", "<i8"), ("line", "<i8")])


def _pack_lines(h1, h2, place) -> bytes:
    """Lines in columns; places are alike, so they shrink."""
    import zstandard

    doc, hash_, line = place
    columns = (h1.astype("<u8"), h2.astype("<u8"), doc.astype("<i8"), hash_.astype("<i8"), line.astype("<i8"))
    return len(h1).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(c.tobytes() for c in columns))


def _unpack_lines(blob: bytes) -> np.ndarray:
    import zstandard

    n = int.from_bytes(blob[:4], "little")
    raw, out = zstandard.ZstdDecompressor().decompress(blob[4:]), np.zeros(n, _ENTRY)
    for i, name in enumerate(_ENTRY.names):
        out[name] = np.frombuffer(raw, _ENTRY[name], n, i * 8 * n)
    return out


def _stay(blobs: list[bytes]) -> list[np.ndarray]:
    """Whether each line stands at the first of its places. Blobs that begin with `late` name lines that go."""
    late = [np.frombuffer(x[4:], "<u8").reshape(-1, 2) for x in blobs if x[:4] == b"late"]
    parts = [_unpack_lines(x) if x[:4] != b"late" else np.zeros(0, _ENTRY) for x in blobs]
    x = np.concatenate(parts)
    order = np.lexsort((x["line"], x["hash"], x["doc"], x["h2"], x["h1"]))
    head = np.ones(len(x), bool)
    s = x[order]
    head[1:] = (s["h1"][1:] != s["h1"][:-1]) | (s["h2"][1:] != s["h2"][:-1])
    first = s[head][np.cumsum(head) - 1] if len(s) else s  # of each line
    stays = (s["doc"] == first["doc"]) & (s["hash"] == first["hash"]) & (s["line"] == first["line"])
    if late:
        gone = np.concatenate(late)
        both = np.concatenate([gone, np.column_stack([s["h1"], s["h2"]])])
        _, number = np.unique(both, axis=0, return_inverse=True)
        number = number.ravel()
        stays &= ~np.isin(number[len(gone) :], number[: len(gone)])
    out = np.zeros(len(x), bool)
    out[order] = stays
    return np.split(out, np.cumsum([len(p) for p in parts])[:-1])


def _shared(blobs: list[bytes]) -> list[np.ndarray]:
    """For the segments and then the probes of each batch: whether another entry has the key, and one is a segment."""
    parts = []
    for x in blobs:
        n = int.from_bytes(x[:4], "little")
        both = asking.from_five(x[4:])
        parts.append((both[:n], both[n:]))
    all_ = np.concatenate([y for x in parts for y in x])
    own = np.concatenate([np.full(len(y), i == 0) for x in parts for i, y in enumerate(x)])
    distinct, number = _distinct(all_)
    indexed = np.zeros(len(distinct), bool)
    indexed[number[own]] = True
    live = indexed & (np.bincount(number, minlength=len(distinct)) > 1)
    return np.split(live[number], np.cumsum([len(a) + len(b) for a, b in parts])[:-1])


def _first_keys(own: _Lines, stays, buckets: int, threshold: int, least: int, points: bool):
    """Keys of the lines that are the first of all, of segments and of probes: key, line, distinct codes, each one's number."""
    order, some, begin = own.by_bucket(buckets)
    key, is_own, line = own.keys(order[asking.told(stays, some, begin)], threshold, least, points)
    return [(key[of], line[of], *_distinct(asking.codes(key[of], buckets))) for of in (is_own, ~is_own)]


def _survivors(own: _Lines, stays, shared, buckets: int, *how):
    """key, own, line of the keys that have a partner, perhaps."""
    (key, line, code, number), (probe, asker, asked, wanted) = _first_keys(own, stays, buckets, *how)
    both = np.concatenate([code, asked])
    order = np.argsort(both >> U64(40), kind="stable")
    bits = np.zeros(len(both), bool)
    bits[order] = asking.told(shared, *asking.bounds(both[order], buckets))
    live, live_probes = bits[: len(code)], bits[len(code) :]
    # within the batch
    live |= np.bincount(number, minlength=len(code)) > 1
    if len(code):
        at = np.minimum(np.searchsorted(code, asked), len(code) - 1)
        hit = code[at] == asked
        live[at[hit]] = True
        live_probes |= hit
    a, b = live[number], live_probes[wanted]
    return np.concatenate([key[a], probe[b]]), np.repeat([True, False], [a.sum(), b.sum()]), np.concatenate([line[a], asker[b]])


def _edits_of(a: np.ndarray, b: np.ndarray, threshold: int, least: int) -> np.ndarray:
    return np.minimum(threshold, np.minimum(a, b) // max(1, least))


def _read(contents: list[bytes], points: bool) -> list[bytes] | list[str]:
    return [c.decode(errors="surrogateescape") for c in contents] if points else contents


def _near_pairs(pairs: DataFrame, lines: DataFrame, threshold: int, least: int, points: bool) -> DataFrame:
    """h1, h2 of the later lines of pairs (x1, x2, y1, y2) that are near."""

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (_read(batch.column(c).to_pylist(), points) for c in (4, 5))
        most = _edits_of(np.array([len(x) for x in a]), np.array([len(x) for x in b]), threshold, least)
        near = within_all(a, b, most.tolist())
        x1, x2, y1, y2 = (batch.column(c).to_numpy() for c in range(4))
        x_goes = batch.column(6).to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays([pa.array(np.where(x_goes, x1, y1)[near]), pa.array(np.where(x_goes, x2, y2)[near])], _ID)

    told = lambda a, b, c, p: lines.select(F.col("h1").alias(a), F.col("h2").alias(b), F.col("content").alias(c), F.struct(*_PLACE).alias(p))
    both = pairs.join(told("x1", "x2", "a", "px"), ["x1", "x2"]).join(told("y1", "y2", "b", "py"), ["y1", "y2"])
    return map_batches(both.select("x1", "x2", "y1", "y2", "a", "b", (F.col("px") > F.col("py")).alias("x_goes")), compare, "h1 long, h2 long")


def _histograms(lines: list[np.ndarray]) -> np.ndarray:
    """How many characters of each of 64 classes lines have: an edit changes two counts by one."""
    if not lines:
        return np.zeros((0, 64), np.int32)
    of = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    return np.bincount(of * 64 + (np.concatenate(lines) & 63), minlength=64 * len(lines)).reshape(-1, 64).astype(np.int32)


def _bits_of(rows: list[list], known: np.ndarray) -> np.ndarray:
    """Packed bits: which of the known keys each row has."""
    out = np.zeros((len(rows), len(known)), bool)
    for i, r in enumerate(rows):
        r = np.array(r, np.int64)
        at = np.searchsorted(known, r)
        ok = at < len(known)
        out[i, at[ok][known[at[ok]] == r[ok]]] = True
    return np.packbits(out, axis=1)


def _late_in(group: pa.Table, threshold: int, least: int, points: bool) -> list[int]:
    """Rows, in order of place, that are near an earlier row of their group."""
    lines = _read(group.column("content").to_pylist(), points)
    own, block = group.column("own").to_numpy(), group.column("block").to_numpy()
    same, key = group.column("i")[0] == group.column("j")[0], group.column("key")[0].as_py()
    codes = _codes(lines)
    count, size = _histograms(codes), np.array([len(x) for x in lines])
    parity = np.packbits((count & 1).astype(np.uint8), axis=1).view(np.uint64).ravel()
    hot = group.column("hot").to_pylist()
    smaller = np.unique(np.array([h["key"] for r in hot for h in r if h["key"] < key], np.int64))
    has, owns = _bits_of([[h["key"] for h in r] for r in hot], smaller), _bits_of([[h["key"] for h in r if h["own"]] for r in hot], smaller)
    found = []
    for at in range(0, len(lines), 64):
        rows = np.arange(at, min(len(lines), at + 64))
        most = _edits_of(size[rows][:, None], size[None, :], threshold, least)
        like = (np.arange(len(lines))[None, :] < rows[:, None]) & (np.abs(size[rows][:, None] - size[None, :]) <= most) & (own[rows][:, None] | own[None, :])
        like &= np.bitwise_count(parity[rows][:, None] ^ parity[None, :]) <= 2 * most
        if not same:
            like &= block[rows][:, None] != block[None, :]
        y, x = np.nonzero(like)
        most, y = most[y, x], y + at
        near = np.abs(count[y] - count[x]).sum(axis=1) <= 2 * most
        y, x, most = y[near], x[near], most[near]
        if len(smaller) and len(y):
            new = ~((has[y] & owns[x]) | (owns[y] & has[x])).any(axis=1)
            y, x, most = y[new], x[new], most[new]
        found.append((y, x, most))
    y, x, most = (np.concatenate(c) for c in zip(*found))
    late = np.zeros(len(lines), bool)
    while len(y):  # a few partners of each line at a time, until it is late or has none left
        nth = np.arange(len(y)) - np.searchsorted(y, y)
        now = nth < 4
        near = within_all([lines[i] for i in x[now]], [lines[i] for i in y[now]], most[now].tolist())
        late[y[now][near]] = True
        left = ~now & ~late[y]
        y, x, most = y[left], x[left], most[left]
    return np.flatnonzero(late).tolist()


def _hot_near(hot: DataFrame, lines: DataFrame, threshold: int, least: int, points: bool) -> DataFrame:
    """h1, h2 of lines with an earlier near line under a hot key. hot: key, n (lines), own, h1, h2."""
    all_ = hot.groupBy(*_ID).agg(F.collect_list(F.struct("key", "own")).alias("hot"))  # at most the keys of a line
    cut = hot.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64(*_ID), "blocks").cast("int"))
    rows = cut.join(all_.join(lines.select(*_ID, "content", *_PLACE), _ID), _ID)
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "own", "hot", *_ID, "content", *_PLACE)

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in _PLACE]).combine_chunks()
        return group.select(_ID).take(pa.array(_late_in(group, threshold, least, points), pa.int64()))

    return met.groupBy("key", "i", "j").applyInArrow(compare, "h1 long, h2 long")


def _late(batches: DataFrame, stays: DataFrame, buckets: int, threshold: int, least: int, bucket: int, points: bool) -> tuple[DataFrame, list[DataFrame]]:
    """h1, h2 of the lines with an earlier near line, and the tables they are made from."""
    how = (threshold, least, points)

    def ask(name, packed, stays_):
        segments_, probes_ = (x[2] for x in _first_keys(_Lines(asking.unpack(packed)), stays_, buckets, *how))
        a, b = asking.bounds(segments_, buckets), asking.bounds(probes_, buckets)
        parts = [{int(k): codes_[i:j] for k, i, j in zip(some, begin, begin[1:])} for codes_, (some, begin) in ((segments_, a), (probes_, b))]
        some, none = sorted(parts[0].keys() | parts[1].keys()), np.zeros(0, U64)
        blobs = [len(parts[0].get(k, none)).to_bytes(4, "little") + asking.five(parts[0].get(k, none)) + asking.five(parts[1].get(k, none)) for k in some]
        yield asking.asks(name, np.array(some, np.int32), blobs)

    def emit(packed, stays_, shared_):
        own = _Lines(asking.unpack(packed))
        key, is_own, line = _survivors(own, stays_, shared_, buckets, *how)
        order = np.argsort(line, kind="stable")
        line, key, is_own = line[order], key[order], is_own[order]
        some, begin = np.unique(line, return_index=True)
        for at in range(0, len(some), 1000):
            part, upto = some[at : at + 1000], np.append(begin, len(line))[at : at + 1001]
            each = pa.StructArray.from_arrays([pa.array(key[upto[0] : upto[-1]].astype(np.int64)), pa.array(is_own[upto[0] : upto[-1]])], ["key", "own"])
            where = own.first[part]
            content = [own.data[a:b].tobytes() for a, b in zip(own.start[where].tolist(), own.end[where].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.h1[part].astype(np.int64)), pa.array(own.h2[part].astype(np.int64)), *(pa.array(p[where]) for p in own.place), pa.array(content, pa.binary()), pa.ListArray.from_arrays(pa.array(upto - upto[0], pa.int32()), each)],
                [*_ID, *_PLACE, "content", "keys"],
            )

    # nothing names these joins, so their shuffle files go once a step is written
    joined = lambda bits, *columns: batches.join(bits.hint("shuffle_hash"), "batch", "left").select(*columns)
    shared = materialize(asking.answers(asking.over_batches(joined(stays, "batch", "packed", "stays"), ask, asking.ASKED), buckets, _shared, "shared"), "shared-segments")
    kind = "h1 long, h2 long, doc long, text_hash long, line long, content binary, keys array<struct<key:long,own:boolean>>"
    lines = materialize(asking.over_batches(joined(stays.join(shared, "batch", "left"), "packed", "stays", "shared"), emit, kind), "lines-with-partners")
    # rows that repeat a document have the same lines
    keys = materialize(lines.select(*_ID, F.explode("keys").alias("k")).select("k.key", *_ID, "k.own").groupBy("key", *_ID).agg(F.max("own").alias("own")), "segments")
    once = materialize(lines.select(*_ID, *_PLACE, "content").dropDuplicates(_ID), "lines-to-compare")
    sizes = materialize(keys.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("own")).filter("n > 1 and own").select("key", "n"), "segment-sizes")
    small = keys.join(sizes.filter(F.col("n") <= bucket).select("key"), "key")
    # at most `bucket` entries
    met = small.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(*_ID, "own"))).alias("all"))
    two = F.flatten(F.transform("all", lambda x, i: F.transform(F.filter(F.slice("all", i + 2, F.size("all")), lambda y: x["own"] | y["own"]), lambda y: F.struct(x["h1"].alias("x1"), x["h2"].alias("x2"), y["h1"].alias("y1"), y["h2"].alias("y2")))))
    pairs = met.select(F.explode(two).alias("t")).select("t.*").distinct()
    late = _near_pairs(pairs, once, *how)
    hot = materialize(keys.join(sizes.filter(F.col("n") > bucket), "key").select("key", "n", "own", *_ID), "hot-segments")
    return late.unionByName(_hot_near(hot, once, *how)).distinct(), [shared, lines, keys, once, sizes, hot]


def dedup_lines(df: DataFrame, threshold: int = THRESHOLD, least: int = LEAST, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text", keep_rows: bool = False, points: bool = False, batch_bytes: int = asking.BATCH_BYTES) -> DataFrame:
    """doc_id, n_lines (that aren't empty), n_removed, kept (the text without the removed lines) of every row; with
    keep_rows also `rest`: `row`, the row's other columns, and whether its text is `missing`. Distances count code points
    with points, else bytes."""
    if not 0 <= threshold <= MOST_EDITS:
        raise ValueError(f"the threshold must be 0 to {MOST_EDITS}")
    spark = df.sparkSession
    small_batches(spark)
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    id_ = F.col(id_col).cast("long")
    # the text travels once, so the row goes without it
    rest = [F.struct(F.struct(*(F.col(f"`{c}`") for c in df.columns if c != text_col)).alias("row"), F.col(text_col).isNull().alias("missing")).alias("rest")] if keep_rows else []
    source = df.select(id_.alias("doc_id"), F.coalesce(id_, F.lit(asking.NONE)).alias("doc"), F.xxhash64(body).alias("text_hash"), body.alias("text"), *rest)
    buckets = asking.bucket_count(source)

    def ask_lines(rows: pa.Table):
        own = _Lines(rows)
        order, some, begin = own.by_bucket(buckets)
        pick = [order[i:j] for i, j in zip(begin, begin[1:])]
        return some, [_pack_lines(own.h1[p], own.h2[p], tuple(c[own.first[p]] for c in own.place)) for p in pick]

    both = materialize(asking.gather(source, batch_bytes, order=("doc", "text_hash"), ask=ask_lines), "line-batches")
    batches, asked = asking.split(both)
    stays = materialize(asking.answers(asked, buckets, _stay, "stays"), "first-lines")
    if threshold:
        late, made = _late(batches, stays, buckets, threshold, least, bucket, points)

        def tell(batch: pa.RecordBatch) -> pa.RecordBatch:
            h1, h2 = (c.to_numpy().astype(U64) for c in batch.columns)
            code = asking.codes(h1, buckets)
            order = np.argsort(code, kind="stable")
            some, begin = asking.bounds(code[order], buckets)
            blobs = [b"late" + np.column_stack([h1[order[i:j]], h2[order[i:j]]]).astype("<u8").tobytes() for i, j in zip(begin, begin[1:])]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.nulls(len(some), pa.string()), pa.array(blobs, pa.binary())], ["bucket", "batch", "blob"])

        named = materialize(map_batches(late, tell, asking.ASKED), "late-lines")
        discard(*made)
        first, stays = stays, materialize(asking.answers(asked.unionByName(named), buckets, _stay, "stays"), "lines-that-stay")
        discard(first, named)

    def finish(packed, given):
        own = _Lines(asking.unpack(packed))
        order, some, begin = own.by_bucket(buckets)
        stay = np.zeros(len(own.first), bool)
        stay[order] = asking.told(given, some, begin)
        keep = stay[own.of]
        for c in own.place:
            keep &= c == c[own.first][own.of]
        n = np.bincount(own.doc, minlength=own.rows.num_rows)
        gone: dict[int, list[int]] = {}
        for d, line in zip(own.doc[~keep].tolist(), own.number[~keep].tolist()):
            gone.setdefault(d, []).append(line)
        for at in range(0, own.rows.num_rows, 500):
            part = own.rows.slice(at, 500)
            kept = []
            for d, text in enumerate(part.column("text").to_pylist(), at):
                drop = set(gone.get(d, ()))
                kept.append("\n".join([x for i, x in enumerate(text.split("\n")) if i not in drop]) if drop else text)
            removed = [len(gone.get(d, ())) for d in range(at, at + len(kept))]
            more = [part.column("rest").combine_chunks()] if keep_rows else []
            yield pa.RecordBatch.from_arrays([part.column("doc_id").combine_chunks(), pa.array(n[at : at + 500]), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), *more], ["doc_id", "n_lines", "n_removed", "kept", *(["rest"] if keep_rows else [])])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), *([source.schema["rest"]] if keep_rows else [])])
    told = batches.join(stays.hint("shuffle_hash"), "batch", "left")
    return asking.over_batches(told.select("packed", "stays"), finish, schema)
