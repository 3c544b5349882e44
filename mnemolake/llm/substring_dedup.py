"""Substring deduplication by recompression.

Words become numbers, and rounds rename what lies next to each other: first runs of one word, then, round by round,
pairs of a left and a right symbol, where a hash of the symbol says which it is. A name is a hash of its parts, so it is
the same in all documents. Of two equal passages only the outermost symbols can be paired differently, depending on what
stands around them; which symbols that are follows from the passage alone, and the rest, its interior, gets the same
names in both. So a window of `window` words that occurs twice has an interior of symbols that all occur twice.

1. Documents are gathered in batches, each a row of a table in the shared folder; batches ask each other (see `asking`)
   which of the distinct symbols of the last round others have too.
2. Windows whose interior has shared symbols only are candidates, and so are windows without an interior (runs). Their
   fingerprints, of two independent hashes of 64 bits, are compared in the same way: each batch sends the first place of
   each distinct window and is told whether it is the first of all. This verifies the repeats; windows that merely share
   symbols go free.
3. Words covered by a window that is not the first of its kind are removed.

Nulls and empty texts have no words. Documents are ordered by doc_id, null first; of rows that repeat a doc_id an
arbitrary one counts as earlier. Texts of any length are processed whole: one that is longer than a batch makes a batch.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.llm import asking
from mnemolake.llm.common import id_and_text, materialize, small_batches, string_buffers
from mnemolake.llm.words import U64, grams, mix, not_white, span_hashes, starts_of, words

WINDOW = 20
#: Pair rounds: symbols of the last one hold about (4 / 3) ** ROUNDS words, few enough to fit a window several times.
ROUNDS = 4


def recompress(h: np.ndarray, first: np.ndarray, rounds: int = ROUNDS):
    """Symbols of words h in texts (first: words before each text, and in all).

    Returns the last round's symbols, and for each place the symbol that the interior of a window that starts there
    begins with, and the symbol that the interior of a window that ends before there ends before."""
    n = len(h)
    new_text = np.zeros(n + 1, bool)
    new_text[first] = True
    # runs: the one at an edge of a window may go on outside
    begins = new_text[:n].copy()
    begins[1:] |= h[1:] != h[:-1]
    at = np.flatnonzero(begins)
    run = np.cumsum(begins) - 1
    length = np.diff(np.append(at, n))
    symbol = np.where(length > 1, mix(h[at] + mix(length.astype(U64))), h[at])
    left = np.append(run + 1, len(at))
    right = np.append(0, run)
    edge = new_text[:n][at]
    for j in range(rounds):
        m = len(symbol)
        is_left = (mix(symbol + U64(j * 0x1234567 + 7)) >> U64(63)).astype(bool)
        paired = np.zeros(m, bool)
        paired[:-1] = is_left[:-1] & ~is_left[1:] & ~edge[1:]
        starts = np.ones(m, bool)
        starts[1:] = ~paired[:-1]
        number = np.append(np.cumsum(starts) - 1, starts.sum())
        is_left = np.append(is_left, True)
        # a right symbol at the front may belong to one before the window, a left one at the end to one after it
        left = number[np.minimum(left + ~is_left[np.minimum(left, m)], m)]
        last = np.maximum(right - 1, 0)
        right = right - (is_left[last] & (right > 0))
        right = np.where(right > 0, number[np.maximum(right - 1, 0)] + 1, 0)
        keep = np.flatnonzero(starts)
        pair = paired[keep]
        mate = symbol[np.minimum(keep + 1, m - 1)]
        symbol = np.where(pair, mix(symbol[keep] * U64(0x9E3779B97F4A7C15) + mate + U64(j)), symbol[keep])
        edge = edge[keep]
    return symbol, left, right


class Batch:
    """The documents of a batch, by doc_id: their words, windows and symbols."""

    def __init__(self, rows: pa.Table, window: int, rounds: int):
        self.ids, column = rows.column("doc_id").combine_chunks(), rows.column("text").combine_chunks()
        self.doc = rows.column("doc").to_numpy()
        offsets, self.data = string_buffers(column)
        self.start, self.end, self.h, self.first = words(offsets, self.data, not_white())
        self.at = starts_of(self.first, window)
        if len(self.h):
            self.symbol, left, right = recompress(self.h, self.first, rounds)
            self.lo, self.hi = left[self.at], right[self.at + window]
        else:
            self.symbol, self.lo, self.hi = np.zeros(0, U64), self.at, self.at
        self.window = window

    def asked(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the distinct symbols, for each symbol its number among them, and whether it occurs twice here."""
        distinct, number, count = np.unique(asking.codes(self.symbol, buckets), return_inverse=True, return_counts=True)
        return distinct, number, count > 1

    def candidates(self, given, buckets: int) -> np.ndarray:
        """Places of windows whose interior is of shared symbols only."""
        distinct, number, here = self.asked(buckets)
        shared = asking.told(given, *asking.bounds(distinct, buckets))
        alone = np.append(0, np.cumsum(~(shared | here)[number]))
        return self.at[alone[np.maximum(self.hi, self.lo)] == alone[self.lo]]

    def fingerprints(self, at: np.ndarray):
        """Of windows at the places: distinct ones (two hashes), their first places, and each one's number."""
        if not len(at):
            none = np.zeros(0, np.int64)
            return none.astype(U64), none.astype(U64), none, none
        h2 = span_hashes(self.data, self.start, self.end, 13)[0]
        a, b = grams(self.h, self.window, 11)[at], grams(h2, self.window, 12)[at]
        order = np.lexsort((b, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        where = order[new]  # the sort is stable
        return a[where], b[where], at[where], number

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """doc_id and start in the document of places."""
        doc = np.searchsorted(self.first, at, side="right") - 1
        return self.doc[doc], at - self.first[doc]

    def by_bucket(self, places: np.ndarray, buckets: int):
        """Distinct windows by bucket and place: both hashes, first place, order, buckets and bounds, each one's number."""
        a, b, at, number = self.fingerprints(places)
        code = asking.codes(a, buckets)
        order = np.lexsort((at, code >> U64(40)))
        return a, b, at, order, *asking.bounds(code[order], buckets), number


def _shared(blobs: list[bytes]) -> list[np.ndarray]:
    """Whether each symbol was asked for by another batch."""
    parts = [asking.from_five(x) for x in blobs]
    _, number, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    return np.split(count[number] > 1, np.cumsum([len(p) for p in parts])[:-1])


_PLACE = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("start", "<i8")])


def _pack_places(a: np.ndarray, b: np.ndarray, doc: np.ndarray, start: np.ndarray) -> bytes:
    """Windows by place, in columns: ids and starts shrink to a byte or two as differences."""
    import zstandard

    columns = (a.astype("<u8"), b.astype("<u8"), np.diff(doc, prepend=0).astype("<i8"), np.diff(start, prepend=0).astype("<i8"))
    return len(a).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(c.tobytes() for c in columns))


def _unpack_places(blob: bytes) -> np.ndarray:
    import zstandard

    n = int.from_bytes(blob[:4], "little")
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob[4:]), np.zeros(n, _PLACE), 0
    for name in _PLACE.names:
        kind = _PLACE[name]
        out[name] = np.frombuffer(raw, kind, n, at)
        at += n * kind.itemsize
    out["doc"], out["start"] = np.cumsum(out["doc"]), np.cumsum(out["start"])
    return out


def _firsts(blobs: list[bytes]) -> list[np.ndarray]:
    """Whether each window is the first of all with its fingerprint."""
    parts = [_unpack_places(x) for x in blobs]
    x = np.concatenate(parts)
    order = np.lexsort((x["start"], x["doc"], x["b"], x["a"]))
    a, b = x["a"][order], x["b"][order]
    head = np.ones(len(x), bool)
    head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    out = np.zeros(len(x), bool)
    out[order[head]] = True
    return np.split(out, np.cumsum([len(p) for p in parts])[:-1])


def remove_repeats(df: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = asking.BATCH_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) of every row."""
    small_batches(df.sparkSession)
    docs = id_and_text(df, id_col, text_col).withColumn("doc", F.coalesce("doc_id", F.lit(asking.NONE)))
    buckets = asking.bucket_count(docs)

    def ask_symbols(rows: pa.Table):
        distinct = Batch(rows, window, rounds).asked(buckets)[0]
        some, begin = asking.bounds(distinct, buckets)
        return some, [asking.five(distinct[i:j]) for i, j in zip(begin, begin[1:])]

    batches, asked = asking.split(materialize(asking.gather(docs, batch_bytes, ask=ask_symbols), "substring-batches"))

    def ask_windows(name, packed, shared):
        own = Batch(asking.unpack(packed), window, rounds)
        a, b, at, order, some, begin, _ = own.by_bucket(own.candidates(shared, buckets), buckets)
        doc, start = own.places(at)
        yield asking.asks(name, some, [_pack_places(*(c[order[i:j]] for c in (a, b, doc, start))) for i, j in zip(begin, begin[1:])])

    def finish(packed, shared, firsts):
        own = Batch(asking.unpack(packed), window, rounds)
        places = own.candidates(shared, buckets)
        _, _, at, order, some, begin, number = own.by_bucket(places, buckets)
        first = np.zeros(len(at), bool)
        first[order] = asking.told(firsts, some, begin)
        gone = places[~(first[number] & (at[number] == places))] if len(places) else places
        n = len(own.h) + 1
        cover = np.cumsum(np.bincount(gone, minlength=n) - np.bincount(gone + window, minlength=n))
        yield from _kept(own, cover[:-1] == 0)

    def _kept(own: Batch, stays: np.ndarray):
        whole = own.data.tobytes()
        starts, ends, keep, first = own.start.tolist(), own.end.tolist(), stays.tolist(), own.first.tolist()
        n, removed, texts_ = [], [], []
        for i, j in zip(first, first[1:]):
            kept = [whole[a:b] for a, b, k in zip(starts[i:j], ends[i:j], keep[i:j]) if k]
            n.append(j - i)
            removed.append(j - i - len(kept))
            texts_.append(b" ".join(kept))
        for at in range(0, len(n), 500):
            part = slice(at, at + 500)
            yield pa.RecordBatch.from_arrays([own.ids[part], pa.array(n[part], pa.int64()), pa.array(removed[part], pa.int64()), pa.array(texts_[part], pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    shared = materialize(asking.answers(asked, buckets, _shared, "shared"), "shared-symbols")
    with_shared = lambda: batches.join(shared.hint("shuffle_hash"), "batch", "left").select("batch", "packed", "shared")
    firsts = materialize(asking.answers(asking.over_batches(with_shared(), ask_windows, asking.ASKED), buckets, _firsts, "firsts"), "first-windows")
    both = batches.join(shared.join(firsts, "batch", "left").hint("shuffle_hash"), "batch", "left")
    return asking.over_batches(both.select("packed", "shared", "firsts"), finish, "doc_id long, n_words long, n_removed long, kept string")
