"""BPE encoding and decoding by forced-boundary splitting.

Each symbol that a BPE merge makes is itself a token of the vocabulary. So a byte pair that occurs inside no token is
never bridged, and a text can be cut there for certain. Fragments between such cuts are encoded on their own, the
results of frequent fragments are remembered, and a document is the concatenation of its fragments' ids.

The pre-tokeniser also looks at context, so a cut counts only where it sees the same on both sides:

* the left side ends in no white space (the pattern looks ahead after white space only),
* the right side starts a character, and starts with an apostrophe only after an ASCII letter or digit,
* the byte pairs inside contractions ('re, 've, 'll) are never cut.

Nulls and empty texts have no ids and decode to the empty text; very long texts are cut like others; repeated rows give
repeated rows; ids outside the vocabulary are an error. Extra columns of the input, of whatever name, are ignored.

A worker holds the vocabulary (about 50 MB for 50,000 tokens; 5 MB if it only decodes), the remembered fragments, which
go when its task ends, and what encoding about PART_BYTES of text takes; a longer text is a part of its own.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from mnemolake.llm.common import give_back, id_and_text, small_batches, texts

#: Places for remembered fragments of up to 16 bytes, a power of two, and the most ids that one may have: together 17 MB.
REMEMBERED, MOST_IDS = 1 << 19, 4
#: A specification travels to every executor, so its size is bounded.
MAX_SPEC_BYTES = 64 << 20
#: Bytes of text that are encoded together.
PART_BYTES = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_spec(path: str) -> bytes:
    with open(path, "rb") as f:
        spec = f.read()
    if len(spec) > MAX_SPEC_BYTES:
        raise ValueError(f"{path} has {len(spec)} bytes, more than {MAX_SPEC_BYTES}")
    return spec


def _told(spec: bytes) -> dict:
    told = json.loads(spec)
    pre = told.get("pre_tokenizer") or {}
    if told["model"].get("type") != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or told.get("normalizer") or told.get("post_processor"):
        raise ValueError("a byte-level BPE specification without normaliser, prefix space and post-processor is needed")
    if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in told["added_tokens"]):
        raise ValueError("added tokens that take white space or whole words aren't supported")
    return told


class Decoder:
    """Decodes with a byte-level BPE specification in the tokenizers library's JSON format."""

    def __init__(self, spec: bytes):
        self._take(_told(spec))

    def _take(self, told: dict) -> None:
        self.special = {x["content"].encode(): x["id"] for x in told["added_tokens"]}
        to_byte = byte_alphabet()
        vocabulary = told["model"]["vocab"]
        self.size = 1 + max([*vocabulary.values(), *self.special.values()])
        self.token: list[bytes] = [b""] * self.size
        for word, i in vocabulary.items():
            self.token[i] = bytes(to_byte[c] for c in word)
        for word, i in self.special.items():
            self.token[i] = word

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids' tokens; what isn't UTF-8 becomes the replacement character."""
        token = self.token
        out = b"".join([token[i] for i in ids.tolist()])
        try:
            out.decode()
        except UnicodeDecodeError:
            out = out.decode(errors="replace").encode()
        return out


class _Remembered:
    """Ids of fragments of up to 16 bytes, each at the place that its hash names; a later fragment takes the place.

    A fragment is told by all its bytes, as two numbers; without zero bytes the first of them is never 0."""

    def __init__(self):
        self.lo, self.hi = np.zeros(REMEMBERED, np.uint64), np.zeros(REMEMBERED, np.uint64)
        self.n, self.ids = np.zeros(REMEMBERED, np.uint8), np.zeros((REMEMBERED, MOST_IDS), np.uint32)

    def find(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, numbers of ids (0: not known), and ids."""
        h = (lo ^ (hi << np.uint64(29) | hi >> np.uint64(35))) * np.uint64(0x9E3779B97F4A7C15)
        at = ((h ^ h >> np.uint64(32)) & np.uint64(REMEMBERED - 1)).astype(np.int64)
        same = (self.lo[at] == lo) & (self.hi[at] == hi)
        return at, np.where(same, self.n[at], 0).astype(np.int64), self.ids[at]

    def keep(self, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: np.ndarray, ids: np.ndarray, begin: np.ndarray) -> None:
        at, one = np.unique(at, return_index=True)
        self.lo[at], self.hi[at], self.n[at] = lo[one], hi[one], n[one]
        for k in range(MOST_IDS):
            have = n[one] > k
            self.ids[at[have], k] = ids[begin[one][have] + k]


class BoundaryCodec(Decoder):
    """Encodes too."""

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        told = _told(spec)
        self._take(told)
        self.cut = self._cut_table(self.token[i] for i in told["model"]["vocab"].values())
        del told
        self.tokenizer = Tokenizer.from_str(spec.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.forget()

    def forget(self) -> None:
        """Drops the remembered fragments."""
        self.remembered: _Remembered | None = None

    @staticmethod
    def _cut_table(tokens) -> np.ndarray:
        """For each pair of bytes, as first * 256 + second: whether a text is cut between them."""
        inside = np.zeros((256, 256), bool)
        joined = np.frombuffer(b"".join(t + b"\0\0" for t in tokens), np.uint8)
        inside[joined[:-1], joined[1:]] = True  # the separators only add pairs with byte 0, which then aren't cut
        for pair in (b"re", b"ve", b"ll"):
            inside[pair[0], pair[1]] = True
        cut = ~inside
        cut[:, 0x80:0xC0] = False
        cut[:0x21, :] = False
        alnum = [*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]
        quote = cut[alnum, ord("'")]
        cut[:, ord("'")] = False
        cut[alnum, ord("'")] = quote
        return cut.ravel()

    def _cuts(self, a: np.ndarray) -> np.ndarray:
        """For each byte of a text but the last: whether the text is cut after it."""
        cut = self.cut[(a[:-1].astype(np.uint16) << 8) | a[1:]]
        wide = np.flatnonzero(cut & (a[:-1] >= 0x80))
        if len(wide):  # white space beyond ASCII ends in such bytes
            last, two, three = a[wide], a[np.maximum(wide - 1, 0)], a[np.maximum(wide - 2, 0)]
            blank = (two == 0xC2) & ((last == 0x85) | (last == 0xA0)) | (three == 0xE2) & ((two == 0x80) | (two == 0x81)) | (three == 0xE1) & (two == 0x9A) | (three == 0xE3) & (two == 0x80)
            cut[wide[blank]] = False
        return cut

    def fragments(self, data: bytes) -> list[bytes]:
        """The text between certain cuts."""
        ends = (np.flatnonzero(self._cuts(np.frombuffer(data, np.uint8))) + 1).tolist() if len(data) > 1 else []
        return [data[i:j] for i, j in zip([0, *ends], [*ends, len(data)]) if i < j]

    def _segments(self, data: bytes) -> list[bytes]:
        """Fragments, with the added tokens as fragments of their own; of two that start together the longer one."""
        out, at = [], 0
        while found := [(i, -len(s), s) for s in self.special if (i := data.find(s, at)) >= 0]:
            i, _, s = min(found)
            out += [*self.fragments(data[at:i]), s]
            at = i + len(s)
        return out + self.fragments(data[at:])

    def _look_up(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of fragments one after another, and how many each has."""
        flat, n = array("I"), []
        for start in range(0, len(pieces), 10_000):
            for e in self.tokenizer.encode_batch_fast([x.decode() for x in pieces[start : start + 10_000]], add_special_tokens=False):
                ids = e.ids
                flat.extend(ids)
                n.append(len(ids))
        return np.array(flat, np.uint32), np.array(n, np.int64)

    def _encode_alone(self, data: bytes) -> np.ndarray:
        """Ids of a text that may hold added tokens and zero bytes."""
        pieces = self._segments(data)
        distinct = list(dict.fromkeys(x for x in pieces if x not in self.special))
        flat, n = self._look_up(distinct)
        of = dict(zip(distinct, np.split(flat, np.cumsum(n)[:-1]))) | {x: np.array([i], np.uint32) for x, i in self.special.items()}
        return np.concatenate([of[x] for x in pieces])

    def encode(self, data: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, given in UTF-8."""
        odd = {i for i, x in enumerate(data) if b"\0" in x or any(s in x for s in self.special)}
        plain = iter(self._encode_together([x for i, x in enumerate(data) if i not in odd]))
        return [self._encode_alone(x) if i in odd else next(plain) for i, x in enumerate(data)]

    def _encode_together(self, data: list[bytes]) -> list[np.ndarray]:
        """encode() for texts without added tokens and zero bytes: each distinct fragment is looked up once."""
        whole = b"".join(data)
        ends = np.cumsum([len(x) for x in data])
        if not whole:
            return [np.zeros(0, np.uint32) for _ in data]
        a = np.frombuffer(whole, np.uint8)
        cut = np.append(self._cuts(a), True) if len(a) > 1 else np.ones(1, bool)
        cut[ends[ends > 0] - 1] = True
        stop = np.flatnonzero(cut) + 1
        start = np.append(0, stop[:-1])
        size = stop - start
        # up to 16 bytes make two numbers, which tell fragments without zero bytes apart for certain
        low = np.array([(1 << 8 * min(i, 8)) - 1 for i in range(17)], np.uint64)
        high = np.array([(1 << 8 * max(i - 8, 0)) - 1 for i in range(17)], np.uint64)
        short = np.flatnonzero(size <= 16)
        view = np.lib.stride_tricks.sliding_window_view(np.append(a, np.zeros(16, np.uint8)), 16)
        pair = np.ascontiguousarray(view[start[short]]).view("<u8").reshape(-1, 2)
        lo, hi = pair[:, 0] & low[size[short]], pair[:, 1] & high[size[short]]
        code, _ = pd.factorize(lo * np.uint64(0x9E3779B97F4A7C15) ^ hi * np.uint64(0xC2B2AE3D27D4EB4F))
        first = np.zeros(code.max(initial=-1) + 1, np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        same = (lo[first[code]] == lo) & (hi[first[code]] == hi)
        alone = np.concatenate([np.flatnonzero(size > 16), short[~same]])
        of = np.zeros(len(size), np.int64)
        of[short] = code
        of[alone] = len(first) + np.arange(len(alone))
        distinct = np.concatenate([short[first], alone])
        if self.remembered is None:
            self.remembered = _Remembered()
        kept, known_n, known_ids = self.remembered.find(lo[first], hi[first])
        fresh = np.append(np.flatnonzero(known_n == 0), np.arange(len(first), len(distinct)))
        told = distinct[fresh]
        flat, fresh_n = self._look_up([whole[i:j] for i, j in zip(start[told].tolist(), stop[told].tolist())])
        n = np.append(known_n, np.zeros(len(alone), np.int64))
        n[fresh] = fresh_n
        begin = np.cumsum(n) - n
        ids = np.empty(n.sum(), np.uint32)
        ids[np.repeat(begin[fresh] - (np.cumsum(fresh_n) - fresh_n), fresh_n) + np.arange(len(flat))] = flat
        for k in range(MOST_IDS):
            have = np.flatnonzero(known_n > k)
            ids[begin[have] + k] = known_ids[have, k]
        short_ones = fresh[: len(fresh) - len(alone)]
        short_ones = short_ones[n[short_ones] <= MOST_IDS]
        self.remembered.keep(kept[short_ones], lo[first[short_ones]], hi[first[short_ones]], n[short_ones], ids, begin[short_ones])
        count = n[of]
        upto = np.cumsum(count)
        ids = ids[np.repeat(begin[of] - (upto - count), count) + np.arange(upto[-1])]
        at = np.append(0, upto)[np.searchsorted(stop, ends, side="right")]
        return np.split(ids, at[:-1])


#: The codec that a Python worker used last.
_CODECS: dict[tuple, Decoder] = {}


def codec_of(spec: bytes, kind: type = BoundaryCodec):
    """One codec for each Python worker: a task that needs another one takes its place."""
    key = (kind.__name__, hashlib.sha256(spec).hexdigest())
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = kind(spec)
    return _CODECS[key]


def in_parts(data: list[bytes], most: int = PART_BYTES):
    """Consecutive texts of together about as many bytes at most: bounds the memory of a step."""
    part, n = [], 0
    for x in data:
        part.append(x)
        n += len(x)
        if n >= most:
            yield part
            part, n = [], 0
    if part:
        yield part


def _encoded(codec: BoundaryCodec, column: pa.Array) -> pa.ListArray:
    ids = [x for part in in_parts(texts(column)) for x in codec.encode(part)]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))


def _decoded(codec: Decoder, lists: pa.ListArray) -> pa.Array:
    at, flat = lists.offsets.to_pylist(), lists.values.to_numpy(zero_copy_only=False)
    return pa.array([codec.decode(flat[a:b]) for a, b in zip(at, at[1:])], pa.binary()).cast(pa.string())


def _map(df: DataFrame, spec_path: str, kind: type, f, schema: str) -> DataFrame:
    """f(codec, batch) for each batch; what the codec remembers goes with the task."""
    small_batches(df.sparkSession)
    spec = df.sparkSession.sparkContext.broadcast(read_spec(spec_path))

    def run(batches):
        codec = codec_of(spec.value, kind)
        for batch in batches:
            if batch.num_rows:
                yield f(codec, batch)
        if kind is BoundaryCodec:
            codec.forget()
        give_back()

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, spec_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    run = lambda codec, batch: pa.RecordBatch.from_arrays([batch.column(0), _encoded(codec, batch.column(1))], ["doc_id", "ids"])
    return _map(id_and_text(df, id_col, text_col), spec_path, BoundaryCodec, run, "doc_id long, ids array<int>")


def decode(df: DataFrame, spec_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids and text of every row of ids; null ids count as none."""
    run = lambda codec, batch: pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _decoded(codec, batch.column(1))], ["doc_id", "ids", "text"])
    rows = df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"coalesce(cast(`{ids_col}` as array<int>), cast(array() as array<int>)) ids")
    return _map(rows, spec_path, Decoder, run, "doc_id long, ids array<int>, text string")


def round_trip(df: DataFrame, spec_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids of every text, and the text that they decode to: encode() and decode() in one worker."""

    def run(codec: BoundaryCodec, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = _encoded(codec, batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), ids, _decoded(codec, ids)], ["doc_id", "ids", "text"])

    return _map(id_and_text(df, id_col, text_col), spec_path, BoundaryCodec, run, "doc_id long, ids array<int>, text string")
