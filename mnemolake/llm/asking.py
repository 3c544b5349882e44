"""Batches of rows that ask each other what they have in common.

Rows are gathered in batches, each one row of a table in the shared folder. A batch sends what it asks about, hashed to
buckets, as one small row for each bucket; a bucket sees what all batches sent and answers each with bits, which come
back in the order of what was asked. So a value of whatever frequency costs a batch one entry, and no row is shuffled
for a value. Batches and buckets grow in number with the input; what a worker holds of either is bounded by their size.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import give_back, string_buffers
from mnemolake.llm.words import U64

#: Bytes of text in a batch, about, and bytes of text that a bucket answers for.
BATCH_BYTES, BUCKET_BYTES = 4 << 20, 24 << 20
#: How null ids sort.
NONE = -(1 << 63)
ASKED = "bucket int, batch string, blob binary"


def gather(df: DataFrame, size: int, text: str = "text", order: Iterable[str] = ("doc",), ask: Callable[[pa.Table], tuple] | None = None) -> DataFrame:
    """batch, packed, bucket, blob: the rows of df in batches of about `size` bytes of text, in order within, each a row
    with `packed`. A longer text makes a batch. With `ask`, what it returns for a batch (buckets, blobs) are rows too."""
    order = [(c, "ascending") for c in order]

    def pack(held: list[pa.RecordBatch]):
        import zstandard

        name, sink = uuid.uuid4().hex, pa.BufferOutputStream()
        table = pa.Table.from_batches(held).sort_by(order).combine_chunks()
        with pa.ipc.new_stream(sink, table.schema) as s:
            s.write_table(table)
        packed = zstandard.ZstdCompressor(level=3).compress(sink.getvalue())
        some, blobs = ask(table) if ask else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array([name] * (1 + len(blobs))), pa.array([packed] + [None] * len(blobs), pa.binary()), pa.array([None, *map(int, some)], pa.int32()), pa.array([None, *blobs], pa.binary())], ["batch", "packed", "bucket", "blob"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            at, _ = string_buffers(batch.column(batch.schema.names.index(text)))
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, min(batch.num_rows, int(np.searchsorted(at, at[begin] + size - n, side="left"))))
                held.append(batch.slice(begin, end - begin))
                n += int(at[end] - at[begin])
                begin = end
                if n >= size:
                    yield from pack(held)
                    held, n = [], 0
        if held:
            yield from pack(held)
        give_back()

    return df.mapInArrow(run, "batch string, packed binary, bucket int, blob binary")


def split(gathered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Batches (batch, packed) and asks (bucket, batch, blob) of a table that gather() made."""
    return gathered.filter("packed is not null").select("batch", "packed"), gathered.filter("blob is not null").select("bucket", "batch", "blob")


def unpack(packed: bytes) -> pa.Table:
    import zstandard

    with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(packed)) as s:
        return s.read_all().combine_chunks()


def bucket_count(df: DataFrame, text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets, so that each answers for a bounded part of the texts."""
    total = df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(1, partitions, -(-total // bucket_bytes)), 1 << 24)


def codes(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 40 bits of a key in one number, which sorts by bucket."""
    return (keys >> U64(40)) % U64(buckets) << U64(40) | keys & U64((1 << 40) - 1)


def bounds(sorted_codes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that occur, and where the part of each starts and ends."""
    own = (sorted_codes >> U64(40)).astype(np.int64)
    some = np.unique(own)
    return some, np.searchsorted(own, np.append(some, buckets))


def five(sorted_codes: np.ndarray) -> bytes:
    """The 40 bits of each code."""
    return np.ascontiguousarray(sorted_codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def from_five(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def asks(batch: str, some: np.ndarray, blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([batch] * len(blobs), pa.string()), pa.array(blobs, pa.binary())], ["bucket", "batch", "blob"])


def over_batches(batches: DataFrame, f: Callable[..., Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """f(*columns) for each row of batches, one after another."""

    def run(rows):
        for rows_ in rows:
            for i in range(rows_.num_rows):
                yield from f(*(c[i].as_py() for c in rows_.columns))
        give_back()

    return batches.mapInArrow(run, schema)


def answers(asked: DataFrame, buckets: int, decide: Callable[[list[bytes]], list[np.ndarray]], name: str) -> DataFrame:
    """For each batch, in a column `name`, the bits that `decide` gives to what it asked, by bucket. Rows without a batch
    only tell a bucket something."""

    def run(rows):
        held: dict[int, list] = {}
        for batch in rows:
            for b, who, blob in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(b, []).append((who, blob))
        for b in list(held):
            own = held.pop(b)
            bits = decide([blob for _, blob in own])
            told = [(who, np.packbits(x).tobytes()) for (who, _), x in zip(own, bits) if who is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in told], pa.string()), pa.array([b] * len(told), pa.int32()), pa.array([x for _, x in told], pa.binary())], ["batch", "bucket", "bits"])
        give_back()

    told = asked.select("bucket", "batch", "blob").repartitionById(buckets, "bucket").mapInArrow(run, "batch string, bucket int, bits binary")
    # as many as there are buckets, of a few bytes each
    return told.groupBy("batch").agg(F.collect_list(F.struct("bucket", F.col("bits").alias("bits"))).alias(name))


def told(given, some: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Bits of the answers to a batch, in the order of its sorted codes."""
    out = np.zeros(int(begin[-1]) if len(begin) else 0, bool)
    at = dict(zip(some.tolist(), range(len(some))))
    for a in given or ():
        i = at[a["bucket"]]
        out[begin[i] : begin[i + 1]] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=int(begin[i + 1] - begin[i])).astype(bool)
    return out
