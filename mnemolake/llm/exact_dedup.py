"""Exact deduplication by composable polynomial fingerprints.

A text is normalised (its ASCII white space goes) and cut into chunks. A chunk's hash is a polynomial in its bytes for
two primes; hashes of neighbours combine by arithmetic, hash(ab) = hash(a) * base ** len(b) + hash(b), so the chunks of
a huge document may be hashed in any order or in parallel: those of texts of more than HUGE bytes become rows that are
dealt to all tasks, and Spark combines their hashes in order. Rows with equal fingerprints then undergo a comparison of
their texts, chunk after chunk: Spark merges equal chunks before it shuffles them, and where a chunk of one fingerprint
has two contents, the fingerprint's rows are told apart by the SHA-256 of their texts as well.

Null texts count as empty; all empty texts are equal. Of equal texts the one with the most code points in the original
stays, then the smallest doc_id (null last), then, for rows that repeat a doc_id, one of them. An empty table gives an
empty result. Extra columns are ignored. A group of copies of any size is aggregated before it is shuffled, and only
joins that split skewed partitions bring its rows together with its result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import id_and_text, map_batches, materialize, small_batches, texts
from mnemolake.llm.words import WHITE

CHUNK = 1 << 16
#: Texts of more bytes are hashed by several tasks.
HUGE = 8 << 20
#: How a null id is joined.
_NULL = -(1 << 63)
#: Primes below 2**31 and bases for them.
PRIMES, BASES = (2_147_483_647, 2_147_483_629), (1_000_003, 999_983)


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base ** (n - 1), ..., base, 1."""
    out = [1]
    for _ in range(n - 1):
        out.append(out[-1] * base % prime)
    return np.array(out[::-1], np.uint64)


class Fingerprint:
    """(hashes, length): a monoid over byte strings."""

    def __init__(self, primes: tuple[int, ...] = PRIMES, bases: tuple[int, ...] = BASES, chunk: int = CHUNK):
        self.primes, self.bases, self.chunk = primes, bases, chunk
        self.powers = [_powers(b, p, chunk) for p, b in zip(primes, bases)]

    def of_chunk(self, data: bytes) -> tuple[tuple[int, ...], int]:
        # a byte plus 1, so that leading zero bytes count; below 2**56 in sum
        x = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        return tuple(int(x @ w[self.chunk - len(x) :]) % p for p, w in zip(self.primes, self.powers)), len(x)

    def combine(self, a, b):
        """The fingerprint of two byte strings one after the other."""
        return tuple((x * pow(g, b[1], p) + y) % p for x, y, p, g in zip(a[0], b[0], self.primes, self.bases)), a[1] + b[1]

    def of(self, data: bytes):
        total = ((0,) * len(self.primes), 0)
        for at in range(0, len(data), self.chunk):
            total = self.combine(total, self.of_chunk(data[at : at + self.chunk]))
        return total


def normal(data: bytes) -> bytes:
    return data.translate(None, WHITE)


_TOLD = "doc_id long, n_points long, n_bytes long, fp long, text_sha256 string"


def fingerprints(df: DataFrame, hasher: Fingerprint | None = None, id_col: str = "doc_id", text_col: str = "text", huge: int = HUGE) -> DataFrame:
    """doc_id, n_points (code points of the text), n_bytes and fp (of the normalised text), text_sha256."""
    small_batches(df.sparkSession)
    texts_ = id_and_text(df, id_col, text_col)
    size = F.octet_length("text")
    return _of_texts(texts_.filter(size <= huge), hasher).unionByName(_of_chunks(texts_.filter(size > huge), hasher))


def _of_chunks(docs: DataFrame, hasher: Fingerprint | None) -> DataFrame:
    """fingerprints() of long texts: their chunks are hashed where there is room, then combined in order."""
    primes, bases, chunk = (hasher.primes, hasher.bases, hasher.chunk) if hasher else (PRIMES, BASES, CHUNK)

    def cut(batches):
        for batch in batches:
            points = pc.utf8_length(batch.column(1)).to_pylist()
            for doc, n_points, text in zip(batch.column(0).to_pylist(), points, texts(batch.column(1))):
                text = normal(text)
                sha, size = hashlib.sha256(text).hexdigest(), len(text)
                for n, at in enumerate(range(0, max(1, size), chunk)):
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc], pa.int64()), "n_points": [n_points], "n_bytes": [size], "text_sha256": [sha], "n": [n], "content": pa.array([text[at : at + chunk]], pa.binary())})

    def hash_(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = Fingerprint(primes, bases, chunk)
        hashes = [own.of_chunk(x) for x in batch.column(5).to_pylist()]
        each = pa.array([[{"hash": h, "shift": pow(g, n, p)} for h, p, g in zip(hs, primes, bases)] for hs, n in hashes], pa.list_(pa.struct([("hash", pa.int64()), ("shift", pa.int64())])))
        return pa.RecordBatch.from_arrays([*batch.columns[:5], each], [*batch.schema.names[:5], "parts"])

    same = "doc_id long, n_points long, n_bytes long, text_sha256 string, n long"
    rows = docs.mapInArrow(cut, f"{same}, content binary").repartition("doc_id", "text_sha256", "n")
    rows = map_batches(rows, hash_, f"{same}, parts array<struct<hash:long,shift:long>>")
    # chunks are told apart by what their text is, so a task that runs again makes the same ones; rows that repeat an id and a text share them
    ordered = F.sort_array(F.collect_set(F.struct("n", "parts")))
    total = lambda i, p: F.aggregate("all", F.lit(0).cast("long"), lambda s, x: (s * x["parts"][i]["shift"] + x["parts"][i]["hash"]) % p)
    fp = sum((total(i, p) * (1 << 31 * i) for i, p in enumerate(primes)), F.lit(0).cast("long"))
    once = rows.groupBy("doc_id", "n_points", "n_bytes", "text_sha256").agg(ordered.alias("all"), F.count(F.when(F.col("n") == 0, 1)).cast("int").alias("copies"))
    told = once.select("doc_id", "n_points", "n_bytes", fp.alias("fp"), "text_sha256", "copies")
    return told.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


def _of_texts(docs: DataFrame, hasher: Fingerprint | None) -> DataFrame:
    primes, bases, chunk = (hasher.primes, hasher.bases, hasher.chunk) if hasher else (PRIMES, BASES, CHUNK)
    made: list[Fingerprint] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Fingerprint(primes, bases, chunk))
        size, fp, sha = [], [], []
        for x in texts(batch.column(1)):
            x = normal(x)
            hashes, n = made[0].of(x)
            size.append(n)
            fp.append(sum(h << 31 * i for i, h in enumerate(hashes)))
            sha.append(hashlib.sha256(x).hexdigest())
        points = pc.utf8_length(batch.column(1)).cast(pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), points, pa.array(size, pa.int64()), pa.array(fp, pa.int64()), pa.array(sha)], ["doc_id", "n_points", "n_bytes", "fp", "text_sha256"])

    return map_batches(docs, run, _TOLD)


def _collisions(df: DataFrame, marked: DataFrame, hasher: Fingerprint, id_col: str, text_col: str) -> DataFrame:
    """n_bytes and fp of which some chunk has different contents. marked: the ids, once each, of rows to compare; rows
    that share such an id are compared too."""
    primes, bases, chunk = hasher.primes, hasher.bases, hasher.chunk

    def chunks(batches):
        own = Fingerprint(primes, bases, chunk)
        for batch in batches:
            for text in texts(batch.column(0)):
                text = normal(text)
                hashes, n = own.of(text)
                fp = sum(h << 31 * i for i, h in enumerate(hashes))
                parts = [text[at : at + chunk] for at in range(0, len(text), chunk)]
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(parts), pa.int64()), pa.array([fp] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["n_bytes", "fp", "chunk", "content"])

    rows = id_and_text(df, id_col, text_col).withColumn("id", F.coalesce("doc_id", F.lit(_NULL)))
    rows = rows.join(marked.hint("shuffle_hash"), "id", "left_semi").select("text")
    each = rows.mapInArrow(chunks, "n_bytes long, fp long, chunk int, content binary").distinct()
    return each.groupBy("n_bytes", "fp", "chunk").count().filter("count > 1").select("n_bytes", "fp").distinct()


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hasher: Fingerprint | None = None, huge: int = HUGE) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    rows = materialize(fingerprints(df, hasher, id_col, text_col, huge).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    by = ["n_bytes", "fp", "tie"]
    best = F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("id"), F.bitwise_not("row").alias("row"))).alias("best")

    def groups(of: DataFrame) -> DataFrame:
        return of.groupBy(*by).agg(F.count("*").alias("group_size"), best).filter("group_size > 1")

    plain = rows.withColumn("tie", F.lit(""))
    found = materialize(groups(plain), "equal-fingerprints")
    alike = rows.join(found.select("n_bytes", "fp"), ["n_bytes", "fp"], "left_semi").select(F.coalesce("doc_id", F.lit(_NULL)).alias("id")).distinct()
    unequal = materialize(_collisions(df, materialize(alike, "to-compare"), hasher or Fingerprint(), id_col, text_col), "collisions")
    if not unequal.isEmpty():
        # different texts behind one fingerprint: a rarity by construction, so few rows are dealt again
        plain = rows.join(unequal.withColumn("hit", F.lit(True)), ["n_bytes", "fp"], "left").withColumn("tie", F.when(F.col("hit"), F.col("text_sha256")).otherwise("")).drop("hit")
        plain = materialize(plain, "fingerprints-told-apart")
        found = materialize(groups(plain), "equal-texts")
    out = plain.join(found, by, "left")
    keep = F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.bitwise_not("best.id"))
    kept = F.col("best").isNull() | (F.col("best.row") == F.bitwise_not("row"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")
