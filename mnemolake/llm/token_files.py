"""Token ids in Arrow files with batches of fixed-size lists.

A file holds consecutive documents in ascending doc_id order as one stream of ids, cut into sequences of equal length:
columns `tokens` (fixed-size list of uint16, or uint32 where the vocabulary needs it) and `mask` (fixed-size list of
bool, false on the padding that ends a file). It is Arrow's stream format with the footer that allows random access,
uncompressed, so a memory-mapped reader gets any sequence without copying. Beside it lies an index stream of doc_id,
offset and length. The manifest lists the files that count; what a lost or repeated task attempt wrote is in none.

Null and empty texts have the end id alone. Null doc_ids come first; rows that repeat a doc_id follow each other. An
empty table gives a manifest without rows. A very long document spans sequences and batches. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemolake.llm.bpe import codec_of, in_parts, read_spec
from mnemolake.llm.common import give_back, id_and_text, materialize, shared_dir, small_batches, texts

#: Ids in a sequence and sequences in a batch.
SEQUENCE, BATCH = 2048, 64
#: Bytes of text that a file holds, about, unless more shuffle partitions ask for smaller ones; documents that a task reads.
FILE_BYTES, READ_DOCUMENTS = 64 << 20, 20_000
MANIFEST = "part int, path string, documents long, tokens long, sequences long"


def _ranges(df: DataFrame, parts: int) -> list[int]:
    """Upper ends of doc_id ranges with about as many rows each: a read of the one column."""
    ends = df.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    return sorted({int(x) for x in ends})


def write(df: DataFrame, spec_path: str, end_id: int, out_dir: str | None = None, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """Writes the files; returns the manifest, one row for each."""
    import zstandard

    spark = df.sparkSession
    small_batches(spark)
    spec = spark.sparkContext.broadcast(read_spec(spec_path))
    docs = id_and_text(df, id_col, text_col)
    folder = out_dir or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ends = _ranges(docs, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_BYTES)))

    def encode(batches):
        codec, zip_ = codec_of(spec.value), zstandard.ZstdCompressor(level=1)
        kind = np.uint16 if max(codec.size, end_id + 1) <= 1 << 16 else np.uint32
        end = np.array([end_id], kind)
        for batch in batches:
            packed = [zip_.compress(np.append(x.astype(kind), end).tobytes()) for part in in_parts(texts(batch.column(1))) for x in codec.encode(part)]
            doc = batch.column(0)
            part = np.searchsorted(np.array(ends, np.int64), doc.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([doc, pa.array(part), pa.array([kind().itemsize] * len(doc), pa.int32()), pa.array(packed, pa.binary())], ["doc_id", "part", "width", "ids"])
        codec.forget()
        give_back()

    def write_files(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        unzip, system, state = zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            for doc, part, width, packed in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(unzip.decompress(packed), np.uint16 if width == 2 else np.uint32)
                if state is not None and state.part != part:
                    yield state.close()
                    state = None
                if state is None:
                    if system is None:
                        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
                        system.create_dir(root, recursive=True)
                    name = f"part-{part:05d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
                    state = _File(system, f"{root}/{name}", f"{folder}/{name}", part, ids.dtype, sequence)
                state.add(doc, ids)
        if state is not None:
            yield state.close()

    dealt = docs.mapInArrow(encode, "doc_id long, part int, width int, ids binary").repartitionById(len(ends) + 1, "part").sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "ids")
    return materialize(dealt.mapInArrow(write_files, MANIFEST), "manifest")


class _File:
    """A file of sequences and its index, written batch by batch."""

    def __init__(self, system, where: str, path: str, part: int, kind: np.dtype, sequence: int):
        self.part, self.path, self.kind, self.sequence = part, path, np.dtype(kind), sequence
        self.schema = pa.schema([("tokens", pa.list_(pa.from_numpy_dtype(self.kind), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])
        self.out = system.open_output_stream(f"{where}.arrow")
        self.sequences = pa.ipc.new_file(self.out, self.schema)
        self.index_out = system.open_output_stream(f"{where}.index")
        self.index = pa.ipc.new_stream(self.index_out, self.index_schema)
        self.held, self.held_n, self.rows, self.at, self.n_rows, self.documents = [], 0, [], 0, 0, 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.rows.append((doc, self.at, len(ids)))
        self.at += len(ids)
        self.held.append(ids)
        self.held_n += len(ids)
        if self.held_n >= BATCH * self.sequence:
            self._flush(BATCH * self.sequence)
        if len(self.rows) >= 10_000:
            self._flush_index()

    def _flush(self, size: int, last: bool = False) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        whole = len(flat) // size * size
        for start in range(0, whole, size):
            self._batch(flat[start : start + size], size)
        rest = flat[whole:]
        if last and len(rest):
            rows = -(-len(rest) // self.sequence)
            self._batch(np.append(rest, np.zeros(rows * self.sequence - len(rest), self.kind)), len(rest))
            rest = rest[:0]
        self.held, self.held_n = [rest], len(rest)

    def _batch(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        self.sequences.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (flat, mask)], schema=self.schema))
        self.n_rows += len(flat) // self.sequence

    def _flush_index(self) -> None:
        doc, at, n = zip(*self.rows) if self.rows else ((), (), ())
        self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, at, n)], schema=self.index_schema))
        self.documents += len(self.rows)
        self.rows = []

    def close(self) -> pa.RecordBatch:
        self._flush(BATCH * self.sequence, last=True)
        self._flush_index()
        for x in (self.sequences, self.index, self.out, self.index_out):
            x.close()
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((self.part, pa.int32()), (self.path, pa.string()), (self.documents, pa.int64()), (self.at, pa.int64()), (self.n_rows, pa.int64()))], ["part", "path", "documents", "tokens", "sequences"])


class TokenReader:
    """Random access to a written file: `sequence(i)`, or the ids from any offset on, as views of the mapped file."""

    def __init__(self, path: str):
        from pyarrow import fs

        system, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        self.system, self.where = system, where
        source = pa.memory_map(f"{where}.arrow") if isinstance(system, fs.LocalFileSystem) else system.open_input_file(f"{where}.arrow")
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("tokens").type.list_size
        self.per_batch = self.file.get_batch(0).num_rows * self.length if self.file.num_record_batches else self.length
        self._last: tuple[int, pa.RecordBatch] | None = None

    def _batch(self, i: int) -> pa.RecordBatch:
        if self._last is None or self._last[0] != i:
            self._last = (i, self.file.get_batch(i))
        return self._last[1]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids, without a copy, and mask of sequence i."""
        rows = self.per_batch // self.length
        batch, at = self._batch(i // rows), i % rows * self.length
        return batch.column(0).values.to_numpy()[at : at + self.length], batch.column(1).values.slice(at, self.length).to_numpy(zero_copy_only=False)

    def spans(self, offset: int, n: int):
        """Views that together hold the n ids from offset on."""
        while n > 0:
            i, at = divmod(offset, self.per_batch)
            view = self._batch(i).column(0).values.to_numpy()[at : at + n]
            yield view
            offset, n = offset + len(view), n - len(view)

    def documents(self, begin: int = 0, end: int | None = None):
        """Index rows (doc_id, offset, n_tokens) of the documents from begin to end."""
        at = 0
        with self.system.open_input_stream(f"{self.where}.index") as source:
            for batch in pa.ipc.open_stream(source):
                part = batch.slice(max(0, begin - at), max(0, min(batch.num_rows, end - at if end is not None else batch.num_rows) - max(0, begin - at)))
                if part.num_rows:
                    yield part
                at += batch.num_rows
                if end is not None and at >= end:
                    return


def read(manifest: DataFrame, documents: int = READ_DOCUMENTS) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers). A file of more documents is read by several tasks."""
    spark = manifest.sparkSession
    # a row for each file: their running sum is small
    files = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pieces = files.select("path", "base", F.explode(F.sequence(F.lit(0), F.col("documents") - 1, F.lit(documents))).alias("begin"))

    def run(batches):
        for batch in batches:
            for path, base, begin in zip(*(c.to_pylist() for c in batch.columns)):
                reader = TokenReader(path)
                for docs in reader.documents(begin, begin + documents):
                    at, n = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                    crc = []
                    for o, m in zip(at.tolist(), n.tolist()):
                        c = 0
                        for view in reader.spans(o, m):
                            c = zlib.crc32(np.ascontiguousarray(view, dtype="<u4"), c)
                        crc.append(c)
                    yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(at + base), docs.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return pieces.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "begin").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
