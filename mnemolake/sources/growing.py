"""A stream of the lines that are added to files: complete lines only, each once, and all of them again where a file was
written anew.

An offset holds, for each file, the number of bytes up to its last line end, and a fingerprint of the bytes before. A
later batch reads on from there if the file still has that fingerprint; a file that was cut, or replaced by another text,
however long, is read from its begin. What follows the last line end waits until the line is complete. The driver lists
files and reads a few bytes of each; contents are read in the tasks, in ranges of SPLIT bytes, so one huge file is many
tasks. Where nothing but the length matters, no file is read twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "file string, offset long, line string, anew boolean"
#: Bytes of a task, bytes that a fingerprint covers, bytes that are looked at together, lines of a batch.
SPLIT, WINDOW, CHUNK, LINES = 64 << 20, 64, 1 << 16, 8192


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def last_line_end(source, size: int) -> int:
    """Bytes up to the last line end of an open file, 0 if it has none."""
    end = size
    while end > 0:
        begin = max(0, end - CHUNK)
        source.seek(begin)
        at = source.read(end - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        end = begin
    return 0


def fingerprint(source, offset: int) -> str:
    """Hash of the WINDOW bytes before an offset, or of as many as there are."""
    begin = max(0, offset - WINDOW)
    source.seek(begin)
    return hashlib.blake2b(source.read(offset - begin), digest_size=16).hexdigest()


def resume(source, size: int, before: list | None) -> int:
    """Where to read on in an open file of which [offset, fingerprint] was seen before."""
    if not before or before[0] > size or fingerprint(source, before[0]) != before[1]:
        return 0
    return before[0]


class _Part(InputPartition):
    def __init__(self, root: str, file: str, begin: int, end: int, limit: int, first: bool, anew: bool) -> None:
        self.root, self.file, self.begin, self.end, self.limit, self.first, self.anew = root, file, begin, end, limit, first, anew


def lines_between(source, begin: int, end: int, limit: int, first: bool) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each line that begins in [begin, end), read up to `limit`, which is a line end. Unless `first`,
    a line that begins before is left out."""
    at, rest, skip = begin, b"", not first
    if skip:  # does a line end just before?
        source.seek(begin - 1)
        skip = source.read(1) != b"\n"
    source.seek(begin)
    read = begin
    while at < end and read < limit:
        piece = source.read(min(CHUNK, limit - read))
        if not piece:  # the file was cut meanwhile
            return
        read += len(piece)
        rest += piece
        *whole, rest = rest.split(b"\n")
        for line in whole:
            if at >= end:
                return
            if skip:
                skip = False
            else:
                yield at, line
            at += len(line) + 1


class _Reader(DataSourceStreamReader):
    def __init__(self, options) -> None:
        self.root, self.suffix, self.split = options["path"], options.get("suffix", ""), int(options.get("split", SPLIT))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, root = _filesystem(self.root)
        out = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type == fs.FileType.File and info.path.endswith(self.suffix) and not info.base_name.startswith((".", "_")):
                with system.open_input_file(info.path) as source:
                    end = last_line_end(source, source.size())
                    out[info.path] = [end, fingerprint(source, end)]
        return out

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        system, _ = _filesystem(self.root)
        parts = []
        for file, (limit, seen) in sorted(end.items()):
            if start.get(file) == [limit, seen]:
                continue
            with system.open_input_file(file) as source:
                begin = resume(source, source.size(), start.get(file))
            begin = begin if begin <= limit else 0
            for at in range(begin, limit, self.split):
                parts.append(_Part(self.root, file, at, min(at + self.split, limit), limit, at == begin, begin == 0))
        return parts

    def read(self, partition: _Part):
        import pyarrow as pa

        system, _ = _filesystem(partition.root)
        names = ["file", "offset", "line", "anew"]

        def batch(held):
            offsets, lines = zip(*held)
            text = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines]
            return pa.RecordBatch.from_arrays([pa.array([partition.file] * len(text)), pa.array(offsets, pa.int64()), pa.array(text, pa.string()), pa.array([partition.anew] * len(text))], names)

        with system.open_input_file(partition.file) as source:
            held, size = [], 0
            for offset, line in lines_between(source, partition.begin, partition.end, partition.limit, partition.first):
                held.append((offset, line))
                size += len(line)
                if len(held) >= LINES or size >= SPLIT // 8:
                    yield batch(held)
                    held, size = [], 0
            if held:
                yield batch(held)

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> _Reader:
        return _Reader(dict(self.options))


def growing_lines(spark: SparkSession, path: str, suffix: str = ".jsonl", split: int = SPLIT) -> DataFrame:
    """file, offset (bytes before the line), line, anew (its file was read from the begin in this batch), as a stream.

    path: a folder, also of a store that Arrow opens; files in folders below count, names with a first "." or "_" don't.
    Bytes that aren't UTF-8 are replaced; a line ends with a line feed, a carriage return before it goes. An empty folder,
    or one that isn't there yet, gives nothing. A file that vanishes gives nothing, and all its lines if it comes back.
    """
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("suffix", suffix).option("split", str(split)).load(path)
