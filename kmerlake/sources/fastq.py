"""FASTQ as a data source of Spark's: files split by byte ranges, malformed records an error.

``register(spark)``, then ``spark.read.format("fastq").load(path)`` gives (file,
offset, name, seq).  A plain file is read in ranges of ``splitBytes``; a record
belongs to the range in which its header begins, and a range that begins inside a
record finds the next header by itself: among four-line records only a header has
``@`` at its start and a line with ``+`` two lines on.  Compressed files (.gz, .bz2,
.zst) are one range each.  Stores are those that Arrow's file systems reach (local
paths, s3, gs, hdfs); ``files.fastq`` reads from any store of Spark's but leaves
malformed records out.

The option ``onError`` is ``fail`` (file, offset and what is wrong are told) or
``drop``, which goes on with the next header.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, offset long, name string, seq string"
_ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("name", pa.string()), ("seq", pa.string())])
_PACKED = (".gz", ".bz2", ".zst")
_LOOK_AHEAD = 8


class MalformedFastq(ValueError):
    pass


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int | None  # None: a compressed file, read to its end

    def __post_init__(self):
        super().__init__(None)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, of all files in a folder, or of those that a pattern in the last part matches."""
    from fnmatch import fnmatch

    system, plain = file_system(path)
    head = path[: len(path) - len(plain)]
    folder, _, last = plain.rpartition("/")
    if any(c in last for c in "*?["):
        found = [x for x in system.get_file_info(fs.FileSelector(folder or ".")) if x.type == fs.FileType.File and fnmatch(x.base_name, last)]
    else:
        info = system.get_file_info(plain)
        found = [info] if info.type == fs.FileType.File else []
        if info.type == fs.FileType.Directory:
            found = [x for x in system.get_file_info(fs.FileSelector(plain, recursive=True)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]
    if not found:
        raise FileNotFoundError(f"no FASTQ file at {path}")
    return sorted((head + x.path, x.size) for x in found)


def _lines(path: str, start: int, packed: bool, block: int = 1 << 22) -> Iterator[tuple[int, bytes]]:
    """(offset, line) from the first line that begins at ``start`` or later; a last line needs no line end."""
    system, plain = file_system(path)
    with system.open_input_stream(plain) if packed else system.open_input_file(plain) as source:
        offset, rest = start, b""
        if start:
            source.seek(start - 1)
            offset = start - 1
        fresh = not start
        while data := source.read(block):
            rest += data
            lines = rest.split(b"\n")
            rest = lines.pop()
            for line in lines:
                if fresh:
                    yield offset, line.removesuffix(b"\r")
                fresh = True
                offset += len(line) + 1
        if rest and fresh:
            yield offset, rest.removesuffix(b"\r")


def _is_head(window: list[tuple[int, bytes]], i: int) -> bool:
    return window[i][1].startswith(b"@") and i + 2 < len(window) and window[i + 2][1].startswith(b"+")


def _fault(record: list[tuple[int, bytes]]) -> str | None:
    if len(record) < 4:
        return "the file ends within a record"
    head, seq, plus, quality = (line for _, line in record)
    if not head.startswith(b"@"):
        return "a header must begin with @"
    if not plus.startswith(b"+"):
        return "the third line must begin with +"
    if len(seq) != len(quality):
        return f"{len(seq)} bases but {len(quality)} qualities"
    return None


def records(path: str, start: int, end: int | None, drop: bool = False) -> Iterator[tuple[int, str, str]]:
    """(offset, name, seq) of the records whose header begins in the range."""
    lines = _lines(path, start, end is None)
    window: list[tuple[int, bytes]] = []

    def filled(size: int) -> list[tuple[int, bytes]]:
        while len(window) < size and (line := next(lines, None)) is not None:
            window.append(line)
        return window

    def only_empty() -> bool:
        """Whether nothing but empty lines is left in the file."""
        return len(filled(_LOOK_AHEAD)) < _LOOK_AHEAD and not any(line for _, line in window)

    def to_next_head(most: int | None) -> bool:
        """Leave lines out up to a header; whether one was found within ``most`` lines."""
        left = 0
        while filled(_LOOK_AHEAD):
            if _is_head(window, 0) or only_empty():
                return True
            if most is not None and left == most:
                return False
            window.pop(0)
            left += 1
        return True

    if start and not to_next_head(None if drop else 3):
        # No header among four lines: the record that is wrong may begin before the range, but lies at its begin.
        raise MalformedFastq(f"{path}: malformed record near byte {window[0][0]}: no header where one is due")
    while filled(4):
        if only_empty():
            return
        if end is not None and window[0][0] >= end:
            return
        record = window[:4]
        if fault := _fault(record):
            if not drop:
                name = record[0][1][1:].split(b" ")[0].decode(errors="replace")
                raise MalformedFastq(f"{path}: malformed record {name!r} at byte {record[0][0]}: {fault}")
            window.pop(0)
            to_next_head(None)
            continue
        del window[:4]
        head = record[0][1][1:].split(None, 1)
        yield record[0][0], head[0].decode(errors="replace") if head else "", record[1][1].decode(errors="replace")


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("a path is needed")
        self.split = int(options.get("splitBytes", 64 << 20))
        self.on_error = options.get("onError", "fail")
        if self.split < 1 or self.on_error not in ("fail", "drop"):
            raise ValueError("splitBytes must be positive and onError fail or drop")

    def partitions(self) -> list[Range]:
        out = []
        for path, size in files_of(self.path):
            if path.endswith(_PACKED):
                out.append(Range(path, 0, None))
            else:
                out += [Range(path, at, at + self.split) for at in range(0, size, self.split)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for record in records(partition.path, partition.start, partition.end, self.on_error == "drop") if partition.path else ():
            held.append((partition.path, *record))
            if len(held) == 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqSource)


def read_fastq(spark: SparkSession, path: str, split_bytes: int = 64 << 20, on_error: str = "fail") -> DataFrame:
    """(file, offset, name, seq) of the reads in a file, a folder or a pattern."""
    register(spark)
    return spark.read.format("fastq").option("splitBytes", split_bytes).option("onError", on_error).load(path)
