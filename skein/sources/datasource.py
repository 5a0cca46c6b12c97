"""Transcripts as a data source of Spark: files of lines read in byte ranges, filters pushed into the reader, and a stream that follows growing files.

    spark.dataSource.register(TranscriptSource)
    spark.read.format("transcripts").option("path", folder).load()
    spark.readStream.format("transcripts").option("path", folder).load()

Options: `path` (a folder, searched in depth, or a file), `endings` (by default .jsonl,.json,.md,.txt), `split_bytes` (64 MB). Files are opened by
executors through pyarrow's file systems (file, hdfs, s3, gs, abfs). A row is a line that isn't blank: `file`, `stem` (its name without
ending), `offset` (the line's first byte, so its order), `line`. A range has the lines that begin in it, so every line is read
once whatever the ranges; a task holds a block of the file and the rows of one batch, never a whole file.

With the option `push` filters on stems and on substrings of lines go into the reader. Spark 4.1 keeps one reader for a loaded DataFrame,
so what one plan has pushed holds for all plans of that DataFrame: load it anew for each query that pushes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringContains

SCHEMA = "file string, stem string, offset long, line string"
_ARROW = pa.schema([("file", pa.string()), ("stem", pa.string()), ("offset", pa.int64()), ("line", pa.string())])
#: Bytes of a range, and read at a time; lines and bytes of a batch.
SPLIT, BLOCK, LINES, BATCH_BYTES = 64 << 20, 1 << 20, 4096, 8 << 20


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; one without a scheme is mounted by all machines alike."""
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def stem(name: str) -> str:
    base = name.rsplit("/", 1)[-1]
    return base.rsplit(".", 1)[0] or base


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int

    def __post_init__(self):
        self.value = (self.path, self.start, self.end)


def lines(stream, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of the lines that begin from start up to, but not including, end."""
    at = start
    if start:  # what began before belongs to another range
        at = start - 1
        stream.seek(at)
        while True:
            block = stream.read(BLOCK)
            cut = block.find(b"\n")
            if not block or cut >= 0:
                at += cut + 1 if block else 0
                break
            at += len(block)
        if not block:
            return
    stream.seek(at)
    rest: list[bytes] = []
    begun = at
    while begun < end:
        block = stream.read(BLOCK)
        if not block:
            break
        parts = block.split(b"\n")
        for part in parts[:-1]:
            line = b"".join([*rest, part])
            rest = []
            if begun >= end:
                return
            yield begun, line
            begun += len(line) + 1
        rest.append(parts[-1])
    if begun < end and any(rest):
        yield begun, b"".join(rest)


class Files:
    """What batch and stream readers share."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.endings = tuple(x.strip() for x in options.get("endings", ".jsonl,.json,.md,.txt").split(","))
        self.split = int(options.get("split_bytes", SPLIT))
        self.stems: set[str] | None = None
        self.needles: list[bytes] = []

    def listed(self) -> list[tuple[str, int]]:
        """Paths and sizes of the files, by path."""
        system, path = opened(self.root)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(self.endings) and (self.stems is None or stem(f.path) in self.stems))

    def ranges(self, path: str, start: int, end: int) -> list[Range]:
        return [Range(path, at, min(at + self.split, end)) for at in range(start, end, self.split)]

    def batches(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.root)
        offsets, texts, size = [], [], 0

        def batch():
            n = len(texts)
            return pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array([stem(part.path)] * n), pa.array(offsets, pa.int64()), pa.array(texts, pa.string())], schema=_ARROW)

        with system.open_input_file(part.path) as f:
            for at, line in lines(f, part.start, part.end):
                if not line.strip() or not all(n in line for n in self.needles):
                    continue
                offsets.append(at)
                texts.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                size += len(line)
                if len(texts) >= LINES or size >= BATCH_BYTES:
                    yield batch()
                    offsets, texts, size = [], [], 0
        if texts:
            yield batch()


class TranscriptReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = Files(options)
        self.push = str(options.get("push", "false")).lower() == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Stems choose files before any is opened; substrings of lines are looked for in their bytes. Others stay Spark's."""
        for f in filters:
            if not self.push:
                yield f
            elif isinstance(f, EqualTo) and f.attribute == ("stem",) and f.value is not None:
                self._only({f.value})
            elif isinstance(f, In) and f.attribute == ("stem",):
                self._only({v for v in f.value if v is not None})
            elif isinstance(f, StringContains) and f.attribute == ("line",) and "�" not in f.value:
                self.files.needles.append(f.value.encode())
            else:
                yield f

    def _only(self, stems: set[str]) -> None:
        self.files.stems = stems if self.files.stems is None else self.files.stems & stems

    def partitions(self) -> list[Range]:
        return [r for path, size in self.files.listed() for r in self.files.ranges(path, 0, size)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.files.batches(partition) if partition.path else iter(())


class TranscriptStream(DataSourceStreamReader):
    """An offset is how many bytes of each file are done: whole lines only, so a line that is being written waits. A file that shrank is read anew."""

    def __init__(self, options: dict):
        self.files = Files(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, _ = opened(self.files.root)
        return {path: self._whole(system, path, size) for path, size in self.files.listed()}

    @staticmethod
    def _whole(system, path: str, size: int) -> int:
        """The end of the last whole line among the first `size` bytes."""
        with system.open_input_file(path) as f:
            end = size
            while end > 0:
                start = max(0, end - BLOCK)
                cut = f.read_at(end - start, start).rfind(b"\n")
                if cut >= 0:
                    return start + cut + 1
                end = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, to in sorted(end.items()):
            done = start.get(path, 0)
            out += self.files.ranges(path, done if done <= to else 0, to)
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.files.batches(partition) if partition.path else iter(())


class TranscriptSource(DataSource):
    """SRC1: the source `transcripts`."""

    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TranscriptReader:
        return TranscriptReader(self.options)

    def streamReader(self, schema) -> TranscriptStream:
        return TranscriptStream(self.options)


def register(spark) -> None:
    """Makes the source known to a session; loads that ask for it (`push`) get their filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TranscriptSource)
