"""A data source of number traces in members of zip archives."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of archives that a task gets, about, and numbers of a batch of rows.
TASK_BYTES, BATCH_NUMBERS = 64 << 20, 1 << 18


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a path or a URI, of one slash or three."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def number(word: bytes) -> float | None:
    try:
        return float(word)
    except ValueError:
        return None


class Archives(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(None)
        self.files = files


class ZippedTraces(DataSource):
    """(file, line, trace) of the lines of the member of each archive below path. Options: path, member."""

    @classmethod
    def name(cls) -> str:
        return "zipped_traces"

    def schema(self) -> str:
        return "file string, line long, trace array<double>"

    def reader(self, schema) -> DataSourceReader:
        return ZippedReader(self.options["path"], self.options["member"])


class ZippedReader(DataSourceReader):
    def __init__(self, path: str, member: str):
        self.path, self.member = path, member.lower()

    def partitions(self) -> list[Archives]:
        """Archives in lists of about TASK_BYTES; only names and sizes are looked at here."""
        place, path = opened(self.path)
        info = place.get_file_info(path)
        found = [info] if info.is_file else place.get_file_info(fs.FileSelector(path, recursive=True))
        dealt, size = [[]], 0
        for f in sorted((f for f in found if f.is_file and f.path.lower().endswith(".zip")), key=lambda f: f.path):
            if dealt[-1] and size + f.size > TASK_BYTES:
                dealt.append([])
                size = 0
            dealt[-1].append(f.path)
            size += f.size
        return [Archives(files) for files in dealt]

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        place, _ = opened(self.path)
        for path in partition.files:
            with place.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                for entry in z.infolist():
                    if PurePosixPath(entry.filename).name.lower() == self.member:
                        with z.open(entry) as lines:
                            yield from batches(path, lines)


def batches(path: str, lines) -> Iterator[pa.RecordBatch]:
    """Lines as batches of about BATCH_NUMBERS numbers; blank lines count but aren't rows, what is no number is null."""
    at, traces, held = [], [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(traces, pa.list_(pa.float64()))], ["file", "line", "trace"])

    for k, line in enumerate(lines):
        if words := line.split():
            at.append(k)
            traces.append([number(w) for w in words])
            held += len(words)
        if held >= BATCH_NUMBERS:
            yield batch()
            at, traces, held = [], [], 0
    if at:
        yield batch()
