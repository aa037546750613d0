"""A source over one text file that grows: ``spark.readStream.format("tail").load(path)``, and ``spark.read`` for what it holds now.

The driver handles offsets only: the file's size and a digest of its first bytes. What lies between two offsets is cut into
ranges of ``rangeBytes``, and each range is read by a task. A line belongs to the range that holds its newline, and the task
looks back for where the line began, so a line may cross any number of ranges and batches, is told once, and without its
newline waits. A file that shrank or starts otherwise took the place of another and is read from its start; a batch that was
planned for a file since replaced is empty.

Rows are (value, seq): the line without its end, and the byte at which it starts, by which lines are in order. Options: ``replay``
(true: from the start, false: from what comes next), ``startBytes`` and ``endBytes`` (from or up to a byte, so that a batch of the
log up to a place and a stream from there share no line and lose none), ``rangeBytes``, and for streams ``batchBytes``, the bytes
that one batch takes at most (not with the availableNow trigger, which takes one step). The path is a file that driver and
executors can open, or a URI that pyarrow knows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

HEAD = 64
#: Bytes of a range, and of one read within it.
RANGE, STEP = 16 << 20, 1 << 20
SCHEMA = "value string, seq bigint"


def _open(path: str):
    """(file to read at will, its size); (None, 0) if there is none."""
    system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    try:
        file = system.open_input_file(place)
    except FileNotFoundError:
        return None, 0
    return file, file.size()


def _sign(file, size: int) -> str:
    return hashlib.sha1(file.read_at(size, 0) if size else b"").hexdigest()


def mark(path: str, size: int | None = None) -> dict:
    """The offset ``size`` bytes into the file, or at its end."""
    file, end = _open(path)
    size = end if size is None else min(size, end)
    head = min(size, HEAD)
    out = {"bytes": size, "head": head, "sign": _sign(file, head)}
    if file:
        file.close()
    return out


def _same(path: str, at: dict) -> bool:
    """Whether the file is still the one that the offset was taken from."""
    file, size = _open(path)
    if file is None:
        return not at["bytes"]
    with file:
        return size >= at["bytes"] and _sign(file, at["head"]) == at["sign"]


@dataclass
class Range(InputPartition):
    """The newlines of a file in [start, end), while its first bytes are those of ``sign``."""

    path: str
    start: int
    end: int
    head: int
    sign: str


def ranges(path: str, start: int, end: dict, size: int) -> list[Range]:
    return [Range(path, lo, min(lo + size, end["bytes"]), end["head"], end["sign"]) for lo in range(start, end["bytes"], size)]


def _began(file, at: int) -> int:
    """Where the line that holds the byte before ``at`` begins: after the newline before it."""
    while at:
        lo = max(0, at - STEP)
        found = file.read_at(at - lo, lo).rfind(b"\n")
        if found >= 0:
            return lo + found + 1
        at = lo
    return 0


def lines(part: Range) -> Iterator[pa.RecordBatch]:
    """The lines whose newlines the range holds, a step at a time."""
    file, size = _open(part.path)
    if file is None:
        return
    with file:
        if size < part.end or _sign(file, part.head) != part.sign:
            return
        at, held, begin = part.start, b"", None
        while at < part.end:
            data = file.read_at(min(STEP, part.end - at), at)
            stop = data.rfind(b"\n") + 1
            if stop:
                if begin is None:  # only now is it known that the range holds an end of a line
                    begin = _began(file, part.start)
                    held = file.read_at(part.start - begin, begin) + held
                whole = (held + data[:stop]).split(b"\n")[:-1]
                starts, k = [], begin
                for x in whole:
                    starts.append(k)
                    k += len(x) + 1
                yield pa.record_batch([pa.array([x.decode(errors="replace").removesuffix("\r") for x in whole]), pa.array(starts, pa.int64())], ["value", "seq"])
                held, begin = data[stop:], k
            else:
                held += data
            at += len(data)


class TailBatch(DataSourceReader):
    """What the file holds now, or up to ``endBytes``."""

    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("rangeBytes", RANGE))
        self.start, self.end = int(options.get("startBytes", 0)), options.get("endBytes")

    def partitions(self) -> list[Range]:
        return ranges(self.path, self.start, mark(self.path, None if self.end is None else int(self.end)), self.size) or [Range(self.path, 0, 0, 0, "")]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return lines(partition)


class TailStream(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("rangeBytes", RANGE))
        self.replay = options.get("replay", "true").lower() == "true"
        self.first, self.most = options.get("startBytes"), options.get("batchBytes")
        self.at: dict | None = None  # the last offset this reader has heard of

    def initialOffset(self) -> dict:
        self.at = mark(self.path, int(self.first) if self.first is not None else 0 if self.replay else None)
        return self.at

    def latestOffset(self) -> dict:
        size = None
        if self.most is not None and self.at is not None:
            size = int(self.most) + (self.at["bytes"] if _same(self.path, self.at) else 0)
        self.at = mark(self.path, size)
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.at = end
        begin = start["bytes"] if start["bytes"] <= end["bytes"] and _same(self.path, start) else 0
        return ranges(self.path, begin, end, self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return lines(partition)

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch."""


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TailBatch:
        return TailBatch(self.options)

    def streamReader(self, schema) -> TailStream:
        return TailStream(self.options)


def register(spark) -> None:
    """Make the source known to a session."""
    spark.dataSource.register(TailSource)
