"""Growing files as a stream: a source that knows how many bytes of each file it has handed on.

    spark.dataSource.register(RecordTail)
    spark.readStream.format("record_tail").option("kind", "log").load(folder)

A row is (file, at, record): at is the byte where the record begins. An offset is the bytes taken of each file, so a restart goes
on in the middle of a file, and a batch that is run again reads the same bytes. Half a record at a file's end is left for
later. Files may only grow. A batch's bytes are split into ranges of ``chunk`` bytes, read in parallel; a task takes as many of them
as make PACK bytes, or a part of PARTS of a batch that has less, so neither small files nor small ranges cost a task each.

Kinds: 'frames', which end with an empty line, and 'log', whose records begin with a line that begins with a time. The last
record of a log is complete when another one follows, or when it ends with a line break and is no JSON that is still open.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from strandline.sources.paths import files_below, opened

SCHEMA = "file string, at long, record string"
LOG_START = re.compile(rb"(?:\A|(?<=\n))\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3} - ")
LOG_BODY = re.compile(r"\A[^\n]*?\w+: ([\[{].*)\Z", re.DOTALL)
STEP = 1 << 16
#: A file's last record is looked for in so many bytes at its end first.
BACK = 1 << 12
PACK, PARTS = 32 << 20, 64


class Range(InputPartition):
    """Records that begin in [start, stop) of a file of which ``end`` bytes are complete."""

    def __init__(self, file: str, start: int, stop: int, end: int) -> None:
        self.file, self.start, self.stop, self.end = file, start, stop, end


class Pack(InputPartition):
    """Ranges that one task reads."""

    def __init__(self, ranges: list[Range]) -> None:
        self.ranges = ranges


def packed(ranges: list[Range]) -> list[Pack]:
    """The ranges, in order, in packs of about PACK bytes, or of a part of PARTS where all have less than PARTS packs."""
    most = min(PACK, -(-sum(r.stop - r.start for r in ranges) // PARTS))
    packs: list[Pack] = []
    held = most
    for r in ranges:
        if held >= most:
            packs.append(Pack([]))
            held = 0
        packs[-1].ranges.append(r)
        held += r.stop - r.start
    return packs


def _log_is_whole(record: bytes) -> bool:
    if not record.endswith(b"\n"):
        return False
    body = LOG_BODY.match(record.decode("utf-8", "replace"))
    if not body:
        return True
    try:
        json.loads(body[1])
    except ValueError:
        return False
    return True


def _whole_end(read, size: int, kind: str) -> int:
    """Up to where the first ``size`` bytes are whole records; looks back from the end as far as the last record begins."""
    back = BACK
    while True:
        start = max(0, size - back)
        data = read(start, size - start)
        if kind == "frames":
            at = data.rfind(b"\n\n")
            if at >= 0:
                return start + at + 2
        else:
            last = None
            for m in LOG_START.finditer(data, 0 if start == 0 else 1):  # with a byte before it, to see the line break
                last = m.start()
            if last is not None:
                return size if _log_is_whole(data[last:]) else start + last
        if start == 0:
            return 0
        back *= 4


def _records(read, r: Range, kind: str, step: int = STEP) -> Iterator[tuple[int, bytes]]:
    """(at, record) of the records that begin in the range; they may end beyond it."""
    before = 2 if kind == "frames" else 1  # what tells whether a record begins just at the range's start
    at = max(0, r.start - before)
    held, begin, place = b"", at, 0
    # held: bytes from begin on; those from place on are not yet told apart
    first = True
    while True:
        data = read(at, min(step, r.end - at)) if at < r.end else b""
        at += len(data)
        held, begin, place = held[place:] + data, begin + place, 0
        ended = at >= r.end
        if first:
            skip = _first_start(held, begin, r.start, kind)
            if skip is None:
                if ended or begin + len(held) > r.stop + 64:  # a beginning before stop would be in sight
                    return
                continue
            place, first = skip, False
        while begin + place < r.stop:
            size = _record_size(held, kind, ended, place)
            if not size:
                break
            yield begin + place, held[place : place + size]
            place += size
        if begin + place >= r.stop or ended:
            return


def _first_start(data: bytes, begin: int, start: int, kind: str) -> int | None:
    """Where in data, which begins at byte begin, the first record at or after start begins."""
    if start == 0:
        return 0
    if kind == "frames":
        at = data.find(b"\n\n", max(0, start - 2 - begin))
        return None if at < 0 else at + 2
    m = LOG_START.search(data, start - begin)
    return None if m is None else m.start()


def _record_size(data: bytes, kind: str, ended: bool, place: int = 0) -> int:
    """How many bytes the record at a place of data has, 0 if that can't be told yet."""
    if kind == "frames":
        at = data.find(b"\n\n", place)
        return at + 2 - place if at >= 0 else 0
    m = LOG_START.search(data, place + 1)
    return m.start() - place if m else len(data) - place if ended else 0


def _reading(path: str):
    system, where = opened(path)
    file = system.open_input_file(where)
    return lambda start, size: file.read_at(size, start)


class _Tail:
    def __init__(self, options: dict) -> None:
        self.path, self.kind, self.chunk = options["path"], options.get("kind", "log"), int(options.get("chunk", 32 << 20))
        if self.kind not in ("log", "frames"):
            raise ValueError(f"kind {self.kind}")
        self.known: dict[str, tuple[int, int]] = {}  # size and whole end of each file, so that only files that grew are looked at

    def ends(self) -> dict[str, int]:
        for path, size in files_below(self.path):
            if self.known.get(path, (-1, 0))[0] != size:
                self.known[path] = (size, _whole_end(_reading(self._uri(path)), size, self.kind))
        return {p: end for p, (_, end) in self.known.items() if end}

    def _uri(self, path: str) -> str:
        """A listed path with the scheme of the folder's."""
        scheme, sign, _ = self.path.partition("://")
        return f"{scheme}://{path}" if sign else path

    def ranges(self, start: dict[str, int], end: dict[str, int]) -> list[Range]:
        out = []
        for path, stop in sorted(end.items()):
            at = start.get(path, 0)
            while at < stop:
                out.append(Range(path, at, min(at + self.chunk, stop), stop))
                at += self.chunk
        return out

    def rows(self, r: Range) -> Iterator[tuple]:
        for at, record in _records(_reading(self._uri(r.file)), r, self.kind):
            yield r.file, at, record.decode("utf-8", "replace")


class TailStream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.tail = _Tail(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.tail.ends()

    def partitions(self, start: dict, end: dict) -> list[Pack]:
        return packed(self.tail.ranges(start, end))

    def read(self, partition: Pack) -> Iterator[tuple]:
        return (row for r in partition.ranges for row in self.tail.rows(r))


class TailBatch(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.tail = _Tail(options)

    def partitions(self) -> list[Pack]:
        return packed(self.tail.ranges({}, self.tail.ends())) or [Pack([])]

    def read(self, partition: Pack) -> Iterator[tuple]:
        return (row for r in partition.ranges for row in self.tail.rows(r))


class RecordTail(DataSource):
    """Options: path, kind ('log' or 'frames'), chunk (bytes of a range)."""

    @classmethod
    def name(cls) -> str:
        return "record_tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TailBatch:
        return TailBatch(dict(self.options))

    def streamReader(self, schema) -> TailStream:
        return TailStream(dict(self.options))
