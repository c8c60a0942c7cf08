"""Lines of growing log files as a stream: byte offsets as the cursor, rotation and truncation told apart.

``spark.dataSource.register(TailSource)``, then ``spark.readStream.format("tail").option("path", "/var/log/app/*.log")``. The
files have to be readable where the driver and its tasks run, as those of a host's agent are.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a line without its end; longer ones are dropped and told.
MAX_LINE = 1 << 20
#: Bytes that one task reads, beside the line that it begins in.
RANGE = 4 << 20


@dataclass
class Piece(InputPartition):
    """Bytes of a file, named by its identity, for a rotated file has another path. ``rest``: nothing will follow its last byte."""

    path: str
    file: tuple[int, int]
    start: int
    end: int
    rest: bool = False
    problem: str | None = None


def _identity(path: str) -> tuple[int, int, int] | None:
    try:
        s = os.stat(path, follow_symlinks=False)
    except FileNotFoundError:
        return None
    return (s.st_dev, s.st_ino, s.st_size) if os.path.isfile(path) and not os.path.islink(path) else None


def _located(path: str, file: tuple[int, int]) -> str | None:
    """Where the file of this identity is now: at its path, or renamed beside it."""
    folder = os.path.dirname(path)
    for found in [path, *sorted(e.path for e in os.scandir(folder))] if os.path.isdir(folder) else []:
        if (got := _identity(found)) and got[:2] == tuple(file):
            return found
    return None


def _cut(path: str, file: tuple[int, int], start: int, end: int, rest: bool = False) -> list[Piece]:
    cuts = [*range(start, end, RANGE), end]
    return [Piece(path, tuple(file), a, b, rest and b == end) for a, b in zip(cuts, cuts[1:])]


def pieces(start: dict, end: dict) -> list[Piece]:
    """What lies between two offsets ({path: [device, inode, bytes]}), as ranges of bytes."""
    out = []
    for path, (device, inode, size) in sorted(end.items()):
        old = start.get(path)
        if old is None:
            out += _cut(path, (device, inode), 0, size)
        elif old[:2] == [device, inode]:
            if size < old[2]:  # cut off and written anew
                out.append(Piece(path, (device, inode), 0, 0, problem="truncated"))
            out += _cut(path, (device, inode), old[2] if size >= old[2] else 0, size)
        else:
            found = _located(path, old[:2])
            if found is None:
                out.append(Piece(path, tuple(old[:2]), 0, 0, problem="lost"))
            else:
                last = max(_identity(found)[2], old[2])
                out += _cut(path, old[:2], old[2], last, True) or [Piece(path, tuple(old[:2]), last, last, True)]
            out += _cut(path, (device, inode), 0, size)
    return out


def lines_of(piece: Piece) -> Iterator[tuple[str, int, str | None, str | None]]:
    """(path, offset, line, problem) of each line whose end lies in the piece; it may have begun before it.

    Ends are line feeds, with a carriage return before them or not. A line of over ``MAX_LINE`` bytes is "oversized",
    what a rotated file ends with without an end is "partial"; both have no line. Bytes that are not UTF-8 are replaced.
    """
    if piece.problem:
        yield piece.path, piece.start, None, piece.problem
        return
    found = _located(piece.path, piece.file)
    if found is None:
        yield piece.path, piece.start, None, "lost"
        return
    with open(found, "rb") as f:
        back = max(0, piece.start - MAX_LINE - 2)
        f.seek(back)
        head = f.read(piece.start - back)
        cut = head.rfind(b"\n") + 1
        at, known = back + cut, cut > 0 or back == 0  # where the first line begins, if that is near enough
        data = head[cut:] + f.read(piece.end - piece.start)
    begin = 0
    while (stop := data.find(b"\n", max(begin, piece.start - at if begin == 0 else 0))) >= 0:
        line = data[begin:stop].removesuffix(b"\r")
        if len(line) > MAX_LINE or (begin == 0 and not known):
            yield piece.path, at + begin, None, "oversized"
        else:
            yield piece.path, at + begin, line.decode("utf-8", "replace"), None
        begin = stop + 1
    if piece.rest and begin < len(data):
        yield piece.path, at + begin, None, "partial"


class TailReader(DataSourceStreamReader):
    def __init__(self, pattern: str):
        self.pattern = pattern

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {p: list(found) for p in sorted(glob.glob(self.pattern)) if (found := _identity(p))}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return pieces(start, end)

    def read(self, partition: Piece) -> Iterator[tuple]:
        yield from lines_of(partition)


class TailSource(DataSource):
    """Stream of (path, offset, line, problem); option ``path``: a file or a pattern that matches live files only."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "path string, offset long, line string, problem string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"])
