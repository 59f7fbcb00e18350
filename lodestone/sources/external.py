"""Data sources that Spark has no reader for: change journals with positions, and live directory trees.

Register them with `register(spark)`; then spark.readStream.format("lodestone_journal") and spark.read.format("lodestone_tree") read
any place that Arrow's file systems reach: local disks, and stores by their addresses.

A journal is a folder of segments, <drive>/<journal id>/<first position>-<next position>.jsonl, of JSON lines in the order of seq. A
segment has all records from its first position up to its next one, and is written under another name before it gets this one. Old segments may go.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition, LessThan, LessThanOrEqual, SimpleDataSourceStreamReader, StringStartsWith
from pyspark.sql.types import StructType

JOURNAL = "drive string, journal_id long, seq long, file_ref long, parent_ref long, name string, is_dir boolean, reason long"
TREE = "path string, name string, is_dir boolean, depth int, length long, modified timestamp"
_SEGMENT = re.compile(r"(\d+)-(\d+)\.jsonl$")


class RescanNeeded(ValueError):
    """A saved position is of another journal or outside of what the journal has: only a full scan brings the state up to date."""


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Segment(InputPartition):
    drive: str
    journal_id: int
    first: int
    next: int
    path: str


def segments(path: str) -> dict[str, list[Segment]]:
    """Of each drive the segments of its journal, the one with the greatest id, in order. A gap between them is an error."""
    files, base = _opened(path)
    found: dict[str, dict[int, list[Segment]]] = {}
    for info in files.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
        parts = info.path.removeprefix(base).strip("/").split("/")
        if info.type == fs.FileType.File and len(parts) == 3 and parts[1].isdigit() and (m := _SEGMENT.fullmatch(parts[2])):
            found.setdefault(parts[0], {}).setdefault(int(parts[1]), []).append(Segment(parts[0], int(parts[1]), int(m[1]), int(m[2]), info.path))
    out = {}
    for drive, journals in sorted(found.items()):
        out[drive] = sorted(journals[max(journals)], key=lambda s: s.first)
        for a, b in zip(out[drive], out[drive][1:], strict=False):
            if a.next != b.first:
                raise RescanNeeded(f"{drive}: the journal has nothing from {a.next} to {b.first}")
    return out


def _records(files: fs.FileSystem, segment: Segment, start: int = 0) -> Iterator[tuple]:
    """Rows of a segment from a position on."""
    with files.open_input_stream(segment.path) as stream:
        rest = b""
        while block := stream.read(1 << 20):
            *lines, rest = (rest + block).split(b"\n")
            for line in lines:
                if line.strip() and (r := json.loads(line))["seq"] >= start:
                    yield (segment.drive, segment.journal_id, r["seq"], r.get("file_ref"), r.get("parent_ref"), r.get("name"), r.get("is_dir"), r.get("reason"))
        if rest.strip() and (r := json.loads(rest))["seq"] >= start:
            yield (segment.drive, segment.journal_id, r["seq"], r.get("file_ref"), r.get("parent_ref"), r.get("name"), r.get("is_dir"), r.get("reason"))


class JournalStream(SimpleDataSourceStreamReader):
    """Offsets are {drive: "journal id:next position"}; a batch has eventsPerBatch records at most, shared among the drives."""

    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("eventsPerBatch", 10_000))
        self.saved, self.start = json.loads(options.get("positions", "{}")), options.get("start", "end")
        if self.start not in ("first", "end") or self.most < 1:
            raise ValueError("start is first or end, eventsPerBatch 1 at least")

    def initialOffset(self) -> dict:
        """Of a drive with a saved position (positions: JSON of drive to [journal id, next position]) that one, else the journal's end, or its start if asked for."""
        there = segments(self.path)
        at = {drive: (own[0].journal_id, own[0].first if self.start == "first" else own[-1].next) for drive, own in there.items()}
        at |= {drive: tuple(place) for drive, place in self.saved.items()}
        for drive, place in at.items():
            self._valid(there, drive, *place)
        return {drive: "%d:%d" % place for drive, place in at.items()}

    @staticmethod
    def _valid(there: dict[str, list[Segment]], drive: str, journal_id: int, position: int) -> list[Segment]:
        own = there.get(drive)
        if not own or own[0].journal_id != journal_id:
            raise RescanNeeded(f"{drive}: the journal isn't {journal_id} any more")
        if not own[0].first <= position <= own[-1].next:
            raise RescanNeeded(f"{drive}: position {position} is outside {own[0].first} to {own[-1].next}")
        return own

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        there, files = segments(self.path), _opened(self.path)[0]
        places = {drive: tuple(map(int, place.split(":"))) for drive, place in start.items()}
        places |= {drive: (own[0].journal_id, own[0].first) for drive, own in there.items() if drive not in places}
        rows, end, left = [], {}, self.most
        for k, (drive, (journal_id, position)) in enumerate(sorted(places.items())):
            own = self._valid(there, drive, journal_id, position)
            share, taken = max(1, left // (len(places) - k)) if left else 0, 0
            for segment in own:
                if segment.next <= position or taken == share:
                    continue
                for row in _records(files, segment, position):
                    if taken == share:
                        break
                    rows.append(row)
                    taken += 1
                    position = row[2] + 1
                else:
                    position = segment.next
            left -= taken
            end[drive] = f"{journal_id}:{position}"
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The records of a batch that had begun before a crash."""
        there, files = segments(self.path), _opened(self.path)[0]
        for drive, place in sorted(end.items()):
            journal_id, until = map(int, place.split(":"))
            position = int(start[drive].split(":")[1]) if drive in start else 0
            for segment in self._valid(there, drive, journal_id, max(position, there[drive][0].first) if drive in there and drive not in start else position):
                if segment.first < until and segment.next > position:
                    yield from (row for row in _records(files, segment, position) if row[2] < until)


class JournalReader(DataSourceReader):
    """All records of the journals, a partition for each segment; a condition drive = ... leaves out the others'."""

    def __init__(self, options):
        self.path, self.drives = options["path"], None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("drive",):
                self.drives = {f.value} if self.drives is None else self.drives & {f.value}
            else:
                yield f

    def partitions(self):
        return [s for drive, own in segments(self.path).items() if self.drives is None or drive in self.drives for s in own] or [Segment("", 0, 0, 0, "")]

    def read(self, partition):
        if partition.path:
            yield from _records(_opened(self.path)[0], partition)


class JournalSource(DataSource):
    @classmethod
    def name(cls):
        return "lodestone_journal"

    def schema(self):
        return JOURNAL

    def reader(self, schema: StructType):
        return JournalReader(self.options)

    def simpleStreamReader(self, schema: StructType):
        return JournalStream(self.options)


@dataclass(frozen=True)
class Folders(InputPartition):
    """Folders to walk, whole or their own entries alone."""

    folders: tuple[tuple[str, bool], ...]


class TreeReader(DataSourceReader):
    """Entries of a directory tree. Folders are listed level by level until there are enough of them for `partitions` tasks, which walk what is below.

    Conditions on path (equal to or beginning with a text) choose the folders that are walked, depth < or <= a number how deep.
    """

    def __init__(self, options):
        self.path, self.wanted = options["path"].rstrip("/"), int(options.get("partitions", 64))
        self.prefix, self.deepest = "", 1 << 30

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | StringStartsWith) and f.attribute == ("path",):
                self.prefix = max(self.prefix, f.value, key=len)
            elif isinstance(f, LessThan | LessThanOrEqual) and f.attribute == ("depth",):
                self.deepest = min(self.deepest, f.value - isinstance(f, LessThan))
            yield f  # Spark checks rows again: folders above a prefix are listed, too

    def _may_hold(self, base: str, folder: str) -> bool:
        """Whether what is in a folder can begin with the prefix."""
        inside = folder.removeprefix(base) + "/"
        return inside.startswith(self.prefix) or self.prefix.startswith(inside)

    def _depth(self, base: str, path: str) -> int:
        return path.removeprefix(base).count("/")

    def partitions(self):
        files, base = _opened(self.path)
        base = base.rstrip("/")
        own, level = [], [base]
        while level and len(level) < self.wanted:
            own += level
            below = []
            for folder in level:
                if self._depth(base, folder) + 1 < self.deepest:
                    below += [i.path for i in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.type == fs.FileType.Directory]
            level = sorted(f for f in below if self._may_hold(base, f))
        work = [(f, False) for f in own] + [(f, True) for f in level]
        return [Folders(tuple(work[k :: self.wanted])) for k in range(min(self.wanted, len(work)))]

    def read(self, partition):
        files, base = _opened(self.path)
        base = base.rstrip("/")
        rows: list[list] = [[] for _ in range(6)]
        todo = list(partition.folders)
        while todo:
            folder, whole = todo.pop()
            for i in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                is_dir, path = i.type == fs.FileType.Directory, i.path.removeprefix(base)
                depth = path.count("/")
                if depth <= self.deepest and path.startswith(self.prefix):
                    for column, value in zip(rows, (path, i.base_name, is_dir, depth, None if is_dir else i.size, i.mtime or datetime.fromtimestamp(0, UTC)), strict=True):
                        column.append(value)
                if whole and is_dir and depth < self.deepest and self._may_hold(base, i.path):
                    todo.append((i.path, True))
            if len(rows[0]) >= 10_000 or rows[0] and not todo:
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.bool_()), pa.array(rows[3], pa.int32()), pa.array(rows[4], pa.int64()), pa.array(rows[5], pa.timestamp("us", "UTC"))], ["path", "name", "is_dir", "depth", "length", "modified"])
                rows = [[] for _ in range(6)]


class TreeSource(DataSource):
    @classmethod
    def name(cls):
        return "lodestone_tree"

    def schema(self):
        return TREE

    def reader(self, schema: StructType):
        return TreeReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes both sources known to the session, with conditions passed on to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(JournalSource)
    spark.dataSource.register(TreeSource)
