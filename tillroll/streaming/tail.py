"""Growing text files as a stream of lines (S9, S10, V4): a Python data source.

The file source takes a file once, as it is found; lines that a writer appends later are lost to
it. Here the position of the stream is a byte position per file. A micro-batch takes what lies
between two positions, cut into ranges that tasks read on their own; every range starts where a
line starts and ends behind a line feed, so a line is read once and a half-written last line
waits until its line feed is there. A batch that runs again after a failure has the same
positions and reads the same lines; with ``availableNow`` a run that finds such a batch takes that
one, and the next run what came later.

A file is known by its path and by a checksum of its first bytes:

* a file that was emptied or replaced under its name is read from its start;
* a file that was renamed (a rotated log that stays in the folder) keeps its position.

A position holds one entry per file of the folder; a file that is gone leaves it. Files whose name
starts with ``_`` or ``.`` are skipped, compressed ones refused: they can't grow line by line.
Storage is reached through Arrow's file systems, by driver and executors alike. Bytes that are no
UTF-8 become the replacement character; a carriage return before the line feed is left out.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: First bytes of a file that its checksum covers (fewer while it is shorter).
HEAD = 512
#: Bytes that one task reads of a file.
RANGE = 32 << 20
#: Bytes read at once.
BLOCK = 1 << 20
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")


def storage(path: str):
    """Arrow's file system for a path, and the path within it."""
    from pyarrow import fs

    plain = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(plain)


def ship() -> None:
    """Pickle this module by value, so that workers need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


class LineRange(InputPartition):
    """Lines of a file that start at ``begin`` or later and before ``end``; both lie in a part of
    the file that starts with a line at ``first`` and ends behind a line feed at ``last``."""

    def __init__(self, path: str, first: int, begin: int, end: int, last: int):
        self.path, self.first, self.begin, self.end, self.last = path, first, begin, end, last


def ranges(path: str, first: int, last: int, most: int = RANGE) -> list[LineRange]:
    """A part of a file, cut for tasks."""
    return [LineRange(path, first, at, min(at + most, last), last) for at in range(first, last, most)]


def lines_of(source, part: LineRange, block: int = BLOCK) -> Iterator[list[bytes]]:
    """The lines of a range, in lists of about a block. ``source`` is a seekable file.

    A range that starts inside a line leaves that line to the range before it, which reads on to
    the line's end."""
    at = part.begin
    held: list[bytes] = []
    skipping = part.begin > part.first
    if skipping:
        at -= 1  # a line feed right before the range means that a line starts with it
    source.seek(at)
    while at < part.last:
        data = source.read(min(block, part.last - at))
        if not data:
            raise OSError(f"{part.path} is shorter than it was: {at} of {part.last} bytes")
        start, found = 0, []
        if skipping:
            feed = data.find(b"\n")
            if feed < 0:
                at += len(data)
                continue
            start, skipping = feed + 1, False
        if at + start >= part.end and not held:
            return
        # lines that start before the range's end, and so the one that crosses it
        stop = data.rfind(b"\n") + 1
        if at + len(data) >= part.end:
            crossing = data.find(b"\n", max(part.end - 1 - at, start))
            stop = crossing + 1 if crossing >= 0 else stop if at + stop <= part.end else 0
        if stop > start:
            found = data[start:stop].split(b"\n")[:-1]
            found[0] = b"".join([*held, found[0]])
            held = []
            yield found
            start = stop
        if at + start >= part.end and not held:
            return
        held.append(data[start:])
        at += len(data)


class GrowingLinesReader(DataSourceStreamReader):
    """Positions: path -> ``at`` (read up to here), ``head`` (length and checksum of the first
    bytes), ``since`` (where this file's reading started) and ``turn`` (files of this name so far)."""

    def __init__(self, options):
        self.root = options["path"]
        self.most = int(options.get("rangebytes", RANGE))
        self.known: dict = json.loads(options.get("resume") or "{}")

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, root = storage(self.root)
        info = system.get_file_info(root)
        if info.type == fs.FileType.File:
            found = [info]
        else:
            found = system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
        files = [f for f in found if f.type == fs.FileType.File and f.base_name[:1] not in "_."]
        refused = [f.path for f in files if f.path.endswith(COMPRESSED)]
        if refused:
            raise ValueError(f"compressed files can't be followed: {refused[:3]}")
        before: dict = self.known.get("files", {})
        now: dict = {}
        fresh = []
        for f in files:
            entry = before.get(f.path)
            if entry and f.size == entry["at"]:
                now[f.path] = entry
            elif entry and f.size > entry["at"] and self._head(system, f.path, entry["head"][0]) == entry["head"][1]:
                now[f.path] = self._advanced(system, f, entry["at"], entry["since"], entry["turn"])
            else:
                fresh.append(f)
        # a fresh name may be a known file renamed: one that isn't there, or is there anew
        lost = {p: e for p, e in before.items() if p not in now and e["head"][0]}
        for f in fresh:
            turn = before[f.path]["turn"] + 1 if f.path in before else 0
            since = 0
            for path, entry in lost.items():
                length, checksum = entry["head"]
                if path != f.path and f.size >= entry["at"] and self._head(system, f.path, length) == checksum:
                    since = entry["at"]
                    del lost[path]
                    break
            now[f.path] = self._advanced(system, f, since, since, turn)
        self.known = {"files": now}
        return self.known

    @staticmethod
    def _head(system, path: str, length: int) -> int:
        with system.open_input_file(path) as source:
            return zlib.crc32(source.read(length))

    def _advanced(self, system, info, at: int, since: int, turn: int) -> dict:
        """The entry of a file that is read up to its last line feed."""
        end, low = at, info.size
        with system.open_input_file(info.path) as source:
            while low > at:
                size = min(BLOCK, low - at)
                low -= size
                source.seek(low)
                feed = source.read(size).rfind(b"\n")
                if feed >= 0:
                    end = low + feed + 1
                    break
            source.seek(0)
            length = min(HEAD, end)
            checksum = zlib.crc32(source.read(length))
        return {"at": end, "head": [length, checksum], "since": since, "turn": turn}

    def partitions(self, start: dict, end: dict) -> list[LineRange]:
        self.known = end
        parts = []
        for path, entry in end["files"].items():
            before = start["files"].get(path)
            same = before is not None and before["turn"] == entry["turn"]
            parts += ranges(path, before["at"] if same else entry["since"], entry["at"], self.most)
        return parts

    def read(self, partition: LineRange):
        import pyarrow as pa

        system, _ = storage(self.root)
        with system.open_input_file(partition.path) as source:
            for lines in lines_of(source, partition):
                texts = [line.removesuffix(b"\r").decode("utf-8", "replace") for line in lines]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    """``readStream.format("growing_lines")``: a folder (with its subfolders) or one file."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> GrowingLinesReader:
        return GrowingLinesReader(self.options)


def _planned(spark: SparkSession, checkpoint: str) -> str | None:
    """The newest position that a stream's checkpoint holds, if it ran before."""
    try:
        log = spark.read.text(f"{checkpoint.rstrip('/')}/offsets")
        newest = log.select(F.col("_metadata.file_name").try_cast("long").alias("n"), "value")
        row = newest.filter(F.col("n").isNotNull() & F.col("value").startswith('{"files"')).orderBy(F.desc("n")).first()
    except AnalysisException:
        return None
    return row["value"] if row else None


def growing_lines(spark: SparkSession, path: str, checkpoint: str, range_bytes: int = RANGE) -> DataFrame:
    """A stream (value) of the lines of files that may grow, for a query with this checkpoint."""
    ship()
    spark.dataSource.register(GrowingLines)
    reader = spark.readStream.format("growing_lines").option("path", path).option("rangeBytes", range_bytes)
    resume = _planned(spark, checkpoint)
    return (reader.option("resume", resume) if resume else reader).load()
