"""Growing files as a stream: appended, half-written, replaced and renamed files, cut ranges."""

from __future__ import annotations

import io
import random

import pytest
from pyspark.errors import StreamingQueryException

from tillroll.streaming.tail import growing_lines, lines_of, ranges


def test_ranges_hold_every_line_once_wherever_they_are_cut():
    rng = random.Random(1)
    for _ in range(200):
        lines = [bytes(rng.choice(b"ab\r") for _ in range(rng.choice([0, 1, 2, 7, 30]))) for _ in range(rng.randint(1, 12))]
        before = b"earlier\n" if rng.random() < 0.5 else b""
        data = before + b"".join(line + b"\n" for line in lines)
        whole = data + b"half"
        got = []
        for part in ranges("f", len(before), len(data), rng.randint(1, 25)):
            for found in lines_of(io.BytesIO(whole), part, block=rng.randint(1, 9)):
                got += found
        assert got == lines


class Inbox:
    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder
        (folder / "in").mkdir()

    def write(self, name, text, mode="a"):
        with open(self.folder / "in" / name, mode, newline="") as file:
            file.write(text)

    def run(self):
        """One run over what is there; the lines of this run's batches."""
        got = []

        def take(batch, number):
            got.extend(r.value for r in batch.collect())

        checkpoint = str(self.folder / "ck")
        lines = growing_lines(self.spark, str(self.folder / "in"), checkpoint, range_bytes=16)
        query = lines.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(got)


@pytest.fixture
def inbox(spark, tmp_path):
    return Inbox(spark, tmp_path)


def test_appended_lines_arrive_once_and_half_lines_wait(inbox):
    inbox.write("a.log", "one\ntwo\nthr")
    inbox.write("_SUCCESS", "x\n")
    assert inbox.run() == ["one", "two"]
    assert inbox.run() == []
    inbox.write("a.log", "ee\nfour and a longer line than a range\r\n\nfi")
    inbox.write("b.log", "other\n")
    assert inbox.run() == ["", "four and a longer line than a range", "other", "three"]
    inbox.write("a.log", "ve\n")
    assert inbox.run() == ["five"]


def test_replaced_and_renamed_files(inbox):
    inbox.write("a.log", "one\ntwo\n")
    assert inbox.run() == ["one", "two"]
    # rotated: the old file stays under a new name and gets a last line, a new one takes its place
    (inbox.folder / "in" / "a.log").rename(inbox.folder / "in" / "a.log.1")
    inbox.write("a.log.1", "last\n")
    inbox.write("a.log", "new one\nnew two\nnew three\n")
    assert inbox.run() == ["last", "new one", "new three", "new two"]
    inbox.write("a.log", "shorter\n", mode="w")
    assert inbox.run() == ["shorter"]
    inbox.write("a.log", "another of the same or more bytes\n", mode="w")
    assert inbox.run() == ["another of the same or more bytes"]
    assert inbox.run() == []


def test_a_batch_that_failed_is_read_again_as_it_was(inbox):
    inbox.write("a.log", "one\ntwo\n")
    checkpoint = str(inbox.folder / "ck")

    def fail(batch, number):
        raise RuntimeError("no sink")

    lines = growing_lines(inbox.spark, str(inbox.folder / "in"), checkpoint)
    query = lines.writeStream.foreachBatch(fail).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    with pytest.raises(StreamingQueryException):
        query.awaitTermination()
    inbox.write("a.log", "three\n")
    assert inbox.run() == ["one", "two"]
    assert inbox.run() == ["three"]


def test_compressed_files_are_refused(inbox):
    inbox.write("a.log.gz", "x\n")
    with pytest.raises(Exception, match="can't be followed"):
        inbox.run()
