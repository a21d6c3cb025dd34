"""Frame containers: round trip, ranges, filters that reach the reader, commits."""

import random
from pathlib import Path

import pytest

from trackweave.sources import frames as C

COLUMNS = "clip_id string, frame long, width int, height int, pixels binary"


def frame(clip, number, seed=0, side=4):
    return (clip, number, side, side, bytes((seed + number * 7 + i) % 256 for i in range(side * side)))


def rows_of(df):
    return sorted((r.clip_id, r.frame, r.width, r.height, bytes(r.pixels)) for r in df.collect())


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """Two clips with gaps, repeated frames and a change of size, in any order, in small blocks and files."""
    path = str(tmp_path_factory.mktemp("frames"))
    rows = [frame("a", 3 * n, n) for n in range(200)] + [frame("b", n, side=4 if n < 50 else 2) for n in range(-20, 100)] + [frame("a", 300, 1), frame("a", 300, 2)]
    random.Random(3).shuffle(rows)
    C.write_frames(spark.createDataFrame(rows, COLUMNS), path, block_bytes=80, file_bytes=400)
    return path, sorted(rows)


def test_round_trip(spark, written):
    path, rows = written
    assert rows_of(C.read_container(spark, path)) == rows


@pytest.mark.parametrize("first, last, every", [(100, 130, 1), (300, 300, 1), (None, 0, 1), (590, None, 1), (None, None, 7), (50, 250, 5), (1000, None, 1), (9, 3, 1)])
def test_ranges(spark, written, first, last, every):
    path, rows = written
    low, high = -1000 if first is None else first, 10**6 if last is None else last
    assert rows_of(C.read_container(spark, path, first, last, every)) == [r for r in rows if low <= r[1] <= high and r[1] % every == 0]


def test_range_is_planned_as_few_blocks(written):
    path, _ = written
    every = C.FrameReader(path, C.Span()).partitions()
    some = C.FrameReader(path, C.Span(first=300, last=300, clips=["a"])).partitions()
    assert 0 < len(some) <= 3 and len(every) > 50 and {b.clip for b in some} == {"a"}
    assert all(b.size * (b.end - b.start) <= 80 for b in every)


@pytest.mark.parametrize(
    "asked, pruned",
    [
        ("frame = 30", True), ("frame > 30 AND frame <= 60", True), ("clip_id = 'b' AND frame >= 40", True), ("clip_id IN ('a', 'c') AND frame < 12", True),
        ("clip_id IS NULL", True), ("width = 2 AND frame > 500", True), ("frame IN (3, 6, 9)", False), ("frame = 30 OR frame = 33", False),
    ],
)
def test_filters_reach_the_reader(spark, written, asked, pruned):
    path, rows = written
    spark.conf.set(C.PUSHDOWN, "true")
    try:
        found = C.read_container(spark, path).filter(asked)
        got, n = rows_of(found), found.rdd.getNumPartitions()
    finally:
        spark.conf.unset(C.PUSHDOWN)
    want = spark.createDataFrame(rows, COLUMNS).filter(asked)
    assert got == rows_of(want) == rows_of(C.read_container(spark, path).filter(asked))
    assert not pruned or n < len(C.FrameReader(path, C.Span()).partitions()) / 2


def test_rows_without_pixels_and_empty_tables(spark, tmp_path):
    rows = [frame("a", 1), ("a", None, 1, 1, b"x"), (None, 2, 1, 1, b"x"), ("a", 3, 1, 1, None), ("a", 4, 0, 0, b"")]
    C.write_frames(spark.createDataFrame(rows, COLUMNS), f"{tmp_path}/some")
    assert rows_of(C.read_container(spark, f"{tmp_path}/some")) == [rows[0], rows[4]]
    C.write_frames(spark.createDataFrame([], COLUMNS), f"file://{tmp_path}/none")
    assert rows_of(C.read_container(spark, f"{tmp_path}/none")) == []


def test_commits(spark, tmp_path):
    """Appends add, overwriting replaces, and files that no commit names are not read."""
    path = str(tmp_path / "log")
    first, more = [frame("a", n) for n in range(5)], [frame("a", n, 9) for n in range(3, 8)]
    C.write_frames(spark.createDataFrame(first, COLUMNS), path)
    C.write_frames(spark.createDataFrame(more, COLUMNS), path, mode="append")
    assert rows_of(C.read_container(spark, path)) == sorted(first + more)
    writer = C.FrameWriter(path, False, 80, 400)
    batch = spark.createDataFrame([frame("a", 99)], COLUMNS).toArrow().to_batches()
    left = writer.write(iter(batch))
    assert rows_of(C.read_container(spark, path)) == sorted(first + more)
    writer.abort([left, None])
    assert not Path(path, left.entries[0]["file"]).exists()
    C.write_frames(spark.createDataFrame(more, COLUMNS), path)
    assert rows_of(C.read_container(spark, path)) == sorted(more)


def test_arrays_as_frames(spark):
    rows = spark.createDataFrame([(1, 5, [0, 15, 16, 255])], "c int, f int, v array<int>")
    got = C.as_frames(rows, "c", "f", "v", 2).first()
    assert (got.clip_id, got.frame, got.width, got.height, bytes(got.pixels)) == ("1", 5, 2, 2, bytes([0, 15, 16, 255]))
