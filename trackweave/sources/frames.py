"""Video frames as uncompressed containers: a data source that plans by ranges of frames and a writer that commits.

A container file holds frames of one clip, all of one size, in ascending order: the pixels one frame after the other, then
the frame numbers as little-endian 64-bit integers. So any frame is two reads away. Each commit adds one manifest, a line
a file with the first frame of each block; files that no manifest names (of failed tasks) are never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

SCHEMA = "clip_id string, frame long, width int, height int, pixels binary"
#: Bytes of pixels of a block (what a task reads, and what can be left out) and of a file.
BLOCK_BYTES, FILE_BYTES = 8 << 20, 256 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _manifests(files: fs.FileSystem, folder: str) -> list[str]:
    found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.endswith(".manifest"))


@dataclass
class Span:
    """Frames that are asked for: first to last, of every so many, of these clips (None: all)."""

    first: int = _LEAST
    last: int = _MOST
    every: int = 1
    clips: list[str] | None = None

    def narrow(self, f: Filter) -> bool:
        """Takes a filter in; False if it can't."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if isinstance(f, IsNotNull) and name in ("frame", "clip_id"):  # the container has no others
            return True
        if isinstance(f, IsNull) and name in ("frame", "clip_id"):
            self.clips = []
            return True
        if name == "clip_id" and isinstance(f, (EqualTo, In)):
            asked = [f.value] if isinstance(f, EqualTo) else list(f.value)
            self.clips = [c for c in asked if c is not None and (self.clips is None or c in self.clips)]
            return True
        if name != "frame" or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) or f.value is None:
            return False
        if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
            self.first = max(self.first, f.value + isinstance(f, GreaterThan))
        if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
            self.last = min(self.last, f.value - isinstance(f, LessThan))
        return True


@dataclass
class Block(InputPartition):
    """Records start to end of a file, of n, with what is asked of them."""

    file: str
    clip: str
    width: int
    height: int
    size: int
    n: int
    start: int
    end: int
    span: Span = field(default_factory=Span)


class FrameReader(DataSourceReader):
    def __init__(self, path: str, span: Span) -> None:
        self.path, self.span = path, span

    def partitions(self) -> list[Block]:
        """Blocks that may hold a frame asked for; only manifests are read here."""
        files, folder = _folder(self.path)
        span, out = self.span, []
        for manifest in _manifests(files, folder):
            with files.open_input_stream(manifest) as lines:
                entries = [json.loads(line) for line in lines.read().decode().splitlines()]
            for e in entries:
                if span.clips is not None and e["clip"] not in span.clips:
                    continue
                # A block ends where the next one begins; a frame number may be on both sides of that.
                for i, first in enumerate(e["starts"]):
                    last = e["starts"][i + 1] if i + 1 < len(e["starts"]) else e["last"]
                    if first <= span.last and last >= span.first:
                        end = min(e["n"], (i + 1) * e["block"])
                        out.append(Block(f"{folder}/{e['file']}", e["clip"], e["width"], e["height"], e["size"], e["n"], i * e["block"], end, span))
        return out

    def read(self, partition: Block | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's one task for a plan without blocks
            return
        p, span = partition, partition.span
        files, _ = _folder(self.path)
        with files.open_input_file(p.file) as f:
            numbers = np.frombuffer(f.read_at(8 * (p.end - p.start), p.n * p.size + 8 * p.start), "<i8")
            wanted = np.flatnonzero((numbers >= span.first) & (numbers <= span.last) & (numbers % span.every == 0))
            # Records that lie side by side are one read, of at most a block.
            for run in np.split(wanted, np.flatnonzero(np.diff(wanted) != 1) + 1) if len(wanted) else []:
                body = f.read_at(len(run) * p.size, (p.start + int(run[0])) * p.size)
                pixels = [body[i * p.size : (i + 1) * p.size] for i in range(len(run))]
                columns = [
                    pa.array([p.clip] * len(run), pa.string()),
                    pa.array(numbers[run], pa.int64()),
                    pa.array([p.width] * len(run), pa.int32()),
                    pa.array([p.height] * len(run), pa.int32()),
                    pa.array(pixels, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["clip_id", "frame", "width", "height", "pixels"])


class PushingFrameReader(FrameReader):
    """Spark lets a reader take filters only where the session allows it, so this is a class of its own."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.span.narrow(f):
                yield f


@dataclass
class Written(WriterCommitMessage):
    entries: list[dict]


class FrameWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, block_bytes: int, file_bytes: int) -> None:
        self.path, self.overwrite, self.block_bytes, self.file_bytes = path, overwrite, block_bytes, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One file for each run of rows of a clip and size in ascending order; a full file, and a step back, begin a new one."""
        files, folder = _folder(self.path)
        files.create_dir(folder, recursive=True)
        entries, out, numbers = [], None, []

        def close() -> None:
            if out is None:
                return
            out.write(np.array(numbers, "<i8").tobytes())
            out.close()
            e = entries[-1]
            e |= {"n": len(numbers), "last": numbers[-1], "starts": numbers[:: e["block"]]}

        for batch in iterator:
            for row in batch.to_pylist():
                kind = {"clip": row["clip_id"], "width": row["width"], "height": row["height"], "size": len(row["pixels"])}
                full = numbers and (len(numbers) + 1) * kind["size"] > self.file_bytes
                if out is None or full or row["frame"] < numbers[-1] or any(entries[-1][k] != v for k, v in kind.items()):
                    close()
                    numbers = []
                    entries.append(kind | {"file": f"{uuid.uuid4().hex}.frames", "block": max(1, self.block_bytes // max(1, kind["size"]))})
                    out = files.open_output_stream(f"{folder}/{entries[-1]['file']}")
                out.write(row["pixels"])
                numbers.append(row["frame"])
        close()
        return Written(entries)

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = _folder(self.path)
        files.create_dir(folder, recursive=True)
        before = _manifests(files, folder) if self.overwrite else []
        named = f"{folder}/{uuid.uuid4().hex}"
        with files.open_output_stream(f"{named}.part") as out:
            for m in messages:
                for e in m.entries if m else []:
                    out.write((json.dumps(e) + "\n").encode())
        for old in before:
            files.delete_file(old)
        files.move(f"{named}.part", f"{named}.manifest")

    def abort(self, messages: list[Written | None]) -> None:
        files, folder = _folder(self.path)
        for m in messages:
            for e in m.entries if m else []:
                files.delete_file(f"{folder}/{e['file']}")


class FrameSource(DataSource):
    """Format "frames". Options: path, first, last, every (frames that it divides), push (take filters), block_bytes, file_bytes."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def _number(self, name: str, default: int) -> int:
        return int(self.options.get(name, default))

    def reader(self, schema) -> FrameReader:
        span = Span(self._number("first", _LEAST), self._number("last", _MOST), self._number("every", 1))
        kind = PushingFrameReader if self.options.get("push") == "true" else FrameReader
        return kind(self.options["path"], span)

    def writer(self, schema, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options["path"], overwrite, self._number("block_bytes", BLOCK_BYTES), self._number("file_bytes", FILE_BYTES))


def write_frames(df: DataFrame, path: str, mode: str = "overwrite", block_bytes: int = BLOCK_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Frames (clip_id, frame, width, height, pixels) as containers under path, which driver and executors must share.

    Clips are dealt by ranges of frames, so a long clip is many tasks' work. Rows without a clip, frame, size or pixels are
    left out; repeated frames are all kept; an empty table gives an empty container. Other columns are not written. Other
    file systems than local ones need what pyarrow asks for them. Overwriting replaces the manifests; files that they
    named stay until the folder is removed, so that a running reader doesn't lose them.
    """
    df.sparkSession.dataSource.register(FrameSource)
    rows = df.selectExpr("CAST(clip_id AS STRING) AS clip_id", "CAST(frame AS BIGINT) AS frame", "CAST(width AS INT) AS width", "CAST(height AS INT) AS height", "pixels")
    rows = rows.dropna().repartitionByRange("clip_id", "frame").sortWithinPartitions("clip_id", "frame")
    options = {"path": path, "block_bytes": block_bytes, "file_bytes": file_bytes}
    rows.write.format("frames").mode(mode).options(**options).save()


def read_container(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, every: int = 1) -> DataFrame:
    """Frames first to last (inclusive) of every so many, from containers of write_frames; a task reads a block's frames that are asked for.

    Where the session allows Python sources to take filters (PUSHDOWN), comparisons of frame and clip_id with constants are
    taken too; elsewhere they filter after the read.
    """
    spark.dataSource.register(FrameSource)
    options = {"path": path, "every": every, "push": str(spark.conf.get(PUSHDOWN, "false")).lower()}
    options |= {k: v for k, v in (("first", first), ("last", last)) if v is not None}
    return spark.read.format("frames").options(**options).load()


def as_frames(rows: DataFrame, clip: str, frame: str, values: str, width: int) -> DataFrame:
    """Frames of one byte a pixel out of arrays of whole numbers from 0 to 255, in lines of `width` pixels."""
    text = F.array_join(F.transform(F.expr(values), lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), "")
    shaped = rows.select(F.expr(clip).cast("string").alias("clip_id"), F.expr(frame).cast("long").alias("frame"), F.lit(width).alias("width"), F.unhex(text).alias("pixels"))
    return shaped.withColumn("height", (F.length("pixels") / width).cast("int"))
