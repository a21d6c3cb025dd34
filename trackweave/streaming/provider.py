"""The place where a model is plugged in: frames in, detections out, batch by batch on the executors."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame


class PerceptionProvider(Protocol):
    """Makes detections of frames. It is sent to the executors, so models are loaded in open(), not before."""

    #: Columns of the detections, as a schema string.
    schema: str

    def open(self) -> None:
        """Called once for each partition, before its first batch."""

    def detect(self, frames: pa.RecordBatch) -> pa.RecordBatch:
        """The detections of a batch of frames; a frame may have none or many."""


def perceive(frames: DataFrame, provider: PerceptionProvider) -> DataFrame:
    """Detections of frames (clip_id, frame, content; or whatever the provider reads), by a provider. No frames, no detections."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider.open()
        for part in parts:
            if part.num_rows:
                yield provider.detect(part)

    return frames.mapInArrow(run, provider.schema)
