"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes

from pyspark.sql import DataFrame, SparkSession

from ..tables import (  # noqa: F401
    BROADCAST_BYTES, FILE_BYTES, _made, discard, few_files, materialize, new_path, plan_bytes, remove, shared_dir, small_side, spent,
)

#: What the contracts call white space, as a regular-expression class for Spark and for DuckDB.
WS_CLASS = r"[\x20\x09-\x0D]"
#: The same characters for bytes.strip(); bytes.split() without arguments splits at just these.
WS_BYTES = b" \t\n\x0b\x0c\r"
#: bytes.translate table that lower-cases A-Z and nothing else.
LOWER_AZ = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Rows and bytes of one Arrow batch at most; keeps a batch of very long texts within a worker's memory.
BATCH_ROWS, BATCH_BYTES = 256, 32 << 20


def limit_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Holds Arrow batches at so many rows and at BATCH_BYTES; smaller settings of the session stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("bB")
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def text_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trimmed(run):
    """A mapInArrow function that gives the memory it has freed back when its partition ends: workers are reused."""

    def whole(parts):
        import pyarrow as pa

        try:
            yield from run(parts)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return whole
