"""Line dedup over levelled sorted runs of line digests.

A run is a bucketed table, sorted in each bucket by the 128-bit digest of a line's key, with the number of documents that
have the line and the smallest of their ids. Each new batch is merge-anti-joined with the runs: lines that no run has
are the batch's own run, lines that some run has are kept beside it as further counts. When a level holds `fanout` runs
they are merged into one run of the next level. Runs have no line in common and all have the same buckets, so neither
the anti-join nor a merge moves a row between tasks. Runs and counts together give the lines to drop.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, FILE_BYTES, LOWER_AZ, WS_BYTES, discard, few_files, limit_batches, materialize, new_path, plan_bytes, remove, text_bytes, trimmed

#: Bytes of a frequent line in the table that workers hold, and lines of which they hold one; with more, a join marks the lines.
LINE_BYTES = 24
TABLE_LINES = BROADCAST_BYTES // LINE_BYTES
#: Bytes of a batch in a bucket.
BUCKET_BYTES = 256 << 20
_tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line: white space stripped at both ends, A-Z lower-cased."""
    return [x.strip(WS_BYTES) for x in text.translate(LOWER_AZ).split(b"\n")]


class LineRuns:
    """Levelled runs of (h, n, first): digest of a line, documents that have it, smallest id of those.

    A batch's table marks the lines that no earlier run had (`fresh`): these are its run, its other rows are counts.
    """

    def __init__(self, spark: SparkSession, buckets: int = 8, fanout: int = 3):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[DataFrame]] = []
        self.counts: list[DataFrame] = []
        self._tables: list[tuple[str, str]] = []

    def _write(self, rows: DataFrame) -> DataFrame:
        name, path = f"trackweave_run_{uuid.uuid4().hex}", new_path(self.spark, "line-run")
        rows.write.bucketBy(self.buckets, "h").sortBy("h").option("path", path).format("parquet").saveAsTable(name)
        self._tables.append((name, path))
        return self.spark.table(name)

    def _live(self) -> list[DataFrame]:
        return [table for level in self.levels for table in level]

    def runs(self) -> list[DataFrame]:
        """Tables without a line in common."""
        return [table.filter("fresh") for table in self._live()]

    def marked(self, batch: DataFrame) -> DataFrame:
        """The batch with `fresh`: whether no run has the line. A merge join with each run; the batch has a line once."""
        names = []
        for i, run in enumerate(self.runs()):
            names.append(f"__in{i}")
            batch = batch.join(run.select("h", F.lit(True).alias(names[-1])), "h", "left")
        fresh = F.coalesce(*names).isNull() if names else F.lit(True)
        return batch.withColumn("fresh", fresh).drop(*names)

    def add(self, batch: DataFrame) -> None:
        """batch: (h, n, first), a row a line."""
        first = not self.levels
        own = self._write(self.marked(few_files(batch.select("h", "n", "first").repartition(self.buckets, "h"), self.buckets * FILE_BYTES)))
        if not first:
            self.counts.append(own)
        self._put(own, 0)
        if len(self.counts) == self.fanout:
            self.counts = [self._write(self._merged([c.filter("NOT fresh") for c in self.counts]).withColumn("fresh", F.lit(False)))]

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            together = self._write(self._merged([run.filter("fresh") for run in self.levels[level]]).withColumn("fresh", F.lit(True)))
            self.levels[level] = []
            self._put(together, level + 1)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """One row a line of any of the tables: n added up, the smallest first. All have the same buckets, so their
        union has them too and is merged bucket by bucket (as long as no column is dropped before it)."""
        out = runs[0]
        for run in runs[1:]:
            out = out.union(run)
        return out.groupBy("h").agg(F.sum("n").alias("n"), F.min("first").alias("first"))

    def frequent(self, min_docs: int) -> DataFrame:
        """(h, first) of the lines in at least min_docs documents. Each table is read once, for what it still holds."""
        live = self._live()
        both = [table if any(table is c for c in self.counts) else table.filter("fresh") for table in live]
        both += [c.filter("NOT fresh") for c in self.counts if not any(c is table for table in live)]
        return self._merged(both).filter(F.col("n") >= min_docs).select("h", "first")

    def drop(self) -> None:
        for name, path in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, path)
        self._tables.clear()


def _count_lines(min_chars: int, batches: int):
    def run(parts):
        import xxhash

        digest, seen = xxhash.xxh3_128_digest, {}

        def out():
            rows = list(seen.items())
            seen.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k, _ in rows], pa.int32()),
                    pa.array([k[1] for k, _ in rows], pa.binary()),
                    pa.array([v[0] for _, v in rows], pa.int64()),
                    pa.array([v[1] for _, v in rows], pa.int64()),
                ],
                names=["batch", "h", "n", "first"],
            )

        number = TaskContext.get().partitionId() % batches
        for part in parts:
            for doc_id, text in zip(part.column(0).to_pylist(), text_bytes(part.column(1))):
                for key in set(line_keys(text)):
                    if len(key) < min_chars or min_chars > 1 and len(key.decode()) < min_chars:
                        continue
                    h = (number, digest(key))
                    n, first = seen.get(h, (0, doc_id))
                    if first is None or doc_id is not None and doc_id < first:
                        first = doc_id
                    seen[h] = (n + 1, first)
                if len(seen) > 150_000:
                    yield out()
        if seen:
            yield out()

    return run


def _drop_lines(shared, table_key, names, keep_first):
    def run(parts):
        import xxhash

        digest = xxhash.xxh3_128_digest
        if table_key not in _tables:
            _tables.clear()
            _tables[table_key] = tuple(np.frombuffer(x, kind) for x, kind in zip(shared.value, ("S16", np.int64, bool)))
        known, firsts, named = _tables[table_key]
        for part in parts:
            texts, n_lines, n_dropped = text_bytes(part.column(1)), [], []
            lines = [t.split(b"\n") for t in texts]
            n_lines = np.fromiter(map(len, lines), np.int64, len(lines))
            gone = np.zeros(int(n_lines.sum()), bool)
            if len(known) and len(gone):
                keys = [k for t in texts for k in line_keys(t)]
                wanted = np.frombuffer(b"".join(map(digest, keys)), "S16")
                at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                gone = (known[at] == wanted) & np.fromiter(map(bool, keys), bool, len(keys))
                if keep_first:  # an id that is null is first where no document of the line has one
                    ids = part.column(0)
                    has_id = np.repeat(ids.is_valid().to_numpy(zero_copy_only=False), n_lines)
                    own = np.repeat(ids.fill_null(0).to_numpy(zero_copy_only=False), n_lines)
                    gone &= ~((named[at] & has_id & (firsts[at] == own)) | (~named[at] & ~has_id))
            start = np.cumsum(n_lines) - n_lines
            n_dropped = np.add.reduceat(gone, start, dtype=np.int64) if len(gone) else np.zeros(len(texts), np.int64)
            for i in np.flatnonzero(n_dropped).tolist():
                a = int(start[i])
                texts[i] = b"\n".join(x for x, g in zip(lines[i], gone[a : a + len(lines[i])].tolist()) if not g)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[2:], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines), pa.array(n_dropped)], names=names
            )

    return run


def _explode_lines(parts):
    import xxhash

    for part in parts:
        for i, text in enumerate(text_bytes(part.column(1))):
            lines = text.split(b"\n")
            rid, ids = part.column(2)[i].as_py(), part.column(0)[i].as_py()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rid] * len(lines), pa.int64()),
                    pa.array([ids] * len(lines), pa.int64()),
                    pa.array(range(len(lines)), pa.int32()),
                    pa.array([xxhash.xxh3_128_digest(k) if k else b"\0" * 17 + b"%d:%d" % (rid, j) for j, k in enumerate(line_keys(text))], pa.binary()),
                    pa.array(lines, pa.binary()).cast(pa.string()),
                ],
                names=["rid", "id", "pos", "h", "line"],
            )


def frequent_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 3
) -> DataFrame:
    """(h, first) of the lines of at least min_chars code points that at least min_docs documents have.

    first is the smallest id of those documents.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    counted = materialize(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(trimmed(_count_lines(min_chars, batches)), "batch int, h binary, n long, first long")
        .groupBy("batch", "h")
        .agg(F.sum("n").alias("n"), F.min("first").alias("first")),
        "line-batches",
        most=plan_bytes(docs.select(text_col)),
    )
    n = counted.count()
    runs = LineRuns(spark, min(50_000, max(4, spark.sparkContext.defaultParallelism, 40 * n // (batches * BUCKET_BYTES))), fanout)
    for i in range(batches):
        runs.add(counted.filter(F.col("batch") == i))
    out = materialize(runs.frequent(min_docs), "line-frequent")
    runs.drop()
    discard(counted)
    return out


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    keep: str = "none",
    batches: int = 4,
    fanout: int = 3,
    table_lines: int = TABLE_LINES,
    lines_col: str = "n_lines",
    dropped_col: str = "n_dropped",
) -> DataFrame:
    """docs with frequent lines taken out of text_col, and the columns lines_col (lines before) and dropped_col.

    A line's key is the line without white space at both ends, A-Z lower-cased; keys of at least min_chars code
    points (at least 1: empty lines always stay) in at least min_docs documents go. keep="none" drops them in
    every document, keep="first" leaves them in the document with the smallest id. Null texts count as one
    empty line and come back empty. A document counts once for a line however often it repeats it; rows that
    repeat an id count each. Other columns come back as they were; columns named like those two are
    replaced. Row order is not kept. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    lines = frequent_lines(docs, id_col, text_col, min_docs, max(1, min_chars), batches, fanout)
    others = [c for c in docs.columns if c not in (text_col, lines_col, dropped_col)]
    renamed = docs.select(
        F.col(id_col).cast("long").alias("__tw_id"), F.col(text_col).alias("__tw_text"), *[F.col(f"`{c}`") for c in others]
    )
    names = [*others, text_col, lines_col, dropped_col]
    if lines.count() <= table_lines:
        rows = lines.toArrow()  # at most table_lines rows of LINE_BYTES
        digests = np.frombuffer(b"".join(rows.column("h").to_pylist()), "S16")
        first, order = rows.column("first"), np.argsort(digests)
        found = digests, first.fill_null(0).to_numpy(), first.is_valid().to_numpy()
        shared = spark.sparkContext.broadcast([x[order].tobytes() for x in found])
        schema = renamed.select(*others).schema.add(text_col, "string").add(lines_col, "long").add(dropped_col, "long")
        out = renamed.mapInArrow(trimmed(_drop_lines(shared, uuid.uuid4().hex, names, keep == "first")), schema)
    else:
        numbered = materialize(renamed.withColumn("__tw_rid", F.monotonically_increasing_id()), "line-docs")
        exploded = numbered.select("__tw_id", "__tw_text", "__tw_rid").mapInArrow(_explode_lines, "rid long, id long, pos int, h binary, line string")
        marked = exploded.join(lines.withColumnRenamed("first", "f").withColumn("hit", F.lit(True)), "h", "left")
        gone = F.coalesce("hit", F.lit(False)) & (F.lit(True) if keep != "first" else ~F.expr("f <=> id"))
        texts = marked.groupBy("rid").agg(
            F.count("*").alias(lines_col),
            F.count_if(gone).alias(dropped_col),
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.when(~gone, F.struct("pos", "line")))), lambda x: x["line"]), "\n"
            ).alias(text_col),
        )
        out = numbered.join(texts.withColumnRenamed("rid", "__tw_rid"), "__tw_rid").select(*[f"`{c}`" for c in names])
    return out.select(*[F.col(f"`{c}`") for c in [*[c for c in docs.columns if c not in (lines_col, dropped_col)], lines_col, dropped_col]])
