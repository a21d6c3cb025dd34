"""Token ids in Parquet list columns: dictionary pages, bounded row groups, page indexes."""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import limit_batches, new_path, small_side, trimmed
from .units import CACHE_PARTS, LOWER, LOWER_CLASS, MARK_CLASS, UPPER_CLASS, UnitEncoder, joined

#: The pre-tokeniser that WordEncoder knows to split letters from punctuation (fixed value of the vocabulary file).
_SPLIT = json.dumps(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_encoders: dict[str, WordEncoder] = {}


class WordEncoder(UnitEncoder):
    """A tokenizers file applied word by word: for tokenizers that lower-case, split at white space and drop it.

    The units are words (runs without ASCII white space). Parts of them go through the library's model without its
    normaliser, many in one call: in their ids, the suffix that ends a word marks where each ends. All other words
    go through the whole tokenizer. Texts with "<|" could hold special tokens and go through it whole.
    """

    def __init__(self, path: str, most: int = CACHE_PARTS):
        super().__init__(most)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4"
        with open(path, "rb") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix")
        if suffix and _SPLIT in json.dumps(spec.get("pre_tokenizer")):
            self.pattern, self.letters = f"^[{LOWER_CLASS}]*[{MARK_CLASS}]*$", LOWER
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            )
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(parts), 2000):
            todo = parts[at : at + 2000]
            ids = np.array(self.plain.encode_batch_fast([" ".join(todo)], add_special_tokens=False)[0].ids, self.kind)
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize
            if len(cuts) != len(todo):
                raise ValueError("the ends of words were lost")
            data, cuts = ids.tobytes(), cuts.tolist()
            out += [data[a:b] for a, b in zip([0, *cuts], cuts)]
        return out

    def encode_unit(self, unit: str) -> list[int]:
        return self._ids(unit)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a string column, one after the other, and where each text's begin (and the last's end)."""
        column = column.fill_null("")
        marked = np.flatnonzero(pc.match_substring(column, "<|").to_numpy(zero_copy_only=False))
        if len(marked):
            return self._encode_marked(column, set(marked.tolist()))
        lists = pc.ascii_split_whitespace(column)
        words = lists.flatten()
        if not self.pattern:
            return self.gather(lists, words)
        # The library composes before it lower-cases, and some marks compose with one case of a letter only. So words are
        # lower-cased here only if all their characters are ASCII or letters below U+0100, which neither compose with
        # each other nor differ in how they are lower-cased; words with others go to the library as they are.
        latin = pc.match_substring_regex(words, f"^[\\x00-\\x7f{LOWER_CLASS}{UPPER_CLASS}]*$")
        return self.gather(lists, pc.if_else(latin, pc.utf8_lower(words), words))

    def _encode_marked(self, column: pa.Array, marked: set[int]) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), text by text, where some texts hold "<|"."""
        parts = []
        for i in range(len(column)):
            one = column.slice(i, 1)
            parts.append(np.array(self._ids(one[0].as_py()), self.kind) if i in marked else self.encode(one)[1])
        return np.cumsum([0, *map(len, parts)]), np.concatenate(parts)


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _encode(path: str, end_id: int):
    def run(parts):
        words, number, start = encoder(path), TaskContext.get().partitionId(), 0
        for part in joined(parts):
            edges, ids = words.encode(part.column(1))
            n = len(edges) - 1
            values = np.full(len(ids) + n, end_id, np.int32)
            offsets = edges + np.arange(n + 1)
            inner = np.ones(len(values), bool)
            inner[offsets[1:] - 1] = False
            values[inner] = ids
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(np.full(n, number, np.int32)),
                    pa.array(start + offsets[:-1]),
                    pa.array(np.diff(offsets)),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values)),
                ],
                names=["doc_id", "part", "part_start", "n_tokens", "ids"],
            )
            start += int(offsets[-1])

    return run


def write_token_ids(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_rows: int = 256,
) -> str:
    """Writes the ids of every text, with end_id after each, in ascending id order; returns the folder.

    Part files follow each other in id order and each is sorted, so the ids of the table are one stream. Columns:
    doc_id, part, part_start (ids before it in the part), n_tokens, ids. Row groups are held at row_group_bytes
    and pages at page_rows rows; the writer's column and offset indexes let a reader fetch the pages of some rows,
    or the metadata columns alone. encoding: "dictionary" or "delta" (version-2 pages, DELTA_BINARY_PACKED).
    Null texts count as empty (the end id alone); null ids come first; rows that repeat an id follow each other in
    no defined order. An empty table gives a folder without rows.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    path = path or new_path(spark, "token-ids")
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows = rows.mapInArrow(trimmed(_encode(tokenizer_path, end_id)), f"doc_id {kind}, part int, part_start long, n_tokens long, ids array<int>")
    rows.write.options(
        **{
            "parquet.block.size": str(row_group_bytes),
            "parquet.page.row.count.limit": str(page_rows),
            "parquet.page.size": str(1 << 20),
            "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
            "parquet.writer.version": "PARQUET_1_0" if encoding == "dictionary" else "PARQUET_2_0",
        }
    ).parquet(path)
    return path


def _digest(parts):
    for part in parts:
        lists = part.column(4)
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4", copy=False)
        crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets, offsets[1:])]
        yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(crc, pa.int64())], names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all rows before it), n_tokens, ids, in the folder's order."""
    rows = spark.read.parquet(path)
    return _placed(rows, rows).select("doc_id", "start", "n_tokens", "ids")


def _placed(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows with start: what the parts before hold (a row per part, read from the metadata columns) and part_start."""
    from pyspark.sql import Window

    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(F.col("part").alias("p"), "n")
    before = totals.select(
        "p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    n = totals.count()  # a row a part
    return rows.join(small_side(before, n, 16), F.col("part") == F.col("p")).withColumn("start", F.col("before") + F.col("part_start"))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row of a folder that write_token_ids wrote."""
    rows = spark.read.parquet(path)
    kind = rows.schema["doc_id"].dataType.simpleString()
    limit_batches(spark)
    read = rows.select("doc_id", "part", "part_start", "n_tokens", "ids").mapInArrow(
        _digest, f"doc_id {kind}, part int, part_start long, n_tokens long, ids_crc32 long"
    )
    return _placed(read, rows).select("doc_id", "start", "n_tokens", "ids_crc32")
