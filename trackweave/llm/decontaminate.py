"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by the number of their distinct shingles. The sketch of an item is its smallest shingle hashes
(bottom-k MinHash), in each partition a table of its own. A document that contains an item of n shingles to at least t
lacks at most m = n - ceil(t n) of them, so of a sketch of min(n, 2 m + 1) hashes it has all but m: items with so many
hits are candidates, and no pair is lost. Documents of any length are probed in one pass over their shingles, a
partition only if they have as many shingles as its items need, and a candidate is verified with the item's whole set.

A word is a run of letters and digits, lower-cased. Items of fewer words than a shingle are one shingle of all
their words and are sought as such; items without words match nothing.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_batches, materialize, small_side, trimmed
from .units import spans

WORD = re.compile(r"[^\W_]+")
#: Bytes of item texts that one broadcast holds; larger benchmarks pass in several blocks.
ITEM_BYTES = 4 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_indexes: dict[str, ItemIndex] = {}


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit value for each run of size word numbers."""
    with np.errstate(over="ignore"):
        n = len(ids) - size + 1
        out = np.zeros(max(0, n), np.uint64)
        for i in range(size if n > 0 else 0):
            out = _mix(out * _FACTOR + ids[i : i + n].astype(np.uint64) + np.uint64(1))
        return out


def _rows(windows: np.ndarray) -> np.ndarray:
    """Each row as one value, which equals another's if the rows are equal."""
    windows = np.ascontiguousarray(windows, np.int32)
    return windows.view(f"V{4 * windows.shape[1]}").ravel()


class Partition:
    """Sketches of items of like size: (words in a shingle, bit length of the number of distinct shingles)."""

    def __init__(self, numbers: list[int], sketches: list[np.ndarray], least: list[int], need: list[int]):
        hashes, owner = np.concatenate(sketches), np.repeat(np.arange(len(numbers)), list(map(len, sketches)))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner = hashes[order], owner[order]
        self.numbers, self.least, self.need = np.array(numbers), np.array(least), min(need)

    def candidates(self, hashes: np.ndarray) -> list[int]:
        """Numbers of the items of whose sketches these (distinct) hashes have enough."""
        if len(hashes) < self.need:
            return []
        low = np.searchsorted(self.hashes, hashes, "left")
        n = np.searchsorted(self.hashes, hashes, "right") - low
        hits = np.bincount(self.owner[spans(low, n)], minlength=len(self.numbers))
        return self.numbers[hits >= self.least].tolist()


class ItemIndex:
    """Partitions and shingle sets of a block of items, in the numbering of their own words."""

    def __init__(self, items: list[tuple[int, str]], size: int, threshold: float):
        self.threshold = threshold
        self.words: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []  # id, shingles
        parts: dict[tuple[int, int], list] = {}
        for item_id, text in items:
            ws = words_of(text)
            if not ws:
                continue
            k = min(size, len(ws))
            ids = np.array([self.words.setdefault(w, len(self.words)) for w in ws], np.int32)
            runs = np.unique(np.lib.stride_tricks.sliding_window_view(ids, k), axis=0)
            n = len(runs)
            need = max(1, int(np.ceil(threshold * n - 1e-9)))
            length = min(n, 2 * (n - need) + 1)
            hashes = np.unique(np.concatenate([rolling(r, k) for r in runs]))[:length]
            # Hashes of an item that collide are one, so a document lacks no more of them than of the shingles.
            parts.setdefault((k, n.bit_length()), []).append((len(self.items), hashes, max(1, len(hashes) - (n - need)), need))
            self.items.append((item_id, _rows(runs)))
        self.parts = {key: Partition(*map(list, zip(*rows))) for key, rows in sorted(parts.items())}
        self.sizes = sorted({k for k, _ in self.parts})

    def find(self, text: str | None) -> list[tuple[int, float]]:
        """(item id, containment) of the items that the text contains to at least the threshold, by id."""
        get = self.words.get
        ids = np.array([get(w, -1) for w in words_of(text)], np.int32)
        out = []
        for k in self.sizes:
            if len(ids) < k:
                continue
            known = np.flatnonzero(np.convolve(ids >= 0, np.ones(k, np.int64), "valid") == k)
            if not len(known):
                continue
            windows = np.lib.stride_tricks.sliding_window_view(ids, k)[known]
            h = np.zeros(len(known), np.uint64)
            with np.errstate(over="ignore"):
                for i in range(k):
                    h = _mix(h * _FACTOR + windows[:, i].astype(np.uint64) + np.uint64(1))
            h = np.unique(h)
            found = [number for (words, _), part in self.parts.items() if words == k for number in part.candidates(h)]
            if not found:
                continue
            have = np.unique(_rows(windows))
            for number in found:
                item_id, shingles = self.items[number]
                share = float(np.isin(shingles, have).sum()) / len(shingles)
                if share >= self.threshold - 1e-12:
                    out.append((item_id, share))
        return sorted(out)


_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("containment", pa.float64())]))


def _index(shared, key: str) -> ItemIndex:
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = shared.value
    return _indexes[key]


def _search(shared, key, names, text_at):
    """Rows with what is found in each."""

    def run(parts):
        index = _index(shared, key)
        for part in parts:
            found = [[{"item_id": i, "containment": c} for i, c in index.find(text)] for text in part.column(text_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, _HIT)], names=names)

    return run


def _hits(shared, key):
    """(id, text) to (digest of the text, id, hits) of the rows with any."""

    def run(parts):
        index = _index(shared, key)
        for part in parts:
            found = [(i, t, hits) for i, t in enumerate(part.column(1).to_pylist()) if (hits := index.find(t))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for _, t, _ in found], pa.string()),
                    part.column(0).take(pa.array([i for i, _, _ in found], pa.int64())),
                    pa.array([[{"item_id": i, "containment": c} for i, c in hits] for _, _, hits in found], _HIT),
                ],
                names=["digest", "id", "hits"],
            )

    return run


def _found(docs: DataFrame, benchmark: DataFrame, id_col, text_col, item_id_col, item_text_col, words, threshold, item_bytes) -> DataFrame:
    """docs with __tw_hits: array of (item_id, containment)."""
    spark = docs.sparkSession
    limit_batches(spark)
    items = benchmark.select(F.col(item_id_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).dropna()
    blocks = -(-(items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // item_bytes)
    none = F.expr("CAST(array() AS array<struct<item_id: bigint, containment: double>>)")
    if blocks == 0:
        return docs.withColumn("__tw_hits", none)

    def block(b: int):
        part = items.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).orderBy("i", "t").collect()
        return spark.sparkContext.broadcast(ItemIndex([(r.i, r.t) for r in part], words, threshold)), uuid.uuid4().hex

    if blocks == 1:
        schema = docs.withColumn("__tw_hits", none).schema
        return docs.mapInArrow(trimmed(_search(*block(0), schema.names, docs.columns.index(text_col))), schema)
    # Each block reads the texts and gives the few rows with hits; these are joined by id and text, in which rows that
    # are both alike have the same hits.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    hits = [
        materialize(texts.mapInArrow(trimmed(_hits(*block(b))), f"digest string, id {kind}, hits array<struct<item_id: bigint, containment: double>>").distinct(), "leaks")
        for b in range(blocks)
    ]
    every = hits[0]
    for more in hits[1:]:
        every = every.union(more)
    every = materialize(every.groupBy("digest", "id").agg(F.flatten(F.collect_list("hits")).alias("__tw_hits")), "leaks")
    every = every.withColumnsRenamed({"digest": "__tw_digest", "id": "__tw_id"})
    n, at = every.count(), F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"), 256)
    joined = docs.join(small_side(every, n, 512), (at == F.col("__tw_digest")) & F.col(f"`{id_col}`").eqNullSafe(F.col("__tw_id")), "left")
    return joined.select(*[docs[f"`{c}`"] for c in docs.columns], F.coalesce("__tw_hits", none).alias("__tw_hits"))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    words: int = 5,
    threshold: float = 0.8,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """A row per row of docs: doc_id, item_ids (ascending), n_items, containment (the largest; 0.0 without items).

    An item counts if the document has at least `threshold` of its distinct word shingles. Null and empty texts
    have no items; items with a null id or no words are not sought, items that repeat an id count once. Other columns
    of docs are not read, whatever their names. An empty benchmark finds nothing; empty docs give an empty table.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__tw_text"))
    rows = _found(rows, benchmark, "doc_id", "__tw_text", item_id_col, item_text_col, words, threshold, item_bytes)
    ids = F.array_sort(F.array_distinct(F.expr("transform(__tw_hits, x -> x.item_id)")))
    return rows.select(
        "doc_id",
        ids.alias("item_ids"),
        F.size(ids).cast("long").alias("n_items"),
        F.coalesce(F.array_max(F.expr("transform(__tw_hits, x -> x.containment)")), F.lit(0.0)).alias("containment"),
    )


def drop_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    words: int = 5,
    threshold: float = 0.8,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """The rows of docs that contain no benchmark item, with all their columns, whatever their names."""
    found = _found(docs, benchmark, id_col, text_col, item_id_col, item_text_col, words, threshold, item_bytes)
    return found.filter("size(__tw_hits) = 0").select(*[F.col(f"`{c}`") for c in docs.columns])
