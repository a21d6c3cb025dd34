"""SentencePiece encoding and decoding, with giant documents as a max-plus scan over chunks (see maxplus).

Ordinary documents are encoded in one piece. For BPE models whose pieces never span a word border the ids of a
text are those of its words, and each distinct word goes through the library once per worker. Giant documents are
cut into chunks at fixed places, wherever these fall; each chunk gives its boundary-state matrix, matrices are
combined in groups level by level, and each chunk is traced by itself from the states that come back.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, limit_batches, materialize, trimmed
from .maxplus import SPACE, Chunk, PieceLattice, product, resolve
from .units import CACHE_PARTS, LOWER, LOWER_CLASS, MARK_CLASS, MARKS, UPPER, UPPER_CLASS, UnitEncoder, joined

#: Characters from which on a document is giant, of a chunk, and chunks (or groups) that one group combines.
GIANT_CHARS, CHUNK_CHARS, FAN = 32_768, 8_192, 128
_models: dict[str, PieceModel] = {}


class PieceModel(UnitEncoder):
    """A SentencePiece model file with the tables that encoding by words, scanning and decoding take.

    The units are words with the space before them, words at the beginning of a line, and line feeds.
    """

    def __init__(self, path: str, most: int = CACHE_PARTS):
        super().__init__(most)
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.kind = "<u2" if n <= 1 << 16 else "<u4"
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        pieces = {sp.id_to_piece(i): sp.get_score(i) for i in range(n) if not special[i]}
        # The library gives no access to the model's kind: BPE scores are whole, minus the rank of the merge.
        whole = all(float(s).is_integer() for s in pieces.values())
        self.lattice = PieceLattice(pieces, "bpe" if whole else "unigram")
        self.id = {p: sp.piece_to_id(p) for p in pieces}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = all(sp.is_byte(i) for i in self.byte)
        self.piece_bytes = [
            bytes([self.byte.index(i)]) if sp.is_byte(i) else b"" if special[i] else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)
        ]
        probe = "A  b \u0301\uff21"  # what a normaliser would change
        plain = sp.normalize(probe) == SPACE + probe.replace(" ", SPACE)
        self.by_words = whole and plain and self.fallback and not self.lattice.space_inside and "\n" not in self.lattice.joined
        letters, marks = set(LOWER + UPPER), set(MARKS)
        if not any(a in letters and b in marks for p in pieces for a, b in zip(p, p[1:])):
            self.pattern, self.letters = f"^ ?[{LOWER_CLASS}{UPPER_CLASS}]+[{MARK_CLASS}]*$", " " + LOWER + UPPER

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        ids = self.sp.encode([p[1:] if p[0] == " " else "\n" + p for p in parts], num_threads=1)
        return [np.array(x if p[0] == " " else x[2:], self.kind).tobytes() for p, x in zip(parts, ids)]

    def encode_unit(self, unit: str) -> list[int]:
        """Ids of normalised text with spaces for the mark of a space, cut off at a place that no piece crosses."""
        if not unit:
            return []
        if unit == " ":
            return [self.id[SPACE]]
        return self.sp.encode(unit[1:]) if unit[0] == " " else self.sp.encode("\n" + unit)[2:]

    def encode_normal(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised texts (as for encode_unit) one after the other, and where each text's begin.

        Runs of spaces merge among themselves, so texts with such runs go through the library whole.
        """
        odd = pc.match_substring_regex(column, "  |\x1f").to_numpy(zero_copy_only=False)
        usual = column.filter(pa.array(~odd))
        units = pc.replace_substring(pc.replace_substring(usual, " ", "\x1f "), "\n", "\x1f\n\x1f")
        lists = pc.split_pattern(units, "\x1f")
        edges, ids = self.gather(lists, lists.flatten())
        if not odd.any():
            return edges, ids
        others = iter([np.array(self.encode_unit(t), self.kind) for t in column.filter(pa.array(odd)).to_pylist()])
        whole = iter([ids[a:b] for a, b in zip(edges, edges[1:])])
        parts = [next(others) if x else next(whole) for x in odd]
        return np.cumsum([0, *map(len, parts)]), np.concatenate(parts)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a string column one after the other, and where each text's begin (and the last's end)."""
        column = column.fill_null("")
        if not self.by_words:
            parts = self.sp.encode(column.to_pylist(), num_threads=1)
            return np.cumsum([0, *map(len, parts)]), np.array([i for p in parts for i in p], self.kind)
        spaced = pc.replace_substring(column, SPACE, " ")
        return self.encode_normal(pc.if_else(pc.equal(spaced, ""), "", pc.binary_join_element_wise(" ", spaced, "")))

    def between(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of normalised texts between two places that no piece crosses."""
        if self.by_words:
            edges, ids = self.encode_normal(pa.array([t.replace(SPACE, " ") for t in texts], pa.string()))
            return [ids[a:b] for a, b in zip(edges, edges[1:])]
        out, lat = [], self.lattice
        for text in texts:
            ways, at, found = lat.ways(text, (0, 0), len(text)), len(text), []
            while at:
                begin = ways[at][1]
                found.append(text[begin:at])
                at = begin
            out.append(np.array([i for p in reversed(found) for i in self.ids_of(p)], self.kind))
        return out

    def ids_of(self, piece: str) -> list[int]:
        """Of a piece of the lattice; a character that is no piece is its bytes, or unknown."""
        if piece in self.id:
            return [self.id[piece]]
        return [self.byte[b] for b in piece.encode()] if self.fallback else [self.sp.unk_id()]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, the space that encoding puts in front taken off."""
        data = b"".join(map(self.piece_bytes.__getitem__, ids.tolist()))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _encode(path: str, names: list[str], text_at: int, decoded: bool):
    def run(parts):
        sp = model(path)
        for part in joined(parts):
            edges, ids = sp.encode(part.column(text_at))
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int32)))
            texts = [pa.array([sp.decode(ids[a:b]) for a, b in zip(edges, edges[1:])], pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([*part.columns, lists, *texts], names=names)

    return run


def _chunks(path: str, chunk_chars: int):
    """(rid, text) to (rid, pos, chunks, left, right, text, matrix): chunks with a piece's length around them."""

    def run(parts):
        sp = model(path)
        lat = sp.lattice
        size = max(chunk_chars, 2 * lat.longest + 2)
        for part in parts:
            for rid, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                text = SPACE + raw.replace(" ", SPACE) if sp.by_words else sp.sp.normalize(raw)
                n = max(1, len(text) // size)
                for pos in range(n):
                    a, b = pos * size, len(text) if pos == n - 1 else (pos + 1) * size
                    lo, hi = max(0, a - lat.longest), min(len(text), b + lat.longest)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x], t) for x, t in ((rid, pa.int64()), (pos, pa.int64()), (n, pa.int64()), (a - lo, pa.int32()), (b - lo, pa.int32()), (text[lo:hi], pa.string()))],
                        names=["rid", "pos", "chunks", "left", "right", "text"],
                    )

    return run


def _chunk(sp: PieceModel, row: dict) -> Chunk:
    return Chunk(sp.lattice, row["text"], row["left"], row["right"], row["pos"] == 0, row["pos"] == row["chunks"] - 1)


def _matrices(path: str):
    def run(parts):
        sp = model(path)
        for part in parts:
            blobs = [pickle.dumps(_chunk(sp, row).matrix()) for row in part.to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(blobs, pa.binary())], names=[*part.schema.names, "matrix"])

    return run


def _combine(key, table):
    rows = table.sort_by("pos")
    out = None
    for blob in rows.column("matrix").to_pylist():
        m = pickle.loads(blob)
        out = m if out is None else product(out, m)
    return pa.table({"rid": [key[0].as_py()], "pos": [key[1].as_py()], "matrix": pa.array([pickle.dumps(out)], pa.binary())})


def _states(key, table):
    rows = table.sort_by("pos")
    matrices = [pickle.loads(x) for x in rows.column("matrix").to_pylist()]
    entry, exit_ = rows.column("up_entry")[0].as_py(), rows.column("up_exit")[0].as_py()
    found = resolve(matrices, entry, None if exit_ < 0 else exit_)
    return pa.table(
        {"rid": rows.column("rid"), "pos": rows.column("pos"), "entry": pa.array([x for x, _ in found], pa.int64()), "exit": pa.array([y for _, y in found], pa.int64())}
    )


def _trace(path: str):
    def run(parts):
        sp = model(path)
        for part in parts:
            rows, middles = [], []

            def middle(text: str) -> int:
                middles.append(text)
                return len(middles) - 1

            for row in part.to_pylist():
                rows.append(_chunk(sp, row).pieces(row["entry"], row["exit"], middle))
            inner = sp.between(middles) if middles else []
            ids = [np.concatenate([inner[x] if isinstance(x, int) else sp.ids_of(x) for x in row] or [[]]).astype(np.int32) for row in rows]
            yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("pos"), pa.array(ids, pa.list_(pa.int32()))], names=["rid", "pos", "ids"])

    return run


def _scan(giants: DataFrame, path: str, chunk_chars: int, fan: int) -> DataFrame:
    """(rid, ids) of giant documents (rid, text)."""
    spark = giants.sparkSession
    chunks = giants.mapInArrow(_chunks(path, chunk_chars), "rid long, pos long, chunks long, left int, right int, text string")
    chunks = chunks.repartition(max(spark.sparkContext.defaultParallelism * 2, 8), "rid", "pos")
    chunks = materialize(chunks.mapInArrow(trimmed(_matrices(path)), "rid long, pos long, chunks long, left int, right int, text string, matrix binary"), "pieces")
    levels = [chunks.select("rid", "pos", "matrix")]
    most = chunks.agg(F.max("pos")).first()[0] or 0
    while most >= fan:
        below = levels[-1].withColumn("group", F.expr(f"pos div {fan}"))
        levels.append(materialize(below.groupBy("rid", "group").applyInArrow(_combine, "rid long, pos long, matrix binary"), "pieces-up"))
        most //= fan
    top = levels[-1].withColumn("group", F.lit(0).cast("long")).withColumn("up_entry", F.lit(0).cast("long")).withColumn("up_exit", F.lit(-1).cast("long"))
    states = top.groupBy("rid", "group").applyInArrow(_states, "rid long, pos long, entry long, exit long")
    for level in reversed(levels[:-1]):
        known = states.select(F.col("rid").alias("r"), F.col("pos").alias("p"), F.col("entry").alias("up_entry"), F.col("exit").alias("up_exit"))
        below = level.withColumn("group", F.expr(f"pos div {fan}")).join(known, (F.col("rid") == F.col("r")) & (F.col("group") == F.col("p"))).drop("r", "p")
        states = below.groupBy("rid", "group").applyInArrow(_states, "rid long, pos long, entry long, exit long")
    states = states.select(F.col("rid").alias("r"), F.col("pos").alias("p"), "entry", "exit")
    traced = chunks.drop("matrix").join(states, (F.col("rid") == F.col("r")) & (F.col("pos") == F.col("p"))).drop("r", "p")
    ids = traced.mapInArrow(trimmed(_trace(path)), "rid long, pos long, ids array<int>")
    return ids.groupBy("rid").agg(F.flatten(F.expr("transform(array_sort(collect_list(struct(pos, ids))), x -> x.ids)")).alias("ids"))


def encode(
    docs: DataFrame,
    model_path: str,
    text_col: str = "text",
    ids_col: str = "ids",
    decoded_col: str | None = None,
    giant_chars: int = GIANT_CHARS,
    chunk_chars: int = CHUNK_CHARS,
    fan: int = FAN,
) -> DataFrame:
    """docs with ids_col: the model's ids of text_col, as array<int>; and with decoded_col, if named, the ids decoded again.

    The ids are those the library gives for the whole text. Null and empty texts have no ids. Other columns come
    back as they were (those named like the new ones are replaced); repeated rows each have their ids; an empty table gives
    an empty table. The model file must be at model_path on every executor.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    kept = [c for c in docs.columns if c not in (ids_col, decoded_col)]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    giant = F.coalesce(F.length(F.col(f"`{text_col}`")) > giant_chars, F.lit(False))
    schema = rows.select("*").schema.add(ids_col, T.ArrayType(T.IntegerType()))
    if decoded_col:
        schema = schema.add(decoded_col, T.StringType())
    ordinary = rows.filter(~giant).mapInArrow(trimmed(_encode(model_path, schema.names, kept.index(text_col), bool(decoded_col))), schema)
    long = materialize(rows.filter(giant).withColumn("__tw_rid", F.monotonically_increasing_id()), "giants")
    if long.isEmpty():
        discard(long)
        return ordinary
    found = _scan(long.select(F.col("__tw_rid").alias("rid"), F.col(f"`{text_col}`").alias("text")), model_path, chunk_chars, fan)
    found = materialize(found.select(F.col("rid").alias("__tw_r"), F.col("ids").alias(ids_col)), "giant-ids")
    if decoded_col:
        found = decode(found, model_path, ids_col, decoded_col)
    scanned = long.join(found, F.col("__tw_rid") == F.col("__tw_r")).select(*[F.col(f"`{c}`") for c in schema.names])
    return ordinary.union(scanned)


def _decode(path: str, names: list[str], ids_at: int):
    def run(parts):
        sp = model(path)
        for part in parts:
            lists = part.column(ids_at)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            texts = [sp.decode(values[a:b]) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=names)

    return run


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with text_col: the text of ids_col; null or no ids give the empty text."""
    limit_batches(rows.sparkSession)
    kept = [c for c in rows.columns if c != text_col]
    rows = rows.select(*[F.col(f"`{c}`") for c in kept])
    schema = rows.select("*").schema.add(text_col, "string")
    return rows.mapInArrow(trimmed(_decode(model_path, schema.names, kept.index(ids_col))), schema)
