"""SimHash near-dedup with bit-sliced comparison.

Fingerprints are compared inside blocks. For small radii the blocks are exact: the bits are cut into radius + 2
parts, and two fingerprints within the radius agree in two parts at least, so each pair of parts is a key. For a
word-shingle similarity the radius is too wide for that; there, documents meet that share a smallest shingle under
one of several hash orders, the bit-sliced distance (384 bits) drops strangers, and exact shingle sets decide.

Equal fingerprints, or equal word sequences, are one node from the start. A key that more than `block` nodes share
is dealt out as pairs of blocks, so no task holds more than two blocks, and a task returns a spanning forest of
what it links, never all its pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitslice import neighbours, pairs_within, spanning
from .common import LOWER_AZ, discard, limit_batches, materialize, small_side, text_bytes, trimmed
from .components import connected_components

#: Nodes of a key that one task compares; keys with more are dealt out as pairs of blocks.
BLOCK = 4096
#: Hash orders for blocking: a pair of similarity 0.8 shares no smallest shingle with probability 0.2 ** 12 (4e-9).
ORDERS = 12
#: Words of a fingerprint for similarity. At 0.8 the distance is 72 of its 384 bits with a deviation of 7.6 at most (4
#: against 5 shingles), so a pair is beyond the radius with probability 3e-9: less than the hash orders lose. Fewer bits
#: would need a radius so wide that strangers link, and whole clusters of them go to verification.
PRINTS = [f"f{i}" for i in range(6)]
SIMILAR_RADIUS = 119
#: Shingles of a block in exact verification, and its documents.
SET_BLOCK, DOC_BLOCK = 1_000_000, 1024
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    """Words between white space, A-Z lower-cased."""
    return text.translate(LOWER_AZ).split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of size words, repeats included; of all words if there are fewer."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[itertools.islice(words, i, None) for i in range(size)]))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(42)), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """A bit is set if more than half of the hashes have it."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def _mixed(hashes: np.ndarray, order: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = hashes + _MIX * np.uint64(order + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _fingerprints(size: int):
    def run(parts):
        for part in parts:
            prints = [majority(shingle_hashes(words_of(t), size)) for t in text_bytes(part.column(1))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["doc_id", "fp"]
            )

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp) of every row: the 64-bit fingerprint over word shingles, zero for a text without words."""
    limit_batches(docs.sparkSession)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        trimmed(_fingerprints(words)), f"doc_id {kind}, fp long"
    )


def _groups(parts, columns: int):
    """Rows sorted by their first column, as (numpy key array, list of column arrays) with whole keys."""
    held = None
    for part in parts:
        batch = pa.Table.from_batches([part])
        if held is not None:
            batch = pa.concat_tables([held, batch])
        keys = batch.column(0).to_numpy()
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        held = batch.slice(cut)
        if cut:
            yield batch.slice(0, cut)
    if held is not None and held.num_rows:
        yield held


def _compare(radius: int, small: int = 48):
    """Rows (key, side, node, fp words) sorted by key to links (a, b): spanning forests of the close nodes of each key."""

    def links(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(parts):
        for rows in _groups(parts, 4):
            keys, side, node = (rows.column(i).to_numpy() for i in range(3))
            words = np.column_stack([rows.column(i).to_numpy().view(np.uint64) for i in range(3, rows.num_columns)])
            start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            size = np.diff(np.r_[start, len(keys)])
            left, right = [], []
            for at, n in zip(start[(size > 1) & (size <= small)], size[(size > 1) & (size <= small)]):
                i, j = np.triu_indices(n, 1)
                left.append(at + i)
                right.append(at + j)
            if left:
                left, right = np.concatenate(left), np.concatenate(right)
                differ = (node[left] != node[right]) & ((side[left] == 2) | (side[left] != side[right]))
                left, right = left[differ], right[differ]
                hit = pairs_within(words, left, right, radius)
                label = spanning(len(keys), left[hit], right[hit])
                tied = np.flatnonzero(label != np.arange(len(keys)))
                if len(tied):
                    yield links(node[tied], node[label[tied]])
            for at, n in zip(start[size > small], size[size > small]):
                first = np.arange(at, at + n) if side[at] == 2 else at + np.flatnonzero(side[at : at + n] == 0)
                other = first if side[at] == 2 else at + np.flatnonzero(side[at : at + n] == 1)
                if not len(first) or not len(other):
                    continue
                ls, rs = [], []
                label = np.arange(n)
                held = 0
                for i, js in neighbours(words[first], words[other], radius):
                    ls.append(np.full(len(js), first[i] - at))
                    rs.append(other[js] - at)
                    held += len(js)
                    if held > 2_000_000:
                        ls.append(np.arange(n))
                        rs.append(label)
                        label = spanning(n, np.concatenate(ls), np.concatenate(rs))
                        ls, rs, held = [], [], 0
                if ls:
                    ls.append(np.arange(n))
                    rs.append(label)
                    label = spanning(n, np.concatenate(ls), np.concatenate(rs))
                tied = np.flatnonzero(label != np.arange(n))
                if len(tied):
                    yield links(node[at + tied], node[at + label[tied]])

    return run


def dealt(rows: DataFrame, key: str, n_blocks, block_hash) -> DataFrame:
    """rows with `key` made finer for hot keys: (key, block, block) for each pair of its blocks, and the side.

    n_blocks: column with the number of blocks of the key (1: all its rows meet in one task, side 2).
    """
    numbered = rows.withColumn("__nb", n_blocks).withColumn("__b", F.expr(f"pmod({block_hash}, __nb)"))
    whole = numbered.filter("__nb = 1").withColumn("side", F.lit(2))
    split = (
        numbered.filter("__nb > 1")
        .withColumn("__o", F.explode(F.expr("sequence(0L, __nb - 1)")))
        .withColumn("side", F.expr("CASE WHEN __o = __b THEN 2 WHEN __b < __o THEN 0 ELSE 1 END"))
        .withColumn(key, F.expr(f"xxhash64({key}, least(__b, __o), greatest(__b, __o))"))
        .drop("__o")
    )
    return whole.unionByName(split).drop("__nb", "__b")


def close_links(rows: DataFrame, radius: int, words: list[str], block: int = BLOCK) -> DataFrame:
    """Links (a, b) of the nodes that share a key and are within the radius; rows: (key long, node long, words long)."""
    count = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    hot = materialize(count, "hot-keys", most=0)
    n_hot = hot.count()
    if n_hot:
        rows = rows.join(small_side(hot, n_hot, 16), "key", "left")
        rows = dealt(rows, "key", F.expr(f"coalesce(ceil(n / {block}), 1L)"), "xxhash64(node)")
    else:
        rows = rows.withColumn("side", F.lit(2))
    rows = rows.select("key", F.col("side").cast("int"), "node", *words)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(trimmed(_compare(radius)), "a long, b long")


def part_keys(fp, radius: int) -> F.Column:
    """Keys under which any two 64-bit fingerprints within the radius meet: the bits of each two of radius + 2 parts."""
    edges = [round(64 * i / (radius + 2)) for i in range(radius + 3)]
    masks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(radius + 2)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = []
    for number, (a, b) in enumerate(itertools.combinations(masks, 2)):
        keys.append(F.xxhash64(F.lit(number), fp.bitwiseAND(F.lit(signed(a | b)).cast("long"))))
    return F.array(*keys)


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, block: int = BLOCK
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row; links join fingerprints within the radius.

    component_id is the smallest id of the rows that the row reaches over links, itself included. Null and empty
    texts have fingerprint zero and link like any other; texts of fewer words than a shingle are one shingle.
    Rows with a null id have a component like any other (null if nothing else is in it); repeated rows come back
    each. Other columns are not read. An empty table gives an empty table.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, words), "simhash")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes", most=16 * marked.count())
    n = nodes.count()
    keyed = nodes.select(F.col("fp").alias("node"), "fp", F.explode(part_keys(F.col("fp"), radius)).alias("key"))
    links = close_links(keyed, radius, ["fp"], block)
    parts = connected_components(links, most=16 * n)
    placed = nodes.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_fp = materialize(placed.join(least, "root").select("fp", "component_id"), "simhash-groups", most=16 * n)
    discard(nodes)
    return marked.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Similarity of word shingles


def _signatures(size: int, orders: int):
    def run(parts):
        import xxhash

        for part in parts:
            digests, prints, counts, mins = [], [], [], []
            for text in text_bytes(part.column(1)):
                ws = words_of(text)
                digests.append(xxhash.xxh3_128_digest(b" ".join(ws)))
                h = np.unique(shingle_hashes(ws, size))
                counts.append(len(h))
                prints.append([majority(h), *(majority(_mixed(h, 99 + k)) for k in range(len(PRINTS) - 1))])
                mins.append([int(_mixed(h, k).min().view(np.int64)) for k in range(orders)] if len(h) else [0] * orders)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(2),
                    pa.array(digests, pa.binary()),
                    *(pa.array(x) for x in np.array(prints, np.uint64).reshape(-1, len(PRINTS)).T.copy().view(np.int64)),
                    pa.array(counts, pa.int64()),
                    pa.array(mins, pa.list_(pa.int64())),
                ],
                names=["doc_id", "th", "digest", *PRINTS, "n", "mins"],
            )

    return run


def _sets(size: int):
    """(doc_id, text, digest, node, cluster) to (cluster, node, shingles); rows whose text isn't the node's go."""

    def run(parts):
        import xxhash

        for part in parts:
            cluster, node, sets = [], [], []
            want, nodes, clusters = (part.column(i).to_pylist() for i in (1, 2, 3))
            for i, text in enumerate(text_bytes(part.column(0))):
                ws = words_of(text)
                if xxhash.xxh3_128_digest(b" ".join(ws)) == want[i]:
                    cluster.append(clusters[i])
                    node.append(nodes[i])
                    sets.append(np.unique(shingle_hashes(ws, size)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cluster, pa.int64()), pa.array(node, pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                names=["cluster", "node", "shingles"],
            )

    return run


def _verify(threshold: float):
    """Rows (key, side, node, shingles) sorted by key to links of nodes whose sets are at least threshold similar."""

    def run(parts):
        for rows in _groups(parts, 4):
            rows = rows.combine_chunks()
            keys, side, node = (rows.column(i).to_numpy() for i in range(3))
            lists = rows.column(3).combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            for at, end in zip(start, np.r_[start[1:], len(keys)]):
                _, pick = np.unique(node[at:end], return_index=True)
                own = at + pick
                if len(own) < 2:
                    continue
                size = offsets[own + 1] - offsets[own]
                doc = np.repeat(np.arange(len(own)), size)
                flat = np.concatenate([values[offsets[i] : offsets[i + 1]] for i in own])
                _, word, times = np.unique(flat, return_inverse=True, return_counts=True)
                shared = times[word] > 1
                doc, word = doc[shared], word[shared]
                order = np.argsort(word, kind="stable")
                doc, word = doc[order], word[order]
                common = np.zeros((len(own), len(own)), np.float32)
                cuts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
                ends = np.r_[cuts[1:], len(word)]
                for c in range(0, len(cuts), 2048):
                    lo, hi = cuts[c], ends[min(c + 2048, len(cuts)) - 1]
                    column = np.searchsorted(cuts[c : c + 2048], np.arange(lo, hi), side="right") - 1
                    grid = np.zeros((len(own), len(cuts[c : c + 2048])), np.float32)
                    grid[doc[lo:hi], column] = 1
                    common += grid @ grid.T
                both = common.astype(np.float64)
                close = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
                s = side[own]
                close &= (s[:, None] == 2) | (s[:, None] != s[None, :])
                i, j = np.nonzero(np.triu(close, 1))
                label = spanning(len(own), i, j)
                tied = np.flatnonzero(label != np.arange(len(own)))
                if len(tied):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node[own[tied]], pa.int64()), pa.array(node[own[label[tied]]], pa.int64())], names=["a", "b"]
                    )

    return run


def similar_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    threshold: float = 0.8,
    orders: int = ORDERS,
    radius: int = SIMILAR_RADIUS,
    block: int = BLOCK,
    set_block: int = SET_BLOCK,
    doc_block: int = DOC_BLOCK,
) -> DataFrame:
    """doc_id, component_id and digest of every row; links join texts whose sets of word shingles have a Jaccard
    similarity of at least threshold.

    digest (16 bytes) is that of the text's word sequence. Texts without words are equal to each other. Nulls,
    repeats, ties and empty tables are as for near_groups.
    """
    limit_batches(docs.sparkSession)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    marked = materialize(
        read.mapInArrow(
            trimmed(_signatures(words, orders)),
            f"doc_id {kind}, th long, digest binary, {', '.join(f'{x} long' for x in PRINTS)}, n long, mins array<long>",
        ),
        "similar",
    )
    n_rows = marked.count()
    nodes = materialize(
        marked.groupBy("digest")
        .agg(
            F.min("doc_id").alias("rep"),
            F.expr("min_by(th, struct(doc_id IS NULL, doc_id, th))").alias("rep_th"),
            F.first(F.struct(*PRINTS, "n", "mins")).alias("x"),
        )
        .select(F.monotonically_increasing_id().alias("node"), "digest", "rep", "rep_th", "x.*"),
        "similar-nodes",
        most=(100 + 8 * orders) * n_rows,
    )
    n = nodes.count()
    keyed = nodes.filter("n > 0").select("node", *PRINTS, F.posexplode("mins").alias("order", "least"))
    keyed = keyed.select("node", *PRINTS, F.xxhash64("order", "least").alias("key"))
    loose = materialize(connected_components(close_links(keyed, radius, PRINTS, block), most=16 * n), "similar-loose", most=16 * n)
    members = nodes.join(loose, "node").select("node", F.col("component").alias("cluster"), "digest", "rep", "rep_th", "n")
    members = materialize(members, "similar-members", most=64 * n)
    n_members = members.count()
    sets = materialize(
        read.join(small_side(members, n_members, 64), F.expr("doc_id <=> rep AND th = rep_th"))
        .select("text", "digest", "node", "cluster")
        .mapInArrow(trimmed(_sets(words)), "cluster long, node long, shingles array<long>"),
        "similar-sets",
    )
    sizes = members.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n").alias("total"))
    blocks = sizes.select("cluster", F.expr(f"greatest(ceil(docs / {doc_block}), ceil(total / {set_block}))").alias("blocks"))
    rows = sets.join(blocks, "cluster").withColumnRenamed("cluster", "key")
    rows = dealt(rows, "key", F.col("blocks"), "xxhash64(node)").select("key", F.col("side").cast("int"), "node", "shingles")
    links = rows.repartition("key").sortWithinPartitions("key").mapInArrow(trimmed(_verify(threshold)), "a long, b long")
    parts = connected_components(links, most=16 * n_members)
    placed = nodes.join(parts, "node", "left").select("digest", "rep", F.coalesce("component", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_text = materialize(placed.join(least, "root").select("digest", "component_id"), "similar-groups", most=32 * n)
    for used in (nodes, loose, members, sets):
        discard(used)
    return marked.join(of_text, "digest").select("doc_id", "component_id", "digest")


def dedup_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without near copies: of each group of similar_groups the row with the smallest id stays.

    Rows are told apart by id: rows that repeat the staying id all stay, and a null id stays if some row without
    an id is in a group without ids. All columns come back as they were.
    """
    found = materialize(similar_groups(docs, id_col, text_col, **options).select("doc_id", "component_id"), "similar-found")
    stays = found.filter("doc_id <=> component_id").select("doc_id").distinct()
    goes = found.filter("NOT (doc_id <=> component_id)").select("doc_id").distinct().join(stays, "doc_id", "left_anti")
    goes = materialize(goes.select(F.col("doc_id").alias("__tw_id")), "similar-goes", most=8 * found.count())
    out = docs.join(small_side(goes, goes.count(), 16), F.expr(f"`{id_col}` <=> __tw_id"), "left_anti")
    discard(found)
    return out
