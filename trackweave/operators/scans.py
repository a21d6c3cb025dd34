"""Sequential rules over one long clip as scans: a chunk of frames is a map over the rule's states, and maps compose."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import P, Params
from ..tables import materialize

#: Frames of a chunk, and chunks (or groups of them) that one task composes.
CHUNK, FAN = 1024, 1024


def cut_tables(cooldown: int) -> np.ndarray:
    """Next state of the cut detector for a low and a high difference; states: quiet, one high, and 1 + c with c frames to wait.

    A cut is a high difference in state 1.
    """
    wait = np.arange(cooldown)
    return np.array([np.r_[0, 0, np.where(wait == 0, 0, 1 + wait)], np.r_[1, 1 + cooldown if cooldown else 0, np.where(wait == 0, 0, 1 + wait)]])


def _levels(maps: DataFrame, fan: int, top: int) -> list[DataFrame]:
    """Maps of chunks, of groups of fan chunks, of groups of those, to one a clip."""

    def compose(key, rows):
        order = np.argsort(rows.column("chunk").to_numpy())
        every = np.array(rows.column("map").to_pylist())[order]
        whole = every[0]
        for m in every[1:]:
            whole = m[whole]
        return pa.table([pa.array([k.as_py()], k.type) for k in key] + [pa.array([whole.tolist()], pa.list_(pa.int32()))], names=["clip_id", "chunk", "map"])

    out = [maps]
    while top > 0:
        up = out[-1].withColumn("chunk", F.floor(F.col("chunk") / fan)).groupBy("clip_id", "chunk").applyInArrow(compose, maps.schema)
        out.append(materialize(up, "scan-maps"))
        top //= fan
    return out


def _entries(levels: list[DataFrame], fan: int) -> DataFrame:
    """The state in which each chunk begins, from the clip downwards."""

    def spread(key, rows):
        order = np.argsort(rows.column("chunk").to_numpy())
        every, state, out = rows.column("map").to_pylist(), rows.column("entry")[0].as_py(), np.zeros(len(order), np.int32)
        for i in order:
            out[i] = state
            state = every[i][state]
        return pa.table([rows.column("clip_id"), rows.column("chunk"), pa.array(out)], names=["clip_id", "chunk", "entry"])

    schema = levels[0].select("clip_id", "chunk", F.lit(0).alias("entry")).schema
    found = levels[-1].select("clip_id", "chunk", F.lit(0).alias("entry"))
    for level in levels[-2::-1]:
        parents = found.select(F.col("clip_id").alias("c"), F.col("chunk").alias("k"), "entry")
        below = level.withColumn("parent", F.floor(F.col("chunk") / fan))
        below = below.join(parents, F.col("clip_id").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("k"))).drop("c", "k")
        found = below.groupBy("clip_id", "parent").applyInArrow(spread, schema)
    return found


def cuts(frames: DataFrame, p: Params = P, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(clip_id, frame, is_cut) of frames (clip_id, frame, mad): two high differences in a row, then none for a cooldown.

    No task gets a clip: rows meet by clip and chunk of frames, then maps by groups of fan chunks, level by level. A chunk
    holds the rows of `chunk` frame numbers; rows of one frame count one after the other. Null and NaN differences are
    low; rows without a frame are left out; an empty table gives an empty table. Other columns are not read.
    """
    tables = cut_tables(p.cut_cooldown)
    rows = frames.select("clip_id", F.col("frame").cast("long").alias("frame"), F.coalesce((F.col("mad") > p.cut_mad) & ~F.isnan("mad"), F.lit(False)).alias("high"))
    rows = rows.filter("frame IS NOT NULL").withColumn("chunk", F.floor(F.col("frame") / chunk))
    span = rows.agg(F.min("chunk").alias("least"), F.max("chunk").alias("most")).first()
    least, most = span.least or 0, span.most or 0
    rows = rows.withColumn("chunk", F.col("chunk") - least)
    kind = rows.schema["clip_id"].dataType.simpleString()

    def as_map(key, part):
        high = part.column("high").to_numpy(zero_copy_only=False)[np.lexsort((part.column("high").to_numpy(zero_copy_only=False), part.column("frame").to_numpy()))]
        states = np.arange(tables.shape[1])
        for h in high.astype(int):
            states = tables[h][states]
        return pa.table([pa.array([k.as_py()], k.type) for k in key] + [pa.array([states.tolist()], pa.list_(pa.int32()))], names=["clip_id", "chunk", "map"])

    def flagged(key, part):
        order = np.lexsort((part.column("high").to_numpy(zero_copy_only=False), part.column("frame").to_numpy()))
        high, out = part.column("high").to_numpy(zero_copy_only=False).astype(int), np.zeros(len(order), bool)
        state = part.column("entry")[0].as_py()
        for i in order:
            out[i] = state == 1 and high[i] == 1
            state = int(tables[high[i]][state])
        return pa.table([part.column("clip_id"), part.column("frame"), pa.array(out)], names=["clip_id", "frame", "is_cut"])

    maps = materialize(rows.groupBy("clip_id", "chunk").applyInArrow(as_map, f"clip_id {kind}, chunk long, map array<int>"), "scan-maps")
    begun = _entries(_levels(maps, fan, most - least), fan)
    # A row for each chunk of rows; clips may have no name, so the join takes nulls as equal.
    begun = begun.select(F.col("clip_id").alias("c"), F.col("chunk").alias("k"), "entry")
    joined = rows.join(begun, F.col("clip_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k"))).drop("c", "k")
    return joined.groupBy("clip_id", "chunk").applyInArrow(flagged, f"clip_id {kind}, frame long, is_cut boolean")
