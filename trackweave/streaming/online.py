"""The online path: a step function per frame, a batch twin, and Structured Streaming over the same function on typed state.

A clip's frames arrive in order; a frame at or before the last one processed is dropped and counted. Every frame is
a row of the input, also those without detections (track_id null), since a track that misses a frame loses state.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from ..params import P, Params

OUTPUT = "clip_id string, frame long, track_id long, sx1 long, sy1 long, sx2 long, sy2 long, helmet_ok boolean, label int, is_cut boolean, field_valid boolean, dropped long"
_BOX = ("x1", "y1", "x2", "y2")


def new_state() -> dict:
    return {"last": None, "dropped": 0, "streak": 0, "cooldown": 0, "field": 0, "tracks": {}, "votes": {}}


def cut(state: dict, mad: float | None, p: Params = P) -> bool:
    """Two high differences in a row; after a cut none for a cooldown, which also ends a streak."""
    if state["cooldown"] > 0:
        state["cooldown"] -= 1
        state["streak"] = 0
        return False
    state["streak"] = state["streak"] + 1 if mad is not None and mad > p.cut_mad else 0
    if state["streak"] < 2:
        return False
    state["streak"], state["cooldown"] = 0, p.cut_cooldown
    return True


def field(state: dict, fit_ok: bool) -> bool:
    """Registration is valid after three more good fits than bad ones."""
    state["field"] = max(0, state["field"] + (1 if fit_ok else -1))
    return state["field"] >= 3


def smooth(track: dict, box: list[float], p: Params = P) -> list[int]:
    before = track.get("box")
    track["box"] = box if before is None else [p.ema * n + (1 - p.ema) * b for n, b in zip(box, before)]
    return [int(v) for v in track["box"]]


def helmet(track: dict, confirmed: bool, p: Params = P) -> bool:
    """Grace at first; then enough confirmations among the last ones, one of them once a run of them has locked."""
    seen = track["hits"] = [*track.get("hits", []), bool(confirmed)][-p.helmet_window :]
    track["seen"] = track.get("seen", 0) + 1
    track["run"] = track.get("run", 0) + 1 if confirmed else 0
    track["sure"] = track.get("sure", False) or track["run"] >= p.helmet_soft_lock
    return track["seen"] <= p.helmet_grace or sum(seen) >= (1 if track["sure"] else p.helmet_required)


def margins(distance: float, warmup: bool = False) -> tuple[float, float, int]:
    """Margin of a confident vote, margin to escape a lock, and unanimous votes that lock."""
    if warmup:
        return 1.0, max(2.0, 0.25 * distance), 6
    return max(0.8, 0.12 * distance), max(2.0, 0.25 * distance, 3.0), P.vote_lock


def vote(track: dict, label: int, d0: float, d1: float, area: float, crowded: bool, rule: tuple[float, float, int], p: Params = P) -> int:
    """The label of a track after one more observation: the locked one, else the majority (ties: seen first), else the last, else -1.

    An area of 0 is unknown. A mask far beyond its mean still votes but can't speak against a lock, and ends a run that does.
    """
    confident, escape, lock = rule
    if area > 0:
        track["area"] = 0.9 * track["area"] + 0.1 * area if "area" in track else area
    votes, locked = track.setdefault("votes", []), track.get("lock")
    margin = abs(d0 - d1)
    sure = margin >= confident
    if sure:
        votes.append(label)
        del votes[: -p.vote_window]
        track["last"] = label
    if locked is not None:
        frozen = area > 0 and area > 2 * track["area"]
        against = sure and label != locked and margin >= escape and not frozen
        track["against"] = track.get("against", 0) + 1 if against else 0
        if track["against"] < (20 if crowded else 6):
            return locked
        track["lock"], track["against"] = None, 0
        return majority(track)
    if sure and len(votes) >= lock and len(set(votes[-lock:])) == 1:
        track["lock"] = label
    voted = majority(track)
    if voted >= 0:
        track["last"] = voted
    return voted


def majority(track: dict) -> int:
    votes = track.get("votes")
    return max(Counter(votes).items(), key=lambda kv: (kv[1], -votes.index(kv[0])))[0] if votes else track.get("last", -1)


def crowded(box: list[float], others: list[list[float]], p: Params = P) -> bool:
    """Another centre nearer than the limit; the same centre doesn't count."""
    x, y = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    return any(0 < math.hypot((o[0] + o[2]) / 2 - x, (o[1] + o[3]) / 2 - y) < p.pile_up for o in others)


def step(state: dict, clip_id: str, frame: int, rows: list[dict], p: Params = P) -> list[tuple]:
    """Processes a frame: cut, registration, then each detection; absent tracks lose their box and helmet state, but not their votes."""
    if state["last"] is not None and frame <= state["last"]:
        state["dropped"] += len(rows)
        return []
    state["last"] = frame
    is_cut = cut(state, rows[0].get("mad"), p)
    valid = field(state, bool(rows[0].get("fit_ok")))
    if is_cut:
        for track in state["tracks"].values():
            track.pop("box", None)
    dets = sorted((r for r in rows if r.get("track_id") is not None), key=lambda r: r["track_id"])
    boxes = [[float(r[c]) for c in _BOX] for r in dets]
    kept, out = {}, []
    for r, box in zip(dets, boxes):
        key = str(r["track_id"])
        track = kept[key] = state["tracks"].get(key, {})
        smoothed = smooth(track, box, p)
        ok = helmet(track, r["helmet_hits"] > 0, p)
        label = vote(state["votes"].setdefault(key, {}), int(r["label"]), r["dist0"], r["dist1"], float(r["torso_px"]), crowded(box, boxes, p), margins(10.0), p)
        out.append((clip_id, frame, r["track_id"], *smoothed, ok, label, is_cut, valid, state["dropped"]))
    state["tracks"] = kept
    return out


def frames_of(rows: pd.DataFrame):
    """The rows of each frame in order, as (frame, dictionaries with None for missing values)."""
    rows = rows.sort_values("frame", kind="stable")
    records = rows.astype(object).where(rows.notna(), None).to_dict("records")
    for frame, part in itertools.groupby(records, key=lambda r: r["frame"]):
        yield int(frame), list(part)


def run_rows(state: dict, clip_id: str, rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for frame, part in frames_of(rows):
        out += step(state, clip_id, frame, part)
    return pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])


def in_order(frames: DataFrame, output: str, begin, run) -> DataFrame:
    """run(state, clip, rows) over all frames of each clip in order, some rows at a time: begin() makes a clip's state.

    Spark sorts a clip's rows, so a worker holds a batch of them, the frame that the next batch may go on with, and the state.
    """

    def fold(batches):
        clip, state, rest = object(), None, None
        for rows in itertools.chain(batches, [None]):
            if rows is None:
                rows, rest = rest, None
            else:
                rows = rows.astype({"track_id": "Int64"})  # alike whether a batch has nulls or not
                rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
                key = rows[["clip_id", "frame"]].astype(object).where(rows[["clip_id", "frame"]].notna(), None)
                rest = rows[[k == tuple(key.iloc[-1]) for k in zip(key["clip_id"], key["frame"])]] if len(rows) else None
                rows = rows.iloc[: len(rows) - (0 if rest is None else len(rest))]
            if rows is not None and len(rows):
                for found, part in rows.groupby("clip_id", sort=False, dropna=False):
                    found = None if pd.isna(found) else found
                    if found != clip:
                        clip, state = found, begin()
                    yield run(state, clip, part)

    return frames.repartition("clip_id").sortWithinPartitions("clip_id", "frame", "track_id").mapInPandas(fold, output)


def batch(frames: DataFrame) -> DataFrame:
    """All frames of each clip at once. A clip's state is sequential, so a clip is one task's work, some rows at a time."""
    return in_order(frames, OUTPUT, new_state, run_rows)


CLIP_STATE = "last long, turn long, dropped long, streak int, cooldown int, field int"
TRACK_KEY = "track_id long"
TRACK_STATE = (
    "turn long, box array<double>, hits array<boolean>, seen int, run int, sure boolean, "
    "votes array<int>, label int, locked int, against int, area double"
)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _packed(turn: int, held: dict, votes: dict) -> tuple:
    """A track as a row of TRACK_STATE: what ends with an absence (held) and what follows the track through it (votes)."""
    return (
        turn, held.get("box"), held.get("hits"), held.get("seen"), held.get("run"), held.get("sure"),
        votes.get("votes"), votes.get("last"), votes.get("lock"), votes.get("against"), votes.get("area"),
    )


def _unpacked(row: tuple) -> tuple[int, dict, dict]:
    turn, box, hits, seen, run, sure, votes, label, locked, against, area = row
    held = {"box": None if box is None else list(box), "hits": None if hits is None else [bool(h) for h in hits], "seen": seen, "run": run, "sure": sure}
    kept = {"votes": None if votes is None else [int(v) for v in votes], "last": label, "lock": locked, "against": against, "area": area}
    return turn, {k: v for k, v in held.items() if v is not None}, {k: v for k, v in kept.items() if v is not None}


class ClipProcessor(StatefulProcessor):
    """Typed state of a clip: a value for its frames and a map of its tracks, of which a batch reads and writes those it has.

    A track's row has the turn (the clip's count of frames) at which it was last seen, so box and helmet state of absent
    tracks end without being touched: they count only if that turn is the one before.
    """

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.clip = handle.getValueState("clip", CLIP_STATE, self.keep_ms)
        self.tracks = handle.getMapState("tracks", TRACK_KEY, TRACK_STATE, self.keep_ms)

    def handleInputRows(self, key, rows, timerValues):
        state, turn = new_state(), 0
        if self.clip.exists():
            state["last"], turn, state["dropped"], state["streak"], state["cooldown"], state["field"] = self.clip.get()
        known: dict[int, int] = {}  # tracks of this batch, and the turn at which each was last seen

        def fetch(frame: int, part: list[dict]) -> None:
            for track in {int(r["track_id"]) for r in part if r.get("track_id") is not None} - known.keys():
                known[track] = -1
                if self.tracks.containsKey((track,)):
                    known[track], held, votes = _unpacked(self.tracks.getValue((track,)))
                    state["votes"][str(track)] = votes
                    if known[track] == turn:
                        state["tracks"][str(track)] = held

        out = []
        for frame, part in frames_of(pd.concat(list(rows))):
            late = state["last"] is not None and frame <= state["last"]
            if not late:
                fetch(frame, part)
            out += step(state, key[0], frame, part)
            if not late:
                turn += 1
                known.update((int(r["track_id"]), turn) for r in part if r.get("track_id") is not None)
        for track, seen in known.items():
            held = state["tracks"].get(str(track), {}) if seen == turn else {}
            self.tracks.updateValue((track,), _packed(seen, held, state["votes"].get(str(track), {})))
        self.clip.update((state["last"], turn, state["dropped"], state["streak"], state["cooldown"], state["field"]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def stream(frames: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """The same on a streaming DataFrame, on typed state: with keep_ms, a clip and each of its tracks is kept only so long after its last row.

    State that is a map for each key needs the RocksDB store: spark.sql.streaming.stateStore.providerClass must name it
    before the query starts; the session's settings are not changed here.
    """
    if frames.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    return frames.groupBy("clip_id").transformWithStateInPandas(ClipProcessor(keep_ms), OUTPUT, "append", "processingTime" if keep_ms else "none")
