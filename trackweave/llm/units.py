"""Encoding by units: a text's ids are those of its units, and each distinct unit of a batch is looked up once."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Latin letters below U+0100 by case, and ASCII punctuation without the apostrophe.
LOWER = "".join(c for c in map(chr, range(97, 256)) if c.islower() and c not in "ªµº")
UPPER = "".join(c for c in map(chr, range(65, 223)) if c.isupper())
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
LOWER_CLASS, UPPER_CLASS, MARK_CLASS = r"a-zß-öø-ÿ", r"A-ZÀ-ÖØ-Þ", r"!-&(-/:-@\[-`{-~"
#: Parts whose ids a worker keeps; others are encoded batch by batch.
CACHE_PARTS = 150_000


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of size[0] numbers, then those of the next."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)


def joined(parts, least: int = 2 << 20):
    """Batches put together until they have so many bytes."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += part.nbytes
        if size >= least:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class UnitEncoder:
    """Units of letters and then punctuation are the ids of the two parts, which a bounded table keeps; subclasses
    give the pattern of such units and encode new parts and all other units."""

    kind = "<u2"  # of ids
    pattern: str | None = None
    letters = ""

    def __init__(self, most: int):
        self.most = most
        self.parts: dict[str, bytes] = {}

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        raise NotImplementedError

    def encode_unit(self, unit: str) -> list[int]:
        raise NotImplementedError

    def _known(self, parts: list[str]) -> list[bytes]:
        out = list(map(self.parts.get, parts))
        gaps = [i for i, x in enumerate(out) if x is None]
        todo = [parts[i] for i in gaps]
        found = self.encode_parts(todo) if todo else []
        for i, x in zip(gaps, found):
            out[i] = x
        self.parts.update(islice(zip(todo, found), max(0, self.most - len(self.parts))))
        return out

    def look_up(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct units: where each one's begin and how many they are, in one array of ids."""
        plain = np.zeros(len(units), bool)
        if self.pattern:
            plain = pc.match_substring_regex(units, self.pattern).to_numpy(zero_copy_only=False)
        values, chosen = [b""], np.zeros((2, len(units)), np.int64)  # numbers of values for the two parts of a unit
        others = np.flatnonzero(~plain)
        chosen[0, others] = np.arange(len(others)) + 1
        values += [np.array(self.encode_unit(w), self.kind).tobytes() for w in units.take(pa.array(others)).to_pylist()]
        units = units.filter(pa.array(plain))
        for row, part in enumerate((pc.utf8_rtrim(units, characters=MARKS), pc.utf8_ltrim(units, characters=self.letters or "a"))):
            coded = part.dictionary_encode()
            kinds = coded.dictionary.to_pylist()
            full = [k for k in kinds if k]
            number = np.zeros(len(kinds), np.int64)
            number[[i for i, k in enumerate(kinds) if k]] = np.arange(len(full)) + len(values)
            values += self._known(full)
            chosen[row, plain] = number[coded.indices.to_numpy()]
        flat = np.frombuffer(b"".join(values), self.kind)
        size = np.fromiter(map(len, values), np.int64, len(values)) // flat.itemsize
        start = np.cumsum(size) - size
        n = size[chosen].sum(axis=0)
        return np.cumsum(n) - n, n, flat[spans(start[chosen].T.ravel(), size[chosen].T.ravel())]

    def gather(self, lists: pa.ListArray, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where each list's ids begin (and the last one's end), and the ids; units: those of all lists in order."""
        edges = lists.offsets.to_numpy()
        coded = units.dictionary_encode()
        start, size, flat = self.look_up(coded.dictionary)
        codes = coded.indices.to_numpy()
        n = size[codes]
        return np.r_[0, np.cumsum(n)][edges - edges[0]], flat[spans(start[codes], n)]
