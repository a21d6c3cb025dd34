"""Boxes of a frame or image that are near each other, found by sorting instead of comparing all with all.

A frame's boxes come to one task, as everywhere here; what is compared there are boxes whose corners are near enough for
the overlap asked for, some at a time, so memory goes with the number of boxes and not with its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs compared at once, and boxes whose neighbours are sought at once.
PAIRS, ROWS = 1 << 18, 1 << 10
#: Cells of a grid for each point.
CELLS = 16
_SLACK = 1e-9


class Points:
    """Points sorted by strips of y and then x, which gives those of a rectangle (and some above and below it) as runs."""

    def __init__(self, x: np.ndarray, y: np.ndarray, strip: float):
        self.strip = strip if np.isfinite(strip) and strip > 0 else 1.0
        self.at = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
        self.rows, row = np.unique(np.floor(y[self.at] / self.strip), return_inverse=True)
        self.x, column = np.unique(x[self.at], return_inverse=True)
        key = row * (len(self.x) + 1) + column
        order = np.argsort(key, kind="stable")
        self.at, self.key = self.at[order], key[order]

    def near(self, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray, skip: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (rectangle, point) as blocks of two arrays, a superset of the points in each; a rectangle's are in one block.

        Rectangles come in order. Those marked in `skip` when their turn comes have no pairs; nor have those with NaN.
        """
        if not len(self.at):
            return
        sane = ~(np.isnan(x0) | np.isnan(x1) | np.isnan(y0) | np.isnan(y1))
        first = np.searchsorted(self.rows, np.floor(y0 / self.strip), "left")
        last = np.searchsorted(self.rows, np.floor(y1 / self.strip), "right")
        left, right = np.searchsorted(self.x, x0, "left"), np.searchsorted(self.x, x1, "right")
        height = np.where(sane & (left < right), np.maximum(last - first, 0), 0)
        begin = 0
        while begin < len(x0):
            end = begin + max(1, int(np.searchsorted(np.cumsum(height[begin : begin + ROWS]), PAIRS, "right")))
            who = np.arange(begin, min(end, len(x0)))
            begin = end
            who = who[height[who] > 0]
            if skip is not None:
                who = who[~skip[who]]
            i, of = _runs(first[who], last[who])
            low = np.searchsorted(self.key, of * (len(self.x) + 1) + left[who[i]], "left")
            high = np.searchsorted(self.key, of * (len(self.x) + 1) + right[who[i]], "left")
            upto = np.cumsum(np.bincount(i, weights=high - low, minlength=len(who)))
            a = 0
            while a < len(who):  # rectangles whose points fit together, one at least
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
                some = slice(*np.searchsorted(i, [a, b]))
                which, found = _runs(low[some], high[some])
                keep = np.ones(len(found), bool) if skip is None else ~skip[who[i[some][which]]]
                yield who[i[some][which]][keep], self.at[found][keep]
                a = b


class Cells:
    """Points of layers in square cells of a grid; those around a place of a layer are runs, one for each row of cells.

    The grid has a bounded number of cells a point: where the points are few for their extent, cells are larger.
    """

    def __init__(self, layer: np.ndarray, layers: int, x: np.ndarray, y: np.ndarray, size: float):
        self.at = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
        x, y, layer = x[self.at], y[self.at], layer[self.at]
        self.low = (x.min(), y.min()) if len(x) else (0.0, 0.0)
        self.size, wide, high = float(size) if size > 0 else 1.0, *((float(np.ptp(x)), float(np.ptp(y))) if len(x) else (0.0, 0.0))
        while (wide / self.size + 1) * (high / self.size + 1) * layers > CELLS * len(x) + ROWS:
            self.size *= 2
            if not np.isfinite(self.size):
                break
        self.shape = (int(wide / self.size) + 1, int(high / self.size) + 1) if np.isfinite(self.size) else (1, 1)
        key = (layer * self.shape[1] + self._cells(y, 1)) * self.shape[0] + self._cells(x, 0)
        self.at = self.at[np.argsort(key, kind="stable")]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=layers * self.shape[0] * self.shape[1]))])

    def _cells(self, v: np.ndarray, axis: int, least: int = 0, most: int = 0) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            cell = np.floor((v - self.low[axis]) / self.size) if np.isfinite(self.size) else np.zeros(np.shape(v))
        return np.clip(np.nan_to_num(cell), least, self.shape[axis] - 1 + most).astype(np.int64)

    def near(self, x: np.ndarray, y: np.ndarray, reach: np.ndarray, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (place, point), a superset of the points within reach of a place, as blocks of two arrays; a place's are in one block.

        x, y: a row for each place, a column for each layer, where the place may be elsewhere. A block has `most` pairs at
        most, or those of one place. Places with NaN have none.
        """
        reach = reach[:, None]
        sane = ~(np.isnan(x) | np.isnan(y))
        left, right = self._cells(x - reach, 0, 0, 1), self._cells(x + reach, 0, -1)
        first, last = self._cells(y - reach, 1, 0, 1), self._cells(y + reach, 1, -1)
        height = np.where(sane & (left <= right), np.maximum(last - first + 1, 0), 0)
        for begin, end in _parts(height.sum(1), most):
            rows = height[begin:end].ravel()
            some = np.flatnonzero(rows)
            which, row = _runs(first[begin:end].ravel()[some], last[begin:end].ravel()[some] + 1)
            place, layer = np.divmod(some[which], height.shape[1])
            key = (layer * self.shape[1] + row) * self.shape[0]
            low, high = self.begin[key + left[begin:end].ravel()[some][which]], self.begin[key + right[begin:end].ravel()[some][which] + 1]
            for a, b in _parts(np.bincount(place, weights=high - low, minlength=end - begin), most):
                part = slice(*np.searchsorted(place, [a, b]))
                run, found = _runs(low[part], high[part])
                yield begin + place[part][run], self.at[found]


def _parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs (begin, end) of things that have `most` together at most, or are one."""
    upto, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + most, "right")))
        yield begin, end
        begin = end


def _runs(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, number) of each number of the runs low to high - 1."""
    n = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + low[which]


def overlaps(a: np.ndarray, b: np.ndarray, guarded: bool = False) -> np.ndarray:
    """Overlap of each box of a with the one of b in its place, as functions.scalars.iou has it."""
    w = np.maximum(0.0, np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0]))
    h = np.maximum(0.0, np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1]))
    common = w * h
    union = (a[:, 2] - a[:, 0]) * (a[:, 3] - a[:, 1]) + (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]) - common
    if guarded:
        return common / np.maximum(1.0, union)
    return np.divide(common, union, out=np.zeros_like(common), where=union > 0)


def overlapping(a: np.ndarray, b: np.ndarray, least: float, guarded: bool = False, skip: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, overlap) of the boxes of a and b that overlap by `least` (above 0) or more, in blocks; a box's are in one block.

    Such boxes share `least` of the width and height of either, so b's corner lies in a rectangle around a's. Boxes with
    coordinates that are missing or infinite, and those without an area, overlap nothing.
    """
    if least <= 0:
        raise ValueError("least must be above 0")
    if not len(a) or not len(b):
        return
    a, b = (np.where(np.isfinite(x).all(1, keepdims=True) & (x[:, 2:] > x[:, :2]).all(1, keepdims=True), x, np.nan) for x in (a, b))
    if np.isnan(a[:, 0]).all() or np.isnan(b[:, 0]).all():
        return
    size_a, size_b = a[:, 2:] - a[:, :2], b[:, 2:] - b[:, :2]
    slack = _SLACK * (1 + max(np.nanmax(np.abs(a)), np.nanmax(np.abs(b))))
    part = max(0.0, 1 - least)
    low = a[:, :2] - part * np.minimum(size_a / least, np.nanmax(size_b, 0)) - slack
    high = a[:, :2] + part * size_a + slack
    points = Points(b[:, 0], b[:, 1], max(float(np.nanmedian(size_b[:, 1])) * max(part, 0.05) / 2, 2 * slack))
    for i, j in points.near(low[:, 0], high[:, 0], low[:, 1], high[:, 1], skip):
        close = (b[j, 1] >= low[i, 1]) & (b[j, 1] <= high[i, 1])
        i, j = i[close], j[close]
        score = overlaps(a[i], b[j], guarded)
        hit = score >= least
        yield i[hit], j[hit], score[hit]


def best(a: np.ndarray, b: np.ndarray, least: float, guarded: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each box of a that of b with the greatest overlap (ties: the first), or -1 if none has `least`; and the overlap."""
    at, score = np.full(len(a), -1), np.zeros(len(a))
    for i, j, s in overlapping(a, b, least, guarded):
        order = np.lexsort((j, -s, i))
        i, j, s = i[order], j[order], s[order]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        at[i[first]], score[i[first]] = j[first], s[first]
    return at, score


def of_each(i: np.ndarray, *others: np.ndarray) -> Iterator[tuple]:
    """(i, parts of the others) of each run of the same i."""
    if len(i):
        cuts = [0, *np.flatnonzero(np.diff(i)) + 1, len(i)]
        for low, high in zip(cuts[:-1], cuts[1:]):
            yield (int(i[low]), *(x[low:high] for x in others))
