"""Bit-sliced Hamming comparison: bit planes stored vertically, 64 distances counted in each machine word."""

from __future__ import annotations

import numpy as np

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def planes_of(words: np.ndarray) -> np.ndarray:
    """(n, k) uint64 fingerprints to (64 k, ceil(n / 64)) planes; lane i of a plane is bit i % 64 of word i // 64."""
    n, k = words.shape
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(n, 8 * k), axis=1, bitorder="little")
    rows = -(-n // 64) * 64
    wide = np.zeros((64 * k, rows), np.uint8)
    wide[:, :n] = bits.T
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def near(planes, radius: int, check_every: int = 16) -> np.ndarray:
    """Lanes (as words) with at most radius set bits over the planes, an iterable of equal uint64 arrays.

    Pairs of planes go through a carry-save adder into vertical counters; lanes over the radius are marked as
    counting goes on, and once every lane of the block is over it the block is abandoned.
    """
    planes = list(planes)
    depth = max(1, len(planes)).bit_length()
    counters = [np.zeros_like(planes[0]) for _ in range(depth)]
    over = np.zeros_like(planes[0])
    for i in range(0, len(planes), 2):
        x = planes[i]
        y = planes[i + 1] if i + 1 < len(planes) else np.zeros_like(x)
        half = counters[0] ^ x
        carry = (counters[0] & x) | (half & y)
        counters[0] = half ^ y
        for level in range(1, depth):
            counters[level], carry = counters[level] ^ carry, counters[level] & carry
        if (i + 2) % check_every == 0 or i + 2 >= len(planes):
            over = _greater(counters, radius)
            if (over == ONES).all():
                break
    return ~over


def _greater(counters: list[np.ndarray], value: int) -> np.ndarray:
    greater, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ONES)
    for level in range(len(counters) - 1, -1, -1):
        if value >> level & 1:
            equal = equal & counters[level]
        else:
            greater = greater | (equal & counters[level])
            equal = equal & ~counters[level]
    if value >> len(counters):
        greater[:] = 0
    return greater


def lanes(words: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the set lanes among the first n."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")[:n])


def pairs_within(words: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int, block: int = 1 << 16) -> np.ndarray:
    """Which of the pairs (left[i], right[i]) are at most radius bits apart; a lane stands for a pair."""
    out = []
    for at in range(0, len(left), block):
        diff = words[left[at : at + block]] ^ words[right[at : at + block]]
        out.append(at + lanes(near(planes_of(diff), radius), len(diff)))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def neighbours(words: np.ndarray, others: np.ndarray, radius: int, queries: int = 64):
    """Yields (i, js): of each row i of words, the rows js of others within the radius; a lane stands for a row."""
    planes = planes_of(others)
    n = len(others)
    for at in range(0, len(words), queries):
        bits = np.unpackbits(np.ascontiguousarray(words[at : at + queries]).view(np.uint8), axis=None, bitorder="little")
        flip = np.where(bits.reshape(-1, planes.shape[0]).astype(bool), ONES, np.uint64(0))
        found = near([planes[p][None, :] ^ flip[:, p][:, None] for p in range(planes.shape[0])], radius)
        for i in np.flatnonzero(found.any(axis=1)):
            yield at + int(i), lanes(np.ascontiguousarray(found[i]), n)


def spanning(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest number that each of n items reaches over the links."""
    label = np.arange(n)
    while len(left):
        least = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], least)
        np.minimum.at(label, label[right], least)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label == before).all():
            break
    return label
