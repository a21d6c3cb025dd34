"""Best segmentation of a text into pieces as a max-plus scan over chunks.

The state at a chunk boundary is the last piece that begins before it: where it begins and ends. A chunk gives a
matrix: for each state at its left and each state at its right the weight of the best way between them (minus
infinity if there is none). The max-plus product of matrices is associative, so chunks can be summarised anywhere
and combined in any grouping; once the states at its two boundaries are known, each chunk is traced by itself.

For a unigram model the weight of a way is the sum of its pieces' scores. For a BPE model a way is allowed, with
weight zero, if merging any two neighbouring pieces' characters gives back just these two pieces: merges run by
priority, so the first merge across a border of pieces would also be the first across it with these two alone.
The only way that is allowed from one end of a text to the other is therefore the BPE segmentation.
"""

from __future__ import annotations

import numpy as np

SPACE = "▁"
NEVER = -np.inf


class PieceLattice:
    """Pieces with scores, and the ways that lead through a text."""

    def __init__(self, pieces: dict[str, float], kind: str = "unigram"):
        self.pieces, self.kind = pieces, kind
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - 10
        self.joined = {c for p in pieces if len(p) > 1 for c in p}
        self.space_inside = any(SPACE in p.lstrip(SPACE) for p in pieces)
        self._fits: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}

    def merged(self, text: str) -> list[str]:
        """BPE by definition: the neighbours whose join has the highest score merge, the leftmost first."""
        symbols = list(text)
        while len(symbols) > 1:
            best, at = NEVER, -1
            for i in range(len(symbols) - 1):
                score = self.pieces.get(symbols[i] + symbols[i + 1])
                if score is not None and score > best:
                    best, at = score, i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def whole(self, piece: str) -> bool:
        if piece not in self._whole:
            self._whole[piece] = self.kind != "bpe" or self.merged(piece) == [piece]
        return self._whole[piece]

    def fits(self, a: str, b: str) -> bool:
        if self.kind != "bpe" or not a:
            return True
        if (a, b) not in self._fits:
            if len(self._fits) > 50_000:
                self._fits.clear()
            self._fits[a, b] = self.merged(a + b) == [a, b]
        return self._fits[a, b]

    def weight(self, piece: str) -> float:
        return 0.0 if self.kind == "bpe" else self.pieces.get(piece, self.unknown)

    def ends(self, text: str, at: int) -> list[int]:
        """Ends of the pieces that begin here; a character that is no piece is one by itself."""
        out = [e for e in range(at + 1, min(len(text), at + self.longest) + 1) if text[at:e] in self.pieces and self.whole(text[at:e])]
        if text[at] not in self.pieces:
            out.append(at + 1)
        return out

    def is_cut(self, text: str, at: int) -> bool:
        """True if no piece can cover both characters beside this place (some such places are not recognised)."""
        if at <= 0 or at >= len(text):
            return True
        a, b = text[at - 1], text[at]
        return a not in self.joined or b not in self.joined or not self.space_inside and b == SPACE != a

    def states(self, text: str, at: int, first: bool, last: bool) -> list[tuple[int, int]]:
        """Pieces (begin, end) that can be the last to begin before this place."""
        if first:
            return [(0, 0)]
        out = []
        for begin in range(max(0, at - self.longest), at):
            out += [(begin, e) for e in self.ends(text, begin) if e >= at and (not last or e == at)]
        return out

    def ways(self, text: str, entry: tuple[int, int], to: int) -> dict[int, tuple[float, int]]:
        """Best way from the end of entry to each place up to `to` and what reaches beyond: (weight, begin of its last piece)."""
        best = {entry[1]: (0.0, entry[0])}
        for at in range(entry[1], to):
            if at not in best:
                continue
            weight, begin = best[at]
            before = text[begin:at]
            for end in self.ends(text, at):
                piece = text[at:end]
                if self.fits(before, piece):
                    now = weight + self.weight(piece)
                    if end not in best or now > best[end][0]:
                        best[end] = (now, at)
        return best

    def trace(self, text: str, entry: tuple[int, int], exit_: tuple[int, int]) -> list[tuple[int, int]]:
        """Pieces after entry up to and with exit_."""
        if exit_ == entry:
            return []
        ways = self.ways(text, entry, exit_[0])
        out, at = [exit_], exit_[0]
        while at > entry[1]:
            begin = ways[at][1]
            out.append((begin, at))
            at = begin
        if at != entry[1]:
            raise ValueError("no way between these states")
        return out[::-1]

    def through(self, text: str, entry: tuple[int, int], exits: list[tuple[int, int]], to: int) -> list[float]:
        """Weights of the best ways from entry to each of the exits, pieces that begin before `to`."""
        ways = self.ways(text, entry, to)
        out = []
        for begin, end in exits:
            if (begin, end) == entry:
                out.append(0.0)
            elif begin < entry[1] or begin not in ways:
                out.append(NEVER)
            else:
                weight, last = ways[begin]
                ok = self.fits(text[last:begin], text[begin:end])
                out.append(weight + self.weight(text[begin:end]) if ok else NEVER)
        return out


class Chunk:
    """text[left:right] of a longer text, with its surroundings: `text` has at least a piece's length more on both sides."""

    def __init__(self, lattice: PieceLattice, text: str, left: int, right: int, first: bool, last: bool):
        self.lattice, self.text, self.left, self.right = lattice, text, left, right
        self.entries = lattice.states(text, left, first, False) if not first else [(left, left)]
        self.exits = lattice.states(text, right, False, last) if right > left else list(self.entries)
        # Between the first and the last place that no piece crosses all ways are alike: a matrix of rank one.
        a = next((p for p in range(left, right) if lattice.is_cut(text, p)), None)
        b = next((p for p in range(right - 1, left - 1, -1) if lattice.is_cut(text, p)), None)
        self.cuts = None if a is None else (a, b)

    def matrix(self) -> np.ndarray:
        lat, text = self.lattice, self.text
        if self.cuts is None:
            return np.array([lat.through(text, x, self.exits, self.right) for x in self.entries]).reshape(len(self.entries), len(self.exits))
        a, b = self.cuts
        into = []
        for x in self.entries:
            ways = lat.ways(text, x, a)
            into.append(ways[a][0] if a in ways and x[1] <= a else NEVER)
        middle = lat.ways(text, (a, a), b)[b][0] if lat.kind != "bpe" else 0.0
        out = lat.through(text, (b, b), self.exits, self.right)
        return np.array(into)[:, None] + middle + np.array(out)[None, :]

    def pieces(self, entry: int, exit_: int, middle) -> list:
        """What `middle` makes of the text between the cuts, and the pieces before and after as texts."""
        lat, text = self.lattice, self.text
        x, y = self.entries[entry], self.exits[exit_]
        if self.cuts is None:
            return [text[p:e] for p, e in lat.trace(text, x, y)]
        a, b = self.cuts
        ways, head, at = lat.ways(text, x, a), [], a
        while at > x[1]:
            head.append(text[ways[at][1] : at])
            at = ways[at][1]
        between = [middle(text[a:b])] if b > a else []
        return [*head[::-1], *between, *(text[p:e] for p, e in lat.trace(text, (b, b), y))]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    if not a.size or not b.size:
        return np.full((a.shape[0], b.shape[1]), NEVER)
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def resolve(matrices: list[np.ndarray], entry: int, exit_: int | None) -> list[tuple[int, int]]:
    """States (entry, exit) of each of a run of chunks on the best way between the run's own states."""
    vectors = [np.full(matrices[0].shape[0], NEVER)]
    vectors[0][entry] = 0.0
    for m in matrices:
        vectors.append((vectors[-1][:, None] + m).max(axis=0))
    at = int(vectors[-1].argmax()) if exit_ is None else exit_
    if not np.isfinite(vectors[-1][at]):
        raise ValueError("no way through the text")
    states = [at]
    for m, before in zip(reversed(matrices), reversed(vectors[:-1])):
        states.append(int((before + m[:, states[-1]]).argmax()))
    states.reverse()
    return list(zip(states, states[1:]))
