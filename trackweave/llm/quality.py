"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow regression trees, boosted on the logistic loss, propose rules: each path from a root is a conjunction of
thresholds on statistics of the text. A lasso-penalised logistic fit over the rules leaves a few weights, which
are compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import limit_batches, text_bytes, trimmed

#: Labelled rows that a fit takes at most, chosen by a hash of their ids.
FIT_ROWS = 8000
STATISTICS = (
    "n_bytes", "n_words", "n_lines", "word_bytes", "upper", "digit", "space", "symbol", "bang", "bar", "stop", "comma",
    "high", "distinct_words", "same_word_next", "distinct_lines", "top_word", "words_end_symbol",
)
_SYMBOLS = b"#$%&*@^~<>=+_{}[]\\/"


def statistics(text: bytes) -> list[float]:
    """The statistics of one text, in the order of STATISTICS; an empty text has zeros and ones as shares of distinct."""
    n = len(text)
    if not n:
        return [0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0]
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), text.split(b"\n")
    m = max(1, len(words))
    counts = Counter(words)
    letters = max(1, int(c[65:91].sum() + c[97:123].sum()))
    return [
        float(n),
        float(len(words)),
        float(len(lines)),
        (n - int(c[9:14].sum() + c[32])) / m,
        int(c[65:91].sum()) / letters,
        int(c[48:58].sum()) / n,
        int(c[9:14].sum() + c[32]) / n,
        int(c[list(_SYMBOLS)].sum()) / n,
        int(c[33]) / n,
        int(c[124]) / n,
        int(c[46]) / n,
        int(c[44]) / n,
        int(c[128:].sum()) / n,
        len(counts) / m,
        sum(map(eq, words, islice(words, 1, None))) / m,
        len(set(lines)) / len(lines),
        max(counts.values(), default=0) / m,
        sum(w[-1] in _SYMBOLS for w in words) / m,
    ]


def _statistics(names, text_at):
    def run(parts):
        for part in parts:
            rows = np.array([statistics(t) for t in text_bytes(part.column(text_at))], np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(rows), pa.list_(pa.float64()))], names=names)

    return run


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the column __tw_stats: the statistics as an array."""
    limit_batches(docs.sparkSession)
    schema = docs.select("*").schema.add("__tw_stats", T.ArrayType(T.DoubleType()))
    return docs.mapInArrow(trimmed(_statistics(schema.names, docs.columns.index(text_col))), schema)


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    q = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
    q = np.r_[q, np.quantile(x, [0.005, 0.995], method="lower")]
    return np.unique(q)


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, bins: int = 24, rate: float = 0.3, leaf: int = 8):
    """Paths of boosted trees as rules: tuples of (statistic, threshold, above), sorted and distinct."""
    n, k = x.shape
    cuts = [_cuts(x[:, j], bins) for j in range(k)]
    binned = [np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]
    score = np.full(n, math.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    rules = set()
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p) + 1e-6
        nodes = [(np.arange(n), ())]
        for _ in range(depth):
            grown = []
            for rows, path in nodes:
                best = (1e-9, None)
                gs, hs = g[rows].sum(), h[rows].sum()
                for j in range(k):
                    if not len(cuts[j]):
                        continue
                    size = len(cuts[j]) + 1
                    b = binned[j][rows]
                    gl = np.cumsum(np.bincount(b, g[rows], size))[:-1]
                    hl = np.cumsum(np.bincount(b, h[rows], size))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=size))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(nl < leaf) | (len(rows) - nl < leaf)] = -1
                    at = int(gain.argmax())
                    if gain[at] > best[0]:
                        best = (gain[at], (j, at))
                if best[1] is None:
                    score[rows] += rate * gs / (hs + 1)
                    continue
                j, at = best[1]
                low = binned[j][rows] <= at
                for side, above in ((rows[low], False), (rows[~low], True)):
                    new = (*path, (j, float(cuts[j][at]), above))
                    rules.add(tuple(sorted(set(new))))
                    grown.append((side, new))
            nodes = grown
        for rows, _ in nodes:
            score[rows] += rate * g[rows].sum() / (h[rows].sum() + 1)
    return sorted(rules, key=lambda r: (len(r), r))


def holds(rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, cut, above in rule:
        out &= (x[:, j] > cut) if above else (x[:, j] <= cut)
    return out


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise the mean logistic loss plus penalty times the weights' absolute sum (FISTA)."""
    n, k = a.shape
    v = np.ones(k) / math.sqrt(max(1, k))
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= max(1e-12, np.linalg.norm(v))
    step = 4 * n / (np.linalg.norm(a @ v) ** 2 + n)
    w, b = np.zeros(k), math.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    zw, zb, t = w, b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(a @ zw + zb))) - y
        nw = zw - step * (a.T @ r) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = zb - step * r.mean()
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        zw, zb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return b, w


class RuleModel:
    """Weighted rules; column() is the score as a Spark expression over __tw_stats."""

    def __init__(self, intercept: float, rules: list[tuple[tuple, float]]):
        self.intercept, self.rules = intercept, rules

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 0.0005) -> RuleModel:
        """Rows without labels, or labels of one kind, give a constant score (the smoothed share of label 1)."""
        n, ones = len(y), float(y.sum()) if len(y) else 0.0
        prior = math.log((ones + 0.5) / (n - ones + 0.5))
        if n < 20 or ones in (0.0, float(n)):
            return cls(prior, [])
        rules, columns, seen = [], [], set()
        for rule in grow_rules(x, y):
            on = holds(rule, x)
            key = np.packbits(on).tobytes()
            if 0 < on.sum() < n and key not in seen:
                seen.add(key)
                rules.append(rule)
                columns.append(on)
        if not rules:
            return cls(prior, [])
        b, w = lasso_logistic(np.array(columns, np.float64).T, y, penalty)
        return cls(float(b), [(r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-6])

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            z += weight * holds(rule, x)
        return 1 / (1 + np.exp(-z))

    def column(self, stats: str = "__tw_stats") -> F.Column:
        parts = [repr(self.intercept) + "D"]
        for rule, weight in self.rules:
            test = " AND ".join(f"{stats}[{j}] {'>' if above else '<='} {cut!r}D" for j, cut, above in rule)
            parts.append(f"IF({test}, {weight!r}D, 0D)")
        return 1 / (1 + F.exp(-F.expr(" + ".join(parts))))


def held_out(id_column) -> F.Column:
    """Rows whose crc32 of the id as text leaves 2 on division by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS
) -> RuleModel:
    """Fits on at most fit_rows labelled rows of docs that aren't held out, chosen by a hash of the id.

    Labels that are null or not 0 or 1, or whose id is null, are left out; an id with several labels counts as the
    largest of them; a repeated document counts each time, within fit_rows, which bounds the rows and not only the ids.
    """
    by_hash = lambda c: F.xxhash64(F.col(c).cast("string"), F.lit(17))
    chosen = (
        labels.select(F.col(id_col).alias("__tw_l"), F.col(label_col).cast("int").alias("__tw_y"))
        .filter("__tw_l IS NOT NULL AND __tw_y IN (0, 1)")
        .filter(~held_out("__tw_l"))
        .groupBy("__tw_l")
        .agg(F.max("__tw_y").alias("__tw_y"))
        .orderBy(by_hash("__tw_l"), "__tw_l")
        .limit(fit_rows)
    )
    rows = docs.select(F.col(id_col).alias("__tw_d"), F.col(text_col).alias("__tw_text")).join(
        F.broadcast(chosen), F.col("__tw_d") == F.col("__tw_l")
    )
    rows = with_statistics(rows.select("__tw_d", "__tw_y", "__tw_text"), "__tw_text").select("__tw_d", "__tw_y", "__tw_stats")
    got = rows.orderBy(by_hash("__tw_d"), "__tw_d", "__tw_stats").limit(fit_rows).toArrow()
    x = got.column("__tw_stats").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
    y = got.column("__tw_y").to_numpy().astype(np.float64)
    order = np.lexsort([*x.T[::-1], y])  # the rows come in any order
    return RuleModel.fit(x[order], y[order])


def score_quality(
    docs: DataFrame, model: RuleModel, text_col: str = "text", threshold: float = 0.7, score_col: str = "score", predicted_col: str = "predicted"
) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold).

    Null and empty texts are scored like any other, from their statistics. Columns of those two names are
    replaced; all others come back as they were. An empty table gives an empty table.
    """
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (score_col, predicted_col, "__tw_stats")])
    scored = with_statistics(rows, text_col).withColumn(score_col, model.column())
    return scored.withColumn(predicted_col, F.when(F.col(score_col) >= threshold, 1).otherwise(0)).drop("__tw_stats")


def keep_good(docs: DataFrame, model: RuleModel, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs that the model accepts, with all their columns, whatever their names."""
    scored = score_quality(docs, model, text_col, threshold, "__tw_score", "__tw_predicted")
    return scored.filter("__tw_predicted = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
