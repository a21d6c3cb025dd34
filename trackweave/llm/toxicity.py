"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

Terms are words and the beginnings of words, so that inflected and compound forms of a word meet. The space is spanned
by the terms that toxic examples use more often than chance would have it, by the likelihood-ratio statistic over the
labelled examples; their document frequencies are those of the whole corpus. The index holds the examples in blocks, and for each
term and block the largest weight; a block whose bound lies below the k-th best similarity found so far is skipped,
which loses nothing. Neighbours vote with their similarity; the votes of the examples among themselves, each without
itself, give the calibration (isotonic). The neighbours are the evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_AZ, limit_batches, materialize, text_bytes, trimmed

#: Labelled rows that a fit takes at most, chosen by a hash of their ids.
FIT_ROWS = 12_000
#: Neighbours that vote, examples of a block, likelihood ratio from which a term counts (chance: about 1 in 8,000,000).
NEIGHBOURS, BLOCK, LEAST_RATIO = 15, 128, 28.0
#: Characters of the beginnings that are terms too, and words whose terms a worker remembers at most.
BEGINNINGS, KNOWN_WORDS = range(3, 9), 500_000
#: Scores of vectors that a task remembers at most.
KNOWN_VECTORS = 20_000
#: Weight of the vote that the share of toxic examples has beside the neighbours.
PRIOR_WEIGHT = 2.0
EVIDENCE = "id string, label int, similarity double"
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and characters from U+0080 on, A-Z lower-cased."""
    return _TERM.findall(text.translate(LOWER_AZ))


def terms_of(word: bytes) -> list[str]:
    """The word, and its proper beginnings, which a star marks."""
    word = word.decode("utf-8", "replace")
    return [word, *(word[:n] + "*" for n in BEGINNINGS if n < len(word))]


def held_out(id_column: str) -> F.Column:
    """Rows whose crc32 of the id as text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 5 == 0, F.lit(False))


def _listed(parts):
    """(id, label, text) to a row for each distinct term: id, label, term."""
    for part in parts:
        ids, labels, words = [], [], []
        for i, y, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), text_bytes(part.column(2))):
            found = sorted({t for w in set(words_of(text)) for t in terms_of(w)})
            ids += [i] * len(found)
            labels += [y] * len(found)
            words += found
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(labels, pa.int32()), pa.array(words, pa.string())], names=["id", "label", "term"])


def _entropy(*counts):
    total = sum(counts)
    return sum(F.when(c > 0, c * F.log(c / total)).otherwise(0.0) for c in counts)


def telling_terms(examples: DataFrame, least: float = LEAST_RATIO) -> list[str]:
    """The terms of examples (id, label, text) that label 1 has more often than by chance, in order of their bytes.

    What comes to the driver is bounded by the examples: a statistic over n of them reaches `least` for at most all
    their terms, and chance gives one in 8,000,000.
    """
    sizes = dict(examples.groupBy("label").count().collect())
    n1, n0 = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    if not n1 or not n0:
        return []
    listed = examples.mapInArrow(trimmed(_listed), "id string, label int, term string")
    counts = listed.groupBy("term").agg(F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b"))
    a, b = F.col("a"), F.col("b")
    with_term, without = _entropy(a, b), _entropy(n1 - a, n0 - b)
    ratio = 2 * (with_term + without - F.lit(n1 * math.log(n1 / (n1 + n0)) + n0 * math.log(n0 / (n1 + n0))))
    return sorted(r.term for r in counts.filter((ratio >= least) & (a * (n1 + n0) > (a + b) * n1)).select("term").collect())


def _counted(terms: list[str]):
    """Rows whose last column is a text to the rows with, instead of it, what term_vectors() says."""
    number = {t: i for i, t in enumerate(terms)}

    def run(parts):
        known: dict[bytes, list[int]] = {}
        for part in parts:
            at, ids, times = [0], [], []
            for text in text_bytes(part.column(part.num_columns - 1)):
                words = Counter(words_of(text))
                found: Counter = Counter()
                for word in words:
                    mine = known.get(word)
                    if mine is None:
                        mine = known[word] = [number[t] for t in terms_of(word) if t in number]
                    for i in mine:
                        found[i] += words[word]
                for i in sorted(found):
                    ids.append(i)
                    times.append(found[i])
                at.append(len(ids))
                if len(known) > KNOWN_WORDS:
                    known.clear()
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (ids, times)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *lists], names=[*part.schema.names[:-1], "__tw_terms", "__tw_times"])

    return run


def term_vectors(rows: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """rows without the column `text`, with __tw_terms and __tw_times."""
    others = [c for c in rows.columns if c != text]
    kind = rows.select(*[F.col(f"`{c}`") for c in others]).schema.add("__tw_terms", T.ArrayType(T.IntegerType())).add("__tw_times", T.ArrayType(T.IntegerType()))
    limit_batches(rows.sparkSession)
    return rows.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`")).mapInArrow(trimmed(_counted(terms)), kind)


class BlockMaxIndex:
    """Unit vectors of examples as postings by term, with the largest weight of each term in each block of vectors.

    Examples with equal vectors share an entry, so that copies neither fill blocks nor tie with each other; examples
    without a term have none.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK):
        self.block = block
        same: dict[tuple[bytes, bytes], list[int]] = {}
        for i, (t, w) in enumerate(vectors):
            if len(t):
                same.setdefault((t.tobytes(), w.tobytes()), []).append(i)
        # Vectors with the same heaviest term stand together, so that a block has few terms and low bounds for others.
        heavy = lambda m: (int((v := vectors[m[0]])[0][np.argmax(v[1])]), -float(v[1].max()), m[0])
        self.members = sorted(same.values(), key=heavy)
        entries = [vectors[m[0]] for m in self.members]
        self.blocks = max(1, -(-len(entries) // block))
        self.most = np.zeros((n_terms, self.blocks), np.float64)
        terms = np.concatenate([t for t, _ in entries] or [np.zeros(0, np.int64)]).astype(np.int64)
        weights = np.concatenate([w for _, w in entries] or [np.zeros(0)])
        owner = np.repeat(np.arange(len(entries)), [len(t) for t, _ in entries])
        by = np.lexsort([owner, terms])
        self.owner, self.weight, terms = owner[by], weights[by], terms[by]
        np.maximum.at(self.most, (terms, self.owner // block), self.weight)
        self.begin = np.searchsorted(terms * self.blocks + self.owner // block, np.arange(n_terms * self.blocks + 1))

    def _block(self, b: int, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Similarities of the entries of a block."""
        cells = terms * self.blocks + b
        first = self.begin[cells]
        sizes = self.begin[cells + 1] - first
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(first - ends + sizes, sizes)
        return np.bincount(self.owner[at] - b * self.block, self.weight[at] * np.repeat(weights, sizes), minlength=self.block)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> list[tuple[float, int]]:
        """The k examples of greatest similarity above zero (ties: lower number), without example `skip`."""
        if not len(terms):
            return []
        bounds = weights @ self.most[terms]
        found: list[tuple[float, int]] = []
        for b in np.argsort(-bounds, kind="stable").tolist():
            least = -found[-1][0] - 1e-9 if len(found) == k else 1e-12  # the bound is a sum in another order
            if bounds[b] < least:
                break
            sums = self._block(b, terms, weights)
            for j in np.flatnonzero(sums >= least).tolist():
                similar = -round(float(sums[j]), 12)
                found += [(similar, i) for i in self.members[b * self.block + j][: k + 1] if i != skip]
            found = sorted(found)[:k]
        return [(-s, i) for s, i in found]


class ToxicityModel:
    """Terms with their weights, the index of the examples, and the calibration of votes."""

    def __init__(self, terms: list[str], idf: np.ndarray, examples: list[tuple], k: int = NEIGHBOURS):
        """examples: (id, label, term numbers, counts), in order of their ids."""
        self.terms, self.idf, self.k = terms, idf, k
        self.ids, self.labels = [e[0] for e in examples], np.array([e[1] for e in examples], np.int64)
        self.prior = (self.labels.sum() + 0.5) / (len(examples) + 1)
        vectors = [self.vector(np.array(e[2], np.int64), np.array(e[3], np.float64)) for e in examples]
        self.index = BlockMaxIndex(vectors, len(terms))
        votes = np.array([self.vote(self.index.search(t, w, k, skip=i)) for i, (t, w) in enumerate(vectors)])
        self.knots, self.rates = isotonic(votes, self.labels, self.prior)

    def vector(self, terms: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weights = (1 + np.log(times)) * self.idf[terms] if len(terms) else np.zeros(0)
        return terms, weights / np.sqrt((weights**2).sum()) if len(terms) else weights

    def vote(self, found: list[tuple[float, int]]) -> float:
        """Share of label 1 among the neighbours, by similarity (one less the distance), with the prior's vote."""
        total = sum(s for s, _ in found)
        return (sum(s * self.labels[i] for s, i in found) + PRIOR_WEIGHT * self.prior) / (total + PRIOR_WEIGHT)

    def score(self, terms: np.ndarray, times: np.ndarray) -> tuple[float, list[tuple[float, int]]]:
        found = self.index.search(*self.vector(terms, times), self.k)
        vote = self.vote(found) if len(self.labels) else self.prior
        rate = float(np.interp(vote, self.knots, self.rates)) if len(self.knots) else self.prior
        return min(1.0, max(0.0, 0.999 * rate + 0.001 * vote)), found  # the vote itself tells equal rates apart


def isotonic(votes: np.ndarray, labels: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Pools of votes with rising rates of label 1, each smoothed by one example at the prior: (votes, rates) to interpolate."""
    pools: list[list[float]] = []  # examples, ones, sum of votes
    values, at = np.unique(votes, return_inverse=True)
    for v, n, ones in zip(values, np.bincount(at, minlength=len(values)), np.bincount(at, labels, len(values))):
        pools.append([float(n), float(ones), float(v * n)])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n, ones, total = pools.pop()
            pools[-1] = [pools[-1][0] + n, pools[-1][1] + ones, pools[-1][2] + total]
    rates = np.array([(ones + prior) / (n + 1) for n, ones, _ in pools])
    return np.array([t / n for n, _, t in pools]), np.maximum.accumulate(rates) if len(rates) else rates


def choose_examples(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS
) -> DataFrame:
    """(id, label, text) of at most fit_rows labelled documents that aren't held out, chosen by a hash of the id.

    Labels that are null or not 0 or 1, or whose id is null, are left out; an id with several labels counts as the largest
    of them; of documents that repeat an id the least text counts, null as empty, so an id gives one row.
    """
    chosen = (
        labels.select(F.col(id_col).alias("l"), F.col(label_col).cast("int").alias("label"))
        .filter("l IS NOT NULL AND label IN (0, 1)").filter(~held_out("l"))
        .groupBy("l").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64(F.col("l").cast("string"), F.lit(29)), "l").limit(fit_rows)
    )
    rows = docs.select(F.col(id_col).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("d") == F.col("l"))
    return rows.groupBy(F.col("d").cast("string").alias("id"), "label").agg(F.min("text").alias("text"))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS
) -> tuple[ToxicityModel, DataFrame]:
    """The model, and the term vectors of all documents (id as text, __tw_terms, __tw_times), a table.

    Document frequencies are counted over all documents. Without labels of both kinds no term tells, and every document
    has the prior (a half without labels) as its score.
    """
    examples = materialize(choose_examples(docs, labels, id_col, text_col, label_col, fit_rows), "toxic-examples")
    terms = telling_terms(examples)
    rows = docs.select(F.col(id_col).alias("__tw_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__tw_text"))
    vectors = materialize(term_vectors(rows, "__tw_text", terms), "toxic-vectors")
    n = vectors.count()
    found = dict(vectors.select(F.explode("__tw_terms").alias("t")).groupBy("t").count().collect())  # a row a term
    idf = np.array([math.log((1 + n) / (1 + found.get(i, 0))) + 1 for i in range(len(terms))])
    own = term_vectors(examples, "text", terms).orderBy("id").collect()  # at most fit_rows
    model = ToxicityModel(terms, idf, [(r.id, r.label, r["__tw_terms"], r["__tw_times"]) for r in own])
    return model, vectors


def _scored(model, evidence: int):
    def run(parts):
        known, seen = model.value, {}
        for part in parts:
            lists = [part.column(part.num_columns - 2), part.column(part.num_columns - 1)]
            scores, near = [], []
            for terms, times in zip(*(x.to_pylist() for x in lists)):
                key = (tuple(terms), tuple(times))
                if key not in seen:
                    seen[key] = known.score(np.array(terms, np.int64), np.array(times, np.float64))
                score, found = seen[key]
                if len(seen) > KNOWN_VECTORS:
                    seen.clear()
                scores.append(score)
                near.append([{"id": known.ids[i], "label": int(known.labels[i]), "similarity": s} for s, i in found[:evidence]])
            kind = pa.list_(pa.struct([("id", pa.string()), ("label", pa.int32()), ("similarity", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(scores, pa.float64()), pa.array(near, kind)], names=[*part.schema.names[:-2], "score", "evidence"])

    return run


def score_vectors(vectors: DataFrame, model: ToxicityModel, threshold: float = 0.5, evidence: int = 3) -> DataFrame:
    """vectors with, instead of their terms, score, evidence (nearest examples: id, label, similarity) and predicted."""
    others = [c for c in vectors.columns if not c.startswith("__tw_t")]
    kind = vectors.select(*others).schema.add("score", "double").add("evidence", T.ArrayType(T.StructType.fromDDL(EVIDENCE)))
    limit_batches(vectors.sparkSession)
    sent = vectors.sparkSession.sparkContext.broadcast(model)  # bounded by FIT_ROWS
    rows = vectors.select(*others, "__tw_terms", "__tw_times").mapInArrow(trimmed(_scored(sent, evidence)), kind)
    return rows.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5, evidence: int = 3) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier), evidence and predicted (1 if score >= threshold).

    Whole texts count. Null and empty texts, and texts without a telling term, have no neighbour and get the rate of such
    examples. Columns of those three names are replaced, all others come back as they were; repeated rows get equal
    scores. An empty table gives an empty table.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "evidence", "predicted") and not c.startswith("__tw_")]
    return score_vectors(term_vectors(docs.select(*others, F.col(f"`{text_col}`").alias("__tw_text")), "__tw_text", model.terms), model, threshold, evidence)
