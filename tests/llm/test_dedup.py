import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from trackweave.llm import bitslice, components, linededup, radix, simhash

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def groups(n, links):
    label = list(range(n))
    find = lambda i: i if label[i] == i else find(label[i])
    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_fingerprint(text, size=3):
    words = (text or "").encode().translate(LOWER).split()
    shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def test_bitslice_counts_like_popcount():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 63, (300, 2)).astype(np.uint64)
    words[100:200] = words[:100] ^ (np.uint64(1) << rng.integers(0, 64, (100, 2)).astype(np.uint64))
    left, right = (x.ravel() for x in np.meshgrid(np.arange(300), np.arange(300)))
    distance = np.bitwise_count(words[left] ^ words[right]).sum(axis=1)
    for radius in (0, 1, 2, 36, 63, 128):
        assert bitslice.pairs_within(words, left, right, radius).tolist() == np.flatnonzero(distance <= radius).tolist()
        found = {(i, j) for i, js in bitslice.neighbours(words, words, radius) for j in js}
        assert found == set(zip(right[distance <= radius].tolist(), left[distance <= radius].tolist()))


def test_spanning():
    assert bitslice.spanning(6, np.array([5, 3, 1]), np.array([3, 1, 4])).tolist() == [0, 1, 2, 1, 1, 1]


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(500, 560)] + [(7, 7)]
    links += [(900, i) for i in range(901, 960)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = groups(1000, links)
    assert got == {i: want[i] for a, b in links if a != b for i in (a, b)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [simhash.BLOCK, 3])
def test_near_groups(spark, documents, block):
    rows = documents + [(1000 + i, t[: len(t) // 2] + " zz " + t[len(t) // 2 :]) for i, t in documents[:40]] + [(2000, ""), (2001, None)]
    got = {r.doc_id: r for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
    prints = [brute_fingerprint(t) for _, t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    label = groups(len(rows), links)
    least = {}
    for (i, _), c in zip(rows, label):
        least[c] = min(least.get(c, i), i)
    assert {i: (f"{p:016x}", least[c]) for (i, _), p, c in zip(rows, prints, label)} == {i: (r.fingerprint, r.component_id) for i, r in got.items()}
    assert any(r.component_id != i for i, r in got.items() if i >= 1000)


def jaccard_groups(rows, size=5, threshold=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    links = []
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if (not sets[a] and not sets[b]) or both and both >= threshold * len(sets[a] | sets[b]) - 1e-9:
            links.append((a, b))
    label, least = groups(len(rows), links), {}
    for (i, _), c in zip(rows, label):
        least[c] = min(least.get(c, i), i)
    return {i: least[c] for (i, _), c in zip(rows, label)}


@pytest.mark.parametrize("options", [{}, {"block": 4, "doc_block": 3, "set_block": 500}])
def test_similar_groups(spark, documents, options):
    rng = np.random.default_rng(3)
    rows = list(documents[:120])
    for i, t in documents[:25]:
        for k in range(1, 6):  # copies with more and more words changed: on both sides of the threshold
            w = t.split(" ")
            for at in rng.integers(0, len(w), max(1, len(w) * k // 120)):
                w[at] = f"new{at}"
            rows.append((1000 * k + i, " ".join(w)))
    rows += [(9000, ""), (9001, None), (9002, " ")]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()}
    want = jaccard_groups(rows)
    assert got == want
    assert 10 < sum(i != c for i, c in want.items() if i >= 1000) < 125


def test_short_similar_pairs_are_not_lost(spark):
    rows = []
    for i in range(2000):  # 4 against 5 shingles: at 0.8 just similar, with the widest spread of fingerprints
        text = " ".join(f"w{i}x{j}" for j in range(8))
        rows += [(2 * i, text), (2 * i + 1, text + " more")]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_similar_copies_go(spark, odd):
    kept = simhash.dedup_similar(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [1, 3, 6, 6, 7, 9, 11]
    assert simhash.dedup_similar(odd.limit(0)).count() == 0


def test_near_groups_odd(spark, odd):
    got = sorted(((r.doc_id or 0), r.component_id) for r in simhash.near_groups(odd).collect())
    assert len(got) == 12
    assert {c for i, c in got if i in (3, 4, 5)} == {3} and {c for i, c in got if i in (0, 6)} == {6}
    assert simhash.near_groups(odd.limit(0)).count() == 0


def brute_exact(rows):
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    least, size = {}, Counter(norm)
    for (i, _), t in zip(rows, norm):
        if i is not None:
            least[t] = min(least.get(t, i), i)
    return Counter((i, least.get(t), size[t], i == least.get(t), hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, norm))


@pytest.mark.parametrize("options", [{}, {"first_digit": 1, "widen": 2}])
def test_exact(spark, documents, odd, options):
    rows = documents + [(500 + i, t) for i, t in documents[:30]] + [(800 + i, t + "x") for i, t in documents[:9]] + [(900, documents[0][1][:-1] + "\t")]
    for df, want in ((spark.createDataFrame(rows, "doc_id long, text string"), rows), (odd, [(r.doc_id, r.text) for r in odd.collect()])):
        got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in radix.exact_duplicates(df, **options).collect())
        assert got == brute_exact(want)
    assert radix.exact_duplicates(odd.limit(0)).count() == 0


def brute_lines(rows, min_docs=10, keep="none"):
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: line.strip(strip).encode().translate(LOWER)
    docs = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            docs[k].append(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(docs[key(x)]) < min_docs or keep == "first" and min(docs[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"keep": "first"}, {"table_lines": 0}, {"table_lines": 0, "keep": "first"}, {"batches": 1}, {"batches": 9, "fanout": 2}])
def test_lines(spark, documents, options):
    rows = [*documents, (300, None), (301, ""), (302, "\n\n"), *((400 + i, f" Common LINE\r\n{i}\ncommon line") for i in range(12))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in linededup.dedup_lines(df, **options).collect())
    assert got == brute_lines(rows, keep=options.get("keep", "none"))
    assert sum(r[3] for r in got) > 20


def test_lines_odd(spark, odd):
    got = linededup.dedup_lines(odd, min_docs=2)
    assert got.columns == [*odd.columns, "n_lines", "n_dropped"]
    assert {(r.doc_id, r.text) for r in got.collect()} >= {(3, ""), (6, ""), (7, ""), (None, ""), (5, "  \n\t")}
    assert linededup.dedup_lines(odd.limit(0)).count() == 0


def test_runs_anti_join(spark):
    runs = linededup.LineRuns(spark, buckets=3, fanout=2)
    rows = lambda *hs: spark.createDataFrame([(bytes([h]) * 16, 1, 10 - h) for h in hs], "h binary, n long, first long")
    sizes = []
    for batch in (rows(1, 2), rows(1, 3), rows(1, 2, 4), rows(5, 1), rows(6, 1)):
        runs.add(batch)
        sizes.append([len(level) for level in runs.levels])
    assert sizes == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]]
    assert sorted(r.h[0] for run in runs.runs() for r in run.collect()) == [1, 2, 3, 4, 5, 6]  # no line in two runs
    assert {r.h[0]: r.fresh for r in runs.marked(rows(1, 2, 3, 9)).collect()} == {1: False, 2: False, 3: False, 9: True}
    assert sorted((r.h[0], r["first"]) for r in runs.frequent(2).collect()) == [(1, 9), (2, 8)]
    names = [name for name, _ in runs._tables]
    runs.drop()
    assert not {t.name for t in spark.catalog.listTables()} & set(names)


def test_runs_merge_without_exchange(spark):
    runs = linededup.LineRuns(spark, buckets=3, fanout=9)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for hs in ((1, 2), (2, 3), (4, 5)):
            runs.add(spark.createDataFrame([(bytes([h]) * 16, 1, h) for h in hs], "h binary, n long, first long"))
        plan = runs.frequent(1)._jdf.queryExecution().executedPlan().toString()
        assert "Union" in plan and "Exchange" not in plan
        plan = runs.marked(runs.runs()[0])._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        runs.drop()
