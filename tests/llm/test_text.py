import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from trackweave import tables
from trackweave.llm import decontaminate, htmltext, licences, maxplus, quality, queries, sentencepiece_scan, tokenids, warc

PIECES, WORDS = queries.vocabulary(queries.PIECES), queries.vocabulary(queries.WORDS)


@pytest.mark.parametrize("options", [{}, {"giant_chars": 200, "chunk_chars": 40, "fan": 3}])
def test_sentencepiece(spark, documents, odd, options):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = documents[:80] + [(1000, "a" * 700), (1001, " \n ".join(["日本é"] * 200)), (1002, "x" * 300 + " " * 300 + "\n" * 9 + "thethethe" * 70)]
    rows += [(r.doc_id, r.text) for r in odd.collect()]
    got = sentencepiece_scan.encode(spark.createDataFrame(rows, "doc_id long, text string"), PIECES, **options)
    want = {(i, t): sp.encode(t or "") for i, t in rows}
    back = sentencepiece_scan.decode(got, PIECES).collect()
    assert len(back) == len(rows)
    for r in back:
        assert r.ids == want[r.doc_id, r.text]
        assert r.decoded == (r.text or "").replace("▁", " ")
    assert sentencepiece_scan.encode(odd.limit(0), PIECES, **options).count() == 0
    assert sentencepiece_scan.encode(odd, PIECES, **options).columns == [*odd.columns, "ids"]


def test_maxplus_unigram_matches_viterbi():
    rng = np.random.default_rng(5)
    pieces = {c: -float(rng.uniform(3, 5)) for c in "abc"} | {
        "".join(rng.choice(list("abc"), int(rng.integers(2, 5)))): -float(rng.uniform(1, 6)) for _ in range(25)
    }
    lattice = maxplus.PieceLattice(pieces)
    for size in (10, 13):
        text = "".join(rng.choice(list("abcx"), 120))
        best = [0.0] + [-np.inf] * len(text)
        for at in range(len(text)):
            for end in range(at + 1, min(len(text), at + 4) + 1):
                w = pieces.get(text[at:end], lattice.unknown if end == at + 1 else -np.inf)
                best[end] = max(best[end], best[at] + w)
        n = len(text) // size
        chunks = []
        for i in range(n):
            a, b = i * size, len(text) if i == n - 1 else (i + 1) * size
            lo, hi = max(0, a - lattice.longest), min(len(text), b + lattice.longest)
            chunks.append(maxplus.Chunk(lattice, text[lo:hi], a - lo, b - lo, i == 0, i == n - 1))
        matrices = [c.matrix() for c in chunks]
        left = maxplus.product(maxplus.product(matrices[0], matrices[1]), matrices[2])
        right = maxplus.product(matrices[0], maxplus.product(matrices[1], matrices[2]))
        assert np.allclose(left, right)
        whole = matrices[0]
        for m in matrices[1:]:
            whole = maxplus.product(whole, m)
        assert whole.max() == pytest.approx(best[-1])

        def middle(part):
            ways, at, out = lattice.ways(part, (0, 0), len(part)), len(part), []
            while at:
                out.append(part[ways[at][1] : at])
                at = ways[at][1]
            return out[::-1]

        found = []
        for c, (x, y) in zip(chunks, maxplus.resolve(matrices, 0, None)):
            for p in c.pieces(x, y, middle):
                found += p if isinstance(p, list) else [p]
        assert "".join(found) == text
        assert sum(map(lattice.weight, found)) == pytest.approx(best[-1])


def test_token_ids(spark, documents, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    rows = [*documents, (700, None), (701, "A<|endoftext|>b  DON'T Ⅻ ́x　y")]
    for encoding in ("dictionary", "delta"):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        path = tokenids.write_token_ids(df, WORDS, 2, encoding=encoding)
        got = sorted(tuple(r) for r in tokenids.token_digests(spark, path).collect())
        start, want = 0, []
        for i, t in sorted(rows, key=lambda r: r[0]):
            ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert got == want
        assert [r.ids for r in tokenids.read_token_ids(spark, path).filter("doc_id = 700").collect()] == [[2]]
    assert tokenids.token_digests(spark, tokenids.write_token_ids(odd, WORDS, 2)).count() == 12
    assert tokenids.token_digests(spark, tokenids.write_token_ids(odd.limit(0), WORDS, 2)).count() == 0


def test_every_code_point_matches_the_library():
    import unicodedata

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    chars = [c for c in map(chr, range(0x3000)) if unicodedata.category(c) not in ("Cn", "Cs")]
    texts = [t for c in chars for t in (c, f"a{c}b", f"{c}stanbul", f"x{c}, {c}!")] + ["İ", "İstanbul K Å ẞ", "ÀÖØÞß ŸÿĲ ÉÉ"]
    for at in range(0, len(texts), 5000):
        part = texts[at : at + 5000]
        edges, ids = tokenids.encoder(WORDS).encode(pa.array(part))
        want = [x.ids for x in tok.encode_batch(part, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == want


def test_every_letter_with_every_mark_matches_the_library():
    """Marks that compose with one case of a letter only: alone and inside words, both cases, and random texts."""
    import random
    import unicodedata

    from tokenizers import Tokenizer

    tok, rng = Tokenizer.from_file(WORDS), random.Random(4)
    letters = [c for c in map(chr, range(0x370)) if unicodedata.category(c)[0] == "L"]
    marks = [c for c in map(chr, range(0x370)) if unicodedata.category(c) == "Mn"]
    texts = [" ".join(w for m in marks for w in (c + m, f"ab{c}{m}cd", f"AB{c}{m}CD,")) for c in letters]
    some = [*"TtHhWwYyJjAa\u0130\u0131 .,'1", *"\u0308\u0331\u030a\u030c\u0307\u0323", "\u212b", "\u2126", "\n"]
    texts += ["".join(rng.choices(some, k=rng.randrange(1, 12))) for _ in range(100_000)]
    for at in range(0, len(texts), 5000):
        part = texts[at : at + 5000]
        edges, ids = tokenids.encoder(WORDS).encode(pa.array(part))
        want = [x.ids for x in tok.encode_batch_fast(part, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == want


def test_word_cache_bound():
    small, large = tokenids.WordEncoder(WORDS, 3), tokenids.WordEncoder(WORDS)
    texts = pa.array(["one two three four É'a Ÿ%%% ﬁ İ", "two five six ONE", "", None, " one\t", "a<|endoftext|>B"])
    for column in (texts, texts.slice(1, 4)):
        first, again, other = small.encode(column), small.encode(column), large.encode(column)
        assert all(np.array_equal(x, y) and np.array_equal(x, z) for x, y, z in zip(first, again, other))
    assert len(small.parts) <= 3


def brute_leaks(rows, items, size=5, threshold=0.8):
    out = {}
    for i, t in rows:
        w, found = decontaminate.words_of(t), []
        for item, text in items:
            v = decontaminate.words_of(text)
            if not v or item is None:
                continue
            k = min(size, len(v))
            runs = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}
            have = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
            if len(runs & have) / len(runs) >= threshold - 1e-12:
                found.append((item, len(runs & have) / len(runs)))
        out[i] = (sorted(x for x, _ in found), max((c for _, c in found), default=0.0))
    return out


@pytest.mark.parametrize("options", [{}, {"item_bytes": 4000}, {"threshold": 0.5}, {"threshold": 1.0}])
def test_leaks(spark, sf, documents, options):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()] + [(900, "Only two"), (901, ""), (902, None), (None, documents[0][1])]
    rows = [*documents, (600, "here ONLY** two!"), (601, None), (602, ""), (603, "x " * 50_000 + items[0][1].upper() + " y" * 50_000)]
    w = items[1][1].split()
    rows += [(610 + k, " ".join(w[: len(w) - k])) for k in range(14)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.item_ids, r.containment) for r in decontaminate.find_leaks(df, spark.createDataFrame(items, "item_id long, text string"), **options).collect()}
    want = brute_leaks(rows, items, threshold=options.get("threshold", 0.8))
    assert {i: (a, pytest.approx(b)) for i, (a, b) in want.items()} == got
    assert sum(bool(a) for a, _ in want.values()) > 5 and want[600][0] == [900]


def test_leaks_odd(spark, odd):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_items for r in decontaminate.find_leaks(odd, empty).collect()] == [0] * 12
    bench = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6")], "item_id long, text string")
    kept = decontaminate.drop_leaks(odd, bench)
    assert kept.columns == odd.columns and kept.count() == 9
    assert decontaminate.find_leaks(odd.limit(0), bench).count() == 0


def test_licences(spark, odd):
    mit = licences.LICENCES["MIT"][0]
    rows = [
        (1, "MIT Licence\n\nCopyright (c) 2020-2024 Some Body, all rights\n© 2021 Other\n\n" + mit.upper().replace(",", " ;")),
        (2, "x\nreleased under the  *MIT* Licence\ny\nLicensed under CC-BY-NC 4.0"), (3, mit + " more"), (4, None), (5, "All Rights Reserved!"),
    ]
    got = {r.doc_id: (r.licence_id, r.notice_ids, r.restricted) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {
        1: ("MIT", [], False), 2: (None, ["CC-BY-NC-4.0", "MIT"], True), 3: (None, [], False), 4: (None, [], False),
        5: ("All-Rights-Reserved", ["All-Rights-Reserved"], True),
    }
    assert licences.scan_licences(odd).count() == 12 and licences.scan_licences(odd.limit(0)).count() == 0


def test_notices_on_copyright_lines(spark):
    reserved, nc = "All-Rights-Reserved", "CC-BY-NC-4.0"
    cases = {
        "Copyright (c) 2024 Example Ltd. All rights reserved.": [reserved],
        "x\n(c) 2020 Foo, licensed under CC BY-NC 4.0.\ny": [nc],
        "© 2021 Foo. All Rights Reserved. This work is licensed under CC BY-NC 4.0.": [reserved, nc],
        "Copyright 2020 Foo. Released under the MIT Licence": ["MIT"],
        "Copyright (c) 2024 Example Ltd.": [],
        "Copyright (c) 2024 Example Ltd. Not all rights reserved.": [],
        "Copyright (c) 2024 Example Ltd. All rights reserved to others": [],
    }
    df = spark.createDataFrame([(t, t) for t in cases], "doc_id string, text string")
    got = {r.doc_id: (r.licence_id, r.notice_ids, r.restricted) for r in licences.scan_licences(df).collect()}
    assert got == {t: (None, ids, any(i in licences.RESTRICTED for i in ids)) for t, ids in cases.items()}


def test_notices_of_other_words(spark):
    rows = [(1, "x\nDo as you please!\ny"), (2, "in the Public--Domain"), (3, "please")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    other = {"Free": ["do as you please"], "PD": ["in the public domain"]}
    assert {r.doc_id: r.notice_ids for r in licences.scan_licences(df, licences=other, full={}).collect()} == {1: ["Free"], 2: ["PD"], 3: []}
    assert licences.notice_word(licences.LICENCES) == licences.NOTICE_WORD


def test_long_licences(spark):
    folder = "/usr/share/common-licenses"
    files = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    if not all(os.path.exists(f"{folder}/{f}") for f in files):
        pytest.skip("no common licences here")
    texts = {f: open(f"{folder}/{f}", encoding="utf-8").read() for f in files}
    rows = [(f, t) for f, t in texts.items()] + [("cut", texts["GPL-2"].partition("END OF TERMS")[0]), ("more", texts["GPL-2"] + "more")]
    got = {r.doc_id: (r.licence_id, r.restricted) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    free = ("Apache-2.0", "CC0-1.0")
    assert got == {f: (i, f not in free) for f, i in files.items()} | {"cut": ("GPL-2.0", True), "more": (None, False)}


def test_licences_run_no_python(spark, odd):
    plan = licences.scan_licences(odd)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_quality(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op5_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    n, right, keep = got.selectExpr("count(*)", "avg(int(predicted = quality))", "avg(predicted) FILTER (WHERE quality = 1)").first()
    assert n > 500 and right > 0.97 and keep > 0.985


def test_quality_rules_compile(spark, documents):
    rng = np.random.default_rng(7)
    x = np.array([quality.statistics(t.encode()) for _, t in documents])
    y = ((x[:, 4] > np.median(x[:, 4])) ^ (rng.random(len(x)) < 0.02)).astype(float)
    model = quality.RuleModel.fit(x, y)
    assert model.rules and ((model.score(x) > 0.5) == y).mean() > 0.9
    got = {r.doc_id: r.score for r in quality.score_quality(spark.createDataFrame(documents, "doc_id long, text string"), model).collect()}
    assert np.allclose([got[i] for i, _ in documents], model.score(x))


def brute_rules(x, y, trees, depth, bins, rate, leaf):
    """Boosted trees by plain search over rows: every statistic and cut, gains from sums over the rows on either side."""
    cuts = [sorted(set(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) | set(np.quantile(c, [0.005, 0.995], method="lower"))) for c in x.T]
    score, rules = np.full(len(x), np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), set()
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p) + 1e-6
        add = np.zeros(len(x))

        def grow(rows, path):
            best = None
            for j, c in enumerate(cuts if len(path) < depth else []):
                for cut in c:
                    low = rows & (x[:, j] <= cut)
                    high = rows & ~low
                    if low.sum() < leaf or high.sum() < leaf:
                        continue
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (low, high)) - g[rows].sum() ** 2 / (h[rows].sum() + 1)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, j, cut, low, high
            if best is None:
                add[rows] = rate * g[rows].sum() / (h[rows].sum() + 1)
                return
            _, j, cut, low, high = best
            for side, above in ((low, False), (high, True)):
                rules.add(tuple(sorted({*path, (j, float(cut), above)})))
                grow(side, (*path, (j, float(cut), above)))

        grow(np.ones(len(x), bool), ())
        score = score + add
    return rules


def test_rules_match_plain_trees():
    rng = np.random.default_rng(21)
    x = rng.normal(size=(400, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > -0.2) ^ (rng.random(400) < 0.1)).astype(float)
    options = dict(trees=3, depth=3, bins=6, rate=0.3, leaf=8)
    assert set(quality.grow_rules(x, y, **options)) == brute_rules(x, y, **options)


def test_lasso_is_optimal():
    rng = np.random.default_rng(22)
    a = (rng.random((600, 30)) < 0.4).astype(float)
    y = (a[:, 0] + a[:, 1] - a[:, 2] + rng.normal(0, 0.5, 600) > 0.5).astype(float)
    penalty = 0.01
    b, w = quality.lasso_logistic(a, y, penalty, steps=4000)
    r = 1 / (1 + np.exp(-(a @ w + b))) - y
    slope = a.T @ r / 600
    assert abs(r.mean()) < 1e-5 and (w == 0).sum() > 10 and (w != 0).sum() >= 3
    assert np.abs(slope[w != 0] + penalty * np.sign(w[w != 0])).max() < 1e-4 and np.abs(slope[w == 0]).max() <= penalty + 1e-4


def test_registered_quality_matches_a_plain_fit(spark, sf):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [(docs[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in docs and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    x, y = np.array([quality.statistics(t) for t, _ in rows]), np.array([float(q) for _, q in rows])
    order = np.lexsort([*x.T[::-1], y])
    model = quality.RuleModel.fit(x[order], y[order])
    want = dict(zip(docs, model.score(np.array([quality.statistics(t) for t in docs.values()]))))
    got = queries.op5_quality(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-9) and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_batches_are_bounded_in_bytes(spark):
    from trackweave.llm import common

    common.limit_batches(spark)

    def sizes(parts):
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows]), pa.array([part.nbytes])], names=["rows", "bytes"])

    texts = spark.range(0, 24, 1, 1).selectExpr("repeat('x', 8 << 20) AS t")
    got = texts.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 24 and max(r.bytes for r in got) <= common.BATCH_BYTES + (9 << 20)


def test_quality_odd(spark, odd):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (6, None)], "doc_id long, quality int")
    model = quality.fit_quality(odd, labels)
    got = quality.score_quality(odd, model)
    assert got.count() == 12 and set(got.columns) == {"doc_id", "text", "component_id", "score", "predicted"}
    assert quality.fit_quality(odd, labels.limit(0)).rules == [] and quality.score_quality(odd.limit(0), model).count() == 0


def test_quality_fit_is_bounded_by_rows(spark, monkeypatch):
    rows = [(i, f"text {i} " * (i % 7 + 1)) for i in range(1, 40)] + [(1, f"again {n}") for n in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, quality int")
    shapes = []
    monkeypatch.setattr(quality.RuleModel, "fit", staticmethod(lambda x, y: shapes.append(x.shape)))
    for most in (10, 50, 8000):
        quality.fit_quality(docs, labels, fit_rows=most)
    kept = docs.filter(~quality.held_out("doc_id")).count()
    assert [s[0] for s in shapes] == [10, 50, kept]


def test_warc_round_trip(spark):
    rows = [(i, f"http://h/{i % 7} x", ("é<p>%d</p>" % (i % 13)) * (40 * (i % 29))) for i in range(300)] + [(900, None, None), (None, "u", "z" * 2000), (901, "u", "z" * 2000)]
    rows += [(902, "big", "0123456789" * 30_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    manifest = warc.write_archives(df, segment=4096, archive=20_000)
    assert manifest.count() > 3
    got = {r.page_id: r for r in warc.read_archives(spark, manifest).collect()}
    assert len(got) == len(rows)
    last = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            last[h] = max(last.get(h, i), i)
    for i, _, h in rows:
        payload, r = (h or "").encode(), got[i]
        refers = last.get(h) if last.get(h) != i else None
        assert (r.record_type, r.refers_to, r.payload_bytes) == ("response" if refers is None else "revisit", refers, len(payload))
        assert r.payload is None if refers is not None else bytes(r.payload) == payload
    empty = warc.write_archives(df.limit(0))
    assert warc.read_archives(spark, empty).count() == 0


def test_warc_ids_and_segments(spark, sf):
    import gzip

    rows = [(1, "u", "a" * 9000), (2, "u", "a" * 9000), (3, "u", "b" * 2000), (3, "u", "b" * 2000), (4, "u", "b" * 2000), (None, "u", "c"), (None, "u", "d")]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, digest string, n int")
    manifest = warc.write_archives(df)
    records = []
    for r in manifest.collect():
        with open(r.path.removeprefix("file:"), "rb") as f:
            data = gzip.decompress(f.read())
        records += [dict(x.split(": ", 1) for x in part.split("\r\n")[1:]) for part in data.decode().split("\r\n\r\n") if part.startswith("WARC/1.1")]
    ids = [r["WARC-Record-ID"] for r in records]
    assert len(set(ids)) == len(ids) == manifest.agg({"records": "sum"}).first()[0] and sum(r["WARC-Type"] == "continuation" for r in records) == 2
    assert [(r["WARC-Record-ID"], r["WARC-Refers-To"]) for r in records if r["WARC-Type"] == "revisit" and r["WARC-Record-ID"].endswith(":1>")] == [("<urn:trackweave:page:1>", "<urn:trackweave:page:2>")]
    assert "<urn:trackweave:page:2>" in ids
    got = sorted(((r.page_id or 0), r.record_type, r.refers_to or 0, r.payload_bytes) for r in warc.read_archives(spark, manifest).collect())
    assert got == [(0, "response", 0, 1), (0, "response", 0, 1), (1, "revisit", 2, 9000), (2, "response", 0, 9000), (3, "revisit", 4, 2000), (3, "revisit", 4, 2000), (4, "response", 0, 2000)]


def test_warc_reassembles_the_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    manifest = warc.write_archives(pages)
    long = pages.filter("length(html) > 4096").count()
    assert long > 5 and manifest.agg({"records": "sum"}).first()[0] >= pages.count() + long // 2
    got = {r.page_id: r.payload for r in warc.read_archives(spark, manifest).collect()}
    assert all(got[r.page_id] is None or bytes(got[r.page_id]).decode() == r.html for r in pages.collect()) and len(got) == pages.count()


def test_warc_broken_segments():
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"x" * 30_000)
    assert warc.payload_of(block)[1] == b"x" * 30_000
    with pytest.raises(ValueError):
        warc.payload_of(block[:-9000])


@pytest.mark.parametrize("broken", ["whole", "missing", "first", "total", "digest", "cut"])
def test_warc_archives_that_are_not_whole(spark, tmp_path, broken):
    import gzip
    import re

    text = "".join(f"line {i}\n" for i in range(2000))
    pages = spark.createDataFrame([(1, "u", text), (2, "v", "short")], "page_id long, url string, html string")
    [path] = [r.path for r in warc.write_archives(pages.coalesce(1), segment=4096).collect()]
    with open(path.removeprefix("file:"), "rb") as f:
        records = [b"WARC/1.1" + r for r in gzip.decompress(f.read()).split(b"WARC/1.1")[1:]]
    parts = [i for i, r in enumerate(records) if b"continuation" in r]
    assert len(parts) >= 3
    if broken == "missing":
        del records[parts[1]]
    elif broken == "first":
        del records[parts[0] - 1]
    elif broken == "total":
        records[parts[-1]] = re.sub(rb"(Total-Length: )(\d+)", lambda m: m[1] + str(int(m[2]) + 1).encode(), records[parts[-1]])
    elif broken == "digest":
        records = [re.sub(rb"(Payload-Digest: sha1:)(.)", lambda m: m[1] + (b"1" if m[2] == b"0" else b"0"), r) for r in records]
    elif broken == "cut":
        records[-1] = records[-1][:-20]
    with open(tmp_path / "x.warc.gz", "wb") as f:
        f.write(b"".join(gzip.compress(r) for r in records))
    manifest = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz", 1, 1)], "path string, bytes long, records long")
    if broken == "whole":
        got = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(spark, manifest).collect()}
        assert got == {1: text, 2: "short"}
        return
    why = {"digest": "digest differs", "cut": "breaks off"}.get(broken, "not whole")
    with pytest.raises(Exception, match=why):
        warc.read_archives(spark, manifest).collect()


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><script>var a = "</p>";</script><style>p{}</style></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/x">Menu</a></ul></nav><!-- <p>no</p> --><div class="cookie-notice">We use cookies</div>
<article><h1>T &amp; x</h1><p><b>First&nbsp; line<br><p class="lead">Second &lt;line&#33; <i>it</i>alic</p><aside>Side</aside><form><input name=q>Find</form>
<div class="ad"><div>Buy</div> now</div><ul><li>one<li>two</ul></article><section id="comments"><p>I say</p></section><footer>&copy; F</footer>"""


def test_main_text():
    blocks = htmltext.blocks_of(PAGE)
    assert blocks.article() == ["T & x", "First line", "Second <line! italic", "one", "two"]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<div class="has-sidebar"><article><p>Hello</p></article></div>', ["Hello"]),
        ('<div class="layout no-sidebar"><main>Hello</main></div>', ["Hello"]),
        ('<div class="sidebar"><article>Only</article></div>', ["Only"]),
        ('<div class="sidebar"><article>Teaser</article></div><main>Text</main>', ["Text"]),
        ("<form><article>In a form<form>Find</form></article></form>", ["In a form"]),
        ('<article><ul><li class="share">x<li>y</ul><p>Body</p></article>', ["y", "Body"]),
        ("<article><p class='ad'>Buy<h2>Real</h2></article>", ["Real"]),
        ("<article><dl><dt class='ad'>x<dd>y</dl><table><tr><td class='promo'>a<td>b<tr><td>c</table>d</article>", ["y", "b", "c", "d"]),
        ('<article>a <span style="display: none">no</span>b<p hidden>no</p><p style="visibility:hidden">no<p data-hidden="x hidden">c</article>', ["a b", "c"]),
        ('<article>a<section class="reader-remarks"><p>no</p></section><article class="comment">no</article></article>', ["a"]),
        ('<div id="comments"><article>no</article></div>', []),
        ("<article>a</div></p>b<b>c</article>d", ["a", "bc"]),
    ],
)
def test_placing(page, want):
    assert htmltext.blocks_of(page).article() == want


@pytest.mark.parametrize("name", ["share-of-market", "related-work", "discussion", "ad-hoc", "notice-of-motion", "comments-on-law"])
def test_parts_of_class_names_are_hints(name):
    blocks = htmltext.blocks_of(f'<article><p>a</p><section class="{name}"><p>b</p><p>c</p></section><p>d</p></article>')
    assert blocks.article() == ["a", "b", "c", "d"] and blocks.doubtful() == [False, True, True, False]


@pytest.mark.parametrize("name", ["ad", "comments", "cookie-notice", "share-buttons", "comment-list", "ad_slot_2", "related-posts", "newsletter-box"])
def test_class_names_that_mean_one_thing(name):
    assert htmltext.blocks_of(f'<article><p>a</p><div class="{name}"><p>b</p></div><p>d</p></article>').article() == ["a", "d"]


def test_repetition_decides_what_a_class_name_hints_at(spark):
    """Over the given hosts' size of input: hinted blocks that pages of a host share go, unique ones and unhinted repeats stay."""
    rows = [
        (i, f"https://h{i % 3}.example/{i}",
         f"<article><h1>t{i}</h1><p>The same sentence in every article of the host here</p><div class='share-of-market'>figures of year {i} and of {i} plants</div>"
         f"<div class='related-work'>More to read on the site of host {i % 3} today</div><p>end</p></article>")
        for i in range(30)
    ]
    rows.append((99, "https://lone.example/", "<article><p>x</p><div class='related-work'>More to read on the site of host 0 today</div></article>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"t{i}\nThe same sentence in every article of the host here\nfigures of year {i} and of {i} plants\nend" for i in range(30)}
    want[99] = "x\nMore to read on the site of host 0 today"
    for options in ({}, {"shard_pages": 4}):
        assert {r.page_id: r.text for r in htmltext.main_text(df, **options).collect()} == want


def test_pages_with_an_article_are_in_the_array(spark):
    """Footers and menus of pages that mark an article count for a page that marks none; articles keep what they repeat."""
    notice, quoted = "Read the terms of this site before you go on", "Write to the editor of this site if you disagree"
    rows = [(i, "https://h.example/", f"<nav><li>Start</nav><article><p>{quoted}</p><p>text of {i}</p></article><footer>{notice}</footer><div class='ad'>only {i}</div>") for i in range(4)]
    rows += [(9, "https://h.example/", f"<div>Start</div><div>{quoted}</div><p>plain page</p><div>{notice}</div>"), (10, "https://g.example/", f"<p>{notice}</p>")]
    rows += rows[:1] * 5  # copies
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    want = sorted([(i, f"{quoted}\ntext of {i}") for i in range(4)] + [(0, f"{quoted}\ntext of 0")] * 5 + [(9, f"{quoted}\nplain page"), (10, notice)])
    for options in ({}, {"shard_pages": 2}, {"shard_pages": 1}):
        assert sorted((r.page_id, r.text) for r in htmltext.main_text(df, **options).collect()) == want
    K, D, X = htmltext.KEPT, htmltext.DOUBTFUL, htmltext.OUT
    counts = {(r.mark, r.repeated): r.n for r in htmltext.block_counts(df).collect()}
    assert counts == {(K, False): 18, (K, True): 0, (D, False): 3, (D, True): 2, (X, False): 9, (X, True): 18}


def test_array_finds_repeats_of_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    one, many = ({(r.mark, r.repeated): r.n for r in htmltext.block_counts(pages, n).collect()} for n in (10**6, 3))
    for mark in (htmltext.DOUBTFUL, htmltext.OUT):
        assert [one[mark, x] for x in (False, True)] == [many[mark, x] for x in (False, True)]
    assert one[htmltext.OUT, True] > 0


def test_pages(spark, sf):
    import html

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in htmltext.main_text(pages).collect()}
    for r in pages.collect():
        inner = r.html.partition("<article>")[2].partition("</article>")[0]
        for tag in ("<b>", "</b>"):
            inner = inner.replace(tag, "")
        for tag in ("</h1>", "</p>", "<br>", "<h1>"):
            inner = inner.replace(tag, "<p>")
        want = "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in inner.split("<p>")) if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_host_suffix_array(spark):
    unique = [" ".join(f"u{i}x{j}" for j in range(30)) for i in range(40)]
    rows = [
        (i, f"https://h{i % 2}.example/{i}", f"<div>Welcome to the best site of h{i % 2}</div><p>{unique[i]}</p><p>Shared tail number one two three four five</p>")
        for i in range(40)
    ] + [(50, None, None), (51, "https://h0.example/z", ""), (52, "https://lone.example/", "<p>only page</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for shard in (512, 8):
        got = {r.page_id: r.text for r in htmltext.main_text(df.repartition(3), shard_pages=shard).collect()}
        assert got == {i: unique[i] for i in range(40)} | {50: "", 51: "", 52: "only page"}
    assert htmltext.main_text(df.limit(0)).count() == 0


def test_passage_on_three_pages_of_many_shards(spark):
    unique = [" ".join(f"u{i}x{j}" for j in range(30)) for i in range(42)]
    notice = [" ".join(f"n{i}y{j}" for j in range(8)) for i in range(14)]
    rows = [(i, f"https://h.example/{i}", f"<p>{unique[i]}</p><p>{notice[i % 14]}</p>") for i in range(42)]
    rows += [(50 + i, f"https://h.example/s{i}", f"<p>Autumn sale</p><p>once only {i}</p>") for i in range(3)]
    rows += [(60, "https://h.example/t", "<p>our Autumn sale has begun</p>"), (61, "https://g.example/", f"<p>{notice[0]}</p>")]
    rows += [(70 + i, f"https://h.example/c{i}", f"<p>{unique[0][::-1]}</p>") for i in range(9)]  # copies of one page
    rows += [(80 + i, f"https://h.example/d{i}", f"<p>{unique[1][::-1]}</p><p>of {i} and {i}</p>") for i in range(2)]  # two pages alike
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = dict(enumerate(unique)) | {50: "once only 0", 51: "once only 1", 52: "once only 2", 60: "our Autumn sale has begun", 61: notice[0]}
    want |= {70 + i: unique[0][::-1] for i in range(9)} | {80 + i: f"{unique[1][::-1]}\nof {i} and {i}" for i in range(2)}
    for options in ({}, {"shard_pages": 4}, {"shard_pages": 1}, {"shard_chars": 100}):
        assert {r.page_id: r.text for r in htmltext.main_text(df, **options).collect()} == want


def brute_repeated(pages, size, least, covered):
    holders = {}
    for p, blocks in enumerate(pages):
        for text in blocks:
            t = text.split()
            for run in [tuple(t[i : i + size]) for i in range(len(t) - size + 1)] if len(t) >= size else [tuple(t)]:
                holders.setdefault((run, len(t) < size), set()).add(p)
    out = []
    for blocks in pages:
        row = []
        for text in blocks:
            t, on = text.split(), set()
            for i in range(max(1, len(t) - size + 1)):
                if len(holders[tuple(t[i : i + size]), len(t) < size]) >= least:
                    on |= set(range(i, min(len(t), i + size)))
            row.append(len(on) >= covered * max(1, len(t)))
        out.append(row)
    return out


@pytest.mark.parametrize("letters", ["ab", "abcd"])
def test_repeated_blocks_match_brute_force(letters):
    rng = np.random.default_rng(11)
    found = set()
    for size, least in ((4, 2), (4, 3), (6, 3), (2, 5)):
        pages = [[" ".join(rng.choice(list(letters), int(rng.integers(1, 14)))) for _ in range(int(rng.integers(0, 4)))] for _ in range(24)]
        want = brute_repeated(pages, size, least, 0.9)
        assert htmltext.repeated_blocks(pages, size, least, 0.9) == want
        found |= {x for page in want for x in page}
    assert found == {False, True}


def test_shards_runs_add_up_to_those_of_one_array():
    rng = np.random.default_rng(12)
    pages = [[" ".join(rng.choice(list("abcd"), int(rng.integers(1, 14)))) for _ in range(int(rng.integers(1, 4)))] for _ in range(24)]
    whole, total = htmltext.HostRuns(pages, 4), {}
    for part in (pages[:8], pages[8:16], pages[16:]):
        runs = htmltext.HostRuns(part, 4)
        for k, n in zip(runs.hashes().tolist(), runs.times.tolist()):
            total[k] = total.get(k, 0) + n
    assert total == dict(zip(whole.hashes().tolist(), whole.times.tolist()))


def test_pages_odd(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, "http://a/", f"<article>{long}<p>x</article>", "t", 1), (1, "http://a/", f"<article>{long}<p>x</article>", "t", 1), (None, None, None, None, None),
            (3, "http://a/", f"<p>{long}", "t", 3), (4, "", "", "", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = htmltext.main_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(((r.page_id or 0), r.text, r.n_chars) for r in got.collect()) == sorted(
        [(0, "", 0), (1, long + "\nx", len(long) + 2), (1, long + "\nx", len(long) + 2), (3, long, len(long)), (4, "", 0)]
    )


def test_suffix_array():
    rng = np.random.default_rng(8)
    tokens = rng.integers(0, 3, 200)
    order, shared = htmltext.suffix_array(tokens)
    assert order.tolist() == sorted(range(200), key=lambda i: tokens[i:].tolist())
    for k in range(1, 200):
        a, b = tokens[order[k - 1] :].tolist(), tokens[order[k] :].tolist()
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shared[k] == n


@pytest.mark.parametrize("tokens", [[], [5], [3] * 40, [1, 2] * 20 + [1], [*range(30), *range(30), -1, *range(30)]])
def test_suffix_array_of_repeats(tokens):
    order, shared = htmltext.suffix_array(np.array(tokens, np.int64))
    assert order.tolist() == sorted(range(len(tokens)), key=lambda i: tokens[i:])
    for k in range(1, len(tokens)):
        a, b = tokens[order[k - 1] :], tokens[order[k] :]
        assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_rows_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(htmltext, "COPIES", 4)
    rows = [(i, f"https://h.example/{i}", "<p>one page</p>") for i in range(30)] + [(i, None, None) for i in range(40, 52)] + [(i, "https://h.example/", "<p>four</p>") for i in range(70, 74)]
    rows += [(60, "https://h.example/60", "<p>other</p>"), (None, "https://h.example/x", "<p>one page</p>"), (None, None, "<p>third</p>"), (1, "https://h.example/1", "<p>one page</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for most in (32 << 20, -1):
        monkeypatch.setattr(htmltext, "small_side", lambda df, rows, row_bytes, most=most: tables.small_side(df, rows, row_bytes, most))
        got = [(str(r.page_id), str(r.url), r.text) for r in htmltext.main_text(df).collect()]
        want = [(str(i), str(u), (h or "").replace("<p>", "").replace("</p>", "")) for i, u, h in rows]
        assert sorted(got) == sorted(want)
