import duckdb
import pytest

import corpus_pipeline
from trackweave.llm import decontaminate, queries

from .test_dedup import brute_fingerprint, brute_lines, jaccard_groups
from .test_text import brute_leaks


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    stages = dict(corpus_pipeline.STAGES)
    lines = stages["line_dedup"](spark, docs, sf)
    assert lines.columns == docs.columns
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted((r.doc_id, r.text) for r in lines.collect()) == [(i, t) for i, t, _, _ in brute_lines(rows, keep="first")]
    near = stages["simhash_near_dedup"](spark, docs, sf)
    assert near.columns == docs.columns
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, c in jaccard_groups(rows).items() if i == c)
    clean = stages["benchmark_decontamination"](spark, docs, sf)
    found = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert clean.columns == docs.columns and clean.count() == found.filter("n_items = 0").count() < docs.count()
    good = stages["quality_classifier"](spark, docs, sf)
    assert good.columns == docs.columns and 0 < good.count() <= docs.count()
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "ids", "n_pieces", "n_chars"]


CLASHING = ("score", "predicted", "item_ids", "n_items", "containment", "n_lines", "n_dropped", "component_id", "digest", "ids", "node", "key")


@pytest.fixture(scope="module")
def strange(spark, sf):
    """Documents with nulls, empty and long texts, repeated rows and ids, and columns named like those of operators."""
    docs = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    base = docs[0][1]
    docs += [docs[3], (docs[4][0], base + " again", None, None, None), (None, None, None, None, None), (None, base, "en", "s", 1), (900, None, "en", "s", 0)]
    docs += [(901, "", "en", "s", 0), (902, " \n\t", "en", "s", 3), (903, "Long " + base * 40, "en", "s", 9), (904, base, "en", "s", 1)]
    rows = [(*r, *(f"{c}{i}" for c in CLASHING)) for i, r in enumerate(docs)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(f'{c} string' for c in CLASHING)}")


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_strange_documents(spark, sf, strange, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, strange, sf)
    nothing = stage(spark, strange.limit(0), sf)
    assert nothing.columns == got.columns and nothing.count() == 0
    if name == "sentencepiece":
        assert got.columns == ["doc_id", "ids", "n_pieces", "n_chars"] and got.count() == strange.count()
        return
    assert got.schema == strange.schema
    rows, kept = {r.score: r for r in strange.collect()}, {r.score: r for r in got.collect()}
    for key, r in kept.items():  # columns of the documents come back as they were, whatever their names
        before = rows[key].asDict()
        assert all(r[c] == before[c] for c in (*CLASHING, "doc_id", "lang", "source"))
        assert name == "line_dedup" or (r.text, r.n_chars) == (before["text"], before["n_chars"])
    pairs = [(r.doc_id, r.text) for r in rows.values()]
    if name == "line_dedup":
        assert len(kept) == len(rows)
    if name == "simhash_near_dedup":
        ids = {r.doc_id for r in kept.values()}
        assert 900 in ids and not {None, 901, 902, 904} & ids  # of the texts without words, and of the copies, the smallest id
    if name == "benchmark_decontamination":
        bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
        leaks = [bool(brute_leaks([p], bench)[p[0]][0]) for p in pairs]
        assert {k for k, bad in zip(rows, leaks) if not bad} == set(kept)


def test_pipeline_leaves_one_table(spark, sf):
    import os

    from trackweave.llm import common

    before = set(common._made)
    corpus_pipeline.run(spark, sf).count()
    left = [p for p in common._made if p not in before]
    assert len(left) == 1 and "pipeline-sentencepiece" in left[0] and os.path.isdir(left[0].removeprefix("file:"))


def test_registered_queries(spark, sf):
    """op1, op2 and op9 as registered, against the libraries and brute force."""
    import zlib

    import numpy as np
    import sentencepiece
    from tokenizers import Tokenizer

    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary(queries.PIECES))
    got = {r.doc_id: (r.n_pieces, r.round_trip) for r in queries.op1_sentencepiece(spark, sf).collect()}
    assert got == {i: (len(sp.encode(t)), True) for i, t in docs}
    got = {r.doc_id: r.fingerprint for r in queries.op2_simhash(spark, sf).collect()}
    assert got == {i: f"{brute_fingerprint(t):016x}" for i, t in docs}
    tok, start, want = Tokenizer.from_file(queries.vocabulary(queries.WORDS)), 0, {}
    for i, t in docs:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op9_token_ids(spark, sf).collect()} == want


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]}) AS q").fetchall()
    plain = lambda row: tuple(round(x, 9) if isinstance(x, float) else tuple(x) if isinstance(x, list) else x for x in row)
    assert sorted(map(repr, map(plain, want))) == sorted(map(repr, (plain(tuple(r)) for r in got.select(*columns).collect())))
