"""Divergence, toxicity and session closing: odd rows, brute force, SQL, held-out accuracy, restarts."""

import random
import zlib
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest

from trackweave.llm import divergence, queries, sessions, toxicity
from trackweave.llm.common import materialize

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string"
LOG = [c.split()[0] for c in sessions.STATE.split(", ")]


def same(df, sql, con):
    columns = ", ".join(f'"{c}"' for c in df.columns)
    want = con.execute(f"SELECT {columns} FROM ({sql}) AS q").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


@pytest.mark.parametrize("name, tables", [("op11_divergence", ["documents"]), ("op13_sessions", ["clicks"])])
def test_registered_query_matches_sql(spark, sf, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert same(queries.queries()[name](spark, sf), queries.oracle_sql()[name], con)


def as_view(con, spark, df, name, folder):
    path = str(folder / name)
    df.write.parquet(path)
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'")


def test_divergence_of_odd_rows(spark, tmp_path):
    """Nulls, empties, repeats, ties, clashing names, a language whose terms are too rare, one with a single source."""
    rows = [(i, t, lang, s, 1) for i in range(40) for t, lang, s in (("Aa bb É9x", "en", "p"), ("aa cc", "en", None), ("BB bb", "en", "q"))]
    rows += [(1, None, "en", "r", 2), (2, "rare", "de", "p", 3), (2, "", "de", "q", 3), (None, "aa \x00 bb" * 3000, None, "p", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, value long").withColumnRenamed("doc_id", "rank")
    con = duckdb.connect()
    as_view(con, spark, docs, "documents", tmp_path)
    got = same(divergence.divergence(docs), divergence.ORACLE, con)
    assert {r[:2] for r in got if r[2] == "pair"} >= {("en", "r"), ("de", "p")}
    assert [r[4] for r in got if r[0] == "de"] == [0, 0]
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_shares_are_exact(spark):
    df = spark.createDataFrame([(9_000_000_000_000, 9_000_000_000_007, 3), (0, 0, 1)], "n long, t long, v long")
    got = [r[0] for r in df.select(divergence.share("n", "t", "v")).collect()]
    assert got == [1 + 10**9 * (9_000_000_000_000 + 5) // (9_000_000_000_007 + 15), 1 + 10**9 * 5 // 5]


def plain_sessions(batches, gap, lateness):
    """Each batch: sessions left open and clicks that aren't late, joined one by one: [(client, first, last, n, crc, merges, batch)]."""
    high, left, out = None, [], []
    for b, rows in enumerate(batches):
        bound = None if high is None else high - lateness
        now = [(c, t, t, 1, zlib.crc32(str(i).encode()), 0, False) for i, c, t in rows if bound is None or t >= bound]
        both, done = sorted(left + now, key=lambda r: (r[0], r[1])), []
        for r in both:
            p = done[-1] if done else None
            if p and p[0] == r[0] and r[1] - p[2] <= gap:
                done[-1] = (p[0], p[1], max(p[2], r[2]), p[3] + r[3], p[4] + r[4], p[5] + r[5], p[6] + r[6])
            else:
                done.append((*r[:6], int(r[6])))
        high = max([t for _, _, t in rows] + ([] if high is None else [high])) if rows else high
        left = []
        for c, first, last, n, crc, merges, opened in done:
            s = (c, first, last, n, crc, merges + max(0, opened - 1))
            if rows and last + gap < high - lateness:
                out.append((*s, b))
            else:
                left.append((*s, True))
    return sorted(out + [(*s[:6], len(batches)) for s in left])


def random_batches(rng, n, batches, clients, span, spread):
    out, number = [], 0
    for b in range(batches):
        rows = []
        for _ in range(rng.randrange(n)):
            number += 1
            rows.append((number, rng.randrange(clients), max(0, int(b * span + rng.uniform(-spread, span)))))
        out.append(rows)
    return out


@pytest.mark.parametrize("seed", range(60))
def test_replay_equals_one_by_one(seed):
    """The kernel over runs kept apart for several batches, against joining clicks one by one."""
    rng = random.Random(seed)
    gap, lateness = 10, rng.choice([0, 15, 40, 1000])
    batches = random_batches(rng, 40, rng.randrange(1, 9), 3, rng.choice([5, 40, 120]), rng.choice([5, 60]))
    items, high, got = [], None, []
    every = rng.choice([1, 2, 3])
    for b, rows in enumerate([*batches, None]):
        if rows:
            cells = {}
            for i, c, t in rows:
                if high is None or t >= high - lateness:
                    cells.setdefault((c, t // gap), []).append((t, zlib.crc32(str(i).encode())))
            items += [(c, k, b, min(x)[0], max(x)[0], min(x)[0], len(x), sum(y for _, y in x), 0) for (c, k), x in cells.items()]
            high = max([t for _, _, t in rows] + ([] if high is None else [high]))
        due = 1 << 62 if rows is None else None if high is None else high - lateness - gap
        # the timer: a merge is needed when something ends before `due`; else runs may stay apart
        if items and due is not None and (any(r[4] < due for r in items) or b % every == 0):
            items.sort()
            table = {k: np.array([r[j] for r in items], np.int64) for j, k in enumerate(LOG)}
            closed, stay = sessions.replay(table, due, b, gap)
            got += [(*map(int, r), b) for r in zip(*(closed[k] for k in ("client_id", "first", "hi", "n", "crc", "merges")))]
            items = [tuple(map(int, r)) for r in zip(*(stay[k] for k in LOG))]
    assert sorted(got) == plain_sessions(batches, gap, lateness)


def clicks_of(spark, rows):
    return spark.createDataFrame([(i, c, t, b) for i, c, t, b in rows], "click_id long, client_id long, ts_us long, batch long")


def test_log_compacts_by_levels_and_survives_repeats(spark, tmp_path):
    """Runs pile up and are compacted while nothing is due; every epoch is applied twice, as after a failure."""
    rng = random.Random(5)
    gap, lateness = 10, 200
    batches = random_batches(rng, 60, 9, 4, 25, 90)
    log = sessions.SessionLog(spark, f"file://{tmp_path}/state", gap, lateness, fanout=2)
    levels = set()
    for b, rows in enumerate(batches):
        for _ in range(2):
            log.step(clicks_of(spark, [(i, c, t, b) for i, c, t in rows]), b)
        levels |= {r["level"] for r in log.manifest()["runs"]}
    assert max(levels) >= 2
    assert sorted(map(tuple, log.sessions(len(batches)).collect())) == plain_sessions(batches, gap, lateness)


def test_a_batch_that_fails_is_repeated(spark, tmp_path, monkeypatch):
    """A stream that dies inside a batch goes on from its checkpoint with the same rows and the state before them."""
    batches = random_batches(random.Random(8), 50, 3, 3, 60, 30)
    log = sessions.SessionLog(spark, f"file://{tmp_path}/state", 10, 50)
    commit, fail = log._commit, [True]

    def once(epoch, manifest):
        if epoch == 1 and fail and fail.pop():
            raise RuntimeError("lost")
        commit(epoch, manifest)

    monkeypatch.setattr(log, "_commit", once)
    for b, rows in enumerate(batches):
        clicks_of(spark, [(i, c, t, b) for i, c, t in rows]).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        for attempt in range(2):
            stream = spark.readStream.schema("click_id long, client_id long, ts_us long, batch long").parquet(f"file://{tmp_path}/in")
            query = stream.writeStream.foreachBatch(log.step).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
            try:
                query.awaitTermination()
                break
            except Exception:
                assert attempt == 0
    assert not fail
    assert sorted(map(tuple, log.sessions(3).collect())) == plain_sessions(batches, 10, 50)


def test_sessions_of_odd_clicks(spark, tmp_path):
    """Nulls, repeats, ties, a click without arrival, times before 1970, an empty table, a clashing name."""
    at = datetime(2024, 1, 1)
    rows = [(i, at + timedelta(minutes=17 * i), at + timedelta(hours=i), i % 3, "x") for i in range(90)]
    rows += [rows[5], rows[6], (200, None, at, 1, "x"), (201, at, at, None, None), (None, at, at, 1, "x"), (202, at, None, 1, None)]
    rows += [(203, at + timedelta(minutes=17), at, 1, "x"), (204, at + timedelta(minutes=17), at, 1, "x"), (205, at + timedelta(days=3), at + timedelta(days=90), 7, "x")]
    clicks = spark.createDataFrame(rows, CLICKS).withColumnRenamed("kind", "batch")
    con = duckdb.connect()
    as_view(con, spark, clicks, "clicks", tmp_path)
    assert same(sessions.close_sessions(clicks), sessions.ORACLE, con)
    for empty in (clicks.limit(0), clicks.filter("client_id IS NULL")):
        assert sessions.close_sessions(empty).count() == 0
    assert sessions.close_sessions(clicks.limit(0)).columns == [c.split()[0] for c in sessions.SESSIONS.split(", ")]


def test_micros_need_no_zone(spark):
    times = [datetime(1969, 12, 31, 23, 59, 59, 999999), datetime(2024, 3, 10, 2, 30, 0, 1), datetime(2024, 11, 3, 1, 30)]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [r[0] for r in df.select(sessions.micros("ts")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [(t - datetime(1970, 1, 1)) // timedelta(microseconds=1) for t in times]


def test_a_hot_client_is_combined_before_the_merge(spark):
    """A million clicks of one client in a day are 48 rows of a run."""
    clicks = spark.range(200_000).selectExpr("id AS click_id", "7L AS client_id", "(id * 431999) AS ts_us", "0L AS batch")
    assert sessions.mini_sessions(clicks, 0).count() <= 49


@pytest.mark.parametrize("seed", range(8))
def test_block_max_search_is_exact(seed):
    rng = np.random.default_rng(seed)
    n, terms = int(rng.integers(1, 200)), 30
    dense = np.where(rng.random((n, terms)) < 0.15, rng.integers(1, 4, (n, terms)), 0).astype(float)
    norms = np.sqrt((dense**2).sum(1, keepdims=True))
    dense = np.divide(dense, norms, out=np.zeros_like(dense), where=norms > 0)
    index = toxicity.BlockMaxIndex([(np.flatnonzero(v), v[np.flatnonzero(v)]) for v in dense], terms, block=8)
    for q in range(40):
        query = np.where(rng.random(terms) < 0.2, rng.random(terms), 0)
        skip = q if q < n and q % 2 else -1
        sims = [(-round(float(s), 12), i) for i, s in enumerate(dense @ query) if i != skip and s > 0]
        got = index.search(np.flatnonzero(query), query[np.flatnonzero(query)], 5, skip)
        want = sorted(sims)[:5]
        assert [i for _, i in got] == [i for _, i in want] or np.allclose([s for s, _ in got], [-s for s, _ in want], atol=1e-10)
        assert np.allclose([s for s, _ in got], [-s for s, _ in want], atol=1e-10)


def test_isotonic_rises():
    rng = np.random.default_rng(1)
    votes = rng.random(300)
    labels = (rng.random(300) < votes).astype(int)
    knots, rates = toxicity.isotonic(votes, labels, 0.3)
    assert (np.diff(rates) >= 0).all() and (np.diff(knots) > 0).all() and rates.min() > 0 and rates.max() < 1
    assert abs(np.interp(votes, knots, rates).mean() - labels.mean()) < 0.05


def test_toxicity_against_plain_neighbours(spark, sf):
    """Scores of every document against cosines with all examples, term by term; held-out labels; evidence."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model, vectors = toxicity.fit_toxicity(docs, labels)
    rows = toxicity.score_vectors(vectors, model).collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    number = {t: i for i, t in enumerate(model.terms)}

    def dense(text):
        v = np.zeros(len(number))
        for w in toxicity.words_of(text.encode()):
            for t in toxicity.terms_of(w):
                if t in number:
                    v[number[t]] += 1
        on = v > 0
        v[on] = (1 + np.log(v[on])) * model.idf[on]
        return v / (np.linalg.norm(v) or 1)

    known = {int(i): dense(texts[int(i)]) for i in model.ids}
    for r in rows:
        v = dense(texts[r["__tw_id"]])
        sims = sorted((round(float(v @ x), 9) for x in known.values() if v @ x > 0), reverse=True)[:3]
        assert np.allclose([e.similarity for e in r.evidence], sims, atol=1e-8)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    df = {t: sum(number[t] in np.flatnonzero(dense(x)) for x in texts.values()) for t in model.terms}
    assert np.allclose(model.idf, [np.log((1 + len(texts)) / (1 + df[t])) + 1 for t in model.terms])


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op12_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    good = [r for r in got if not r.toxic]
    bad = [r for r in got if r.toxic]
    assert sum(r.predicted for r in good) <= 0.01 * len(good) and sum(r.predicted for r in bad) >= 0.88 * len(bad)
    assert np.mean([r.score > s.score for r in bad for s in good]) > 0.9


def test_toxicity_learns_only_from_rows_not_held_out(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, "bad word" if i % 2 else "good word") for i in range(200)], "doc_id long, text string")
    chosen = {int(r.id) for r in toxicity.choose_examples(docs, labels).collect()}
    assert chosen == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5}
    assert toxicity.choose_examples(docs, labels, fit_rows=10).count() == 10


def test_toxicity_of_odd_rows(spark):
    """Null, empty and long texts, repeats, null ids, clashing names, no labels, labels of one kind, no documents."""
    rows = [(i, "you bad thing" if i % 2 else "a good thing", "x") for i in range(100)]
    rows += [(1, "you bad thing", "x"), (None, None, None), (300, "", "x"), (301, "Bad " + "é日 thing " * 60_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("evidence", toxicity.F.lit(1)).withColumn("term", toxicity.F.lit(1))
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (5, None), (6, 7)], "doc_id long, toxic int")
    model, _ = toxicity.fit_toxicity(docs, labels)
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "term", "score", "evidence", "predicted"}
    by = {r.doc_id: r for r in got}
    assert by[301].predicted == 1 and by[300].score < by[301].score and by[None].score == by[300].score
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    for some in (labels.limit(0), labels.filter("toxic = 1")):
        flat, _ = toxicity.fit_toxicity(docs, some)
        assert len({r.score for r in toxicity.score_toxicity(docs, flat).collect()}) == 1
    none, vectors = toxicity.fit_toxicity(docs.limit(0), labels)
    assert toxicity.score_vectors(vectors, none).count() == 0
    assert materialize(toxicity.score_toxicity(docs.limit(0), model), "t").count() == 0
