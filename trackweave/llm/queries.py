"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, htmltext, licences, linededup, quality, radix, sentencepiece_scan, sessions, simhash, tokenids, toxicity, warc
from .common import table

PIECES, WORDS = "piece_bpe_32k.model", "word_bpe_49k.json"
END_ID = 2


def vocabulary(name: str) -> str:
    """Path of a vocabulary file, the same on every executor: in the folder TRACKWEAVE_TOKENIZERS names, or in public_tokenizers."""
    folder = os.environ.get("TRACKWEAVE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, decoded again: doc_id, n_pieces, ids_hash, decoded_sha256, round_trip."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = sentencepiece_scan.encode(docs, vocabulary(PIECES), decoded_col="decoded")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document: 64-bit fingerprints over three words, links within two bits."""
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_ids, n_items and containment of every document: benchmark items of which it has 0.8 of the five-word shingles."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text_digest, licence_id, notice_ids and restricted of every document."""
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; the model learns from the labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, read back from the archives written."""
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, manifest, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document: lines that ten documents have are dropped from all."""
    rows = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document."""
    return radix.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files written."""
    path = tokenids.write_token_ids(table(spark, sf_dir, "documents"), vocabulary(WORDS), END_ID)
    return tokenids.token_digests(spark, path)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return htmltext.main_text(table(spark, sf_dir, "pages"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value and rank: how each source's terms differ from other sources' and its language's.
    Nulls count as empty strings; ties go by the item's bytes; repeats count; an empty table gives no row."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of every document; the model learns from the labelled rows that
    aren't held out. Null and empty texts get the rate of examples without a telling term; repeats get equal scores."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, vectors = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_vectors(vectors, model)
    return scored.select(F.col("__tw_id").alias("doc_id"), toxicity.held_out("__tw_id").alias("held_out"), "score", "predicted", "evidence")


def op13_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """client_id, first_us, last_us, n_clicks, ids_crc32, n_merges and close_batch of every session of clicks. Clicks
    without an id, a client or a time are left out, and repeats of an id; an empty table gives no row."""
    return sessions.close_sessions(table(spark, sf_dir, "clicks"))


def queries():
    return {f.__name__: f for f in (
        op1_sentencepiece, op2_simhash, op3_decontaminate, op4_licences, op5_quality, op6_warc, op7_line_dedup, op8_exact_dedup, op9_token_ids, op10_main_text,
        op11_divergence, op12_toxicity, op13_sessions,
    )}


_KEY = r"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = {
    "op3_decontaminate": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4])) AS s FROM dw WHERE len(w) >= 5),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4])) AS s FROM bw WHERE len(w) >= 5),
bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1),
hit AS (SELECT doc_id, item_id, count(*) AS k FROM ds JOIN bs USING (s) GROUP BY 1, 2),
ok AS (SELECT doc_id, item_id, k / n AS c FROM hit JOIN bn USING (item_id) WHERE k / n >= 0.8 - 1e-12),
per AS (SELECT doc_id, list_sort(list(item_id)) AS item_ids, count(*) AS n_items, max(c) AS containment FROM ok GROUP BY 1)
SELECT d.doc_id, coalesce(p.item_ids, CAST([] AS BIGINT[])) AS item_ids, coalesce(p.n_items, 0) AS n_items, coalesce(p.containment, 0.0) AS containment
FROM documents d LEFT JOIN per p ON d.doc_id = p.doc_id
""",
    "op4_licences": licences.oracle_sql(),
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS last FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN last IS NOT NULL AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to
FROM m
""",
    "op7_line_dedup": f"""
WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT doc_id, i, line, translate({_KEY.format(x='line')}, '{_UPPER}', '{_LOWER}') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
    "op8_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
""",
    # Reads the markup that the given pages have: an article of blocks and <b>, five character references.
    "op10_main_text": r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?b>', '', 'g') AS body FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(body, '<[^>]*>'), lambda x: regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#x27;?', '''', 'g'), '&amp;?', '&', 'g')) AS parts FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM t
""",
    "op11_divergence": divergence.ORACLE,
    "op13_sessions": sessions.ORACLE,
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
