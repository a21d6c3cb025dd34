"""Licence scan by canonical digest: entire texts, and single lines of notice, looked up by hash. DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .licence_texts import FULL_TEXTS, LICENCES

#: Equivalent spellings, applied in this order to the canonical words. Fixed values of the matching rules.
SPELLINGS = (
    (r"\blicence", "license"),
    (r"\blicencing\b", "licensing"),
    (r"\bnon commercial\b", "noncommercial"),
    (r"\bsub license\b", "sublicense"),
    (r"\bcopyright owner\b", "copyright holder"),
    (r"\bcopyright owners\b", "copyright holders"),
    (r"\bmerchantibility\b", "merchantability"),
    (r"\bwilful\b", "willful"),
    (r"\bhttps\b", "http"),
    (r"\bversion (?=[0-9])", "v "),
    (r"\bgnu general public license\b", "gpl"),
)
#: A line that only says who holds the copyright.
COPYRIGHT_LINE = r"^[^\p{L}\p{N}\n]*(?:copyright|\(c\)|©)(?:[^\p{L}\p{N}\n]|\(c\)|©|copyright)*(?:[0-9<\[{]|by )[^\n]*$"
#: Canonical words that a notice starts with where it shares its line with the copyright.
NOTICE_START = r" (?=(?<!\bnot )(?:all rights reserved|(?:this work is )?licensed under|released (?:under|into)|spdx license identifier)\b)"
#: Of these a line has one in any spelling if a text of LICENCES does; other lines aren't digested.
NOTICE_WORD = r"licen[sc]|rights|copyright|domain|permission|warranty"


def notice_word(licences: dict[str, list[str]]) -> str:
    """Pattern of the lines to digest: NOTICE_WORD if each of the texts has one of its words, else any line."""
    return NOTICE_WORD if all(re.search(NOTICE_WORD, text.lower()) for texts in licences.values() for text in texts) else ""


def canonical(text) -> F.Column:
    """Lower case, without copyright lines and punctuation, one space between words, equivalent spellings made one."""
    return _words(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "(?md)" + COPYRIGHT_LINE, " "))


def _words(lowered) -> F.Column:
    return _spell(F.trim(F.regexp_replace(lowered, r"[^\p{L}\p{N}]+", " ")))


def _spell(out) -> F.Column:
    rewritten = out
    for pattern, word in SPELLINGS:
        rewritten = F.regexp_replace(rewritten, pattern, word)
    # Texts without a word that a spelling rule starts from are as they are.
    return F.when(out.rlike(r"licen|non commercial|copyright own|merchantib|wilful|https|version [0-9]|gnu general"), rewritten).otherwise(out)


def canonical_digest(text) -> F.Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def line_digests(line) -> F.Column:
    """Digests of a line's notices: of the line, or of each notice that follows the holder on a copyright line."""
    low = F.lower(line)
    notices = F.slice(F.split(_words(low), NOTICE_START), 2, 1 << 30)
    rest = F.transform(notices, lambda x: F.sha2(x.cast("binary"), 256))
    return F.when(low.rlike("(?md)" + COPYRIGHT_LINE), rest).otherwise(F.array(canonical_digest(line)))


def known_digests(spark: SparkSession, licences: dict[str, list[str]] = LICENCES, full: dict[str, list[str]] = FULL_TEXTS) -> DataFrame:
    """(licence_id, licence_digest) of the known texts, and of long ones known by digest; of a size fixed by the parameters."""
    rows = [(name, text) for name, texts in licences.items() for text in texts]
    df = spark.createDataFrame(rows, "licence_id string, t string")
    df = df.select("licence_id", canonical_digest(F.col("t")).alias("licence_digest"))
    if full:
        df = df.union(spark.createDataFrame([(name, x) for name, digests in full.items() for x in digests], df.schema))
    return df.groupBy("licence_digest").agg(F.min("licence_id").alias("licence_id"))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", licences: dict[str, list[str]] = LICENCES, full: dict[str, list[str]] = FULL_TEXTS) -> DataFrame:
    """A row per row of docs: doc_id, text_digest, licence_id, notice_ids, restricted.

    text_digest is the SHA-256 of the canonical entire text, licence_id the known licence whose canonical text it
    is (null: none). notice_ids are the known licences that a line of the text, or a copyright line after its holder,
    states, ascending; restricted is
    true if any of all these forbids commercial use, asks for the same licence or reserves all rights. Null counts
    as the empty text, which is no licence. Repeated rows come back each; other columns are not read; an empty
    table gives an empty table. The known digests are broadcast: they are a fixed list.
    """
    spark = docs.sparkSession
    known = known_digests(spark, licences, full)
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"(?i){notice_word(licences)}"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        canonical_digest(text).alias("text_digest"),
        F.flatten(F.transform(lines, line_digests)).alias("line_digests"),
    )
    # The lookup of lines is the same hash lookup as a literal map: the list is fixed, and documents need not be regrouped.
    pairs = [F.lit(x) for row in known.orderBy("licence_digest").collect() for x in (row.licence_digest, row.licence_id)]
    table = F.create_map(*pairs)
    rows = rows.join(F.broadcast(known), rows["text_digest"] == known["licence_digest"], "left")
    found = F.transform("line_digests", lambda d: F.try_element_at(table, d))
    notices = F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))
    rows = rows.select("doc_id", "text_digest", "licence_id", notices.alias("notice_ids"))
    restricted = RESTRICTED + RESTRICTED_FULL
    strict = F.array(*[F.lit(x) for x in restricted])
    return rows.withColumn(
        "restricted", F.arrays_overlap("notice_ids", strict) | F.coalesce(F.col("licence_id").isin(*restricted), F.lit(False))
    )


#: Of LICENCES, those that forbid commercial use, ask for the same licence or reserve all rights.
RESTRICTED = ("AGPL-3.0", "All-Rights-Reserved", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-SA-4.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0")
#: Of FULL_TEXTS alone, those that ask for the same licence.
RESTRICTED_FULL = ("GFDL-1.2", "GFDL-1.3", "GPL-1.0", "LGPL-2.0", "LGPL-2.1", "MPL-1.1", "MPL-2.0")


def oracle_sql(licences: dict[str, list[str]] = LICENCES) -> str:
    """The same rows in DuckDB SQL."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def canon(x: str) -> str:
        out = f"regexp_replace(lower({x}), {quoted('(?m)' + COPYRIGHT_LINE)}, ' ', 'g')"
        out = f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        for pattern, word in SPELLINGS:
            if "(?=" in pattern:  # no look-ahead here
                pattern, word = pattern.replace("(?=[0-9])", "([0-9])"), word + "\\1"
            out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(word)}, 'g')"
        return out

    values = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, texts in licences.items() for text in texts)
    strict = ", ".join(map(quoted, RESTRICTED))
    return f"""
WITH known AS (SELECT sha256({canon('t')}) AS h, min(i) AS licence_id FROM (VALUES {values}) AS k(i, t) GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
hits AS (SELECT doc_id, list_sort(list(DISTINCT licence_id)) AS notice_ids FROM lines JOIN known ON sha256({canon('line')}) = h
         WHERE regexp_matches(line, {quoted('(?i)' + notice_word(licences))}) GROUP BY doc_id),
texts AS (SELECT doc_id, sha256({canon("coalesce(text, '')")}) AS text_digest FROM documents)
SELECT t.doc_id, t.text_digest, k.licence_id, coalesce(n.notice_ids, CAST([] AS VARCHAR[])) AS notice_ids,
       list_has_any(coalesce(n.notice_ids, CAST([] AS VARCHAR[])), [{strict}]) OR coalesce(k.licence_id IN ({strict}), false) AS restricted
FROM texts t LEFT JOIN known k ON t.text_digest = k.h LEFT JOIN hits n ON t.doc_id = n.doc_id
"""
