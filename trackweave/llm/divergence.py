"""Source divergence audit: how the sources of a language differ in their use of its common terms, relationally.

Terms are exploded once with their documents' distinct terms beside them, so one aggregate gives both the occurrences
and the documents of each (lang, source, term). Groups are crossed with their language's kept terms, so that a term a
group lacks counts as zero there; pairs of sources meet in a self-join on language and term. Probabilities are whole
parts of SCALE and all arithmetic is on integers, so no order of summing shows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_side

#: A term is a run of ASCII letters and characters from U+0080 on; A-Z are lower-cased.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Probabilities are counted in parts of this; SMOOTH is added to each count.
SCALE, SMOOTH = 1_000_000_000, 5
#: Bytes of a (lang, source) group where it is broadcast, besides those of its names.
ROW_BYTES = 64


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group and documents of it that have the term."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    rows = docs.select(_or_empty(lang_col).alias("lang"), _or_empty(source_col).alias("source"), F.regexp_extract_all(text, F.lit(TERM), 0).alias("all"))
    both = rows.select("lang", "source", F.posexplode(F.array("all", F.array_distinct("all"))).alias("once", "terms"))
    each = both.select("lang", "source", "once", F.explode("terms").alias("term"))
    return each.groupBy("lang", "source", "term").agg(F.count_if(F.col("once") == 0).alias("n"), F.count_if(F.col("once") == 1).alias("docs"))


def _or_empty(name: str) -> F.Column:
    return F.coalesce(F.col(name), F.lit(""))


def share(n: str, total: str, terms: str) -> F.Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms)), exact for any long."""
    return (F.expr(f"({SCALE}BD * CAST({n} + {SMOOTH} AS DECIMAL(20,0))) div CAST({total} + {SMOOTH} * {terms} AS DECIMAL(20,0))") + 1).cast("long")


def divergence(
    docs: DataFrame,
    min_docs: int = 30,
    top: int = 50,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """lang, source, part, item, value, rank: for each group (lang, source), part "pair": each other source of the
    language with the sum of the differences of their term probabilities; part "term": the `top` terms that it uses more
    than its language does, with the difference.

    Kept are terms that at least min_docs documents of the language have. Ranks begin at 1 in each group and part, by
    value descending, then by the item's bytes. Null texts, languages and sources count as empty strings, which are
    values like any other; a group without terms has its pairs; where a language keeps no term all pairs have value 0.
    A repeated document counts each time. Other columns are ignored. An empty table gives an empty table.
    """
    groups = materialize(docs.select(_or_empty(lang_col).alias("lang"), _or_empty(source_col).alias("source")).distinct(), "divergence-groups")
    counts = materialize(term_counts(docs, lang_col, source_col, text_col), "divergence-counts")
    n, letters = groups.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("lang") + F.octet_length("source")), F.lit(0))).first()
    size = n * ROW_BYTES + letters  # a language has a group at least, so this bounds the languages too

    per_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    vocabulary = materialize(per_lang.filter(F.col("docs") >= min_docs).drop("docs"), "divergence-terms")
    sizes = small_side(vocabulary.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("terms")), 1, size)
    own = counts.select("lang", "source", "term", "n").join(vocabulary.select("lang", "term"), ["lang", "term"])
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    known = small_side(groups.join(totals, ["lang", "source"], "left").fillna(0, ["total"]), 1, size)
    dense = vocabulary.join(known, "lang").join(own, ["lang", "source", "term"], "left")
    dense = dense.join(sizes, "lang").withColumn("n", F.coalesce("n", F.lit(0)))
    dense = dense.select(
        "lang", "source", "term", "n", share("n", "total", "terms").alias("p"), share("lang_n", "lang_total", "terms").alias("q")
    )
    dense = materialize(dense, "divergence-shares")

    one = dense.select("lang", "term", "source", "p")
    other = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("other"))
    sums = one.join(other, ["lang", "term"]).filter("source < item").groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("other"))).alias("value"))
    sums = sums.union(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    terms = dense.filter("n > 0 AND p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    first = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).union(first)


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
v AS (SELECT lang, term, count(*) AS ln FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
x AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, v.ln FROM g JOIN v ON g.lang = v.lang
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS tot, sum(n) OVER (PARTITION BY lang) AS ltot,
             (SELECT count(*) FROM v AS k WHERE k.lang = x.lang) AS terms FROM x),
p AS (SELECT lang, source, term, n, CAST(1 + ({SCALE}::HUGEINT * (n + {SMOOTH})) // (tot + {SMOOTH} * terms) AS BIGINT) AS p,
             CAST(1 + ({SCALE}::HUGEINT * (ln + {SMOOTH})) // (ltot + {SMOOTH} * terms) AS BIGINT) AS q FROM s),
m AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value
      FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term WHERE a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(m.value, 0) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= 50
"""
