"""Exact duplicates by distributed most-significant-digit radix partitioning.

A text is the string of its length (the most significant digit) and its UTF-8 bytes. Each round splits every
group that still has several members by the next run of bytes; a group that is single is unique, a group whose
bytes have ended is a class of equal texts. The digits widen eightfold from round to round, so the number of
rounds is logarithmic in the longest text, and only members of unsplit groups carry their remaining bytes on.
The corpus is read and normalised once, into a table whose rows have numbers; later steps refer to rows by these.
No digest decides equality; SHA-256 is an output column only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS_CLASS, discard, materialize, small_side

#: Bytes of the first digit (beside the length), and by how much digits widen.
FIRST_DIGIT, WIDEN = 24, 8


def normalised(text) -> F.Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{WS_CLASS}+", " ")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_digit: int = FIRST_DIGIT, widen: int = WIDEN
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white-space runs become one space; null counts as empty. The row with
    the smallest id of a class stays. Rows that repeat an id and a text all carry keep_id and count as kept;
    a null id sorts after all others, so it stays only in a class without ids (keep_id null, kept true). Other
    columns of docs are not read, whatever their names. An empty table gives an empty table.
    """
    text = normalised(F.col(text_col)).cast("binary")
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("b"))
    base = materialize(
        source.select(
            F.monotonically_increasing_id().alias("rid"),
            "doc_id",
            F.sha2("b", 256).alias("text_sha256"),
            F.octet_length("b").alias("len"),
            F.substring("b", 1, first_digit).alias("digit"),
            F.expr(f"substring(b, {first_digit + 1})").alias("rest"),
        ),
        "radix-base",
    )
    rows = base.count()
    groups = base.groupBy("len", "digit").agg(F.min("rid").alias("gid"), F.count("*").alias("n")).filter("n > 1")
    in_groups = base.select("rid", "len", "digit").join(groups, ["len", "digit"]).select("rid", "len", "gid")
    open_rows = materialize(in_groups, "radix-open", most=24 * rows)
    ended = [open_rows.filter(F.col("len") <= first_digit).select("rid", "gid")]
    longer = open_rows.filter(F.col("len") > first_digit).select("rid", "gid")
    n_longer = longer.count()
    state = None
    if n_longer:
        state = materialize(base.select("rid", "rest").join(small_side(longer, n_longer, 40), "rid"), "radix-rest")
    width, finished = first_digit, []
    while state is not None:
        width *= widen
        step = state.select("rid", "gid", F.expr(f"substring(rest, 1, {width})").alias("digit"), "rest")
        split = step.groupBy("gid", "digit").agg(F.min("rid").alias("new_gid"), F.count("*").alias("n")).filter("n > 1")
        kept = materialize(
            step.join(split, ["gid", "digit"]).select(
                "rid", F.col("new_gid").alias("gid"), F.expr(f"substring(rest, {width + 1})").alias("rest")
            ),
            "radix-rest",
        )
        discard(state)
        done = F.octet_length("rest") == 0
        ended.append(kept.filter(done).select("rid", "gid"))
        finished.append(kept)
        state = kept.filter(~done)
        if state.isEmpty():
            state = None
    classes = ended[0]
    for more in ended[1:]:
        classes = classes.union(more)
    named = base.select("rid", "doc_id", "text_sha256").join(classes, "rid", "left")
    labelled = materialize(named.select("doc_id", "text_sha256", "gid"), "radix-labelled", most=100 * rows)
    for used in (open_rows, base, *finished):
        discard(used)
    single = labelled.filter("gid IS NULL").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    several = labelled.filter("gid IS NOT NULL")
    sizes = several.groupBy("gid").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    of_several = several.join(sizes, "gid").select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")
    return single.union(of_several)
