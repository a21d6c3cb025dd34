"""Exact quantiles of groups of any size: histograms refined around the ranks sought, never a group's values in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialize

#: Parts of a range in a round, and values of a part that are few enough to be read in order.
BINS, FEW = 1024, 4096


def exact_quantiles(rows: DataFrame, value: str, at: dict[str, float], by: tuple[str, ...] = (), bins: int = BINS, few: int = FEW) -> DataFrame:
    """One row, or one for each group (by), with the quantiles `at` (name: share) of an expression, interpolated as `percentile` does.

    Each rank sought has a range of values that holds it. A round counts the values of that range in `bins` parts, with
    map-side sums, and the part with the rank is the next range, cut to its own least and largest value. A range of one
    value is the answer; one of `few` values or less is put in order. So a task holds `bins` counts or `few` values of a
    rank, whatever a group's size. A round narrows a range by the factor of bins at least; ranges of doubles end within
    some 200 rounds in the worst case (values spread over all exponents) and mostly within three. Nulls and NaN are
    left out; a group without values has nulls, as has an empty table without by.
    """
    keys = [f"k{i}" for i in range(max(1, len(by)))]
    base = rows.select(*[F.expr(b).alias(k) for b, k in zip(by or ("0",), keys)], F.expr(value).cast("double").alias("v"))
    every = base.select(*keys).distinct() if by else rows.sparkSession.range(1).select(F.lit(0).alias(keys[0]))
    base = base.filter("v IS NOT NULL AND NOT isnan(v)")
    held = [F.col(k).alias(f"s_{k}") for k in keys]  # keys of the side that a table is joined with
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in keys])
    inside = same & F.col("v").between(F.col("lo"), F.col("hi"))

    size = materialize(base.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "quantile-sizes")
    # Two ranks a share, counted from 0: below and above its place; what is before a range is counted once.
    places = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q")) for n, q in at.items()]))
    sought = size.withColumn("p", places).withColumn("place", F.col("p.q") * (F.col("n") - 1))
    ranks = sought.select(*keys, "lo", "hi", "n", F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank")).distinct().withColumn("before", F.lit(0).cast("long"))
    found: list[DataFrame] = []
    ranges = materialize(ranks, "quantile-ranges")
    while True:
        found.append(ranges.filter("lo = hi").select(*keys, "rank", F.col("lo").alias("v")))
        short = ranges.filter(f"lo < hi AND n <= {few}").select(*held, "rank", "before", "lo", "hi")
        ordered = base.join(short, inside).groupBy(*keys, "rank", "before", "lo").agg(F.sort_array(F.collect_list("v")).alias("vs"))
        found.append(ordered.select(*keys, "rank", F.expr("vs[int(rank - before)]").alias("v")))
        left = ranges.filter(f"lo < hi AND n > {few}")
        if left.isEmpty():
            break
        wide = left.select(*held, "rank", "before", "lo", "hi")
        # Wide ranges are halved first, since the width of one of the largest doubles is none; narrow ones aren't, since halves may be equal.
        share = F.expr("if(hi / 2 - lo / 2 > 1, (v / 2 - lo / 2) / (hi / 2 - lo / 2), (v - lo) / (hi - lo))")
        part = F.least(F.lit(bins - 1), F.floor(share * bins)).alias("part")
        counted = base.join(wide, inside).groupBy(*keys, "rank", "before", part)
        counted = counted.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "rank", "before").orderBy("part"))
        chosen = counted.withColumn("start", F.col("before") + upto - F.col("n")).filter("rank >= start AND rank < start + n")
        ranges = materialize(chosen.select(*keys, "lo", "hi", "n", "rank", F.col("start").alias("before")), "quantile-ranges")
    values = found[0]
    for more in found[1:]:
        values = values.union(more)
    values = values.select(*held, "rank", "v")
    pairs = sought.select(*keys, "p", "place").join(values, same & F.col("rank").between(F.floor("place"), F.ceil("place")))
    low = F.max(F.when(F.col("rank") == F.floor("place"), F.col("v")))
    high = F.max(F.when(F.col("rank") == F.ceil("place"), F.col("v")))
    ends = pairs.groupBy(*keys, "p.name", "place").agg(low.alias("a"), high.alias("b"))
    # The formula of percentile: both values weighted by their distance; one value if they are the same.
    ends = ends.withColumn("v", F.expr("CASE WHEN a = b THEN a ELSE (ceil(place) - place) * a + (place - floor(place)) * b END"))
    out = ends.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in at])
    return every.join(out.select(*held, *at), same, "left").select(*[F.col(k).alias(b) for k, b in zip(keys, by)], *at)
