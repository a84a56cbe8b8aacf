"""Exact quantiles of groups of any size: by repeated histograms that narrow the interval of each wanted rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpoint

#: Values of a group up to which one task's buffer takes them (Spark's percentile), bins of a histogram, and values that are sorted at the end.
BUFFER, BINS, FEW = 1_000_000, 4096, 50_000


def magnitude(v: str) -> Column:
    """A number that grows with v, by one for each doubling on either side of 0 (1075: below the least exponent of a double)."""
    return F.when(F.col(v) == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.log2(F.abs(F.col(v))) + 1075))


def quantiles_of_groups(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], buffer: int = BUFFER, few: int = FEW) -> DataFrame:
    """keys and q0, q1, ...: the interpolated quantiles of each group's finite values, equal to percentile(); without such values null.

    If all groups are of `buffer` values at most, percentile() itself. Else each pass counts the values in the bins of each wanted rank's interval,
    with partial sums before the shuffle, and goes on with the bin that holds the rank and the values that it really spans, until a bin has `few` values
    or one value only; bins are even by turns in the values and in their magnitudes, so that values of all sizes are told apart soon. No task holds a group's values. Rows with a null key are left out; no keys: one row for all.
    """
    names = list(keys) or ["_all"]
    given = df if keys else df.withColumn("_all", F.lit(0))
    v = F.col(value).cast("double")
    base = given.where(" AND ".join(f"`{k}` IS NOT NULL" for k in names)).select(*names, F.when(F.abs(v) < float("inf"), v).alias("_v"))
    sizes = checkpoint(base.groupBy(*names).agg(F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    made = [f"q{i}" for i in range(len(probs))]
    if (sizes.agg(F.max("n")).first()[0] or 0) <= buffer:
        return base.groupBy(*names).agg(*(F.percentile("_v", float(p)).alias(q) for p, q in zip(probs, made, strict=True))).select(*keys, *made)
    base = base.where("_v IS NOT NULL")
    # position p * (n - 1): between the ranks below and above it
    wanted = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs))))
    places = sizes.where("n > 0").select(*names, "n", "lo", "hi", wanted.alias("w")).select(*names, "n", "lo", "hi", "w.i", (F.col("w.p") * (F.col("n") - 1)).alias("at"))
    ranks = places.select(*names, "n", "lo", "hi", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    found = checkpoint(ranks.select(*names, "rank", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("held")))
    wide = (F.col("held") > few) & (F.col("lo") < F.col("hi"))
    turn = 0
    while found.where(wide).limit(1).count():
        spans = found.where(wide).select(*names, "lo", "hi").distinct()
        even = (F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves: the difference of two doubles can be too large
        share = even if turn % 2 == 0 else F.when(magnitude("hi") > magnitude("lo"), (magnitude("_v") - magnitude("lo")) / (magnitude("hi") - magnitude("lo"))).otherwise(even)
        turn += 1
        bins = base.join(spans, names).where("_v BETWEEN lo AND hi").groupBy(*names, "lo", "hi", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin"))
        counts = bins.agg(F.count("*").alias("c"), F.min("_v").alias("l"), F.max("_v").alias("h"))
        upto = Window.partitionBy(*names, "lo", "hi").orderBy("bin")
        counts = counts.withColumn("before", F.sum("c").over(upto) - F.col("c"))
        start = F.col("below") + F.col("before")
        inner = found.where(wide).join(counts, [*names, "lo", "hi"]).where((start <= F.col("rank")) & (F.col("rank") < start + F.col("c")))
        found = checkpoint(found.where(~wide).unionByName(inner.select(*names, "rank", F.col("l").alias("lo"), F.col("h").alias("hi"), start.alias("below"), F.col("c").alias("held"))))
    # what is left of each rank is one value, or few
    some = found.where("lo < hi")
    lists = base.join(some.select(*names, "lo", "hi").distinct(), names).where("_v BETWEEN lo AND hi").groupBy(*names, "lo", "hi").agg(F.array_sort(F.collect_list("_v")).alias("all"))
    chosen = found.where("lo = hi").select(*names, "rank", F.col("lo").alias("v")).unionByName(some.join(lists, [*names, "lo", "hi"]).select(*names, "rank", F.expr("all[int(rank - below)]").alias("v")))
    side = lambda to, as_: places.join(chosen, names).where(F.col("rank") == to).select(*names, "i", "at", F.col("v").alias(as_))
    both = side(F.floor("at"), "a").join(side(F.ceil("at"), "b").drop("at"), [*names, "i"])
    between: Column = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil("at") - F.col("at")) * F.col("a") + (F.col("at") - F.floor("at")) * F.col("b"))
    out = both.withColumn("q", between).groupBy(*names).agg(*(F.max(F.when(F.col("i") == i, F.col("q"))).alias(q) for i, q in enumerate(made)))
    return sizes.select(*names).join(out, names, "left").select(*keys, *made)
