"""Exact values at given ranks of groups of any size, without holding a group in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stable import checkpoint

#: Bins that an interval is counted in, and values that may be sorted together at the end.
BINS, SMALL = 512, 4096


def select_ranks(rows: DataFrame, keys: list[str], value: str, ranks: Callable[[Column], list[Column]]) -> DataFrame:
    """``keys``, ``n`` and ``at``, a map from each of the ranks (0 for the least) to its value.

    ``ranks`` gives the wanted ranks from the number ``n`` of a group's values; null and NaN values and null keys are left out, and groups
    without another one give no row. Every wanted rank has an interval that holds its value, at first from the group's least to
    its greatest. A round counts the values of all open intervals of all groups in BINS bins and goes on with the bin of the
    rank, from its least to its greatest value, until an interval holds one value or SMALL occurrences; these are sorted. The
    rows of a group are read where they lie, only counts of bins are shuffled, and equal values end together however many. Three rounds do for even
    values; where they spread over many orders of magnitude, each round takes the next orders."""
    v = F.col(value).cast("double")
    base = rows.select(*keys, v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    for k in keys:
        base = base.where(F.col(k).isNotNull())
    stats = base.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = F.explode(F.array_distinct(F.array(*[r.cast("long") for r in ranks(F.col("n"))])))
    state = checkpoint(stats.select(*keys, "n", wanted.alias("k"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("size")))
    interval = [*keys, "lo", "hi"]

    def inside(some: DataFrame) -> DataFrame:
        """The values within the intervals of ``some``; those of a group are as few as its ranks."""
        held = some.select(*interval).distinct().groupBy(*keys).agg(F.collect_list(F.struct("lo", "hi")).alias("held"))
        met = F.explode(F.filter("held", lambda t: (F.col("v") >= t["lo"]) & (F.col("v") <= t["hi"]))).alias("t")
        return base.join(held, keys).select(*keys, "v", met).select(*keys, "v", "t.lo", "t.hi")

    going = (F.col("lo") < F.col("hi")) & (F.col("size") > SMALL)
    while not state.where(going).isEmpty():
        part = F.try_divide(F.col("v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2) * BINS  # halves, as hi - lo may overflow
        part = F.coalesce(part, (F.col("v") > F.col("lo")).cast("double"))
        bins = inside(state.where(going)).groupBy(*interval, F.floor(part).alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("first"), F.max("v").alias("last"))
        upto = bins.withColumn("upto", F.sum("c").over(Window.partitionBy(*interval).orderBy("bin")))
        rank = F.col("k") - F.col("below")
        found = state.where(going).join(upto, interval).where((rank >= F.col("upto") - F.col("c")) & (rank < F.col("upto")))
        found = found.select(*keys, "n", "k", F.col("first").alias("lo"), F.col("last").alias("hi"), (F.col("below") + F.col("upto") - F.col("c")).alias("below"), F.col("c").alias("size"))
        state = checkpoint(state.where(~going).unionByName(found))
    few = inside(state.where("lo < hi")).groupBy(*interval).agg(F.sort_array(F.collect_list("v")).alias("sorted"))
    one = F.coalesce(F.element_at("sorted", (F.col("k") - F.col("below") + 1).cast("int")), F.col("lo"))
    picked = state.join(few, interval, "left").select(*keys, "n", "k", one.alias("value"))
    return picked.groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("at"))


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], name: str = "q") -> DataFrame:
    """``keys`` and the array ``name`` of the exact quantiles, between two values in proportion."""
    place = lambda n, q: (n - 1) * F.lit(float(q))
    got = select_ranks(rows, keys, value, lambda n: [f(place(n, q)) for q in shares for f in (F.floor, F.ceil)])

    def one(q):
        at = place(F.col("n"), q)
        low, high = F.col("at")[F.floor(at)], F.col("at")[F.ceil(at)]
        return low + (high - low) * (at - F.floor(at))

    return got.select(*keys, F.array(*map(one, shares)).alias(name))
