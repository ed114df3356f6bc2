"""Order-dependent statistics: deduplication, running sums, p-value corrections, curves, top k.

A window without partition would pull all rows into one task. ``running`` computes running sums over
one global order in two steps instead: rows are aggregated by the order's value (ties form one step),
values are cut into ranges by approximate quantiles, each range is summed in its own task, and the
totals of the few ranges before are added. Defined results: null order values are left out; ties are
one step where values are aggregated, and fall to the given tie-break columns elsewhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalspan.functions.columns import pearson, r6, ratio

RANGES = 256


def pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in an order, by an aggregate that combines before the shuffle (a hot key costs one row per task)."""
    row = F.struct(*df.columns)
    best = df.groupBy(*keys).agg(F.min_by(row, F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))).alias("r"))
    return best.select("r.*")


def running(df: DataFrame, order: str, sums: dict[str, Column], ranges: int = RANGES) -> DataFrame:
    """One row per value of ``order`` with its own sums (name) and those up to it (cum_name)."""
    steps = df.filter(F.col(order).isNotNull()).groupBy(order).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    bounds = steps.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    cuts = sorted(set(bounds))
    cut = F.lit(0)
    if cuts:
        at = F.array(*map(F.lit, cuts))
        cut = F.size(F.filter(at, lambda x: x < F.col(order)))
    placed = steps.withColumn("__range", cut)
    totals = placed.groupBy("__range").agg(*(F.sum(n).alias(f"t_{n}") for n in sums))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # at most ``ranges`` rows
    offsets = totals.select(F.col("__range").alias("__r"), *(F.coalesce(F.sum(f"t_{n}").over(before), F.lit(0)).alias(f"b_{n}") for n in sums))
    inside = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(offsets), F.col("__range") == F.col("__r"))
    return out.select(order, *sums, *((F.sum(n).over(inside) + F.col(f"b_{n}")).alias(f"cum_{n}") for n in sums))


def running_accuracy_error(df: DataFrame, confidence: str, correct: str) -> DataFrame:
    """Mean distance of a confidence from the accuracy of all rows up to it, in ascending order of confidence (ties are one step)."""
    steps = running(df, confidence, {"n": F.lit(1), "hits": F.col(correct).cast("double")})
    gap = F.abs(F.col(confidence) - F.col("cum_hits") / F.col("cum_n"))
    return steps.agg(F.sum("n").alias("n"), r6(F.sum(gap * F.col("n")) / F.sum("n")).alias("static_error"))


def corrections(df: DataFrame, test: str, p: str, family: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Bonferroni, Holm and Benjamini-Hochberg adjusted p-values within each family of tests.

    A family is a set of tests made together; its rows meet in one task, as its size is that of an experiment plan.
    """
    keys = list(family)
    every, up = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(p, test)
    n, i = F.count(p).over(every), F.row_number().over(up) - 1
    base = df.filter(F.col(p).isNotNull()).select("*", n.alias("__n"), i.alias("__i"))
    upto = up.rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy(F.desc(p), F.desc(test)).rowsBetween(Window.unboundedPreceding, 0)
    holm = F.max(F.least(F.lit(1.0), F.col(p) * (F.col("__n") - F.col("__i")))).over(upto)
    bh = F.least(F.lit(1.0), F.min(F.col(p) * F.col("__n") / (F.col("__i") + 1)).over(down))
    bonferroni = F.least(F.lit(1.0), F.col(p) * F.col("__n"))
    return base.select(*keys, test, r6(F.col(p)).alias("p"), r6(bonferroni).alias("bonferroni"), r6(holm).alias("holm"), r6(bh).alias("bh"), (bh < alpha).alias("bh_significant"))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per key; each task keeps k rows per key before the shuffle (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def trapezoid(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Area under (x, y) points in order of (x, y) per key; 1 for fewer than two points. Points are few: thresholds of a curve."""
    w = Window.partitionBy(*keys).orderBy(x, y)
    part = df.select(*keys, ((F.col(y) + F.lag(y).over(w)) / 2 * (F.col(x) - F.lag(x).over(w))).alias("a"))
    return part.groupBy(*keys).agg(r6(F.when(F.count("*") < 2, 1.0).otherwise(F.sum("a"))).alias("area"))


def trimmed_correlation(df: DataFrame, keys: Sequence[str], x: str, y: str, trim: float) -> DataFrame:
    """Squared correlation without floor(trim n) rows at either end of the order of x; ties at a cut fall out by value counts.

    Positions come from running counts of the values of x, so rows with the same x share their fate only
    at the cut, where the least y go first.
    """
    w = Window.partitionBy(*keys).orderBy(x, y)
    ranked = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y, F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy(*keys)).alias("n"))
    cut = F.floor(F.col("n") * trim)
    kept = ranked.filter((F.col("i") > cut) & (F.col("i") <= F.col("n") - cut))
    return kept.groupBy(*keys).agg(F.count("*").alias("n"), r6(F.pow(pearson(F.col(x), F.col(y)), F.lit(2.0))).alias("r2"))


def step_ratio(df: DataFrame, cost: str, gain: str, name: str) -> DataFrame:
    """Each point of a frontier against the next dearer one: gain per cost."""
    w = Window.orderBy(cost, name)  # a frontier, not a table
    nxt = lambda c: F.lead(c).over(w)
    j = df.select(name, cost, gain, nxt(name).alias("next"), (nxt(gain) - F.col(gain)).alias("dg"), (nxt(cost) - F.col(cost)).alias("dc")).filter("next is not null")
    return j.select(name, "next", r6(F.col("dg")).alias("gain"), r6(F.col("dc")).alias("cost"), r6(ratio(F.col("dg"), F.col("dc"), None)).alias("gain_per_cost"))
