"""Grouped statistics of scores: conditional aggregates, grouping sets, pivots, quantiles.

All of them combine before the shuffle and give one row per group. Defined results: an empty table
gives no group (a global aggregate one row with count 0 and null means); null scores are left out of
means and counted in row counts; a standard deviation of fewer than two values is 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspan.functions.columns import r6, ratio, std0


def conditional_stats(df: DataFrame, keys: Sequence[str], scores: Sequence[str], success: Column, flags: dict[str, Column]) -> DataFrame:
    """Rows, successes, means over successes and counts of flags per group."""
    means = [r6(F.avg(F.when(success, F.col(s)))).alias(f"mean_{s}") for s in scores]
    counts = [F.count_if(c).alias(f"n_{name}") for name, c in flags.items()]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(success).alias("n_success"), *means, *counts)


def stat_block(score: str) -> list[Column]:
    """n, mean, sample deviation, minimum, maximum of a score."""
    c = F.col(score)
    return [F.count(c).alias("n"), r6(F.avg(c)).alias("mean"), r6(std0(c)).alias("std"), r6(F.min(c)).alias("min"), r6(F.max(c)).alias("max")]


def grouping_set_stats(df: DataFrame, sets: Sequence[Sequence[str]], aggregates: Sequence[Column]) -> DataFrame:
    """Several groupings in one pass; ``level`` names the grouping, absent keys are null."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, columns))
    gid = F.grouping_id(*map(F.col, columns))
    # Bits of grouping_id: 1 where a column is not part of the set.
    width = len(columns)
    value = {sum(1 << (width - 1 - i) for i, c in enumerate(columns) if c not in s): ("+".join(s) or "overall") for s in map(tuple, sets)}
    names = reduce(lambda acc, kv: acc.when(gid == kv[0], kv[1]), value.items(), F)
    return grouped.agg(names.alias("level"), *aggregates)


def unpivot_scores(df: DataFrame, keys: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """Long form (keys, metric, value) without null values."""
    return df.unpivot([F.col(k) for k in keys], [F.col(s) for s in scores], "metric", "value").filter("value is not null")


def best_group(df: DataFrame, keys: Sequence[str], group: str, value: str, largest: bool = True) -> DataFrame:
    """Group with the best mean per key; equal means fall to the least name."""
    means = df.groupBy(*keys, group).agg(F.avg(value).alias("m"))
    signed = F.col("m") if largest else -F.col("m")
    rank = F.min_by(group, F.struct((-r6(signed)).alias("a"), F.col(group).alias("b")))
    out = means.groupBy(*keys) if keys else means.groupBy()
    return out.agg(rank.alias("best"), r6(F.max("m") if largest else F.min("m")).alias("best_mean"))


def exclusive_quantiles(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles by the exclusive method: position q (n + 1), linear between neighbours, least and greatest value below four rows.

    Only the order statistics next to the three positions are needed; ``percentile`` gives them without
    collecting a group: order statistic k of n is the linear percentile at (k - 1) / (n - 1).
    """
    rows = df.filter(F.col(value).isNotNull())
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    # Value counts keep the second pass small; they meet their group's size by key.
    counts = rows.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys).orderBy("v")
    ranked = counts.withColumn("last", F.sum("c").over(w)).withColumn("first", F.col("last") - F.col("c") + 1)
    joined = ranked.join(sizes, list(keys))

    def at(k: Column) -> Column:
        return F.max(F.when((F.col("first") <= k) & (k <= F.col("last")), F.col("v")))

    out = []
    for q, name in ((0.25, "q25"), (0.5, "median"), (0.75, "q75")):
        pos = (F.col("n") + 1) * q
        low = F.least(F.greatest(F.floor(pos), F.lit(1)), F.col("n") - 1)
        out.append((name, at(low), at(low + 1), F.max(pos - low)))
    agg = joined.groupBy(*keys).agg(F.max("n").alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi"), *(c for name, a, b, d in out for c in (a.alias(f"{name}_a"), b.alias(f"{name}_b"), d.alias(f"{name}_d"))))
    value_of = lambda name: F.col(f"{name}_a") + (F.col(f"{name}_b") - F.col(f"{name}_a")) * F.col(f"{name}_d")
    small = {"q25": F.col("lo"), "q75": F.col("hi"), "median": (F.col("lo") + F.col("hi")) / 2}
    few = {**small, "median": F.when(F.col("n") == 3, F.col("median_a") + (F.col("median_b") - F.col("median_a")) * F.col("median_d")).otherwise(small["median"])}
    return agg.select(*keys, "n", *(r6(F.when(F.col("n") >= 4, value_of(x)).otherwise(few[x])).alias(x) for x in ("q25", "median", "q75")))


def linear_quantiles(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, mean, deviation, linear quartiles, standard error and normal interval."""
    from evalspan.functions.columns import z_quantile

    c = F.col(value)
    base = df.groupBy(*keys).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.percentile(c, [0.25, 0.5, 0.75]).alias("q"))
    se = F.coalesce(F.col("std"), F.lit(0.0)) / F.sqrt("n")
    z = z_quantile(0.975)
    q = lambda i: r6(F.get("q", F.lit(i)))
    return base.select(*keys, "n", r6(F.col("mean")).alias("mean"), r6(F.coalesce("std", F.lit(0.0))).alias("std"), q(0).alias("q25"), q(1).alias("median"), q(2).alias("q75"), r6(se).alias("se"), r6(F.col("mean") - z * se).alias("ci_low"), r6(F.col("mean") + z * se).alias("ci_high"))


def upper_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Element floor(n / 2) of the sorted values (the upper one of the middle two) and the population deviation."""
    from pyspark.sql.window import Window

    rows = df.filter(F.col(value).isNotNull())
    counts = rows.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    placed = counts.withColumn("n", F.sum("c").over(w)).withColumn("last", F.sum("c").over(w.orderBy("v")))
    middle = placed.filter(F.col("last") > F.floor(F.col("n") / 2)).groupBy(*keys).agg(F.min("v").alias("upper_median"))
    other = rows.groupBy(*keys).agg(F.count("*").alias("n"), r6(F.stddev_pop(value)).alias("std_pop"))
    return other.join(middle, list(keys)).select(*keys, "n", "std_pop", r6(F.col("upper_median")).alias("upper_median"))


def pivot_mean(df: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """Means with one column per given value of ``column``; absent cells are null."""
    return df.groupBy(row).pivot(column, list(columns)).agg(r6(F.avg(value)))


def lift_over(df: DataFrame, group: str, value: str, tested: str, higher_is_better: bool = True) -> DataFrame:
    """Mean of one group against the best of all others: lift (positive if better) and whether it exceeds a tenth."""
    means = df.groupBy(group).agg(F.avg(value).alias("m"))
    best = F.max if higher_is_better else F.min
    one = means.agg(F.max(F.when(F.col(group) == tested, F.col("m"))).alias("tested_mean"), best(F.when(F.col(group) != tested, F.col("m"))).alias("best_other_mean"))
    gain = (F.col("tested_mean") - F.col("best_other_mean")) * (1 if higher_is_better else -1)
    lift = ratio(gain, F.col("best_other_mean"), None)
    return one.select(r6(F.col("tested_mean")).alias("tested_mean"), r6(F.col("best_other_mean")).alias("best_other_mean"), r6(lift).alias("lift"), (F.abs(lift) > 0.10).alias("significant"))


def baseline_improvement(df: DataFrame, outer: str, group: str, value: str, baseline: str) -> DataFrame:
    """Percent change of every other group's mean against the baseline group, per outer key; only where that is positive."""
    means = df.groupBy(outer, group).agg(F.avg(value).alias("m"))
    base = means.filter(F.col(group) == baseline).select(F.col(outer).alias("o"), F.col("m").alias("b"))
    joined = means.filter(F.col(group) != baseline).join(base, F.col(outer).eqNullSafe(F.col("o"))).filter("b > 0")
    return joined.select(outer, group, r6(F.col("m")).alias("mean"), r6((F.col("m") - F.col("b")) / F.col("b") * 100).alias("improvement"))


def multi_label(df: DataFrame, labels: dict[str, Column], keep: Sequence[str]) -> DataFrame:
    """One row per row and label that holds: keep, label."""
    named = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in labels.items())))
    return df.select(*keep, F.explode(named).alias("label"))


def label_combinations(df: DataFrame, labels: dict[str, Column], keys: Sequence[str], k: int) -> DataFrame:
    """The k most frequent combinations of labels per group; equal counts fall to the least name."""
    from pyspark.sql.window import Window

    combo = F.array_join(F.array_sort(F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in labels.items())))), "+")
    counts = df.select(*keys, combo.alias("combination")).filter("combination <> ''").groupBy(*keys, "combination").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "combination"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def bucket_breakdown(df: DataFrame, bucket: Column, buckets: Sequence[str], value: str) -> DataFrame:
    """Count, mean and deviation for a fixed list of buckets, empty ones included."""
    found = df.groupBy(bucket.alias("b")).agg(F.count(value).alias("n"), r6(F.avg(value)).alias("mean"), r6(F.when(F.count(value) >= 2, F.stddev_samp(value))).alias("std"))
    names = df.sparkSession.createDataFrame([(i, b) for i, b in enumerate(buckets)], "position int, bucket string")
    return names.join(found, F.col("bucket") == F.col("b"), "left").select("position", "bucket", F.coalesce("n", F.lit(0)).alias("n"), "mean", "std")


def consistency(df: DataFrame, keys: Sequence[str], answer: Column, parsed: Column) -> DataFrame:
    """Runs, parse rate, distinct answers and 1 - (distinct - 1) / (n - 1); 1 for one run, 0 without any answer."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), r6(F.avg(F.when(parsed, 1.0).otherwise(0.0))).alias("parse_rate"), F.count(answer).alias("n_answers"), F.countDistinct(answer).alias("n_distinct"))
    value = F.when(F.col("n_answers") == 0, 0.0).when(F.col("n_answers") == 1, 1.0).otherwise(1 - (F.col("n_distinct") - 1) / (F.col("n_answers") - 1))
    return g.withColumn("consistency", r6(value))


def variant_sensitivity(df: DataFrame, key: str, variant: str, value: str) -> DataFrame:
    """Spread of the variants' means per key: best, worst, range, population variance, label."""
    from evalspan.functions.columns import ladder

    means = df.groupBy(key, variant).agg(F.avg(value).alias("m")).filter("m is not null")
    g = means.groupBy(key).agg(F.count("*").alias("n_variants"), F.max_by(variant, F.struct(r6(F.col("m")), F.col(variant))).alias("best"), F.min_by(variant, F.struct(r6(F.col("m")), F.col(variant))).alias("worst"), (F.max("m") - F.min("m")).alias("range"), F.var_pop("m").alias("variance"))
    return g.select(key, "n_variants", "best", "worst", r6(F.col("range")).alias("range"), r6(F.col("variance")).alias("variance"), r6(F.least(F.lit(1.0), 10 * F.col("variance"))).alias("sensitivity"), ladder(r6(F.col("range")), [(0.3, "high"), (0.1, "medium")], "low").alias("label"))


def pilot_size(df: DataFrame, group: str, value: str, a: str, b: str, low: int = 10, high: int = 50) -> DataFrame:
    """Rows per group for a two-group comparison at 5 % and 80 % power, from the pilot's pooled population deviation, clipped."""
    side = lambda name: F.when(F.col(group) == name, F.col(value))
    g = df.agg(F.avg(side(a)).alias("mean_a"), F.avg(side(b)).alias("mean_b"), F.var_pop(side(a)).alias("va"), F.var_pop(side(b)).alias("vb"))
    d = ratio(F.abs(F.col("mean_a") - F.col("mean_b")), F.sqrt((F.col("va") + F.col("vb")) / 2), 0.0)
    n = F.when(d > 0, F.ceil(2 * F.pow((1.96 + 0.84) / d, F.lit(2.0)))).otherwise(high)
    return g.select(r6(F.col("mean_a")).alias("mean_a"), r6(F.col("mean_b")).alias("mean_b"), r6(d).alias("effect"), F.greatest(F.lit(low), F.least(F.lit(high), n)).cast("bigint").alias("n_per_group"))
