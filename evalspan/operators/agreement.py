"""Agreement of raters on items: (item, rater, score) rows.

Pairs of raters are joined on the item (a panel of raters is small, items may be many). Defined
results: null scores are no rating; items with one rating agree with themselves; an agreement that is
expected with certainty is 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspan.functions.columns import ladder, pearson, r6, ratio


def item_agreement(df: DataFrame, item: str, score: str) -> DataFrame:
    """Per item: ratings, range below 0.5 (exact), and whether a rounded score (half to even) has the majority."""
    votes = df.filter(F.col(score).isNotNull()).groupBy(item, F.bround(score).alias("vote")).agg(F.count("*").alias("c"), F.min(score).alias("lo"), F.max(score).alias("hi"))
    g = votes.groupBy(item).agg(F.sum("c").alias("n"), F.max("c").alias("top"), (F.max("hi") - F.min("lo")).alias("range"))
    return g.select(item, "n", (F.col("range") < 0.5).alias("exact"), (F.col("top") > F.col("n") / 2).alias("majority"))


def agreement_rates(df: DataFrame, item: str, score: str) -> DataFrame:
    return item_agreement(df, item, score).agg(F.count("*").alias("n_items"), r6(F.avg(F.col("exact").cast("double"))).alias("exact_rate"), r6(F.avg(F.col("majority").cast("double"))).alias("majority_rate"))


def rater_pairs(df: DataFrame, item: str, rater: str, score: str) -> DataFrame:
    """Correlation, Cohen's kappa of rounded scores, mean difference per pair of raters."""
    rows = df.filter(F.col(score).isNotNull()).groupBy(item, rater).agg(F.avg(score).alias("s"))
    a = rows.select(F.col(item).alias("i"), F.col(rater).alias("rater_a"), F.col("s").alias("sa"))
    b = rows.select(F.col(item).alias("j"), F.col(rater).alias("rater_b"), F.col("s").alias("sb"))
    j = a.join(b, (F.col("i") == F.col("j")) & (F.col("rater_a") < F.col("rater_b")))
    cells = j.groupBy("rater_a", "rater_b", F.bround("sa").alias("ca"), F.bround("sb").alias("cb")).agg(F.count("*").alias("c"))
    total = cells.groupBy("rater_a", "rater_b").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("c")).otherwise(0)).alias("same"))
    left = cells.groupBy("rater_a", "rater_b", F.col("ca").alias("k")).agg(F.sum("c").alias("na"))
    right = cells.groupBy("rater_a", "rater_b", F.col("cb").alias("k")).agg(F.sum("c").alias("nb"))
    expected = left.join(right, ["rater_a", "rater_b", "k"]).groupBy("rater_a", "rater_b").agg(F.sum(F.col("na") * F.col("nb")).alias("e"))
    k = total.join(expected, ["rater_a", "rater_b"], "left")
    po, pe = F.col("same") / F.col("n"), F.coalesce("e", F.lit(0)) / (F.col("n") * F.col("n"))
    kappa = k.select("rater_a", "rater_b", "n", r6(F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe))).alias("kappa"))
    moments = j.groupBy("rater_a", "rater_b").agg(r6(pearson(F.col("sa"), F.col("sb"))).alias("pearson"), r6(F.avg(F.abs(F.col("sa") - F.col("sb")))).alias("mae"), r6(F.avg(F.col("sa") - F.col("sb"))).alias("bias"))
    calibrated = (F.col("pearson") > 0.7) & (F.col("mae") < 0.15)
    return kappa.join(moments, ["rater_a", "rater_b"]).withColumn("calibrated", F.coalesce(calibrated, F.lit(False)))


def fleiss_kappa(df: DataFrame, item: str, category: Column) -> DataFrame:
    """Fleiss' kappa over items with the same number of ratings (the commonest number; others are left out)."""
    cells = df.select(F.col(item).alias("i"), category.alias("k")).filter("k is not null").groupBy("i", "k").agg(F.count("*").alias("c"))
    items = cells.groupBy("i").agg(F.sum("c").alias("r"), F.sum(F.col("c") * F.col("c")).alias("sq"))
    common = items.groupBy("r").count().filter("r > 1").agg(F.max_by("r", F.struct("count", "r")).alias("rr"))
    kept = items.join(F.broadcast(common), F.col("r") == F.col("rr"))
    p = kept.agg(F.count("*").alias("n_items"), F.max("r").alias("raters"), F.avg((F.col("sq") - F.col("r")) / (F.col("r") * (F.col("r") - 1))).alias("p"))
    shares = cells.join(kept.select("i", "r"), "i").groupBy("k").agg(F.sum("c").alias("c"))
    e = shares.agg((F.sum(F.col("c") * F.col("c")) / F.pow(F.sum("c"), F.lit(2.0))).alias("e"))
    return p.crossJoin(F.broadcast(e)).select("n_items", "raters", r6(F.when(F.col("e") == 1, 1.0).otherwise((F.col("p") - F.col("e")) / (1 - F.col("e")))).alias("kappa"))


def ensemble(df: DataFrame, item: str, score: str) -> DataFrame:
    """Mean, median, mode of scores at one decimal (the least among equals), population deviation and its label."""
    rows = df.filter(F.col(score).isNotNull())
    votes = rows.groupBy(item, F.round(score, 1).alias("v")).agg(F.count("*").alias("c"))
    mode = votes.groupBy(item).agg(F.min_by("v", F.struct(-F.col("c"), F.col("v"))).alias("mode"))
    g = rows.groupBy(item).agg(r6(F.avg(score)).alias("mean"), r6(F.median(score)).alias("median"), r6(F.stddev_pop(score)).alias("std"))
    return g.join(mode, item).withColumn("agreement", F.when(F.col("std") < 0.1, "high").when(F.col("std") < 0.2, "medium").otherwise("low"))


def debiased_pairs(df: DataFrame, key: Sequence[str], a_first: Column, b_second: Column, b_first: Column, a_second: Column) -> DataFrame:
    """Two answers judged in both orders: mean scores, winner (tie below 0.5), whether the order decided."""
    a, b = (a_first + a_second) / 2, (b_first + b_second) / 2
    win = lambda x, y: F.when(F.abs(x - y) < 0.5, "tie").when(x > y, "a").otherwise("b")
    return df.select(*key, r6(a).alias("score_a"), r6(b).alias("score_b"), win(a, b).alias("winner"), (win(a_first, b_second) != win(a_second, b_first)).alias("order_bias"), r6(F.least(F.lit(1.0), F.abs(a - b) / 10)).alias("confidence"))


def rubric_score(df: DataFrame, key: Sequence[str], scores: str, rubric: dict[str, tuple[float, float]]) -> DataFrame:
    """Weighted share of the reachable score over a map criterion -> score; rubric: criterion -> (weight, highest level).

    Unknown criteria weigh 1 / number of rubric criteria with highest level 3; no criterion gives 0.
    """
    table = df.sparkSession.createDataFrame([(k, *v) for k, v in rubric.items()], "criterion string, weight double, top double")
    long = df.select(*key, F.explode_outer(scores).alias("c", "s")).join(F.broadcast(table), F.col("c") == F.col("criterion"), "left")
    w = F.coalesce("weight", F.lit(1 / max(1, len(rubric))))
    known = F.col("s").isNotNull()
    return long.groupBy(*key).agg(r6(F.coalesce(ratio(F.sum(F.when(known, F.col("s") * w)), F.sum(F.when(known, F.coalesce("top", F.lit(3.0)) * w))), F.lit(0.0))).alias("score"))


def robustness(df: DataFrame, item: str, variant: str, score: str, base: str) -> DataFrame:
    """Per variant: mean score, mean drop against the item's base variant, share of consistent items; grade of the drop."""
    rows = df.groupBy(item, variant).agg(F.avg(score).alias("s")).filter("s is not null")
    b = rows.filter(F.col(variant) == base).select(F.col(item).alias("i"), F.col("s").alias("b"))
    j = rows.filter(F.col(variant) != base).join(b, F.col(item) == F.col("i")).withColumn("drop", F.col("b") - F.col("s"))
    g = j.groupBy(variant).agg(F.count("*").alias("n"), F.avg("s").alias("mean"), F.avg("drop").alias("drop"), F.avg((F.abs("drop") < 0.1).cast("double")).alias("consistency"))
    value = 0.5 * (1 - F.col("drop")) + 0.5 * F.col("consistency")
    return g.select(variant, "n", r6(F.col("mean")).alias("mean"), r6(F.col("drop")).alias("mean_drop"), r6(F.col("consistency")).alias("consistency"), r6(value).alias("robustness"), ladder(r6(value), [(0.9, "A"), (0.8, "B"), (0.7, "C"), (0.6, "D")], "F").alias("grade"))


def judge_calibration(df: DataFrame, judge: str, score: str, human: str, max_score: float = 1.0) -> DataFrame:
    """Correlation with human scores, mean absolute error and bias per judge; calibrated above a correlation of 0.7 and below an error of 0.15."""
    h = F.col(human) / max_score
    g = df.filter(F.col(score).isNotNull() & F.col(human).isNotNull()).groupBy(judge).agg(F.count("*").alias("n"), pearson(F.col(score), h).alias("r"), F.avg(F.abs(F.col(score) - h)).alias("mae"), F.avg(F.col(score) - h).alias("bias"))
    r = F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0))
    return g.select(judge, "n", r6(r).alias("correlation"), r6(F.col("mae")).alias("mae"), r6(F.col("bias")).alias("bias"), ((r > 0.7) & (F.col("mae") < 0.15)).alias("calibrated"))


def bias_aware_scores(df: DataFrame, item: str, score: str, word_ratio: str, disagreement: float = 0.3, ratio_limit: float = 1.5, factor: float = 0.1, most: float = 0.2) -> DataFrame:
    """Mean of all judges per item, whether they disagree (population deviation above the threshold), and the mean less a
    penalty for answers much longer than the reference (word_ratio, null without a reference)."""
    g = df.filter(F.col(score).isNotNull()).groupBy(item).agg(F.count("*").alias("n"), F.avg(score).alias("m"), F.stddev_pop(score).alias("s"), F.max(word_ratio).alias("ratio"))
    penalty = F.when(F.col("ratio") > ratio_limit, F.least((F.col("ratio") - ratio_limit) * factor, F.lit(most))).otherwise(0.0)
    return g.select(item, "n", r6(F.col("m")).alias("ensemble_score"), (F.col("s") > disagreement).alias("disagreement"), r6(F.greatest(F.lit(0.0), F.col("m") - penalty)).alias("score"))
