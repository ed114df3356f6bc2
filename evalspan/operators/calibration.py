"""Calibration and selective prediction on (confidence, correct) rows.

Everything is a grouped aggregate; grids of temperatures and thresholds (at most some hundred
values) are exploded against *binned or counted* rows, never against the data. Defined results: rows
with a null confidence or correctness are left out; no rows give a count of 0 and errors of 0
(selective metrics: coverage 0, risks 1); the last bin is closed, so 1.0 belongs to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspan.functions.columns import r6, ratio


def usable(df: DataFrame, confidence: str, correct: Column, keys: Sequence[str] = ()) -> DataFrame:
    return df.select(*keys, F.col(confidence).cast("double").alias("conf"), correct.cast("double").alias("hit")).filter("conf is not null and not isnan(conf) and hit is not null")


def uniform_bin(n_bins: int) -> Column:
    return F.least(F.floor(F.col("conf") * n_bins), F.lit(n_bins - 1))


def quantile_bin(rows: DataFrame, n_bins: int) -> Column:
    """Bins between exact percentiles; the outer edges are 0 and 1."""
    edges = rows.agg(F.percentile("conf", [i / n_bins for i in range(1, n_bins)])).first()[0] or []
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: F.col("conf") >= e)) if edges else F.lit(0)


def bins(rows: DataFrame, bin_of: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Reliability table: rows, mean confidence and accuracy of every bin that isn't empty."""
    return rows.groupBy(*keys, bin_of.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("mean_conf"), F.avg("hit").alias("accuracy"))


def calibration_errors(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Expected, maximal and average calibration error, and the shares of bins above and below their accuracy."""
    gap = F.abs(F.col("accuracy") - F.col("mean_conf"))
    zero = lambda c: F.coalesce(r6(c), F.lit(0.0))
    return table.groupBy(*keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), zero(F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), zero(F.max(gap)).alias("mce"), zero(F.avg(gap)).alias("ace"),
        zero(F.avg((F.col("mean_conf") > F.col("accuracy")).cast("double"))).alias("over_rate"), zero(F.avg((F.col("mean_conf") < F.col("accuracy")).cast("double"))).alias("under_rate"),
    )


def brier(rows: DataFrame, keys: Sequence[str] = (), n_bins: int = 10) -> DataFrame:
    """Brier score with reliability, resolution and uncertainty on equal bins."""
    per_bin = rows.groupBy(*keys, uniform_bin(n_bins).alias("bin")).agg(F.count("*").alias("n"), F.sum("conf").alias("c"), F.sum("hit").alias("h"), F.sum(F.pow(F.col("conf") - F.col("hit"), F.lit(2.0))).alias("sq"))
    total = per_bin.groupBy(*keys).agg(F.sum("n").alias("total"), (F.sum("h") / F.sum("n")).alias("base"))
    j = per_bin.join(total, list(keys)) if keys else per_bin.crossJoin(F.broadcast(total))
    f, o = F.col("c") / F.col("n"), F.col("h") / F.col("n")
    sq = lambda x: F.pow(x, F.lit(2.0))
    return j.groupBy(*keys).agg(
        r6(F.sum("sq") / F.max("total")).alias("brier"), r6(F.sum(F.col("n") * sq(f - o)) / F.max("total")).alias("reliability"),
        r6(F.sum(F.col("n") * sq(o - F.col("base"))) / F.max("total")).alias("resolution"), r6(F.max(F.col("base") * (1 - F.col("base")))).alias("uncertainty"),
    )


def best_temperature(rows: DataFrame, low: float = 0.1, high: float = 5.0, steps: int = 50, n_bins: int = 10) -> DataFrame:
    """Temperature of the grid with the least expected calibration error; the earliest among equals, 1 if none beats it.

    Rows are counted by confidence first, so the grid multiplies distinct confidences only.
    """
    counts = rows.groupBy("conf").agg(F.count("*").alias("n"), F.sum("hit").alias("h"))
    grid = F.array(F.lit(1.0), *(F.lit(low + (high - low) * i / (steps - 1)) for i in range(steps)))
    clipped = F.least(F.greatest(F.col("conf"), F.lit(1e-7)), F.lit(1 - 1e-7))
    scaled = counts.select("n", "h", F.log(clipped / (1 - clipped)).alias("logit"), F.posexplode(grid).alias("i", "t"))
    scaled = scaled.withColumn("c", 1 / (1 + F.exp(-F.col("logit") / F.col("t"))))
    per_bin = scaled.groupBy("i", "t", F.least(F.floor(F.col("c") * n_bins), F.lit(n_bins - 1)).alias("bin")).agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.sum(F.col("c") * F.col("n")).alias("c"))
    ece = per_bin.groupBy("i", "t").agg((F.sum(F.abs(F.col("h") - F.col("c"))) / F.sum("n")).alias("ece"))
    return ece.agg(F.min_by("t", F.struct(r6(F.col("ece")), "i")).alias("t"), r6(F.min("ece")).alias("ece")).select(r6(F.col("t")).alias("temperature"), "ece")


def curve(rows: DataFrame, n_thresholds: int = 100, keys: Sequence[str] = ()) -> DataFrame:
    """Coverage, selective accuracy and risks at equally spaced thresholds from 0 to 1.

    A row is attempted at every threshold up to its confidence: rows are counted by their last
    threshold, and sums from above over the few thresholds give the curve.
    """
    from pyspark.sql.window import Window

    grid = rows.sparkSession.createDataFrame([(i, i / (n_thresholds - 1)) for i in range(n_thresholds)], "i int, threshold double")
    at = F.array(*(F.lit(i / (n_thresholds - 1)) for i in range(n_thresholds)))
    counts = rows.groupBy(*keys, F.size(F.filter(at, lambda t: t <= F.col("conf"))).alias("reached")).agg(F.count("*").alias("n"), F.sum("hit").alias("h"))
    groups = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    full = groups.crossJoin(F.broadcast(grid)).join(counts.withColumn("i", F.col("reached") - 1).drop("reached"), [*keys, "i"], "left").fillna(0, ["n", "h"])
    above = Window.partitionBy(*keys).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    c = full.withColumn("attempted", F.sum("n").over(above)).withColumn("hits", F.sum("h").over(above))
    acc = ratio(F.col("hits"), F.col("attempted"), 0.0)
    return c.select(*keys, "threshold", "attempted", "total", "hits", (F.col("attempted") / F.col("total")).alias("coverage"), acc.alias("accuracy"), F.when(F.col("attempted") > 0, 1 - acc).otherwise(1.0).alias("risk"), (1 - F.col("hits") / F.col("total")).alias("overall_risk"))


def best_threshold(points: DataFrame, score: Column, min_coverage: float, keys: Sequence[str] = ()) -> DataFrame:
    """Threshold with the greatest score among those with enough coverage; the least among equals."""
    ok = points.filter(F.col("coverage") >= min_coverage)
    best = F.max_by(F.struct("threshold", "coverage", "accuracy"), F.struct(r6(score), -F.col("threshold")))
    return ok.groupBy(*keys).agg(best.alias("b")).select(*keys, *(r6(F.col("b")[c]).alias(c) for c in ("threshold", "coverage", "accuracy")))


def cheapest_threshold(points: DataFrame, error_cost: float, abstention_cost: float, keys: Sequence[str] = ()) -> DataFrame:
    """Threshold with the least cost of errors and abstentions; the least among equals."""
    cost = (F.col("attempted") - F.col("hits")) * error_cost + (F.col("total") - F.col("attempted")) * abstention_cost
    best = F.min_by(F.struct("threshold", "coverage", (cost / F.col("total")).alias("expected_cost")), F.struct(r6(cost), F.col("threshold")))
    return points.groupBy(*keys).agg(best.alias("b")).select(*keys, *(r6(F.col("b")[c]).alias(c) for c in ("threshold", "coverage", "expected_cost")))


# Phrases that say that an answer is uncertain.
HEDGES = ("i'm not sure", "i don't know", "uncertain", "unsure", "might be", "possibly", "could be", "not certain", "hard to say", "difficult to determine", "unclear", "ambiguous")


def abstains_by_hedges(confidence: Column, response: Column, threshold: float = 0.5, weight: float = 0.3) -> Column:
    """Abstains below the threshold, and where the confidence falls below it when every hedging phrase takes off ``weight``."""
    text = F.lower(F.coalesce(response, F.lit("")))
    found = sum((F.contains(text, F.lit(h)).cast("int") for h in HEDGES), F.lit(0))
    return confidence - found * weight < threshold


def abstains_by_disagreement(confidence: Column, answers: Column, agreement: float = 0.7, least: float = 0.3) -> Column:
    """Abstains below the least confidence, and where 1 - (different answers - 1) / answers is below ``agreement``; no answers agree."""
    share = F.when(F.size(answers) > 0, 1 - (F.size(F.array_distinct(answers)) - 1) / F.size(answers)).otherwise(1.0)
    return (confidence < least) | (share < agreement)
