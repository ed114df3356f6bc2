"""Distribution, coverage and stratification of test sets.

Defined results: null is a value like any other where values are counted (its name is null); an
empty table gives no rows, or one row of zeros for global measures; a single value has entropy 0 and
counts as unbalanced only if its share differs (ratio 1).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalspan.functions.columns import r6, ratio


def value_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, value, n) of several columns in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features)))
    return df.select(pairs.alias("p")).groupBy("p.feature", "p.value").agg(F.count("*").alias("n"))


def distribution(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Values, normalised Shannon entropy, imbalance ratio and balance verdict per feature."""
    counts = value_counts(df, features)
    total = Window.partitionBy("feature")
    p = F.col("n") / F.sum("n").over(total)
    g = counts.select("feature", "n", p.alias("p")).groupBy("feature").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(-F.col("p") * F.log2(F.col("p") + 1e-10)).alias("h"), (F.max("n") / F.min("n")).alias("imbalance"))
    entropy = F.when(F.col("k") > 1, F.col("h") / F.log2("k")).otherwise(F.lit(0.0))
    return g.select("feature", F.col("k").alias("n_values"), "n", r6(entropy).alias("entropy"), r6(F.col("imbalance")).alias("imbalance"), ((F.col("imbalance") < 3) & (entropy > 0.8)).alias("balanced"))


def diversity_score(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Seven tenths mean entropy, three tenths share of balanced features."""
    d = distribution(df, features)
    return d.agg(F.count("*").alias("n_features"), r6(F.avg("entropy")).alias("mean_entropy"), r6(0.7 * F.avg("entropy") + 0.3 * F.avg(F.col("balanced").cast("double"))).alias("score"))


def cross_coverage(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows per combination of the features' values, absent combinations included (a grid of distinct values, not of rows)."""
    grid = reduce(DataFrame.crossJoin, [df.select(f).filter(F.col(f).isNotNull()).distinct() for f in features])
    counts = df.groupBy(*features).agg(F.count("*").alias("n"))
    return grid.join(counts, list(features), "left").fillna(0, ["n"])


def stratification(df: DataFrame, field: str, targets: dict[str, float]) -> DataFrame:
    """Actual against target shares over the union of values, the rows that a value lacks, and the overall quality."""
    counts = df.groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n"))
    goal = df.sparkSession.createDataFrame(list(targets.items()), "t string, target double")
    j = counts.join(goal, F.col("value") == F.col("t"), "full_outer").select(F.coalesce("value", "t").alias("value"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("target", F.lit(0.0)).alias("target"))
    every = Window.partitionBy()  # values of one field
    share = F.col("n") / F.sum("n").over(every)
    quality = 1 - F.least(F.lit(1.0), 2 * F.avg(F.abs(F.col("target") - F.col("actual"))).over(every))
    lacking = F.floor(F.sum("n").over(every) * F.col("target")) - F.col("n")
    return j.withColumn("actual", share).select("value", "n", r6(F.col("target")).alias("target"), r6(F.col("actual")).alias("actual"), lacking.cast("bigint").alias("suggested"), r6(quality).alias("quality"))


def content_diversity(df: DataFrame, text: str, keys: Sequence[str] = ()) -> DataFrame:
    """Lengths, vocabulary, type-token ratio and the rate of texts with the same set of words as another."""
    tokens = F.filter(F.split(F.lower(text), "\\s+"), lambda w: w != "")
    t = df.filter(F.col(text).isNotNull()).select(*keys, F.length(text).alias("len"), tokens.alias("w"))
    sets = t.withColumn("set", F.sha2(F.array_join(F.array_sort(F.array_distinct("w")), " "), 256))
    base = sets.groupBy(*keys).agg(F.count("*").alias("n"), r6(F.avg("len")).alias("mean_length"), r6(F.stddev_pop("len")).alias("std_length"), F.sum(F.size("w")).alias("tokens"), r6(F.avg(F.size(F.array_distinct("w")))).alias("mean_unique_words"), (F.count("*") - F.countDistinct("set")).alias("copies"))
    vocabulary = t.select(*keys, F.explode("w").alias("word")).groupBy(*keys, "word").count().groupBy(*keys).agg(F.count("*").alias("vocabulary"))
    if keys:
        words = vocabulary.select(*(F.col(k).alias(f"__{k}") for k in keys), "vocabulary")
        j = base.join(words, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left")
    else:
        j = base.crossJoin(F.broadcast(vocabulary))
    return j.select(*keys, "n", "mean_length", "std_length", F.coalesce("vocabulary", F.lit(0)).alias("vocabulary"), r6(ratio(F.col("vocabulary"), F.col("tokens"))).alias("type_token_ratio"), "mean_unique_words", r6(ratio(F.col("copies"), F.col("n"))).alias("duplicate_rate"))


def difficulty_shares(df: DataFrame, score: str, targets: tuple[float, float, float] = (0.3, 0.4, 0.3)) -> DataFrame:
    """Shares of easy (< 0.3), medium and hard (>= 0.7) rows and whether they are near the target."""
    c = F.col(score)
    g = df.filter(c.isNotNull()).agg(F.avg((c < 0.3).cast("double")).alias("easy"), F.avg(((c >= 0.3) & (c < 0.7)).cast("double")).alias("medium"), F.avg((c >= 0.7).cast("double")).alias("hard"))
    off = sum(F.abs(F.col(n) - t) for n, t in zip(("easy", "medium", "hard"), targets))
    return g.select(*(r6(F.col(n)).alias(n) for n in ("easy", "medium", "hard")), r6(off).alias("deviation"), (off < 0.3).alias("well_distributed"))
