"""Costs of tokens and of planned experiments; prices are a table (model, input_price, output_price) per million tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspan.functions.columns import r6


def token_costs(df: DataFrame, model: str, tokens_in: Column, tokens_out: Column, prices: DataFrame, fallback: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Adds ``cost`` and ``priced`` (whether the model is listed); null tokens cost nothing; models of one name take the greatest price."""
    p = prices.groupBy(F.col("model").alias("__m")).agg(F.max("input_price").alias("__i"), F.max("output_price").alias("__o"))
    j = df.join(p, F.col(model) == F.col("__m"), "left")
    part = lambda n, price, otherwise: F.coalesce(n, F.lit(0)) / 1e6 * F.coalesce(price, F.lit(otherwise))
    cost = part(tokens_in, F.col("__i"), fallback[0]) + part(tokens_out, F.col("__o"), fallback[1])
    return j.withColumn("cost", cost).withColumn("priced", F.col("__m").isNotNull()).drop("__m", "__i", "__o")


def experiment_costs(models: DataFrame, dimensions: Sequence[int], n_cases: int, n_repeats: int, tokens_in: int, tokens_out: int, prices: DataFrame, fallback: tuple[float, float]) -> DataFrame:
    """Planned calls and cost per model (a table with ``model``): the dimensions' sizes multiply with cases and repeats."""
    calls = n_cases * n_repeats
    for size in dimensions:
        calls *= size
    planned = models.select("model").distinct().withColumn("calls", F.lit(calls))
    costs = token_costs(planned, "model", F.col("calls") * tokens_in, F.col("calls") * tokens_out, prices, fallback)
    return costs.select("model", "calls", r6(F.col("cost")).alias("cost"), "priced")


def average_tokens(base: Sequence[tuple[float, float]], multipliers: Sequence[float], added: Sequence[float], tools: bool, tool_tokens: tuple[int, int] = (200, 300)) -> tuple[int, int]:
    """Tokens in and out of a call, averaged over reasoning types (in, out), context multipliers and added context."""
    mean = lambda xs, otherwise: sum(xs) / len(xs) if xs else otherwise
    tokens_in = mean([b[0] for b in base], 1500) * mean(multipliers, 1.0) + mean(added, 0)
    tokens_out = mean([b[1] for b in base], 500)
    return (int(tokens_in + tool_tokens[0] * tools), int(tokens_out + tool_tokens[1] * tools))
