"""Extension points: own extractors, scorers, judges, tools, features, prompts, statistics and row functions.

What is plugged in is a function from columns to a column where possible, so it stays in the JVM; Python
functions work on Arrow batches. Statistics of one's own are given as parts that can be merged, so a
group that holds a third of all rows is still reduced where it lies. Defined results: an unknown name
is an error when the plan is built; null inputs are passed on.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnFunction = Callable[..., Column]


class Registry:
    """Named functions of one kind: ``@registry.register("name")`` adds one, ``registry["name"]`` gives it."""

    def __init__(self, kind: str) -> None:
        self.kind, self.functions = kind, {}

    def register(self, name: str) -> Callable[[ColumnFunction], ColumnFunction]:
        def add(f: ColumnFunction) -> ColumnFunction:
            if name in self.functions:
                raise ValueError(f"{self.kind} {name} is registered already")
            self.functions[name] = f
            return f

        return add

    def __getitem__(self, name: str) -> ColumnFunction:
        if name not in self.functions:
            raise KeyError(f"no {self.kind} {name}; there are {sorted(self.functions)}")
        return self.functions[name]


def evaluated(df: DataFrame, response: str, expected: str, extract: ColumnFunction, score: ColumnFunction) -> DataFrame:
    """Adds ``extracted`` (from the response) and ``score`` (extracted against expected)."""
    return df.withColumn("extracted", extract(F.col(response))).withColumn("score", score(F.col("extracted"), F.col(expected)))


def judged(df: DataFrame, judges: Mapping[str, ColumnFunction], *columns: str) -> DataFrame:
    """One row per row and judge: ``judge`` and ``score``; a judge is a function of the given columns."""
    scores = F.array(*(F.struct(F.lit(name).alias("judge"), f(*map(F.col, columns)).cast("double").alias("score")) for name, f in judges.items()))
    return df.select("*", F.inline(scores))


def dispatched(df: DataFrame, tool: str, argument: str, tools: Mapping[str, ColumnFunction]) -> DataFrame:
    """Adds ``result``: that of the tool which a row names, as text, and ``known``."""
    out = F
    for name, f in tools.items():
        out = out.when(F.col(tool) == name, f(F.col(argument)).cast("string"))
    return df.withColumn("result", out.otherwise(F.lit(None))).withColumn("known", F.coalesce(F.col(tool).isin(*tools), F.lit(False)))


def features(df: DataFrame, extractors: Mapping[str, Column]) -> DataFrame:
    """One row per row and feature: ``feature`` and ``value`` as text."""
    return df.select("*", F.inline(F.array(*(F.struct(F.lit(n).alias("feature"), c.cast("string").alias("value")) for n, c in extractors.items()))))


def prompts(cases: DataFrame, templates: DataFrame, placeholders: Mapping[str, Column]) -> DataFrame:
    """Every case under every template (strategy, template), ``{name}`` replaced by the case's columns; null is ''. The grid is the result."""
    text = F.col("template")
    for name, c in placeholders.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return cases.crossJoin(templates.select("strategy", "template")).withColumn("prompt", text)


def transformed(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Rows through a function of one's own, batch by batch."""
    return df.mapInPandas(lambda parts: map(f, parts), schema)


def own_statistic(df: DataFrame, keys: Sequence[str], columns: Sequence[str], part: Callable[[pd.DataFrame], object], merge: Callable[[object, object], object], finish: Callable[[object], float | None], held: int = 10_000) -> DataFrame:
    """(keys, statistic) from parts that can be merged.

    part: state of some rows of a group; merge: state of two; finish: the statistic. States are emitted per task (or
    sooner, when ``held`` groups are held) and merged per group in a tree of hashed buckets, so a task merges
    a bucket's states and then 64 of them.
    """
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keys).schema.fields)

    def states(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[tuple, object] = {}

        def emitted() -> pd.DataFrame:
            rows = [(*k, pickle.dumps(s)) for k, s in acc.items()]
            acc.clear()
            return pd.DataFrame(rows, columns=[*keys, "state"])

        for p in parts:
            for key, rows in p.groupby(list(keys), dropna=False) if keys else [((), p)]:
                key, own = key if isinstance(key, tuple) else (key,), part(rows)
                acc[key] = merge(acc[key], own) if key in acc else own
            if len(acc) > held:
                yield emitted()
        yield emitted()

    def merged(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for *key, blobs in p.itertuples(index=False):
                state = pickle.loads(blobs[0])
                for b in blobs[1:]:
                    state = merge(state, pickle.loads(b))
                rows.append((*key, pickle.dumps(state)))
            yield pd.DataFrame(rows, columns=[*keys, "state"])

    def ended(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(statistic=[finish(pickle.loads(b)) for b in p["state"]]).drop(columns="state").astype({"statistic": "Float64"})

    state = df.select(*keys, *columns).mapInPandas(states, kinds + "state binary")
    bucket = F.pmod(F.xxhash64("state"), F.lit(64))
    once = state.groupBy(*keys, bucket.alias("b")).agg(F.collect_list("state").alias("s")).drop("b").mapInPandas(merged, kinds + "state binary")
    whole = once.groupBy(*keys).agg(F.collect_list("state").alias("s")).mapInPandas(merged, kinds + "state binary")
    return whole.mapInPandas(ended, kinds + "statistic double")
