"""Pareto frontiers and cost ratios.

Every task keeps the frontier of its own rows (a point that is dominated within a task is dominated at
all), and what is left of all tasks meets in ranges of the first objective. Pairs of all points are never formed. Defined results: null and NaN objectives count as 0; equal points all stay;
an empty table has an empty frontier.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspan.functions.columns import r6, ratio
from evalspan.session import cut_lineage


def _undominated(m: np.ndarray) -> np.ndarray:
    """Positions of the rows that no other row dominates (all columns maximised), in order."""
    order = np.lexsort(tuple(-m[:, i] for i in reversed(range(m.shape[1]))))
    if m.shape[1] == 2:  # sweep: the best second objective of all rows with a greater first one
        x, y = m[order, 0], m[order, 1]
        top = np.maximum.accumulate(y)
        head = np.flatnonzero(np.diff(x, prepend=np.nan) != 0)  # first row of equal first objectives has the best second
        group = np.cumsum(np.isin(np.arange(len(x)), head)) - 1
        above = np.concatenate([[-np.inf], top[head[1:] - 1]]) if len(head) else top
        return np.sort(order[(y == y[head][group]) & (y > above[group])])
    front: list[int] = []
    points, n = np.empty((16, m.shape[1])), 0
    for i in order:  # a point can only be dominated by one that comes before it
        p, held = m[i], points[:n]
        if not ((held >= p).all(1) & (held > p).any(1)).any():
            front.append(i)
            if n == len(points):
                points = np.concatenate([points, np.empty_like(points)])
            points[n] = p
            n += 1
    return np.array(sorted(front), np.int64)


def _local(columns: list[str]):
    def reduce_part(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: pd.DataFrame | None = None
        for part in parts:
            both = part if kept is None else pd.concat([kept, part], ignore_index=True)
            kept = both.iloc[_undominated(both[columns].to_numpy(float))]
        if kept is not None:
            yield kept

    return reduce_part


#: Ranges of the first objective in which the points that are left meet.
RANGES = 64


def frontier(df: DataFrame, objectives: dict[str, bool]) -> DataFrame:
    """Rows that no other row dominates; objectives: column -> whether it is maximised.

    What is left of all tasks is cut into ranges of the first objective. With two objectives a range needs one
    number of the ranges above it, the best second objective; with more, ranges meet in pairs, round by round, and
    what dominates within a pair is gone before the next round.
    """
    signed = {f"__o{i}": F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) * (1 if up else -1) for i, (c, up) in enumerate(objectives.items())}
    names = list(signed)
    tagged = df.withColumns(signed)
    once = cut_lineage(tagged.mapInPandas(_local(names), tagged.schema))
    if len(names) != 2:
        n = RANGES
        while n >= 1:
            once = once.repartitionByRange(n, names[0]).mapInPandas(_local(names), tagged.schema)
            n //= 8
        return once.drop(*names)
    edges = sorted(set(once.approxQuantile(names[0], [i / RANGES for i in range(1, RANGES)], 0.001)))
    part = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(names[0]))) if edges else F.lit(0)
    ranged = once.withColumn("__r", part)
    tops = [(r[0], r[1]) for r in ranged.groupBy("__r").agg(F.max(names[1])).collect()]  # RANGES rows at most
    above = df.sparkSession.createDataFrame([(r, max((t for q, t in tops if q > r), default=float("-inf"))) for r, _ in tops], "__q int, __top double")
    local = ranged.repartition(F.col("__r")).mapInPandas(_local(names), ranged.schema)
    return local.join(F.broadcast(above), F.col("__r") == F.col("__q")).filter(F.col(names[1]) > F.col("__top")).select(*df.columns)


def hypervolume(front: DataFrame, x: str, y: str) -> DataFrame:
    """Area of a two-objective frontier against (0, 0): sum of |(x - next x) y| in descending order of x, the last next being 0."""
    from pyspark.sql.window import Window

    w = Window.orderBy(F.desc(x), F.desc(y))  # a frontier
    return front.select((F.abs((F.col(x) - F.lead(x, 1, 0.0).over(w)) * F.col(y))).alias("a")).agg(r6(F.coalesce(F.sum("a"), F.lit(0.0))).alias("hypervolume"), F.count("*").alias("n_points"))


def best_under_budget(df: DataFrame, name: str, cost: str, gain: str, budgets: Sequence[float]) -> DataFrame:
    """Best gain within each budget; equal gains fall to the cheaper, then the least name."""
    fits = F.explode(F.array_compact(F.array(*(F.when(F.col(cost) <= b, F.lit(float(b))) for b in budgets))))
    return df.select(name, cost, gain, fits.alias("budget")).groupBy("budget").agg(F.max_by(F.struct(name, cost, gain), F.struct(F.col(gain), -F.col(cost), F.col(name))).alias("b"), F.min_by(name, F.struct(-F.col(gain), F.col(cost), F.col(name))).alias("best")).select("budget", "best", r6(F.col("b")[cost]).alias("cost"), r6(F.col("b")[gain]).alias("gain"))


def cost_ratios(df: DataFrame, name: str, cost: Column, gain: Column, reference_cost: float) -> DataFrame:
    """Gain per cost (infinite at no cost) and an efficiency that halves gain and thrift."""
    inf = F.lit(float("inf"))
    thrift = 1 - F.least(F.lit(1.0), cost / reference_cost)
    return df.select(name, r6(F.when(cost == 0, inf).otherwise(ratio(gain, cost))).alias("gain_per_cost"), r6(gain * 0.5 + thrift * 0.5).alias("efficiency"))
