"""Spectral similarity of dyes, panel complexity, spreading, and cosine search over vectors.

A dye list is a bounded dimension, so its pairs are formed; panels meet the pair table by equi-joins
on their dyes. Vector search is exact: blocks of queries against all vectors (see ``cosine_neighbours``). Defined
results: null or empty ranges have no spectrum; a zero norm gives similarity 0.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspan.functions.columns import once, r6

POINTS, FIRST, LAST = 500, 350.0, 850.0


def emission(peak: Column, lo: Column, hi: Column) -> Column:
    """Two-sided Gaussian on equally spaced wavelengths, left width (peak - lo) / 2.5, right width (hi - peak) / 2."""
    step = (LAST - FIRST) / (POINTS - 1)
    z = lambda w: F.when(w < peak, (w - peak) / ((peak - lo) / 2.5)).otherwise((w - peak) / ((hi - peak) / 2))
    return F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), lambda i: F.exp(-0.5 * F.pow(z(FIRST + i * step), F.lit(2.0))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def spectra(dyes: DataFrame) -> DataFrame:
    """(name, s): spectra of the dyes with peaks and ranges."""
    return dyes.filter("em_max is not null and em_range.lo < em_max and em_range.hi > em_max").select("name", emission(F.col("em_max"), F.col("em_range.lo"), F.col("em_range.hi")).alias("s"))


def spectral_pairs(dyes: DataFrame) -> DataFrame:
    """(name_a, name_b, similarity) for name_a < name_b of a bounded dye list with peaks and ranges."""
    s = spectra(dyes)
    a, b = s.select(F.col("name").alias("name_a"), F.col("s").alias("sa")), s.select(F.col("name").alias("name_b"), F.col("s").alias("sb"))
    return a.join(b, F.col("name_a") < F.col("name_b")).select("name_a", "name_b", r6(cosine(F.col("sa"), F.col("sb"))).alias("similarity"))


def panel_complexity(members: DataFrame, pairs: DataFrame, critical: float = 0.9, high: float = 0.7) -> DataFrame:
    """Complexity of panels (panel, name) from the pair table, under three definitions, with counts and a verdict.

    ``sum_all`` adds all similarities, ``sum_squares`` the squares above 0.5, ``with_penalty`` adds 5 per
    critical pair to the sum.
    """
    m = members.select("panel", "name").distinct()
    a, b = m.withColumnRenamed("name", "name_a"), m.select(F.col("panel").alias("p2"), F.col("name").alias("name_b"))
    j = a.join(pairs, "name_a").join(b, (F.col("panel") == F.col("p2")) & (pairs["name_b"] == b["name_b"]))
    s = F.col("similarity")
    sizes = m.groupBy("panel").agg(F.count("*").alias("n_colours"))
    g = j.groupBy("panel").agg(F.count("*").alias("n_pairs"), F.sum(s).alias("sum_all"), F.sum(F.when(s > 0.5, s * s).otherwise(0.0)).alias("sum_squares"), F.count_if(s > critical).alias("n_critical"), F.count_if(s > high).alias("n_high"), F.max(s).alias("max_similarity"))
    out = sizes.join(g, "panel", "left").fillna(0)
    quality = F.when(F.col("max_similarity") > 0.9, "avoid").when(F.col("max_similarity") > 0.75, "caution").when(F.col("max_similarity") > 0.6, "acceptable").otherwise("good")
    return out.select("panel", "n_colours", "n_pairs", r6(F.col("sum_all")).alias("sum_all"), r6(F.col("sum_squares")).alias("sum_squares"), r6(F.col("sum_all") + 5.0 * F.col("n_critical")).alias("with_penalty"), "n_critical", "n_high", r6(F.col("max_similarity")).alias("max_similarity"), quality.alias("quality"))


def spreading(pairs: DataFrame, stain_index: DataFrame) -> DataFrame:
    """Spreading of every ordered pair: sqrt(sim^2 SI_i) sqrt(SI_i / SI_j); the ratio is skipped for SI_j <= 0."""
    both = pairs.select("name_a", "name_b", "similarity").unionAll(pairs.select(F.col("name_b"), F.col("name_a"), "similarity"))
    i, j = stain_index.select(F.col("name").alias("i"), F.col("si").alias("si_i")), stain_index.select(F.col("name").alias("j"), F.col("si").alias("si_j"))
    x = both.join(i, F.col("name_a") == F.col("i")).join(j, F.col("name_b") == F.col("j"))
    spread = F.sqrt(F.pow("similarity", F.lit(2.0)) * F.col("si_i")) * F.when(F.col("si_j") > 0, F.sqrt(F.col("si_i") / F.col("si_j"))).otherwise(1.0)
    return x.select("name_a", "name_b", r6(spread).alias("spread"))


def substitutes(dyes: DataFrame, pairs: DataFrame, existing: list[str], laser: int, k: int) -> DataFrame:
    """Dyes outside a panel by (1 - greatest similarity) * brightness / 100 * (1 for the laser, else 0.5)."""
    both = pairs.select("name_a", "name_b", "similarity").unionAll(pairs.select(F.col("name_b"), F.col("name_a"), "similarity"))
    worst = both.filter(F.col("name_b").isin(existing)).groupBy("name_a").agg(F.max("similarity").alias("max_similarity"))
    j = dyes.filter(~F.col("name").isin(existing)).join(worst, F.col("name") == F.col("name_a"), "left")
    score = (1 - F.coalesce("max_similarity", F.lit(0.0))) * F.coalesce("relative_brightness", F.lit(0.0)) / 100 * F.when(F.col("optimal_laser") == laser, 1.0).otherwise(0.5)
    return j.select("name", r6(F.coalesce("max_similarity", F.lit(0.0))).alias("max_similarity"), r6(score).alias("score")).orderBy(F.desc("score"), "name").limit(k)


def cosine_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 4096) -> DataFrame:
    """Exact k nearest vectors (vec_id, embedding) by cosine for a stated query set: (query_id, vec_id, similarity, rank).

    Queries go out in blocks of a fixed size; a task holds one block as a matrix, scores its own rows and
    keeps k per query, so what is shuffled is k rows per query and task. Ties fall to the least id.
    """
    from evalspan.operators.ordered import top_k

    q = queries.select(F.col("vec_id").alias("query_id"), "embedding").filter("embedding is not null")
    n_blocks = max(1, -(-q.count() // block))
    found = None
    for b in range(n_blocks):
        rows = q.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b).collect()
        if not rows:
            continue
        ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
        m /= np.where((norm := np.linalg.norm(m, axis=1, keepdims=True)) > 0, norm, 1)
        sent = vectors.sparkSession.sparkContext.broadcast((ids, m))

        def score(parts, sent=sent):
            ids, m = sent.value
            held = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})
            for part in parts:
                x = np.array(part["embedding"].tolist(), float).reshape(len(part), -1)
                if not len(part):
                    continue
                x /= np.where((norm := np.linalg.norm(x, axis=1, keepdims=True)) > 0, norm, 1)
                s = np.round(m @ x.T, 6)
                v = part["vec_id"].to_numpy()
                s[ids[:, None] == v[None]] = -2  # a vector is no neighbour of itself
                order = np.lexsort((np.broadcast_to(v, s.shape), -s), axis=1)[:, :k]
                new = pd.DataFrame({"query_id": np.repeat(ids, order.shape[1]), "vec_id": v[order].ravel(), "similarity": np.take_along_axis(s, order, 1).ravel()})
                held = pd.concat([held, new]).sort_values(["query_id", "similarity", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)
            yield held[held["similarity"] > -2]

        part = vectors.filter("embedding is not null").select("vec_id", "embedding").mapInPandas(score, "query_id bigint, vec_id bigint, similarity double")
        found = part if found is None else found.unionAll(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, similarity double, rank int")
    return top_k(found, ["query_id"], [F.desc("similarity"), F.col("vec_id")], k)


def normalised(values: Column) -> Column:
    """Values over their greatest; unchanged if that isn't positive."""
    return once(F.array_max(values), lambda top: F.when(top > 0, F.transform(values, lambda v: v / top)).otherwise(values))


def peak(at: Column, values: Column) -> Column:
    """Place of the first greatest value."""
    return F.get(at, F.array_position(values, F.array_max(values)).cast("int") - 1)


def half_width(at: Column, values: Column) -> Column:
    """Distance of the first and the last place with at least half of the greatest value; 0 for fewer than two."""
    places = once(F.array_max(values) / 2, lambda half: F.filter(F.transform(values, lambda v, i: F.when(v >= half, F.get(at, i))), lambda x: x.isNotNull()))
    return F.when(F.size(places) >= 2, F.get(places, F.size(places) - 1) - F.get(places, F.lit(0))).otherwise(0.0)


def interpolated(at: Column, values: Column, x: Column) -> Column:
    """Linear interpolation at ``x``; 0 outside (places ascend)."""
    i = F.size(F.filter(at, lambda a: a <= x)) - 1
    a0, a1, v0, v1 = F.get(at, i), F.get(at, i + 1), F.get(values, i), F.get(values, i + 1)
    return F.when((x < F.get(at, F.lit(0))) | (x > F.get(at, F.size(at) - 1)), 0.0).when(a0 == x, v0).otherwise(v0 + (v1 - v0) * (x - a0) / (a1 - a0))


def validated(calculated: DataFrame, expected: DataFrame, keys: Sequence[str], value: str, tolerance: float = 0.05) -> DataFrame:
    """Calculated values against expected ones: error, and whether it is within the tolerance; pairs on one side only are no pair."""
    e = expected.select(*keys, F.col(value).alias("expected"))
    error = F.abs(F.col(value) - F.col("expected"))
    return calculated.join(e, list(keys)).select(*keys, F.col(value).alias("calculated"), "expected", r6(error).alias("error"), (error <= tolerance + 1e-12).alias("passed"))
