"""Resampling, effect sizes, correlation, pass@k.

Resampling works on partial sums: every task draws Poisson(1) weights (bootstrap) or random signs
(permutation) per row and replicate from a generator seeded by the row's id, adds them up per group
and replicate with numpy, and only these sums are shuffled. A group may be of any size, the result
doesn't depend on the partitioning, and a lost task is redone alike. Defined results: null scores are
left out; groups of fewer than two rows have null intervals; a zero deviation gives effect 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspan.functions.columns import ladder, normal_cdf, pearson, r6, ratio, slope, z_quantile

#: Rows and replicates drawn at a time.
BLOCK, REPLICATES_AT_ONCE = 4096, 1000
#: Sums held by a task (two per group and replicate, 8 bytes each) before partial ones are emitted.
HELD_SUMS = 8_000_000


def _uniform(ids: np.ndarray, first: int, last: int, seed: int) -> np.ndarray:
    """Uniform numbers per (row id, replicate from first up to last), by hashing: rows are independent of each other and of the partitioning."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(first + 1, last + 1, dtype=np.uint64)[None] * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


#: Cumulative probabilities of Poisson(1): a uniform number's rank among them is the weight.
_POISSON = np.cumsum([np.exp(-1) / float(np.prod(np.arange(1, k + 1))) for k in range(12)])


def _sums(weights, columns: Sequence[str], replicates: int, seed: int):
    def part_sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def emitted() -> pd.DataFrame:
            rows = [(*key, acc[0].tolist(), acc[1].tolist()) for key, acc in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=[*columns, "w", "wx"])

        for part in parts:
            for key, rows in part.groupby(list(columns), dropna=False) if columns else [((), part)]:
                acc = held.setdefault(key if isinstance(key, tuple) else (key,), np.zeros((2, replicates)))
                ids, x = rows["row_id"].to_numpy(), rows["value"].to_numpy(float)
                for i in range(0, len(x), BLOCK):
                    for r in range(0, replicates, REPLICATES_AT_ONCE):
                        w = weights(_uniform(ids[i : i + BLOCK], r, min(replicates, r + REPLICATES_AT_ONCE), seed))
                        acc[:, r : r + REPLICATES_AT_ONCE] += np.stack([w.sum(0), x[i : i + BLOCK] @ w])
                if 2 * replicates * len(held) > HELD_SUMS:
                    yield emitted()
        yield emitted()

    return part_sums


def _replicates(df: DataFrame, keys: Sequence[str], row_id: str, value: Column, weights, replicates: int, seed: int) -> DataFrame:
    """(keys, replicate, w, wx) summed over all tasks."""
    rows = df.select(*keys, F.col(row_id).cast("bigint").alias("row_id"), value.cast("double").alias("value")).filter("value is not null and row_id is not null")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keys).schema.fields) + "w array<double>, wx array<double>"
    partial = rows.mapInPandas(_sums(weights, keys, replicates, seed), schema)
    long = partial.select(*keys, F.posexplode(F.arrays_zip("w", "wx")).alias("replicate", "s"))
    return long.groupBy(*keys, "replicate").agg(F.sum("s.w").alias("w"), F.sum("s.wx").alias("wx"))


def bootstrap_mean(df: DataFrame, keys: Sequence[str], row_id: str, value: str, replicates: int = 10_000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Mean, standard error and percentile, basic and bias-corrected accelerated (BCa) intervals per group.

    The acceleration is that of the leave-one-out means, which for a mean is a sixth of the third central
    moment over the second one's power 1.5, divided by the root of the rows: a plain aggregate.
    """
    c = F.col(value)
    base = df.filter(c.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(c).alias("m"), (F.coalesce(F.nanvl(F.skewness(c.cast("double")), F.lit(0.0)), F.lit(0.0)) / (6 * F.sqrt(F.count("*").cast("double")))).alias("acceleration"))
    weights = lambda u: np.searchsorted(_POISSON, u).astype(float)
    reps = _replicates(df, keys, row_id, c, weights, replicates, seed).filter("w > 0").withColumn("t", F.col("wx") / F.col("w"))
    j = reps.join(base, list(keys)) if keys else reps.crossJoin(F.broadcast(base))
    lo, hi = (1 - level) / 2, (1 + level) / 2
    g = j.groupBy(*keys).agg(F.max("n").alias("n"), F.max("m").alias("mean"), F.max("acceleration").alias("acceleration"), F.stddev_pop("t").alias("se"), F.percentile("t", [lo, hi]).alias("q"), F.avg((F.col("t") < F.col("m")).cast("double")).alias("below"), F.sort_array(F.collect_list("t")).alias("ts"))
    # Bias correction: the levels move by twice the normal quantile of the share of replicates below the mean.
    bounds = [(z_quantile(lo), "bca_low"), (z_quantile(hi), "bca_high")]
    share = F.least(F.greatest(F.col("below"), F.lit(1e-6)), F.lit(1 - 1e-6))
    g = g.withColumn("__t", F.sqrt(-2 * F.log(F.least(share, 1 - share)))).withColumn("__sign", F.signum(share - 0.5))
    t = F.col("__t")
    g = g.withColumn("__z0", F.col("__sign") * (t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))))
    z0 = F.col("__z0")
    size = F.size("ts")
    level_of = lambda z: normal_cdf(z0 + (z0 + z) / (1 - F.col("acceleration") * (z0 + z)))
    at = lambda z: F.get("ts", F.greatest(F.least(F.floor(level_of(z) * size), size - 1), F.lit(0)).cast("int"))
    q = lambda i: F.get("q", F.lit(i))
    enough = lambda x: F.when(F.col("n") >= 2, r6(x))
    return g.select(*keys, "n", r6(F.col("mean")).alias("mean"), enough(F.col("se")).alias("se"), enough(q(0)).alias("low"), enough(q(1)).alias("high"), enough(2 * F.col("mean") - q(1)).alias("basic_low"), enough(2 * F.col("mean") - q(0)).alias("basic_high"), *(enough(at(F.lit(z))).alias(name) for z, name in bounds))


def sign_permutation(pairs: DataFrame, keys: Sequence[str], row_id: str, delta: str, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """Paired permutation test: share of random sign flips whose mean difference is as large as the observed one (no correction)."""
    base = pairs.filter(F.col(delta).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(delta).alias("s"))
    signs = lambda u: np.where(u < 0.5, -1.0, 1.0)
    reps = _replicates(pairs, keys, row_id, F.col(delta), signs, replicates, seed)
    j = reps.join(base, list(keys)) if keys else reps.crossJoin(F.broadcast(base))
    return j.groupBy(*keys).agg(F.max("n").alias("n"), r6(F.max(F.col("s") / F.col("n"))).alias("mean_difference"), r6(F.avg((F.abs("wx") >= F.abs("s") - 1e-12).cast("double"))).alias("p_value"))


def effect_sizes(df: DataFrame, keys: Sequence[str], group: str, a: str, b: str, value: str) -> DataFrame:
    """Cohen's d, Hedges' g (both with intervals) and Glass's delta of group a against b."""
    side = lambda name: F.when(F.col(group) == name, F.col(value))
    g = df.groupBy(*keys).agg(*(f(side(x)).alias(f"{n}_{s}") for x, s in ((a, "a"), (b, "b")) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    na, nb = F.col("n_a"), F.col("n_b")
    pooled = F.sqrt(((na - 1) * F.col("v_a") + (nb - 1) * F.col("v_b")) / (na + nb - 2))
    diff = F.col("m_a") - F.col("m_b")
    d = ratio(diff, pooled)
    se = F.sqrt((na + nb) / (na * nb) + d * d / (2 * (na + nb)))
    j, z = 1 - 3 / (4 * (na + nb - 2) - 1), z_quantile(0.975)
    label = ladder(F.abs(d), [(0.8, "large"), (0.5, "medium"), (0.2, "small")], "negligible")
    return g.filter((na >= 2) & (nb >= 2)).select(*keys, "n_a", "n_b", r6(d).alias("cohens_d"), r6(d - z * se).alias("d_low"), r6(d + z * se).alias("d_high"), label.alias("label"), r6(d * j).alias("hedges_g"), r6(ratio(diff, F.sqrt("v_b"))).alias("glass_delta"))


def cliff_delta(df: DataFrame, keys: Sequence[str], group: str, a: str, b: str, value: str) -> DataFrame:
    """(pairs a > b minus pairs a < b) / all pairs, from counts per value: no pair is formed.

    Counts of a below and at a value come from running sums over the distinct values of a group.
    """
    from pyspark.sql.window import Window

    rows = df.filter(F.col(value).isNotNull() & F.col(group).isin(a, b))
    counts = rows.groupBy(*keys, F.col(value).alias("v")).agg(F.count_if(F.col(group) == a).alias("ca"), F.count_if(F.col(group) == b).alias("cb"))
    w = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    c = counts.withColumn("below_b", F.sum("cb").over(w) - F.col("cb")).withColumn("below_a", F.sum("ca").over(w) - F.col("ca"))
    g = c.groupBy(*keys).agg(F.sum(F.col("ca") * F.col("below_b")).alias("more"), F.sum(F.col("cb") * F.col("below_a")).alias("less"), F.sum("ca").alias("n_a"), F.sum("cb").alias("n_b"))
    delta = ratio(F.col("more") - F.col("less"), F.col("n_a") * F.col("n_b"))
    return g.select(*keys, "n_a", "n_b", r6(delta).alias("delta"), ladder(F.abs(delta), [(0.474, "large"), (0.33, "medium"), (0.147, "small")], "negligible").alias("label"))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Rank of every distinct value, ties sharing the mean of their ranks: (keys, value, name)."""
    from pyspark.sql.window import Window

    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(*keys, value, (F.sum("c").over(w) - (F.col("c") - 1) / 2).alias(name))


def correlation(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson, Spearman and the least-squares line per group; null where a column doesn't vary (R2 is 1 if only y doesn't)."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    ranked = rows.join(average_ranks(rows, keys, x, "rx"), [*keys, x]).join(average_ranks(rows, keys, y, "ry"), [*keys, y])
    a, b, r = F.col(x), F.col(y), pearson(F.col(x), F.col(y))
    level = F.when(F.stddev_pop(b) > 0, r * r).when(F.stddev_pop(a) > 0, 1.0)
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), r6(r).alias("pearson"), r6(pearson(F.col("rx"), F.col("ry"))).alias("spearman"), r6(slope(b, a)).alias("slope"), r6(F.avg(b) - slope(b, a) * F.avg(a)).alias("intercept"), r6(level).alias("r2"))


def influence(df: DataFrame, keys: Sequence[str], name: str, x: str, y: str) -> DataFrame:
    """Cook's distance and leave-one-out change of R2 of every row, in closed form from the group's sums."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    X, Y = F.col(x), F.col(y)
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(X).alias("sx"), F.sum(Y).alias("sy"), F.sum(X * X).alias("sxx"), F.sum(Y * Y).alias("syy"), F.sum(X * Y).alias("sxy")).filter("n > 3")
    j = rows.join(sums, list(keys)) if keys else rows.crossJoin(F.broadcast(sums))
    c = F.col

    def r2(n, sx, sy, sxx, syy, sxy):
        cov, vx, vy = sxy - sx * sy / n, sxx - sx * sx / n, syy - sy * sy / n
        return F.when((vx > 1e-12) & (vy > 1e-12), cov * cov / (vx * vy)).otherwise(0.0), cov, vx, vy

    full, cov, vx, vy = r2(c("n"), c("sx"), c("sy"), c("sxx"), c("syy"), c("sxy"))
    without, *_ = r2(c("n") - 1, c("sx") - X, c("sy") - Y, c("sxx") - X * X, c("syy") - Y * Y, c("sxy") - X * Y)
    mean_x, mean_y = c("sx") / c("n"), c("sy") / c("n")
    slope = ratio(cov, vx)
    residual = Y - mean_y - slope * (X - mean_x)
    mse = F.greatest((vy - slope * cov) / (c("n") - 2), F.lit(0.0))
    h = 1 / c("n") + ratio((X - mean_x) * (X - mean_x), vx)
    cook = F.when((vx > 1e-12) & (mse > 1e-15), residual * residual / (2 * mse) * h / ((1 - h) * (1 - h))).otherwise(0.0)
    return j.select(*keys, name, r6(cook).alias("cook"), r6(full - without).alias("delta_r2"))


def outliers(df: DataFrame, keys: Sequence[str], name: str, value: str, threshold: float = 2.5) -> DataFrame:
    """Rows whose distance from the median exceeds the threshold times the scaled median deviation (quartile fences if that is 0)."""
    rows = df.filter(F.col(value).isNotNull())
    mid = rows.groupBy(*keys).agg(F.median(value).alias("mid"), F.percentile(value, [0.25, 0.75]).alias("q"))
    j = rows.join(mid, list(keys))
    mad = j.groupBy(*keys).agg((1.4826 * F.median(F.abs(F.col(value) - F.col("mid")))).alias("mad"))
    k = j.join(mad, list(keys))
    iqr = F.get("q", F.lit(1)) - F.get("q", F.lit(0))
    far = F.when(F.col("mad") > 0, F.abs(F.col(value) - F.col("mid")) / F.col("mad") > threshold).otherwise((F.col(value) < F.get("q", F.lit(0)) - 1.5 * iqr) | (F.col(value) > F.get("q", F.lit(1)) + 1.5 * iqr))
    return k.filter(far).select(*keys, name, r6(F.col(value)).alias(value))


def pass_at_k(df: DataFrame, keys: Sequence[str], passed: Column, ks: Sequence[int]) -> DataFrame:
    """pass@k (at least one of k passes) and pass^k (all of k pass) per group; for fewer than k rows by the pass rate."""
    g = df.filter(passed.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(passed).alias("c"))
    n, c = F.col("n").cast("double"), F.col("c").cast("double")

    def product(top: Column, k: int) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda acc, i: acc * F.greatest(top - i, F.lit(0.0)) / (n - i))

    out = g
    for k in ks:
        some = F.when(c == 0, 0.0).when(c >= n, 1.0).when(n < k, 1 - F.pow(1 - c / n, F.lit(float(k)))).otherwise(1 - product(n - c, k))
        every = F.when(c >= n, 1.0).when(n < k, F.pow(c / n, F.lit(float(k)))).when(c < k, 0.0).otherwise(product(c, k))
        out = out.withColumn(f"pass_at_{k}", r6(some)).withColumn(f"pass_all_{k}", r6(every))
    return out


def bootstrap_difference(df: DataFrame, keys: Sequence[str], group: str, a: str, b: str, row_id: str, value: str, replicates: int = 10_000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Difference of the means of two groups with a percentile interval from independent resamples."""
    weights = lambda u: np.searchsorted(_POISSON, u).astype(float)
    side = lambda name: df.filter(F.col(group) == name)
    both = None
    for i, name in enumerate((a, b)):
        reps = _replicates(side(name), keys, row_id, F.col(value), weights, replicates, seed + i).filter("w > 0").select(*keys, "replicate", (F.col("wx") / F.col("w")).alias(f"t{i}"))
        both = reps if both is None else both.join(reps, [*keys, "replicate"])
    means = df.groupBy(*keys).agg((F.avg(F.when(F.col(group) == a, F.col(value))) - F.avg(F.when(F.col(group) == b, F.col(value)))).alias("d"))
    g = both.groupBy(*keys).agg(F.percentile(F.col("t0") - F.col("t1"), [(1 - level) / 2, (1 + level) / 2]).alias("q"))
    j = means.join(g, list(keys)) if keys else means.crossJoin(F.broadcast(g))
    low, high = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    return j.select(*keys, r6(F.col("d")).alias("difference"), r6(low).alias("low"), r6(high).alias("high"), ((low > 0) | (high < 0)).alias("significant"))


def label_permutation(df: DataFrame, keys: Sequence[str], group: str, a: str, b: str, row_id: str, value: str, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """Independent permutation test of the mean difference: every row draws its label with the share of group a.

    Labels are drawn per row, so a replicate's group sizes vary around the true ones; the difference of
    means is compared with the observed one (no correction).
    """
    rows = df.filter(F.col(group).isin(a, b) & F.col(value).isNotNull())
    base = rows.groupBy(*keys).agg(F.avg((F.col(group) == a).cast("double")).alias("share"), F.count("*").alias("n"), F.sum(value).alias("s"), (F.avg(F.when(F.col(group) == a, F.col(value))) - F.avg(F.when(F.col(group) == b, F.col(value)))).alias("d"))
    # One uniform number per row and replicate decides; the share is close to the row counts' ratio in every key.
    overall = rows.agg(F.avg((F.col(group) == a).cast("double"))).first()[0] or 0.5
    labels = lambda u: (u < overall).astype(float)
    reps = _replicates(rows, keys, row_id, F.col(value), labels, replicates, seed)
    j = reps.join(base, list(keys)) if keys else reps.crossJoin(F.broadcast(base))
    d = F.col("wx") / F.col("w") - (F.col("s") - F.col("wx")) / (F.col("n") - F.col("w"))
    return j.filter("w > 0 and w < n").groupBy(*keys).agg(r6(F.max("d")).alias("difference"), r6(F.avg((F.abs(d) >= F.abs("d") - 1e-12).cast("double"))).alias("p_value"))


def required_n(effect: float, alpha: float = 0.05, power: float = 0.8, ratio_b: float = 1.0) -> int:
    """Rows per group that find an effect: ceil((z(1 - a / 2) + z(power))^2 (1 + 1 / ratio) / d^2)."""
    return math.ceil((z_quantile(1 - alpha / 2) + z_quantile(power)) ** 2 * (1 + 1 / ratio_b) / effect**2)


def achieved_power(effect: Column, n: Column, alpha: float = 0.05, ratio_b: float = 1.0) -> Column:
    return normal_cdf(F.abs(effect) / F.sqrt((1 + 1 / ratio_b) / n) - z_quantile(1 - alpha / 2))


def detectable_effect(n: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    return (z_quantile(1 - alpha / 2) + z_quantile(power)) * F.sqrt(2 / n)


def bootstrap_r2(df: DataFrame, keys: Sequence[str], row_id: str, x: str, y: str, replicates: int = 10_000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """R2 of a line with a percentile interval over resamples; replicates without variance in x or y are skipped."""
    weights = lambda u: np.searchsorted(_POISSON, u).astype(float)
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(row_id).isNotNull())
    moments = {"x": F.col(x), "y": F.col(y), "xx": F.col(x) * F.col(x), "yy": F.col(y) * F.col(y), "xy": F.col(x) * F.col(y)}
    # The same weights per row and replicate in every pass, as they are hashes of the row's id.
    reps = None
    for name, c in moments.items():
        one = _replicates(rows, keys, row_id, c, weights, replicates, seed).withColumnsRenamed({"w": f"w_{name}", "wx": name})
        reps = one if reps is None else reps.join(one.drop(f"w_{name}"), [*keys, "replicate"])
    n = F.col("w_x")
    vx, vy, vxy = (n * F.col("xx") - F.col("x") * F.col("x")), (n * F.col("yy") - F.col("y") * F.col("y")), (n * F.col("xy") - F.col("x") * F.col("y"))
    r2 = F.when((vx > 1e-9) & (vy > 1e-9), vxy * vxy / (vx * vy))
    g = reps.select(*keys, r2.alias("r2")).filter("r2 is not null").groupBy(*keys).agg(F.avg("r2").alias("mean"), F.percentile("r2", [(1 - level) / 2, (1 + level) / 2]).alias("q"))
    base = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.pow(pearson(F.col(x), F.col(y)), F.lit(2.0)).alias("r2"))
    j = base.join(g, list(keys)) if keys else base.crossJoin(g)
    return j.select(*keys, "n", r6(F.col("r2")).alias("r2"), r6(F.col("mean")).alias("bootstrap_mean"), r6(F.get("q", F.lit(0))).alias("low"), r6(F.get("q", F.lit(1))).alias("high"))


def compare_groups(df: DataFrame, keys: Sequence[str], group: str, a: str, b: str, row_id: str, value: str, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """Two groups at a glance: effect size (Hedges' g below 20 rows a side, else Cohen's d), bootstrapped difference, permutation p-value."""
    effects = effect_sizes(df, keys, group, a, b, value)
    small = F.least("n_a", "n_b") < 20
    effect = F.when(small, F.col("hedges_g")).otherwise(F.col("cohens_d"))
    j = effects.join(bootstrap_difference(df, keys, group, a, b, row_id, value, replicates, seed=seed), list(keys)).join(label_permutation(df, keys, group, a, b, row_id, value, replicates, seed).select(*keys, "p_value"), list(keys))
    return j.select(*keys, "n_a", "n_b", "difference", "low", "high", "p_value", F.when(small, "hedges_g").otherwise("cohens_d").alias("effect_kind"), effect.alias("effect"), "label")
