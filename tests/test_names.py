"""Names, costs, judges, abstention, spectra and intervals on small fixtures: nulls, ties, empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspan.functions import text as X
from evalspan.operators import agreement, calibration, costs, names, spectra, statistics


def one(spark, rows, columns, *cs):
    return [tuple(r) for r in spark.createDataFrame(rows, columns).select(*cs).collect()]


def dictionary(spark, df, entries):
    d = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(entries)], "ord int, k string, v string")
    return names.with_dictionary(df, "d", d, "k", "v", [F.col("ord")])


def test_normal_forms_of_names(spark):
    raw = ["CCR7 positive  T cells", "pDCs (gated)", None, "", "Non-classical Monocytes", "γδ T Cell", "CD4+CD8- NK cell", " B ", "C.D+"]
    df = spark.createDataFrame([(x,) for x in raw], "name string").withColumn("i", F.monotonically_increasing_id())
    d = dictionary(spark, df, [("ccr7", "cd197"), ("pdcs", "plasmacytoid"), ("t", "tee"), ("c.d", "x$1"), (None, "y")])
    c = F.col("name")
    got = [tuple(r) for r in d.orderBy("i").select(names.enhanced_name(c, F.slice("d", 1, 1), F.slice("d", 2, 1)), names.shortened_name(c), names.expanded_name(c, F.col("d"))).collect()]
    assert got[0] == ("cd197+ t cells", "ccr7 + t", "cd197 positive tee cells")
    assert got[1][:2] == ("plasmacytoid", "pdcs") and got[2] == got[3] == ("", "", "")
    assert got[4][1] == "nonclassical mono" and got[5][1] == "gd t" and got[6][2] == "nk cells" and got[7] == ("b", "b", "b")
    none = [r[0] for r in dictionary(spark, df, []).orderBy("i").select(names.enhanced_name(c, F.col("d"), F.col("d"))).collect()]
    assert none[0] == "ccr7+ t cells"


def test_equivalent_names_follow_lookup_then_the_first_rule(spark):
    df = dictionary(spark, spark.createDataFrame([("B Cells",), ("cd 19",), ("cd 20",), ("anti-x",), ("anti-b cells",), (None,)], "name string"), [("b cells", "b"), ("cd19", "nineteen")])
    rules = [(r"cd (\d+)", "cd$1", True), ("anti-", "", False)]
    assert [r[0] for r in df.select(names.equivalent_name(F.col("name"), F.col("d"), rules)).collect()] == ["b", "nineteen", "cd20", "anti-x", "b", ""]


def test_registry_matches_and_f1(spark):
    p = spark.createDataFrame([("k", "A", "a"), ("k", "a", "a"), ("k", "z", "z"), ("k", None, None), ("l", "q", "q")], "key string, name string, c string")
    t = spark.createDataFrame([("k", "a", "a"), ("k", "aa", "a"), ("k", "b", "b"), ("m", "b", "b")], "key string, name string, c string")
    got = {r.key: tuple(r)[1:] for r in names.registry_match(p, t, "key", "name", "c").collect()}
    assert got == {"k": (2, 2, 1, 0.666667, 0.333333), "l": (0, 0, 1, 0.0, 0.0), "m": (0, 1, 0, 0.0, 0.0)}
    m = names.fuzzy_matches(spark.createDataFrame([("k", "cd4 t cells"), ("k", "b cells"), ("k", "x")], "key string, name string"), spark.createDataFrame([("k", "cd4 cells"), ("k", "B cells"), ("k", "y")], "key string, name string"), "key", "name", F.lower("name"))
    assert {(r.p, r.t, r.kind, r.weight) for r in m.collect()} == {("b cells", "B cells", "exact", 1.0), ("cd4 t cells", "cd4 cells", "fuzzy", 0.8)}
    assert names.fuzzy_matches(p.limit(0), t, "key", "name", F.lower("name")).count() == 0


def test_valid_parents(spark):
    closure = names.closure_of(spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "child string, parent string"))
    pairs = spark.createDataFrame([("c", "a"), ("a", "c"), ("x", "x"), (None, "a")], "child string, parent string")
    assert {(r.child, r.parent): r.valid for r in names.valid_parents(pairs, "child", "parent", closure).collect()} == {("c", "a"): True, ("a", "c"): False, ("x", "x"): True, (None, "a"): False}


def test_costs(spark):
    prices = spark.createDataFrame([("m", 1.0, 2.0), ("m", 0.5, 2.0)], "model string, input_price double, output_price double")
    df = spark.createDataFrame([("m", 1_000_000, None), ("n", 1_000_000, 1_000_000), (None, None, None)], "model string, i long, o long")
    got = {r.model: (r.cost, r.priced) for r in costs.token_costs(df, "model", F.col("i"), F.col("o"), prices, (3.0, 4.0)).collect()}
    assert got == {"m": (1.0, True), "n": (7.0, False), None: (0.0, False)}
    assert costs.average_tokens([], [], [], False) == (1500, 500) and costs.average_tokens([(1000, 200)], [2.0], [50, 150], True) == (2300, 500)


def test_judges(spark):
    df = spark.createDataFrame([("j", 0.1 * i, 0.1 * i + 0.05) for i in range(9)] + [("k", 0.5, 0.5), ("k", None, 0.1)], "judge string, s double, h double")
    got = {r.judge: tuple(r)[1:] for r in agreement.judge_calibration(df, "judge", "s", "h").collect()}
    assert got["j"] == (9, 1.0, 0.05, -0.05, True) and got["k"] == (1, 0.0, 0.0, 0.0, False)
    rows = spark.createDataFrame([(1, 0.2, 4.0), (1, 1.0, 4.0), (2, 0.5, None), (3, None, 1.0)], "item int, s double, w double")
    assert {r.item: tuple(r)[1:] for r in agreement.bias_aware_scores(rows, "item", "s", "w").collect()} == {1: (2, 0.6, True, 0.4), 2: (1, 0.5, False, 0.5)}


def test_abstention(spark):
    c = F.col("c")
    assert one(spark, [(0.6, "It might be so"), (0.9, "Possibly, it might be"), (0.9, None), (0.4, "sure")], "c double, t string", calibration.abstains_by_hedges(c, F.col("t"))) == [(True,), (True,), (False,), (True,)]
    assert one(spark, [(0.9, ["a", "a", "b"]), (0.9, ["a", "a", "a", "b"]), (0.9, []), (0.2, ["a"])], "c double, a array<string>", calibration.abstains_by_disagreement(c, F.col("a"))) == [(True,), (False,), (False,), (True,)]


def test_spectra(spark):
    at, v = F.col("at"), F.col("v")
    rows = [([1.0, 2.0, 3.0, 4.0], [0.0, 2.0, 4.0, 2.0]), ([1.0], [5.0]), ([1.0, 2.0], [0.0, 0.0])]
    got = one(spark, rows, "at array<double>, v array<double>", spectra.peak(at, v), spectra.half_width(at, v), spectra.normalised(v), spectra.interpolated(at, v, F.lit(1.5)), spectra.interpolated(at, v, F.lit(9.0)))
    assert got == [(3.0, 2.0, [0.0, 0.5, 1.0, 0.5], 1.0, 0.0), (1.0, 0.0, [1.0], 0.0, 0.0), (1.0, 1.0, [0.0, 0.0], 0.0, 0.0)]


def test_texts_of_judges(spark):
    t = F.col("t")
    rows = [('x ```json\n{"discrepancies": [{"severity": "critical"}, {"severity": "odd"}], "confidence_score": 140}\n```',), ("none",), (None,), ('{"confidence_score": -3}',), ("{broken",)]
    got = [tuple(r[0]) for r in one(spark, rows, "t string", X.debate_result(t))]
    assert got == [(1, 0, 1, 100), (0, 0, 0, 50), (0, 0, 0, 50), (0, 0, 0, 0), (0, 0, 0, 50)]
    r = one(spark, [("## Dr. Who says\n- `most experts` **agree**",), (None,)], "t string", X.prepared_for_judging(t, plain=True))
    assert tuple(r[0][0]) == ("[EXPERT] says [CLAIM] agree", 1, 1) and tuple(r[1][0]) == ("", 0, 0)
    assert one(spark, [("orrery-small", 0.5), ("gpt", None)], "m string, x double", X.condition_name(F.col("m"), F.lit("cot"), temperature=F.col("x"))) == [("small_cot_t0.5",), ("gpt_cot",)]


def test_bca_interval_against_an_index_bootstrap(spark):
    rng = np.random.default_rng(7)
    x = rng.exponential(1.0, 200)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(999, None)], "id long, v double")
    r = statistics.bootstrap_mean(df, [], "id", "v", replicates=4000).first()
    t = np.sort(rng.choice(x, (20000, 200)).mean(1))
    from statistics import NormalDist

    n = NormalDist()
    z0 = n.inv_cdf((t < x.mean()).mean())
    d = x.mean() - x
    a = (-d**3).sum() / (6 * ((d**2).sum()) ** 1.5)
    want = [t[int(n.cdf(z0 + (z0 + z) / (1 - a * (z0 + z))) * len(t))] for z in (n.inv_cdf(0.025), n.inv_cdf(0.975))]
    assert [r.bca_low, r.bca_high] == pytest.approx(want, abs=0.03)
    assert r.bca_low > r.basic_low  # skewed values move the interval


def test_bootstrapped_r2(spark):
    rng = random.Random(1)
    rows = [(i, "a", float(i), 2.0 * i + rng.random()) for i in range(60)] + [(100 + i, "b", 1.0, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, k string, x double, y double")
    got = {r.k: r for r in statistics.bootstrap_r2(df, ["k"], "id", "x", "y", replicates=200).collect()}
    assert got["a"].r2 > 0.99 and got["a"].low <= got["a"].r2 <= got["a"].high and "b" not in got


def test_columns_that_do_not_vary(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("c", 1.0, 5.0), ("c", 2.0, 5.0), ("d", None, 1.0)], "k string, x double, y double")
    got = {r.k: (r.n, r.pearson, r.spearman, r.slope, r.intercept, r.r2) for r in statistics.correlation(df, ["k"], "x", "y").collect()}
    assert got == {"a": (2, None, None, None, None, None), "b": (1, None, None, None, None, None), "c": (2, None, None, 0.0, 5.0, 1.0)}
    ratings = spark.createDataFrame([(i, r, 1.0) for i in range(3) for r in "xy"], "item int, rater string, s double")
    assert agreement.rater_pairs(ratings, "item", "rater", "s").first().pearson is None
