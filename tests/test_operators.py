"""Operators that SQL can't state, and the traps: deviations, quantiles, half rounding, ties, nulls, empty tables."""

import itertools
import math
import random
import statistics as st

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from evalspan.functions import jsontext, text
from evalspan.functions.columns import normal_cdf, r6, std0, z_quantile
from evalspan.operators import aggregates, agreement, calibration, joins, ordered, overlap, pareto, spectra, trees
from evalspan.operators import statistics as stats


def one(spark, column, value=None):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first().x


def test_standard_deviations_and_empty_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", None)], "g string, x double")
    got = {r.g: r.s for r in df.groupBy("g").agg(std0(F.col("x")).alias("s")).collect()}
    assert got["a"] == pytest.approx(math.sqrt(2)) and got["b"] == 0 and got["c"] == 0
    assert aggregates.exclusive_quantiles(df.filter("false"), ["g"], "x").count() == 0


@pytest.mark.parametrize("values", [[1.0, 2.0, 4.0, 9.0, 11.0], [5.0, 5.0, 5.0, 7.0], [3.0], [1.0, 2.0, 8.0], list(map(float, range(17)))])
def test_exclusive_quantiles(spark, values):
    df = spark.createDataFrame([("g", v) for v in values] + [("g", None)], "g string, x double")
    got = aggregates.exclusive_quantiles(df, ["g"], "x").first()
    want = st.quantiles(values, n=4) if len(values) >= 4 else [min(values), st.median(values), max(values)]
    assert [got.q25, got.median, got.q75] == pytest.approx(want)


def test_upper_median(spark):
    df = spark.createDataFrame([(1, float(x)) for x in (4, 1, 3, 2)], "g int, x double")
    assert aggregates.upper_median(df, ["g"], "x").first().upper_median == 3.0


def test_normal_approximations(spark):
    assert z_quantile(0.975) == pytest.approx(1.96, abs=1e-3) and z_quantile(0.5) == 0 and z_quantile(0) == -math.inf
    for x in (-2.0, 0.0, 0.7, 3.0):
        assert one(spark, normal_cdf(F.lit(x))) == pytest.approx(st.NormalDist().cdf(x), abs=1e-6)


def test_running_sums_over_many_ranges(spark):
    rows = [(i % 97 / 10, float(i % 3)) for i in range(1000)]
    got = {r.x: r.cum_s for r in ordered.running(spark.createDataFrame(rows, "x double, v double"), "x", {"s": F.col("v")}, ranges=7).collect()}
    for x in got:
        assert got[x] == sum(v for y, v in rows if y <= x)


def test_corrections(spark):
    p = [0.01, 0.04, 0.03, 0.005]
    got = {r.t: r for r in ordered.corrections(spark.createDataFrame([(str(i), x) for i, x in enumerate(p)], "t string, p double"), "t", "p").collect()}
    assert [got[str(i)].holm for i in range(4)] == [0.03, 0.06, 0.06, 0.02]
    assert [got[str(i)].bh for i in range(4)] == [0.02, 0.04, 0.04, 0.02]
    assert [got[str(i)].bonferroni for i in range(4)] == [0.04, 0.16, 0.12, 0.02]


def test_calibration_edges(spark):
    rows = spark.createDataFrame([(0.0, 0), (0.1, 0), (1.0, 1), (0.95, 1), (None, 1), (0.5, None)], "c double, y int")
    u = calibration.usable(rows, "c", F.col("y"))
    bins = {r.bin: r.n for r in calibration.bins(u, calibration.uniform_bin(10)).collect()}
    assert bins == {0: 1, 1: 1, 9: 2}
    none = calibration.calibration_errors(calibration.bins(u.filter("false"), calibration.uniform_bin(10))).first()
    assert (none.n, none.ece, none.mce) == (0, 0.0, 0.0)
    c = {round(r.threshold, 6): r for r in calibration.curve(u, 3).collect()}
    assert c[1.0].attempted == 1 and c[0.5].coverage == 0.5 and c[0.0].risk == 0.5


def test_frontier_against_brute_force(spark):
    rng = np.random.default_rng(1)
    pts = [(str(i), float(a), float(b)) for i, (a, b) in enumerate(rng.integers(0, 12, (200, 2)))] + [("n", None, 3.0)]
    got = {r.name for r in pareto.frontier(spark.createDataFrame(pts, "name string, gain double, cost double").repartition(5), {"gain": True, "cost": False}).collect()}
    val = {n: (a or 0.0, -b) for n, a, b in pts}
    want = {n for n, v in val.items() if not any(w[0] >= v[0] and w[1] >= v[1] and w != v for w in val.values())}
    assert got == want
    assert pareto.frontier(spark.createDataFrame([], "name string, gain double, cost double"), {"gain": True}).count() == 0


@settings(max_examples=40, deadline=None)
@given(hs.lists(hs.lists(hs.integers(0, 9), min_size=4, max_size=4), min_size=4, max_size=4))
def test_assignment_is_the_cheapest(cost):
    got = sum(cost[i][j] for i, j in enumerate(trees.assign(cost)))
    assert got == min(sum(cost[i][p[i]] for i in range(4)) for p in itertools.permutations(range(4)))


def test_tree_edit_distance():
    a = ("r", (("x", ()), ("y", (("z", ()),))))
    assert trees.tree_edit_distance(a, a) == 0
    assert trees.tree_edit_distance(a, ("r", (("x", ()), ("q", (("z", ()),))))) == 1
    assert trees.tree_edit_distance(a, ("r", (("x", ()),))) == 2
    assert trees.tree_edit_distance(None, a) == 4 and trees.tree_edit_distance(None, None) == 0


def test_tree_walks(spark):
    rows = [("t", "a", None, "A", 0), ("t", "b", "a", "B", 1), ("t", "c", "b", "C", 2), ("t", "d", "a", "B", 1), ("u", "a", None, "A", 0)]
    n = spark.createDataFrame(rows, "tree string, node string, parent string, name string, depth int")
    assert {(r.node, r.ancestor, r.distance) for r in trees.ancestors(n, "tree").collect()} == {("b", "a", 1), ("d", "a", 1), ("c", "b", 1), ("c", "a", 2)}
    assert {(r.tree, r.path) for r in trees.leaf_paths(n, "tree").collect()} == {("t", "A > B > C"), ("t", "A > B"), ("u", "A")}
    s = {r.tree: r for r in trees.tree_stats(n, "tree").collect()}
    assert (s["t"].n_leaves, s["t"].n_names, s["u"].max_depth) == (2, 3, 0)


def test_one_to_one_optimal_beats_greedy(spark):
    p = spark.createDataFrame([(1, "a", "x", 0.9), (1, "a", "y", 0.85), (1, "b", "x", 0.85), (1, "b", "y", 0.1)], "k int, l string, r string, s double")
    pairs = lambda optimal: {(r.l, r.r) for r in trees.one_to_one(p, ["k"], "l", "r", "s", 0.7, optimal).collect()}
    assert pairs(True) == {("a", "y"), ("b", "x")} and pairs(False) == {("a", "x")}


def test_resampling(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(2, 1, 400)
    df = spark.createDataFrame([(i, "g", float(v)) for i, v in enumerate(x)] + [(900, "one", 1.0), (901, "none", None)], "id long, g string, v double")
    got = {r.g: r for r in stats.bootstrap_mean(df, ["g"], "id", "v", 500).collect()}
    se = x.std() / math.sqrt(len(x))
    assert got["g"].mean == pytest.approx(x.mean(), abs=1e-5) and got["g"].se == pytest.approx(se, rel=0.15)
    assert got["g"].low == pytest.approx(x.mean() - 1.96 * se, abs=0.03) and got["one"].low is None and "none" not in got
    again = {r.g: r for r in stats.bootstrap_mean(df.repartition(7), ["g"], "id", "v", 500).collect()}
    assert again["g"].low == pytest.approx(got["g"].low, abs=1e-6)
    pairs = spark.createDataFrame([(i, float(v) - 2) for i, v in enumerate(x)], "id long, d double")
    assert stats.sign_permutation(pairs, [], "id", "d", 400).first().p_value > 0.01
    assert stats.sign_permutation(pairs.withColumn("d", F.col("d") + 2), [], "id", "d", 400).first().p_value == 0


def test_pass_at_k_edges(spark):
    rows = [("none", False)] * 3 + [("all", True)] * 3 + [("mix", True)] + [("mix", False)] * 3 + [("few", True), ("few", False)]
    got = {r.g: r for r in stats.pass_at_k(spark.createDataFrame(rows, "g string, ok boolean"), ["g"], F.col("ok"), (1, 3)).collect()}
    assert (got["none"].pass_at_3, got["all"].pass_at_3, got["all"].pass_all_3) == (0, 1, 1)
    assert got["mix"].pass_at_1 == 0.25 and got["mix"].pass_at_3 == 0.75 and got["mix"].pass_all_3 == 0
    assert got["few"].pass_at_3 == pytest.approx(1 - 0.5**3) and got["few"].pass_all_3 == pytest.approx(0.5**3)


def test_agreement(spark):
    rows = [("i", "a", 0.5), ("i", "b", 0.4), ("j", "a", 1.5), ("j", "b", 2.4), ("k", "a", None), ("k", "b", 3.0)]
    df = spark.createDataFrame(rows, "item string, rater string, s double")
    got = {r.item: (r.exact, r.majority) for r in agreement.item_agreement(df, "item", "s").collect()}
    assert got == {"i": (True, True), "j": (False, True), "k": (True, True)}  # halves round to even
    same = spark.createDataFrame([("i", "a", 1.0), ("i", "b", 1.0)], "item string, rater string, s double")
    assert agreement.rater_pairs(same, "item", "rater", "s").first().kappa == 1.0


def test_theta_joins(spark):
    a = spark.createDataFrame([("x", 0.0, 10.0), ("y", 20.0, 20.0), ("z", None, 3.0)], "n string, lo double, hi double")
    b = spark.createDataFrame([("p", 5.0, 30.0), ("q", 10.0, 12.0)], "m string, r_lo double, r_hi double")
    assert [(r.n, r.m, r.fraction) for r in joins.interval_overlap(a, b, "lo", "hi", 3.0).collect()] == [("x", "p", 0.5)]
    names = spark.createDataFrame([("cd3",), ("cd31",), ("b",), ("",), (None,)], "a string")
    others = spark.createDataFrame([("cd3",), ("abc",), ("",)], "b string")
    assert {tuple(r) for r in joins.gram_contains(names, "a", others, "b").collect()} == {("cd3", "cd3"), ("cd31", "cd3"), ("b", "abc")}
    sets = spark.createDataFrame([("p", ["a"]), ("q", ["a", "b"]), ("r", ["a", "b", "c"]), ("e", [])], "child string, elements array<string>")
    got = {r.child: r.parent for r in joins.most_specific_container(sets, sets.withColumnRenamed("child", "parent")).collect()}
    assert got == {"p": None, "q": "p", "r": "q", "e": None}


def test_containers_are_found_in_divided_buckets(spark, monkeypatch):
    """Largest proper subset by brute force, where buckets of elements are shared, and split by sets and by children."""
    for name, n in (("ELEMENT_BUCKETS", 5), ("ELEMENTS_AT_ONCE", 20), ("CHILDREN_AT_ONCE", 7)):
        monkeypatch.setattr(joins, name, n)
    draw = random.Random(5)
    some = lambda n: [(draw.choice([None, *(f"n{i}" for i in range(60))]), draw.choices(["a", "b", "c", "d", "e", "f", "é", None], k=draw.randint(0, 6))) for _ in range(n)]
    children, parents = dict(some(120)), some(150)
    want = {}
    for child, e in children.items():
        inside = [(-len(set(f)), name) for name, f in parents if None not in (child, name) and name != child and set(f) < set(e) and set(f) - {None}]
        want[child] = min(inside)[1] if inside else None
    df = joins.most_specific_container(spark.createDataFrame(list(children.items()), "child string, elements array<string>"), spark.createDataFrame(parents, "parent string, elements array<string>"))
    assert {r.child: r.parent for r in df.collect()} == want and len(set(want.values())) > 5
    # Sets that share their rarest element aren't tried one by one on every child that has it.
    assert "array_except" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_children_walk_only_branches_that_they_have():
    class Counted(set):
        tried = 0

        def issuperset(self, other):
            Counted.tried += 1
            return super().issuperset(other)

    draw = random.Random(7)
    sets = {tuple(sorted(draw.sample(range(100), draw.randint(2, 14)))) for _ in range(4000)}
    root = joins._trie([(x, str(x), None) for x in sets])
    for child in draw.sample(sorted(sets), 150):
        n, name = joins._largest_within(root, Counted(child), len(child), "")
        assert (-n, name) == min([(-len(x), str(x)) for x in sets if set(x) < set(child)], default=(0, None))
    assert Counted.tried < 150 * len(sets) / 20


def test_cosine_neighbours(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 5))
    m[7] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(99, None)], "vec_id long, embedding array<float>").repartition(3)
    got = {(r.query_id, r["rank"]): r.similarity for r in spectra.cosine_neighbours(df, df.filter("vec_id < 10"), 3, block=4).collect()}
    unit = m / np.where(np.linalg.norm(m, axis=1, keepdims=True) > 0, np.linalg.norm(m, axis=1, keepdims=True), 1)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    for q in range(10):
        assert [got[q, k] for k in (1, 2, 3)] == pytest.approx(sorted(sims[q], reverse=True)[:3], abs=1e-5)


@pytest.mark.parametrize(
    "response, want",
    [
        ("", "empty"),
        (None, "empty"),
        ("Which markers are used? Please provide more information.", "meta_questions"),
        ("I cannot predict this.", "refusal"),
        ("Generally, you would gate. It depends on the panel.", "instructions"),
        ("Singlets, live cells, lymphocytes, CD3+, T cells, B cells. Please specify.", "none"),
    ],
)
def test_failure_type(spark, response, want):
    assert one(spark, text.failure_type(F.col("t")), response) == want


def test_text_parsers(spark):
    assert one(spark, text.explicit_confidence(F.col("t")), "Confidence: 85%") == 0.85
    assert one(spark, text.explicit_confidence(F.col("t")), "no idea") is None
    assert one(spark, text.condition_anchored(F.col("t")), "m_x_rich_cot_hipc").asDict() == {"context": "rich", "strategy": "cot", "reference": "hipc"}
    assert one(spark, text.condition_suffix(F.col("t")), "a_b").asDict() == {"context": "", "strategy": ""}
    assert one(spark, text.version_at_least(F.col("t"), "1.10.0"), "1.9.5") is False and one(spark, text.version_at_least(F.col("t"), "0.0.0"), None) is True
    assert [x.asDict() for x in one(spark, text.marker_logic(F.col("t")), "CD3+ CD19-")] == [{"marker": "CD3", "positive": True}, {"marker": "CD19", "positive": False}]
    assert one(spark, text.marker_logic(F.col("t")), "FSC-A+ SSC-") == []
    assert one(spark, text.final_answer(F.col("t")), "x\nFinal answer: 7 ") == "7"
    assert one(spark, text.judge_field(F.col("t"), "SCORE", "int"), "ok\nSCORE: 8/10") == 8
    assert one(spark, text.numeric_answer_score(F.col("t"), F.lit("100 nM")), "about 120 nM") == 0.75
    assert one(spark, text.strip_authority(F.col("t")), "According to experts [3], see https://x.y/z") == "[AUTHORITY_CLAIM] , see [URL]"
    assert one(spark, text.truncated(F.col("t")), '{"a": {') is True


def test_json_in_text():
    assert jsontext.balanced_object('x {"a": "}", "b": {"c": 1}} y') == '{"a": "}", "b": {"c": 1}}'
    assert jsontext.balanced_object('{"a": 1') is None
    assert jsontext.response_nodes('```json\n{"name": "A", "children": ["B", {"name": "C"}]}\n```') == ("fenced", [(0, None, "A"), (1, 0, "B"), (2, 0, "C")])
    assert jsontext.response_nodes("A\n  - B\n    - C\n  - D") == ("list", [(0, None, "A"), (1, 0, "B"), (2, 1, "C"), (3, 0, "D")])
    assert jsontext.response_nodes(None) == ("none", []) and jsontext.response_nodes('{"name": "A", "chil')[0] == "none"


@settings(max_examples=60, deadline=None)
@given(hs.text("abc", max_size=12), hs.text("abc", max_size=12))
def test_lcs(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
    assert overlap.lcs_length(a, b) == m[-1][-1]


def test_common_substrings(spark):
    shared = "the quick brown fox jumps over the lazy dog and runs away"
    o = spark.createDataFrame([(1, f"AAA {shared.upper()} BBB"), (2, None), (3, "")], "id int, text string")
    c = spark.createDataFrame([(7, f"zz{shared}yy")], "rid int, body string")
    got = overlap.common_substrings(o, "id", "text", c, "rid", "body", 40).collect()
    assert [(r.output_id, r.reference_id, r.output_at, r.reference_at, r.length) for r in got] == [(1, 7, 4, 2, len(shared))]


def test_rounding_of_halves(spark):
    assert one(spark, F.bround(F.lit(2.5))) == 2 and one(spark, r6(F.lit(None).cast("double"))) is None


def test_tree_distance_of_every_parsed_answer(spark, tmp_path):
    from evalspan.plans import registry

    tree = lambda *names: '{"name": "r", "children": [' + ", ".join(f'{{"name": "{n}"}}' for n in names) + "]}"
    rows = [(1, "c", "run1", 1, tree("a", "b"), True), (2, "c", "run2", 2, tree("a", "x"), True), (3, "c", "run3", 5, tree("a"), True), (4, "c", "run3", 4, "nothing", True), (5, "c", "run1", 3, tree("a"), False)]
    df = spark.createDataFrame(rows, "id bigint, test_case_id string, run_id string, bootstrap_run bigint, raw_response string, parse_success boolean")
    df.selectExpr("*", "'m' as model", "'l' as context_level", "'s' as prompt_strategy", "'r' as reference_mode").write.parquet(str(tmp_path / "predictions.parquet"))
    got = {(r.id, r.distance, r.normalised) for r in registry.QUERIES["response_tree_distance"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0, 0.0), (2, 1, 0.333333), (3, 1, 0.333333), (4, 3, 1.0)}


def test_tree_edit_distance_equals_its_definition():
    import random
    from itertools import permutations

    size = lambda t: 1 + sum(map(size, t[1]))

    def plain(x, y):
        n = max(len(x[1]), len(y[1]))
        at = lambda t, i: t[1][i] if i < len(t[1]) else None
        cost = lambda c, e: plain(c, e) if c and e else size(c or e) if c or e else 0
        best = (x[0] != y[0]) + min((sum(cost(at(x, i), at(y, j)) for i, j in enumerate(p)) for p in permutations(range(n))), default=0)
        ways = [1 + sum(plain(c, y) for c in x[1])] * bool(x[1]) + [1 + sum(plain(x, c) for c in y[1])] * bool(y[1])
        return min([best, *ways])

    rng = random.Random(5)
    make = lambda depth: (rng.choice("abc"), tuple(make(depth - 1) for _ in range(rng.randrange(4 if depth > 1 else 3) if depth else 0)))
    for _ in range(150):
        a, b = make(2), make(2)
        assert trees.tree_edit_distance(a, b) == plain(a, b), (a, b)


def test_common_substrings_of_repeated_texts_and_copies(spark, tmp_path, monkeypatch):
    import random

    from evalspan.plans import registry

    def plain(a, b, least):
        got = set()
        for i in range(len(a)):
            for m in range(len(b)):
                if a[i] == b[m] and not (i and m and a[i - 1] == b[m - 1]):
                    n = next((x for x in range(min(len(a) - i, len(b) - m)) if a[i + x] != b[m + x]), min(len(a) - i, len(b) - m))
                    got |= {(i, m, n)} if n >= least else set()
        return got

    rng = random.Random(3)
    make = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    passage = make(70, "abcdefgh ")
    items = ["x" * 80, passage, passage, "ab" * 45, make(60, "ab") + passage[10:65], "é😀" * 30, None, ""]
    docs = ["x" * 150, "y" + passage.upper() + "z" + passage, "ab" * 60 + passage[:49], "é😀" * 40, passage, passage, None, "", make(200, "ab")]
    monkeypatch.setattr(overlap, "REFERENCE_CHARS", 150)
    monkeypatch.setattr(overlap, "OUTPUT_CHARS", 64)
    spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(str(tmp_path / "eval_items.parquet"))
    got = [tuple(r) for r in registry.QUERIES["verbatim_passages"](spark, str(tmp_path)).collect()]
    want = {(i, c, *m) for i, a in enumerate(docs) for c, b in enumerate(items) for m in plain((a or "").lower(), (b or "").lower(), 50)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    # The whole search, in pieces of 64 characters here, as the workers have their own settings.
    refs = overlap._References(list(range(len(items))), items, 25)
    for i, a in enumerate(docs):
        here = {(c, *m[1:]) for m in overlap._passages((a or "").lower(), refs, overlap._Hasher(25), 50) for c in refs.owners[m[0]]}
        assert here == {w[1:] for w in want if w[0] == i}


def test_walks_of_deep_trees_and_circles(spark):
    from evalspan.operators import perturb

    chain = [("deep", i, i - 1 if i else None, f"n{i}", i) for i in range(150)]
    # 1 -> 2 -> 3 -> 1 with a tail 5 -> 4 -> 1, and a node that is its own parent
    circles = [("c", 1, 2, "a", 0), ("c", 2, 3, "b", 0), ("c", 3, 1, "c", 0), ("c", 4, 1, "d", 1), ("c", 5, 4, "e", 2), ("s", 1, 1, "a", 0)]
    schema = "tree string, node int, parent int, name string, depth int"
    n = spark.createDataFrame(chain, schema)
    got = [(r.node, r.ancestor, r.distance) for r in trees.ancestors(n, "tree").collect()]
    assert len(got) == 150 * 149 // 2 and set(got) == {(i, j, i - j) for i in range(150) for j in range(i)}
    assert [r.path for r in trees.leaf_paths(n, "tree").collect()] == [" > ".join(f"n{i}" for i in range(150))]
    kept = {r.node for r in perturb.pruned(n, "tree", 0.03).collect()}
    assert kept == set(range(len(kept))) and len(kept) < 86
    c = trees.ancestors(spark.createDataFrame(circles, schema), "tree").collect()
    ring = {(a, b, (b - a) % 3 or 3) for a in (1, 2, 3) for b in (1, 2, 3)}
    tail = {(4, 1, 1), (4, 2, 2), (4, 3, 3), (5, 4, 1), (5, 1, 2), (5, 2, 3), (5, 3, 4)}
    assert sorted((r.tree, r.node, r.ancestor, r.distance) for r in c) == sorted([*(("c", *x) for x in ring | tail), ("s", 1, 1, 1)])
    rows = [("t", f"p{i}", f"p{i - 1}" if i else "Live", []) for i in range(80)]
    deep = trees.from_populations(spark.createDataFrame(rows, "tree string, population string, parent string, markers array<string>"), "tree")
    assert {r.node: r.depth for r in deep.collect()} == {"All Events": 0, "Singlets": 1, "Live": 2} | {f"p{i}": i + 3 for i in range(80)}


def test_content_diversity_of_the_null_group(spark):
    from evalspan.operators import diversity

    df = spark.createDataFrame([(None, "a b"), (None, "b c"), ("s", "a")], "source string, text string")
    got = {r.source: (r.n, r.vocabulary, r.type_token_ratio) for r in diversity.content_diversity(df, "text", ["source"]).collect()}
    assert got == {None: (2, 3, 0.75), "s": (1, 1, 1.0)}


def test_resampling_draws_ten_thousand_replicates(spark):
    import inspect

    from evalspan.operators import statistics

    for f in (statistics.bootstrap_mean, statistics.bootstrap_difference, statistics.sign_permutation, statistics.label_permutation):
        assert inspect.signature(f).parameters["replicates"].default == 10_000
    pairs = spark.range(11).selectExpr("id as row_id", "1.0D as delta")
    # A mean of eleven equal signs: two of 2,048 outcomes, a p-value that 1,000 replicates can't tell from 0.001.
    p = statistics.sign_permutation(pairs, [], "row_id", "delta").first().p_value
    assert 0.0003 < p < 0.0019 and round(p * 10_000, 6) == round(p * 10_000)
