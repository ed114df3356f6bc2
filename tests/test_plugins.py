"""Extension points, frontier, containment and merges on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from evalspan.operators import joins, pareto, plugins, statistics


def test_registry():
    r = plugins.Registry("scorer")
    r.register("a")(F.upper)
    assert r["a"] is F.upper
    with pytest.raises(KeyError):
        r["b"]
    with pytest.raises(ValueError):
        r.register("a")(F.lower)


def test_evaluate_judge_dispatch_features_prompts(spark):
    df = spark.createDataFrame([(1, " x ", "X", "up"), (2, None, "y", "odd"), (3, "q", None, None)], "id int, r string, e string, tool string")
    got = {x.id: (x.extracted, x.score) for x in plugins.evaluated(df, "r", "e", F.trim, lambda a, b: (F.upper(a) == b).cast("int")).collect()}
    assert got == {1: ("x", 1), 2: (None, None), 3: ("q", None)}
    assert {(x.id, x.judge, x.score) for x in plugins.judged(df, {"null": lambda c: c.isNull()}, "r").collect()} == {(1, "null", 0.0), (2, "null", 1.0), (3, "null", 0.0)}
    assert {x.id: (x.result, x.known) for x in plugins.dispatched(df, "tool", "e", {"up": F.lower}).collect()} == {1: ("x", True), 2: (None, False), 3: (None, False)}
    assert plugins.features(df, {"n": F.length("r")}).filter("id = 1").first().value == "3"
    t = spark.createDataFrame([("s", "{e}-{e} {id}")], "strategy string, template string")
    assert {x.prompt for x in plugins.prompts(df, t, {"e": F.col("e"), "id": F.col("id")}).collect()} == {"X-X 1", "y-y 2", "- 3"}
    assert plugins.transformed(df, lambda p: p[["id"]] + 1, "id int").agg(F.sum("id")).first()[0] == 9


@pytest.mark.parametrize("held", [0, 10_000])
def test_own_statistic_merges(spark, held):
    rows = [(k, float(i)) for i in range(200) for k in ("a" if i % 3 else "b", None)] + [("c", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    part = lambda p: (int(p["v"].notna().sum()), float(p["v"].sum()))
    out = plugins.own_statistic(df, ["k"], ["v"], part, lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: s[1] / s[0] if s[0] else None, held)
    want = {k: [v for x, v in rows if x == k and v is not None] for k in ("a", "b", None)}
    assert {r.k: r.statistic for r in out.collect()} == {k: pytest.approx(sum(v) / len(v)) for k, v in want.items()} | {"c": None}
    assert plugins.own_statistic(df.limit(0), ["k"], ["v"], part, max, lambda s: s[0]).count() == 0


@pytest.mark.parametrize("objectives", [{"x": True, "y": False}, {"x": True, "y": False, "z": True}])
def test_frontier_against_brute_force(spark, objectives):
    rng = random.Random(len(objectives))
    rows = [(i, float(rng.randrange(30)), float(rng.randrange(30)), float(rng.randrange(4))) for i in range(400)] + [(900, None, 3.0, 1.0), (901, float("nan"), None, None)]
    rows += [(1000 + i, 100.0 + i, 100.0 + i, 0.0) for i in range(150)]  # a long frontier
    clean = lambda v: 0.0 if v is None or v != v else v
    point = {r[0]: [clean(r["ixyz".index(c)]) * (1 if up else -1) for c, up in objectives.items()] for r in rows}
    beats = lambda a, b: all(p >= q for p, q in zip(a, b)) and a != b
    want = {i for i, p in point.items() if not any(beats(q, p) for q in point.values())}
    df = spark.createDataFrame(rows, "id int, x double, y double, z double").repartition(5)
    out = pareto.frontier(df, objectives)
    assert out.columns == df.columns and sorted(r.id for r in out.collect()) == sorted(want)
    assert pareto.frontier(df.limit(0), objectives).count() == 0


def test_container_against_brute_force(spark):
    rng = random.Random(2)
    sets = {f"s{i}": {"hot"} | set(rng.sample("abcdefgh", rng.randint(0, 5))) for i in range(60)} | {"empty": set(), "same": {"hot"}}
    df = spark.createDataFrame([(k, [*v, *list(v)[:1]]) for k, v in sets.items()] + [("null", None)], "child string, elements array<string>")

    def best(c):
        inside = [(-len(v), k) for k, v in sets.items() if v and v < sets[c] and k != c]
        return min(inside)[1] if inside else None

    got = {r.child: r.parent for r in joins.most_specific_container(df, df.withColumnRenamed("child", "parent")).collect()}
    assert got == {c: best(c) for c in sets} | {"null": None}


def test_replicates_are_emitted_in_parts(spark, monkeypatch):
    df = spark.createDataFrame([(i, i % 5, float(i)) for i in range(50)], "id long, k int, v double").coalesce(1)
    whole = sorted(map(tuple, statistics.bootstrap_mean(df, ["k"], "id", "v", replicates=50).collect()))
    monkeypatch.setattr(statistics, "HELD_SUMS", 150)
    assert sorted(map(tuple, statistics.bootstrap_mean(df, ["k"], "id", "v", replicates=50).collect())) == whole
