import pytest
from pyspark.sql import functions as F

from evalspan.functions import text
from evalspan.operators import perturb, scoring
from evalspan.operators import statistics as stats
from evalspan.sources import config


def frame(spark, rows, names="k int, name string"):
    return spark.createDataFrame(rows, names)


def test_f1_and_recall(spark):
    p, t = frame(spark, [(1, "a"), (1, "b"), (1, "b"), (2, "x"), (4, None)]), frame(spark, [(1, "b"), (1, "c"), (3, "y")])
    got = {r.k: (r.precision, r.recall, r.f1) for r in scoring.set_f1(p, t, "k", "name").collect()}
    assert got == {1: (0.5, 0.5, 0.5), 2: (0, 0, 0), 3: (0, 0, 0)}
    rec = {r.k: r.recall for r in scoring.recall_of(t, p.filter("name is not null"), "k", "name").collect()}
    assert rec == {1: 0.5, 2: 1.0, 3: 0.0}
    syn = spark.createDataFrame([(2, "aa", "z"), (1, "AA", "b")], "ord int, synonym string, canonical string")
    assert {r.k: r.f1 for r in scoring.canonical_f1(frame(spark, [(1, " aa")]), frame(spark, [(1, "B")]), "k", "name", syn).collect()} == {1: 1.0}


def tree(spark, rows):
    return spark.createDataFrame([("t", *r) for r in rows], "tree string, node int, parent int, name string, depth int")


def test_structure_errors(spark):
    truth = tree(spark, [(0, None, "R", 0), (1, 0, "A", 1), (2, 1, "B", 2), (3, 0, "C", 1), (4, 0, "D", 1), (5, 3, "E", 2)])
    pred = tree(spark, [(0, None, "R", 0), (1, 0, "B", 1), (2, 1, "A", 2), (3, 0, "C", 1), (4, 3, "E", 2), (5, 4, "F", 3)])
    got = {r.name: r.error for r in scoring.structure_errors(pred, truth, "tree").collect()}
    assert got == {"A": "wrong_parent", "B": "swapped", "C": "correct", "D": "missing", "E": "correct"}
    assert scoring.subtree_contained(truth, tree(spark, [(0, None, "C", 0), (1, 0, "E", 1)]), "tree").first().contained is True
    assert scoring.subtree_contained(truth, tree(spark, [(0, None, "E", 0), (1, 0, "C", 1)]), "tree").first().contained is False


def test_row_scores(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    names = F.array(*map(F.lit, ("All", "Singlets", "Live", "T")))
    assert one(scoring.order_kept(names, ["singlets", "live"])) and not one(scoring.order_kept(names, ["live", "singlets"])) and one(scoring.order_kept(names, ["none", "live"]))
    assert one(scoring.depth_accuracy(F.lit(3), F.lit(4))) == 0.75 and one(scoring.depth_accuracy(F.lit(0), F.lit(0))) == 1
    assert one(text.first_family(F.lit("My-GEMINI-x"), {"a": ["claude"], "b": ["gemini"]}, "none")) == "b"
    assert one(text.most_hits(F.lit("x y z"), {"p": ["x"], "q": ["y", "z"]})) == "q" and one(text.most_hits(F.lit(None), {"p": ["x"]})) is None
    assert one(text.marker_state(F.lit(" Positive"))) == "+" and one(text.replaced_at_start(F.lit("cd3 pos"), [(r"cd(\d+)", "CD$1")])) == "CD3 pos"
    assert one(text.assignment_accuracy(F.create_map(F.lit("a"), F.lit("X ")), F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("y")))) == 0.5
    assert [c.value for c in one(text.claims(F.lit("n = 12 and p < 0.05"), {"n": r"n = (\d+)", "p": r"p < ([\d.]+)"}))] == ["12", "0.05"]
    assert one(text.concept_score(F.lit("a b bad"), ["a", "q"], ["b"], ["bad"])) == pytest.approx(0.4)


def test_hallucinated_names_and_tiers(spark):
    p = frame(spark, [(1, "CD3+ T"), (1, "CD99-"), (1, "Scatter+"), (1, "Live"), (1, None)])
    panel = spark.createDataFrame([(1, "cd3"), (1, "")], "k int, m string")
    assert scoring.hallucination_rate(p, "k", "name", panel, "m", "scatter").first().hallucination_rate == pytest.approx(1 / 3, abs=1e-6)
    got = scoring.tiered_matches(frame(spark, [(1, "A"), (1, "b")]), frame(spark, [(1, "A"), (1, "B"), (1, "b ")]), "k", "name", [("exact", F.col("name")), ("folded", F.lower(F.trim(F.col("name"))))])
    assert {(r.p, r.t, r.tier) for r in got.collect()} == {("A", "A", "exact"), ("b", "B", "folded")}


def test_perturbations_are_seeded(spark):
    df = spark.createDataFrame([(1, "The first one. A second one. A third. The last."), (2, None)], "id int, t string")
    a = perturb.text_variants(df, "id", "t", list(perturb.PERTURBATIONS), 0.3)
    b = perturb.text_variants(df.repartition(3), "id", "t", list(perturb.PERTURBATIONS), 0.3)
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    got = {(r.id, r.kind): r.variant for r in a.collect()}
    assert got[2, "typos"] is None and sorted(got[1, "sentences"].split()) == sorted("The first one. A second one. A third. The last.".split())
    t = tree(spark, [(0, None, "R", 0), (1, 0, "A", 1), (2, 1, "B", 2)])
    assert perturb.pruned(t, "tree", 1.0).count() == 1 and perturb.pruned(t, "tree", 0.0).count() == 3


def test_power(spark):
    assert stats.required_n(0.5) == 63
    assert spark.range(1).select(stats.achieved_power(F.lit(0.5), F.lit(64)).alias("x")).first().x == pytest.approx(0.8, abs=0.02)


def test_configuration(spark, tmp_path, monkeypatch):
    (tmp_path / "base.yaml").write_text("a: {x: 1, y: 2}\nb: ${EVALSPAN_TEST:7}\n")
    (tmp_path / "own.yaml").write_text("extends: base.yaml\na: {y: 3}\n")
    assert config.load_config(str(tmp_path / "own.yaml"), {"c": 1}) == {"a": {"x": 1, "y": 3}, "b": 7, "c": 1}
    (tmp_path / "eq.yaml").write_text("T cell: [T cells, CD3+]\n")
    assert config.equivalence_classes(spark, str(tmp_path / "eq.yaml")).count() == 3
    spark.range(3).createOrReplaceTempView("three")
    assert config.query(spark, "SELECT * FROM three WHERE id > ?", 0).count() == 2
    cache = spark.range(1).select(config.response_key(F.lit("q")).alias("key"), F.lit("r").alias("response"))
    req = spark.createDataFrame([("q", 0.0), ("q", 0.7)], "p string, t double")
    assert [r.response for r in config.cached_responses(req, config.response_key(F.col("p")), cache, "t").orderBy("t").collect()] == ["r", None]
    assert config.markdown(spark.range(1)) == "| id |\n| --- |\n| 0 |"


def test_tree_from_populations(spark):
    from evalspan.operators import trees

    rows = [("t", "T", None, ["CD3+"]), ("t", "CD4 T", None, ["CD3+", "CD4+"]), ("t", "NK", "Lymphs", ["CD56+"]), ("u", "CD4 T", None, ["CD4+"]), ("u", None, None, [])]
    df = spark.createDataFrame(rows, "tree string, population string, parent string, markers array<string>")
    got = {(r.tree, r.node, r.parent, r.depth) for r in trees.from_populations(df, "tree").collect()}
    spine = {(t, *x) for t in "tu" for x in (("All Events", None, 0), ("Singlets", "All Events", 1), ("Live", "Singlets", 2))}
    assert got == spine | {("t", "T", "Live", 3), ("t", "CD4 T", "T", 4), ("t", "Lymphs", "Live", 3), ("t", "NK", "Lymphs", 4), ("u", "CD4 T", "Live", 3)}


def test_structure_errors_of_missing_and_orphaned_gates(spark):
    truth = tree(spark, [(0, None, "R", 0), (1, 0, "A", 1), (2, 1, "B", 2), (3, 0, "C", 1), (4, 3, "D", 2)])
    # A isn't predicted, so B has lost its ancestor; D hangs on C's place but C is there; X > Y > Z hang on nothing true, V below C does.
    pred = tree(spark, [(0, None, "R", 0), (1, 0, "B", 1), (2, 0, "C", 1), (3, 0, "D", 1), (4, None, "X", 0), (5, 4, "Y", 1), (6, 5, "Z", 2), (7, 2, "U", 2), (8, 7, "V", 3)])
    got = sorted((r.name, r.error) for r in scoring.structure_errors(pred, truth, "tree").collect())
    assert got == [("A", "missing"), ("B", "missing_ancestor"), ("C", "correct"), ("D", "wrong_parent"), ("Y", "orphaned"), ("Z", "orphaned")]


def test_structure_similarity_and_valid_parents(spark):
    from evalspan.operators import trees

    truth = tree(spark, [(0, None, "R", 0), (1, 0, "A", 1), (2, 1, "B", 2), (3, 1, "C", 2)])
    pred = tree(spark, [(0, None, "R", 0), (1, 0, "A", 1), (2, 0, "E", 1), (3, 2, "C", 2)])
    r = trees.structure_similarity(pred, truth, "tree").first()
    # 3 of 5 names, 1 of 5 edges, depths 1 1 2 against 1 2 1 of 4, 3/4 children a node in both; distance 2 (B to nothing, E in C's way).
    d = trees.edit_distances(pred, truth, "tree").first().distance
    parts = (0.6, 0.2, 0.75, 1.0, 1 - d / 4)
    assert (r.node_similarity, r.edge_similarity, r.depth_similarity, r.branching_similarity, r.edit_similarity) == parts
    assert r.similarity == round(sum(w * x for w, x in zip((0.25, 0.25, 0.15, 0.1, 0.25), parts)), 6)
    same, alone = trees.structure_similarity(truth, truth, "tree").first(), trees.structure_similarity(truth.limit(0), truth, "tree").first()
    assert same.similarity == 1.0 and alone.similarity == 0.0
    valid = spark.createDataFrame([("C", "E"), ("C", "R")], "name string, parent_name string")
    accuracy = lambda v: trees.compare_structure(pred, truth, "tree", v).first().structure_accuracy
    assert accuracy(None) == 0.333333 and accuracy(valid) == 0.666667
