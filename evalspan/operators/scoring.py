"""Scores of predicted gate sets and trees against the truth.

Inputs are long tables (key, name) or node tables; keys are records, so a join on the key meets a
record's gates only. Defined results: zero denominators give 0 (recall of an empty list of critical
gates 1); names are compared as given, so normalise first; duplicate names count once in sets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspan.functions.columns import r6, ratio
from evalspan.operators.trees import ancestors


def set_f1(predicted: DataFrame, truth: DataFrame, key: str, name: str) -> DataFrame:
    """Precision, recall and F1 of the name sets per key (keys of either side)."""
    p, t = predicted.select(key, name).filter(F.col(name).isNotNull()).distinct().withColumn("__p", F.lit(1)), truth.select(key, name).filter(F.col(name).isNotNull()).distinct().withColumn("__t", F.lit(1))
    g = p.join(t, [key, name], "full_outer").groupBy(key).agg(F.count("__p").alias("__np"), F.count("__t").alias("__nt"), F.count_if(F.col("__p").isNotNull() & F.col("__t").isNotNull()).alias("__hit"))
    precision, recall = ratio(F.col("__hit"), F.col("__np")), ratio(F.col("__hit"), F.col("__nt"))
    return g.select(key, F.col("__hit").alias("n_hit"), r6(precision).alias("precision"), r6(recall).alias("recall"), r6(ratio(2 * precision * recall, precision + recall)).alias("f1"))


def canonical_f1(predicted: DataFrame, truth: DataFrame, key: str, name: str, synonyms: DataFrame) -> DataFrame:
    """Set F1 over canonical names: synonyms (synonym, canonical) are resolved without regard to case, the first by ``ord`` wins."""
    s = synonyms.groupBy(F.lower("synonym").alias("__s")).agg(F.min_by("canonical", "ord").alias("__c"))
    canon = lambda df: df.join(s, F.lower(F.trim(F.col(name))) == F.col("__s"), "left").select(key, F.lower(F.coalesce("__c", F.trim(F.col(name)))).alias(name))
    return set_f1(canon(predicted), canon(truth), key, name)


def recall_of(critical: DataFrame, predicted: DataFrame, key: str, name: str) -> DataFrame:
    """Share of a key's critical names that are predicted; 1 for keys of ``predicted`` without any."""
    c = critical.select(key, name).distinct()
    p = predicted.select(key, name).distinct().withColumn("hit", F.lit(1))
    g = c.join(p, [key, name], "left").groupBy(key).agg(F.count("*").alias("__n"), F.count("hit").alias("__k"))
    keys = predicted.select(key).unionAll(critical.select(key)).distinct()
    return keys.join(g, key, "left").select(key, F.coalesce("__n", F.lit(0)).alias("n_critical"), r6(F.coalesce(F.col("__k") / F.col("__n"), F.lit(1.0))).alias("recall"))


def hallucination_rate(predicted: DataFrame, key: str, name: str, panel: DataFrame, marker: str, skipped: str) -> DataFrame:
    """Share of names with a sign (+ or -) that mention no marker of the key's panel; names matching ``skipped`` (a regex) are left out."""
    p = predicted.select(key, F.lower(name).alias("n")).filter(F.col("n").isNotNull() & ~F.col("n").rlike(skipped))
    m = panel.select(key, F.lower(F.trim(marker)).alias("m")).filter("m <> ''").groupBy(key).agg(F.collect_set("m").alias("ms"))
    j = p.join(m, key, "left")
    known = F.exists(F.coalesce("ms", F.array()), lambda x: F.contains(F.col("n"), x))
    return j.groupBy(key).agg(F.count("*").alias("n_names"), r6(F.avg((F.col("n").rlike("[+-]") & ~known).cast("double"))).alias("hallucination_rate"))


def subtree_contained(main: DataFrame, candidate: DataFrame, tree: str) -> DataFrame:
    """Whether every (name, parent name) of a candidate tree occurs in the main tree of the same key."""
    def links(df: DataFrame) -> DataFrame:
        p = df.select(F.col(tree).alias("t"), F.col("node").alias("n"), F.col("name").alias("pn"))
        return df.join(p, (F.col(tree) == F.col("t")) & (F.col("parent") == F.col("n")), "left").select(tree, "name", F.coalesce("pn", F.lit("")).alias("pn"))

    # A candidate's root may hang anywhere, so its own parent doesn't count.
    c = links(candidate).distinct()
    m = links(main)
    m = m.unionAll(m.select(tree, "name", F.lit("").alias("pn"))).distinct().withColumn("hit", F.lit(1))
    return c.join(m, [tree, "name", "pn"], "left").groupBy(tree).agg((F.count("hit") == F.count("*")).alias("contained"))


def structure_errors(predicted: DataFrame, truth: DataFrame, tree: str) -> DataFrame:
    """One verdict per true row below the root, and a row 'orphaned' per predicted one that hangs on nothing true.

    Verdicts in this order: missing, correct, swapped, wrong_depth, missing_ancestor (the true parent isn't predicted),
    wrong_parent. Orphaned rows have a parent, and neither their name nor that of any ancestor is true.
    """
    def links(df: DataFrame, s: str) -> DataFrame:
        p = df.select(F.col(tree).alias("t"), F.col("node").alias("n"), F.col("name").alias(f"parent_{s}"))
        return df.join(p, (F.col(tree) == F.col("t")) & (F.col("parent") == F.col("n"))).select(tree, "name", f"parent_{s}", F.col("depth").alias(f"depth_{s}"))

    t = links(truth, "t")
    p = links(predicted, "p")
    found = p.groupBy(tree, "name").agg(F.collect_set("parent_p").alias("parents"), F.collect_set("depth_p").alias("depths"))
    present = predicted.select(tree, "name").distinct().withColumn("present", F.lit(True))
    inverse = p.select(tree, F.col("name").alias("parent_t"), F.col("parent_p").alias("name")).distinct().withColumn("inverse", F.lit(True))
    above = present.select(tree, F.col("name").alias("parent_t"), F.col("present").alias("parent_present"))
    j = t.join(present, [tree, "name"], "left").join(found, [tree, "name"], "left").join(inverse, [tree, "name", "parent_t"], "left").join(above, [tree, "parent_t"], "left")
    same_parent, same_depth = F.coalesce(F.array_contains("parents", F.col("parent_t")), F.lit(False)), F.coalesce(F.array_contains("depths", F.col("depth_t")), F.lit(False))
    kind = F.when(F.col("present").isNull(), "missing").when(same_parent & same_depth, "correct").when(F.col("inverse"), "swapped").when(same_parent, "wrong_depth").when(F.col("parent_present").isNull(), "missing_ancestor").otherwise("wrong_parent")
    names = truth.select(tree, "name").distinct()
    extra = predicted.filter("parent is not null").join(names, [tree, "name"], "left_anti")
    true_nodes = predicted.join(names, [tree, "name"], "left_semi").select(tree, F.col("node").alias("ancestor"))
    held = ancestors(predicted, tree).join(true_nodes, [tree, "ancestor"], "left_semi").select(tree, "node").distinct()
    orphaned = extra.join(held, [tree, "node"], "left_anti").select(tree, "name", F.lit("orphaned").alias("error"))
    return j.select(tree, "name", kind.alias("error")).unionAll(orphaned)


def order_kept(preorder: Column, required: Sequence[str]) -> Column:
    """No adjacent pair of required names (substring matches in an array of pre-order names) is inverted; absent names are passed over."""
    place = lambda w: F.array_min(F.filter(F.transform(preorder, lambda x, i: F.when(F.lower(x).contains(w.lower()), i)), lambda i: i.isNotNull()))
    spots = F.array_compact(F.array(*map(place, required)))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(spots) - 1, F.lit(1))), lambda i: F.coalesce(F.get(spots, i - 1) <= F.get(spots, i), F.lit(True)))
    return F.forall(pairs, lambda x: x)


def depth_accuracy(predicted: Column, truth: Column) -> Column:
    """max(0, 1 - |difference| / true depth); for a true depth of 0, whether both are 0."""
    return F.when(truth == 0, (predicted == 0).cast("double")).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(predicted - truth) / truth))


def tiered_matches(predicted: DataFrame, truth: DataFrame, key: str, name: str, tiers: Sequence[tuple[str, Column]]) -> DataFrame:
    """Matches of a key's predicted and true names by the first tier whose form agrees: one to one within a form, names in order.

    tiers: (label, column expression over ``name``); an earlier tier takes its names out of the later ones.
    """
    from pyspark.sql.window import Window

    left = predicted.select(key, F.col(name).alias("p")).filter("p is not null").distinct()
    right = truth.select(key, F.col(name).alias("t")).filter("t is not null").distinct()
    out = None
    for label, form in tiers:
        number = lambda df, c: df.withColumn(name, F.col(c)).withColumn("f", form).drop(name).withColumn("i", F.row_number().over(Window.partitionBy(key, "f").orderBy(c)))
        hit = number(left, "p").join(number(right, "t"), [key, "f", "i"]).select(key, "p", "t", F.lit(label).alias("tier"))
        out = hit if out is None else out.unionAll(hit)
        left = left.join(hit.select(key, "p"), [key, "p"], "left_anti")
        right = right.join(hit.select(key, "t"), [key, "t"], "left_anti")
    return out


def tournament(df: DataFrame, key: str, order: str, name: str, score: str, rank: str) -> DataFrame:
    """Winner of a knock-out per key: neighbours in ``order`` meet, the higher score wins, ties by the lower ``rank``, an odd one passes.

    With fixed scores the bracket's winner is the best of all by (score, -rank), the earlier one of equals, so an aggregate gives it.
    """
    return df.filter(F.col(score).isNotNull()).groupBy(key).agg(F.min_by(name, F.struct(-F.col(score), F.col(rank), F.col(order))).alias("winner"), r6(F.max(score)).alias("score"))
