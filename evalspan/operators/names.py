"""Canonical forms of gate names, and what follows from them.

Dictionaries are tables. A dictionary is folded to one row (an array in the order in which its entries
apply) and joined to the names, so its size is what one row may hold: it's a list that people keep, not
data. Null names are ''. The ways to normalise differ on purpose and are kept apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspan.functions.columns import once, r6, ratio
from evalspan.functions.text import text_of


def with_dictionary(df: DataFrame, name: str, entries: DataFrame, key: str, value: str, order: Sequence[Column]) -> DataFrame:
    """Adds the column ``name``: array<struct<key, value>> of a dictionary in the given order."""
    rank = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    pairs = F.sort_array(F.collect_list(F.struct(rank.alias("rank"), F.lower(F.trim(key)).alias("key"), F.lower(F.trim(value)).alias("value"))))
    return df.crossJoin(entries.filter(F.col(key).isNotNull()).agg(F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value"))).alias(name)))


def stripped(c: Column) -> Column:
    """Text without blanks of any kind around; '' for null."""
    return F.regexp_replace(text_of(c), r"(?U)^\s+|\s+$", "")


def escaped(c: Column) -> Column:
    """Text as a pattern that matches it literally."""
    return F.regexp_replace(c, r"([^A-Za-z0-9_\s])", r"\\$1")


def first_value(entries: Column, fits) -> Column:
    """Value of the first entry whose key fits; null if none."""
    return F.get(F.filter(entries, lambda e: fits(e["key"])), F.lit(0))["value"]


def enhanced_name(c: Column, aliases: Column, synonyms: Column) -> Column:
    """Aliases of markers replaced as whole words (in the array's order, longest first), signs without blanks around,
    polarity words as signs, bracketed notes dropped; then the synonym that equals the name, else the first that it contains."""
    s = F.reduce(aliases, F.lower(stripped(c)), lambda acc, a: F.regexp_replace(acc, F.concat(F.lit(r"\b"), escaped(a["key"]), F.lit(r"\b")), a["value"]))
    for pattern, to in ((r"\s*\+\s*", "+"), (r"\s*-\s*", "-"), (r"\s+positive\b", "+"), (r"\s+negative\b", "-"), (r"\bpositive\b", "+"), (r"\bnegative\b", "-"), (r"\s*\([^)]*\)\s*", " "), (r"\s+", " ")):
        s = F.regexp_replace(s, pattern, to)
    return once(stripped(s), lambda x: F.coalesce(first_value(synonyms, lambda k: k == x), first_value(synonyms, lambda k: F.contains(x, k)), x))


# Replacements of the second normal form, applied in this order.
SHORTER = (("non classical", "nonclassical"), ("monocytes", "mono"), ("monocyte", "mono"), ("lymphocytes", "lymph"), ("lymphocyte", "lymph"), (" cells", ""), (" cell", ""), ("positive", "+"), ("negative", "-"), (" hi", "+"), (" lo", "-"), (" high", "+"), (" low", "-"))


def shortened_name(c: Column) -> Column:
    """Hyphens and underscores as blanks, Greek letters spelled, bracketed notes dropped, then fixed replacements in order."""
    s = F.translate(F.lower(stripped(c)), "‐−", "--")
    for old, new in (("γδ", "gd"), ("γ", "gamma"), ("δ", "delta")):
        s = F.replace(s, F.lit(old), F.lit(new))
    s = stripped(F.regexp_replace(F.translate(F.regexp_replace(s, r"\s*\([^)]*\)\s*", " "), "-_", "  "), r"\s+", " "))
    for old, new in SHORTER:
        s = F.replace(s, F.lit(old), F.lit(new))
    return stripped(s)


def expanded_name(c: Column, abbreviations: Column) -> Column:
    """Signed notes in brackets and leading signed markers dropped, abbreviations spelled word by word, 'cell' after T, B or NK as 'cells'."""
    s = F.regexp_replace(F.lower(stripped(c)), r"\([^)]*[+\-][^)]*\)", "")
    s = F.regexp_replace(s, r"^([a-z]+\d*[+\-]+\s*)+", "")
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    spelled = lambda w: once(F.regexp_replace(w, r"^[(),]+|[(),]+$", ""), lambda x: F.coalesce(first_value(abbreviations, lambda k: k == x), w))
    s = F.array_join(F.transform(words, spelled), " ")
    return F.when(s.rlike("t cell|b cell|nk cell"), F.regexp_replace(s, r"\bcell\b", "cells")).otherwise(s)


def equivalent_name(c: Column, lookup: Column, rules: Sequence[tuple[str, str, bool]]) -> Column:
    """Canonical form by lookup; else by the first rule (regex, replacement, bidirectional) that matches at the start: its
    result looked up, or the result itself if the rule is bidirectional and no earlier one was found; else the name."""
    def resolved(s: Column) -> Column:
        found = [first_value(lookup, lambda k: k == s)]
        known = lambda x: first_value(lookup, lambda k: k == x)
        for pattern, to, both in rules:
            hit = once(F.regexp_replace(s, pattern, to), (lambda x: F.coalesce(known(x), x)) if both else known)
            found.append(F.when(s.rlike(f"^(?:{pattern})"), hit))
        return F.coalesce(*found, s)

    return once(F.lower(stripped(c)), resolved)


def valid_parents(pairs: DataFrame, child: str, parent: str, closure: DataFrame) -> DataFrame:
    """Adds ``valid``: the two canonical names are equal, or the closure (child, parent) has the pair; null names are not valid."""
    known = closure.select(F.col("child").alias("__c"), F.col("parent").alias("__p")).distinct().withColumn("__hit", F.lit(True))
    j = pairs.join(known, (F.col(child) == F.col("__c")) & (F.col(parent) == F.col("__p")), "left")
    return j.withColumn("valid", F.coalesce(F.col(child) == F.col(parent), F.lit(False)) | F.col("__hit").isNotNull()).drop("__c", "__p", "__hit")


def closure_of(parents: DataFrame) -> DataFrame:
    """(child, parent) with the ancestors of a child at any depth as its valid parents; parents: (child, parent)."""
    from evalspan.operators.trees import ancestors

    nodes = parents.select(F.lit(0).alias("tree"), F.col("child").alias("node"), "parent").filter("child is not null").distinct()
    return ancestors(nodes, "tree").select(F.col("node").alias("child"), F.col("ancestor").alias("parent")).distinct()


def registry_match(predicted: DataFrame, truth: DataFrame, key: str, name: str, canonical: str) -> DataFrame:
    """Matches by canonical name per key of either side: several predicted names may match the same true one.

    Of the true names of one canonical form only the first is matched, so precision and recall count
    different things: matching predicted names, and matched true names.
    """
    p, t = (df.filter(F.col(name).isNotNull()).select(key, name, canonical).distinct() for df in (predicted, truth))
    of_p = p.groupBy(key, canonical).agg(F.count("*").alias("__p"))
    of_t = t.groupBy(key, canonical).agg(F.count("*").alias("__t"))
    j = of_p.join(of_t, [key, canonical], "full_outer")
    both = F.col("__p").isNotNull() & F.col("__t").isNotNull()
    g = j.groupBy(key).agg(F.coalesce(F.sum("__p"), F.lit(0)).alias("n_predicted"), F.coalesce(F.sum("__t"), F.lit(0)).alias("n_true"), F.sum(F.when(both, F.col("__p")).otherwise(0)).alias("n_matching"), F.count_if(both).alias("n_matched_true"))
    precision, recall = ratio(F.col("n_matching"), F.col("n_predicted")), ratio(F.col("n_matched_true"), F.col("n_true"))
    return g.select(key, "n_matching", (F.col("n_true") - F.col("n_matched_true")).alias("n_missing"), (F.col("n_predicted") - F.col("n_matching")).alias("n_extra"), r6(precision).alias("precision"), r6(recall).alias("recall"))


def match_f1(matches: DataFrame, predicted: DataFrame, truth: DataFrame, key: str, name: str, weight: Column) -> DataFrame:
    """F1 of one-to-one matches: counted (precision, recall, f1) and weighted (each match by ``weight``)."""
    size = lambda df, c: df.filter(F.col(name).isNotNull()).groupBy(key).agg(F.countDistinct(name).alias(c))
    m = matches.groupBy(key).agg(F.count("*").alias("m"), F.sum(weight).alias("w"))
    j = size(predicted, "np").join(size(truth, "nt"), key, "full_outer").join(m, key, "left").fillna(0, ["np", "nt", "m", "w"])

    def scores(hits: str, prefix: str) -> list[Column]:
        p, r = ratio(F.col(hits), F.col("np")), ratio(F.col(hits), F.col("nt"))
        return [r6(p).alias(f"{prefix}precision"), r6(r).alias(f"{prefix}recall"), r6(ratio(2 * p * r, p + r)).alias(f"{prefix}f1")]

    return j.select(key, "m", *scores("m", ""), *scores("w", "weighted_")).withColumnRenamed("m", "n_matches")


def fuzzy_matches(predicted: DataFrame, truth: DataFrame, key: str, name: str, form: Column, least: float = 0.5, weight: float = 0.8) -> DataFrame:
    """(key, p, t, kind, weight): exact matches of a form of the names, then greedy ones by the Jaccard similarity of their words.

    Greedy matches go by similarity, then by name, where the order of a set would leave it to chance.
    """
    from evalspan.operators.scoring import tiered_matches
    from evalspan.operators.trees import one_to_one

    exact = tiered_matches(predicted, truth, key, name, [("exact", form)])
    rest = lambda df, c: df.select(key, F.col(name).alias(c)).filter(F.col(c).isNotNull()).distinct().join(exact.select(key, c), [key, c], "left_anti")
    words = lambda df, c, n: df.withColumn(name, F.col(c)).withColumn("ws", F.array_distinct(F.filter(F.split(form, r"\s+"), lambda w: w != ""))).select(key, c, F.size("ws").alias(n), F.explode("ws").alias("word"))
    met = words(rest(predicted, "p"), "p", "np").join(words(rest(truth, "t"), "t", "nt"), [key, "word"]).groupBy(key, "p", "t", "np", "nt").agg(F.count("*").alias("c"))
    pairs = met.select(key, "p", "t", (F.col("c") / (F.col("np") + F.col("nt") - F.col("c"))).alias("similarity")).filter(F.col("similarity") >= least)
    fuzzy = one_to_one(pairs, [key], "p", "t", "similarity", least, optimal=False)
    return exact.select(key, "p", "t", F.lit("exact").alias("kind"), F.lit(1.0).alias("weight")).unionByName(fuzzy.select(key, "p", "t", F.lit("fuzzy").alias("kind"), F.lit(weight).alias("weight")))
