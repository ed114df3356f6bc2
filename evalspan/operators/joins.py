"""Joins of evaluation data: comparison pairs, missing work, overrides, theta joins by shared values or intervals.

Joins on keys are plain equi-joins, whose strategy adaptive execution picks by measured size; theta
joins are turned into equi-joins on shared tokens, grid cells or set elements wherever the predicate
allows it, so that no cross product of two tables arises. Defined results: null keys meet nothing
(except where a docstring says null-safe); empty tables give empty joins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspan.functions.columns import r6
from evalspan.session import cut_lineage


def compare_pairs(df: DataFrame, keys: Sequence[str], model: str, a: str, b: str, value: str) -> DataFrame:
    """Rows of two models on equal keys with the difference of a value (symmetric: both sides are filtered alike)."""
    side = lambda name, s: df.filter(F.col(model) == name).select(*keys, F.col(value).alias(f"{value}_{s}"))
    joined = side(a, "a").join(side(b, "b"), list(keys))
    return joined.withColumn("delta", r6(F.col(f"{value}_a") - F.col(f"{value}_b")))


def missing_keys(grid: Sequence[DataFrame], done: DataFrame) -> DataFrame:
    """Combinations of small dimension tables that ``done`` lacks (the grid is the result: a cross join of dimensions)."""
    wanted = reduce(DataFrame.crossJoin, grid)
    return wanted.join(done.select(*wanted.columns).distinct(), list(wanted.columns), "left_anti")


def override_merge(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Old rows with the values of re-run ones taken over where the key was re-run; new keys are added (null-safe keys)."""
    n = new.select(*(F.col(k).alias(f"__n_{k}") for k in keys), F.struct(*values).alias("__new"))
    o = old.select(*keys, F.struct(*values).alias("__old"))
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__n_{k}")) for k in keys])
    j = o.join(n, on, "full_outer")
    row = F.coalesce("__new", "__old")
    return j.select(*(F.when(F.col("__new").isNull(), F.col(k)).otherwise(F.col(f"__n_{k}")).alias(k) for k in keys), *(row[v].alias(v) for v in values), F.when(F.col("__new").isNull(), "old").otherwise("new").alias("origin"))


def lookup(facts: DataFrame, key: str, dimension: DataFrame, dim_key: str, columns: Sequence[str]) -> DataFrame:
    """Left lookup; ``found`` tells misses."""
    dim = dimension.select(F.col(dim_key).alias("__k"), *columns, F.lit(True).alias("__hit"))
    return facts.join(dim, facts[key] == F.col("__k"), "left").withColumn("found", F.coalesce("__hit", F.lit(False))).drop("__k", "__hit")


def fallback_lookup(facts: DataFrame, key: str, dimension: DataFrame, dim_key: str, value: str) -> DataFrame:
    """Exact match first, else the least entry of the same lower-case key; ``via`` says which."""
    exact = dimension.select(F.col(dim_key).alias("__e"), F.col(value).alias("__ev"))
    folded = dimension.groupBy(F.lower(dim_key).alias("__f")).agg(F.min_by(value, dim_key).alias("__fv"))
    j = facts.join(exact, facts[key] == F.col("__e"), "left").join(folded, F.lower(facts[key]) == F.col("__f"), "left")
    via = F.when(F.col("__e").isNotNull(), "exact").when(F.col("__f").isNotNull(), "folded").otherwise("none")
    return j.withColumn("via", via).withColumn(value, F.when(F.col("__e").isNotNull(), F.col("__ev")).otherwise(F.col("__fv"))).drop("__e", "__ev", "__f", "__fv")


def alias_lookup(facts: DataFrame, key: str, names: DataFrame, name: str, aliases: DataFrame, alias: str, canonical: str) -> DataFrame:
    """Name itself, else an alias, else the name without regard to case: ``resolved`` and ``via``."""
    n = names.select(F.col(name).alias("__n")).distinct()
    a = aliases.groupBy(F.lower(alias).alias("__a")).agg(F.min_by(canonical, alias).alias("__c"))
    f = names.groupBy(F.lower(name).alias("__f")).agg(F.min(name).alias("__fn"))
    low = F.lower(facts[key])
    j = facts.join(n, facts[key] == F.col("__n"), "left").join(a, low == F.col("__a"), "left").join(f, low == F.col("__f"), "left")
    via = F.when(F.col("__n").isNotNull(), "name").when(F.col("__c").isNotNull(), "alias").when(F.col("__fn").isNotNull(), "folded").otherwise("none")
    return j.withColumn("resolved", F.coalesce("__n", "__c", "__fn")).withColumn("via", via).drop("__n", "__a", "__c", "__f", "__fn")


def unordered_pairs(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """All pairs of a bounded dimension table, key_a < key_b; for tables that grow, join on shared values instead."""
    a = df.select(F.col(key).alias(f"{key}_a"), *(F.col(c).alias(f"{c}_a") for c in columns))
    b = df.select(F.col(key).alias(f"{key}_b"), *(F.col(c).alias(f"{c}_b") for c in columns))
    return a.join(b, F.col(f"{key}_a") < F.col(f"{key}_b"))


def symmetric_lookup(pairs: DataFrame, a: str, b: str, known: DataFrame, ka: str, kb: str, value: str, otherwise: Column) -> DataFrame:
    """Value of a pair in either order; ``otherwise`` where unknown."""
    k = known.groupBy(F.least(ka, kb).alias("__x"), F.greatest(ka, kb).alias("__y")).agg(F.max(value).alias("__v"))
    return pairs.join(k, (F.least(a, b) == F.col("__x")) & (F.greatest(a, b) == F.col("__y")), "left").withColumn(value, F.coalesce("__v", otherwise)).drop("__x", "__y", "__v")


def interval_overlap(left: DataFrame, right: DataFrame, lo: str, hi: str, cell: float) -> DataFrame:
    """Pairs of rows whose open intervals overlap, by an equi-join on grid cells; ``right`` has r_lo, r_hi.

    A pair that shares several cells is kept in the cell in which its overlap begins. ``fraction`` is the
    overlap's share of the left interval. Null or empty intervals overlap nothing.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / cell), F.floor(b / cell)))
    a = left.filter(F.col(lo) < F.col(hi)).withColumn("__cell", cells(F.col(lo), F.col(hi)))
    b = right.filter("r_lo < r_hi").withColumn("__rcell", cells(F.col("r_lo"), F.col("r_hi")))
    begin, end = F.greatest(F.col(lo), F.col("r_lo")), F.least(F.col(hi), F.col("r_hi"))
    j = a.join(b, F.col("__cell") == F.col("__rcell")).filter((begin < end) & (F.floor(begin / cell) == F.col("__cell")))
    return j.withColumn("fraction", r6((end - begin) / (F.col(hi) - F.col(lo)))).drop("__cell", "__rcell")


#: Buckets that elements of sets are hashed to; elements of sets that a task holds at once, and children that meet them (or a thousandth of all, if that is more).
ELEMENT_BUCKETS, ELEMENTS_AT_ONCE, CHILDREN_AT_ONCE = 1024, 500_000, 20_000
#: Sets that are compared one by one rather than told apart by a further element.
_LEAF = 16


def _trie(sets: list[tuple]) -> list:
    """Nodes (size of the largest set, set that ends here, nodes by next element, sets by falling size) of (elements, first, second)."""
    root: list = []
    todo = [(root, sets, 0)]
    while todo:
        node, own, depth = todo.pop()
        node.append(max(len(x[0]) for x in own))
        if len(own) <= _LEAF:
            node += [None, None, sorted(own, key=lambda x: -len(x[0]))]
            continue
        end, inner = None, {}
        for x in own:
            if len(x[0]) == depth:
                end = x
            else:
                inner.setdefault(x[0][depth], []).append(x)
        nodes: dict = {e: [] for e in inner}
        node += [end, nodes, None]
        todo += [(nodes[e], part, depth + 1) for e, part in inner.items()]
    return root


def _largest_within(root: list, have: set, size: int, child: object) -> tuple[int, object]:
    """Size and name of the largest set of a trie that ``have`` holds, of fewer than ``size`` elements and not named ``child``."""
    best, name, todo = 0, None, [root]
    while todo:
        most, end, inner, leaf = todo.pop()
        if most < best:
            continue
        for elements, first, second in leaf if inner is None else [end] if end else ():
            n = len(elements)
            if n < best:
                break
            if n < size and have.issuperset(elements):
                own = first if first != child else second
                if own is not None and (n > best or own < name):
                    best, name = n, own
        if inner is not None:
            todo += [node for e, node in inner.items() if e in have] if len(inner) <= len(have) else [inner[e] for e in have if e in inner]
    return best, name


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of part, sets before children: the largest proper subset of each child in its part."""
    part, sets, root, shared = None, [], None, {}
    for b in batches:
        found: tuple[list, list, list] = ([], [], [])
        for p, is_child, child, size, elements, first, second in zip(*(c.to_pylist() for c in b.columns)):
            if p != part:
                part, sets, root, shared = p, [], None, {}
            if not is_child:
                sets.append((tuple(shared.setdefault(e, e) for e in elements), first, second))
                continue
            if root is None:
                if not sets:
                    continue
                root = _trie(sets)
            n, name = _largest_within(root, set(elements), size, child)
            if n:
                for column, v in zip(found, (child, n, name)):
                    column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(found[0], b.schema.field("child").type), pa.array(found[1], pa.int32()), pa.array(found[2], b.schema.field("first").type)], ["child", "n", "parent"])


def most_specific_container(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Largest proper subset among the parents' sets for every child: child, parent.

    children (child, elements), parents (parent, elements): the elements of all sets are brought in one order, the rarest
    first (rarity is counted by buckets of elements, in distinct sets of parents). A set is contained only if its rarest
    element is, so it waits at the bucket of that element alone, and a child calls at the buckets of all its elements with
    those that follow. There the sets are a trie in that order, of which a child walks only the branches that it has;
    an element that all sets have is nobody's way in unless it's all a set has. What a task holds is bounded: buckets
    with many sets or children are divided. Equal sets among the parents are looked up once. Equal sizes fall to the
    least name; empty sets are nobody's parent.
    """
    sets = parents.filter("parent is not null").select("parent", F.array_sort(F.array_distinct("elements")).alias("pe")).filter(F.size("pe") > 0)
    # A child is no parent of its own, under whatever set its name occurs: the two least names of a set will do.
    names = sets.withColumn("n", F.dense_rank().over(Window.partitionBy("pe").orderBy("parent"))).filter("n <= 2")
    distinct = cut_lineage(names.groupBy("pe").agg(F.min("parent").alias("first"), F.max(F.when(F.col("n") == 2, F.col("parent"))).alias("second")))
    calls = children.filter("child is not null").select("child", F.array_distinct("elements").alias("e")).filter(F.size("e") > 0)

    bucket = lambda x: F.pmod(F.xxhash64(x), F.lit(ELEMENT_BUCKETS)).cast("int")
    at = lambda values, h: F.element_at(F.array(*map(F.lit, values)), h + 1)

    def sums(rows: DataFrame, h: Column, value: Column) -> list[int]:
        out = [0] * ELEMENT_BUCKETS
        for r in rows.select(h.alias("h"), value.alias("v")).groupBy("h").agg(F.sum("v").alias("v")).collect():
            out[r["h"]] = r["v"]
        return out

    rarity = sums(distinct.select(F.explode("pe").alias("x")), bucket(F.col("x")), F.lit(1).cast("bigint"))
    # Nulls come last: they are nobody's way in.
    ranked = lambda c: F.sort_array(F.transform(c, lambda x: F.struct(F.when(x.isNull(), F.lit(1 << 62)).otherwise(at(rarity, bucket(x)).cast("bigint")).alias("c"), bucket(x).alias("h"), x.alias("x"))))
    p = distinct.select("pe", "first", "second", ranked("pe").alias("o")).filter(F.col("o")[0]["x"].isNotNull()).withColumn("h", F.col("o")[0]["h"])
    begins = F.filter(F.sequence(F.lit(1), F.size("o")), lambda i: F.element_at("o", i)["x"].isNotNull() & ((i == 1) | (F.element_at("o", i)["h"] != F.element_at("o", F.greatest(i - 1, F.lit(1)))["h"])))
    c = calls.select("child", ranked("e").alias("o")).select("child", "o", F.explode(begins).alias("i")).withColumn("h", F.element_at("o", F.col("i"))["h"])
    waiting, calling = sums(p, F.col("h"), F.size("pe").cast("bigint")), sums(c, F.col("h"), F.lit(1).cast("bigint"))
    least = max(CHILDREN_AT_ONCE, sum(calling) // 1000)
    blocks, shares = [-(-n // ELEMENTS_AT_ONCE) for n in waiting], [max(1, -(-n // least)) for n in calling]

    h = F.col("h")
    part = lambda block, share: (h.cast("bigint") + ELEMENT_BUCKETS * (block.cast("bigint") + (1 << 21) * share.cast("bigint"))).alias("part")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    kinds = {"child": dict(children.dtypes)["child"], "parent": dict(parents.dtypes)["parent"]}
    some, other = F.lit(None).cast(kinds["child"]), F.lit(None).cast(kinds["parent"])
    elements = lambda o: F.transform(o, lambda x: x["x"]).alias("elements")
    held = p.select("*", upto(at(shares, h)).alias("share")).select(part(F.pmod(F.xxhash64("pe"), at(blocks, h)), F.col("share")), F.lit(False).alias("is_child"), some.alias("child"), F.size("pe").alias("size"), elements(F.col("o")), "first", "second")
    sent = c.filter(at(blocks, h) > 0).select("*", upto(at(blocks, h)).alias("block")).select(part(F.col("block"), F.pmod(F.xxhash64("child"), at(shares, h))), F.lit(True).alias("is_child"), "child", F.size("o").alias("size"), elements(F.slice("o", F.col("i"), F.size("o"))), other.alias("first"), other.alias("second"))
    met = held.unionAll(sent).repartition("part").sortWithinPartitions("part", "is_child").mapInArrow(_meet, f"child {kinds['child']}, n int, parent {kinds['parent']}")
    best = met.groupBy("child").agg(F.min_by("parent", F.struct(-F.col("n"), F.col("parent"))).alias("parent"))
    return children.select("child").join(best, "child", "left")


def gram_contains(left: DataFrame, a: str, right: DataFrame, b: str, q: int = 3) -> DataFrame:
    """Pairs (a, b) of distinct names of which one contains the other, found by the rarest way in: names share
    the q-gram with which the shorter one begins. Names below q characters are met by their whole text's prefix join."""
    x, y = left.select(a).filter(F.col(a) != "").distinct(), right.select(b).filter(F.col(b) != "").distinct()
    inner = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substring(c, i, F.lit(q))))
    first = lambda c: F.substring(c, 1, q)
    pieces = lambda c: F.array_distinct(F.flatten(F.transform(inner(c), lambda g: F.transform(F.sequence(F.lit(1), F.length(g)), lambda n: F.substring(g, F.lit(1), n)))))
    ab = x.withColumn("g", F.explode(pieces(F.col(a)))).join(y.withColumn("h", first(F.col(b))), F.col("g") == F.col("h")).filter(F.col(a).contains(F.col(b)))
    ba = y.withColumn("g", F.explode(pieces(F.col(b)))).join(x.withColumn("h", first(F.col(a))), F.col("g") == F.col("h")).filter(F.col(b).contains(F.col(a)))
    return ab.select(a, b).unionByName(ba.select(a, b)).distinct()
