"""Trees as node tables, and their comparison.

A node table has tree, node, parent (null at the root), name and depth. Walks double their reach with
every join over the whole table, so they take as many rounds as the deepest tree's depth has bits; the rows
of a round are written once to the checkpoint folder. Pair measures
that need a whole tree (edit distance, assignments) work on one tree pair at a time, whose size is that
of a single record. Defined results: duplicate names count once in sets and keep their number where a
docstring says rows; empty trees have depth 0, no leaves, and are alike (1.0) to each other.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspan.functions.columns import r6, ratio
from evalspan.functions.jsontext import response_nodes
from evalspan.session import cut_lineage


def tree_stats(nodes: DataFrame, tree: str) -> DataFrame:
    """Depth, nodes, distinct names, leaves and mean children of inner nodes per tree."""
    parents = nodes.filter("parent is not null").groupBy(F.col(tree).alias("t"), F.col("parent").alias("p")).agg(F.count("*").alias("children"))
    j = nodes.join(parents, (F.col(tree) == F.col("t")) & (F.col("node") == F.col("p")), "left")
    return j.groupBy(tree).agg(F.max("depth").alias("max_depth"), F.count("*").alias("n_nodes"), F.countDistinct("name").alias("n_names"), F.count_if(F.col("children").isNull()).alias("n_leaves"), r6(F.coalesce(F.avg("children"), F.lit(0.0))).alias("branching"))


def ancestors(nodes: DataFrame, tree: str) -> DataFrame:
    """(tree, node, ancestor, distance) of all ancestors at any depth.

    If the parents of some nodes run in a circle, every (node, ancestor) is given once, at its first distance; the
    nodes of the circle are ancestors of themselves.
    """
    columns = (tree, "node", "ancestor", "distance")
    found = cut_lineage(nodes.filter("parent is not null").select(tree, "node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")))
    jump, reach, circle = found, 1, not found.filter("node = ancestor").isEmpty()
    while True:
        # A way of up to 2 * reach steps is one of exactly reach steps and a shorter one from there.
        far = found.select(F.col(tree).alias("t"), F.col("node").alias("n"), F.col("ancestor").alias("above"), F.col("distance").alias("more"))
        step = jump.join(far, (F.col(tree) == F.col("t")) & (F.col("ancestor") == F.col("n")))
        new = every = cut_lineage(step.select(tree, "node", F.col("above").alias("ancestor"), (F.col("more") + reach).alias("distance")))
        circle = circle or not new.filter("node = ancestor").isEmpty()
        if circle:
            first = every.groupBy(*columns[:3]).agg(F.min("distance").alias("distance"))
            new = cut_lineage(first.join(found, list(columns[:3]), "left_anti").select(*columns))
        if new.isEmpty():
            return found
        found, reach = found.unionAll(new), reach * 2
        jump = every.filter(F.col("distance") == reach)


def leaf_paths(nodes: DataFrame, tree: str, separator: str = " > ") -> DataFrame:
    """(tree, node, path): names from the root to every leaf."""
    up = ancestors(nodes, tree)
    names = nodes.select(F.col(tree).alias("t"), F.col("node").alias("n"), "name", F.col("depth").alias("d"))
    inner = nodes.filter("parent is not null").select(F.col(tree).alias("t"), F.col("parent").alias("n")).distinct()
    leaves = nodes.join(inner, (F.col(tree) == F.col("t")) & (F.col("node") == F.col("n")), "left_anti").select(tree, "node", "name")
    chain = leaves.select(tree, "node").join(up, [tree, "node"]).join(names, (F.col(tree) == F.col("t")) & (F.col("ancestor") == F.col("n"))).select(tree, "node", "d", "name")
    above = chain.groupBy(tree, "node").agg(F.array_sort(F.collect_list(F.struct("d", "name"))).alias("up"))
    return leaves.join(above, [tree, "node"], "left").select(tree, "node", F.concat_ws(separator, F.transform("up", lambda x: x["name"]), F.col("name")).alias("path"))


def siblings(nodes: DataFrame, tree: str) -> DataFrame:
    """(tree, node, n_siblings): other nodes below the same parent."""
    counts = nodes.groupBy(F.col(tree).alias("t"), F.col("parent").alias("p")).agg(F.count("*").alias("c"))
    return nodes.join(counts, (F.col(tree) == F.col("t")) & F.col("parent").eqNullSafe(F.col("p"))).select(tree, "node", (F.col("c") - 1).alias("n_siblings"))


def structural_errors(nodes: DataFrame, tree: str) -> DataFrame:
    """Validation per tree: duplicate names, orphans (a parent that is no node), roots."""
    dup = nodes.groupBy(tree, "name").agg(F.count("*").alias("c")).groupBy(tree).agg(F.count_if(F.col("c") > 1).alias("duplicate_names"))
    known = nodes.select(F.col(tree).alias("t"), F.col("node").alias("n"), F.lit(1).alias("hit"))
    j = nodes.join(known, (F.col(tree) == F.col("t")) & (F.col("parent") == F.col("n")), "left")
    rest = j.groupBy(tree).agg(F.count_if(F.col("parent").isNotNull() & F.col("hit").isNull()).alias("orphans"), F.count_if(F.col("parent").isNull()).alias("roots"))
    return dup.join(rest, tree)


def _structure_parts(predicted: DataFrame, truth: DataFrame, tree: str, valid: DataFrame | None) -> DataFrame:
    """The measures of compare_structure, not rounded, and the depth histograms."""

    def edges(df: DataFrame) -> DataFrame:
        p = df.select(F.col(tree).alias("t"), F.col("node").alias("n"), F.col("name").alias("parent_name"))
        return df.join(p, (F.col(tree) == F.col("t")) & (F.col("parent") == F.col("n"))).select(tree, "name", "parent_name", "depth")

    def overlap(a: DataFrame, b: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
        x, y = a.select(tree, *cols).distinct().withColumn("a", F.lit(1)), b.select(tree, *cols).distinct().withColumn("b", F.lit(1))
        j = x.join(y, [tree, *cols], "full_outer")
        return j.groupBy(tree).agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias(f"{name}_both"), F.count("a").alias(f"{name}_a"), F.count("b").alias(f"{name}_b"), F.count("*").alias(f"{name}_any"))

    ea, eb = edges(predicted), edges(truth)
    names, links = overlap(predicted, truth, ["name"], "name"), overlap(ea, eb, ["name", "parent_name"], "edge")
    levels = lambda df, n: df.groupBy(tree, "depth").agg(F.count("*").alias(n))
    hist = levels(predicted, "ca").join(levels(truth, "cb"), [tree, "depth"], "full_outer").fillna(0, ["ca", "cb"])
    depth = hist.groupBy(tree).agg((F.sum(F.least("ca", "cb")) / F.sum(F.greatest("ca", "cb"))).alias("depth_similarity"))
    found = ea.select(tree, "name", "parent_name", "depth").distinct().withColumn("hit", F.lit(1))
    matched = eb.join(found, [tree, "name", "parent_name", "depth"], "left")
    if valid is not None:
        second = ea.join(valid.select("name", "parent_name"), ["name", "parent_name"], "left_semi").select(tree, "name", "depth").distinct().withColumn("second", F.lit(1))
        matched = matched.join(second, [tree, "name", "depth"], "left").withColumn("hit", F.coalesce("hit", "second"))
    exact = matched.groupBy(tree).agg((F.count("hit") / F.count("*")).alias("structure_accuracy"))
    j = names.join(links, tree, "left").join(depth, tree, "left").join(exact, tree, "left")
    f1 = ratio(2 * F.col("name_both"), F.col("name_a") + F.col("name_b"))
    return j.select(tree, f1.alias("name_f1"), (F.col("name_both") / F.col("name_any")).alias("node_jaccard"), F.coalesce(F.col("edge_both") / F.col("edge_any"), F.lit(1.0)).alias("edge_jaccard"), F.coalesce("depth_similarity", F.lit(1.0)).alias("depth_similarity"), F.coalesce("structure_accuracy", F.lit(0.0)).alias("structure_accuracy"))


def compare_structure(predicted: DataFrame, truth: DataFrame, tree: str, valid: DataFrame | None = None) -> DataFrame:
    """Set F1 of names, Jaccard of nodes and of (parent, child) edges, depth histogram overlap, structure accuracy per tree.

    Structure accuracy is the share of true rows (name, parent name, depth) below the root that are predicted. With
    ``valid``, all pairs (name, parent_name) of a hierarchy at any distance, a true row also counts if its name is
    predicted at its depth below a valid parent.
    """
    j = _structure_parts(predicted, truth, tree, valid)
    return j.select(tree, *(r6(F.col(c)).alias(c) for c in j.columns if c != tree))


def structure_similarity(predicted: DataFrame, truth: DataFrame, tree: str) -> DataFrame:
    """Composite per tree: .25 node and .25 edge Jaccard, .15 shares of depths, .10 branching, .25 edit similarity.

    Depths are compared by the smaller share of rows at each depth, branching by the mean children of a node (leaves
    included), edits by the distance over the larger size. A tree of one side only has nothing in common.
    """
    size = lambda df, s: df.groupBy(tree).agg(F.count("*").alias(f"n_{s}"), (F.count("parent") / F.count("*")).alias(f"mean_{s}"))
    sizes = size(predicted, "p").join(size(truth, "t"), tree, "full_outer")
    levels = lambda df, s: df.groupBy(tree, "depth").agg(F.count("*").alias(f"c_{s}"))
    shared = levels(predicted, "p").join(levels(truth, "t"), [tree, "depth"]).join(sizes, tree)
    depth = shared.groupBy(tree).agg(F.sum(F.least(F.col("c_p") / F.col("n_p"), F.col("c_t") / F.col("n_t"))).alias("depths"))
    j = _structure_parts(predicted, truth, tree, None).select(tree, "node_jaccard", "edge_jaccard").join(sizes, tree).join(depth, tree, "left").join(edit_distances(predicted, truth, tree).select(tree, "distance"), tree)
    both = F.col("n_p").isNotNull() & F.col("n_t").isNotNull()
    widest = F.greatest("mean_p", "mean_t")
    branching = F.when(~both, 0.0).when(widest == 0, 1.0).otherwise(1 - F.abs(F.col("mean_p") - F.col("mean_t")) / widest)
    edits = 1 - F.least(F.lit(1.0), F.col("distance") / F.greatest("n_p", "n_t"))
    parts = {"node_similarity": F.col("node_jaccard"), "edge_similarity": F.when(both, F.col("edge_jaccard")).otherwise(0.0), "depth_similarity": F.coalesce("depths", F.lit(0.0)), "branching_similarity": branching, "edit_similarity": edits}
    overall = sum(w * c for w, c in zip((0.25, 0.25, 0.15, 0.10, 0.25), parts.values()))
    return j.select(tree, *(r6(c).alias(n) for n, c in parts.items()), r6(overall).alias("similarity"))


def tree_edit_distance(a: tuple | None, b: tuple | None) -> int:
    """Distance of two trees (name, children), in which a node may be relabelled (1), deleted or inserted with a subtree (its size).

    D(a, b) = min(relabel + best assignment of the children, 1 + sum D(child of a, b), 1 + sum D(a, child of b)).
    """

    @lru_cache(None)
    def size(t: tuple) -> int:
        return 1 + sum(map(size, t[1]))

    @lru_cache(None)
    def distance(x: tuple, y: tuple) -> int:
        best = int(x[0] != y[0]) + children(x[1], y[1])
        # Trees of different sizes are at least 1 apart, so a way that can't be shorter isn't walked.
        if x[1] and best > 1 + sum(size(c) != size(y) for c in x[1]):
            best = min(best, 1 + sum(distance(c, y) for c in x[1]))
        if y[1] and best > 1 + sum(size(c) != size(x) for c in y[1]):
            best = min(best, 1 + sum(distance(x, c) for c in y[1]))
        return best

    def children(xs: tuple, ys: tuple) -> int:
        if not xs or not ys:
            return sum(map(size, xs or ys))
        n = max(len(xs), len(ys))
        if not any(t[1] for t in xs) and not any(t[1] for t in ys):  # leaves: every pair costs 0 or 1
            return n - (Counter(t[0] for t in xs) & Counter(t[0] for t in ys)).total()
        cost = [[distance(xs[i], ys[j]) if i < len(xs) and j < len(ys) else size(xs[i]) if i < len(xs) else size(ys[j]) for j in range(n)] for i in range(n)]
        return int(sum(cost[i][j] for i, j in enumerate(assign(cost))))

    if a is None or b is None:
        return size(a or b) if (a or b) else 0
    if not any(c[1] for c in a[1]) and not any(c[1] for c in b[1]):
        return _flat_distance(a[0], [c[0] for c in a[1]], b[0], [c[0] for c in b[1]])
    return distance(a, b)


def _flat_distance(x: str, xs: list[str], y: str, ys: list[str]) -> int:
    """The edit distance of two roots with leaves only, in closed form."""

    def lone(leaf: str, root: str, leaves: list[str]) -> int:
        n = len(leaves)
        return min((leaf != root) + n, 1 + n - leaves.count(leaf)) if n else int(leaf != root)

    rest, same = ys.copy(), 0
    for name in xs:
        if name in rest:
            rest.remove(name)
            same += 1
    best = (x != y) + max(len(xs), len(ys)) - same
    if xs and best > 1:
        best = min(best, 1 + sum(lone(c, y, ys) for c in xs))
    if ys and best > 1:
        best = min(best, 1 + sum(lone(c, x, xs) for c in ys))
    return best


def assign(cost: Sequence[Sequence[float]]) -> list[int]:
    """Column of every row in the cheapest one-to-one assignment of a square matrix (shortest augmenting paths)."""
    n, inf = len(cost), float("inf")
    u, v, match = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)  # potentials; match: row of a column, 1-based
    for row in range(1, n + 1):
        match[0], column = row, 0
        slack, way, seen = [inf] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while match[column]:
            seen[column] = True
            here, step, nxt = match[column], inf, 0
            for j in range(1, n + 1):
                if not seen[j]:
                    reduced = cost[here - 1][j - 1] - u[here] - v[j]
                    if reduced < slack[j]:
                        slack[j], way[j] = reduced, column
                    if slack[j] < step:
                        step, nxt = slack[j], j
            for j in range(n + 1):
                if seen[j]:
                    u[match[j]] += step
                    v[j] -= step
                else:
                    slack[j] -= step
            column = nxt
        while column:
            match[column], column = match[way[column]], way[column]
    out = [0] * n
    for j in range(1, n + 1):
        out[match[j] - 1] = j - 1
    return out


def _nest(rows: list) -> tuple | None:
    kids: dict[str | None, list] = {}
    for r in sorted(rows, key=lambda r: r["node"]):
        kids.setdefault(r["parent"], []).append(r)
    build = lambda r: (r["name"], tuple(build(c) for c in kids.get(r["node"], [])))
    roots = kids.get(None, [])
    return build(roots[0]) if roots else None


def edit_distances(predicted: DataFrame, truth: DataFrame, tree: str) -> DataFrame:
    """Edit distance of the two trees of a key, and it divided by the larger size (1 at most)."""
    pack = lambda df, name: df.groupBy(tree).agg(F.collect_list(F.struct("node", "parent", "name")).alias(name))
    both = pack(predicted, "a").join(pack(truth, "b"), tree, "full_outer")

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for key, a, b in zip(part[tree], part["a"], part["b"]):
                a, b = list(a) if a is not None else [], list(b) if b is not None else []
                d = tree_edit_distance(_nest(a), _nest(b))
                rows.append((key, d, round(min(1.0, d / max(len(a), len(b), 1)), 6)))
            yield pd.DataFrame(rows, columns=[tree, "distance", "normalised"])

    kind = dict(predicted.dtypes)[tree]
    return both.mapInPandas(measure, f"`{tree}` {kind}, distance bigint, normalised double")


def answer_distances(df: DataFrame, key: str, actual: str, reference: str) -> DataFrame:
    """Edit distance of the trees in an answer and in its reference text, and it divided by the larger size; no tree is an empty tree.

    Row-wise, as an answer is one record: no node is shuffled.
    """

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def tree_of(text: str | None) -> tuple[tuple | None, int]:
            nodes = response_nodes(text)[1]  # the root first, parents before their children
            kids: list[list] = [[] for _ in nodes]
            for i, p, name in reversed(nodes):
                built = (name, tuple(kids[i][::-1]))
                if p is not None:
                    kids[p].append(built)
            return (built if nodes else None), len(nodes)

        reference_tree = lru_cache(1 << 10)(tree_of)
        for part in parts:
            rows = []
            for k, x, y in zip(part[key], part[actual], part[reference]):
                (a, n), (b, m) = tree_of(x), reference_tree(y)
                d = tree_edit_distance(a, b)
                rows.append((k, d, round(min(1.0, d / max(n, m, 1)), 6)))
            yield pd.DataFrame(rows, columns=[key, "distance", "normalised"])

    return df.select(key, actual, reference).mapInPandas(measure, f"`{key}` {dict(df.dtypes)[key]}, distance bigint, normalised double")


def one_to_one(pairs: DataFrame, key: Sequence[str], left: str, right: str, similarity: str, least: float, optimal: bool = True) -> DataFrame:
    """One-to-one matches per key from candidate pairs: optimal assignment, or greedy by (similarity, names) descending.

    Both keep matches of at least ``least``; candidates of a key are those of one record.
    """

    def match(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([similarity, left, right], ascending=[False, True, True])
        keys = [part[k].iloc[0] for k in key]
        if optimal:
            ls, rs = sorted(part[left].unique()), sorted(part[right].unique())
            n = max(len(ls), len(rs))
            cost = [[1.0] * n for _ in range(n)]
            for a, b, s in zip(part[left], part[right], part[similarity]):
                i, j = ls.index(a), rs.index(b)
                cost[i][j] = min(cost[i][j], 1 - s)
            chosen = [(ls[i], rs[j], 1 - cost[i][j]) for i, j in enumerate(assign(cost)) if i < len(ls) and j < len(rs)]
        else:
            free_l, free_r, chosen = set(part[left]), set(part[right]), []
            for a, b, s in zip(part[left], part[right], part[similarity]):
                if a in free_l and b in free_r:
                    free_l.remove(a)
                    free_r.remove(b)
                    chosen.append((a, b, s))
        rows = [(*keys, a, b, round(s, 6), "exact" if s >= 0.999 else "high" if s >= 0.85 else "medium") for a, b, s in chosen if s >= least - 1e-12]
        return pd.DataFrame(rows, columns=[*key, left, right, similarity, "kind"])

    kinds = dict(pairs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*key, left, right)) + f", `{similarity}` double, kind string"
    return pairs.groupBy(*key).applyInPandas(match, schema)


def from_populations(rows: DataFrame, tree: str, spine: Sequence[str] = ("All Events", "Singlets", "Live")) -> DataFrame:
    """Node table of marker tables (tree, population, parent, markers): names serve as nodes.

    The parent is the given one, else the population of the tree with the largest proper subset of the
    markers, else the end of the spine. Given parents that are no population become nodes there.
    """
    from evalspan.operators.joins import most_specific_container

    p = rows.filter(F.col("population").isNotNull()).groupBy(tree, "population").agg(F.max("parent").alias("parent"), F.flatten(F.collect_set("markers")).alias("markers"))
    key = F.to_json(F.struct(F.col(tree).alias("t"), F.col("population").alias("p")))
    sets = p.select(key.alias("child"), F.transform("markers", lambda m: F.concat_ws("|", F.col(tree).cast("string"), m)).alias("elements"))
    inferred = most_specific_container(sets, sets.withColumnRenamed("child", "parent")).withColumnRenamed("parent", "__above")
    j = p.withColumn("__key", key).join(inferred, F.col("__key") == F.col("child"), "left")
    above = F.coalesce("parent", F.get_json_object("__above", "$.p"), F.lit(spine[-1]))
    own = j.filter(~F.col("population").isin(*spine)).select(tree, F.col("population").alias("node"), above.alias("parent"))
    trees = p.select(tree).distinct()
    links = F.array(*(F.struct(F.lit(n).alias("node"), F.lit(spine[i - 1] if i else None).cast("string").alias("parent")) for i, n in enumerate(spine)))
    backbone = trees.select(tree, F.inline(links))
    stubs = own.select(tree, F.col("parent").alias("node")).distinct().join(own.select(tree, "node").unionAll(backbone.select(tree, "node")), [tree, "node"], "left_anti").select(tree, "node", F.lit(spine[-1]).alias("parent"))
    nodes = own.unionAll(stubs).unionAll(backbone).withColumn("name", F.col("node"))
    depth = ancestors(nodes, tree).groupBy(F.col(tree).alias("__t"), F.col("node").alias("__n")).agg(F.count("*").cast("int").alias("d"))
    return nodes.join(depth, (F.col(tree) == F.col("__t")) & (F.col("node") == F.col("__n")), "left").select(tree, "node", "parent", "name", F.coalesce("d", F.lit(0)).alias("depth"))
