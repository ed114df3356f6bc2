"""Best representative of each group of duplicate records.

Groups: records that share an identifier, directly or through others. Records with the same set of
identifiers collapse first, so copies cost nothing in the graph; components of the identifiers are
found by alternating large-star and small-star rounds, each of which is a combined aggregate and a
join on one node, written to the shared checkpoint folder. A hub joins with its one minimum (a
skewed join that adaptive execution splits); no neighbourhood is collected.

Choice: fields that depend on each other form a *bundle*; a bundle is taken whole from one record. A
functional dependency x -> y between fields of two bundles demands that the chosen y occurs with the
chosen x in some record of the group. Bundles are branched one after the other, all groups at once:

* branch: partial choices meet the candidates of the next bundle only through the value pairs that
  occur in the group, so no cross product within a group arises;
* dominance: of the partial choices that look alike to the remaining dependencies, the most trusted
  one is kept (an aggregate that combines before the shuffle);
* bound: a partial choice that cannot reach the best single record, even with the best candidates of all
  remaining bundles, is cut. A single record always obeys the dependencies, so it is a valid first solution.

Of the consistent choices the most complete one wins (most bundles of a component, i.e. of bundles linked
by dependencies); among those the most trusted one. Trust is an array of numbers per record and bundle. The
first number is summed over the bundles of a component and is maximised; ties fall to the rest, bundle by bundle.
Bundles without dependencies are components of their own: there the greatest array wins.

Defined results for odd input: a record without any identifier is a group of its own; null trust
counts as less than any number, NaN as null; null values are values in a dependency; a bundle for
which no record of the group is usable is null and sets no condition on others; where no consistent choice
fills all bundles, those of the less trusted choice are null; an empty table gives an empty table; ties in all numbers fall
to the greatest payload; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspan.session import cut_lineage

#: Trust of an absent number; real ones are greater.
NONE = -1e300


def number_key(value: Column, prefix: str) -> Column:
    """Identifier that is a number behind an optional prefix (a regex): case, marks and leading zeros don't matter.

    Null for placeholders, i.e. without a digit other than 0.
    """
    plain = F.upper(F.regexp_replace(value, "[^A-Za-z0-9]+", ""))
    bare = F.regexp_replace(F.regexp_replace(plain, f"^(?:{prefix})", ""), "^0+", "")
    return F.when(bare.rlike("[1-9]"), bare)


def doi_key(value: Column) -> Column:
    """DOI without resolver, label, case, separators and surrounding marks; null for placeholders (no digit behind the slash)."""
    doi = F.regexp_extract(F.lower(value), r"(10\.\d{3,9}/\S+)", 1)
    suffix = F.regexp_replace(doi, "^[^/]*/", "")
    return F.when(suffix.rlike("[1-9]"), F.concat(F.regexp_extract(doi, r"^10\.(\d+)/", 1), F.lit("/"), F.regexp_replace(suffix, "[^a-z0-9]+", "")))


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star round; edges are (u, v) with u > v."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(low, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
    small = large.join(low, F.col("u") == F.col("c")).select("u", "v", "m")
    return small.select("u", F.col("m").alias("v")).unionAll(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v) but the roots; root is the least node of the component."""
    edges = cut_lineage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(edges)
    while True:
        edges = cut_lineage(_stars(edges))
        after = mark(edges)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after


def with_roots(records: DataFrame, record_id: str, keys: dict[str, Column]) -> DataFrame:
    """Records with ``root``, equal for all that are connected by equal keys of the same name."""
    typed = F.array_compact(F.array(*(F.concat(F.lit(f"{name}:"), k) for name, k in keys.items())))
    keyed = records.withColumn("__keys", typed)
    sets = keyed.filter(F.size("__keys") > 1).select("__keys").distinct()
    edges = sets.select(F.get("__keys", F.lit(0)).alias("u"), F.explode(F.slice("__keys", 2, len(keys))).alias("v"))
    roots = components(edges)
    first = keyed.withColumn("__key", F.coalesce(F.get("__keys", F.lit(0)), F.concat(F.lit("-:"), F.col(record_id).cast("string"))))
    rooted = first.join(roots, F.col("__key") == F.col("node"), "left")
    return rooted.withColumn("root", F.coalesce("root", "__key")).drop("__keys", "__key", "node")


def duplicate_groups(records: DataFrame, record_id: str, keys: dict[str, Column]) -> DataFrame:
    """(record_id, group): the least record id among all records connected by equal keys of the same name."""
    rooted = with_roots(records.select(F.col(record_id).alias("record_id"), *(k.alias(f"__{n}") for n, k in keys.items())), "record_id", {n: F.col(f"__{n}") for n in keys}).select("record_id", "root")
    least = rooted.groupBy("root").agg(F.min("record_id").alias("group")).withColumnRenamed("root", "r")
    return rooted.join(least, F.col("root") == F.col("r")).select("record_id", "group")


@dataclass
class Bundle:
    """Fields taken whole from one record; trust: numbers, the first of which is summed within a component."""

    name: str
    fields: dict[str, Column]
    trust: Sequence[Column]
    usable: Column = field(default_factory=lambda: F.lit(True))


@dataclass(frozen=True)
class Dependency:
    """Field ``x`` of bundle ``a`` determines field ``y`` of bundle ``b``."""

    a: str
    x: str
    b: str
    y: str


def _candidate(b: Bundle) -> Column:
    trust = F.array(*(F.coalesce(F.nanvl(t.cast("double"), F.lit(None).cast("double")), F.lit(NONE)) for t in b.trust))
    return F.when(b.usable, F.struct(trust.alias("trust"), F.struct(*(c.alias(n) for n, c in b.fields.items())).alias("row")))


def _parts(bundles: Sequence[Bundle], dependencies: Sequence[Dependency]) -> list[list[Bundle]]:
    """Connected bundles, each list in an order in which every bundle but the first is linked to an earlier one."""
    left, parts = list(bundles), []
    while left:
        part = [left.pop(0)]
        while linked := next((b for b in left if any({d.a, d.b} & {p.name for p in part} and b.name in (d.a, d.b) for d in dependencies)), None):
            left.remove(linked)
            part.append(linked)
        parts.append(part)
    return parts


def _search(candidates: DataFrame, part: list[Bundle], dependencies: Sequence[Dependency]) -> DataFrame:
    """Best consistent choice of linked bundles per group: (group, one struct per bundle, null where nothing is chosen)."""
    names = [b.name for b in part]
    links = [d for d in dependencies if d.a in names]
    order = {n: i for i, n in enumerate(names)}
    here = {n: F.col(n).isNotNull().cast("int") for n in names}
    scalar = {n: F.when(F.col(n).isNull(), 0.0).otherwise(F.greatest(F.get(F.col(n)["trust"], F.lit(0)), F.lit(0.0))) for n in names}
    worth = lambda chosen: F.struct(reduce(Column.__add__, [here[n] for n in chosen]).alias("bundles"), reduce(Column.__add__, [scalar[n] for n in chosen]).alias("trust"))
    # The best single record is the first solution; the best candidate of every bundle gives the bounds.
    limits = candidates.groupBy("group").agg(F.max(worth(names)).alias("first"), *(F.max(scalar[n]).alias(f"best_{n}") for n in names), *(F.max(here[n]).alias(f"any_{n}") for n in names)).withColumnRenamed("group", "g")
    ends = {n: sorted({d.x for d in links if d.a == n} | {d.y for d in links if d.b == n}) for n in names}
    value = lambda n, f: F.when(F.col(n).isNotNull(), F.to_json(F.struct(F.col(n)["row"][f].alias("v"))))

    def options(n: str) -> DataFrame:
        at = [value(n, f).alias(f"{n}__{f}") for f in ends[n]]
        return candidates.filter(F.col(n).isNotNull()).select("group", *at, n).groupBy("group", *(f"{n}__{f}" for f in ends[n])).agg(F.max(n).alias(n))

    def or_nothing(found: DataFrame, state: DataFrame, n: str) -> DataFrame:
        missing = [c for c in found.columns if c not in state.columns]
        return found.unionByName(state.select("*", *(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in missing)))

    state = or_nothing(options(names[0]), candidates.select("group").distinct(), names[0])
    for i, n in enumerate(names[1:], 1):
        mine = [d for d in links if n in (d.a, d.b) and order[d.b if d.a == n else d.a] < i]
        there = sorted({(d.b, d.y) if d.a == n else (d.a, d.x) for d in mine})
        own = sorted({d.x if d.a == n else d.y for d in mine})
        # Values that occur together; a bundle that was left out ('*') sets no condition.
        at = [F.array_compact(F.array(value(m, f), F.lit("*"))) for m, f in there]
        pairs = candidates.filter(F.col(n).isNotNull()).select(F.col("group").alias("g"), *(value(n, f).alias(f"h__{f}") for f in own), *(x.alias(f"t__{m}__{f}") for x, (m, f) in zip(at, there)))
        for m, f in there:
            pairs = pairs.withColumn(f"t__{m}__{f}", F.explode(f"t__{m}__{f}"))
        option = options(n).withColumnRenamed("group", "og")
        fitting = pairs.distinct().join(option, F.col("g").eqNullSafe(F.col("og")) & reduce(Column.__and__, [F.col(f"h__{f}") == F.col(f"{n}__{f}") for f in own])).drop("og")
        on = F.col("group").eqNullSafe(F.col("g")) & reduce(Column.__and__, [F.coalesce(F.col(f"{m}__{f}"), F.lit("*")) == F.col(f"t__{m}__{f}") for m, f in there])
        chosen, rest = names[: i + 1], names[i + 1 :]
        found = state.join(fitting, on).select(*state.columns, *(c for c in option.columns if c != "og"))
        bounded = or_nothing(found, state, n).join(limits, F.col("group").eqNullSafe(F.col("g")))
        hope = F.struct(reduce(Column.__add__, [F.col(f"any_{m}") for m in rest], worth(chosen)["bundles"]).alias("bundles"), (reduce(Column.__add__, [F.col(f"best_{m}") for m in rest], worth(chosen)["trust"]) + 1e-9).alias("trust"))
        live = [f"{m}__{f}" for m in chosen for f in ends[m] if any(f == (d.x if d.a == m else d.y) and m in (d.a, d.b) and (d.b if d.a == m else d.a) in rest for d in links)]
        kept = bounded.filter(hope >= F.col("first")).groupBy("group", *live).agg(F.max(F.struct(worth(chosen).alias("worth"), *chosen)).alias("s"))
        state = kept.select("group", *live, *(F.col("s")[m].alias(m) for m in chosen))
    return state.groupBy("group").agg(F.max(F.struct(worth(names).alias("worth"), *names)).alias("s")).select("group", *(F.col("s")[m].alias(m) for m in names))


def best_representatives(records: DataFrame, group: str, bundles: Sequence[Bundle], dependencies: Sequence[Dependency] = (), record_id: str | None = None) -> DataFrame:
    """One row per group: ``group``, ``n_records``, with ``record_id`` the least ``first_id``, and one struct per bundle with the chosen fields."""
    extra = [F.col(record_id).alias("__id")] if record_id else []
    candidates = records.select(F.col(group).alias("group"), *extra, *(_candidate(b).alias(b.name) for b in bundles))
    parts = _parts(bundles, dependencies)
    if any(len(p) > 1 for p in parts):
        candidates = cut_lineage(candidates)  # read by every step of the search
    alone = [p[0] for p in parts if len(p) == 1]
    first = [F.min("__id").alias("first_id")] if record_id else []
    out = candidates.groupBy("group").agg(F.count("*").alias("n_records"), *first, *(F.max(b.name).alias(b.name) for b in alone))
    for part in parts:
        if len(part) > 1:
            found = _search(candidates.select("group", *(b.name for b in part)), part, dependencies).withColumnRenamed("group", "g")
            out = out.join(found, F.col("group").eqNullSafe(F.col("g"))).drop("g")
    return out.select("group", "n_records", *(["first_id"] if record_id else []), *(F.col(b.name)["row"].alias(b.name) for b in bundles))
