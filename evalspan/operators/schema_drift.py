"""Schemas that drift between batches of JSON files.

Every body is parsed once in the JVM into a variant; direct fields of one object become rows, of which
type, hash and nested names are written once to the shared checkpoint folder. An aggregate that combines
before the shuffle reduces them to one line per (collection, batch, field). Neighbouring batches meet by
joins of these lines, not of files; values meet only for fields that go or come. Fields that go and fields that come in the same batch are matched by similarity
flooding: either schema becomes a graph of fields, name parts, types and nested names, match scores
start from names, types and values and are propagated along equally labelled edges until they stop
changing, and a consistent (one to one) set of correspondences is selected in order of score. A
correspondence counts as a rename if the test cases of both batches keep their values under it.

Defined results for odd input: bodies that are null, empty or not JSON, and bodies whose root has no
object under the context field, are no files of a batch; a batch without any valid body is not seen
as a batch; null and empty arrays have no type and no value; a null collection is a collection like
any other; repeated files add nothing; columns beside the named ones are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalspan.session import cut_lineage

#: Largest change of a score at which flooding has converged, and rounds after which it's taken for an error.
EPSILON, ROUNDS = 1e-3, 10_000
#: Score from which a pair of fields without any common value is a rename.
BLIND_SCORE = 0.75


def json_type(value: Column) -> Column:
    """JSON type of a variant; arrays carry the type of their elements; null and empty arrays have none."""
    return type_of_schema(F.schema_of_variant(value))


def type_of_schema(schema: Column) -> Column:
    """The same from a variant's schema; only arrays are taken apart."""
    depth = F.length(F.regexp_extract(schema, "^((?:ARRAY<)*)", 1)) / 6
    base = F.regexp_extract(schema, r"^(?:ARRAY<)*(\w+)", 1)
    scalar = lambda c: F.when(c == "STRING", "string").when(c == "BOOLEAN", "boolean").when(c == "OBJECT", "object").when(c == "VARIANT", "mixed").otherwise("number")
    nested = F.when(base != "VOID", F.concat(F.repeat(F.lit("array<"), depth.cast("int")), scalar(base), F.repeat(F.lit(">"), depth.cast("int"))))
    return F.when(schema.startswith("ARRAY<"), nested).when(schema.startswith("OBJECT<"), "object").when(schema != "VOID", scalar(schema))


def fields_of(files: DataFrame, collection: str, batch: str, body: str, case_path: str, object_path: str) -> DataFrame:
    """One row per direct field of the object of each valid body: collection, batch, case_id, field, value (variant)."""
    parsed = files.select(F.col(collection).alias("collection"), F.col(batch).alias("batch"), F.try_parse_json(F.col(body)).alias("v"))
    objects = parsed.select("collection", "batch", F.try_variant_get("v", case_path, "string").alias("case_id"), F.try_variant_get("v", object_path, "variant").alias("o")).filter(F.schema_of_variant("o").startswith("OBJECT<"))
    spark = files.sparkSession
    exploded = objects.lateralJoin(spark.tvf.variant_explode(F.col("o").outer()))
    return exploded.select("collection", "batch", "case_id", F.col("key").alias("field"), "value")


def facts_of(fields: DataFrame) -> DataFrame:
    """What the report needs of every value: its type, a hash, and the value itself only where it has names within."""
    fields = fields.withColumn("__schema", F.schema_of_variant("value"))
    kind = type_of_schema(F.col("__schema"))
    nested = F.when(F.col("__schema").contains("OBJECT<"), F.col("value"))
    return fields.select("collection", "batch", "case_id", "field", kind.alias("kind"), F.xxhash64(F.to_json("value")).alias("hash"), nested.alias("nested"))


def batch_schemas(facts: DataFrame) -> DataFrame:
    """One row per (collection, batch, field): sorted types and the merged nested schema."""
    return facts.groupBy("collection", "batch", "field").agg(F.array_sort(F.collect_set("kind")).alias("types"), F.schema_of_variant_agg("nested").alias("nested"))


def transitions(schemas: DataFrame) -> DataFrame:
    """One row per batch and the batch before it, with both schemas as arrays of (field, types, nested).

    Only batch numbers are ordered within a collection; the schemas are joined to them.
    """
    w = Window.partitionBy("collection").orderBy("batch")
    pairs = schemas.select("collection", "batch").distinct().withColumn("batch_before", F.lag("batch").over(w)).filter(F.col("batch_before").isNotNull())
    listed = schemas.groupBy(F.col("collection").alias("c"), F.col("batch").alias("b")).agg(F.array_sort(F.collect_list(F.struct("field", "types", "nested"))).alias("listed"))
    out = pairs
    for at, name in (("batch_before", "before"), ("batch", "after")):
        out = out.join(listed.withColumnRenamed("listed", name), F.col("collection").eqNullSafe(F.col("c")) & (F.col(at) == F.col("b"))).drop("c", "b")
    return out


@lru_cache(100_000)
def _names(schema: str | None) -> list[str]:
    return re.findall(r"[<,]\s*`?(\w+)`?:", schema or "")


@lru_cache(100_000)
def _parts(name: str) -> list[str]:
    """Parts of a name in lower case: snake, kebab and camel case are split."""
    return [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+", name)] or [name.lower()]


@lru_cache(100_000)
def _grams(name: str) -> set[str]:
    s = f" {''.join(_parts(name))} "
    return {s[i : i + 3] for i in range(len(s) - 2)}


def _graph(schema: list) -> tuple[list[tuple[str, str]], dict[tuple[str, str], int], dict[str, np.ndarray]]:
    """Nodes (kind, name) and a 0/1 matrix per edge label; the root is node 0."""
    nodes: dict[tuple[str, str], int] = {("root", ""): 0}
    edges: list[tuple[str, int, int]] = []
    node = lambda *x: nodes.setdefault(x, len(nodes))
    for f in schema:
        i = node("field", f["field"])
        edges.append(("field", 0, i))
        edges += [("part", i, node("part", p)) for p in _parts(f["field"])]
        edges += [("type", i, node("type", t)) for t in f["types"]]
        edges += [("nested", i, node("nested", n)) for n in _names(f["nested"])]
    labels = {}
    for label in ("field", "part", "type", "nested"):
        m = np.zeros((len(nodes), len(nodes)))
        for name, i, j in edges:
            if name == label:
                m[i, j] = 1
        labels[label] = m
    return list(nodes), nodes, labels


def flood(before: list, after: list, value_score: dict[tuple[str, str], float]) -> dict[tuple[str, str], float]:
    """Match score of every pair of fields of two schemas, by similarity flooding, scaled to 0..1."""
    na, ia, la = _graph(before)
    nb, ib, lb = _graph(after)
    start = np.zeros((len(na), len(nb)))
    of_kind: dict[str, list[tuple[int, str]]] = {}
    for j, (kind, name) in enumerate(nb):
        of_kind.setdefault(kind, []).append((j, name))
    for i, (kind, name) in enumerate(na):
        if (kind, name) in ib:
            start[i, ib[kind, name]] = 1
        if kind in ("field", "type"):  # other kinds are alike only if they are equal
            for j, name_b in of_kind.get(kind, ()):
                if name == name_b:
                    continue
                if kind == "type":
                    start[i, j] = 0.2
                else:
                    x, y = _grams(name), _grams(name_b)
                    seen = value_score.get((name, name_b))
                    alike = len(x & y) / len(x | y)
                    start[i, j] = alike if seen is None else 0.3 * alike + 0.7 * seen
    pairs = []
    for label in la:  # a pair shares its score among its neighbours along equally labelled edges
        out = np.outer(la[label].sum(1), lb[label].sum(1))
        into = np.outer(la[label].sum(0), lb[label].sum(0))
        pairs.append((la[label], lb[label], np.divide(1, out, out=np.zeros_like(out), where=out > 0), np.divide(1, into, out=np.zeros_like(into), where=into > 0)))
    score = start.copy()
    for _ in range(ROUNDS):
        spread = start + score
        for a, b, out, into in pairs:
            spread += a.T @ (score * out) @ b + a @ (score * into) @ b.T
        top = spread.max()
        spread /= top or 1
        moved = np.abs(spread - score).max()
        score = spread
        if moved < EPSILON:
            break
    else:
        raise ArithmeticError("flooding doesn't converge")
    fields = score[np.ix_([i for k, i in ia.items() if k[0] == "field"], [j for k, j in ib.items() if k[0] == "field"])]
    names_a, names_b = [k[1] for k in ia if k[0] == "field"], [k[1] for k in ib if k[0] == "field"]
    top = fields.max(initial=0) or 1
    return {(x, y): float(fields[i, j] / top) for i, x in enumerate(names_a) for j, y in enumerate(names_b)}


def match_fields(before: list, after: list, evidence: list) -> tuple[list[tuple[str, str]], list[str], list[str]]:
    """Renames, removed and added fields of one transition.

    evidence: (old_field, new_field, common, kept) counts test cases with a value under both names,
    and those whose values agree.
    """
    old, new = {f["field"]: f for f in before}, {f["field"]: f for f in after}
    gone, come = [f for f in old if f not in new], [f for f in new if f not in old]
    renamed: list[tuple[str, str]] = []
    if gone and come:
        seen = {(e["old_field"], e["new_field"]): (e["common"], e["kept"]) for e in evidence}
        scores = flood(before, after, {k: kept / common for k, (common, kept) in seen.items()})
        verified = []
        for a in gone:
            for b in come:
                common, kept = seen.get((a, b), (0, 0))
                if kept == common if common else scores[a, b] >= BLIND_SCORE and list(old[a]["types"]) == list(new[b]["types"]):
                    verified.append((common > 0, scores[a, b], a, b))
        for _, _, a, b in sorted(verified, key=lambda v: (-v[0], -v[1], v[2], v[3])):
            if all(a != x and b != y for x, y in renamed):
                renamed.append((a, b))
    taken_a, taken_b = {a for a, _ in renamed}, {b for _, b in renamed}
    return renamed, [f for f in gone if f not in taken_a], [f for f in come if f not in taken_b]


def _changes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for r in part.itertuples(index=False):
            before, after = list(r.before), list(r.after)
            renamed, removed, added = match_fields(before, after, list(r.evidence) if r.evidence is not None else [])
            at = (r.collection, r.batch, r.batch_before)
            rows += [(*at, "renamed", a, b) for a, b in renamed]
            rows += [(*at, "removed", a, "") for a in removed]
            rows += [(*at, "added", "", b) for b in added]
            types = {f["field"]: list(f["types"]) for f in before}
            for f in after:
                was, now = types.get(f["field"], []), list(f["types"])
                if was and now and was != now:
                    rows.append((*at, "retyped", f["field"], f["field"]))
        yield pd.DataFrame(rows, columns=["collection", "batch", "batch_before", "change", "old_field", "new_field"])


def value_evidence(facts: DataFrame, steps: DataFrame) -> DataFrame:
    """Per transition: pairs of a gone and a new field with the test cases that have a value under both, and those that keep it."""
    names = lambda c: F.transform(c, lambda f: f["field"])
    both = steps.select("collection", "batch", "batch_before", F.array_except(names(F.col("before")), names(F.col("after"))).alias("gone"), F.array_except(names(F.col("after")), names(F.col("before"))).alias("come")).filter((F.size("gone") > 0) & (F.size("come") > 0))
    role = lambda fields, at, old: F.transform(fields, lambda f: F.struct(F.col(at).alias("b"), F.struct(F.lit(old).alias("old"), f.alias("f")).alias("x")))
    wanted = both.select(F.col("collection").alias("c"), F.col("batch").alias("step"), F.inline(F.concat(role(F.col("gone"), "batch_before", True), role(F.col("come"), "batch", False))))
    valued = facts.filter(F.col("kind").isNotNull() & F.col("case_id").isNotNull())
    hits = valued.join(wanted, valued["collection"].eqNullSafe(wanted["c"]) & (valued["batch"] == wanted["b"]) & (valued["field"] == wanted["x"]["f"]))

    def pairs(xs: str) -> Column:  # fields of one schema each: as many as it is wide
        of = lambda old: F.transform(F.filter(xs, lambda x: x["old"] == F.lit(old)), lambda x: x["f"])
        return F.explode(F.flatten(F.transform(of(True), lambda o: F.transform(of(False), lambda n: F.struct(o.alias("old_field"), n.alias("new_field"))))))

    per_value = hits.groupBy("c", "step", "case_id", "hash").agg(F.collect_set("x").alias("xs"))
    per_case = per_value.select("c", "step", "case_id", F.explode("xs").alias("x")).groupBy("c", "step", "case_id").agg(F.collect_set("x").alias("xs"))
    common = per_case.select("c", "step", pairs("xs").alias("p"), F.lit(0).alias("kept"))
    kept = per_value.select("c", "step", "case_id", pairs("xs").alias("p")).distinct().select("c", "step", "p", F.lit(1).alias("kept"))
    counted = common.unionAll(kept).groupBy("c", "step", "p").agg(F.count_if(F.col("kept") == 0).alias("common"), F.sum("kept").alias("kept"))
    return counted.groupBy("c", "step").agg(F.collect_list(F.struct("p.old_field", "p.new_field", "common", "kept")).alias("evidence"))


def drift(fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Schemas of all batches (collection, batch, field, types, nested), and the report of every change."""
    facts = cut_lineage(facts_of(fields))
    schemas = cut_lineage(batch_schemas(facts))
    # Steps without any change end here.
    same = lambda c: F.transform(c, lambda f: F.struct(f["field"], f["types"]))
    moved = cut_lineage(transitions(schemas).filter(same(F.col("before")) != same(F.col("after"))))
    evidence = value_evidence(facts, moved)
    full = moved.join(evidence, moved["collection"].eqNullSafe(evidence["c"]) & (moved["batch"] == evidence["step"]), "left")
    kind = {f.name: f.dataType.simpleString() for f in fields.schema.fields}
    out = f"collection {kind['collection']}, batch {kind['batch']}, batch_before {kind['batch']}, change string, old_field string, new_field string"
    return schemas, full.select("collection", "batch", "batch_before", "before", "after", "evidence").mapInPandas(_changes, out)


def drift_report(fields: DataFrame) -> DataFrame:
    """Every change against the batch before: collection, batch, batch_before, change, old_field, new_field."""
    return drift(fields)[1]


def _latest(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Rows (collection, field, batch, ..) with ``event``: batch and field of the last event of that field up to the row's batch."""
    extra = [c for c in rows.columns if c not in ("collection", "field", "batch")]
    types = dict(rows.dtypes)
    marks = events.select("collection", "field", "batch", *(F.lit(None).cast(types[c]).alias(c) for c in extra), F.struct("batch", "field").alias("__mark"))
    both = marks.unionByName(rows.withColumn("__mark", F.lit(None).cast(marks.schema["__mark"].dataType)))
    w = Window.partitionBy("collection", "field").orderBy("batch", F.col("__mark").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("event", F.last("__mark", ignorenulls=True).over(w)).filter(F.col("__mark").isNull()).drop("__mark")


def canonical_names(schemas: DataFrame, report: DataFrame) -> DataFrame:
    """(collection, batch, field, canonical): the name that the field had first, following its renames back.

    A field has the name of the last rename into it, up to its batch; that rename's name comes from the one
    before it, and so on. Chains of renames halve with every round, so no collection is walked in one task.
    """
    renames = report.filter("change = 'renamed'").select("collection", F.col("new_field").alias("field"), "batch", "old_field", "batch_before")
    renames = cut_lineage(renames)
    sources = renames.select("collection", F.col("old_field").alias("field"), F.col("batch_before").alias("batch"), F.struct("batch", "field").alias("of"))
    chain = cut_lineage(_latest(sources, renames).select("collection", "of", "event", F.col("field").alias("canonical")))
    while chain.filter(F.col("event").isNotNull()).limit(1).count():
        before = chain.select(F.col("collection").alias("c"), F.col("of").alias("o"), F.col("event").alias("e"), F.col("canonical").alias("n"))
        met = chain.join(before, F.col("collection").eqNullSafe(F.col("c")) & (F.col("event") == F.col("o")), "left")
        chain = cut_lineage(met.select("collection", "of", F.col("e").alias("event"), F.coalesce("n", "canonical").alias("canonical")))
    named = chain.select(F.col("collection").alias("c"), "of", "canonical")
    lines = _latest(schemas.select("collection", "field", "batch"), renames)
    return lines.join(named, F.col("collection").eqNullSafe(F.col("c")) & (F.col("event") == F.col("of")), "left").select("collection", "batch", "field", F.coalesce("canonical", "field").alias("canonical"))


def consistent_table(fields: DataFrame, report: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """All values under canonical names and one type per collection and field.

    Gives collection, batch, case_id, field, type, value. A field that ever was an array is cast to
    array<string> (a scalar becomes an array of one, other elements their JSON), one that had several
    types to string, else it keeps its type; value is the cast value's JSON, null where there is none.
    Names and types are decided on the lines of the schemas; values are joined to them once.
    """
    schemas = schemas if schemas is not None else batch_schemas(facts_of(fields))
    names = canonical_names(schemas, report)
    typed = names.join(schemas.select(F.col("collection").alias("c"), F.col("batch").alias("b"), F.col("field").alias("f"), "types"), F.col("collection").eqNullSafe(F.col("c")) & (F.col("batch") == F.col("b")) & (F.col("field") == F.col("f"))).select("collection", "batch", "field", "canonical", "types")
    kinds = typed.select(F.col("collection").alias("c"), F.col("canonical").alias("f"), F.explode_outer("types").alias("kind")).groupBy("c", "f").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    target = F.when(F.exists("kinds", lambda k: k.startswith("array<")), F.when(F.size("kinds") == 1, F.get("kinds", 0)).otherwise("array<string>")).when(F.size("kinds") > 1, "string").otherwise(F.get("kinds", 0))
    lines = typed.join(kinds.select("c", "f", target.alias("type")), F.col("collection").eqNullSafe(F.col("c")) & (F.col("canonical") == F.col("f"))).select(F.col("collection").alias("c"), F.col("batch").alias("b"), F.col("field").alias("f"), "canonical", "type")
    j = fields.join(lines, fields["collection"].eqNullSafe(F.col("c")) & (fields["batch"] == F.col("b")) & (fields["field"] == F.col("f"))).select("collection", "batch", "case_id", F.col("canonical").alias("field"), "type", json_type(F.col("value")).alias("kind"), "value")
    text = F.coalesce(F.when(F.col("kind") == "string", F.try_variant_get("value", "$", "string")), F.to_json("value"))
    wrapped = F.when(F.col("kind") == "array<string>", F.to_json("value")).when(F.col("kind").startswith("array<"), F.to_json(F.transform(F.try_variant_get("value", "$", "array<variant>"), lambda x: F.to_json(x)))).otherwise(F.to_json(F.array(text)))
    cast = F.when(F.col("kind").isNull(), F.lit(None)).when(F.col("kind") == F.col("type"), F.to_json("value")).when(F.col("type") == "array<string>", wrapped).otherwise(F.to_json(F.struct(text.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(text.alias("x")))) - 6))
    return j.select("collection", "batch", "case_id", "field", "type", cast.alias("value"))
