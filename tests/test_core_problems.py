"""Drift, nested records and copies on small fixtures, against plain statements of what must come out."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest

from evalspan.operators import copy_diff, nested, schema_drift

ENTRY = "array<struct<marker:string,fluorophore:string,channel:string>>"


def panel(spark, rows):
    return spark.createDataFrame(rows, f"id string, revision int, entries {ENTRY}, best string, extra int").selectExpr("*", "1 as key_l", "2 as channel")


def diff(spark, left, right):
    from pyspark.sql import functions as F

    sides = [copy_diff.highest_revision(panel(spark, r), copy_diff.normal_id(F.col("id")), "revision", [F.col("best"), F.col("entries")]) for r in (left, right)]
    out = copy_diff.diff_nested(*sides, ("marker", "fluorophore"), ("best",)).select("key", F.explode("differences").alias("d")).select("key", "d.*")
    return {(r.key, r.channel, r.field, r.kind) for r in out.collect()}


def test_copies_differ_only_where_it_means_something(spark):
    left = [("omip_1", 1, [("CD3", "PE", "B1")], "x", 1), ("OMIP-1", 2, [("CD3", None, "B1"), ("CD4", "FITC", "B2")], "xml", 2), ("OMIP-2", 1, None, None, 3), ("OMIP-1", 2, [("CD3", None, "B1"), ("CD4", "FITC", "B2")], "xml", 2)]
    right = [("OMIP‐1", 2, [("cd4 ", "APC", "B2"), (" CD3", "", "B1"), ("CD8", "PE", "B3")], " XML", 9), ("OMIP-3", 1, [], "", 0)]
    assert diff(spark, left, right) == {("OMIP-1", "B2", "fluorophore", "differs"), ("OMIP-1", "B3", "entry", "only_right"), ("OMIP-2", "", "row", "only_left"), ("OMIP-3", "", "row", "only_right")}


def test_copies_take_null_keys_empty_tables_and_repeated_channels(spark):
    row = (None, None, [("CD3", "PE", None), ("CD9", "PE", None)], None, None)
    assert diff(spark, [row], [row]) == set()
    assert diff(spark, [], []) == set()
    assert diff(spark, [row], []) == {(None, "", "row", "only_left")}


def test_flat_copies(spark):
    a = spark.createDataFrame([(1, "x", "Y"), (2, "a", None), (None, "n", "n")], "k int, f string, g string")
    b = spark.createDataFrame([(1, "X ", "z"), (3, "q", "q"), (None, "n", "n")], "k int, f string, g string")
    got = {(r.k, r.kind): [tuple(x) for x in r.differences or []] for r in copy_diff.diff_rows(a, b, ["k"], ["f", "g"]).collect()}
    assert got == {(1, "differs"): [("g", "Y", "z")], (2, "only_left"): [], (3, "only_right"): []}


def files(spark, batches):
    rows = [("c", n, body if isinstance(body, str) or body is None else json.dumps(body)) for n, bodies in batches.items() for body in bodies]
    df = spark.createDataFrame(rows, "collection string, batch_no int, body string").selectExpr("*", "1 as value", "2 as batch")
    return schema_drift.fields_of(df, "collection", "batch_no", "body", "$.id", "$.context")


def ctx(i, **fields):
    return {"id": i, "context": fields}


def changes(spark, batches):
    return {(r.batch, r.change, r.old_field, r.new_field) for r in schema_drift.drift_report(files(spark, batches)).collect()}


def test_drift_reports_each_change(spark):
    batches = {
        1: [ctx("a", src="p1", n=3, t="x", gone="g"), ctx("b", src="p2", n=None, t="y"), "{broken", "", None, '"text"', '{"id": "z", "context": 5}'],
        2: [ctx("a", source_file="p1", n="3", t="x", new=True), ctx("b", source_file="p2", n=[], t="y"), ctx("b", source_file="p2", n=[], t="y")],
        4: [ctx("a", source_file=["p1"], n="3", t=None, new=True)],
    }
    assert changes(spark, batches) == {(2, "renamed", "src", "source_file"), (2, "retyped", "n", "n"), (2, "removed", "gone", ""), (2, "added", "", "new"), (4, "retyped", "source_file", "source_file")}


def test_a_field_with_other_values_is_no_rename(spark):
    assert changes(spark, {1: [ctx("a", pdf="x")], 2: [ctx("a", pdf_path="y")]}) == {(2, "removed", "pdf", ""), (2, "added", "", "pdf_path")}


def test_array_types_and_empty_input(spark):
    assert changes(spark, {1: [ctx("a", r=["x"])], 2: [ctx("a", r=[{"id": 1}])], 3: [ctx("a", r=[])], 4: [ctx("a", r=[1, 2.5])]}) == {(2, "retyped", "r", "r")}
    assert changes(spark, {}) == set()


def test_consistent_table_follows_renames(spark):
    f = files(spark, {1: [ctx("a", src="p1", n=3)], 2: [ctx("a", path="p1", n="3")], 3: [ctx("a", path="p1", n=None)]})
    got = {(r.batch, r.field, r.type, r.value) for r in schema_drift.consistent_table(f, schema_drift.drift_report(f)).collect()}
    assert got == {(b, "src", "string", '"p1"') for b in (1, 2, 3)} | {(1, "n", "string", '"3"'), (2, "n", "string", '"3"'), (3, "n", "string", None)}


def test_names_follow_long_chains_of_renames(spark):
    """A field that is renamed batches after it came, and back again, keeps its first name; so does one that comes again."""
    chain = [ctx("a", src="p1", n=1), ctx("a", path="p1", n=1), ctx("a", path="p1", n=1), ctx("a", file="p1", n=1), ctx("a", file="p1"), ctx("a", src="p1", n=1), ctx("a", doc="p1")]
    f = files(spark, {i: [c] for i, c in enumerate(chain)})
    got = {(r.batch, r.field) for r in schema_drift.consistent_table(f, schema_drift.drift_report(f)).collect()}
    assert got == {(i, "src") for i in range(7)} | {(i, "n") for i in (0, 1, 2, 3, 5)}


def test_flooding_prefers_alike_fields():
    field = lambda name, t="string": {"field": name, "types": [t], "nested": "STRING"}
    scores = schema_drift.flood([field("pdf_source"), field("note")], [field("pdfSource"), field("count", "number")], {})
    assert scores["pdf_source", "pdfSource"] == max(scores.values())


def nodes(spark, bodies):
    df = spark.createDataFrame([(i, b if isinstance(b, str) or b is None else json.dumps(b)) for i, b in enumerate(bodies)], "record_id int, body string")
    return {(r.record_id, r.kind, r.parent_path, r.node_path) for r in nested.gate_tables(df).collect()}


def record(panel=None, tree=None, best=("m", "m")):
    return {"extractions": {"panel": {"m": {"data": panel}}, "gating_hierarchy": {"m": {"data": tree}}}, "best_extraction": {"panel": best[0], "gating_hierarchy": best[1]}}


def test_trees_of_every_shape(spark):
    tree = {"name": "r", "marker_logic": [{"marker": "x"}, None, {"marker": "y"}], "children": [{"name": "a", "children": {"name": "b"}}, None, {"children": []}]}
    gates = {("gate", "", "0"), ("gate", "0", "0.0"), ("gate", "0.0", "0.0.0"), ("gate", "0", "0.2"), ("logic", "0", "0/0"), ("logic", "0", "0/2")}
    for shape in (tree, {"hierarchy": tree}, {"hierarchy": {"root": tree}}, json.dumps({"root": tree}), {"note": "n", "hierarchy": tree, "table": {"rows": [[1]]}}):
        assert nodes(spark, [record(tree=shape)]) == {(0, *g) for g in gates}


def test_bodies_without_rows(spark):
    odd = [None, "", "{cut", "[]", "5", {}, {"best_extraction": None}, record(best=(None, "absent")), record({"entries": []}, {"hierarchy": None}), {"extractions": [], "best_extraction": {"panel": "m"}}]
    assert nodes(spark, odd) == set() and nodes(spark, []) == set()
    assert nodes(spark, [record({"entries": [{"marker": "x"}, None, {"marker": "y"}]})]) == {(0, "entry", "", "0"), (0, "entry", "", "2")}


def test_deep_tree(spark):
    tree = {"name": "leaf"}
    for i in range(300):
        tree = {"name": str(i), "children": [tree]}
    assert len(nodes(spark, [record(tree=tree)])) == 301


def test_shred_keeps_parents_and_positions():
    t = pa.table({"id": [1, 2, 3], "x": pa.array([[{"a": 1, "b": [{"c": 5}, {"c": 6}]}], None, [{"a": 2, "b": []}, None, {"a": 3, "b": [{"c": 7}]}]])})
    out = nested.shred(t, "id")
    assert out["x"].select(["id", "node_path", "a"]).to_pylist() == [{"id": 1, "node_path": "0", "a": 1}, {"id": 3, "node_path": "0", "a": 2}, {"id": 3, "node_path": "2", "a": 3}]
    assert out["x.b"].to_pylist() == [{"id": 1, "parent_path": "0", "node_path": "0.0", "c": 5}, {"id": 1, "parent_path": "0", "node_path": "0.1", "c": 6}, {"id": 3, "parent_path": "2", "node_path": "2.0", "c": 7}]


def test_index_agrees_with_the_decoder():
    """Texts that the index vouches for are valid and have the decoder's structure; odd ones are left to the decoder."""
    from evalspan.operators.json_index import JsonIndex, buffers

    rng = random.Random(3)

    def value(depth=0):
        kind = rng.random()
        if depth > 4 or kind < 0.3:
            return rng.choice([1, -2.5e7, "x", 'a"b\\', None, True, "é\n{", {}, []])
        return [value(depth + 1) for _ in range(rng.randint(0, 4))] if kind < 0.65 else {f"k{i}": value(depth + 1) for i in range(rng.randint(0, 4))}

    def read(index, t):
        kind = chr(index.kind[t])
        if kind == "[":
            return [read(index, e) for e in index.lists(np.array([t])).values.to_pylist()]
        if kind == "{":
            names = [n for n in index.names if index.field(np.array([t]), n)[0] >= 0]
            return {n: read(index, index.field(np.array([t]), n)[0]) for n in names}
        return json.loads(index.whole(np.array([t]))[0].as_py())

    left = 0
    for _ in range(60):
        texts = []
        for _ in range(15):
            t = json.dumps(value(), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
            if rng.random() < 0.5:
                i = rng.randrange(len(t))
                t = t[:i] + rng.choice(["", '"', "{", "}", "[", "]", ",", ":", "\\", "1", "a", " ", "\n", "\x01"]) + t[i + rng.randint(0, 2) :]
            texts.append(t)
        index = JsonIndex(*buffers(pa.array(["skipped", *texts]).slice(1)))
        for t, good, root in zip(texts, index.good, index.roots()):
            try:
                want = [json.loads(t)]
            except ValueError:
                want = []
            if good:
                assert [read(index, root)] == want
            left += bool(want) and not good
    assert left < 10
    odd = ["", "NaN", '{"a": 1, "a": 2}', '{"\\u0061": 1}', '"\\u12"', "[1", "01", '"\\x"', '{"a"}', "{1: 2}", "[1:2]", '{"a": 1}{}', None]
    assert not JsonIndex(*buffers(pa.array(odd, pa.string()))).good.any()


def test_indexed_and_decoded_bodies_give_the_same_rows(spark, monkeypatch):
    tree = {"name": "r", "marker_logic": [{"marker": 'x"'}, None, {"marker": "y"}], "children": [{"name": 5, "children": {"name": None, "marker": "m"}}, None, {"children": [], "z": [1, {"a": "é"}]}]}
    bodies = [record({"entries": [{"marker": "é", "b": 1}, 3]}, shape) for shape in (tree, {"hierarchy": tree}, json.dumps({"root": tree}), [[tree], tree], "no json", json.dumps('"x"'))]
    bodies += [record(json.dumps([{"marker": "q"}]), {"a": {"b": {"name": "deep"}}, "c": {"name": "near"}}), record({"marker": "single"}, 5), {"extractions": 1}]
    same = lambda r: (*r[:6], json.dumps(json.loads(r[6])))  # texts of attributes are as written, or the decoder's
    rows = lambda: {same(r) for r in nested.gate_tables(spark.createDataFrame(list(enumerate(map(json.dumps, bodies))), "record_id int, body string")).collect()}
    indexed = rows()
    assert any(r[4] == "5" for r in indexed) and any(r[4] == 'x"' for r in indexed)
    found = list(nested._flatten_bodies([pa.RecordBatch.from_pydict({"record_id": [1, None], "body": pa.array([None, ""], pa.string())})], True))
    assert sum(b.num_rows for b in found) == 0
    monkeypatch.setattr(nested, "LARGE_BODY", -1)
    decoded = {same(r) for b in nested._flatten_bodies([pa.RecordBatch.from_pydict({"record_id": list(range(len(bodies))), "body": list(map(json.dumps, bodies))})], True) for r in zip(*(b.column(c).to_pylist() for c in b.schema.names))}
    assert decoded == indexed


def test_trees_beyond_the_decoders_limit(spark):
    from evalspan.operators import nested as N

    levels = 30_000
    deep = '{"k": [' * levels + "1" + "]}" * levels
    with pytest.raises(RecursionError):
        json.loads(deep)
    assert N._dumps(N._decode_deep(deep)) == deep
    for text in ('{"a": [1, -2.5e3, "x\\n", null, true, {}, []], "b": {"c": "}"}}', ' [ ] ', '"s"', "3"):
        assert N._decode_deep(text) == json.loads(text)
    for text in ("", "[1,]", '{"a" 1}', "[1] 2", "{,}", "[}", '{"a": }', "]", "[1", "01", "nul"):
        with pytest.raises(ValueError):
            N._decode_deep(text)
    tree = f'{{"name": "r", "note": {deep}, "children": [{{"name": "a"}}]}}'
    bodies = [f'{{"extractions": {{"gating_hierarchy": {{"m": {{"data": {part}}}}}}}, "best_extraction": {{"gating_hierarchy": "m"}}}}' for part in (json.dumps(tree), tree)]
    df = spark.createDataFrame(list(enumerate(bodies)), "record_id bigint, body string")
    got = {(r.record_id, r.name, r.attributes) for r in N.gate_tables(df).filter("kind = 'gate'").collect()}
    assert got == {(i, *x) for i in (0, 1) for x in (("r", f'{{"note": {deep}}}'), ("a", "{}"))}
