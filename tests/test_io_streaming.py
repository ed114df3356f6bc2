import json
import os

import pytest
from pyspark.sql import functions as F

from evalspan.sources import files, sinks
from evalspan.streaming import stateful, windows


def write(path, content):
    path.write_text(content if isinstance(content, str) else "\n".join(json.dumps(x) for x in content))
    return str(path)


def test_wrapped_json(spark, tmp_path):
    write(tmp_path / "a.json", '{"results": [{"id": "x", "s": 1.5}]}')
    write(tmp_path / "b.json", '[{"id": "y"}, {"id": "z", "s": 2}]')
    write(tmp_path / "c.json", '{"predictions": []}')
    write(tmp_path / "d.json", "{broken")
    got = {(r.id, r.s) for r in files.wrapped_json(spark, str(tmp_path), "struct<id:string,s:double>").collect()}
    assert got == {("x", 1.5), ("y", None), ("z", 2.0)}


def test_documents_by_id(spark, tmp_path):
    write(tmp_path / "a.json", '{"test_case_id": "omip_1", "n": 3}')
    write(tmp_path / "b.json", "nope")
    assert [(r.id, r.n) for r in files.json_documents(spark, str(tmp_path), "struct<test_case_id:string,n:int>", "test_case_id").collect()] == [("OMIP-1", 3)]


def test_merged_lines(spark, tmp_path):
    a = write(tmp_path / "a.jsonl", '{"k": "1", "v": "a1"}\n\n{bad\n{"k": "1", "v": "a2"}\n')
    b = write(tmp_path / "b.jsonl", [{"k": "1", "v": "b"}, {"k": "2", "v": "b"}, {"v": "no key"}])
    got = {(r.k, r.v) for r in files.merged_lines(spark, [a, b], "k string, v string", ["k"]).collect() if r.k}
    assert got == {("1", "a1"), ("2", "b")}


def test_tables_of_markers(spark, tmp_path):
    p = write(tmp_path / "m.csv", "Population,Parent,CD3,CD19\nT cells,Live,+,\nB cells,,-,+\n")
    got = {r.population: (r.parent, r.markers) for r in files.marker_table(spark, p).collect()}
    assert got == {"T cells": ("Live", {"CD3": "+"}), "B cells": (None, {"CD3": "-", "CD19": "+"})}
    t = spark.createDataFrame([("| a | b |\n|---|---|\n| 1 |  |\n| 2 |",)], "t string")
    assert t.select(files.piped_table(F.col("t")).alias("x")).first().x == [{"a": "1", "b": ""}, {"a": "2", "b": ""}]


def test_xml(spark, tmp_path):
    write(tmp_path / "a.xml", "<article><front><article-id pub-id-type='doi'>10.1/x</article-id><article-title>T  1</article-title></front><body><sec><title>M</title></sec></body></article>")
    r = files.articles(spark, str(tmp_path / "a.xml")).first()
    assert (r.title, r.doi, r.sections, r.abstract) == ("T 1", "10.1/x", ["M"], None)
    write(tmp_path / "w.wsp", "<W><SampleNode><Subpopulations><Population name='A'><Subpopulations><Population name='B'/></Subpopulations></Population></Subpopulations></SampleNode><SampleNode/></W>")
    assert {(r.path, r.parent_path, r.depth) for r in files.workspace_gates(spark, str(tmp_path / "w.wsp")).collect()} == {("/A", "", 0), ("/A/B", "/A", 1)}


def test_exports(spark, tmp_path):
    df = spark.sql("SELECT 'r' AS run_id, named_struct('a', 1, 'b', named_struct('c', 'x')) AS s, array('p', null) AS l")
    flat = sinks.flatten_struct(df)
    assert flat.columns == ["run_id", "s.a", "s.b.c", "l"]
    assert sinks.export_columns(flat, {"a": "s.a"}, {"n": "l"}, {"l": ("l", None)}).first().asDict() == {"a": 1, "n": 2, "l": "p|"}
    sinks.write_csv(flat.select("run_id"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1
    sinks.append_jsonl(df.select("run_id"), str(tmp_path / "j"))
    sinks.append_jsonl(df.select("run_id"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string").coalesce(1)
    sinks.keyed_overwrite(old, new, ["k"], str(tmp_path / "u"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "u")).collect()} == {(1, "a"), (2, "c"), (3, "e")}
    doc = sinks.run_documents(df.select("run_id"), spark.sql("SELECT 'r' AS run_id, 1 AS id")).first().document
    assert json.loads(doc) == {"run_id": "r", "predictions": [{"id": 1}]}


def test_windows_on_batch_and_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", "a", 1.0), (1, "2024-01-01 00:20:00", "a", 3.0), (2, "2024-01-01 01:10:00", "b", 5.0)]
    df = spark.createDataFrame(rows, "user_id int, t string, event_type string, value double").select("user_id", F.to_timestamp("t").alias("ts"), "event_type", "value")
    assert {(r.event_type, r.n, r.mean_value) for r in windows.tumbling_stats(df, "1 hour").collect()} == {("a", 2, 2.0), ("b", 1, 5.0)}
    assert {(r.user_id, r.n) for r in windows.session_activity(df, "5 minutes").collect()} == {(1, 1), (2, 1)}
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windows.tumbling_stats(s, "1 hour").writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("tumbling").count() == 2


def test_adaptive_threshold_is_the_same_as_a_stream(spark, tmp_path):
    rows = [("u", i, 0.4 + i % 7 / 10, i % 3 > 0) for i in range(40)] + [("v", i, 0.9, True) for i in range(12)] + [(None, 1, 0.5, True)]
    df = spark.createDataFrame(rows, "k string, i int, confidence double, correct boolean")
    want = {}
    for key in ("u", "v"):
        t, h = stateful.START, []
        for _, _, c, ok in (r for r in rows if r[0] == key):
            t = stateful.step(t, h, c, ok)
        want[key] = round(t, 6)
    assert {r.k: r.threshold for r in stateful.adaptive_thresholds(df, "k", ["i"]).collect()} == want
    df.filter("k is not null").coalesce(1).sortWithinPartitions("i").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).drop("i")
    q = stateful.adaptive_threshold_stream(s, "k").writeStream.format("memory").queryName("adaptive").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.k: r.threshold for r in spark.table("adaptive").collect()} == want


def test_guard_and_resume(spark, tmp_path):
    bad = spark.createDataFrame([(i, i < 6) for i in range(12)], "i int, failed boolean")
    with pytest.raises(RuntimeError):
        stateful.FailureGuard("failed")(bad, 0)
    stateful.FailureGuard("failed", least=100)(bad, 0)
    os.makedirs(tmp_path / "in")
    args = (str(tmp_path / "in"), "k int", lambda d: d.withColumn("y", F.col("k") * 2), str(tmp_path / "out"), str(tmp_path / "cp"))
    for i in (1, 2):
        write(tmp_path / "in" / f"{i}.json", [{"k": i}])
        stateful.process_new_files(spark, *args)
    assert sorted(r.y for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 4]
    items = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert [r.k for r in stateful.remaining(items, spark.read.parquet(str(tmp_path / "out")), "k").collect()] == [3]
