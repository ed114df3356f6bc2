"""Round trips through every file source and sink: a table is written in the source's format and read back.

The SQL of each query reads the table itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspan.operators.joins import lookup
from evalspan.sources import config, files, sinks
from evalspan.sources.tables import register as register_tables
from evalspan.sources.tables import table
from evalspan.session import scratch

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _lines(df, path):
    df.write.mode("overwrite").text(path)
    return path


@query("SELECT test_case_id, species, n_gates FROM test_cases")
def wrapped_json_scan(spark, d):
    """Files that hold a list, or an object with the list under a key (cases by difficulty, half of them wrapped)."""
    cases = table(spark, d, "test_cases").select("test_case_id", "species", "n_gates", "difficulty")
    body = F.to_json(F.collect_list(F.struct("test_case_id", "species", "n_gates")))
    one = cases.groupBy("difficulty").agg(body.alias("b")).select(F.when(F.length(F.coalesce("difficulty", F.lit(""))) % 2 == 0, F.concat(F.lit('{"results": '), "b", F.lit("}"))).otherwise(F.col("b")).alias("value"), F.coalesce("difficulty", F.lit("none")).alias("part"))
    path = scratch(spark, "wrapped")
    one.write.mode("overwrite").partitionBy("part").text(path)  # one file per difficulty
    return files.wrapped_json(spark, f"{path}/*/*.txt", "struct<test_case_id: string, species: string, n_gates: int>")


@query("SELECT upper(replace(test_case_id, '_', '-')) AS id, species, n_gates FROM test_cases WHERE n_gates > 12")
def json_directory_scan(spark, d):
    """One document per file; a file that is no JSON is skipped."""
    cases = table(spark, d, "test_cases").filter("n_gates > 12").select("test_case_id", "species", "n_gates")
    path = scratch(spark, "documents")
    rows = cases.select(F.to_json(F.struct("*")).alias("value"), F.col("test_case_id").alias("part")).unionAll(spark.createDataFrame([("{broken", "broken")], "value string, part string"))
    rows.write.mode("overwrite").partitionBy("part").text(path)
    return files.json_documents(spark, f"{path}/*", "struct<test_case_id: string, species: string, n_gates: int>", "test_case_id", "*.txt").select("id", "species", "n_gates")


@query("SELECT id, model, hierarchy_f1, error_type FROM predictions WHERE id IS NOT NULL")
def jsonl_scan(spark, d):
    """JSON lines; blank, broken and keyless lines are skipped."""
    good = table(spark, d, "predictions").select(F.to_json(F.struct("id", "model", "hierarchy_f1", "error_type")).alias("value"))
    bad = spark.createDataFrame([("",), ("{cut",), ('{"model": "no key"}',)], "value string")
    return files.json_lines(spark, _lines(good.unionAll(bad), scratch(spark, "lines")), "id bigint, model string, hierarchy_f1 double, error_type string", key="id")


@query("SELECT id, model FROM predictions WHERE error_type IS NULL OR error_type = ''")
def successful_lines(spark, d):
    path = _lines(table(spark, d, "predictions").select(F.to_json(F.struct("id", "model", "error_type")).alias("value")), scratch(spark, "done"))
    return files.succeeded(files.json_lines(spark, path, "id bigint, model string, error_type string"), "error_type").select("id", "model")


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN 'first' ELSE 'second' END AS part FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def merged_line_files(spark, d):
    """Union of files; the first one that has a key wins."""
    o = table(spark, d, "orders")
    side = lambda n, part: _lines(o.filter(F.col("o_orderkey") % n == 0).select(F.to_json(F.struct("o_orderkey", "o_orderstatus", F.lit(part).alias("part"))).alias("value")), scratch(spark, part))
    return files.merged_lines(spark, [side(2, "first"), side(3, "second")], "o_orderkey bigint, o_orderstatus string, part string", ["o_orderkey"])


@query("SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey >= 5 AND n_name <> 'CANADA' GROUP BY 1")
def parameterised_sql(spark, d):
    register_tables(spark, d, "nation")
    return config.query(spark, "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey >= ? AND n_name <> ? GROUP BY 1", 5, "CANADA")


@query("SELECT n_name AS population, r_name AS parent, 'CD3' AS marker, CASE WHEN n_nationkey % 2 = 0 THEN '+' ELSE '-' END AS state FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, r_name, 'CD19', 'dim' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0")
def marker_table_scan(spark, d):
    """CSV with populations, parents and one column per marker; empty cells are no state."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.select(F.col("n_name").alias("Population"), F.col("r_name").alias("Parent"), F.when(F.col("n_nationkey") % 2 == 0, "+").otherwise("-").alias("CD3"), F.when(F.col("n_nationkey") % 3 == 0, "dim").alias("CD19"))
    path = scratch(spark, "markers")
    sinks.write_csv(rows, path)
    return files.marker_table(spark, path).select("population", "parent", F.explode("markers").alias("marker", "state"))


@query("SELECT r_regionkey, n_name AS name, n_nationkey::VARCHAR AS number FROM nation JOIN region ON n_regionkey = r_regionkey")
def piped_tables(spark, d):
    """Tables in texts, as one text per region."""
    line = F.concat(F.lit("| "), "n_name", F.lit(" | "), F.col("n_nationkey").cast("string"), F.lit(" |"))
    text = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.concat(F.lit("Notes\n| name | number |\n|---|:--|\n"), F.array_join(F.collect_list(line), "\n"), F.lit("\nend")).alias("text"))
    return text.select("r_regionkey", F.explode(files.piped_table(F.col("text"))).alias("m")).select("r_regionkey", F.col("m")["name"].alias("name"), F.col("m")["number"].alias("number"))


_XML = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


@query("SELECT '10.1/' || test_case_id AS doi, 'Panel ' || test_case_id AS title, 'About <' || species || '> & more' AS abstract, 'Methods' AS section, 'Gates of ' || test_case_id AS caption FROM test_cases WHERE species IS NOT NULL AND n_gates > 12")
def article_scan(spark, d):
    """XML articles, one per file."""
    t = table(spark, d, "test_cases").filter("species is not null and n_gates > 12")
    i = F.col("test_case_id")
    body = F.concat(F.lit("<!DOCTYPE article><article><front><article-id pub-id-type='doi'>10.1/"), i, F.lit("</article-id><article-title>Panel\n "), i, F.lit("</article-title><abstract>"), _XML(F.concat(F.lit("About <"), "species", F.lit("> & more"))), F.lit("</abstract></front><body><sec><title>Methods</title></sec><fig><caption><p>Gates of "), i, F.lit("</p></caption></fig></body></article>"))
    path = scratch(spark, "articles")
    t.select(body.alias("value"), i.alias("part")).write.mode("overwrite").partitionBy("part").text(path)
    return files.articles(spark, f"{path}/*/*.txt").select("doi", "title", "abstract", F.explode("sections").alias("section"), "captions").select("doi", "title", "abstract", "section", F.explode("captions").alias("caption"))


@query("SELECT '/' || r_name AS path, '' AS parent_path, r_name AS name, 0 AS depth FROM region UNION ALL SELECT '/' || r_name || '/' || n_name, '/' || r_name, n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey")
def workspace_scan(spark, d):
    """XML workspaces: the gates of the first sample."""
    nations = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.collect_list(F.concat(F.lit('<Population name="'), "n_name", F.lit('"/>'))), "").alias("inner"))
    rows = table(spark, d, "region").join(nations, F.col("n_regionkey") == F.col("r_regionkey"))
    gate = F.concat(F.lit('<Workspace><SampleNode><Subpopulations><Population name="'), "r_name", F.lit('"><Subpopulations>'), "inner", F.lit("</Subpopulations></Population></Subpopulations></SampleNode><SampleNode/></Workspace>"))
    path = scratch(spark, "workspaces")
    rows.select(gate.alias("value"), F.col("r_name").alias("part")).write.mode("overwrite").partitionBy("part").text(path)
    return files.workspace_gates(spark, f"{path}/*/*.txt").select("path", "parent_path", "name", "depth")


@query("SELECT id, CASE WHEN bootstrap_run > 2 AND id % 3 <> 0 THEN 'cached' END AS response FROM predictions")
def cached_answers(spark, d):
    """Requests with their cached responses; those with a positive temperature bypass the cache."""
    p = table(spark, d, "predictions").select("id", "model", "bootstrap_run", F.when(F.col("id") % 3 == 0, 0.7).otherwise(0.0).alias("temperature"))
    key = config.response_key(F.col("id"), F.col("model"))
    cache = p.filter("bootstrap_run > 2").select(key.alias("key"), F.lit("cached").alias("response"))
    return config.cached_responses(p, key, cache, "temperature").select("id", "response")


@query("SELECT run_id, count(id) AS n, min(id) AS first_id, max(id) AS last_id FROM runs LEFT JOIN predictions USING (run_id) GROUP BY 1")
def run_documents(spark, d):
    """One JSON document per run, read back."""
    p = table(spark, d, "predictions").select("run_id", "id", "model")
    docs = sinks.run_documents(table(spark, d, "runs").select("run_id", "git_commit"), p)
    ids = F.coalesce(F.from_json("document", "struct<predictions: array<struct<id: bigint>>>")["predictions"]["id"], F.array().cast("array<bigint>"))
    return docs.select("run_id", ids.alias("ids")).select("run_id", F.size("ids").cast("bigint").alias("n"), F.array_min("ids").alias("first_id"), F.array_max("ids").alias("last_id"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT -o_orderkey - 1, 'new' FROM orders WHERE o_orderkey % 8 = 0")
def keyed_merge(spark, d):
    """Rows merged by key into the folder that they were read from."""
    path = scratch(spark, "merged")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    o.write.mode("overwrite").parquet(path)
    again = o.filter("o_orderkey % 4 = 0").select("o_orderkey", F.lit("new").alias("o_orderstatus"), F.lit(2).alias("at"))
    new = again.unionAll(again.select("o_orderkey", F.lit("old"), F.lit(1))).unionAll(again.filter("o_orderkey % 8 = 0").select(-F.col("o_orderkey") - 1, "o_orderstatus", "at"))
    sinks.keyed_overwrite(spark.read.parquet(path), new, ["o_orderkey"], path, ["at"])
    return spark.read.parquet(path)


@query("SELECT test_case_id, model, count(*) AS n FROM predictions GROUP BY ALL")
def appended_checkpoint(spark, d):
    """Finished work, appended in two steps and read back."""
    path = scratch(spark, "finished")
    p = table(spark, d, "predictions").select("id", "test_case_id", "model")
    sinks.append_jsonl(p.filter("id % 2 = 0"), path)
    sinks.append_jsonl(p.filter("id % 2 = 1"), path)
    return files.json_lines(spark, path, "id bigint, test_case_id string, model string").groupBy("test_case_id", "model").agg(F.count("*").alias("n"))


@query("SELECT run_id AS experiment_id, count(*) AS n FROM predictions WHERE model = 'orrery-small' GROUP BY 1")
def experiment_store(spark, d):
    """One folder per experiment; reading one model prunes nothing but rows, the folder's name is the key."""
    path = scratch(spark, "experiments")
    sinks.write_experiments(table(spark, d, "predictions").filter("model = 'orrery-small'").select(F.col("run_id").alias("experiment_id"), "id"), path)
    return spark.read.parquet(path).groupBy("experiment_id").agg(F.count("*").alias("n"))


@query("SELECT test_case_id, species, species IS NOT NULL AS found FROM (SELECT DISTINCT test_case_id FROM predictions) p LEFT JOIN test_cases USING (test_case_id)")
def reference_lookup(spark, d):
    """A reference table looked up by its key."""
    return lookup(table(spark, d, "predictions").select("test_case_id").distinct(), "test_case_id", table(spark, d, "test_cases").filter("species is not null"), "test_case_id", ["species"])
