"""Queries of the general problems: schema drift, nested records, differences between copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspan.operators import copy_diff, nested, schema_drift
from evalspan.session import cut_lineage
from evalspan.sources.tables import table

ENTRY_FIELDS = ("marker", "fluorophore", "clone", "vendor", "cat_number")


def _panel_side(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = table(spark, sf_dir, name)
    payload = [F.col("best_extraction")["panel"].alias("best_extraction.panel"), F.col("entries").alias("entries")]
    return copy_diff.highest_revision(df, copy_diff.normal_id(F.col("test_case_id")), "revision", payload, ("updated_at",))


def panel_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = [_panel_side(spark, sf_dir, name) for name in ("panel", "panel_copy")]
    return copy_diff.diff_nested(*sides, ENTRY_FIELDS, ("best_extraction.panel",))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.when(F.col("d.kind") == "only_left", "only_panel").when(F.col("d.kind") == "only_right", "only_copy").otherwise(F.col("d.kind"))
    return panel_differences(spark, sf_dir).select(F.col("key").alias("test_case_id"), F.explode("differences").alias("d")).select("test_case_id", "d.channel", "d.field", kinds.alias("kind"))


def p5_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every differing value with what either side holds."""
    d = panel_differences(spark, sf_dir).select(F.col("key").alias("test_case_id"), F.explode("differences").alias("d"))
    return d.filter(F.col("d.kind") == "differs").select("test_case_id", "d.channel", "d.field", "d.left_value", "d.right_value")


def _context_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.fields_of(table(spark, sf_dir, "context_files"), "collection", "batch_no", "body", "$.test_case_id", "$.context")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = schema_drift.drift_report(_context_fields(spark, sf_dir))
    return report.select("collection", F.col("batch").alias("batch_no"), "change", "old_field", "new_field")


def p2_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contexts under consistent names and types."""
    fields = cut_lineage(_context_fields(spark, sf_dir))  # bodies are parsed once
    schemas, report = schema_drift.drift(fields)
    return schema_drift.consistent_table(fields, report, schemas).withColumnRenamed("batch", "batch_no")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.gate_tables(table(spark, sf_dir, "raw_extractions"), attributes=False).select("record_id", "kind", "parent_path", "node_path")


def p4_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate table with its attributes."""
    nodes = nested.gate_tables(table(spark, sf_dir, "raw_extractions")).filter("kind = 'gate'")
    a = F.col("attributes")
    return nodes.select("record_id", "parent_path", "node_path", "name", "depth", F.get_json_object(a, "$.gate_type").alias("gate_type"), F.get_json_object(a, "$.is_critical").cast("boolean").alias("is_critical"))


def p4_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed column concordance of extractions: its panel array as a flat child table."""
    flat = nested.flat_tables(table(spark, sf_dir, "extractions"), "extraction_id", "concordance")["concordance.panel"]
    return flat.select("extraction_id", "node_path", "methods", "metric", "score")


QUERIES = {"p4_found": p4_found, "p4_gates": p4_gates, "p4_concordance": p4_concordance, "p2_found": p2_found, "p2_table": p2_table, "p5_found": p5_found, "p5_values": p5_values}

_HYPHENS = copy_diff.HYPHENS
_NORMAL = "coalesce(lower(trim(regexp_replace(translate({x}, '" + _HYPHENS + "', '" + "-" * len(_HYPHENS) + "'), '[\\s\\x{{00a0}}]+', ' ', 'g'))), '')"
_TOP = "(SELECT k, arg_max(e, (revision, updated_at)) AS e, arg_max(struct_pack(b := b), (revision, updated_at)).b AS b FROM (SELECT upper(trim(replace(translate(test_case_id, '" + _HYPHENS + "', '" + "-" * len(_HYPHENS) + "'), '_', '-'))) AS k, revision, updated_at, entries AS e, best_extraction.panel AS b FROM {t}) GROUP BY k)"
_FIELD_SQL = " UNION ALL ".join(f"SELECT a.k AS test_case_id, a.ch AS channel, '{f}' AS field, 'differs' AS kind FROM ea a JOIN eb b ON a.k = b.k AND a.ch = b.ch WHERE {_NORMAL.format(x=f'a.e.{f}')} <> {_NORMAL.format(x=f'b.e.{f}')}" for f in ENTRY_FIELDS)

_P5 = f"""
WITH a AS {_TOP.format(t='panel')}, b AS {_TOP.format(t='panel_copy')},
ea AS (SELECT k, x.channel AS ch, x AS e FROM (SELECT k, unnest(e) AS x FROM a) WHERE k IN (SELECT k FROM b)),
eb AS (SELECT k, x.channel AS ch, x AS e FROM (SELECT k, unnest(e) AS x FROM b) WHERE k IN (SELECT k FROM a))
SELECT k AS test_case_id, '' AS channel, 'row' AS field, 'only_panel' AS kind FROM a WHERE k NOT IN (SELECT k FROM b)
UNION ALL SELECT k, '', 'row', 'only_copy' FROM b WHERE k NOT IN (SELECT k FROM a)
UNION ALL SELECT a.k, '', 'best_extraction.panel', 'differs' FROM a JOIN b ON a.k = b.k WHERE {_NORMAL.format(x='a.b')} <> {_NORMAL.format(x='b.b')}
UNION ALL SELECT k, ch, 'entry', 'only_panel' FROM ea WHERE NOT EXISTS (SELECT 1 FROM eb WHERE eb.k = ea.k AND eb.ch = ea.ch)
UNION ALL SELECT k, ch, 'entry', 'only_copy' FROM eb WHERE NOT EXISTS (SELECT 1 FROM ea WHERE eb.k = ea.k AND eb.ch = ea.ch)
UNION ALL {_FIELD_SQL}"""

_KIND = "CASE json_type({v}) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN NULL ELSE 'number' END"
_P2 = f"""
WITH o AS (SELECT file_id, collection, batch_no, json_extract_string(body, '$.test_case_id') AS tc, json_extract(body, '$.context') AS c FROM context_files WHERE json_valid(body) AND json_type(json_extract(body, '$.context')) = 'OBJECT'),
f AS (SELECT collection, batch_no, tc, k, json_extract(c, '$."' || k || '"') AS v FROM (SELECT *, unnest(json_keys(c)) AS k FROM o)),
t AS (SELECT *, CASE WHEN json_type(v) = 'ARRAY' THEN (SELECT 'array<' || string_agg(DISTINCT x, ',' ORDER BY x) || '>' FROM (SELECT {_KIND.format(v='e')} AS x FROM (SELECT unnest(json_extract(v, '$[*]')) AS e)) WHERE x IS NOT NULL) ELSE {_KIND.format(v='v')} END AS kind FROM f),
s AS (SELECT collection, batch_no, k, list_sort(list_distinct(list(kind) FILTER (WHERE kind IS NOT NULL))) AS kinds FROM t GROUP BY ALL),
b AS (SELECT collection, batch_no, lag(batch_no) OVER (PARTITION BY collection ORDER BY batch_no) AS before FROM (SELECT DISTINCT collection, batch_no FROM s)),
gone AS (SELECT b.collection, b.batch_no, b.before, s.k FROM b JOIN s ON s.collection = b.collection AND s.batch_no = b.before WHERE NOT EXISTS (SELECT 1 FROM s n WHERE n.collection = b.collection AND n.batch_no = b.batch_no AND n.k = s.k)),
come AS (SELECT b.collection, b.batch_no, b.before, s.k FROM b JOIN s ON s.collection = b.collection AND s.batch_no = b.batch_no WHERE b.before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s n WHERE n.collection = b.collection AND n.batch_no = b.before AND n.k = s.k)),
r AS (SELECT g.collection, g.batch_no, g.k AS old, c.k AS new FROM gone g JOIN come c ON g.collection = c.collection AND g.batch_no = c.batch_no
  JOIN t x ON x.collection = g.collection AND x.batch_no = g.before AND x.k = g.k AND x.kind IS NOT NULL JOIN t y ON y.collection = g.collection AND y.batch_no = g.batch_no AND y.k = c.k AND y.kind IS NOT NULL AND y.tc = x.tc
  GROUP BY ALL HAVING count(DISTINCT x.tc) = count(DISTINCT x.tc) FILTER (WHERE CAST(x.v AS VARCHAR) = CAST(y.v AS VARCHAR)))
SELECT collection, batch_no, 'renamed' AS change, old AS old_field, new AS new_field FROM r
UNION ALL SELECT collection, batch_no, 'removed', k, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.collection = g.collection AND r.batch_no = g.batch_no AND r.old = g.k)
UNION ALL SELECT collection, batch_no, 'added', '', k FROM come c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.collection = c.collection AND r.batch_no = c.batch_no AND r.new = c.k)
UNION ALL SELECT b.collection, b.batch_no, 'retyped', n.k, n.k FROM b JOIN s n ON n.collection = b.collection AND n.batch_no = b.batch_no JOIN s p ON p.collection = b.collection AND p.batch_no = b.before AND p.k = n.k WHERE len(n.kinds) > 0 AND len(p.kinds) > 0 AND n.kinds <> p.kinds"""

# JSON with the keys of objects in order, at the two levels that occur here.
_SORTED = lambda v: "'{' || array_to_string(list_transform(list_sort(json_keys({v})), lambda k: '\"' || k || '\":' || CAST(json_extract({v}, '$.\"' || k || '\"') AS VARCHAR)), ',') || '}'".replace("{v}", v)
_TEXT = f"CASE json_type(@) WHEN 'OBJECT' THEN {_SORTED('@')} WHEN 'ARRAY' THEN '[' || array_to_string(list_transform(json_extract(@, '$[*]'), lambda e: CASE json_type(e) WHEN 'OBJECT' THEN {_SORTED('e')} ELSE CAST(e AS VARCHAR) END), ',') || ']' ELSE CAST(@ AS VARCHAR) END"
_P2_TABLE = _P2[: _P2.index("SELECT collection, batch_no, 'renamed' AS change")].replace("WITH o AS", "WITH RECURSIVE o AS").rstrip() + """,
e AS (SELECT r.collection, r.batch_no, b.before, old, new FROM r JOIN b ON b.collection = r.collection AND b.batch_no = r.batch_no),
p AS (SELECT e.*, (SELECT max(x.batch_no) FROM e x WHERE x.collection = e.collection AND x.new = e.old AND x.batch_no <= e.before) AS pb FROM e),
c AS (SELECT collection, batch_no, new, old AS name FROM p WHERE pb IS NULL UNION ALL SELECT p.collection, p.batch_no, p.new, c.name FROM p JOIN c ON c.collection = p.collection AND c.batch_no = p.pb AND c.new = p.old),
l AS (SELECT s.collection, s.batch_no, s.k, s.kinds, coalesce((SELECT arg_max(c.name, c.batch_no) FROM c WHERE c.collection = s.collection AND c.new = s.k AND c.batch_no <= s.batch_no), s.k) AS canonical FROM s),
y AS (SELECT collection, canonical, list_sort(list_distinct(flatten(list(coalesce(kinds, []))))) AS kinds FROM l GROUP BY ALL),
z AS (SELECT collection, canonical, CASE WHEN len(list_filter(kinds, lambda k: k LIKE 'array<%')) > 0 THEN CASE WHEN len(kinds) = 1 THEN kinds[1] ELSE 'array<string>' END WHEN len(kinds) > 1 THEN 'string' ELSE kinds[1] END AS type FROM y),
v AS (SELECT t.collection, t.batch_no, t.tc, l.canonical, z.type, t.kind, t.v, """ + _TEXT.replace("@", "t.v") + """ AS json, CASE WHEN t.kind = 'string' THEN json_extract_string(t.v, '$') ELSE """ + _TEXT.replace("@", "t.v") + """ END AS text FROM t JOIN l ON l.collection = t.collection AND l.batch_no = t.batch_no AND l.k = t.k JOIN z ON z.collection = l.collection AND z.canonical = l.canonical)
SELECT collection, batch_no, tc AS case_id, canonical AS field, type, CASE WHEN kind IS NULL THEN NULL WHEN kind = type OR (type = 'array<string>' AND kind = 'array<string>') THEN json
  WHEN type = 'array<string>' AND kind LIKE 'array<%' THEN CAST(to_json(list_transform(json_extract(v, '$[*]'), lambda x: """ + _TEXT.replace("@", "x").replace("lambda e:", "lambda q:").replace("json_type(e)", "json_type(q)").replace("json_keys(e)", "json_keys(q)").replace("json_extract(e,", "json_extract(q,").replace("CAST(e AS", "CAST(q AS") + """)) AS VARCHAR) WHEN type = 'array<string>' THEN CAST(to_json([text]) AS VARCHAR) ELSE CAST(to_json(text) AS VARCHAR) END AS value FROM v"""

_DATA = "CASE WHEN json_type(d) = 'VARCHAR' THEN CAST(json_extract_string(d, '$') AS JSON) ELSE d END"
_P4 = f"""
WITH RECURSIVE v AS (SELECT record_id, CAST(body AS JSON) AS j FROM raw_extractions WHERE json_valid(body)),
p AS (SELECT record_id, {_DATA} AS d FROM (SELECT record_id, json_extract(j, '$.extractions.panel.' || json_extract_string(j, '$.best_extraction.panel') || '.data') AS d FROM v)),
h AS (SELECT record_id, {_DATA} AS d FROM (SELECT record_id, json_extract(j, '$.extractions.gating_hierarchy.' || json_extract_string(j, '$.best_extraction.gating_hierarchy') || '.data') AS d FROM v)),
root AS (SELECT record_id, CASE WHEN json_exists(d, '$.name') THEN d WHEN json_exists(d, '$.hierarchy.name') THEN json_extract(d, '$.hierarchy') WHEN json_exists(d, '$.root.name') THEN json_extract(d, '$.root') ELSE json_extract(d, '$.hierarchy.root') END AS n FROM h),
g AS (SELECT record_id, '' AS parent_path, '0' AS path, n FROM root WHERE json_type(n) = 'OBJECT'
  UNION ALL SELECT record_id, path, path || '.' || (i - 1), c[i] FROM (SELECT record_id, path, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT record_id, path, CASE json_type(json_extract(n, '$.children')) WHEN 'ARRAY' THEN json_extract(n, '$.children[*]') WHEN 'OBJECT' THEN [json_extract(n, '$.children')] ELSE [] END AS c FROM g)) WHERE json_type(c[i]) = 'OBJECT'),
e AS (SELECT record_id, unnest(range(CAST(json_array_length(d, '$.entries') AS BIGINT))) AS i FROM p WHERE json_type(json_extract(d, '$.entries')) = 'ARRAY'),
l AS (SELECT record_id, path, unnest(range(CAST(json_array_length(n, '$.marker_logic') AS BIGINT))) AS i FROM g WHERE json_type(json_extract(n, '$.marker_logic')) = 'ARRAY')
SELECT record_id, 'entry' AS kind, '' AS parent_path, CAST(i AS VARCHAR) AS node_path FROM e
UNION ALL SELECT record_id, 'gate', parent_path, path FROM g
UNION ALL SELECT record_id, 'logic', path, path || '/' || i FROM l"""

_P4_GATES = _P4[: _P4.index("e AS (SELECT record_id, unnest(range(")].rstrip().rstrip(",") + """
SELECT record_id, parent_path, path AS node_path, coalesce(json_extract_string(n, '$.name'), CASE WHEN json_type(json_extract(n, '$.marker')) = 'VARCHAR' THEN json_extract_string(n, '$.marker') END) AS name,
  len(path) - len(replace(path, '.', '')) AS depth, json_extract_string(n, '$.gate_type') AS gate_type, CAST(json_extract_string(n, '$.is_critical') AS BOOLEAN) AS is_critical FROM g"""
_P4_CONCORDANCE = """SELECT extraction_id, CAST(i - 1 AS VARCHAR) AS node_path, p[i].methods AS methods, p[i].metric AS metric, p[i].score AS score
FROM (SELECT extraction_id, concordance.panel AS p, unnest(range(1, len(concordance.panel) + 1)) AS i FROM extractions) WHERE p[i] IS NOT NULL"""
_SIDES = _P5[: _P5.index("SELECT k AS test_case_id, '' AS channel, 'row' AS field")]
_P5_VALUES = f"""{_SIDES}
SELECT a.k AS test_case_id, '' AS channel, 'best_extraction.panel' AS field, a.b AS left_value, b.b AS right_value FROM a JOIN b ON a.k = b.k WHERE {_NORMAL.format(x='a.b')} <> {_NORMAL.format(x='b.b')}
UNION ALL """ + " UNION ALL ".join(f"SELECT a.k, a.ch, '{f}', a.e.{f}, b.e.{f} FROM ea a JOIN eb b ON a.k = b.k AND a.ch = b.ch WHERE {_NORMAL.format(x=f'a.e.{f}')} <> {_NORMAL.format(x=f'b.e.{f}')}" for f in ENTRY_FIELDS)

ORACLES: dict[str, str] = {"p5_found": _P5, "p5_values": _P5_VALUES, "p2_found": _P2, "p2_table": _P2_TABLE, "p4_found": _P4, "p4_gates": _P4_GATES, "p4_concordance": _P4_CONCORDANCE}
