"""Scoring, perturbation and resampling queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalspan.functions import text as X
from evalspan.functions.columns import r6
from evalspan.functions.jsontext import parse_responses, with_depth
from evalspan.operators import ordered as O
from evalspan.operators import perturb as PB
from evalspan.operators import scoring as SC
from evalspan.operators import statistics as ST
from evalspan.plans.aggregate_queries import MODELS, predictions
from evalspan.plans.analysis_queries import _NODES, geography
from evalspan.plans.row_queries import _E
from evalspan.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def markers(spark, d, name, field="marker"):
    e = table(spark, d, name).select(F.upper(F.translate("test_case_id", "_", "-")).alias("panel"), F.explode("entries").alias("e"))
    return e.select("panel", F.lower(F.trim(F.col("e")[field])).alias("name")).filter("name is not null")


_F1 = "round({p}, 6) AS precision, round({r}, 6) AS recall, round(CASE WHEN {p} + {r} = 0 THEN 0 ELSE 2 * {p} * {r} / ({p} + {r}) END, 6) AS f1"
_SETS = "(SELECT DISTINCT k AS panel, marker AS name FROM " + _E + " WHERE marker IS NOT NULL)"


def _f1_sql(left: str, right: str) -> str:
    return f"WITH g AS (SELECT coalesce(p.panel, t.panel) AS panel, count(p.name) AS np, count(t.name) AS nt, count(*) FILTER (WHERE p.name IS NOT NULL AND t.name IS NOT NULL) AS hit FROM {left} p FULL JOIN {right} t ON p.panel = t.panel AND p.name = t.name GROUP BY 1), s AS (SELECT panel, hit, CASE WHEN np = 0 THEN 0 ELSE hit / np END AS pr, CASE WHEN nt = 0 THEN 0 ELSE hit / nt END AS rc FROM g) SELECT panel, hit AS n_hit, " + _F1.format(p="pr", r="rc") + " FROM s"


@query(_f1_sql(_SETS.format(t="panel"), _SETS.format(t="panel_copy")))
def name_set_f1(spark, d):
    return SC.set_f1(markers(spark, d, "panel"), markers(spark, d, "panel_copy"), "panel", "name")


_CANON = "(SELECT DISTINCT k AS panel, lower(coalesce(c, marker)) AS name FROM " + _E + " LEFT JOIN (SELECT lower(synonym) AS s, arg_min(canonical, ord) AS c FROM synonyms GROUP BY 1) ON marker = s WHERE marker IS NOT NULL)"


@query(_f1_sql(_CANON.format(t="staging_panel"), _CANON.format(t="panel")))
def canonical_set_f1(spark, d):
    return SC.canonical_f1(markers(spark, d, "staging_panel"), markers(spark, d, "panel"), "panel", "name", table(spark, d, "synonyms"))


@query(f"WITH c AS (SELECT DISTINCT k AS panel, marker AS name FROM {_E.format(t='panel')} WHERE marker IN (SELECT lower(marker) FROM marker_list WHERE location = 'surface')), p AS (SELECT DISTINCT k AS panel, marker AS name FROM {_E.format(t='panel_copy')} WHERE marker IS NOT NULL), g AS (SELECT c.panel, count(*) AS n, count(p.name) AS k FROM c LEFT JOIN p USING (panel, name) GROUP BY 1) SELECT a.panel, coalesce(n, 0) AS n_critical, round(coalesce(k / n, 1.0), 6) AS recall FROM (SELECT panel FROM c UNION SELECT panel FROM p) a LEFT JOIN g USING (panel)")
def critical_recall(spark, d):
    surface = table(spark, d, "marker_list").filter("location = 'surface'").select(F.lower("marker").alias("name"))
    return SC.recall_of(markers(spark, d, "panel").join(surface, "name", "left_semi"), markers(spark, d, "panel_copy"), "panel", "name")


@query(f"WITH p AS (SELECT k AS panel, marker || CASE WHEN length(marker) > 4 THEN '+' ELSE '' END AS n FROM {_E.format(t='panel_copy')} WHERE marker IS NOT NULL), m AS (SELECT k AS panel, list(DISTINCT marker) AS ms FROM {_E.format(t='panel')} WHERE marker IS NOT NULL AND marker <> '' GROUP BY 1) SELECT panel, count(*) AS n_names, round(avg(CAST(regexp_matches(n, '[+-]') AND len(list_filter(coalesce(ms, []), lambda x: contains(n, x))) = 0 AS DOUBLE)), 6) AS hallucination_rate FROM p LEFT JOIN m USING (panel) WHERE NOT regexp_matches(n, 'scatter|time') GROUP BY panel")
def hallucinated_names(spark, d):
    signed = markers(spark, d, "panel_copy").withColumn("name", F.concat("name", F.when(F.length("name") > 4, "+").otherwise("")))
    return SC.hallucination_rate(signed, "panel", "name", markers(spark, d, "panel").withColumnRenamed("name", "marker"), "marker", "scatter|time")


_PRED = f"(SELECT tree, node, parent, CASE WHEN depth = 2 AND name < 'Supplier#000000030' THEN name || 'x' ELSE name END AS name, depth FROM {_NODES})"


@query(f"WITH q AS {_NODES}, p AS {_PRED}, t AS (SELECT a.tree, a.name, b.name AS pt, a.depth FROM q a JOIN q b ON a.tree = b.tree AND a.parent = b.node), l AS (SELECT a.tree, a.name, b.name AS pp, a.depth FROM p a JOIN p b ON a.tree = b.tree AND a.parent = b.node), f AS (SELECT tree, name, list(DISTINCT pp) AS ps, list(DISTINCT depth) AS ds FROM l GROUP BY ALL) SELECT t.tree, t.name, CASE WHEN x.name IS NULL THEN 'missing' WHEN list_contains(ps, pt) AND list_contains(ds, t.depth) THEN 'correct' WHEN i.name IS NOT NULL THEN 'swapped' WHEN list_contains(ps, pt) THEN 'wrong_depth' ELSE 'wrong_parent' END AS error FROM t LEFT JOIN (SELECT DISTINCT tree, name FROM p) x ON t.tree = x.tree AND t.name = x.name LEFT JOIN f ON t.tree = f.tree AND t.name = f.name LEFT JOIN (SELECT DISTINCT tree, name, pp FROM l) i ON t.tree = i.tree AND i.name = t.pt AND i.pp = t.name")
def structure_error_kinds(spark, d):
    truth = geography(spark, d)
    predicted = truth.withColumn("name", F.when((F.col("depth") == 2) & (F.col("name") < "Supplier#000000030"), F.concat("name", F.lit("x"))).otherwise(F.col("name")))
    return SC.structure_errors(predicted, truth, "tree")


@query(f"WITH m AS {_NODES}, c AS (SELECT tree, node, CASE WHEN depth = 1 THEN NULL ELSE parent END AS parent, name FROM {_NODES} WHERE depth >= 1), cl AS (SELECT DISTINCT a.tree, a.name, coalesce(b.name, '') AS pn FROM c a LEFT JOIN c b ON a.tree = b.tree AND a.parent = b.node), ml AS (SELECT a.tree, a.name, coalesce(b.name, '') AS pn FROM m a LEFT JOIN m b ON a.tree = b.tree AND a.parent = b.node), u AS (SELECT * FROM ml UNION SELECT tree, name, '' FROM ml) SELECT cl.tree, count(u.name) = count(*) AS contained FROM cl LEFT JOIN u ON cl.tree = u.tree AND cl.name = u.name AND cl.pn = u.pn GROUP BY cl.tree")
def subtree_check(spark, d):
    nodes = geography(spark, d)
    lower = nodes.filter("depth >= 1").withColumn("parent", F.when(F.col("depth") > 1, F.col("parent")))
    return SC.subtree_contained(nodes, lower, "tree")


_RAW = "SELECT k AS panel, marker AS n FROM {e} WHERE marker IS NOT NULL"


@query(f"WITH l AS (SELECT DISTINCT k AS panel, e.marker AS p FROM (SELECT {'upper(replace(test_case_id, ' + chr(39) + '_' + chr(39) + ', ' + chr(39) + '-' + chr(39) + '))'} AS k, unnest(entries) AS e FROM panel) WHERE e.marker IS NOT NULL), r AS (SELECT DISTINCT k AS panel, e.marker AS t FROM (SELECT {'upper(replace(test_case_id, ' + chr(39) + '_' + chr(39) + ', ' + chr(39) + '-' + chr(39) + '))'} AS k, unnest(entries) AS e FROM panel_copy) WHERE e.marker IS NOT NULL), x AS (SELECT panel, p, t, 'exact' AS tier FROM l JOIN r USING (panel) WHERE p = t), l2 AS (SELECT *, lower(trim(p, ' ')) AS f, row_number() OVER (PARTITION BY panel, lower(trim(p, ' ')) ORDER BY p) AS i FROM l WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.panel = l.panel AND x.p = l.p)), r2 AS (SELECT *, lower(trim(t, ' ')) AS f, row_number() OVER (PARTITION BY panel, lower(trim(t, ' ')) ORDER BY t) AS i FROM r WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.panel = r.panel AND x.t = r.t)) SELECT * FROM x UNION ALL SELECT l2.panel, p, t, 'folded' FROM l2 JOIN r2 ON l2.panel = r2.panel AND l2.f = r2.f AND l2.i = r2.i")
def tiered_matches(spark, d):
    raw = lambda n: table(spark, d, n).select(F.upper(F.translate("test_case_id", "_", "-")).alias("panel"), F.explode("entries").alias("e")).select("panel", F.col("e.marker").alias("name"))
    return SC.tiered_matches(raw("panel"), raw("panel_copy"), "panel", "name", [("exact", F.col("name")), ("folded", F.lower(F.trim(F.col("name"))))])


@query("SELECT test_case_id, arg_min(model, (-round(f1, 6), t, model)) AS winner, round(max(f1), 6) AS score FROM (SELECT test_case_id, model, round(avg(hierarchy_f1), 6) AS f1, min(tokens_used) AS t FROM predictions WHERE hierarchy_f1 IS NOT NULL GROUP BY ALL) GROUP BY 1")
def model_tournament(spark, d):
    m = predictions(spark, d).filter("hierarchy_f1 is not null").groupBy("test_case_id", "model").agg(r6(F.avg("hierarchy_f1")).alias("f1"), F.min("tokens_used").alias("t"))
    return SC.tournament(m, "test_case_id", "model", "model", "f1", "t")


FAMILIES = {"orrery": ["orrery"], "plover": ["plover"], "other": ["tern", "basalt"]}


@query("SELECT model, CASE WHEN contains(lower(model), 'orrery') THEN 'orrery' WHEN contains(lower(model), 'plover') THEN 'plover' WHEN contains(lower(model), 'tern') OR contains(lower(model), 'basalt') THEN 'other' END AS family, count(*) AS n FROM predictions GROUP BY ALL")
def model_families(spark, d):
    return predictions(spark, d).groupBy("model", X.first_family(F.col("model"), FAMILIES).alias("family")).agg(F.count("*").alias("n"))


KINDS = {"protocol": ["staining", "fixation", "titrated"], "results": ["histogram", "frequencies", "distribution"], "plain": ["blood", "cells", "colour"]}


@query("WITH h AS (SELECT doc_id, " + ", ".join("(" + " + ".join(f"CAST(contains(lower(coalesce(text, '')), '{w}') AS INT)" for w in ws) + f") AS {k}" for k, ws in KINDS.items()) + " FROM documents) SELECT doc_id, CASE WHEN greatest(protocol, results, plain) = 0 THEN NULL WHEN protocol >= results AND protocol >= plain THEN 'protocol' WHEN results >= plain THEN 'results' ELSE 'plain' END AS kind FROM h")
def document_kinds(spark, d):
    return table(spark, d, "documents").select("doc_id", X.most_hits(F.col("text"), KINDS).alias("kind"))


@query("SELECT panel, round(CASE WHEN n = 0 THEN 0 ELSE k / n END, 6) AS accuracy FROM (SELECT t.k AS panel, count(*) AS n, count(*) FILTER (WHERE lower(trim(p.dye, ' ')) = lower(trim(t.dye, ' '))) AS k FROM (SELECT upper(replace(test_case_id, '_', '-')) AS k, e.channel AS ch, e.fluorophore AS dye FROM (SELECT test_case_id, unnest(arg_max(entries, (revision, updated_at))) AS e FROM (SELECT upper(replace(test_case_id, '_', '-')) AS test_case_id, revision, updated_at, entries FROM panel_copy) GROUP BY test_case_id)) t LEFT JOIN (SELECT upper(replace(test_case_id, '_', '-')) AS k, e.channel AS ch, e.fluorophore AS dye FROM (SELECT test_case_id, unnest(arg_max(entries, (revision, updated_at))) AS e FROM (SELECT upper(replace(test_case_id, '_', '-')) AS test_case_id, revision, updated_at, entries FROM panel) GROUP BY test_case_id)) p ON t.k = p.k AND t.ch = p.ch WHERE EXISTS (SELECT 1 FROM panel z WHERE upper(replace(z.test_case_id, '_', '-')) = t.k) GROUP BY 1)")
def assignment_accuracy(spark, d):
    def side(name, c):
        p = table(spark, d, name).groupBy(F.upper(F.translate("test_case_id", "_", "-")).alias("panel")).agg(F.max_by("entries", F.struct("revision", "updated_at")).alias("e"))
        return p.select("panel", F.map_from_entries(F.transform("e", lambda x: F.struct(x["channel"], F.coalesce(x["fluorophore"], F.lit("\x00"))))).alias(c))

    j = side("panel_copy", "t").join(side("panel", "p"), "panel")
    # A null dye equals nothing, not even another null.
    truth = F.map_filter("t", lambda k, v: v != "\x00")
    return j.select("panel", r6(F.when(F.size("t") == 0, 0.0).otherwise(X.assignment_accuracy(F.col("p"), truth) * F.size(truth) / F.size("t"))).alias("accuracy"))


@query()
def response_depths(spark, d):
    """Depth of the parsed tree of every answer, against its number of gates."""
    nodes = with_depth(parse_responses(predictions(spark, d), "id", "raw_response"), "id")
    return nodes.groupBy("id").agg(F.max("depth").alias("depth"), F.count("*").alias("n_gates"), SC.order_kept(F.array_sort(F.collect_list(F.struct("node", "name")))["name"], ["events", "singlets", "live"]).alias("order_kept"))


@query()
def text_perturbations(spark, d):
    return PB.text_variants(table(spark, d, "eval_items"), "item_id", "text", list(PB.PERTURBATIONS), 0.05)


@query()
def pruned_trees(spark, d):
    return PB.pruned(geography(spark, d), "tree", 0.2)


@query()
def bootstrap_difference(spark, d):
    return ST.bootstrap_difference(predictions(spark, d), ["context_level"], "model", *MODELS, "id", "hierarchy_f1")


@query()
def label_permutation(spark, d):
    return ST.label_permutation(predictions(spark, d), ["context_level"], "model", *MODELS, "id", "hierarchy_f1")


@query("WITH r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS a, row_number() OVER (PARTITION BY source ORDER BY n_chars ASC NULLS LAST, doc_id) AS b FROM documents), u AS (SELECT source, doc_id, a * 2 - 1 AS place FROM r WHERE a <= 5 UNION ALL SELECT source, doc_id, b * 2 FROM r WHERE b <= 5), m AS (SELECT source, doc_id, min(place) AS place FROM u GROUP BY ALL) SELECT source, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY place) AS rank FROM m) WHERE rank <= 5")
def interleaved_top(spark, d):
    """Two rankings (longest and shortest documents of a source) interleaved without repeats: the five first of each source."""
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    a = O.top_k(docs, ["source"], [F.desc_nulls_last("n_chars"), F.col("doc_id")], 5).select("source", "doc_id", (F.col("rank") * 2 - 1).alias("place"))
    b = O.top_k(docs, ["source"], [F.asc_nulls_last("n_chars"), F.col("doc_id")], 5).select("source", "doc_id", (F.col("rank") * 2).alias("place"))
    first = a.unionAll(b).groupBy("source", "doc_id").agg(F.min("place").alias("place"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("place"))).filter("rank <= 5").drop("place")
