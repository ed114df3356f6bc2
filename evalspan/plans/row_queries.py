"""Projections, filters, set operations, upserts, text extraction and event windows, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalspan.functions import text as X
from evalspan.functions.columns import COMPLEXITY, bucket, ladder, r6, ratio
from evalspan.operators import agreement as G
from evalspan.operators import ordered as O
from evalspan.plans.aggregate_queries import MODELS, P, predictions
from evalspan.sources.sinks import export_columns, flatten_struct
from evalspan.sources.tables import table
from evalspan.streaming.windows import session_activity, tumbling_stats

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_K = "upper(replace(test_case_id, '_', '-'))"


@query("SELECT extraction_id, best_extraction.panel AS \"best_extraction.panel\", best_extraction.gating_hierarchy AS \"best_extraction.gating_hierarchy\", coalesce(len(concordance.panel), 0) AS n_panel, coalesce(array_to_string(list_transform(concordance.panel, lambda x: coalesce(x.methods, '')), '|'), '') AS methods FROM extractions")
def nested_flatten(spark, d):
    flat = flatten_struct(table(spark, d, "extractions").select("extraction_id", "best_extraction", "concordance"))
    return export_columns(flat, {"extraction_id": "extraction_id", "best_extraction.panel": "best_extraction.panel", "best_extraction.gating_hierarchy": "best_extraction.gating_hierarchy"}, {"n_panel": "concordance.panel"}, {"methods": ("concordance.panel", "methods")})


@query(f"SELECT {_K} AS panel, revision, n AS n_colours, CASE WHEN n <= 15 THEN 'simple' WHEN n <= 25 THEN 'medium' ELSE 'complex' END AS complexity FROM (SELECT *, len(list_filter(entries, lambda e: e.fluorophore IS NOT NULL AND upper(trim(e.fluorophore, ' ')) NOT IN ('FSC', 'SSC'))) AS n FROM panel)")
def complexity_bucket(spark, d):
    n = F.size(F.filter("entries", lambda e: e["fluorophore"].isNotNull() & ~F.upper(F.trim(e["fluorophore"])).isin("FSC", "SSC")))
    return table(spark, d, "panel").select(F.upper(F.translate("test_case_id", "_", "-")).alias("panel"), "revision", n.alias("n_colours"), bucket(n, COMPLEXITY, "complex").alias("complexity"))


def conjunction(df, equal: dict, least: dict):
    """Rows that meet all given conditions; None leaves a condition out."""
    conditions = [F.col(c) == v for c, v in equal.items() if v is not None] + [F.col(c) >= v for c, v in least.items() if v is not None]
    return df.filter(reduce(lambda a, b: a & b, conditions)) if conditions else df


@query(f"SELECT id, model, condition, hierarchy_f1 FROM {P} WHERE model = '{MODELS[1]}' AND parse_success AND hierarchy_f1 >= 0.4")
def filtered_results(spark, d):
    return conjunction(predictions(spark, d), {"model": MODELS[1], "parse_success": True, "condition": None}, {"hierarchy_f1": 0.4}).select("id", "model", "condition", "hierarchy_f1")


@query("SELECT DISTINCT model FROM predictions WHERE model ILIKE 'ORRERY%' OR model ILIKE '%\\_mini' ESCAPE '\\'")
def model_filter(spark, d):
    return predictions(spark, d).filter(F.col("model").ilike("ORRERY%") | F.col("model").ilike("%\\_mini")).select("model").distinct()


@query("SELECT id, array_to_string(list_filter([CASE WHEN hierarchy_f1 < 0.1 THEN 'low f1' END, CASE WHEN hallucination_rate > 0.3 THEN 'hallucination' END, CASE WHEN critical_gate_recall < 0.5 THEN 'critical recall' END], lambda x: x IS NOT NULL), '; ') AS reason FROM predictions WHERE hierarchy_f1 < 0.1 OR hallucination_rate > 0.3 OR critical_gate_recall < 0.5")
def outlier_reasons(spark, d):
    reasons = F.concat_ws("; ", F.when(F.col("hierarchy_f1") < 0.1, "low f1"), F.when(F.col("hallucination_rate") > 0.3, "hallucination"), F.when(F.col("critical_gate_recall") < 0.5, "critical recall"))
    return predictions(spark, d).select("id", reasons.alias("reason")).filter("reason <> ''")


@query("SELECT test_case_id, n_gates, (omip_id IS NOT NULL AND n_gates > 1) AS complete, array_to_string(list_filter([CASE WHEN omip_id IS NULL THEN 'no id' END, CASE WHEN n_gates < 5 THEN 'few gates' END, CASE WHEN difficulty IS NULL THEN 'no difficulty' END], lambda x: x IS NOT NULL), ',') AS issues FROM test_cases")
def completeness(spark, d):
    issues = F.array_compact(F.array(F.when(F.col("omip_id").isNull(), "no id"), F.when(F.col("n_gates") < 5, "few gates"), F.when(F.col("difficulty").isNull(), "no difficulty")))
    return table(spark, d, "test_cases").select("test_case_id", "n_gates", (F.col("omip_id").isNotNull() & (F.col("n_gates") > 1)).alias("complete"), F.array_join(issues, ",").alias("issues"))


@query(f"SELECT DISTINCT run_id, test_case_id, model, condition, bootstrap_run FROM {P} WHERE raw_response IS NOT NULL AND (error_type IS NULL) AND NOT contains(raw_response, '[ERROR') AND NOT contains(raw_response, '[BLOCKED')")
def completed_keys(spark, d):
    raw = F.col("raw_response")
    return predictions(spark, d).filter(raw.isNotNull() & F.col("error_type").isNull() & ~raw.contains("[ERROR") & ~raw.contains("[BLOCKED")).select("run_id", "test_case_id", "model", "condition", "bootstrap_run").distinct()


CATEGORIES = ("model", "context_level", "prompt_strategy", "reference_mode", "test_case_id", "raw_response", "error_type")


@query("SELECT field, n_values, n_values BETWEEN 2 AND 0.3 * n AS categorical FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS field, count(DISTINCT {c}) AS n_values, count(*) AS n FROM predictions" for c in CATEGORIES) + ")")
def categorical_fields(spark, d):
    counts = predictions(spark, d).agg(F.count("*").alias("n"), *(F.countDistinct(c).alias(c) for c in CATEGORIES))
    long = counts.unpivot("n", list(CATEGORIES), "field", "n_values")
    return long.select("field", "n_values", ((F.col("n_values") >= 2) & (F.col("n_values") <= 0.3 * F.col("n"))).alias("categorical"))


@query("SELECT name, optimal_laser, relative_brightness, list_contains(compatible_lasers, 488) AS fits_488 FROM fluorophore WHERE relative_brightness BETWEEN 40 AND 100 OR list_contains(compatible_lasers, 488)")
def laser_predicates(spark, d):
    fits = F.array_contains("compatible_lasers", 488)
    return table(spark, d, "fluorophore").filter(F.col("relative_brightness").between(40, 100) | fits).select("name", "optimal_laser", "relative_brightness", fits.alias("fits_488"))


_E = "(SELECT " + _K + " AS k, lower(trim(e.marker, ' ')) AS marker, lower(trim(e.fluorophore, ' ')) AS dye, e.vendor AS vendor FROM (SELECT test_case_id, unnest(entries) AS e FROM {t}))"


@query(f"WITH c AS (SELECT marker, dye, count(*) AS n, min(vendor) AS vendor FROM {_E.format(t='panel_copy')} WHERE marker IS NOT NULL AND dye IS NOT NULL GROUP BY ALL) SELECT p.k AS panel, count(*) AS n, count(c.marker) AS n_available, round(count(c.marker) / count(*), 6) AS availability, count(DISTINCT c.vendor) AS n_vendors FROM {_E.format(t='panel')} p LEFT JOIN c ON p.marker = c.marker AND p.dye = c.dye GROUP BY p.k")
def panel_availability(spark, d):
    def side(name):
        e = table(spark, d, name).select(F.upper(F.translate("test_case_id", "_", "-")).alias("panel"), F.explode("entries").alias("e"))
        return e.select("panel", F.lower(F.trim("e.marker")).alias("marker"), F.lower(F.trim("e.fluorophore")).alias("dye"), F.col("e.vendor").alias("vendor"))

    known = side("panel_copy").filter("marker is not null and dye is not null").groupBy("marker", "dye").agg(F.min("vendor").alias("v"), F.lit(1).alias("hit"))
    j = side("panel").join(known, ["marker", "dye"], "left")
    return j.groupBy("panel").agg(F.count("*").alias("n"), F.count("hit").alias("n_available"), r6(F.count("hit") / F.count("*")).alias("availability"), F.countDistinct("v").alias("n_vendors"))


@query(f"WITH s AS (SELECT k, marker, count(*) AS n FROM {_E.format(t='panel')} WHERE marker IS NOT NULL GROUP BY ALL), t AS (SELECT k, marker, count(*) AS n FROM {_E.format(t='panel_copy')} WHERE marker IS NOT NULL GROUP BY ALL) SELECT coalesce(s.k, t.k) AS panel, CAST(sum(least(coalesce(s.n, 0), coalesce(t.n, 0))) AS BIGINT) AS matched, CAST(sum(greatest(coalesce(s.n, 0) - coalesce(t.n, 0), 0)) AS BIGINT) AS extra, CAST(sum(greatest(coalesce(t.n, 0) - coalesce(s.n, 0), 0)) AS BIGINT) AS missing FROM s FULL JOIN t ON s.k = t.k AND s.marker = t.marker GROUP BY 1")
def multiset_match(spark, d):
    def side(name, n):
        e = table(spark, d, name).select(F.upper(F.translate("test_case_id", "_", "-")).alias("panel"), F.explode("entries").alias("e")).select("panel", F.lower(F.trim("e.marker")).alias("marker"))
        return e.filter("marker is not null").groupBy("panel", "marker").agg(F.count("*").alias(n))

    j = side("panel", "a").join(side("panel_copy", "b"), ["panel", "marker"], "full_outer").fillna(0)
    return j.groupBy("panel").agg(F.sum(F.least("a", "b")).alias("matched"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("extra"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("missing"))


@query(f"SELECT m1 AS marker_a, m2 AS marker_b, n, CASE WHEN n >= 20 THEN 'coexpressed' WHEN n >= 5 THEN 'known' ELSE 'rare' END AS relation FROM (SELECT a.marker AS m1, b.marker AS m2, count(*) AS n FROM (SELECT DISTINCT k, marker FROM {_E.format(t='panel')} WHERE marker IS NOT NULL) a JOIN (SELECT DISTINCT k, marker FROM {_E.format(t='panel')} WHERE marker IS NOT NULL) b ON a.k = b.k AND a.marker < b.marker GROUP BY ALL)")
def marker_relations(spark, d):
    """Panels in which two markers occur together; a panel's markers are a record's list."""
    e = table(spark, d, "panel").select(F.upper(F.translate("test_case_id", "_", "-")).alias("k"), F.explode("entries").alias("e")).select("k", F.lower(F.trim("e.marker")).alias("m")).filter("m is not null").distinct()
    j = e.withColumnRenamed("m", "marker_a").join(e.withColumnRenamed("m", "marker_b"), "k").filter("marker_a < marker_b")
    return j.groupBy("marker_a", "marker_b").agg(F.count("*").alias("n")).withColumn("relation", F.when(F.col("n") >= 20, "coexpressed").when(F.col("n") >= 5, "known").otherwise("rare"))


@query(f"SELECT id, 'new' AS origin FROM predictions WHERE bootstrap_run = 1 AND parse_success UNION ALL SELECT id, 'old' FROM predictions p WHERE bootstrap_run <> 1 AND parse_success AND NOT EXISTS (SELECT 1 FROM predictions q WHERE q.bootstrap_run = 1 AND q.parse_success AND q.test_case_id = p.test_case_id AND q.model = p.model AND q.context_level = p.context_level)")
def union_of_results(spark, d):
    p = predictions(spark, d).filter("parse_success")
    keys = ["test_case_id", "model", "context_level"]
    first = p.filter("bootstrap_run = 1")
    rest = p.filter("bootstrap_run <> 1").join(first.select(*keys).distinct(), keys, "left_anti")
    return first.select("id", F.lit("new").alias("origin")).unionAll(rest.select("id", F.lit("old").alias("origin")))


_U = "(SELECT test_case_id, model, arg_max({c}, (ts, id)) AS v FROM predictions WHERE {c} IS NOT NULL GROUP BY ALL)"


@query(f"SELECT a.test_case_id, a.model, coalesce(b.v, a.v) AS hierarchy_f1, (b.v IS NOT NULL) AS updated FROM {_U.format(c='hierarchy_f1')} a LEFT JOIN {_U.format(c='hierarchy_recall')} b USING (test_case_id, model)")
def score_update(spark, d):
    last = lambda c: predictions(spark, d).filter(F.col(c).isNotNull()).groupBy("test_case_id", "model").agg(F.max_by(c, F.struct("ts", "id")).alias(c))
    j = last("hierarchy_f1").join(last("hierarchy_recall"), ["test_case_id", "model"], "left")
    return j.select("test_case_id", "model", F.coalesce("hierarchy_recall", "hierarchy_f1").alias("hierarchy_f1"), F.col("hierarchy_recall").isNotNull().alias("updated"))


@query("SELECT CASE WHEN completed_at IS NULL THEN 'running' WHEN notes IS NULL THEN 'completed' ELSE 'annotated' END AS status, count(*) AS n FROM runs GROUP BY 1")
def status_counts(spark, d):
    status = F.when(F.col("completed_at").isNull(), "running").when(F.col("notes").isNull(), "completed").otherwise("annotated")
    return table(spark, d, "runs").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT run_id, substr(md5(config_json), 1, 8) AS config_hash, substr(sha256(run_id || '|' || coalesce(git_commit, '')), 1, 12) AS provenance FROM runs")
def config_hashes(spark, d):
    return table(spark, d, "runs").select("run_id", F.substring(F.md5("config_json"), 1, 8).alias("config_hash"), F.substring(F.sha2(F.concat_ws("|", "run_id", F.coalesce("git_commit", F.lit(""))), 256), 1, 12).alias("provenance"))


@query("SELECT run_id, count(*) AS processed, count(*) FILTER (WHERE error_type IS NOT NULL OR NOT parse_success) AS failed, round(count(*) FILTER (WHERE error_type IS NOT NULL OR NOT parse_success) / count(*), 6) AS failure_rate, round(avg(latency_ms) / 1000 * greatest(200 - count(*), 0), 6) AS eta_seconds, (count(*) >= 10 AND count(*) FILTER (WHERE error_type IS NOT NULL OR NOT parse_success) / count(*) > 0.2) AS tripped FROM predictions GROUP BY run_id")
def run_monitor(spark, d):
    failed = F.count_if(F.col("error_type").isNotNull() | ~F.col("parse_success"))
    n = F.count("*")
    return predictions(spark, d).groupBy("run_id").agg(n.alias("processed"), failed.alias("failed"), r6(failed / n).alias("failure_rate"), r6(F.avg("latency_ms") / 1000 * F.greatest(200 - n, F.lit(0))).alias("eta_seconds"), ((n >= 10) & (failed / n > 0.2)).alias("tripped"))


@query("SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '\\b(?i:cd)\\d+[a-zA-Z]{0,2}\\b'), lambda x: upper(x)))) AS markers FROM documents")
def marker_mentions(spark, d):
    found = F.regexp_extract_all(X.text_of(F.col("text")), F.lit(r"\b(?i:cd)\d+[a-zA-Z]{0,2}\b"), 0)
    return table(spark, d, "documents").select("doc_id", F.array_sort(F.array_distinct(F.transform(found, F.upper))).alias("markers"))


@query("WITH m AS (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '\\b(?i:cd)\\d+[a-zA-Z]{0,2}\\b'), lambda x: upper(x)))) AS marker FROM documents) SELECT doc_id, count(*) AS n_mentioned, count(*) FILTER (WHERE l.u IS NULL) AS n_unlisted, round(count(*) FILTER (WHERE l.u IS NULL) / count(*), 6) AS unlisted_rate FROM m LEFT JOIN (SELECT DISTINCT upper(marker) AS u FROM marker_list) l ON marker = l.u GROUP BY doc_id")
def unlisted_mentions(spark, d):
    m = marker_mentions(spark, d).select("doc_id", F.explode("markers").alias("marker"))
    j = m.join(table(spark, d, "marker_list").select(F.upper("marker").alias("u")).distinct(), F.col("marker") == F.col("u"), "left")
    miss = F.count_if(F.col("u").isNull())
    return j.groupBy("doc_id").agg(F.count("*").alias("n_mentioned"), miss.alias("n_unlisted"), r6(miss / F.count("*")).alias("unlisted_rate"))


@query("SELECT DISTINCT typical_lineage AS name, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(typical_lineage, ''))), '\\s*\\([^)]*\\)', '', 'g'), '\\bpositive\\b', '+', 'g'), '\\bnegative\\b', '-', 'g'), '\\bcells?\\b', '', 'g'), '\\s*([+-])', '\\1', 'g'), '[_\\s]+', ' ', 'g')) AS normal FROM marker_list")
def gate_names(spark, d):
    return table(spark, d, "marker_list").select(F.col("typical_lineage").alias("name"), X.gate_name(F.col("typical_lineage")).alias("normal")).distinct()


@query("WITH a AS (SELECT test_case_id AS k, arg_min(raw_response, id) AS g FROM predictions WHERE parse_success GROUP BY 1) SELECT id, (a.g = raw_response) AS same, CASE WHEN raw_response IS NULL THEN 'none' WHEN contains(raw_response, '```') THEN 'fenced' WHEN contains(raw_response, '{') THEN 'json' WHEN trim(raw_response) = '' THEN 'none' ELSE 'list' END AS shape FROM predictions LEFT JOIN a ON test_case_id = a.k")
def response_shapes(spark, d):
    p = predictions(spark, d)
    first = p.filter("parse_success").groupBy(F.col("test_case_id").alias("k")).agg(F.min_by("raw_response", "id").alias("g"))
    raw = F.col("raw_response")
    shape = F.when(raw.isNull(), "none").when(raw.contains("```"), "fenced").when(raw.contains("{"), "json").when(F.trim(raw) == "", "none").otherwise("list")
    return p.join(first, F.col("test_case_id") == F.col("k"), "left").select("id", (F.col("g") == raw).alias("same"), shape.alias("shape"))


@query("SELECT id, CAST(round(hierarchy_f1 * 100) AS BIGINT) AS score, CASE WHEN hierarchy_f1 IS NULL THEN 'unknown' WHEN round(hierarchy_f1 * 100) <= 30 THEN 'very_low' WHEN round(hierarchy_f1 * 100) <= 50 THEN 'low' WHEN round(hierarchy_f1 * 100) <= 70 THEN 'moderate' WHEN round(hierarchy_f1 * 100) <= 90 THEN 'high' ELSE 'very_high' END AS band, round(hierarchy_f1 * 100) > 50 AS trusted FROM predictions")
def confidence_bands(spark, d):
    score = F.round(F.col("hierarchy_f1") * 100)
    band = F.when(F.col("hierarchy_f1").isNull(), "unknown").otherwise(X.interpretation_band(score))
    return predictions(spark, d).select("id", score.cast("bigint").alias("score"), band.alias("band"), (score > 50).alias("trusted"))


_PAIR = "(SELECT a.id AS a_id, a.hierarchy_precision * 10 AS a1, a.hierarchy_recall * 10 AS a2, b.id AS b_id, b.hierarchy_recall * 10 AS b1, b.hierarchy_precision * 10 AS b2 FROM {r} a JOIN {r} b ON a.test_case_id IS NOT DISTINCT FROM b.test_case_id AND a.model IS NOT DISTINCT FROM b.model AND b.rn = a.rn + 1 AND a.rn % 2 = 1)".format(r="(SELECT *, row_number() OVER (PARTITION BY test_case_id, model ORDER BY id) AS rn FROM predictions WHERE hierarchy_precision IS NOT NULL AND hierarchy_recall IS NOT NULL)")
_WIN = lambda x, y: f"CASE WHEN abs({x} - {y}) < 0.5 THEN 'tie' WHEN {x} > {y} THEN 'a' ELSE 'b' END"


@query(f"SELECT a_id, b_id, round((a1 + a2) / 2, 6) AS score_a, round((b1 + b2) / 2, 6) AS score_b, {_WIN('((a1 + a2) / 2)', '((b1 + b2) / 2)')} AS winner, {_WIN('a1', 'b2')} <> {_WIN('a2', 'b1')} AS order_bias, round(least(1.0, abs((a1 + a2) / 2 - (b1 + b2) / 2) / 10), 6) AS confidence FROM {_PAIR}")
def debiased_comparison(spark, d):
    """All rows of a case and model, two neighbours in order of their ids at a time (a last odd one has no partner)."""
    p = predictions(spark, d).filter("hierarchy_precision is not null and hierarchy_recall is not null")
    rows = p.select("test_case_id", "model", "id", (F.col("hierarchy_precision") * 10).alias("x"), (F.col("hierarchy_recall") * 10).alias("y"))
    w = Window.partitionBy("test_case_id", "model").orderBy("id")
    after = lambda c: F.lead(c).over(w)
    paired = rows.select(F.row_number().over(w).alias("rn"), F.col("id").alias("a_id"), F.col("x").alias("a_x"), F.col("y").alias("a_y"), after("id").alias("b_id"), after("x").alias("b_x"), after("y").alias("b_y"))
    g = paired.filter("rn % 2 = 1 and b_id is not null")
    return G.debiased_pairs(g, ["a_id", "b_id"], F.col("a_x"), F.col("b_x"), F.col("b_y"), F.col("a_y"))


@query("SELECT id, round((3 * round(hierarchy_f1 * 3) + 2 * round(structure_accuracy * 3) + 1 * round(critical_gate_recall * 3)) / (3 * 3 + 2 * 3 + 1 * 3), 6) AS score FROM predictions WHERE hierarchy_f1 IS NOT NULL AND structure_accuracy IS NOT NULL AND critical_gate_recall IS NOT NULL")
def rubric_scores(spark, d):
    rubric = {"hierarchy_f1": (3.0, 3.0), "structure_accuracy": (2.0, 3.0), "critical_gate_recall": (1.0, 3.0)}
    p = predictions(spark, d).filter(" and ".join(f"{c} is not null" for c in rubric))
    levels = F.create_map(*(x for c in rubric for x in (F.lit(c), F.round(F.col(c) * 3))))
    return G.rubric_score(p.select("id", levels.alias("scores")), ["id"], "scores", rubric)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def tumbling_window(spark, d):
    return tumbling_stats(table(spark, d, "events"), "1 hour").select("window_start", "event_type", "n", "mean_value")


@query("WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e) SELECT user_id, min(ts) AS session_start, count(*) AS n, round(sum(value), 6) AS total FROM g GROUP BY user_id, k")
def session_windows(spark, d):
    return session_activity(table(spark, d, "events"), "30 minutes").select("user_id", "session_start", "n", "total")


@query("SELECT user_id, count(*) AS n, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END), 6) AS rate, round(stddev_samp(value), 6) AS std, CASE WHEN avg(value) >= 12 THEN 'high' WHEN avg(value) >= 8 THEN 'medium' ELSE 'low' END AS label FROM events GROUP BY user_id")
def user_activity(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), r6(F.avg(F.when(F.col("value") > 10, 1.0).otherwise(0.0))).alias("rate"), r6(F.stddev_samp("value")).alias("std"), ladder(F.avg("value"), [(12, "high"), (8, "medium")], "low").alias("label"))


_STEP = "CASE WHEN i + 1 < 10 OR len(a) < 5 THEN t WHEN len(list_filter(a, lambda x: x.ok)) / len(a) < 0.8 THEN least(0.99::DOUBLE, t + 0.05::DOUBLE) ELSE greatest(0.01::DOUBLE, t - 0.05::DOUBLE / 2) END"


@query(f"WITH RECURSIVE u AS (SELECT user_id, list({{'c': value / 100, 'ok': event_type <> 'error'}} ORDER BY ts, event_id) AS o FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL AND event_type IS NOT NULL GROUP BY 1), s AS (SELECT user_id, o, 0 AS i, 0.5::DOUBLE AS t FROM u UNION ALL SELECT user_id, o, i + 1, {_STEP} FROM (SELECT *, list_filter(o[greatest(1, i - 48):i + 1], lambda x: x.c >= t) AS a FROM s WHERE i < len(o))) SELECT user_id, len(o) AS n, round(t, 6) AS threshold FROM s WHERE i = len(o)")
def adaptive_threshold(spark, d):
    """Threshold per user after all events in order (see streaming.stateful for the stream)."""
    from evalspan.streaming.stateful import adaptive_thresholds

    e = table(spark, d, "events").select("user_id", "event_id", "ts", (F.col("value") / 100).alias("confidence"), (F.col("event_type") != "error").alias("correct"))
    return adaptive_thresholds(e, "user_id", ["ts", "event_id"])


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY ALL")
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 4).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("sum_disc_price"), r6(F.avg("l_discount")).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT n_name, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def orders_by_nation(spark, d):
    small = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    j = table(spark, d, "orders").join(small, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT p_brand, p_name, p_retailprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3")
def top_parts(spark, d):
    return O.top_k(table(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 3).select("p_brand", "p_name", "p_retailprice", "rank")


@query("SELECT model, ts_day, n, CAST(sum(n) OVER (PARTITION BY model ORDER BY ts_day) AS BIGINT) AS n_so_far, round(CASE WHEN lag(n) OVER (PARTITION BY model ORDER BY ts_day) > 0 THEN n / lag(n) OVER (PARTITION BY model ORDER BY ts_day) ELSE 0 END, 6) AS growth FROM (SELECT model, strftime(ts, '%Y-%m-%d') AS ts_day, count(*) AS n FROM predictions WHERE ts IS NOT NULL GROUP BY ALL)")
def daily_progress(spark, d):
    w = Window.partitionBy("model").orderBy("ts_day")
    g = predictions(spark, d).filter("ts is not null").groupBy("model", F.date_format("ts", "yyyy-MM-dd").alias("ts_day")).agg(F.count("*").alias("n"))
    return g.select("model", "ts_day", "n", F.sum("n").over(w).alias("n_so_far"), r6(ratio(F.col("n"), F.lag("n").over(w))).alias("growth"))
