"""Join, order, calibration and frontier queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspan.functions.columns import r6
from evalspan.operators import calibration as C
from evalspan.operators import joins as J
from evalspan.operators import ordered as O
from evalspan.operators import pareto as R
from evalspan.plans.aggregate_queries import CONTEXTS, MODELS, P, predictions
from evalspan.session import cut_lineage
from evalspan.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


KEYS = ("test_case_id", "context_level", "prompt_strategy", "reference_mode", "bootstrap_run")
_BEST = f"(SELECT {', '.join(KEYS)}, model, max(hierarchy_f1) AS f1 FROM predictions WHERE parse_success GROUP BY ALL)"


@query(f"SELECT {', '.join('a.' + k for k in KEYS)}, a.f1 AS f1_a, b.f1 AS f1_b, round(a.f1 - b.f1, 6) AS delta FROM {_BEST} a JOIN {_BEST} b USING ({', '.join(KEYS)}) WHERE a.model = '{MODELS[0]}' AND b.model = '{MODELS[1]}'")
def compare_models(spark, d):
    once = predictions(spark, d).filter("parse_success").groupBy(*KEYS, "model").agg(F.max("hierarchy_f1").alias("f1"))
    return J.compare_pairs(once, KEYS, "model", *MODELS, "f1")


@query("SELECT id, test_case_id, difficulty, (t.k IS NOT NULL) AS found FROM predictions p LEFT JOIN (SELECT test_case_id AS k, difficulty FROM test_cases) t ON p.test_case_id = t.k")
def case_lookup(spark, d):
    return J.lookup(predictions(spark, d).select("id", "test_case_id"), "test_case_id", table(spark, d, "test_cases"), "test_case_id", ["difficulty"])


@query("SELECT p.id, r.run_id FROM predictions p JOIN runs r USING (run_id) WHERE r.completed_at IS NOT NULL")
def completed_run_rows(spark, d):
    done = table(spark, d, "runs").filter("completed_at is not null").select("run_id")
    return predictions(spark, d).join(done, "run_id", "left_semi").select("id", "run_id")


@query("SELECT 'kept' AS part, count(*) AS n FROM predictions WHERE test_case_id IN (SELECT test_case_id FROM test_cases WHERE omip_id IS NOT NULL) UNION ALL SELECT 'dropped', count(*) FROM predictions WHERE test_case_id NOT IN (SELECT test_case_id FROM test_cases WHERE omip_id IS NOT NULL)")
def semi_anti_split(spark, d):
    known = table(spark, d, "test_cases").filter("omip_id is not null").select("test_case_id")
    p = predictions(spark, d)
    part = lambda how, name: p.join(known, "test_case_id", how).agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return part("left_semi", "kept").unionAll(part("left_anti", "dropped"))


_ENTRIES = "(SELECT test_case_id, e.ord AS ord, e.marker AS marker, e.fluorophore AS fluorophore FROM (SELECT test_case_id, unnest(entries) AS e FROM staging_panel))"


def entries(spark, d):
    return table(spark, d, "staging_panel").select("test_case_id", F.inline("entries")).select("test_case_id", "ord", "marker", "fluorophore")


@query(f"SELECT test_case_id, ord, marker, CASE WHEN x.m IS NOT NULL THEN x.location ELSE y.location END AS location, CASE WHEN x.m IS NOT NULL THEN 'exact' WHEN y.m IS NOT NULL THEN 'folded' ELSE 'none' END AS via FROM {_ENTRIES} e LEFT JOIN (SELECT marker AS m, location FROM marker_list) x ON e.marker = x.m LEFT JOIN (SELECT lower(marker) AS m, arg_min(location, marker) AS location FROM marker_list GROUP BY 1) y ON lower(e.marker) = y.m")
def fallback_lookup(spark, d):
    return J.fallback_lookup(entries(spark, d).select("test_case_id", "ord", "marker"), "marker", table(spark, d, "marker_list"), "marker", "location")


@query(f"SELECT test_case_id, ord, marker, coalesce(n.k, a.c, f.c) AS resolved, CASE WHEN n.k IS NOT NULL THEN 'name' WHEN a.c IS NOT NULL THEN 'alias' WHEN f.c IS NOT NULL THEN 'folded' ELSE 'none' END AS via FROM {_ENTRIES} e LEFT JOIN (SELECT DISTINCT marker AS k FROM marker_list) n ON e.marker = n.k LEFT JOIN (SELECT lower(synonym) AS k, arg_min(canonical, synonym) AS c FROM synonyms GROUP BY 1) a ON lower(e.marker) = a.k LEFT JOIN (SELECT lower(marker) AS k, min(marker) AS c FROM marker_list GROUP BY 1) f ON lower(e.marker) = f.k")
def alias_lookup(spark, d):
    return J.alias_lookup(entries(spark, d).select("test_case_id", "ord", "marker"), "marker", table(spark, d, "marker_list"), "marker", table(spark, d, "synonyms"), "synonym", "canonical")


@query(f"SELECT coalesce(a.model, b.model) AS model, coalesce(a.n, 0) AS n_minimal, coalesce(b.n, 0) AS n_rich FROM (SELECT model, count(*) AS n FROM predictions WHERE context_level = 'minimal' AND error_type = 'timeout' GROUP BY 1) a FULL JOIN (SELECT model, count(*) AS n FROM predictions WHERE context_level = 'rich' GROUP BY 1) b ON a.model = b.model")
def key_union(spark, d):
    p = predictions(spark, d)
    a = p.filter("context_level = 'minimal' and error_type = 'timeout'").groupBy("model").agg(F.count("*").alias("n_minimal"))
    b = p.filter("context_level = 'rich'").groupBy("model").agg(F.count("*").alias("n_rich"))
    return a.join(b, "model", "full_outer").fillna(0)


@query("SELECT t.test_case_id, m.model, c.context_level, s.prompt_strategy FROM (SELECT DISTINCT test_case_id FROM test_cases) t, (SELECT DISTINCT model FROM predictions) m, (SELECT DISTINCT context_level FROM predictions) c, (SELECT DISTINCT prompt_strategy FROM predictions) s WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.test_case_id = t.test_case_id AND p.model = m.model AND p.context_level = c.context_level AND p.prompt_strategy = s.prompt_strategy AND p.error_type IS NULL)")
def missing_keys(spark, d):
    p = predictions(spark, d)
    dims = [p.select(c).distinct() for c in ("model", "context_level", "prompt_strategy")]
    return J.missing_keys([table(spark, d, "test_cases").select("test_case_id").distinct(), *dims], p.filter("error_type is null"))


@query("SELECT m.model, c.context_level, s.prompt_strategy, r.reference_mode FROM (SELECT DISTINCT model FROM predictions) m, (SELECT DISTINCT context_level FROM predictions) c, (SELECT DISTINCT prompt_strategy FROM predictions) s, (SELECT DISTINCT reference_mode FROM predictions) r")
def condition_grid(spark, d):
    p = predictions(spark, d)
    grid = p.select("model").distinct()
    for c in ("context_level", "prompt_strategy", "reference_mode"):
        grid = grid.crossJoin(p.select(c).distinct())
    return grid


_LAST = "(SELECT test_case_id, model, arg_max(hierarchy_f1, (ts, id)) AS f1 FROM predictions WHERE run_id {op} (SELECT max(run_id) FROM predictions) AND hierarchy_f1 IS NOT NULL GROUP BY ALL)"


@query(f"SELECT coalesce(n.test_case_id, o.test_case_id) AS test_case_id, coalesce(n.model, o.model) AS model, coalesce(n.f1, o.f1) AS f1, CASE WHEN n.f1 IS NULL THEN 'old' ELSE 'new' END AS origin FROM {_LAST.format(op='<>')} o FULL JOIN {_LAST.format(op='=')} n ON o.test_case_id IS NOT DISTINCT FROM n.test_case_id AND o.model IS NOT DISTINCT FROM n.model")
def override_merge(spark, d):
    p = predictions(spark, d).filter("hierarchy_f1 is not null")
    last = predictions(spark, d).agg(F.max("run_id").alias("last_run"))
    marked = p.crossJoin(F.broadcast(last))  # one row
    once = lambda q: q.groupBy("test_case_id", "model").agg(F.max_by("hierarchy_f1", F.struct("ts", "id")).alias("f1"))
    return J.override_merge(once(marked.filter("run_id <> last_run")), once(marked.filter("run_id = last_run")), ["test_case_id", "model"], ["f1"])


@query("SELECT a.name AS name_a, b.name AS name_b, round(abs(a.em_max - b.em_max), 6) AS distance, abs(a.em_max - b.em_max) <= 20 AS close FROM fluorophore a JOIN fluorophore b ON a.name < b.name WHERE a.em_max IS NOT NULL AND b.em_max IS NOT NULL")
def dye_pairs(spark, d):
    gap = F.abs(F.col("em_max_a") - F.col("em_max_b"))
    return J.unordered_pairs(table(spark, d, "fluorophore").filter("em_max is not null"), "name", ["em_max"]).select("name_a", "name_b", r6(gap).alias("distance"), (gap <= 20).alias("close"))


DETECTORS = [(f"D{c}", c - 15.0, c + 15.0) for c in range(420, 841, 30)]


@query("SELECT name, detector, round((least(f.em_range.hi, t.r_hi) - greatest(f.em_range.lo, t.r_lo)) / (f.em_range.hi - f.em_range.lo), 6) AS fraction FROM fluorophore f, (VALUES " + ", ".join(f"('{n}', {a}, {b})" for n, a, b in DETECTORS) + ") t(detector, r_lo, r_hi) WHERE f.em_range.lo < f.em_range.hi AND greatest(f.em_range.lo, t.r_lo) < least(f.em_range.hi, t.r_hi)")
def detector_overlap(spark, d):
    dyes = table(spark, d, "fluorophore").select("name", F.col("em_range.lo").alias("lo"), F.col("em_range.hi").alias("hi"))
    return J.interval_overlap(dyes, spark.createDataFrame(DETECTORS, "detector string, r_lo double, r_hi double"), "lo", "hi", 25.0).select("name", "detector", "fraction")


@query("WITH o AS (SELECT name, detector, round((least(f.em_range.hi, t.r_hi) - greatest(f.em_range.lo, t.r_lo)) / (f.em_range.hi - f.em_range.lo), 6) AS fraction FROM fluorophore f, (VALUES " + ", ".join(f"('{n}', {a}, {b})" for n, a, b in DETECTORS) + ") t(detector, r_lo, r_hi) WHERE f.em_range.lo < f.em_range.hi AND greatest(f.em_range.lo, t.r_lo) < least(f.em_range.hi, t.r_hi)) SELECT name, arg_min(detector, (-fraction, detector)) AS detector, max(fraction) AS fraction FROM o GROUP BY name")
def best_detector(spark, d):
    return detector_overlap(spark, d).groupBy("name").agg(F.min_by("detector", F.struct(-F.col("fraction"), F.col("detector"))).alias("detector"), F.max("fraction").alias("fraction"))


_SETS = "(SELECT upper(replace(test_case_id, '_', '-')) AS k, list_distinct(flatten(list(list_transform(list_filter(entries, lambda e: e.marker IS NOT NULL), lambda e: trim(e.marker))))) AS s FROM {t} GROUP BY 1)"


@query(f"SELECT a.k AS test_case_id, len(list_intersect(a.s, b.s)) AS n_common, len(list_distinct(list_concat(a.s, b.s))) AS n_union, round(CASE WHEN len(list_distinct(list_concat(a.s, b.s))) = 0 THEN 1.0 ELSE len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) END, 6) AS jaccard, round(CASE WHEN len(a.s) + len(b.s) = 0 THEN 0.0 ELSE 2 * len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s)) END, 6) AS f1 FROM {_SETS.format(t='panel')} a JOIN {_SETS.format(t='panel_copy')} b USING (k)")
def set_overlap(spark, d):
    def side(name, s):
        e = table(spark, d, name).select(F.upper(F.translate("test_case_id", "_", "-")).alias("test_case_id"), F.filter(F.transform("entries", lambda x: F.trim(x["marker"])), lambda m: m.isNotNull()).alias("m"))
        return e.groupBy("test_case_id").agg(F.array_distinct(F.flatten(F.collect_set("m"))).alias(s))

    j = side("panel", "a").join(side("panel_copy", "b"), "test_case_id")
    common, union = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    total = F.size("a") + F.size("b")
    return j.select("test_case_id", common.alias("n_common"), union.alias("n_union"), r6(F.when(union == 0, 1.0).otherwise(common / union)).alias("jaccard"), r6(F.when(total == 0, 0.0).otherwise(2 * common / total)).alias("f1"))


_PC = "(SELECT upper(replace(test_case_id, '_', '-')) AS k, list_sort(list_distinct(list_transform(list_filter(first(entries ORDER BY revision DESC, updated_at DESC), lambda e: e.marker IS NOT NULL), lambda e: lower(trim(e.marker))))) AS s FROM {t} GROUP BY 1)"


@query(f"WITH p AS {_PC.format(t='panel')}, u AS (SELECT k, unnest(s) AS x, len(s) AS n FROM p), h AS (SELECT c.k AS child, c.n AS cn, q.k AS parent, q.n AS pn, count(*) AS m FROM u c JOIN u q ON c.x = q.x AND c.k <> q.k AND q.n < c.n GROUP BY ALL), b AS (SELECT child, arg_min(parent, (-pn, parent)) AS parent FROM h WHERE m = pn GROUP BY child) SELECT p.k AS child, b.parent FROM p LEFT JOIN b ON p.k = b.child")
def marker_set_parents(spark, d):
    p = table(spark, d, "panel").groupBy(F.upper(F.translate("test_case_id", "_", "-")).alias("child")).agg(F.max_by("entries", F.struct("revision", "updated_at")).alias("e"))
    sets = p.select("child", F.array_distinct(F.transform(F.filter("e", lambda x: x["marker"].isNotNull()), lambda x: F.lower(F.trim(x["marker"])))).alias("elements"))
    sets = cut_lineage(sets)
    return J.most_specific_container(sets, sets.withColumnRenamed("child", "parent"))


@query(f"SELECT DISTINCT e.v AS typed, m.marker FROM (SELECT DISTINCT lower(trim(marker, ' ')) AS v FROM {_ENTRIES}) e JOIN (SELECT DISTINCT lower(marker) AS marker FROM marker_list) m ON (contains(e.v, m.marker) OR contains(m.marker, e.v)) WHERE e.v <> ''")
def substring_match(spark, d):
    typed = entries(spark, d).select(F.lower(F.trim("marker")).alias("typed")).distinct()
    return J.gram_contains(typed, "typed", table(spark, d, "marker_list").select(F.lower("marker").alias("marker")), "marker")


_DIM = "run_id, test_case_id, model, context_level, prompt_strategy, reference_mode, bootstrap_run"


@query(f"SELECT id, {_DIM}, hierarchy_f1 FROM (SELECT *, row_number() OVER (PARTITION BY {_DIM} ORDER BY ts, id) AS rn FROM predictions) WHERE rn = 1")
def dedupe_first(spark, d):
    p = predictions(spark, d).select("id", "ts", *_DIM.split(", "), "hierarchy_f1")
    return O.pick(p, _DIM.split(", "), [F.col("ts"), F.col("id")]).drop("ts")


@query(f"SELECT id, {_DIM}, hierarchy_f1 FROM (SELECT *, row_number() OVER (PARTITION BY {_DIM} ORDER BY ts DESC, id DESC) AS rn FROM predictions) WHERE rn = 1")
def upsert_last(spark, d):
    p = predictions(spark, d).select("id", "ts", *_DIM.split(", "), "hierarchy_f1")
    newest = [-F.unix_micros(F.col("ts").cast("timestamp")), -F.col("id")]
    return O.pick(p, _DIM.split(", "), newest).drop("ts")


_CONF = "(SELECT critical_gate_recall AS conf, CAST(hierarchy_f1 >= 0.3 AS DOUBLE) AS hit, model FROM predictions WHERE critical_gate_recall IS NOT NULL AND hierarchy_f1 IS NOT NULL)"


def confidences(spark, d, keys=()):
    return C.usable(predictions(spark, d), "critical_gate_recall", F.col("hierarchy_f1") >= 0.3, keys)


@query(f"WITH s AS (SELECT conf, sum(hit) AS h, count(*) AS n FROM {_CONF} GROUP BY conf), c AS (SELECT conf, n, sum(h) OVER w / sum(n) OVER w AS a FROM s WINDOW w AS (ORDER BY conf)) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(abs(conf - a) * n) / sum(n), 6) AS static_error FROM c")
def running_accuracy(spark, d):
    return O.running_accuracy_error(confidences(spark, d), "conf", "hit")


_PV = "(SELECT model || '|' || context_level AS test, model, least(1.0, 2 * exp(-0.5 * pow(abs(avg(hierarchy_f1) - 0.3) * sqrt(count(hierarchy_f1)) / stddev_samp(hierarchy_f1) / 5, 2))) AS p FROM predictions GROUP BY model, context_level)"


@query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p, test) - 1 AS i, count(*) OVER (PARTITION BY model) AS n FROM {_PV}), a AS (SELECT model, test, p, least(1.0, p * n) AS bonferroni, max(least(1.0, p * (n - i))) OVER (PARTITION BY model ORDER BY i) AS holm, least(1.0, min(p * n / (i + 1)) OVER (PARTITION BY model ORDER BY i DESC)) AS bh FROM r) SELECT model, test, round(p, 6) AS p, round(bonferroni, 6) AS bonferroni, round(holm, 6) AS holm, round(bh, 6) AS bh, bh < 0.05 AS bh_significant FROM a")
def p_value_corrections(spark, d):
    f1 = F.col("hierarchy_f1")
    z = F.abs(F.avg(f1) - 0.3) * F.sqrt(F.count(f1)) / F.stddev_samp(f1) / 5
    tests = predictions(spark, d).groupBy("model", "context_level").agg(F.least(F.lit(1.0), 2 * F.exp(-0.5 * F.pow(z, F.lit(2.0)))).alias("p")).withColumn("test", F.concat_ws("|", "model", "context_level"))
    return O.corrections(tests.drop("context_level"), "test", "p", ["model"])


@query("WITH r AS (SELECT model, tokens_used AS x, latency_ms AS y, row_number() OVER (PARTITION BY model ORDER BY tokens_used, latency_ms) AS i, count(*) OVER (PARTITION BY model) AS n FROM predictions WHERE tokens_used IS NOT NULL AND latency_ms IS NOT NULL) SELECT model, count(*) AS n, round(pow(corr(x, y), 2), 6) AS r2 FROM r WHERE i > floor(n * 0.05) AND i <= n - floor(n * 0.05) GROUP BY model")
def trimmed_correlation(spark, d):
    return O.trimmed_correlation(predictions(spark, d), ["model"], "tokens_used", "latency_ms", 0.05)


@query("SELECT optimal_laser, name, relative_brightness, rank FROM (SELECT *, row_number() OVER (PARTITION BY optimal_laser ORDER BY relative_brightness DESC NULLS LAST, name) AS rank FROM fluorophore) WHERE rank <= 3")
def brightest_per_laser(spark, d):
    return O.top_k(table(spark, d, "fluorophore"), ["optimal_laser"], [F.desc_nulls_last("relative_brightness"), F.col("name")], 3).select("optimal_laser", "name", "relative_brightness", "rank")


@query(f"WITH e AS (SELECT marker, count(*) AS n FROM {_ENTRIES} WHERE marker IS NOT NULL GROUP BY 1) SELECT marker, n FROM e ORDER BY n DESC, marker LIMIT 10")
def most_common_markers(spark, d):
    return entries(spark, d).filter("marker is not null").groupBy("marker").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "marker").limit(10)


@query("SELECT test_case_id, arg_max(condition, (round(f1, 6), condition)) AS best_condition, round(max(f1), 6) AS best_f1 FROM (SELECT test_case_id, condition, hierarchy_f1 AS f1 FROM " + P + ") WHERE f1 IS NOT NULL GROUP BY 1")
def best_by_confidence(spark, d):
    p = predictions(spark, d).filter("hierarchy_f1 is not null")
    return p.groupBy("test_case_id").agg(F.max_by("condition", F.struct(r6(F.col("hierarchy_f1")), F.col("condition"))).alias("best_condition"), r6(F.max("hierarchy_f1")).alias("best_f1"))


_BINS = f"(SELECT model, CAST(least(floor(conf * 10), 9) AS INT) AS bin, count(*) AS n, avg(conf) AS mean_conf, avg(hit) AS accuracy FROM {_CONF} GROUP BY ALL)"


@query(f"SELECT model, bin, n, round(mean_conf, 6) AS mean_conf, round(accuracy, 6) AS accuracy FROM {_BINS}")
def reliability_table(spark, d):
    t = C.bins(confidences(spark, d, ["model"]), C.uniform_bin(10), ["model"])
    return t.select("model", "bin", "n", r6(F.col("mean_conf")).alias("mean_conf"), r6(F.col("accuracy")).alias("accuracy"))


_ERR = "CAST(sum(n) AS BIGINT) AS n, round(sum(abs(accuracy - mean_conf) * n) / sum(n), 6) AS ece, round(max(abs(accuracy - mean_conf)), 6) AS mce, round(avg(abs(accuracy - mean_conf)), 6) AS ace, round(avg(CAST(mean_conf > accuracy AS DOUBLE)), 6) AS over_rate, round(avg(CAST(mean_conf < accuracy AS DOUBLE)), 6) AS under_rate"


@query(f"SELECT model, {_ERR} FROM {_BINS} GROUP BY model")
def calibration_errors(spark, d):
    return C.calibration_errors(C.bins(confidences(spark, d, ["model"]), C.uniform_bin(10), ["model"]), ["model"])


@query(f"WITH e AS (SELECT quantile_cont(conf, [{', '.join(str(i / 10) for i in range(1, 10))}]) AS q FROM {_CONF}), b AS (SELECT len(list_filter(q, lambda x: c.conf >= x)) AS bin, count(*) AS n, avg(conf) AS mean_conf, avg(hit) AS accuracy FROM {_CONF} c, e GROUP BY 1) SELECT {_ERR} FROM b")
def calibration_errors_quantile(spark, d):
    rows = confidences(spark, d)
    return C.calibration_errors(C.bins(rows, C.quantile_bin(rows, 10)))


@query(f"WITH b AS (SELECT model, least(floor(conf * 10), 9) AS bin, count(*) AS n, avg(conf) AS f, avg(hit) AS o, sum(pow(conf - hit, 2)) AS sq FROM {_CONF} GROUP BY ALL), t AS (SELECT model, sum(n) AS t, sum(o * n) / sum(n) AS base FROM b GROUP BY 1) SELECT model, round(sum(sq) / max(t), 6) AS brier, round(sum(n * pow(f - o, 2)) / max(t), 6) AS reliability, round(sum(n * pow(o - base, 2)) / max(t), 6) AS resolution, round(max(base * (1 - base)), 6) AS uncertainty FROM b JOIN t USING (model) GROUP BY model")
def brier_score(spark, d):
    return C.brier(confidences(spark, d, ["model"]), ["model"])


@query(f"WITH g AS (SELECT 0 AS i, 1.0::DOUBLE AS t UNION ALL SELECT i + 1, 0.1::DOUBLE + 4.9::DOUBLE * i / 49 FROM range(50) r(i)), c AS (SELECT i, t, hit, 1 / (1 + exp(-ln(k / (1 - k)) / t)) AS c FROM (SELECT hit, least(greatest(conf, 1e-7), 1 - 1e-7) AS k FROM {_CONF}), g), b AS (SELECT i, t, least(floor(c * 10), 9) AS bin, count(*) AS n, sum(hit) AS h, sum(c) AS s FROM c GROUP BY ALL), e AS (SELECT i, t, sum(abs(h - s)) / sum(n) AS ece FROM b GROUP BY ALL) SELECT round(arg_min(t, (round(ece, 6), i)), 6) AS temperature, round(min(ece), 6) AS ece FROM e")
def temperature_scaling(spark, d):
    return C.best_temperature(confidences(spark, d))


_CURVE = f"(SELECT model, i / 99.0::DOUBLE AS threshold, count(*) FILTER (WHERE conf >= i / 99.0::DOUBLE) AS attempted, count(*) AS n, coalesce(sum(hit) FILTER (WHERE conf >= i / 99.0::DOUBLE), 0) AS hits FROM {_CONF}, range(100) r(i) GROUP BY ALL)"


@query(f"SELECT model, round(threshold, 6) AS threshold, round(attempted / n, 6) AS coverage, round(CASE WHEN attempted > 0 THEN hits / attempted ELSE 0 END, 6) AS accuracy, round(CASE WHEN attempted > 0 THEN 1 - hits / attempted ELSE 1 END, 6) AS risk, round(1 - hits / n, 6) AS overall_risk FROM {_CURVE}")
def selective_curve(spark, d):
    c = C.curve(confidences(spark, d, ["model"]), 100, ["model"])
    return c.select("model", *(r6(F.col(x)).alias(x) for x in ("threshold", "coverage", "accuracy", "risk", "overall_risk")))


@query(f"WITH p AS (SELECT model, attempted / n AS x, CASE WHEN attempted > 0 THEN 1 - hits / attempted ELSE 1 END AS y FROM {_CURVE}), a AS (SELECT model, (y + lag(y) OVER w) / 2 * (x - lag(x) OVER w) AS a FROM p WINDOW w AS (PARTITION BY model ORDER BY x, y)) SELECT model, round(sum(a), 6) AS area FROM a GROUP BY model")
def risk_coverage_area(spark, d):
    return O.trapezoid(C.curve(confidences(spark, d, ["model"]), 100, ["model"]), ["model"], "coverage", "risk")


@query(f"WITH c AS (SELECT model, threshold, attempted / n AS coverage, CASE WHEN attempted > 0 THEN hits / attempted ELSE 0 END AS accuracy FROM {_CURVE} WHERE attempted / n >= 0.5) SELECT model, round(arg_max(threshold, (round(accuracy * coverage, 6), -threshold)), 6) AS threshold, round(arg_max(coverage, (round(accuracy * coverage, 6), -threshold)), 6) AS coverage, round(arg_max(accuracy, (round(accuracy * coverage, 6), -threshold)), 6) AS accuracy FROM c GROUP BY model")
def threshold_optimum(spark, d):
    return C.best_threshold(C.curve(confidences(spark, d, ["model"]), 100, ["model"]), F.col("accuracy") * F.col("coverage"), 0.5, ["model"])


@query(f"WITH c AS (SELECT model, threshold, attempted / n AS coverage, (attempted - hits) * 1.0 + (n - attempted) * 0.5 AS cost, n FROM {_CURVE}) SELECT model, round(arg_min(threshold, (round(cost, 6), threshold)), 6) AS threshold, round(arg_min(coverage, (round(cost, 6), threshold)), 6) AS coverage, round(arg_min(cost / n, (round(cost, 6), threshold)), 6) AS expected_cost FROM c GROUP BY model")
def cost_threshold(spark, d):
    return C.cheapest_threshold(C.curve(confidences(spark, d, ["model"]), 100, ["model"]), 1.0, 0.5, ["model"])


_POINTS = f"(SELECT model || '/' || condition AS name, round(avg(hierarchy_f1), 6) AS gain, round(avg(tokens_used), 6) AS cost, round(avg(latency_ms), 6) AS latency FROM {P} GROUP BY 1)"


def points(spark, d):
    p = predictions(spark, d).withColumn("name", F.concat_ws("/", "model", "condition"))
    return p.groupBy("name").agg(r6(F.avg("hierarchy_f1")).alias("gain"), r6(F.avg("tokens_used")).alias("cost"), r6(F.avg("latency_ms")).alias("latency"))


_FRONT = f"(SELECT * FROM {_POINTS} a WHERE NOT EXISTS (SELECT 1 FROM {_POINTS} b WHERE b.gain >= a.gain AND b.cost <= a.cost AND (b.gain > a.gain OR b.cost < a.cost)))"


@query(f"SELECT name, gain, cost, latency FROM {_FRONT}")
def pareto_frontier(spark, d):
    return R.frontier(points(spark, d), {"gain": True, "cost": False})


@query(f"SELECT name, gain, cost, latency FROM {_POINTS} a WHERE NOT EXISTS (SELECT 1 FROM {_POINTS} b WHERE b.gain >= a.gain AND b.cost <= a.cost AND b.latency <= a.latency AND (b.gain > a.gain OR b.cost < a.cost OR b.latency < a.latency))")
def pareto_three_objectives(spark, d):
    return R.frontier(points(spark, d), {"gain": True, "cost": False, "latency": False})


@query(f"SELECT round(coalesce(sum(abs((gain - nx) * cost)), 0), 6) AS hypervolume, count(*) AS n_points FROM (SELECT gain, cost, lead(gain, 1, 0) OVER (ORDER BY gain DESC, cost DESC) AS nx FROM {_FRONT})")
def hypervolume(spark, d):
    return R.hypervolume(pareto_frontier(spark, d), "gain", "cost")


@query(f"SELECT name, next, round(dg, 6) AS gain, round(dc, 6) AS cost, round(CASE WHEN dc <> 0 THEN dg / dc END, 6) AS gain_per_cost FROM (SELECT name, lead(name) OVER w AS next, lead(gain) OVER w - gain AS dg, lead(cost) OVER w - cost AS dc FROM {_FRONT} WINDOW w AS (ORDER BY cost, name)) WHERE next IS NOT NULL")
def frontier_steps(spark, d):
    return O.step_ratio(pareto_frontier(spark, d), "cost", "gain", "name")


BUDGETS = (500.0, 1000.0, 1500.0, 2000.0, 4000.0)


@query(f"SELECT b AS budget, arg_min(name, (-gain, cost, name)) AS best, arg_min(cost, (-gain, cost, name)) AS cost, max(gain) AS gain FROM {_POINTS}, (VALUES {', '.join(f'({b}::DOUBLE)' for b in BUDGETS)}) t(b) WHERE cost <= b AND gain IS NOT NULL GROUP BY b")
def budget_best(spark, d):
    return R.best_under_budget(points(spark, d).filter("gain is not null"), "name", "cost", "gain", BUDGETS)


@query("SELECT name, round(CASE WHEN cost = 0 THEN 'inf'::DOUBLE ELSE gain / cost END, 6) AS gain_per_cost, round(gain * 0.5 + (1 - least(1.0, cost / 5000)) * 0.5, 6) AS efficiency FROM " + _POINTS.replace("round(avg(hierarchy_f1), 6)", "avg(hierarchy_f1)").replace("round(avg(tokens_used), 6)", "avg(tokens_used)"))
def cost_ratios(spark, d):
    p = predictions(spark, d).groupBy(F.concat_ws("/", "model", "condition").alias("name")).agg(F.avg("hierarchy_f1").alias("gain"), F.avg("tokens_used").alias("cost"))
    return R.cost_ratios(p, "name", F.col("cost"), F.col("gain"), 5000.0)
