"""Aggregate, quantile and pivot queries over the prediction tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspan.functions.columns import r6, share
from evalspan.operators import aggregates as A
from evalspan.sources.tables import table

SCORES = ("hierarchy_f1", "structure_accuracy", "critical_gate_recall")
ALL_SCORES = (*SCORES, "hierarchy_precision", "hierarchy_recall", "hallucination_rate")
MODELS = ("orrery-small", "orrery-large")
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a query (spark, sf_dir) -> DataFrame under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "predictions").withColumn("condition", F.concat_ws("_", "context_level", "prompt_strategy", "reference_mode"))


P = "(SELECT *, concat_ws('_', context_level, prompt_strategy, reference_mode) AS condition FROM predictions)"


@query(
    "SELECT model, count(*) AS n, count(*) FILTER (WHERE parse_success) AS n_success,"
    + ", ".join(f" round(avg({s}) FILTER (WHERE parse_success), 6) AS mean_{s}" for s in SCORES)
    + ", count(*) FILTER (WHERE error_type = 'timeout') AS n_timeout, count(*) FILTER (WHERE error_type IS NOT NULL) AS n_error FROM predictions GROUP BY model"
)
def stats_by_model(spark, d):
    p = predictions(spark, d)
    return A.conditional_stats(p, ["model"], SCORES, F.col("parse_success"), {"timeout": F.col("error_type") == "timeout", "error": F.col("error_type").isNotNull()}).orderBy(F.desc_nulls_last("mean_hierarchy_f1"))


@query("SELECT model, prompt_strategy, round(avg(hierarchy_f1), 6) AS mean_f1, round(avg(structure_accuracy), 6) AS mean_structure, count(*) AS n FROM predictions WHERE parse_success GROUP BY model, prompt_strategy")
def two_key_effect(spark, d):
    return predictions(spark, d).filter("parse_success").groupBy("model", "prompt_strategy").agg(r6(F.avg("hierarchy_f1")).alias("mean_f1"), r6(F.avg("structure_accuracy")).alias("mean_structure"), F.count("*").alias("n"))


@query("SELECT " + ", ".join(f"round(avg({s}) FILTER (WHERE parse_success), 6) AS mean_{s}, round(min({s}) FILTER (WHERE parse_success), 6) AS min_{s}, round(max({s}) FILTER (WHERE parse_success), 6) AS max_{s}" for s in ALL_SCORES) + ", round(avg(CASE WHEN parse_success THEN 1.0 ELSE 0.0 END), 6) AS parse_rate, count(*) AS n FROM predictions")
def score_summary(spark, d):
    ok = F.col("parse_success")
    cols = [c for s in ALL_SCORES for c in (r6(F.avg(F.when(ok, F.col(s)))).alias(f"mean_{s}"), r6(F.min(F.when(ok, F.col(s)))).alias(f"min_{s}"), r6(F.max(F.when(ok, F.col(s)))).alias(f"max_{s}"))]
    return predictions(spark, d).agg(*cols, r6(share(ok)).alias("parse_rate"), F.count("*").alias("n"))


_STATS = "count(hierarchy_f1) AS n, round(avg(hierarchy_f1), 6) AS mean, round(coalesce(stddev_samp(hierarchy_f1), 0), 6) AS std, round(min(hierarchy_f1), 6) AS min, round(max(hierarchy_f1), 6) AS max"


@query(f"SELECT CASE grouping_id(model, condition) WHEN 3 THEN 'overall' WHEN 1 THEN 'model' ELSE 'condition' END AS level, model, condition, {_STATS} FROM {P} GROUP BY GROUPING SETS ((), (model), (condition))")
def grouping_sets_stats(spark, d):
    return A.grouping_set_stats(predictions(spark, d), [(), ("model",), ("condition",)], A.stat_block("hierarchy_f1"))


@query(f"SELECT condition, metric, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM (UNPIVOT (SELECT condition, {', '.join(ALL_SCORES)} FROM {P} WHERE parse_success) ON {', '.join(ALL_SCORES)} INTO NAME metric VALUE value) GROUP BY condition, metric")
def metric_by_condition(spark, d):
    return A.unpivot_scores(predictions(spark, d).filter("parse_success"), ["condition"], ALL_SCORES).groupBy("condition", "metric").agg(*A.stat_block("value"))


@query(f"SELECT model, first(condition ORDER BY m DESC, condition) AS best, round(max(m), 6) AS best_mean FROM (SELECT model, condition, round(avg(hierarchy_f1), 6) AS m FROM {P} GROUP BY ALL) WHERE m IS NOT NULL GROUP BY model")
def best_condition(spark, d):
    return A.best_group(predictions(spark, d).filter("hierarchy_f1 is not null"), ["model"], "condition", "hierarchy_f1")


@query(f"SELECT metric, first(run_id ORDER BY m DESC, run_id) AS best, round(max(m), 6) AS best_mean FROM (SELECT metric, run_id, round(avg(value), 6) AS m FROM (UNPIVOT (SELECT run_id, {', '.join(ALL_SCORES)} FROM predictions) ON {', '.join(ALL_SCORES)} INTO NAME metric VALUE value) GROUP BY ALL) GROUP BY metric")
def run_comparison(spark, d):
    return A.best_group(A.unpivot_scores(predictions(spark, d), ["run_id"], ALL_SCORES), ["metric"], "run_id", "value")


@query("SELECT model, round(avg(CASE WHEN parse_success THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(avg(hierarchy_f1), 6) AS mean_where_given, round(avg(coalesce(hierarchy_f1, 0)), 6) AS mean_missing_as_0 FROM predictions GROUP BY model")
def success_rates(spark, d):
    f1 = F.col("hierarchy_f1")
    return predictions(spark, d).groupBy("model").agg(r6(share(F.col("parse_success"))).alias("success_rate"), r6(F.avg(f1)).alias("mean_where_given"), r6(F.avg(F.coalesce(f1, F.lit(0.0)))).alias("mean_missing_as_0"))


@query("SELECT model, reference_mode, round(avg(hierarchy_f1), 6) AS mean, round(coalesce(stddev_samp(hierarchy_f1), 0), 6) AS std, count(DISTINCT test_case_id) AS n_cases, sum(tokens_used) AS tokens, round(sum(latency_ms) / 1000, 6) AS seconds FROM predictions WHERE hierarchy_f1 IS NOT NULL GROUP BY model, reference_mode")
def benchmark_metrics(spark, d):
    scored = predictions(spark, d).filter("hierarchy_f1 is not null")
    return scored.groupBy("model", "reference_mode").agg(*A.stat_block("hierarchy_f1")[1:3], F.countDistinct("test_case_id").alias("n_cases"), F.sum("tokens_used").alias("tokens"), r6(F.sum("latency_ms") / 1000).alias("seconds"))


_EXCLUSIVE = "CASE WHEN n >= 4 THEN v[{j}] + (v[{j} + 1] - v[{j}]) * ((n + 1) * {q} - {j}) ELSE {small} END"


def _exclusive(q: float, small: str) -> str:
    return _EXCLUSIVE.format(j=f"CAST(least(greatest(floor((n + 1) * {q}), 1), n - 1) AS BIGINT)", q=q, small=small)


@query(f"WITH g AS (SELECT model, list_sort(list(hierarchy_f1) FILTER (WHERE hierarchy_f1 IS NOT NULL)) AS v FROM predictions GROUP BY model), h AS (SELECT model, v, len(v) AS n FROM g WHERE len(v) > 0) SELECT model, n, round({_exclusive(0.25, 'v[1]')}, 6) AS q25, round({_exclusive(0.5, 'list_median(v)')}, 6) AS median, round({_exclusive(0.75, 'v[n]')}, 6) AS q75 FROM h")
def describe_exclusive_quantiles(spark, d):
    return A.exclusive_quantiles(predictions(spark, d), ["model"], "hierarchy_f1")


@query("SELECT model, n, round(m, 6) AS mean, round(coalesce(s, 0), 6) AS std, round(q[1], 6) AS q25, round(q[2], 6) AS median, round(q[3], 6) AS q75, round(coalesce(s, 0) / sqrt(n), 6) AS se, round(m - z * coalesce(s, 0) / sqrt(n), 6) AS ci_low, round(m + z * coalesce(s, 0) / sqrt(n), 6) AS ci_high FROM (SELECT model, count(hierarchy_f1) AS n, avg(hierarchy_f1) AS m, stddev_samp(hierarchy_f1) AS s, quantile_cont(hierarchy_f1, [0.25, 0.5, 0.75]) AS q, (SELECT t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t) FROM (SELECT sqrt(-2 * ln(0.025::DOUBLE)) AS t)) AS z FROM predictions GROUP BY model)")
def describe_linear(spark, d):
    return A.linear_quantiles(predictions(spark, d), ["model"], "hierarchy_f1")


@query("SELECT model, len(v) AS n, round(sp, 6) AS std_pop, round(v[CAST(floor(len(v) / 2) AS BIGINT) + 1], 6) AS upper_median FROM (SELECT model, stddev_pop(hierarchy_f1) AS sp, list_sort(list(hierarchy_f1) FILTER (WHERE hierarchy_f1 IS NOT NULL)) AS v FROM predictions GROUP BY model)")
def upper_median(spark, d):
    return A.upper_median(predictions(spark, d), ["model"], "hierarchy_f1")


@query("SELECT test_cases.difficulty, p.model, round(avg(hierarchy_f1), 6) AS mean, round(stddev_samp(hierarchy_f1), 6) AS std FROM predictions p JOIN test_cases USING (test_case_id) GROUP BY ALL")
def mean_std_by_difficulty(spark, d):
    cases = table(spark, d, "test_cases").select("test_case_id", "difficulty")
    return predictions(spark, d).join(cases, "test_case_id").groupBy("difficulty", "model").agg(r6(F.avg("hierarchy_f1")).alias("mean"), r6(F.stddev_samp("hierarchy_f1")).alias("std"))


@query("WITH m AS (SELECT reference_mode, avg(hierarchy_f1) AS m FROM predictions GROUP BY 1), o AS (SELECT max(m) FILTER (WHERE reference_mode = 'none') AS t, max(m) FILTER (WHERE reference_mode <> 'none') AS b FROM m) SELECT round(t, 6) AS tested_mean, round(b, 6) AS best_other_mean, round((t - b) / b, 6) AS lift, abs((t - b) / b) > 0.10 AS significant FROM o")
def lift_vs_best(spark, d):
    return A.lift_over(predictions(spark, d), "reference_mode", "hierarchy_f1", "none")


@query("WITH m AS (SELECT reference_mode, avg(hallucination_rate) AS m FROM predictions GROUP BY 1), o AS (SELECT max(m) FILTER (WHERE reference_mode = 'none') AS t, min(m) FILTER (WHERE reference_mode <> 'none') AS b FROM m) SELECT round(t, 6) AS tested_mean, round(b, 6) AS best_other_mean, round((b - t) / b, 6) AS lift, abs((b - t) / b) > 0.10 AS significant FROM o")
def lift_vs_lowest(spark, d):
    return A.lift_over(predictions(spark, d), "reference_mode", "hallucination_rate", "none", higher_is_better=False)


@query("WITH m AS (SELECT model, context_level, avg(hierarchy_f1) AS m FROM predictions GROUP BY ALL) SELECT a.model, a.context_level, round(a.m, 6) AS mean, round((a.m - b.m) / b.m * 100, 6) AS improvement FROM m a JOIN m b ON a.model IS NOT DISTINCT FROM b.model AND b.context_level = 'minimal' WHERE a.context_level <> 'minimal' AND b.m > 0")
def baseline_improvement(spark, d):
    return A.baseline_improvement(predictions(spark, d), "model", "context_level", "hierarchy_f1", "minimal")


@query("SELECT first(bootstrap_run ORDER BY m, bootstrap_run) AS best_run, round(min(m), 6) AS best_mean, first(m ORDER BY bootstrap_run) > last(m ORDER BY bootstrap_run) AS falls FROM (SELECT bootstrap_run, avg(hallucination_rate) AS m FROM predictions GROUP BY 1) WHERE m IS NOT NULL")
def weight_curve(spark, d):
    m = predictions(spark, d).groupBy("bootstrap_run").agg(F.avg("hallucination_rate").alias("m")).filter("m is not null")
    return m.agg(F.min_by("bootstrap_run", F.struct("m", "bootstrap_run")).alias("best_run"), r6(F.min("m")).alias("best_mean"), (F.min_by("m", "bootstrap_run") > F.max_by("m", "bootstrap_run")).alias("falls"))


_LABELS = {"parse_failure": "NOT parse_success", "low_f1": "parse_success AND hierarchy_f1 < 0.3", "hallucination": "parse_success AND hallucination_rate > 0.1", "missed_critical": "parse_success AND critical_gate_recall < 0.8", "bad_structure": "parse_success AND structure_accuracy < 0.1"}
_LABEL_SQL = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _LABELS.items()) + "], lambda x: x IS NOT NULL)"


def _labels():
    return {n: F.expr(c) for n, c in _LABELS.items()}


@query(f"SELECT CASE grouping_id(model, condition) WHEN 3 THEN 'overall' WHEN 1 THEN 'model' ELSE 'condition' END AS level, model, condition, label, count(*) AS n, count(DISTINCT id) AS n_rows FROM (SELECT id, model, condition, unnest({_LABEL_SQL}) AS label FROM {P}) GROUP BY GROUPING SETS ((label), (label, model), (label, condition))")
def multilabel_failures(spark, d):
    long = A.multi_label(predictions(spark, d), _labels(), ["id", "model", "condition"])
    parts = long.groupingSets([[F.col("label")], [F.col("label"), F.col("model")], [F.col("label"), F.col("condition")]], "label", "model", "condition")
    level = F.when(F.grouping("model") + F.grouping("condition") == 2, "overall").when(F.grouping("model") == 0, "model").otherwise("condition")
    return parts.agg(level.alias("level"), F.count("*").alias("n"), F.countDistinct("id").alias("n_rows")).select("level", "model", "condition", "label", "n", "n_rows")


@query(f"SELECT condition, combination, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY n DESC, combination) AS rank FROM (SELECT condition, array_to_string(list_sort({_LABEL_SQL}), '+') AS combination, count(*) AS n FROM {P} GROUP BY ALL) WHERE combination <> '') WHERE rank <= 5")
def failure_combinations(spark, d):
    return A.label_combinations(predictions(spark, d), _labels(), ["condition"], 5)


@query("WITH b AS (SELECT CASE WHEN n_gates <= 10 THEN 'easy' WHEN n_gates <= 18 THEN 'medium' ELSE 'hard' END AS b, hierarchy_f1 FROM predictions JOIN test_cases USING (test_case_id)) SELECT position, bucket, coalesce(n, 0) AS n, mean, std FROM (VALUES (0, 'easy'), (1, 'medium'), (2, 'hard'), (3, 'unknown')) t(position, bucket) LEFT JOIN (SELECT b, count(hierarchy_f1) AS n, round(avg(hierarchy_f1), 6) AS mean, round(CASE WHEN count(hierarchy_f1) >= 2 THEN stddev_samp(hierarchy_f1) END, 6) AS std FROM b GROUP BY b) ON bucket = b")
def complexity_breakdown(spark, d):
    cases = table(spark, d, "test_cases").select("test_case_id", "n_gates")
    bucket = F.when(F.col("n_gates") <= 10, "easy").when(F.col("n_gates") <= 18, "medium").otherwise("hard")
    return A.bucket_breakdown(predictions(spark, d).join(cases, "test_case_id"), bucket, ["easy", "medium", "hard", "unknown"], "hierarchy_f1")


ERRORS = ("api_error", "rate_limit", "timeout", "token_limit")


@query("SELECT model, " + ", ".join(f"count(*) FILTER (WHERE error_type = '{e}') AS {e}" for e in ERRORS) + ", round(avg(CASE WHEN error_type IS NOT NULL OR NOT parse_success THEN 1.0 ELSE 0.0 END), 6) AS failure_rate FROM predictions GROUP BY model")
def failure_types(spark, d):
    p = predictions(spark, d)
    return p.groupBy("model").agg(*(F.count_if(F.col("error_type") == e).alias(e) for e in ERRORS), r6(share(F.col("error_type").isNotNull() | ~F.col("parse_success"))).alias("failure_rate"))


@query("SELECT context_level, round(avg(CASE WHEN hierarchy_f1 >= 0.8 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, round(avg(CASE WHEN hierarchy_f1 >= 0.4 AND hierarchy_f1 < 0.8 THEN 1.0 ELSE 0.0 END), 6) AS partial_rate, round(avg(CASE WHEN hierarchy_f1 < 0.4 THEN 1.0 ELSE 0.0 END), 6) AS fail_rate FROM predictions GROUP BY context_level")
def pass_rates(spark, d):
    f1 = F.col("hierarchy_f1")
    return predictions(spark, d).groupBy("context_level").agg(r6(share(f1 >= 0.8)).alias("pass_rate"), r6(share((f1 >= 0.4) & (f1 < 0.8))).alias("partial_rate"), r6(share(f1 < 0.4)).alias("fail_rate"))


_SIDE = "(SELECT DISTINCT upper(replace(test_case_id, '_', '-')) AS k, trim(e.marker) AS marker FROM (SELECT test_case_id, unnest(entries) AS e FROM {t}) WHERE e.marker IS NOT NULL)"


@query(f"SELECT a.marker, count(b.k) AS n_found, count(*) - count(b.k) AS n_missed, round(count(b.k) / count(*), 6) AS detection_rate FROM {_SIDE.format(t='panel')} a LEFT JOIN {_SIDE.format(t='panel_copy')} b ON a.k = b.k AND a.marker = b.marker GROUP BY a.marker")
def detection_counts(spark, d):
    def side(name, m):
        e = table(spark, d, name).select(F.upper(F.translate("test_case_id", "_", "-")).alias("k"), F.explode("entries").alias("e"))
        return e.select("k", F.trim("e.marker").alias("marker")).filter("marker is not null").distinct().withColumn(m, F.lit(1))

    both = side("panel", "x").join(side("panel_copy", "y"), ["k", "marker"], "left")
    return both.groupBy("marker").agg(F.count("y").alias("n_found"), (F.count("*") - F.count("y")).alias("n_missed"), r6(F.count("y") / F.count("*")).alias("detection_rate"))


@query(f"SELECT test_case_id, model, condition, n, parse_rate, n_answers, n_distinct, round(CASE WHEN n_answers = 0 THEN 0.0 WHEN n_answers = 1 THEN 1.0 ELSE 1 - (n_distinct - 1) / (n_answers - 1) END, 6) AS consistency FROM (SELECT test_case_id, model, condition, count(*) AS n, round(avg(CASE WHEN parse_success THEN 1.0 ELSE 0.0 END), 6) AS parse_rate, count(raw_response) AS n_answers, count(DISTINCT raw_response) AS n_distinct FROM {P} GROUP BY ALL)")
def bootstrap_consistency(spark, d):
    return A.consistency(predictions(spark, d), ["test_case_id", "model", "condition"], F.col("raw_response"), F.col("parse_success"))


@query("SELECT CASE WHEN hierarchy_f1 >= 0.7 THEN 'good' WHEN hierarchy_f1 >= 0.4 THEN 'fair' ELSE 'poor' END AS band, lower(trim(w)) AS word, count(*) AS n FROM (SELECT hierarchy_f1, unnest(string_split(error_message, ' ')) AS w FROM predictions WHERE error_message IS NOT NULL) WHERE trim(w) <> '' GROUP BY ALL")
def message_histogram(spark, d):
    f1 = F.col("hierarchy_f1")
    band = F.when(f1 >= 0.7, "good").when(f1 >= 0.4, "fair").otherwise("poor")
    words = predictions(spark, d).filter("error_message is not null").select(band.alias("band"), F.explode(F.split("error_message", " ")).alias("w"))
    return words.filter(F.trim("w") != "").groupBy("band", F.lower(F.trim("w")).alias("word")).agg(F.count("*").alias("n"))


@query("WITH g AS (SELECT test_case_id, model, arg_max(bootstrap_run, (round(hierarchy_f1, 6), -bootstrap_run)) AS best, max(hierarchy_f1) - min(hierarchy_f1) AS delta FROM predictions WHERE hierarchy_f1 IS NOT NULL GROUP BY ALL HAVING count(*) >= 2) SELECT best AS bootstrap_run, count(*) AS n, round(avg(delta), 6) AS mean_delta FROM g GROUP BY best")
def best_run_distribution(spark, d):
    p = predictions(spark, d).filter("hierarchy_f1 is not null")
    best = F.max_by("bootstrap_run", F.struct(r6(F.col("hierarchy_f1")), -F.col("bootstrap_run")))
    g = p.groupBy("test_case_id", "model").agg(F.count("*").alias("n"), best.alias("bootstrap_run"), (F.max("hierarchy_f1") - F.min("hierarchy_f1")).alias("delta")).filter("n >= 2")
    return g.groupBy("bootstrap_run").agg(F.count("*").alias("n"), r6(F.avg("delta")).alias("mean_delta"))


@query("WITH m AS (SELECT test_case_id, prompt_strategy AS v, avg(hierarchy_f1) AS m FROM predictions GROUP BY ALL HAVING m IS NOT NULL), g AS (SELECT test_case_id, count(*) AS n_variants, arg_max(v, (round(m, 6), v)) AS best, arg_min(v, (round(m, 6), v)) AS worst, round(max(m) - min(m), 6) AS r, var_pop(m) AS vp FROM m GROUP BY 1) SELECT test_case_id, n_variants, best, worst, r AS range, round(vp, 6) AS variance, round(least(1.0, 10 * vp), 6) AS sensitivity, CASE WHEN r >= 0.3 THEN 'high' WHEN r >= 0.1 THEN 'medium' ELSE 'low' END AS label FROM g")
def variant_sensitivity(spark, d):
    return A.variant_sensitivity(predictions(spark, d), "test_case_id", "prompt_strategy", "hierarchy_f1")


@query(f"WITH g AS (SELECT avg(hierarchy_f1) FILTER (WHERE model = '{MODELS[0]}') AS a, avg(hierarchy_f1) FILTER (WHERE model = '{MODELS[1]}') AS b, var_pop(hierarchy_f1) FILTER (WHERE model = '{MODELS[0]}') AS va, var_pop(hierarchy_f1) FILTER (WHERE model = '{MODELS[1]}') AS vb FROM predictions), e AS (SELECT *, abs(a - b) / sqrt((va + vb) / 2) AS d FROM g) SELECT round(a, 6) AS mean_a, round(b, 6) AS mean_b, round(d, 6) AS effect, CAST(greatest(10, least(50, CASE WHEN d > 0 THEN ceil(2 * pow((1.96 + 0.84) / d, 2)) ELSE 50 END)) AS BIGINT) AS n_per_group FROM e")
def pilot_power(spark, d):
    return A.pilot_size(predictions(spark, d), "model", "hierarchy_f1", *MODELS)


CONTEXTS = ("minimal", "standard", "rich")


@query("SELECT model, " + ", ".join(f"round(avg(hierarchy_f1) FILTER (WHERE context_level = '{c}'), 6) AS {c}" for c in CONTEXTS) + " FROM predictions GROUP BY model")
def pivot_mean(spark, d):
    return A.pivot_mean(predictions(spark, d), "model", "context_level", "hierarchy_f1", CONTEXTS)


@query("SELECT CASE WHEN grouping(m) = 0 THEN 'model' ELSE 'context_level' END AS level, m AS model, context_level, count(*) AS n, round(avg(hierarchy_f1), 6) AS mean FROM (SELECT *, regexp_extract(model, '[^/]*$') AS m FROM predictions) GROUP BY GROUPING SETS ((m), (context_level))")
def comparison_tables(spark, d):
    short = predictions(spark, d).withColumn("model", F.substring_index("model", "/", -1))
    return A.grouping_set_stats(short, [("model",), ("context_level",)], [F.count("*").alias("n"), r6(F.avg("hierarchy_f1")).alias("mean")])
