"""Diversity, statistics, agreement, spectra, trees and text queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspan.functions import jsontext as T
from evalspan.functions import text as X
from evalspan.functions.columns import pearson, r6, ratio
from evalspan.operators import agreement as G
from evalspan.operators import diversity as D
from evalspan.operators import overlap as V
from evalspan.operators import spectra as S
from evalspan.operators import statistics as ST
from evalspan.operators import trees as TR
from evalspan.plans.aggregate_queries import MODELS, P, predictions
from evalspan.session import spread
from evalspan.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


FEATURES = ("model", "context_level", "prompt_strategy", "reference_mode", "error_type")
_COUNTS = "(" + " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS value, count(*) AS n FROM predictions GROUP BY {f}" for f in FEATURES) + ")"
_DIST = f"(SELECT feature, count(*) AS k, sum(n) AS n, sum(-p * log2(p + 1e-10)) AS h, max(n) / min(n) AS imb FROM (SELECT *, n / sum(n) OVER (PARTITION BY feature) AS p FROM {_COUNTS}) GROUP BY feature)"


@query(f"SELECT feature, k AS n_values, CAST(n AS BIGINT) AS n, round(CASE WHEN k > 1 THEN h / log2(k) ELSE 0 END, 6) AS entropy, round(imb, 6) AS imbalance, (imb < 3 AND CASE WHEN k > 1 THEN h / log2(k) ELSE 0 END > 0.8) AS balanced FROM {_DIST}")
def entropy_distribution(spark, d):
    return D.distribution(predictions(spark, d), FEATURES)


@query(f"SELECT count(*) AS n_features, round(avg(e), 6) AS mean_entropy, round(0.7 * avg(e) + 0.3 * avg(CAST(imb < 3 AND e > 0.8 AS DOUBLE)), 6) AS score FROM (SELECT imb, round(CASE WHEN k > 1 THEN h / log2(k) ELSE 0 END, 6) AS e FROM {_DIST})")
def diversity_report(spark, d):
    return D.diversity_score(predictions(spark, d), FEATURES)


@query("SELECT s.species, f.source_type, t.difficulty, count(c.test_case_id) AS n FROM (SELECT DISTINCT species FROM test_cases WHERE species IS NOT NULL) s CROSS JOIN (SELECT DISTINCT source_type FROM test_cases WHERE source_type IS NOT NULL) f CROSS JOIN (SELECT DISTINCT difficulty FROM test_cases WHERE difficulty IS NOT NULL) t LEFT JOIN test_cases c ON c.species = s.species AND c.source_type = f.source_type AND c.difficulty = t.difficulty GROUP BY ALL")
def cross_coverage(spark, d):
    return D.cross_coverage(table(spark, d, "test_cases"), ["species", "source_type", "difficulty"])


TARGETS = {"easy": 0.3, "medium": 0.4, "hard": 0.2, "expert": 0.1}


@query("WITH c AS (SELECT difficulty AS v, count(*) AS n FROM test_cases GROUP BY 1), j AS (SELECT coalesce(v, t) AS value, coalesce(n, 0) AS n, coalesce(target, 0) AS target FROM c FULL JOIN (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in TARGETS.items()) + ") g(t, target) ON v = t), a AS (SELECT *, n / sum(n) OVER () AS actual, sum(n) OVER () AS total FROM j) SELECT value, n, round(target, 6) AS target, round(actual, 6) AS actual, CAST(floor(total * target) - n AS BIGINT) AS suggested, round(1 - least(1.0, 2 * avg(abs(target - actual)) OVER ()), 6) AS quality FROM a")
def stratification(spark, d):
    return D.stratification(table(spark, d, "test_cases"), "difficulty", TARGETS)


_TOK = "list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')"


@query(f"WITH t AS (SELECT source, length(text) AS len, {_TOK} AS w FROM documents WHERE text IS NOT NULL), v AS (SELECT source, count(DISTINCT x) AS vocabulary FROM (SELECT source, unnest(w) AS x FROM t) GROUP BY 1), b AS (SELECT source, count(*) AS n, round(avg(len), 6) AS mean_length, round(stddev_pop(len), 6) AS std_length, sum(len(w)) AS tokens, round(avg(len(list_distinct(w))), 6) AS mean_unique_words, count(*) - count(DISTINCT array_to_string(list_sort(list_distinct(w)), ' ')) AS copies FROM t GROUP BY 1) SELECT b.source, n, mean_length, std_length, coalesce(vocabulary, 0) AS vocabulary, round(CASE WHEN tokens > 0 THEN vocabulary / tokens ELSE 0 END, 6) AS type_token_ratio, mean_unique_words, round(copies / n, 6) AS duplicate_rate FROM b LEFT JOIN v ON v.source IS NOT DISTINCT FROM b.source")
def content_diversity(spark, d):
    return D.content_diversity(spread(table(spark, d, "documents").select("source", "text")), "text", ["source"])


@query("WITH g AS (SELECT avg(CAST(hierarchy_f1 < 0.3 AS DOUBLE)) AS e, avg(CAST(hierarchy_f1 >= 0.3 AND hierarchy_f1 < 0.7 AS DOUBLE)) AS m, avg(CAST(hierarchy_f1 >= 0.7 AS DOUBLE)) AS h FROM predictions WHERE hierarchy_f1 IS NOT NULL) SELECT round(e, 6) AS easy, round(m, 6) AS medium, round(h, 6) AS hard, round(abs(e - 0.3) + abs(m - 0.4) + abs(h - 0.3), 6) AS deviation, abs(e - 0.3) + abs(m - 0.4) + abs(h - 0.3) < 0.3 AS well_distributed FROM g")
def difficulty_shares(spark, d):
    return D.difficulty_shares(predictions(spark, d), "hierarchy_f1")


@query("WITH g AS (SELECT context_level, count(hierarchy_f1) FILTER (WHERE model = '{a}') AS n_a, avg(hierarchy_f1) FILTER (WHERE model = '{a}') AS ma, var_samp(hierarchy_f1) FILTER (WHERE model = '{a}') AS va, count(hierarchy_f1) FILTER (WHERE model = '{b}') AS n_b, avg(hierarchy_f1) FILTER (WHERE model = '{b}') AS mb, var_samp(hierarchy_f1) FILTER (WHERE model = '{b}') AS vb FROM predictions GROUP BY 1), e AS (SELECT *, (ma - mb) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)) AS d FROM g), s AS (SELECT *, sqrt((n_a + n_b) / (n_a * n_b) + d * d / (2 * (n_a + n_b))) AS se, (SELECT t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t) FROM (SELECT sqrt(-2 * ln(0.025::DOUBLE)) AS t)) AS z FROM e) SELECT context_level, n_a, n_b, round(d, 6) AS cohens_d, round(d - z * se, 6) AS d_low, round(d + z * se, 6) AS d_high, CASE WHEN abs(d) >= 0.8 THEN 'large' WHEN abs(d) >= 0.5 THEN 'medium' WHEN abs(d) >= 0.2 THEN 'small' ELSE 'negligible' END AS label, round(d * (1 - 3 / (4 * (n_a + n_b - 2) - 1)), 6) AS hedges_g, round((ma - mb) / sqrt(vb), 6) AS glass_delta FROM s".format(a=MODELS[0], b=MODELS[1]))
def effect_sizes(spark, d):
    return ST.effect_sizes(predictions(spark, d), ["context_level"], "model", *MODELS, "hierarchy_f1")


@query("WITH r AS (SELECT context_level, model, hierarchy_f1 AS v FROM predictions WHERE hierarchy_f1 IS NOT NULL AND model IN ('{a}', '{b}')), g AS (SELECT x.context_level, sum(sign(x.v - y.v)) AS s, count(*) AS c FROM r x JOIN r y ON x.context_level = y.context_level WHERE x.model = '{a}' AND y.model = '{b}' GROUP BY 1), n AS (SELECT context_level, count(*) FILTER (WHERE model = '{a}') AS n_a, count(*) FILTER (WHERE model = '{b}') AS n_b FROM r GROUP BY 1) SELECT context_level, n_a, n_b, round(s / c, 6) AS delta, CASE WHEN abs(s / c) >= 0.474 THEN 'large' WHEN abs(s / c) >= 0.33 THEN 'medium' WHEN abs(s / c) >= 0.147 THEN 'small' ELSE 'negligible' END AS label FROM g JOIN n USING (context_level)".format(a=MODELS[0], b=MODELS[1]))
def cliff_delta(spark, d):
    return ST.cliff_delta(predictions(spark, d), ["context_level"], "model", *MODELS, "hierarchy_f1")


@query("WITH r AS (SELECT model, tokens_used AS x, latency_ms AS y, rank() OVER wx + (count(*) OVER (PARTITION BY model, tokens_used) - 1) / 2 AS rx, rank() OVER wy + (count(*) OVER (PARTITION BY model, latency_ms) - 1) / 2 AS ry FROM predictions WHERE tokens_used IS NOT NULL AND latency_ms IS NOT NULL WINDOW wx AS (PARTITION BY model ORDER BY tokens_used), wy AS (PARTITION BY model ORDER BY latency_ms)) SELECT model, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM r GROUP BY model")
def correlation_regression(spark, d):
    return ST.correlation(predictions(spark, d), ["model"], "tokens_used", "latency_ms")


_CASES = f"(SELECT model, condition AS name, avg(hierarchy_precision) AS x, avg(hierarchy_recall) AS y FROM {P} GROUP BY ALL)"


def case_points(spark, d):
    return predictions(spark, d).groupBy("model", F.col("condition").alias("name")).agg(F.avg("hierarchy_precision").alias("x"), F.avg("hierarchy_recall").alias("y"))


@query(f"WITH p AS {_CASES}, s AS (SELECT model, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x*x) AS sxx, sum(y*y) AS syy, sum(x*y) AS sxy FROM p GROUP BY model HAVING count(*) > 3), j AS (SELECT *, sxx - sx*sx/n AS vx, syy - sy*sy/n AS vy, sxy - sx*sy/n AS cov, n-1 AS m, sx-x AS ax, sy-y AS ay, sxx-x*x AS axx, syy-y*y AS ayy, sxy-x*y AS axy FROM p JOIN s USING (model)), k AS (SELECT *, y - sy/n - cov/vx*(x - sx/n) AS e, (vy - cov/vx*cov)/(n-2) AS mse, 1/n + (x - sx/n)*(x - sx/n)/vx AS h, cov*cov/(vx*vy) AS r2, (axy - ax*ay/m)*(axy - ax*ay/m)/((axx - ax*ax/m)*(ayy - ay*ay/m)) AS r2w FROM j) SELECT model, name, round(e*e/(2*mse)*h/((1-h)*(1-h)), 6) AS cook, round(r2 - r2w, 6) AS delta_r2 FROM k")
def influence(spark, d):
    return ST.influence(case_points(spark, d), ["model"], "name", "x", "y")


@query("WITH r AS (SELECT * FROM predictions WHERE latency_ms IS NOT NULL), m AS (SELECT model, median(latency_ms) AS mid, quantile_cont(latency_ms, [0.25, 0.75]) AS q FROM r GROUP BY 1), d AS (SELECT model, 1.4826 * median(abs(latency_ms - mid)) AS mad FROM r JOIN m USING (model) GROUP BY 1) SELECT r.model, r.id, r.latency_ms FROM r JOIN m USING (model) JOIN d USING (model) WHERE CASE WHEN mad > 0 THEN abs(latency_ms - mid) / mad > 2.5 ELSE latency_ms < q[1] - 1.5 * (q[2] - q[1]) OR latency_ms > q[2] + 1.5 * (q[2] - q[1]) END")
def outlier_rows(spark, d):
    return ST.outliers(predictions(spark, d), ["model"], "id", "latency_ms").withColumn("latency_ms", F.col("latency_ms").cast("bigint"))


def _passk(k: int) -> tuple[str, str]:
    prod = lambda top: " * ".join(f"(greatest({top} - {i}, 0) / (n - {i}))" for i in range(k))
    return (f"round(CASE WHEN c = 0 THEN 0.0 WHEN c >= n THEN 1.0 WHEN n < {k} THEN 1 - pow(1 - c / n, {k}) ELSE 1 - {prod('(n - c)')} END, 6) AS pass_at_{k}", f"round(CASE WHEN c >= n THEN 1.0 WHEN n < {k} THEN pow(c / n, {k}) WHEN c < {k} THEN 0.0 ELSE {prod('c')} END, 6) AS pass_all_{k}")


KS = (1, 2, 3, 5)
_PASS = "(SELECT test_case_id, model, n, c, " + ", ".join(x for k in KS for x in _passk(k)) + " FROM (SELECT test_case_id, model, count(*) AS n, count(*) FILTER (WHERE hierarchy_f1 >= 0.3) AS c FROM predictions WHERE hierarchy_f1 IS NOT NULL GROUP BY ALL))"


@query(f"SELECT * FROM {_PASS}")
def pass_at_k(spark, d):
    return ST.pass_at_k(predictions(spark, d), ["test_case_id", "model"], F.col("hierarchy_f1") >= 0.3, KS)


@query(f"SELECT model, count(*) AS n_cases, " + ", ".join(f"round(avg(pass_at_{k}), 6) AS mean_{k}, round(stddev_pop(pass_at_{k}), 6) AS std_{k}" for k in KS) + f" FROM {_PASS} GROUP BY model")
def macro_pass_at_k(spark, d):
    return pass_at_k(spark, d).groupBy("model").agg(F.count("*").alias("n_cases"), *(c for k in KS for c in (r6(F.avg(f"pass_at_{k}")).alias(f"mean_{k}"), r6(F.stddev_pop(f"pass_at_{k}")).alias(f"std_{k}"))))


@query()
def bootstrap_interval(spark, d):
    return ST.bootstrap_mean(predictions(spark, d), ["model"], "id", "hierarchy_f1")


@query()
def paired_permutation(spark, d):
    once = predictions(spark, d).filter("hierarchy_f1 is not null").groupBy("test_case_id", "context_level").pivot("model", list(MODELS)).agg(F.avg("hierarchy_f1"))
    pairs = once.select("context_level", F.xxhash64("test_case_id").alias("row_id"), (F.col(f"`{MODELS[0]}`") - F.col(f"`{MODELS[1]}`")).alias("delta"))
    return ST.sign_permutation(pairs, ["context_level"], "row_id", "delta")


RATED = ("hierarchy_f1", "hierarchy_precision", "hierarchy_recall")
_R = "(UNPIVOT (SELECT id, " + ", ".join(f"{c} * 10 AS {c}" for c in RATED) + " FROM predictions) ON " + ", ".join(RATED) + " INTO NAME rater VALUE score)"


def ratings(spark, d):
    p = predictions(spark, d).select("id", *((F.col(c) * 10).alias(c) for c in RATED))
    return p.unpivot("id", list(RATED), "rater", "score").filter("score is not null")


@query(f"WITH v AS (SELECT id, round_even(score, 0) AS v, count(*) AS c, min(score) AS lo, max(score) AS hi FROM {_R} GROUP BY ALL), g AS (SELECT id, sum(c) AS n, max(c) AS top, max(hi) - min(lo) AS r FROM v GROUP BY id) SELECT count(*) AS n_items, round(avg(CAST(r < 0.5 AS DOUBLE)), 6) AS exact_rate, round(avg(CAST(top > n / 2 AS DOUBLE)), 6) AS majority_rate FROM g")
def judge_majority(spark, d):
    return G.agreement_rates(ratings(spark, d), "id", "score")


@query(f"WITH j AS (SELECT a.rater AS rater_a, b.rater AS rater_b, a.score AS sa, b.score AS sb, round_even(a.score, 0) AS ca, round_even(b.score, 0) AS cb FROM {_R} a JOIN {_R} b ON a.id = b.id AND a.rater < b.rater), m AS (SELECT rater_a, rater_b, count(*) AS n, avg(CAST(ca = cb AS DOUBLE)) AS po, corr(sa, sb) AS r, avg(abs(sa - sb)) AS mae, avg(sa - sb) AS bias FROM j GROUP BY ALL), l AS (SELECT rater_a, rater_b, ca AS k, count(*) AS na FROM j GROUP BY ALL), r AS (SELECT rater_a, rater_b, cb AS k, count(*) AS nb FROM j GROUP BY ALL), e AS (SELECT rater_a, rater_b, sum(na * nb) AS e FROM l JOIN r USING (rater_a, rater_b, k) GROUP BY ALL) SELECT rater_a, rater_b, n, round(CASE WHEN e / (n * n) = 1 THEN 1.0 ELSE (po - e / (n * n)) / (1 - e / (n * n)) END, 6) AS kappa, round(r, 6) AS pearson, round(mae, 6) AS mae, round(bias, 6) AS bias, (round(r, 6) > 0.7 AND round(mae, 6) < 0.15) AS calibrated FROM m JOIN e USING (rater_a, rater_b)")
def rater_pairs(spark, d):
    return G.rater_pairs(ratings(spark, d), "id", "rater", "score")


@query(f"WITH c AS (SELECT id, round_even(score / 3, 0) AS k, count(*) AS c FROM {_R} GROUP BY ALL), i AS (SELECT id, sum(c) AS r, sum(c * c) AS sq FROM c GROUP BY id), m AS (SELECT arg_max(r, (n, r)) AS rr FROM (SELECT r, count(*) AS n FROM i WHERE r > 1 GROUP BY r)), k AS (SELECT i.* FROM i JOIN m ON r = rr), p AS (SELECT count(*) AS n_items, max(r) AS raters, avg((sq - r) / (r * (r - 1))) AS p FROM k), e AS (SELECT sum(s * s) / pow(sum(s), 2) AS e FROM (SELECT c.k, sum(c.c) AS s FROM c JOIN k USING (id) GROUP BY c.k)) SELECT n_items, CAST(raters AS BIGINT) AS raters, round((p - e) / (1 - e), 6) AS kappa FROM p, e")
def fleiss_kappa(spark, d):
    return G.fleiss_kappa(ratings(spark, d), "id", F.bround(F.col("score") / 3))


@query(f"WITH s AS (SELECT id, score / 10 AS s FROM {_R}), v AS (SELECT id, round(s, 1) AS v, count(*) AS c FROM s GROUP BY ALL), m AS (SELECT id, arg_min(v, (-c, v)) AS mode FROM v GROUP BY id) SELECT id, round(avg(s), 6) AS mean, round(median(s), 6) AS median, round(stddev_pop(s), 6) AS std, any_value(mode) AS mode, CASE WHEN round(stddev_pop(s), 6) < 0.1 THEN 'high' WHEN round(stddev_pop(s), 6) < 0.2 THEN 'medium' ELSE 'low' END AS agreement FROM s JOIN m USING (id) GROUP BY id")
def judge_ensemble(spark, d):
    return G.ensemble(ratings(spark, d).withColumn("score", F.col("score") / 10), "id", "score")


@query("WITH s AS (SELECT test_case_id, context_level AS v, avg(hierarchy_f1) AS s FROM predictions GROUP BY ALL HAVING s IS NOT NULL), j AS (SELECT a.v, a.s, b.s - a.s AS dr FROM s a JOIN s b ON a.test_case_id = b.test_case_id AND b.v = 'standard' WHERE a.v <> 'standard'), g AS (SELECT v, count(*) AS n, avg(s) AS m, avg(dr) AS dr, avg(CAST(abs(dr) < 0.1 AS DOUBLE)) AS c FROM j GROUP BY v) SELECT v AS context_level, n, round(m, 6) AS mean, round(dr, 6) AS mean_drop, round(c, 6) AS consistency, round(0.5 * (1 - dr) + 0.5 * c, 6) AS robustness, CASE WHEN round(0.5 * (1 - dr) + 0.5 * c, 6) >= 0.9 THEN 'A' WHEN round(0.5 * (1 - dr) + 0.5 * c, 6) >= 0.8 THEN 'B' WHEN round(0.5 * (1 - dr) + 0.5 * c, 6) >= 0.7 THEN 'C' WHEN round(0.5 * (1 - dr) + 0.5 * c, 6) >= 0.6 THEN 'D' ELSE 'F' END AS grade FROM g")
def robustness(spark, d):
    return G.robustness(predictions(spark, d), "test_case_id", "context_level", "hierarchy_f1", "standard")


_EM = "(SELECT name, list_transform(range(500), lambda i: exp(-0.5 * pow(CASE WHEN 350.0 + i * (500.0::DOUBLE / 499) < em_max THEN (350.0 + i * (500.0::DOUBLE / 499) - em_max) / ((em_max - em_range.lo) / 2.5) ELSE (350.0 + i * (500.0::DOUBLE / 499) - em_max) / ((em_range.hi - em_max) / 2) END, 2))) AS s FROM fluorophore WHERE em_max IS NOT NULL AND em_range.lo < em_max AND em_range.hi > em_max)"
_SIM = f"(SELECT a.name AS name_a, b.name AS name_b, round(list_cosine_similarity(a.s, b.s), 6) AS similarity FROM {_EM} a JOIN {_EM} b ON a.name < b.name)"


@query(f"SELECT * FROM {_SIM}")
def spectral_pairs(spark, d):
    return S.spectral_pairs(table(spark, d, "fluorophore"))


@query(f"SELECT CASE WHEN similarity > 0.9 THEN 'critical' WHEN similarity > 0.7 THEN 'high' WHEN similarity > 0.5 THEN 'moderate' ELSE 'low' END AS risk, count(*) AS n, round(avg(similarity), 6) AS mean FROM {_SIM} GROUP BY 1")
def risk_levels(spark, d):
    from evalspan.functions.columns import ladder

    s = spectral_pairs(spark, d)
    return s.groupBy(ladder(F.col("similarity"), [(0.9, "critical"), (0.7, "high"), (0.5, "moderate")], "low", strict=True).alias("risk")).agg(F.count("*").alias("n"), r6(F.avg("similarity")).alias("mean"))


_MEM = "(SELECT DISTINCT upper(replace(test_case_id, '_', '-')) AS panel, trim(e.fluorophore) AS name FROM (SELECT test_case_id, unnest(entries) AS e FROM panel))"


@query(f"WITH m AS (SELECT * FROM {_MEM} WHERE name IS NOT NULL), g AS (SELECT a.panel, count(*) AS n_pairs, sum(similarity) AS sa, sum(CASE WHEN similarity > 0.5 THEN similarity * similarity ELSE 0 END) AS ss, count(*) FILTER (WHERE similarity > 0.9) AS n_critical, count(*) FILTER (WHERE similarity > 0.7) AS n_high, max(similarity) AS mx FROM m a JOIN m b ON a.panel = b.panel JOIN {_SIM} s ON s.name_a = a.name AND s.name_b = b.name GROUP BY 1), z AS (SELECT panel, count(*) AS n FROM m GROUP BY 1) SELECT z.panel, n AS n_colours, coalesce(n_pairs, 0) AS n_pairs, round(coalesce(sa, 0), 6) AS sum_all, round(coalesce(ss, 0), 6) AS sum_squares, round(coalesce(sa, 0) + 5.0 * coalesce(n_critical, 0), 6) AS with_penalty, coalesce(n_critical, 0) AS n_critical, coalesce(n_high, 0) AS n_high, round(coalesce(mx, 0), 6) AS max_similarity, CASE WHEN mx > 0.9 THEN 'avoid' WHEN mx > 0.75 THEN 'caution' WHEN mx > 0.6 THEN 'acceptable' ELSE 'good' END AS quality FROM z LEFT JOIN g USING (panel)")
def panel_complexity(spark, d):
    m = table(spark, d, "panel").select(F.upper(F.translate("test_case_id", "_", "-")).alias("panel"), F.explode("entries").alias("e"))
    return S.panel_complexity(m.select("panel", F.trim("e.fluorophore").alias("name")).filter("name is not null"), spectral_pairs(spark, d))


@query(f"WITH b AS (SELECT name_a, name_b, similarity FROM {_SIM} UNION ALL SELECT name_b, name_a, similarity FROM {_SIM}), s AS (SELECT name, coalesce(relative_brightness, 50.0) AS si FROM fluorophore) SELECT name_a, name_b, round(sqrt(similarity * similarity * i.si) * CASE WHEN j.si > 0 THEN sqrt(i.si / j.si) ELSE 1 END, 6) AS spread FROM b JOIN s i ON name_a = i.name JOIN s j ON name_b = j.name")
def spreading(spark, d):
    si = table(spark, d, "fluorophore").select("name", F.coalesce("relative_brightness", F.lit(50.0)).alias("si"))
    return S.spreading(spectral_pairs(spark, d), si)


EXISTING = ["Alexine 488", "PE"]


@query(f"WITH b AS (SELECT name_a, name_b, similarity FROM {_SIM} UNION ALL SELECT name_b, name_a, similarity FROM {_SIM}), w AS (SELECT name_a AS name, max(similarity) AS m FROM b WHERE name_b IN ('{EXISTING[0]}', '{EXISTING[1]}') GROUP BY 1) SELECT name, round(coalesce(m, 0), 6) AS max_similarity, round((1 - coalesce(m, 0)) * coalesce(relative_brightness, 0) / 100 * CASE WHEN optimal_laser = 405 THEN 1.0 ELSE 0.5 END, 6) AS score FROM fluorophore LEFT JOIN w USING (name) WHERE name NOT IN ('{EXISTING[0]}', '{EXISTING[1]}') ORDER BY score DESC, name LIMIT 5")
def substitute_dyes(spark, d):
    return S.substitutes(table(spark, d, "fluorophore"), spectral_pairs(spark, d), EXISTING, 405, 5)


@query("WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0) SELECT query_id, vec_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= 5")
def cosine_neighbours(spark, d):
    v = table(spark, d, "embeddings")
    return S.cosine_neighbours(v, v.filter("vec_id % 50 = 0"))


_NODES = "(SELECT r_regionkey AS tree, 'r' || r_regionkey AS node, NULL AS parent, r_name AS name, 0 AS depth FROM region UNION ALL SELECT n_regionkey, 'n' || n_nationkey, 'r' || n_regionkey, n_name, 1 FROM nation UNION ALL SELECT n_regionkey, 's' || s_suppkey, 'n' || s_nationkey, s_name, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def geography(spark, d):
    """Regions, nations and suppliers as trees."""
    id_of = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("tree"), id_of("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"), F.lit(0).alias("depth"))
    nations = table(spark, d, "nation")
    n = nations.select(F.col("n_regionkey").alias("tree"), id_of("n", "n_nationkey").alias("node"), id_of("r", "n_regionkey").alias("parent"), F.col("n_name").alias("name"), F.lit(1).alias("depth"))
    s = table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("tree"), id_of("s", "s_suppkey").alias("node"), id_of("n", "s_nationkey").alias("parent"), F.col("s_name").alias("name"), F.lit(2).alias("depth"))
    return r.unionAll(n).unionAll(s)


@query(f"WITH n AS {_NODES}, c AS (SELECT tree AS t, parent AS p, count(*) AS c FROM n WHERE parent IS NOT NULL GROUP BY ALL) SELECT tree, max(depth) AS max_depth, count(*) AS n_nodes, count(DISTINCT name) AS n_names, count(*) FILTER (WHERE c IS NULL) AS n_leaves, round(coalesce(avg(c), 0), 6) AS branching FROM n LEFT JOIN c ON tree = t AND node = p GROUP BY tree")
def tree_stats(spark, d):
    return TR.tree_stats(geography(spark, d), "tree")


@query(f"WITH RECURSIVE n AS {_NODES}, a AS (SELECT tree, node, parent AS ancestor, 1 AS distance FROM n WHERE parent IS NOT NULL UNION ALL SELECT a.tree, a.node, n.parent, a.distance + 1 FROM a JOIN n ON a.tree = n.tree AND a.ancestor = n.node WHERE n.parent IS NOT NULL) SELECT * FROM a")
def tree_ancestors(spark, d):
    return TR.ancestors(geography(spark, d), "tree")


@query(f"WITH RECURSIVE n AS {_NODES}, w AS (SELECT tree, node, name AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.tree, n.node, w.path || ' > ' || n.name FROM w JOIN n ON w.tree = n.tree AND n.parent = w.node) SELECT tree, node, path FROM w WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.tree = w.tree AND n.parent = w.node)")
def tree_paths(spark, d):
    return TR.leaf_paths(geography(spark, d), "tree")


@query(f"WITH n AS {_NODES} SELECT a.tree, a.node, (SELECT count(*) FROM n b WHERE b.tree = a.tree AND b.parent IS NOT DISTINCT FROM a.parent) - 1 AS n_siblings FROM n a")
def tree_siblings(spark, d):
    return TR.siblings(geography(spark, d), "tree")


@query(f"WITH k AS {_NODES}, d AS (SELECT tree, count(*) FILTER (WHERE c > 1) AS duplicate_names FROM (SELECT tree, name, count(*) AS c FROM k GROUP BY ALL) GROUP BY 1) SELECT a.tree, any_value(duplicate_names) AS duplicate_names, count(*) FILTER (WHERE a.parent IS NOT NULL AND b.node IS NULL) AS orphans, count(*) FILTER (WHERE a.parent IS NULL) AS roots FROM k a JOIN d USING (tree) LEFT JOIN k b ON a.tree = b.tree AND a.parent = b.node GROUP BY a.tree")
def tree_validation(spark, d):
    return TR.structural_errors(geography(spark, d), "tree")


_TRUTH, _PRED = f"(SELECT * FROM {_NODES})", f"(SELECT tree, node, parent, CASE WHEN depth = 2 AND name < 'Supplier#000000030' THEN name || 'x' ELSE name END AS name, depth FROM {_NODES})"
_EDGE = "(SELECT a.tree, a.name, b.name AS pn, a.depth FROM {t} a JOIN {t} b ON a.tree = b.tree AND a.parent = b.node)"


@query(f"WITH p AS {_PRED}, q AS {_TRUTH}, pe AS {_EDGE.format(t='p')}, qe AS {_EDGE.format(t='q')}, nj AS (SELECT tree, count(*) FILTER (WHERE a AND b) AS both_, count(a) AS na, count(b) AS nb, count(*) AS any_ FROM (SELECT coalesce(x.tree, y.tree) AS tree, x.a, y.b FROM (SELECT DISTINCT tree, name, true AS a FROM p) x FULL JOIN (SELECT DISTINCT tree, name, true AS b FROM q) y ON x.tree = y.tree AND x.name = y.name) GROUP BY 1), ej AS (SELECT tree, count(*) FILTER (WHERE a AND b) / count(*) AS e FROM (SELECT coalesce(x.tree, y.tree) AS tree, x.a, y.b FROM (SELECT DISTINCT tree, name, pn, true AS a FROM pe) x FULL JOIN (SELECT DISTINCT tree, name, pn, true AS b FROM qe) y ON x.tree = y.tree AND x.name = y.name AND x.pn = y.pn) GROUP BY 1), dj AS (SELECT tree, sum(least(coalesce(ca, 0), coalesce(cb, 0))) / sum(greatest(coalesce(ca, 0), coalesce(cb, 0))) AS d FROM (SELECT coalesce(x.tree, y.tree) AS tree, ca, cb FROM (SELECT tree, depth, count(*) AS ca FROM p GROUP BY ALL) x FULL JOIN (SELECT tree, depth, count(*) AS cb FROM q GROUP BY ALL) y ON x.tree = y.tree AND x.depth = y.depth) GROUP BY 1), aj AS (SELECT t.tree, count(h.tree) / count(*) AS acc FROM qe t LEFT JOIN (SELECT DISTINCT * FROM pe) h ON t.tree = h.tree AND t.name = h.name AND t.pn = h.pn AND t.depth = h.depth GROUP BY 1) SELECT nj.tree, round(2 * both_ / (na + nb), 6) AS name_f1, round(both_ / any_, 6) AS node_jaccard, round(e, 6) AS edge_jaccard, round(d, 6) AS depth_similarity, round(acc, 6) AS structure_accuracy FROM nj JOIN ej USING (tree) JOIN dj USING (tree) JOIN aj USING (tree)")
def structure_accuracy(spark, d):
    truth = geography(spark, d)
    predicted = truth.withColumn("name", F.when((F.col("depth") == 2) & (F.col("name") < "Supplier#000000030"), F.concat("name", F.lit("x"))).otherwise(F.col("name")))
    return TR.compare_structure(predicted, truth, "tree")


@query()
def parsed_responses(spark, d):
    """Format and node table of every answer."""
    return T.parse_responses(predictions(spark, d), "id", "raw_response")


@query("SELECT CASE WHEN raw_response IS NULL OR trim(raw_response) = '' THEN 'empty' ELSE 'text' END AS kind, count(*) AS n, count(*) FILTER (WHERE length(raw_response) - length(replace(raw_response, '{', '')) > length(raw_response) - length(replace(raw_response, '}', ''))) AS n_truncated FROM predictions GROUP BY 1")
def truncated_responses(spark, d):
    raw = F.col("raw_response")
    return predictions(spark, d).groupBy(F.when(F.trim(X.text_of(raw)) == "", "empty").otherwise("text").alias("kind")).agg(F.count("*").alias("n"), F.count_if(X.truncated(raw)).alias("n_truncated"))


@query()
def response_tree_distance(spark, d):
    """Edit distance between the tree of every parsed answer and that of its test case's reference, the first parsed answer."""
    p = predictions(spark, d).filter("parse_success")
    ref = p.groupBy(F.col("test_case_id").alias("k")).agg(F.min_by("raw_response", "id").alias("reference"))
    j = spread(p.select("id", "test_case_id", "raw_response")).join(ref, F.col("test_case_id").eqNullSafe(F.col("k")))
    return TR.answer_distances(j, "id", "raw_response", "reference")


@query()
def optimal_name_match(spark, d):
    """One-to-one matches of the typed markers of a panel and the listed names they share three-letter runs with."""
    e = table(spark, d, "staging_panel").select("test_case_id", F.explode("entries").alias("e")).select("test_case_id", F.lower(F.trim("e.marker")).alias("typed")).filter("typed is not null").distinct()
    gram = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))
    names = table(spark, d, "marker_list").select(F.lower("marker").alias("marker"))
    t = e.select("typed").distinct().withColumn("g", gram(F.col("typed"))).withColumn("n", F.size("g"))
    m = names.withColumn("h", gram(F.col("marker"))).withColumn("k", F.size("h"))
    shared = t.select("typed", "n", F.explode("g").alias("x")).join(m.select("marker", "k", F.explode("h").alias("x")), "x").groupBy("typed", "n", "marker", "k").agg(F.count("*").alias("c"))
    close = shared.select("typed", "marker", (F.col("c") / (F.col("n") + F.col("k") - F.col("c"))).alias("similarity")).filter("similarity >= 0.5")
    return TR.one_to_one(e.join(close, "typed"), ["test_case_id"], "typed", "marker", "similarity", 0.5)


def _hits(patterns) -> str:
    return " + ".join("len(regexp_extract_all(coalesce(text, ''), '(?i)" + p.replace("'", "''") + "'))" for p in patterns)


@query(f"WITH h AS (SELECT doc_id, text, {_hits(X.META_QUESTIONS)} AS m, {_hits(X.REFUSALS)} AS r, {_hits(X.INSTRUCTIONS)} AS i, {_hits(X.GATES)} AS g FROM documents) SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN (g >= 5 AND m + r + i <= 1) OR g >= 10 THEN 'none' WHEN (m >= 2 AND g < 5) OR (m >= 1 AND g < 3) THEN 'meta_questions' WHEN r >= 1 THEN 'refusal' WHEN i >= 2 AND g < 5 THEN 'instructions' ELSE 'none' END AS failure_type FROM documents JOIN h USING (doc_id)".replace("FROM documents JOIN h USING (doc_id)", "FROM h"))
def task_failure(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", X.failure_type(F.col("text")).alias("failure_type"))


@query(f"SELECT doc_id, {_hits([p for p, _ in X.AUTHORITY])} AS n_authority, {_hits(X.BANDWAGON)} AS n_bandwagon FROM documents")
def authority_markers(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.hits(t, [p for p, _ in X.AUTHORITY]).alias("n_authority"), X.hits(t, X.BANDWAGON).alias("n_bandwagon"))


_W = "len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> ''))"


@query(f"SELECT doc_id, {_W} AS n_words, length(coalesce(text, '')) AS n_chars, greatest(len(regexp_extract_all(coalesce(text, ''), '[.!?]+')), 1) AS n_sentences FROM documents")
def verbosity(spark, d):
    return table(spark, d, "documents").select("doc_id", *(c.alias(n) for n, c in X.verbosity(F.col("text")).items()))


_LIST = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
_SW = "list_distinct(string_split_regex(lower(coalesce(text, '')), '\\s+'))"


@query(f"SELECT doc_id, round(CASE WHEN p + n = 0 THEN 0 ELSE (p - n) / (p + n) END, 6) AS sentiment FROM (SELECT doc_id, len(list_intersect({_SW}, {_LIST(X.POSITIVE)})) AS p, len(list_intersect({_SW}, {_LIST(X.NEGATIVE)})) AS n FROM documents)")
def sentiment(spark, d):
    return table(spark, d, "documents").select("doc_id", r6(X.sentiment(F.col("text"))).alias("sentiment"))


@query("SELECT doc_id, round((" + " + ".join(f"CAST(regexp_matches(coalesce(text, ''), '{p}') AS INT)" for p in X.FORMATTING.values()) + ") / 7, 6) AS formatting FROM documents")
def formatting(spark, d):
    return table(spark, d, "documents").select("doc_id", r6(X.formatting(F.col("text"))).alias("formatting"))


@query("SELECT run_id, x AS temperature, b AS n_bootstrap, date_diff('microsecond', started_at, completed_at) / 1e6 AS seconds FROM (SELECT *, CAST(json_extract_string(config_json, '$.temperature') AS DOUBLE) AS x, CAST(json_extract_string(config_json, '$.n_bootstrap') AS BIGINT) AS b FROM runs)")
def run_configs(spark, d):
    field = lambda n, t: F.get_json_object("config_json", f"$.{n}").cast(t)
    micros = F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    return table(spark, d, "runs").select("run_id", field("temperature", "double").alias("temperature"), field("n_bootstrap", "bigint").alias("n_bootstrap"), (micros / 1e6).alias("seconds"))


@query(f"SELECT DISTINCT condition, model, CASE WHEN len(p) >= 3 THEN p[-2] ELSE '' END AS context, CASE WHEN len(p) >= 3 THEN p[-1] ELSE '' END AS strategy FROM (SELECT condition, model, string_split(condition, '_') AS p FROM {P})")
def condition_parts(spark, d):
    c = X.condition_suffix(F.col("condition"))
    return predictions(spark, d).select("condition", "model", c["context"].alias("context"), c["strategy"].alias("strategy")).distinct()


@query("SELECT error_message, CASE WHEN error_message = '' THEN NULL WHEN lower(error_message) LIKE '%rate limit%' OR error_message LIKE '%429%' THEN 'rate_limit' WHEN lower(error_message) LIKE '%token%' AND (lower(error_message) LIKE '%limit%' OR lower(error_message) LIKE '%max%') THEN 'token_limit' WHEN lower(error_message) LIKE '%timeout%' OR lower(error_message) LIKE '%timed out%' THEN 'timeout' ELSE 'api_error' END AS kind, count(*) AS n FROM predictions WHERE error_message IS NOT NULL GROUP BY ALL")
def error_kinds(spark, d):
    return predictions(spark, d).filter("error_message is not null").groupBy("error_message", X.error_kind(F.col("error_message")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT event_type, round(avg(CAST(json_extract_string(props, '$.k') AS BIGINT)), 6) AS mean_k, count(*) AS n FROM events GROUP BY event_type")
def json_props(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(r6(F.avg(F.get_json_object("props", "$.k").cast("bigint"))).alias("mean_k"), F.count("*").alias("n"))


_WT = "list_filter(string_split_regex(lower(coalesce({c}, '')), '\\W+'), lambda w: w <> '')"
_SH = lambda c, n: f"(CASE WHEN len({c}) >= {n} THEN list_distinct(list_transform(range(1, len({c}) - {n} + 2), lambda i: array_to_string(list_slice({c}, i, i + {n - 1}), ' '))) ELSE [] END)"
_JAC = lambda n: f"round(CASE WHEN len(list_distinct(list_concat({_SH('a', n)}, {_SH('b', n)}))) = 0 THEN 0 ELSE len(list_intersect({_SH('a', n)}, {_SH('b', n)})) / len(list_distinct(list_concat({_SH('a', n)}, {_SH('b', n)}))) END, 6)"


@query(f"WITH t AS (SELECT c.id, p.raw_response AS x, c.raw_response AS y, {_WT.format(c='p.raw_response')} AS a, {_WT.format(c='c.raw_response')} AS b FROM predictions c JOIN (SELECT test_case_id AS k, arg_min(raw_response, id) AS raw_response FROM predictions WHERE parse_success GROUP BY 1) p ON c.test_case_id = p.k), o AS (SELECT id, {_JAC(3)} AS overlap_3, {_JAC(4)} AS overlap_4, {_JAC(5)} AS overlap_5, (trim(coalesce(x, ''), ' ') <> '' AND contains(lower(coalesce(y, '')), lower(trim(coalesce(x, ''), ' ')))) AS contained, round(CASE WHEN len(list_distinct(a)) = 0 THEN 0 ELSE len(list_intersect(list_distinct(a), b)) / len(list_distinct(a)) END, 6) AS containment FROM t) SELECT *, contained OR greatest(overlap_3, overlap_4, overlap_5) >= 0.5 AS memorised FROM o")
def memorisation_flags(spark, d):
    p = predictions(spark, d)
    ref = p.filter("parse_success").groupBy(F.col("test_case_id").alias("k")).agg(F.min_by("raw_response", "id").alias("reference"))
    j = spread(p.select("id", "test_case_id", "raw_response")).join(ref, F.col("test_case_id") == F.col("k")).withColumn("containment", r6(V.containment(F.col("reference"), F.col("raw_response"))))
    return V.memorisation(j, ["id", "containment"], F.col("raw_response"), F.col("reference"))


@query("WITH w AS (SELECT list_filter(string_split_regex(lower(text), '\\W+'), lambda w: w <> '') AS a FROM eval_items WHERE text IS NOT NULL), g AS (SELECT unnest(flatten([" + ", ".join(_SH("a", n) for n in (3, 4, 5)) + "])) AS gram FROM w) SELECT gram, count(*) AS n, substr(sha256(gram), 1, 16) AS hash FROM g GROUP BY gram ORDER BY n DESC, gram LIMIT 100")
def fingerprint_top100(spark, d):
    return V.fingerprint(table(spark, d, "eval_items").filter("text is not null"), "text")


@query()
def character_overlap(spark, d):
    p = predictions(spark, d)
    ref = p.filter("parse_success").groupBy(F.col("test_case_id").alias("k")).agg(F.min_by("raw_response", "id").alias("reference"))
    return V.character_overlap(p.join(ref, F.col("test_case_id") == F.col("k")), "id", "raw_response", "reference")


@query()
def verbatim_passages(spark, d):
    """Common substrings of 50 characters or more between documents and evaluation items."""
    return V.common_substrings(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


@query("SELECT corr(s, f) IS NOT NULL AS known, round(coalesce(corr(s, f), 0), 6) AS r, count(*) AS n FROM (SELECT tokens_used AS s, hierarchy_f1 AS f FROM predictions WHERE tokens_used IS NOT NULL AND hierarchy_f1 IS NOT NULL)")
def score_length_correlation(spark, d):
    p = predictions(spark, d).filter("tokens_used is not null and hierarchy_f1 is not null")
    r = pearson(F.col("tokens_used"), F.col("hierarchy_f1"))
    return p.agg(r.isNotNull().alias("known"), r6(F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0))).alias("r"), F.count("*").alias("n"))
