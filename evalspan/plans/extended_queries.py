"""Queries of single functions, names, costs, judges and spectra, with their SQL.

Where a function reads a text of a given form, the query composes that text from table columns; its SQL
takes the expected values from the columns themselves.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspan.functions import text as X
from evalspan.functions.columns import DIFFICULTY, bucket, normal_cdf, once, r6, z_quantile
from evalspan.operators import agreement as G
from evalspan.operators import calibration as C
from evalspan.operators import costs as K
from evalspan.operators import joins as J
from evalspan.operators import names as N
from evalspan.operators import ordered as O
from evalspan.operators import plugins as PL
from evalspan.operators import scoring as SC
from evalspan.operators import spectra as S
from evalspan.operators import statistics as ST
from evalspan.operators import trees as TR
from evalspan.plans import scoring_queries as SQ
from evalspan.plans.aggregate_queries import MODELS, P, predictions
from evalspan.plans.analysis_queries import _EM, _NODES, _SIM, case_points, geography, spectral_pairs
from evalspan.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Condition names, versions, buckets, filters.


@query(f"SELECT DISTINCT condition, coalesce(p[i], 'standard') AS context, coalesce(p[i + 1], 'direct') AS strategy, coalesce(p[i + 2], 'none') AS reference FROM (SELECT condition, p, coalesce(nullif(list_min([nullif(list_position(p, a), 0) FOR a IN ['minimal', 'standard', 'rich']]), 0), CASE WHEN len(p) >= 4 THEN len(p) - 2 END) AS i FROM (SELECT condition, string_split(condition, '_') AS p FROM (SELECT model || '_' || condition AS condition FROM {P})))")
def anchored_conditions(spark, d):
    name = F.concat_ws("_", "model", "condition")
    c = X.condition_anchored(F.col("condition"))
    return predictions(spark, d).filter("model is not null").select(name.alias("condition")).select("condition", c["context"].alias("context"), c["strategy"].alias("strategy"), c["reference"].alias("reference")).distinct()


@query("SELECT DISTINCT model, context_level, concat_ws('_', coalesce(string_split(model, '-')[2], model), prompt_strategy, context_level, reference_mode, 't0.' || (bootstrap_run % 10)) AS name FROM predictions WHERE model IS NOT NULL")
def condition_names(spark, d):
    name = X.condition_name(F.col("model"), F.col("prompt_strategy"), F.col("context_level"), F.col("reference_mode"), temperature=(F.col("bootstrap_run") % 10) / 10)
    return predictions(spark, d).filter("model is not null").select("model", "context_level", name.alias("name")).distinct()


@query("SELECT test_case_id, v AS version, string_split(v, '.')::INT[] >= [1, 2, 0] AS supported FROM (SELECT test_case_id, concat_ws('.', n_gates % 3, n_gates % 5, n_gates) AS v FROM test_cases WHERE n_gates IS NOT NULL)")
def supported_versions(spark, d):
    n = F.col("n_gates")
    v = F.concat_ws(".", n % 3, n % 5, n)
    return table(spark, d, "test_cases").filter("n_gates is not null").select("test_case_id", v.alias("version"), X.version_at_least(v, "1.2.0").alias("supported"))


@query("SELECT test_case_id, n_gates, CASE WHEN n_gates - 1 <= 10 THEN 'easy' WHEN n_gates - 1 <= 18 THEN 'medium' ELSE 'hard' END AS bucket FROM test_cases")
def difficulty_buckets(spark, d):
    return table(spark, d, "test_cases").select("test_case_id", "n_gates", bucket(F.col("n_gates") - 1, DIFFICULTY, "hard").alias("bucket"))


@query("SELECT run_id, status, row_number() OVER (ORDER BY started_at DESC, run_id) AS place FROM (SELECT *, CASE WHEN completed_at IS NULL THEN 'running' ELSE 'completed' END AS status FROM runs) WHERE status = 'completed' AND run_id ILIKE '%1%' AND len(list_intersect(string_split(lower(coalesce(notes, '')), ' '), ['rerun', 'pilot', 'full', 'after', 'the'])) > 0")
def listed_runs(spark, d):
    """Completed runs with any of some tags and a part of the name, newest first."""
    runs = table(spark, d, "runs").withColumn("status", F.when(F.col("completed_at").isNull(), "running").otherwise("completed"))
    tags = F.split(F.lower(F.coalesce("notes", F.lit(""))), " ")
    hit = runs.filter((F.col("status") == "completed") & F.col("run_id").ilike("%1%") & F.arrays_overlap(tags, F.array(*map(F.lit, ("rerun", "pilot", "full", "after", "the")))))
    return O.top_k(hit.withColumn("every", F.lit(1)), ["every"], [F.col("started_at").desc(), F.col("run_id")], 1 << 30).select("run_id", "status", F.col("rank").cast("bigint").alias("place"))


@query("SELECT id, test_case_id, severity FROM (SELECT id, test_case_id, round(1 - hierarchy_f1, 6) AS severity, row_number() OVER (ORDER BY 1 - hierarchy_f1 DESC, id) AS r FROM predictions WHERE hierarchy_f1 IS NOT NULL) WHERE r <= 10")
def severest_failures(spark, d):
    p = predictions(spark, d).filter("hierarchy_f1 is not null").select("id", "test_case_id", (1 - F.col("hierarchy_f1")).alias("s"))
    return p.orderBy(F.col("s").desc(), "id").limit(10).select("id", "test_case_id", r6(F.col("s")).alias("severity"))  # a top-k report


@query("SELECT id, model, hierarchy_f1 FROM predictions WHERE hierarchy_f1 BETWEEN 0.2 AND 0.4 AND id IN (SELECT id FROM predictions WHERE hierarchy_f1 BETWEEN 0.2 AND 0.4 ORDER BY id LIMIT 25)")
def scores_in_range(spark, d):
    return predictions(spark, d).filter(F.col("hierarchy_f1").between(0.2, 0.4)).orderBy("id").limit(25).select("id", "model", "hierarchy_f1")  # the first n are the feature


@query("SELECT run_id, started_at, completed_at, git_commit FROM runs")
def record_round_trip(spark, d):
    """Records to JSON and back: instants as ISO texts, unknown keys dropped."""
    runs = table(spark, d, "runs")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema.fields if f.name in ("run_id", "started_at", "completed_at", "git_commit"))
    form = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return runs.select(F.from_json(F.to_json(F.struct("*"), form), kind, form).alias("r")).select("r.*")


# Texts of a given form.


@query("SELECT marker, unnest([marker, 'CD19']) AS part, unnest([true, false]) AS positive FROM marker_list WHERE regexp_full_match(marker, '[A-Za-z][A-Za-z0-9. ]*(-[0-9]+)?')")
def marker_expressions(spark, d):
    m = table(spark, d, "marker_list").filter(F.col("marker").rlike("^[A-Za-z][A-Za-z0-9. ]*(-[0-9]+)?$"))
    return m.select("marker", F.inline(X.marker_logic(F.concat("marker", F.lit("+ CD19-")))).alias("part", "positive"))


@query("SELECT w, CASE WHEN w IN ('+', 'pos', 'positive', 'yes') THEN '+' WHEN w IN ('-', 'neg', 'no') THEN '-' WHEN w IN ('low', 'int') THEN 'dim' WHEN w = 'high' THEN 'bright' ELSE w END AS state, count(*) AS n FROM (SELECT CASE id % 10 WHEN 0 THEN '+' WHEN 1 THEN 'pos' WHEN 2 THEN 'positive' WHEN 3 THEN 'yes' WHEN 4 THEN '-' WHEN 5 THEN 'neg' WHEN 6 THEN 'low' WHEN 7 THEN 'int' WHEN 8 THEN 'high' ELSE 'other' END AS w FROM predictions) GROUP BY ALL")
def marker_states(spark, d):
    words = ("+", "pos", "positive", "yes", "-", "neg", "low", "int", "high", "other")
    w = F.get(F.array(*map(F.lit, words)), (F.col("id") % 10).cast("int"))
    return predictions(spark, d).groupBy(w.alias("w")).agg(F.count("*").alias("n")).select("w", X.marker_state(F.concat(F.lit(" "), F.upper("w"))).alias("state"), "n")


@query("SELECT id, CASE WHEN c > 1 THEN c / 100 ELSE c END::DOUBLE AS confidence FROM (SELECT id, round(hierarchy_f1 * 100)::DOUBLE AS c FROM predictions WHERE hierarchy_f1 IS NOT NULL)")
def stated_confidence(spark, d):
    text = F.concat(F.lit("Answer.\nConfidence: "), F.round(F.col("hierarchy_f1") * 100).cast("int"), F.lit("% sure"))
    return predictions(spark, d).filter("hierarchy_f1 is not null").select("id", X.explicit_confidence(text).alias("confidence"))


@query("SELECT id, CASE WHEN e <= 10 THEN 1.0 WHEN e <= 25 THEN 0.75 WHEN e <= 50 THEN 0.5 WHEN e <= 100 THEN 0.25 ELSE 0.0 END::DOUBLE AS score FROM (SELECT id, abs(latency_ms - tokens_used) / tokens_used * 100 AS e FROM predictions WHERE latency_ms > 0 AND tokens_used > 0 AND latency_ms IS NOT NULL AND position(tokens_used::VARCHAR IN latency_ms::VARCHAR) = 0) UNION ALL SELECT id, 1.0 FROM predictions WHERE latency_ms > 0 AND tokens_used > 0 AND position(tokens_used::VARCHAR IN latency_ms::VARCHAR) > 0")
def numeric_answers(spark, d):
    answer = F.concat(F.lit("about "), F.col("latency_ms"), F.lit(" ms"))
    return predictions(spark, d).filter("latency_ms > 0 and tokens_used > 0").select("id", X.numeric_answer_score(answer, F.col("tokens_used").cast("string")).alias("score"))


@query("SELECT doc_id, c.kind AS kind, c.value AS value FROM (SELECT doc_id, unnest(list_concat([{'kind': 'percent', 'value': v} FOR v IN regexp_extract_all(text, '(\\d+(?:\\.\\d+)?) percent', 1)], [{'kind': 'channel', 'value': v} FOR v IN regexp_extract_all(text, 'channel (\\d+)', 1)])) AS c FROM documents WHERE text IS NOT NULL)")
def text_claims(spark, d):
    c = X.claims(F.col("text"), {"percent": r"(\d+(?:\.\d+)?) percent", "channel": r"channel (\d+)"})
    return table(spark, d, "documents").select("doc_id", F.explode(c).alias("c")).select("doc_id", "c.kind", "c.value")


@query("SELECT id, model AS verdict, tokens_used::INT AS score FROM predictions WHERE model IS NOT NULL AND tokens_used IS NOT NULL")
def judge_fields(spark, d):
    text = F.concat(F.lit("notes first\n**VERDICT**: "), "model", F.lit(" \nscore: "), F.col("tokens_used"), F.lit(" of many"))
    return predictions(spark, d).filter("model is not null and tokens_used is not null").select("id", X.judge_field(text, "VERDICT").alias("verdict"), X.judge_field(text, "SCORE", "int").alias("score"))


_HAS = lambda w: f"CAST(contains(lower(coalesce(text, '')), '{w}') AS INT)"


@query(f"SELECT doc_id, round(least(1, greatest(0, ({_HAS('panel')} + {_HAS('laser')}) / 2 + least(0.1 * ({_HAS('titration')} + {_HAS('control')} + {_HAS('clone')}), 0.2) - least(0.2 * ({_HAS('unknown')} + {_HAS('failed')} + {_HAS('wrong')}), 0.5))), 6) AS score FROM documents")
def concept_scores(spark, d):
    return table(spark, d, "documents").select("doc_id", r6(X.concept_score(F.col("text"), ["panel", "laser"], ["titration", "control", "clone"], ["unknown", "failed", "wrong"])).alias("score"))


@query("SELECT id, CASE id % 3 WHEN 0 THEN model WHEN 1 THEN '{\"a\": 1}' ELSE 'only ' || model END AS answer FROM predictions WHERE model IS NOT NULL")
def final_answers(spark, d):
    m = F.col("model")
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Final answer: no\nFinal answer: "), m)).when(F.col("id") % 3 == 1, F.concat(F.lit("thinking "), m, F.lit('\n{"a": 1} '))).otherwise(F.concat(F.lit(" only "), m))
    return predictions(spark, d).filter("model is not null").select("id", X.final_answer(text).alias("answer"))


@query("SELECT id, CASE WHEN id % 4 = 0 THEN 0 ELSE (id % 3)::INT END AS n_critical, 0 AS n_moderate, CASE WHEN id % 4 = 0 THEN 0 ELSE 1 END AS n_minor, CASE WHEN id % 4 = 0 THEN 50 ELSE least(100, tokens_used % 150)::INT END AS confidence FROM predictions WHERE tokens_used IS NOT NULL")
def debate_results(spark, d):
    one = F.lit('{"severity": "critical"}, ')
    body = F.concat(F.lit('Verdict\n```json\n{"discrepancies": ['), F.repeat(one, (F.col("id") % 3).cast("int")), F.lit('{"aspect": "x"}], "confidence_score": '), F.col("tokens_used") % 150, F.lit("}\n``` done"))
    text = F.when(F.col("id") % 4 == 0, "no answer").otherwise(body)
    return predictions(spark, d).filter("tokens_used is not null").select("id", X.debate_result(text).alias("r")).select("id", "r.*")


@query("SELECT id, 'Shown by [EXPERT] and [CLAIM]: ' || model AS text, 1 AS n_authority, 1 AS n_bandwagon FROM predictions WHERE model IS NOT NULL")
def prepared_responses(spark, d):
    text = F.concat(F.lit("## Shown  by Dr. Smith and **most experts**: "), F.col("model"))
    return predictions(spark, d).filter("model is not null").select("id", X.prepared_for_judging(text, plain=True).alias("r")).select("id", "r.*")


@query("SELECT id, round(CASE WHEN t = 0 THEN CASE WHEN p = 0 THEN 1.0 ELSE 0.0 END ELSE greatest(0, 1 - abs(p - t) / t) END, 6) AS accuracy FROM (SELECT id, tokens_used % 7 AS p, latency_ms % 5 AS t FROM predictions WHERE tokens_used IS NOT NULL AND latency_ms IS NOT NULL)")
def depth_accuracies(spark, d):
    return predictions(spark, d).filter("tokens_used is not null and latency_ms is not null").select("id", r6(SC.depth_accuracy(F.col("tokens_used") % 7, F.col("latency_ms") % 5)).alias("accuracy"))


# Names.


_DICT = "(SELECT list({{'k': lower(trim(synonym)), 'v': lower(trim(canonical))}} ORDER BY {o}) FROM synonyms WHERE synonym IS NOT NULL)"
_RAW_NAMES = "(SELECT DISTINCT e.marker || CASE WHEN length(e.marker) % 3 = 0 THEN ' positive cells (note)' WHEN length(e.marker) % 3 = 1 THEN ' + ' ELSE '' END AS name FROM (SELECT unnest(entries) AS e FROM staging_panel) WHERE e.marker IS NOT NULL)"


def raw_names(spark, d):
    """Typed markers with polarity words and notes of some kinds behind."""
    m = F.col("e.marker")
    tail = F.when(F.length(m) % 3 == 0, " positive cells (note)").when(F.length(m) % 3 == 1, " + ").otherwise("")
    return table(spark, d, "staging_panel").select(F.explode("entries").alias("e")).filter(m.isNotNull()).select(F.concat(m, tail).alias("name")).distinct()


_ALIASED = "list_reduce(list_prepend({'k': '', 'v': lower(trim(name))}, " + _DICT.format(o="-length(synonym), ord") + r"), lambda acc, a: {'k': '', 'v': regexp_replace(acc.v, '\b' || regexp_replace(a.k, '([^A-Za-z0-9_\s])', '\\\1', 'g') || '\b', a.v, 'g')}).v"
_SIGNS = ((r"\s*\+\s*", "+"), (r"\s*-\s*", "-"), (r"\s+positive\b", "+"), (r"\s+negative\b", "-"), (r"\bpositive\b", "+"), (r"\bnegative\b", "-"), (r"\s*\([^)]*\)\s*", " "), (r"\s+", " "))
_ENHANCED = _ALIASED
for _p, _t in _SIGNS:
    _ENHANCED = f"regexp_replace({_ENHANCED}, '{_p}', '{_t}', 'g')"


@query(f"SELECT name, coalesce(list_filter({_DICT.format(o='ord')}, lambda e: e.k = s)[1].v, list_filter({_DICT.format(o='ord')}, lambda e: contains(s, e.k))[1].v, s) AS canonical FROM (SELECT name, trim({_ENHANCED}) AS s FROM {_RAW_NAMES})")
def enhanced_names(spark, d):
    syn = table(spark, d, "synonyms")
    df = N.with_dictionary(raw_names(spark, d), "aliases", syn, "synonym", "canonical", [-F.length("synonym"), F.col("ord")])
    df = N.with_dictionary(df, "synonyms", syn, "synonym", "canonical", [F.col("ord")])
    return df.select("name", N.enhanced_name(F.col("name"), F.col("aliases"), F.col("synonyms")).alias("canonical"))


_SHORT = "regexp_replace(translate(regexp_replace(replace(replace(replace(translate(lower(trim(name)), '‐−', '--'), 'γδ', 'gd'), 'γ', 'gamma'), 'δ', 'delta'), '\\s*\\([^)]*\\)\\s*', ' ', 'g'), '-_', '  '), '\\s+', ' ', 'g')"
_SHORT = f"trim({_SHORT})"
for _a, _b in N.SHORTER:
    _SHORT = f"replace({_SHORT}, '{_a}', '{_b}')"


@query(f"SELECT name, trim({_SHORT}) AS canonical FROM {_RAW_NAMES}")
def shortened_names(spark, d):
    return raw_names(spark, d).select("name", N.shortened_name(F.col("name")).alias("canonical"))


_EXPANDED = r"regexp_replace(regexp_replace(lower(trim(name)), '\([^)]*[+\-][^)]*\)', '', 'g'), '^([a-z]+\d*[+\-]+\s*)+', '')"


@query(f"SELECT name, CASE WHEN regexp_matches(s, 't cell|b cell|nk cell') THEN regexp_replace(s, '\\bcell\\b', 'cells', 'g') ELSE s END AS canonical FROM (SELECT name, array_to_string([coalesce(list_filter(l, lambda e: e.k = trim(w, '(),'))[1].v, w) FOR w IN string_split_regex({_EXPANDED}, '\\s+') IF w <> ''], ' ') AS s FROM (SELECT name, {_DICT.format(o='ord')} AS l FROM {_RAW_NAMES}))")
def expanded_names(spark, d):
    df = N.with_dictionary(raw_names(spark, d), "words", table(spark, d, "synonyms"), "synonym", "canonical", [F.col("ord")])
    return df.select("name", N.expanded_name(F.col("name"), F.col("words")).alias("canonical"))


@query(f"SELECT name, coalesce(list_filter(l, lambda e: e.k = s)[1].v, CASE WHEN regexp_matches(s, '^(?:cd[- ]?(\\d+))') THEN coalesce(list_filter(l, lambda e: e.k = regexp_replace(s, 'cd[- ]?(\\d+)', 'cd\\1', 'g'))[1].v, regexp_replace(s, 'cd[- ]?(\\d+)', 'cd\\1', 'g')) END, CASE WHEN regexp_matches(s, '^(?:anti[- ])') THEN list_filter(l, lambda e: e.k = regexp_replace(s, 'anti[- ]', '', 'g'))[1].v END, s) AS canonical FROM (SELECT name, lower(regexp_replace(name, '^[\\s\\x{{00a0}}]+|[\\s\\x{{00a0}}]+$', '', 'g')) AS s, {_DICT.format(o='ord')} AS l FROM {_RAW_NAMES})")
def equivalent_names(spark, d):
    df = N.with_dictionary(raw_names(spark, d), "lookup", table(spark, d, "synonyms"), "synonym", "canonical", [F.col("ord")])
    rules = [(r"cd[- ]?(\d+)", "cd$1", True), ("anti[- ]", "", False)]
    return df.select("name", N.equivalent_name(F.col("name"), F.col("lookup"), rules).alias("canonical"))


@query(f"WITH RECURSIVE n AS {_NODES}, a AS (SELECT node AS child, parent FROM n WHERE parent IS NOT NULL UNION SELECT a.child, n.parent FROM a JOIN n ON a.parent = n.node WHERE n.parent IS NOT NULL), p AS (SELECT x.node AS child, 'r' || r_regionkey AS parent FROM n x CROSS JOIN region WHERE x.depth <= 1 UNION ALL SELECT node, 'n' || (CAST(substr(node, 2) AS BIGINT) % 25) FROM n WHERE depth = 2) SELECT child, parent, (child = parent OR EXISTS (SELECT 1 FROM a WHERE a.child = p.child AND a.parent = p.parent)) AS valid FROM p")
def parents_checked(spark, d):
    nodes = geography(spark, d)
    regions = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("parent"))
    few = nodes.filter("depth <= 1").select(F.col("node").alias("child")).crossJoin(regions)  # regions and nations, fixed lists
    suppliers = nodes.filter("depth = 2").select(F.col("node").alias("child"), F.concat(F.lit("n"), F.substring("node", 2, 20).cast("bigint") % 25).alias("parent"))
    return N.valid_parents(few.unionAll(suppliers), "child", "parent", N.closure_of(nodes.select(F.col("node").alias("child"), "parent")))


_CANON = "(SELECT DISTINCT upper(replace(test_case_id, '_', '-')) AS panel, e.marker AS name, lower(trim(e.marker)) AS c FROM (SELECT test_case_id, unnest(entries) AS e FROM {t}) WHERE e.marker IS NOT NULL)"


def _panel_names(spark, d, name):
    e = table(spark, d, name).select(F.upper(F.translate("test_case_id", "_", "-")).alias("panel"), F.explode("entries").alias("e"))
    return e.select("panel", F.col("e.marker").alias("name")).filter("name is not null")


@query(f"WITH p AS (SELECT panel, c, count(*) AS n FROM {_CANON.format(t='panel')} GROUP BY ALL), t AS (SELECT panel, c, count(*) AS n FROM {_CANON.format(t='panel_copy')} GROUP BY ALL), g AS (SELECT coalesce(p.panel, t.panel) AS panel, coalesce(sum(p.n), 0) AS np, coalesce(sum(t.n), 0) AS nt, coalesce(sum(p.n) FILTER (WHERE t.n IS NOT NULL), 0) AS m, count(*) FILTER (WHERE p.n IS NOT NULL AND t.n IS NOT NULL) AS mt FROM p FULL JOIN t ON p.panel = t.panel AND p.c = t.c GROUP BY 1) SELECT panel, m::BIGINT AS n_matching, (nt - mt)::BIGINT AS n_missing, (np - m)::BIGINT AS n_extra, round(CASE WHEN np = 0 THEN 0 ELSE m / np END, 6) AS precision, round(CASE WHEN nt = 0 THEN 0 ELSE mt / nt END, 6) AS recall FROM g")
def registry_matches(spark, d):
    with_form = lambda n: _panel_names(spark, d, n).withColumn("canonical", F.lower(F.trim("name")))
    return N.registry_match(with_form("panel"), with_form("panel_copy"), "panel", "name", "canonical")


_TIERED = SQ.ORACLES["tiered_matches"]
_SIZES = "(SELECT panel, count(DISTINCT name) AS n FROM " + _CANON + " GROUP BY panel)"


@query(f"WITH m AS (SELECT panel, count(*) AS m, sum(CASE tier WHEN 'exact' THEN 1.0 ELSE 0.9 END)::DOUBLE AS w FROM ({_TIERED}) GROUP BY 1), j AS (SELECT coalesce(p.panel, t.panel) AS panel, coalesce(p.n, 0) AS np, coalesce(t.n, 0) AS nt, coalesce(m.m, 0) AS m, coalesce(m.w, 0) AS w FROM {_SIZES.format(t='panel')} p FULL JOIN {_SIZES.format(t='panel_copy')} t ON p.panel = t.panel LEFT JOIN m ON m.panel = coalesce(p.panel, t.panel)) SELECT panel, m AS n_matches, " + ", ".join(f"round(CASE WHEN np = 0 THEN 0 ELSE {h} / np END, 6) AS {x}precision, round(CASE WHEN nt = 0 THEN 0 ELSE {h} / nt END, 6) AS {x}recall, round(CASE WHEN np = 0 OR nt = 0 OR {h} = 0 THEN 0 ELSE 2 * {h} / (np + nt) END, 6) AS {x}f1" for h, x in (("m", ""), ("w", "weighted_"))) + " FROM j")
def semantic_f1(spark, d):
    p, t = _panel_names(spark, d, "panel"), _panel_names(spark, d, "panel_copy")
    m = SC.tiered_matches(p, t, "panel", "name", [("exact", F.col("name")), ("folded", F.lower(F.trim("name")))])
    return N.match_f1(m, p, t, "panel", "name", F.when(F.col("tier") == "exact", 1.0).otherwise(0.9))


@query()
def fuzzy_f1(spark, d):
    """F1 with fuzzy matches at a lower weight (greedy)."""
    p, t = _panel_names(spark, d, "panel"), _panel_names(spark, d, "panel_copy")
    m = N.fuzzy_matches(p, t, "panel", "name", F.lower(F.trim("name")))
    return N.match_f1(m, p, t, "panel", "name", F.col("weight"))


@query(f"WITH f AS ({SQ.ORACLES['name_set_f1']}), c AS ({SQ.ORACLES['critical_recall']}), h AS ({SQ.ORACLES['hallucinated_names']}) SELECT panel, f.f1, f.precision AS precision, f.recall AS recall, coalesce(c.recall, 1) AS critical_recall, coalesce(h.hallucination_rate, 0) AS hallucination_rate FROM f LEFT JOIN c USING (panel) LEFT JOIN h USING (panel)")
def evaluated_predictions(spark, d):
    """All scores of a prediction side by side."""
    f = SQ.QUERIES["name_set_f1"](spark, d).select("panel", "f1", "precision", "recall")
    c = SQ.QUERIES["critical_recall"](spark, d).select("panel", F.col("recall").alias("critical_recall"))
    h = SQ.QUERIES["hallucinated_names"](spark, d).select("panel", "hallucination_rate")
    return f.join(c, "panel", "left").join(h, "panel", "left").fillna(1.0, ["critical_recall"]).fillna(0.0, ["hallucination_rate"])


# Costs, judges, abstention.

PRICES = (("orrery-small", 0.25, 1.25), ("orrery-large", 3.0, 15.0))
_PRICES = "(VALUES " + ", ".join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, i, o in PRICES) + ") AS pr(m, i, o)"


def prices(spark):
    return spark.createDataFrame(list(PRICES), "model string, input_price double, output_price double")


@query(f"SELECT model, m IS NOT NULL AS priced, count(*) AS n, round(sum(coalesce(tokens_used, 0) / 1e6 * coalesce(i, 1.0) + length(coalesce(raw_response, '')) / 1e6 * coalesce(o, 2.0)), 6) AS cost FROM predictions LEFT JOIN {_PRICES} ON m = model GROUP BY ALL")
def token_costs(spark, d):
    p = predictions(spark, d)
    c = K.token_costs(p, "model", F.col("tokens_used"), F.length(F.coalesce("raw_response", F.lit(""))), prices(spark), (1.0, 2.0))
    return c.groupBy("model", "priced").agg(F.count("*").alias("n"), r6(F.sum("cost")).alias("cost"))


_IN, _OUT = K.average_tokens([(1000, 300), (2000, 900)], [1.0, 1.5], [0, 400], True)


@query(f"SELECT model, 2 * 3 * 240 * 5 AS calls, round(7200 * {_IN} / 1e6 * coalesce(i, 3.0) + 7200 * {_OUT} / 1e6 * coalesce(o, 15.0), 6) AS cost, m IS NOT NULL AS priced FROM (SELECT DISTINCT model FROM predictions WHERE model IS NOT NULL) LEFT JOIN {_PRICES} ON m = model")
def experiment_costs(spark, d):
    models = predictions(spark, d).filter("model is not null").select("model")
    return K.experiment_costs(models, (2, 3), 240, 5, _IN, _OUT, prices(spark), (3.0, 15.0))


@query("WITH j AS (SELECT model, hierarchy_precision AS s, hierarchy_f1 AS h FROM predictions WHERE hierarchy_precision IS NOT NULL AND hierarchy_f1 IS NOT NULL), g AS (SELECT model, count(*) AS n, coalesce(corr(s, h), 0) AS r, avg(abs(s - h)) AS mae, avg(s - h) AS bias FROM j GROUP BY 1) SELECT model, n, round(r, 6) AS correlation, round(mae, 6) AS mae, round(bias, 6) AS bias, (r > 0.7 AND mae < 0.15) AS calibrated FROM g")
def judges_calibrated(spark, d):
    return G.judge_calibration(predictions(spark, d), "model", "hierarchy_precision", "hierarchy_f1")


@query("WITH r AS (SELECT id, unnest([hierarchy_f1, hierarchy_precision, hierarchy_recall]) AS s, tokens_used / 500.0 AS w FROM predictions), g AS (SELECT id, count(*) AS n, avg(s) AS m, stddev_pop(s) AS sd, max(w) AS w FROM r WHERE s IS NOT NULL GROUP BY 1) SELECT id, n, round(m, 6) AS ensemble_score, sd > 0.3 AS disagreement, round(greatest(0, m - CASE WHEN w > 1.5 THEN least((w - 1.5) * 0.1, 0.2) ELSE 0 END), 6) AS score FROM g")
def bias_aware_scores(spark, d):
    rated = predictions(spark, d).select("id", F.explode(F.array("hierarchy_f1", "hierarchy_precision", "hierarchy_recall")).alias("s"), (F.col("tokens_used") / 500.0).alias("w"))
    return G.bias_aware_scores(rated, "id", "s", "w")


_HEDGED = " + ".join("CAST(contains(lower(coalesce(raw_response, '')), '" + h.replace("'", "''") + "') AS INT)" for h in C.HEDGES)


@query(f"SELECT id, hierarchy_precision < 0.5 AS below, hierarchy_precision - 0.3 * ({_HEDGED}) < 0.5 AS hedged, (hierarchy_precision < 0.3 OR 1 - (len(list_distinct([hierarchy_f1 > 0.3, hierarchy_recall > 0.3, structure_accuracy > 0.3])) - 1) / 3 < 0.7) AS split FROM predictions WHERE hierarchy_precision IS NOT NULL AND hierarchy_f1 IS NOT NULL AND hierarchy_recall IS NOT NULL AND structure_accuracy IS NOT NULL")
def abstentions(spark, d):
    needed = ("hierarchy_precision", "hierarchy_f1", "hierarchy_recall", "structure_accuracy")
    c = F.col("hierarchy_precision")
    answers = F.array(*(F.col(x) > 0.3 for x in needed[1:]))
    return predictions(spark, d).filter(" and ".join(f"{x} is not null" for x in needed)).select("id", (c < 0.5).alias("below"), C.abstains_by_hedges(c, F.col("raw_response")).alias("hedged"), C.abstains_by_disagreement(c, answers).alias("split"))


# Spectra and dyes.


@query(f"SELECT name_b AS name_a, name_a AS name_b, similarity FROM {_SIM} UNION ALL SELECT name, 'no dye', 0 FROM fluorophore")
def symmetric_similarity(spark, d):
    """Similarity of pairs given in the other order; 0 where unknown."""
    known = spectral_pairs(spark, d)
    pairs = known.select(F.col("name_b").alias("name_a"), F.col("name_a").alias("name_b")).unionAll(table(spark, d, "fluorophore").select("name", F.lit("no dye")))
    return J.symmetric_lookup(pairs, "name_a", "name_b", known.withColumnsRenamed({"name_a": "ka", "name_b": "kb"}), "ka", "kb", "similarity", F.lit(0.0))


_W = "(350.0 + (i - 1) * (500.0::DOUBLE / 499))"


@query(f"WITH e AS (SELECT name, s, list_max(s) AS m FROM {_EM} WHERE s IS NOT NULL), h AS (SELECT *, [i FOR i IN range(1, 501) IF s[i] >= m / 2] AS above, list_position(s, m) AS i FROM e) SELECT name, round({_W}, 6) AS peak, round(CASE WHEN len(above) >= 2 THEN (above[-1] - above[1]) * (500.0::DOUBLE / 499) ELSE 0 END, 6) AS half_width, round(list_sum(s) / m, 6) AS total, round(s[i] * 0.5 + s[least(i + 1, 500)] * 0.5, 6) AS between FROM h")
def spectrum_shapes(spark, d):
    step = (S.LAST - S.FIRST) / (S.POINTS - 1)
    places = F.transform(F.sequence(F.lit(0), F.lit(S.POINTS - 1)), lambda i: S.FIRST + i * step)

    def shape(at, s):
        p = S.peak(at, s)
        total = F.aggregate(S.normalised(s), F.lit(0.0), lambda a, x: a + x)
        return F.struct(r6(p).alias("peak"), r6(S.half_width(at, s)).alias("half_width"), r6(total).alias("total"), r6(S.interpolated(at, s, F.least(p + step / 2, F.lit(S.LAST)))).alias("between"))

    shapes = once(places, lambda at: once(F.col("s"), lambda s: shape(at, s)))
    return S.spectra(table(spark, d, "fluorophore")).select("name", shapes.alias("r")).select("name", "r.*")


@query(f"SELECT name_a, name_b, similarity AS calculated, round(similarity, 1) AS expected, round(abs(similarity - round(similarity, 1)), 6) AS error, abs(similarity - round(similarity, 1)) <= 0.03 + 1e-12 AS passed FROM {_SIM}")
def reference_validation(spark, d):
    s = spectral_pairs(spark, d)
    return S.validated(s, s.withColumn("similarity", F.round("similarity", 1)), ["name_a", "name_b"], "similarity", 0.03)


TEMPLATES = (("gates", "How many gates?", ("easy", "medium")), ("order", "Which gate comes first?", ("medium", "hard")), ("species", "Which species?", ("easy", "medium", "hard", "expert")))


@query("SELECT test_case_id || ':' || k AS question_id, q AS question, difficulty FROM test_cases CROSS JOIN (VALUES " + ", ".join(f"('{k}', '{q}', {list(kinds)})" for k, q, kinds in TEMPLATES) + ") AS t(k, q, kinds) WHERE list_contains(kinds, difficulty)")
def generated_questions(spark, d):
    """Questions of a suite: templates that fit a case's kind."""
    templates = spark.createDataFrame([(k, q, list(kinds)) for k, q, kinds in TEMPLATES], "k string, q string, kinds array<string>")
    cases = table(spark, d, "test_cases").select("test_case_id", "difficulty")
    return cases.join(templates, F.array_contains("kinds", F.col("difficulty"))).select(F.concat_ws(":", "test_case_id", "k").alias("question_id"), F.col("q").alias("question"), "difficulty")


# Statistics.


_ZA, _ZB = z_quantile(0.975), z_quantile(0.8)
_PHI = "0.5 * (1 + sign({x}) * (1 - {t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-(abs({x}) / sqrt(2)) * (abs({x}) / sqrt(2)))))"
_X = f"(abs(effect) / sqrt(2.0 / n) - {_ZA})"


@query(f"SELECT model, n, round({_PHI.format(x=_X, t=f'(1 / (1 + 0.3275911 * abs({_X}) / sqrt(2)))')}, 6) AS power, round(({_ZA} + {_ZB}) * sqrt(2.0 / n), 6) AS detectable FROM (SELECT model, count(hierarchy_f1) AS n, avg(hierarchy_f1) - 0.3 AS effect FROM predictions GROUP BY 1 HAVING count(hierarchy_f1) > 0)")
def test_power(spark, d):
    g = predictions(spark, d).groupBy("model").agg(F.count("hierarchy_f1").alias("n"), (F.avg("hierarchy_f1") - 0.3).alias("effect")).filter("n > 0")
    return g.select("model", "n", r6(ST.achieved_power(F.col("effect"), F.col("n"))).alias("power"), r6(ST.detectable_effect(F.col("n"))).alias("detectable"))


@query(f"SELECT id, round({_PHI.format(x='x', t='(1 / (1 + 0.3275911 * abs(x) / sqrt(2)))')}, 6) AS p FROM (SELECT id, (hierarchy_f1 - 0.3) * 5 AS x FROM predictions WHERE hierarchy_f1 IS NOT NULL)")
def normal_scores(spark, d):
    return predictions(spark, d).filter("hierarchy_f1 is not null").select("id", r6(normal_cdf((F.col("hierarchy_f1") - 0.3) * 5)).alias("p"))


@query()
def bootstrap_r2(spark, d):
    points = case_points(spark, d).withColumn("row_id", F.xxhash64("model", "name"))
    return ST.bootstrap_r2(points, ["model"], "row_id", "x", "y", replicates=2000)


@query()
def compare_conditions(spark, d):
    return ST.compare_groups(predictions(spark, d), ["context_level"], "model", *MODELS, "id", "hierarchy_f1", replicates=2000)


# Trees from marker tables, greedy matches.


@query("WITH p AS (SELECT r_name AS tree, n_name AS population, CASE n_nationkey % 3 WHEN 0 THEN [n_name, 'base'] WHEN 1 THEN ['base'] ELSE [n_name, 'base', 'more'] END AS m, CASE WHEN n_nationkey % 3 = 2 THEN 'Given' END AS parent FROM nation JOIN region ON n_regionkey = r_regionkey), q AS (SELECT a.tree, a.population, coalesce(a.parent, (SELECT arg_min(b.population, (-len(list_distinct(b.m)), b.population)) FROM p b WHERE b.tree = a.tree AND b.population <> a.population AND len(list_distinct(b.m)) < len(list_distinct(a.m)) AND len(list_intersect(a.m, b.m)) = len(list_distinct(b.m))), 'Live') AS parent FROM p a), t AS (SELECT tree, population AS node, parent FROM q UNION ALL SELECT DISTINCT tree, 'Given', 'Live' FROM q WHERE parent = 'Given' UNION ALL SELECT DISTINCT tree, unnest(['All Events', 'Singlets', 'Live']), unnest([NULL, 'All Events', 'Singlets']) FROM q) SELECT * FROM t")
def trees_of_populations(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    kind = F.col("n_nationkey") % 3
    markers = F.when(kind == 0, F.array("n_name", F.lit("base"))).when(kind == 1, F.array(F.lit("base"))).otherwise(F.array("n_name", F.lit("base"), F.lit("more")))
    rows = n.select(F.col("r_name").alias("tree"), F.col("n_name").alias("population"), markers.alias("markers"), F.when(kind == 2, "Given").alias("parent"))
    return TR.from_populations(rows, "tree").select("tree", "node", "parent")


@query("WITH p AS (SELECT test_case_id, lower(trim(e.marker)) AS m FROM (SELECT test_case_id, unnest(entries) AS e FROM panel) WHERE e.marker IS NOT NULL), c AS (SELECT DISTINCT test_case_id, m, 1.0::DOUBLE AS similarity FROM p) SELECT test_case_id, m AS a, m AS b, similarity FROM c")
def greedy_name_match(spark, d):
    """Greedy one-to-one matches; here every marker's best partner is itself."""
    e = table(spark, d, "panel").select("test_case_id", F.explode("entries").alias("e")).select("test_case_id", F.lower(F.trim("e.marker")).alias("m")).filter("m is not null").distinct()
    first = e.select("test_case_id", F.substring("m", 1, 2).alias("g"), F.col("m").alias("a"))
    pairs = first.join(first.withColumnRenamed("a", "b"), ["test_case_id", "g"]).select("test_case_id", "a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.6).alias("similarity"))
    return TR.one_to_one(pairs, ["test_case_id"], "a", "b", "similarity", 0.5, optimal=False).select("test_case_id", "a", "b", "similarity")


# Extension points.

EXTRACTORS = PL.Registry("extractor")


@EXTRACTORS.register("digits")
def _digits(c):
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d+)", 1)


@query("SELECT id, regexp_extract(coalesce(raw_response, ''), '(\\d+)', 1) AS extracted, CAST(regexp_extract(coalesce(raw_response, ''), '(\\d+)', 1) = CAST(bootstrap_run AS VARCHAR) AS INT) AS score FROM predictions")
def evaluated_responses(spark, d):
    """An extractor of one's own, by name, and a scorer."""
    p = predictions(spark, d).select("id", "raw_response", F.col("bootstrap_run").cast("string").alias("expected"))
    return PL.evaluated(p, "raw_response", "expected", EXTRACTORS["digits"], lambda a, b: (a == b).cast("int")).select("id", "extracted", "score")


@query("SELECT id, 'long' AS judge, (length(coalesce(raw_response, '')) > 200)::INT::DOUBLE AS score FROM predictions UNION ALL SELECT id, 'filled', (raw_response IS NOT NULL)::INT::DOUBLE FROM predictions")
def plugged_judges(spark, d):
    judges = {"long": lambda c: F.length(F.coalesce(c, F.lit(""))) > 200, "filled": lambda c: c.isNotNull()}
    return PL.judged(predictions(spark, d).select("id", "raw_response"), judges, "raw_response").select("id", "judge", "score")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN upper(props) WHEN 'view' THEN CAST(length(props) AS VARCHAR) END AS result, coalesce(event_type IN ('click', 'view'), false) AS known FROM events")
def dispatched_tools(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "props")
    return PL.dispatched(e, "event_type", "props", {"click": F.upper, "view": F.length}).select("event_id", "result", "known")


@query("SELECT feature, value, count(*) AS n FROM (SELECT 'first' AS feature, substr(lower(text), 1, 1) AS value FROM documents UNION ALL SELECT 'lines', CAST(length(text) - length(replace(text, chr(10), '')) > 5 AS VARCHAR) FROM documents) GROUP BY ALL")
def own_features(spark, d):
    t = F.col("text")
    f = PL.features(table(spark, d, "documents").select("text"), {"first": F.substring(F.lower(t), 1, 1), "lines": F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) > 5})
    return f.groupBy("feature", "value").agg(F.count("*").alias("n"))


STRATEGIES = (("direct", "Give the gates of {case} ({species})."), ("stepwise", "Think first. Then give the gates of {case}; {case} has {n}."))


@query("SELECT test_case_id, 'direct' AS strategy, 'Give the gates of ' || test_case_id || ' (' || coalesce(species, '') || ').' AS prompt FROM test_cases UNION ALL SELECT test_case_id, 'stepwise', 'Think first. Then give the gates of ' || test_case_id || '; ' || test_case_id || ' has ' || coalesce(n_gates::VARCHAR, '') || '.' FROM test_cases")
def composed_prompts(spark, d):
    templates = spark.createDataFrame(list(STRATEGIES), "strategy string, template string")
    cases = table(spark, d, "test_cases").select("test_case_id", "species", "n_gates")
    return PL.prompts(cases, templates, {"case": F.col("test_case_id"), "species": F.col("species"), "n": F.col("n_gates")}).select("test_case_id", "strategy", "prompt")


@query("SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders")
def transformed_rows(spark, d):
    return PL.transformed(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), lambda p: p.assign(doubled=p["o_totalprice"] * 2)[["o_orderkey", "doubled"]], "o_orderkey bigint, doubled double")


def _log_part(rows):
    import numpy as np

    x = rows["latency_ms"].dropna()
    x = x[x > 0]
    return len(x), float(np.log(x.astype(float)).sum())


@query("SELECT model, round(exp(avg(ln(latency_ms))), 4) AS statistic FROM predictions WHERE latency_ms > 0 GROUP BY model")
def geometric_means(spark, d):
    """A statistic of one's own, from parts that can be merged."""
    import math

    g = PL.own_statistic(predictions(spark, d), ["model"], ["latency_ms"], _log_part, lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: math.exp(s[1] / s[0]) if s[0] else None)
    return g.filter("statistic is not null").select("model", F.round("statistic", 4).alias("statistic"))
