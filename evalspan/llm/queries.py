"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspan.llm import canonical_names, leakage, mixture, reading_level, survivors
from evalspan.session import cut_lineage
from evalspan.sources.tables import table

# Problem 1: one record per paper.


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "extractions")
    keys = {
        "omip": survivors.number_key(F.col("omip_id"), "OMIP"),
        "pmc": survivors.number_key(F.col("pmc_id"), "(?:PMCID)?(?:PMC)?"),
        "doi": survivors.doi_key(F.col("doi")),
    }
    panel = F.coalesce(F.col("concordance")["panel"], F.array())
    method_names = F.flatten(F.transform(panel, lambda p: F.split(F.lower(F.coalesce(p["methods"], F.lit(""))), r"[\s_\-‐]+vs\.?[\s_\-‐]+")))
    ranked = df.select(
        F.col("extraction_id"),
        *(c.alias(n) for n, c in keys.items()),
        "title",
        "model",
        F.array_max(F.filter(F.transform(panel, lambda p: p["score"]), lambda s: (s >= 0) & (s <= 1))).alias("score"),
        F.size(F.array_distinct(F.filter(F.transform(method_names, lambda s: F.trim(s)), lambda m: m != ""))).alias("n_methods"),
        F.unix_micros(F.col("extracted_at").cast("timestamp")).alias("extracted_at"),
        _chosen_method("panel").alias("best_panel"),
        _chosen_method("gating_hierarchy").alias("best_gating"),
    )
    return survivors.with_roots(cut_lineage(ranked), "extraction_id", {k: F.col(k) for k in keys})


def _chosen_method(part: str) -> Column:
    value = F.lower(F.trim(F.col("best_extraction")[part]))
    return F.when(~value.isin("", "none", "null"), value)


_TRUST = ("score", "n_methods", "extracted_at", "extraction_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    trust = [F.col(c) for c in _TRUST]
    best = survivors.best_representatives(
        _papers(spark, sf_dir),
        "root",
        [
            survivors.Bundle("representative", {"extraction_id": F.col("extraction_id")}, trust),
            survivors.Bundle("panel", {"value": F.col("best_panel")}, trust, F.col("best_panel").isNotNull()),
        ],
        record_id="extraction_id",
    )
    return best.filter("n_records >= 2").select(F.col("first_id").alias("group_id"), F.col("representative.extraction_id").alias("survivor_id"), F.coalesce("panel.value", F.lit("")).alias("best_panel"))


def p1_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One built record per paper: identifiers as one bundle, panel and gating choices of one model, the title of that PMC id."""
    trust = [F.col(c) for c in _TRUST]
    filled = F.size(F.array_compact(F.array("omip", "pmc", "doi")))
    best = survivors.best_representatives(
        _papers(spark, sf_dir),
        "root",
        [
            survivors.Bundle("ids", {"omip": F.col("omip"), "pmc": F.col("pmc"), "doi": F.col("doi")}, [filled / 3, *trust]),
            survivors.Bundle("citation", {"title": F.col("title"), "pmc": F.col("pmc")}, trust, F.col("title").isNotNull()),
            survivors.Bundle("panel", {"method": F.col("best_panel"), "model": F.col("model")}, trust, F.col("best_panel").isNotNull()),
            survivors.Bundle("gating", {"method": F.col("best_gating"), "model": F.col("model")}, trust, F.col("best_gating").isNotNull()),
        ],
        [survivors.Dependency("ids", "pmc", "citation", "pmc"), survivors.Dependency("panel", "model", "gating", "model")],
        "extraction_id",
    )
    return best.select(
        F.col("first_id").alias("group_id"), "n_records", "ids.omip", "ids.pmc", "ids.doi", "citation.title",
        F.col("panel.method").alias("panel_method"), F.col("panel.model").alias("panel_model"), F.col("gating.method").alias("gating_method"), F.col("gating.model").alias("gating_model"),
    )


# Problem 3: typed markers and dyes as names of their lists.

# Greek letters that serve as suffixes, words on the reagent instead of the thing, and "anti-" as a letter.
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta", "κ": "kappa", "λ": "lambda", "μ": "mu", "σ": "sigma", "ω": "omega"}
NOISE = ("anti", "human", "mouse", "rat", "dye", "conj", "conjugate", "conjugated", "antibody", "antibodies", "mab", "reagent")
REAGENTS = canonical_names.Rules(GREEK, NOISE, r"[aα]\s?[-‐‑‒–]")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    markers = table(spark, sf_dir, "marker_list").select(F.lit("marker").alias("list"), F.col("marker").alias("name"))
    return markers.unionAll(table(spark, sf_dir, "fluorophore").select(F.lit("fluorophore").alias("list"), "name"))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(test_case_id, ord, list, value) of the values that have to be mapped."""
    entries = table(spark, sf_dir, "staging_panel").select("test_case_id", F.explode("entries").alias("e"))
    fields = F.array(*(F.struct(F.lit(f).alias("list"), F.col("e")[f].alias("value")) for f in ("marker", "fluorophore")))
    typed = entries.select("test_case_id", F.col("e")["ord"].alias("ord"), F.inline(fields)).filter(F.col("value").isNotNull() & ~canonical_names.is_blank(F.col("value")))
    listed = _names(spark, sf_dir).select(F.col("list").alias("l"), "name")
    return typed.join(listed, (F.col("list") == F.col("l")) & (F.col("value") == F.col("name")), "left_anti")


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _typed(spark, sf_dir).select("list", "value").distinct()
    return canonical_names.canonical_values(values, _names(spark, sf_dir), table(spark, sf_dir, "synonyms"), REAGENTS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _typed(spark, sf_dir).join(_mapped(spark, sf_dir), ["list", "value"])
    return rows.select("test_case_id", "ord", F.col("list").alias("field"), "canonical").distinct()


def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of the distinct values that name nothing in their list."""
    rows = _typed(spark, sf_dir).join(_mapped(spark, sf_dir).filter("canonical = ''"), ["list", "value"])
    return rows.groupBy(F.col("list").alias("field"), "value").agg(F.count("*").alias("n_entries"), F.max("score").alias("best_score"))


# Problem 6: evaluation items in documents.


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).filter(F.col("longest_run") >= leakage.WINDOW).select("doc_id", "item_id")


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of every item: documents that give it away and the longest passage."""
    leaks = _leaks(spark, sf_dir).filter(F.col("longest_run") >= leakage.WINDOW).groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("longest_run").alias("longest_run"))
    items = table(spark, sf_dir, "eval_items").select("item_id", "task")
    return items.join(leaks, "item_id", "left").select("item_id", "task", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("longest_run", F.lit(0)).alias("longest_run"))


def p6_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a copy or near copy of a whole item."""
    return _leaks(spark, sf_dir).filter("similarity is not null").select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "longest_run")


# Problem 7: a mixture of sources.


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixture.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "mixture_targets"))


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents with the number of times that each is used."""
    return _mixture(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of the shares that the sources really got."""
    return _mixture(spark, sf_dir)[1]


# Problem 8: reading level of documents.


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_level.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_samples")).select("doc_id", "level")


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of the corpus: documents and words a sentence by level."""
    scored = reading_level.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_samples"))
    return scored.groupBy("level").agg(F.count("*").alias("n_documents"), F.avg("unfamiliar").alias("mean_unfamiliar"), F.avg("sentence_length").alias("mean_sentence_length"))


QUERIES = {"p7_selection": p7_selection, "p7_shares": p7_shares, "p8_found": p8_found, "p8_profile": p8_profile, "p6_found": p6_found, "p6_items": p6_items, "p6_near": p6_near, "p3_found": p3_found, "p3_unmatched": p3_unmatched, "p1_found": p1_found, "p1_golden": p1_golden}

_NUMBER = "CASE WHEN regexp_matches({x}, '[1-9]') THEN regexp_replace(regexp_replace(regexp_replace(upper({x}), '[^A-Z0-9]+', '', 'g'), '^({p})', ''), '^0+', '') END"
_DOI = "regexp_extract(lower(doi), '(10\\.\\d{3,9}/\\S+)', 1)"
_ORDER = "(coalesce(score, -1), n_methods, extracted_at, extraction_id)"
_P1 = f"""
WITH RECURSIVE k AS (SELECT extraction_id AS id, unnest(list_filter(['o' || {_NUMBER.format(x='omip_id', p='OMIP')}, 'p' || {_NUMBER.format(x='pmc_id', p='(PMCID)?(PMC)?')}, CASE WHEN regexp_matches(regexp_replace({_DOI}, '^[^/]*/', ''), '[1-9]') THEN 'd' || regexp_replace({_DOI}, '[^a-z0-9]+', '', 'g') END], lambda x: x IS NOT NULL)) AS key FROM extractions),
r AS (SELECT DISTINCT id, id AS m FROM k UNION SELECT r.id, b.id FROM r JOIN k a ON a.id = r.m JOIN k b ON a.key = b.key),
g AS (SELECT id, min(m) AS grp FROM r GROUP BY id),
x AS (SELECT grp, extraction_id, extracted_at, CASE WHEN lower(trim(best_extraction.panel)) NOT IN ('', 'none', 'null') THEN lower(trim(best_extraction.panel)) END AS best,
  list_max(list_filter(list_transform(concordance.panel, lambda p: p.score), lambda s: s >= 0 AND s <= 1)) AS score,
  len(list_distinct(list_filter(flatten(list_transform(coalesce(concordance.panel, []), lambda p: string_split_regex(lower(coalesce(p.methods, '')), '[\\s_-]+vs[\\s_-]+'))), lambda m: m <> ''))) AS n_methods
  FROM extractions JOIN g ON id = extraction_id)
SELECT grp AS group_id, arg_max(extraction_id, {_ORDER}) AS survivor_id, coalesce(arg_max(best, {_ORDER}) FILTER (WHERE best IS NOT NULL), '') AS best_panel FROM x GROUP BY grp HAVING count(*) >= 2"""

# The same choice by brute force: every pair of candidates of two linked bundles that agree in the linking value.
_PMC, _OMIP = _NUMBER.format(x="pmc_id", p="(PMCID)?(PMC)?"), _NUMBER.format(x="omip_id", p="OMIP")
_DOI_KEY = f"CASE WHEN regexp_matches(regexp_replace({_DOI}, '^[^/]*/', ''), '[1-9]') THEN regexp_extract({_DOI}, '^10\\.(\\d+)/', 1) || '/' || regexp_replace(regexp_replace({_DOI}, '^[^/]*/', ''), '[^a-z0-9]+', '', 'g') END"
_P1_GOLDEN = _P1[: _P1.index("x AS (")] + f"""
x AS (SELECT grp, extraction_id, extracted_at, model, title, {_OMIP} AS omip, {_PMC} AS pmc, {_DOI_KEY} AS doi,
  CASE WHEN lower(trim(best_extraction.panel)) NOT IN ('', 'none', 'null') THEN lower(trim(best_extraction.panel)) END AS panel,
  CASE WHEN lower(trim(best_extraction.gating_hierarchy)) NOT IN ('', 'none', 'null') THEN lower(trim(best_extraction.gating_hierarchy)) END AS gating,
  coalesce(list_max(list_filter(list_transform(concordance.panel, lambda p: p.score), lambda s: s >= 0 AND s <= 1)), -1e300) AS score,
  len(list_distinct(list_filter(flatten(list_transform(coalesce(concordance.panel, []), lambda p: string_split_regex(lower(coalesce(p.methods, '')), '[\\s_-]+vs[\\s_-]+'))), lambda m: m <> ''))) AS n_methods
  FROM extractions JOIN (SELECT extraction_id AS id, coalesce(grp, extraction_id) AS grp FROM extractions LEFT JOIN g ON id = extraction_id) ON id = extraction_id),
k2 AS (SELECT *, (CAST(omip IS NOT NULL AS INT) + CAST(pmc IS NOT NULL AS INT) + CAST(doi IS NOT NULL AS INT)) / 3 AS filled FROM x),
ic AS (SELECT a.grp, row_number() OVER (PARTITION BY a.grp ORDER BY (b.grp IS NOT NULL) DESC, a.filled + greatest(coalesce(b.score, 0), 0) DESC, a.filled DESC, a.score DESC NULLS LAST, a.n_methods DESC NULLS LAST, a.extracted_at DESC NULLS LAST, a.extraction_id DESC NULLS LAST, b.score DESC NULLS LAST, b.n_methods DESC NULLS LAST, b.extracted_at DESC NULLS LAST, b.extraction_id DESC NULLS LAST) AS place, a.omip, a.pmc, a.doi, b.title
  FROM k2 a LEFT JOIN k2 b ON a.grp = b.grp AND a.pmc IS NOT DISTINCT FROM b.pmc AND b.title IS NOT NULL),
p2 AS (SELECT *, EXISTS (SELECT 1 FROM k2 c WHERE c.grp = k2.grp AND c.panel IS NOT NULL AND c.gating IS NOT NULL AND c.model IS NOT DISTINCT FROM k2.model) AS paired FROM k2 WHERE panel IS NOT NULL), g2 AS (SELECT * FROM k2 WHERE gating IS NOT NULL),
pc AS (SELECT coalesce(a.grp, b.grp) AS grp, row_number() OVER (PARTITION BY coalesce(a.grp, b.grp) ORDER BY (a.grp IS NOT NULL AND b.grp IS NOT NULL) DESC, greatest(coalesce(a.score, 0), 0) + greatest(coalesce(b.score, 0), 0) DESC, a.score DESC NULLS LAST, a.n_methods DESC NULLS LAST, a.extracted_at DESC NULLS LAST, a.extraction_id DESC NULLS LAST, b.score DESC NULLS LAST, b.n_methods DESC NULLS LAST, b.extracted_at DESC NULLS LAST, b.extraction_id DESC NULLS LAST) AS place, a.panel AS panel_method, a.model AS panel_model, b.gating AS gating_method, b.model AS gating_model
  FROM p2 a FULL JOIN g2 b ON a.grp = b.grp AND a.model IS NOT DISTINCT FROM b.model AND a.paired),
n AS (SELECT grp, count(*) AS n_records FROM x GROUP BY grp)
SELECT n.grp AS group_id, n.n_records, ic.omip, ic.pmc, ic.doi, ic.title, pc.panel_method, pc.panel_model, pc.gating_method, pc.gating_model
FROM n JOIN ic ON ic.grp = n.grp AND ic.place = 1 LEFT JOIN pc ON pc.grp = n.grp AND pc.place = 1"""

_CLEAN = r"lower(regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(replace(text, '&nbsp;', ' '), '<[^<>]*>', ' ', 'g'), '\[\s*\d+(\s*[,;–-]\s*\d+)*\s*\]', ' ', 'g'), 'ﬁ', 'fi'), chr(160), ' '), '\x{00ad}(\s*\n\s*)?', '', 'g'), '([\p{L}\p{N}])[-‐‑][ \t]*\n\s*([\p{L}\p{N}])', '\1\2', 'g'))"
_WINDOWS = "(SELECT id, pos, array_to_string(list_slice(w, pos, pos + 11), ' ') AS x FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS pos FROM (SELECT @id AS id, regexp_extract_all(" + _CLEAN + r", '[\p{L}\p{N}]+') AS w FROM @table WHERE text IS NOT NULL) WHERE len(w) >= 12))"
_MET = f"{_WINDOWS.replace('@id', 'doc_id').replace('@table', 'documents')} d JOIN {_WINDOWS.replace('@id', 'item_id').replace('@table', 'eval_items')} i ON d.x = i.x"
_P6 = f"SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM {_MET}"
# Hits of one document and item on one diagonal that follow each other are a run.
_P6_ITEMS = f"""
WITH h AS (SELECT d.id AS doc_id, i.id AS item_id, d.pos - i.pos AS diagonal, d.pos AS pos FROM {_MET}),
r AS (SELECT doc_id, item_id, count(*) + 11 AS run FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY pos) AS island FROM h) GROUP BY doc_id, item_id, diagonal, island),
l AS (SELECT item_id, count(DISTINCT doc_id) AS n, max(run) AS longest FROM r GROUP BY item_id)
SELECT item_id, task, coalesce(n, 0) AS n_documents, coalesce(longest, 0) AS longest_run FROM eval_items LEFT JOIN l USING (item_id)"""

ORACLES: dict[str, str] = {"p1_found": _P1, "p1_golden": _P1_GOLDEN, "p6_found": _P6, "p6_items": _P6_ITEMS}
