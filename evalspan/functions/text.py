"""Text detectors, parsers and scores as column expressions.

All are built-in functions, so they stay in generated code. Null text is treated as '' unless a
docstring says otherwise. The pattern families are fixed values: they define what is detected.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspan.functions.columns import ratio

# Pattern families of failed answers.
META_QUESTIONS = (
    r"which\s+(fluorochromes?|channels?|markers?)\s+(are|is|being)",
    r"what\s+(is|are)\s+(the|your)\s+(research|experimental)",
    r"what\s+(cell\s+)?populations?\s+(of\s+interest|are\s+you|do\s+you)",
    r"what\s+specific\s+markers",
    r"what\s+is\s+the\s+(sample|tissue)\s+type",
    r"(need|require)s?\s+(more\s+)?(information|context|details)",
    r"please\s+(provide|specify|clarify)",
    r"could\s+you\s+(specify|clarify|tell|provide)",
    r"without\s+(knowing|more\s+information)",
    r"what\s+(markers?|cells?|gates?)\s+(do\s+you|should\s+i|would\s+you)",
    r"interested\s+in\s+(\w+ing|gate|identify|target)",
)
REFUSALS = (
    r"(cannot|can't|unable\s+to)\s+(predict|determine|create|provide)",
    r"(impossible|not\s+possible)\s+to\s+(predict|determine)",
    r"insufficient\s+(information|data|context)",
    r"would\s+need\s+(to\s+know|more)",
    r"this\s+is\s+(difficult|challenging)\s+without",
)
INSTRUCTIONS = (
    r"here('s|\s+is)\s+how\s+(you|one)\s+(would|could|might)",
    r"the\s+typical\s+approach\s+(would|is)",
    r"generally,?\s+(you|one)\s+would",
    r"a\s+common\s+strategy\s+(is|would\s+be)",
    r"depends\s+on\s+(the|your)",
)
GATES = (
    r"\bsinglets?\b",
    r"\blive\s*(cells?)?\b",
    r"\blymphocytes?\b",
    r"\bcd\d+[+-]?\b",
    r"\bt\s*cells?\b",
    r"\bb\s*cells?\b",
    r"\bnk\s*cells?\b",
    r"\bmonocytes?\b",
    r"\bdendritic\b",
    r"\bleukocytes?\b",
    r"\bgranulocytes?\b",
)
# Appeals to authority with their placeholders, in order.
AUTHORITY = (
    (r"\b(Dr\.|Professor|Prof\.|PhD|Ph\.D\.)\s+\w+", "[EXPERT]"),
    (r"\b(Harvard|Stanford|MIT|Oxford|Cambridge|Yale|Princeton|Berkeley)\b", "[INSTITUTION]"),
    (r"\b(Nature|Science|NEJM|Lancet|Cell|PNAS)\b", "[JOURNAL]"),
    (r"(according to (leading )?experts?)", "[AUTHORITY_CLAIM]"),
    (r"(studies (have )?show(n|s)?)", "[STUDY_CLAIM]"),
    (r"(research (has )?(proven|demonstrated|shown))", "[RESEARCH_CLAIM]"),
    (r"(peer[- ]reviewed)", "[PEER_REVIEW]"),
    (r"(Nobel (Prize )?(laureate|winner))", "[NOBEL]"),
    (r"\[\d+\]", ""),
    (r"\(\w+\s+et\s+al\.,?\s*\d{4}\)", "[CITATION]"),
    (r"\(\w+,?\s*\d{4}\)", "[CITATION]"),
)
# Appeals to the majority.
BANDWAGON = (
    r"(\d+%?\s+of\s+(people|users|experts?|studies))",
    r"(most\s+(people|experts?|researchers?|scientists?))",
    r"(widely\s+(accepted|believed|recognized|known))",
    r"(consensus\s+(is|shows?|agrees?))",
    r"(everyone\s+(knows?|agrees?|believes?))",
    r"(popular\s+(opinion|belief|view))",
    r"(majority\s+(of|believes?|agrees?))",
    r"(commonly\s+(accepted|believed|known))",
)
# Sentiment lists.
POSITIVE = ("excellent", "great", "good", "best", "perfect", "wonderful", "amazing", "outstanding", "superb", "fantastic", "brilliant", "exceptional", "impressive", "remarkable", "superior", "ideal", "optimal", "effective", "successful", "beneficial", "advantageous", "favorable", "positive", "helpful", "useful")
NEGATIVE = ("poor", "bad", "wrong", "incorrect", "failed", "terrible", "awful", "horrible", "worst", "inferior", "inadequate", "insufficient", "deficient", "flawed", "problematic", "disappointing", "unsatisfactory", "negative", "harmful", "detrimental", "unfavorable", "unsuccessful", "ineffective", "useless", "worthless")
# Formatting features.
FORMATTING = {"headers": r"(?m)^#+\s", "bullets": r"(?m)^[\-\*]\s", "numbered": r"(?m)^\d+\.\s", "code": "```", "inline_code": r"`[^`]+`", "bold": r"\*\*[^*]+\*\*", "emphasis": r"_[^_]+_|\*[^*]+\*"}


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def hits(c: Column, patterns: Sequence[str], ignore_case: bool = True) -> Column:
    """Matches of a family of patterns."""
    flag = "(?i)" if ignore_case else ""
    return reduce(Column.__add__, (F.regexp_count(text_of(c), F.lit(flag + p)) for p in patterns))


def failure_type(response: Column) -> Column:
    """Kind of a failed answer: empty, meta_questions, refusal, instructions; none where enough gates are named."""
    meta, refusal, advice, gates = (hits(response, family) for family in (META_QUESTIONS, REFUSALS, INSTRUCTIONS, GATES))
    fine = ((gates >= 5) & (meta + refusal + advice <= 1)) | (gates >= 10)
    asks = ((meta >= 2) & (gates < 5)) | ((meta >= 1) & (gates < 3))
    return F.when(F.trim(text_of(response)) == "", "empty").when(fine, "none").when(asks, "meta_questions").when(refusal >= 1, "refusal").when((advice >= 2) & (gates < 5), "instructions").otherwise("none")


def strip_authority(c: Column) -> Column:
    """Appeals to authority replaced in order, blanks collapsed."""
    out = F.regexp_replace(text_of(c), r"(?i)https?://[^\s<>\"{}|\\^`\[\]]+", "[URL]")
    for pattern, placeholder in AUTHORITY:
        out = F.regexp_replace(out, "(?i)" + pattern, placeholder)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(text_of(c), r"\s+"), lambda w: w != ""))


def verbosity(c: Column, reference: Column | None = None) -> dict[str, Column]:
    """Words, characters, sentences (at least 1) and, with a reference, the ratio of words and its flags."""
    words = word_count(c)
    out = {"n_words": words, "n_chars": F.length(text_of(c)), "n_sentences": F.greatest(F.regexp_count(text_of(c), F.lit(r"[.!?]+")), F.lit(1))}
    if reference is not None:
        r = ratio(words, word_count(reference), 1.0)
        out |= {"ratio": r, "verbose": r > 1.5, "very_verbose": r > 2.5}
    return out


def verbosity_penalty(score: Column, word_ratio: Column, factor: float = 0.1, most: float = 0.2) -> Column:
    return F.greatest(F.lit(0.0), score - F.when(word_ratio > 1.5, F.least((word_ratio - 1.5) * factor, F.lit(most))).otherwise(0.0))


def sentiment(c: Column) -> Column:
    """(positive - negative) / both over the set of blank-separated words; 0 if none."""
    words = F.array_distinct(F.split(F.lower(text_of(c)), r"\s+"))
    n = lambda listed: F.size(F.array_intersect(words, F.array(*map(F.lit, listed))))
    return ratio(n(POSITIVE) - n(NEGATIVE), n(POSITIVE) + n(NEGATIVE))


def formatting(c: Column) -> Column:
    """Share of the formatting features that occur."""
    return reduce(Column.__add__, (text_of(c).rlike(p).cast("int") for p in FORMATTING.values())) / len(FORMATTING)


def explicit_confidence(c: Column) -> Column:
    """First stated confidence; above 1 it is a percentage; within 0 and 1; null if none."""
    t = F.lower(text_of(c))
    number = r"(\d+(?:\.\d+)?)"
    patterns = (rf'"confidence"\s*:\s*{number}', rf"confidence[:\s]+{number}\s*%?", rf"{number}\s*%?\s*confident", rf"certainty[:\s]+{number}\s*%?", rf"{number}\s*%?\s*certain", rf"{number}\s*%\s*(?:sure|probability|likely)")
    found = F.coalesce(*(F.when(F.regexp_extract(t, p, 1) != "", F.regexp_extract(t, p, 1)) for p in patterns)).cast("double")
    return F.when(found.isNotNull(), F.least(F.when(found > 1, found / 100).otherwise(found), F.lit(1.0)))


def error_kind(c: Column) -> Column:
    """rate_limit, token_limit, timeout, api_error; null without an error."""
    e = F.lower(c)
    has = lambda w: e.contains(w)
    return F.when(c.isNull() | (c == ""), F.lit(None)).when(has("rate limit") | has("429"), "rate_limit").when(has("token") & (has("limit") | has("max")), "token_limit").when(has("timeout") | has("timed out"), "timeout").otherwise("api_error")


def condition_suffix(c: Column) -> Column:
    """Last two parts of a condition name with three parts or more: struct(context, strategy), else empty strings."""
    parts = F.split(c, "_")
    known = F.size(parts) >= 3
    at = lambda i: F.when(known, F.try_element_at(parts, F.lit(i))).otherwise("")
    return F.struct(at(-2).alias("context"), at(-1).alias("strategy"))


def condition_anchored(c: Column, anchors: Sequence[str] = ("minimal", "standard", "rich")) -> Column:
    """Parts from the first anchor on: struct(context, strategy, reference); without an anchor the last three of four parts or more, else defaults."""
    parts = F.split(c, "_")
    n = F.size(parts)
    place = F.array_min(F.filter(F.transform(parts, lambda x, i: F.when(x.isin(*anchors), i)), lambda i: i.isNotNull()))
    start = F.when(place.isNotNull(), place).when(n >= 4, n - 3)
    at = lambda k, default: F.coalesce(F.get(parts, start + k), F.lit(default))
    return F.struct(at(0, "standard").alias("context"), at(1, "direct").alias("strategy"), at(2, "none").alias("reference"))


def version_at_least(version: Column, least: str) -> Column:
    """Dotted numbers compared part by part; a missing version is 0.0.0."""
    return F.transform(F.split(F.coalesce(version, F.lit("0.0.0")), r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0))) >= F.array(*(F.lit(int(x)) for x in least.split(".")))


def gate_name(c: Column) -> Column:
    """Gate name in normal form: lower case, no bracketed notes, polarity words as signs, 'cells' dropped, single blanks."""
    s = F.regexp_replace(F.lower(F.trim(text_of(c))), r"\s*\([^)]*\)", "")
    for pattern, to in ((r"\bpositive\b", "+"), (r"\bnegative\b", "-"), (r"\bcells?\b", ""), (r"\s*([+-])", "$1"), (r"[_\s]+", " ")):  # in this order
        s = F.regexp_replace(s, pattern, to)
    return F.trim(s)


def marker_logic(c: Column) -> Column:
    """Marker expression such as 'CD3+ CD19-' as array<struct<marker, positive>>; scatter expressions give []."""
    tokens = F.regexp_extract_all(text_of(c), F.lit(r"([A-Za-z][\w. ]*?(?:-\d+)?)\s*([+-])(?=\s|$|,)"), 0)
    items = F.transform(tokens, lambda t: F.struct(F.trim(F.regexp_replace(t, r"\s*[+-]$", "")).alias("marker"), t.endswith("+").alias("positive")))
    return F.when(F.lower(text_of(c)).rlike(r"\b(fsc|ssc|scatter|time)\b"), F.slice(items, 1, 0)).otherwise(items)


def final_answer(c: Column, prefix: str = "Final answer:") -> Column:
    """Text after the last prefix; else the last fenced block; else a trailing object; else the whole text, trimmed."""
    t = text_of(c)
    fenced = F.regexp_extract(t, r"(?s)```(?:\w+)?\s*((?:(?!```).)*?)\s*```\s*$", 1)
    trailing = F.regexp_extract(t, r"(?s)(\{.*\})\s*$", 1)
    return F.trim(F.when(t.contains(prefix), F.substring_index(t, prefix, -1)).when(fenced != "", fenced).when(trailing != "", trailing).otherwise(t))


def judge_field(c: Column, key: str, kind: str = "string") -> Column:
    """Value of a line 'KEY: value'; null if the key is missing."""
    v = F.regexp_extract(text_of(c), rf"(?im)^\s*\**{key}\**\s*:\s*(.+?)\s*$", 1)
    found = F.when(v != "", v)
    return found if kind == "string" else F.regexp_extract(found, r"-?\d+(?:\.\d+)?", 0).try_cast(kind)


def interpretation_band(score: Column) -> Column:
    """Bands of a confidence between 0 and 100."""
    return F.when(score <= 30, "very_low").when(score <= 50, "low").when(score <= 70, "moderate").when(score <= 90, "high").otherwise("very_high")


def numeric_answer_score(response: Column, gold: Column, tolerance: float = 10.0) -> Column:
    """1 for equal texts or a gold answer within the text; numbers by percent error: within the tolerance 1, 25 0.75, 50 0.5, 100 0.25, else 0; other texts by half for a shared half of the words."""
    clean = lambda c: F.trim(F.regexp_replace(F.lower(text_of(c)), r"\s+", " "))
    num = lambda c: F.regexp_extract(clean(c), r"-?\d+(?:\.\d+)?", 0).try_cast("double")
    r, g = clean(response), clean(gold)
    a, b = num(response), num(gold)
    error = F.when(b == 0, F.when(a == 0, 0.0).otherwise(1000.0)).otherwise(F.abs(a - b) / F.abs(b) * 100)
    by_number = F.when(error <= tolerance, 1.0).when(error <= 25, 0.75).when(error <= 50, 0.5).when(error <= 100, 0.25).otherwise(0.0)
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\W+"), lambda w: F.length(w) > 2))
    overlap = ratio(F.size(F.array_intersect(words(r), words(g))), F.size(words(g)))
    by_words = F.when(overlap >= 0.5, 0.5).when(overlap > 0, 0.25).otherwise(0.0)
    return F.when((r == g) | ((g != "") & r.contains(g)), 1.0).when(b.isNotNull() & a.isNotNull(), by_number).when(b.isNotNull(), 0.0).otherwise(by_words)


def truncated(c: Column) -> Column:
    """More opening than closing braces."""
    count = lambda b: F.length(text_of(c)) - F.length(F.replace(text_of(c), F.lit(b), F.lit("")))
    return count("{") > count("}")


def shingles(tokens: Column, n: int) -> Column:
    """Distinct runs of n words, joined by blanks; [] for shorter texts."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))
    return F.when(F.size(tokens) >= n, F.array_distinct(runs)).otherwise(F.slice(runs, 1, 0))


def first_family(c: Column, families: dict[str, Sequence[str]], otherwise: str | None = None) -> Column:
    """First family of which a word is a substring of the text (case aside); families in their order."""
    t = F.lower(text_of(c))
    out = F
    for name, words in families.items():
        out = out.when(reduce(Column.__or__, (t.contains(w) for w in words)), name)
    return out.otherwise(F.lit(otherwise))


def most_hits(c: Column, keywords: dict[str, Sequence[str]]) -> Column:
    """Kind with the most keyword hits; the earlier one of equals; null without a hit."""
    t = F.lower(text_of(c))
    counts = [(name, reduce(Column.__add__, (t.contains(w).cast("int") for w in words))) for name, words in keywords.items()]
    ranked = F.array_max(F.array(*(F.struct(n.alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, n) in enumerate(counts))))
    return F.when(ranked["n"] > 0, ranked["name"])


def marker_state(c: Column) -> Column:
    """State of a marker as +, -, dim, bright; other words as they are."""
    s = F.lower(F.trim(text_of(c)))
    return F.when(s.isin("+", "pos", "positive", "yes", "hi+"), "+").when(s.isin("-", "neg", "negative", "no"), "-").when(s.isin("dim", "low", "lo", "int", "intermediate"), "dim").when(s.isin("bright", "hi", "high", "++"), "bright").otherwise(s)


def replaced_at_start(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """First of the ordered rules (regex, replacement) that matches at the start, applied; else the text."""
    out = F
    for pattern, to in rules:
        out = out.when(text_of(c).rlike(f"^(?:{pattern})"), F.regexp_replace(text_of(c), pattern, to))
    return out.otherwise(text_of(c))


def assignment_accuracy(predicted: Column, truth: Column) -> Column:
    """Share of the keys of a true map whose value is the predicted one (case and blanks aside); 0 for an empty truth."""
    same = F.map_filter(truth, lambda k, v: F.lower(F.trim(F.try_element_at(predicted, k))) == F.lower(F.trim(v)))
    return ratio(F.size(same), F.size(truth))


def claims(c: Column, patterns: dict[str, str], context: int = 30) -> Column:
    """array<struct<kind, value, context>>: first group of every match of the ordered patterns with the characters around its first place."""
    t = text_of(c)

    def of(kind: str, pattern: str) -> Column:
        around = lambda v: F.substring(t, F.greatest(F.instr(t, v) - context, F.lit(1)), F.length(v) + 2 * context)
        return F.transform(F.regexp_extract_all(t, F.lit(pattern), 1), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), around(v).alias("context")))

    return F.flatten(F.array(*(of(kind, p) for kind, p in patterns.items())))


def concept_score(c: Column, required: Sequence[str], bonus: Sequence[str], failing: Sequence[str]) -> Column:
    """Share of required concepts, plus a tenth per bonus (0.2 at most), minus a fifth per failure (0.5 at most), within 0 and 1."""
    t = F.lower(text_of(c))
    n = lambda ws: reduce(Column.__add__, (t.contains(w).cast("int") for w in ws), F.lit(0))
    base = ratio(n(required), F.lit(len(required)))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), base + F.least(0.1 * n(bonus), F.lit(0.2)) - F.least(0.2 * n(failing), F.lit(0.5))))


def condition_name(model: Column, *parts: Column, temperature: Column | None = None) -> Column:
    """Name of a condition: second part of the model's name (or all of it), the other parts, and tX.X where a temperature is given."""
    short = F.coalesce(F.get(F.split(model, "-"), F.lit(1)), model)
    return F.concat_ws("_", short, *parts, *([F.concat(F.lit("t"), F.format_number(temperature, 1))] if temperature is not None else []))


def strip_bandwagon(c: Column) -> Column:
    """Appeals to the majority replaced, blanks collapsed."""
    out = text_of(c)
    for pattern in BANDWAGON:
        out = F.regexp_replace(out, "(?i)" + pattern, "[CLAIM]")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def strip_formatting(c: Column) -> Column:
    """Markdown dropped: fences, headers, bullets, numbers of lists, emphasis and inline code."""
    out = text_of(c)
    for pattern, to in (("```\\w*", ""), (r"(?m)^#+\s+", ""), (r"(?m)^[\-\*]\s+", ""), (r"(?m)^\d+\.\s+", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), ("`([^`]+)`", "$1")):
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def prepared_for_judging(c: Column, authority: bool = True, bandwagon: bool = True, plain: bool = False) -> Column:
    """struct<text, n_authority, n_bandwagon>: the text without the wanted kinds of bias, and what was found."""
    text = strip_formatting(c) if plain else text_of(c)
    text = strip_authority(text) if authority else text
    text = strip_bandwagon(text) if bandwagon else text
    return F.struct(text.alias("text"), hits(c, [p for p, _ in AUTHORITY]).alias("n_authority"), hits(c, BANDWAGON).alias("n_bandwagon"))


def debate_result(c: Column) -> Column:
    """struct<n_critical, n_moderate, n_minor, confidence> of a validator's JSON (fenced or in prose); confidence within 0 and 100, 50 if there is no JSON."""
    t = text_of(c)
    fenced = F.regexp_extract(t, r"(?s)```json\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(F.regexp_extract(t, r"(?s)\{.*\}", 0))
    v = F.try_parse_json(body)
    levels = F.coalesce(F.try_variant_get(v, "$.discrepancies", "array<struct<severity string>>"), F.array())
    n = lambda level: F.size(F.filter(levels, lambda x: x["severity"] == level))
    critical, moderate = n("critical"), n("moderate")
    confidence = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.try_variant_get(v, "$.confidence_score", "double").cast("int"), F.lit(50))))
    return F.struct(critical.alias("n_critical"), moderate.alias("n_moderate"), (F.size(levels) - critical - moderate).alias("n_minor"), confidence.alias("confidence"))
