"""Free-entered values mapped to a canonical list.

Distinct values only are worked on. A value is brought into a normal form, split into a *stem* and a
*variant* (numbers, the letters behind the last number, a Greek letter or a single last letter), and
retrieves candidates from an inverted index of the character n-grams of all listed names, kept apart by
list and variant, because a name with another number or suffix is another thing, however alike the rest
is. Candidates are scored by the cosine of their n-gram vectors, weighted by the rarity of an n-gram in
the list; the best one is accepted above a threshold and a margin to the next name.

Retrieval looks up a value's n-grams from the rarest on and stops where the rest of its vector is too
short to reach ``threshold - margin`` with any name (prefix filter), so common n-grams, such as single
letters and the marks of a name's ends, are scored but never looked up. A name that is not retrieved
can neither be accepted nor stand within the margin of one that is.

The index is broadcast in blocks of ``BLOCK_STEMS`` stems, one pass over the distinct values per block,
so a list of any length is searched; the weights of n-grams are broadcast whole (their number is bounded
by the alphabet, as they have three letters at most). Equal stems are scored once per task.

Synonyms are further spellings of a listed name. Where a synonym and its name differ in the stem
only, the pair of stems is an abbreviation and holds for every listed name of that stem.

Text in brackets may be a note, another name or a part of the name: the value is tried without it,
with it alone, and with the brackets left out; the best score of any of them counts.

Defined results for odd input: values that are null or blank (all kinds of white space), or of no list, give no row; values
of any length are taken whole; a value without any letter or digit, or with an equally good second
name, matches none (canonical ''); an empty list matches nothing; repeated values give one row each.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspan.session import cut_lineage

#: Cosine from which a candidate is accepted, and its least distance to the next name.
THRESHOLD, MARGIN = 0.25, 0.02
#: Stems of one broadcast index: some 4 kB each, 80 MB at most.
BLOCK_STEMS = 20_000
#: Scores of stems remembered by a task.
REMEMBERED = 100_000

_BLANK = "\\s\\u00a0\\u2000-\\u200b\\u202f\\u3000\\ufeff"


@dataclass(frozen=True)
class Rules:
    """What the normal form depends on: letters that serve as suffixes with their names, words that don't tell which thing is meant, and a prefix (regex) that says as little."""

    suffixes: dict[str, str] = field(default_factory=dict)
    noise: tuple[str, ...] = ()
    prefix: str = ""

    def spaced_form(self, text: str) -> str:
        """Lower case words with single blanks between; marks, prefix and noise removed."""
        s = unicodedata.normalize("NFKC", re.sub("[®™©℠]", " ", text)).lower().strip()
        s = re.sub(f"^(?:{self.prefix})", " ", s) if self.prefix else s
        if self.suffixes:
            s = re.sub("|".join(self.suffixes), lambda m: f" {self.suffixes[m[0]]} ", s)
        s = re.sub(r"(?<!\d)\.|\.(?!\d)", "", s).replace(".", "")
        s = re.sub(r"[\W_]+", " ", s)
        if self.noise:
            s = re.sub(rf"\b(?:{'|'.join(self.noise)})\b", " ", s)
        return " ".join(s.split())

    def split_form(self, spaced: str) -> tuple[str, str, str]:
        """Stem, variant and compact form."""
        compact = spaced.replace(" ", "")
        if re.search(r"\d", compact):
            behind = re.search(r"(?<=\d)\D*$", compact)[0]
            numbers = ",".join(re.findall(r"\d+", compact))
            return re.sub(r"\d", "", compact[: len(compact) - len(behind)]), numbers + behind, compact
        suffix = next((g for g in self.suffixes.values() if compact.endswith(g)), "") or (re.search(r" (\w)$", spaced) or ["", ""])[1]
        return compact[: len(compact) - len(suffix)], suffix, compact

    def readings(self, text: str) -> list[str]:
        """Spaced forms to look up: brackets may hold a note, another name or a part of the name."""
        plain = unicodedata.normalize("NFKC", re.sub("[®™©℠]", " ", text))
        inside = re.findall(r"[(\[]([^()\[\]]*)[)\]]", plain)
        texts = [re.sub(r"[(\[][^()\[\]]*[)\]]", " ", plain), " ".join(inside), re.sub(r"[()\[\]]", " ", plain)] if inside else [plain]
        return list(dict.fromkeys(f for f in map(self.spaced_form, texts) if f))


def is_blank(value: Column) -> Column:
    return F.regexp_replace(value, f"[{_BLANK}]+", "") == ""


def grams(stem: str) -> list[str]:
    """Distinct letters, pairs of letters at a distance of one or two, and trigrams of a stem with its ends marked.

    Letters and spaced pairs still hold where neighbours are swapped.
    """
    padded = f"^{stem}$"
    runs = [padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)]
    return list(dict.fromkeys(runs + [padded[i] + padded[i + 2] for i in range(len(padded) - 2)]))


class Weights:
    """Rarity of n-grams among the stems of each list: log(1 + stems / stems with it)."""

    def __init__(self) -> None:
        self.df: dict[str, Counter] = {}
        self.n: Counter = Counter()

    def add(self, name: str, stem: str) -> None:
        self.n[name] += 1
        self.df.setdefault(name, Counter()).update(grams(stem))

    def vector(self, name: str, stem: str) -> list[tuple[str, float]]:
        """N-grams of a stem with their weights, rarest first; one that no stem has counts as one of a single stem's."""
        n, df = self.n[name], self.df.get(name, {})
        return sorted(((g, math.log1p(n / df.get(g, 1))) for g in grams(stem)), key=lambda x: (-x[1], x[0]))


class NameIndex:
    """Inverted index of (list, variant): n-gram -> stems, with the names of each stem."""

    def __init__(self, refs: list[tuple[str, str, str, str]], weights: Weights) -> None:
        self.weights = weights
        self.names: dict[tuple[str, str], list[list[str]]] = {}
        self.norms: dict[tuple[str, str], list[float]] = {}
        self.postings: dict[tuple[str, str], dict[str, list[int]]] = {}
        at: dict[tuple[str, str, str], int] = {}
        for name, canonical, stem, variant in sorted(set(refs)):
            key = (name, variant)
            names = self.names.setdefault(key, [])
            i = at.setdefault((*key, stem), len(names))
            if i == len(names):
                vector = weights.vector(name, stem)
                names.append([])
                self.norms.setdefault(key, []).append(math.sqrt(sum(w * w for _, w in vector)))
                postings = self.postings.setdefault(key, {})
                for g, _ in vector:
                    postings.setdefault(g, []).append(i)
            names[i].append(canonical)

    def retrieved(self, name: str, stem: str, variant: str, least: float) -> dict[int, float]:
        """Stems of the same list and variant that share a looked-up n-gram, with the products of their vectors."""
        postings = self.postings.get((name, variant))
        if not postings:
            return {}
        vector = self.weights.vector(name, stem)
        rest = sum(w * w for _, w in vector)
        enough = least * least * rest
        dots: dict[int, float] = {}
        for g, w in vector:
            looked_up = rest >= enough - 1e-9
            for i in postings.get(g, ()):
                if looked_up or i in dots:
                    dots[i] = dots.get(i, 0.0) + w * w
            rest -= w * w
        return dots

    def scores(self, name: str, stem: str, variant: str, least: float) -> dict[str, float]:
        """Cosine of the names that reach ``least``."""
        dots = self.retrieved(name, stem, variant, least)
        if not dots:
            return {}
        own = math.sqrt(sum(w * w for _, w in self.weights.vector(name, stem)))
        out: dict[str, float] = {}
        for i, dot in dots.items():
            score = dot / (own * self.norms[name, variant][i])
            if score >= least:
                for canonical in self.names[name, variant][i]:
                    out[canonical] = max(out.get(canonical, 0.0), score)
        return out


def reference_forms(names: DataFrame, synonyms: DataFrame, rules: Rules) -> DataFrame:
    """All spellings of the listed names: (list, canonical, stem, variant).

    names: (list, name); synonyms: (synonym, canonical).
    """
    form = "list string, canonical string, own boolean, stem string, variant string, compact string"

    def forms(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(r.list, r.canonical, r.own, *rules.split_form(spaced)) for r in part.itertuples(index=False) for spaced in rules.readings(r.value)]
            yield pd.DataFrame(rows, columns=["list", "canonical", "own", "stem", "variant", "compact"])

    listed = names.filter("list is not null and name is not null").select("list", F.col("name").alias("canonical"))
    other = listed.join(synonyms.select(F.col("synonym").alias("value"), F.col("canonical").alias("c")), F.col("canonical") == F.col("c")).filter("value is not null")
    every = listed.select("list", F.col("canonical").alias("value"), "canonical", F.lit(True).alias("own")).unionAll(other.select("list", "value", "canonical", F.lit(False)))
    every = cut_lineage(every.mapInPandas(forms, form))
    own = every.filter("own").drop("own", "compact")
    # A single last letter that a synonym writes without a blank: it's the variant of its name.
    of_name = own.select("list", "canonical", F.col("stem").alias("name_stem"), F.col("variant").alias("name_variant"))
    short = every.filter("not own").join(of_name, ["list", "canonical"])
    glued = (F.col("variant") == "") & (F.length("name_variant") == 1) & (F.expr("right(compact, 1)") == F.col("name_variant"))
    short = short.withColumn("stem", F.when(glued, F.expr("left(compact, length(compact) - 1)")).otherwise(F.col("stem"))).withColumn("variant", F.when(glued, F.col("name_variant")).otherwise(F.col("variant")))
    abbreviations = short.filter("variant = name_variant and stem <> name_stem and variant <> ''").select(F.col("list").alias("l"), F.col("stem").alias("short_stem"), F.col("name_stem").alias("long_stem")).distinct()
    derived = own.join(abbreviations, (F.col("list") == F.col("l")) & (F.col("stem") == F.col("long_stem"))).select("list", "canonical", F.col("short_stem").alias("stem"), "variant")
    spelled = own.unionByName(short.select("list", "canonical", "stem", "variant"))
    # "Name K" typed without the blank: the variant '' with the letter as the end of the stem.
    joined = F.when((F.length("variant") == 1) & F.col("variant").rlike("[^0-9]"), F.array(F.struct("stem", "variant"), F.struct(F.concat("stem", "variant").alias("stem"), F.lit("").alias("variant")))).otherwise(F.array(F.struct("stem", "variant")))
    return spelled.select("list", "canonical", F.inline(joined)).unionByName(derived).distinct()


def canonical_values(values: DataFrame, names: DataFrame, synonyms: DataFrame, rules: Rules, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """(list, value, canonical, score) for the distinct values (list, value).

    canonical is '' where no name fits; score is the best name's, null where none reaches ``threshold - margin``.
    """
    spark = values.sparkSession
    values = values.filter(F.col("list").isNotNull() & F.col("value").isNotNull() & ~is_blank(F.col("value"))).select("list", "value")
    refs = cut_lineage(reference_forms(names, synonyms, rules))
    n_blocks = -(-refs.count() // BLOCK_STEMS) or 1
    block = F.pmod(F.xxhash64("list", "stem"), F.lit(n_blocks))  # a stem lies in one block
    weights = Weights()
    for b in range(n_blocks):
        for r in refs.filter(block == b).select("list", "stem").distinct().toLocalIterator():
            weights.add(r[0], r[1])
    shared = spark.sparkContext.broadcast(weights)
    least = threshold - margin
    tops = []
    for b in range(n_blocks):
        index = spark.sparkContext.broadcast([tuple(r) for r in refs.filter(block == b).select("list", "canonical", "stem", "variant").collect()])

        def best(parts: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            known, seen = NameIndex(index.value, shared.value), {}
            for part in parts:
                rows = []
                for name, value in zip(part["list"], part["value"]):
                    found: dict[str, float] = {}
                    for spaced in rules.readings(value):
                        stem, variant, _ = rules.split_form(spaced)
                        key = (name, stem, variant)
                        if key not in seen:
                            if len(seen) >= REMEMBERED:
                                seen.clear()
                            seen[key] = known.scores(*key, least)
                        for canonical, score in seen[key].items():
                            found[canonical] = max(found.get(canonical, 0.0), score)
                    top = sorted(((s, c) for c, s in found.items()), reverse=True)[:2]
                    rows.append((name, value, [{"score": s, "canonical": c} for s, c in top]))
                yield pd.DataFrame(rows, columns=["list", "value", "top"])

        tops.append(values.mapInPandas(best, "list string, value string, top array<struct<score double, canonical string>>"))
    # The two best names of all blocks; a name may be among the best of several.
    top = reduce(DataFrame.unionAll, tops)
    if n_blocks > 1:
        top = top.groupBy("list", "value").agg(F.flatten(F.collect_list("top")).alias("top"))
    first = F.array_max("top")
    second = F.array_max(F.transform(F.filter("top", lambda t: t["canonical"] != first["canonical"]), lambda t: t["score"]))
    fits = (first["score"] >= threshold) & (first["score"] - F.coalesce(second, F.lit(0.0)) >= margin)
    return top.select("list", "value", F.when(fits, first["canonical"]).otherwise("").alias("canonical"), first["score"].alias("score"))
