"""Reading level of each document, by a familiar-word formula.

The formula has two parts: the share of words outside a list of familiar words, and the average
sentence length. The lists come from the corpus: document frequencies are counted over all its
English documents, once per stratum of average sentence length, because the words of plain texts are
rare in a corpus of specialist ones. A list holds the words that occur in at least a given share of a
stratum's documents; several shares and strata give graded lists, and a text has one unfamiliar share
per list. A linear discriminant, fitted to labelled sample texts, turns shares and sentence length
into a level. Where a text has lost its punctuation, sentence length says nothing; such texts are
placed by the shares alone.

Two passes over the corpus, no shuffle of texts: the first emits partial word counts per task, which
are summed by an aggregate that combines before the shuffle; the lists are then collected. Their size
is bounded: a word is listed if it is in ``SHARES[0]`` of the documents, so a list has at most the
mean number of distinct words of a document divided by that share. The second pass scores.

Defined results for odd input: null, empty and short texts (below ``min_words``) and texts in other
languages have no level; where words of two languages are frequent, that of most sentences holds; an empty corpus gives no row; without samples of two levels at least the fit
is refused; repeated documents count as often as they occur; ties of distance fall to the lower level.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspan.llm.words import words
from evalspan.session import cut_lineage, spread

#: Upper ends of the strata, in words a sentence (the last takes all), and shares of documents for the graded lists.
STRATA = (12.0, 18.0, 24.0, np.inf)
SHARES = (0.01, 0.02, 0.04, 0.08, 0.16, 0.32)
#: Sentence lengths outside say that punctuation was lost, or stands for something else.
PLAUSIBLE = (4.0, 45.0)
SHRINKAGE = 0.2
#: Share of the words of an English text that are among its function words, at least: keeps out languages without a list.
LEAST_ENGLISH = 0.05
#: Labelled samples used for the fit at most.
MAX_SAMPLES = 20_000
#: Distinct words held per task before partial counts are emitted.
HELD_WORDS = 400_000

#: Frequent function words of some languages.
FUNCTION_WORDS = {
    "en": "the of and to a in that is on with for was we it as at by from this be are have has not but or which an its then you your my can when so after before",
    "de": "der die das und nicht ist mit ein eine einen dem den des wird werden auf für bei nach auch sich von zu im oder weil obwohl wenn über",
    "fr": "le la les des et est une un dans pour avec sur que qui du au par ne pas sont ce cette il elle de notre chaque bien",
    "es": "el la los las y es una un en para con del que se por no son su al como más sin de cada aunque cuando",
}
_LANGUAGES: dict[str, tuple[str, ...]] = {}
for _code, _list in FUNCTION_WORDS.items():
    for _w in _list.split():
        _LANGUAGES[_w] = (*_LANGUAGES.get(_w, ()), _code)
_END = re.compile(r"[.!?;]+(?=[\"'”’)\]]*(?:\s|$))")
_SENTENCE = re.compile(r"[.!?;]+\s+|\n+")


def _hits(tokens: list[str]) -> dict[str, int]:
    hits = dict.fromkeys(FUNCTION_WORDS, 0)
    for codes, n in Counter(map(_LANGUAGES.get, tokens)).items():
        for code in codes or ():
            hits[code] += n
    return hits


def is_english(text: str, tokens: list[str]) -> bool:
    """Whether the text is in English; doubtful ones, as with long quotations, are by the language of most sentences."""
    hits = _hits(tokens)
    if hits["en"] < LEAST_ENGLISH * len(tokens):
        return False
    other = max(n for code, n in hits.items() if code != "en")
    if hits["en"] >= 4 * other:
        return True
    if other >= 4 * hits["en"]:
        return False
    votes: Counter = Counter()
    for sentence in _SENTENCE.split(text):
        own = words(sentence)
        h = _hits(own)
        best = max(h, key=lambda code: h[code])
        if h[best] and len(own) > 3:
            votes[best == "en"] += 1
    return votes[True] > votes[False]


def sentence_length(text: str, tokens: list[str]) -> float:
    """Words a sentence; 0 where it can't be told."""
    n = len(_END.findall(text))
    length = len(tokens) / n if n else 0.0
    return length if PLAUSIBLE[0] <= length <= PLAUSIBLE[1] else 0.0


def _english(texts: list[str | None], min_words: int) -> Iterator[tuple[int, list[str], float]]:
    """Position, alphabetic words and sentence length of the texts that have a level."""
    for i, x in enumerate(texts):
        tokens = words(x) if isinstance(x, str) else []
        if len(tokens) >= min_words and is_english(x, tokens):
            alpha = list(filter(str.isalpha, tokens))
            if alpha:
                yield i, alpha, sentence_length(x, tokens)


def document_frequencies(documents: DataFrame, min_words: int) -> DataFrame:
    """(stratum, word, df) of all English documents; word '' counts the documents."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[Counter] = [Counter() for _ in STRATA]

        def emitted() -> pd.DataFrame:
            rows = [(s, w, n) for s, counter in enumerate(held) for w, n in counter.items()]
            for counter in held:
                counter.clear()
            return pd.DataFrame(rows, columns=["stratum", "word", "df"])

        for part in parts:
            for _, alpha, length in _english(part["text"].tolist(), min_words):
                # A document counts in every stratum that reaches up to it; the last one has all, also those of unknown length.
                first = next((s for s, end in enumerate(STRATA) if length and length <= end), len(STRATA) - 1)
                held[first].update({*alpha, ""})
            if sum(map(len, held)) > HELD_WORDS:
                yield emitted()
        yield emitted()

    return documents.select("text").mapInPandas(count, "stratum int, word string, df bigint").groupBy("stratum", "word").agg(F.sum("df").alias("df"))


def familiar_words(frequencies: DataFrame) -> dict[str, int]:
    """Word -> bits of the graded lists that hold it (stratum-major)."""
    # Strata are cumulative: the counts of a stratum are those of all below it and its own.
    sums = frequencies.groupBy("word").pivot("stratum", list(range(len(STRATA)))).agg(F.first("df")).fillna(0)
    level, total = [], F.lit(0)
    for s in range(len(STRATA)):
        total = total + F.col(str(s))
        level.append(total.alias(f"n{s}"))
    cumulative = sums.select("word", *level)
    sizes = cumulative.filter("word = ''").first()
    if sizes is None:
        return {}
    bits = F.lit(0)
    for s in range(len(STRATA)):
        for k, share in enumerate(SHARES):
            enough = (F.col(f"n{s}") >= share * sizes[f"n{s}"]) & (F.col(f"n{s}") > 0)
            bits = bits + F.when(enough, 1 << (s * len(SHARES) + k)).otherwise(0)
    return {r[0]: r[1] for r in cumulative.filter("word <> ''").select("word", bits.cast("bigint").alias("bits")).filter("bits > 0").collect()}


N_LISTS = len(STRATA) * len(SHARES)
#: The list of the plain formula: words of the whole corpus at the middle share.
PLAIN = (N_LISTS - len(SHARES) // 2 - 1,)


class Features:
    """Unfamiliar shares of a text, one per list."""

    def __init__(self, familiar: dict[str, int]) -> None:
        self.row = {w: i for i, w in enumerate(familiar, 1)}
        self.table = np.ones((len(familiar) + 1, N_LISTS), np.float32)  # row 0: a word on no list
        for w, i in self.row.items():
            self.table[i] = [not familiar[w] >> b & 1 for b in range(N_LISTS)]

    def __call__(self, alpha: list[str]) -> np.ndarray:
        rows = np.fromiter(map(self.row.get, alpha, repeat(0)), np.int64, len(alpha))
        return sum(self.table[rows[i : i + 100_000]].sum(0, dtype=np.float64) for i in range(0, len(rows), 100_000)) / len(alpha)


@dataclass
class Discriminant:
    """Shrunk linear discriminant: distances to the levels' means."""

    levels: np.ndarray
    means: np.ndarray
    inverse: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Discriminant:
        levels = np.unique(y)
        means = np.array([x[y == level].mean(0) for level in levels])
        centred = x - means[np.searchsorted(levels, y)]
        within = centred.T @ centred / max(1, len(y) - len(levels))
        spread_out = np.trace(within) / len(within)
        return cls(levels, means, np.linalg.inv((1 - SHRINKAGE) * within + (SHRINKAGE * spread_out + 1e-9) * np.eye(len(within))))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        d = x[:, None, :] - self.means[None]
        return self.levels[np.einsum("nlf,fg,nlg->nl", d, self.inverse, d).argmin(1)]


class LevelModel:
    """Discriminants with and without sentence length; ``lists`` are the numbers of the lists that they use."""

    def __init__(self, familiar: dict[str, int], samples: list[tuple[int, str]], lists: tuple[int, ...] = tuple(range(N_LISTS))) -> None:
        self.features = Features(familiar)
        self.lists = list(lists)
        rows = [(level, alpha, length) for level, text in samples for _, alpha, length in _english([text], 1)]
        if len({r[0] for r in rows}) < 2:
            raise ValueError("samples of two levels at least are needed")
        y = np.array([r[0] for r in rows])
        shares = np.array([self.features(r[1]) for r in rows])[:, self.lists]
        lengths = np.array([r[2] for r in rows])
        known = lengths > 0
        self.alone = Discriminant.fit(shares, y)
        self.with_length = Discriminant.fit(self._both(shares[known], lengths[known]), y[known]) if len(set(y[known])) == len(set(y)) else None

    @staticmethod
    def _both(shares: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return np.column_stack([shares, np.log(lengths) / 4])

    def levels(self, shares: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        shares = shares[:, self.lists]
        out = self.alone(shares)
        if self.with_length is not None and (known := lengths > 0).any():
            out[known] = self.with_length(self._both(shares[known], lengths[known]))
        return out


def reading_levels(documents: DataFrame, samples: DataFrame, min_words: int = 60, graded: bool = True) -> DataFrame:
    """(doc_id, level, unfamiliar, sentence_length) of the English documents (doc_id, text) with ``min_words`` or more.

    ``graded`` uses all graded lists, otherwise the plain formula: one list and sentence length.

    samples: (level, text). ``unfamiliar`` is the share of words outside the list of the plainest
    stratum at the middle share; sentence_length is null where punctuation was lost.
    """
    spark = documents.sparkSession
    corpus = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    familiar = familiar_words(cut_lineage(document_frequencies(corpus, min_words)))  # the corpus is counted once
    labelled = [(int(r[0]), r[1]) for r in samples.filter("level is not null and text is not null").select("level", "text").limit(MAX_SAMPLES).collect()]
    model = spark.sparkContext.broadcast(LevelModel(familiar, labelled, tuple(range(N_LISTS)) if graded else PLAIN))
    shown = len(SHARES) // 2

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids, kept, shares, lengths = part["doc_id"].tolist(), [], [], []
            for i, alpha, length in _english(part["text"].tolist(), min_words):
                kept.append(ids[i])
                shares.append(model.value.features(alpha))
                lengths.append(length)
            x, a = np.array(shares).reshape(-1, N_LISTS), np.array(lengths)
            yield pd.DataFrame({"doc_id": kept, "level": model.value.levels(x, a) if kept else [], "unfamiliar": x[:, shown], "sentence_length": np.where(a > 0, a, np.nan)})

    return corpus.mapInPandas(score, "doc_id bigint, level int, unfamiliar double, sentence_length double").withColumn("sentence_length", F.when(~F.isnan("sentence_length"), F.col("sentence_length")))
