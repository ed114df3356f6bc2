"""Overlap of an answer with its reference text.

Measures of one pair of texts are row-wise; common substrings of a corpus are found through an index of
hashed k-grams at every k-th position of the references, so no text meets all others. The index is
broadcast in blocks of bounded size, one pass over the outputs per block, and no output is shuffled.
Defined results: null texts count as ''; an empty reference has overlap 0; both empty word sets are 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspan.functions.columns import r6, ratio
from evalspan.functions.text import shingles, text_of


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(text_of(c)), r"\W+"), lambda w: w != "")


def ngram_jaccard(a: Column, b: Column, n: int) -> Column:
    x, y = shingles(words(a), n), shingles(words(b), n)
    return ratio(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y)))


def containment(expected: Column, actual: Column) -> Column:
    e = F.array_distinct(words(expected))
    return ratio(F.size(F.array_intersect(e, words(actual))), F.size(e))


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence of characters, by bit-parallel rows (a word of bits as long as a)."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def character_overlap(df: DataFrame, key: str, actual: str, reference: str) -> DataFrame:
    """(key, lcs_overlap, sequence_ratio): common subsequence over the reference's length, and the matching-blocks ratio."""

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k, a, b in zip(part[key], part[actual], part[reference]):
                a, b = (a or "").lower().strip(), (b or "").lower().strip()
                rows.append((k, round(lcs_length(a, b) / len(b), 6) if b else 0.0, round(SequenceMatcher(None, a, b).ratio(), 6)))
            yield pd.DataFrame(rows, columns=[key, "lcs_overlap", "sequence_ratio"])

    return df.select(key, actual, reference).mapInPandas(measure, f"`{key}` {dict(df.dtypes)[key]}, lcs_overlap double, sequence_ratio double")


def memorisation(df: DataFrame, keep: Sequence[str], actual: Column, reference: Column) -> DataFrame:
    """n-gram overlaps and the flag: contained word for word, or half of the n-grams of some size shared.

    Words and n-grams are columns of their own steps, so each is made once per row.
    """
    inside = (F.trim(text_of(reference)) != "") & F.lower(text_of(actual)).contains(F.lower(F.trim(text_of(reference))))
    step = df.select(*keep, inside.alias("contained"), words(actual).alias("__a"), words(reference).alias("__r"))
    for n in (3, 4, 5):
        step = step.withColumns({f"__a{n}": shingles(F.col("__a"), n), f"__r{n}": shingles(F.col("__r"), n)})
    step = step.withColumns({f"__i{n}": F.size(F.array_intersect(f"__a{n}", f"__r{n}")) for n in (3, 4, 5)})
    share = {n: ratio(F.col(f"__i{n}"), F.size(f"__a{n}") + F.size(f"__r{n}") - F.col(f"__i{n}")) for n in (3, 4, 5)}
    out = step.select(*keep, *(r6(x).alias(f"overlap_{n}") for n, x in share.items()), "contained")
    return out.withColumn("memorised", F.col("contained") | (F.greatest("overlap_3", "overlap_4", "overlap_5") >= 0.5))


def fingerprint(df: DataFrame, text: str, k: int = 100) -> DataFrame:
    """The k most frequent 3- to 5-grams of a test set (equal counts by name) with a hash of each."""
    tokens = words(F.col(text))
    grams = df.select(F.explode(F.concat(*(shingles(tokens, n) for n in (3, 4, 5)))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(k).withColumn("hash", F.substring(F.sha2("gram", 256), 1, 16))


#: Characters of references in one broadcast index, and of outputs hashed at a time.
REFERENCE_CHARS, OUTPUT_CHARS = 4_000_000, 1 << 20
#: Pairs of positions taken at a time.
SEEDS = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Hasher:
    """Polynomial hashes modulo 2^64 of the k-grams at all positions of a text."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, k: int) -> None:
        self.k = k
        self.up, self.down = _powers(self.BASE, OUTPUT_CHARS + k), _powers(pow(self.BASE, -1, 1 << 64), OUTPUT_CHARS + k)

    def pieces(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for at in range(0, len(codes) - self.k + 1, OUTPUT_CHARS):
            c = codes[at : at + OUTPUT_CHARS + self.k - 1].astype(np.uint64)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * self.up[: len(c)], dtype=np.uint64)])
            n = len(c) - self.k + 1
            yield at, (total[self.k :] - total[:n]) * self.down[:n] * np.uint64(0xD6E8FEB86659FD93)


class _References:
    """The distinct texts of the references in one array, and the k-grams at multiples of k in order of their hashes."""

    def __init__(self, ids: list, texts: list[str | None], k: int) -> None:
        self.k, self.ids = k, {}
        for i, t in zip(ids, texts):
            self.ids.setdefault((t or "").lower(), []).append(i)
        lengths = [len(t) for t in self.ids]
        self.owners = list(self.ids.values())
        self.codes = _codes("".join(self.ids))
        self.ends = np.cumsum(lengths, dtype=np.int64)
        self.starts = self.ends - lengths
        at = np.concatenate([np.empty(0, np.int64), *(np.arange(s, e - k + 1, k) for s, e in zip(self.starts, self.ends))])
        h = np.concatenate([np.empty(0, np.uint64), *(x for _, x in _Hasher(k).pieces(self.codes))])[at]
        order = np.argsort(h, kind="stable")
        self.hashes, self.at = h[order], at[order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[h >> np.uint64(44)] = True


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common start."""
    n, i, step = min(len(a), len(b)), 0, 64
    while i < n:
        off = np.flatnonzero(a[i : min(n, i + step)] != b[i : min(n, i + step)])
        if len(off):
            return i + int(off[0])
        i, step = i + step, step * 2
    return n


def _passages(text: str, refs: _References, hasher: _Hasher, least: int) -> list[tuple[int, int, int, int]]:
    """(reference, output_at, reference_at, length) of all maximal common substrings.

    Seeds of a diagonal that lie on a substring already measured are passed over, so repeated k-grams
    cost one comparison per substring.
    """
    codes, k, out, covered = _codes(text), refs.k, [], {}
    for at, h in hasher.pieces(codes):
        here = np.flatnonzero(refs.filter[h >> np.uint64(44)])
        lo, hi = np.searchsorted(refs.hashes, h[here]), np.searchsorted(refs.hashes, h[here], "right")
        here, lo, n = here[hi > lo] + at, lo[hi > lo], (hi - lo)[hi > lo]
        ends, i = np.cumsum(n), 0
        while i < len(here):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SEEDS)))
            first = np.repeat(ends[i:j] - n[i:j], n[i:j])
            spots = np.repeat(lo[i:j], n[i:j]) + np.arange(len(first)) + (ends[i] - n[i]) - first
            for p, g in zip(np.repeat(here[i:j], n[i:j]).tolist(), refs.at[spots].tolist()):
                if p < covered.get(p - g, 0):
                    continue
                r = int(np.searchsorted(refs.ends, g, "right"))
                s, e = int(refs.starts[r]), int(refs.ends[r])
                right = _equal(codes[p:], refs.codes[g:e])
                if right < k:
                    continue
                left = _equal(codes[:p][::-1], refs.codes[s:g][::-1])
                covered[p - g] = p + right
                if left + right >= least:
                    out.append((r, p - left, g - left - s, left + right))
            i = j
    return out


def common_substrings(outputs: DataFrame, key: str, text: str, corpus: DataFrame, ckey: str, ctext: str, least: int = 50) -> DataFrame:
    """Maximal common substrings of at least ``least`` characters, case aside: output, reference, positions, length.

    A common substring of that length covers a whole block of k = least / 2 characters that starts at a
    multiple of k in the reference; the outputs' k-grams are looked up by hash, and hits are extended.
    Exact copies of a reference, and of an output within a batch, are searched once.
    """
    k = max(1, least // 2)
    okind, ckind = dict(outputs.dtypes)[key], dict(corpus.dtypes)[ckey]
    spark, found = outputs.sparkSession, None
    chars = corpus.agg(F.sum(F.length(ctext))).first()[0] or 0
    n_blocks = -(-chars // REFERENCE_CHARS) or 1
    block = F.pmod(F.xxhash64(ckey, ctext), F.lit(n_blocks))
    for b in range(n_blocks):
        rows = corpus.filter(block == b).select(ckey, ctext).collect()
        held = spark.sparkContext.broadcast(_References([r[0] for r in rows], [r[1] for r in rows], k))

        def search(parts: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            refs, hasher = held.value, _Hasher(k)
            for part in parts:
                copies: dict[str, list] = {}
                for i, t in zip(part[key], part[text]):
                    if t:
                        copies.setdefault(t.lower(), []).append(i)
                hits = [(ids, m) for t, ids in copies.items() if len(t) >= least for m in _passages(t, refs, hasher, least)]
                rows = [(i, c, *m[1:]) for ids, m in hits for i in ids for c in refs.owners[m[0]]]
                yield pd.DataFrame(rows, columns=["output_id", "reference_id", "output_at", "reference_at", "length"])

        part = outputs.select(key, text).mapInPandas(search, f"output_id {okind}, reference_id {ckind}, output_at bigint, reference_at bigint, length bigint")
        found = part if found is None else found.unionAll(part)
    return found
