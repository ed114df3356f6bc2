"""Evaluation passages inside a training corpus.

An item leaks whole or in part, so windows of two sizes are searched for:

* *item-sized windows*, as long as the item itself, find copies and near copies of whole items. A
  window's fingerprint is the 64-bit SimHash of its five-word shingles, weighted by their rarity among
  the items. Fingerprints within ``RADIUS`` bits are found by a multi-index: 64 bits are cut into
  ``BLOCKS`` blocks, and two fingerprints that differ in at most ``BLOCKS * (NEAR + 1) - 1`` bits have
  a block that differs in at most ``NEAR`` bits. The items' blocks are indexed under all values within
  ``NEAR`` bits, so one lookup per block finds every fingerprint within the radius. What is found is
  verified by the exact weighted similarity of the two windows' shingles (sum of the lesser over sum of
  the greater number of occurrences).
* *passages* of ``WINDOW`` words find parts of items. They must agree word for word, so their radius is
  0 and their index has one block of all 64 bits; the words themselves are compared afterwards, and
  adjacent hits of an item join to runs.

The corpus is read, cut into words and hashed once, whatever the number of items: a table of all items'
shingles (one byte per slot, ``TABLE_BITS`` at most) lets those stretches of a document pass that may
hold a window, and only they are written, as word hashes. The filter loses nothing: a window whose
weighted similarity reaches 0.8 has at least that share of its weight in known shingles, unknown ones
weigh most, so at least that share of its shingles is known, and one of the runs of 8 to 15 shingles into
which it can be cut holds 7 known ones; so does a passage. The items are then searched in blocks of
bounded size, each of them over the written stretches.

Rows depend neither on the blocks of items nor on those of documents: weights come from all items, and
a word broken at a line end is one word.

Defined results for odd input: null, empty and shorter texts give no row; items shorter than the
window can't leak; repeated passages, equal items and copies of documents each count; texts of any
length are taken whole; a document's row doesn't depend on other documents; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspan.llm.words import words
from evalspan.session import cut_lineage, spread

WINDOW, SHINGLE, SIMILARITY = 12, 5, 0.8
#: Blocks of bits and the bits by which one of them may differ; together they guarantee the radius.
BLOCKS, NEAR = 4, 3
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Items of one broadcast index: an item takes 33 kB of neighbouring values, a word some 40 bytes (110 MB at most beside one item).
BLOCK_ITEMS, BLOCK_CHARS = 2_000, 1_000_000
#: Slots of the table of shingles, as a power of two (a byte each).
TABLE_BITS = 26
#: Words handled at once (64 counters each), pairs compared at once, and entries of a worker's table of word hashes.
CHUNK_WORDS, CHUNK_PAIRS, HASHES = 100_000, 1_000_000, 1_000_000
#: Shingles of a passage, and the most that a run of the filter has.
PASSAGE = WINDOW - SHINGLE + 1
STRETCH = 2 * PASSAGE - 1

_MIX = np.uint64(0x9E3779B97F4A7C15)
_WIDTH = 64 // BLOCKS


class _Hashes(dict):
    """Word -> 64-bit hash, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= HASHES:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def word_hashes(tokens: list[str], hashes: _Hashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))


def shingle_hashes(h: np.ndarray) -> np.ndarray:
    """Hash of the SHINGLE words from every position, order-dependent and mixed."""
    n = len(h) - SHINGLE + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(SHINGLE if n > 0 else 0):
        out = (out ^ h[j : j + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


class ShingleTable:
    """Weights of the items' shingles by hashed slot, in eighths; 0 is a shingle of no item.

    weight = log(1 + items / items with the shingle); a shingle of no item weighs as much as one of a
    single item.
    """

    def __init__(self, items_with: np.ndarray, n_items: int) -> None:
        self.shift = np.uint64(64 - (len(items_with).bit_length() - 1))
        self.top = self._codes(np.ones(1), n_items)[0]
        self.codes = np.where(items_with > 0, self._codes(np.maximum(items_with, 1), n_items), 0).astype(np.uint8)

    @staticmethod
    def _codes(df: np.ndarray, n: int) -> np.ndarray:
        return np.clip(np.rint(8 * np.log1p(n / df)), 1, 255).astype(np.uint8)

    @staticmethod
    def slots(shingles: np.ndarray, bits: int) -> np.ndarray:
        return (shingles >> np.uint64(64 - bits)).astype(np.int64)

    def known(self, shingles: np.ndarray) -> np.ndarray:
        return self.codes[(shingles >> self.shift).astype(np.int64)]

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        code = self.known(shingles)
        return np.where(code > 0, code, self.top).astype(np.int64)


class Sums:
    """Running sums of the shingles' weights and of their weighted bits: the SimHash of any run of them is one difference."""

    def __init__(self, shingles: np.ndarray, weights: np.ndarray) -> None:
        small = len(shingles) < 2**31 // 255
        bits = np.unpackbits(np.ascontiguousarray(shingles).view(np.uint8).reshape(-1, 8), axis=1)
        self.bits = np.zeros((len(bits) + 1, 64), np.int32 if small else np.int64)
        np.cumsum(bits * weights.astype(self.bits.dtype)[:, None], axis=0, out=self.bits[1:])
        self.whole = np.concatenate([[0], np.cumsum(weights)])

    def fingerprints(self, starts: np.ndarray, size: int) -> np.ndarray:
        """SimHash of ``size`` shingles from every start: a bit is the weighted majority of its shingles' bits."""
        out = np.zeros(len(starts), np.uint64)
        for k in range(0, len(starts), CHUNK_WORDS):
            p = starts[k : k + CHUNK_WORDS]
            out[k : k + len(p)] = np.packbits(2 * (self.bits[p + size] - self.bits[p]) > (self.whole[p + size] - self.whole[p])[:, None], axis=1).view(np.uint64).ravel()
        return out


def _neighbours() -> np.ndarray:
    """All patterns of at most NEAR bits of a block."""
    return np.array([sum(1 << b for b in bits) for n in range(NEAR + 1) for bits in combinations(range(_WIDTH), n)], np.int64)


def _block(fps: np.ndarray, b: int) -> np.ndarray:
    return ((fps >> np.uint64(b * _WIDTH)) & np.uint64((1 << _WIDTH) - 1)).astype(np.int64)


def _spans(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, position) for lo[row] <= position < hi[row], in parts of about CHUNK_PAIRS (one row's at least)."""
    n = hi - lo
    rows = np.flatnonzero(n)
    cut = np.searchsorted(np.cumsum(n[rows]), np.arange(CHUNK_PAIRS, n.sum() + CHUNK_PAIRS, CHUNK_PAIRS))
    for part in np.split(rows, np.unique(cut + 1)):
        if len(part):
            m = n[part]
            yield np.repeat(part, m), np.repeat(lo[part] - (np.cumsum(m) - m), m) + np.arange(m.sum())


class ItemIndex:
    """Fingerprints of whole items in neighbouring blocks of bits, and those of their passages in order."""

    def __init__(self, ids: list, texts: list[str | None], table: ShingleTable) -> None:
        hashes = _Hashes()
        kept = [(i, h) for i, x in zip(ids, texts) if len(h := word_hashes(words(x), hashes)) >= WINDOW]
        self.ids = [i for i, _ in kept]
        self.words = [h for _, h in kept]
        self.flat = np.concatenate([np.zeros(0, np.uint64), *self.words])
        self.offsets = np.cumsum([0, *map(len, self.words)])
        self.shingles = [shingle_hashes(h) for h in self.words]
        weights = [table.weights(s) for s in self.shingles]
        self.bags = [np.unique(s, return_counts=True) for s in self.shingles]
        self.weight = np.array([w.sum() for w in weights], np.int64)
        k = PASSAGE
        whole, parts = [], []
        for s, w in zip(self.shingles, weights):
            sums = Sums(s, w)
            whole.append(sums.fingerprints(np.zeros(1, np.int64), len(s))[0])
            parts.append(sums.fingerprints(np.arange(len(s) - k + 1), k))
        self.fps = np.array(whole, np.uint64)
        self.size = np.array([len(s) for s in self.shingles], np.int64)
        self.sizes = np.unique(self.size)
        masks = _neighbours()
        self.tables = []
        for b in range(BLOCKS):  # (size, value of the block) within NEAR bits -> items
            key = ((np.searchsorted(self.sizes, self.size) << _WIDTH)[:, None] | (_block(self.fps, b)[:, None] ^ masks)).ravel()
            order = np.argsort(key, kind="stable")
            self.tables.append((key[order], (order // len(masks)).astype(np.int32)))
        # Passages: equal fingerprints lie side by side.
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        fps = join(parts, np.uint64)
        order = np.argsort(fps, kind="stable")
        self.passages = fps[order]
        self.item = join([np.full(len(s) - k + 1, i, np.int32) for i, s in enumerate(self.shingles)], np.int32)[order]
        self.at = join([np.arange(len(s) - k + 1, dtype=np.int32) for s in self.shingles], np.int32)[order]

    def within_radius(self, fps: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (position in fps, item of ``size`` shingles) whose fingerprints differ in RADIUS bits at most."""
        s = int(np.searchsorted(self.sizes, size))
        if s == len(self.sizes) or self.sizes[s] != size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = [np.zeros((0, 2), np.int64)]
        for b, (keys, items) in enumerate(self.tables):
            key = (s << _WIDTH) | _block(fps, b)
            for i, at in _spans(np.searchsorted(keys, key), np.searchsorted(keys, key, "right")):
                j = items[at]
                near = np.bitwise_count(fps[i] ^ self.fps[j]) <= RADIUS
                found.append(np.stack([i[near], j[near]], 1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def similarity(self, window: np.ndarray, j: int, table: ShingleTable) -> float:
        """Weighted Jaccard similarity of the shingles of a window and of item ``j``, each counted as often as it occurs."""
        a, n = np.unique(window, return_counts=True)
        both, x, y = np.intersect1d(a, self.bags[j][0], assume_unique=True, return_indices=True)
        shared = (table.weights(both) * np.minimum(n[x], self.bags[j][1][y])).sum()
        return float(shared / (table.weights(window).sum() + self.weight[j] - shared))


def _near_copies(index: ItemIndex, table: ShingleTable, s: np.ndarray, segment: np.ndarray, known: np.ndarray, sums: Sums, most: int, similarity: float) -> Iterator[tuple[int, int, float]]:
    """(start, item, similarity) of the item-sized windows from the first ``most`` words on that are similar enough."""
    for size in index.sizes.tolist():
        p = np.arange(min(len(s) - size + 1, most))
        p = p[(segment[p] == segment[p + size + SHINGLE - 2]) & (known[p + size] - known[p] >= similarity * (sums.whole[p + size] - sums.whole[p]) - 1e-6)]
        if len(p):
            i, j = index.within_radius(sums.fingerprints(p, size), size)
            for start, item in zip(p[i].tolist(), j.tolist()):
                x = index.similarity(s[start : start + size], item, table)
                if x >= similarity:
                    yield start, item, x


def _passages(index: ItemIndex, h: np.ndarray, s: np.ndarray, segment: np.ndarray, known: np.ndarray, sums: Sums, most: int) -> Iterator[np.ndarray]:
    """(item, first word - first word in the item, first word) of the passages from the first ``most`` words on, word for word."""
    k = PASSAGE
    p = np.arange(min(max(len(s) - k + 1, 0), most))
    p = p[(segment[p] == segment[p + WINDOW - 1]) & (known[p + k] - known[p] == k)]
    fps = sums.fingerprints(p, k)
    for i, at in _spans(np.searchsorted(index.passages, fps), np.searchsorted(index.passages, fps, "right")):
        item, place = index.item[at].astype(np.int64), index.at[at].astype(np.int64)
        same = np.ones(len(i), bool)
        for j in range(WINDOW):
            same &= h[p[i] + j] == index.flat[index.offsets[item] + place + j]
        yield np.stack([item, p[i] - place, p[i]], 1)[same]


def _leaks(index: ItemIndex, table: ShingleTable, docs: np.ndarray, lengths: np.ndarray, h: np.ndarray, similarity: float) -> list[tuple]:
    """(document, item, passages, similarity, longest run) of some segments; docs: the document of each of them."""
    out: dict[tuple[int, int], list] = {}
    if not len(index.ids):
        return []
    segment = np.repeat(np.arange(len(lengths)), lengths)
    shingles = shingle_hashes(h)
    reach = int(index.sizes[-1])
    hits = [np.zeros((0, 3), np.int64)]
    for at in range(0, len(shingles), CHUNK_WORDS):  # spans that overlap by a window
        s, own = shingles[at : at + CHUNK_WORDS + reach], segment[at : at + CHUNK_WORDS + reach + SHINGLE]
        code = table.known(s)
        inside = own[: len(s)] == own[SHINGLE - 1 : SHINGLE - 1 + len(s)]
        weight = np.concatenate([[0], np.cumsum(np.where(inside, code, 0).astype(np.int64))])
        known = np.concatenate([[0], np.cumsum((code > 0) & inside)])
        sums = Sums(s, np.where(code > 0, code, table.top).astype(np.int64))
        for start, item, x in _near_copies(index, table, s, own, weight, sums, CHUNK_WORDS, similarity):
            row = out.setdefault((int(docs[own[start]]), item), [0, None, 0])
            row[1] = max(row[1] or 0.0, x)
        hits += [x + np.array([0, at, at]) for x in _passages(index, h[at : at + CHUNK_WORDS + reach + SHINGLE], s, own, known, sums, CHUNK_WORDS)]
    x = np.concatenate(hits)
    x = x[np.lexsort((x[:, 2], x[:, 1], x[:, 0]))]
    new = np.ones(len(x), bool)  # whether a hit starts a run
    new[1:] = (x[1:, :2] != x[:-1, :2]).any(1) | (x[1:, 2] != x[:-1, 2] + 1) | (segment[x[1:, 2]] != segment[x[:-1, 2]])
    starts = np.flatnonzero(new)
    for d, item, n in zip(docs[segment[x[starts, 2]]].tolist(), x[starts, 0].tolist(), np.diff(np.append(starts, len(x))).tolist()):
        row = out.setdefault((d, item), [0, None, 0])
        row[0] += n
        row[2] = max(row[2], n + WINDOW - 1)
    return [(d, index.ids[j], *row) for (d, j), row in out.items()]


def stretches(table: ShingleTable, h: np.ndarray, doc: np.ndarray, reach: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words in which a window can lie, each within one document.

    doc: the document of each word; reach: words of the longest item.
    """
    s = shingle_hashes(h)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    known = np.concatenate([[0], np.cumsum((table.known(s) > 0) & (doc[: len(s)] == doc[SHINGLE - 1 :]))])
    p = np.arange(len(s))
    p = p[known[np.minimum(p + STRETCH, len(s))] - known[p] >= np.ceil(PASSAGE * similarity - 1e-6)]
    edge = np.flatnonzero(np.diff(doc, prepend=-1, append=doc[-1] + 1))  # first word of every document, and the end
    which = np.searchsorted(edge, p, "right")
    steps = np.zeros(len(h) + 1, np.int64)
    # A stretch that begins at the end of a document may be the next one's.
    np.add.at(steps, np.maximum(p - reach, edge[which - 1]), 1)
    np.add.at(steps, np.minimum(p + STRETCH + SHINGLE + reach, len(h)), -1)
    covered = np.cumsum(steps[:-1]) > 0
    first = covered & ((np.diff(covered, prepend=False)) | (np.diff(doc, prepend=-1) != 0))
    last = covered & ((~np.append(covered[1:], False)) | (np.diff(doc, append=doc[-1] + 1) != 0))
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def suspicious_stretches(documents: DataFrame, table, reach: int, similarity: float) -> DataFrame:
    """(doc_id, lengths, hashes): word hashes of the stretches of every document (doc_id, text) that may hold a window."""

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()

        def passed(ids: list, tokens: list[list[str]]) -> list[tuple]:
            h = word_hashes([w for t in tokens for w in t], hashes)
            doc = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
            first, end = stretches(table.value, h, doc, reach, similarity)
            of = doc[first]
            cuts = np.flatnonzero(np.diff(of, prepend=-1))
            return [(ids[of[a]], (end[a:b] - first[a:b]).tolist(), np.concatenate([h[x:y] for x, y in zip(first[a:b], end[a:b])]).tobytes()) for a, b in zip(cuts, np.append(cuts[1:], len(of)))]

        for part in parts:
            rows, ids, tokens, held = [], [], [], 0
            for d, x in zip(part["doc_id"].tolist(), part["text"].tolist()):
                ids.append(d)
                tokens.append(words(x) if isinstance(x, str) else [])
                held += len(tokens[-1])
                if held >= CHUNK_WORDS:
                    rows += passed(ids, tokens)
                    ids, tokens, held = [], [], 0
            rows += passed(ids, tokens) if held else []
            yield pd.DataFrame(rows, columns=["doc_id", "lengths", "hashes"]).astype({"doc_id": "Int64"})

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(scan, "doc_id bigint, lengths array<bigint>, hashes binary")


def _item_blocks(items: DataFrame) -> Iterator[list]:
    """Items (item_id, text) in blocks of bounded size."""
    chars, n = items.agg(F.sum(F.length("text")), F.count("*")).first()
    n_blocks = max(-(-(chars or 0) // BLOCK_CHARS), -(-n // BLOCK_ITEMS), 1)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    for b in range(n_blocks):
        yield items.filter(block == b).select(F.col("item_id").cast("bigint"), "text").collect()


def _table_of(items: DataFrame) -> tuple[ShingleTable, int]:
    """Table of the shingles of all items, and the words of the longest one."""
    hashes, n_items, longest = _Hashes(), 0, 0
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(TABLE_BITS, max(16, (16 * int(chars)).bit_length()))  # some hundred slots a word
    counts = np.zeros(1 << bits, np.uint32)
    for rows in _item_blocks(items):
        shingles = []
        for r in rows:
            h = word_hashes(words(r[1]), hashes)
            if len(h) >= WINDOW:
                longest, n_items = max(longest, len(h)), n_items + 1
                shingles.append(np.unique(shingle_hashes(h)))
        for s in shingles:
            counts[np.unique(ShingleTable.slots(s, bits))] += 1
    return ShingleTable(counts, n_items), longest


def find_leaks(documents: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document (doc_id, text) and item (item_id, text) that share a passage or are near copies.

    Gives doc_id, item_id, windows (passages found), similarity (that of the most similar item-sized
    window; null below the threshold) and longest_run (words in the same order; 0 without a passage).
    """
    spark = documents.sparkSession
    shingle_table, longest = _table_of(items)
    table = spark.sparkContext.broadcast(shingle_table)
    found_in = cut_lineage(suspicious_stretches(spread(documents.select("doc_id", "text")), table, longest, similarity))
    found = []
    for rows in _item_blocks(items):
        index = spark.sparkContext.broadcast(ItemIndex([r[0] for r in rows], [r[1] for r in rows], shingle_table))

        def search(parts: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for part in parts:
                ids, out = part["doc_id"].astype("Int64").tolist(), []
                docs, lengths, hashes, held = [], [], [], 0
                for d, (n, h) in enumerate(zip(part["lengths"], part["hashes"])):
                    docs += [d] * len(n)
                    lengths += list(n)
                    hashes.append(np.frombuffer(h, np.uint64))
                    held += len(hashes[-1])
                    if held >= CHUNK_WORDS or d + 1 == len(ids):
                        out += _leaks(index.value, table.value, np.array(docs), np.array(lengths), np.concatenate(hashes), similarity)
                        docs, lengths, hashes, held = [], [], [], 0
                rows = [(ids[d], *x) for d, *x in out]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "windows", "similarity", "longest_run"]).astype({"doc_id": "Int64", "item_id": "Int64", "similarity": "Float64"})

        found.append(found_in.mapInPandas(search, "doc_id bigint, item_id bigint, windows bigint, similarity double, longest_run int"))
    return reduce(DataFrame.unionAll, found)
