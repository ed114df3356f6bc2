"""Seeded perturbations of texts and trees: one row in, several out.

Randomness comes from a hash of (seed, key, variant, position), so a row gives the same variants on any
partitioning and in any session. Null texts stay null.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import xxhash
from pyspark.sql import DataFrame


def typos(text: str, rate: float, rng: random.Random) -> str:
    """Neighbouring letters swapped at a rate."""
    out, i = list(text), 0
    while i < len(out) - 1:
        if out[i].isalpha() and out[i + 1].isalpha() and rng.random() < rate:
            out[i], out[i + 1] = out[i + 1], out[i]
            i += 1
        i += 1
    return "".join(out)


def case_changes(text: str, rate: float, rng: random.Random) -> str:
    return "".join(c.swapcase() if rng.random() < rate else c for c in text)


def extra_blanks(text: str, rate: float, rng: random.Random) -> str:
    return "".join(c + " " if c == " " and rng.random() < rate * 10 else c for c in text)


def punctuation(text: str, rate: float, rng: random.Random) -> str:
    return "".join("" if c in ".,;:!?" and rng.random() < rate * 10 else c for c in text)


def sentence_order(text: str, rate: float, rng: random.Random) -> str:
    """Inner sentences in another order; the first and the last stay."""
    parts = re.split(r"(?<=[.!?])\s+", text)
    inner = parts[1:-1]
    rng.shuffle(inner)
    return " ".join([*parts[:1], *inner, *parts[1:][-1:]])


def synonyms(table: dict[str, Sequence[str]]) -> Callable[[str, float, random.Random], str]:
    """Words of a table replaced at a rate; a capital stays."""

    def replace(text: str, rate: float, rng: random.Random) -> str:
        def one(m: re.Match) -> str:
            options = table.get(m[0].lower())
            if not options or rng.random() >= rate:
                return m[0]
            new = rng.choice(list(options))
            return new.capitalize() if m[0][0].isupper() else new

        return re.sub(r"\w+", one, text)

    return replace


PERTURBATIONS: dict[str, Callable[[str, float, random.Random], str]] = {"typos": typos, "case": case_changes, "blanks": extra_blanks, "punctuation": punctuation, "sentences": sentence_order}


def text_variants(df: DataFrame, key: str, text: str, kinds: Sequence[str], rate: float = 0.05, copies: int = 1, seed: int = 42, registry: dict | None = None) -> DataFrame:
    """(key, kind, copy, variant) for every kind of the registry."""
    table = {**PERTURBATIONS, **(registry or {})}
    chosen = {k: table[k] for k in kinds}

    def vary(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k, t in zip(part[key], part[text]):
                for kind, f in chosen.items():
                    for c in range(copies):
                        rng = random.Random(xxhash.xxh64_intdigest(f"{seed}|{k}|{kind}|{c}"))
                        rows.append((k, kind, c, f(t, rate, rng) if isinstance(t, str) else None))
            yield pd.DataFrame(rows, columns=[key, "kind", "copy", "variant"])

    return df.select(key, text).mapInPandas(vary, f"`{key}` {dict(df.dtypes)[key]}, kind string, copy int, variant string")


def pruned(nodes: DataFrame, tree: str, share: float, seed: int = 42) -> DataFrame:
    """Node table without a seeded share of the nodes below the root, each with its subtree."""
    from pyspark.sql import functions as F

    from evalspan.operators.trees import ancestors

    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(tree), F.col("node")), F.lit(10_000)) / 10_000
    cut = nodes.filter(F.col("parent").isNotNull() & (draw < share)).select(tree, F.col("node").alias("ancestor"))
    below = ancestors(nodes, tree).join(cut, [tree, "ancestor"]).select(tree, "node")
    gone = below.unionAll(cut.select(tree, F.col("ancestor").alias("node"))).distinct()
    return nodes.join(gone, [tree, "node"], "left_anti")
