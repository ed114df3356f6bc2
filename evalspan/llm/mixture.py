"""A mixture of sources with target shares of its tokens.

Sizes are tokens of a public tokenizer, counted over whole texts. Documents are spread over shards by
a seeded hash, more shards for larger sources, so that no task holds a source; within a shard they are
put in seeded order and cut into blocks of equal token numbers. The mixture's size is the largest that
all sources with documents can carry at their target shares (or a given one, if smaller). It is divided
into blocks by Sainte-Laguë apportionment: the next block goes to the source with the highest quotient
share / (2 k + 1), k being the blocks it has, until its capacity (tokens times repeats) is used up. The
quota of a source is divided among its shards in the same way, by their tokens. A shard then takes its
blocks in seeded order: full rounds of all blocks first, then single blocks until the quota is reached;
the last block is taken document by document.

Only figures per source and per shard go to the driver (a shard has about ``SHARD_TOKENS`` tokens, or a
third of a promille of the corpus if that is more, so there are a few thousand shards at most).

Defined results for odd input: null, empty texts have no tokens and are never chosen; documents without
a source, or of a source without target, are left out (reported with share 0); sources without documents
get none, and the shares of the others are scaled to 1; null or negative targets count as 0, null
repeats as 1; source names match without regard to case, blanks and the kind of hyphen; copies of
documents are documents; an empty corpus gives an empty mixture.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalspan.session import cut_lineage, spread

#: The pattern of the byte-level vocabulary files: a fixed value that belongs to them.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Blocks of the whole mixture, tokens of a shard at least, shards at most.
BLOCKS, SHARD_TOKENS, MAX_SHARDS = 10_000, 2_000_000, 3_000


def source_key(source: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(source), r"[\s_\-‐‑–]+", "_"))


def with_tokens(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds the number of tokens of ``text``; the vocabulary (a path on the driver, some 1 MB) is broadcast, executors need no file."""
    import base64

    with open(vocabulary, "rb") as f:
        ranks = documents.sparkSession.sparkContext.broadcast({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)})

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        encoding = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={})
        for part in parts:
            sizes = [len(encoding.encode_ordinary(x)) if isinstance(x, str) else 0 for x in part["text"]]
            yield part.drop(columns="text").assign(tokens=np.array(sizes, np.int64))

    kept = [f for f in documents.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", tokens bigint"
    return documents.mapInPandas(count, schema)


def sainte_lague(shares: list[float], caps: list[int], seats: int) -> list[int]:
    """Seats by highest quotients share / (2 k + 1), none above its cap; ties fall to the earlier one."""
    got = [0] * len(shares)
    heap = [(-share, i) for i, share in enumerate(shares) if share > 0 and caps[i] > 0]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-shares[i] / (2 * got[i] + 1), i))
    return got


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, blocks: int = BLOCKS, seed: int = 42, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """Chosen documents (doc_id, source, tokens, repeats) and the report of the sources.

    documents: (doc_id, source, text); targets: (source, target_share, max_repeats). The report has
    source, target_share, max_repeats, documents, tokens, quota, chosen_documents, chosen_tokens,
    actual_share.
    """
    spark = documents.sparkSession
    counted = with_tokens(spread(documents.select("doc_id", source_key(F.col("source")).alias("source"), "text")), vocabulary)
    counted = cut_lineage(counted.filter("tokens > 0"))  # tokens are dear; they are counted once
    wanted = [
        (r["source"], max(0.0, r["target_share"] or 0.0), max(0, 1 if r["max_repeats"] is None else r["max_repeats"]))
        for r in targets.groupBy(source_key(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).filter("source is not null").orderBy("source").collect()
    ]
    sizes = {r["source"]: (r["n"], r["t"]) for r in counted.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).filter(F.col("source").isin([s for s, *_ in wanted])).collect()}
    live = [(s, share, repeats) for s, share, repeats in wanted if s in sizes and share > 0 and repeats > 0]
    whole = sum(share for _, share, _ in live)
    largest = min((sizes[s][1] * repeats * whole / share for s, share, repeats in live), default=0)
    total = int(min(largest, total_tokens or largest))
    block = max(1, total // blocks)
    quota = dict(zip([s for s, *_ in live], sainte_lague([share for _, share, _ in live], [int(sizes[s][1] * r // block) for s, _, r in live], total // block)))

    all_tokens = sum(t for _, t in sizes.values())
    shard_tokens = max(SHARD_TOKENS, all_tokens // MAX_SHARDS)
    plan = [(s, quota[s], repeats, max(1, -(-sizes[s][1] // shard_tokens))) for s, _, repeats in live]
    n_shards = spark.createDataFrame(plan, "s string, quota bigint, max_repeats int, n_shards bigint")
    sharded = counted.join(F.broadcast(n_shards), F.col("source") == F.col("s")).select("doc_id", "source", "tokens", "max_repeats", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("n_shards")).alias("shard"))
    per_shard: dict[str, list[tuple[int, int]]] = {}
    for r in sharded.groupBy("source", "shard").agg(F.sum("tokens").alias("t")).collect():
        per_shard.setdefault(r["source"], []).append((r["shard"], r["t"]))
    rows = []
    for s, q, repeats, _ in plan:
        shards = sorted(per_shard[s])
        # A shard's quota in tokens; what its capacity cuts off in whole blocks is a fraction of a block.
        for (k, t), n in zip(shards, sainte_lague([t for _, t in shards], [-(-t * repeats // block) for _, t in shards], q)):
            rows.append((s, k, min(n * block, t * repeats), t))
    quotas = spark.createDataFrame(rows, "s string, k bigint, quota_tokens bigint, shard_tokens bigint")

    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id")
    cut = sharded.withColumn("block", F.floor((F.sum("tokens").over(order) - F.col("tokens")) / block))
    drawn = Window.partitionBy("source", "shard").orderBy(F.xxhash64("block", "shard", F.lit(seed + 2)), "block", F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id")
    met = cut.join(F.broadcast(quotas), (F.col("source") == F.col("s")) & (F.col("shard") == F.col("k")))
    rounds = F.floor(F.col("quota_tokens") / F.col("shard_tokens"))
    rest = F.col("quota_tokens") - rounds * F.col("shard_tokens")
    before = F.sum("tokens").over(drawn) - F.col("tokens")
    # A document is taken once more if its middle lies within the rest: the error is half a document at most.
    once_more = (before + F.col("tokens") / 2 <= rest) & (rounds < F.col("max_repeats"))
    chosen = met.select("doc_id", "source", "tokens", (rounds + once_more.cast("bigint")).cast("int").alias("repeats")).filter("repeats > 0")

    got = chosen.groupBy(F.col("source").alias("g")).agg(F.count("*").alias("chosen_documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("chosen_tokens"))
    names = [s for s, *_ in wanted]
    facts = spark.createDataFrame([(s, share, repeats, *sizes.get(s, (0, 0)), quota.get(s, 0) * block) for s, share, repeats in wanted], "source string, target_share double, max_repeats int, documents bigint, tokens bigint, quota bigint")
    other = counted.filter(F.col("source").isNull() | ~F.col("source").isin(names)).groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens")).select("source", F.lit(0.0).alias("target_share"), F.lit(0).alias("max_repeats"), "documents", "tokens", F.lit(0).cast("bigint").alias("quota"))
    joined = facts.unionByName(other).join(got, F.col("source") == F.col("g"), "left").drop("g").fillna(0, ["chosen_documents", "chosen_tokens"])
    every = got.agg(F.sum("chosen_tokens").alias("every"))  # one row
    report = joined.crossJoin(every).withColumn("actual_share", F.coalesce(F.col("chosen_tokens") / F.col("every"), F.lit(0.0))).drop("every")
    return chosen, report
