"""Recall of near copies against brute force: every item-sized window of every document, every item.

Run as a script on a data folder, it prints the figures of the README:
python tests/llm/test_leakage_recall.py /root/testdata/sf0.1
"""

import random
import sys

import numpy as np
import pyarrow.parquet as pq

from evalspan.llm import leakage
from evalspan.llm.words import words


def brute_force(docs, items):
    """{(document, item): best similarity} of all windows as long as an item whose weighted similarity reaches the threshold."""
    hashes = leakage._Hashes()
    shingles = lambda x: leakage.shingle_hashes(leakage.word_hashes(words(x), hashes)).tolist()
    of_item = {i: s for i, x in items if len(s := shingles(x)) >= leakage.PASSAGE}
    df = {}
    for s in of_item.values():
        for g in set(s):
            df[g] = df.get(g, 0) + 1
    by_count = {n: max(1, round(8 * float(np.log1p(len(of_item) / n)))) for n in {1, *df.values()}}
    weight = lambda g: by_count[df.get(g, 1)]
    whole = {i: sum(map(weight, s)) for i, s in of_item.items()}
    holders = {}
    for i, s in of_item.items():
        for g in set(s):
            holders.setdefault(g, []).append(i)
    found = {}
    for d, x in docs:
        s = shingles(x)
        for i in {i for g in set(s) for i in holders.get(g, ())}:  # without a shared shingle the similarity is 0
            item = of_item[i]
            m = len(item)
            want, have = {}, {}
            for g in item:
                want[g] = want.get(g, 0) + 1
            shared = total = 0
            for p, g in enumerate(s):
                have[g] = have.get(g, 0) + 1
                shared += weight(g) if have[g] <= want.get(g, 0) else 0
                total += weight(g)
                if p >= m:
                    old = s[p - m]
                    shared -= weight(old) if have[old] <= want.get(old, 0) else 0
                    total -= weight(old)
                    have[old] -= 1
                if p >= m - 1:
                    similarity = shared / (total + whole[i] - shared)
                    if similarity >= leakage.SIMILARITY:
                        found[d, i] = max(found.get((d, i), 0), similarity)
    return found


def operator(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r.similarity for r in leakage.find_leaks(d, t).filter("similarity is not null").collect()}


def planted(seed, n_items=100, n_docs=250):
    """Items of 14 to 200 words and documents with one of them, up to four of its words changed, left out or added."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [text(rng.randint(14, 200)) for _ in range(n_items)]
    docs = []
    for _ in range(n_docs):
        w = list(rng.choice(items))
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [w[k], rng.choice(vocabulary)]])
        docs.append(text(rng.randint(0, 150)) + w + text(rng.randint(0, 150)))
    return [(i, " ".join(x)) for i, x in enumerate(docs)], [(i, " ".join(x)) for i, x in enumerate(items)]


def compare(spark, docs, items):
    want, got = brute_force(docs, items), operator(spark, docs, items)
    # Two shingles in one slot of the table have a weight in common, so similarities may be off by a trifle.
    assert all(v <= want.get(k, leakage.SIMILARITY) + 0.01 for k, v in got.items())
    return len(got.keys() & want.keys()), len(want), sum(1 - 1e-9 > x for x in want.values())


def test_recall_of_near_copies(spark):
    found, there, changed = compare(spark, *planted(11))
    assert changed > 50 and found >= 0.9 * there


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    read = lambda name, key: [(r[key], r["text"]) for r in pq.read_table(f"{sys.argv[1]}/{name}.parquet", columns=[key, "text"]).to_pylist()]
    for seed in range(3):
        print("planted edits, seed", seed, "found, there, of them changed:", compare(session, *planted(seed)))
    print(sys.argv[1], "found, there, of them changed:", compare(session, read("documents", "doc_id"), read("eval_items", "item_id")))
