"""Held-out accuracy of the reading levels: the labelled samples in folds, the lists from a corpus.

Run as a script on a data folder, it prints the figures of the README:
python tests/llm/test_level_accuracy.py /root/testdata/sf0.1
"""

import random
import sys

import numpy as np

from evalspan.llm import reading_level as R


def accuracy(familiar, samples, lists, folds=10, seed=1):
    """Share of the samples that a model fitted without their fold places rightly, and the share placed within one level."""
    order = list(range(len(samples)))
    random.Random(seed).shuffle(order)
    off = []
    for k in range(folds):
        held = set(order[k::folds])
        model = R.LevelModel(familiar, [samples[i] for i in order if i not in held], lists)
        for i in held:
            for _, alpha, length in R._english([samples[i][1]], 1):
                off.append(abs(int(model.levels(model.features(alpha)[None], np.array([length]))[0]) - samples[i][0]))
    return len(off), sum(x == 0 for x in off) / len(off), sum(x <= 1 for x in off) / len(off)


def measured(spark, folder):
    corpus = spark.read.parquet(f"{folder}/documents.parquet").select("text")
    familiar = R.familiar_words(R.document_frequencies(corpus, 60))
    samples = [(r.level, r.text) for r in spark.read.parquet(f"{folder}/level_samples.parquet").collect()]
    return {name: accuracy(familiar, samples, lists) for name, lists in (("graded", tuple(range(R.N_LISTS))), ("plain", R.PLAIN))}


def test_held_out_accuracy(spark):
    got = measured(spark, "/root/testdata/sf0.01")
    assert got["graded"][1] >= 0.9 and got["plain"][1] >= 0.4 and got["graded"][1] >= got["plain"][1]


def test_languages_without_a_list():
    dutch = "de kat zit op de mat en het is een mooie dag in de tuin van onze buren die vaak op reis zijn naar het noorden " * 5
    english = "the cat sat on the mat and it was a fine day in the garden of our neighbours who often travel to the north " * 5
    assert not R.is_english(dutch, dutch.split()) and R.is_english(english, english.split())


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    for name, figures in measured(session, sys.argv[1]).items():
        print(name, "samples, right, within one level:", figures)
