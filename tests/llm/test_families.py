"""Large families of near copies: what is counted, what meets, and that no link is lost."""

import random

import numpy as np
from pyspark.sql import functions as F
from test_groups import exact_groups

from framestack.llm import simhash


def test_counts_come_from_all_rows(spark):
    rows = spark.range(60_000).select(F.col("id").alias("key"), F.concat(F.lit("five words shared by all "), F.col("id")).alias("text"))
    table = simhash._counted(rows, 5).value
    shared = int(simhash.shingle_set("five words shared by all")[0])
    assert abs(int(table[shared >> 64 - simhash.COUNT_BITS]) - 8 * np.log2(60_000)) <= 0.5


def test_differing_parities_are_no_more_than_differing_shingles():
    pick = np.random.default_rng(4)
    for n in (1, 30, 500, 3000):
        a = np.unique(pick.integers(0, 1 << 63, n, np.uint64))
        b = np.unique(np.concatenate([a[n // 5 :], pick.integers(0, 1 << 63, n // 7, np.uint64)]))
        differ = int(np.bitwise_count(simhash.parities(a) ^ simhash.parities(b)).sum())
        assert differ <= len(np.setxor1d(a, b))


def test_a_large_family_meets_in_few_pairs(spark, monkeypatch):
    pick, words = random.Random(8), [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(900):
        own = list(words)
        for _ in range(pick.randrange(1, 9)):
            own[pick.randrange(len(own))] = f"x{pick.randrange(10**6)}"
        texts[i] = " ".join(own)
    held, stored = {}, simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, name: held.setdefault(name, stored(df, name)) if name == "rest" else stored(df, name))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs).collect()}
    assert got == exact_groups(texts)
    assert held["rest"].count() <= 20 * len(texts)
