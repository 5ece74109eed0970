import collections
import re

import numpy as np

from murkwater.llm.components import components
from murkwater.llm.jaccard import Salts, jaccard_classes


def brute(texts, percent=80):
    sets, owners = {}, collections.defaultdict(list)
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        for g in sets[i]:
            owners[g].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j, both in collections.Counter(j for g in sets[i] for j in owners[g] if j < i).items():
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def result(docs):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_classes(docs).collect())


def test_equals_brute_force(docs, texts):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(docs).collect()} == brute(texts)


def test_chain_and_groups_of_near_copies(spark):
    rng = np.random.default_rng(1)
    base = [f"t{i}" for i in range(80)]
    rows, chain = [], list(base)
    for i in range(30):  # each links with the one before, the ends do not link
        rows.append((100 + i, " ".join(chain)))
        chain = chain[2:] + [f"c{i}a", f"c{i}b"]
    for i in range(60):  # star of near copies, some too far from it
        w = list(base)
        for k in rng.choice(80, rng.integers(0, 4), replace=False):
            w[k] = f"n{i}_{k}"
        rows.append((500 + i, " ".join(w)))
    want = brute(dict(rows))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == want


def test_empty_repeated_and_without_id(spark, empty):
    assert jaccard_classes(empty).collect() == []
    text = "a b c d e f g h"
    rows = [(7, text), (7, text), (None, text), (3, text + " i"), (None, "q"), (9, None)]
    got = result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == [(False, 3, 5, 3), (False, 7, 4, 3), (False, 7, 4, 3), (False, 9, 0, 9), (True, 0, 1, None), (True, 0, 4, 3)]


def test_a_key_of_most_rows_is_dealt(spark):
    from pyspark.sql import functions as F

    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("key"), F.col("id").alias("node"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("many"))
    salts = Salts(sizes, 3000, 8)
    assert salts.hot.count() == 1
    dealt = salts.dealt(rows)
    assert dealt.groupBy("key", "salt").count().agg(F.max("count")).first()[0] < 200
    assert dealt.join(salts.repeated(sizes), ["key", "salt"]).count() == 3000


def test_near_copies_of_one_text_and_sets_apart_in_one_key(spark):
    rng = np.random.default_rng(3)
    base = [f"s{i}" for i in range(60)]
    rows = []
    for i in range(400):  # most rows in the same keys: near copies, and some that share a part but do not link
        w = list(base)
        for k in rng.choice(60, 1 if i % 4 else rng.integers(2, 9), replace=False):
            w[k] = f"m{i}_{k}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute(dict(rows))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (None, 3), (200, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in [*range(41), 200]} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
