import collections
import math
import unicodedata
import zlib

import pytest
from pyspark.sql import functions as F

from murkwater.llm import langid


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    out = langid.identify(docs.select("doc_id", "text", "lang"), langid.fit(docs)).withColumn("out", langid.held_out(F.col("doc_id"))).collect()
    held = [r for r in out if r.out]
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_texts_do_not_mix(spark, sf, docs, texts):
    model = langid.fit(docs)
    one = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.identify(docs, model).collect()}
    two = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.identify(docs.select("doc_id", "text").repartition(7), model).collect()}
    assert one == two
    assert one[900_001] == one[900_002] == one[900_003] == ("und", 0.0)
    alone = langid.identify(docs.where("doc_id = 900012").select("doc_id", "text"), model).first()
    assert (alone.lang_pred, round(alone.score, 9)) == one[900_012]


def test_nothing_to_learn_from(docs, empty):
    model = langid.fit(empty)
    assert model.languages == []
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, model).collect()} == {("und", 0.0)}
    assert langid.identify(empty, model).collect() == []
    assert langid.identify(docs, model).columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score"]


def _buckets(text):
    """Buckets of the 1-, 2- and 3-grams of letters and word edges, one gram at a time."""
    m32 = 0xFFFFFFFF
    points = [32]
    for c in text.lower():
        if unicodedata.category(c)[0] == "L":
            points.append(ord(c))
        elif points[-1] != 32:
            points.append(32)
    if points[-1] != 32:
        points.append(32)

    def turned(x, n):
        return (x << n | x >> (32 - n)) & m32

    def spread(x, by):
        return ((x ^ x >> 15) * by) & m32

    out = []
    for i, p in enumerate(points):
        if p != 32:
            out.append(spread(p * 0x9E3779B1 & m32, 0x2C1B3C6D) >> 18)
    pairs = [spread((p * 0x9E3779B1 & m32) ^ turned(q * 0x85EBCA6B & m32, 3), 0x2C1B3C6D) for p, q in zip(points, points[1:])]
    out += [x >> 18 for x, p, q in zip(pairs, points, points[1:]) if p != 32 or q != 32]
    for i in range(len(points) - 2):
        if points[i + 1] != 32:
            out.append(spread(pairs[i] ^ turned(points[i + 2] * 0xC2B2AE35 & m32, 7), 0x297A2D39) >> 18)
    return out


def test_equals_plain_naive_bayes(docs):
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    learned = [(t, g) for i, t, g in rows if zlib.crc32(str(i).encode()) % 4 != 2 and t is not None and g is not None]
    known = sorted({g for _, g in learned})
    counts = {g: collections.Counter() for g in known}
    for t, g in learned:
        counts[g].update(_buckets(t))
    prior = collections.Counter(g for _, g in learned)
    total = {g: sum(counts[g].values()) + 0.5 * 2**langid.BITS for g in known}
    got = {r.doc_id: r for r in langid.identify(docs.select("doc_id", "text"), langid.fit(docs)).collect()}
    for i, t, _ in rows:
        b = collections.Counter(_buckets(t or ""))
        if not b:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        log = [math.log(prior[g] / len(learned)) + sum(n * math.log((counts[g][x] + 0.5) / total[g]) for x, n in b.items()) for g in known]
        best = max(log)
        assert got[i].lang_pred == known[log.index(best)]
        assert got[i].score == pytest.approx(1 / sum(math.exp(x - best) for x in log), abs=1e-3)


def test_ties_repeated_rows_and_bounds(spark):
    rows = [(i, t, g) for i in range(40) for t, g in (("abc abc", "bb"), ("abc abc", "aa"), ("xyz", "cc"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs.select("doc_id", "text"), langid.fit(docs)).collect()
    assert {(r.text, r.lang_pred) for r in got} == {("abc abc", "aa"), ("xyz", "cc")}
    assert len({(r.text, r.score) for r in got}) == 2 and len(got) == len(rows)
    assert langid.fit(docs, most_languages=3).languages == ["aa", "bb", "cc"]
    with pytest.raises(ValueError, match="languages"):
        langid.fit(docs, most_languages=2)
    few = langid.fit(docs, most_docs=5)
    assert few.languages == ["aa", "bb", "cc"]
