import random
import re

from murkwater.llm.substring import duplicate_factors, remove_duplicate_spans


def brute(rows, window=13):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        keep = [True] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                keep[j : j + window] = [False] * window
        out.append((i, len(w), len(w) - sum(keep), " ".join(x for x, k in zip(w, keep, strict=True) if k)))
    return sorted(out)


def result(docs, **more):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in remove_duplicate_spans(docs, **more).select("doc_id", "n_words", "n_removed", "text").collect())


def test_equals_brute_force(docs, texts):
    want = brute(texts.items())
    assert result(docs) == want
    assert result(docs, most_bytes=50_000) == want


def test_straddling_factors_and_repeats(spark):
    a, b = [f"a{i}" for i in range(20)], [f"b{i}" for i in range(20)]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(a + b)), (4, " ".join(a[10:] + b[:10])), (5, " ".join(a[10:] + b[:10])), (6, "x " * 40), (7, "x " * 13), (5, " ".join(b))]
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_empty_nulls_and_other_columns(spark, docs, empty):
    assert remove_duplicate_spans(empty).collect() == []
    out = remove_duplicate_spans(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "node", "part", "tag", "score", "spans", "bucket", "key", "n_words", "n_removed"]
    text = " ".join(f"k{i}" for i in range(15))
    got = remove_duplicate_spans(spark.createDataFrame([(None, text), (4, text), (4, text), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(0, 0, 0), (0, 15, 0), (4, 15, 0), (4, 15, 0)]


def test_factors_are_greedy_and_have_true_sources(spark):
    draw = random.Random(5)
    passages = [[f"p{k}w{i}" for i in range(draw.randint(8, 60))] for k in range(12)]
    rows = [(i, " ".join(w for k in draw.choices(range(12), k=6) for w in passages[k])) for i in range(60)] + [(99, "x " * 40), (100, "x " * 70)]
    words = {i: t.split() for i, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(docs) == brute(rows)
    for most in (8_000_000, 2_000):
        factors = duplicate_factors(docs, most_bytes=most).collect()
        covered = set()
        for f in factors:
            n = f.n + 12
            assert f.source < f.doc_id
            assert words[f.doc_id][f.start : f.start + n] == words[f.source][f.source_start : f.source_start + n]
            here = {(f.doc_id, j) for j in range(f.start, f.start + f.n)}
            assert covered.isdisjoint(here)
            covered |= here
        assert len({f.source for f in factors if f.doc_id == 59}) > 1
    whole = duplicate_factors(docs.coalesce(1)).where("doc_id = 100").collect()
    assert sorted((f.source, f.source_start, f.start, f.n) for f in whole) == [(99, 0, 0, 28), (99, 0, 28, 28), (99, 0, 56, 2)]


def test_texts_that_lose_nothing_may_stay_as_they_are(spark):
    text = " ".join(f"k{i}" for i in range(15))
    docs = spark.createDataFrame([(1, f" {text}\n"), (2, f"{text}  z"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in remove_duplicate_spans(docs, as_they_are=True).collect()} == {1: f" {text}\n", 2: "z", 3: ""}
