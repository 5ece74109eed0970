import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from murkwater.llm import fingerprint


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_edited_texts_and_likeness(docs, texts):
    ids = sorted(texts)
    rows = {r.doc_id: r for r in fingerprint.edited_with_next(docs).collect()}
    assert sorted(rows) == ids
    prints = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs).collect()}
    off = 0
    for i, n in zip(ids, ids[1:] + ids[:1], strict=True):
        r, t, u = rows[i], texts[i] or "", texts[n] or ""
        assert r.n_chars == len(t)
        assert r.edited == t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert r.fingerprint == prints[i]
        a, b, c = shingles(t), shingles(r.edited), shingles(u)
        for got, x in ((r.near_edited, b), (r.near_next, c)):
            true = len(a & x) / len(a | x) if a | x else 1.0
            kept = max(1.0, len(a | x) / fingerprint.SCALE)  # half of the union's shingles, drawn without replacement
            assert got == pytest.approx(true, abs=5 * (true * (1 - true) / 2 / kept) ** 0.5 + 2.5 / kept)
            off += abs(got - true)
    assert off / len(ids) < 0.1
    assert rows[900_008].fingerprint == rows[900_009].fingerprint
    assert rows[900_008].near_next == 1.0


def test_string_round_trip_and_merge():
    import pyarrow as pa

    from murkwater.llm.words import gram_sets

    words = [f"w{i}" for i in range(3000)]
    whole, half, other = gram_sets(pa.array([" ".join(words), " ".join(words[:1500]), " ".join(words[1496:])]), 5)
    s = fingerprint.sketch(whole)
    assert (fingerprint.read_back(fingerprint.written_out(s)) == s).all()
    assert abs(len(s) - 1500) < 150
    assert fingerprint.likeness(s, fingerprint.sketch(half))[1] == 1.0  # containment of a much shorter text
    m = fingerprint.merged(fingerprint.written_out(fingerprint.sketch(half)), fingerprint.written_out(fingerprint.sketch(other)))
    assert m == fingerprint.written_out(s)


@given(st.sets(st.integers(0, 2**64 - 1), max_size=12), st.sets(st.integers(0, 2**64 - 1), max_size=12), st.integers(0, 63))
def test_merging_is_the_sketch_of_the_union(a, b, high):
    """Also of sets of which no hash is below the fraction."""
    a, b = ({x | (high & 1) << 63 for x in s} for s in (a, b))
    prints = [fingerprint.written_out(fingerprint.sketch(np.array(sorted(x), np.uint64))) for x in (a, b, a | b)]
    assert fingerprint.merged(*prints[:2]) == fingerprint.merged(prints[1], prints[0]) == prints[2]
    assert fingerprint.merged(prints[0], prints[0]) == prints[0]
    near, _ = fingerprint.likeness(*map(fingerprint.read_back, prints[:2]))
    assert 0 <= near <= 1 and (near == 1 if a == b else True) and (near == 0 if bool(a) != bool(b) else True)


def test_empty_single_ties_and_nulls(spark, empty):
    assert fingerprint.edited_with_next(empty).collect() == []
    one = fingerprint.edited_with_next(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).collect()
    assert [(r.edited, r.near_next) for r in one] == [("abcabc", 1.0)]
    rows = [(1, "bb"), (1, "aa"), (None, "zz"), (2, None), (1, "bb")]
    got = fingerprint.edited_with_next(spark.createDataFrame(rows, "doc_id long, text string")).orderBy(F.col("doc_id").asc_nulls_last(), "edited").collect()
    assert [(r.doc_id, r.edited) for r in got] == [(1, "ab"), (1, "b"), (1, "bb"), (2, ""), (None, "za")]


def test_excerpts_of_long_texts_are_contained():
    import pyarrow as pa

    from murkwater.llm.words import gram_sets

    words = [f"w{i}" for i in range(6000)]
    whole = fingerprint.sketch(gram_sets(pa.array([" ".join(words)]), 5)[0])
    for length in (20, 60, 132, 133, 200):
        parts = gram_sets(pa.array([" ".join(words[i : i + length]) for i in range(0, 5800, 7)]), 5)
        got = [fingerprint.likeness(fingerprint.sketch(x), whole)[1] for x in parts]
        assert set(got) <= {1.0, None} and got.count(None) <= 0.03 * len(got)
    short, empty = gram_sets(pa.array(["w1 w2 w3 w4 w5", ""]), 5)
    assert fingerprint.likeness(fingerprint.sketch(short), whole)[1] is None
    assert fingerprint.likeness(fingerprint.sketch(short), whole)[0] < 0.001
    assert fingerprint.likeness(fingerprint.sketch(empty), whole) == (0.0, 0.0)
    assert fingerprint.likeness(fingerprint.sketch(empty), fingerprint.sketch(empty)) == (1.0, 1.0)
    assert fingerprint.likeness(fingerprint.sketch(short), fingerprint.sketch(short)) == (1.0, 1.0)


def test_bounds_of_many_ranges(spark):
    firsts = list(range(0, 3000, 3))
    rows = fingerprint._dealt(spark.range(-5, 3100).withColumnRenamed("id", "key"), firsts).collect()
    assert all(r.bucket == max(1, min(len(firsts), r.key // 3 + 1)) and r["first"] == firsts[r.bucket - 1] for r in rows)
