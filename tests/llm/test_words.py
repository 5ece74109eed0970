import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from murkwater.llm.shared import gathered, packed, unpacked
from murkwater.llm.words import gram_sets, grams, word_hashes, words

TEXT = st.text(alphabet=st.sampled_from("abAB é文\U0001f600 \t\n\x0b\x0c\r\x1c  "), max_size=30)


def plain(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=8), st.integers(1, 40))
def test_words_and_hashes(texts, block):
    w = words(pa.array(texts, pa.string()))
    found = [bytes(w.data[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)]
    assert [found[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)] == [plain(t) for t in texts]
    h = word_hashes(w, block=block)
    assert len(set(h.tolist())) == len(set(found))
    assert dict(zip(found, h.tolist(), strict=True)) == dict(zip(found, word_hashes(w).tolist(), strict=True))
    low = word_hashes(w, lower=True)
    assert len(set(low.tolist())) == len({re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in found})


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_gram_sets(texts):
    sets = gram_sets(pa.array(texts, pa.string()), 3)
    every = {}
    for t, s in zip(texts, sets, strict=True):
        w = plain(t)
        want = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
        assert len(s) == len(want) and (np.sort(s) == s).all()
        assert every.setdefault(frozenset(want), s.tobytes()) == s.tobytes()
    assert grams(np.array([1], np.uint64), 3).size == 0


def test_sliced_columns():
    column = pa.array(["a b", None, "c", "d e f"]).slice(1)
    w = words(column)
    assert w.first.tolist() == [0, 0, 1, 4]


def test_packing_round_trip():
    part = np.array([2, 0, 2, 1])
    lengths = np.array([1, 2, 0, 3])
    cols = packed(part, {"a": np.array([10, 20, 30, 40])}, lengths, {"x": np.array([1, 2, 3, 4, 5, 6])})
    batch = pa.RecordBatch.from_pydict(cols)
    back = unpacked([batch], {"a": np.int64, "x": np.int64})
    assert batch.column("part").to_pylist() == [0, 1, 2]
    assert back["a"].tolist() == [20, 40, 10, 30] and back["x"].tolist() == [2, 3, 4, 5, 6, 1]
    assert len(packed(part[:0], {"a": part[:0]})["part"]) == 0


def test_gathered_bounds_texts():
    batches = [pa.RecordBatch.from_pydict({"k": [i, -i], "text": ["x" * 40, "y" * 70]}) for i in range(1, 5)]
    tables = list(gathered(batches, 100))
    assert sum(t.num_rows for t in tables) == 8
    assert all(sum(len(x) for x in t["text"].to_pylist()) <= 110 for t in tables)
    assert [k for t in tables for k in t["k"].to_pylist()] == [k for b in batches for k in b.column("k").to_pylist()]
