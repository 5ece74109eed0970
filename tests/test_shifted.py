"""Alignment without a key against a plain version."""

import random
from bisect import bisect_left
from collections import Counter
from itertools import combinations

import pytest

from murkwater.operators import shifted


def plain(clean, dirty):
    once = lambda xs: {x for x, n in Counter(xs).items() if n == 1}
    both = once(clean) & once(dirty)
    at = {x: i for i, x in enumerate(dirty)}
    marks = [(i, at[x]) for i, x in enumerate(clean) if x in both]
    tails, back, ends = [], [], []
    for i, (_, b) in enumerate(marks):
        k = bisect_left(tails, b)
        tails[k:k + 1] = [b]
        ends[k:k + 1] = [i]
        back.append(ends[k - 1] if k else -1)
    kept, i = [], ends[-1] if ends else -1
    while i >= 0:
        kept.append(marks[i])
        i = back[i]
    kept = [(-1, -1), *kept[::-1], (len(clean), len(dirty))]
    out = []
    for (a, b), (c, d) in zip(kept, kept[1:], strict=False):
        for o in range(max(c - a, d - b)):
            out.append((a + o if o < c - a else None, b + o if o < d - b else None))
    return sorted((p for p in out if p != (-1, -1)), key=str), len(kept) - 2


def result(spark, clean, dirty):
    frames = [spark.createDataFrame(list(enumerate(x)), "_row_id long, v string").repartition(3) for x in (clean, dirty)]
    return sorted((tuple(r) for r in shifted.places(*frames, ["v"]).collect()), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_rows_lost_added_and_changed(spark, monkeypatch, seed):
    monkeypatch.setattr(shifted, "BUCKET", 16)
    rng = random.Random(seed)
    clean = [f"r{i}" if rng.random() < 0.9 else f"same{rng.randrange(3)}" for i in range(300)]
    dirty = []
    for x in clean:
        k = rng.random()
        if k > 0.05:
            dirty.append(None if k > 0.97 else x + "!" if k > 0.9 else x)
        if k < 0.1:
            dirty.append(f"new{rng.random()}")
    assert result(spark, clean, dirty) == plain(clean, dirty)[0]


def test_moved_blocks(spark, monkeypatch):
    """Of blocks in another order the heaviest ascending sequence stays; where it is the only one, so are the pairs."""
    monkeypatch.setattr(shifted, "BUCKET", 8)
    clean = [f"r{i}" for i in range(100)]
    dirty = clean[40:50] + clean[:20] + ["x"] + clean[20:40] + clean[70:] + clean[50:70]
    assert result(spark, clean, dirty) == plain(clean, dirty)[0]


def test_nothing_in_common_repeats_and_empty_tables(spark):
    assert result(spark, ["a", "a", "b"], ["c", "c"]) == plain(["a", "a", "b"], ["c", "c"])[0]
    assert result(spark, [], ["c"]) == [(None, 0)] and result(spark, [], []) == []
    assert result(spark, ["a"] * 5, ["a"] * 3) == plain(["a"] * 5, ["a"] * 3)[0]


def test_heaviest_ascending_subsequence():
    rng = random.Random(4)
    for n in range(9):
        for _ in range(30):
            runs = list(zip(rng.sample(range(50), n), (rng.randint(1, 5) for _ in range(n)), strict=True))
            best = max((sum(runs[i][1] for i in s) for k in range(n + 1) for s in combinations(range(n), k) if all(runs[a][0] < runs[b][0] for a, b in zip(s, s[1:], strict=False))), default=0)
            got = shifted.heaviest(runs)
            assert sum(runs[i][1] for i in got) == best and all(runs[a][0] < runs[b][0] for a, b in zip(got, got[1:], strict=False))


def test_too_many_runs_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(shifted, "MOST_RUNS", 5)
    with pytest.raises(ValueError, match="key"):
        result(spark, [f"r{i}" for i in range(20)], [f"r{i}" for i in reversed(range(20))])


def test_aligned_pair(spark):
    clean = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "c", None)], "_row_id long, v string, n int")
    dirty = spark.createDataFrame([(0, "a", 1), (1, "c", None), (2, "d", 4)], "_row_id long, v string, n int")
    got = {(r.clean_at, r.dirty_at, r.v, r.v__dirty, r._side) for r in shifted.align(clean, dirty, ["v", "n"]).collect()}
    assert got == {(0, 0, "a", "a", "both"), (1, None, "b", None, "clean"), (2, 1, "c", "c", "both"), (None, 2, None, "d", "dirty")}
