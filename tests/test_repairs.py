"""Repairs by dependencies and by edit distance, pairs of flips and components, against plain versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from murkwater.operators import graph, pairs, repair


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize(("most", "q"), [(1, 2), (2, 2), (2, 3), (3, 2)])
def test_nearest_clean_equals_all_pairs(spark, most, q):
    rng = random.Random(10 * most + q)
    word = lambda n: "".join(rng.choice("ab" if rng.random() < 0.5 else "abcde\U0001f600") for _ in range(n))
    clean = {word(rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 9, 14])) for _ in range(120)} | {"", "aaaaaaaaaaaa", "abababababab", "a"}

    def edited(text):
        for _ in range(rng.randint(0, most + 1)):
            i = rng.randint(0, len(text))
            text = rng.choice([text[:i] + rng.choice("abz") + text[i:], text[:i] + text[i + 1 :], text[:i] + "z" + text[i + 1 :]])
        return text

    values = {edited(x) for x in clean} | {word(rng.randint(0, 9)) for _ in range(60)} | {"", "aaaaaaaaaaab", "bababababab"}
    want = {}
    for v in values:
        best = min((levenshtein(v, c), c.encode(), c) for c in clean)
        if best[0] <= most:
            want["x", v] = (best[2], best[0])
    want["y", "a"] = ("ab", 1)
    left = spark.createDataFrame([("x", v) for v in values] + [("x", "a"), ("x", "a"), ("x", None), ("y", "a"), ("none", "a")], "col string, value string")
    right = spark.createDataFrame([("x", c) for c in clean] + [("y", "ab"), ("y", None), ("x", None)], "col string, value string")
    want["x", "a"] = ("a", 0)
    assert {(r.col, r.value): (r.nearest, r.distance) for r in repair.nearest_clean(left, right, most, q).collect()} == want


def test_common_grams_join_nothing(spark):
    """All names share their first twelve characters; candidates come from the rare grams behind them."""
    clean = spark.range(3000).selectExpr("'x' as col", "concat('Customer#000', lpad(conv(id * 7919 % 46656, 10, 36), 4, '0')) as value")
    values = clean.where("hash(value) % 50 = 0").selectExpr("col", "replace(value, 'Cust', 'Cst') as value")
    got = repair.nearest_clean(values, clean, 1).collect()
    assert len(got) == values.distinct().count() and all(r.nearest == r.value.replace("Cst", "Cust") and r.distance == 1 for r in got)
    assert repair.nearest_clean(values.limit(0), clean).collect() == [] == repair.nearest_clean(values, clean.limit(0)).collect()


def test_few_texts_are_compared(spark, monkeypatch):
    """Names that are all taken share every gram with many others; values meet those alone that may be near."""
    compared = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(a, b, most):
        compared.add(1)
        return d if (d := levenshtein(a, b)) <= most else -1

    clean = spark.range(3000).selectExpr("'x' as col", "concat('Customer#', lpad(cast(id as string), 9, '0')) as value")
    typos = "array(concat(substring(value, 1, 15), substring(value, 17, 9)), concat('Cusotmer', substring(value, 9, 10)), concat('Cuqst', substring(value, 6, 13)))"
    values = clean.where("hash(value) % 50 = 0").selectExpr("col", f"explode({typos}) as value")
    all_pairs = values.crossJoin(clean.select(F.col("value").alias("c"))).groupBy("value").agg(F.min(F.struct(F.levenshtein("value", "c").alias("d"), "c")).alias("b"))
    wanted = {r.value: tuple(r.b) for r in all_pairs.collect()}
    monkeypatch.setattr(F, "levenshtein", lambda a, b, most: counted(a, b, F.lit(most)))
    assert {r.value: (r.distance, r.nearest) for r in repair.nearest_clean(values, clean).collect()} == wanted
    assert 0 < compared.value <= 10_000


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_common_keys_are_cut_finer(spark, monkeypatch, most):
    """Values that share a key with more texts than SHARED are looked for with more pieces, of which some texts have fewer characters; the rest is found before."""
    rng = random.Random(most)
    word = lambda n: "".join(rng.choice("ab\U0001f600") for _ in range(n))
    clean = {word(rng.randint(0, 5)) + word(1) * rng.randint(0, 30) for _ in range(150)} | {"far from all of them", "b" * 70}
    values = {word(rng.randint(0, 6)) + word(1) * rng.randint(0, 30) for _ in range(150)} | {"far from all f them", "b" * 35 + "a" + "b" * 34}
    best = {v: min((levenshtein(v, c), c.encode(), c) for c in clean) for v in values}
    finer, near = [], repair.near

    def watched(values, *args):
        if len(args) == 4:
            finer.append((values.count(), args[2], args[3]))
        return near(values, *args)

    monkeypatch.setattr(repair, "SHARED", (0, 2))
    monkeypatch.setattr(repair, "near", watched)
    got = repair.nearest_clean(*(spark.createDataFrame([("x", t) for t in side], "col string, value string") for side in (values, clean)), most)
    assert {r.value: (r.nearest, r.distance) for r in got.collect()} == {v: (c, d) for v, (d, _, c) in best.items() if d <= most}
    assert most < 2 or finer and all(0 < n < len(values) for n, *_ in finer)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(300)] + [(2000, i) for i in range(2001, 2300)] + [(5, 5), (None, 1), (1, None), (4000, 4000)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in graph.contracted(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got.keys() == parent.keys()
    classes = lambda of: {frozenset(x for x in got if of(x) == r) for r in {of(x) for x in got}}
    assert classes(got.get) == classes(find)
    assert graph.contracted(spark.createDataFrame([], "a int, b int")).collect() == []


def plain_repair(rows, dependencies, order, conflicts=True):
    """One union-find over left values for each column, then the most frequent value of each component."""
    rows = [dict(r) for r in rows]
    for b in order:
        lefts = [a for a, right in dependencies if right == b]
        parent = {}

        def find(x, parent=parent):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        mine = []
        for r in rows:
            nodes = [(a, tuple(r[c] for c in a)) for a in lefts if all(r[c] is not None for c in a)]
            mine.append(nodes)
            for x, y in zip(nodes, nodes[1:], strict=False):
                x, y = find(x), find(y)
                parent[max(x, y)] = min(x, y)
        votes = {}
        for r, nodes in zip(rows, mine, strict=True):
            if nodes and r[b] is not None:
                votes.setdefault(find(nodes[0]), Counter())[r[b]] += 1
        best = {k: min(v, key=lambda x: (-v[x], x)) for k, v in votes.items()}
        for r, nodes in zip(rows, mine, strict=True):
            if nodes and find(nodes[0]) in best and (conflicts or r[b] is None):
                r[b] = best[find(nodes[0])]
    return rows


@pytest.mark.parametrize("conflicts", [True, False])
def test_repair_by_dependencies(spark, conflicts):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        a = rng.choice([None, *(f"a{k}" for k in range(40))])
        g = int(a[1:]) if a else rng.randrange(40)
        maybe = lambda v: rng.choice([None, f"odd{rng.randrange(3)}", v, v, v, v])
        rows.append({"id": i, "a": a, "b": maybe(f"b{g // 3}"), "c": maybe(f"c{g // 6}"), "e": f"e{g // 2}", "d": maybe(f"d{g % 2}")})
    dependencies = [(("c",), "d"), (("a",), "b"), (("b",), "c"), (("e",), "c"), (("a", "e"), "d")]
    want = plain_repair(rows, dependencies, ["b", "c", "d"], conflicts)
    changed = {(r["id"], c): (r[c], w[c]) for r, w in zip(rows, want, strict=True) for c in "bcd" if r[c] != w[c]}
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, a string, b string, c string, e string, d string").selectExpr("*", "1 as root", "2 as node", "3 as n", "'x' as v")
    got = repair.by_dependencies(df, ["id"], [(x[0] if len(x) == 1 else x, y) for x, y in dependencies], conflicts)
    assert {(r.id, r.col): (r.was, r.value) for r in got.collect()} == changed


def test_order_of_dependencies():
    assert repair.in_order([("b", "c"), ("a", "b"), (("a", "c"), "d")]) == ["b", "c", "d"]
    with pytest.raises(ValueError, match="circle"):
        repair.in_order([("a", "b"), ("b", "a")])


def test_flips_of_unequal_and_hot_sides(spark):
    """A hot pair of values on one side only as often as the other side has it; a row's own swap and missing cells stay out."""
    rows = [(i, "a", "b") for i in range(900)] + [(1000 + i, "b", "a") for i in range(700)] + [(3000 + i, "c", "d") for i in range(5)] + [(4000, "e", "f"), (4001, "f", "e"), (4002, "f", "e"), (5000, "g", None), (5001, None, "g"), (6000, "h", "h")]
    pair = spark.createDataFrame([(i, c, d, "z", "z") for i, c, d in rows] + [(7000, "p", "q", "q", "p"), (7001, "q", "p", "z", "z")], "id long, v string, v__dirty string, w string, w__dirty string")
    got = pairs.flips(pairs.diff_cells(pair, ["id"], {"v": "str", "w": "str"}), ["id"]).collect()
    by = {i: (c, d) for i, c, d in rows}
    assert Counter((r.one, r.other) for r in got) == {("a", "b"): 700, ("e", "f"): 1}
    assert all(by[r.id] == (r.other, r.one) and by[r.id__other] == (r.one, r.other) for r in got)
    used = [x for r in got for x in (r.id, r.id__other)]
    assert len(used) == len(set(used))
