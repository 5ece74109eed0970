"""Discovery of dependencies against brute force, and what breaks them."""

import itertools
import random

import pytest

from murkwater.operators import dependencies, inject, pairs
from murkwater.plans import pipeline


def brute(rows, columns, most):
    count = lambda s: len({tuple(r[i] for i in s) for r in rows})
    held = [(s, a) for k in range(most + 1) for s in itertools.combinations(range(len(columns)), k) for a in range(len(columns)) if a not in s and count(s) == count((*s, a))]
    least = [(s, a) for s, a in held if not any(b == a and set(t) < set(s) for t, b in held)]
    return sorted((tuple(columns[i] for i in s), columns[a]) for s, a in least)


@pytest.mark.parametrize("seed", range(12))
def test_lattice_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    columns = list("abcde")
    n, wide = rng.choice([1, 5, 20, 60]), rng.choice([1, 2, 4, 30])
    rows = []
    for _ in range(n):
        a, b = rng.randrange(wide), rng.choice([None, *range(wide)])
        rows.append((a, b, (a * 7 + (b or 0)) % 5 if seed % 3 else rng.randrange(3), None if seed % 4 == 0 else a % 2, rng.randrange(wide * 2)))
    rows += rows[: n // 3]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, e int")
    assert sorted(dependencies.lattice(df, columns, 3)) == brute(rows, columns, 3)
    assert sorted(dependencies.lattice(df, columns, 1)) == brute(rows, columns, 1)


def test_lattice_of_an_empty_table_and_of_one_column(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert dependencies.lattice(df, ["a", "b"]) == [((), "a"), ((), "b")]
    assert dependencies.lattice(spark.createDataFrame([(1,), (2,)], "a int"), ["a"]) == []


def test_a_level_is_one_shuffle_of_rows(spark):
    df = spark.range(1000).selectExpr("id % 7 as a", "id % 5 as b", "id % 3 as c")
    plan = dependencies.group_counts(df, [("a", "b"), ("a", "c"), ("b", "c")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # of groups, and of their counts
    assert {r["columns"]: r["n"] for r in dependencies.group_counts(df, [("a", "b"), ("c",)]).collect()} == {"a,b": 35, "c": 3}


def test_composite_confidence_tells_null_from_text(spark):
    df = spark.createDataFrame([("x", None, 1), ("x", "null", 2), ("x", None, 1), ("y", "a", 1), ("y", "a", 2)], "a string, b string, c int")
    got = {(r.lhs, r.rhs): (round(r.confidence, 6), r.exact) for r in dependencies.confidences(df, [(("a", "b"), "c"), ("a", "c")]).collect()}
    assert got == {("a,b", "c"): (0.8, False), ("a", "c"): (0.6, False)}


def pair_of(spark):
    """Groups of one to twelve rows; every fifth group has a row with another group's value, one a misspelling, one a missing value."""
    rows, k = [], 0
    for g in range(40):
        for i in range(1 + g % 12):
            value = f"v{g}"
            dirty = f"v{(g + 1) % 40}" if g % 5 == 4 and i == 0 else None if g == 7 and i == 1 else "v7y" if g == 7 and i == 2 else value
            rows.append((k, g, value, g, dirty))
            k += 1
    return spark.createDataFrame(rows, "id long, g long, v string, g__dirty long, v__dirty string"), rows


def test_cells_that_break_a_dependency(spark):
    pair, rows = pair_of(spark)
    cells = pairs.classify(pair, ["id"], {"g": "num", "v": "str"}, dependencies=[("g", "v")])
    got = {r.id: r.error_class for r in cells.collect()}
    size = {g: sum(r[1] == g for r in rows) for g in range(40)}
    want = {}
    for i, g, v, _, d in rows:
        if v != d:
            # in a group of two the least value counts as the most frequent one, in a group of one there is no conflict
            kept = size[g] > 2 or (size[g] == 2 and v < d)
            want[i] = "MV" if d is None else "TYPO" if d == "v7y" else "FD" if kept else "REPLACEMENT"
    assert got == want
    plain = {r.id: r.error_class for r in pairs.classify(pair, ["id"], {"g": "num", "v": "str"}).collect()}
    assert plain == {i: "REPLACEMENT" if c == "FD" else c for i, c in want.items()}


def test_a_run_breaks_as_many_groups_and_keeps_the_others(spark):
    pair, _ = pair_of(spark)
    kinds = {"g": "num", "v": "str"}
    run = pipeline.run(pair, ["id"], kinds, 3, dependencies=[("g", "v")])
    again = pairs.classify(run.generated, ["_row_id"], kinds, dependencies=[("g", "v")])
    groups = lambda cells: {(r.lhs, r.x): r.n for r in pairs.histogram(cells, "fd").groupBy("lhs", "x").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    before, after = groups(run.cells), groups(again)
    assert before and {k: 3 * n for k, n in before.items()} == {k: after[k] for k in before}
    checks = {(r["check"], r["column"]): r.passed for r in run.validation.collect()}
    assert checks["count_fd", "v"] and checks["dependency", "g->v"]


def test_two_dependencies_edit_a_cell_once(spark):
    rows = spark.createDataFrame([(i, i % 3, i % 3, "w") for i in range(30)], "_row_id long, a long, b long, c string")
    plan = spark.createDataFrame([("a", "c", "0.0", "z", 10), ("b", "c", "0.0", "y", 10)], "lhs string, col string, x string, value string, n long")
    got = inject.broken(rows, {"a": "num", "b": "num", "c": "str"}, [("a", "c"), ("b", "c")], plan, 1, 5).collect()
    assert len(got) == 10 and {r.value for r in got} == {"z"}
