"""Unit tests of the engine's parts with values worked out by hand, and invariants of whole runs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from murkwater.functions import values
from murkwater.operators import allocate, dependencies, estimators, inject, pairs, profile, ranks, repair, scale, schema, validate
from murkwater.plans import derived, pipeline
from murkwater.sources import tables


def column(spark, xs, kind="double"):
    return spark.createDataFrame([(x,) for x in xs], f"v {kind}")


def fof(spark, counts):
    out = {}
    for c in counts:
        out[c] = out.get(c, 0) + 1
    return spark.createDataFrame([("v", i, f) for i, f in out.items()], "column string, i long, f long")


def test_moments_and_quantiles(spark):
    r = profile.moments(column(spark, [1.0, 2.0, 2.0, 9.0, 4.0]), ["v"]).first()
    assert (r.skew, r.kurt, r["var"]) == pytest.approx((1.6607968306529903, 2.711848430577813, 10.3))
    q = profile.quantiles(column(spark, [1.0, 2.0, 2.0, 9.0, 4.0]), ["v"]).first()
    assert (q.q25, q.q50, q.q75) == (2, 2, 4)
    m = profile.plotting_quantiles(column(spark, [float(i) for i in range(1, 2411)] * 2), ["v"]).first()
    assert (m.q25, m.q50, m.q75) == pytest.approx((603.0, 1205.5, 1808.0))
    flat = profile.moments(column(spark, [3.0, 3.0, 3.0, 3.0]), ["v"]).first()
    assert flat.skew is None and flat.kurt is None
    assert profile.moments(column(spark, [1.0, float("nan"), None]), ["v"]).first().mean == 1.0
    assert profile.moments(column(spark, []), ["v"]).first().n == 0


def test_modes_and_distincts(spark):
    df = column(spark, ["a", "a", "b", "b", None, None, None], "string")
    assert sorted(r.value for r in profile.modes(df, ["v"]).collect()) == ["a", "b"]
    r = profile.distinct_counts(df, ["v"]).first()
    assert (r.distinct_excl_null, r.distinct_incl_null) == (2, 3)


@pytest.mark.parametrize(("counts", "want"), [([1] * 100, 200), ([10] * 10, 10), ([127], 1)])
def test_estimators(spark, counts, want):
    assert estimators.estimates(fof(spark, counts), 2.0).first().estimate == want
    assert estimators.estimates(fof(spark, counts), 2.0, compat=True).first().estimate == want


def test_estimator_variants_differ(spark):
    counts = [50, 20, 5, 5, 1, 1, 1, 1, 1, 1]
    new, old = estimators.estimates(fof(spark, counts), 2.0).first(), estimators.estimates(fof(spark, counts), 2.0, compat=True).first()
    assert new.shlosser == old.shlosser == 16
    assert old.haas_stokes == 10 and new.haas_stokes != 10


def test_numbers_in_text(spark):
    rows = column(spark, ["1", " -2.5e3 ", "1d", "abc", "", "NaN", None, "+.5", "1.", "0x1"], "string")
    assert [r[0] for r in rows.select(values.number(F.col("v"))).collect()] == [1.0, -2500.0, None, None, None, None, None, 0.5, 1.0, None]
    flags = [r[0] for r in rows.select(values.missing_text(F.col("v"))).collect()]
    assert flags == [False, False, False, False, True, True, True, False, False, False]
    kept = column(spark, ["", "x"], "string").select(values.missing_text(F.col("v"), blank_is_missing=False))
    assert [r[0] for r in kept.collect()] == [False, False]


def test_jaccard(spark):
    df = spark.createDataFrame([("abc", "bcd"), ("", ""), ("aa", "a")], "a string, b string")
    assert [r[0] for r in df.select(values.jaccard(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, 1.0]


def test_schema_of_short_and_mixed_tables(spark):
    df = spark.createDataFrame([(1, "1.5", "x", True), (2, "2", "1", False), (3, "2.5", None, True)], "k long, a string, b string, c boolean")
    got = {r["column"]: (r.kind, r.parse_kind) for r in schema.infer(df, ["k"]).collect()}
    assert got == {"k": ("int", "float"), "a": ("float", "float"), "b": ("str", "str"), "c": ("int", "float")}


def test_classes(spark):
    rows = [(i, float(i % 10), "red" if i % 2 else "blue", f"n{i}", float(i % 10), "red" if i % 2 else "blue", f"n{i}") for i in range(40)]
    change = lambda i, **x: rows.__setitem__(i, tuple(x.get(n, v) for n, v in zip(("k", "a", "b", "c", "ad", "bd", "cd"), rows[i], strict=True)))
    change(0, ad=None)
    change(1, ad=-9999.0)
    change(2, ad=500.0)
    change(3, ad=3.5)
    change(4, ad=5.0)
    change(5, bd="blue")
    change(6, bd="blu")
    change(7, bd="NA")
    change(8, bd="n8", cd="blue")
    df = spark.createDataFrame(rows, "k long, a double, b string, c string, a__dirty double, b__dirty string, c__dirty string")
    cells = {(r.k, r.col): (r.error_class, r.typo) for r in pairs.classify(df, ["k"], {"a": "num", "b": "str", "c": "str"}).collect()}
    assert cells == {
        (0, "a"): ("MV", False), (1, "a"): ("MV", False), (2, "a"): ("OUTLIER", False), (3, "a"): ("RESIDUAL", False), (4, "a"): ("REPLACEMENT", False),
        (5, "b"): ("REPLACEMENT", False), (6, "b"): ("TYPO", True), (7, "b"): ("MV", True), (8, "b"): ("SWAP", False), (8, "c"): ("SWAP", False),
    }
    strict = pairs.classify(df, ["k"], {"b": "str"}, strict=True).where("typo").count()
    assert strict == pairs.classify(df, ["k"], {"b": "str"}).where("typo").count() - 1
    assert pairs.classify(df.limit(0), ["k"], {"a": "num", "b": "str"}).collect() == []


def test_ranks_are_dense(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    got = sorted(r["rank"] for r in ranks.ranked(df, ranks.hashed(1, F.col("id"))).collect())
    assert got == list(range(1000))
    by = {}
    for r in ranks.ranked(df, ranks.hashed(1, F.col("id")), ["g"]).collect():
        by.setdefault(r.g, []).append(r["rank"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


@pytest.mark.parametrize("factor", [0.4, 1, 2, 2.5, 3.75])
def test_scaled_ids_are_dense(spark, factor):
    out = scale.replicate(spark.range(101).withColumnRenamed("id", "k"), ["k"], factor)
    assert sorted(r._row_id for r in out.collect()) == list(range(scale.rounded(101, factor)))


def test_rounding_is_half_even(spark):
    assert [scale.rounded(n, 0.5) for n in (1, 3, 5, 7)] == [0, 2, 2, 4]
    assert [r[0] for r in spark.range(1, 8, 2).select(allocate.new_count(F.col("id"), 0.5)).collect()] == [0, 2, 2, 4]
    assert scale.strategy(100, 1.5) == "hash" and scale.strategy(100, 2) == scale.strategy(9000, 1.5) == "replicate"


def test_allocation_is_exact(spark):
    h = spark.createDataFrame([("c", f"v{i}", n) for i, n in enumerate([7, 1, 1, 3, 20])] + [("d", "x", 5)], "col string, value string, n long")
    total = spark.createDataFrame([("c", 97), ("d", 11)], "col string, total long")
    got = allocate.allocate(h, total, ["col"])
    assert {r.col: r.s for r in got.groupBy("col").agg(F.sum("planned").alias("s")).collect()} == {"c": 97, "d": 11}


def test_outliers_balance(spark):
    fence = pairs.Fences((0.0, 10.0), (-5.0, 15.0), (1.0, 9.0))
    rows = [inject.outlier_row("a", 100, 30, 5.0, 5.0, fence), inject.outlier_row("b", 7, 4, 40.0, 5.0, fence, True), inject.outlier_row("c", 5, 1, 5.0, 5.0, fence)]
    made = inject.outliers(spark.createDataFrame(rows, inject.OUTLIERS), 1).collect()
    of = {c: [(float(r.value), r.planned) for r in made if r.col == c] for c in "abc"}
    assert {c: (len(x), sum(n for _, n in x)) for c, x in of.items()} == {"a": (30, 100), "b": (4, 7), "c": (1, 5)}
    assert all(v < -5 or v > 15 for x in of.values() for v, _ in x)
    assert len({v for v, _ in of["a"]}) == 30 and math.isclose(sum(v for v, _ in of["a"]) / 30, 5.0)
    assert all(v == int(v) for v, _ in of["b"]) and abs(sum(v for v, _ in of["b"]) / 4 - 40) <= 1
    assert inject.outliers(spark.createDataFrame([], inject.OUTLIERS), 1).collect() == []


def test_typos_differ_from_their_source(spark):
    words = {"a": 1, "ab": 1, "hello": 2, "aaaa": 2, "eleven chars": 3}
    df = spark.createDataFrame([(w, k) for w in words for k in range(40)], "w string, k int")
    rows = df.select("w", inject.typo(F.col("w"), F.col("k")).alias("t")).collect()
    assert all(abs(len(r.t) - len(r.w)) <= words[r.w] for r in rows)
    assert sum(r.t != r.w for r in rows) >= 0.97 * len(rows)  # two exchanges can undo each other
    assert all(r.t[0] == "a" and len(r.t) == 2 for r in rows if r.w == "a")
    assert all(len({r.t for r in rows if r.w == w}) > 20 for w in words)


def test_null_is_a_value_that_can_be_injected(spark):
    scaled = spark.createDataFrame([(0, 1.0, "x"), (1, 2.0, "y")], "_row_id long, a double, b string")
    edits = spark.createDataFrame([(0, "a", None, "MV"), (1, "b", "z", "TYPO")], "_row_id long, col string, value string, error_class string")
    got = {r._row_id: (r.a__dirty, r.b__dirty) for r in inject.apply(scaled, edits, ["a", "b"]).collect()}
    assert got == {0: (None, "x"), 1: (2.0, "z")}


@pytest.mark.parametrize("factor", [1, 1.5, 2, 3])
def test_runs_keep_the_error_profile(spark, sf, factor):
    run = pipeline.run(derived.orders(spark, sf), ["o_orderkey"], derived.ORDERS_KINDS, factor)
    edits = run.edits.groupBy("_row_id", "col").count()
    assert edits.where("count > 1").isEmpty()
    failed = run.validation.where("check like 'count_%' and passed = false").collect()
    assert failed == []


def test_fraction_below_one_only_cuts(spark, sf):
    run = pipeline.run(derived.orders(spark, sf), ["o_orderkey"], derived.ORDERS_KINDS, 0.5)
    assert run.generated.count() == derived.orders(spark, sf).count() // 2 and run.edits.isEmpty()


def test_swaps_go_both_ways(spark, sf):
    run = pipeline.run(derived.customer(spark, sf), ["c_custkey"], derived.CUSTOMER_KINDS, 2)
    swapped = run.generated.where("c_name <> c_name__dirty and c_name__dirty = c_mktsegment")
    assert swapped.count() > 0 and swapped.where("c_mktsegment__dirty <> c_name").isEmpty()


def test_dependencies(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, "b", 3), (2, "c", 4), (None, "d", 5)], "x int, y string, z int")
    got = {(r.lhs, r.rhs): (r.confidence, r.exact) for r in dependencies.confidences(df, [("x", "y"), ("y", "x")]).collect()}
    assert got[("x", "y")] == (0.8, False) and got[("y", "x")][1]
    (tmp_path / "fds.txt").write_text("0->1,2\n1 -> 0\nnonsense\n9->1\n")
    assert sorted(map(tuple, tables.read_dependencies(spark, str(tmp_path / "fds.txt"), ["x", "y", "z"]).collect())) == [("x", "y"), ("x", "z"), ("y", "x")]
    (tmp_path / "fds.json").write_text('{"fds": [{"key": ["x"], "value": ["y", "z"]}]}')
    assert sorted(map(tuple, tables.read_dependencies_json(spark, str(tmp_path / "fds.json")).collect())) == [("x", "y"), ("x", "z")]


def test_plan_and_logs(spark, tmp_path):
    (tmp_path / "plan.json").write_text('{"transformations": [{"t_type": "OUTLIER", "type": "from_iqr", "col": "a", "num_outliers": 3}, {"t_type": "SWAP_BETWEEN_COLS", "col1": "a", "col2": "b"}]}')
    assert [(r.t_type, r.num_outliers, r.col2) for r in tables.read_error_plan(spark, str(tmp_path / "plan.json")).collect()] == [("OUTLIER", 3, None), ("SWAP_BETWEEN_COLS", None, "b")]
    (tmp_path / "run.log").write_text("x\nMean original dirty: 1.5\nMean original dirty: 2e3\n")
    assert sorted(r.amount for r in tables.read_metric_log(spark, str(tmp_path / "run.log"), "Mean original dirty").collect()) == [1.5, 2000.0]


def test_csv_quotes_commas_and_lines(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "x"'), ("line\nbreak", "z")], "p string, q string")
    tables.write_csv(df, str(tmp_path / "t"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "t"), schema=df.schema, multi_line=True).collect())) == sorted(map(tuple, df.collect()))


def test_repairs(spark):
    df = column(spark, [1.0, 2.0, None, 2.0, 100.0])
    assert sorted(r.v for r in repair.impute(df, "v", "mode", F.col("v").isNull()).collect()) == [1, 2, 2, 2, 100]
    assert repair.impute(column(spark, [None]), "v", "mean", F.col("v").isNull()).first().v is None
    assert [r.v for r in repair.cap(df, "v", 1.5, 50.0).collect()] == [1.5, 2.0, None, 2.0, 50.0]
    near = {r.value: (r.nearest, r.distance) for r in repair.nearest_others(column(spark, [1.0, 4.0, 4.0, 6.0, 100.0, None]), "v", 3).collect()}
    assert near == {1.0: (4.0, 3.0), 4.0: (6.0, 2.0), 6.0: (4.0, 2.0), 100.0: (6.0, 94.0)}
    assert repair.nearest_others(column(spark, [5.0]), "v").first().nearest is None


def test_validation_flags_what_is_off(spark):
    a = spark.createDataFrame([("c", "SWAP", 4), ("c", "REPLACEMENT", 100), ("c", "MV", 5)], "col string, error_class string, n long")
    b = spark.createDataFrame([("c", "SWAP", 9), ("c", "REPLACEMENT", 215), ("c", "TYPO", 1)], "col string, error_class string, n long")
    got = {r.check: r.passed for r in validate.counts(a, b, 2).collect()}
    assert got == {"count_swap": False, "count_replacement": True, "count_mv": False, "count_typo": True}


@pytest.mark.parametrize(("sketch", "held"), [(10_000, 50_000), (50, 40), (10, 5)])
def test_quartiles_narrow_down_to_exact_ones(spark, monkeypatch, sketch, held):
    """Rough sketches and small ranges, so that ranges are narrowed several times and missed ranks are found again."""
    monkeypatch.setattr(profile, "SKETCH", sketch)
    monkeypatch.setattr(profile, "SORTED", held)
    monkeypatch.setattr(profile, "FEW", held)
    rng = np.random.default_rng(sketch)
    n = 2003
    data = pd.DataFrame({"u": rng.normal(size=n), "ties": rng.integers(0, 4, n) * 1.0, "two": (np.arange(n) < n // 4 + 1) * 1.0, "one": 7.0, "far": np.where(np.arange(n) % 2, 1e300, -1e300), "some": np.where(np.arange(n) < 3, np.arange(n) * 1.0, np.nan)})
    df = spark.createDataFrame(data).withColumn("none", F.lit(None).cast("double")).repartition(3)
    columns = [*data.columns, "none"]
    got = {r["column"]: (r.q25, r.q50, r.q75) for r in profile.quantiles(df, columns).collect()}
    assert got.pop("none") == (None, None, None)
    for c, quartiles in got.items():
        assert quartiles == pytest.approx(tuple(data[c].quantile([0.25, 0.5, 0.75])))


def test_equal_counts_and_common_prefixes_spread_over_buckets(spark):
    """20,000 values of one count and one prefix: shares and intervals are exact, and no bucket holds many of them."""
    h = spark.range(20_000).selectExpr("'c' as col", "concat('Customer#', lpad(id, 9, '0')) as value", "1L as n")
    total = spark.createDataFrame([("c", 30_011)], "col string, total long")
    plan = allocate.allocate(h, total, ["col"])
    counts = {r.planned: r.k for r in plan.groupBy("planned").agg(F.count("*").alias("k")).collect()}
    assert counts == {1: 9_989, 2: 10_011}
    cut = allocate.intervals(plan, ["col"], ["value"]).select("lo", "hi").orderBy("lo").collect()
    assert cut[0].lo == 0 and cut[-1].hi == 30_011 and all(a.hi == b.lo for a, b in zip(cut, cut[1:], strict=False))
    buckets = h.groupBy(F.substring(allocate._digest("value"), 1, ranks.digits_for(spark))).count().collect()
    assert len(buckets) >= 16 * 4 and max(r["count"] for r in buckets) < 20_000 / 64


@pytest.mark.parametrize("counts", [[1], [7], [1, 1, 2], [50, 20, 5, 5, 1, 1, 1, 1, 1, 1], [1, 3, 3, 400, 401, 900], [2, 2, 2, 5]])
def test_compat_estimates_step_over_gaps(spark, counts):
    """Gaps between frequencies are closed by powers; here each step is taken."""
    q, d, n, f = 0.5, len(counts), sum(counts), {c: counts.count(c) for c in counts}
    base = 1 - (1 - q) * f.get(1, 0) / n
    duj1 = d / base if base else d
    gamma = 0.0
    for k in range(1, max(counts)):
        gamma = (gamma + k * (k - 1) * f.get(k, 0)) * duj1 / (n * n) + duj1 / (2 * n) - 1
    gamma = max(0.0, gamma)
    below = {i: x for i, x in f.items() if i < max(counts)}
    a, b = sum(i * q * q * (1 - q * q) ** (i - 1) * x for i, x in below.items()), sum(((1 - q * q) ** i - (1 - q) ** i) * x for i, x in below.items())
    c, e = sum((1 - q) ** i * x for i, x in below.items()), sum(i * q * (1 - q) ** (i - 1) * x for i, x in below.items())
    small = (d - (1 - q) * f.get(1, 0) * math.log(1 - q) * gamma / q) / base if base else d
    large = d + f.get(1, 0) * a / b * (c / e) ** 2 if b and e else d
    assert estimators.estimates(fof(spark, counts), 2.0, compat=True).first().haas_stokes == math.floor(small if gamma < 0.9 else large)


def test_compat_estimates_of_a_very_frequent_value(spark):
    rows = spark.createDataFrame([("v", 1, 3), ("v", 10**12, 1), ("v", 10**15, 1)], "column string, i long, f long")
    assert estimators.estimates(rows, 2.0, compat=True).first().d == 5


def test_compat_estimates_beyond_products_of_long_numbers(spark):
    """Ten values so frequent that i * (i - 1) is beyond 2^63 count in the sums as they should."""
    rows = [(1, 5), (4 * 10**9, 10), (4 * 10**9 + 1, 1)]
    d, n = 16, sum(i * f for i, f in rows)
    base = 1 - 0.5 * 5 / n
    ratio, more = d / base / n / n, d / base / (2 * n) - 1
    settled = more / (1 - ratio)  # in the gap each step leaves next to nothing of the sum before
    gamma = (settled + 10 * 4e9 * (4e9 - 1)) * ratio + more
    assert 0.3 < gamma < 0.9
    small = (d - 0.5 * 5 * math.log(0.5) * gamma / 0.5) / base
    frequencies = spark.createDataFrame([("v", i, f) for i, f in rows], "column string, i long, f long")
    assert math.floor(small) > d and estimators.estimates(frequencies, 2.0, compat=True).first().haas_stokes == math.floor(small)
