"""Profiles in batches, frequent values, tables in buckets, and slices, against plain versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from murkwater.operators import frequent, inject, profile, scale, sketches
from murkwater.plans import pipeline


def test_states_of_batches_equal_one_pass(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, rng.gauss(1e6, 3), float("nan")]), rng.choice([None, f"t{rng.randrange(3000)}"]), None) for i in range(9000)]
    df = spark.createDataFrame(rows, "id long, x double, t string, none double")
    columns = ["id", "x", "t", "none"]
    for batch, (lo, hi) in enumerate([(0, 10), (10, 4000), (4000, 4000), (4000, 9000)]):
        sketches.save(df.where((F.col("id") >= lo) & (F.col("id") < hi)), columns, str(tmp_path / "s"), batch)
    sketches.save(df.where("id < 10"), columns, str(tmp_path / "s"), 0)  # a batch that runs again
    many = {r["column"]: r for r in sketches.merged(sketches.load(spark, str(tmp_path / "s"))).collect()}
    one = {r["column"]: r for r in sketches.merged(sketches.states(df, columns)).collect()}
    for c in columns:
        assert [many[c][k] for k in ("n", "missing", "least", "most")] == [one[c][k] for k in ("n", "missing", "least", "most")]
        assert many[c].mean == (pytest.approx(one[c].mean) if one[c].mean else None) and many[c]["var"] == (pytest.approx(one[c]["var"], rel=1e-3) if one[c]["var"] else None)
    exact = profile.moments(df, ["id", "x"]).collect()
    assert all(many[r["column"]].mean == pytest.approx(r["mean"]) for r in exact)
    assert abs(many["t"].distinct_approx - len({r[2] for r in rows if r[2]})) <= 0.05 * 3000 and many["none"].n == 0 and many["none"].quantiles_approx is None
    assert all(abs(q - p * 9000) < 90 for q, p in zip(many["id"].quantiles_approx, (0.25, 0.5, 0.75), strict=True))


@pytest.mark.parametrize("share", [0.3, 0.05, 0.004])
def test_frequent_values(spark, share):
    rng = random.Random(int(share * 1000))
    n = 20_000
    data = {"skew": [f"v{int(rng.paretovariate(0.6))}" for _ in range(n)], "unique": [str(i) for i in range(n)], "hot": ["x" if i % 3 == 0 else None for i in range(n)], "even": [str(i % 20) for i in range(n)]}
    data["late"] = ["end" if i > n * 0.9 else str(i) for i in range(n)]
    df = spark.createDataFrame(list(zip(*data.values(), strict=True)), ", ".join(f"{c} string" for c in data)).repartition(7)
    want = set()
    for c, xs in data.items():
        counts = Counter(x for x in xs if x is not None)
        want |= {(c, v, k) for v, k in counts.items() if k > share * sum(counts.values())}
    assert {tuple(r) for r in frequent.frequent_values(df, list(data), share).collect()} == want
    assert frequent.frequent_values(df.limit(0), list(data), share).collect() == []


def test_summaries_stay_small_and_lose_little(spark):
    df = spark.range(50_000).selectExpr("cast(id as string) as v").repartition(4)
    rows = frequent.summaries(df, ["v"], 50).collect()
    assert sum(r.value is not None for r in rows) <= 4 * 50 and sum(r.rows for r in rows) == 50_000 and sum(r.lost for r in rows) * 51 <= 50_000
    with pytest.raises(ValueError, match="share"):
        frequent.frequent_values(df, ["v"], 1.5)


def test_edits_meet_a_bucketed_table_without_an_exchange(spark):
    base = spark.range(300).selectExpr("id as _row_id", "cast(id % 7 as string) as v", "id * 1.5 as x")
    edits = base.where("_row_id % 3 = 0").selectExpr("_row_id", "'v' as col", "'new' as value", "'TYPO' as error_class").union(base.where("_row_id % 6 = 0").selectExpr("_row_id", "'x'", "null", "'MV'"))
    plain = inject.apply(base, edits, ["v", "x"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        layout = inject.apply(pipeline.bucketed(base, "t"), pipeline.bucketed(edits, "e"), ["v", "x"])
        plan = layout._jdf.queryExecution().executedPlan().toString()
        again = layout.groupBy("_row_id").agg(F.count("*").alias("n"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Exchange" not in again
    assert sorted(map(str, layout.collect())) == sorted(map(str, plain.select(layout.columns).collect()))


@pytest.mark.parametrize("rows", [0, 1, 2, 37, 499, 500, 900])
def test_heads_are_filters_by_exact_rank(spark, monkeypatch, rows):
    monkeypatch.setattr(profile, "FEW", 50)
    monkeypatch.setattr(profile, "SORTED", 20)
    ids = random.Random(5).sample(range(10_000), 500)
    df = spark.createDataFrame([(i, f"{i:05}") for i in ids], "id long, t string")
    for order in ("id", "t"):
        assert sorted(r.id for r in scale.head(df, order, rows, 500).collect()) == sorted(ids)[:rows]
    assert scale.head(df.limit(0), "id", rows, 0).collect() == []
