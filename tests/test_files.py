from pyspark.sql import functions as F

from murkwater.operators import pairs
from murkwater.plans.files import Paths, read_pair, run_files
from murkwater.sources import tables


def make(tmp_path, n=200):
    clean = [["id", "city", "price"], *[[str(i), ["Graz", "Wien", "Linz"][i % 3], f"{10 + i % 7}.5"] for i in range(n)]]
    dirty = [list(r) for r in clean]
    for i in range(1, n + 1):
        if i % 23 == 1:
            dirty[i][1] = "Grz"
        elif i % 29 == 2:
            dirty[i][2] = ""
        elif i % 31 == 3:
            dirty[i][2] = "90000"
        elif i % 37 == 4:
            dirty[i][2] = "n/a"
    for name, rows in (("clean", clean), ("dirty", dirty)):
        (tmp_path / f"{name}.csv").write_text("\n".join(",".join(r) for r in rows) + "\n")
    return str(tmp_path / "clean.csv"), str(tmp_path / "dirty.csv")


def test_positions(spark, tmp_path):
    spark.range(0, 1000, 1, 7).select("id").write.csv(str(tmp_path / "t"))
    rows = pairs.positioned(spark.read.schema("id long").csv(str(tmp_path / "t")))
    assert sorted(r._row_id for r in rows.collect()) == list(range(1000))


def test_from_files_to_files(spark, tmp_path):
    clean, dirty = make(tmp_path)
    pair, kinds, key = read_pair(spark, clean, dirty)
    assert kinds == {"id": "num", "city": "str", "price": "num"} and key == ["_row_id"] and pair.count() == 200
    classes = {(r.col, r.error_class): r.n for r in pairs.class_counts(pairs.classify(pair, key, kinds)).collect()}
    assert classes[("city", "TYPO")] == 9 and classes[("price", "MV")] == 12 and classes[("price", "OUTLIER")] > 0
    paths = Paths(*(str(tmp_path / x) for x in ("out", "before", "after")))
    checks = run_files(spark, clean, dirty, 3, paths).cache()
    assert checks.where("(check like 'count_%' or check like 'population_%' or check = 'quartile_in_band') and not passed").collect() == []
    assert {r.check for r in checks.select("check").distinct().collect()} >= {"count_typo", "population_mv", "distinct", "stat_mean", "stat_skew", "stat_q75", "quartile_in_band", "correlation"}
    assert spark.read.parquet(paths.output).count() == 600
    before, after = ({(r.label, r.column): r.amount for r in tables.read_report(spark, p).collect()} for p in (paths.original_report, paths.generated_report))
    assert after[("typo", "city")] == 3 * before[("typo", "city")]
    assert {"mean", "q75", "kurt", "distinct_excl_null"} <= {label for label, _ in before} and before[("distinct_incl_null", "city")] == 4
    values = {(r.error_class, r.col, r.value): r.n for r in tables.read_histograms(spark, paths.original_report).collect()}
    assert values[("TYPO", "city", "Grz")] == 9 and sum(n for (c, _, _), n in values.items() if c == "MV") == 12


def test_histogram_lines_keep_odd_values(spark, tmp_path):
    rows = [("a", "MV", None), ("a", "TYPO", "x\ty\n\"z\""), ("a", "TYPO", ""), ("a", "TYPO", ""), ("b", "MV", "null")]
    path = str(tmp_path / "report")
    tables.write_report(tables.histogram_lines(spark.createDataFrame(rows, "col string, error_class string, dirty string")), path)
    assert sorted(map(str, tables.read_histograms(spark, path).collect())) == sorted(f"Row(error_class={c!r}, col={a!r}, value={v!r}, n={n})" for a, c, v, n in [("a", "MV", None, 1), ("a", "TYPO", "x\ty\n\"z\"", 1), ("a", "TYPO", "", 2), ("b", "MV", "null", 1)])
    assert tables.read_report(spark, path).collect() == []


def test_dependencies_of_a_file_have_a_part_in_a_run(spark, tmp_path):
    rows = [["id", "zip", "city"], *[[str(i), f"z{i % 12}", f"c{i % 12 // 2}"] for i in range(240)]]
    for name in ("clean", "dirty"):
        lines = [list(r) for r in rows]
        if name == "dirty":
            lines[5][2] = lines[18][2] = "c5"
        (tmp_path / f"{name}.csv").write_text("\n".join(",".join(r) for r in lines) + "\n")
    (tmp_path / "fds.txt").write_text("1->2\n0,1 -> 2\n7->2\nnot one\n")
    found = tables.read_dependencies(spark, str(tmp_path / "fds.txt"), rows[0], composite=True)
    assert sorted(map(tuple, found.collect())) == [("id,zip", "city"), ("zip", "city")]
    paths = Paths(*(str(tmp_path / x) for x in ("out", "before", "after")))
    checks = run_files(spark, str(tmp_path / "clean.csv"), str(tmp_path / "dirty.csv"), 2, paths, dependencies=str(tmp_path / "fds.txt"), composite=True)
    got = {(r["check"], r["column"]): (r.expected, r.actual, r.passed) for r in checks.where("check in ('count_fd', 'dependency')").collect()}
    assert got["count_fd", "city"] == (4.0, 4.0, True) and got["dependency", "zip->city"][2]


def test_by_key(spark, tmp_path):
    clean, dirty = make(tmp_path)
    pair, kinds, key = read_pair(spark, clean, dirty, key=["id"])
    assert key == ["id"] and list(kinds) == ["city", "price"]
    assert pair.where(F.col("city") != F.col("city__dirty")).count() == 9
