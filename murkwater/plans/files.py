"""From files to files: the whole engine on a clean and a dirty table of delimited text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.folder import written
from ..functions.values import number
from ..operators import pairs, profile, schema
from ..sources import tables
from . import pipeline


@dataclass
class Paths:
    """Where a run writes: the generated table (Parquet), and reports of the original and generated profile."""

    output: str
    original_report: str
    generated_report: str


def read_pair(spark: SparkSession, clean_path: str, dirty_path: str, key: list[str] | None = None, header: tuple[bool, bool] = (True, True), sep: tuple[str, str] = (",", ",")) -> tuple[DataFrame, dict[str, str], list[str]]:
    """(aligned pair, kinds, key): columns in the clean table's order, by ``key`` or by row position.

    Clean nulls become 0. Numeric columns, inferred from the clean table, are doubles on its side and stay
    text on the dirty one, where what is no number counts as missing.
    """
    clean = tables.read_csv(spark, clean_path, header[0], sep[0])
    dirty = tables.read_csv(spark, dirty_path, header[1], sep[1])
    dirty = dirty.toDF(*clean.columns)
    columns = [c for c in clean.columns if c not in (key or [])]
    clean, dirty = (df if key else pairs.positioned(df) for df in (clean.na.fill("0"), dirty))
    key = key or ["_row_id"]
    inferred = {r["column"]: r.parse_kind for r in schema.infer(clean.select(*key, *columns), key).collect()}
    kinds = {c: "num" if inferred[c] == "float" else "str" for c in columns}
    both = pairs.align(clean, dirty, key, columns).where("_side = 'both'").drop("_side")
    return both.withColumns({c: number(F.col(c)) for c, k in kinds.items() if k == "num"}), kinds, key


def dirty_statistics(table: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(column, distincts, moments, quartiles) of a pair's dirty side; what a text column lacks is null. Null numbers count as 0."""
    numeric = pipeline.numeric(kinds)
    counts = profile.distinct_counts(table.select(*[F.col(c + pairs.DIRTY).alias(c) for c in kinds]), list(kinds))
    if not numeric:
        return counts
    values = pipeline.dirty_numbers(table, numeric).na.fill(0.0)
    return counts.join(profile.moments(values, numeric), "column", "left").join(profile.quantiles(values, numeric), "column", "left")


def run_files(
    spark: SparkSession, clean_path: str, dirty_path: str, factor: float, paths: Paths, key: list[str] | None = None, seed: int = 3215, dependencies: str | None = None, composite: bool = False
) -> DataFrame:
    """Run the engine and write its results; returns the validation table, with all checks.

    ``dependencies`` is a file of dependencies between columns of the clean table (see sources.tables). Reports hold class counts,
    distincts, moments and quartiles of the dirty side, and histograms of erroneous values.
    """
    pair, kinds, key = read_pair(spark, clean_path, dirty_path, key)
    declared = None
    if dependencies:
        found = tables.read_dependencies(spark, dependencies, list(tables.read_csv(spark, clean_path).columns), composite)
        declared = [(tuple(r.lhs.split(",")), r.rhs) for r in found.distinct().collect() if r.rhs in kinds and set(r.lhs.split(",")) <= set(kinds)]  # a line or so for each column
    pair = written(pair.withColumnsRenamed({k: f"_key{i}" for i, k in enumerate(key)}), "pair")
    done = pipeline.run(pair, [f"_key{i}" for i in range(len(key))], kinds, factor, seed, declared, full=True)
    tables.write_table(done.generated.select(*[F.col(c + pairs.DIRTY).alias(c) for c in kinds]), paths.output)
    sides = ((done.original, done.cells, pair, paths.original_report), (done.regenerated, done.again, done.generated, paths.generated_report))
    for counts, cells, table, path in sides:
        lines = tables.report_lines(counts, dirty_statistics(table, kinds)).unionByName(tables.histogram_lines(cells.select("col", "error_class", "dirty")))
        tables.write_report(lines, path)
    return done.validation
