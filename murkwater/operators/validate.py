"""Checks of a generated error population against the original one, as a table.

Every check has (check, column, expected, actual, tolerance, passed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import profile
from .allocate import new_count

COLUMNS = ["check", "column", "expected", "actual", "tolerance", "passed"]


def counts(original: DataFrame, generated: DataFrame, factor: float) -> DataFrame:
    """Class counts (col, error_class, n): swaps exact, replacements and broken dependencies within 10 %, others at least as many as before."""
    both = original.withColumnRenamed("n", "before").join(generated.withColumnRenamed("n", "after"), ["col", "error_class"], "full").na.fill(0, ["before", "after"])
    expected = new_count(F.col("before"), factor).cast("double")
    actual = F.col("after").cast("double")
    near = (actual >= F.bround(expected * 0.9)) & (actual <= F.bround(expected * 1.1))
    passed = F.when(F.col("error_class") == "SWAP", expected == actual).when(F.col("error_class").isin("REPLACEMENT", "FD"), near).when(F.col("error_class") == "RESIDUAL", F.lit(None).cast("boolean")).otherwise(F.col("before") <= F.col("after"))
    tolerance = F.when(F.col("error_class") == "SWAP", 0.0).when(F.col("error_class").isin("REPLACEMENT", "FD"), 0.1)
    return both.select(F.concat(F.lit("count_"), F.lower("error_class")).alias("check"), F.col("col").alias("column"), expected.alias("expected"), actual.alias("actual"), tolerance.alias("tolerance"), passed.alias("passed"))


def statistics(original: DataFrame, generated: DataFrame, names: list[str], tolerance: float = 0.2) -> DataFrame:
    """Statistics of two profiles (column, <names>): relative difference at most ``tolerance``; nulls agree with nulls."""
    a = original.select("column", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("expected")) for n in names])).alias("x")).select("column", "x.*")
    b = generated.select("column", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("actual")) for n in names])).alias("x")).select("column", "x.*")
    near = F.abs(F.col("actual") - F.col("expected")) <= tolerance * F.greatest(F.abs("expected"), F.lit(1e-12))
    passed = F.coalesce(near, F.col("expected").isNull() & F.col("actual").isNull())
    return a.join(b, ["column", "name"], "full").select(F.concat(F.lit("stat_"), "name").alias("check"), "column", "expected", "actual", F.lit(tolerance).alias("tolerance"), passed.alias("passed"))


def inside_band(original: DataFrame, generated: DataFrame) -> DataFrame:
    """Generated quartiles (column, q25, q75) lie inside the original's band of 1.5 interquartile ranges."""
    a = original.select("column", (F.col("q25") - 1.5 * (F.col("q75") - F.col("q25"))).alias("lo"), (F.col("q75") + 1.5 * (F.col("q75") - F.col("q25"))).alias("hi"))
    rows = a.join(generated.select("column", F.explode(F.array("q25", "q75")).alias("actual")), "column")
    return rows.select(F.lit("quartile_in_band").alias("check"), "column", F.col("lo").alias("expected"), "actual", (F.col("hi") - F.col("lo")).alias("tolerance"), F.col("actual").between(F.col("lo"), F.col("hi")).alias("passed"))


def correlation_drift(original: DataFrame, generated: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """Pairwise correlations (a, b, r) differ by at most ``tolerance``."""
    both = original.withColumnRenamed("r", "expected").join(generated.withColumnRenamed("r", "actual"), ["a", "b"])
    return both.select(F.lit("correlation").alias("check"), F.concat_ws("~", "a", "b").alias("column"), "expected", "actual", F.lit(tolerance).alias("tolerance"), (F.abs(F.col("actual") - F.col("expected")) <= tolerance).alias("passed"))


def confidences(original: DataFrame, generated: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Confidences (lhs, rhs, confidence) of dependencies differ by at most ``tolerance``."""
    both = original.select("lhs", "rhs", F.col("confidence").alias("expected")).join(generated.select("lhs", "rhs", F.col("confidence").alias("actual")), ["lhs", "rhs"])
    near = F.abs(F.col("actual") - F.col("expected")) <= tolerance
    return both.select(F.lit("dependency").alias("check"), F.concat_ws("->", "lhs", "rhs").alias("column"), "expected", "actual", F.lit(tolerance).alias("tolerance"), near.alias("passed"))


def distincts(clean: DataFrame, generated: DataFrame, estimates: DataFrame, factor: float) -> DataFrame:
    """Distinct values of each generated column against clean ones plus those estimated for errors.

    ``clean`` and ``generated`` have (column, distinct_excl_null), ``estimates`` (column, typos, missing,
    outliers). For information: passed says whether they agree within 10 %.
    """
    both = clean.withColumnRenamed("distinct_excl_null", "base").join(generated.withColumnRenamed("distinct_excl_null", "actual"), "column").join(estimates, "column", "left").na.fill(0)
    expected = (F.col("base") + F.col("typos") + F.col("missing") + F.col("outliers") * factor).cast("double")
    actual = F.col("actual").cast("double")
    return both.select(F.lit("distinct").alias("check"), "column", expected.alias("expected"), actual.alias("actual"), F.lit(0.1).alias("tolerance"), (F.abs(actual - expected) <= 0.1 * expected).alias("passed"))


def replaced_values(original: DataFrame, generated: DataFrame) -> DataFrame:
    """Cells of both tables (col, error_class, clean): as many distinct clean values are replaced in each column."""
    count = lambda cells, name: cells.where("error_class = 'REPLACEMENT'").groupBy("col").agg(F.count_distinct("clean").cast("double").alias(name))
    both = count(original, "expected").join(count(generated, "actual"), "col", "full").na.fill(0, ["expected", "actual"])
    return both.select(F.lit("distinct_replaced").alias("check"), F.col("col").alias("column"), "expected", "actual", F.lit(0.0).alias("tolerance"), (F.col("expected") == F.col("actual")).alias("passed"))


def error_populations(original: DataFrame, generated: DataFrame) -> DataFrame:
    """Cells of both tables (col, error_class, dirty): missing values, outliers and typos are as many, or of as many distinct values, as before."""

    def counted(cells: DataFrame, suffix: str) -> DataFrame:
        some = cells.where(F.col("error_class").isin("MV", "OUTLIER", "TYPO"))
        return some.groupBy("col", "error_class").agg(F.count("*").alias(f"n{suffix}"), F.count_distinct("dirty").alias(f"d{suffix}"))

    both = counted(original, "1").join(counted(generated, "2"), ["col", "error_class"], "full").na.fill(0)
    passed = (F.col("d1") <= F.col("d2")) | (F.col("n1") <= F.col("n2"))
    return both.select(F.concat(F.lit("population_"), F.lower("error_class")).alias("check"), F.col("col").alias("column"), F.col("n1").cast("double").alias("expected"), F.col("n2").cast("double").alias("actual"), F.lit(None).cast("double").alias("tolerance"), passed.alias("passed"))


def skew_band(skew: Column) -> Column:
    """How lopsided a column is: about symmetric, moderately or highly skewed to a side."""
    size = F.when(F.abs(skew) < 0.5, 0).when(F.abs(skew) < 1, 1).otherwise(2)
    return F.coalesce(size * F.signum(skew), F.lit(0.0))


def compare_profiles(original: DataFrame, generated: DataFrame) -> DataFrame:
    """Two profiles (column, distinct, min, max, skew, var): equal distincts, least and greatest values and bands of skewness, variances within 20 %."""
    names = ["distinct", "min", "max", "band", "var"]

    def long(df: DataFrame, value: str) -> DataFrame:
        rows = df.withColumn("band", skew_band(F.col("skew")))
        return rows.select("column", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias(value)) for n in names])).alias("x")).select("column", "x.*")

    near = F.when(F.col("name") == "var", F.abs(F.col("actual") - F.col("expected")) <= 0.2 * F.col("expected")).otherwise(F.col("expected").eqNullSafe(F.col("actual")))
    both = long(original, "expected").join(long(generated, "actual"), ["column", "name"])
    return both.select(F.concat(F.lit("same_"), "name").alias("check"), "column", "expected", "actual", F.when(F.col("name") == "var", 0.2).otherwise(0.0).alias("tolerance"), F.coalesce(near, F.lit(False)).alias("passed"))


def summary(original: DataFrame, generated: DataFrame, columns: list[str]) -> DataFrame:
    """(column, side, min, max, mean, var, q25, q50, q75, mode) of both tables, side by side; of several modes the least."""
    parts = None
    for side, df in (("original", original), ("generated", generated)):
        mode = profile.modes(df, columns).groupBy("column").agg(F.min(F.col("value").try_cast("double")).alias("mode"))
        part = profile.moments(df, columns).join(profile.quantiles(df, columns), "column").join(mode, "column", "left")
        part = part.select("column", F.lit(side).alias("side"), "min", "max", "mean", "var", "q25", "q50", "q75", "mode")
        parts = part if parts is None else parts.unionByName(part)
    return parts
