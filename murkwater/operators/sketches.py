"""Profiles that can be added up: exact counts and moments with sketches of distinct values and quantiles, kept by batch.

A batch's state has one row for each column, of bounded size whatever the batch. States merge in any order, so a profile
of all batches reads the states alone, and a new batch only its own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import as_double

#: Registers of the distinct sketch as a power of two (error about 1.04 / sqrt(2 ** 12), 1.6 %), and size of the quantile sketch (error of a rank about 0.2 %).
DISTINCT, QUANTILE = 12, 2000


def states(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, column, n, missing, least, most, mean, m2, distinct, quantile): the state of each column, for each value of ``by``.

    n counts values that are no nulls; least, most, mean and m2 (squared deviations) are those of numeric columns,
    null for others, whose quantile sketch is null as well. NaN counts as null.
    """
    by = by or []
    kinds = dict(df.dtypes)

    def parts(c: str) -> list[Column]:
        none = F.lit(None).cast("double")
        numeric = kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal")
        v = as_double(F.col(c)) if numeric else F.col(c).cast("string")
        moments = (F.min(v), F.max(v), F.avg(v), F.var_pop(v) * F.count(v), F.kll_sketch_agg_double(v, QUANTILE)) if numeric else (none, none, none, none, F.lit(None).cast("binary"))
        made = [F.lit(c), F.count(v), F.count_if(v.isNull()), *moments[:4], F.hll_sketch_agg(v.cast("string"), DISTINCT), moments[4]]
        return [m.alias(n) for m, n in zip(made, ("column", "n", "missing", "least", "most", "mean", "m2", "distinct", "quantile"), strict=True)]

    wide = df.groupBy(*by).agg(*[F.struct(*parts(c)).alias(f"_{i}") for i, c in enumerate(columns)])
    return wide.select(*by, F.explode(F.array(*[f"_{i}" for i in range(len(columns))])).alias("_s")).select(*by, "_s.*")


def save(df: DataFrame, columns: list[str], path: str, batch: int) -> None:
    """Write the states of a batch; a batch that is run again replaces its own."""
    states(df, columns).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The states of all batches so far."""
    return spark.read.parquet(path)


def merged(parts: DataFrame, points: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column, n, missing, least, most, mean, var, distinct_approx, quantiles_approx) of all rows whose states ``parts`` has.

    Counts, ends, mean and sample variance are those of one pass over all rows, up to rounding; distinct counts and quantiles are estimates.
    """
    some = F.col("quantile").isNotNull() & (F.col("n") > 0)
    total = F.sum(F.when(some, F.col("n")))
    mean = F.sum(F.when(some, F.col("n") * F.col("mean"))) / total
    spread = F.sum(F.when(some, F.col("m2"))) + F.sum(F.when(some, F.col("n") * F.col("mean") * F.col("mean"))) - total * mean * mean
    grouped = parts.groupBy("column").agg(
        F.sum("n").alias("n"), F.sum("missing").alias("missing"), F.min("least").alias("least"), F.max("most").alias("most"), mean.alias("mean"),
        F.when(total > 1, F.greatest(spread, F.lit(0.0)) / (total - 1)).alias("var"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct_approx"),
        F.kll_merge_agg_double(F.when(some, F.col("quantile"))).alias("_q"), F.count_if(some).alias("_some"),
    )
    quantiles = F.when(F.col("_some") > 0, F.array(*[F.kll_sketch_get_quantile_double("_q", F.lit(p)) for p in points]))
    return grouped.withColumn("quantiles_approx", quantiles).drop("_q", "_some")
