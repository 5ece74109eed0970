"""How many cells of each error, and of each erroneous value, a scaled table gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import digits_for


def new_count(n: Column, factor: float) -> Column:
    """round(n * factor), half to even."""
    from decimal import Decimal

    return F.bround(n * F.lit(Decimal(str(factor)))).cast("long")


def _digest(value: str) -> Column:
    """An order of values that spreads them evenly."""
    return F.md5(F.coalesce(F.col(value).cast("string"), F.lit("")).cast("binary"))


def allocate(histogram: DataFrame, total: DataFrame, group: list[str], value: str = "value") -> DataFrame:
    """Split each group's ``total`` (columns group, total) over the values of ``histogram`` (group, value, n).

    A value's share is its count plus the least count, over the sum of these; fractions are floored and
    what is left goes to the largest fractions (ties by the value's digest), so shares add up to the total exactly.
    Adds ``planned``. Sums of a group are aggregates; fractions are ranked in buckets of the fraction and, as
    most values may have the same one, the digest's leading digits, so that the distinct
    values of a group, however many and however alike, are never sorted in one task.
    """
    digits = digits_for(histogram.sparkSession)
    sums = histogram.groupBy(*group).agg(F.min("n").alias("_least"), F.sum("n").alias("_n"), F.count("*").alias("_m")).join(total, group)
    rows = histogram.join(sums, group)
    rows = rows.withColumn("_share", (F.col("n") + F.col("_least")).cast("double") / (F.col("_n") + F.col("_m") * F.col("_least")) * F.col("total"))
    rows = rows.withColumn("_base", F.floor("_share").cast("long"))
    rows = rows.withColumn("_fraction", F.round(F.col("_share") - F.col("_base"), 9)).withColumn("_digest", _digest(value)).withColumn("_bucket", F.struct(F.floor(-F.col("_fraction") * 1000).alias("f"), F.substring("_digest", 1, digits).alias("d")))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*group, "_bucket").agg(F.count("*").alias("_size"), F.sum("_base").alias("_sum"))
    sizes = sizes.withColumn("_first", F.coalesce(F.sum("_size").over(before), F.lit(0))).withColumn("_bases", F.sum("_sum").over(Window.partitionBy(*group)))
    rows = rows.join(sizes.select(*group, "_bucket", "_first", "_bases"), [*group, "_bucket"])
    place = F.col("_first") + F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(F.desc("_fraction"), "_digest"))
    rows = rows.withColumn("planned", F.col("_base") + (place <= F.col("total") - F.col("_bases")).cast("long"))
    return rows.drop("_least", "_n", "_m", "_share", "_base", "_fraction", "_digest", "_bucket", "_first", "_bases")


def intervals(plan: DataFrame, group: list[str], order: list[str], size: str = "planned") -> DataFrame:
    """``plan`` with [lo, hi): consecutive intervals of ``size`` within each group, by ``order`` (the last of it by its digest).

    Running sums are taken in buckets of equal leading digits of that digest, and buckets start where
    those before them end, so no group is summed up in one task, whatever its values look like.
    """
    *heads, last = order
    rows = plan.where(F.col(size) > 0).withColumn("_digest", _digest(last)).withColumn("_bucket", F.substring("_digest", 1, digits_for(plan.sparkSession)))
    before = Window.partitionBy(*group).orderBy(*heads, "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*group, *heads, "_bucket").agg(F.sum(size).alias("_sum")).withColumn("_first", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    keys = [*group, *heads, "_bucket"]
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    upto = Window.partitionBy(*keys).orderBy("_digest").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(sums, same).withColumn("hi", F.col("_first") + F.sum(size).over(upto)).withColumn("lo", F.col("hi") - F.col(size))
    return rows.drop("_digest", "_bucket", "_first", *[f"_k{i}" for i in range(len(keys))])
