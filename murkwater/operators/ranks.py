"""Dense, reproducible pseudo-random ranks without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def hashed(seed: int | str, *columns: Column) -> Column:
    """The md5 of a seed and values: an order that any engine can rebuild."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]).cast("binary"))


def digits_for(spark: SparkSession, least: int = 2, most: int = 6) -> int:
    """Leading hex digits that make at least sixteen buckets for each shuffle partition of the session."""
    wanted = 16 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return next((d for d in range(least, most) if 16**d >= wanted), most)


def ranked(df: DataFrame, order: Column, within: list[str] | None = None, name: str = "rank", digits: int | None = None, most: DataFrame | None = None) -> DataFrame:
    """``df`` with 0-based ranks by a hex digest, over all rows or within groups; ties are broken arbitrarily.

    Rows are ranked in buckets of equal leading ``digits`` (by default as many as the session's partitions
    ask for) and each bucket starts after those before it, so that even a group that holds most rows is
    spread over many tasks. Only bucket sizes are summed up in one place. With ``most`` (within, most) only
    buckets that start below a group's number are ranked: rows beyond them never move.
    """
    within = within or []
    rows = df.withColumn("_digest", order).withColumn("_bucket", F.substring("_digest", 1, digits or digits_for(df.sparkSession)))
    before = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*within, "_bucket").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if most is not None:
        sizes = (sizes.join(most, within) if within else sizes.crossJoin(F.broadcast(most))).where("_first < most")
    sizes = sizes.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(within)], F.col("_bucket").alias("_b"), "_first")
    same = F.col("_bucket") == F.col("_b")
    for i, c in enumerate(within):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    joined = rows.join(sizes, same).withColumn("_place", F.row_number().over(Window.partitionBy(*within, "_bucket").orderBy("_digest")))
    return joined.withColumn(name, F.col("_first") + F.col("_place") - 1).drop("_digest", "_bucket", "_b", "_first", "_place", *[f"_g{i}" for i in range(len(within))])
