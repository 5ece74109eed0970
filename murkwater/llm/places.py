"""Places of rows within their group, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, written


def placed(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``pos``: the 1-based place of each within its ``key`` by ``order``. Nulls of key are a group.

    Rows are sorted by ranges of (key, order), so a key with very many rows lies in several ranges, and written
    once. A row's place in the whole is its place in its range after all ranges before it; only their sizes
    are summed up in one place. Rows that are equal in all of ``order`` get places of their own.
    """
    spark = rows.sparkSession
    by = [F.col(key), *order]
    line = rows.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by)
    line = written(line.withColumn("_m", F.monotonically_increasing_id()), "placed")
    sizes = line.groupBy(F.shiftright("_m", 33).alias("_p")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over ranges
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_f"))
    dense = line.withColumn("_p", F.shiftright("_m", 33)).join(F.broadcast(starts), "_p")
    dense = dense.withColumn("_g", F.col("_f") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_f")
    first = dense.groupBy(F.col(key).alias("_key")).agg(F.min("_g").alias("_first"))
    return dense.join(first, F.col(key).eqNullSafe(F.col("_key"))).withColumn("pos", F.col("_g") - F.col("_first") + 1).drop("_g", "_key", "_first")


def crc(text: Column) -> Column:
    """Unsigned CRC-32 of a text's UTF-8 bytes."""
    return F.crc32(text.cast("binary"))
