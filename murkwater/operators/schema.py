"""Schema inference from the first rows of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import number


def infer(df: DataFrame, order_by: list[str], rows: int = 30) -> DataFrame:
    """(column, kind, parse_kind) by the most frequent kind of value among the first ``rows`` rows.

    Kinds are int, float and str; booleans count as int, null as str. parse_kind has float for int, as a
    dirty twin may hold fractions. Ties go to the first kind in natural order. A shorter table is taken whole.
    """
    head = df.orderBy(*order_by).limit(rows)

    def kind(c: str):
        v = F.col(f"`{c}`")
        n = number(v) if dict(df.dtypes)[c] != "boolean" else v.cast("double")
        return F.when(n.isNotNull() & (n == F.floor(n)), "int").when(n.isNotNull(), "float").otherwise("str")

    cells = head.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), kind(c).alias("kind")) for c in df.columns])).alias("x")).select("x.*")
    best = Window.partitionBy("column").orderBy(F.desc("n"), "kind")
    top = cells.groupBy("column", "kind").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(best)).where("r = 1")
    return top.select("column", "kind", F.when(F.col("kind") == "int", "float").otherwise(F.col("kind")).alias("parse_kind"))
