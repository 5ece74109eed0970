"""Row generation: a table scaled by an integer or fractional factor, with dense 64-bit row ids."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import profile
from .ranks import hashed, ranked


def rounded(n: int, factor: float) -> int:
    """n * factor, rounded half to even."""
    return int((Decimal(n) * Decimal(str(factor))).to_integral_value(ROUND_HALF_EVEN))


def strategy(rows: int, factor: float) -> str:
    """``hash`` for small tables and fractional factors, else ``replicate``."""
    return "hash" if rows < 5000 and factor != int(factor) else "replicate"


def replicate(df: DataFrame, key: list[str], factor: float, seed: int = 3215) -> DataFrame:
    """floor(factor) copies of all rows and one more of a sample without replacement, up to round(n * factor) rows.

    Adds _copy and _row_id; ids are dense: copy c of the row with rank r has c * n + r, so the sample (the
    lowest ranks) continues them without a gap. One ranking, then rows are repeated in place.
    """
    rows = ranked(df, hashed(seed, *[F.col(k) for k in key]), name="_rank")
    n = df.count()
    copies, more = int(factor), rounded(n, factor) - int(factor) * n
    times = F.sequence(F.lit(0), F.when(F.col("_rank") < more, copies).otherwise(copies - 1))
    full = rows if copies else rows.where(F.col("_rank") < more)
    return full.withColumn("_copy", F.explode(times)).withColumn("_row_id", F.col("_copy").cast("long") * n + F.col("_rank")).drop("_rank")


def multiply(df: DataFrame, factor: float) -> DataFrame:
    """round(count * factor) copies (half to even) of each group of identical rows, with _copy; totals may differ from round(n * factor)."""
    grouped = df.groupBy(*df.columns).agg(F.bround(F.count("*") * F.lit(Decimal(str(factor)))).cast("int").alias("_times"))
    return grouped.where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))).drop("_times")


def scaled(df: DataFrame, key: list[str], columns: list[str], factor: float, seed: int = 3215) -> DataFrame:
    """``columns`` of ``df`` scaled by the strategy that suits its size, with dense _row_id (and the key where rows are replicated)."""
    if strategy(df.count(), factor) == "replicate":
        return replicate(df, key, factor, seed)
    rows = multiply(df.select(*columns), factor)
    return ranked(rows, hashed(seed, *[F.col(c) for c in columns], F.col("_copy")), name="_row_id")


def resample(df: DataFrame, key: list[str], factor: float, seed: int = 3215) -> DataFrame:
    """All rows and round(n * factor) - n drawn with replacement; adds _row_id.

    A draw is a row id and the rank that a digest of it picks, so drawing is an equi-join.
    """
    n = df.count()
    rows = ranked(df, hashed(seed, *[F.col(k) for k in key]), name="_rank")
    draws = df.sparkSession.range(0, max(0, rounded(n, factor) - n)).select((F.col("id") + n).alias("_row_id"), pick(F.col("id"), n, seed).alias("_rank"))
    first = rows.withColumn("_row_id", F.col("_rank"))
    return first.unionByName(rows.join(draws, "_rank").select(*rows.columns, "_row_id")).drop("_rank")


def pick(draw: Column, n: int, seed: int) -> Column:
    """A number below n from the leading 15 hex digits of the draw's digest."""
    return F.pmod(F.conv(F.substring(hashed(f"{seed}|draw", draw), 1, 15), 16, 10).cast("long"), F.lit(n))


def head(df: DataFrame, order: str, rows: int, total: int) -> DataFrame:
    """The first ``rows`` of ``total`` rows by a unique ``order`` column without nulls.

    By a number, rows up to the value at that rank are kept, which exact ranks find without a sort (see profile.values_at), so
    that a slice of most of a table is a filter. Others are a top-k.
    """
    if rows <= 0 or not total:
        return df.limit(0)
    kind = dict(df.dtypes)[order]
    if kind not in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        return df.orderBy(order).limit(rows)
    row, at = profile.values_at(df, [order], [min(rows / total, 1.0)], lambda n, _: [min(rows, n)])[order]
    if not row.n:
        return df.limit(0)
    kept = df.where(F.col(order) <= F.lit(next(iter(at.values()))).cast(kind))
    # numbers beyond 2 ** 53 may share a double; they are few, so a top-k takes the last of them
    return kept if kind in ("tinyint", "smallint", "int") or abs(next(iter(at.values()))) < 2**53 else kept.orderBy(order).limit(rows)


def with_slice(df: DataFrame, order: str, factor: float, inclusive: bool = False) -> DataFrame:
    """floor(factor) copies of all rows and the first round(n * factor) - floor(factor) * n by a unique ``order`` column.

    ``inclusive`` takes one row more, as label slices do. Adds _copy.
    """
    n, copies = df.count(), int(factor)
    whole = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))) if copies else df.limit(0).withColumn("_copy", F.lit(0))
    part = head(df, order, rounded(n, factor) - copies * n + inclusive, n).withColumn("_copy", F.lit(copies))
    return whole.unionByName(part)


def shrink(df: DataFrame, order: str, factor: float) -> DataFrame:
    """For factors below 1: int(factor * n) rows by a unique ``order`` column, without the first."""
    n = df.count()
    return head(df, order, int(Decimal(str(factor)) * n) + 1, n).join(df.agg(F.min(order).alias("_first")), F.col(order) != F.col("_first")).drop("_first")
