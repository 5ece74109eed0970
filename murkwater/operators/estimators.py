"""Estimates of the number of distinct values of a larger table from a sample's frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _half_even(c: Column) -> Column:
    return F.bround(c, 0).cast("long")


def estimates(fof: DataFrame, scale: float, compat: bool = False) -> DataFrame:
    """(column, d, n, shlosser, haas_stokes, estimate) for frequencies of frequencies (column, i, f).

    The sample is a 1/``scale`` share of the table; estimate is the larger of the two. With ``compat``
    sums leave out the greatest frequency and the squared coefficient of variation is updated term by
    term, as a known implementation has it (over gaps between frequencies by powers, so a value that occurs very
    often costs no more than others); by default published formulas hold. Where a formula divides
    by zero the sample's distinct count stands. All sums are one aggregate over (column, i, f).
    """
    q = 1.0 / scale
    i, f = F.col("i").cast("double"), F.col("f").cast("double")
    rows = fof
    if compat:
        most = fof.groupBy("column").agg(F.max("i").alias("most"))
        rows = fof.join(most, "column")
    inside = F.col("i") < F.col("most") if compat else F.lit(True)
    some = lambda x: F.coalesce(F.sum(F.when(inside, x)), F.lit(0.0))
    sums = rows.groupBy("column").agg(
        F.sum("f").alias("d"), F.sum(F.col("i") * F.col("f")).alias("n"), F.sum(F.when(F.col("i") == 1, F.col("f")).otherwise(0)).alias("f1"),
        F.sum(F.pow(F.lit(1 - q), i) * f).alias("s_up"), F.sum(i * q * F.pow(F.lit(1 - q), i - 1) * f).alias("s_down"),
        some(i * q * q * F.pow(F.lit(1 - q * q), i - 1) * f).alias("a"), some((F.pow(F.lit(1 - q * q), i) - F.pow(F.lit(1 - q), i)) * f).alias("b"),
        some(F.pow(F.lit(1 - q), i) * f).alias("c"), some(i * q * F.pow(F.lit(1 - q), i - 1) * f).alias("e"),
        some(i * (i - 1) * f).alias("pairs"),
        F.array_sort(F.collect_list(F.struct("i", "f"))).alias("freqs"), F.max("i").alias("top"),
    )
    d, n, f1 = F.col("d").cast("double"), F.col("n").cast("double"), F.col("f1").cast("double")
    shlosser = F.when((F.lit(q >= 1)) | (F.col("s_down") == 0), d).otherwise(d + f1 * F.col("s_up") / F.col("s_down"))
    base = 1 - (1 - q) * f1 / n
    duj1 = F.when(base == 0, d).otherwise(d / F.when(base == 0, 1.0).otherwise(base))
    if compat:
        # each step, also of a frequency that does not occur, scales what has been summed so far by ``ratio`` and adds ``more``
        ratio, more = duj1 / (n * n), duj1 / (n * scale) - 1

        def idle(s: Column, steps: Column) -> Column:
            """What is left of a sum after so many steps that add nothing else."""
            power = F.pow(ratio, steps)
            return s * power + F.when(ratio == 1, more * steps).otherwise(more * (power - 1) / F.when(ratio == 1, 1.0).otherwise(ratio - 1))

        def step(state: Column, x: Column) -> Column:
            summed = idle(state["s"], (x["i"] - state["at"] - 1).cast("double"))
            often = x["i"].cast("double")  # a product of long numbers ends at 2^63
            return F.struct(((summed + often * (often - 1) * x["f"]) * ratio + more).alias("s"), x["i"].cast("long").alias("at"))

        below = F.filter("freqs", lambda x: x["i"] < F.col("top"))
        state = F.aggregate(below, F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("at")), step)
        summed = idle(state["s"], (F.col("top") - 1 - state["at"]).cast("double"))
        gamma = F.greatest(F.lit(0.0), summed)
    else:
        gamma = F.greatest(F.lit(0.0), duj1 / (n * n) * F.col("pairs") + duj1 / (n * scale) - 1)
    small = F.when((base == 0) | F.lit(q >= 1), d).otherwise((d - (1 - q) * f1 * F.ln(F.lit(max(1 - q, 1e-300))) * gamma / q) / F.when(base == 0, 1.0).otherwise(base))
    large = F.when((F.col("b") == 0) | (F.col("e") == 0), d).otherwise(d + f1 * F.try_divide(F.col("a"), F.col("b")) * F.pow(F.try_divide(F.col("c"), F.col("e")), 2))
    haas = F.floor(F.when(gamma < 0.9, small).otherwise(large)).cast("long")
    out = sums.select("column", F.col("d"), F.col("n"), _half_even(shlosser).alias("shlosser"), haas.alias("haas_stokes"))
    return out.withColumn("estimate", F.greatest("shlosser", "haas_stokes"))
