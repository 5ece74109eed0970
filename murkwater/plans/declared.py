"""Declarative error plans: transformations read from a file become edits of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import inject, pairs, ranks


def edits(rows: DataFrame, transformations: DataFrame, seed: int = 3215) -> DataFrame:
    """Edits (_row_id, col, value, error_class) of ``rows`` (_row_id and columns) by ``sources.tables.read_error_plan``.

    OUTLIER sets ``num_outliers`` cells of each of its columns to values beyond the interquartile fence, in
    turn above and below. SWAP_BETWEEN_COLS exchanges two columns in the row of the lowest rank (``neighbors``:
    and in the next). FLIP exchanges a column's values of the two rows of lowest rank. DISTINCT gives the row
    of the lowest rank a value that the column does not have. Columns are names or 0-based numbers; rows are
    ranked by a digest of their id, the transformation's number and the seed. A plan has a few lines.
    """
    names = [c for c in rows.columns if c != "_row_id"]
    name = lambda c: None if c is None else names[int(c)] if str(c).isdigit() else c
    out = rows.sparkSession.createDataFrame([], inject.EDITS)
    text = lambda c: F.col(c).cast("string")
    for i, t in enumerate(transformations.collect()):
        columns = [name(c) for c in (t.cols or [])] or [name(t.col)]
        first = lambda n, i=i: ranks.ranked(rows, ranks.hashed(f"{seed}|{i}", F.col("_row_id")), most=rows.sparkSession.createDataFrame([(n,)], "most long")).where(F.col("rank") < n)
        if t.t_type == "OUTLIER":
            for c, f in pairs.fences(rows.select(*columns), columns).items():
                reach = (f.iqr[1] - f.iqr[0]) / 4 or 1.0  # the interquartile range
                value = F.when(F.col("rank") % 2 == 0, F.lit(f.iqr[1]) + reach * (F.col("rank") + 1)).otherwise(F.lit(f.iqr[0]) - reach * (F.col("rank") + 1))
                out = out.union(first(t.num_outliers or 1).select("_row_id", F.lit(c), value.cast("string"), F.lit("OUTLIER")))
        elif t.t_type == "SWAP_BETWEEN_COLS":
            a, b = name(t.col1), name(t.col2)
            both = F.array(F.struct(F.lit(a).alias("col"), text(b).alias("value")), F.struct(F.lit(b).alias("col"), text(a).alias("value")))
            out = out.union(first(2 if t.type == "neighbors" else 1).select("_row_id", F.explode(both).alias("e")).select("_row_id", "e.col", "e.value", F.lit("SWAP")))
        elif t.t_type == "FLIP":
            two = first(2).select("_row_id", "rank", text(columns[0]).alias("value"))
            other = two.select((1 - F.col("rank")).alias("rank"), "value")
            out = out.union(two.select("_row_id", "rank").join(other, "rank").select("_row_id", F.lit(columns[0]), "value", F.lit("REPLACEMENT")))
        elif t.t_type == "DISTINCT":
            most = rows.agg(F.max(F.length(text(columns[0]))).alias("longest"))
            out = out.union(first(1).crossJoin(F.broadcast(most)).select("_row_id", F.lit(columns[0]), F.rpad(text(columns[0]), F.col("longest") + 1, F.lit("~")), F.lit("TYPO")))
        else:
            raise ValueError(f"unknown transformation {t.t_type}")
    return out
