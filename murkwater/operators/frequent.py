"""Values that make up more than a given share of a column, exactly, without a shuffle of all values."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMMARY = "column string, value string, n long, lost long, rows long"


class Summary:
    """Counts of a column's values of which at most ``most`` are kept: an added value's count may be too small, by ``lost`` at most."""

    def __init__(self, most: int):
        self.most, self.counts, self.lost, self.rows = most, {}, 0, 0

    def add(self, values: pa.Array) -> None:
        for pair in pc.value_counts(values.drop_null()).to_pylist():
            self.counts[pair["values"]] = self.counts.get(pair["values"], 0) + pair["counts"]
        self.rows += len(values) - values.null_count
        if len(self.counts) > self.most:
            cut = sorted(self.counts.values(), reverse=True)[self.most]
            self.counts = {v: n - cut for v, n in self.counts.items() if n > cut}
            self.lost += cut


def summaries(df: DataFrame, columns: list[str], most: int) -> DataFrame:
    """Rows of SUMMARY: each task's counts of each column's values, at most ``most``, and, with a null value, what they may lack and the column's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: Summary(most) for c in columns}
        for batch in batches:
            for c in columns:
                held[c].add(batch.column(c))
        rows = [(c, v, n, 0, 0) for c, s in held.items() for v, n in s.counts.items()] + [(c, None, 0, s.lost, s.rows) for c, s in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], [x.split()[0] for x in SUMMARY.split(", ")])

    return df.select(*[F.col(c).cast("string").alias(c) for c in columns]).mapInArrow(run, SUMMARY)


def frequent_values(df: DataFrame, columns: list[str], share: float = 0.01) -> DataFrame:
    """(column, value, n): all values, as text, with more than ``share`` of a column's rows that are no nulls, and their exact counts.

    A first pass keeps 2 / share counts of each column in each task. A count is too small by what was taken from all counts when
    there were too many, which adds up to less than half of ``share``. So a value over the threshold keeps a count of
    more than half of it, and at most 2 / share values of a column can: these few, which that bound allows to be broadcast, are counted in a
    second pass. No other value leaves its task.
    """
    if not 0 < share < 1:
        raise ValueError("share lies between 0 and 1")
    parts = summaries(df, columns, math.ceil(2 / share))
    limits = parts.groupBy("column").agg((share * F.sum("rows")).alias("least"), F.sum("lost").alias("lost"))
    kept = parts.where("value is not null").groupBy("column", "value").agg(F.sum("n").alias("seen"))
    wanted = kept.join(F.broadcast(limits), "column").where("seen + lost > least").select("column", "value", "least")
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    counted = cells.join(F.broadcast(wanted), ["column", "value"]).groupBy("column", "value").agg(F.count("*").alias("n"), F.first("least").alias("least"))
    return counted.where("n > least").drop("least")
