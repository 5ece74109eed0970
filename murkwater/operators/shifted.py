"""Alignment of two tables without a key when rows were added, lost or moved.

Rows that each side has once are anchors. The longest sequence of anchors in the same order on both sides stays; rows
between two of its anchors are paired by their place there. Anchors that follow each other on both sides are one run, which
is kept or left out as a whole, so the sequence is searched among runs: as many as blocks were moved, not as rows.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folder import written

#: Rows of a bucket in which places are counted.
BUCKET = 65_536
#: Runs beyond which the sides have no order in common that would tell which rows belong together.
MOST_RUNS = 200_000


def in_order(df: DataFrame, by: list[str], name: str = "_row_id") -> DataFrame:
    """``df``, written, with each row's 0-based place by the columns ``by``; sorted by ranges, so that only their sizes meet in one place."""
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = written(df.repartitionByRange(count, *by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id()), "ordered")
    sizes = line.groupBy(F.shiftright("_m", 33).alias("_p")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over ranges
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_f"))
    placed = line.withColumn("_p", F.shiftright("_m", 33)).join(F.broadcast(starts), "_p")
    return placed.withColumn(name, F.col("_f") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_f")


def _numbered(rows: DataFrame, at: str, name: str) -> DataFrame:
    """``rows`` with their 0-based rank by a whole number, counted in buckets of it."""
    bucketed = rows.withColumn("_b", F.floor(F.col(at) / BUCKET))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # over buckets
    sizes = bucketed.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_f"))
    return bucketed.join(sizes, "_b").withColumn(name, F.col("_f") + F.row_number().over(Window.partitionBy("_b").orderBy(at)) - 1).drop("_b", "_f")


def heaviest(runs: list[tuple[int, int]]) -> list[int]:
    """Indexes of the ascending subsequence of greatest weight among (value, weight) with distinct values; of several, one."""
    order = sorted(v for v, _ in runs)
    tree: list[tuple[int, int]] = [(0, -1)] * (len(runs) + 1)  # greatest weight, and its last run, of values up to a place
    before = []
    for i, (v, w) in enumerate(runs):
        at = bisect_left(order, v) + 1
        best, k = (0, -1), at - 1
        while k:
            best, k = max(best, tree[k]), k & (k - 1)
        before.append(best[1])
        now, k = (best[0] + w, i), at
        while k <= len(runs):
            tree[k], k = max(tree[k], now), k + (k & -k)
    best, k = (0, -1), len(runs)
    while k:
        best, k = max(best, tree[k]), k & (k - 1)
    out, i = [], best[1]
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def anchors(clean: DataFrame, dirty: DataFrame) -> DataFrame:
    """(a, b): places of the rows (pos, digest) that both sides have once, in the longest sequence that ascends on both sides."""
    sides = clean.select("digest", F.col("pos").alias("a"), F.lit(None).cast("long").alias("b")).unionByName(dirty.select("digest", F.lit(None).cast("long").alias("a"), F.col("pos").alias("b")))
    once = sides.groupBy("digest").agg(F.count("a").alias("n"), F.count("b").alias("m"), F.max("a").alias("a"), F.max("b").alias("b")).where("n = 1 and m = 1").select("a", "b")
    ranked = written(_numbered(_numbered(once, "a", "i"), "b", "j"), "anchors")
    shift = ranked.select("a", "b", "i", (F.col("j") - F.col("i")).alias("d"))
    starts = shift.join(shift.select((F.col("i") + 1).alias("i"), F.col("d").alias("last")), "i", "left").where("last is null or last <> d").select("i", "d")
    found = starts.limit(MOST_RUNS + 1).collect()
    if len(found) > MOST_RUNS:
        raise ValueError(f"more than {MOST_RUNS} runs of rows stand in another order: align by a key")
    if len(found) <= 1:
        return shift.select("a", "b")
    runs = sorted((r.i, r.d) for r in found)
    ends = [i for i, _ in runs[1:]] + [ranked.count()]
    kept = [(runs[k][1], runs[k][0], ends[k]) for k in heaviest([(i + d, end - i) for (i, d), end in zip(runs, ends, strict=True)])]
    spans = clean.sparkSession.createDataFrame(kept, "d long, lo long, hi long")
    return shift.join(F.broadcast(spans), "d").where("lo <= i and i < hi").select("a", "b")


def _since(rows: DataFrame, marks: DataFrame, side: str) -> DataFrame:
    """(pos, gap, offset): the clean place of the last anchor up to each row, and how many rows behind it the row is; -1 before the first."""
    marked = rows.select("pos").join(marks.select(F.col(side).alias("pos"), F.struct(F.col(side).alias("start"), F.col("a").alias("gap")).alias("mark")), "pos", "left").withColumn("_b", F.floor(F.col("pos") / BUCKET))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # over buckets
    carried = marked.groupBy("_b").agg(F.max("mark").alias("mark")).select("_b", F.max("mark").over(before).alias("carried"))
    upto = Window.partitionBy("_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = marked.join(carried, "_b").withColumn("last", F.coalesce(F.max("mark").over(upto), F.col("carried")))
    return last.select("pos", F.coalesce("last.gap", F.lit(-1)).alias("gap"), (F.col("pos") - F.coalesce("last.start", F.lit(-1))).alias("offset"))


def places(clean: DataFrame, dirty: DataFrame, columns: list[str], at: str = "_row_id") -> DataFrame:
    """(clean_at, dirty_at): which rows belong together; null where a row has no counterpart.

    ``at`` has the rows' places, whole numbers from 0 without gaps. Equal rows that either side has repeatedly are no anchors;
    between anchors rows are paired from the front, and what one side has more there stays alone. A moved block of rows
    that is not in the longest sequence is lost on one side and added on the other. Empty tables and tables without an
    anchor are paired by place alone.
    """
    digest = F.md5(F.to_json(F.array(*[F.col(c).cast("string") for c in columns]), {"ignoreNullFields": "false"}).cast("binary"))
    left, right = (written(df.select(F.col(at).cast("long").alias("pos"), digest.alias("digest")), "digests") for df in (clean, dirty))
    marks = written(anchors(left, right), "anchors")
    one, two = (_since(df, marks, side).withColumnRenamed("pos", name) for df, side, name in ((left, "a", "clean_at"), (right, "b", "dirty_at")))
    return one.join(two, ["gap", "offset"], "full").select("clean_at", "dirty_at")


def align(clean: DataFrame, dirty: DataFrame, columns: list[str], at: str = "_row_id", suffix: str = "__dirty") -> DataFrame:
    """An aligned pair with the places of both rows and ``_side`` (both, clean or dirty), as pairs.align gives by a key."""
    pairs = places(clean, dirty, columns, at)
    one = clean.select(F.col(at).alias("clean_at"), *columns)
    two = dirty.select(F.col(at).alias("dirty_at"), *[F.col(c).alias(c + suffix) for c in columns])
    side = F.when(F.col("clean_at").isNull(), "dirty").when(F.col("dirty_at").isNull(), "clean").otherwise("both")
    return pairs.join(one, "clean_at", "left").join(two, "dirty_at", "left").withColumn("_side", side)
