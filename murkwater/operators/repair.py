"""Repairs: imputation by mean, median, mode or dependencies, capping of outliers, nearest other values and nearest clean texts."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folder import written
from . import profile
from .dependencies import Dependency, left_columns, left_name, left_value, missing
from .graph import contracted


def impute(df: DataFrame, column: str, how: str, missing: Column) -> DataFrame:
    """``df`` with the cells under ``missing`` set to the mean, median or mode (ties: the least) of the others.

    The value is a one-row aggregate that joins all rows; if there is none, cells become null.
    """
    others = df.where(~missing)
    if how == "mode":
        counted = others.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
        value = counted.agg(F.min_by("_v", F.struct(-F.col("_n"), F.col("_v"))).alias("_fill"))
    else:
        value = others.agg(F.avg(column).alias("_fill")) if how == "mean" else profile.quantiles(others.select(column), [column]).select(F.col("q50").alias("_fill"))
    return df.join(F.broadcast(value)).withColumn(column, F.when(missing, F.col("_fill")).otherwise(F.col(column))).drop("_fill")


def cap(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """``df`` with a column's values drawn into [low, high]; nulls stay."""
    return df.withColumn(column, F.when(F.col(column).isNotNull(), F.greatest(F.least(F.col(column), F.lit(high)), F.lit(low))))


def nearest_others(df: DataFrame, column: str, buckets: int = 64) -> DataFrame:
    """(value, nearest, distance) of each distinct value of a numeric column: the nearest value that is not equal, the lower of two.

    In sorted order the nearest is a neighbour, so no matrix of distances is made. Values are dealt into
    ranges of about as many distinct values each, by a sketch of them; a range's neighbours outside are the
    ends of the ranges around it.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("value")).distinct()
    ends = values.agg(F.percentile_approx("value", F.array(*[F.lit(i / buckets) for i in range(1, max(buckets, 2))]), F.lit(100 * buckets)).alias("ends"))
    dealt = values.crossJoin(F.broadcast(ends)).withColumn("b", F.size(F.filter("ends", lambda e: e < F.col("value")))).select("value", "b")
    ends = dealt.groupBy("b").agg(F.min("value").alias("least"), F.max("value").alias("most"))
    order = Window.orderBy("b")  # over at most ``buckets`` rows
    ends = ends.select("b", F.lag("most").over(order).alias("before"), F.lead("least").over(order).alias("after"))
    own = Window.partitionBy("b").orderBy("value")
    rows = dealt.join(F.broadcast(ends), "b").withColumn("down", F.coalesce(F.lag("value").over(own), "before")).withColumn("up", F.coalesce(F.lead("value").over(own), "after"))
    nearest = F.when(F.col("up").isNull() | (F.col("value") - F.col("down") <= F.col("up") - F.col("value")), F.col("down")).otherwise(F.col("up"))
    return rows.select("value", nearest.alias("nearest")).withColumn("distance", F.abs(F.col("value") - F.col("nearest")))


def in_order(dependencies: list[Dependency]) -> list[str]:
    """Right columns so that each comes after those that its left sides need; raises ValueError if they form a circle."""
    needs: dict[str, set[str]] = {}
    for a, b in dependencies:
        needs.setdefault(b, set()).update(left_columns(a))
    done: list[str] = []
    while len(done) < len(needs):
        ready = [b for b, n in needs.items() if b not in done and not any(x in needs and x not in done for x in n)]
        if not ready:
            raise ValueError(f"dependencies form a circle among {sorted(set(needs) - set(done))}")
        done += ready
    return done


def by_dependencies(df: DataFrame, key: list[str], dependencies: list[Dependency], conflicts: bool = True) -> DataFrame:
    """(key, col, was, value): the cells that dependencies set, and to what.

    Cells of a right column whose rows share a left value must be equal; several left sides of one column join
    such groups where a row is in both, and what they connect is one component. Its value is that of most of its
    cells (ties: the least), so that fewest cells change; missing cells have no vote, and a component of
    missing cells alone stays as it is. Missing cells are filled and, with ``conflicts``, others set right. Columns
    are repaired in the order in which they depend on each other, left sides by their repaired values; a missing left
    value determines nothing.

    Only the columns that dependencies name move; values are counted by group before they are shuffled, and
    groups without a missing or differing cell don't meet the rows.
    """
    kinds = dict(df.dtypes)
    rights = in_order(dependencies)
    names = sorted({c for a, b in dependencies for c in (*left_columns(a), b)})
    work = df.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(key)], *[F.col(c).alias(c) for c in names], *[F.col(c).alias(f"_was_{c}") for c in rights])
    for b in rights:
        lefts = [a for a, right in dependencies if right == b]
        absent = [F.aggregate(F.array(*[missing(F.col(c), kinds[c]) for c in left_columns(a)]), F.lit(False), lambda x, y: x | y) for a in lefts]
        nodes = [F.when(~no, F.concat(F.lit(left_name(a) + "="), left_value([F.col(c) for c in left_columns(a)]))) for a, no in zip(lefts, absent, strict=True)]
        work = work.withColumn("_node", F.coalesce(*nodes))
        gone = missing(F.col(b), kinds[b])
        if len(lefts) > 1:  # a row's nodes are in one component
            edges = work.select(F.explode(F.array(*[F.struct(F.col("_node").alias("a"), n.alias("b")) for n in nodes])).alias("e")).select("e.*").distinct()
            roots = contracted(edges)
            counted = work.where("_node is not null").groupBy("_node", F.when(~gone, F.col(b)).alias("v")).agg(F.count("*").alias("n"))
            counted = counted.join(roots, F.col("_node") == F.col("node")).groupBy("root", "v").agg(F.sum("n").alias("n"))
        else:
            roots = None
            counted = work.where("_node is not null").groupBy(F.col("_node").alias("root"), F.when(~gone, F.col(b)).alias("v")).agg(F.count("*").alias("n"))
        best = F.min(F.when(F.col("v").isNotNull(), F.struct((-F.col("n")).alias("less"), "v")))
        chosen = counted.groupBy("root").agg(best["v"].alias("_to"), F.count("*").alias("ways")).where("_to is not null and ways > 1").drop("ways")
        chosen = chosen if roots is None else chosen.join(roots, "root").select(F.col("node").alias("root"), "_to")
        change = F.col("_to").isNotNull() & (F.lit(conflicts) | gone)
        work = work.join(chosen, F.col("_node") == F.col("root"), "left").withColumn(b, F.when(change, F.col("_to")).otherwise(F.col(b))).drop("_to", "root", "_node")
    cells = F.array(*[F.when(~F.col(b).eqNullSafe(F.col(f"_was_{b}")), F.struct(F.lit(b).alias("col"), F.col(f"_was_{b}").cast("string").alias("was"), F.col(b).cast("string").alias("value"))) for b in rights])
    changed = work.select(*[F.col(f"_key{i}").alias(k) for i, k in enumerate(key)], F.explode(F.filter(cells, lambda c: c.isNotNull())).alias("_c"))
    return changed.select(*key, "_c.*")


#: A value is cut finer where it shares a key with more clean texts than these for each value and these besides.
SHARED = (50, 200)


def without(texts: DataFrame, edits: int, cuts: int, moving: bool) -> DataFrame:
    """(col, value, key): for every way to take ``edits`` of its ``cuts`` pieces out of a text (col, value, n, more), what is left, as a hash.

    The pieces are those of a text of ``n`` characters, at most one for each; the text has ``more`` characters. With ``moving``,
    what lies behind a piece is also looked for where up to so many edits inside the pieces before it move it.
    """
    ways = [w for w in itertools.product(range(-edits, edits + 1), repeat=edits) if sum(map(abs, w)) <= edits] if moving else [(0,) * edits]
    moves = [tuple(itertools.accumulate(w, initial=0)) for w in ways]
    taken = list(itertools.combinations(range(cuts), edits))
    literal = lambda rows: F.expr(f"array({', '.join(f'array({str(list(r))[1:-1]})' for r in rows)})")
    rows = texts.withColumn("cuts", F.least(F.lit(cuts), F.greatest("n", F.lit(edits)))).withColumn("move", F.explode(literal(moves))).where(F.col("move")[edits] == F.col("more"))
    if edits:
        rows = rows.select("*", F.posexplode(literal(taken)).alias("way", "out")).where(F.col("out")[edits - 1] < F.col("cuts"))
    else:
        rows = rows.withColumn("way", F.lit(0))
    cut = lambda i: F.floor(i * F.col("n") / F.col("cuts")).cast("int")
    left = []
    for j in range(edits + 1):
        start = cut(F.col("out")[j - 1] + 1) if j else F.lit(0)
        end = cut(F.col("out")[j]) if j < edits else F.col("n")
        left.append(F.substring("value", start + F.col("move")[j] + 1, end - start))
    return rows.select("col", "value", F.xxhash64("n", "way", *left).alias("key"))


def near(values: DataFrame, clean: DataFrame, lengths: DataFrame, edits: int, cuts: int, limit: float | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(col, value, nearest, distance) of ``values`` (col, value) with a text of ``clean`` (its ``lengths``: col, n) up to ``edits`` away, and the values left out, if any: those that share a key with more than ``limit`` clean texts.

    So many edits touch at most so many pieces of a clean text. Without these it is found in a near value, moved by what
    the edits put in or take out, so the two share a key. The join is an equi-join on keys; what it finds is verified.
    """
    count = max(1, int(clean.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a few rows make many
    wanted = values.withColumn("more", F.explode(F.sequence(F.lit(-edits), F.lit(edits)))).withColumn("n", F.length("value") - F.col("more")).join(F.broadcast(lengths), ["col", "n"])
    every = clean.withColumns({"n": F.length("value"), "more": F.lit(0)}).join(F.broadcast(wanted.select("col", "n").distinct()), ["col", "n"], "left_semi")
    keys = written(without(wanted.repartition(count, "col", "value"), edits, cuts, True).distinct(), "keys")
    met = written(without(every.repartition(count, "col", "value"), edits, cuts, False).join(keys.select("col", "key").distinct(), ["col", "key"], "left_semi"), "met")
    many = None
    if limit is not None:
        common = met.groupBy("col", "key").agg(F.count("*").alias("n")).where(F.col("n") > limit)
        if not common.isEmpty():
            many = written(keys.join(common, ["col", "key"], "left_semi").select("col", "value").distinct(), "texts")
            keys = keys.join(many, ["col", "value"], "left_anti")
    pairs = keys.join(met.withColumnRenamed("value", "nearest").repartition(count, "col", "key"), ["col", "key"])
    found = pairs.withColumn("distance", F.levenshtein("value", "nearest", edits)).where("distance >= 0")
    best = found.groupBy("col", "value").agg(F.min(F.struct("distance", "nearest")).alias("b"))
    return written(best.select("col", "value", "b.nearest", "b.distance"), "near"), many


def nearest_clean(values: DataFrame, clean: DataFrame, most: int = 2, q: int = 2) -> DataFrame:
    """(col, value, nearest, distance): for each text of ``values`` (col, value) the clean text of its column (col, value) at the least edit distance, up to ``most``.

    Of several the least. A value without a clean text so near has no row; one that is clean is its own nearest;
    nulls have none; repeated rows count once.

    Values with a clean text one edit away are settled first, then the others with two, and so on. Clean texts are cut in ``4 * q``
    pieces (four more for one edit); values that share what is left of too many of them are looked for again with three times
    as many, which of most texts are single characters.
    """
    rest, every = (written(df.where("value is not null").select("col", "value").distinct(), "texts") for df in (values, clean))
    lengths = written(every.select("col", F.length("value").alias("n")).distinct(), "lengths")
    texts, found = every.count(), []
    for edits in range(min(most, 1), most + 1):
        left = rest.count()
        if found and not left:
            break
        cuts = 4 * (q if edits > 1 else q + 1)
        best, many = near(rest, every, lengths, edits, cuts, SHARED[0] * texts / max(left, 1) + SHARED[1])
        if many is not None:
            best = best.unionByName(near(many, every, lengths, edits, 3 * cuts)[0])
        found.append(best)
        if edits < most:
            rest = written(rest.join(best, ["col", "value"], "left_anti"), "texts")
    return functools.reduce(DataFrame.unionByName, found)
