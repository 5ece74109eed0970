"""Functional dependencies: confidence, discovery over several columns, and the cells that break them."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import as_double, canonical, missing_number, missing_text

#: Left side (one column or several) and right side.
Dependency = tuple[str | tuple[str, ...], str]


def left_columns(lhs: str | tuple[str, ...]) -> tuple[str, ...]:
    return (lhs,) if isinstance(lhs, str) else tuple(lhs)


def left_name(lhs: str | tuple[str, ...]) -> str:
    """A left side as it is named in tables: its columns joined by commas."""
    return ",".join(left_columns(lhs))


def left_value(values: list[Column]) -> Column:
    """The values of a left side as one text; a null is a value of its own."""
    return values[0].cast("string") if len(values) == 1 else F.to_json(F.array(*[v.cast("string") for v in values]), {"ignoreNullFields": "false"})


def confidences(df: DataFrame, pairs: list[Dependency], threshold: float = 0.8) -> DataFrame:
    """(lhs, rhs, confidence, exact, holds) of each pair of a left side (one column or several) and a column.

    Confidence is the share of rows that keep if each lhs value keeps its most frequent rhs value; exact
    means that every lhs value has one rhs value. Nulls are a value of their own. Rows are reduced to
    counts of value pairs in one shuffle for all pairs of columns.
    """
    cells = F.array(*[F.struct(F.lit(left_name(a)).alias("lhs"), F.lit(b).alias("rhs"), left_value([F.col(c) for c in left_columns(a)]).alias("x"), F.col(b).cast("string").alias("y")) for a, b in pairs])
    counted = df.select(F.explode(cells).alias("c")).select("c.*").groupBy("lhs", "rhs", "x", "y").agg(F.count("*").alias("n"))
    best = counted.groupBy("lhs", "rhs", "x").agg(F.max("n").alias("most"), F.sum("n").alias("n"), F.count("*").alias("ways"))
    out = best.groupBy("lhs", "rhs").agg((F.sum("most") / F.sum("n")).alias("confidence"), (F.max("ways") == 1).alias("exact"))
    return out.withColumn("holds", F.col("exact") | (F.col("confidence") >= threshold))


def all_pairs(columns: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for a in columns for b in columns if a != b]


def group_counts(df: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """(columns, n): number of distinct value combinations of each set of columns; nulls are a value.

    All sets are grouping sets of one aggregation, combined before its shuffle. Each task counts its groups by
    set, so what follows the shuffle is a row for each set and task.
    """
    used = [c for c in df.columns if any(c in s for s in sets)]
    name = F.concat_ws(",", *[F.when(F.col(f"_in_{i}") == 0, F.lit(c)) for i, c in enumerate(used)])
    view, marks = "{rows}", ", ".join(f"grouping(`{c}`) AS _in_{i}" for i, c in enumerate(used))
    listed = ", ".join("(" + ", ".join(f"`{c}`" for c in s) + ")" for s in sets)
    groups = df.sparkSession.sql(f"SELECT {marks} FROM {view} GROUP BY {', '.join(f'`{c}`' for c in used)} GROUPING SETS ({listed})", rows=df.select(*used))
    return groups.groupBy(name.alias("columns")).agg(F.count("*").alias("n"))


def lattice(df: DataFrame, columns: list[str], most: int = 3) -> list[tuple[tuple[str, ...], str]]:
    """Minimal exact dependencies with at most ``most`` columns on the left, as (lhs, rhs); an empty lhs stands for a constant column.

    Sets of columns are gone through level by level. A dependency X -> A holds if X and X with A part the rows
    into equally many groups, so a level needs the group counts of its sets: one aggregation, one shuffle of rows. A set
    is left out of the next level if one of its subsets is a key (it parts all rows, so whatever it would
    tell is not minimal) or if no right side is open for it: dependencies found below close those that
    they imply. What the driver holds is a number for each set. Repeated rows are one; nulls are a value; in an empty table
    all columns are constant.
    """
    columns = list(columns)
    order = {c: i for i, c in enumerate(columns)}
    rows = df.select(*columns)
    total, counts = 0, {(): 0}  # with the first level's counts comes that of all columns
    every = frozenset(columns)
    open_for: dict[tuple[str, ...], frozenset[str]] = {(): every}
    found: list[tuple[tuple[str, ...], str]] = []
    level = [(c,) for c in columns]
    for size in range(1, most + 2):
        if not level:
            break
        wanted = [*level, tuple(columns)] if size == 1 and len(columns) > 1 else level
        counts |= {tuple(sorted(filter(None, r["columns"].split(",")), key=order.get)): r["n"] for r in group_counts(rows, wanted).collect()}
        if size == 1:
            total = counts.get(tuple(columns), 0)
            counts[()] = min(total, 1)
        for s in level:
            counts.setdefault(s, 0)
            rest = {c: tuple(x for x in s if x != c) for c in s}
            candidates = frozenset.intersection(*(open_for.get(r, frozenset()) for r in rest.values()))
            for c in s:
                if c in candidates and counts[rest[c]] == counts[s]:
                    found.append((rest[c], c))
                    candidates = (candidates - {c}) & frozenset(s)
            open_for[s] = candidates
        alive = []
        for s in level:
            if not open_for[s]:
                continue
            if counts[s] == total:  # a key: it determines what no smaller set in it does
                if size <= most:
                    found += [(s, c) for c in columns if c in open_for[s] - frozenset(s) and not _implied(found, s, c)]
                continue
            alive.append(s)
        live = set(alive)
        joined = {(*a, b[-1]) for a, b in combinations(sorted(alive, key=lambda s: [order[c] for c in s]), 2) if a[:-1] == b[:-1]}
        level = sorted((s for s in joined if all(tuple(x for x in s if x != c) in live for c in s)), key=lambda s: [order[c] for c in s])
    return sorted(set(found), key=lambda d: (len(d[0]), [order[c] for c in d[0]], order[d[1]]))


def _implied(found: list[tuple[tuple[str, ...], str]], lhs: tuple[str, ...], rhs: str) -> bool:
    """Whether a smaller left side is known to determine ``rhs``."""
    return any(r == rhs and set(x) < set(lhs) for x, r in found)


def missing(value: Column, kind: str) -> Column:
    """Whether a cell, a number or a text, is missing."""
    return missing_number(as_double(value)) if kind != "string" else missing_text(value)


def majorities(df: DataFrame, pairs: list[Dependency], suffix: str = "") -> DataFrame:
    """(lhs, rhs, x, y, n, ways): each left value's most frequent right value (ties: the least) and how many there are.

    Missing right values have no vote. ``suffix`` belongs to the columns' names in ``df``, not to those in ``pairs``.
    Values are in canonical form. One aggregation for all dependencies, then one over counts.
    """
    counted = _cells(df, pairs, suffix).where("not missing").groupBy("lhs", "rhs", "x", "y").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("less"), "y")).alias("best")
    grouped = counted.groupBy("lhs", "rhs", "x").agg(best, F.count("*").alias("ways"), F.sum("n").alias("n"))
    return grouped.select("lhs", "rhs", "x", F.col("best.y").alias("y"), (-F.col("best.less")).alias("n"), "ways", F.col("n").alias("of"))


def _cells(df: DataFrame, pairs: list[Dependency], suffix: str = "", keep: tuple[str, ...] = (), only: dict[str, Column] | None = None) -> DataFrame:
    """(keep, lhs, rhs, x, y, missing): a row for each row and dependency; with ``only`` where the right side's test is true."""
    kinds = dict(df.dtypes)
    form = lambda c: canonical(F.col(c + suffix), kinds[c + suffix] != "string")
    made = []
    for a, b in pairs:
        cell = F.struct(F.lit(left_name(a)).alias("lhs"), F.lit(b).alias("rhs"), left_value([form(c) for c in left_columns(a)]).alias("x"), form(b).alias("y"), missing(F.col(b + suffix), kinds[b + suffix]).alias("missing"))
        made.append(F.when(only[b], cell) if only else cell)
    return df.select(*keep, F.explode(F.filter(F.array(*made), lambda c: c.isNotNull())).alias("_c")).select(*keep, "_c.*")


def breaking(df: DataFrame, key: list[str], pairs: list[Dependency], suffix: str = "", only: dict[str, Column] | None = None) -> DataFrame:
    """(key, lhs, col, x, value, expected): cells that differ from what most rows with the same left value have.

    A missing cell breaks nothing. With ``only`` (a test for each right column) just such cells are looked at;
    majorities count all rows. Left values without a conflict don't meet the cells.
    """
    conflicts = majorities(df, pairs, suffix).where("ways > 1").select("lhs", "rhs", "x", F.col("y").alias("expected"))
    cells = _cells(df, pairs, suffix, tuple(key), only).where("not missing")
    same = (cells["lhs"] == conflicts["lhs"]) & (cells["rhs"] == conflicts["rhs"]) & cells["x"].eqNullSafe(conflicts["x"])
    hit = cells.join(conflicts, same).where(F.col("y") != F.col("expected"))
    return hit.select(*key, cells["lhs"], cells["rhs"].alias("col"), cells["x"], F.col("y").alias("value"), "expected")
