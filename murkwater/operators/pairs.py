"""Clean and dirty tables as one: alignment, differing cells and their error classes.

An aligned pair is a DataFrame with a column ``c`` (clean) and ``c__dirty`` for each compared column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import as_double, canonical, differs, missing_number, missing_text, number
from . import profile
from .dependencies import Dependency, breaking
from .ranks import hashed, ranked

DIRTY = "__dirty"
#: Classes in order of precedence.
CLASSES = ("MV", "SWAP", "OUTLIER", "FD", "REPLACEMENT", "TYPO", "RESIDUAL")


@dataclass(frozen=True)
class Fences:
    """Limits of a clean numeric column, and its mean; a dirty value outside any of the limits is an outlier."""

    iqr: tuple[float, float]
    sigma: tuple[float, float]
    span: tuple[float, float]
    mean: float | None = None

    def outside(self, value: Column, which: str = "all") -> Column:
        limits = [self.iqr, self.sigma, self.span] if which == "all" else [getattr(self, which)]
        tests = [(value < lo) | (value > hi) for lo, hi in limits if lo is not None]
        found = F.lit(False)
        for t in tests:
            found = found | t
        return found


def align(clean: DataFrame, dirty: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Join two tables on their key to an aligned pair; rows of one side only have ``_side`` clean or dirty."""
    left = clean.select(*key, *columns, F.lit(True).alias("_in_clean"))
    right = dirty.select(*key, *[F.col(c).alias(c + DIRTY) for c in columns], F.lit(True).alias("_in_dirty"))
    both = left.join(right, key, "full")
    side = F.when(F.col("_in_clean").isNull(), "dirty").when(F.col("_in_dirty").isNull(), "clean").otherwise("both")
    return both.withColumn("_side", side).drop("_in_clean", "_in_dirty")


def positioned(df: DataFrame, name: str = "_row_id") -> DataFrame:
    """``df`` with each row's 0-based place in its source, for tables without a key.

    A row's place in its partition is the low part of its generated id; partitions start after those
    before them. Only partition sizes are summed up in one place. Sources must split alike whenever they
    are read, as files do.
    """
    rows = df.withColumn("_m", F.monotonically_increasing_id())
    sizes = rows.groupBy(F.shiftright("_m", 33).alias("_p")).agg(F.count("*").alias("_n"))
    first = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("_p", F.shiftright("_m", 33)).join(F.broadcast(sizes.select("_p", first.alias("_f"))), "_p")
    return placed.withColumn(name, F.col("_f") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_f")


def fences(pair: DataFrame, numeric: list[str]) -> dict[str, Fences]:
    """All limits: moments come with the first pass of the quartiles; a few numbers for each column come to the driver."""
    if not numeric:
        return {}
    stored = dict(pair.dtypes)
    values = pair.select(*[(number(F.col(c)) if stored[c] == "string" else as_double(F.col(c))).alias(c) for c in numeric])
    out = {}
    for c, (row, (q1, _, q3)) in profile.quartiles(values, numeric, also={"mean": F.avg, "sd": F.stddev_samp, "lo": F.min, "hi": F.max}).items():
        if not row.n:
            out[c] = Fences((None, None), (None, None), (None, None))
            continue
        reach = 1.5 * (q3 - q1)
        sigma = (None, None) if row.sd is None else (row.mean - 3 * row.sd, row.mean + 3 * row.sd)
        out[c] = Fences((q1 - reach, q3 + reach), sigma, (row.lo, row.hi), row.mean)
    return out


def differing(pair: DataFrame, c: str, kind: str) -> Column:
    """Whether a row's clean and dirty values of a column differ, by the column's kind."""
    stored = dict(pair.dtypes)
    as_kind = lambda name: F.col(name) if kind != "num" else number(F.col(name)) if stored[name] == "string" else as_double(F.col(name))
    return differs(as_kind(c), as_kind(c + DIRTY))


def diff_cells(pair: DataFrame, key: list[str], kinds: dict[str, str], limits: dict[str, Fences] | None = None, blank_is_missing: bool = True) -> DataFrame:
    """One row for each differing cell: key, ord, col, clean, dirty (text), mv, outside, swap_with.

    ``kinds`` maps columns to ``num`` or ``str``. Only differing cells leave their row, so a clean table
    costs one scan. Swaps are found inside the row, without a join: two cells that are not missing and
    hold each other's clean value; swap_with is the least such column's place.
    """
    limits = fences(pair, [c for c, k in kinds.items() if k == "num"]) if limits is None else limits
    stored = dict(pair.dtypes)
    cells, any_differ = [], F.lit(False)
    for i, (c, kind) in enumerate(kinds.items()):
        clean, dirty = F.col(c), F.col(c + DIRTY)
        is_text = stored[c + DIRTY] == "string"
        if kind == "num":
            missing = missing_text(dirty, True, blank_is_missing) if is_text else missing_number(as_double(dirty))
            outside = ~missing & limits[c].outside(number(dirty) if is_text else as_double(dirty))
        else:
            missing, outside = missing_text(dirty, False, blank_is_missing), F.lit(False)
        differ = differing(pair, c, kind)
        any_differ = any_differ | differ
        cells.append(
            F.struct(
                F.lit(i).alias("ord"), F.lit(c).alias("col"), F.lit(kind).alias("kind"), clean.cast("string").alias("clean"), dirty.cast("string").alias("dirty"),
                canonical(clean, kind == "num" and stored[c] != "string").alias("was"), canonical(dirty, kind == "num" and not is_text).alias("now"),
                F.coalesce(missing, F.lit(False)).alias("mv"), F.coalesce(outside, F.lit(False)).alias("outside"), differ.alias("diff"),
            )
        )
    own = F.filter(F.array(*cells), lambda x: x["diff"])
    swapped = F.transform(
        F.col("_own"),
        lambda x: F.struct(
            *[x[n].alias(n) for n in ("ord", "col", "kind", "clean", "dirty", "was", "now", "mv", "outside")],
            F.array_min(F.transform(F.filter(F.col("_own"), lambda o: (o["ord"] != x["ord"]) & ~o["mv"] & ~x["mv"] & (o["was"] == x["now"]) & (o["now"] == x["was"])), lambda o: o["ord"])).alias("swap_with"),
        ),
    )
    rows = pair.where(any_differ).select(*key, own.alias("_own"))  # the test alone is cheap; cells are made for differing rows only
    return rows.select(*key, F.explode(swapped).alias("_cell")).select(*key, "_cell.*")


def classify(pair: DataFrame, key: list[str], kinds: dict[str, str], limits: dict[str, Fences] | None = None, strict: bool = False, dependencies: list[Dependency] | None = None) -> DataFrame:
    """``diff_cells`` with known (dirty value is among the column's clean values), error_class and typo.

    With ``dependencies``, which the clean table is meant to keep, a cell that would be a replacement or RESIDUAL is FD if it
    breaks one: it differs from what most dirty rows with the same left value have. fd_lhs and fd_x tell the
    first such left side and its value. A misspelling stays one, whatever it breaks.

    Classes follow the precedence of CLASSES. typo is also true of a missing text outside the clean
    values unless ``strict``. Clean values are reduced to those that some differing cell has before they
    are made distinct, so the membership test shuffles little.
    """
    cells = diff_cells(pair, key, kinds, limits)
    wanted = cells.where("now is not null").select("col", "now").distinct()
    stored = dict(pair.dtypes)
    clean = pair.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), canonical(F.col(c), k == "num" and stored[c] != "string").alias("now")) for c, k in kinds.items()])).alias("x")).select("x.*")
    known = clean.join(wanted, ["col", "now"], "left_semi").distinct().withColumn("known", F.lit(True))
    found = cells.join(known, ["col", "now"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    broken = F.lit(False)
    if dependencies:
        only = {b: differing(pair, b, kinds[b]) for _, b in dependencies}
        found, broken = _with_broken(found, pair, key, dependencies, only), F.col("fd_lhs").isNotNull() & (F.col("known") | (F.col("kind") == "num"))
    swapped = F.col("swap_with").isNotNull()
    novel = (F.col("kind") == "str") & ~F.col("known") & ~swapped
    tag = F.when(F.col("mv"), "MV").when(swapped, "SWAP").when(F.col("outside"), "OUTLIER").when(broken, "FD").when(F.col("known"), "REPLACEMENT").when(F.col("kind") == "str", "TYPO").otherwise("RESIDUAL")
    return found.withColumn("error_class", tag).withColumn("typo", novel & ~F.col("mv") if strict else novel)


def _with_broken(cells: DataFrame, pair: DataFrame, key: list[str], dependencies: list[Dependency], only: dict[str, Column]) -> DataFrame:
    """``cells`` with fd_lhs and fd_x: the first dependency that a cell breaks; null where there is none."""
    hit = breaking(pair, key, dependencies, DIRTY, only).groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("col").alias("_col"))
    hit = hit.agg(F.min(F.struct("lhs", "x")).alias("_fd"))
    same = F.col("col") == F.col("_col")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return cells.join(hit, same, "left").withColumns({"fd_lhs": F.col("_fd.lhs"), "fd_x": F.col("_fd.x")}).drop("_col", "_fd", *[f"_k{i}" for i in range(len(key))])


def class_counts(cells: DataFrame) -> DataFrame:
    """(col, error_class, n)."""
    return cells.groupBy("col", "error_class").agg(F.count("*").alias("n"))


def histogram(cells: DataFrame, what: str) -> DataFrame:
    """Value counts of one class: (col, value, n) of mv, outlier or typo; (col, clean, dirty, n) of replacement; (lhs, col, x, value, n) of fd."""
    if what == "fd":
        return cells.where("error_class = 'FD'").groupBy(F.col("fd_lhs").alias("lhs"), "col", F.col("fd_x").alias("x"), F.col("dirty").alias("value")).agg(F.count("*").alias("n"))
    if what == "replacement":
        return cells.where("error_class = 'REPLACEMENT'").groupBy("col", "clean", "dirty").agg(F.count("*").alias("n"))
    test = {"mv": "mv", "typo": "typo", "outlier": "error_class = 'OUTLIER'"}[what]
    return cells.where(test).groupBy("col", F.col("dirty").alias("value")).agg(F.count("*").alias("n"))


def swap_histogram(cells: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(col1, col2, clean1, dirty1, kind, n): kind is nums if both columns are numeric, else with_str."""
    names, types = list(kinds), list(kinds.values())
    lookup = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), i + 1)
    one = cells.where("error_class = 'SWAP' and ord < swap_with")
    other = lookup(types, F.col("swap_with"))
    return one.groupBy(F.col("col").alias("col1"), lookup(names, F.col("swap_with")).alias("col2"), F.col("clean").alias("clean1"), F.col("dirty").alias("dirty1"), F.when((F.col("kind") == "num") & (other == "num"), "nums").otherwise("with_str").alias("kind")).agg(F.count("*").alias("n"))


def flips(cells: DataFrame, key: list[str], seed: int = 3215) -> DataFrame:
    """(col, one, other, <key>, <key>__other): pairs of rows whose cells of a column hold each other's clean values.

    ``one`` is the lesser of the two values in canonical form; the first row has it where ``other`` belongs, the
    second the reverse. Both sides are ranked by a seeded digest of their keys and meet by rank, each
    cell in one pair at most; what one side has more stays alone. Missing cells and cells of a swap within their row
    take no part. Pairs are joined by rank as well, so a pair of values that very many cells exchange is spread
    over many tasks.
    """
    free = cells.where(~F.col("mv") & F.col("swap_with").isNull() & F.col("was").isNotNull() & F.col("now").isNotNull() & (F.col("was") != F.col("now")))
    sides = free.select(*key, "col", F.least("was", "now").alias("one"), F.greatest("was", "now").alias("other"), (F.col("now") < F.col("was")).alias("_low"))
    within = ["col", "one", "other"]
    both = sides.groupBy(*within).agg(F.count_if("_low").alias("_n"), F.count_if(~F.col("_low")).alias("_m")).select(*within, F.least("_n", "_m").alias("most")).where("most > 0")
    most = both.crossJoin(F.broadcast(cells.sparkSession.range(2).select((F.col("id") == 1).alias("_low"))))
    line = ranked(sides, hashed(seed, *[F.col(k) for k in key]), [*within, "_low"], most=most).join(both, within).where("rank < most").drop("most")
    second = line.where(~F.col("_low")).select(*within, "rank", *[F.col(k).alias(f"{k}__other") for k in key])
    return line.where("_low").drop("_low").join(second, [*within, "rank"]).drop("rank")
