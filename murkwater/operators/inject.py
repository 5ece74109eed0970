"""Error injection: plan new errors, choose their cells, and apply all edits with one join.

Edits are rows (_row_id, col, value, error_class). Cells are chosen by rank lines: rows are ranked by a
seeded digest, and consecutive intervals of the line go to the planned errors, so no cell is hit twice.
Swaps, broken dependencies and replacements, which need given clean values, come first, ranked within that value; the other
classes share the line of the rows that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folder import written
from ..functions.values import MISSING_TEXTS, canonical
from .allocate import allocate, intervals, new_count
from .dependencies import Dependency, left_columns, left_name, left_value
from .pairs import Fences
from .ranks import digits_for, hashed, ranked

EDITS = "_row_id long, col string, value string, error_class string"


def place(rows: DataFrame, plan: DataFrame, seed: int, within: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """``rows`` (with _row_id and ``within``) joined to the plan row whose interval holds their rank.

    The plan, which is read several times and had better be written, has one row for each distinct erroneous value; only rows that its groups may need are ranked. It meets rows in an equi-join of unit
    blocks: an interval is cut at multiples of its group's block length, so no range join is needed.
    """
    within = within or []
    line = ranked(rows, hashed(seed, F.col("_row_id")), within, most=plan.groupBy(*within).agg(F.sum("planned").alias("most")))
    cut = intervals(plan, within, order or ["value"])
    width = 256
    blocks = cut.withColumn("_block", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    renamed = blocks.select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(within)], *[c for c in blocks.columns if c not in within])
    same = F.floor(F.col("rank") / width) == F.col("_block")
    for i, c in enumerate(within):
        same = same & (F.col(c) == F.col(f"_w{i}"))
    hit = line.join(renamed, same & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return hit.drop("_block", "rank", "lo", "hi", *[f"_w{i}" for i in range(len(within))])


def replacements(scaled: DataFrame, kinds: dict[str, str], histogram: DataFrame, factor: float, seed: int) -> DataFrame:
    """Edits for all columns of ``kinds`` from (col, clean, dirty, n): rows with the clean value get the dirty ones, all alternatives in turn.

    The columns' cells are one keyed table, so there is one plan however many columns there are. If a clean
    value has too few rows, what is planned beyond them is not injected; validation shows it.
    """
    plan = histogram.where(F.col("col").isin(*kinds)).select("col", canonical(F.col("clean"), False).alias("_was"), F.col("dirty").alias("value"), new_count(F.col("n"), factor).alias("planned"))
    plan = written(plan, "plan")  # it is read several times
    cells = F.array(*[F.struct(F.lit(c).alias("col"), canonical(F.col(c), k == "num").alias("_was")) for c, k in kinds.items()])
    rows = scaled.select("_row_id", F.explode(cells).alias("x")).select("_row_id", "x.*").join(plan.select("col", "_was").distinct(), ["col", "_was"], "left_semi")
    return place(rows, plan, seed, ["col", "_was"]).select("_row_id", "col", "value", F.lit("REPLACEMENT").alias("error_class"))


def broken(scaled: DataFrame, kinds: dict[str, str], dependencies: list[Dependency], histogram: DataFrame, factor: float, seed: int) -> DataFrame:
    """Edits that break dependencies, from (lhs, col, x, value, n): the same left values get the same wrong right values, round(n * factor) times.

    So as many groups break as before, and no other. Rows of a group are chosen by rank; most of a group keep their value, as
    before. A cell that several dependencies claim gets one edit.
    """
    keys = ["lhs", "col", "x"]
    plan = written(histogram.select(*keys, "value", new_count(F.col("n"), factor).alias("planned")), "plan")  # it is read several times
    form = lambda c: canonical(F.col(c), kinds.get(c, "num" if dict(scaled.dtypes)[c] != "string" else "str") == "num")
    cells = F.array(*[F.struct(F.lit(left_name(a)).alias("lhs"), F.lit(b).alias("col"), left_value([form(c) for c in left_columns(a)]).alias("x")) for a, b in dependencies])
    rows = scaled.select("_row_id", F.explode(cells).alias("c")).select("_row_id", "c.*").join(plan.select(*keys).distinct(), keys, "left_semi")
    hit = place(rows, plan, seed, keys)
    if len({b for _, b in dependencies}) < len(dependencies):
        hit = hit.groupBy("_row_id", "col").agg(F.min(F.struct("lhs", "value")).alias("h")).select("_row_id", "col", "h.value")
    return hit.select("_row_id", "col", "value", F.lit("FD").alias("error_class"))


def swaps(scaled: DataFrame, kinds: dict[str, str], histogram: DataFrame, factor: float, seed: int) -> DataFrame:
    """Edits from (col1, col2, clean1, dirty1, n): rows with both values in place get them exchanged, two edits a row.

    Only pairs of columns that the histogram has are looked at, all in one keyed table. A row that suits
    several pairs is used for the first.
    """
    names = list(kinds)
    plan = histogram.select("col1", "col2", canonical(F.col("clean1"), False).alias("_x"), canonical(F.col("dirty1"), False).alias("_y"), F.col("clean1").alias("value"), "dirty1", new_count(F.col("n"), factor).alias("planned"))
    plan = written(plan, "plan")  # it is read several times
    found = {(r.col1, r.col2) for r in plan.select("col1", "col2").distinct().collect()}  # at most one for each two columns
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if (a, b) in found]
    if not pairs:
        return scaled.sparkSession.createDataFrame([], EDITS)
    keys = ["col1", "col2", "_x", "_y"]
    cells = F.array(*[F.struct(F.lit(a).alias("col1"), F.lit(b).alias("col2"), canonical(F.col(a), kinds[a] == "num").alias("_x"), canonical(F.col(b), kinds[b] == "num").alias("_y")) for a, b in pairs])
    rows = scaled.select("_row_id", F.explode(cells).alias("x")).select("_row_id", "x.*").join(plan.select(*keys).distinct(), keys, "left_semi")
    hit = place(rows, plan, seed, keys)
    if len(pairs) > 1:
        hit = hit.groupBy("_row_id").agg(F.min(F.struct("col1", "col2", "value", "dirty1")).alias("h")).select("_row_id", "h.*")
    both = F.array(F.struct(F.col("col1").alias("col"), F.col("dirty1").alias("value")), F.struct(F.col("col2").alias("col"), F.col("value").alias("value")))
    return hit.select("_row_id", F.explode(both).alias("e")).select("_row_id", "e.col", "e.value", F.lit("SWAP").alias("error_class"))


def line_cells(scaled: DataFrame, most: DataFrame, seed: int) -> DataFrame:
    """(_row_id, col): for each column of ``most`` (col, most) at least so many cells, the first of its rank line.

    Rows are counted by the leading digits of their digest; only those of the first buckets leave the table.
    """
    rows = scaled.select("_row_id").withColumn("_bucket", F.substring(hashed(seed, F.col("_row_id")), 1, digits_for(scaled.sparkSession)))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # over bucket sizes
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    keep = sizes.crossJoin(F.broadcast(most)).where("_first < most").groupBy("_bucket").agg(F.collect_list("col").alias("cols"))
    return rows.join(keep, "_bucket").select("_row_id", F.explode("cols").alias("col"))


def typo(text: Column, salt: Column) -> Column:
    """A misspelling: max(1, min(round(length / 2), 3)) edits, each by the digest of text, salt and its number.

    An edit exchanges neighbours, drops a character or puts one in, never at the last one; a text of up to
    two characters gets one at the end. New characters are the visible ones of ASCII. Different salts give
    different misspellings; the caller drops those that are clean values.
    """

    def edited(now: Column, k: Column) -> Column:
        digest = hashed("typo", text, salt, k)
        digit = lambda i: F.conv(F.substring(digest, i, 4), 16, 10).cast("int")
        parts = F.struct(now.alias("now"), F.length(now).alias("n"), (F.pmod(digit(1), F.greatest(F.length(now) - 1, F.lit(1))) + 1).alias("at"), F.char(F.lit(33) + F.pmod(digit(5), F.lit(94))).alias("letter"), F.pmod(digit(9), F.lit(3)).alias("kind"))

        def made(p: Column) -> Column:
            head, tail = F.substring(p["now"], F.lit(1), p["at"] - 1), F.substring(p["now"], p["at"] + 2, p["n"])
            one, two = F.substring(p["now"], p["at"], F.lit(1)), F.substring(p["now"], p["at"] + 1, F.lit(1))
            changed = F.when((p["kind"] == 0) & (one != two), F.concat(head, two, one, tail)).when(p["kind"] == 1, F.concat(head, two, tail)).otherwise(F.concat(head, p["letter"], one, two, tail))
            return F.when(p["n"] <= 2, F.concat(p["now"], p["letter"])).otherwise(changed)

        return F.element_at(F.transform(F.array(parts), made), 1)  # so that each part is made once

    edits = F.greatest(F.lit(1), F.least(F.bround(F.length(text) / 2).cast("int"), F.lit(3)))
    return F.aggregate(F.sequence(F.lit(1), edits), text, edited)


def missing_values(histogram: DataFrame, wanted: DataFrame, kinds: dict[str, str], factor: float) -> DataFrame:
    """(col, value, planned) of missing tokens: the existing ones of (col, value, n) and new ones in natural order, up to ``wanted`` (col, estimate) distinct."""
    tokens = [(c, t) for c, k in kinds.items() for t in ("-9999", "99999", *(() if k == "num" else MISSING_TEXTS))]
    fresh = histogram.sparkSession.createDataFrame(tokens, "col string, value string").join(histogram.select("col", "value"), ["col", "value"], "left_anti")
    room = histogram.groupBy("col").agg(F.count("*").alias("known")).join(wanted, "col").select("col", (F.col("estimate") - F.col("known")).alias("room"))
    extra = fresh.withColumn("i", F.row_number().over(Window.partitionBy("col").orderBy("value"))).join(room, "col").where("i <= room")
    both = histogram.select("col", "value", F.col("n").cast("long").alias("n")).unionByName(extra.select("col", "value", F.lit(1).cast("long").alias("n")))
    total = histogram.groupBy("col").agg(new_count(F.sum("n"), factor).alias("total"))
    return allocate(both, total, ["col"]).select("col", "value", "planned")


OUTLIERS = "col string, total long, distinct long, centre double, mean double, reach double, range double, deviation double, least double, whole boolean"


def outlier_row(column: str, total: int, distinct: int, centre: float, mean: float, limits: Fences, whole: bool = False) -> tuple:
    """What ``outliers`` needs to know of a column. ``centre`` is where the mean of its outliers shall be: that of those that it has."""
    reach = max(abs(x - mean) for pair in (limits.iqr, limits.sigma, limits.span) for x in pair if x is not None) or 1.0
    deviation = 0.0 if limits.sigma[0] is None else (limits.sigma[1] - limits.sigma[0]) / 6
    return column, total, max(1, min(distinct, total)), float(centre), float(mean), float(reach), float(limits.span[1] - limits.span[0]), float(deviation), float(limits.span[0]), whole


def outliers(columns: DataFrame, seed: int, most: int | None = None) -> DataFrame:
    """(col, value, planned) of values outside the fences, with counts that add up to ``total``, from rows of OUTLIERS.

    Values come in pairs at equal distance above and below ``centre``, so the mean of what is injected is that
    of the outliers there were, and the column's mean grows as it should; an odd one out lies above. Distances
    come from seven generators in turn: the range beyond the shift of the mean (above and below), a number
    times ten until it is outside, a number beyond either fence, and three deviations beyond the least value
    (above and below). ``most`` is the largest number of distinct values of a column, if it is known. Each is at least the fences' reach and the shift, so both values are outside.
    """
    most = max(most, 1) if most is not None else columns.agg(F.max("distinct")).first()[0] or 0
    rows = columns.sparkSession.range(most).withColumnRenamed("id", "k").crossJoin(F.broadcast(columns)).where("total > 0 and k < distinct")
    draw = F.floor(F.col("k") / 2)
    number = F.conv(F.substring(hashed(seed, F.lit("outlier"), F.col("col"), draw), 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("u", (F.pmod(number, F.lit(999983)) + 1) / 999984.0).withColumn("shift", F.abs(F.col("centre") - F.col("mean")))
    v, kind = F.col("u") * F.col("reach"), F.pmod(draw, F.lit(7))
    far = (
        F.when(kind <= 1, F.col("range") + F.col("shift"))
        .when(kind == 2, v * F.pow(F.lit(10.0), F.ceil(-F.log10("u"))))
        .when(kind <= 4, F.col("reach") + v)
        .otherwise(3 * F.col("deviation") + F.abs("least"))
    )
    distance = F.greatest(far, F.col("reach") + F.col("shift")) * (1.001 + F.col("u") / 100)
    value = F.when(F.col("k") % 2 == 0, F.col("centre") + distance).otherwise(F.col("centre") - distance)
    outward = F.when(F.col("k") % 2 == 0, F.ceil(value)).otherwise(F.floor(value))
    value = F.when(F.col("whole"), outward.cast("string")).otherwise(value.cast("string"))
    planned = F.floor(F.col("total") / F.col("distinct")) + (F.col("k") < F.pmod("total", "distinct")).cast("long")
    return rows.select("col", value.alias("value"), planned.alias("planned"))


def apply(scaled: DataFrame, edits: DataFrame, columns: list[str], suffix: str = "__dirty") -> DataFrame:
    """``scaled`` with ``c + suffix`` for each column: the edited value where there is an edit (which may be null), else the value.

    All edits of a row become one map, so the table is joined once however many columns and classes there
    are. Of several edits of one cell the first class in natural order wins; the planner makes none.
    """
    order = Window.partitionBy("_row_id", "col").orderBy("error_class", "value")
    single = edits.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    wide = single.groupBy("_row_id").agg(F.map_from_entries(F.collect_list(F.struct("col", F.struct(F.col("value").alias("v")).alias("e")))).alias("_edits"))
    joined = scaled.join(wide, "_row_id", "left")
    kinds = dict(scaled.dtypes)
    made = {}
    for c in columns:
        edit = F.try_element_at("_edits", F.lit(c))
        value = F.when(edit.isNotNull(), edit["v"].try_cast(kinds[c])).otherwise(F.col(c))
        made[c + suffix] = value
    return joined.withColumns(made).drop("_edits")


def drop_clean(values: DataFrame, clean: DataFrame) -> DataFrame:
    """Values (col, value, ...) that no clean cell (col, value) has. Clean cells are reduced to the values in question first."""
    hit = clean.join(values.select("col", "value").distinct(), ["col", "value"], "left_semi").distinct()
    return values.join(hit, ["col", "value"], "left_anti")
