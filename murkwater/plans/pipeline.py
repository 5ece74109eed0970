"""The whole engine: profile a pair, scale the clean table, inject errors in proportion, profile again, validate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folder import place, written
from ..functions.values import number
from ..operators import dependencies as fd
from ..operators import estimators, inject, pairs, profile, scale, validate
from ..operators.allocate import allocate, new_count
from ..operators.dependencies import Dependency
from ..sources import tables


def bucketed(df: DataFrame, name: str, by: str = "_row_id", buckets: int | None = None) -> DataFrame:
    """``df`` written in buckets by row id in the shared folder, as many as the session has shuffle partitions; a catalog table of a name of its own."""
    path = place(df.sparkSession, name)
    count = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tables.write_bucketed(df, path, path.rsplit("/", 1)[-1].replace("-", "_"), by, count)


@dataclass
class Run:
    """What a run makes, as DataFrames."""

    cells: DataFrame
    original: DataFrame
    scaled: DataFrame
    edits: DataFrame
    generated: DataFrame
    regenerated: DataFrame
    validation: DataFrame
    again: DataFrame


def numeric(kinds: dict[str, str]) -> list[str]:
    return [c for c, k in kinds.items() if k == "num"]


def dirty_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """The dirty side of numeric columns as numbers, under the columns' own names; text that is no number is null."""
    stored = dict(df.dtypes)
    return df.select(*[(number(F.col(c + pairs.DIRTY)) if stored[c + pairs.DIRTY] == "string" else F.col(c + pairs.DIRTY)).alias(c) for c in columns])


def plan_edits(scaled: DataFrame, cells: DataFrame, pair: DataFrame, kinds: dict[str, str], limits: dict[str, pairs.Fences], factor: float, seed: int, dependencies: list[Dependency] | None = None) -> DataFrame:
    """Edits for all columns and classes; what the driver learns are counts and means of each column, a few numbers.

    Rows of a swap or of a broken dependency are taken out of all later lines, replaced cells out of their column's; missing values,
    outliers and typos then share one line per column. Each step is one plan for all columns.
    """
    counts = [F.count_if(F.col("error_class") == c).alias(c) for c in pairs.CLASSES]
    outlying = F.when(F.col("error_class") == "OUTLIER", number(F.col("dirty")))
    summary = {r["col"]: r for r in cells.groupBy("col").agg(*counts, F.count_distinct(outlying).alias("seen"), F.avg(outlying).alias("centre")).collect()}
    of = lambda *classes: {c: k for c, k in kinds.items() if c in summary and any(summary[c][x] for x in classes)}
    swapped = written(inject.swaps(scaled, kinds, pairs.swap_histogram(cells, kinds), factor, seed), "edits") if of("SWAP") else None
    replaced = None
    if dependencies and of("FD"):
        free = scaled if swapped is None else scaled.join(swapped.select("_row_id").distinct(), "_row_id", "left_anti")
        broken = written(inject.broken(free, kinds, dependencies, pairs.histogram(cells, "fd"), factor, seed), "edits")
        swapped = broken if swapped is None else swapped.unionByName(broken)
    if of("REPLACEMENT"):
        free = scaled if swapped is None else scaled.join(swapped.select("_row_id").distinct(), "_row_id", "left_anti")
        replaced = written(inject.replacements(free, of("REPLACEMENT"), pairs.histogram(cells, "replacement"), factor, seed), "edits")
    done = [x for x in (swapped, replaced) if x is not None]
    plan = line_plan(cells, pair, of("MV", "OUTLIER", "TYPO"), summary, limits, factor, seed)
    if plan is not None:
        done.append(inject.place(_free_cells(scaled, plan, swapped, replaced, seed + 1), plan, seed + 1, ["col"], ["error_class", "value"]).select("_row_id", "col", "value", "error_class"))
    edits = scaled.sparkSession.createDataFrame([], inject.EDITS)
    for part in done:
        edits = part if part is done[0] else edits.unionByName(part)
    return edits


def _free_cells(scaled: DataFrame, plan: DataFrame, swapped: DataFrame | None, replaced: DataFrame | None, seed: int) -> DataFrame:
    """(_row_id, col) of the plan's columns, enough of each line's first cells for what is planned, without those already edited."""
    columns = plan.groupBy("col").agg(F.sum("planned").alias("planned"))
    taken = [replaced.select("_row_id", "col")] if replaced is not None else []
    if swapped is not None:
        taken.append(swapped.select("_row_id").distinct().crossJoin(F.broadcast(columns.select("col"))))
    if not taken:
        return inject.line_cells(scaled, columns.withColumnRenamed("planned", "most"), seed)
    both = taken[0] if len(taken) == 1 else taken[0].unionByName(taken[1])
    lost = both.groupBy("col").agg(F.count("*").alias("lost"))
    most = columns.join(lost, "col", "left").select("col", (F.col("planned") + F.coalesce("lost", F.lit(0))).alias("most"))
    return inject.line_cells(scaled, most, seed).join(both, ["_row_id", "col"], "left_anti")


def line_plan(cells: DataFrame, pair: DataFrame, kinds: dict[str, str], summary: dict, limits: dict[str, pairs.Fences], factor: float, seed: int) -> DataFrame | None:
    """(col, value, planned, error_class) of all columns' missing values, outliers and typos, written once."""
    parts = []
    has = lambda error_class: {c: k for c, k in kinds.items() if summary[c][error_class]}
    if has("MV"):
        old = cells.where("error_class = 'MV'").groupBy("col", F.col("dirty").alias("value")).agg(F.count("*").alias("n"))
        fof = old.groupBy(F.col("col").alias("column"), F.col("n").alias("i")).agg(F.count("*").alias("f"))
        wanted = estimators.estimates(fof, factor).select(F.col("column").alias("col"), "estimate")
        parts.append(inject.missing_values(old, wanted, has("MV"), factor).withColumn("error_class", F.lit("MV")))
    if has("OUTLIER"):
        most = max(scale.rounded(summary[c]["seen"], factor) for c in has("OUTLIER"))
        parts.append(inject.outliers(outlier_columns(pair, list(has("OUTLIER")), summary, limits, factor), seed, most).withColumn("error_class", F.lit("OUTLIER")))
    if has("TYPO"):
        parts.append(typo_plan(cells, pair, list(has("TYPO")), factor).withColumn("error_class", F.lit("TYPO")))
    plan = None
    for part in parts:
        plan = part if plan is None else plan.unionByName(part)
    return None if plan is None else written(plan, "plan")


def outlier_columns(pair: DataFrame, columns: list[str], summary: dict, limits: dict[str, pairs.Fences], factor: float) -> DataFrame:
    """What new outliers of these columns need: a few numbers for each."""
    stored = dict(pair.dtypes)
    rows = []
    for c in columns:
        whole = stored[c] in ("tinyint", "smallint", "int", "bigint")
        rows.append(inject.outlier_row(c, scale.rounded(summary[c]["OUTLIER"], factor), scale.rounded(summary[c]["seen"], factor), summary[c]["centre"], limits[c].mean, limits[c], whole))
    return pair.sparkSession.createDataFrame(rows, inject.OUTLIERS)


def typo_plan(cells: DataFrame, pair: DataFrame, columns: list[str], factor: float) -> DataFrame:
    """(col, value, planned): existing typos and as many new distinct ones as growth asks for, none of them a clean value."""
    old = cells.where(F.col("col").isin(*columns) & (F.col("error_class") == "TYPO")).groupBy("col", F.col("dirty").alias("value"), "clean").agg(F.count("*").alias("n"))
    more = F.greatest(F.lit(0), new_count(F.count("*"), factor) - F.count("*"))
    wanted = old.groupBy("col", "clean").agg(more.alias("more")).where("more > 0")
    made = wanted.select("col", "clean", F.explode(F.sequence(F.lit(1), F.col("more"))).alias("k")).select("col", inject.typo(F.col("clean"), F.col("k")).alias("value")).distinct()
    clean = pair.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    fresh = inject.drop_clean(made, clean).join(old.select("col", "value"), ["col", "value"], "left_anti")
    both = old.groupBy("col", "value").agg(F.sum("n").alias("n")).unionByName(fresh.select("col", "value", F.lit(1).cast("long").alias("n")))
    total = old.groupBy("col").agg(new_count(F.sum("n"), factor).alias("total"))
    return allocate(both, total, ["col"]).select("col", "value", "planned")


def distinct_estimates(cells: DataFrame, factor: float) -> DataFrame:
    """(column, typos, missing, outliers): estimated distinct erroneous values of a table ``factor`` times as large; outliers as they are."""

    def estimated(error_class: str, name: str) -> DataFrame:
        some = cells.where(F.col("error_class") == error_class).groupBy(F.col("col").alias("column"), "dirty").agg(F.count("*").alias("i"))
        return estimators.estimates(some.groupBy("column", "i").agg(F.count("*").alias("f")), factor).select("column", F.col("estimate").alias(name))

    outlying = cells.where("error_class = 'OUTLIER'").groupBy(F.col("col").alias("column")).agg(F.count_distinct("dirty").alias("outliers"))
    return estimated("TYPO", "typos").join(estimated("MV", "missing"), "column", "full").join(outlying, "column", "full")


def profile_checks(cells: DataFrame, again: DataFrame, pair: DataFrame, generated: DataFrame, kinds: dict[str, str], factor: float) -> DataFrame:
    """What a run checks beside class counts and dependencies: populations, replaced values, distincts, moments, quartiles and correlations.

    ``cells`` and ``again`` are the differing cells of the original and the generated pair. Nulls of dirty numbers count as 0.
    """
    checks = validate.replaced_values(cells, again).unionByName(validate.error_populations(cells, again))
    distinct = lambda df, suffix: profile.distinct_counts(df.select(*[F.col(c + suffix).alias(c) for c in kinds]), list(kinds))
    checks = checks.unionByName(validate.distincts(distinct(pair, ""), distinct(generated, pairs.DIRTY), distinct_estimates(cells, factor), factor))
    names = numeric(kinds)
    if not names:
        return checks
    sides = [dirty_numbers(df, names).na.fill(0.0) for df in (pair, generated)]
    quartiles = [profile.quantiles(df, names) for df in sides]
    stats = [profile.moments(df, names).join(q, "column") for df, q in zip(sides, quartiles, strict=True)]
    checks = checks.unionByName(validate.statistics(*stats, ["mean", "var", "min", "max", "skew", "kurt", "q25", "q50", "q75"])).unionByName(validate.inside_band(*quartiles))
    if len(names) > 1:
        checks = checks.unionByName(validate.correlation_drift(*[profile.correlations(df, names) for df in sides]))
    return checks


def run(pair: DataFrame, key: list[str], kinds: dict[str, str], factor: float, seed: int = 3215, dependencies: list[Dependency] | None = None, full: bool = False) -> Run:
    """Profile ``pair`` (aligned, see operators.pairs), scale, inject, profile again and validate.

    Differing cells, the scaled table and the edits are used by several later steps and are written to
    the shared folder once; all else stays a plan.

    Small tables and fractional factors repeat groups of equal rows (see scale.strategy), others whole rows.

    ``dependencies`` (left columns, right column) that the clean table keeps make cells that break them a class of
    their own, and their confidence in the dirty table is validated. All their columns are among ``kinds``.

    Class counts and, of numeric columns, means, variances and ends are validated; with ``full`` all that
    ``profile_checks`` knows.

    With a factor of 1 the dirty side stands as it is; below 1 the pair is cut and nothing is injected.
    """
    limits = pairs.fences(pair, numeric(kinds))
    cells = written(pairs.classify(pair, key, kinds, limits, dependencies=dependencies), "cells")
    original = pairs.class_counts(cells)
    columns = list(kinds)
    if factor <= 1:
        scaled = (pair if factor == 1 else scale.shrink(pair, key[0], factor)).withColumn("_row_id", F.col(key[0]).cast("long"))
        edits = pair.sparkSession.createDataFrame([], inject.EDITS)
        generated = scaled
    else:
        scaled = written(scale.scaled(pair.select(*key, *columns), key, columns, factor, seed), "scaled")
        edits = written(plan_edits(scaled, cells, pair, kinds, limits, factor, seed, dependencies), "edits")
        generated = inject.apply(scaled, edits, columns)
    found = pairs.classify(generated, ["_row_id"], kinds, limits, dependencies=dependencies)
    found = written(found, "cells") if full else found
    again = pairs.class_counts(found)
    dirty = lambda df: dirty_numbers(df, numeric(kinds))
    checks = validate.counts(original, again, factor)
    if full:
        checks = checks.unionByName(profile_checks(cells, found, pair, generated, kinds, factor))
    elif numeric(kinds):
        stats = validate.statistics(profile.moments(dirty(pair), numeric(kinds), True), profile.moments(dirty(generated), numeric(kinds), True), ["mean", "var", "min", "max"])
        checks = checks.unionByName(stats)
    if dependencies:
        kept = lambda df: fd.confidences(df.select(*[F.col(c + pairs.DIRTY).alias(c) for c in columns]), dependencies)
        checks = checks.unionByName(validate.confidences(kept(pair), kept(generated)))
    return Run(cells, original, scaled, edits, generated, again, checks, found)
