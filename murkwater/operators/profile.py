"""Column profiles: moments, quantiles, modes, distinct counts, each in one pass over all columns."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.values import as_double


def _long(df: DataFrame, columns: list[str], of: dict[str, callable]) -> DataFrame:
    """Aggregate all columns in one pass, then one row for each column."""
    wide = df.agg(*[f(F.col(c)).alias(f"{c}__{name}") for c in columns for name, f in of.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{name}").alias(name) for name in of]) for c in columns])
    return wide.select(F.explode(rows).alias("x")).select("x.*")


def sample_skewness(v: Column) -> Column:
    """Bias-corrected; null below three values or without variance."""
    n = F.count(v)
    return F.when((n > 2) & (F.var_pop(v) > 0), F.skewness(v) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(v: Column) -> Column:
    """Bias-corrected excess; null below four values or without variance."""
    n = F.count(v)
    return F.when((n > 3) & (F.var_pop(v) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(v) + 6))


def moments(df: DataFrame, columns: list[str], nulls_as_zero: bool = False) -> DataFrame:
    """(column, n, min, max, mean, var, skew, kurt), sample versions; NaN counts as null, nulls as 0 if asked."""
    clean = df.select(*[(F.coalesce(as_double(F.col(c)), F.lit(0.0)) if nulls_as_zero else as_double(F.col(c))).alias(c) for c in columns])
    return _long(clean, columns, {"n": F.count, "min": F.min, "max": F.max, "mean": F.avg, "var": F.var_samp, "skew": sample_skewness, "kurt": sample_kurtosis})


def population_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, var, skew, kurt) of the rows as a population."""
    clean = df.select(*[as_double(F.col(c)).alias(c) for c in columns])
    return _long(clean, columns, {"var": F.var_pop, "skew": F.skewness, "kurt": F.kurtosis})


#: Sketches that narrow ranges down are off by one in SKETCH ranks; columns of a few values need none; so many values of a range are sorted at most.
SKETCH = 1_000
FEW = 20_000
SORTED = 1_000_000


@dataclass
class _Range:
    """Where a column's wanted ranks are looked for: between two values, with so many below and inside."""

    column: str
    ranks: list[int]
    lo: float = -math.inf
    hi: float = math.inf
    below: int = 0
    inside: int = 0
    narrow: bool = False

    def holds(self, v: Column) -> Column:
        return (v >= self.lo) & (v <= self.hi)


def values_at(df: DataFrame, columns: list[str], points: list[float], ranks: Callable[[int, float], list[int]], also: dict[str, Callable] | None = None) -> dict[str, tuple[Row, dict[int, float]]]:
    """For each column its number of values and what ``also`` aggregates, and the value at each of the 1-based ``ranks(total, point)``.

    A first pass counts and sketches all columns. Each point then has a range of values around it; a pass counts what
    lies below and inside, and while a range holds more than SORTED values it is narrowed by a sketch of these alone, unless
    nearly all are repeats of its ends. What is left is counted by value and sorted. So values are scanned a few times and few move. The driver learns a few numbers for each column.
    """
    values = df.select(*[as_double(F.col(c)).alias(c) for c in columns])
    near = [x for p in points for x in (max(0.0, p - 3 / SKETCH), min(1.0, p + 3 / SKETCH))]
    of = {"n": F.count, "near": lambda v: F.percentile_approx(v, F.array(*map(F.lit, near)), F.lit(SKETCH)), **(also or {})}
    first = values.agg(*[F.struct(*[f(F.col(c)).alias(k) for k, f in of.items()]).alias(c) for c in columns]).first()
    every: list[_Range] = []
    for c in columns:
        n, bounds = first[c].n, first[c].near
        for i, p in enumerate(points if n else []):
            span = _Range(c, sorted(set(ranks(n, p))), inside=n)
            if n > FEW:
                span.lo, span.hi = bounds[2 * i], bounds[2 * i + 1]
            every.append(span)
    open_ = [r for r in every if r.inside > FEW]
    _count(values, open_)
    while open_ := [r for r in open_ if r.inside > SORTED and r.lo < r.hi and not r.narrow]:
        _narrow(values, open_)
    found = {(r.column, k): r.lo for r in every if r.lo == r.hi for k in r.ranks}
    found |= _sorted_out(values, [r for r in every if r.lo < r.hi])
    return {c: (first[c], {k: v for (name, k), v in found.items() if name == c}) for c in columns}


def _count(values: DataFrame, spans: list[_Range]) -> None:
    """What lies below and inside each range; one that misses its ranks, which a sketch may do, is opened to that side."""
    todo = spans
    while todo:
        row = values.agg(*[F.struct(F.count_if(F.col(r.column) < r.lo), F.count_if(r.holds(F.col(r.column)))).alias(f"r{i}") for i, r in enumerate(todo)]).first()
        again = []
        for r, (below, inside) in zip(todo, row, strict=True):
            r.below, r.inside = below, inside
            if r.ranks[0] <= below or r.ranks[-1] > below + inside:
                r.lo = -math.inf if r.ranks[0] <= below else r.lo
                r.hi = math.inf if r.ranks[-1] > below + inside else r.hi
                again.append(r)
        todo = again


def _narrow(values: DataFrame, spans: list[_Range]) -> None:
    """Ranges drawn together around their ranks by sketches of the values inside."""
    made = []
    for i, r in enumerate(spans):
        share = lambda k, r=r: (k - r.below) / r.inside
        around = [max(0.0, share(r.ranks[0] - 1) - 3 / SKETCH), min(1.0, share(r.ranks[-1] + 1) + 3 / SKETCH)]
        made.append(F.percentile_approx(F.when(r.holds(F.col(r.column)), F.col(r.column)), F.array(*map(F.lit, around)), F.lit(SKETCH)).alias(f"r{i}"))
    before = [r.inside for r in spans]
    for r, bounds in zip(spans, values.agg(*made).first(), strict=True):
        r.lo, r.hi = bounds
    _count(values, spans)
    for r, inside in zip(spans, before, strict=True):
        r.narrow = r.inside > inside / 2  # nearly all of it are repeats of the values at its ends


def _sorted_out(values: DataFrame, spans: list[_Range]) -> dict[tuple[str, int], float]:
    """The values at the ranks of ranges that hold few values; only values inside a range leave their row."""
    if not spans:
        return {}
    cells = F.filter(F.array(*[F.when(r.holds(F.col(r.column)), F.struct(F.lit(i).alias("i"), F.col(r.column).alias("v"))) for i, r in enumerate(spans)]), lambda x: x.isNotNull())
    some = F.lit(False)
    for r in spans:
        some = some | r.holds(F.col(r.column))
    inside = values.where(some).select(F.explode(cells).alias("x")).select("x.*").groupBy("i", "v").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.lit(False)
    ranked = inside.withColumn("hi", F.sum("n").over(upto))
    for i, r in enumerate(spans):
        hit = hit | ((F.col("i") == i) & F.exists(F.array(*[F.lit(k - r.below) for k in r.ranks]), lambda k: (k <= F.col("hi")) & (k > F.col("hi") - F.col("n"))))
    out: dict[tuple[str, int], float] = {}
    for row in ranked.where(hit).collect():
        r = spans[row.i]
        out |= {(r.column, k): row.v for k in r.ranks if row.hi - row.n < k - r.below <= row.hi}
    return out


QUARTILES = (0.25, 0.5, 0.75)


def _around(position: float, total: int) -> list[int]:
    """The ranks on both sides of a fractional position."""
    return [math.floor(position), min(math.floor(position) + 1, total)]


def linear(total: int, p: float) -> float:
    """The 1-based position of a quantile by linear interpolation."""
    return (total - 1) * p + 1


def quartiles(df: DataFrame, columns: list[str], position: Callable[[int, float], float] = linear, also: dict[str, Callable] | None = None) -> dict[str, tuple[Row, list[float | None]]]:
    """For each column what ``also`` aggregates and its exact quartiles, on the driver; null without values."""
    found = values_at(df, columns, list(QUARTILES), lambda n, p: _around(position(n, p), n), also)
    out = {}
    for c, (row, at) in found.items():
        points: list[float | None] = []
        for p in QUARTILES:
            if not row.n:
                points.append(None)
                continue
            k = position(row.n, p)
            lo, hi = (at[x] for x in _around(k, row.n))
            points.append(lo + (hi - lo) * (k - math.floor(k)) if hi != lo else lo)
        out[c] = (row, points)
    return out


def _quartiles(df: DataFrame, columns: list[str], position: Callable[[int, float], float]) -> DataFrame:
    rows = [(c, *points) for c, (_, points) in quartiles(df, columns, position).items()]
    return df.sparkSession.createDataFrame(rows, "column string, q25 double, q50 double, q75 double")


def quantiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, q25, q50, q75) by linear interpolation, exact."""
    return _quartiles(df, columns, linear)


def approximate_quantiles(df: DataFrame, columns: list[str], accuracy: int = 10000) -> DataFrame:
    """(column, q25, q50, q75) by mergeable sketches of bounded size, for columns too large to count exactly."""
    clean = df.select(*[as_double(F.col(c)).alias(c) for c in columns])
    of = {f"q{round(100 * p)}": (lambda p: lambda v: F.percentile_approx(v, p, accuracy))(p) for p in (0.25, 0.5, 0.75)}
    return _long(clean, columns, of)


def plotting_quantiles(df: DataFrame, columns: list[str], alpha: float = 0.4, beta: float = 0.4) -> DataFrame:
    """(column, q25, q50, q75) with plotting positions ``alpha``, ``beta``, exact."""

    def position(total: int, p: float) -> float:
        return max(1.0, min(total * p + alpha + p * (1 - alpha - beta), float(total)))

    return _quartiles(df, columns, position)


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): every most frequent value of each column, as text; nulls don't count."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*").where("value is not null")
    counted = cells.groupBy("column", "value").agg(F.count("*").alias("n"))
    most = counted.groupBy("column").agg(F.max("n").alias("n"))
    return counted.join(most, ["column", "n"]).select("column", "value", "n")


def value_counts(df: DataFrame, column: str, nulls: bool = True) -> DataFrame:
    """(value, n) of a column."""
    rows = df if nulls else df.where(F.col(column).isNotNull())
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, distinct_excl_null, distinct_incl_null), exact."""
    return _long(df.select(*columns), columns, {"distinct_excl_null": F.count_distinct, "distinct_incl_null": lambda v: F.count_distinct(v) + F.max(v.isNull().cast("int"))})


def approximate_distinct_counts(df: DataFrame, columns: list[str], rsd: float = 0.1) -> DataFrame:
    """(column, distinct_approx) by HyperLogLog."""
    return _long(df.select(*columns), columns, {"distinct_approx": lambda v: F.approx_count_distinct(v, rsd)})


def frequency_of_frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, i, f): f distinct values occur i times; nulls don't count."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*").where("value is not null")
    return cells.groupBy("column", "value").agg(F.count("*").alias("i")).groupBy("column", "i").agg(F.count("*").alias("f"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r): Pearson correlation of every pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = df.agg(*[F.corr(as_double(F.col(a)), as_double(F.col(b))).alias(f"{a}__{b}") for a, b in pairs])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("r")) for a, b in pairs])).alias("x")).select("x.*")


def masked_mean(df: DataFrame, value: str, mask: Column) -> Column:
    """Aggregate: mean of the rows under ``mask``, of all rows if there are none."""
    return F.coalesce(F.avg(F.when(mask, F.col(value))), F.avg(value))


def bundle(df: DataFrame, columns: list[str], missing: Callable[[Column], Column], texts: list[str] | None = None, missing_text: Callable[[Column], Column] | None = None) -> DataFrame:
    """(column, rows, distinct, missing, outliers, mean, var, skew, kurt) of numeric ``columns`` and of ``texts`` in one table.

    ``missing`` and ``missing_text`` tell of a cell whether it is missing; such cells count neither as distinct values, nor as outliers (beyond
    1.5 interquartile ranges), nor in moments, which are those of the rows as a population. Texts have neither outliers nor moments.
    """
    if texts:
        count = {"rows": lambda v: F.count("*"), "distinct": F.count_distinct, "missing": lambda v: F.count_if(v.isNull())}
        words = _long(df.select(*[F.when(~missing_text(F.col(c)), F.col(c)).alias(c) for c in texts]), texts, count)
        words = words.select("column", "rows", "distinct", "missing", F.lit(None).cast("long").alias("outliers"), *[F.lit(None).cast("double").alias(c) for c in ("mean", "var", "skew", "kurt")])
        return bundle(df, columns, missing).select(words.columns).unionByName(words) if columns else words
    clean = df.select(*[F.when(~missing(F.col(c)), as_double(F.col(c))).alias(c) for c in columns])
    limits = {c: (q[0], q[2]) for c, (_, q) in quartiles(clean, columns).items()}
    parts = _long(clean, columns, {"rows": lambda v: F.count("*"), "distinct": F.count_distinct, "missing": lambda v: F.count_if(v.isNull()), "mean": F.avg, "var": F.var_pop, "skew": F.skewness, "kurt": F.kurtosis})
    beyond = []
    for c in columns:
        q1, q3 = limits[c]
        outside = F.lit(False) if q1 is None else (F.col(c) < q1 - 1.5 * (q3 - q1)) | (F.col(c) > q3 + 1.5 * (q3 - q1))
        beyond.append(F.count_if(outside).alias(c))
    counts = clean.agg(*beyond).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("outliers")) for c in columns])).alias("x")).select("x.*")
    return parts.join(counts, "column")
