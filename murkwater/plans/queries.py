"""The engine's registered queries, each over whole tables, with the SQL that each must equal."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..functions.folder import place, written
from ..operators import allocate, dependencies, estimators, frequent, inject, pairs, profile, ranks, repair, scale, schema, shifted, sketches, validate
from ..sources import tables
from ..streaming import profiles
from . import declared, derived, pipeline
from .derived import CUSTOMER, CUSTOMER_KINDS, FLIPPED, LINEITEM, LINEITEM_KINDS, MISSPELT, ORDERS, ORDERS_KINDS, ZONES, ZONES_DEPENDENCIES, ZONES_KEY, ZONES_KINDS, cte, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SEED = 3215


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _rank_sql(source: str, key: str, name: str = "rank") -> str:
    return f"row_number() OVER (ORDER BY md5('{SEED}|' || CAST({key} AS VARCHAR))) - 1 AS {name}"


# --- schema and differences -------------------------------------------------------------------------

_NUMERIC_TEXT = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"


@query(f"""
WITH head AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 30),
cells AS (
  SELECT 'o_orderkey' AS c, CAST(o_orderkey AS VARCHAR) AS v FROM head UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM head
  UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM head UNION ALL SELECT 'o_totalprice', CAST(o_totalprice AS VARCHAR) FROM head
  UNION ALL SELECT 'o_orderdate', CAST(o_orderdate AS VARCHAR) FROM head UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM head),
kinds AS (
  SELECT c, CASE WHEN regexp_matches(v, {_NUMERIC_TEXT}) THEN CASE WHEN CAST(v AS DOUBLE) = floor(CAST(v AS DOUBLE)) THEN 'int' ELSE 'float' END ELSE 'str' END AS kind FROM cells),
best AS (SELECT c, kind, row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, kind) AS r FROM kinds GROUP BY c, kind)
SELECT c AS "column", kind, CASE WHEN kind = 'int' THEN 'float' ELSE kind END AS parse_kind FROM best WHERE r = 1
""")
def schema_infer_orders(spark, sf_dir):
    return schema.infer(table(spark, sf_dir, "orders"), ["o_orderkey"])


ORDERS_CTE = f"""
WITH {cte(ORDERS, "orders")},
st AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM pair),
price AS (
  SELECT o_orderkey, o_totalprice AS clean, o_totalprice__dirty AS dirty,
         o_totalprice__dirty IS NULL OR o_totalprice__dirty IN (-9999, 99999) AS mv,
         o_totalprice__dirty < q1 - 1.5 * (q3 - q1) OR o_totalprice__dirty > q3 + 1.5 * (q3 - q1) AS iqr,
         o_totalprice__dirty < m - 3 * s OR o_totalprice__dirty > m + 3 * s AS sigma,
         o_totalprice__dirty < lo OR o_totalprice__dirty > hi AS span,
         o_totalprice__dirty IN (SELECT o_totalprice FROM pair) AS known
  FROM pair, st WHERE o_totalprice__dirty IS NULL OR o_totalprice__dirty <> o_totalprice),
texts AS (
  SELECT 'o_orderstatus' AS col, o_orderstatus AS clean, o_orderstatus__dirty AS dirty, o_orderstatus__dirty IN (SELECT o_orderstatus FROM pair) AS known FROM pair WHERE o_orderstatus__dirty <> o_orderstatus
  UNION ALL SELECT 'o_orderpriority', o_orderpriority, o_orderpriority__dirty, o_orderpriority__dirty IN (SELECT o_orderpriority FROM pair) FROM pair WHERE o_orderpriority__dirty <> o_orderpriority),
classes AS (
  SELECT 'o_totalprice' AS col, CASE WHEN mv THEN 'MV' WHEN iqr OR sigma OR span THEN 'OUTLIER' WHEN known THEN 'REPLACEMENT' ELSE 'RESIDUAL' END AS error_class FROM price
  UNION ALL SELECT col, CASE WHEN known THEN 'REPLACEMENT' ELSE 'TYPO' END FROM texts)
"""


def _orders_cells(spark, sf_dir):
    return pairs.classify(derived.orders(spark, sf_dir), ["o_orderkey"], ORDERS_KINDS)


def _orders_differences(spark, sf_dir):
    return pairs.diff_cells(derived.orders(spark, sf_dir), ["o_orderkey"], ORDERS_KINDS)


@query(ORDERS_CTE + "SELECT col, count(*) AS n FROM (SELECT 'o_totalprice' AS col FROM price UNION ALL SELECT col FROM texts) GROUP BY col")
def diff_counts_orders(spark, sf_dir):
    return _orders_differences(spark, sf_dir).groupBy("col").agg(F.count("*").alias("n"))


@query(ORDERS_CTE + "SELECT 'o_totalprice' AS col, count(*) AS n FROM price WHERE mv")
def mv_counts_orders(spark, sf_dir):
    return _orders_differences(spark, sf_dir).where("mv").groupBy("col").agg(F.count("*").alias("n"))


@query(ORDERS_CTE + "SELECT 'o_totalprice' AS col, dirty AS value, count(*) AS n FROM price WHERE mv GROUP BY dirty")
def mv_histogram_orders(spark, sf_dir):
    return pairs.histogram(_orders_differences(spark, sf_dir), "mv").withColumn("value", F.col("value").cast("double"))


def _fence_count(which):
    def count(spark, sf_dir):
        pair = derived.orders(spark, sf_dir)
        fence = pairs.fences(pair, ["o_totalprice"])["o_totalprice"]
        dirty = F.col("o_totalprice__dirty")
        found = values.differs(F.col("o_totalprice"), dirty) & ~values.missing_number(dirty) & fence.outside(dirty, which)
        return pair.agg(F.count_if(found).alias("n"))

    return count


for _name, _which, _test in (("iqr", "iqr", "iqr"), ("3sigma", "sigma", "sigma"), ("range", "span", "span"), ("combined", "all", "(iqr OR sigma OR span)")):
    QUERIES[f"outlier_{_name}_orders"] = _fence_count(_which)
    ORACLES[f"outlier_{_name}_orders"] = ORDERS_CTE + f"SELECT count(*) AS n FROM price WHERE NOT mv AND {_test}"


@query(ORDERS_CTE + "SELECT round(dirty, 2) AS value, count(*) AS n FROM price WHERE NOT mv AND (iqr OR sigma OR span) GROUP BY 1")
def outlier_values_orders(spark, sf_dir):
    found = pairs.histogram(_orders_cells(spark, sf_dir), "outlier")
    return found.groupBy(F.round(F.col("value").cast("double"), 2).alias("value")).agg(F.sum("n").alias("n"))


@query(ORDERS_CTE + "SELECT col, error_class, count(*) AS n FROM classes GROUP BY col, error_class")
def error_class_profile_orders(spark, sf_dir):
    return pairs.class_counts(_orders_cells(spark, sf_dir))


@query(ORDERS_CTE + "SELECT o_orderkey, round(clean, 4) AS clean, round(dirty, 4) AS dirty FROM price WHERE NOT mv AND NOT iqr AND NOT sigma AND NOT span AND NOT known")
def residual_cells_orders(spark, sf_dir):
    cells = _orders_cells(spark, sf_dir).where("error_class = 'RESIDUAL'")
    return cells.select("o_orderkey", F.round(F.col("clean").cast("double"), 4).alias("clean"), F.round(F.col("dirty").cast("double"), 4).alias("dirty"))


@query(f"""
WITH {cte(ORDERS, "orders")},
clean AS (SELECT o_orderkey, o_orderstatus FROM pair WHERE o_orderkey % 211 <> 1),
dirty AS (SELECT o_orderkey, o_orderstatus__dirty FROM pair WHERE o_orderkey % 223 <> 2)
SELECT CASE WHEN c.o_orderkey IS NULL THEN 'dirty' WHEN d.o_orderkey IS NULL THEN 'clean' ELSE 'both' END AS side, count(*) AS n,
       count(*) FILTER (WHERE o_orderstatus <> o_orderstatus__dirty) AS differing
FROM clean c FULL JOIN dirty d ON c.o_orderkey = d.o_orderkey GROUP BY 1
""")
def align_orders(spark, sf_dir):
    """Two tables whose keys do not all match (their own rows are part of the case), aligned by key."""
    pair = derived.orders(spark, sf_dir)
    clean = pair.where("o_orderkey % 211 <> 1").select("o_orderkey", "o_orderstatus")
    dirty = pair.where("o_orderkey % 223 <> 2").select("o_orderkey", F.col("o_orderstatus__dirty").alias("o_orderstatus"))
    both = pairs.align(clean, dirty, ["o_orderkey"], ["o_orderstatus"])
    return both.groupBy(F.col("_side").alias("side")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") != F.col("o_orderstatus__dirty")).alias("differing"))


# --- classes of text columns and swaps --------------------------------------------------------------

CUSTOMER_CTE = f"""
WITH {cte(CUSTOMER, "customer")},
rows AS (
  SELECT *, c_name__dirty <> c_name AS d1, c_mktsegment__dirty <> c_mktsegment AS d2,
         c_mktsegment__dirty IN ('NA', 'NaN', 'NAN', 'nan', '0-*') AS mv2,
         c_name__dirty IN (SELECT c_name FROM pair) AS k1, c_mktsegment__dirty IN (SELECT c_mktsegment FROM pair) AS k2
  FROM pair),
swapped AS (SELECT *, d1 AND d2 AND NOT mv2 AND c_name__dirty = c_mktsegment AND c_mktsegment__dirty = c_name AS swap FROM rows),
cells AS (
  SELECT 'c_name' AS col, c_name AS clean, c_name__dirty AS dirty, swap, false AS mv, k1 AS known FROM swapped WHERE d1
  UNION ALL SELECT 'c_mktsegment', c_mktsegment, c_mktsegment__dirty, swap, mv2, k2 FROM swapped WHERE d2)
"""


def _customer_cells(spark, sf_dir):
    return pairs.classify(derived.customer(spark, sf_dir), ["c_custkey"], CUSTOMER_KINDS)


@query(CUSTOMER_CTE + "SELECT col, clean, dirty, count(*) AS n FROM cells WHERE NOT mv AND NOT swap AND known GROUP BY ALL")
def replacement_hist_customer(spark, sf_dir):
    return pairs.histogram(_customer_cells(spark, sf_dir), "replacement")


@query(CUSTOMER_CTE + "SELECT col, dirty AS value, count(*) AS n FROM cells WHERE NOT swap AND NOT known GROUP BY ALL")
def typo_hist_customer(spark, sf_dir):
    """Misspellings with missing tokens among them, as both are counted by default."""
    return pairs.histogram(_customer_cells(spark, sf_dir), "typo")


@query(CUSTOMER_CTE + "SELECT 'c_name' AS col1, 'c_mktsegment' AS col2, clean AS clean1, dirty AS dirty1, 'with_str' AS kind, count(*) AS n FROM cells WHERE swap AND col = 'c_name' GROUP BY ALL")
def swap_pairs_customer(spark, sf_dir):
    return pairs.swap_histogram(_customer_cells(spark, sf_dir), CUSTOMER_KINDS)


@query(f"WITH {cte(LINEITEM, 'lineitem')} SELECT 'l_discount' AS col1, 'l_tax' AS col2, l_discount AS clean1, l_tax AS dirty1, 'nums' AS kind, count(*) AS n FROM pair WHERE l_orderkey % 97 = 3 AND l_discount <> l_tax GROUP BY ALL")
def swap_pairs_lineitem(spark, sf_dir):
    cells = pairs.classify(derived.lineitem(spark, sf_dir), ["l_orderkey", "l_linenumber"], LINEITEM_KINDS)
    found = pairs.swap_histogram(cells, LINEITEM_KINDS)
    return found.withColumns({c: F.col(c).cast("double") for c in ("clean1", "dirty1")})


# --- profiles ---------------------------------------------------------------------------------------

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _each(template: str, columns: list[str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {template.format(c=c)} FROM {source}" for c in columns)


@query(_each("count({c}) AS n, round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(avg({c}), 6) AS mean, round(var_samp({c}), 4) AS var, round(skewness({c}), 6) AS skew, round(kurtosis({c}), 6) AS kurt", MEASURES, "lineitem"))
def moments_lineitem(spark, sf_dir):
    return rounded(rounded(profile.moments(table(spark, sf_dir, "lineitem"), MEASURES), "min", "max", "mean", "skew", "kurt"), "var", digits=4)


@query(_each("round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75", MEASURES, "lineitem"))
def quantiles_lineitem(spark, sf_dir):
    return rounded(profile.quantiles(table(spark, sf_dir, "lineitem"), MEASURES), "q25", "q50", "q75")


def _plotting_sql(column: str) -> str:
    def q(p):
        return f"(SELECT round((1 - g) * xs[k] + g * xs[least(k + 1, n)], 6) FROM (SELECT xs, n, CAST(floor(greatest(1, least(n * {p} + 0.4 + 0.2 * {p}, n - 1))) AS BIGINT) AS k, greatest(0, least(1, n * {p} + 0.4 + 0.2 * {p} - floor(greatest(1, least(n * {p} + 0.4 + 0.2 * {p}, n - 1))))) AS g FROM s))"

    return f"SELECT * FROM (WITH s AS (SELECT list({column} ORDER BY {column}) AS xs, count({column}) AS n FROM lineitem WHERE {column} IS NOT NULL) SELECT '{column}' AS \"column\", {q(0.25)} AS q25, {q(0.5)} AS q50, {q(0.75)} AS q75)"


@query(" UNION ALL ".join(_plotting_sql(c) for c in ("l_quantity", "l_discount")))
def mquantiles_lineitem(spark, sf_dir):
    return rounded(profile.plotting_quantiles(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"]), "q25", "q50", "q75")


@query()
def approx_quantiles_lineitem(spark, sf_dir):
    return profile.approximate_quantiles(table(spark, sf_dir, "lineitem"), MEASURES)


@query("WITH c AS (SELECT 'p_brand' AS \"column\", p_brand AS value, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY p_size) SELECT * FROM c QUALIFY n = max(n) OVER (PARTITION BY \"column\")")
def mode_part(spark, sf_dir):
    return profile.modes(table(spark, sf_dir, "part"), ["p_brand", "p_size"])


@query(_each("round(var_pop({c}), 4) AS var, round(skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0)), 6) AS skew, round(kurtosis_pop({c}), 6) AS kurt", MEASURES, "lineitem"))
def popmoments_lineitem(spark, sf_dir):
    return rounded(rounded(profile.population_moments(table(spark, sf_dir, "lineitem"), MEASURES), "skew", "kurt"), "var", digits=4)


@query(f"WITH {cte(ORDERS, 'orders')} SELECT 'o_totalprice' AS \"column\", count(*) AS n, round(min(v), 4) AS min, round(max(v), 4) AS max, round(avg(v), 4) AS mean FROM (SELECT coalesce(o_totalprice__dirty, 0) AS v FROM pair)")
def dirty_stats_orders(spark, sf_dir):
    """Statistics of the dirty side with nulls as 0."""
    rows = derived.orders(spark, sf_dir).select(F.col("o_totalprice__dirty").alias("o_totalprice"))
    return rounded(profile.moments(rows, ["o_totalprice"], nulls_as_zero=True), "min", "max", "mean", digits=4).select("column", "n", "min", "max", "mean")


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY event_type")
def value_counts_events(spark, sf_dir):
    return profile.value_counts(table(spark, sf_dir, "events"), "event_type")


@query(f"WITH {cte(ORDERS, 'orders')} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_excl_null, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS distinct_incl_null FROM pair" for c in ("o_totalprice__dirty", "o_orderstatus__dirty")))
def distinct_exact_orders(spark, sf_dir):
    return profile.distinct_counts(derived.orders(spark, sf_dir), ["o_totalprice__dirty", "o_orderstatus__dirty"])


@query(_each("count(DISTINCT {c}) AS distinct_excl_null, count(DISTINCT {c}) AS distinct_incl_null", ["c_name", "c_nationkey", "c_mktsegment"], "customer"))
def distinct_exact_customer(spark, sf_dir):
    return profile.distinct_counts(table(spark, sf_dir, "customer"), ["c_name", "c_nationkey", "c_mktsegment"])


@query()
def distinct_approx_events(spark, sf_dir):
    return profile.approximate_distinct_counts(table(spark, sf_dir, "events"), ["user_id", "event_type"])


SKETCHED = ["user_id", "event_type", "value"]


@query("""
WITH c AS (
  SELECT 'user_id' AS "column", CAST(user_id AS DOUBLE) AS v, CAST(user_id AS VARCHAR) AS t FROM events
  UNION ALL SELECT 'value', value, CAST(value AS VARCHAR) FROM events UNION ALL SELECT 'event_type', NULL, event_type FROM events)
SELECT "column", count(t) AS n, count(*) - count(t) AS missing, min(v) AS least, max(v) AS most, round(avg(v), 5) AS mean, round(var_samp(v), 3) AS var,
       true AS distinct_close, CASE WHEN "column" <> 'event_type' THEN true END AS quantiles_close
FROM c GROUP BY "column"
""")
def sketch_profile_events(spark, sf_dir):
    """The profile of all events from the states of four batches, and whether its estimates are as near as stated: distincts within 5 %, ranks of quartiles within 1 %."""
    rows, path = table(spark, sf_dir, "events"), place(spark, "states")
    for batch in range(4):
        sketches.save(rows.where(F.col("event_id") % 4 == batch), SKETCHED, path, batch)
    found = sketches.merged(sketches.load(spark, path))
    exact = profile.distinct_counts(rows, SKETCHED).select("column", F.col("distinct_excl_null").alias("exact"))
    points = {r["column"]: r.quantiles_approx for r in found.where("quantiles_approx is not null").collect()}
    at = [F.array(*[F.abs((F.count_if(F.col(c) < q) + F.count_if(F.col(c) <= q)) / 2 / F.count(c) - p) - F.count_if(F.col(c) == q) / 2 / F.count(c) for q, p in zip(qs, profile.QUARTILES, strict=True)]).alias(c) for c, qs in points.items()]
    off = rows.agg(*at).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.array_max(c).alias("off")) for c in points])).alias("x")).select("x.*")
    both = found.join(exact, "column").join(off, "column", "left").withColumn("distinct_close", F.abs(F.col("distinct_approx") - F.col("exact")) <= 0.05 * F.col("exact")).withColumn("quantiles_close", F.col("off") <= 0.01)
    return both.select("column", "n", "missing", "least", "most", F.round("mean", 5).alias("mean"), F.round("var", 3).alias("var"), "distinct_close", "quantiles_close")


FREQUENT = ["l_partkey", "l_quantity", "l_discount", "l_returnflag", "l_extendedprice", "l_shipdate"]


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {'CAST(l_shipdate AS DATE)::VARCHAR' if c == 'l_shipdate' else f'CAST({c} AS VARCHAR)'} AS value, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 0.015 * (SELECT count({c}) FROM lineitem)" for c in FREQUENT
))
def frequent_values_lineitem(spark, sf_dir):
    """Values with more than 1.5 % of the rows, of columns with few and with very many values."""
    rows = table(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("date"))
    return frequent.frequent_values(rows, FREQUENT, 0.015)


@query(f"""
WITH n AS (SELECT count(*) AS n FROM orders), base AS (SELECT *, {_rank_sql("orders", "o_orderkey", "k")} FROM orders),
scaled AS (SELECT copy * n + k AS row_id, o_orderstatus, o_orderpriority FROM (SELECT *, unnest([0, 1, 2]) AS copy FROM base, n))
SELECT row_id, CASE WHEN row_id % 10 = 3 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN row_id % 15 = 3 THEN NULL ELSE o_orderpriority END AS priority FROM scaled WHERE row_id % 5 = 3
""")
def inject_bucketed_orders(spark, sf_dir):
    """Edits applied to the tripled table, both in buckets by row id: each fifth row."""
    columns = ["o_orderstatus", "o_orderpriority"]
    base = table(spark, sf_dir, "orders").select("o_orderkey", *columns)
    scaled = pipeline.bucketed(scale.replicate(base, ["o_orderkey"], 3).drop("_copy"), "scaled")
    edits = scaled.where("_row_id % 10 = 3").selectExpr("_row_id", "'o_orderstatus' as col", "'X' as value", "'TYPO' as error_class")
    edits = pipeline.bucketed(edits.union(scaled.where("_row_id % 15 = 3").selectExpr("_row_id", "'o_orderpriority'", "null", "'MV'")), "edits")
    done = inject.apply(scaled, edits, columns).where("_row_id % 5 = 3")
    return done.select(F.col("_row_id").alias("row_id"), F.col("o_orderstatus__dirty").alias("status"), F.col("o_orderpriority__dirty").alias("priority"))


@query("SELECT 'user_id' AS \"column\", i, count(*) AS f FROM (SELECT count(*) AS i FROM events WHERE user_id IS NOT NULL GROUP BY user_id) GROUP BY i")
def freq_of_freq_events(spark, sf_dir):
    return profile.frequency_of_frequencies(table(spark, sf_dir, "events"), ["user_id"])


ESTIMATED = ["p_brand", "p_name", "p_retailprice"]
ESTIMATES_SQL = f"""
WITH cells AS ({" UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM part WHERE {c} IS NOT NULL" for c in ESTIMATED)}),
fof AS (SELECT col, i, count(*) AS f FROM (SELECT col, v, count(*) AS i FROM cells GROUP BY col, v) GROUP BY col, i),
s AS (
  SELECT col, sum(f) AS d, sum(i * f) AS n, sum(CASE WHEN i = 1 THEN f ELSE 0 END) AS f1, 0.5::DOUBLE AS q,
         sum(pow(0.5, i) * f) AS up, sum(i * 0.5 * pow(0.5, i - 1) * f) AS down,
         sum(i * 0.25 * pow(0.75, i - 1) * f) AS a, sum((pow(0.75, i) - pow(0.5, i)) * f) AS b, sum(i * (i - 1) * f) AS pairs
  FROM fof GROUP BY col),
g AS (SELECT *, d / (1 - 0.5 * f1 / n) AS duj1 FROM s),
h AS (SELECT *, greatest(0, duj1 / (n * n) * pairs + duj1 / (2 * n) - 1) AS gamma FROM g),
e AS (
  SELECT col, CAST(d AS BIGINT) AS d, CAST(n AS BIGINT) AS n, CAST(round_even(d + f1 * up / down, 0) AS BIGINT) AS shlosser,
         CAST(floor(CASE WHEN gamma < 0.9 THEN (d - 0.5 * f1 * ln(0.5) * gamma / 0.5) / (1 - 0.5 * f1 / n) ELSE d + f1 * a / b * pow(up / down, 2) END) AS BIGINT) AS haas_stokes
  FROM h)
"""


def _estimates(spark, sf_dir, compat=False):
    return estimators.estimates(profile.frequency_of_frequencies(table(spark, sf_dir, "part"), ESTIMATED), 2.0, compat)


@query(ESTIMATES_SQL + 'SELECT col AS "column", d, n, shlosser FROM e')
def est_shlosser_part(spark, sf_dir):
    return _estimates(spark, sf_dir).select("column", "d", "n", "shlosser")


@query(ESTIMATES_SQL + 'SELECT col AS "column", haas_stokes FROM e')
def est_haas_stokes_part(spark, sf_dir):
    return _estimates(spark, sf_dir).select("column", "haas_stokes")


@query(ESTIMATES_SQL + 'SELECT col AS "column", greatest(shlosser, haas_stokes) AS estimate FROM e')
def est_max_part(spark, sf_dir):
    return _estimates(spark, sf_dir).select("column", "estimate")


@query(ESTIMATES_SQL[: ESTIMATES_SQL.index("g AS (")] + """
top AS (SELECT col, max(i) AS top FROM fof GROUP BY col),
t AS (
  SELECT col, max(top) AS top, sum(i * 0.25 * pow(0.75, i - 1) * f) FILTER (WHERE i < top) AS a, sum((pow(0.75, i) - pow(0.5, i)) * f) FILTER (WHERE i < top) AS b,
         sum(pow(0.5, i) * f) FILTER (WHERE i < top) AS c, sum(i * 0.5 * pow(0.5, i - 1) * f) FILTER (WHERE i < top) AS e
  FROM fof JOIN top USING (col) GROUP BY col),
steps AS (
  SELECT k.col, list(k.i * (k.i - 1) * coalesce(f, 0)::DOUBLE ORDER BY k.i) AS xs
  FROM (SELECT col, unnest(range(1, top)) AS i FROM top) k LEFT JOIN fof ON fof.col = k.col AND fof.i = k.i GROUP BY k.col),
g AS (SELECT s.* EXCLUDE (a, b), t.a, t.b, t.c, t.e, xs, d / (1 - 0.5 * f1 / n) AS duj1 FROM s JOIN t USING (col) LEFT JOIN steps USING (col)),
h AS (SELECT *, greatest(0, coalesce(list_reduce(list_concat([0.0::DOUBLE], xs), lambda s, x: (s + x) * duj1 / (n * n) + duj1 / (2 * n) - 1), 0)) AS gamma FROM g),
w AS (
  SELECT col, CAST(d AS BIGINT) AS d, CAST(n AS BIGINT) AS n, CAST(round_even(d + f1 * up / down, 0) AS BIGINT) AS shlosser,
         CAST(floor(CASE WHEN gamma < 0.9 THEN (d - 0.5 * f1 * ln(0.5) * gamma / 0.5) / (1 - 0.5 * f1 / n) WHEN b IS NULL OR b = 0 OR e = 0 THEN d ELSE d + f1 * a / b * pow(c / e, 2) END) AS BIGINT) AS haas_stokes
  FROM h)
SELECT col AS "column", d, n, shlosser, haas_stokes, greatest(shlosser, haas_stokes) AS estimate FROM w
""")
def est_compat_part(spark, sf_dir):
    return _estimates(spark, sf_dir, compat=True)


def _error_estimates(cells: DataFrame, what: str) -> DataFrame:
    fof = pairs.histogram(cells, what).groupBy(F.col("col").alias("column"), F.col("n").alias("i")).agg(F.count("*").alias("f"))
    return estimators.estimates(fof, 2.0).select("column", "d", "n", "shlosser", "haas_stokes", "estimate")


def _error_estimates_sql(cells: str) -> str:
    head = ESTIMATES_SQL[ESTIMATES_SQL.index("fof AS") :].replace("fof AS (SELECT col, i, count(*) AS f FROM (SELECT col, v, count(*) AS i FROM cells GROUP BY col, v) GROUP BY col, i)", f"fof AS (SELECT col, i, count(*) AS f FROM ({cells}) GROUP BY col, i)")
    return head + 'SELECT col AS "column", d, n, shlosser, haas_stokes, greatest(shlosser, haas_stokes) AS estimate FROM e'


@query(CUSTOMER_CTE + ", " + _error_estimates_sql("SELECT col, dirty, count(*) AS i FROM cells WHERE NOT swap AND NOT known GROUP BY ALL"))
def est_typos_customer(spark, sf_dir):
    """How many distinct misspellings a table of twice the size would have."""
    return _error_estimates(_customer_cells(spark, sf_dir), "typo")


@query(ORDERS_CTE + ", " + _error_estimates_sql("SELECT 'o_totalprice' AS col, dirty, count(*) AS i FROM price WHERE mv GROUP BY ALL").replace("s AS (", "sums AS (").replace("FROM s)", "FROM sums)"))
def est_mv_orders(spark, sf_dir):
    return _error_estimates(_orders_cells(spark, sf_dir), "mv")


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, 'l_quantity' AS a, 'l_extendedprice' AS b FROM lineitem UNION ALL SELECT round(corr(l_quantity, l_discount), 6), 'l_quantity', 'l_discount' FROM lineitem UNION ALL SELECT round(corr(l_extendedprice, l_discount), 6), 'l_extendedprice', 'l_discount' FROM lineitem")
def corr_lineitem(spark, sf_dir):
    return rounded(profile.correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), "r")


@query(f"WITH {cte(ORDERS, 'orders')} SELECT o_orderstatus, round(coalesce(avg(CASE WHEN o_totalprice__dirty > 1000000 THEN o_totalprice END), avg(o_totalprice)), 4) AS mean FROM pair GROUP BY o_orderstatus")
def masked_mean_orders(spark, sf_dir):
    pair = derived.orders(spark, sf_dir)
    return rounded(pair.groupBy("o_orderstatus").agg(profile.masked_mean(pair, "o_totalprice", F.col("o_totalprice__dirty") > 1000000).alias("mean")), "mean", digits=4)


@query(f"""
WITH {cte(ORDERS, "orders")}, v AS (SELECT 'o_totalprice' AS "column", sum(o_totalprice) AS original, sum(CASE WHEN o_totalprice__dirty IS NULL THEN 0 ELSE o_totalprice__dirty END) AS generated FROM pair)
SELECT "column", round(CASE WHEN generated = 0 THEN 0 ELSE abs(generated - original) / abs(generated) * 100 END, 4) AS percent FROM v
""")
def pct_diff_profile(spark, sf_dir):
    sums = derived.orders(spark, sf_dir).agg(F.sum("o_totalprice").alias("original"), F.sum(F.coalesce("o_totalprice__dirty", F.lit(0.0))).alias("generated"))
    return sums.select(F.lit("o_totalprice").alias("column"), F.round(values.percent_difference(F.col("generated"), F.col("original")), 4).alias("percent"))


@query(ORDERS_CTE + """, totals AS (SELECT error_class, count(*) AS n FROM classes GROUP BY error_class)
SELECT error_class, n, CAST(sum(n) OVER (ORDER BY error_class) AS BIGINT) AS running, round(100.0 * n / sum(n) OVER (), 6) AS percent FROM totals""")
def stacked_errors_orders(spark, sf_dir):
    from pyspark.sql import Window

    totals = pairs.class_counts(_orders_cells(spark, sf_dir)).groupBy("error_class").agg(F.sum("n").alias("n"))  # at most six rows
    return totals.select("error_class", "n", F.sum("n").over(Window.orderBy("error_class")).alias("running"), F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("percent"))


# --- scaling ----------------------------------------------------------------------------------------


@query(f"""
WITH r AS (SELECT *, {_rank_sql("orders", "o_orderkey", "k")} FROM orders), n AS (SELECT count(*) AS n FROM orders),
c AS (SELECT r.*, n.n, unnest(CASE WHEN k < round_even(n.n * 2.5, 0) - 2 * n.n THEN [0, 1, 2] ELSE [0, 1] END) AS copy FROM r, n)
SELECT copy * n + k AS row_id, o_orderkey, copy FROM c
""")
def scale_replicate_orders_2_5(spark, sf_dir):
    out = scale.replicate(table(spark, sf_dir, "orders"), ["o_orderkey"], 2.5)
    return out.select(F.col("_row_id").alias("row_id"), "o_orderkey", F.col("_copy").alias("copy"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM (SELECT o_orderstatus, o_orderpriority, unnest(range(CAST(round_even(count(*) * 1.5, 0) AS BIGINT))) FROM orders GROUP BY o_orderstatus, o_orderpriority) GROUP BY ALL")
def scale_hash_orders_1_5(spark, sf_dir):
    out = scale.multiply(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority"), 1.5)
    return out.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT r_regionkey, r_name, unnest(range(1, CAST(round_even(1.5, 0) AS BIGINT) + 1)) AS copy FROM region")
def scale_hash_region_1_5(spark, sf_dir):
    return scale.multiply(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), 1.5).withColumnRenamed("_copy", "copy")


@query("WITH n AS (SELECT count(*) AS n FROM customer), r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS k FROM customer) SELECT c_custkey, unnest(CASE WHEN k <= round_even(n * 1.5, 0) - n THEN [0, 1] ELSE [0] END) AS copy FROM r, n")
def scale_slice_customer(spark, sf_dir):
    return scale.with_slice(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 1.5).withColumnRenamed("_copy", "copy")


@query(f"""
WITH r AS (SELECT c_custkey, {_rank_sql("customer", "c_custkey", "k")} FROM customer), n AS (SELECT count(*) AS n FROM customer),
draws AS (SELECT n.n + d AS row_id, CAST(concat('0x', substr(md5('{SEED}|draw|' || CAST(d AS VARCHAR)), 1, 15)) AS BIGINT) % n.n AS k FROM n, range(0, (SELECT CAST(round_even(count(*) * 1.5, 0) - count(*) AS BIGINT) FROM customer)) t(d))
SELECT k AS row_id, c_custkey FROM r UNION ALL SELECT row_id, c_custkey FROM draws JOIN r USING (k)
""")
def scale_full_customer(spark, sf_dir):
    return scale.resample(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], 1.5).select(F.col("_row_id").alias("row_id"), "c_custkey")


@query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM r WHERE k BETWEEN 1 AND CAST(floor(n * 0.4) AS BIGINT)")
def slice_lt1_orders(spark, sf_dir):
    return scale.shrink(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.4)


# --- allocation and injection -----------------------------------------------------------------------

ALLOCATE_SQL = """,
a AS (SELECT *, min(n) OVER (PARTITION BY col) AS least, CAST(round_even(sum(n) OVER (PARTITION BY col) * 2.5, 0) AS BIGINT) AS total FROM h),
s AS (SELECT *, CAST(n + least AS DOUBLE) / sum(n + least) OVER (PARTITION BY col) * total AS share FROM a),
b AS (SELECT *, CAST(floor(share) AS BIGINT) AS base, row_number() OVER (PARTITION BY col ORDER BY round(share - floor(share), 9) DESC, md5(coalesce(CAST(value AS VARCHAR), ''))) AS place FROM s)
SELECT col, value, n, CAST(base + (place <= total - sum(base) OVER (PARTITION BY col))::INT AS BIGINT) AS planned FROM b
"""


def _allocated(histogram: DataFrame) -> DataFrame:
    total = histogram.groupBy("col").agg(allocate.new_count(F.sum("n"), 2.5).alias("total"))
    return allocate.allocate(histogram, total, ["col"]).select("col", "value", "n", "planned")


@query(CUSTOMER_CTE + ", h AS (SELECT col, dirty AS value, count(*) AS n FROM cells WHERE NOT swap AND NOT known GROUP BY ALL)" + ALLOCATE_SQL)
def alloc_typos_customer(spark, sf_dir):
    return _allocated(pairs.histogram(_customer_cells(spark, sf_dir), "typo"))


@query(ORDERS_CTE + ", h AS (SELECT 'o_totalprice' AS col, dirty AS value, count(*) AS n FROM price WHERE mv GROUP BY dirty)" + ALLOCATE_SQL)
def alloc_mv_orders(spark, sf_dir):
    return _allocated(pairs.histogram(_orders_differences(spark, sf_dir), "mv").withColumn("value", F.col("value").cast("double")))


@query(CUSTOMER_CTE + f""",
plan AS (SELECT clean AS was, dirty AS value, CAST(round_even(count(*) * 2.0, 0) AS BIGINT) AS planned FROM cells WHERE col = 'c_mktsegment' AND NOT mv AND NOT swap AND known GROUP BY ALL),
lines AS (SELECT *, sum(planned) OVER (PARTITION BY was ORDER BY md5(coalesce(CAST(value AS VARCHAR), ''))) AS hi FROM plan),
n AS (SELECT count(*) AS n FROM customer),
base AS (SELECT c_custkey, c_mktsegment, {_rank_sql("customer", "c_custkey", "k")} FROM customer),
scaled AS (SELECT copy * n + k AS row_id, c_mktsegment FROM (SELECT *, unnest([0, 1]) AS copy FROM base, n)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('{SEED}|' || CAST(row_id AS VARCHAR))) - 1 AS place FROM scaled)
SELECT row_id, value FROM ranked JOIN lines ON c_mktsegment = was AND place >= hi - planned AND place < hi
""")
def inject_replacements_customer(spark, sf_dir):
    scaled = scale.replicate(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"], 2)
    histogram = pairs.histogram(_customer_cells(spark, sf_dir), "replacement").where("col = 'c_mktsegment'")
    edits = inject.replacements(scaled, {"c_mktsegment": "str"}, histogram, 2, SEED)
    return edits.select(F.col("_row_id").alias("row_id"), "value")


@query(CUSTOMER_CTE + f""",
plan AS (SELECT clean AS x, dirty AS y, CAST(round_even(count(*) * 2.0, 0) AS BIGINT) AS planned FROM cells WHERE swap AND col = 'c_name' GROUP BY ALL),
n AS (SELECT count(*) AS n FROM customer),
base AS (SELECT c_custkey, c_name, c_mktsegment, {_rank_sql("customer", "c_custkey", "k")} FROM customer),
scaled AS (SELECT copy * n + k AS row_id, c_name, c_mktsegment FROM (SELECT *, unnest([0, 1]) AS copy FROM base, n)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY c_name, c_mktsegment ORDER BY md5('{SEED}|' || CAST(row_id AS VARCHAR))) - 1 AS place FROM scaled),
hit AS (SELECT row_id, x, y FROM ranked JOIN plan ON c_name = x AND c_mktsegment = y AND place < planned)
SELECT row_id, 'c_name' AS col, y AS value FROM hit UNION ALL SELECT row_id, 'c_mktsegment', x FROM hit
""")
def inject_swaps_customer(spark, sf_dir):
    scaled = scale.replicate(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_custkey"], 2)
    edits = inject.swaps(scaled, CUSTOMER_KINDS, pairs.swap_histogram(_customer_cells(spark, sf_dir), CUSTOMER_KINDS), 2, SEED)
    return edits.select(F.col("_row_id").alias("row_id"), "col", "value")


@query("""
SELECT l_discount AS clean1, l_tax AS dirty1, CAST(round_even(count(*) * 2.0, 0) AS BIGINT) AS n
FROM lineitem WHERE l_orderkey % 97 = 3 AND l_discount <> l_tax GROUP BY ALL
""")
def inject_swaps_lineitem(spark, sf_dir):
    """Injected swaps by value pair: twice as many as before, as the doubled table has enough rows of each."""
    pair = derived.lineitem(spark, sf_dir)
    cells = pairs.classify(pair, ["l_orderkey", "l_linenumber"], LINEITEM_KINDS)
    base = pair.select("l_discount", "l_tax").withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_row_id", F.monotonically_increasing_id())
    edits = inject.swaps(base, LINEITEM_KINDS, pairs.swap_histogram(cells, LINEITEM_KINDS), 2, SEED)
    both = edits.groupBy("_row_id").pivot("col", list(LINEITEM_KINDS)).agg(F.first("value"))
    return both.groupBy(F.col("l_tax").cast("double").alias("clean1"), F.col("l_discount").cast("double").alias("dirty1")).agg(F.count("*").alias("n"))


def _orders_line(which: str):
    def line(spark, sf_dir):
        pair = derived.orders(spark, sf_dir)
        scaled = scale.replicate(pair.select("o_orderkey"), ["o_orderkey"], 2)
        cells = _orders_cells(spark, sf_dir)
        if which == "MV":
            plan = _allocated(pairs.histogram(cells, "mv")).select("value", F.col("planned"))
        elif which == "OUTLIER":
            limits = pairs.fences(pair, ["o_totalprice"])
            found = F.when(F.col("error_class") == "OUTLIER", F.col("dirty").cast("double"))
            summary = cells.groupBy("col").agg(F.count(found).alias("OUTLIER"), F.count_distinct(found).alias("seen"), F.avg(found).alias("centre")).where("OUTLIER > 0")
            columns = pipeline.outlier_columns(pair, ["o_totalprice"], {r["col"]: r for r in summary.collect()}, limits, 2)
            plan = inject.outliers(columns, SEED)
        else:
            plan = pipeline.typo_plan(cells, pair, ["o_orderstatus"], 2)
        return inject.place(scaled.select("_row_id"), written(plan, "plan"), SEED).select(F.col("_row_id").alias("row_id"), "value")

    return line


_DOUBLED_RANKED = f"""
n AS (SELECT count(*) AS n FROM orders),
base AS (SELECT o_orderkey, {_rank_sql("orders", "o_orderkey", "k")} FROM orders),
scaled AS (SELECT copy * n + k AS row_id FROM (SELECT *, unnest([0, 1]) AS copy FROM base, n)),
ranked AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED}|' || CAST(row_id AS VARCHAR))) - 1 AS place FROM scaled)
"""


@query(ORDERS_CTE + f""",
known AS (SELECT count(*) * 2 AS total, least(count(*) * 2, count(DISTINCT dirty) * 2) AS d, avg(dirty) AS centre FROM price WHERE NOT mv AND (iqr OR sigma OR span)),
col AS (SELECT *, abs(centre - m) AS shift, greatest(abs(q1 - 1.5 * (q3 - q1) - m), abs(q3 + 1.5 * (q3 - q1) - m), 3 * s, abs(lo - m), abs(hi - m)) AS reach FROM st, known),
draws AS (SELECT *, k // 2 AS h, (CAST('0x' || substr(md5('{SEED}|outlier|o_totalprice|' || CAST(k // 2 AS VARCHAR)), 1, 8) AS BIGINT) % 999983 + 1) / 999984.0::DOUBLE AS u FROM col, (SELECT unnest(range(0, (SELECT d FROM known))) AS k)),
dist AS (
  SELECT *, greatest(CASE WHEN h % 7 <= 1 THEN hi - lo + shift WHEN h % 7 = 2 THEN u * reach * pow(10, ceil(-log10(u))) WHEN h % 7 <= 4 THEN reach + u * reach ELSE 3 * s + abs(lo) END, reach + shift) * (1.001 + u / 100) AS distance FROM draws),
plan AS (SELECT centre + CASE WHEN k % 2 = 0 THEN distance ELSE -distance END AS v, total // d + CASE WHEN k < total % d THEN 1 ELSE 0 END AS planned FROM dist),
{_DOUBLED_RANKED}
SELECT CAST(sign(v) AS DOUBLE) AS side, round(v, 1) AS value, CAST(sum(planned) AS BIGINT) AS n FROM plan GROUP BY ALL
""")
def inject_outliers_orders(spark, sf_dir):
    """Injected outliers by value: in pairs around the mean of those there were."""
    hit = _orders_line("OUTLIER")(spark, sf_dir).withColumn("v", F.col("value").cast("double"))
    return hit.groupBy(F.signum("v").alias("side"), F.round("v", 1).alias("value")).agg(F.count("*").alias("n"))


def _typo_sql(old: str) -> str:
    """Planned typos of ``old`` (col, value, clean, n) when the table is doubled: h (col, value, n) as ALLOCATE_SQL has it."""
    step = """
  SELECT col, clean, k, edits, CASE WHEN {j} > edits THEN t WHEN len(t) <= 2 THEN t || letter
    WHEN kind = 0 AND t[a:a] <> t[a + 1:a + 1] THEN t[1:a - 1] || t[a + 1:a + 1] || t[a:a] || t[a + 2:]
    WHEN kind = 1 THEN t[1:a - 1] || t[a + 1:] ELSE t[1:a - 1] || letter || t[a:] END AS t
  FROM (SELECT *, CAST('0x' || substr(d, 1, 4) AS BIGINT) % greatest(len(t) - 1, 1) + 1 AS a, chr(CAST(33 + CAST('0x' || substr(d, 5, 4) AS BIGINT) % 94 AS INTEGER)) AS letter, CAST('0x' || substr(d, 9, 4) AS BIGINT) % 3 AS kind
        FROM (SELECT *, md5('typo|' || clean || '|' || CAST(k AS VARCHAR) || '|{j}') AS d FROM t{i}))"""
    steps = ",\n".join(f"t{j} AS ({step.format(i=j - 1, j=j)})" for j in (1, 2, 3))
    return f"""old AS ({old}),
t0 AS (SELECT col, clean, unnest(range(1, CAST(more AS BIGINT) + 1)) AS k, greatest(1, least(CAST(round_even(len(clean) / 2, 0) AS BIGINT), 3)) AS edits, clean AS t FROM (SELECT col, clean, round_even(count(*) * 2.0, 0) - count(*) AS more FROM old GROUP BY ALL)),
{steps},
fresh AS (SELECT DISTINCT col, t AS value FROM t3),
h AS (SELECT col, value, CAST(sum(n) AS BIGINT) AS n FROM old GROUP BY ALL UNION ALL SELECT col, value, 1 FROM fresh WHERE (col, value) NOT IN (SELECT col, clean FROM every_clean) AND (col, value) NOT IN (SELECT col, value FROM old))"""


TYPO_ALLOCATE_SQL = ALLOCATE_SQL.replace("sum(n) OVER (PARTITION BY col) * 2.5", "(SELECT sum(o.n) FROM old o WHERE o.col = h.col) * 2.0")


@query(ORDERS_CTE + ", every_clean AS (SELECT 'o_orderstatus' AS col, o_orderstatus AS clean FROM pair), " + _typo_sql("SELECT col, dirty AS value, clean, count(*) AS n FROM texts WHERE NOT known AND col = 'o_orderstatus' GROUP BY ALL")
       + TYPO_ALLOCATE_SQL.replace("SELECT col, value, n,", ", plan AS (SELECT value,").rstrip() + f"""),
lines AS (SELECT value, planned, sum(planned) OVER (ORDER BY md5(coalesce(CAST(value AS VARCHAR), ''))) AS hi FROM plan WHERE planned > 0),
{_DOUBLED_RANKED}
SELECT row_id, value FROM ranked JOIN lines ON place >= hi - planned AND place < hi
""")  # fmt: skip
def inject_typos_orders(spark, sf_dir):
    return _orders_line("TYPO")(spark, sf_dir)


@query(CUSTOMER_CTE + ", every_clean AS (SELECT 'c_name' AS col, c_name AS clean FROM pair UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM pair), "
       + _typo_sql("SELECT col, dirty AS value, clean, count(*) AS n FROM cells WHERE NOT mv AND NOT swap AND NOT known GROUP BY ALL") + TYPO_ALLOCATE_SQL.replace("SELECT col, value, n,", "SELECT col, value,"))
def plan_typos_customer(spark, sf_dir):
    """Existing and new misspellings, several edits each, and how often each is planned."""
    return pipeline.typo_plan(_customer_cells(spark, sf_dir), derived.customer(spark, sf_dir), list(CUSTOMER_KINDS), 2)


@query(ORDERS_CTE + f""", h AS (SELECT 'o_totalprice' AS col, dirty AS value, count(*) AS n FROM price WHERE mv GROUP BY dirty)
{ALLOCATE_SQL.replace("SELECT col, value, n,", ", plan AS (SELECT col, value, n,").rstrip()}),
lines AS (SELECT value, planned, sum(planned) OVER (ORDER BY md5(coalesce(CAST(value AS VARCHAR), ''))) AS hi FROM plan),
n AS (SELECT count(*) AS n FROM orders),
base AS (SELECT o_orderkey, {_rank_sql("orders", "o_orderkey", "k")} FROM orders),
scaled AS (SELECT copy * n + k AS row_id FROM (SELECT *, unnest([0, 1]) AS copy FROM base, n)),
ranked AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED}|' || CAST(row_id AS VARCHAR))) - 1 AS place FROM scaled)
SELECT row_id, value FROM ranked JOIN lines ON place >= hi - planned AND place < hi
""")
def inject_mv_orders(spark, sf_dir):
    return _orders_line("MV")(spark, sf_dir).withColumn("value", F.col("value").cast("double"))


# --- the whole pipeline -----------------------------------------------------------------------------

PLANNED = ORDERS_CTE + """,
counted AS (SELECT col, error_class, count(*) AS n FROM classes WHERE error_class <> 'RESIDUAL' GROUP BY ALL)
"""


def _run(spark, sf_dir):
    return pipeline.run(derived.orders(spark, sf_dir), ["o_orderkey"], ORDERS_KINDS, 2)


@query(PLANNED + "SELECT col, error_class, CAST(round_even(n * 2.0, 0) AS BIGINT) AS n FROM counted")
def pipeline_orders_sf2(spark, sf_dir):
    """Edits by column and class: each class of each column grows by the factor."""
    return _run(spark, sf_dir).edits.groupBy("col", "error_class").agg(F.count("*").alias("n"))


@query(PLANNED + "SELECT col, error_class, CAST(round_even(n * 2.0, 0) AS BIGINT) AS n FROM counted")
def reprofile_orders_sf2(spark, sf_dir):
    """The error profile of the generated table, found anew by classification."""
    return _run(spark, sf_dir).regenerated


@query(PLANNED + "SELECT 'count_' || lower(error_class) AS \"check\", col AS \"column\", CAST(round_even(n * 2.0, 0) AS DOUBLE) AS expected, CAST(round_even(n * 2.0, 0) AS DOUBLE) AS actual, true AS passed FROM counted")
def validate_orders_sf2(spark, sf_dir):
    """Checks of class counts; those of statistics are in validate_stats_orders_sf2."""
    checks = _run(spark, sf_dir).validation
    return checks.where("check like 'count_%' and check <> 'count_residual'").select("check", "column", "expected", "actual", "passed")


@query()
def validate_stats_orders_sf2(spark, sf_dir):
    return _run(spark, sf_dir).validation.where("check like 'stat_%'")


@query()
def generated_orders_sf2(spark, sf_dir):
    return _run(spark, sf_dir).generated


@query(ORDERS_CTE + """,
d AS (SELECT coalesce(o_totalprice__dirty, 0) AS v FROM pair),
stats(name, expected) AS (
  SELECT unnest(['stat_mean', 'stat_var', 'stat_min', 'stat_max', 'stat_skew', 'stat_kurt', 'stat_q25', 'stat_q50', 'stat_q75']),
         unnest([avg(v), var_samp(v), min(v), max(v), skewness(v), kurtosis(v), quantile_cont(v, 0.25), quantile_cont(v, 0.5), quantile_cont(v, 0.75)]) FROM d),
each AS (SELECT col, CASE WHEN known THEN 'REPLACEMENT' ELSE 'TYPO' END AS error_class, clean FROM texts UNION ALL SELECT 'o_totalprice', CASE WHEN mv THEN 'MV' WHEN iqr OR sigma OR span THEN 'OUTLIER' WHEN known THEN 'REPLACEMENT' ELSE 'RESIDUAL' END, CAST(clean AS VARCHAR) FROM price)
SELECT name AS "check", 'o_totalprice' AS "column", round(expected, CASE name WHEN 'stat_var' THEN -6 ELSE 5 END) AS expected, CAST(NULL AS BOOLEAN) AS passed FROM stats
UNION ALL SELECT 'quartile_in_band', 'o_totalprice', e, true FROM (SELECT round(quantile_cont(v, 0.25) - 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)), 5) AS e FROM d), range(2)
UNION ALL SELECT 'population_' || lower(error_class), col, count(*), true FROM each WHERE error_class IN ('MV', 'OUTLIER', 'TYPO') GROUP BY ALL
UNION ALL SELECT 'distinct_replaced', col, count(DISTINCT clean), true FROM each WHERE error_class = 'REPLACEMENT' GROUP BY ALL
""")
def validate_full_orders_sf2(spark, sf_dir):
    """All checks of a run but class counts and distincts: what is expected, and of populations, replaced values and quartiles whether it holds."""
    run = pipeline.run(derived.orders(spark, sf_dir), ["o_orderkey"], ORDERS_KINDS, 2, full=True)
    rows = run.validation.where("check not like 'count_%' and check <> 'distinct'")
    expected = F.when(F.col("check") == "stat_var", F.round("expected", -6)).otherwise(F.round("expected", 5))
    return rows.select("check", "column", expected.alias("expected"), F.when(~F.col("check").like("stat_%"), F.col("passed")).alias("passed"))


@query("SELECT 'count_swap' AS \"check\", c AS \"column\", CAST(2 * n AS DOUBLE) AS expected, true AS passed FROM (SELECT count(*) AS n FROM customer WHERE c_custkey % 89 = 2), (VALUES ('c_name'), ('c_mktsegment')) t(c)")
def validate_swaps_customer_sf2(spark, sf_dir):
    run = pipeline.run(derived.customer(spark, sf_dir), ["c_custkey"], CUSTOMER_KINDS, 2)
    return run.validation.where("check = 'count_swap'").select("check", "column", "expected", "passed")


@query(f"""
WITH {cte(LINEITEM, "lineitem")}, c AS (SELECT corr(l_discount, l_tax) AS expected, corr(l_discount__dirty, l_tax__dirty) AS actual FROM pair)
SELECT 'correlation' AS "check", 'l_discount~l_tax' AS "column", round(expected, 6) AS expected, round(actual, 6) AS actual, CAST(0.2 AS DOUBLE) AS tolerance, abs(actual - expected) <= 0.2 AS passed FROM c
""")
def validate_correlation_lineitem(spark, sf_dir):
    pair = derived.lineitem(spark, sf_dir)
    clean = profile.correlations(pair, ["l_discount", "l_tax"])
    dirty = profile.correlations(pair.select(F.col("l_discount__dirty").alias("l_discount"), F.col("l_tax__dirty").alias("l_tax")), ["l_discount", "l_tax"])
    return rounded(validate.correlation_drift(clean, dirty), "expected", "actual")


@query(f"""
WITH {cte(ORDERS, "orders")}, q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b, quantile_cont(o_totalprice__dirty, 0.25) AS c, quantile_cont(o_totalprice__dirty, 0.75) AS d FROM pair),
x AS (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi, unnest([c, d]) AS actual FROM q)
SELECT 'quartile_in_band' AS "check", 'o_totalprice' AS "column", round(lo, 4) AS expected, round(actual, 4) AS actual, round(hi - lo, 4) AS tolerance, actual BETWEEN lo AND hi AS passed FROM x
""")
def validate_band_orders(spark, sf_dir):
    pair = derived.orders(spark, sf_dir)
    clean, dirty = profile.quantiles(pair, ["o_totalprice"]), profile.quantiles(pair.select(F.col("o_totalprice__dirty").alias("o_totalprice")), ["o_totalprice"])
    return rounded(validate.inside_band(clean, dirty), "expected", "actual", "tolerance", digits=4)


def _price_sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Prices before and after the errors, with missing cells as 0."""
    pair = derived.orders(spark, sf_dir)
    return pair.select("o_totalprice"), pair.select(F.coalesce("o_totalprice__dirty", F.lit(0.0)).alias("o_totalprice"))


SIDES_SQL = f"WITH {cte(ORDERS, 'orders')}, sides AS (SELECT 'original' AS side, o_totalprice AS v FROM pair UNION ALL SELECT 'generated', coalesce(o_totalprice__dirty, 0) FROM pair)"


@query(SIDES_SQL + """, p AS (SELECT side, unnest(['mean', 'min', 'max', 'q25', 'q50', 'q75', 'skew', 'kurt']) AS name, unnest([avg(v), min(v), max(v), quantile_cont(v, 0.25), quantile_cont(v, 0.5), quantile_cont(v, 0.75), skewness(v), kurtosis(v)]) AS x FROM sides GROUP BY side)
SELECT 'stat_' || a.name AS "check", 'o_totalprice' AS "column", round(a.x, 4) AS expected, round(b.x, 4) AS actual, CAST(0.2 AS DOUBLE) AS tolerance, abs(b.x - a.x) <= 0.2 * greatest(abs(a.x), 1e-12) AS passed
FROM p a JOIN p b ON a.name = b.name AND a.side = 'original' AND b.side = 'generated'""")
def validate_profile_orders(spark, sf_dir):
    """Moments and quartiles of the clean and the dirty side, within 20 %."""
    full = lambda df: profile.moments(df, ["o_totalprice"]).join(profile.quantiles(df, ["o_totalprice"]), "column")
    checks = validate.statistics(*map(full, _price_sides(spark, sf_dir)), ["mean", "min", "max", "q25", "q50", "q75", "skew", "kurt"])
    return rounded(checks, "expected", "actual", digits=4)


@query(SIDES_SQL + """, m AS (SELECT side, v, row_number() OVER (PARTITION BY side ORDER BY count(*) DESC, v) AS r FROM sides GROUP BY side, v)
SELECT 'o_totalprice' AS "column", s.side, round(min(s.v), 4) AS min, round(max(s.v), 4) AS max, round(avg(s.v), 4) AS mean, round(var_samp(s.v) / 1e6, 2) AS var, round(quantile_cont(s.v, 0.25), 4) AS q25, round(quantile_cont(s.v, 0.5), 4) AS q50, round(quantile_cont(s.v, 0.75), 4) AS q75, round(any_value(m.v), 4) AS mode
FROM sides s JOIN m ON s.side = m.side AND r = 1 GROUP BY s.side""")
def validate_summary_orders(spark, sf_dir):
    rows = validate.summary(*_price_sides(spark, sf_dir), ["o_totalprice"]).withColumn("var", F.round(F.col("var") / 1e6, 2))
    return rounded(rows, "min", "max", "mean", "q25", "q50", "q75", "mode", digits=4)


@query(SIDES_SQL + """, p AS (SELECT side, count(DISTINCT v) AS d, min(v) AS lo, max(v) AS hi, skewness(v) AS s, var_samp(v) AS var FROM sides GROUP BY side),
l AS (SELECT side, unnest(['distinct', 'min', 'max', 'band', 'var']) AS name, unnest([CAST(d AS DOUBLE), lo, hi, CASE WHEN abs(s) < 0.5 THEN 0 WHEN abs(s) < 1 THEN 1 ELSE 2 END * sign(s), var]) AS x FROM p)
SELECT 'same_' || a.name AS "check", 'o_totalprice' AS "column", round(CASE WHEN a.name = 'var' THEN a.x / 1e6 ELSE a.x END, 2) AS expected, round(CASE WHEN a.name = 'var' THEN b.x / 1e6 ELSE b.x END, 2) AS actual, CAST(CASE WHEN a.name = 'var' THEN 0.2 ELSE 0 END AS DOUBLE) AS tolerance,
       CASE WHEN a.name = 'var' THEN abs(b.x - a.x) <= 0.2 * a.x ELSE a.x = b.x END AS passed
FROM l a JOIN l b ON a.name = b.name AND a.side = 'original' AND b.side = 'generated'""")
def compare_profiles_orders(spark, sf_dir):
    def full(df):
        distinct = profile.distinct_counts(df, ["o_totalprice"]).select("column", F.col("distinct_excl_null").alias("distinct"))
        return profile.moments(df, ["o_totalprice"]).join(distinct, "column")

    checks = validate.compare_profiles(*map(full, _price_sides(spark, sf_dir)))
    shown = lambda c: F.round(F.when(F.col("check") == "same_var", F.col(c) / 1e6).otherwise(F.col(c)), 2)
    return checks.withColumns({"expected": shown("expected"), "actual": shown("actual")})


@query(ORDERS_CTE + """, replaced AS (
  SELECT 'o_orderpriority' AS col, count(DISTINCT clean) AS d FROM texts WHERE known AND col = 'o_orderpriority' HAVING count(*) > 0
  UNION ALL SELECT 'o_orderstatus', count(DISTINCT clean) FROM texts WHERE known AND col = 'o_orderstatus' HAVING count(*) > 0)
SELECT 'distinct_replaced' AS "check", col AS "column", CAST(d AS DOUBLE) AS expected, CAST(d AS DOUBLE) AS actual, true AS passed FROM replaced
UNION ALL SELECT 'population_' || lower(error_class), col, CAST(count(*) AS DOUBLE), CAST(round_even(count(*) * 2.0, 0) AS DOUBLE), true FROM classes WHERE error_class IN ('MV', 'OUTLIER', 'TYPO') GROUP BY col, error_class""")
def validate_populations_orders_sf2(spark, sf_dir):
    """Distinct replaced values stay, other classes are no fewer than before, in the table that a run generates."""
    run = _run(spark, sf_dir)
    again = pairs.classify(run.generated, ["_row_id"], ORDERS_KINDS, pairs.fences(derived.orders(spark, sf_dir), ["o_totalprice"]))
    checks = validate.replaced_values(run.cells, again).unionByName(validate.error_populations(run.cells, again))
    return checks.select("check", "column", "expected", "actual", "passed")


@query()
def validate_distincts_orders_sf2(spark, sf_dir):
    """Distinct values of the generated columns against clean ones and those estimated for errors."""
    run, columns = _run(spark, sf_dir), list(ORDERS_KINDS)
    estimates = pipeline.distinct_estimates(run.cells, 2.0)
    generated = run.generated.select(*[F.col(f"{c}__dirty").alias(c) for c in columns])
    return validate.distincts(profile.distinct_counts(derived.orders(spark, sf_dir), columns), profile.distinct_counts(generated, columns), estimates, 2)


@query(f"""
WITH {cte(ORDERS, "orders")}, v AS (SELECT CASE WHEN o_totalprice__dirty IS NULL OR o_totalprice__dirty IN (-9999, 99999) THEN NULL ELSE o_totalprice__dirty END AS v FROM pair),
q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM v)
SELECT 'o_totalprice' AS "column", count(*) AS rows, count(DISTINCT v) AS "distinct", count(*) FILTER (WHERE v IS NULL) AS missing, count(*) FILTER (WHERE v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) AS outliers,
       round(avg(v), 4) AS mean, round(var_pop(v) / 1e6, 2) AS var, round(skewness(v) * (count(v) - 2) / sqrt(count(v) * (count(v) - 1.0)), 6) AS skew, round(kurtosis_pop(v), 6) AS kurt
FROM v, q
""")
def data_stats_orders(spark, sf_dir):
    """Size, distinct values, missing values, outliers and moments of a dirty column, in one table."""
    rows = derived.orders(spark, sf_dir).select(F.col("o_totalprice__dirty").alias("o_totalprice"))
    found = profile.bundle(rows, ["o_totalprice"], values.missing_number).withColumn("var", F.round(F.col("var") / 1e6, 2))
    return rounded(rounded(found, "mean", digits=4), "skew", "kurt")


@query(f"""
WITH {cte(CUSTOMER, "customer")},
v AS (SELECT 'c_name' AS "column", c_name__dirty AS v FROM pair UNION ALL SELECT 'c_mktsegment', c_mktsegment__dirty FROM pair),
m AS (SELECT "column", CASE WHEN v IS NULL OR trim(v) = '' OR v IN ('NA', 'NaN', 'NAN', 'nan', '0-*') THEN NULL ELSE v END AS v FROM v),
n AS (SELECT c_acctbal AS v FROM customer), q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM n)
SELECT "column", count(*) AS rows, count(DISTINCT v) AS "distinct", count(*) - count(v) AS missing, CAST(NULL AS BIGINT) AS outliers, CAST(NULL AS DOUBLE) AS mean FROM m GROUP BY "column"
UNION ALL SELECT 'c_acctbal', count(*), count(DISTINCT v), count(*) - count(v), count(*) FILTER (WHERE v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)), round(avg(v), 4) FROM n, q
""")
def data_stats_customer(spark, sf_dir):
    """Statistics of a numeric and two text columns in one table."""
    dirty = derived.customer(spark, sf_dir).select("c_custkey", F.col("c_name__dirty").alias("c_name"), F.col("c_mktsegment__dirty").alias("c_mktsegment"))
    rows = dirty.join(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    found = profile.bundle(rows, ["c_acctbal"], lambda v: values.missing_number(values.as_double(v)), ["c_name", "c_mktsegment"], values.missing_text)
    return found.select("column", "rows", "distinct", "missing", "outliers", F.round("mean", 4).alias("mean"))


@query("SELECT 'user_id' AS \"column\", count(DISTINCT user_id) AS exact, true AS close FROM events UNION ALL SELECT 'event_type', count(DISTINCT event_type), true FROM events")
def distinct_approx_error_events(spark, sf_dir):
    """Approximate distinct counts are within three standard errors of the exact ones."""
    rows = table(spark, sf_dir, "events")
    both = profile.approximate_distinct_counts(rows, ["user_id", "event_type"]).join(profile.distinct_counts(rows, ["user_id", "event_type"]), "column")
    exact = F.col("distinct_excl_null")
    return both.select("column", exact.alias("exact"), (F.abs(F.col("distinct_approx") - exact) <= 0.3 * exact).alias("close"))


@query(_each("round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, true AS close", MEASURES, "lineitem"))
def approx_quantiles_error_lineitem(spark, sf_dir):
    """Approximate quartiles are within a thousandth of the range of the exact ones."""
    rows = table(spark, sf_dir, "lineitem")
    near = profile.approximate_quantiles(rows, MEASURES).select("column", *[F.col(q).alias(f"a{q}") for q in ("q25", "q50", "q75")])
    both = profile.quantiles(rows, MEASURES).join(near, "column").join(profile.moments(rows, MEASURES).select("column", (F.col("max") - F.col("min")).alias("range")), "column")
    close = F.lit(True)
    for q in ("q25", "q50", "q75"):
        close = close & (F.abs(F.col(q) - F.col(f"a{q}")) <= 0.001 * F.col("range"))
    return rounded(both.select("column", "q25", "q50", "q75", close.alias("close")), "q25", "q50", "q75")


# --- dependencies, repairs, similarity --------------------------------------------------------------

DEPENDENT = [("l_linestatus", "l_returnflag"), ("l_returnflag", "l_linestatus"), ("l_suppkey", "l_linestatus")]


def _dependency_sql(pairs_: list[tuple[str, str]], source: str) -> str:
    each = " UNION ALL ".join(f"SELECT '{a}' AS lhs, '{b}' AS rhs, CAST({a} AS VARCHAR) AS x, CAST({b} AS VARCHAR) AS y FROM {source}" for a, b in pairs_)
    return f"""WITH c AS (SELECT lhs, rhs, x, y, count(*) AS n FROM ({each}) GROUP BY ALL), b AS (SELECT lhs, rhs, x, max(n) AS most, sum(n) AS n, count(*) AS ways FROM c GROUP BY ALL)
SELECT lhs, rhs, round(sum(most) / sum(n), 6) AS confidence, max(ways) = 1 AS exact, max(ways) = 1 OR sum(most) / sum(n) >= 0.8 AS holds FROM b GROUP BY lhs, rhs"""


@query(_dependency_sql(DEPENDENT, "lineitem"))
def fd_confidence_lineitem(spark, sf_dir):
    return rounded(dependencies.confidences(table(spark, sf_dir, "lineitem"), DEPENDENT), "confidence")


@query(_dependency_sql(dependencies.all_pairs(["n_nationkey", "n_name", "n_regionkey"]), "nation"))
def fd_exact_nation(spark, sf_dir):
    return rounded(dependencies.confidences(table(spark, sf_dir, "nation"), dependencies.all_pairs(["n_nationkey", "n_name", "n_regionkey"])), "confidence")


LATTICE = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _lattice_sql(columns: list[str], most: int, source: str) -> str:
    """Minimal dependencies from the group counts of all sets of columns; a set is a number with a bit for each column."""
    sets = [s for size in range(most + 2) for s in itertools.combinations(range(len(columns)), size)]
    bits = lambda s: sum(1 << i for i in s)
    counted = " UNION ALL ".join(f"SELECT {bits(s)} AS b, '{','.join(columns[i] for i in s)}' AS name, {len(s)} AS size, count(*) AS n FROM (SELECT DISTINCT {', '.join(columns[i] for i in s) or '1'} FROM {source})" for s in sets)
    rights = ", ".join(f"({1 << i}, '{c}')" for i, c in enumerate(columns))
    return f"""
WITH counts AS ({counted}), rights(bit, rhs) AS (VALUES {rights}),
held AS (
  SELECT x.b, x.name, x.size, r.rhs FROM counts x JOIN rights r ON x.b & r.bit = 0 JOIN counts y ON y.b = x.b + r.bit
  WHERE x.size <= {most} AND x.n = y.n)
SELECT name AS lhs, rhs, size AS columns FROM held h
WHERE NOT EXISTS (SELECT 1 FROM held s WHERE s.rhs = h.rhs AND s.b <> h.b AND s.b & h.b = s.b)
"""


@query(_lattice_sql(LATTICE, 3, "orders"))
def fd_lattice_orders(spark, sf_dir):
    """Minimal dependencies of orders with up to three columns on the left."""
    found = dependencies.lattice(table(spark, sf_dir, "orders"), LATTICE, 3)
    rows = [(dependencies.left_name(lhs), rhs, len(lhs)) for lhs, rhs in found]
    return spark.createDataFrame(rows, "lhs string, rhs string, columns int")


FD_CTE = f"""
WITH {cte(ZONES, "lineitem")},
votes AS (
  SELECT 'l_zone' AS col, CAST(l_suppkey__dirty AS VARCHAR) AS x, l_zone__dirty AS y, count(*) AS n FROM pair WHERE l_zone__dirty IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'l_area', l_zone__dirty, l_area__dirty, count(*) FROM pair WHERE l_area__dirty <> 'NA' GROUP BY ALL),
most AS (SELECT col, x, y FROM votes QUALIFY row_number() OVER (PARTITION BY col, x ORDER BY n DESC, y) = 1),
cells AS (
  SELECT 'l_zone' AS col, CAST(l_suppkey__dirty AS VARCHAR) AS x, l_zone AS clean, l_zone__dirty AS dirty, l_zone__dirty IN (SELECT l_zone FROM pair) AS known FROM pair WHERE l_zone__dirty IS DISTINCT FROM l_zone
  UNION ALL SELECT 'l_area', l_zone__dirty, l_area, l_area__dirty, l_area__dirty IN (SELECT l_area FROM pair) FROM pair WHERE l_area__dirty <> l_area),
classed AS (
  SELECT c.*, CASE WHEN dirty IS NULL OR dirty = 'NA' THEN 'MV' WHEN NOT known THEN 'TYPO' WHEN m.y <> dirty THEN 'FD' ELSE 'REPLACEMENT' END AS error_class
  FROM cells c LEFT JOIN most m ON m.col = c.col AND m.x IS NOT DISTINCT FROM c.x)
"""


def _zone_cells(spark, sf_dir):
    return pairs.classify(derived.zones(spark, sf_dir), ZONES_KEY, ZONES_KINDS, dependencies=ZONES_DEPENDENCIES)


@query(FD_CTE + "SELECT col, error_class, count(*) AS n FROM classed GROUP BY ALL")
def fd_errors_lineitem(spark, sf_dir):
    """Error classes where zones depend on suppliers and areas on zones."""
    return pairs.class_counts(_zone_cells(spark, sf_dir))


@query(FD_CTE + "SELECT CASE col WHEN 'l_zone' THEN 'l_suppkey' ELSE 'l_zone' END AS lhs, col, count(DISTINCT x) AS groups, count(*) AS n FROM classed WHERE error_class = 'FD' GROUP BY ALL")
def fd_broken_groups_lineitem(spark, sf_dir):
    """How many left values of each dependency have cells that break it, and how many cells."""
    return pairs.histogram(_zone_cells(spark, sf_dir), "fd").groupBy("lhs", "col").agg(F.count_distinct("x").alias("groups"), F.sum("n").alias("n"))


@query(FD_CTE + f""",
plan AS (SELECT col, x, dirty AS value, CAST(round_even(count(*) * 2.0, 0) AS BIGINT) AS planned FROM classed WHERE error_class = 'FD' GROUP BY ALL),
lines AS (SELECT *, sum(planned) OVER (PARTITION BY col, x ORDER BY md5(coalesce(CAST(value AS VARCHAR), ''))) AS hi FROM plan),
n AS (SELECT count(*) AS n FROM lineitem),
base AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED}|' || {" || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in ZONES_KEY)})) - 1 AS k FROM pair),
scaled AS (SELECT copy * n + k AS row_id, l_suppkey, l_zone FROM (SELECT *, unnest([0, 1]) AS copy FROM base, n)),
sides AS (SELECT row_id, 'l_zone' AS col, CAST(l_suppkey AS VARCHAR) AS x FROM scaled UNION ALL SELECT row_id, 'l_area', l_zone FROM scaled),
ranked AS (SELECT *, row_number() OVER (PARTITION BY col, x ORDER BY md5('{SEED}|' || CAST(row_id AS VARCHAR))) - 1 AS place FROM sides)
SELECT row_id, r.col, value FROM ranked r JOIN lines l ON l.col = r.col AND l.x = r.x AND place >= hi - planned AND place < hi
""")
def inject_fd_lineitem(spark, sf_dir):
    """Edits of the doubled table that break the same groups as before, and no other."""
    pair = derived.zones(spark, sf_dir)
    scaled = scale.replicate(pair.select(*ZONES_KEY, "l_zone", "l_area"), ZONES_KEY, 2)
    edits = inject.broken(scaled, ZONES_KINDS, ZONES_DEPENDENCIES, pairs.histogram(_zone_cells(spark, sf_dir), "fd"), 2, SEED)
    return edits.select(F.col("_row_id").alias("row_id"), "col", "value")


@query(f"""
WITH {cte(ZONES, "lineitem")},
c AS (
  SELECT 'l_suppkey->l_zone' AS "column", CAST(l_suppkey AS VARCHAR) AS x, l_zone AS clean, l_zone__dirty AS dirty FROM pair
  UNION ALL SELECT 'l_zone->l_area', l_zone, l_area, l_area__dirty FROM pair),
d AS (SELECT "column", x, dirty, count(*) AS n FROM (SELECT "column", CASE "column" WHEN 'l_zone->l_area' THEN NULL ELSE x END AS x, dirty FROM c WHERE "column" <> 'l_zone->l_area' UNION ALL SELECT 'l_zone->l_area', l_zone__dirty, l_area__dirty FROM pair) GROUP BY ALL),
e AS (SELECT "column", x, clean, count(*) AS n FROM c GROUP BY ALL),
dm AS (SELECT "column", sum(most) / sum(n) AS actual FROM (SELECT "column", x, max(n) AS most, sum(n) AS n FROM d GROUP BY ALL) GROUP BY ALL),
em AS (SELECT "column", sum(most) / sum(n) AS expected FROM (SELECT "column", x, max(n) AS most, sum(n) AS n FROM e GROUP BY ALL) GROUP BY ALL)
SELECT 'dependency' AS "check", "column", round(expected, 6) AS expected, round(actual, 6) AS actual, 0.05 AS tolerance, abs(actual - expected) <= 0.05 AS passed FROM em JOIN dm USING ("column")
""")
def validate_dependencies_lineitem(spark, sf_dir):
    """Confidence of the dependencies in the clean and the dirty table."""
    pair = derived.zones(spark, sf_dir)
    names = ["l_suppkey", *ZONES_KINDS]
    dirty = pair.select(*[F.col(c + pairs.DIRTY).alias(c) for c in names])
    found = [dependencies.confidences(df, ZONES_DEPENDENCIES) for df in (pair.select(*names), dirty)]
    return rounded(validate.confidences(*found), "expected", "actual")


@query(f"""
WITH {cte(ZONES, "lineitem")},
zv AS (SELECT l_suppkey, l_zone__dirty AS v, count(*) AS n FROM pair WHERE l_zone__dirty IS NOT NULL GROUP BY ALL),
zm AS (SELECT l_suppkey, v AS zone FROM zv QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, v) = 1),
z AS (SELECT pair.*, coalesce(zone, l_zone__dirty) AS zone FROM pair LEFT JOIN zm USING (l_suppkey)),
av AS (SELECT zone, l_area__dirty AS v, count(*) AS n FROM z WHERE l_area__dirty <> 'NA' GROUP BY ALL),
am AS (SELECT zone, v AS area FROM av QUALIFY row_number() OVER (PARTITION BY zone ORDER BY n DESC, v) = 1),
a AS (SELECT z.*, coalesce(area, l_area__dirty) AS area FROM z LEFT JOIN am USING (zone))
SELECT {", ".join(ZONES_KEY)}, 'l_zone' AS col, l_zone__dirty AS was, zone AS "value", zone = l_zone AS "right" FROM a WHERE zone IS DISTINCT FROM l_zone__dirty
UNION ALL SELECT {", ".join(ZONES_KEY)}, 'l_area', l_area__dirty, area, area = l_area FROM a WHERE area IS DISTINCT FROM l_area__dirty
""")
def impute_fd_lineitem(spark, sf_dir):
    """Dirty zones and areas set by chained dependencies, areas by two left sides, and whether they are what was clean."""
    pair = derived.zones(spark, sf_dir)
    dirty = pair.select(*ZONES_KEY, *[F.col(c + pairs.DIRTY).alias(c) for c in ZONES_KINDS], *[F.col(c).alias(f"clean_{c}") for c in ZONES_KINDS])
    cells = repair.by_dependencies(dirty, ZONES_KEY, [*ZONES_DEPENDENCIES, ("l_suppkey", "l_area")])
    was_clean = F.when(F.col("col") == "l_zone", F.col("clean_l_zone")).otherwise(F.col("clean_l_area"))
    return cells.join(dirty.drop(*ZONES_KINDS), ZONES_KEY).withColumn("right", F.col("value") == was_clean).drop("clean_l_zone", "clean_l_area")


#: Orders of which some are lost, some came in behind others, and some have other values.
SHIFTED = "SELECT 2 * o_orderkey AS place, o_custkey, CASE WHEN o_orderkey % 31 = 8 THEN -1.0 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM {t} WHERE o_orderkey % 97 NOT IN (5, 6) UNION ALL SELECT 2 * o_orderkey + 1, o_custkey, o_totalprice, 'NEW' FROM {t} WHERE o_orderkey % 89 = 7"


@query(f"""
WITH c AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_custkey, o_totalprice, o_orderpriority FROM orders),
d AS (SELECT row_number() OVER (ORDER BY place) - 1 AS pos, * EXCLUDE (place) FROM ({SHIFTED.format(t="orders")})),
u AS (SELECT 0 AS side, pos, (o_custkey, o_totalprice, o_orderpriority) AS v FROM c UNION ALL SELECT 1, pos, (o_custkey, o_totalprice, o_orderpriority) FROM d),
a AS (SELECT max(pos) FILTER (WHERE side = 0) AS a, max(pos) FILTER (WHERE side = 1) AS b FROM u GROUP BY v HAVING count(*) FILTER (WHERE side = 0) = 1 AND count(*) FILTER (WHERE side = 1) = 1),
cs AS (SELECT pos, max(a) OVER (ORDER BY pos) AS gap, pos - coalesce(max(a) OVER (ORDER BY pos), -1) AS o FROM c LEFT JOIN a ON a = pos),
ds AS (SELECT pos, max(a) OVER (ORDER BY pos) AS gap, pos - coalesce(max(b) OVER (ORDER BY pos), -1) AS o FROM d LEFT JOIN a ON b = pos)
SELECT cs.pos AS clean_at, ds.pos AS dirty_at FROM cs FULL JOIN ds ON coalesce(cs.gap, -1) = coalesce(ds.gap, -1) AND cs.o = ds.o
""")
def align_shifted_orders(spark, sf_dir):
    """Places of orders that belong together after rows were lost, added and changed."""
    rows, columns = table(spark, sf_dir, "orders"), ["o_custkey", "o_totalprice", "o_orderpriority"]
    dirty = spark.sql(SHIFTED.format(t="{orders}"), orders=rows)
    return shifted.places(shifted.in_order(rows.select("o_orderkey", *columns), ["o_orderkey"]), shifted.in_order(dirty, ["place"]), columns)


@query(f"""
WITH {cte(FLIPPED, "orders")},
d AS (SELECT o_orderkey, least(o_orderpriority, o_orderpriority__dirty) AS one, greatest(o_orderpriority, o_orderpriority__dirty) AS other, o_orderpriority__dirty < o_orderpriority AS low FROM pair WHERE o_orderpriority <> o_orderpriority__dirty),
r AS (SELECT *, row_number() OVER (PARTITION BY one, other, low ORDER BY md5('{SEED}|' || CAST(o_orderkey AS VARCHAR))) AS k FROM d)
SELECT 'o_orderpriority' AS col, a.one, a.other, a.o_orderkey, b.o_orderkey AS o_orderkey__other FROM r a JOIN r b ON a.one = b.one AND a.other = b.other AND a.k = b.k AND a.low AND NOT b.low
""")
def flip_pairs_orders(spark, sf_dir):
    """Orders that exchanged their priorities, in pairs."""
    cells = pairs.diff_cells(derived.flipped(spark, sf_dir), ["o_orderkey"], {"o_orderpriority": "str"})
    return pairs.flips(cells, ["o_orderkey"], SEED)


@query(f"""
WITH {cte(MISSPELT, "customer")},
v AS (SELECT DISTINCT c_name__dirty AS value FROM pair WHERE c_name__dirty <> c_name AND c_name__dirty NOT IN (SELECT c_name FROM pair)),
near AS (SELECT value, c_name AS nearest, levenshtein(value, c_name) AS distance FROM v, pair WHERE levenshtein(value, c_name) <= 2)
SELECT 'c_name' AS col, value, nearest, CAST(distance AS INT) AS distance FROM near QUALIFY row_number() OVER (PARTITION BY value ORDER BY distance, nearest) = 1
""")
def repair_typos_customer(spark, sf_dir):
    """The clean name nearest to each misspelt one."""
    pair = derived.misspelt(spark, sf_dir)
    cells = pairs.classify(pair, ["c_custkey"], {"c_name": "str"})
    typos = cells.where("error_class = 'TYPO'").select("col", F.col("dirty").alias("value"))
    return repair.nearest_clean(typos, pair.select(F.lit("c_name").alias("col"), F.col("c_name").alias("value")))


@query(ORDERS_CTE + "SELECT o_orderkey, round(greatest(least(o_totalprice__dirty, q3 + 1.5 * (q3 - q1)), q1 - 1.5 * (q3 - q1)), 4) AS price FROM pair, st WHERE o_totalprice__dirty IS NOT NULL UNION ALL SELECT o_orderkey, NULL FROM pair WHERE o_totalprice__dirty IS NULL")
def cap_outliers_orders(spark, sf_dir):
    pair = derived.orders(spark, sf_dir)
    low, high = pairs.fences(pair, ["o_totalprice"])["o_totalprice"].iqr
    return rounded(repair.cap(pair.select("o_orderkey", F.col("o_totalprice__dirty").alias("price")), "price", low, high), "price", digits=4)


def _impute_sql(value: str) -> str:
    return f"WITH {cte(ORDERS, 'orders')}, v AS (SELECT {value} AS fill FROM pair WHERE NOT (o_totalprice__dirty IS NULL OR o_totalprice__dirty = -9999)) SELECT o_orderkey, round(CASE WHEN o_totalprice__dirty IS NULL OR o_totalprice__dirty = -9999 THEN fill ELSE o_totalprice__dirty END, 3) AS price FROM pair, v"


def _imputed(how):
    def imputed(spark, sf_dir):
        rows = derived.orders(spark, sf_dir).select("o_orderkey", F.col("o_totalprice__dirty").alias("price"))
        return rounded(repair.impute(rows, "price", how, values.missing_number(F.col("price"))), "price", digits=3)

    return imputed


QUERIES["impute_mean_orders"], ORACLES["impute_mean_orders"] = _imputed("mean"), _impute_sql("avg(o_totalprice__dirty)")
QUERIES["impute_median_orders"], ORACLES["impute_median_orders"] = _imputed("median"), _impute_sql("median(o_totalprice__dirty)")


@query(f"WITH {cte(CUSTOMER, 'customer')}, v AS (SELECT c_mktsegment__dirty AS fill FROM pair WHERE c_mktsegment__dirty <> 'NA' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT c_custkey, CASE WHEN c_mktsegment__dirty = 'NA' THEN fill ELSE c_mktsegment__dirty END AS segment FROM pair, v")
def impute_mode_customer(spark, sf_dir):
    rows = derived.customer(spark, sf_dir).select("c_custkey", F.col("c_mktsegment__dirty").alias("segment"))
    return repair.impute(rows, "segment", "mode", values.missing_text(F.col("segment")))


@query("SELECT p_partkey, levenshtein(p_name, p_type) AS distance FROM part")
def levenshtein_part(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance"))


@query("SELECT p_partkey, round(len(list_intersect(list_distinct(string_split(p_name, '')), list_distinct(string_split(p_type, '')))) / len(list_distinct(list_concat(string_split(p_name, ''), string_split(p_type, '')))), 6) AS likeness FROM part")
def jaccard_part(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(values.jaccard(F.col("p_name"), F.col("p_type")), 6).alias("likeness"))


@query("SELECT a.vec_id, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] - z[2] AS DOUBLE) * CAST(z[1] - z[2] AS DOUBLE)))), 4) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def euclid_embeddings(spark, sf_dir):
    """Distance of each vector to the one with the next id."""
    rows = table(spark, sf_dir, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(after, "vec_id").select("vec_id", F.round(values.euclid(F.col("embedding"), F.col("other")), 4).alias("distance"))


@query("""
WITH v AS (SELECT DISTINCT p_retailprice AS value FROM part WHERE p_retailprice IS NOT NULL), w AS (SELECT value, lag(value) OVER (ORDER BY value) AS down, lead(value) OVER (ORDER BY value) AS up FROM v)
SELECT value, CASE WHEN up IS NULL OR value - down <= up - value THEN down ELSE up END AS nearest, round(abs(value - CASE WHEN up IS NULL OR value - down <= up - value THEN down ELSE up END), 6) AS distance FROM w
""")
def nearest_other_part(spark, sf_dir):
    return rounded(repair.nearest_others(table(spark, sf_dir, "part"), "p_retailprice"), "distance")


# --- sources and sinks ------------------------------------------------------------------------------


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def csv_scan_orders(spark, sf_dir):
    """Orders written as delimited text and read back with every column as text."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    path = place(spark, "csv")
    tables.write_csv(rows, path)
    return tables.read_csv(spark, path, schema=tables.all_text(rows.schema))


@query(ORDERS_CTE + "SELECT lower(error_class) AS label, col AS \"column\", CAST(count(*) AS DOUBLE) AS amount FROM classes GROUP BY ALL")
def report_roundtrip_orders(spark, sf_dir):
    """The profile rendered as a text report, written, and read back."""
    path = place(spark, "report")
    counts = pairs.class_counts(_orders_cells(spark, sf_dir))
    stats = profile.quantiles(derived.orders(spark, sf_dir), ["o_totalprice"])
    tables.write_report(tables.report_lines(counts, stats), path)
    return tables.read_report(spark, path).where("label not in ('q25', 'q50', 'q75')")


@query("SELECT c_custkey, c_name, rank FROM (SELECT c_custkey, c_name, row_number() OVER (ORDER BY md5('3215|' || CAST(c_custkey AS VARCHAR))) - 1 AS rank FROM customer) WHERE rank < 100")
def sample_customer(spark, sf_dir):
    """A reproducible sample of 100 rows without replacement: the operator's size is the point here."""
    rows = ranks.ranked(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ranks.hashed(SEED, F.col("c_custkey")))
    return rows.where("rank < 100")


@query(f"WITH {cte(ORDERS, 'orders')} SELECT o_orderkey, coalesce(o_totalprice__dirty, 0) AS price FROM pair")
def fill_constant_orders(spark, sf_dir):
    """Missing cells become 0."""
    return derived.orders(spark, sf_dir).select("o_orderkey", F.col("o_totalprice__dirty").alias("price")).na.fill(0.0, ["price"])


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def table_roundtrip_customer(spark, sf_dir):
    """Customers written as a Parquet table and read back."""
    path = place(spark, "table")
    tables.write_table(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), path)
    return spark.read.parquet(path)


FILED = [("l_linestatus", "l_returnflag"), ("l_linestatus", "l_suppkey"), ("l_returnflag", "l_linestatus")]


@query(_dependency_sql(FILED, "lineitem"))
def fd_files_lineitem(spark, sf_dir):
    """Dependencies read from a text and a JSON file, tested on the table."""
    columns = ["l_linestatus", "l_returnflag", "l_suppkey"]
    text, json = place(spark, "fds"), place(spark, "fds")
    spark.createDataFrame([("0 -> 1,2",)], "value string").write.text(text)
    spark.createDataFrame([('{"fds": [{"key": ["l_returnflag"], "value": ["l_linestatus"]}]}',)], "value string").write.text(json)
    both = tables.read_dependencies(spark, text, columns).union(tables.read_dependencies_json(spark, json))
    return rounded(dependencies.confidences(table(spark, sf_dir, "lineitem"), [(r.lhs, r.rhs) for r in both.collect()]), "confidence")


@query("SELECT round(avg(o_totalprice), 4) AS amount FROM orders GROUP BY o_orderpriority")
def metric_log_orders(spark, sf_dir):
    """Means by priority written as log lines and read back."""
    path = place(spark, "log")
    means = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("m"))
    means.select(F.concat(F.lit("Mean original dirty: "), F.col("m").cast("string")).alias("value")).write.text(path)
    return tables.read_metric_log(spark, path, "Mean original dirty").select(F.round("amount", 4).alias("amount"))


def _plan_rank_sql(i: int) -> str:
    return f"row_number() OVER (ORDER BY md5('{SEED}|{i}|' || CAST(o_orderkey AS VARCHAR))) - 1"


@query(f"""
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders), f AS (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM q),
r AS (SELECT *, {_plan_rank_sql(0)} AS r0, {_plan_rank_sql(1)} AS r1, {_plan_rank_sql(2)} AS r2, {_plan_rank_sql(3)} AS r3 FROM orders)
SELECT o_orderkey AS row_id, 'o_totalprice' AS col, round(CASE WHEN r0 % 2 = 0 THEN hi + (b - a) * (r0 + 1) ELSE lo - (b - a) * (r0 + 1) END, 4) AS amount, NULL AS value, 'OUTLIER' AS error_class FROM r, f, q WHERE r0 < 14
UNION ALL SELECT o_orderkey, unnest(['o_orderstatus', 'o_orderpriority']), NULL, unnest([o_orderpriority, o_orderstatus]), 'SWAP' FROM r WHERE r1 < 2
UNION ALL SELECT x.o_orderkey, 'o_orderpriority', NULL, y.o_orderpriority, 'REPLACEMENT' FROM r x JOIN r y ON x.r2 + y.r2 = 1
UNION ALL SELECT o_orderkey, 'o_orderstatus', NULL, rpad(o_orderstatus, CAST((SELECT max(len(o_orderstatus)) FROM orders) + 1 AS INTEGER), '~'), 'TYPO' FROM r WHERE r3 < 1
""")
def error_plan_orders(spark, sf_dir):
    """A declarative error plan read from a file and carried out."""
    path = place(spark, "plan")
    plan = '{"transformations": [{"t_type": "OUTLIER", "type": "from_iqr", "cols": ["o_totalprice"], "num_outliers": 14}, {"t_type": "SWAP_BETWEEN_COLS", "col1": "1", "col2": "2", "type": "neighbors"}, {"t_type": "FLIP", "col": "2"}, {"t_type": "DISTINCT", "col": "1"}]}'
    spark.createDataFrame([(plan,)], "value string").write.text(path)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_row_id"), "o_totalprice", "o_orderstatus", "o_orderpriority")
    made = declared.edits(rows, tables.read_error_plan(spark, path), SEED)
    outlying = F.col("error_class") == "OUTLIER"
    amount, text = F.when(outlying, F.round(F.col("value").try_cast("double"), 4)), F.when(~outlying, F.col("value"))
    return made.select(F.col("_row_id").alias("row_id"), "col", amount.alias("amount"), text.alias("value"), "error_class")


# --- streaming (an extension) -----------------------------------------------------------------------


@query('SELECT event_type AS "group", count(*) AS n, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, round(sum(value), 4) AS total, round(min(value), 6) AS least, round(max(value), 6) AS most FROM events GROUP BY event_type')
def stream_profile_events(spark, sf_dir):
    """Events as a stream, profiled batch by batch; the merged profile."""
    path = place(spark, "stream")
    # the table may be one file or a folder: a file source stream reads folders, so the file is a pattern's match
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/event[s].parquet")
    profiles.incremental(source, "event_type", "value", f"{path}/parts", f"{path}/state").awaitTermination()
    return rounded(rounded(profiles.merged(spark, f"{path}/parts"), "total", digits=4), "least", "most")


@query("SELECT date_trunc('hour', ts) AS start, event_type AS \"group\", count(*) AS n, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_profile_events(spark, sf_dir):
    return rounded(profiles.windowed(table(spark, sf_dir, "events"), "ts", "event_type", "value"), "total", digits=4)
