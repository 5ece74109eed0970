"""Clean/dirty pairs derived from the driver's tables by rules on keys; the expressions are valid in Spark SQL and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORDERS = [
    "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority",
    "CASE WHEN o_orderkey % 101 = 7 THEN NULL WHEN o_orderkey % 103 = 11 THEN CAST(-9999 AS DOUBLE) WHEN o_orderkey % 107 = 13 THEN o_totalprice * 1000 WHEN o_orderkey % 127 = 5 THEN o_totalprice + CAST(0.005 AS DOUBLE) ELSE o_totalprice END AS o_totalprice__dirty",
    "CASE WHEN o_orderkey % 113 = 19 THEN concat(o_orderstatus, 'x') ELSE o_orderstatus END AS o_orderstatus__dirty",
    "CASE WHEN o_orderkey % 109 = 17 THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority__dirty",
]
ORDERS_KINDS = {"o_totalprice": "num", "o_orderstatus": "str", "o_orderpriority": "str"}

CUSTOMER = [
    "c_custkey", "c_name", "c_mktsegment",
    "CASE WHEN c_custkey % 89 = 2 THEN c_mktsegment ELSE c_name END AS c_name__dirty",
    "CASE WHEN c_custkey % 89 = 2 THEN c_name WHEN c_custkey % 53 = 4 THEN concat(c_mktsegment, 'q') WHEN c_custkey % 59 = 6 THEN 'BUILDING' WHEN c_custkey % 61 = 8 THEN 'NA' ELSE c_mktsegment END AS c_mktsegment__dirty",
]
CUSTOMER_KINDS = {"c_name": "str", "c_mktsegment": "str"}

LINEITEM = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax",
    "CASE WHEN l_orderkey % 97 = 3 THEN l_tax ELSE l_discount END AS l_discount__dirty",
    "CASE WHEN l_orderkey % 97 = 3 THEN l_discount ELSE l_tax END AS l_tax__dirty",
]
LINEITEM_KINDS = {"l_discount": "num", "l_tax": "num"}

#: Zones that depend on the supplier, and areas that depend on the zone; some rows break that, others are misspelt or missing.
ZONES = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    "concat('zone-', CAST(l_suppkey % 25 AS STRING)) AS l_zone",
    "concat('area-', CAST(l_suppkey % 25 % 4 AS STRING)) AS l_area",
    "l_suppkey AS l_suppkey__dirty",
    "CASE WHEN l_orderkey % 211 = 9 THEN concat('zone-', CAST((l_suppkey + 3) % 25 AS STRING)) WHEN l_orderkey % 223 = 4 THEN concat('zone-', CAST(l_suppkey % 25 AS STRING), 'x') WHEN l_orderkey % 227 = 5 THEN NULL ELSE concat('zone-', CAST(l_suppkey % 25 AS STRING)) END AS l_zone__dirty",
    "CASE WHEN l_orderkey % 229 = 6 THEN concat('area-', CAST((l_suppkey % 25 + 1) % 4 AS STRING)) WHEN l_orderkey % 233 = 7 THEN 'NA' ELSE concat('area-', CAST(l_suppkey % 25 % 4 AS STRING)) END AS l_area__dirty",
]
ZONES_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
ZONES_KINDS = {"l_zone": "str", "l_area": "str"}
ZONES_DEPENDENCIES = [("l_suppkey", "l_zone"), ("l_zone", "l_area")]

#: Priorities that some orders exchange, more to one side than to the other.
FLIPPED = [
    "o_orderkey", "o_orderpriority",
    "CASE WHEN o_orderkey % 9 = 3 AND o_orderpriority = '1-URGENT' THEN '5-LOW' WHEN o_orderkey % 13 = 4 AND o_orderpriority = '5-LOW' THEN '1-URGENT' WHEN o_orderkey % 17 = 5 AND o_orderpriority = '2-HIGH' THEN '3-MEDIUM' WHEN o_orderkey % 7 = 6 AND o_orderpriority = '3-MEDIUM' THEN '2-HIGH' WHEN o_orderkey % 19 = 7 THEN '4-NOT SPECIFIED' ELSE o_orderpriority END AS o_orderpriority__dirty",
]

#: Names with a letter dropped, put in or exchanged with the next, at a place that depends on the row.
MISSPELT = [
    "c_custkey", "c_name",
    "CASE WHEN c_custkey % 37 = 3 THEN concat(substring(c_name, 1, 1 + CAST(c_custkey % 16 AS INT)), substring(c_name, 3 + CAST(c_custkey % 16 AS INT), 40)) WHEN c_custkey % 41 = 5 THEN concat(substring(c_name, 1, 2 + CAST(c_custkey % 15 AS INT)), 'q', substring(c_name, 3 + CAST(c_custkey % 15 AS INT), 40)) WHEN c_custkey % 43 = 7 THEN concat(substring(c_name, 1, 3), substring(c_name, 5, 1), substring(c_name, 4, 1), substring(c_name, 6, 40)) ELSE c_name END AS c_name__dirty",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*ORDERS)


def customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*CUSTOMER)


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*LINEITEM)


def flipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*FLIPPED)


def misspelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*MISSPELT)


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*ZONES)


def cte(expressions: list[str], source: str) -> str:
    """The pair as a common table expression."""
    return f"pair AS (SELECT {', '.join(expressions)} FROM {source})"
