"""Sources and sinks: delimited text, Parquet tables, dependency files, error plans and profile reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schema of a declarative error plan file.
PLAN_SCHEMA = "transformations array<struct<t_type string, type string, col string, cols array<string>, col1 string, col2 string, num_outliers int>>"
#: Schema of a dependency file in JSON.
DEPENDENCY_SCHEMA = "fds array<struct<key array<string>, value array<string>>>"


def read_csv(spark: SparkSession, path: str, header: bool = True, sep: str = ",", schema: str | T.StructType | None = None, multi_line: bool = False) -> DataFrame:
    """Delimited text; without ``schema`` every column is text, so nothing is read twice to infer types.

    Files are split among tasks; only where cells hold line breaks (``multi_line``) is each file one task's.
    """
    reader = spark.read.option("header", header).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", multi_line)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", False)).csv(path)


def all_text(schema: T.StructType) -> T.StructType:
    """The same columns as text."""
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema])


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)


def write_table(df: DataFrame, path: str, name: str | None = None) -> None:
    """Parquet at ``path``, and if named a table in the catalog that points there."""
    writer = df.write.mode("overwrite").format("parquet").option("path", path)
    writer.saveAsTable(name) if name else writer.save()


def write_bucketed(df: DataFrame, path: str, name: str, by: str, buckets: int) -> DataFrame:
    """``df`` as the catalog's table ``name`` at ``path``, in buckets by a column and sorted by it within them; read back.

    Tables with equal numbers of buckets by equal columns meet without an exchange.
    """
    df.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, by).sortBy(by).saveAsTable(name)
    return df.sparkSession.table(name)


def read_dependencies(spark: SparkSession, path: str, columns: list[str], composite: bool = False) -> DataFrame:
    """(lhs, rhs) column names from lines ``i,j->k,l`` of 0-based column numbers; other lines are left out.

    Each left column stands alone, or with ``composite`` they are one left side, named by its columns joined by commas.
    """
    sides = F.split(F.regexp_replace("value", r"\s", ""), "->")
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*\d+(\s*,\s*\d+)*\s*->\s*\d+(\s*,\s*\d+)*\s*$"))
    name = lambda c: F.try_element_at(F.array(*map(F.lit, columns)), c.cast("int") + 1)
    if composite:
        lefts = F.transform(F.split(sides[0], ","), name)
        whole = lines.select(F.array_join(lefts, ",").alias("lhs"), F.exists(lefts, lambda c: c.isNull()).alias("gone"), F.explode(F.split(sides[1], ",")).alias("r"))
        return whole.where("not gone").select("lhs", name(F.col("r")).alias("rhs")).where("rhs is not null")
    pairs = lines.select(F.explode(F.split(sides[0], ",")).alias("l"), sides[1].alias("r")).select("l", F.explode(F.split("r", ",")).alias("r"))
    return pairs.select(name(F.col("l")).alias("lhs"), name(F.col("r")).alias("rhs")).where("lhs is not null and rhs is not null")


def read_dependencies_json(spark: SparkSession, path: str) -> DataFrame:
    """(lhs, rhs) column names from a JSON dependency file."""
    fds = spark.read.schema(DEPENDENCY_SCHEMA).option("multiLine", True).json(path).select(F.explode("fds").alias("fd"))
    return fds.select(F.explode("fd.key").alias("lhs"), "fd.value").select("lhs", F.explode("value").alias("rhs"))


def read_error_plan(spark: SparkSession, path: str) -> DataFrame:
    """One row for each transformation of a declarative error plan."""
    return spark.read.schema(PLAN_SCHEMA).option("multiLine", True).json(path).select(F.explode("transformations").alias("t")).select("t.*")


def report_lines(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """A profile as text lines ``label<TAB>column<TAB>value``, from class counts (col, error_class, n) and statistics (column, ...)."""
    one = counts.select(F.concat_ws("\t", F.concat(F.lit("Dirty "), F.lower("error_class")), "col", F.col("n").cast("string")).alias("value"))
    names = [c for c in stats.columns if c != "column"]
    two = stats.select(F.explode(F.array(*[F.concat_ws("\t", F.lit(f"Dirty {n}"), "column", F.coalesce(F.col(n).cast("string"), F.lit("null"))) for n in names])).alias("value"))
    return one.unionByName(two)


def histogram_lines(values: DataFrame) -> DataFrame:
    """Lines ``label<TAB>column<TAB>count<TAB>value`` of the erroneous values in (col, error_class, dirty); a value is written as JSON, so that it stays on its line."""
    counted = values.groupBy("col", "error_class", "dirty").agg(F.count("*").alias("n"))
    value = F.to_json(F.array("dirty"), {"ignoreNullFields": "false"})
    return counted.select(F.concat_ws("\t", F.concat(F.lit("Dirty "), F.lower("error_class"), F.lit("_values")), "col", F.col("n").cast("string"), value).alias("value"))


def read_histograms(spark: SparkSession, path: str) -> DataFrame:
    """(error_class, col, value, n) from a report's histogram lines."""
    part = lambda k: F.regexp_extract("value", r"^Dirty (\S+)_values\t([^\t]*)\t(\d+)\t(.*)$", k)
    rows = spark.read.text(path).select(part(1).alias("label"), part(2).alias("col"), part(3).alias("n"), part(4).alias("text")).where("label <> ''")
    return rows.select(F.upper("label").alias("error_class"), "col", F.from_json("text", "array<string>")[0].alias("value"), F.col("n").cast("long").alias("n"))


def write_report(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(label, column, amount) from report lines other than histograms; amounts that are no numbers are null."""
    part = lambda k: F.regexp_extract("value", r"^Dirty (\S+)\t([^\t]*)\t(.*)$", k)
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^Dirty \S+_values\t"))
    rows = rows.select(part(1).alias("label"), part(2).alias("column"), part(3).alias("text")).where("label <> ''")
    return rows.select("label", "column", F.col("text").try_cast("double").alias("amount"))


def read_metric_log(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """(file, amount) of every line ``<metric>: number`` of log files."""
    import re

    found = F.regexp_extract("value", rf"{re.escape(metric)}:\s*([-+0-9.eE]+)", 1)
    return spark.read.text(path).select(F.input_file_name().alias("file"), found.alias("text")).where("text <> ''").select("file", F.col("text").try_cast("double").alias("amount"))
