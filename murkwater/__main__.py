"""Command line: ``python -m murkwater -c clean.csv -d dirty.csv -sf 2 -o out``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.files import Paths, run_files


def main() -> None:
    p = argparse.ArgumentParser(prog="murkwater", description=__doc__)
    p.add_argument("-c", "--clean", required=True, help="clean table, delimited text")
    p.add_argument("-d", "--dirty", required=True, help="its dirty twin")
    p.add_argument("-sf", "--factor", type=float, required=True, help="scaling factor")
    p.add_argument("-o", "--output", required=True, help="folder of the generated table")
    p.add_argument("-edc", "--original-report", help="folder of the original profile's report")
    p.add_argument("-edd", "--generated-report", help="folder of the generated profile's report")
    p.add_argument("-k", "--key", action="append", help="key column; without any, rows are matched by position")
    p.add_argument("-fd", "--dependencies", help="file of functional dependencies, lines of column numbers such as 0,1->2")
    p.add_argument("--composite", action="store_true", help="take the left columns of a dependency together")
    a = p.parse_args()
    spark = SparkSession.builder.appName("murkwater").getOrCreate()
    paths = Paths(a.output, a.original_report or f"{a.output}_original_report", a.generated_report or f"{a.output}_generated_report")
    run_files(spark, a.clean, a.dirty, a.factor, paths, a.key, dependencies=a.dependencies, composite=a.composite).orderBy("check", "column").show(1000, truncate=False)


if __name__ == "__main__":
    main()
