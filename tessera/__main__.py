"""``python -m tessera query NAME DIR [--top N]``, ``tree DIR``, ``audit DIR``: results as JSON lines, or as a table with ``--top``. Exit code 0, 1 if an audit finds errors, 2 for a wrong call."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions import render
from tessera.operators import audit
from tessera.plans import bundle, catalog
from tessera.sources import code


def main(args: list[str], spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    parser.add_argument("what", choices=["query", "tree", "audit"])
    parser.add_argument("where", nargs="+")
    parser.add_argument("--top", type=int, default=0)
    asked = parser.parse_args(args)
    wrong = asked.what == "query" and (len(asked.where) != 2 or asked.where[0] not in catalog.QUERIES) or asked.what != "query" and len(asked.where) != 1
    if wrong:
        print(f"queries: {' '.join(sorted(catalog.QUERIES))}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    where, failed = asked.where[-1], False
    if asked.what == "query":
        df = catalog.QUERIES[asked.where[0]](spark, where)
    elif asked.what == "tree":
        df = bundle.analyze(spark, code.discover(spark, where))
    else:
        files = code.discover(spark, where)
        text = lambda name: files.where(F.col("path") == name).select(F.col("content").cast("string").alias("text"))
        need = spark.createDataFrame([("report.md",), ("records.jsonl",)], "path string")
        found = audit.audit(audit.record_lines(text("records.jsonl")), text("report.md")).unionByName(audit.required(need, files.select("path", "content")))
        df = found.orderBy("line", "id", "code")
        failed = not found.where("severity = 'error'").isEmpty()
    if asked.top:
        print(render.text_table(" ".join(asked.where), df, [F.lit(1)], asked.top), end="")
    else:
        for row in render.json_lines(df).toLocalIterator():
            print(row.value)
    return int(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
