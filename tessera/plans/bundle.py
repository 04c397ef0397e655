"""The five instruments over one source tree, each with its coverage and state; one that fails does not stop the others."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import clones
from tessera.plans.checkpoints import cut
from tessera.sources import code, manifests

SCHEMA = "instrument string, state string, observations string, error string"
TOP = 5


def one(df: DataFrame) -> dict:
    return {k: v for k, v in df.first().asDict().items()}


def top(df: DataFrame, by: str, then: list[str]) -> list[dict]:
    return [r.asDict() for r in df.where(F.col(by) > 0).orderBy(F.col(by).desc(), *then).limit(TOP).collect()]


def metrics(files: DataFrame, sources: DataFrame) -> dict:
    m = cut(code.measures(sources))
    total = m.agg(F.count(F.lit(1)).alias("files"), *(F.sum(c).alias(c) for c in ("functions", "sloc", "cognitive", "cyclomatic")), F.count_if("syntax_error").alias("syntax_error_files"))
    return one(total) | {"hotspots": top(m.select("path", "cognitive", "cyclomatic", "sloc"), "cognitive", ["path"])}


def dependencies(files: DataFrame, sources: DataFrame) -> dict:
    rows = cut(manifests.dependencies(files))
    used = code.imports(sources).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    counts = rows.agg(F.count_if(F.col("error").isNull()).alias("manifest_dependencies"), F.count_if(F.col("error").isNotNull()).alias("unreadable_manifests"))
    return one(counts) | {"imports": {r.kind: r.n for r in used.collect()}}


def duplicates(files: DataFrame, sources: DataFrame, k: int = 40, min_lines: int = 5) -> dict:
    g = cut(clones.groups(code.token_text(sources), k, min_lines))
    return one(g.agg(F.count(F.lit(1)).alias("groups"), F.sum(F.col("tokens") * F.col("occurrences")).alias("token_mass"))) | {"groups_of_most": top(g.select("tokens", "occurrences", "first_file"), "tokens", ["first_file"])}


def api(files: DataFrame, sources: DataFrame) -> dict:
    return one(code.exported(sources).agg(F.count(F.lit(1)).alias("symbols"), F.count_if("documented").alias("documented"), *(F.count_if(F.col("kind") == c).alias(f"{c}s") for c in ("function", "type", "constant", "module", "reexport"))))


def tests(files: DataFrame, sources: DataFrame) -> dict:
    return one(code.test_cases(sources).agg(F.count(F.lit(1)).alias("cases"), F.count_if("ignored").alias("ignored"))) | one(code.measures(sources).agg(F.sum("assertions").alias("assertions")))


INSTRUMENTS: dict[str, Callable[[DataFrame, DataFrame], dict]] = {"metrics": metrics, "dependencies": dependencies, "duplicates": duplicates, "api": api, "tests": tests}


def analyze(spark: SparkSession, files: DataFrame, instruments: dict[str, Callable[[DataFrame, DataFrame], dict]] = INSTRUMENTS) -> DataFrame:
    """A row for each instrument: complete with its observations as JSON, or failed with its error, of ``files`` (path, content)."""
    sources, out = code.sources(files), []
    for name, run in instruments.items():
        try:
            out.append((name, "complete", json.dumps(run(files, sources), sort_keys=True), None))
        except Exception as failure:  # an instrument's failure is part of the result
            out.append((name, "failed", None, str(failure)[:1000]))
    return spark.createDataFrame(out, SCHEMA)
