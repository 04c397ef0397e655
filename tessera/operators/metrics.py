"""Summaries, rates, distributions, rankings and comparisons of file and function metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import per_ksloc, ratio, relative_change
from tessera.operators import dist

SUMS = ["functions", "lines", "sloc", "ploc", "lloc", "cloc", "blank", "cognitive", "cyclomatic", "modified_cyclomatic", "arguments", "exits"]
DILUTED = ["maintainability", "halstead_volume", "halstead_difficulty", "halstead_effort"]
ABC = ["abc_assignments", "abc_branches", "abc_conditions"]
SORTS = {"cognitive": False, "cyclomatic": False, "sloc": False, "arguments": False, "exits": False, "maintainability": True, "halstead_effort": False}


def summary(files: DataFrame, by: str | None = None) -> DataFrame:
    """Sums, means over all files, and the ABC magnitude of the summed components.

    A mean divides the sum of the values there are by the count of all files; it is null only without any value.
    """
    have = set(files.columns)
    aggs = [F.count(F.lit(1)).alias("files"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in SUMS if c in have)]
    aggs += [ratio(F.sum(c), F.count(F.lit(1))).alias(f"mean_{c}") for c in DILUTED if c in have]
    if have.issuperset(ABC):
        aggs += [F.sum(c).alias(c) for c in ABC]
    out = (files.groupBy(by) if by else files.groupBy()).agg(*aggs)
    if have.issuperset(ABC):
        out = out.withColumn("abc_magnitude", F.sqrt(sum((F.col(c) * F.col(c) for c in ABC), F.lit(0.0))))
    return out


def rates(s: DataFrame) -> DataFrame:
    """The seven rates of a summary."""
    c = F.col
    return s.select(
        per_ksloc(c("functions"), c("sloc")).alias("functions_per_ksloc"),
        per_ksloc(c("cognitive"), c("sloc")).alias("cognitive_per_ksloc"),
        per_ksloc(c("cyclomatic"), c("sloc")).alias("cyclomatic_per_ksloc"),
        ratio(c("arguments"), c("functions")).alias("arguments_per_function"),
        ratio(c("exits"), c("functions")).alias("exits_per_function"),
        ratio(c("cloc"), c("lines")).alias("comment_fraction"),
        ratio(c("blank"), c("lines")).alias("blank_fraction"),
    )


def distributions(functions: DataFrame, metrics: tuple[str, ...] = ("cognitive", "cyclomatic", "sloc", "arguments", "exits")) -> DataFrame:
    """One row for each metric: count, min, p50, p90, p99, max, mean, from a single aggregation."""
    wide = functions.agg(*(c for m in metrics for c in dist.distribution(m, f"{m}__")))
    fields = ["count", "min", "p50", "p90", "p99", "max", "mean"]
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), *(F.col(f"{m}__{f}").alias(f) for f in fields)) for m in metrics)))
    return wide.select(rows.alias("r")).select("r.*")


def ranking(sort: str) -> list[Column]:
    key = F.col(sort).asc_nulls_last() if SORTS[sort] else F.col(sort).desc_nulls_last()
    return [key, F.col("path"), F.col("start_line"), F.col("name")]


def rank_functions(functions: DataFrame, sort: str, top: int, tie: tuple[str, ...] = ()) -> DataFrame:
    """The top functions by one of :data:`SORTS`; nulls come last, ties go by path, line and name."""
    return functions.orderBy(*ranking(sort), *tie).limit(top)


def rank_files(files: DataFrame, sort: str, top: int) -> DataFrame:
    key = F.col(sort).asc_nulls_last() if SORTS[sort] else F.col(sort).desc_nulls_last()
    return files.orderBy(key, "path").limit(top)


DIFFERENCES = ["files", "functions", "sloc", "ploc", "lloc", "cloc", "cognitive", "cyclomatic", "modified_cyclomatic", "arguments", "exits", "mean_maintainability", "mean_halstead_effort"]
DIFFERENCES += ["functions_per_ksloc", "cognitive_per_ksloc", "cyclomatic_per_ksloc", "arguments_per_function", "exits_per_function", "comment_fraction"]
#: Tails of the functions' distributions that a comparison has too: name, metric, rank (1: the greatest).
TAILS = [("function_cognitive_p50", "cognitive", 0.5), ("function_cognitive_p90", "cognitive", 0.9), ("function_cognitive_p99", "cognitive", 0.99), ("function_cognitive_max", "cognitive", 1.0), ("function_cyclomatic_p90", "cyclomatic", 0.9), ("function_sloc_p90", "sloc", 0.9)]


def report(files: DataFrame) -> DataFrame:
    """A summary and its rates in one row."""
    s = summary(files)
    return s.withColumns(
        {
            "functions_per_ksloc": per_ksloc(F.col("functions"), F.col("sloc")),
            "cognitive_per_ksloc": per_ksloc(F.col("cognitive"), F.col("sloc")),
            "cyclomatic_per_ksloc": per_ksloc(F.col("cyclomatic"), F.col("sloc")),
            "arguments_per_function": ratio(F.col("arguments"), F.col("functions")),
            "exits_per_function": ratio(F.col("exits"), F.col("functions")),
            "comment_fraction": ratio(F.col("cloc"), F.col("lines")),
        }
    )


def compare(left: DataFrame, right: DataFrame, functions: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """metric, left, right, right_minus_left and relative_change_from_left of what both reports have, and of the tails of both sides' functions; a metric that is null on a side is left out."""

    def long(files: DataFrame, side: str, tails: DataFrame | None) -> DataFrame:
        r = report(files)
        rows = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias(side)) for n in DIFFERENCES if n in r.columns]
        out = r.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
        if tails is None:
            return out
        t = tails.agg(*((F.max(m) if p == 1 else dist.nearest_rank(m, p)).cast("double").alias(n) for n, m, p in TAILS))
        return out.union(t.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias(side)) for n, _, _ in TAILS))).alias("s")).select("s.*"))

    a, b = functions or (None, None)
    both = long(left, "left", a).join(long(right, "right", b), "metric").dropna()
    return both.select("metric", "left", "right", (F.col("right") - F.col("left")).alias("right_minus_left"), relative_change(F.col("left"), F.col("right")).alias("relative_change_from_left"))


def compare_files(left: DataFrame, right: DataFrame, metrics: tuple[str, ...] = ("sloc", "cognitive", "cyclomatic", "arguments", "exits")) -> DataFrame:
    """Full outer join on (path, language): status matched, only_left or only_right, values of both sides and their deltas."""
    a = left.select("path", "language", *(F.col(m).alias(f"left_{m}") for m in metrics), F.lit(True).alias("__l"))
    b = right.select("path", "language", *(F.col(m).alias(f"right_{m}") for m in metrics), F.lit(True).alias("__r"))
    j = a.join(b, ["path", "language"], "full_outer")
    status = F.when(F.col("__r").isNull(), "only_left").when(F.col("__l").isNull(), "only_right").otherwise("matched")
    return j.select("path", "language", status.alias("status"), *(c for m in metrics for c in (F.col(f"left_{m}"), F.col(f"right_{m}"), (F.col(f"right_{m}") - F.col(f"left_{m}")).alias(f"delta_{m}"))))
