"""Benchmark receipts (run, ordinal, elapsed_ns) and other event folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_first(receipts: DataFrame) -> DataFrame:
    """Each receipt with whether it is the first measured one of its run, which counts apart from the warmed rest."""
    return receipts.withColumn("first_measured", F.col("ordinal") == 0)


def latency(receipts: DataFrame, by: str = "run") -> DataFrame:
    """Per run: the first elapsed time, and count, min, p50, p95, p99, max and floored mean of the others."""
    warmed = F.when(F.col("ordinal") > 0, F.col("elapsed_ns"))
    w = receipts.select(by, F.when(F.col("ordinal") == 0, F.col("elapsed_ns")).alias("f"), warmed.alias("w"))
    rank = lambda p: F.expr(f"percentile_disc({p}) within group (order by w)").cast("long")
    return w.groupBy(by).agg(
        F.max("f").alias("first_ns"), F.count("w").alias("samples"), F.min("w").alias("min_ns"), rank(0.5).alias("p50_ns"), rank(0.95).alias("p95_ns"), rank(0.99).alias("p99_ns"), F.max("w").alias("max_ns"),
        F.floor(F.try_divide(F.sum("w"), F.count("w"))).cast("long").alias("mean_ns"),
    )


def rates(receipts: DataFrame, units: int, by: str = "run") -> DataFrame:
    """Per run: quantiles of the rates of its warmed samples, units a second."""
    r = receipts.where("ordinal > 0").select(by, (F.lit(float(units)) * 1e9 / F.greatest(F.col("elapsed_ns"), F.lit(1))).alias("r"))
    rank = lambda p: F.expr(f"percentile_disc({p}) within group (order by r)")
    return r.groupBy(by).agg(F.count("r").alias("samples"), F.min("r").alias("min_rate"), rank(0.5).alias("p50_rate"), rank(0.95).alias("p95_rate"), rank(0.99).alias("p99_rate"), F.max("r").alias("max_rate"))


def totals(receipts: DataFrame, by: str, known: list[str], optional: list[str], peak: list[str]) -> DataFrame:
    """Resource vectors added up: sums; optional dimensions only where every part is known; peaks by their maximum."""
    return receipts.groupBy(by).agg(
        *(F.sum(c).alias(c) for c in known), *(F.when(F.count(c) == F.count(F.lit(1)), F.sum(c)).alias(c) for c in optional), *(F.max(c).alias(c) for c in peak)
    )


def latest(events: DataFrame, key: str, seq: list[str], values: list[str]) -> DataFrame:
    """The last state of each key by its sequence."""
    return events.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*seq)).alias("v"), F.count(F.lit(1)).alias("events")).select(key, "events", "v.*")


def posterior(prior: DataFrame, updates: DataFrame) -> DataFrame:
    """(claim, probability, updates): of ``updates`` (claim, seq, probability) the last of each claim stands; claims without one keep their prior."""
    last = updates.groupBy(F.col("claim").alias("__claim")).agg(F.max_by("probability", "seq").alias("__p"), F.count(F.lit(1)).alias("n"))
    both = prior.join(last, F.col("claim") == F.col("__claim"), "full_outer")
    return both.select(F.coalesce("claim", "__claim").alias("claim"), F.coalesce("__p", "probability").alias("probability"), F.coalesce("n", F.lit(0)).alias("updates"))
