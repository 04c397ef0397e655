"""Distribution statistics over a weight column: exact nearest-rank quantiles, entropy, concentration.

Nothing here windows over a whole table: totals are joined back as one broadcast row, and ranks are taken over the
distinct values with their counts, which combine map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import ratio
from tessera.plans.checkpoints import cut


def nearest_rank(column: str, p: float) -> Column:
    """The ceil(p*n)-th smallest value, without interpolation."""
    return F.expr(f"percentile_disc({p}) within group (order by {column})")


def distribution(column: str, prefix: str = "") -> list[Column]:
    """count, min, p50, p90, p99, max and mean; all but the count are null over nothing."""
    names = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    ranks = [nearest_rank(column, p).cast("double").alias(f"{prefix}{n}") for n, p in names.items()]
    c = F.col(column).cast("double")
    return [F.count(column).alias(f"{prefix}count"), F.min(c).alias(f"{prefix}min"), *ranks, F.max(c).alias(f"{prefix}max"), F.avg(c).alias(f"{prefix}mean")]


def entropy(df: DataFrame, weight: str, by: list[str] | None = None) -> DataFrame:
    """normalized_entropy and effective_count of the weights, for each group.

    Zero weights count in the number of weights. Nothing, or no mass, gives nulls; exactly one weight gives 0 and 1, whatever it is.
    """
    by = by or []
    one = df.select(*by, F.col(weight).cast("double").alias("__w"))
    # sum of p ln p from sums of w and w ln w, so that one aggregation is enough
    agg = one.groupBy(*by).agg(F.count("__w").alias("__n"), F.sum("__w").alias("__t"), F.sum(F.when(F.col("__w") > 0, F.col("__w") * F.ln("__w")).otherwise(0.0)).alias("__s"))
    h = F.greatest(F.lit(0.0), F.ln("__t") - F.col("__s") / F.col("__t"))
    norm = F.least(F.lit(1.0), h / F.ln("__n"))
    some = F.col("__t") > 0
    return agg.select(*by, F.when(F.col("__n") == 1, 0.0).when(some, norm).alias("normalized_entropy"), F.when(F.col("__n") == 1, 1.0).when(some, F.exp(h)).alias("effective_count"))


def top_share(df: DataFrame, weight: str, tenths: int = 1) -> DataFrame:
    """One row, top_share: the part of the mass that the ceil(n/10) largest weights hold; null without mass.

    Weights fall into buckets, 64 for each doubling, of which there are a few thousand at most; only in the bucket where the quota ends are values ranked.
    """
    counts = df.groupBy(F.col(weight).alias("__w")).agg(F.count(F.lit(1)).alias("__c"))
    counts = cut(counts.withColumn("__g", F.when(F.col("__w") > 0, F.floor(F.log2(F.col("__w").cast("double")) * 64)).otherwise(F.lit(-1 << 40))))
    groups = counts.groupBy("__g").agg(F.sum("__c").alias("__gc"), F.sum(F.col("__w") * F.col("__c")).alias("__gm"))
    ahead = lambda key: Window.orderBy(F.col(key).desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    groups = groups.withColumns({"__b": F.coalesce(F.sum("__gc").over(ahead("__g")), F.lit(0)), "__quota": F.floor((F.sum("__gc").over(whole) * tenths + 9) / 10), "__t": F.sum("__gm").over(whole)})
    groups = cut(groups.withColumn("__room", F.greatest(F.lit(0), F.least("__gc", F.col("__quota") - F.col("__b")))))
    last = groups.where("__room > 0 and __room < __gc").select(F.col("__g").alias("__last"), "__room")
    inside = counts.join(F.broadcast(last), F.col("__g") == F.col("__last"))
    taken = F.least(F.col("__c"), F.greatest(F.lit(0), F.col("__room") - F.coalesce(F.sum("__c").over(ahead("__w")), F.lit(0))))
    part = inside.select((F.col("__w") * taken).alias("__m")).agg(F.sum("__m").alias("__part"))
    full = groups.agg(F.sum(F.when(F.col("__room") == F.col("__gc"), F.col("__gm"))).alias("__full"), F.max("__t").alias("__t"))
    zero = F.lit(0)
    return full.crossJoin(F.broadcast(part)).select(ratio(F.coalesce("__full", zero) + F.coalesce("__part", zero), F.col("__t")).alias("top_share"))


def largest(df: DataFrame, weight: str, path: str) -> DataFrame:
    """One row: the largest weight and its path; of equals the smallest path."""
    return df.agg(F.max(weight).alias("largest"), F.expr(f"min_by({path}, struct(-{weight}, {path}))").alias("largest_path"))


def value_histogram_quantiles(df: DataFrame, column: str, ps: dict[str, float]) -> DataFrame:
    """Nearest-rank quantiles from value counts, for columns of few distinct values over many rows."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    total = counts.agg(F.sum("__c").alias("__n"))
    ranked = counts.withColumn("__r", F.sum("__c").over(Window.orderBy("__v"))).crossJoin(F.broadcast(total))
    return ranked.agg(*(F.min(F.when(F.col("__r") >= F.ceil(F.col("__n") * F.lit(p)), F.col("__v"))).alias(n) for n, p in ps.items()))
