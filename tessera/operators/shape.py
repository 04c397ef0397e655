"""Static shape of a snapshot (path, size)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import CATEGORIES, category, depth, top_level
from tessera.functions.scalars import ratio, ratio_or_zero
from tessera.operators import dist
from tessera.plans.checkpoints import cut


def classified(files: DataFrame) -> DataFrame:
    p = F.col("path")
    return files.select("path", F.col("size").cast("long").alias("size"), category(p).alias("category"), top_level(p).alias("component"), depth(p).alias("depth"))


def category_mix(files: DataFrame) -> DataFrame:
    """Files and bytes of all six categories, those that do not occur at 0."""
    spark = files.sparkSession
    dim = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    got = classified(files).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    zero = F.lit(0).cast("long")
    return dim.join(F.broadcast(got), "category", "left").select("category", F.coalesce("n", zero).alias("files"), F.coalesce("b", zero).alias("bytes"))


def top_level_mass(files: DataFrame) -> DataFrame:
    """Source bytes of each top-level component."""
    return component_mass(classified(files))


def component_mass(c: DataFrame) -> DataFrame:
    return c.where("category = 'source'").groupBy("component").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("files"))


def static_shape(files: DataFrame) -> DataFrame:
    """One row; ratios without a denominator are null, but the generated share is then 0."""
    c = cut(classified(files))
    source = c.where("category = 'source'")
    of = lambda k: F.coalesce(F.sum(F.when(F.col("category") == k, F.col("size"))), F.lit(0)).cast("long")
    totals = c.agg(F.count(F.lit(1)).alias("tracked_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("tracked_bytes"), F.max("depth").alias("max_path_depth"), *(of(k).alias(f"__{k}") for k in CATEGORIES))
    src = source.agg(
        *(F.expr(f"percentile_disc({p}) within group (order by size)").cast("long").alias(n) for n, p in (("source_file_size_median", 0.5), ("source_file_size_p90", 0.9))),
        F.max("size").alias("largest_source_file_bytes"),
        F.expr("min_by(path, struct(-size, path))").alias("largest_source_file_path"),
    )
    sizes = dist.entropy(source, "size").withColumnsRenamed({"normalized_entropy": "normalized_source_size_entropy", "effective_count": "effective_source_files"})
    tops = dist.entropy(component_mass(c), "bytes").withColumnsRenamed({"normalized_entropy": "normalized_top_level_source_entropy", "effective_count": "effective_top_level_components"})
    decile = dist.top_share(source, "size").withColumnRenamed("top_share", "top_decile_source_byte_share")
    out = totals
    for part in (src, sizes, tops, decile):
        out = out.crossJoin(F.broadcast(part))
    return out.select(
        "tracked_files", "tracked_bytes", "source_file_size_median", "source_file_size_p90", "largest_source_file_bytes", "largest_source_file_path",
        ratio(F.col("largest_source_file_bytes"), F.col("__source")).alias("largest_source_file_share"),
        "top_decile_source_byte_share", "normalized_source_size_entropy", "effective_source_files", "normalized_top_level_source_entropy", "effective_top_level_components",
        ratio(F.col("__test"), F.col("__source")).alias("test_to_source_bytes"),
        ratio(F.col("__documentation"), F.col("__source")).alias("documentation_to_source_bytes"),
        ratio_or_zero(F.col("__generated_or_vendor"), F.col("tracked_bytes")).alias("generated_or_vendor_byte_share"),
        "max_path_depth",
    )
