"""Proportional stratified interleaving of documents into shards.

Rows of each source are put into a seeded random order and ranked; ``(2 * rank - 1) / (2 * size)`` is a row's fractional rank in
its source. All rows sorted by it, cut into equal runs, give shards that each hold every source in proportion.

Ranks are found without a window over a whole source or table: rows fall into slots of the sort key, slot counts are prefix-summed, and
only the order within a slot needs a sort. A hot source is spread over as many slots as any other.

Defined cases: a null source is a stratum of its own; null ids are rows as any other and come first among equals; repeated rows
each get a place (equal rows are interchangeable); an empty table gives no rows; further columns are not read. Sources smaller than the
number of shards fall where their fractional ranks do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.tables import seeded, small, table
from tessera.plans.checkpoints import cut

SHARDS, SEED, SLOTS = 64, 20240229, 4096


def ranked(df: DataFrame, by: list[str], slot: Column, order: list[Column], name: str) -> DataFrame:
    """``df`` with column ``name``: the 1-based place of each row within its ``by`` group, ordered by slot and then ``order``, and the group's size in __size.

    ``df`` is evaluated once and cut."""
    df = cut(df.withColumn("__slot", slot))
    counts = df.groupBy(*by, "__slot").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(*(by or [F.lit(0)]))
    counts = cut(counts.select(*(F.col(b).alias(f"__k{i}") for i, b in enumerate(by)), F.col("__slot").alias("__ks"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(all_).alias("__size")))
    on = F.col("__slot").eqNullSafe(F.col("__ks"))
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"__k{i}"))
    within = Window.partitionBy(*by, "__slot").orderBy(*order)
    out = df.withColumn("__r", F.row_number().over(within)).join(small(counts), on)
    return out.withColumn(name, F.col("__before") + F.col("__r")).drop("__slot", "__r", "__before", "__ks", *(f"__k{i}" for i in range(len(by))))


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, slots: int = SLOTS) -> DataFrame:
    """doc_id, source, source_rank, source_size, fraction, position and shard (0 to shards-1) of every row."""
    rows = docs.select("doc_id", "source").withColumn("__h", seeded(seed, F.col("source"), F.col("doc_id")))
    key = F.conv(F.substring("__h", 1, 8), 16, 10).cast("long")
    rows = ranked(rows, ["source"], F.floor(key * slots / F.lit(1 << 32)).cast("int"), [F.col("__h"), F.col("doc_id").asc_nulls_first()], "source_rank")
    rows = rows.withColumnRenamed("__size", "source_size")
    rows = rows.withColumn("fraction", (2 * F.col("source_rank") - 1) / (2 * F.col("source_size")))
    rows = ranked(rows, [], F.floor(F.col("fraction") * slots).cast("int"), [F.col("fraction"), F.col("source").asc_nulls_first(), F.col("source_rank")], "position")
    shard = F.expr(f"((position - 1) * {shards}) div __size")
    return rows.select("doc_id", "source", F.col("source_rank").cast("long").alias("source_rank"), "source_size", "fraction", F.col("position").cast("long").alias("position"), shard.cast("int").alias("shard"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(table(spark, sf_dir, "documents"))


SQL = f"""
WITH h AS (SELECT doc_id, source, md5(concat_ws(':', '{SEED}', coalesce(source, ''), coalesce(CAST(doc_id AS VARCHAR), ''))) AS h FROM documents),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST) AS source_rank, count(*) OVER (PARTITION BY source) AS source_size FROM h),
f AS (SELECT *, CAST(2 * source_rank - 1 AS DOUBLE) / CAST(2 * source_size AS DOUBLE) AS fraction FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, source NULLS FIRST, source_rank) AS position, count(*) OVER () AS total FROM f)
SELECT doc_id, source, source_rank, source_size, fraction, position, CAST((position - 1) * {SHARDS} // total AS INTEGER) AS shard FROM p
"""
