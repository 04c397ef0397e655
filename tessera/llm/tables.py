"""Readers and small plan helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with at most this many rows of a few numbers may be broadcast; beyond it every operator shuffles instead.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are few enough, else as it is."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


def seeded(seed: int, *columns: Column) -> Column:
    """A hex digest that orders rows at random and alike in every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int = 7) -> DataFrame:
    """At most ``per_class`` labelled documents of each class, in the order of a seeded digest: doc_id, text, label.

    Labels without a document, null labels and null ids are left out; of repeated ids with different labels the smaller label counts.
    """
    lab = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("label")).where("__id is not null and label in (0, 1)")
    lab = lab.groupBy("__id").agg(F.min("label").alias("label"))
    lab = lab.join(docs.select(F.col("doc_id").alias("__id")), "__id", "left_semi").withColumn("__o", seeded(seed, F.col("__id")))
    picked = lab.where("label = 0").orderBy("__o", "__id").limit(per_class).union(lab.where("label = 1").orderBy("__o", "__id").limit(per_class))
    picked = small(picked.select("__id", "label"), 2 * per_class)
    return docs.select(F.col("doc_id"), F.col("text")).join(picked, F.col("doc_id") == F.col("__id")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")


def filtered(docs: DataFrame, mask) -> DataFrame:
    """The rows of ``docs``, all columns, for which ``mask(text column of an Arrow batch)`` (a function on the executors) is true."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(mask(batch.column(at)))

    return docs.mapInArrow(run, docs.schema)
