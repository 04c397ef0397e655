"""Sum-of-squares online packing of documents into training windows.

Each packer holds an array of fill levels: how many open windows are filled up to each number of units. A piece goes where the sum of the
squared counts of partially filled windows grows least; ties go to the fullest window, and a new window is the level 0 choice. Among
windows of one level the one opened last is taken. Documents longer than a window fill whole windows first, and their rest is placed.

A packer works on a seeded random share of about ``docs_per_packer`` documents, so packers run side by side and each is small at any
scale; only ids and lengths are shuffled. Units are runs of visible characters, or whatever integer column is named.

Defined cases: null text counts as empty; a document of no units yields one row with zero units and no window; null ids are packed as
other rows are, spread over the packers by the rest of the row; repeated rows are packed each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.tables import seeded, table
from tessera.plans.checkpoints import cut

CAPACITY, DOCS_PER_PACKER, SEED = 2048, 20_000, 11
SCHEMA = "doc_id long, piece int, first_unit long, units long, packer int, window_no long, window_from long"


def place(lengths: np.ndarray, capacity: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """For lengths in arrival order: (row, piece, first unit, units, window, unit of the window it starts at)."""
    levels = np.zeros(capacity + 1, np.int64)  # levels[h]: open windows filled to h; 0 and capacity stay 0
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    opened = 0
    for row, length in enumerate(lengths.tolist()):
        piece = at = 0
        while length - at >= capacity:
            yield row, piece, at, capacity, opened, 0
            opened, piece, at = opened + 1, piece + 1, at + capacity
        size = length - at
        if not size:
            if not length:
                yield row, 0, 0, 0, -1, -1
            continue
        # growth of the sum of squares when a window of level h becomes one of level h + size
        reach = capacity - size
        gain = 2 * levels[size : capacity + 1] + 1
        gain[reach] = 0  # a full window counts no more
        gain[1:] += 1 - 2 * levels[1 : reach + 1]
        allowed = np.flatnonzero(levels[: reach + 1])
        best, score = 0, int(gain[0])
        if len(allowed):
            g = gain[allowed]
            low = int(g.min())
            if low <= score:
                best, score = int(allowed[np.flatnonzero(g == low)[-1]]), low
        if best:
            window = stacks[best].pop()
            levels[best] -= 1
        else:
            window, opened = opened, opened + 1
        yield row, piece, at, size, window, best
        if best + size < capacity:
            levels[best + size] += 1
            stacks[best + size].append(window)


def pack(docs: DataFrame, capacity: int = CAPACITY, docs_per_packer: int = DOCS_PER_PACKER, seed: int = SEED, units: str | None = None) -> DataFrame:
    """One row for each placed piece: doc_id, piece, first_unit, units, packer, window_no, window_from.

    Windows are numbered within their packer; (packer, window_no) names one. Null for documents of no units.
    """
    length = F.col(units).cast("long") if units else F.regexp_count(F.col("text"), F.lit(r"\S+")).cast("long")
    rows = docs.select("doc_id", F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).alias("__len"), F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64(*docs.columns), F.lit(1 << 32))).alias("__v"))
    rows = cut(rows)  # ids and lengths: the texts are read once
    packers = max(1, rows.count() // docs_per_packer)
    order = seeded(seed, F.col("doc_id"))
    rows = rows.withColumn("__o", order).withColumn("packer", (F.coalesce("__v", F.conv(F.substring("__o", 1, 8), 16, 10).cast("long")) % packers).cast("int")).drop("__v")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__o", "doc_id", "__len"], kind="stable").reset_index(drop=True)
        out = np.array(list(place(pdf["__len"].to_numpy(np.int64), capacity)), np.int64).reshape(-1, 6)
        void = out[:, 4] < 0
        got = pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64").to_numpy()[out[:, 0]], "piece": out[:, 1].astype(np.int32), "first_unit": out[:, 2], "units": out[:, 3], "packer": np.int32(pdf["packer"].iloc[0])})
        for name, k in (("window_no", 4), ("window_from", 5)):
            got[name] = pd.array(np.where(void, 0, out[:, k]), dtype="Int64")
            got.loc[void, name] = pd.NA
        got["doc_id"] = got["doc_id"].astype("Int64")
        return got

    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    void = rows.where("__len = 0").select("doc_id", F.lit(0).alias("piece"), zero.alias("first_unit"), zero.alias("units"), "packer", none.alias("window_no"), none.alias("window_from"))
    return rows.where("__len > 0").groupBy("packer").applyInPandas(one, SCHEMA).union(void)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
