"""Benchmark decontamination by a prefix-filtered set join.

Items and documents are sets of word n-grams (case ignored). A first pass counts how often each item n-gram occurs in the documents, and each item's
n-grams are ordered from the rarest. A window that contains ``need = ceil(theta * size)`` of an item's n-grams holds at least ``least`` of its first
``size - need + least`` (``least`` is ``LEAST``, or ``need`` if that is smaller). Only occurrences of these prefixes are gathered by a second pass and joined with the items.
A pair goes on if it passes the length bound (the document has ``need`` n-grams) and the positional bound (``least`` occurrences of prefix tokens lie
within the length of the item). A third pass over the documents left gathers all their item n-grams, and every window of the item's length is checked exactly.

What is shuffled is counts, then occurrences of prefix tokens, then those of all item n-grams in the documents left. The item n-grams go to the executors
as a sorted array up to ``broadcast_rows`` of them, and beyond that all n-grams are joined by a shuffle, with equal results.

Defined cases: null or empty texts match nothing; items without an id are left out; an item of fewer than n words matches only a document of just
these words; items that repeat an id with other texts are matched each, the best window counts; documents that repeat an id likewise;
a null doc_id is reported as null; of equal windows the first is reported; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import textkit as tk
from tessera.llm.tables import BROADCAST_ROWS, small, table
from tessera.plans.checkpoints import cut

N, THETA, LEAST = 3, 0.6, 3
HITS = "doc_id long, sig long, doc_size int, pos int, h long"


def positions(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram hashes in text order, their documents, and word positions in them. Documents of fewer than n words have one of all words."""
    h, _, _, doc = tk.words(data, offs)
    count = np.bincount(doc, minlength=len(offs) - 1)
    first = np.concatenate([[0], np.cumsum(count)])
    g = tk.ngrams(h, n)
    whole = np.flatnonzero(doc[: len(g)] == doc[n - 1 : n - 1 + len(g)])
    g, owner, pos = g[whole], doc[whole], whole - first[doc[whole]]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.array([tk.ngrams(h[first[d] : first[d + 1]], int(count[d]))[0] for d in short], np.uint64)
        g, owner, pos = np.concatenate([g, extra]), np.concatenate([owner, short]), np.concatenate([pos, np.zeros(len(short), np.int64)])
    return g, owner, pos


class Wanted:
    """Membership in a sorted array of hashes."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, np.zeros(1 << 22, bool)
        self.bits[(keys >> np.uint64(42)).astype(np.int64)] = True

    def among(self, g: np.ndarray) -> np.ndarray:
        near = np.flatnonzero(self.bits[(g >> np.uint64(42)).astype(np.int64)])
        if not len(near) or not len(self.keys):
            return near[:0]
        at = np.minimum(np.searchsorted(self.keys, g[near]), len(self.keys) - 1)
        return near[self.keys[at] == g[near]]


def listed(keys: DataFrame) -> np.ndarray:
    return np.sort(np.array(keys.select("h").distinct().toArrow().column(0).to_numpy(), np.int64).view(np.uint64))


def occurrences(docs: DataFrame, n: int, wanted: np.ndarray | None) -> DataFrame:
    """(doc_id, sig, doc_size, pos, h) of the n-grams in ``wanted`` (sorted), or of all."""
    held = None if wanted is None else docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        keys = Wanted(held.value) if held else None
        for batch in batches:
            ids, sigs = batch.column(0).cast(pa.int64()), batch.column(1)
            for lo, hi, data, offs in tk.slices(batch.column(2)):
                g, owner, pos = positions(data, offs, n)
                sizes = np.bincount(owner, minlength=hi - lo)
                if keys is not None:
                    near = keys.among(g)
                    g, owner, pos = g[near], owner[near], pos[near]
                rows = pa.array(owner + lo)
                yield pa.RecordBatch.from_arrays([ids.take(rows), sigs.take(rows), pa.array(sizes[owner].astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(g.view(np.int64))], names=["doc_id", "sig", "doc_size", "pos", "h"])

    text = F.lower(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.xxhash64("text").alias("sig"), text.alias("text")).mapInArrow(run, HITS)


def rarity(docs: DataFrame, n: int, wanted: np.ndarray | None) -> DataFrame:
    """(h, df): how often each n-gram in ``wanted`` (sorted), or each at all, occurs in the documents."""
    held = None if wanted is None else docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        keys, total = (Wanted(held.value), np.zeros(len(held.value), np.int64)) if held else (None, None)
        for batch in batches:
            for _, _, data, offs in tk.slices(batch.column(0)):
                g, _, _ = positions(data, offs, n)
                if keys is not None:
                    total += np.bincount(np.searchsorted(keys.keys, g[keys.among(g)]), minlength=len(total))
                else:
                    u, c = np.unique(g, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], names=["h", "n"])
        if keys is not None:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(keys.keys[some].view(np.int64)), pa.array(total[some])], names=["h", "n"])

    return docs.select(F.lower(F.coalesce("text", F.lit(""))).alias("text")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("df"))


def ordered_items(docs: DataFrame, benchmark: DataFrame, n: int, theta: float, broadcast_rows: int) -> DataFrame:
    """item_id, item_sig, h, rank (by rarity), size, need, least and span (in n-grams) of all items."""
    bench = benchmark.where("item_id is not null").select(F.col("item_id").alias("doc_id"), "text")
    items = cut(occurrences(bench, n, None).select(F.col("doc_id").alias("item_id"), F.col("sig").alias("item_sig"), F.col("doc_size").alias("span"), "h").distinct())
    count = items.select("h").distinct().count()
    seen = rarity(docs, n, listed(items) if count <= broadcast_rows else None)
    item = Window.partitionBy("item_id", "item_sig")
    ordered = items.join(small(seen, count), "h", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    ordered = ordered.withColumn("size", F.count(F.lit(1)).over(item).cast("int")).withColumn("rank", F.row_number().over(item.orderBy("df", "h")))
    need = F.greatest(F.ceil(F.round(F.lit(theta) * F.col("size"), 9)).cast("int"), F.lit(1))
    return cut(ordered.withColumn("need", need).withColumn("least", F.least(need, F.lit(LEAST))))


def candidates(docs: DataFrame, ordered: DataFrame, n: int, broadcast_rows: int) -> DataFrame:
    """doc_id, sig, item_id, item_sig of every pair that shares a prefix token, and whether it passes the length bound (long) and the positional bound (close)."""
    prefix = cut(ordered.where(F.col("rank") <= F.col("size") - F.col("need") + F.col("least")).select("item_id", "item_sig", "h", "span", "need", "least"))
    rows = prefix.count()
    hits = occurrences(docs, n, listed(prefix) if rows <= broadcast_rows else None)
    pair = ["doc_id", "sig", "item_id", "item_sig"]
    met = hits.join(small(prefix, rows), "h").select(*pair, "pos", "h", "doc_size", "span", "need", "least").distinct()
    along = Window.partitionBy(*pair).orderBy("pos")
    back = F.when(F.col("least") == 1, F.col("pos"))
    for k in range(2, LEAST + 1):
        back = back.when(F.col("least") == k, F.lag("pos", k - 1).over(along))
    near = F.coalesce(F.col("pos") - back < F.col("span"), F.lit(False))
    return met.withColumn("near", near).groupBy(*pair).agg((F.first("doc_size") >= F.first("need")).alias("long"), F.max("near").alias("close"))


def best_window(pos: np.ndarray, h: np.ndarray, span: int) -> tuple[int, int]:
    """Most distinct hashes within ``span`` positions, and the first position of the first such window; ``pos`` is sorted."""
    lo = np.searchsorted(pos, pos - span + 1)
    if len(np.unique(h)) == len(h):
        count = np.arange(len(pos)) - lo + 1
        k = int(np.argmax(count))
        return int(count[k]), int(pos[lo[k]])
    held: dict[int, int] = {}
    best, where, begin = 0, 0, 0
    for k, x in enumerate(h.tolist()):
        held[x] = held.get(x, 0) + 1
        while begin < lo[k]:
            y = int(h[begin])
            held[y] -= 1
            if not held[y]:
                del held[y]
            begin += 1
        if len(held) > best:
            best, where = len(held), int(pos[begin])
    return best, where


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, theta: float = THETA, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, sig (xxhash64 of the text), item_id, containment, matched, item_size, window_start (in words) of every contaminated pair."""
    ordered = ordered_items(docs, benchmark, n, theta, broadcast_rows)
    total = ordered.count()
    pairs = cut(candidates(docs, ordered, n, broadcast_rows).where("long and close").select(F.col("doc_id").alias("__d"), F.col("sig").alias("__s"), F.col("item_id").alias("__i"), F.col("item_sig").alias("__t")))
    some = pairs.select("__d", "__s").distinct()
    left = docs.select("doc_id", "text").join(small(some, pairs.count()), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__s")), "left_semi")
    every = occurrences(left, n, listed(ordered) if total <= broadcast_rows else None).distinct().join(small(ordered.select("item_id", "item_sig", "h", "span", "size", "need"), total), "h")
    every = every.join(small(pairs), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("sig") == F.col("__s")) & (F.col("item_id") == F.col("__i")) & (F.col("item_sig") == F.col("__t")), "left_semi")

    def windows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        span, size, need = (int(pdf[c].iloc[0]) for c in ("span", "size", "need"))
        best, where = best_window(pdf["pos"].to_numpy(), pdf["h"].to_numpy(), span)
        if best < need:
            return pd.DataFrame({c: [] for c in ("doc_id", "sig", "item_id", "containment", "matched", "item_size", "window_start")})
        return pd.DataFrame({"doc_id": pd.array([pdf["doc_id"].iloc[0]], dtype="Int64"), "sig": [pdf["sig"].iloc[0]], "item_id": [pdf["item_id"].iloc[0]], "containment": [best / size], "matched": [best], "item_size": [size], "window_start": [where]})

    found = every.groupBy("doc_id", "sig", "item_id", "item_sig").applyInPandas(windows, "doc_id long, sig long, item_id long, containment double, matched int, item_size int, window_start int")
    best = F.max_by(F.struct("containment", "matched", "item_size", "window_start"), F.struct("containment", -F.col("window_start"), "item_size")).alias("b")
    return found.groupBy("doc_id", "sig", "item_id").agg(best).select("doc_id", "sig", "item_id", "b.*")


def clean(docs: DataFrame, benchmark: DataFrame, n: int = N, theta: float = THETA) -> DataFrame:
    """The documents without a benchmark item in them, with all their columns."""
    bad = cut(contaminated(docs, benchmark, n, theta).select(F.col("doc_id").alias("__d"), F.col("sig").alias("__s")).distinct())
    return docs.join(small(bad), docs["doc_id"].eqNullSafe(bad["__d"]) & (F.xxhash64(docs["text"]) == bad["__s"]), "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("sig")
