"""Language-model scores by context-tree weighting over contexts that grow with the corpus.

A byte is eight binary decisions, each with a tree of its own over the preceding bytes. Every node holds the Krichevsky-Trofimov estimate of
the bits seen in its context, and the weighted probability of a node is the even mix of its own estimate and the product of its children's.
The tree is built from the counts of all (context, byte) pairs of the whole corpus; a byte's code length is that of its eight bits under the
mixture of all depths along its context path, and a document's score is its code length per byte.

The tree has no greatest depth. All contexts have ``FIRST`` bytes; from there on a context is extended by one byte more while it was seen at
least ``grow * sqrt(bytes of the corpus)`` times and at least one in ``share`` of its occurrences are preceded by another byte than the
commonest one. So contexts of one depth that are extended number at most ``sqrt(bytes) / grow`` (2.5 million for 100 TB), which bounds what is
collected and broadcast of them, and the second condition makes the depth grow as the logarithm of the corpus, whatever is copied in it.

Each depth is one pass that gathers counts in the executors and sums them by one shuffle; the tree is weighted by group-bys from the leaves up.
Documents are scored by lookup in a sorted array up to ``lookup_rows`` pairs, and beyond that by a join on the pairs of each document, with equal
results.

Defined cases: null or empty texts have null scores and add nothing; contexts at the start of a text are filled with zero bytes; bytes
are those of the UTF-8 text as it is; null ids and repeated rows give a row each and count each; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textkit as tk
from tessera.llm.tables import small, table
from tessera.plans.checkpoints import cut

FIRST, GROW, SHARE, LOOKUP_ROWS = 3, 4, 16, 8_000_000
SCHEMA = "doc_id long, n_bytes long, bits double, bits_per_byte double"


@dataclass
class Growth:
    """Which contexts are extended. ``links[k]``: the contexts of ``FIRST + k`` bytes seen often enough, sorted: at k = 0 their bytes as a number, beyond it
    256 times the number in ``links[k - 1]`` of the context without its first byte, plus that byte. ``kept[k]``: whether the second condition holds too."""

    links: list[np.ndarray] = field(default_factory=list)
    kept: list[np.ndarray] = field(default_factory=list)

    def tables(self) -> "Tables":
        return Tables([Numbers(link, (1 << 24) if k == 0 else len(self.links[k - 1]) << 8) for k, link in enumerate(self.links)], self.kept)


class Numbers:
    """1 + the number of a value in a sorted array, 0 if it is not there; by a table if that is small."""

    def __init__(self, link: np.ndarray, span: int):
        self.link, self.table = link.astype(np.int64), None
        if span <= 1 << 24:
            self.table = np.zeros(span, np.uint16 if len(link) < 65535 else np.uint32)
            self.table[self.link] = np.arange(1, len(link) + 1)

    def __call__(self, value: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[value]
        where = np.minimum(np.searchsorted(self.link, value), len(self.link) - 1)
        return np.where(self.link[where] == value, where + 1, 0)


@dataclass
class Tables:
    numbers: list[Numbers]
    kept: list[np.ndarray]

    def walk(self, w: np.ndarray, real: np.ndarray):
        """For each depth: the positions in ``w`` (padded bytes as 32-bit numbers) whose contexts come so far, and the numbers of those, before ``kept`` is asked."""
        value = np.zeros(len(w), np.uint32)
        value[3:] = w[2:-1] | w[1:-2] << np.uint32(8) | w[:-3] << np.uint32(16)
        at = None
        for k, numbers in enumerate(self.numbers):
            found = numbers(value)
            if at is None:
                at = np.flatnonzero(found * real)
                number = found[at].astype(np.int64) - 1
            else:
                hit = np.flatnonzero(found)
                at, number = at[hit], found[hit].astype(np.int64) - 1
            yield at, number
            if k < len(self.kept):
                on = self.kept[k][number]
                at, number = at[on], number[on]
            value = number << 8 | w[at - (FIRST + 1 + k)]


def padded(data: np.ndarray, offs: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents with ``depth`` zeros ahead of each, as 32-bit numbers, and which of them are bytes of documents."""
    docs = len(offs) - 1
    w, real = np.zeros(len(data) + docs * depth, np.uint32), np.ones(len(data) + docs * depth, bool)
    real[(offs[:-1] + np.arange(docs) * depth)[:, None] + np.arange(depth)] = False
    w[real] = data
    return w, real


def shortest(w: np.ndarray) -> np.ndarray:
    """Each byte and the ``FIRST`` before it, as one number."""
    out = w.copy()
    for back in range(1, FIRST + 1):
        out[back:] |= w[:-back] << np.uint32(8 * back)
    return out


def level_pairs(data: np.ndarray, offs: np.ndarray, tables: Tables) -> np.ndarray:
    """For each byte whose context comes as far as the last of ``growth.links``: that context, one byte more of it, and the byte, as one number."""
    k = len(tables.numbers)
    w, real = padded(data, offs, FIRST + k + 1)
    if not k:
        return shortest(w)[real]
    *_, (at, number) = tables.walk(w, real)
    pair = w[at - (FIRST + k)] << np.uint32(8) | w[at]
    if len(tables.numbers[-1].link) < 65536:
        return number.astype(np.uint32) << np.uint32(16) | pair
    return number.astype(np.uint64) << np.uint64(16) | pair


def pairs(data: np.ndarray, offs: np.ndarray, tables: Tables) -> np.ndarray:
    """For each byte, its longest context and itself as one number, with the depth beyond ``FIRST`` in the upper eight bits."""
    w, real = padded(data, offs, FIRST + len(tables.numbers) + 1)
    out = shortest(w).astype(np.uint64)
    for k, (at, number) in enumerate(tables.walk(w, real)):
        on = tables.kept[k][number]
        at, number = at[on], number[on]
        out[at] = np.uint64(k + 1 << 56) | number.astype(np.uint64) << np.uint64(16) | w[at - (FIRST + 1 + k)] << np.uint32(8) | w[at]
    return out[real]


class Lengths:
    """Code lengths by pair: hashes in order, with a directory of their upper bits. Every pair asked for is there."""

    def __init__(self, keys: np.ndarray, bits: np.ndarray):
        h = tk.mix(keys)
        order = np.argsort(h)
        self.h, self.bits = h[order], bits[order]
        self.shift = np.uint64(64 - max(1, int(2 * len(keys)).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount((self.h >> self.shift).astype(np.int64), minlength=1 << int(64 - self.shift)))]).astype(np.int32)

    def __call__(self, pair: np.ndarray) -> np.ndarray:
        h = tk.mix(pair)
        at = self.first[(h >> self.shift).astype(np.int64)]
        wrong = np.flatnonzero(self.h[at] != h)
        while len(wrong):
            at[wrong] += 1
            wrong = wrong[self.h[at[wrong]] != h[wrong]]
        return self.bits[at]


def counted(docs: DataFrame, growth: Growth) -> DataFrame:
    """key (see :func:`level_pairs`), n: over all documents."""
    held = docs.sparkSession.sparkContext.broadcast(growth)

    def run(batches):
        keys, counts, waiting = [], [], 0
        tables = held.value.tables()

        def merged():
            k, c = np.concatenate(keys), np.concatenate(counts)
            u, inverse = np.unique(k, return_inverse=True)
            return u, np.bincount(inverse, c, len(u)).astype(np.int64)

        for batch in batches:
            for _, _, data, offs in tk.slices(batch.column(0)):
                if len(data):
                    u, c = np.unique(level_pairs(data, offs, tables), return_counts=True)
                    keys.append(u.astype(np.uint64))
                    counts.append(c)
                    waiting += len(u)
                    if waiting > 1 << 22:
                        u, c = merged()
                        if len(u) > 1 << 21:
                            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], names=["key", "n"])
                            keys, counts, waiting = [], [], 0
                        else:
                            keys, counts, waiting = [u], [c], len(u)
        if keys:
            u, c = merged()
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], names=["key", "n"])

    got = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "key long, n long")
    return got.groupBy("key").agg(F.sum("n").alias("n"))


def grown(docs: DataFrame, grow: float = GROW, share: int = SHARE) -> tuple[Growth, list[DataFrame]]:
    """The contexts that are extended, and the counts of each depth from ``FIRST`` on."""
    growth = Growth()
    counts = [cut(counted(docs, growth))]
    total = counts[0].agg(F.sum("n")).first()[0] or 0
    least = max(1, math.ceil(grow * math.sqrt(total)))
    context = F.shiftright("key", 8).alias("p")
    seen = counts[0].groupBy(context).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    ready = np.sort(seen.select("p").toArrow().column(0).to_numpy())
    while len(ready):
        growth.links.append(ready)
        counts.append(cut(counted(docs, growth)))
        seen = cut(counts[-1].groupBy(context).agg(F.sum("n").alias("n")))
        above = seen.groupBy(F.shiftright("p", 8).alias("r")).agg(F.sum("n").alias("n"), F.max("n").alias("most"))
        above = above.where(F.col("n") - F.col("most") >= F.greatest(F.lit(least), F.col("n") / share)).select("r").toArrow().column(0).to_numpy()
        kept = np.zeros(len(ready), bool)
        kept[above] = True
        growth.kept.append(kept)
        ready = np.sort(seen.where(F.col("n") >= least).select("p").toArrow().column(0).to_numpy())
        ready = ready[kept[ready >> 8]]
    if growth.kept and not growth.kept[-1].any():
        growth.links.pop(), growth.kept.pop(), counts.pop()
    return growth, counts


def log_gamma(x: Column) -> Column:
    """Stirling's series after eight steps up; exact to 1e-12 from 0.5 on."""
    up = x + 8
    ladder = F.lit(0.0)
    for k in range(8):
        ladder = ladder + F.ln(x + k)
    return (up - 0.5) * F.ln(up) - up + 0.5 * math.log(2 * math.pi) + 1 / (12 * up) - 1 / (360 * up * up * up) + 1 / (1260 * up * up * up * up * up) - ladder


def estimate() -> Column:
    """Natural logarithm of the Krichevsky-Trofimov probability of n0 zeros and n1 ones in any order."""
    return log_gamma(F.col("n0") + 0.5) + log_gamma(F.col("n1") + 0.5) - math.log(math.pi) - log_gamma(F.col("n0") + F.col("n1") + 1.0)


def code_lengths(growth: Growth, counts: list[DataFrame]) -> DataFrame:
    """key (see :func:`pairs`), bits: the code length of each byte after each longest context that the corpus has."""
    spark = counts[0].sparkSession
    key, shift = F.col("key"), F.call_function
    byte = key.bitwiseAND(255).cast("int")
    step = lambda j: F.struct((shift("shiftleft", F.lit(1), j) + shift("shiftright", byte, 8 - j)).alias("node"), shift("shiftright", byte, 7 - j).bitwiseAND(1).alias("bit"))
    steps = F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), step))
    one = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)

    def parent(level: DataFrame, ctx: Column) -> DataFrame:
        """The nodes above ``level``, whose contexts are ``ctx`` of those of their children."""
        up = level.groupBy(ctx.alias("ctx"), "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("pw").alias("below")).withColumn("pe", estimate())
        top = F.greatest("pe", "below")
        up = up.withColumn("pw", F.lit(-math.log(2)) + top + F.log1p(F.exp(F.least("pe", "below") - top)))
        return up.withColumn("own", 1 / (1 + F.exp(F.least(F.lit(700.0), F.greatest(F.lit(-700.0), F.col("below") - F.col("pe")))))).drop("below")

    def inner(above: DataFrame, here: DataFrame, ctx: Column) -> DataFrame:
        """The probability so far (acc) and the weight left to longer contexts (rest) at ``here``, from those at its parents ``above``."""
        joined = here.join(above, (ctx == F.col("__c")) & (F.col("node") == F.col("__n")))
        return joined.select(F.col("ctx").alias("__c"), F.col("node").alias("__n"), (F.col("acc") + F.col("rest") * F.col("own") * one).alias("acc"), (F.col("rest") * (1 - F.col("own"))).alias("rest"))

    leaves: list[DataFrame] = []
    roots = None
    for k in range(len(counts) - 1, -1, -1):
        each = counts[k]
        if k:  # only contexts that were extended in the end
            on = spark.createDataFrame(pa.table({"__r": pa.array(np.flatnonzero(growth.kept[k - 1]))}))
            each = each.join(small(on, int(growth.kept[k - 1].sum())), F.shiftright("key", 16) == F.col("__r"), "left_semi")
        each = each.select("key", "n", F.shiftright("key", 8).alias("ctx"), steps.alias("s")).select("key", "n", "ctx", "s.node", "s.bit")
        level = each.groupBy("ctx", "node").agg(F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("n1"))
        level = level.withColumn("pe", estimate())
        if roots is None:
            level = level.withColumn("pw", F.col("pe")).withColumn("own", F.lit(1.0))
        else:
            level = level.join(roots, (F.col("ctx") == F.col("__rc")) & (F.col("node") == F.col("__rn")), "left")
            level = level.withColumn("pw", F.coalesce("__rpw", "pe")).withColumn("own", F.coalesce("__rown", F.lit(1.0))).drop("__rc", "__rn", "__rpw", "__rown")
        leaves.insert(0, cut(level))
        if k:
            link = spark.createDataFrame(pa.table({"__l": pa.array(np.arange(len(growth.links[k - 1]))), "__rc": pa.array(growth.links[k - 1])}))
            up = parent(leaves[0], F.shiftright("ctx", 8)).join(small(link, len(growth.links[k - 1])), F.col("ctx") == F.col("__l"))
            roots = cut(up.select("__rc", F.col("node").alias("__rn"), F.col("pw").alias("__rpw"), F.col("own").alias("__rown")))
    levels = [leaves[0]]
    for depth in range(FIRST - 1, -1, -1):
        levels.append(parent(levels[-1], F.col("ctx").bitwiseAND((1 << (8 * depth)) - 1)))
    above = levels[FIRST].select(F.col("ctx").alias("__c"), F.col("node").alias("__n"), (F.col("own") * one).alias("acc"), (1 - F.col("own")).alias("rest"))
    for depth in range(1, FIRST):
        above = inner(above, levels[FIRST - depth], F.col("ctx").bitwiseAND((1 << (8 * (depth - 1))) - 1))
    out = []
    for k, leaf in enumerate(leaves):
        above = cut(inner(above, leaf, F.col("ctx").bitwiseAND((1 << (8 * (FIRST - 1))) - 1) if k == 0 else F.shiftright("ctx", 8)))
        each = counts[k].select("key", F.shiftright("key", 8).alias("ctx"), steps.alias("s")).select("key", "ctx", "s.node", "s.bit")
        each = each.join(above, (F.col("ctx") == F.col("__c")) & (F.col("node") == F.col("__n")) & (F.col("rest") == 0))
        chance = F.when(F.col("bit") == 1, F.col("acc")).otherwise(1 - F.col("acc"))
        out.append(each.groupBy((F.col("key") + F.lit(k << 56 if k < 128 else (k << 56) - (1 << 64))).alias("key")).agg(F.sum(-F.log2(chance)).alias("bits")))
        if k < len(growth.links):
            on = np.flatnonzero(growth.kept[k])
            link = spark.createDataFrame(pa.table({"__l": pa.array(on), "__p": pa.array(growth.links[k][on])}))
            above = above.join(small(link, len(on)), F.col("__c") == F.col("__p")).select(F.col("__l").alias("__c"), "__n", "acc", "rest")
    return reduce(DataFrame.union, out)


def score(docs: DataFrame, growth: Growth, lengths: DataFrame, lookup_rows: int = LOOKUP_ROWS) -> DataFrame:
    """doc_id, n_bytes, bits and bits_per_byte of every document under ``lengths``."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if lengths.count() > lookup_rows:
        return _score_joined(texts, growth, lengths)
    got = lengths.toArrow()
    model = docs.sparkSession.sparkContext.broadcast((growth, got.column("key").to_numpy().view(np.uint64), got.column("bits").to_numpy()))

    def run(batches):
        growth, *known = model.value
        tables, lengths = growth.tables(), Lengths(*known) if len(known[0]) else None
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offs in tk.slices(batch.column(1)):
                each = lengths(pairs(data, offs, tables)) if len(data) else np.zeros(0)
                total, size = tk.spans(offs, each), np.diff(offs)
                void = size == 0
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).cast(pa.int64()), pa.array(size), pa.array(total, mask=void), pa.array(total / np.maximum(size, 1), mask=void)], names=["doc_id", "n_bytes", "bits", "bits_per_byte"])

    return texts.mapInArrow(run, SCHEMA)


def _score_joined(texts: DataFrame, growth: Growth, lengths: DataFrame) -> DataFrame:
    """As :func:`score`, by a join of each document's distinct pairs."""
    held = texts.sparkSession.sparkContext.broadcast(growth)

    def run(batches):
        tables = held.value.tables()
        for batch in batches:
            ids, sigs = batch.column(0).cast(pa.int64()), batch.column(1)
            for lo, hi, data, offs in tk.slices(batch.column(2)):
                size = np.diff(offs)
                owner, each = np.repeat(np.arange(hi - lo), size), pairs(data, offs, tables)
                order = np.lexsort((each, owner))
                owner, each = owner[order], each[order]
                first = np.flatnonzero(np.concatenate([[True], (each[1:] != each[:-1]) | (owner[1:] != owner[:-1])])) if len(each) else np.zeros(0, np.int64)
                void = np.flatnonzero(size == 0)
                row = np.concatenate([owner[first], void])
                key = np.concatenate([each[first].view(np.int64), np.full(len(void), -1)])
                n = np.concatenate([np.diff(np.concatenate([first, [len(each)]])), np.zeros(len(void), np.int64)])
                take = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([ids.take(take), sigs.take(take), pa.array(size[row]), pa.array(key), pa.array(n)], names=["doc_id", "sig", "n_bytes", "key", "n"])

    rows = texts.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("__times")).select("doc_id", F.xxhash64("text").alias("sig"), "text", "__times")
    times = rows.select(F.col("doc_id").alias("__d"), F.col("sig").alias("__s"), "__times")
    each = rows.select("doc_id", "sig", "text").mapInArrow(run, "doc_id long, sig long, n_bytes long, key long, n long")
    total = each.join(lengths, "key", "left").groupBy("doc_id", "sig", "n_bytes").agg(F.sum(F.col("n") * F.col("bits")).alias("bits"))
    total = total.join(times, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("sig") == F.col("__s")))
    total = total.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int"))))
    return total.select("doc_id", "n_bytes", "bits", F.try_divide("bits", F.nullif("n_bytes", F.lit(0))).alias("bits_per_byte"))


def context_tree_scores(docs: DataFrame, lookup_rows: int = LOOKUP_ROWS, grow: float = GROW, share: int = SHARE) -> DataFrame:
    growth, counts = grown(docs, grow, share)
    return score(docs, growth, cut(code_lengths(growth, counts)), lookup_rows)


def op5_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree_scores(table(spark, sf_dir, "documents"))
