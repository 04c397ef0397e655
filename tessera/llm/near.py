"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

A document is its set of word n-grams (case ignored). Documents of equal sets are one vertex, named by a 64-bit digest of the set. Each of ``trees``
prefix tries holds all signatures of ``DEEPEST`` MinHash values. Matched prefixes are shortened from the deepest, until a pair at the threshold would be met in
some trie with the target recall, and further while the recall measured on ``PROBES`` sets falls short of it: what the probes meet in one half of the
tries and what they meet in the other tell how much both halves miss (capture and recapture), over the pairs that lie near the threshold.

All pairs of a prefix block, whatever its size, are linked if their whole signatures look similar enough (three standard errors below the threshold), and
linked sets form components. A large block is compared in cells of two sub-blocks, so no task holds more than those, but the work is the square
of the block. Within a component all pairs are checked exactly by their n-gram sets, in blocks, so each set moves once for a component that fits a block.

:func:`near_classes` has a row for each document: its class (the least doc_id of all that are similar, directly or by others) and its number of links,
that is, of similar documents, copies included. The pairs themselves are counted where they are found and never written. :func:`near_pairs` lists them
between one document of each set, and equal sets as stars.

Defined cases: documents without words have a class of their own and no links; so have null ids, whose class is null; texts of fewer than n words are one n-gram of all
of them; repeated rows are one document and one row; an id with several texts is one document, whose links are those of all its texts, among each other too;
in :func:`near_pairs` the highest similarity of a pair is reported and an id is never paired with itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import textkit as tk
from tessera.llm.graph import components, labels
from tessera.llm.tables import small, table
from tessera.plans.checkpoints import cut

N, THRESHOLD, TREES, DEEPEST, RECALL, SEED, BLOCK, PROBES = 3, 0.5, 24, 4, 0.95, 17, 2048, 1000
#: The pairs of a prefix block of at most so many documents are listed as rows; those of larger ones are compared in cells.
FEW = 32
SKETCH = "id long, v long, values binary"


def depth(threshold: float, trees: int, recall: float, deepest: int = DEEPEST) -> int:
    """The prefix length, shortened from the deepest, at which pairs at the threshold are met with the recall asked for."""
    x = deepest
    while x > 1 and 1 - (1 - threshold**x) ** trees < recall:
        x -= 1
    return x


def trie_keys(m: np.ndarray, x: int) -> np.ndarray:
    """Keys of the prefixes of length x in each trie, from rows of MinHash values."""
    by_tree = m.reshape(len(m), -1, DEEPEST).astype(np.uint64)
    key = np.broadcast_to(tk.mix(np.arange(1, by_tree.shape[1] + 1, dtype=np.uint64)), by_tree.shape[:2])
    for k in range(x):
        key = tk.mix(key * tk.STEP + by_tree[:, :, k])
    return key


def unpacked(column) -> np.ndarray:
    """Rows of MinHash values from a binary column of equally long values."""
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint32)
    return data.reshape(len(column), -1) if len(column) else data.reshape(0, DEEPEST)


def measured(sets: DataFrame, x: int, threshold: float, probes: int, seed: int) -> float:
    """Recall at prefix length x of pairs near the threshold, estimated from those that ``probes`` sets meet; 1 if they meet none."""
    chosen = sets.orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(probes).select("v", "values").toArrow()
    if not chosen.num_rows:
        return 1.0
    values = unpacked(chosen.column("values"))
    keys = trie_keys(values, x)
    half = np.broadcast_to(np.arange(keys.shape[1]) % 2, keys.shape)
    order = np.argsort(keys.reshape(-1))
    held = sets.sparkSession.sparkContext.broadcast((chosen.column("v").to_numpy(), (values & np.uint32(255)).astype(np.uint8), keys.reshape(-1)[order], (order // keys.shape[1]).astype(np.int64), half.reshape(-1)[order]))

    def run(batches):
        own, sigs, keys, owner, half = held.value
        met = np.zeros(3, np.int64)
        for batch in batches:
            v, m = batch.column(0).to_numpy(), unpacked(batch.column(1))
            for lo in range(0, len(m), 256):  # in a hot block a set meets every probe in every trie
                mine, sig = trie_keys(m[lo : lo + 256], x).reshape(-1), (m[lo : lo + 256] & np.uint32(255)).astype(np.uint8)
                i, j = np.searchsorted(keys, mine), np.searchsorted(keys, mine, "right")
                at = np.flatnonzero(j > i)
                size = (j - i)[at]
                entry = np.repeat(i[at], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                row = np.repeat(at // (len(mine) // len(sig)), size)
                pair, inverse = np.unique(row * len(own) + owner[entry], return_inverse=True)
                halves = np.zeros((len(pair), 2), bool)
                halves[inverse, half[entry]] = True
                r, p = pair // len(own), pair % len(own)
                same = ((sig[r] == sigs[p]).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
                use = halves[(same >= threshold) & (same < threshold + 0.1) & (v[lo + r] != own[p])]
                met += [use[:, 0].sum(), use[:, 1].sum(), use.all(axis=1).sum()]
        tk.release()
        yield pa.RecordBatch.from_arrays([pa.array([int(n)]) for n in met], names=["a", "b", "both"])

    a, b, both = sets.select("v", "values").mapInArrow(run, "a long, b long, both long").agg(F.sum("a"), F.sum("b"), F.sum("both")).first()
    return 1.0 if not (a and b) else (a + b - both) * both / (a * b)


def signatures(flat: np.ndarray, offs: np.ndarray, count: int, seed: int) -> np.ndarray:
    """``count`` MinHash values of each nonempty set."""
    rng = np.random.default_rng(seed)
    factors, shifts = rng.integers(0, 1 << 32, count, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, count, np.uint32)
    h = (flat >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(offs) - 1, count), np.uint32)
    for j in range(count):
        v = (h ^ shifts[j]) * factors[j]
        v ^= v >> np.uint32(15)
        out[:, j] = np.minimum.reduceat(v * np.uint32(0x85EBCA6B), offs[:-1])
    return out


def digests(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each nonempty set."""
    return tk.mix(np.add.reduceat(flat, at[:-1]) * tk.STEP + np.add.reduceat(tk.mix(flat), at[:-1]) + np.diff(at).astype(np.uint64)).view(np.int64)


def sketches(docs: DataFrame, n: int, trees: int, seed: int) -> DataFrame:
    """Digest and MinHash values of every document with words."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for lo, hi, data, offs in tk.slices(batch.column(1)):
                flat, at = tk.shingle_sets(data, offs, n)
                some = np.flatnonzero(np.diff(at))
                if len(some):
                    at = np.concatenate([at[some], at[-1:]])
                    m = signatures(flat, at, trees * DEEPEST, seed)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(some + lo)), pa.array(digests(flat, at)), pa.array([row.tobytes() for row in m], pa.binary())], names=["id", "v", "values"])

    return docs.where("doc_id is not null").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text")).mapInArrow(run, SKETCH)


def keyed(sets: DataFrame, x: int) -> DataFrame:
    """id (the digest), its trie keys at prefix length x, and a byte of each MinHash value."""

    def run(batches):
        for batch in batches:
            m = unpacked(batch.column(1))
            key = trie_keys(m, x)
            lists = np.arange(len(m) + 1, dtype=np.int32) * key.shape[1]
            sig = (m & np.uint32(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(lists), pa.array(key.reshape(-1).view(np.int64))), pa.array([row.tobytes() for row in sig], pa.binary())], names=["id", "keys", "sig"])

    return sets.select("v", "values").mapInArrow(run, "id long, keys array<long>, sig binary")


def alike(x: np.ndarray, y: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the rows of ``x``, then of ``y``, as do all pairs of them that agree enough: within ``x``, or between both."""
    width = x.shape[1]
    need = np.flatnonzero((np.arange(width + 1) / width - 1 / 256) / (1 - 1 / 256) >= least)
    need = need[0] if len(need) else width + 1
    n, shift = len(x) + (0 if y is None else len(y)), 0 if y is None else len(x)
    left, right = (np.ascontiguousarray(v.T) for v in (x, x if y is None else y))
    a = b = np.zeros(0, np.int64)
    for lo in range(0, len(x), 128):
        start = lo if y is None else 0
        agree = np.zeros((len(x[lo : lo + 128]), right.shape[1] - start), np.uint8 if width < 256 else np.uint16)
        for k in range(width):
            agree += left[k, lo : lo + 128, None] == right[None, k, start:]
        i, j = np.nonzero(agree >= need)
        root = labels(np.concatenate([a, i + lo]), np.concatenate([b, j + start + shift]), n)
        b = np.flatnonzero(root != np.arange(n))
        a = root[b]
    return a, b


def links(sets: DataFrame, least: float, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that span all pairs of one prefix block whose signatures agree enough."""
    rows = sets.select("id", F.explode("keys").alias("key"))
    rows = cut(rows.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("m > 1"))
    listed = rows.where(F.col("m") <= few).groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("__ids"))
    listed = listed.select(F.explode(F.expr("flatten(transform(__ids, (x, i) -> transform(slice(__ids, i + 2, size(__ids)), y -> struct(x as a, y as b))))")).alias("p"))
    pairs = listed.select("p.a", "p.b").where("a < b").distinct()
    left, right = (sets.select(F.col("id").alias(f"__{s}"), F.col("sig").alias(f"__sig_{s}")) for s in "ab")
    both = pairs.join(left, F.col("a") == F.col("__a")).join(right, F.col("b") == F.col("__b")).select("a", "b", "__sig_a", "__sig_b")

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3)) if batch.num_rows else (np.zeros((0, 1)),) * 2
            same = ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            keep = pa.array(same >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    signed = rows.where(F.col("m") > few).join(sets.select(F.col("id").alias("__id"), "sig"), F.col("id") == F.col("__id"))
    signed = signed.withColumn("nb", F.ceil(F.col("m") / block).cast("int")).withColumn("s", F.expr("cast(pmod(xxhash64(id), nb) as int)"))
    cells = signed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("key", "id", "s", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"), "sig")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        pdf = pdf.drop_duplicates(["id", "sig"]).sort_values(["s", "id"], kind="stable")
        ids, at = pdf["id"].to_numpy(), int((pdf["s"] == i).sum())
        sigs = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(ids), -1)
        a, b = alike(sigs, None, least) if i == j else alike(sigs[:at], sigs[at:], least)
        return pd.DataFrame({"a": np.minimum(ids[a], ids[b]), "b": np.maximum(ids[a], ids[b])})

    return both.mapInArrow(run, "a long, b long").union(cells.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long"))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence columns."""
    m = len(sets)
    if m == 2:
        out = np.zeros((2, 2))
        out[0, 1] = out[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return out
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out, width = np.zeros((m, m), np.float32), 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((m, int(column[j - 1]) - lo + 1), np.float32)
        part[owner[i:j], column[i:j] - lo] = 1
        out += part @ part.T
    return out


def verified(docs: DataFrame, members: DataFrame, n: int, threshold: float, pairs: bool, block: int) -> DataFrame:
    """Exact check within the components ``members`` (v, root, doc, copies). (a, b, jaccard, links): the similar pairs, or with ``pairs`` false pairs that
    span them, with links null, and in rows with a = b parts of the number of documents of other sets that are similar to a."""
    sizes = members.groupBy(F.col("root").alias("__r")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("__nb"))
    members = cut(members.join(sizes, F.col("root") == F.col("__r")).select(F.col("doc").alias("__doc"), "v", "root", "__nb", "copies"))
    rows = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text")).join(small(members), F.col("doc_id") == F.col("__doc"))
    rows = rows.withColumn("__b", F.expr("cast(pmod(xxhash64(v), __nb) as int)")).select("v", "text", "root", "__b", "__nb", "copies")

    def sets(batches):
        for batch in batches:
            for lo, hi, data, offs in tk.slices(batch.column(1)):
                flat, at = tk.shingle_sets(data, offs, n)
                some = np.flatnonzero(np.diff(at))
                if len(some):
                    own = digests(flat, np.concatenate([at[some], at[-1:]]))
                    some = some[own == batch.column(0).to_numpy()[some + lo]]  # an id may have other texts too
                take = pa.array(some + lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), *(batch.column(k).take(take) for k in (2, 3, 4, 5)), pa.array([flat[at[d] : at[d + 1]].tobytes() for d in some], pa.binary())], names=["v", "root", "b", "nb", "copies", "grams"])

    cells = rows.mapInArrow(sets, "v long, root long, b int, nb int, copies long, grams binary")
    cells = cells.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("v", "root", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "copies", "grams")

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("v").sort_values("v", kind="stable")
        ids, blocks, copies = pdf["v"].to_numpy(), pdf["b"].to_numpy(), pdf["copies"].to_numpy()
        grams = [np.frombuffer(g, np.uint64) for g in pdf["grams"]]
        size = np.array([len(g) for g in grams], float)
        if len(ids) < 2:
            return pd.DataFrame({"a": ids[:0], "b": ids[:0], "jaccard": size[:0], "links": ids[:0]})
        both = overlaps(grams).astype(float)
        similar = both / (size[:, None] + size[None, :] - both)
        a, b = np.nonzero(np.triu(similar >= threshold - 1e-12, 1))
        if pdf["i"].iloc[0] != pdf["j"].iloc[0]:
            cross = blocks[a] != blocks[b]
            a, b = a[cross], b[cross]
        if pairs:
            return pd.DataFrame({"a": ids[a], "b": ids[b], "jaccard": similar[a, b], "links": pd.array([None] * len(a), dtype="Int64")})
        links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
        some, root = np.flatnonzero(links), labels(a, b, len(ids))
        b = np.flatnonzero(root != np.arange(len(ids)))
        a = root[b]
        return pd.DataFrame({"a": np.concatenate([ids[a], ids[some]]), "b": np.concatenate([ids[b], ids[some]]), "jaccard": np.concatenate([similar[a, b], np.ones(len(some))]), "links": pd.array([*[None] * len(a), *links[some].astype(np.int64)], dtype="Int64")})

    return cells.groupBy("root", "i", "j").applyInPandas(check, "a long, b long, jaccard double, links long")


def joined(docs: DataFrame, pairs: bool, n: int = N, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, seed: int = SEED, block: int = BLOCK, few: int = FEW, probes: int = PROBES) -> tuple[DataFrame, DataFrame]:
    """The sets of each document (id, v), one row each, and what :func:`verified` finds between sets."""
    all_ = cut(sketches(docs, n, trees, seed))
    owned = cut(all_.select("id", "v").distinct())
    sets = cut(all_.groupBy("v").agg(F.first("values").alias("values")))
    x = depth(threshold, trees, recall)
    while x > 1 and measured(sets, x, threshold, probes, seed) < recall:
        x -= 1
    margin = 3 * math.sqrt(threshold * (1 - threshold) / (trees * DEEPEST))
    members = cut(components(links(cut(keyed(sets, x)), threshold - margin, few, 4 * block)))
    first = owned.groupBy(F.col("v").alias("__v")).agg(F.min("id").alias("doc"), F.count(F.lit(1)).alias("copies"))
    members = members.join(first, F.col("id") == F.col("__v")).select(F.col("id").alias("v"), "root", "doc", "copies")
    return owned, verified(docs, members, n, threshold, pairs, block)


def near_pairs(docs: DataFrame, **options) -> DataFrame:
    """doc_id_a, doc_id_b, jaccard of similar sets, each by its least doc_id, and of equal ones as a star."""
    owned, found = joined(docs, True, **options)
    first = cut(owned.groupBy(F.col("v").alias("__v")).agg(F.min("id").alias("doc")))
    a, b = (first.select(F.col("__v").alias(f"__{s}"), F.col("doc").alias(f"doc_{s}")) for s in "ab")
    unlike = found.join(a, F.col("a") == F.col("__a")).join(b, F.col("b") == F.col("__b")).select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b"), "jaccard")
    stars = owned.join(first, F.col("v") == F.col("__v")).select(F.col("doc").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard"))
    return unlike.union(stars).where("a < b").groupBy(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b")).agg(F.max("jaccard").alias("jaccard"))


def linked(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, n_links of every document with words."""
    owned, found = joined(docs, False, **options)
    found = cut(found)
    several = owned.groupBy(F.col("id").alias("__i")).agg(F.min("v").alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1")
    several = several.join(owned, F.col("__i") == F.col("id")).select("a", F.col("v").alias("b"))
    root = cut(components(found.where("links is null").select("a", "b").union(several)))
    links_of = found.where("links is not null").groupBy(F.col("a").alias("__v")).agg(F.sum("links").alias("links"))
    copies = owned.groupBy(F.col("v").alias("__w")).agg(F.count(F.lit(1)).alias("copies"))
    each = owned.join(root.withColumnRenamed("id", "__x"), F.col("v") == F.col("__x"), "left").join(links_of, F.col("v") == F.col("__v"), "left").join(copies, F.col("v") == F.col("__w"))
    each = cut(each.select("id", F.coalesce("root", "v").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    least = each.groupBy(F.col("root").alias("__r")).agg(F.min("id").alias("class_id"))
    return each.join(least, F.col("root") == F.col("__r")).groupBy(F.col("id").alias("doc_id")).agg(F.min("class_id").alias("class_id"), F.sum("links").alias("n_links"))


def near_classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, n_links of every document."""
    got = linked(docs, **options).withColumnRenamed("doc_id", "__id")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    every = every.where("doc_id is not null").distinct().union(every.where("doc_id is null"))
    return every.join(got, F.col("doc_id") == F.col("__id"), "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents, all columns, without all but the least doc_id of each class, and each repeated (doc_id, text) once. Null ids stay."""
    gone = cut(linked(docs, **options).where("doc_id != class_id").select(F.col("doc_id").alias("__gone")))
    again = cut(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("__again")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__again"))
    rest = docs.join(small(gone), docs["doc_id"] == gone["__gone"], "left_anti")
    twice = again.count()
    if not twice:
        return rest
    repeated = rest.join(small(again, twice), rest["doc_id"] == again["__again"], "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.join(small(again, twice), rest["doc_id"] == again["__again"], "left_anti").unionByName(repeated)


def op4_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
