"""Clone detection over token streams: the texts of files (file, language, text), split at white space.

Windows of k tokens are hashed in slices of a megabyte of text and grouped by 128 bits: a group-by, never a pairwise join, so a window that thousands of files
share costs as many rows. A first pass tells which may occur twice; windows that cannot are never written. Files of equal token streams are compared once. Maximal runs are found from the windows where runs begin,
whose places are made a tree by what follows them; no pair of places is formed but of those that overlap in one file. Positions count tokens from 1; ranges are half open.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from hashlib import md5
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import tokens as tok
from tessera.plans.checkpoints import cut, parts

GRAM = ["language", "h1", "h2"]


class Shared:
    """Which windows may occur more than once, told by a bit for the hash of a part of each (:meth:`Tokens.minimizers`). All that do are among them; ``places`` estimates how many."""

    def __init__(self, bits: Broadcast | None, width: int, places: int):
        self.bits, self.width, self.places = bits, width, places

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.zeros(len(hashes), bool)
        bit = hashes >> np.uint64(64 - self.width)
        return (np.frombuffer(self.bits.value, np.uint8)[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


#: Bits of the broadcast map: 32 for each hash, up to 32 MB; beyond, more windows pass that occur once, which costs time only.
LEAST_BITS, MOST_BITS = 15, 28


def shared(docs: DataFrame, k: int) -> Shared:
    """The windows of k tokens that may occur more than once, from one row for each dozen windows."""

    def run(batches):
        for batch in batches:
            for _, _, data, offs in tok.slices(batch.column(0)):
                _, place, low = tok.Tokens(data, offs).minimizers(k)
                new = np.ones(len(place), bool)
                new[1:] = place[1:] != place[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(low[new].view(np.int64))], names=["h"])

    h = docs.select("text").mapInArrow(run, "h long")
    twice = cut(h.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    n, places = twice.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n:
        return Shared(None, 0, 0)
    width = min(MOST_BITS, max(LEAST_BITS, (32 * n - 1).bit_length()))
    # bitmap functions count from 1, in buckets of 4 KB
    bit = twice.select((F.shiftrightunsigned("h", 64 - width) + 1).alias("b")).select(F.bitmap_bucket_number("b").alias("bucket"), F.bitmap_bit_position("b").alias("at"))
    out = bytearray((1 << width) // 8)
    for r in bit.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("map")).toLocalIterator():
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = r.map
    return Shared(docs.sparkSession.sparkContext.broadcast(bytes(out)), width, places * (k // 4 + 1))


def gathered(rows: DataFrame, expected: int, *by: str) -> DataFrame:
    """Rows of equal ``by`` in one partition, as many partitions as the rows need."""
    return rows.repartition(parts(rows.sparkSession, expected), *by)


def kgrams(docs: DataFrame, k: int, some: Shared | None = None) -> DataFrame:
    """(file, language, pos, h1, h2, before, after, line) of each window of k tokens, hashes of the tokens around it (null at an end), and the lines where it begins
    and where its last token does; of those in ``some`` only, if given."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in tok.slices(batch.column(2)):
                t = tok.Tokens(data, offs)
                if some is None:
                    at = t.windows_at(k)
                else:
                    at, _, low = t.minimizers(k)
                    at = at[some(low)]
                h1, h2 = (tok.ranges(h, at, at + k, w) for w, h in enumerate(t.hashes))
                doc = t.doc[at]
                rows, n = pa.array(doc + lo), len(t.doc)
                before, after = at - 1, at + k
                begins, ends = at == t.first[doc], after == t.first[doc + 1]
                around = [pa.array(t.hashes[0][np.clip(x, 0, max(n - 1, 0))].view(np.int64), mask=m) for x, m in ((before, begins), (after, ends))] if n else [pa.array([], pa.int64())] * 2
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at - t.first[doc] + 1), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), *around, pa.array(t.line[at]), pa.array(t.line[at + k - 1])],
                    names=["file", "language", "pos", "h1", "h2", "before", "after", "line", "last"],
                )

    kind = docs.schema["file"].dataType.simpleString()
    return docs.select("file", "language", "text").mapInArrow(run, f"file {kind}, language string, pos long, h1 long, h2 long, before long, after long, line long, last long")


def digests(docs: DataFrame, k: int, some: Shared) -> DataFrame:
    """(file, language, digest, pos, n) of the windows in ``some``, the copies in one text as one row: the MD5 of the joined tokens, the first place and how many."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in tok.slices(batch.column(2)):
                t = tok.Tokens(data, offs)
                at, _, low = t.minimizers(k)
                at = at[some(low)]
                rows, keys, pos, counts = [], [], [], []
                for d in np.unique(t.doc[at]):
                    words = data[offs[d] : offs[d + 1]].tobytes().split()
                    joined = b" ".join(words)
                    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                    i = at[t.doc[at] == d] - t.first[d]
                    found: dict[bytes, list[int]] = {}
                    for p, a, b in zip(i.tolist(), np.concatenate([[0], ends])[i].tolist(), (ends[i + k - 1] - 1).tolist()):
                        seen = found.setdefault(md5(joined[a:b]).digest(), [p + 1, 0])
                        seen[1] += 1
                    rows += [int(d) + lo] * len(found)
                    keys += found
                    pos += [x for x, _ in found.values()]
                    counts += [x for _, x in found.values()]
                rows = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(keys, pa.binary()), pa.array(pos, pa.int64()), pa.array(counts, pa.int64())], names=["file", "language", "digest", "pos", "n"])

    kind = docs.schema["file"].dataType.simpleString()
    return docs.select("file", "language", "text").mapInArrow(run, f"file {kind}, language string, digest binary, pos long, n long")


def split_tokens(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+")


def repeated(docs: DataFrame, k: int) -> DataFrame:
    """Windows that occur more than once in a language: language, digest (of the joined tokens), occurrences, files, first_file, first_pos."""
    some = shared(docs, k)
    by = gathered(digests(docs, k, some), some.places, "language", "digest")
    per_file = by.groupBy("language", "digest", "file").agg(F.sum("n").alias("n"), F.min("pos").alias("pos"))
    g = per_file.groupBy("language", "digest").agg(F.sum("n").alias("occurrences"), F.count("file").alias("files"), F.min(F.struct("file", "pos")).alias("f")).where("occurrences > 1")
    return g.select("language", F.lower(F.hex("digest")).alias("digest"), "occurrences", "files", F.col("f.file").alias("first_file"), F.col("f.pos").alias("first_pos"))


def cloned_windows(docs: DataFrame, k: int) -> DataFrame:
    """(file, pos, stop) of all occurrences of the windows that occur more than once, those of a file in one partition."""
    some = shared(docs, k)
    by = gathered(kgrams(docs, k, some).select("file", "pos", *GRAM), some.places, *GRAM)
    many = by.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*GRAM))).where("__n > 1")
    return gathered(many.select("file", "pos", (F.col("pos") + k).alias("stop")), some.places, "file")


def islands(ranges: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """Unions of half-open ranges within each ``by``; ranges that touch merge."""
    w = Window.partitionBy(by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("__new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    numbered = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(by, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def union_mass(ranges: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """Total length of the unions, for each ``by``."""
    return islands(ranges, by, start, end).groupBy(by).agg(F.sum(F.col(end) - F.col(start)).cast("long").alias("mass"), F.count(F.lit(1)).alias("islands"))


def diagonals(grams: DataFrame, k: int) -> DataFrame:
    """Maximal runs of at least k equal tokens between any two places, as (language, left_file, right_file, shift, left_start, right_start, tokens), not yet cut
    where both ends are in one file and overlap.

    All pairs of occurrences count, left before right by (file, pos). A pair of equal windows begins a run if the tokens before them differ, or one
    has none, and ends it if those after them do; windows with the same tokens around all their occurrences are not joined.
    """
    differ = lambda c: (F.min(c) != F.max(c)) | (F.count(c) < F.count(F.lit(1)))
    edges = grams.groupBy(*GRAM).agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(differ(c), F.lit(True)).alias(f"__{c}") for c in ("before", "after")))
    g = cut(grams.join(edges.where("n > 1 and (__before or __after)"), GRAM))

    def ends(side: str) -> DataFrame:
        some = g.where(f"__{side}").select(*GRAM, "file", "pos", F.col(side).alias("t"))
        x, y = some.alias("x"), some.alias("y")
        earlier = F.struct("x.file", "x.pos") < F.struct("y.file", "y.pos")
        same = (F.col("x.language") == F.col("y.language")) & (F.col("x.h1") == F.col("y.h1")) & (F.col("x.h2") == F.col("y.h2"))
        j = x.join(y, same & earlier & F.coalesce(F.col("x.t") != F.col("y.t"), F.lit(True)))
        return j.select("x.language", F.col("x.file").alias("left_file"), F.col("y.file").alias("right_file"), (F.col("y.pos") - F.col("x.pos")).alias("shift"), F.col("x.pos").alias("left_start"), F.lit(side).alias("side"))

    both = ends("before").union(ends("after"))
    w = Window.partitionBy("language", "left_file", "right_file", "shift").orderBy("left_start", F.col("side").desc())
    runs = both.withColumn("__last", F.lead("left_start").over(w)).where("side = 'before'")
    return runs.select("language", "left_file", "right_file", "shift", "left_start", (F.col("left_start") + F.col("shift")).alias("right_start"), (F.col("__last") - F.col("left_start") + k).alias("tokens"))


def repeated_windows(grams: DataFrame) -> DataFrame:
    """The windows that occur more than once and lie at an end of a run: with ``key``, which names a window of a language, ``begins`` if the tokens before its places
    differ and ``ends`` if those after them do."""
    differ = lambda c: F.coalesce((F.min(c) != F.max(c)) | (F.count(c) < F.count(F.lit(1))), F.lit(True))
    edges = grams.groupBy(*GRAM).agg(F.count(F.lit(1)).alias("n"), differ("before").alias("begins"), differ("after").alias("ends")).where("n > 1 and (begins or ends)")
    key = F.struct(F.col("h1").bitwiseXOR(F.xxhash64("language")).alias("h1"), "h2")
    return grams.join(edges.drop("n"), GRAM).select("file", key.alias("key"), "pos", "before", "after", "line", "last", "begins", "ends")


def with_chain(rows: DataFrame, chains: DataFrame) -> DataFrame:
    """One row for each file: ``rows`` as a list, and the chain of the file: its windows that end runs."""
    return rows.groupBy("file").agg(F.collect_list(F.struct(*(c for c in rows.columns if c != "file"))).alias("rows")).join(chains, "file").select("file", "rows", "chain")


class Chains:
    """The rows and chains of some files, flat. Between two windows of a chain the text is determined by the first and the token after it, so places of equal windows have as
    many equal tokens as they have equal tokens in the chain from there on."""

    def __init__(self, batch: pa.RecordBatch):
        rows, chain = batch.column(1), batch.column(2)
        self.file = np.repeat(np.arange(batch.num_rows), rows.value_lengths().to_numpy())
        self.rows, flat = rows.flatten(), chain.flatten()
        self.base = np.concatenate([[0], np.cumsum(chain.value_lengths().to_numpy())])
        self.pos, self.last = (flat.field(c).to_numpy() for c in ("pos", "last"))
        after = flat.field("after")
        self.open = np.concatenate([[0], np.cumsum(after.is_null().to_numpy(zero_copy_only=False))])
        self.after = after.fill_null(0).to_numpy().view(np.uint64)
        # a null, after the last window of a file, equals nothing
        self.size = np.diff(self.base) - np.diff(self.open[self.base])

    def of(self, column: str) -> np.ndarray:
        return self.rows.field(column).to_numpy()

    def seek(self, column: np.ndarray, file: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The first window of each file's chain with at least that value in an ascending column."""
        width = int(max(column.max(initial=0), value.max(initial=0))) + 1
        owner = np.repeat(np.arange(len(self.size)), np.diff(self.base))
        return np.searchsorted(owner * width + column, file * width + np.maximum(value, 0))

    def hashes(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        return tok.ranges(self.after, begin, begin + size, 0)


def flat_parts(batch: pa.RecordBatch, most: int = 100_000):
    """Runs of rows of a batch with about so many entries in their lists."""
    size = np.cumsum(batch.column(1).value_lengths().to_numpy().astype(np.int64) + batch.column(2).value_lengths().to_numpy())
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, "right")))
        # lists of a slice still refer to the whole, so they are copied
        yield batch.take(pa.array(np.arange(lo, hi)))
        lo = hi


def periods(c: Chains, key: np.ndarray, pos: np.ndarray, at: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places of one window in one file whose runs overlap: (left, right, equal tokens of the chain). ``key`` numbers windows of a file, ``before`` the tokens before them."""
    order = np.lexsort((pos, key))
    key, begin, left = key[order], at[order], before[order]
    pos, limit = pos[order], (c.base[:-1] + c.size)[c.file[order]]
    out, n = [], len(order)
    # a place with the same token before it as all later ones begins no run with them
    change = np.flatnonzero((key[1:] == key[:-1]) & (left[1:] != left[:-1]))
    final = np.full(int(key.max(initial=-1)) + 1, -1)
    np.maximum.at(final, key[change], change)
    live, step = np.flatnonzero(np.arange(n) <= final[key]), 1
    while len(live := live[live + step < n]) and len(live := live[key[live + step] == key[live]]):
        x, y = live, live + step
        some = left[x] != left[y]
        x, y = x[some], y[some]
        size = np.maximum(c.seek(c.pos, c.file[order[x]], pos[y] + 1 - k) - begin[x], 0)
        some = begin[y] + size <= limit[y]
        x, y, size = x[some], y[some], size[some]
        some = c.hashes(begin[x], size) == c.hashes(begin[y], size)
        x, y = x[some], y[some]
        if len(x):
            low, high = size[some], limit[y] - begin[y]
            while (low < high).any():
                middle = (low + high + 1) // 2
                same = c.hashes(begin[x], middle) == c.hashes(begin[y], middle)
                low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
            out.append((order[x], order[y], low))
        step += 1
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def places_of(rows: DataFrame, k: int, min_lines: int) -> DataFrame:
    """Places where runs begin, from :func:`with_chain`: ``at`` in the chain of the file, the token before, ``low``, how many tokens of the chain make it ``min_lines`` high,
    ``bars``, lengths in the chain of runs that overlap themselves, one for each, and ``cuts``, what remains of those that begin here."""
    kind = rows.schema["file"].dataType.simpleString()
    lists = "bars array<long>, cuts array<struct<mate: long, tokens: long>>"

    def run(batches):
        for whole_batch in batches:
            for batch in flat_parts(whole_batch):
                c = Chains(batch)
                key, pos, n = c.rows.field("key"), c.of("pos"), len(c.file)
                at = c.seek(c.pos, c.file, pos)
                low = np.maximum(c.seek(c.last, c.file, c.of("line") + min_lines - 1) - at, 0)
                h = tok.mix(key.field("h1").to_numpy().view(np.uint64)) ^ key.field("h2").to_numpy().view(np.uint64)
                group = np.unique(np.stack([c.file.astype(np.uint64), h], 1), axis=0, return_inverse=True)[1].reshape(-1)
                before = c.rows.field("before")
                token = np.unique(before.fill_null(0).to_numpy(), return_inverse=True)[1]
                token = np.where(before.is_null().to_numpy(zero_copy_only=False), n + np.arange(n), token)
                x, y, size = periods(c, group, pos, at, token, k)
                bars, cuts = [[] for _ in range(n)], [[] for _ in range(n)]
                single = c.of("copies") == 1
                for i, j, m in zip(x.tolist(), y.tolist(), size.tolist()):
                    shift = int(pos[j] - pos[i])
                    if single[i]:
                        bars[i] += [m] * int(low[j] <= m)
                        bars[j] += [m] * int(low[i] <= m)
                    if shift >= k:
                        cuts[i].append({"mate": int(pos[j]), "tokens": shift})
                files = batch.column(0).take(pa.array(c.file))
                types = [pa.list_(pa.int64()), pa.list_(pa.struct([("mate", pa.int64()), ("tokens", pa.int64())]))]
                yield pa.RecordBatch.from_arrays(
                    [files, key.field("h1"), key.field("h2"), pa.array(pos), pa.array(at - c.base[c.file]), before, pa.array(low), pa.array(bars, types[0]), pa.array(cuts, types[1])],
                    names=["file", "h1", "h2", "pos", "at", "before", "low", "bars", "cuts"],
                )

    return rows.mapInArrow(run, f"file {kind}, h1 long, h2 long, pos long, at long, before long, low long, {lists}")


#: Bits of a run's length told in each round of :func:`members`.
BITS = 4
NODE = "node long, child long, depth long"


def whole_keys(batches):
    """Batches of rows sorted by (h1, h2), joined so that no key is divided."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
        if held and batch.num_rows and (h1[0], h2[0]) != tuple(held[-1].column(c)[-1].as_py() for c in ("h1", "h2")):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        change = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
        if len(change):
            yield pa.Table.from_batches([*held, batch.slice(0, change[-1])]).combine_chunks()
            batch, held = batch.slice(change[-1]), []
        if batch.num_rows:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def numbered(t: pa.Table) -> np.ndarray:
    h1, h2 = (t.column(c).to_numpy() for c in ("h1", "h2"))
    return np.concatenate([[0], np.cumsum((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))]) if len(h1) else np.zeros(0, np.int64)


def split(key: np.ndarray, node: np.ndarray, child: np.ndarray, depth: np.ndarray, hashes: np.ndarray, offs: np.ndarray, shift: int):
    """A round of the search for the tree of the places of each key: (row, node, child, depth) of its entries.

    The entries of a node have ``depth`` equal tokens in their chains. Those that have more in common become a node of their own, and one of them stays for it,
    with the node as its ``child``; so there are fewer than two entries for each place. Lengths are told bit by bit: entries of a node differ within twice the step.
    """
    row, x, size = np.arange(len(key)), np.zeros(len(key), np.int64), np.diff(offs)
    top = np.zeros(int(key.max(initial=-1)) + 1, np.int64)
    np.maximum.at(top, key, node)
    for step in (1 << b for b in reversed(range(BITS))):
        some = np.flatnonzero(x + step <= size[row])
        h = hashes[offs[row[some]] + x[some] + step - 1]
        order = np.lexsort((h, node[some], key[row[some]]))
        some, h = some[order], h[order]
        if not len(some):
            continue
        new = np.ones(len(some), bool)
        new[1:] = (h[1:] != h[:-1]) | (node[some][1:] != node[some][:-1]) | (key[row[some]][1:] != key[row[some]][:-1])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(some)))
        _, of, total = np.unique(np.stack([key[row], node], 1), axis=0, return_inverse=True, return_counts=True)
        all_of = total[of.reshape(-1)][some[begin]]
        run = np.repeat(np.arange(len(begin)), count)
        fresh = (count > 1) & (count < all_of)
        first = some[begin[fresh]]
        owner = key[row[first]]
        # keys are ascending, so new nodes are numbered within each
        name = top[owner] + 1 + np.arange(len(owner)) - np.searchsorted(owner, owner)
        np.maximum.at(top, owner, name)
        stay = row[first], node[first], name, x[first], depth[first]
        names = np.zeros(len(begin), np.int64)
        names[fresh] = name
        moved = some[fresh[run]]
        node[moved] = names[run][fresh[run]]
        x[some[(count > 1)[run]]] += step
        row, node, child, x, depth = (np.concatenate(v) for v in zip((row, node, child, x, depth), stay))
    return row, node, child, depth + (x << shift)


def tree_members(key: np.ndarray, node: np.ndarray, child: np.ndarray, depth: np.ndarray, token: np.ndarray, low: np.ndarray, bars: list) -> tuple[np.ndarray, np.ndarray]:
    """(entry, depth) of the places that are an end of a run of that many tokens of the chain: another place under the same node lies under another entry and has another token before it.

    Places lie in the order of the tree, so a node is a range of them. Work is for each entry and each result.
    """
    ids, of = np.unique(np.stack([key, node], 1), axis=0, return_inverse=True)
    of = of.reshape(-1)
    below = np.full(len(key), -1)
    inner = np.flatnonzero(child >= 0)
    # a node as one number, to look children up
    width = int(max(node.max(initial=0), child.max(initial=0))) + 1
    below[inner] = np.searchsorted(ids[:, 0] * width + ids[:, 1], key[inner] * width + child[inner])
    order = np.argsort(of, kind="stable")
    begin = np.searchsorted(of[order], np.arange(len(ids) + 1)).tolist()
    deep = np.zeros(len(ids), np.int64)
    deep[of] = depth
    entries, down, t = order.tolist(), below.tolist(), deep.tolist()
    size, start = [0] * len(ids), [0] * len(ids)
    for v in np.argsort(-deep, kind="stable").tolist():
        size[v] = sum(1 if down[e] < 0 else size[down[e]] for e in entries[begin[v] : begin[v + 1]])
    leaf, end, base = [0] * (len(key) - len(inner)), {}, 0
    roots = np.ones(len(ids), bool)
    roots[below[inner]] = False
    for v in np.flatnonzero(roots).tolist():
        start[v] = base
        base += size[v]
    spans: list[list[int]] = [[] for _ in ids]
    for v in np.argsort(deep, kind="stable").tolist():
        at = start[v]
        for e in entries[begin[v] : begin[v + 1]]:
            spans[v].append(at)
            if down[e] < 0:
                leaf[at] = e
                at += 1
            else:
                start[down[e]] = at
                at += size[down[e]]
        spans[v].append(at)
    leaf = np.array(leaf, np.int64)
    word, n = token[leaf], len(leaf)
    cuts = np.append(np.flatnonzero(word[1:] != word[:-1]) + 1, n)
    after = cuts[np.searchsorted(cuts, np.arange(n), "right")].tolist() if n else []
    w, high = word.tolist(), low[leaf]
    tall = not high.any()
    barred: dict[int, list[int]] = {}
    for i in np.flatnonzero([bool(bars[e]) for e in leaf.tolist()]).tolist():
        for m in bars[leaf[i]]:
            barred.setdefault(m, []).append(i)

    def others(a: int, b: int, x: int):
        while a < b:
            if w[a] == x:
                a = after[a]
            else:
                yield a
                a += 1

    lows, highs, depths, single, single_depth, gone = [], [], [], [], [], set()
    for v, s in enumerate(spans):
        a, b = s[0], s[-1]
        if after[a] >= b:
            continue
        if not tall and (high[a:b] > t[v]).any():
            here = np.flatnonzero(high[a:b] <= t[v]) + a
            part = np.searchsorted(s, here, "right")
            counts = lambda *c: (lambda u: u[2][u[1].reshape(-1)])(np.unique(np.stack(c, 1), axis=0, return_inverse=True, return_counts=True))
            if len(here):
                free = len(here) - counts(part) - counts(word[here]) + counts(part, word[here])
                free -= np.array([bars[leaf[i]].count(t[v]) for i in here.tolist()])
                single += here[free > 0].tolist()
                single_depth += [t[v]] * int((free > 0).sum())
            continue
        for c, d in zip(s, s[1:]):
            # the token before all places outside this entry, if they have but one
            if c > a and (after[a] < c or d < b and w[a] != w[d]) or d < b and after[d] < b:
                lows.append(c)
                highs.append(d)
                depths.append(t[v])
            else:
                x = list(others(c, d, w[a] if c > a else w[d]))
                single += x
                single_depth += [t[v]] * len(x)
        if t[v] in barred:
            at = barred[t[v]]
            for i in set(at[bisect_left(at, a) : bisect_left(at, b)]):
                j = bisect_right(s, i)
                c, d = s[j - 1], s[j]
                if sum(1 for _ in islice(chain(others(a, c, w[i]), others(d, b, w[i])), bars[leaf[i]].count(t[v]) + 1)) <= bars[leaf[i]].count(t[v]):
                    gone.add((i, t[v]))
    width = np.array(highs, np.int64) - np.array(lows, np.int64)
    at = np.repeat(np.array(lows, np.int64) - np.cumsum(width) + width, width) + np.arange(int(width.sum()))
    at = np.concatenate([at, np.array(single, np.int64)])
    t = np.concatenate([np.repeat(np.array(depths, np.int64), width), np.array(single_depth, np.int64)])
    if gone:
        stays = np.array([x not in gone for x in zip(at.tolist(), t.tolist())], bool)
        at, t = at[stays], t[stays]
    return leaf[at], t


def members(places: DataFrame, chains: DataFrame, k: int) -> DataFrame:
    """(rep, start, tokens) of each place that is an end of a maximal run of some pair, cut nowhere. No pair is formed: the places of a window that begins runs are
    made a tree by what follows them, in rounds that tell some bits of a length each."""
    kind = places.schema["file"].dataType.simpleString()
    state = places.drop("cuts").withColumns({"node": F.lit(0).cast("long"), "child": F.lit(-1).cast("long"), "depth": F.lit(0).cast("long")})
    longest = chains.agg(F.max(F.size("chain"))).first()[0] or 0
    columns = [c for c in state.columns]
    schema = f"file {kind}, h1 long, h2 long, pos long, at long, before long, low long, bars array<long>, {NODE}"

    def hashed(shift: int):
        def run(batches):
            for whole_batch in batches:
                for batch in flat_parts(whole_batch):
                    c = Chains(batch)
                    begin = c.base[c.file] + c.of("at")
                    known = c.of("depth")
                    size = np.clip((c.base[c.file] + c.size[c.file] - begin - known) >> shift, 0, (1 << BITS) - 1)
                    offs = np.concatenate([[0], np.cumsum(size)])
                    each = np.repeat(np.arange(len(size)), size)
                    steps = (np.arange(offs[-1]) - offs[each] + 1) << shift
                    h = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(c.hashes(begin[each], known[each] + steps).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(c.file)), *(c.rows.field(x) for x in columns[1:]), h], names=[*columns, "h"])

        return run

    def grown(shift: int):
        def run(batches):
            for t in whole_keys(batches):
                h = t.column("h").combine_chunks()
                offs = np.concatenate([[0], np.cumsum(h.value_lengths().to_numpy())])
                key = numbered(t)
                row, *nodes = split(key, *(t.column(c).to_numpy().copy() for c in ("node", "child", "depth")), h.flatten().to_numpy(), offs, shift)
                if shift:
                    for lo in range(0, len(row), 50_000):
                        part = slice(lo, lo + 50_000)
                        x = t.select(columns[:-3]).take(pa.array(row[part]))
                        yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in x.columns), *(pa.array(c[part]) for c in nodes)], names=columns)
                    continue
                before = t.column("before").combine_chunks()
                token = np.unique(before.fill_null(0).to_numpy(), return_inverse=True)[1].reshape(-1)
                token = np.where(before.is_null().to_numpy(zero_copy_only=False), len(t) + np.arange(len(t)), token)
                bars = t.column("bars").to_pylist()
                entry, depth = tree_members(key[row], *nodes, token[row], t.column("low").to_numpy()[row], [bars[r] for r in row.tolist()])
                for lo in range(0, len(entry), 100_000):
                    r = row[entry[lo : lo + 100_000]]
                    yield pa.RecordBatch.from_arrays([t.column("file").combine_chunks().take(pa.array(r)), pa.array(t.column("pos").to_numpy()[r]), pa.array(t.column("at").to_numpy()[r] + depth[lo : lo + 100_000])], names=["file", "pos", "to"])

        return run

    n = places.count()
    for shift in range((max(longest, 1).bit_length() - 1) // BITS * BITS, -1, -BITS):
        asked = with_chain(state, chains).mapInArrow(hashed(shift), f"{schema}, h array<long>")
        by_key = asked.repartition(parts(places.sparkSession, 2 * n, 200_000), "h1", "h2").sortWithinPartitions("h1", "h2")
        state = cut(by_key.mapInArrow(grown(shift), schema if shift else f"file {kind}, pos long, to long"))

    def lengths(batches):
        for whole_batch in batches:
            for batch in flat_parts(whole_batch):
                c = Chains(batch)
                pos = c.of("pos")
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(c.file)), pa.array(pos), pa.array(c.pos[c.base[c.file] + c.of("to")] - pos + k)], names=["rep", "start", "tokens"])

    return with_chain(state, chains).mapInArrow(lengths, f"rep {kind}, start long, tokens long")


def spans_of(docs: DataFrame, k: int, min_lines: int) -> DataFrame:
    """(language, tokens, digest, file, start, stop, lines) of the ends of all maximal runs, one row each, by content."""
    stream = F.sha2(F.array_join(split_tokens(F.col("text")), " "), 256)
    named = cut(docs.select("file", "language", stream.alias("stream")))
    copies = named.groupBy("language", "stream").agg(F.min("file").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = cut(docs.join(copies.select(F.col("rep").alias("__rep"), "copies"), F.col("file") == F.col("__rep")).select("file", "language", "text", "copies"))
    windows = cut(repeated_windows(kgrams(reps, k, shared(reps, k))))
    chains = cut(windows.where("ends").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", "after", "last"))).alias("chain")))
    begins = windows.where("begins").join(reps.select("file", "copies"), "file").select("file", "key", "pos", "before", "line", "copies")
    places = cut(places_of(with_chain(begins, chains), k, min_lines))
    free = cut(members(places, chains, k))
    # a run of a pair within one file that overlaps itself is cut to the distance of its ends
    cuts = places.select("file", "pos", F.explode("cuts").alias("c")).select(F.col("file").alias("rep"), F.col("pos").alias("left_start"), F.col("c.mate").alias("right_start"), "c.tokens")
    size = F.size(split_tokens(F.col("text"))).cast("long")
    whole = reps.where("copies > 1").select(F.col("file").alias("rep"), F.lit(1).cast("long").alias("left_start"), F.lit(1).cast("long").alias("right_start"), size.alias("tokens")).where(F.col("tokens") >= k)
    pairs = cuts.union(whole).withColumn("pair", F.struct("rep", "left_start", "right_start", "tokens"))
    each = cut(pairs.select("pair", "tokens", "rep", F.explode(F.array("left_start", "right_start")).alias("start")))
    # lines and content of each distinct end, its file read once
    keys = ["rep", "start", "tokens"]
    ends = free.union(each.select(*keys)).distinct().groupBy(F.col("rep").alias("__r")).agg(F.collect_list(F.struct("start", "tokens")).alias("__s"))
    found = ends.join(reps.select("file", "language", "text"), F.col("__r") == F.col("file")).select("file", "language", "text", "__s")

    def contents(batches):
        for batch in batches:
            for lo, hi, data, offs in tok.slices(batch.column(2)):
                t = tok.Tokens(data, offs)
                lists = batch.column(3).slice(lo, hi - lo)
                doc = np.repeat(np.arange(hi - lo), lists.value_lengths().to_numpy())
                flat = lists.flatten()
                start, size = (flat.field(c).to_numpy() for c in ("start", "tokens"))
                a = t.first[doc] + start - 1
                b = a + size
                h = [tok.ranges(v, a, b, w) for w, v in enumerate(t.hashes)]
                rows = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start), pa.array(size), pa.array([f"{x:016x}{y:016x}" for x, y in zip(*h)], pa.string()), pa.array(t.line[b - 1] - t.line[a] + 1)], names=["rep", "language", "start", "tokens", "digest", "lines"])

    kind = docs.schema["file"].dataType.simpleString()
    known = cut(found.mapInArrow(contents, f"rep {kind}, language string, start long, tokens long, digest string, lines long"))
    tall = each.join(known, keys).groupBy("pair").agg(F.min("lines").alias("least")).where(F.col("least") >= min_lines).select("pair")
    kept = free.union(each.join(tall, "pair").select(*keys)).distinct().join(known, keys)
    alike = named.join(copies, ["language", "stream"]).select("file", F.col("rep").alias("__r"))
    return kept.join(alike, F.col("rep") == F.col("__r")).select("language", "tokens", "digest", "file", "start", (F.col("start") + F.col("tokens")).alias("stop"), "lines")


def apart(spans: DataFrame) -> DataFrame:
    """Without spans that overlap an earlier one of the same content and file that stays."""
    by = ["language", "digest", "tokens", "file"]
    # equal lengths: the next to stay is the first that starts a length after the last; a fold over the sorted starts of one file
    chosen = F.aggregate(F.array_sort(F.collect_list("start")), F.array().cast("array<bigint>"), lambda acc, x: F.when((F.size(acc) == 0) | (F.element_at(acc, -1) + F.col("tokens") <= x), F.array_append(acc, x)).otherwise(acc))
    return spans.groupBy(*by).agg(F.max("lines").alias("lines"), chosen.alias("starts")).select(*by, "lines", F.explode("starts").alias("start")).withColumn("stop", F.col("start") + F.col("tokens"))


def unsubsumed(spans: DataFrame) -> DataFrame:
    """Without groups all of whose spans lie within spans of one longer group.

    What may hold a group is looked for in one file of it, that with the fewest spans, and must have as many files. Groups of one file are settled there; for others
    each candidate is compared with all spans.
    """
    name = ["language", "digest", "tokens"]
    crowd = spans.groupBy("file").agg(F.count(F.lit(1)).alias("crowd"))
    sizes = spans.join(crowd, "file").groupBy(*name).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"), F.min(F.struct("crowd", "file")).alias("a"))
    sizes = cut(sizes.select(*name, "n", "files", F.col("a.file").alias("anchor"), F.monotonically_increasing_id().alias("g")))
    s = cut(spans.join(sizes, name).select("g", "file", "start", "stop", "n", "files", (F.col("file") == F.col("anchor")).alias("here")))

    def candidates(batches):
        for batch in batches:
            rows = batch.column(0)
            flat = rows.flatten()
            g, start, stop, files = (flat.field(c).to_numpy() for c in ("g", "start", "stop", "files"))
            here = flat.field("here").to_numpy(zero_copy_only=False)
            inner, outer = [], []
            offs = np.concatenate([[0], np.cumsum(rows.value_lengths().to_numpy())]).tolist()
            for a, b in zip(offs, offs[1:]):
                order = np.argsort(start[a:b], kind="stable") + a
                id_, first, last, many, size = g[order], start[order], stop[order], files[order], stop[order] - start[order]
                mine = np.flatnonzero(here[order])
                mine = mine[np.argsort(id_[mine], kind="stable")]
                for part in np.split(mine, np.flatnonzero(np.diff(id_[mine])) + 1) if len(mine) else []:
                    i = int(part[0])
                    found = None
                    for j in part.tolist():
                        to = np.searchsorted(first, first[j], "right")
                        x = id_[:to][(last[:to] >= last[j]) & (size[:to] > size[j]) & (many[:to] >= many[j])]
                        found = np.unique(x) if found is None else np.intersect1d(found, x)
                        if not len(found):
                            break
                    if len(found):
                        found = found.tolist() if many[i] > 1 else [None]
                        inner += [int(id_[i])] * len(found)
                        outer += found
            yield pa.RecordBatch.from_arrays([pa.array(inner, pa.int64()), pa.array(outer, pa.int64())], names=["g", "og"])

    by_file = s.groupBy("file").agg(F.collect_list(F.struct("g", "start", "stop", "files", "here")).alias("rows")).select("rows")
    pairs = cut(by_file.mapInArrow(candidates, "g long, og long"))
    outer = s.select(F.col("g").alias("og"), "file", F.col("start").alias("os"), F.col("stop").alias("oe"))
    within = pairs.where("og is not null").join(s.select("g", "file", "start", "stop", "n"), "g").join(outer, ["og", "file"]).where("os <= start and oe >= stop")
    held = within.groupBy("g", "og", "n").agg(F.count_distinct("file", "start").alias("m")).where("m = n").select("g").union(pairs.where("og is null").select("g")).distinct()
    return spans.join(sizes.join(held, "g").select(*name), name, "left_anti")


def groups(docs: DataFrame, k: int, min_lines: int = 1, max_groups: int | None = None) -> DataFrame:
    """Clone groups: language, digest, tokens, lines (most of a span), occurrences, files, first_file and first_start, the heaviest (tokens times occurrences) first; then by first_file and digest.

    A group is all places of one content that is a maximal run of some pair; overlapping places of one file count once. ``max_groups`` caps the list, not the search.
    """
    spans = apart(spans_of(docs, k, min_lines))
    sizes = spans.groupBy("language", "digest", "tokens").agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")
    live = cut(spans.join(sizes, ["language", "digest", "tokens"]).drop("occurrences"))
    out = unsubsumed(live).groupBy("language", "digest", "tokens").agg(F.max("lines").alias("lines"), F.count(F.lit(1)).alias("occurrences"), F.count_distinct("file").alias("files"), F.min(F.struct("file", "start")).alias("f"))
    out = out.select("language", "digest", "tokens", "lines", "occurrences", "files", F.col("f.file").alias("first_file"), F.col("f.start").alias("first_start"))
    return out if max_groups is None else out.orderBy((F.col("tokens") * F.col("occurrences")).desc(), "first_file", "digest").limit(max_groups)
