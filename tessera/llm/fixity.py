"""Merkle fixity audit of two replicas of a record store.

A record's leaf is the SHA-256 of its length-prefixed fields. Records are ordered by id, in blocks of ``width`` ids; prefix sums of the primary's
record sizes (and ``HEADER`` for each) give every block an offset, and a leaf range holds the blocks that start within ``leaf_bytes`` of offsets. Both replicas
are hashed by the primary's ranges, so a record that is lost does not shift the ranges after it. A range's node hashes its number and its ids with their hashes, and nodes are
hashed into parents of ``fanout`` children, level by level, until one root is left, however many ids there are. The audit compares roots, then from
level to level only the children of nodes that differ, and lists only the records of leaf ranges that differ. Each replica is read once; every level is cut.

Defined cases: a null field is hashed apart from an empty one; records without an id are compared as a multiset by their content, spread over ``SPREAD`` ranges, and
those that differ are reported with a null id, range and offsets; records that repeat an id are one entry whose hash tells their number and the sums of their hashes, so no list of them is ever held; blocks that only the
replica has have ranges of their own, reported as null; an empty replica makes every record missing, two empty ones give no rows; columns that are not named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.tables import table
from tessera.plans.checkpoints import cut

WIDTH, LEAF_BYTES, HEADER, FANOUT, SPREAD = 64, 1 << 16, 16, 64, 4096
COLUMNS = ["page_id", "status", "offset_start", "offset_end", "leaf_range", "expected", "actual"]


def serial(columns: list[str]) -> Column:
    return F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("N")) for c in columns))


def sized(columns: list[str]) -> Column:
    total = F.lit(0).cast("long")
    for c in columns:
        total = total + F.coalesce(F.octet_length(c).cast("long"), F.lit(0))
    return total


def entries(records: DataFrame, key: str, fields: list[str], width: int, side: str) -> DataFrame:
    """One row for each id, and for each content without one: side, __id, __k (that content's hash), block (below 0 without an id), hashes, bytes, n.

    ``hashes`` is the record's hash; of several records their number and the sums of four parts of their hashes."""
    rows = records.select(F.col(key).cast("long").alias("__id"), F.sha2(serial(fields), 256).alias("__h"), sized(fields).alias("__b"))
    void = F.col("__id").isNull()
    spread = (-1 - F.conv(F.substring("__h", 1, 8), 16, 10).cast("long") % SPREAD).cast("long")
    rows = rows.withColumns({"__k": F.when(void, F.col("__h")).otherwise(F.lit("")), "void": void, "block": F.when(void, spread).otherwise(F.floor(F.col("__id") / width))})
    parts = [F.sum(F.conv(F.substring("__h", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).alias(f"__s{k}") for k in range(4)]
    g = rows.groupBy("__id", "__k", "void", "block").agg(F.count(F.lit(1)).alias("n"), F.max("__h").alias("__h"), F.sum("__b").alias("bytes"), *parts)
    hashes = F.when(F.col("n") == 1, F.col("__h")).otherwise(F.concat_ws("+", F.col("n").cast("string"), *(F.col(f"__s{k}").cast("string") for k in range(4))))
    return g.select(F.lit(side).alias("side"), "__id", "__k", "void", "block", hashes.alias("hashes"), "bytes", "n")


def starts(primary: DataFrame, leaf_bytes: int) -> DataFrame:
    """(block, start, leaf) of the primary's blocks: the offset at which each starts, and its leaf range. Prefix sums over runs of blocks, then within each."""
    blocks = primary.where("not void").groupBy("block").agg(F.sum("bytes").alias("bytes"), F.sum(F.col("bytes") + HEADER * F.col("n")).alias("weight"))
    blocks = cut(blocks.withColumn("run", F.floor(F.col("block") / 4096)))
    ahead = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = blocks.groupBy("run").agg(F.sum("bytes").alias("rb"), F.sum("weight").alias("rw"))
    runs = runs.select(F.col("run").alias("__run"), *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in ("rb", "rw")))
    within = Window.partitionBy("run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.select("block", "run", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(c) for c in ("bytes", "weight"))).join(runs, F.col("run") == F.col("__run"))
    return sums.select(F.col("block").alias("__block"), (F.col("rb") + F.col("bytes")).alias("start"), F.floor((F.col("rw") + F.col("weight")) / leaf_bytes).alias("leaf"))


def hashed(children: Column) -> Column:
    """SHA-256 of sorted (name, hash) pairs."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(children)), lambda x: F.concat(x["name"], F.lit("="), x["hash"])), ";"), 256)


def parents(nodes: DataFrame, fanout: int) -> DataFrame:
    return nodes.groupBy("side", F.floor(F.col("node") / fanout).alias("node")).agg(hashed(F.struct(F.col("node").cast("string").alias("name"), F.col("hash").alias("hash"))).alias("hash"))


def differing(nodes: DataFrame) -> DataFrame:
    """Nodes that one side lacks or that have another hash there."""
    a, b = (F.max(F.when(F.col("side") == s, F.col("hash"))) for s in "ab")
    return nodes.groupBy("node").agg(a.alias("a"), b.alias("b")).where("not (a <=> b)").select("node")


def tree(leaves: DataFrame, fanout: int) -> list[DataFrame]:
    """The levels over ``leaves`` (side, node, hash), cut each, up to one root of each side."""
    levels = [cut(leaves)]
    while True:
        low, high = levels[-1].agg(F.min("node"), F.max("node")).first()
        if low == high:  # also if there is none
            return levels
        if (low, high) == (-1, 0):  # ranges without an offset and those with one never meet by division
            levels.append(cut(levels[-1].groupBy("side", F.lit(0).cast("long").alias("node")).agg(hashed(F.struct(F.col("node").cast("string").alias("name"), F.col("hash").alias("hash"))).alias("hash"))))
            return levels
        levels.append(cut(parents(levels[-1], fanout)))


def ranged(primary: DataFrame, replica: DataFrame, key: str, fields: list[str], width: int, leaf_bytes: int) -> DataFrame:
    """The entries of both sides with their leaf range (node) and the primary's offset of their block (start)."""
    both = cut(entries(primary, key, fields, width, "a").union(entries(replica, key, fields, width, "b")))
    known = cut(starts(both.where("side = 'a'"), leaf_bytes))
    both = both.join(known, ~F.col("void") & (F.col("block") == F.col("__block")), "left")
    # below 0: records without an id, then blocks that the primary lacks, in an order of their own
    alone = F.when(F.col("void"), F.col("block")).otherwise(-1 - SPREAD - F.abs(F.xxhash64("block") % (1 << 40)))
    return cut(both.select("side", "__id", "__k", "void", "block", "hashes", "bytes", "start", "leaf", F.coalesce("leaf", alone).alias("node")))


def descend(each: DataFrame, fanout: int) -> tuple[DataFrame, list[DataFrame]]:
    """The leaf ranges that differ, and the levels of the trees."""
    name = F.concat(F.coalesce(F.col("__id").cast("string"), F.col("__k")).alias("name"))
    leaves = each.groupBy("side", "node").agg(hashed(F.struct(name.alias("name"), F.col("hashes").alias("hash"))).alias("hash"))
    levels = tree(leaves.select("side", "node", F.sha2(F.concat(F.col("node").cast("string"), F.lit("#"), F.col("hash")), 256).alias("hash")), fanout)
    bad = cut(differing(levels[-1]))
    for below, above in zip(levels[-2::-1], levels[:0:-1]):
        joined_all = above.agg(F.min("node"), F.max("node")).first() == (0, 0) and below.agg(F.min("node")).first()[0] == -1
        up = F.lit(0).cast("long") if joined_all else F.floor(F.col("node") / fanout)
        picked = bad.select(F.col("node").alias("__up"))
        bad = cut(differing(below.join(picked, up == F.col("__up"), "left_semi")))
    return bad, levels


def audit(primary: DataFrame, replica: DataFrame, key: str = "page_id", fields: tuple[str, ...] = ("url", "html"), width: int = WIDTH, fanout: int = FANOUT, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """Rows for the ids whose records differ: id, status (changed, missing, extra), offsets in the primary (where an extra one would be), leaf range and hashes."""
    each = ranged(primary, replica, key, list(fields), width, leaf_bytes)
    bad, _ = descend(each, fanout)
    some = each.join(bad.select(F.col("node").alias("__bad")), F.col("node") == F.col("__bad"), "left_semi")
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    both = some.groupBy("__id", "__k", "void", "block", "start", "leaf").agg(of("a", "hashes").alias("expected"), of("b", "hashes").alias("actual"), F.coalesce(of("a", "bytes"), F.lit(0)).alias("bytes"))
    ahead = Window.partitionBy("void", "block").orderBy("__id", "__k").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("begin", F.col("start") + F.coalesce(F.sum("bytes").over(ahead), F.lit(0))).where("not (expected <=> actual)")
    status = F.when(F.col("expected").isNull(), "extra").when(F.col("actual").isNull(), "missing").otherwise("changed")
    return both.select(F.col("__id").alias(key), status.alias("status"), F.col("begin").alias("offset_start"), (F.col("begin") + F.col("bytes")).alias("offset_end"), F.col("leaf").alias("leaf_range"), "expected", "actual")


def damaged(pages: DataFrame) -> DataFrame:
    """A second replica of ``pages`` as a failing disk would give it: by a digest of the id, some records lost, cut short or with a byte changed."""
    m = F.conv(F.substring(F.md5(F.concat(F.lit("replica:"), F.col("page_id").cast("string"))), 1, 4), 16, 10).cast("int")
    html = F.when(m < 300, F.concat(F.lit("#"), F.substring("html", 2, 2147483647))).when((m >= 300) & (m < 450), F.expr("substring(html, 1, cast(length(html) div 2 as int))")).otherwise(F.col("html"))
    return pages.select("page_id", "url", html.alias("html"), m.alias("__m")).where("__m is null or __m < 450 or __m >= 600").drop("__m")


def op1_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return audit(pages, damaged(pages))


SQL = f"""
WITH m AS (SELECT page_id, url, html, CAST(('0x' || substr(md5('replica:' || CAST(page_id AS VARCHAR)), 1, 4)) AS INTEGER) AS m FROM pages),
b AS (SELECT page_id, url, CASE WHEN m < 300 THEN '#' || substr(html, 2) WHEN m >= 300 AND m < 450 THEN substr(html, 1, length(html) // 2) ELSE html END AS html FROM m WHERE m < 450 OR m >= 600),
ha AS (SELECT page_id, sha256(concat(coalesce(CAST(strlen(url) AS VARCHAR) || ':' || url, 'N'), coalesce(CAST(strlen(html) AS VARCHAR) || ':' || html, 'N'))) AS h,
  coalesce(strlen(url), 0) + coalesce(strlen(html), 0) AS bytes FROM pages),
hb AS (SELECT page_id, sha256(concat(coalesce(CAST(strlen(url) AS VARCHAR) || ':' || url, 'N'), coalesce(CAST(strlen(html) AS VARCHAR) || ':' || html, 'N'))) AS h FROM b),
o AS (SELECT page_id, h, CAST(sum(bytes) OVER (ORDER BY page_id) AS BIGINT) AS offset_end, CAST(bytes AS BIGINT) AS bytes,
  CAST(sum(bytes + {HEADER}) OVER (ORDER BY page_id) AS BIGINT) - bytes - {HEADER} AS w FROM ha),
l AS (SELECT *, CAST(floor((min(w) OVER (PARTITION BY floor(page_id / {WIDTH}))) / {LEAF_BYTES}) AS BIGINT) AS leaf_range FROM o)
SELECT l.page_id, CASE WHEN hb.h IS NULL THEN 'missing' ELSE 'changed' END AS status, l.offset_end - l.bytes AS offset_start, l.offset_end, leaf_range, l.h AS expected, hb.h AS actual
FROM l LEFT JOIN hb ON l.page_id = hb.page_id WHERE l.h IS DISTINCT FROM hb.h
"""
