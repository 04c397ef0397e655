"""Temporal list join: were captures on a block list when they were fetched?

Dated entries (pattern, list_name, action, at) become validity intervals: an ``add`` holds from its time to the next entry of the same
pattern and list. A pattern is a host or any parent domain. Intervals are collected for each host that occurs, and every capture, joined to its
host, looks up the entries active at its fetch time: an as-of join without a sort of the captures and without a group per capture.

Defined cases: a url that is null or has no host is never blocked; a null fetch time matches nothing; an entry with a null pattern, list, action
or time is void; of entries at one instant for one pattern and list, ``remove`` wins, and repeats count once; the times are half open;
of several active entries the longest pattern, then the list name, is reported; captures that repeat are reported each; without entries, or
without captures, nothing is blocked, or there are no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.tables import small, table
from tessera.plans.checkpoints import cut

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[\]]+)"
LISTS = ("adult", "malware", "spam")


def host(url: str = "url") -> Column:
    """Lower-cased, without the dot that may end it; an IPv6 address keeps its brackets."""
    found = F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))
    return F.when(found != "", found)


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, list_name, valid_from, valid_to (null: still active)."""
    e = entries.select(F.lower("pattern").alias("pattern"), "list_name", "action", F.col("at").cast("long").alias("at")).dropna().where("action in ('add', 'remove')")
    e = e.groupBy("pattern", "list_name", "at").agg(F.max("action").alias("action"))
    later = Window.partitionBy("pattern", "list_name").orderBy("at")
    e = e.withColumn("valid_to", F.lead("at").over(later)).where("action = 'add'")
    return e.select("pattern", "list_name", F.col("at").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, host, fetched_at, blocked, list_name, pattern, valid_from of every capture."""
    rows = captures.select("page_id", host().alias("host"), F.col("fetched_at").cast("long").alias("fetched_at"))
    hosts = rows.select(F.col("host").alias("__host")).where("__host is not null").distinct()
    labels = F.split("__host", r"\.")
    suffixes = hosts.select("__host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("__p"))
    known = cut(intervals(entries).withColumnRenamed("pattern", "__pattern"))
    active = suffixes.join(small(known), F.col("__p") == F.col("__pattern"))
    held = F.struct((-F.length("__pattern")).alias("rank"), F.col("list_name").alias("list_name"), (-F.col("valid_from")).alias("since"), F.col("__pattern").alias("pattern"), F.col("valid_from").alias("valid_from"), F.col("valid_to").alias("valid_to"))
    # as long as the entries of a host and its parents
    active = cut(active.groupBy("__host").agg(F.array_sort(F.collect_list(held)).alias("__held")))
    found = rows.join(small(active, active.agg(F.sum(F.size("__held"))).first()[0] or 0), F.col("host") == F.col("__host"), "left")
    hit = F.get(F.filter("__held", lambda x: (x["valid_from"] <= F.col("fetched_at")) & (x["valid_to"].isNull() | (F.col("fetched_at") < x["valid_to"]))), F.lit(0))
    found = found.withColumn("__hit", hit)
    return found.select("page_id", "host", "fetched_at", F.col("__hit").isNotNull().alias("blocked"), F.col("__hit.list_name").alias("list_name"), F.col("__hit.pattern").alias("pattern"), F.col("__hit.valid_from").alias("valid_from"))


def number(text: Column, first: int, digits: int = 4) -> Column:
    return F.conv(F.substring(F.md5(text), first, digits), 16, 10).cast("long")


def fetched(pages: DataFrame) -> DataFrame:
    """Captures of ``pages`` with a fetch day, as days from 2020-01-01, drawn from a digest of the id: the table has none."""
    return pages.select("page_id", "url", (number(F.concat(F.lit("fetch:"), F.col("page_id").cast("string")), 1) % 1500).alias("fetched_at"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """A block list over the hosts of ``pages`` and their parent domains: added, mostly removed, some added again, on days from a digest."""
    hosts = pages.select(host().alias("h")).where("h is not null").distinct()
    labels, hosts = F.split("h", r"\."), cut(hosts)
    both = hosts.select("h").union(hosts.select(F.array_join(F.slice(labels, 2, F.size(labels)), ".").alias("h"))).where("instr(h, '.') > 0").distinct()
    both = both.withColumn("n", number(F.col("h"), 1)).where("n % 3 < 2").withColumn("list_name", F.element_at(F.array(*map(F.lit, LISTS)), (F.col("n") % 3 + 1).cast("int")))
    first, second, third = number(F.col("h"), 5) % 700, number(F.col("h"), 9) % 400 + 30, number(F.col("h"), 13) % 400 + 30
    steps = F.array(F.struct(F.lit("add").alias("action"), first.alias("at")), F.struct(F.lit("remove").alias("action"), (first + second).alias("at")), F.struct(F.lit("add").alias("action"), (first + second + third).alias("at")))
    return both.select(F.col("h").alias("pattern"), "list_name", F.explode(steps).alias("s")).select("pattern", "list_name", "s.action", "s.at")


def op10_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_captures(fetched(pages), dated_entries(pages))


SQL = r"""
WITH c AS (SELECT page_id, nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[\]]+)', 1)), '.'), '') AS host,
  CAST(('0x' || substr(md5('fetch:' || CAST(page_id AS VARCHAR)), 1, 4)) AS BIGINT) % 1500 AS fetched_at FROM pages),
hosts AS (SELECT DISTINCT host AS h FROM c WHERE host IS NOT NULL),
listed AS (SELECT DISTINCT h FROM (SELECT h FROM hosts UNION ALL SELECT substr(h, strpos(h, '.') + 1) FROM hosts WHERE strpos(h, '.') > 0) WHERE strpos(h, '.') > 0),
n AS (SELECT h, CAST(('0x' || substr(md5(h), 1, 4)) AS BIGINT) AS n, CAST(('0x' || substr(md5(h), 5, 4)) AS BIGINT) % 700 AS a,
  CAST(('0x' || substr(md5(h), 9, 4)) AS BIGINT) % 400 + 30 AS b, CAST(('0x' || substr(md5(h), 13, 4)) AS BIGINT) % 400 + 30 AS d FROM listed),
iv AS (SELECT h AS pattern, CASE n % 3 WHEN 0 THEN 'adult' WHEN 1 THEN 'malware' END AS list_name, a AS valid_from, a + b AS valid_to FROM n WHERE n % 3 < 2
  UNION ALL SELECT h, CASE n % 3 WHEN 0 THEN 'adult' WHEN 1 THEN 'malware' END, a + b + d, NULL FROM n WHERE n % 3 < 2),
j AS (SELECT c.page_id, iv.*, row_number() OVER (PARTITION BY c.page_id ORDER BY length(pattern) DESC, list_name, valid_from DESC) AS rn
  FROM c JOIN iv ON (c.host = iv.pattern OR ends_with(c.host, '.' || iv.pattern)) AND iv.valid_from <= c.fetched_at AND (iv.valid_to IS NULL OR c.fetched_at < iv.valid_to))
SELECT c.page_id, c.host, c.fetched_at, j.pattern IS NOT NULL AS blocked, j.list_name, j.pattern, j.valid_from
FROM c LEFT JOIN j ON c.page_id = j.page_id AND j.rn = 1
"""
