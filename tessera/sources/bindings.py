"""The logical relations of the operators, bound to the test tables: a DataFrame and, for the checks, the same relation as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.checkpoints import parts

EXTENSIONS = [".rs", ".md", ".json", "_test.rs", ".min.js", ".bin", ".py"]
_ext_sql = lambda e: "(CASE " + e + " % 7 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(EXTENSIONS)) + " END)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def suffix(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, EXTENSIONS)), (number % 7 + 1).cast("int"))


def seconds(ts: str) -> Column:
    return F.unix_seconds(F.col(ts).cast("timestamp"))


def snapshot_files(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), suffix(F.col("doc_id"))).alias("path"), F.col("n_chars").cast("long").alias("size"), "doc_id")


SNAPSHOT = f"snapshot AS (SELECT source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || {_ext_sql('doc_id')} AS path, CAST(n_chars AS BIGINT) AS size, doc_id FROM documents)"


def by_parts_and_orders(lines: DataFrame, p: DataFrame, o: DataFrame, last: str = "commit") -> DataFrame:
    """Lines with their parts and orders. Both joins and what is grouped after them have as many partitions as the lines need; those of one order end in one partition,
    or with ``last`` = path those of one part."""
    n = parts(lines.sparkSession, lines.count())
    sides = [(p, "l_partkey", "p_partkey"), (o, "l_orderkey", "o_orderkey")]
    for side, left, right in sides if last == "commit" else sides[::-1]:
        lines = lines.repartition(n, left).join(side.repartition(n, right), F.col(left) == F.col(right))
    return lines


def raw_commit_files(spark: SparkSession, d: str, last: str = "commit") -> DataFrame:
    """Unmerged changes: a commit is an order, its files are the parts of its lines, with a path under the part's brand."""
    o = table(spark, d, "orders").select("o_orderkey", seconds("o_orderdate").alias("ts"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    p = table(spark, d, "part").select("p_partkey", F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/p"), F.col("p_partkey").cast("string"), suffix(F.col("p_partkey"))).alias("path"))
    j = by_parts_and_orders(li, p, o, last)
    binary = F.col("l_returnflag") == "R"
    return j.select(F.col("o_orderkey").alias("commit"), "ts", "path", F.col("l_quantity").cast("long").alias("line_mass"), (~binary).alias("is_text"), binary.alias("is_binary"), "p_partkey")


COMMITS = f"""raw_changes AS (SELECT o_orderkey AS commit, CAST(epoch(o_orderdate) AS BIGINT) AS ts, replace(p_brand, '#', '') || '/p' || CAST(p_partkey AS VARCHAR) || {_ext_sql("p_partkey")} AS path,
  CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS line_mass, l_returnflag <> 'R' AS is_text, l_returnflag = 'R' AS is_binary
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
changes AS (SELECT commit, path, max(ts) AS ts, CAST(sum(line_mass) AS BIGINT) AS line_mass, bool_or(is_text) AS is_text, bool_or(is_binary) AS is_binary FROM raw_changes GROUP BY commit, path)"""


def current_files(spark: SparkSession, d: str) -> DataFrame:
    """The parts as current files. Every third has moved since its last change, so both sides have paths that the other lacks."""
    p = table(spark, d, "part")
    moved = F.when(F.col("p_partkey") % 3 == 0, F.lit("/moved")).otherwise(F.lit(""))
    path = F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), moved, F.lit("/p"), F.col("p_partkey").cast("string"), suffix(F.col("p_partkey")))
    cognitive = F.col("p_retailprice").cast("long") % 40
    return p.select(path.alias("path"), F.col("p_brand").alias("language"), (F.col("p_size").cast("long") - 1).alias("current_sloc"), cognitive.alias("current_cognitive"), (cognitive % 11 + 1).alias("current_cyclomatic"))


CURRENT = f"""current_files AS (SELECT replace(p_brand, '#', '') || (CASE WHEN p_partkey % 3 = 0 THEN '/moved' ELSE '' END) || '/p' || CAST(p_partkey AS VARCHAR) || {_ext_sql("p_partkey")} AS path, p_brand AS language, CAST(p_size - 1 AS BIGINT) AS current_sloc,
  CAST(trunc(p_retailprice) AS BIGINT) % 40 AS current_cognitive, CAST(trunc(p_retailprice) AS BIGINT) % 40 % 11 + 1 AS current_cyclomatic FROM part)"""


def function_metrics(spark: SparkSession, d: str, year: int | None = None) -> DataFrame:
    """A function is a line item (shipped in one year)."""
    c = F.col
    li = table(spark, d, "lineitem")
    if year:
        li = li.where((c("l_shipdate") >= F.lit(f"{year}-01-01").cast("timestamp_ntz")) & (c("l_shipdate") < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz")))
    return li.select(
        c("l_orderkey").cast("string").alias("path"), c("l_returnflag").alias("language"), c("l_partkey").alias("start_line"), c("l_linenumber").cast("string").alias("name"),
        c("l_quantity").cast("long").alias("sloc"), F.round(c("l_discount") * 100).cast("long").alias("cognitive"), (F.round(c("l_tax") * 100) + 1).cast("long").alias("cyclomatic"),
        c("l_linenumber").cast("long").alias("arguments"), (c("l_suppkey") % 5).alias("exits"), F.when(c("l_linestatus") != "O", c("l_extendedprice")).alias("maintainability"),
        F.when(c("l_suppkey") % 9 != 0, c("l_extendedprice")).alias("halstead_effort"), c("l_suppkey").alias("tie"),
    )


FUNCTIONS = """functions AS (SELECT CAST(l_orderkey AS VARCHAR) AS path, l_returnflag AS language, l_partkey AS start_line, CAST(l_linenumber AS VARCHAR) AS name,
  CAST(l_quantity AS BIGINT) AS sloc, CAST(round(l_discount * 100) AS BIGINT) AS cognitive, CAST(round(l_tax * 100) + 1 AS BIGINT) AS cyclomatic, CAST(l_linenumber AS BIGINT) AS arguments, l_suppkey % 5 AS exits,
  CASE WHEN l_linestatus <> 'O' THEN l_extendedprice END AS maintainability, CASE WHEN l_suppkey % 9 <> 0 THEN l_extendedprice END AS halstead_effort, l_suppkey AS tie, year(l_shipdate) AS shipped FROM lineitem)"""


def file_metrics(spark: SparkSession, d: str, year: int | None = None) -> DataFrame:
    """A file is a customer's orders (of one year): path is the customer, language the market segment."""
    o = table(spark, d, "orders")
    if year:
        o = o.where((F.col("o_orderdate") >= F.lit(f"{year}-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz")))
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    n = F.col("o_orderkey") % 10
    price = F.col("o_totalprice").cast("long")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_mktsegment").alias("language"))
    total = lambda e: F.sum(e).cast("long")
    return rows.agg(
        F.count(F.lit(1)).alias("functions"), total(price % 90 + 10).alias("lines"), total(price % 70).alias("sloc"), total(price % 60).alias("ploc"), total(price % 50).alias("lloc"), total(price % 6 + 1).alias("modified_cyclomatic"), total(n).alias("cloc"), total(price % 5).alias("blank"), total(price % 13).alias("cognitive"), total(price % 7 + 1).alias("cyclomatic"),
        total(n % 4).alias("arguments"), total(n % 3).alias("exits"), F.max(F.when(n > 6, (price % 100).cast("double"))).alias("maintainability"), F.max(F.when(n > 3, (price % 1000).cast("double"))).alias("halstead_effort"),
        F.sum((n % 2).cast("double")).alias("abc_assignments"), F.sum((n % 5).cast("double")).alias("abc_branches"), F.sum((n % 6).cast("double")).alias("abc_conditions"),
    )


def file_metrics_sql(name: str = "files", year: int | None = None) -> str:
    p, n = "CAST(trunc(o_totalprice) AS BIGINT)", "(o_orderkey % 10)"
    when = f"WHERE o_orderdate >= TIMESTAMP '{year}-01-01' AND o_orderdate < TIMESTAMP '{year + 1}-01-01'" if year else ""
    return f"""{name} AS (SELECT 'f' || CAST(c_custkey AS VARCHAR) AS path, c_mktsegment AS language, count(*) AS functions, CAST(sum({p} % 90 + 10) AS BIGINT) AS lines, CAST(sum({p} % 70) AS BIGINT) AS sloc, CAST(sum({p} % 60) AS BIGINT) AS ploc, CAST(sum({p} % 50) AS BIGINT) AS lloc, CAST(sum({p} % 6 + 1) AS BIGINT) AS modified_cyclomatic, CAST(sum({n}) AS BIGINT) AS cloc,
  CAST(sum({p} % 5) AS BIGINT) AS blank, CAST(sum({p} % 13) AS BIGINT) AS cognitive, CAST(sum({p} % 7 + 1) AS BIGINT) AS cyclomatic, CAST(sum({n} % 4) AS BIGINT) AS arguments, CAST(sum({n} % 3) AS BIGINT) AS exits,
  max(CASE WHEN {n} > 6 THEN CAST({p} % 100 AS DOUBLE) END) AS maintainability, max(CASE WHEN {n} > 3 THEN CAST({p} % 1000 AS DOUBLE) END) AS halstead_effort,
  sum(CAST({n} % 2 AS DOUBLE)) AS abc_assignments, sum(CAST({n} % 5 AS DOUBLE)) AS abc_branches, sum(CAST({n} % 6 AS DOUBLE)) AS abc_conditions
  FROM orders JOIN customer ON o_custkey = c_custkey {when} GROUP BY ALL)"""


def graph_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Declared edges between orders: each depends on the customer's next order of the same year, and an urgent last one on the first, which closes a cycle. It does so on each
    of its lines that was returned or not, whatever the line. Every line also depends on its customer (external), and lines without a return on a name of the customer's that nothing answers to."""
    from pyspark.sql import Window

    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"), "o_orderdate", "o_orderpriority")
    o = o.repartition(parts(spark, o.count()), "o_custkey", "y")
    w = Window.partitionBy("o_custkey", "y").orderBy("o_orderdate", "o_orderkey")
    first = F.first("o_orderkey").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    o = o.withColumn("after", F.coalesce(F.lead("o_orderkey").over(w), F.when(F.col("o_orderpriority") == "1-URGENT", first)))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    n = parts(spark, 3 * li.count())  # three declarations of each line at most; those of one order stay in one partition
    j = li.repartition(n, "l_orderkey").join(o.select("o_orderkey", "after", (-1 - F.col("o_custkey")).alias("customer")).repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    none = F.when(F.col("l_returnflag") == "N", F.col("customer") - 1_000_000_000_000)
    each = F.explode(F.array(F.struct(F.col("after").alias("target"), F.lit("internal").alias("class")), F.struct(F.col("customer").alias("target"), F.lit("external").alias("class")), F.struct(none.alias("target"), F.lit("unresolved").alias("class"))))
    return j.select(F.col("o_orderkey").alias("source"), each.alias("e"), F.col("l_linenumber").alias("line")).select("source", "e.target", "e.class", "line").where("target is not null")


EDGES = """ordered AS (SELECT o_orderkey, o_custkey, coalesce(lead(o_orderkey) OVER w, CASE WHEN o_orderpriority = '1-URGENT' THEN first(o_orderkey) OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END) AS after
  FROM orders WINDOW w AS (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey)),
trade AS (SELECT o_orderkey AS c, after, -1 - o_custkey AS m, l_linenumber AS line, l_returnflag AS f FROM lineitem JOIN ordered ON l_orderkey = o_orderkey),
declared AS MATERIALIZED (SELECT c AS source, after AS target, 'internal' AS class, line FROM trade WHERE after IS NOT NULL UNION ALL SELECT c, m, 'external', line FROM trade UNION ALL SELECT c, m - 1000000000000, 'unresolved', line FROM trade WHERE f = 'N'),
adj AS MATERIALIZED (SELECT DISTINCT source AS src, target AS dst FROM declared WHERE class = 'internal'), ids AS (SELECT o_orderkey AS id FROM orders)"""


def receipts(spark: SparkSession, d: str) -> DataFrame:
    """Events as benchmark receipts: a user is a run; the ordinal is the event's place in it."""
    from pyspark.sql import Window

    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("run"), (F.row_number().over(w) - 1).cast("long").alias("ordinal"), F.round(F.col("value") * 1000).cast("long").alias("elapsed_ns"), "event_type", "event_id")


RECEIPTS = "receipts AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ordinal, CAST(round(value * 1000) AS BIGINT) AS elapsed_ns, event_type, event_id FROM events)"


def claims(spark: SparkSession, d: str) -> DataFrame:
    """A claim for each language: that a document is toxic. Losses and weights follow from the language's name."""
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    n = F.ascii("lang")
    return j.groupBy(F.col("lang").alias("id")).agg(F.avg(F.col("toxic").cast("double")).alias("prior_probability")).withColumns({"false_positive_loss": F.lit(1.0), "false_negative_loss": (F.ascii("id") % 7 + 1).cast("double"), "importance": (F.ascii("id") % 3 + 1).cast("double")})


def probes(spark: SparkSession, d: str) -> DataFrame:
    """A probe for each language and last digit of the source: how often quality goes with the label, smoothed."""
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id").withColumn("digit", F.substring("source", -1, 1).cast("int"))
    hit = lambda t, q: F.sum(F.when((F.col("toxic") == t) & (F.col("quality") == q), 1.0).otherwise(0.0))
    g = j.groupBy("lang", "digit").agg(((hit(1, 1) + 1) / (hit(1, 1) + hit(1, 0) + 2)).alias("sensitivity"), ((hit(0, 0) + 1) / (hit(0, 0) + hit(0, 1) + 2)).alias("specificity"))
    digit = F.col("digit").cast("double")
    return g.select(F.concat("lang", F.lit("-"), F.col("digit").cast("string")).alias("id"), F.col("lang").alias("claim_id"), "sensitivity", "specificity", (digit * 0.5 + 0.25).alias("expected_usd"), (10 - digit).alias("expected_seconds"), F.concat(F.lit("g"), (F.col("digit") % 4).cast("string")).alias("dependence_group"))


PLAN = """claims AS (SELECT lang AS id, avg(CAST(toxic AS DOUBLE)) AS prior_probability, 1.0::DOUBLE AS false_positive_loss, CAST(ascii(lang) % 7 + 1 AS DOUBLE) AS false_negative_loss, CAST(ascii(lang) % 3 + 1 AS DOUBLE) AS importance FROM labels JOIN documents USING (doc_id) GROUP BY lang),
lab AS (SELECT lang, CAST(substr(source, -1) AS INTEGER) AS digit, toxic, quality FROM labels JOIN documents USING (doc_id)),
probes AS (SELECT lang || '-' || CAST(digit AS VARCHAR) AS id, lang AS claim_id, (count(*) FILTER (toxic = 1 AND quality = 1) + 1) / (count(*) FILTER (toxic = 1) + 2)::DOUBLE AS sensitivity,
  (count(*) FILTER (toxic = 0 AND quality = 0) + 1) / (count(*) FILTER (toxic = 0) + 2)::DOUBLE AS specificity, digit * 0.5::DOUBLE + 0.25::DOUBLE AS expected_usd, CAST(10 - digit AS DOUBLE) AS expected_seconds FROM lab GROUP BY lang, digit)"""
