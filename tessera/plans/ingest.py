"""Queries over texts: logs, listings, manifests, source files and record lines are written from the test tables and read back by the parsers.

The DuckDB twins count what was written, so a reader that loses or invents a row is found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths, render, scalars
from tessera.functions import tokens as tok
from tessera.operators import audit, receipts, resolve, topology
from tessera.plans.catalog import masses_of, query, r6, rounded
from tessera.plans.checkpoints import parts
from tessera.sources import bindings as b
from tessera.sources import code, git, manifests

LOG_PATHS = f"""lg AS (SELECT md5('c' || CAST(o_orderkey AS VARCHAR)) || '00000000' AS commit, CAST(epoch(o_orderdate) AS BIGINT) AS ts, replace(p_brand, '#', '') || '/p' || CAST(p_partkey AS VARCHAR) || (CASE WHEN p_partkey % 5 = 0 THEN chr(9) || 'é"' ELSE '' END) AS path,
  CAST(l_quantity AS BIGINT) AS q, l_returnflag = 'R' AS bin, p_partkey, o_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""


def log_sections(spark: SparkSession, d: str) -> DataFrame:
    """Each order as a commit in the form of a log with numstat; every fifth path has a tab, a letter outside ASCII and a quote, and is quoted."""
    o = b.table(spark, d, "orders").select("o_orderkey", b.seconds("o_orderdate").alias("ts"))
    p = b.table(spark, d, "part").select("p_partkey", F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/p"), F.col("p_partkey").cast("string")).alias("path"))
    li = b.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("long").cast("string").alias("q"), "l_returnflag")
    path = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit('"'), F.col("path"), F.lit('\\t\\303\\251\\""'))).otherwise(F.col("path"))
    line = F.concat(F.when(F.col("l_returnflag") == "R", F.lit("-\t-")).otherwise(F.concat(F.col("q"), F.lit("\t0"))), F.lit("\t"), path)
    n = parts(spark, li.count())
    named = li.repartition(n, "l_partkey").join(p.repartition(n, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    # an order has a handful of lines
    rows = named.repartition(n, "l_orderkey").groupBy("l_orderkey").agg(F.array_join(F.collect_list(line), "\n").alias("lines"))
    both = rows.join(o.repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    head = F.concat(F.md5(F.concat(F.lit("c"), F.col("o_orderkey").cast("string"))), F.lit("00000000\x00"), F.col("ts").cast("string"), F.lit("\x00\n"))
    return both.select(F.concat(head, F.col("lines"), F.lit("\n")).alias("value"))


@query(f"WITH {LOG_PATHS} SELECT commit, ts, path, CAST(sum(CASE WHEN bin THEN 0 ELSE q END) AS BIGINT) AS line_mass, bool_or(NOT bin) AS is_text, bool_or(bin) AS is_binary, CAST(NULL AS VARCHAR) AS error FROM lg GROUP BY commit, ts, path")
def git_log(spark: SparkSession, d: str) -> DataFrame:
    return git.parse_log(log_sections(spark, d), b.table(spark, d, "lineitem").count())


@query("""SELECT CASE p_partkey % 10 WHEN 0 THEN '120000' WHEN 1 THEN '160000' WHEN 2 THEN '100755' ELSE '100644' END AS mode, CASE p_partkey % 10 WHEN 1 THEN 'commit' ELSE 'blob' END AS type, count(*) AS entries, CAST(sum(CASE WHEN p_partkey % 10 <> 1 THEN p_size END) AS BIGINT) AS bytes FROM part GROUP BY ALL""")
def git_tree(spark: SparkSession, d: str) -> DataFrame:
    """A listing of the parts as tree entries, by mode."""
    p = b.table(spark, d, "part")
    k = F.col("p_partkey") % 10
    mode = F.when(k == 0, "120000").when(k == 1, "160000").when(k == 2, "100755").otherwise("100644")
    entry = F.concat(mode, F.when(k == 1, " commit ").otherwise(" blob "), F.sha1(F.col("p_partkey").cast("string")), F.when(k == 1, F.lit("       -")).otherwise(F.lpad(F.concat(F.lit(" "), F.col("p_size").cast("string")), 8, " ")), F.lit("\t"), F.col("p_name"))
    return git.parse_tree(p.select(entry.alias("value"))).groupBy("mode", "type").agg(F.count(F.lit(1)).alias("entries"), F.sum("size").alias("bytes"))


def manifest_files(spark: SparkSession, d: str) -> DataFrame:
    """Each customer as a package whose orders are its dependencies, in the form of one of five ecosystems."""
    o = b.table(spark, d, "orders").select("o_custkey", "o_orderkey")
    k, how, name = F.col("o_custkey") % 5, F.col("o_orderkey") % 5, F.concat(F.lit("d"), F.col("o_orderkey").cast("string"))
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (how + 1).cast("int"))
    python = F.concat(name, pick(" *", " @ file:///x", ">=1", " @ git+https://g", ""))
    line = (
        F.when(k == 0, F.concat(name, F.lit(" = "), pick('"*"', '{ path = "../x" }', '"1.2"', '{ git = "https://g" }', '{ features = ["a"] }')))
        .when(k == 1, F.concat(F.lit('"'), name, F.lit('": '), pick('"*"', '"file:../x"', '"^1.2"', '"git+https://g"', '""')))
        .when(k == 2, F.concat(F.lit('"'), python, F.lit('"')))
        .when(k == 3, python)
        .otherwise(F.concat(F.lit("\t"), name, F.lit(" v1.0")))
    )
    # a customer has a few dozen orders
    g = o.select("o_custkey", line.alias("line")).groupBy("o_custkey").agg(F.collect_list("line").alias("lines"))
    form = lambda head, sep, tail: F.concat(F.lit(head), F.array_join("lines", sep), F.lit(tail))
    content = F.when(k == 0, form("[dependencies]\n", "\n", "\n")).when(k == 1, form('{"dependencies": {', ",", "}}")).when(k == 2, form("[project]\ndependencies = [", ", ", "]\n")).when(k == 3, form("# pinned\n", "\n", "\n")).otherwise(form("module m\nrequire (\n", "\n", "\n)\n"))
    file = F.element_at(F.array(*map(F.lit, ("Cargo.toml", "package.json", "pyproject.toml", "requirements.txt", "go.mod"))), (k + 1).cast("int"))
    return g.select(F.concat(F.lit("p"), F.col("o_custkey").cast("string"), F.lit("/"), file).alias("path"), content.alias("content"))


@query("""WITH k AS (SELECT o_custkey % 5 AS e, o_custkey, CASE WHEN o_custkey % 5 = 4 THEN 'registry' ELSE CASE o_orderkey % 5 WHEN 0 THEN (CASE WHEN o_custkey % 5 = 3 THEN 'registry' ELSE 'wildcard' END) WHEN 1 THEN 'path' WHEN 2 THEN 'registry' WHEN 3 THEN 'git' ELSE (CASE WHEN o_custkey % 5 IN (2, 3) THEN 'registry' ELSE 'unknown' END) END END AS kind FROM orders)
SELECT CASE e WHEN 0 THEN 'cargo' WHEN 1 THEN 'npm' WHEN 4 THEN 'go' ELSE 'python' END AS ecosystem, 'runtime' AS scope, count(*) AS dependencies, count(*) FILTER (kind <> 'registry') AS non_registry, count(*) FILTER (kind IN ('path', 'git', 'wildcard', 'unknown')) AS risky, count(DISTINCT o_custkey) AS manifests FROM k GROUP BY ALL""")
def manifest_kinds(spark: SparkSession, d: str) -> DataFrame:
    return manifests.kinds(manifests.dependencies(manifest_files(spark, d)))


TEMPLATES = {
    "rust": "// {c}\nuse std::fmt;\nmod m{d};\npub fn f{d}(a: u8, b: u8) -> u8 { if a > b { return a; } b }\nfn g() {}\n\n#[test]\nfn t{d}() { assert_eq!(1, 1); assert!(true); }\n",
    "python": '# {c}\nimport os, sys\nfrom .p{d} import x\ndef f{d}(a, b):\n    """doc"""\n    if a and b:\n        return 1\ndef _g(): pass\n\ndef test_{d}():\n    assert f{d}(1, 2)\n',
    "javascript": "// {c}\nimport a from './m{d}.js';\nconst r = require('x');\n\nexport function f{d}(a, b) { return a ? b : 0; }\nexport const K = 1;\nit.skip('t', () => { expect(1).toBe(1); });\n",
    "go": '// {c}\npackage m\nimport (\n\t"fmt"\n\t"a/b"\n)\n// F\nfunc F{d}(a, b int) int { if a > 0 && b > 0 { return a }; return b }\n\nfunc TestA(t *testing.T) { t.Errorf("x") }\n',
}


#: Letters and spaces as they are, other first bytes of a character as a space.
PLAIN = np.full(256, 32, np.uint8)
for _from, _to in ((65, 91), (97, 123)):
    PLAIN[_from:_to] = np.arange(_from, _to)


def plain(data: np.ndarray, offs: np.ndarray) -> list[str]:
    """Texts (bytes and offsets) with a space for each character but ASCII letters and spaces."""
    first = (data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(first)])[offs].tolist()
    out = PLAIN[data[first]].tobytes().decode("ascii")
    return [out[x:y] for x, y in zip(at, at[1:])]


def source_files(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a source file, its words in the leading comment. They are written in one pass in Arrow batches: as a column expression the text would be
    written anew for each condition on it."""
    forms = list(zip(("rs", "py", "js", "go"), TEMPLATES.values()))

    def write(batches):
        for batch in batches:
            ids, there = batch.column(0).to_pylist(), batch.column(1).is_valid().to_pylist()
            for lo, hi, data, offs in tok.slices(batch.column(1)):
                some = [(k, *forms[k % 4], c) for k, c, t in zip(ids[lo:hi], plain(data, offs), there[lo:hi]) if t and k is not None]
                yield pa.RecordBatch.from_arrays([pa.array([f"s/{k}.{ext}" for k, ext, _, _ in some], pa.string()), pa.array([form.replace("{d}", str(k)).replace("{c}", c) for k, _, form, c in some], pa.string())], names=["path", "content"])

    return code.sources(b.table(spark, d, "documents").select("doc_id", "text").mapInArrow(write, "path string, content string"))


def per_language(rows: str, columns: str) -> str:
    """SQL that multiplies what one file of each language holds (``rows``: values) by the number of files."""
    return f"WITH n AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'rust' WHEN 1 THEN 'python' WHEN 2 THEN 'javascript' ELSE 'go' END AS language, count(*) AS n FROM documents GROUP BY ALL), v AS (SELECT * FROM (VALUES {rows}) t({columns})) "


@query(per_language("('rust', 'rust-use', 1), ('rust', 'rust-mod', 1), ('python', 'python-import', 2), ('python', 'python-from', 1), ('javascript', 'js-import', 1), ('javascript', 'js-require', 1), ('go', 'go-import', 2)", "language, kind, k") + "SELECT language, kind, k * n AS declarations FROM v JOIN n USING (language)")
def source_imports(spark: SparkSession, d: str) -> DataFrame:
    return code.imports(source_files(spark, d)).groupBy("language", "kind").agg(F.count(F.lit(1)).alias("declarations"))


@query(per_language("('rust', 'function', 1, 0), ('python', 'function', 2, 1), ('javascript', 'function', 1, 0), ('javascript', 'constant', 1, 0), ('go', 'function', 2, 1)", "language, kind, k, o") + "SELECT language, kind, k * n AS symbols, o * n AS documented FROM v JOIN n USING (language)")
def source_api(spark: SparkSession, d: str) -> DataFrame:
    return code.exported(source_files(spark, d)).groupBy("language", "kind").agg(F.count(F.lit(1)).alias("symbols"), F.count_if("documented").alias("documented"))


@query(per_language("('rust', 1, 0), ('python', 1, 0), ('javascript', 1, 1), ('go', 1, 0)", "language, k, o") + "SELECT language, k * n AS cases, o * n AS ignored FROM v JOIN n USING (language)")
def source_tests(spark: SparkSession, d: str) -> DataFrame:
    return code.test_cases(source_files(spark, d)).groupBy("language").agg(F.count(F.lit(1)).alias("cases"), F.count_if("ignored").alias("ignored"))


MEASURED = ("lines", "sloc", "cloc", "blank", "functions", "arguments", "exits", "cyclomatic", "cognitive", "assertions")


@query(per_language("('rust', 8, 6, 1, 1, 3, 2, 1, 4, 1, 2), ('python', 11, 9, 1, 1, 3, 2, 1, 5, 1, 1), ('javascript', 7, 5, 1, 1, 2, 2, 1, 3, 0, 1), ('go', 10, 7, 2, 1, 2, 3, 2, 4, 1, 1)", "language, " + ", ".join(MEASURED)) + f"SELECT language, {', '.join(f'{c} * n AS {c}' for c in MEASURED)}, 0 AS syntax_errors FROM v JOIN n USING (language)")
def source_measures(spark: SparkSession, d: str) -> DataFrame:
    m = code.measures(source_files(spark, d))
    return m.groupBy("language").agg(*(F.sum(c).alias(c) for c in MEASURED), F.count_if("syntax_error").cast("int").alias("syntax_errors"))


def record_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each turn of a conversation as a record line; some are broken in one way or another."""
    c = b.table(spark, d, "conversations")
    k, turn = F.col("conv_id") % 8, F.col("turn")
    instrument = F.when(k == 1, "guessed").when(turn % 2 == 0, "mechanical").otherwise("empirical")
    record = F.to_json(F.struct(
        F.concat(F.lit("r-"), F.col("conv_id").cast("string"), F.lit("-"), F.when(k == 2, "x").otherwise(turn.cast("string"))).alias("id"), F.when(k == 3, "repo@12").otherwise("repo@0123abc").alias("artifact"), F.when(k != 4, F.lit("a")).alias("axis"), instrument.alias("instrument"),
        F.when(k == 5, "../up.md").otherwise("p.md").alias("procedure"), F.lit("e.txt").alias("evidence"), F.lit("pass").alias("verdict"), F.lit("clean").alias("integrity"), F.struct(F.lit("tool").alias("kind"), F.when(k != 6, F.lit("t")).alias("id")).alias("agent"), F.lit("2026-07-10T12:34:56Z").alias("ts"),
    ))
    return c.select((F.col("conv_id") * 1000 + turn).cast("int").alias("line"), F.when(k == 7, F.concat(F.lit("["), record, F.lit("]"))).otherwise(record).alias("raw"))


@query("""WITH c AS (SELECT conv_id % 8 AS k, conv_id, turn FROM conversations), n AS (SELECT conv_id, count(*) AS m FROM c WHERE k = 2 GROUP BY conv_id)
SELECT CASE k WHEN 1 THEN 'invalid_instrument' WHEN 3 THEN 'invalid_artifact_identity' WHEN 4 THEN 'invalid_record_field' WHEN 5 THEN 'unsafe_reference' WHEN 6 THEN 'invalid_agent' ELSE 'invalid_json_record' END AS code, 'error' AS severity, count(*) AS issues FROM c WHERE k NOT IN (0, 2) GROUP BY ALL
UNION ALL SELECT 'duplicate_record_id', 'error', CAST(sum(m - 1) AS BIGINT) FROM n HAVING sum(m - 1) > 0 UNION ALL SELECT 'unknown_report_record', 'error', count(DISTINCT conv_id) FROM c WHERE k = 7""")
def audit_bundle(spark: SparkSession, d: str) -> DataFrame:
    """The issues of a bundle by code: records from the conversations, and a report that cites the first line of each."""
    rows = record_rows(spark, d)
    report = b.table(spark, d, "conversations").groupBy("conv_id").agg(F.min("turn").alias("t")).select(F.concat(F.lit("see r-"), F.col("conv_id").cast("string"), F.lit("-"), F.when(F.col("conv_id") % 8 == 2, "x").otherwise(F.col("t").cast("string")), F.lit(".")).alias("text"))
    return audit.audit(rows, report).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("issues"))


@query(f"""WITH prior AS (SELECT lang AS claim, avg(CAST(toxic AS DOUBLE)) AS p FROM labels JOIN documents USING (doc_id) GROUP BY lang), upd AS (SELECT lang AS claim, source, avg(CAST(quality AS DOUBLE)) AS p FROM labels JOIN documents USING (doc_id) WHERE lang <> 'de' GROUP BY lang, source)
SELECT claim, {r6("coalesce((SELECT arg_max(u.p, u.source) FROM upd u WHERE u.claim = prior.claim), p)")} AS probability, (SELECT count(*) FROM upd u WHERE u.claim = prior.claim) AS updates FROM prior""")
def posterior_merge(spark: SparkSession, d: str) -> DataFrame:
    """Beliefs after the updates of several programs: the last update of a claim stands, a claim without any keeps its prior."""
    j = b.table(spark, d, "labels").join(b.table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    prior = j.groupBy(F.col("lang").alias("claim")).agg(F.avg(F.col("toxic").cast("double")).alias("probability"))
    updates = j.where("lang != 'de'").groupBy(F.col("lang").alias("claim"), F.col("source").alias("seq")).agg(F.avg(F.col("quality").cast("double")).alias("probability"))
    return rounded(receipts.posterior(prior, updates))


PROFILE_SQL = f"WITH {b.COMMITS}, {b.CURRENT}, h AS (SELECT path, CAST(sum(line_mass) AS BIGINT) AS mass, count(*) AS touched FROM changes GROUP BY path) "


@query(PROFILE_SQL + "SELECT language, count(*) AS files, arg_min(path, (-mass, path)) AS by_mass, max(mass) AS mass, arg_min(path, (-current_cognitive, path)) AS by_cognitive, max(current_cognitive) AS cognitive FROM current_files JOIN h USING (path) GROUP BY language")
def facet_extrema(spark: SparkSession, d: str) -> DataFrame:
    """For each language, the current files with a history: how many, and those of most change and of most cognitive weight."""
    h = masses_of(spark, d).groupBy("path").agg(F.sum("line_mass").alias("mass"))
    j = b.current_files(spark, d).join(h, "path")
    most = lambda c: F.min_by("path", F.struct(-F.col(c), F.col("path")))
    return j.groupBy("language").agg(F.count(F.lit(1)).alias("files"), most("mass").alias("by_mass"), F.max("mass").alias("mass"), most("current_cognitive").alias("by_cognitive"), F.max("current_cognitive").alias("cognitive"))


@query(PROFILE_SQL + "SELECT path, mass, touched FROM h WHERE path NOT IN (SELECT path FROM current_files) ORDER BY mass DESC, path LIMIT 15")
def history_only_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The 15 paths of most change that are no current files."""
    h = topology.merged(b.raw_commit_files(spark, d)).groupBy("path").agg(F.sum("line_mass").alias("mass"), F.count(F.lit(1)).alias("touched"))
    return h.join(b.current_files(spark, d).select("path"), "path", "left_anti").orderBy(F.col("mass").desc(), "path").limit(15)


@query("""SELECT event_id, CASE WHEN ns >= 1000000000 THEN printf('%.3fs', ns / 1e9::DOUBLE) WHEN ns >= 1000000 THEN printf('%.3fms', ns / 1e6::DOUBLE) WHEN ns >= 1000 THEN printf('%.3fµs', ns / 1e3::DOUBLE) ELSE CAST(ns AS VARCHAR) || 'ns' END AS elapsed,
  CASE WHEN length(props) <= 12 THEN props ELSE substr(props, 1, 11) || '…' END AS shown FROM (SELECT event_id, props, CAST(event_id * event_id * 1954 + 1 AS BIGINT) AS ns FROM events)""")
def receipts_for_people(spark: SparkSession, d: str) -> DataFrame:
    e = b.table(spark, d, "events")
    ns: Column = F.col("event_id") * F.col("event_id") * 1954 + 1
    return e.select("event_id", render.duration(ns).alias("elapsed"), render.bounded(F.col("props"), 12).alias("shown"))


@query(r"""SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + (CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END) AS BIGINT) AS lines, lower(hex(source)) AS source_hex, sha256(text) AS digest, CAST(length(regexp_replace(text, '\s', '', 'g')) AS INTEGER) AS visible,
  regexp_replace('"' || lang || '`', '^["''`]+|["''`]+$', '', 'g') AS unquoted, regexp_matches(text, '^\p{Lu}') AS capital, regexp_matches(source, '^[\p{L}\p{N}_$]+$') AS simple, regexp_matches('Test' || source, '^(Test|Benchmark|Example)(\P{Ll}.*)?$') AS go_case, lower(lang || '/' || source) AS identity,
  regexp_matches(source, '^[A-Za-z0-9]([A-Za-z0-9-]{0,37}[A-Za-z0-9])?$') AND source NOT LIKE '%--%' AS owner, regexp_matches(source, '^[A-Za-z0-9._-]{1,100}$') AND source NOT IN ('.', '..') AS repo, sha256(CAST(doc_id AS VARCHAR) || ':' || md5(text) || ':v1') || '.json' AS cache,
  lower(hex(unhex(lpad(hex(strlen(source)), 16, '0')))) || lower(hex(source)) AS prefixed FROM documents""")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    """The text expressions over every document."""
    t, s = F.col("text"), F.col("source")
    return b.table(spark, d, "documents").select(
        "doc_id", scalars.line_count(t).alias("lines"), scalars.hex_lower(s).alias("source_hex"), scalars.sha256_hex(t).alias("digest"), F.length(scalars.compact(t)).alias("visible"), scalars.strip_quotes(F.concat(F.lit('"'), F.col("lang"), F.lit("`"))).alias("unquoted"),
        scalars.starts_uppercase(t).alias("capital"), scalars.simple_name(s).alias("simple"), scalars.go_case_name(F.concat(F.lit("Test"), s)).alias("go_case"), scalars.identity_key(F.col("lang"), s).alias("identity"), scalars.valid_owner(s).alias("owner"), scalars.valid_repo(s).alias("repo"),
        scalars.cache_key(F.col("doc_id"), F.md5(t), F.lit("v1")).alias("cache"), scalars.hex_lower(scalars.length_prefixed(s)).alias("prefixed"),
    )


@query(f"""SELECT o_orderkey, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS day, {r6("least(1.0, greatest(0.0, o_totalprice / 1e6))")} AS unit, {r6("greatest(o_totalprice - 1000, 0)")} AS kept, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS finite,
  {r6("ln(1 + o_totalprice) * 480 / ln(1 + 600000)")} AS place, CAST(CAST(o_orderkey + 18014398509481984 AS DOUBLE) AS HUGEINT) = CAST(o_orderkey + 18014398509481984 AS HUGEINT) AS exact, CASE WHEN regexp_matches(o_orderpriority, '^[0-9]+$') THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS BIGINT) ELSE 0 END AS parsed FROM orders""")
def number_functions(spark: SparkSession, d: str) -> DataFrame:
    """The number expressions over every order."""
    o, price, key = b.table(spark, d, "orders"), F.col("o_totalprice"), F.col("o_orderkey")
    lost = F.when(key % 6 == 0, F.lit(float("nan"))).when(key % 3 == 0, F.lit(float("inf"))).otherwise(price)
    read = F.coalesce(scalars.ascii_u64(F.when(key % 2 == 0, key.cast("string")).otherwise("x")), F.lit(0)).cast("long")
    return o.select(
        key, scalars.utc_day(b.seconds("o_orderdate")).alias("day"), F.round(scalars.unit_clamp(price / 1e6), 6).alias("unit"), F.round(F.when(price >= 1000, scalars.nonnegative(F.greatest(price - 1000, F.lit(0.0)), price)).otherwise(0.0), 6).alias("kept"), scalars.finite(lost).alias("finite"),
        F.round(scalars.log_scale(price, F.lit(600000.0), 480.0), 6).alias("place"), scalars.exact_double(key + 18014398509481984).alias("exact"), read.alias("parsed"),
    )


@query("""WITH p AS (SELECT p_partkey AS k, 'src/m' || CAST(p_partkey % 7 AS VARCHAR) || '/f' || CAST(p_partkey AS VARCHAR) || '.rs' AS path FROM part), i AS (SELECT k, path, CASE k % 4 WHEN 0 THEN 'crate::m' || CAST((k + 1) % 7 AS VARCHAR) || '::f' || CAST(k + 1 AS VARCHAR) || '::Name' WHEN 1 THEN 'super::m' || CAST((k + 1) % 7 AS VARCHAR) || '::f' || CAST(k + 1 AS VARCHAR) WHEN 2 THEN 'self::f' || CAST(k + 7 AS VARCHAR) ELSE 'serde::de' END AS specifier FROM p),
t AS (SELECT k, CASE k % 4 WHEN 2 THEN 'src/m' || CAST((k + 7) % 7 AS VARCHAR) || '/f' || CAST(k + 7 AS VARCHAR) || '.rs' WHEN 3 THEN NULL ELSE 'src/m' || CAST((k + 1) % 7 AS VARCHAR) || '/f' || CAST(k + 1 AS VARCHAR) || '.rs' END AS target FROM p)
SELECT k AS key, i.path, specifier, p2.path AS target, k % 4 = 3 AS external, 'src/m' || CAST(k % 7 AS VARCHAR) || '/g.rs' AS sibling, true AS module FROM i JOIN t USING (k) LEFT JOIN p p2 ON p2.path = t.target""")
def rust_use_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Parts as files of a crate that use each other by paths from the crate, the parent and the module itself, or an outer crate."""
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    t = b.table(spark, d, "part")
    # a part is a few bytes on disk, so its table is read by one task, which would work out the candidates of all
    p = t.select(k).repartition(parts(spark, t.count(), 50_000), k).select(k.alias("key"), F.concat(F.lit("src/m"), text(k % 7), F.lit("/f"), text(k), F.lit(".rs")).alias("path"))
    k = F.col("key")
    after = F.concat(F.lit("m"), text((k + 1) % 7), F.lit("::f"), text(k + 1))
    spec = F.when(k % 4 == 0, F.concat(F.lit("crate::"), after, F.lit("::Name"))).when(k % 4 == 1, F.concat(F.lit("super::"), after)).when(k % 4 == 2, F.concat(F.lit("self::f"), text(k + 7))).otherwise("serde::de")
    i = p.select("key", "path", F.lit("rust-use").alias("kind"), spec.alias("specifier"))
    got = resolve.resolve(resolve.candidates(i), p, ["key"])
    sibling = resolve.normalize(F.concat(paths.parent(F.col("path")), F.lit("/x/./../g.rs")))
    return got.select("key", "path", "specifier", "target", resolve.is_external(F.col("kind"), F.col("specifier")).alias("external"), sibling.alias("sibling"), paths.is_source_module(F.col("path")).alias("module"))
