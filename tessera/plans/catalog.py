"""All queries over the test tables by name, with their DuckDB twins. Bindings: ``tessera.sources.bindings``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import paths, scalars
from tessera.operators import audit, clones, dist, graph, leaves, metrics, planner, receipts, resolve, shape, topology
from tessera.plans.checkpoints import cut
from tessera.sources import bindings as b

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HISTORY_COMMITS, TOP, KGRAM = 200, 30, 40


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to six places, as float sums differ in their last bits with the order of addition; large ones to fewer."""
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def r6(sql: str) -> str:
    return f"round({sql}, 6)"


def files_of(spark: SparkSession, d: str) -> DataFrame:
    return topology.merged(b.raw_commit_files(spark, d))


def masses_of(spark: SparkSession, d: str) -> DataFrame:
    """Changes for sums by path, where merging makes no difference."""
    return topology.countable(b.raw_commit_files(spark, d, last="path"))


TOPOLOGY_SQL = f"""
WITH {b.COMMITS},
f AS (SELECT *, split_part(path, '/', 1) AS component, {paths.category_sql("path")} AS category FROM changes),
w AS (SELECT commit, component, count(*) AS n, bool_or(is_binary) AS b, bool_or(category = 'source') AS s, bool_or(category = 'test') AS t, bool_or(category = 'documentation') AS o FROM f GROUP BY commit, component),
c AS (SELECT commit, CAST(sum(n) AS BIGINT) AS files, count(*) AS components, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS same_pairs, bool_or(b) AS b, bool_or(s) AS s, bool_or(t) AS t, bool_or(o) AS o FROM w GROUP BY commit),
a AS (SELECT count(*) AS commits_analyzed, count(*) FILTER (b) AS commits_with_binary_changes, avg(files) AS mean, quantile_disc(files, 0.5) AS p50, quantile_disc(files, 0.9) AS p90, max(files) AS mx,
  CAST(sum(files * (files - 1) // 2) AS BIGINT) AS pairs, CAST(sum(same_pairs) AS BIGINT) AS same_pairs, count(*) FILTER (components >= 3) AS broad, count(*) FILTER (s) AS src, count(*) FILTER (s AND t) AS st, count(*) FILTER (s AND o) AS so FROM c),
p AS (SELECT count(DISTINCT path) AS unique_changed_files, CAST(sum(line_mass) AS BIGINT) AS total_line_change_mass FROM changes)
"""


@query(TOPOLOGY_SQL + f"""SELECT commits_analyzed, commits_with_binary_changes, {r6("mean")} AS files_changed_mean, p50 AS files_changed_p50, p90 AS files_changed_p90, mx AS files_changed_max, pairs, same_pairs AS same_component_pairs,
  broad AS broad_commits, src AS source_commits, st AS source_test_commits, so AS source_documentation_commits, unique_changed_files, total_line_change_mass, {r6("(pairs - same_pairs) / nullif(pairs, 0)::DOUBLE")} AS cross_top_level_pair_ratio,
  {r6("broad / nullif(commits_analyzed, 0)::DOUBLE")} AS broad_commit_rate, {r6("st / nullif(src, 0)::DOUBLE")} AS source_test_cochange_rate, {r6("so / nullif(src, 0)::DOUBLE")} AS source_documentation_cochange_rate FROM a, p""")
def change_topology(spark: SparkSession, d: str) -> DataFrame:
    return rounded(topology.summary(files_of(spark, d)))


@query(TOPOLOGY_SQL + f"""SELECT src AS source_commits, st AS source_test_commits, so AS source_documentation_commits, {r6("st / nullif(src, 0)::DOUBLE")} AS source_test_cochange_rate,
  {r6("so / nullif(src, 0)::DOUBLE")} AS source_documentation_cochange_rate FROM a""")
def cochange_rates(spark: SparkSession, d: str) -> DataFrame:
    cols = ["source_commits", "source_test_commits", "source_documentation_commits", "source_test_cochange_rate", "source_documentation_cochange_rate"]
    return rounded(topology.summary(files_of(spark, d)).select(*cols))


@query(f"WITH {b.COMMITS} SELECT path, CAST(sum(line_mass) AS BIGINT) AS mass FROM changes GROUP BY path HAVING sum(line_mass) > 0 ORDER BY mass DESC, path LIMIT {TOP}")
def hotspots(spark: SparkSession, d: str) -> DataFrame:
    return topology.hotspots(masses_of(spark, d)).orderBy(F.col("mass").desc(), "path").limit(TOP)


def concentration_sql(table: str, weight: str) -> str:
    return f"""t AS (SELECT count(*) AS n, sum({weight})::DOUBLE AS tot FROM {table}),
e AS (SELECT CASE WHEN max(n) = 1 THEN 0.0::DOUBLE WHEN max(tot) > 0 THEN least(1, greatest(0, sum(CASE WHEN {weight} > 0 THEN -({weight} / tot) * ln({weight} / tot) ELSE 0 END)) / ln(max(n))) END AS ne,
  CASE WHEN max(n) = 1 THEN 1.0::DOUBLE WHEN max(tot) > 0 THEN exp(sum(CASE WHEN {weight} > 0 THEN -({weight} / tot) * ln({weight} / tot) ELSE 0 END)) END AS ec FROM {table}, t),
k AS (SELECT sum({weight}) FILTER (rn <= (n + 9) // 10) / max(tot) AS share FROM (SELECT {weight}, row_number() OVER (ORDER BY {weight} DESC) AS rn FROM {table}), t)"""


@query(f"""WITH {b.COMMITS}, h AS (SELECT path, CAST(sum(line_mass) AS BIGINT) AS mass FROM changes GROUP BY path HAVING sum(line_mass) > 0), {concentration_sql("h", "mass")}
SELECT {r6("ne")} AS normalized_change_mass_entropy, {r6("ec")} AS effective_hotspot_files, {r6("share")} AS top_decile_change_mass_share, (SELECT max(mass) FROM h) AS largest_hotspot_mass,
  (SELECT path FROM h ORDER BY mass DESC, path LIMIT 1) AS largest_hotspot_path FROM e, k""")
def change_entropy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(topology.concentration(masses_of(spark, d)))


@query(f"""WITH {b.COMMITS}, c AS (SELECT commit, max(ts) AS ts FROM changes GROUP BY commit), o AS (SELECT *, row_number() OVER (ORDER BY ts DESC, commit DESC) AS place FROM c)
SELECT commit, ts, CAST(place AS INTEGER) AS place, (SELECT count(*) FROM c) > {HISTORY_COMMITS} AS truncated FROM o WHERE place <= {HISTORY_COMMITS}""")
def history_window(spark: SparkSession, d: str) -> DataFrame:
    return topology.window_of_commits(b.raw_commit_files(spark, d), HISTORY_COMMITS)


@query(f"""WITH {b.SNAPSHOT}, c AS (SELECT *, {paths.category_sql("path")} AS category FROM snapshot), dim AS (SELECT unnest({paths.sql_list(paths.CATEGORIES)}) AS category)
SELECT dim.category, count(c.path) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM dim LEFT JOIN c ON c.category = dim.category GROUP BY dim.category""")
def category_mix(spark: SparkSession, d: str) -> DataFrame:
    return shape.category_mix(b.snapshot_files(spark, d))


@query(f"""WITH {b.SNAPSHOT}, s AS (SELECT split_part(path, '/', 1) AS component, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS files FROM snapshot WHERE {paths.category_sql("path")} = 'source' GROUP BY 1)
SELECT component, bytes, files FROM s""")
def top_level_bytes(spark: SparkSession, d: str) -> DataFrame:
    return shape.top_level_mass(b.snapshot_files(spark, d))


@query(f"""WITH {b.SNAPSHOT}, s AS (SELECT split_part(path, '/', 1) AS component, CAST(sum(size) AS BIGINT) AS bytes FROM snapshot WHERE {paths.category_sql("path")} = 'source' GROUP BY 1), {concentration_sql("s", "bytes")}
SELECT {r6("ne")} AS normalized_entropy, {r6("ec")} AS effective_count FROM e""")
def top_level_entropy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dist.entropy(shape.top_level_mass(b.snapshot_files(spark, d)), "bytes"))


@query(f"""WITH {b.SNAPSHOT}, c AS (SELECT *, {paths.category_sql("path")} AS category FROM snapshot), src AS (SELECT path, size FROM c WHERE category = 'source'), {concentration_sql("src", "size")},
tl AS (SELECT split_part(path, '/', 1) AS component, sum(size) AS bytes FROM src GROUP BY 1), t2 AS (SELECT count(*) AS n, sum(bytes)::DOUBLE AS tot FROM tl),
e2 AS (SELECT sum(-(bytes / tot) * ln(bytes / tot)) AS h, max(n) AS n FROM tl, t2),
b AS (SELECT CAST(sum(size) AS BIGINT) AS total, coalesce(sum(size) FILTER (category = 'source'), 0) AS s, coalesce(sum(size) FILTER (category = 'test'), 0) AS te, coalesce(sum(size) FILTER (category = 'documentation'), 0) AS dc,
  coalesce(sum(size) FILTER (category = 'generated_or_vendor'), 0) AS g, count(*) AS n, CAST(max(len(string_split(path, '/'))) AS BIGINT) AS depth FROM c)
SELECT b.n AS tracked_files, b.total AS tracked_bytes, (SELECT quantile_disc(size, 0.5) FROM src) AS source_file_size_median, (SELECT quantile_disc(size, 0.9) FROM src) AS source_file_size_p90, (SELECT max(size) FROM src) AS largest_source_file_bytes,
  (SELECT path FROM src ORDER BY size DESC, path LIMIT 1) AS largest_source_file_path, {r6("(SELECT max(size) FROM src) / nullif(b.s, 0)::DOUBLE")} AS largest_source_file_share, {r6("share")} AS top_decile_source_byte_share,
  {r6("ne")} AS normalized_source_size_entropy, {r6("ec")} AS effective_source_files, {r6("CASE WHEN e2.n = 1 THEN 0 ELSE e2.h / ln(e2.n) END")} AS normalized_top_level_source_entropy, {r6("CASE WHEN e2.n = 1 THEN 1 ELSE exp(e2.h) END")} AS effective_top_level_components,
  {r6("te / nullif(b.s, 0)::DOUBLE")} AS test_to_source_bytes, {r6("dc / nullif(b.s, 0)::DOUBLE")} AS documentation_to_source_bytes, {r6("g / b.total::DOUBLE")} AS generated_or_vendor_byte_share, b.depth AS max_path_depth FROM b, e, k, e2""")
def static_shape(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shape.static_shape(b.snapshot_files(spark, d)))


def profiled(spark: SparkSession, d: str) -> DataFrame:
    files = cut(files_of(spark, d))
    newest = topology.window_of_commits(files, HISTORY_COMMITS).select(F.col("commit").alias("__newest"))
    return topology.profile(b.current_files(spark, d), files.join(F.broadcast(newest), F.col("commit") == F.col("__newest"), "left_semi"))


PROFILE_SQL = f"""
WITH {b.COMMITS}, {b.CURRENT}, newest AS (SELECT commit FROM changes GROUP BY commit ORDER BY max(ts) DESC, commit DESC LIMIT {HISTORY_COMMITS}), ch AS (SELECT * FROM changes WHERE commit IN (SELECT commit FROM newest)),
h AS (SELECT path, count(DISTINCT commit) AS commits_touched, count(DISTINCT ts // 86400) AS active_change_days, count(*) FILTER (is_text) AS text_commits_touched, count(*) FILTER (is_binary) AS binary_change_count,
  CAST(sum(line_mass) AS BIGINT) AS line_change_mass, min(ts) AS f, max(ts) AS l FROM ch GROUP BY path),
n AS (SELECT count(DISTINCT commit) AS commits FROM ch)
"""
STATUS_SQL = "CASE WHEN coalesce(text_commits_touched, 0) > 0 AND coalesce(binary_change_count, 0) > 0 THEN 'text_and_binary' WHEN coalesce(binary_change_count, 0) > 0 THEN 'binary_only' WHEN coalesce(text_commits_touched, 0) > 0 THEN 'text' ELSE 'none' END"


@query(PROFILE_SQL + f"""SELECT c.path, c.language, current_sloc, current_cognitive, current_cyclomatic, {r6("current_cognitive * 1000 / nullif(current_sloc, 0)::DOUBLE")} AS cognitive_per_ksloc,
  CASE WHEN h.path IS NULL THEN 'current_without_history' ELSE 'matched' END AS join_status, coalesce(commits_touched, 0) AS commits_touched, {r6("coalesce(commits_touched, 0) / nullif(commits, 0)::DOUBLE")} AS commit_touch_fraction,
  coalesce(active_change_days, 0) AS active_change_days, coalesce(text_commits_touched, 0) AS text_commits_touched, coalesce(binary_change_count, 0) AS binary_change_count, coalesce(line_change_mass, 0) AS line_change_mass,
  coalesce(binary_change_count, 0) = 0 AS line_change_mass_complete, {r6("CASE WHEN coalesce(binary_change_count, 0) = 0 THEN coalesce(line_change_mass, 0) / nullif(current_sloc, 0)::DOUBLE END")} AS line_change_mass_per_current_sloc,
  f AS first_observed_change_unix_seconds, l AS last_observed_change_unix_seconds, {STATUS_SQL} AS history_status, lower(hex(encode(c.path))) AS path_bytes_hex FROM current_files c LEFT JOIN h ON c.path = h.path, n""")
def change_profile_current(spark: SparkSession, d: str) -> DataFrame:
    p = profiled(spark, d).where("join_status <> 'history_only'")
    return rounded(p.withColumn("path_bytes_hex", scalars.hex_lower(F.col("path"))))


@query(PROFILE_SQL + f"""SELECT h.path, commits_touched, {r6("commits_touched / nullif(commits, 0)::DOUBLE")} AS commit_touch_fraction, active_change_days, text_commits_touched, binary_change_count, line_change_mass, binary_change_count = 0 AS line_change_mass_complete,
  f AS first_observed_change_unix_seconds, l AS last_observed_change_unix_seconds, {STATUS_SQL} AS history_status FROM h, n WHERE h.path NOT IN (SELECT path FROM current_files)""")
def change_profile_history_only(spark: SparkSession, d: str) -> DataFrame:
    cols = ["path", "commits_touched", "commit_touch_fraction", "active_change_days", "text_commits_touched", "binary_change_count", "line_change_mass", "line_change_mass_complete", "first_observed_change_unix_seconds", "last_observed_change_unix_seconds", "history_status"]
    return rounded(profiled(spark, d).where("join_status = 'history_only'").select(*cols))


@query(PROFILE_SQL + """SELECT count(c.path) AS current_files, count(h.path) AS history_files, count(*) FILTER (c.path = h.path) AS matched_files, count(*) FILTER (h.path IS NULL) AS current_without_history_files,
  count(*) FILTER (c.path IS NULL) AS history_only_files, count(*) FILTER (c.path IS NOT NULL AND binary_change_count > 0) AS binary_touched_current_files FROM current_files c FULL JOIN h ON c.path = h.path""")
def change_profile_coverage(spark: SparkSession, d: str) -> DataFrame:
    return topology.join_coverage(profiled(spark, d))


SUM_SQL = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("functions", "lines", "sloc", "ploc", "lloc", "cloc", "blank", "cognitive", "cyclomatic", "modified_cyclomatic", "arguments", "exits"))
MEAN_SQL = ", ".join(f"{r6(f'sum({c}) / count(*)')} AS mean_{c}" for c in ("maintainability", "halstead_effort"))
ABC_SQL = "sum(abc_assignments) AS abc_assignments, sum(abc_branches) AS abc_branches, sum(abc_conditions) AS abc_conditions, round(sqrt(sum(abc_assignments) ** 2 + sum(abc_branches) ** 2 + sum(abc_conditions) ** 2), 6) AS abc_magnitude"


@query(f"WITH {b.file_metrics_sql()} SELECT count(*) AS files, {SUM_SQL}, {MEAN_SQL}, {ABC_SQL} FROM files")
def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.summary(b.file_metrics(spark, d)))


@query(f"WITH {b.file_metrics_sql()} SELECT language, count(*) AS files, {SUM_SQL}, {MEAN_SQL}, {ABC_SQL} FROM files GROUP BY language")
def language_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.summary(b.file_metrics(spark, d), "language"))


@query(f"""WITH {b.file_metrics_sql()}, s AS (SELECT {SUM_SQL} FROM files) SELECT {r6("functions * 1000 / nullif(sloc, 0)::DOUBLE")} AS functions_per_ksloc, {r6("cognitive * 1000 / nullif(sloc, 0)::DOUBLE")} AS cognitive_per_ksloc,
  {r6("cyclomatic * 1000 / nullif(sloc, 0)::DOUBLE")} AS cyclomatic_per_ksloc, {r6("arguments / nullif(functions, 0)::DOUBLE")} AS arguments_per_function, {r6("exits / nullif(functions, 0)::DOUBLE")} AS exits_per_function,
  {r6("cloc / nullif(lines, 0)::DOUBLE")} AS comment_fraction, {r6("blank / nullif(lines, 0)::DOUBLE")} AS blank_fraction FROM s""")
def metric_rates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.rates(metrics.summary(b.file_metrics(spark, d))))


@query(f"WITH {b.FUNCTIONS} " + " UNION ALL ".join(f"""SELECT '{m}' AS metric, count({m}) AS count, CAST(min({m}) AS DOUBLE) AS min, CAST(quantile_disc({m}, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc({m}, 0.9) AS DOUBLE) AS p90, CAST(quantile_disc({m}, 0.99) AS DOUBLE) AS p99,
  CAST(max({m}) AS DOUBLE) AS max, round(avg({m}), 6) AS mean FROM functions""" for m in ("cognitive", "cyclomatic", "sloc", "arguments", "exits")))
def function_distributions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.distributions(b.function_metrics(spark, d)))


def register_rankings() -> None:
    for sort, up in metrics.SORTS.items():
        way = "ASC NULLS LAST" if up else "DESC NULLS LAST"
        cols = "path, language, start_line, name, sloc, cognitive, cyclomatic, arguments, exits, maintainability, halstead_effort, tie"
        rest = ["tie", "sloc", "cognitive", "cyclomatic", "exits", "halstead_effort"]
        QUERIES[f"rank_functions_{sort}"] = lambda spark, d, sort=sort, rest=tuple(rest): metrics.rank_functions(b.function_metrics(spark, d), sort, TOP, rest)
        ORACLES[f"rank_functions_{sort}"] = f"WITH {b.FUNCTIONS} SELECT {cols} FROM functions ORDER BY {sort} {way}, path, start_line, name, {', '.join(c + ' ASC NULLS FIRST' for c in rest)} LIMIT {TOP}"
        QUERIES[f"rank_files_{sort}"] = lambda spark, d, sort=sort: metrics.rank_files(b.file_metrics(spark, d), sort, TOP).select("path", "language", "functions", sort)
        ORACLES[f"rank_files_{sort}"] = f"WITH {b.file_metrics_sql()} SELECT path, language, functions, {sort} FROM files ORDER BY {sort} {way}, path LIMIT {TOP}"


register_rankings()
PAIR_SQL = f"WITH {b.file_metrics_sql('lf', 1996)}, {b.file_metrics_sql('rf', 1997)}"


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return b.file_metrics(spark, d, 1996), b.file_metrics(spark, d, 1997)


def report_sql(t: str, functions: str) -> str:
    v = {"files": "count(*)", **{c: f"sum({c})" for c in ("functions", "sloc", "ploc", "lloc", "cloc", "cognitive", "cyclomatic", "modified_cyclomatic", "arguments", "exits")}}
    v |= {f"mean_{c}": f"sum({c}) / count(*)" for c in ("maintainability", "halstead_effort")}
    v |= {f"{c}_per_ksloc": f"sum({c}) * 1000 / nullif(sum(sloc), 0)" for c in ("functions", "cognitive", "cyclomatic")}
    v |= {f"{c}_per_function": f"sum({c}) / nullif(sum(functions), 0)" for c in ("arguments", "exits")} | {"comment_fraction": "sum(cloc) / nullif(sum(lines), 0)"}
    tails = {n: f"max({m})" if p == 1 else f"quantile_disc({m}, {p})" for n, m, p in metrics.TAILS}
    return " UNION ALL ".join([*(f"SELECT '{k}' AS metric, CAST({e} AS DOUBLE) AS v FROM {t}" for k, e in v.items()), *(f"SELECT '{k}', CAST({e} AS DOUBLE) FROM functions WHERE {functions}" for k, e in tails.items())])


@query(PAIR_SQL + f""", {b.FUNCTIONS}, l AS ({report_sql("lf", "shipped = 1996")}), r AS ({report_sql("rf", "shipped = 1997")}) SELECT metric, {r6("l.v")} AS "left", {r6("r.v")} AS "right", {r6("r.v - l.v")} AS right_minus_left, {r6("(r.v - l.v) / nullif(abs(l.v), 0)")} AS relative_change_from_left
  FROM l JOIN r USING (metric) WHERE l.v IS NOT NULL AND r.v IS NOT NULL""")
def metrics_compare_diffs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.compare(*sides(spark, d), (b.function_metrics(spark, d, 1996), b.function_metrics(spark, d, 1997))))


@query(PAIR_SQL + " SELECT path, language, CASE WHEN r.path IS NULL THEN 'only_left' WHEN l.path IS NULL THEN 'only_right' ELSE 'matched' END AS status, " + ", ".join(f"l.{m} AS left_{m}, r.{m} AS right_{m}, r.{m} - l.{m} AS delta_{m}" for m in ("sloc", "cognitive", "cyclomatic", "arguments", "exits")) + " FROM lf l FULL JOIN rf r USING (path, language)")
def metrics_compare_files(spark: SparkSession, d: str) -> DataFrame:
    return metrics.compare_files(*sides(spark, d))


@query(f"WITH m AS ({PAIR_SQL} SELECT path, language, l.cognitive AS left_cognitive, r.cognitive AS right_cognitive, r.cognitive - l.cognitive AS delta_cognitive FROM lf l JOIN rf r USING (path, language)) SELECT * FROM m ORDER BY abs(delta_cognitive) DESC, path, language LIMIT {TOP}")
def metrics_compare_top_files(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.compare_files(*sides(spark, d), ("cognitive",)).where("status = 'matched'").drop("status")
    return m.orderBy(F.abs("delta_cognitive").desc(), "path", "language").limit(TOP)


@query("""WITH e AS (SELECT event_type, min(CAST(props->>'k' AS BIGINT)) FILTER (event_id % 2 = 0) AS a, min(CAST(props->>'k' AS BIGINT)) FILTER (event_id % 2 = 1) AS b, count(*) FILTER (event_id % 2 = 0) AS na, count(*) FILTER (event_id % 2 = 1) AS nb,
  round(max(value) FILTER (event_id % 2 = 0), 6) AS va, round(max(value) FILTER (event_id % 2 = 1), 6) AS vb FROM events GROUP BY event_type),
u AS (SELECT event_type, '/least' AS pointer, a::DOUBLE AS l, b::DOUBLE AS r FROM e UNION ALL SELECT event_type, '/nested/a~1b/0', na::DOUBLE, nb::DOUBLE FROM e UNION ALL SELECT event_type, '/nested/til~0de', va, vb FROM e)
SELECT event_type, pointer, l AS "left", r AS "right", round(r - l, 6) AS right_minus_left, round((r - l) / nullif(abs(l), 0), 6) AS relative_change_from_left FROM u""")
def repo_compare_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Observations of even and odd events, as JSON, compared leaf by leaf."""
    e = b.table(spark, d, "events").withColumn("side", F.col("event_id") % 2)
    k = F.get_json_object("props", "$.k").cast("long")
    o = e.groupBy("event_type", "side").agg(F.min(k).alias("least"), F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 6).alias("v"))
    text = F.to_json(F.struct("least", F.struct(F.array("n").alias("a/b"), F.col("v").alias("til~de"), F.lit("not a number").alias("s")).alias("nested")))
    found = leaves.numeric_leaves(o.select("event_type", "side", text.alias("j")), "j", ["event_type", "side"])
    return rounded(leaves.differences(found.where("side = 0").drop("side"), found.where("side = 1").drop("side"), ["event_type"]))


@query(f"WITH {b.EDGES} SELECT source, target, class, list_sort(list(DISTINCT line)) AS evidence FROM declared GROUP BY ALL")
def dep_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.grouped_edges(b.graph_edges(spark, d))


NODES_SQL = """n AS (SELECT id, arg_min(kind, (o, kind)) AS kind FROM (SELECT id, 'analyzed-file' AS kind, 0 AS o FROM ids UNION ALL SELECT target, CASE class WHEN 'internal' THEN 'analyzed-file' WHEN 'external' THEN 'external-specifier' ELSE 'unresolved-specifier' END, 1 FROM declared) GROUP BY id),
fi AS (SELECT target AS id, count(DISTINCT source) AS k FROM declared GROUP BY target), fo AS (SELECT source AS id, count(DISTINCT target) AS k FROM declared GROUP BY source), ai AS (SELECT dst AS id, count(*) AS k FROM adj GROUP BY dst), ao AS (SELECT src AS id, count(*) AS k FROM adj GROUP BY src),
nodes AS (SELECT n.id, kind, coalesce(fi.k, 0) AS fan_in, coalesce(fo.k, 0) AS fan_out, CASE WHEN kind = 'analyzed-file' THEN coalesce(ai.k, 0) END AS direct_in, CASE WHEN kind = 'analyzed-file' THEN coalesce(ao.k, 0) END AS direct_out
  FROM n LEFT JOIN fi ON fi.id = n.id LEFT JOIN fo ON fo.id = n.id LEFT JOIN ai ON ai.id = n.id LEFT JOIN ao ON ao.id = n.id)"""
TRANSITIVE_SQL = "ri AS (SELECT dst AS id, count(*) AS k FROM reach WHERE src <> dst GROUP BY dst), ro AS (SELECT src AS id, count(*) AS k FROM reach WHERE src <> dst GROUP BY src), transitive AS (SELECT ids.id, coalesce(ri.k, 0) AS transitive_in, coalesce(ro.k, 0) AS transitive_out FROM ids LEFT JOIN ri ON ri.id = ids.id LEFT JOIN ro ON ro.id = ids.id)"
REACH_SQL = "RECURSIVE reach(src, dst) AS (SELECT src, dst FROM adj UNION SELECT r.src, a.dst FROM reach r JOIN adj a ON r.dst = a.src)"
SCC_SQL = "mutual AS (SELECT x.src AS id, min(x.dst) AS m FROM reach x JOIN reach y ON x.src = y.dst AND x.dst = y.src GROUP BY x.src), scc AS (SELECT ids.id, least(ids.id, coalesce(m, ids.id)) AS component FROM ids LEFT JOIN mutual ON mutual.id = ids.id)"


def with_reach(rest: str) -> str:
    return f"WITH RECURSIVE {b.EDGES}, {REACH_SQL.removeprefix('RECURSIVE ')}, {rest}"


@query(f"WITH {b.EDGES}, {NODES_SQL} SELECT * FROM nodes")
def dep_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes(b.graph_files(spark, d), b.graph_edges(spark, d), 2 * b.table(spark, d, "lineitem").count())


def reach_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Files, internal edges, and their closure if it is admitted."""
    adj, files = graph.cut_balanced(graph.adjacency(b.graph_edges(spark, d))), b.graph_files(spark, d)
    status = graph.admission(files, adj)[0]
    return files, adj, graph.closure(adj) if status in ("computed", "not_applicable") else None


@query(f"WITH {b.EDGES}, n AS (SELECT count(*) AS n FROM ids), e AS (SELECT count(*) AS e FROM adj) SELECT lim.name, CASE WHEN n = 0 THEN 'not_applicable' WHEN n > nodes THEN 'size_limit' WHEN n * (1 + e) > work THEN 'work_limit' ELSE 'computed' END AS status, n AS source_files, n * (1 + e) AS work_upper_bound"
  " FROM n, e, (VALUES ('single_node', 10000, 100000000), ('small', 100, 1000000), ('work', 1000000000, 1000), ('cluster', 1000000000, 1000000000000000000)) lim(name, nodes, work)")
def dep_admission(spark: SparkSession, d: str) -> DataFrame:
    """Whether reachability is admitted under several bounds on nodes and work."""
    adj, files = graph.cut_balanced(graph.adjacency(b.graph_edges(spark, d))), b.graph_files(spark, d)
    bounds = (("single_node", graph.NODE_LIMIT, graph.WORK_LIMIT), ("small", 100, 1_000_000), ("work", 10**9, 1000), ("cluster", graph.CLUSTER_NODES, graph.CLUSTER_WORK))
    return spark.createDataFrame([(name, *graph.admission(files, adj, nodes, work)) for name, nodes, work in bounds], "name string, status string, source_files long, work_upper_bound long")


@query(with_reach(f"{TRANSITIVE_SQL} SELECT * FROM transitive"))
def dep_reachability(spark: SparkSession, d: str) -> DataFrame:
    files, _, reach = reach_of(spark, d)
    return graph.reachability(files, reach)


@query(with_reach(f"{SCC_SQL} SELECT * FROM scc"))
def dep_scc(spark: SparkSession, d: str) -> DataFrame:
    files, adj, reach = reach_of(spark, d)
    return graph.strong_components(files, adj, reach)


@query(with_reach(f"{SCC_SQL} SELECT component, list_sort(list(id)) AS members, count(*) AS size FROM scc GROUP BY component HAVING count(*) > 1 OR bool_or(id IN (SELECT src FROM adj WHERE src = dst))"))
def dep_cycles(spark: SparkSession, d: str) -> DataFrame:
    files, adj, reach = reach_of(spark, d)
    return graph.cycles(graph.strong_components(files, adj, reach), adj)


@query(f"""WITH RECURSIVE {b.EDGES}, v AS (SELECT id FROM ids UNION SELECT target FROM declared), both_ways AS (SELECT source AS a, target AS b FROM declared UNION SELECT target, source FROM declared),
w(id, other) AS (SELECT id, id FROM v UNION SELECT w.id, e.b FROM w JOIN both_ways e ON w.other = e.a) SELECT id, min(other) AS component FROM w GROUP BY id""")
def dep_weak_components(spark: SparkSession, d: str) -> DataFrame:
    e = graph.cut_balanced(b.graph_edges(spark, d).select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct())
    v = graph.sized(b.graph_files(spark, d).union(e.select("dst")), e.count(), "id").distinct()
    return graph.weak_components(v, e)


DEPTH_SQL = f"""{SCC_SQL}, dag AS (SELECT DISTINCT x.component AS a, y.component AS b FROM adj JOIN scc x ON x.id = src JOIN scc y ON y.id = dst WHERE x.component <> y.component),
walk(c, depth) AS (SELECT DISTINCT component, 0 FROM scc UNION SELECT b, depth + 1 FROM walk JOIN dag ON a = c)"""


@query(with_reach(f"{DEPTH_SQL} SELECT c AS component, max(depth) AS depth FROM walk GROUP BY c"))
def dep_depth(spark: SparkSession, d: str) -> DataFrame:
    files, adj, reach = reach_of(spark, d)
    return graph.condensation_depth(graph.strong_components(files, adj, reach), adj)


@query(with_reach(f"""{SCC_SQL}, cyc AS (SELECT component, count(*) AS size FROM scc GROUP BY component HAVING count(*) > 1 OR bool_or(id IN (SELECT src FROM adj WHERE src = dst))),
n AS (SELECT count(*) AS n FROM ids), r AS (SELECT count(*) AS r FROM reach WHERE src <> dst), c AS (SELECT count(*) AS cc, CAST(coalesce(sum(size), 0) AS BIGINT) AS cf, coalesce(max(size), 0) AS lc FROM cyc)
SELECT n AS source_files, r AS reachable_pairs, cc AS cyclic_components, cf AS cyclic_files, lc AS largest_cycle, n * (n - 1) AS possible_pairs, {r6("r / nullif(n * (n - 1), 0)::DOUBLE")} AS propagation_fraction,
  {r6("cf / nullif(n, 0)::DOUBLE")} AS cyclic_file_fraction, {r6("lc / nullif(n, 0)::DOUBLE")} AS largest_cycle_fraction FROM n, r, c"""))
def dep_propagation(spark: SparkSession, d: str) -> DataFrame:
    files, adj, reach = reach_of(spark, d)
    return rounded(graph.propagation(files, reach, graph.strong_components(files, adj, reach), adj))


MEASURES = (("fan_in", "fan_out"), ("fan_out", "fan_in"), ("transitive_in", "transitive_out"), ("transitive_out", "transitive_in"))


@query(with_reach(f"{NODES_SQL}, {TRANSITIVE_SQL}, m AS (SELECT nodes.*, transitive_in, transitive_out FROM nodes JOIN transitive USING (id) WHERE kind = 'analyzed-file') "
  + " UNION ALL ".join(f"(SELECT '{p}' AS measure, id, {p} AS primary_value, {s} AS secondary_value FROM m WHERE {p} <> 0 ORDER BY {p} DESC, {s} DESC, id LIMIT 5)" for p, s in MEASURES)))
def dep_hotspots(spark: SparkSession, d: str) -> DataFrame:
    files, _, reach = reach_of(spark, d)
    rows = 2 * b.table(spark, d, "lineitem").count()
    n = graph.sized(graph.nodes(files, b.graph_edges(spark, d), rows).where("kind = 'analyzed-file'"), rows, "id")
    return graph.hotspots(graph.cut_balanced(n.join(graph.sized(graph.reachability(files, reach), rows, "id"), "id")), MEASURES)


@query(f"WITH {b.EDGES}, g AS (SELECT DISTINCT source, target, class, line FROM declared) SELECT class, count(DISTINCT (source, target)) AS edges, count(*) AS declarations FROM g GROUP BY class")
def dep_edge_classes(spark: SparkSession, d: str) -> DataFrame:
    e = graph.grouped_edges(b.graph_edges(spark, d))
    return e.groupBy("class").agg(F.count(F.lit(1)).alias("edges"), F.sum(F.size("evidence")).cast("long").alias("declarations"))


@query(f"""WITH {b.SNAPSHOT}, imports AS (SELECT doc_id, path, CASE doc_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'rust-mod' ELSE 'js' END AS kind, CASE doc_id % 3 WHEN 0 THEN '.' || CAST(doc_id + 1 AS VARCHAR) WHEN 1 THEN CAST(doc_id + 1 AS VARCHAR) ELSE './' || CAST(doc_id + 1 AS VARCHAR) || '.json' END AS specifier,
  regexp_replace(path, '/?[^/]*$', '') AS dir, CAST(doc_id + 1 AS VARCHAR) AS nxt FROM snapshot),
cand AS (SELECT doc_id, unnest(range(len(c))) AS pos, unnest(c) AS cand FROM (SELECT doc_id, CASE kind WHEN 'python' THEN [dir || '/' || nxt || '.py', dir || '/' || nxt || '/__init__.py']
  WHEN 'rust-mod' THEN [regexp_replace(path, '\\.rs$', '') || '/' || nxt || '.rs', regexp_replace(path, '\\.rs$', '') || '/' || nxt || '/mod.rs'] ELSE [dir || '/' || nxt || '.json'] END AS c FROM imports)),
hit AS (SELECT doc_id, arg_min(cand, pos) AS target FROM cand WHERE cand IN (SELECT path FROM snapshot) GROUP BY doc_id)
SELECT doc_id, path, kind, specifier, target FROM imports LEFT JOIN hit USING (doc_id)""")
def import_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Each document imports its successor by the convention of one of three languages."""
    s = b.snapshot_files(spark, d)
    which, after = F.col("doc_id") % 3, (F.col("doc_id") + 1).cast("string")
    i = s.select("doc_id", "path", F.when(which == 0, "python").when(which == 1, "rust-mod").otherwise("js").alias("kind"), F.when(which == 0, F.concat(F.lit("."), after)).when(which == 1, after).otherwise(F.concat(F.lit("./"), after, F.lit(".json"))).alias("specifier"))
    return resolve.resolve(resolve.candidates(i), s, ["doc_id"]).select("doc_id", "path", "kind", "specifier", "target")


TOKENS_SQL = f"""t AS (SELECT doc_id AS file, lang AS language, regexp_split_to_array(trim(text, ' \n\t\r'), '\\s+') AS t FROM documents),
g AS (SELECT file, language, i AS pos, md5(array_to_string(list_slice(t, i, i + {KGRAM - 1}), ' ')) AS digest FROM (SELECT file, language, t, unnest(range(1, len(t) - {KGRAM - 2})) AS i FROM t))"""


def texts_of(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.col("lang").alias("language"), "text")


@query(f"""WITH {TOKENS_SQL} SELECT language, digest, count(*) AS occurrences, count(DISTINCT file) AS files, min({{'file': file, 'pos': pos}}).file AS first_file, min({{'file': file, 'pos': pos}}).pos AS first_pos FROM g GROUP BY language, digest HAVING count(*) > 1""")
def clone_kgrams(spark: SparkSession, d: str) -> DataFrame:
    return clones.repeated(texts_of(spark, d), KGRAM)


@query(f"""WITH {TOKENS_SQL}, c AS (SELECT file, pos, pos + {KGRAM} AS e FROM g WHERE (language, digest) IN (SELECT (language, digest) FROM g GROUP BY language, digest HAVING count(*) > 1)),
m AS (SELECT *, CASE WHEN pos > max(e) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS nw FROM c),
i AS (SELECT *, sum(nw) OVER (PARTITION BY file ORDER BY pos) AS island FROM m), u AS (SELECT file, island, max(e) - min(pos) AS len FROM i GROUP BY file, island)
SELECT file, CAST(sum(len) AS BIGINT) AS mass, count(*) AS islands FROM u GROUP BY file""")
def clone_totals(spark: SparkSession, d: str) -> DataFrame:
    return clones.union_mass(clones.cloned_windows(texts_of(spark, d), KGRAM), "file", "pos", "stop")


@query()
def clone_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of places with equal tokens, of at least 40 tokens."""
    return clones.groups(texts_of(spark, d), KGRAM)


ROLES_SQL = f"""{b.SNAPSHOT}, roles AS (SELECT path, size, regexp_replace(path, '/?[^/]*$', '') AS directory, CASE WHEN doc_id % 7 = 3 THEN 'test' WHEN doc_id % 7 IN (0, 6) THEN 'source' END AS role,
  CASE doc_id % 7 WHEN 3 THEN CAST(doc_id // 10 AS VARCHAR) ELSE CAST(doc_id // 10 AS VARCHAR) END AS stem FROM snapshot WHERE doc_id % 7 IN (0, 3, 6))"""


def roles_of(spark: SparkSession, d: str) -> DataFrame:
    """Source and test files; stems are tens of documents, so that some are unique and some are not."""
    s = b.snapshot_files(spark, d).withColumns({"lang": paths.language(F.col("path")), "directory": paths.parent(F.col("path"))})
    # each step is a column of its own: nested in one another they grow beyond what can be compiled
    s = s.where(F.col("lang").isNotNull() & ~F.col("path").endswith(".min.js")).withColumn("test", paths.is_test_file(F.col("path"), F.col("lang")))
    s = s.withColumn("stemmed", F.concat("directory", F.lit("/"), F.floor(F.col("doc_id") / 10).cast("string"), b.suffix(F.col("doc_id"))))
    return s.select("path", "size", "directory", F.when(F.col("test"), "test").otherwise("source").alias("role"), paths.canonical_stem(F.col("stemmed"), F.col("test")).alias("stem"))


MATCH_SQL = f"""WITH {ROLES_SQL}, src AS (SELECT * FROM roles WHERE role = 'source'), tst AS (SELECT * FROM roles WHERE role = 'test'),
di AS (SELECT directory, stem, min(path) AS p FROM src GROUP BY directory, stem HAVING count(*) = 1), an AS (SELECT stem, min(path) AS p FROM src GROUP BY stem HAVING count(*) = 1),
m AS (SELECT t.path, t.stem, coalesce(di.p, an.p) AS source_path FROM tst t LEFT JOIN di ON di.directory = t.directory AND di.stem = t.stem LEFT JOIN an ON an.stem = t.stem)"""


@query(MATCH_SQL + " SELECT * FROM m")
def stem_match(spark: SparkSession, d: str) -> DataFrame:
    r = roles_of(spark, d)
    return resolve.match_stems(r.where("role = 'source'"), r.where("role = 'test'"))


@query(MATCH_SQL + " SELECT path, 'test' AS role FROM m WHERE source_path IS NULL UNION ALL SELECT path, 'source' FROM src WHERE path NOT IN (SELECT source_path FROM m WHERE source_path IS NOT NULL)")
def unmatched_tests(spark: SparkSession, d: str) -> DataFrame:
    r = roles_of(spark, d)
    m = resolve.match_stems(r.where("role = 'source'"), r.where("role = 'test'"))
    alone = r.where("role = 'source'").join(m.select(F.col("source_path").alias("__m")), F.col("path") == F.col("__m"), "left_anti").select("path", "role")
    return m.where("source_path is null").select("path", F.lit("test").alias("role")).union(alone)


@query(MATCH_SQL + f"""SELECT count(*) FILTER (role = 'source') AS source_files, count(*) FILTER (role = 'test') AS test_files, CAST(sum(size) FILTER (role = 'source') AS BIGINT) AS source_bytes, CAST(sum(size) FILTER (role = 'test') AS BIGINT) AS test_bytes,
  {r6("sum(size) FILTER (role = 'test') / nullif(sum(size) FILTER (role = 'source'), 0)::DOUBLE")} AS test_to_source_bytes, {r6("count(*) FILTER (role = 'test') / nullif(count(*) FILTER (role = 'source'), 0)::DOUBLE")} AS test_to_source_files,
  (SELECT count(source_path) FROM m) AS matched_tests FROM roles""")
def test_coverage(spark: SparkSession, d: str) -> DataFrame:
    r = roles_of(spark, d)
    of = lambda k, e: F.sum(F.when(F.col("role") == k, e)).cast("long")
    t = r.agg(F.count_if(F.col("role") == "source").alias("source_files"), F.count_if(F.col("role") == "test").alias("test_files"), of("source", F.col("size")).alias("source_bytes"), of("test", F.col("size")).alias("test_bytes"))
    m = resolve.match_stems(r.where("role = 'source'"), r.where("role = 'test'")).agg(F.count("source_path").alias("matched_tests"))
    t = t.withColumns({"test_to_source_bytes": scalars.ratio(F.col("test_bytes"), F.col("source_bytes")), "test_to_source_files": scalars.ratio(F.col("test_files"), F.col("source_files"))})
    return rounded(t.crossJoin(F.broadcast(m)))


@query(f"""SELECT lang AS language, count(*) AS symbols, count(*) FILTER (doc_id % 5 = 0) AS functions, count(*) FILTER (doc_id % 5 = 1) AS types, count(*) FILTER (doc_id % 5 = 2) AS constants, count(*) FILTER (doc_id % 5 > 2) AS other,
  count(l.doc_id) AS documented, {r6("count(*) * 1000 / nullif(sum(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')))), 0)::DOUBLE")} AS public_symbols_per_ksloc FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY lang""")
def api_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents as symbols: the kind by the id, documented where labelled; ex-ports of no kind count as other."""
    docs = b.table(spark, d, "documents").select("doc_id", "lang", scalars.nonblank_lines(F.col("text")).alias("lines"))
    j = docs.join(b.table(spark, d, "labels").select(F.col("doc_id").alias("__l")), F.col("doc_id") == F.col("__l"), "left")
    kind = F.col("doc_id") % 5
    return rounded(j.groupBy(F.col("lang").alias("language")).agg(
        F.count(F.lit(1)).alias("symbols"), F.count_if(kind == 0).alias("functions"), F.count_if(kind == 1).alias("types"), F.count_if(kind == 2).alias("constants"), F.count_if(kind > 2).alias("other"),
        F.count("__l").alias("documented"), scalars.ratio_or_zero(F.count(F.lit(1)) * 1000, F.sum("lines")).alias("public_symbols_per_ksloc"),
    ))


@query(f"""WITH {b.RECEIPTS} SELECT run, max(elapsed_ns) FILTER (ordinal = 0) AS first_ns, count(*) FILTER (ordinal > 0) AS samples, min(elapsed_ns) FILTER (ordinal > 0) AS min_ns, quantile_disc(elapsed_ns, 0.5) FILTER (ordinal > 0) AS p50_ns, quantile_disc(elapsed_ns, 0.95) FILTER (ordinal > 0) AS p95_ns,
  quantile_disc(elapsed_ns, 0.99) FILTER (ordinal > 0) AS p99_ns, max(elapsed_ns) FILTER (ordinal > 0) AS max_ns, CAST(sum(elapsed_ns) FILTER (ordinal > 0) // nullif(count(*) FILTER (ordinal > 0), 0) AS BIGINT) AS mean_ns FROM receipts GROUP BY run""")
def bench_latency(spark: SparkSession, d: str) -> DataFrame:
    return receipts.latency(b.receipts(spark, d))


@query(f"""WITH {b.RECEIPTS}, r AS (SELECT run, 1000.0::DOUBLE * 1e9 / greatest(elapsed_ns, 1) AS r FROM receipts WHERE ordinal > 0)
SELECT run, count(*) AS samples, round(min(r), 3) AS min_rate, round(quantile_disc(r, 0.5), 3) AS p50_rate, round(quantile_disc(r, 0.95), 3) AS p95_rate, round(quantile_disc(r, 0.99), 3) AS p99_rate, round(max(r), 3) AS max_rate FROM r GROUP BY run""")
def bench_rates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(receipts.rates(b.receipts(spark, d), 1000), 3)


@query(f"""WITH {b.RECEIPTS} SELECT event_type, CAST(sum(elapsed_ns) AS BIGINT) AS elapsed_ns, CASE WHEN count(*) = count(CASE WHEN event_type <> 'error' THEN 1 END) THEN count(*) END AS units, max(elapsed_ns) AS peak_ns FROM receipts GROUP BY event_type""")
def receipt_totals(spark: SparkSession, d: str) -> DataFrame:
    r = b.receipts(spark, d).select("event_type", "elapsed_ns", F.when(F.col("event_type") != "error", F.lit(1).cast("long")).alias("units"), F.col("elapsed_ns").alias("peak_ns"))
    return receipts.totals(r, "event_type", ["elapsed_ns"], ["units"], ["peak_ns"])


@query("SELECT user_id AS analysis_id, count(*) AS events, arg_max(event_type, (ts, event_id)) AS state, max(event_id) FILTER (TRUE) AS last_event FROM events GROUP BY user_id")
def job_latest_state(spark: SparkSession, d: str) -> DataFrame:
    e = b.table(spark, d, "events").select(F.col("user_id").alias("analysis_id"), F.col("event_type").alias("state"), "ts", "event_id")
    last = e.groupBy("analysis_id").agg(F.max("event_id").alias("last_event"))
    return receipts.latest(e, "analysis_id", ["ts", "event_id"], ["state"]).join(last, "analysis_id")


@query("SELECT conv_id AS id, count(*) AS records FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def audit_duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return audit.duplicate_ids(b.table(spark, d, "conversations").select(F.col("conv_id").alias("id")))


@query("""WITH t AS (SELECT 'see r-' || CAST(doc_id AS VARCHAR) || '., and r-x' || CAST(doc_id % 50 AS VARCHAR) || '!' AS t FROM labels), f AS (SELECT unnest(regexp_extract_all(t, '\\br-[A-Za-z0-9][A-Za-z0-9_./-]*')) AS raw FROM t),
refs AS (SELECT DISTINCT regexp_replace(raw, '[.,;:!?]+$', '') AS ref FROM f) SELECT ref FROM refs WHERE ref NOT IN (SELECT 'r-' || CAST(doc_id AS VARCHAR) || (CASE WHEN doc_id % 7 = 0 THEN '-renamed' ELSE '' END) FROM documents)""")
def audit_dangling_refs(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("see r-"), F.col("doc_id").cast("string"), F.lit("., and r-x"), (F.col("doc_id") % 50).cast("string"), F.lit("!"))
    refs = audit.references(b.table(spark, d, "labels").select(text.alias("text"))).select("ref")
    known = b.table(spark, d, "documents").select(F.concat(F.lit("r-"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, F.lit("-renamed")).otherwise(F.lit(""))).alias("id"))
    return audit.dangling(refs, known)


@query("""WITH r AS (SELECT conv_id, turn, role AS instrument, CASE WHEN turn % 3 = 0 THEN 'repo@' || substr(md5(text), 1, 8) WHEN turn % 3 = 1 THEN 'repo@12' ELSE 'a@' || substr(md5(text), 1, 7) || ' vs b@' || substr(md5(text), 9, 7) END AS artifact,
  CASE WHEN conv_id % 4 = 0 THEN '../up.md' ELSE 'docs/p.md#x' END AS procedure, '20' || lpad(CAST(conv_id % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(conv_id % 14 AS VARCHAR), 2, '0') || '-10T10:00:00Z' AS ts FROM conversations)
SELECT code, count(*) AS issues FROM (SELECT unnest(list_filter([CASE WHEN instrument NOT IN ('mechanical', 'empirical', 'judged') THEN 'invalid_instrument' END,
  CASE WHEN NOT regexp_matches(artifact, '^[^\\s@]+@[0-9a-fA-F]{7,}( vs [^\\s@]+@[0-9a-fA-F]{7,})?$') THEN 'invalid_artifact_identity' END, CASE WHEN procedure LIKE '../%' THEN 'unsafe_reference' END,
  CASE WHEN CAST(substr(ts, 6, 2) AS INTEGER) NOT BETWEEN 1 AND 12 THEN 'invalid_timestamp' END], lambda x: x IS NOT NULL)) AS code FROM r) GROUP BY code""")
def audit_field_issues(spark: SparkSession, d: str) -> DataFrame:
    c = b.table(spark, d, "conversations")
    m = F.md5("text")
    artifact = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("repo@"), F.substring(m, 1, 8))).when(F.col("turn") % 3 == 1, F.lit("repo@12")).otherwise(F.concat(F.lit("a@"), F.substring(m, 1, 7), F.lit(" vs b@"), F.substring(m, 9, 7)))
    two = lambda e: F.lpad(e.cast("string"), 2, "0")
    r = c.select(
        F.lit(1).alias("line"), F.concat(F.lit("r-"), F.col("conv_id").cast("string")).alias("id"), F.col("role").alias("instrument"), artifact.alias("artifact"), F.when(F.col("conv_id") % 4 == 0, "../up.md").otherwise("docs/p.md#x").alias("procedure"),
        F.concat(F.lit("20"), two(F.col("conv_id") % 100), F.lit("-"), two(F.col("conv_id") % 14), F.lit("-10T10:00:00Z")).alias("ts"),
    )
    return audit.field_issues(r).groupBy("code").agg(F.count(F.lit(1)).alias("issues"))


@query("SELECT role AS instrument, count(*) AS records FROM conversations GROUP BY role")
def audit_instrument_counts(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "conversations").groupBy(F.col("role").alias("instrument")).agg(F.count(F.lit(1)).alias("records"))


H = lambda p: f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN 0 ELSE -({p}) * log2({p}) - (1 - ({p})) * log2(1 - ({p})) END)"
METRICS_SQL = f"""WITH {b.PLAN}, j AS (SELECT p.*, prior_probability AS pi, false_positive_loss AS lp, false_negative_loss AS ln_, importance, prior_probability * sensitivity AS tp, (1 - prior_probability) * (1 - specificity) AS fp,
  prior_probability * (1 - sensitivity) AS fn, (1 - prior_probability) * specificity AS tn FROM probes p JOIN claims c ON c.id = p.claim_id),
q AS (SELECT *, tp + fp AS pos, 1 - (tp + fp) AS neg, coalesce(tp / nullif(tp + fp, 0), pi) AS post1, coalesce(fn / nullif(fn + tn, 0), pi) AS post0 FROM j),
m AS (SELECT id, claim_id, importance, expected_usd, expected_seconds, pos AS positive_probability, post1 AS posterior_positive, post0 AS posterior_negative, greatest(0, {H("pi")} - pos * {H("post1")} - neg * {H("post0")}) AS information_bits,
  greatest(0, least((1 - pi) * lp, pi * ln_) - least(fp * lp, tp * ln_) - least(tn * lp, fn * ln_)) AS risk_reduction,
  (CASE WHEN ((1 - post1) * lp < post1 * ln_) <> ((1 - pi) * lp < pi * ln_) THEN pos ELSE 0 END) + (CASE WHEN ((1 - post0) * lp < post0 * ln_) <> ((1 - pi) * lp < pi * ln_) THEN neg ELSE 0 END) AS decision_flip_probability FROM q)"""


@query(METRICS_SQL + " SELECT id, claim_id, " + ", ".join(f"{r6(c)} AS {c}" for c in ("importance", "expected_usd", "expected_seconds", "positive_probability", "posterior_positive", "posterior_negative", "information_bits", "risk_reduction", "decision_flip_probability"))
  + f", {r6('information_bits / nullif(expected_usd, 0)')} AS bits_per_usd, {r6('information_bits / nullif(expected_seconds, 0)')} AS bits_per_second FROM m")
def probe_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(planner.probe_metrics(b.claims(spark, d), b.probes(spark, d)))


@query(METRICS_SQL + """, v AS (SELECT id, round(importance * information_bits, 9) AS i, round(importance * risk_reduction, 9) AS r, expected_usd AS u, expected_seconds AS s FROM m)
SELECT id FROM v WHERE (i > 0 OR r > 0) AND NOT EXISTS (SELECT 1 FROM v o WHERE o.i >= v.i AND o.r >= v.r AND o.u <= v.u AND o.s <= v.s AND (o.i > v.i OR o.r > v.r OR o.u < v.u OR o.s < v.s))""")
def pareto_frontier(spark: SparkSession, d: str) -> DataFrame:
    w = planner.weighted(planner.probe_metrics(b.claims(spark, d), b.probes(spark, d)))
    return planner.frontier(w.withColumns({"information": F.round("information", 9), "risk": F.round("risk", 9)})).select("id")


@query(f"""WITH {b.PLAN}, g AS (SELECT claim_id, list({{'s': sensitivity, 'c': specificity}} ORDER BY id) AS ps FROM probes GROUP BY claim_id),
m AS (SELECT claim_id, ps, unnest(range(0, CAST(2 ** len(ps) AS BIGINT))) AS mask FROM g),
o AS (SELECT claim_id, mask, list_product(list_transform(ps, lambda x, i: CASE WHEN (mask >> (i - 1)) & 1 = 1 THEN x.s ELSE 1 - x.s END)) AS a, list_product(list_transform(ps, lambda x, i: CASE WHEN (mask >> (i - 1)) & 1 = 1 THEN 1 - x.c ELSE x.c END)) AS z FROM m),
q AS (SELECT claim_id, c.prior_probability * a AS t, (1 - c.prior_probability) * z AS f, c.* FROM o JOIN claims c ON c.id = o.claim_id),
s AS (SELECT claim_id, any_value(prior_probability) AS pi, any_value(false_positive_loss) AS lp, any_value(false_negative_loss) AS ln_, count(*) AS outcomes, sum(CASE WHEN t + f > 0 THEN (t + f) * {H("(t / (t + f))")} ELSE 0 END) AS after_, sum(least(f * false_positive_loss, t * false_negative_loss)) AS cost FROM q GROUP BY claim_id)
SELECT claim_id, outcomes, {r6(f"greatest(0, {H('pi')} - after_)")} AS information_bits, {r6("greatest(0, least((1 - pi) * lp, pi * ln_) - cost)")} AS risk_reduction FROM s""")
def joint_information(spark: SparkSession, d: str) -> DataFrame:
    return rounded(planner.joint_metrics(b.claims(spark, d), b.probes(spark, d)))


@query()
def greedy_plan(spark: SparkSession, d: str) -> DataFrame:
    """The plan for the claims and probes of the test tables within 4 dollars, 60 seconds and 6 probes."""
    c, p = ([r.asDict() for r in x.orderBy("id").collect()] for x in (b.claims(spark, d), b.probes(spark, d)))
    steps, why = planner.greedy_plan(c, p, planner.Budget(4.0, 60.0, 6), "information_per_usd")
    schema = "ordinal int, probe_id string, claim_id string, marginal_information_bits double, marginal_risk_reduction double, cumulative_information_bits double, cumulative_expected_risk_reduction double, cumulative_usd double, cumulative_seconds double, candidate_frontier array<string>, stopped_reason string"
    return spark.createDataFrame([(*s.values(), why) for s in steps], schema)


from tessera.plans import ingest as _ingest  # noqa: E402, F401  (registers its queries)
