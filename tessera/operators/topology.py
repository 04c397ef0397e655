"""Change topology over commit files (commit, ts, path, line_mass, is_text, is_binary)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.paths import category, top_level
from tessera.functions.scalars import choose_two, ratio
from tessera.operators import dist
from tessera.plans.checkpoints import cut


def merged(raw: DataFrame) -> DataFrame:
    """One row for each (commit, path): masses add up, flags are or-ed, combined before the shuffle."""
    rows = raw.groupBy("commit", "path")
    return rows.agg(F.max("ts").alias("ts"), F.sum(F.when(F.col("is_binary"), 0).otherwise(F.col("line_mass"))).cast("long").alias("line_mass"), F.bool_or("is_text").alias("is_text"), F.bool_or("is_binary").alias("is_binary"))


def countable(raw: DataFrame) -> DataFrame:
    """Unmerged changes with no mass for binary ones: sums by path are those of :func:`merged`, without a group for each commit and path."""
    return raw.withColumn("line_mass", F.when(F.col("is_binary"), 0).otherwise(F.col("line_mass")).cast("long"))


def window_of_commits(files: DataFrame, newest: int, order: str = "ts") -> DataFrame:
    """The newest commits with their places, and whether there were more: takes newest + 1 and keeps the last as a sentinel."""
    commits = files.groupBy("commit").agg(F.max(order).alias(order))
    taken = commits.orderBy(F.col(order).desc(), F.col("commit").desc()).limit(newest + 1)
    place = F.row_number().over(Window.orderBy(F.col(order).desc(), F.col("commit").desc()))  # over newest + 1 rows
    ranked = taken.withColumn("place", place)
    more = ranked.agg((F.max("place") > newest).alias("truncated"))
    return ranked.where(F.col("place") <= newest).crossJoin(F.broadcast(more))


def per_commit(files: DataFrame) -> DataFrame:
    """Files, components, kinds of files and same-component pairs of each commit."""
    f = files.select("commit", F.col("path"), "is_binary", top_level(F.col("path")).alias("component"), category(F.col("path")).alias("category"))
    within = f.groupBy("commit", "component").agg(F.count(F.lit(1)).alias("n"), F.bool_or("is_binary").alias("b"), *(F.bool_or(F.col("category") == c).alias(f"has_{c}") for c in ("source", "test", "documentation")))
    kinds = [F.bool_or(f"has_{c}").alias(f"has_{c}") for c in ("source", "test", "documentation")]
    return within.groupBy("commit").agg(F.sum("n").alias("files"), F.count(F.lit(1)).alias("components"), F.sum(choose_two(F.col("n"))).alias("same_pairs"), F.bool_or("b").alias("has_binary"), *kinds)


def summary(files: DataFrame) -> DataFrame:
    """One row of counts, the files-per-commit distribution, and cochange rates."""
    files = cut(files)
    c = per_commit(files)
    ps = {"p50": 0.5, "p90": 0.9}
    out = c.agg(
        F.count(F.lit(1)).alias("commits_analyzed"),
        F.count_if("has_binary").alias("commits_with_binary_changes"),
        F.avg("files").alias("files_changed_mean"),
        *(F.expr(f"percentile_disc({p}) within group (order by files)").cast("long").alias(f"files_changed_{n}") for n, p in ps.items()),
        F.max("files").alias("files_changed_max"),
        F.sum(choose_two(F.col("files"))).alias("pairs"),
        F.sum("same_pairs").alias("same_component_pairs"),
        F.count_if(F.col("components") >= 3).alias("broad_commits"),
        F.count_if("has_source").alias("source_commits"),
        F.count_if(F.col("has_source") & F.col("has_test")).alias("source_test_commits"),
        F.count_if(F.col("has_source") & F.col("has_documentation")).alias("source_documentation_commits"),
    )
    paths = files.groupBy("path").agg(F.sum("line_mass").alias("m")).agg(F.count(F.lit(1)).alias("unique_changed_files"), F.sum("m").alias("total_line_change_mass"))
    out = out.crossJoin(F.broadcast(paths))
    return out.withColumns(
        {
            "cross_top_level_pair_ratio": ratio(F.col("pairs") - F.col("same_component_pairs"), F.col("pairs")),
            "broad_commit_rate": ratio(F.col("broad_commits"), F.col("commits_analyzed")),
            "source_test_cochange_rate": ratio(F.col("source_test_commits"), F.col("source_commits")),
            "source_documentation_cochange_rate": ratio(F.col("source_documentation_commits"), F.col("source_commits")),
        }
    )


def hotspots(files: DataFrame) -> DataFrame:
    """Change mass of each path that has any."""
    return files.groupBy("path").agg(F.sum("line_mass").alias("mass")).where("mass > 0")


def concentration(files: DataFrame) -> DataFrame:
    """Entropy, effective files, top-decile share and largest hotspot of the change mass."""
    h = cut(hotspots(files))
    e = dist.entropy(h, "mass").withColumnsRenamed({"normalized_entropy": "normalized_change_mass_entropy", "effective_count": "effective_hotspot_files"})
    top = dist.top_share(h, "mass").withColumnRenamed("top_share", "top_decile_change_mass_share")
    big = dist.largest(h, "mass", "path").withColumnsRenamed({"largest": "largest_hotspot_mass", "largest_path": "largest_hotspot_path"})
    return e.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(big))


def history_by_path(files: DataFrame) -> DataFrame:
    """What each path's history amounts to: commits, UTC days, text and binary changes, mass, first and last time."""
    return files.groupBy("path").agg(
        F.count_distinct("commit").alias("commits_touched"),
        F.count_distinct(F.floor(F.col("ts") / 86400)).alias("active_change_days"),
        F.count_if("is_text").alias("text_commits_touched"),
        F.count_if("is_binary").alias("binary_change_count"),
        F.sum("line_mass").alias("line_change_mass"),
        F.min("ts").alias("first_observed_change_unix_seconds"),
        F.max("ts").alias("last_observed_change_unix_seconds"),
    )


HISTORY = ["commits_touched", "active_change_days", "text_commits_touched", "binary_change_count", "line_change_mass"]


def profile(current: DataFrame, files: DataFrame) -> DataFrame:
    """Current files (path, language, current_sloc, current_cognitive, current_cyclomatic) joined with their history; history without a file is kept.

    join_status is matched, current_without_history or history_only. Counts of files without history are 0 and their times null.
    """
    commits = files.agg(F.count_distinct("commit").alias("__commits"))
    h = history_by_path(files).withColumn("__h", F.lit(True))
    j = current.withColumn("__c", F.lit(True)).join(h, "path", "full_outer").crossJoin(F.broadcast(commits))
    status = F.when(F.col("__c").isNull(), "history_only").when(F.col("__h").isNull(), "current_without_history").otherwise("matched")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in HISTORY}
    j = j.withColumns({"join_status": status, **zero})
    text, binary = F.col("text_commits_touched") > 0, F.col("binary_change_count") > 0
    kind = F.when(text & binary, "text_and_binary").when(binary, "binary_only").when(text, "text").otherwise("none")
    return j.withColumns(
        {
            "commit_touch_fraction": ratio(F.col("commits_touched"), F.col("__commits")),
            "cognitive_per_ksloc": ratio(F.col("current_cognitive") * 1000, F.col("current_sloc")),
            "line_change_mass_complete": ~binary,
            "line_change_mass_per_current_sloc": F.when(~binary, ratio(F.col("line_change_mass"), F.col("current_sloc"))),
            "history_status": kind,
        }
    ).drop("__c", "__h", "__commits")


def join_coverage(profiled: DataFrame) -> DataFrame:
    """Counts of the join's parts; they must close, or the query fails."""
    c = profiled.agg(
        F.count_if(F.col("join_status") != "history_only").alias("current_files"),
        F.count_if(F.col("join_status") != "current_without_history").alias("history_files"),
        F.count_if(F.col("join_status") == "matched").alias("matched_files"),
        F.count_if(F.col("join_status") == "current_without_history").alias("current_without_history_files"),
        F.count_if(F.col("join_status") == "history_only").alias("history_only_files"),
        F.count_if((F.col("join_status") != "history_only") & (F.col("binary_change_count") > 0)).alias("binary_touched_current_files"),
    )
    closes = (F.col("matched_files") + F.col("current_without_history_files") == F.col("current_files")) & (F.col("matched_files") + F.col("history_only_files") == F.col("history_files"))
    return c.withColumn("current_files", F.when(closes, F.col("current_files")).otherwise(F.raise_error(F.lit("join coverage does not close")).cast("long")))
