"""Audits of evaluation bundles: record lines, references of a report, and the issues they raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import artifact_identity, plausible_rfc3339, safe_reference

FIELDS = ["id", "artifact", "axis", "instrument", "procedure", "evidence", "verdict", "integrity"]
INSTRUMENTS = ["mechanical", "empirical", "judged"]
REFERENCE = r"\br-[A-Za-z0-9][A-Za-z0-9_./-]*"
SCHEMA = "line int, id string, code string, severity string"


def record_lines(files: DataFrame) -> DataFrame:
    """(line, raw) of the lines of a JSONL file held in column ``text``."""
    return files.select(F.posexplode(F.split("text", "\r?\n")).alias("p", "raw")).select((F.col("p") + 1).alias("line"), "raw")


def parsed(lines: DataFrame) -> DataFrame:
    """Nonblank ``lines`` (line, raw) with the JSON value of each; json is null where a line is not an object."""
    some = lines.where(r"raw rlike '\\S'").withColumn("json", F.expr("try_parse_json(raw)"))
    return some.withColumn("json", F.when(F.expr("schema_of_variant(json) like 'OBJECT%'"), F.col("json")))


def records(lines: DataFrame) -> DataFrame:
    """The fields of each parsed line as strings (null unless a JSON string), with agent and time."""
    ways = [*FIELDS, "agent.kind", "agent.id", "ts"]
    part = lambda w: F.expr(f"try_variant_get(json, '$.{w}', 'variant')")
    kept = lines.where("json is not null").select("line", *(part(w).alias(w.replace(".", "_")) for w in ways))
    text = lambda c: F.when(F.expr(f"schema_of_variant({c}) = 'STRING'"), F.expr(f"try_variant_get({c}, '$', 'string')")).alias(c)
    return kept.select("line", *(text(w.replace(".", "_")) for w in ways), F.expr("schema_of_variant(ts)").alias("ts_type"))


def references(reports: DataFrame, text: str = "text") -> DataFrame:
    """(ref, line): record references of a report with trailing punctuation cut, at their first line."""
    lines = reports.select(F.posexplode(F.split(F.col(text), "\n")).alias("p", "t"))
    found = lines.select((F.col("p") + 1).alias("line"), F.explode(F.regexp_extract_all("t", F.lit(REFERENCE), 0)).alias("raw"))
    return found.select(F.regexp_replace("raw", r"[.,;:!?]+$", "").alias("ref"), "line").groupBy("ref").agg(F.min("line").alias("line"))


def dangling(refs: DataFrame, known: DataFrame) -> DataFrame:
    return refs.join(known.select(F.col("id").alias("__known")).distinct(), F.col("ref") == F.col("__known"), "left_anti")


def _present(c: str) -> Column:
    return F.col(c).isNotNull() & (F.trim(c) != "")


def field_issues(r: DataFrame) -> DataFrame:
    """One row for each issue that a record raises by itself."""
    issue = lambda when, code, severity="error": F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    cols = set(r.columns)
    checks = [
        issue(~_present("id"), "missing_record_id"),
        *(issue(~_present(f), "invalid_record_field") for f in FIELDS if f in cols and f != "id"),
        issue(_present("instrument") & ~F.col("instrument").isin(INSTRUMENTS), "invalid_instrument"),
        issue(_present("artifact") & ~artifact_identity(F.col("artifact")), "invalid_artifact_identity"),
        *(issue(_present(f) & ~safe_reference(F.col(f)), "unsafe_reference") for f in ("procedure", "evidence") if f in cols),
        issue(F.col("ts").isNotNull() & ~F.coalesce(plausible_rfc3339(F.col("ts")), F.lit(False)), "invalid_timestamp"),
    ]
    if "ts_type" in cols:
        checks.append(issue(F.col("ts").isNull() & F.coalesce(F.col("ts_type") != "VOID", F.lit(True)), "invalid_timestamp"))
    if "agent_kind" in cols:
        checks.append(issue(~_present("agent_kind") | ~_present("agent_id"), "invalid_agent"))
        checks.append(issue((F.col("instrument") == "judged") & ~F.coalesce(F.col("procedure").rlike("#"), F.lit(False)), "exact_prompt_unproven", "warning"))
    found = F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull()))
    return r.select("line", "id", found.alias("i")).select("line", "id", "i.code", "i.severity")


def duplicate_ids(r: DataFrame, key: str = "id") -> DataFrame:
    return r.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("records")).where("records > 1")


def required(files: DataFrame, known: DataFrame) -> DataFrame:
    """Issues of the files a bundle must have: ``known`` (path, content as bytes) against ``files`` (path)."""
    both = files.select(F.col("path").alias("__p")).join(known, F.col("path") == F.col("__p"), "left")
    code = F.when(F.col("path").isNull(), "missing_required_file").when(F.octet_length("content") == 0, "empty_required_file").when(F.col("__p").endswith(".md") & ~F.expr("is_valid_utf8(cast(content as string))"), "invalid_report_encoding")
    return both.select(F.lit(None).cast("int").alias("line"), F.col("__p").alias("id"), code.alias("code"), F.lit("error").alias("severity")).where("code is not null")


def audit(lines: DataFrame, reports: DataFrame) -> DataFrame:
    """All issues of record ``lines`` (line, raw) and of the ``reports`` (text) that cite them, errors and warnings; an empty result is a clean bundle."""
    lines = parsed(lines)
    r = records(lines)
    bad = lines.where("json is null").select("line", F.lit(None).cast("string").alias("id"), F.lit("invalid_json_record").alias("code"), F.lit("error").alias("severity"))
    first = r.where(_present("id")).groupBy(F.col("id").alias("__id")).agg(F.min("line").alias("__line"), F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = r.join(first, (F.col("id") == F.col("__id")) & (F.col("line") > F.col("__line"))).select("line", "id", F.lit("duplicate_record_id").alias("code"), F.lit("error").alias("severity"))
    lost = dangling(references(reports), r.where("id is not null")).select("line", F.col("ref").alias("id"), F.lit("unknown_report_record").alias("code"), F.lit("error").alias("severity"))
    none = r.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("id"), F.lit("no_valid_records").alias("code"), F.lit("error").alias("severity"))
    return bad.unionByName(field_issues(r)).unionByName(twice).unionByName(lost).unionByName(none)
