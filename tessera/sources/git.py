"""Git output as DataFrames: commit logs with numstat, tree listings, and a snapshot of a repository.

The texts are read as records (a commit, a tree entry) and taken apart by column expressions; only paths that git has quoted go through a UDF. A malformed record
is a row with ``error`` set, so no record is lost silently. Commands run on the driver, where the repository lies, and write to a file when given one that the
executors can read.
"""

from __future__ import annotations

import subprocess

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.plans.checkpoints import parts

LOG_FORMAT = ["log", "--no-merges", "--no-renames", "--format=%x1e%H%x00%ct%x00", "--numstat"]
ESCAPES = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, "\\": 92, '"': 34}


def decode_quoted(path: str | None) -> bytes | None:
    """The bytes of a path as git prints it; None if its quoting is broken."""
    if path is None or not path.startswith('"'):
        return None if path is None else path.encode()
    if len(path) < 2 or not path.endswith('"'):
        return None
    body, out, k = path[1:-1], bytearray(), 0
    while k < len(body):
        if body[k] != "\\":
            out += body[k].encode()
            k += 1
            continue
        if k + 1 == len(body):
            return None
        x = body[k + 1]
        if x in ESCAPES:
            out.append(ESCAPES[x])
            k += 2
        elif x in "01234567":
            end = k + 2
            while end < min(k + 4, len(body)) and body[end] in "01234567":
                end += 1
            value = int(body[k + 1 : end], 8)
            if value > 255:
                return None
            out.append(value)
            k = end
        else:
            return None
    return bytes(out) or None


def display(path: bytes | None) -> str | None:
    """A path for people: as it is if it is UTF-8, else with bytes outside visible ASCII as escapes."""
    if path is None:
        return None
    try:
        return path.decode()
    except UnicodeDecodeError:
        return "".join("\\\\" if b == 92 else chr(b) if 33 <= b <= 126 else f"\\x{b:02x}" for b in path)


@F.pandas_udf(StringType())
def _unquoted(paths: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else display(decode_quoted(p)) for p in paths], paths.index, dtype=object)


def plain_path(path: Column) -> Column:
    """The display form of a path as git prints it; null if its quoting is broken or it is empty."""
    return F.when(path.startswith('"'), _unquoted(F.when(path.startswith('"'), path))).when(path != "", path)


def parse_log(sections: DataFrame, known: int = 0) -> DataFrame:
    """(commit, ts, path, line_mass, is_text, is_binary, error) from ``sections`` (value): what lies between record separators. Rows of one path and commit are merged;
    a commit without files is a row with a null path. ``known`` tells about how many rows there are."""
    s = sections.where(F.trim(F.translate("value", "\n\r\t", "   ")) != "")
    head = F.split("value", "\x00", 3)
    commit, ts = F.get(head, F.lit(0)), F.expr("try_cast(get(split(value, '\\\\x00', 3), 1) as bigint)")
    good = commit.rlike(r"\A(?:[0-9a-fA-F]{40}|[0-9a-fA-F]{64})\z")
    wrong = F.when(F.size(head) < 3, "header").when(~good, "object id").when(ts.isNull(), "timestamp")
    lines = F.filter(F.transform(F.split(F.coalesce(F.get(head, F.lit(2)), F.lit("")), "\n"), lambda x: F.when(x.endswith("\r"), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x)), lambda x: x != "")
    rows = s.select(F.when(good, commit).alias("commit"), ts.alias("ts"), wrong.alias("error"), F.explode_outer(F.when(wrong.isNull(), lines)).alias("line"))
    f = F.split("line", "\t", 3)
    rows = rows.withColumns({"a": F.get(f, F.lit(0)), "d": F.get(f, F.lit(1)), "raw": F.get(f, F.lit(2))})
    binary = (F.col("a") == "-") & (F.col("d") == "-")
    number = lambda c: F.when(F.col(c).rlike(r"\A[0-9]+\z"), F.expr(f"try_cast({c} as bigint)"))
    mass = F.when(binary, F.lit(0).cast("long")).otherwise(number("a") + number("d"))
    rows = rows.select("commit", "ts", plain_path(F.col("raw")).alias("path"), mass.alias("line_mass"), (~binary).alias("is_text"), binary.alias("is_binary"), F.coalesce("error", F.when(F.col("line").isNotNull() & (mass.isNull() | F.coalesce(F.col("raw") == "", F.lit(True))), "numstat")).alias("error"), "line")
    rows = rows.withColumn("error", F.coalesce("error", F.when(F.col("line").isNotNull() & F.col("path").isNull(), "path")))
    # one pass: a malformed record is a group of its own
    own, fine = F.when(F.col("error").isNotNull(), F.monotonically_increasing_id()), F.col("error").isNull()
    parsed = rows.select("commit", "ts", "path", "error", own.alias("own"), F.when(fine, F.col("line_mass")).alias("line_mass"), F.when(fine, F.col("is_text")).alias("is_text"), F.when(fine, F.col("is_binary")).alias("is_binary"))
    if known:
        parsed = parsed.repartition(parts(sections.sparkSession, known), "commit")
    merged = parsed.groupBy("commit", "ts", "path", "error", "own").agg(F.sum("line_mass").alias("line_mass"), F.bool_or("is_text").alias("is_text"), F.bool_or("is_binary").alias("is_binary"))
    return merged.select("commit", "ts", "path", "line_mass", "is_text", "is_binary", "error")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """:func:`parse_log` of a file of log output, which is split at its record separators and read in parallel."""
    return parse_log(spark.read.text(path, lineSep="\x1e"))


def parse_tree(entries: DataFrame) -> DataFrame:
    """(mode, type, oid, size, path, error) from ``entries`` (value) of ``ls-tree -r -z --long``. Sizes of what is no blob are null."""
    m = lambda k: F.regexp_extract("value", r"(?s)\A(\d{6}) (\w+) ([0-9a-f]{40,64}) +(\d+|-)\t(.+)\z", k)
    ok = m(1) != ""
    got = entries.where("value != ''").select(F.when(ok, m(1)).alias("mode"), F.when(ok, m(2)).alias("type"), F.when(ok, m(3)).alias("oid"), F.when(ok & (m(4) != "-"), m(4)).alias("size"), F.when(ok, m(5)).alias("path"), F.when(~ok, "entry").alias("error"))
    return got.withColumn("size", F.expr("try_cast(size as bigint)"))


def regular(tree: DataFrame) -> DataFrame:
    """Committed regular files: neither links nor submodules nor malformed entries."""
    return tree.where("mode in ('100644', '100755')").select("path", "size", "mode", "oid")


def run(root: str, *args: str, stdin: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", root, *args], input=stdin, capture_output=True, check=True).stdout


def records(spark: SparkSession, output: bytes, separator: bytes) -> DataFrame:
    return spark.createDataFrame([(x.decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode(),) for x in output.split(separator)], "value string")


def history(spark: SparkSession, root: str, commits: int, revision: str = "HEAD") -> tuple[DataFrame, bool]:
    """The newest ``commits`` commits of a repository, and whether it has more."""
    sections = [x for x in run(root, *LOG_FORMAT, "-n", str(commits + 1), revision, "--").split(b"\x1e") if x.strip()]
    return parse_log(records(spark, b"\x1e".join(sections[:commits]), b"\x1e")), len(sections) > commits


def tree(spark: SparkSession, root: str, revision: str = "HEAD") -> DataFrame:
    return parse_tree(records(spark, run(root, "ls-tree", "-r", "-z", "--long", revision), b"\x00"))


def blobs(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """(path, content) of committed files (path, oid), read through one process."""
    rows = files.select("path", "oid").collect()
    data, at, out = run(root, "cat-file", "--batch", stdin="".join(f"{r.oid}\n" for r in rows).encode()), 0, []
    for r in rows:
        end = data.index(b"\n", at)
        oid, kind, size = data[at:end].split()
        if oid.decode() != r.oid or kind != b"blob":
            raise ValueError(f"{r.oid} is no blob")
        out.append((r.path, bytearray(data[end + 1 : end + 1 + int(size)])))
        at = end + 2 + int(size)
    return spark.createDataFrame(out, "path string, content binary")


def snapshot(root: str) -> dict[str, object]:
    """Identity of a repository: its top folder, the revision, and whether the work tree differs from it."""
    top = run(root, "rev-parse", "--show-toplevel").decode().rstrip("\n")
    return {"root": top, "revision": run(top, "rev-parse", "HEAD").decode().strip(), "dirty": bool(run(top, "status", "--porcelain", "--untracked-files=normal").strip())}
