"""Resolution of imports to files: ordered candidates, the first that is a known file wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import extension, filename, parent

JS_SUFFIXES = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]


def under(directory: Column, name: Column) -> Column:
    return F.when(directory == "", name).otherwise(F.concat(directory, F.lit("/"), name))


def normalize(path: Column) -> Column:
    """Without . and with .. applied; null if it leaves the root."""
    kept = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    none = F.lit(None).cast("array<string>")
    step = lambda acc, s: F.when(acc.isNull(), none).when((s == "..") & (F.size(acc) == 0), none).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(kept, F.array().cast("array<string>"), step, lambda acc: F.array_join(acc, "/"))


def rust_mod(path: Column, name: Column) -> Column:
    name_ = filename(path)
    own = F.when(name_.isin("mod.rs", "lib.rs", "main.rs"), parent(path)).otherwise(F.regexp_replace(path, r"\.rs$", ""))
    return F.array(under(own, F.concat(name, F.lit(".rs"))), under(own, F.concat(name, F.lit("/mod.rs"))))


def rust_use(path: Column, value: Column) -> Column:
    """crate is the source root, super and self the grandparent and parent module; then shorter and shorter prefixes of the rest."""
    parts = F.split(value, "::")
    head = F.element_at(parts, 1)
    root = F.when(F.instr(path, "src/") > 0, F.concat(F.substring_index(path, "src/", 1), F.lit("src"))).otherwise(F.lit(""))
    base = F.when(head == "crate", root).when(head == "super", parent(parent(path))).otherwise(parent(path))
    rest = F.when(head.isin("crate", "super", "self"), F.slice(parts, 2, F.size(parts))).otherwise(parts)
    n = F.size(rest)
    steps = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.array_join(F.slice(rest, 1, n - i), "/"))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(steps, lambda s: F.array(under(base, F.concat(s, F.lit(".rs"))), under(base, F.concat(s, F.lit("/mod.rs"))))))


def python_module(path: Column, value: Column) -> Column:
    """Leading dots climb from the file's directory; an absolute name is looked up from the root and beside the file."""
    dots = F.length(F.regexp_extract(value, r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace(value, r"^\.+", ""), F.lit("."), F.lit("/"))
    segments = F.filter(F.split(parent(path), "/"), lambda s: s != "")
    climbed = F.array_join(F.slice(segments, 1, F.greatest(F.size(segments) - (dots - 1), F.lit(0))), "/")
    both = lambda b: F.array(under(b, F.concat(rest, F.lit(".py"))), under(b, F.concat(rest, F.lit("/__init__.py"))))
    return F.when(dots > 0, both(climbed)).otherwise(F.concat(both(F.lit("")), both(parent(path))))


def js_module(path: Column, value: Column) -> Column:
    """Relative specifiers only: as written, with each suffix if it has no extension, then as a folder's index."""
    base = normalize(under(parent(path), value))
    bare = extension(value).isNull()
    exact = F.array(base)
    suffixed = F.array(*(F.concat(base, F.lit(s)) for s in JS_SUFFIXES))
    index = F.array(*(F.concat(base, F.lit("/index" + s)) for s in JS_SUFFIXES))
    return F.when(~value.startswith("."), F.array().cast("array<string>")).when(bare, F.concat(exact, suffixed, index)).otherwise(F.concat(exact, index))


def candidates(imports: DataFrame) -> DataFrame:
    """``imports`` (path, kind, specifier) with their ordered candidate paths; kinds rust-mod, rust-use, python, js."""
    p, s, k = F.col("path"), F.col("specifier"), F.col("kind")
    return imports.withColumn("candidates", F.when(k == "rust-mod", rust_mod(p, s)).when(k == "rust-use", rust_use(p, s)).when(k == "python", python_module(p, s)).when(k == "js", js_module(p, s)))


def resolve(imports: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """``imports`` with ``target``, the known file among ``candidates`` that comes first, or null. ``known`` has a column path."""
    c = imports.select(*key, F.posexplode("candidates").alias("__pos", "__cand"))
    hit = c.join(known.select(F.col("path").alias("__known")).distinct(), F.col("__cand") == F.col("__known")).groupBy(*key).agg(F.min_by("__known", "__pos").alias("target"))
    return imports.join(hit, key, "left")


def is_external(kind: Column, specifier: Column) -> Column:
    """Specifiers that name no file of the tree: packages, crates and standard libraries."""
    return (
        F.when(kind == "js", ~specifier.startswith(".")).when(kind == "rust-use", ~specifier.rlike(r"^(crate|self|super)(::|$)")).when(kind == "python", ~specifier.startswith(".")).when(kind == "go", ~specifier.startswith(".")).otherwise(F.lit(False))
    )


def match_stems(sources: DataFrame, tests: DataFrame) -> DataFrame:
    """Every test (path, directory, stem) with its source: the only one of its directory and stem, else the only one anywhere of its stem, else null."""
    direct = sources.groupBy(F.col("directory").alias("__d"), F.col("stem").alias("__s")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("direct")).where("n = 1").drop("n")
    anywhere = sources.groupBy(F.col("stem").alias("__g")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("sole")).where("n = 1").drop("n")
    j = tests.join(direct, (F.col("directory") == F.col("__d")) & (F.col("stem") == F.col("__s")), "left").join(anywhere, F.col("stem") == F.col("__g"), "left")
    return j.select("path", "stem", F.coalesce("direct", "sole").alias("source_path"))
