"""Source trees: files with a known language, and what they declare, by the kernels of ``tessera.functions``.

Files are independent of each other, so every inventory is one pass over (path, content) in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import inventories, lexer

SKIPPED = r"(^|/)(\.[^/]+|target|node_modules|__pycache__)(/|$)"


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, content) of the files under ``root`` but for hidden folders and those of build tools; links are not followed."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.lit(root.rstrip("/") + "/")
    path = F.regexp_replace("path", r"^file:/+", "/")
    relative = F.when(path.startswith(base), F.expr(f"substring(regexp_replace(path, '^file:/+', '/'), {len(root.rstrip('/')) + 2})")).otherwise(path)
    return found.select(relative.alias("path"), F.col("length").alias("size"), "content").where(~F.col("path").rlike(SKIPPED))


def sources(files: DataFrame) -> DataFrame:
    """(path, language, text) of the files whose extension names a language and that are UTF-8."""
    pairs = F.create_map(*(F.lit(x) for kv in lexer.EXTENSIONS.items() for x in kv))
    language = pairs[F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))]
    text = F.expr("if(is_valid_utf8(cast(content as string)), cast(content as string), null)")
    return files.select("path", language.alias("language"), text.alias("text")).where("language is not null and text is not null")


def coverage(files: DataFrame) -> DataFrame:
    """One row: files, those that are UTF-8, supported and not."""
    pairs = F.array(*map(F.lit, lexer.EXTENSIONS))
    known = F.array_contains(pairs, F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    utf8 = F.expr("is_valid_utf8(cast(content as string))")
    return files.agg(F.count(F.lit(1)).alias("tracked"), F.count_if(utf8).alias("utf8"), F.count_if(utf8 & known).alias("supported"), F.count_if(utf8 & ~known).alias("unsupported"))


def _each(files: DataFrame, schema: str, kernel) -> DataFrame:
    """Rows (path, language, ...) that ``kernel(text, language)`` gives for each file."""
    names = [c.split()[0] for c in schema.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [(p, lang, *r) for p, lang, t in zip(*(batch.column(k).to_pylist() for k in range(3))) for r in kernel(t or "", lang)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return files.select("path", "language", "text").mapInArrow(run, schema)


def imports(files: DataFrame) -> DataFrame:
    return _each(files, "path string, language string, line long, specifier string, kind string", inventories.imports)


def exported(files: DataFrame) -> DataFrame:
    return _each(files, "path string, language string, line long, name string, kind string, documented boolean", inventories.exported)


def test_cases(files: DataFrame) -> DataFrame:
    return _each(files, "path string, language string, line long, name string, ignored boolean", lambda t, lang: inventories.tests(t, lang)[0])


def measures(files: DataFrame) -> DataFrame:
    """Size metrics of each file, its assertions, and whether its brackets match."""
    keys = list(inventories.measures("", "rust"))

    def kernel(text: str, language: str):
        m = inventories.measures(text, language)
        return [(*m.values(), inventories.tests(text, language)[1], not lexer.balanced(lexer.lex(text, language)))]

    return _each(files, "path string, language string, " + ", ".join(f"{k} long" for k in keys) + ", assertions long, syntax_error boolean", kernel)


def token_text(files: DataFrame) -> DataFrame:
    """(file, language, text): the normalized tokens of each file, for the clone operators; lines are kept as line ends."""

    def kernel(text: str, language: str):
        out, line = [], 1
        for word, at, _ in lexer.normalized(lexer.lex(text, language), language):
            out.append("\n" * (at - line) + word)
            line = max(line, at)
        return [(" ".join(out),)]

    return _each(files, "path string, language string, text string", kernel).withColumnRenamed("path", "file")
