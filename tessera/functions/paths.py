"""Path and name expressions. All are plain column expressions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CATEGORIES = ["source", "test", "documentation", "configuration", "generated_or_vendor", "other"]
SEGMENTS = {
    "generated_or_vendor": "vendor vendors third_party third-party node_modules generated gen build dist target out .next".split(),
    "test": "test tests testing spec specs __tests__".split(),
    "documentation": "doc docs documentation".split(),
}
CONFIG_NAMES = (
    "makefile gnumakefile dockerfile cargo.lock go.mod go.sum package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml gemfile.lock podfile.lock"
    " .gitignore .gitattributes .editorconfig .npmrc .prettierrc .eslintrc .rubocop.yml"
).split()
GENERATED_NAME = r"(\.min\.(js|css)$)|\.generated\.|_generated\.|\.g\.|\.pb\."
TEST_STEM = r"^test_|^(test|tests|spec|specs)$|(_test|_tests|-test|\.test|_spec|-spec|\.spec)$"
TEST_CAMEL = r"(Test|Tests|Spec)$"
DOC_NAME = r"^(readme|changelog|changes|contributing|authors|license|licence)$|^(readme|changelog|contributing|license|licence)\."
DOC_EXT = "md markdown rst adoc asciidoc".split()
CONFIG_EXT = "json yaml yml toml xml ini cfg conf properties lock gradle".split()
SOURCE_EXT = "rs go py pyw js jsx mjs cjs ts tsx java c h cc cpp cxx hh hpp hxx cs rb swift kt kts sh bash zsh fish".split()
LANGUAGES = {
    "rust": ["rs"],
    "python": ["py", "pyi"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "typescript": ["ts", "mts", "cts", "tsx"],
    "go": ["go"],
}


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def filename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """After the last dot of the file name; null where that dot is its first or last character, or there is none."""
    found = F.regexp_extract(filename(path), r"(?s)^.+\.([^.]+)$", 1)
    return F.when(found != "", found)


def stem(name: Column) -> Column:
    """Before the last dot; the whole name without one."""
    return F.when(F.instr(name, ".") > 0, F.regexp_extract(name, r"(?s)^(.*)\.[^.]*$", 1)).otherwise(name)


def top_level(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(F.lit("."))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")).cast("long")


def parent(path: Column) -> Column:
    """The directory, empty for a bare name."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def category(path: Column) -> Column:
    """One of :data:`CATEGORIES`, by precedence generated, test, documentation, configuration, source, other."""
    lower = ascii_lower(path)
    segments, name = F.split(lower, "/"), filename(lower)
    has = {k: F.arrays_overlap(segments, F.array(*map(F.lit, v))) for k, v in SEGMENTS.items()}
    ext = extension(lower)
    return (
        F.when(has["generated_or_vendor"] | name.rlike(GENERATED_NAME), "generated_or_vendor")
        .when(has["test"] | stem(name).rlike(TEST_STEM) | stem(filename(path)).rlike(TEST_CAMEL), "test")
        .when(has["documentation"] | name.rlike(DOC_NAME) | F.coalesce(ext.isin(DOC_EXT), F.lit(False)), "documentation")
        .when(name.isin(CONFIG_NAMES) | F.coalesce(ext.isin(CONFIG_EXT), F.lit(False)), "configuration")
        .when(F.coalesce(ext.isin(SOURCE_EXT), F.lit(False)), "source")
        .otherwise("other")
    )


def language(path: Column) -> Column:
    """Reporting language by extension; null where it is not supported."""
    known = F.create_map(*(F.lit(x) for name, exts in LANGUAGES.items() for ext in exts for x in (ext, name)))
    return known[ascii_lower(extension(path))]


def is_test_file(path: Column, lang: Column) -> Column:
    """Test role by the conventions of each language."""
    lower = ascii_lower(path)
    name, dirs = filename(lower), F.split(lower, "/")
    within = lambda *names: F.arrays_overlap(dirs, F.array(*map(F.lit, names)))
    return F.coalesce(
        F.when(lang == "rust", within("tests") | name.rlike(r"_tests?\.rs$"))
        .when(lang == "python", within("tests", "test") | name.rlike(r"^test_|_test\.pyi?$"))
        .when(lang.isin("javascript", "typescript"), within("tests", "test", "__tests__") | name.rlike(r"\.(test|spec)\.[a-z]+$"))
        .when(lang == "go", name.rlike(r"_test\.go$")),
        F.lit(False),
    )


def is_source_module(path: Column) -> Column:
    name = ascii_lower(filename(path))
    return ~(name.isin("mod.rs", "lib.rs", "main.rs", "__init__.py") | name.rlike(r"^index\."))


def canonical_stem(path: Column, test: Column) -> Column:
    """Lower-case stem; of a test without its test suffix and prefix."""
    base = stem(ascii_lower(filename(path)))
    return F.when(test, F.regexp_replace(F.regexp_replace(base, r"(\.test|\.spec|_tests|_test)$", ""), r"^test_", "")).otherwise(base)


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def category_sql(path: str) -> str:
    """:func:`category` for DuckDB, for the checks."""
    name, segs = f"split_part(lower({path}), '/', -1)", f"string_split(lower({path}), '/')"
    own = f"split_part({path}, '/', -1)"
    st = lambda n: f"(CASE WHEN strpos({n}, '.') > 0 THEN regexp_extract({n}, '^(.*)\\.[^.]*$', 1) ELSE {n} END)"
    ext = f"regexp_extract({name}, '^.+\\.([^.]+)$', 1)"
    return f"""(CASE WHEN list_has_any({segs}, {sql_list(SEGMENTS["generated_or_vendor"])}) OR regexp_matches({name}, '{GENERATED_NAME}') THEN 'generated_or_vendor'
      WHEN list_has_any({segs}, {sql_list(SEGMENTS["test"])}) OR regexp_matches({st(name)}, '{TEST_STEM}') OR regexp_matches({st(own)}, '{TEST_CAMEL}') THEN 'test'
      WHEN list_has_any({segs}, {sql_list(SEGMENTS["documentation"])}) OR regexp_matches({name}, '{DOC_NAME}') OR list_contains({sql_list(DOC_EXT)}, {ext}) THEN 'documentation'
      WHEN list_contains({sql_list(CONFIG_NAMES)}, {name}) OR list_contains({sql_list(CONFIG_EXT)}, {ext}) THEN 'configuration'
      WHEN list_contains({sql_list(SOURCE_EXT)}, {ext}) THEN 'source' ELSE 'other' END)"""
