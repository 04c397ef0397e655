"""Ratios with a null policy, digests, and small text and number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """Null where the denominator is 0: an undefined ratio is never 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(ratio(num, den), F.lit(0.0))


def per_ksloc(value: Column, sloc: Column) -> Column:
    return ratio(value.cast("double") * 1000, sloc)


def choose_two(n: Column) -> Column:
    n = n.cast("long")
    return F.shiftright(n * (n - 1), 1)


def relative_change(left: Column, right: Column) -> Column:
    return ratio(right - left, F.abs(left))


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def binary_entropy(p: Column) -> Column:
    """Bits; 0 at 0 and 1, NaN outside."""
    inside = -p * F.log2(p) - (1 - p) * F.log2(1 - p)
    return F.when((p < 0) | (p > 1), F.lit(float("nan"))).when((p == 0) | (p == 1), 0.0).otherwise(inside)


def unit_clamp(x: Column) -> Column:
    """Round-off just outside [0, 1] is cut; more than that is an error."""
    slack = 256 * 2.220446049250313e-16
    return F.when((x >= -slack) & (x <= 1 + slack), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).otherwise(F.raise_error(F.concat(F.lit("outside the unit interval: "), x.cast("string"))).cast("double"))


def nonnegative(x: Column, scale: Column) -> Column:
    slack = 256 * 2.220446049250313e-16 * F.greatest(F.lit(1.0), F.abs(scale))
    return F.when(x >= -slack, F.greatest(x, F.lit(0.0))).otherwise(F.raise_error(F.lit("negative beyond round-off")).cast("double"))


def pointer_token(key: Column) -> Column:
    """RFC 6901 escape; the order of the two replacements matters."""
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def pointer(parent: Column, key: Column) -> Column:
    return F.concat(parent, F.lit("/"), pointer_token(key))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def length_prefixed(c: Column) -> Column:
    """Eight big-endian bytes of the length, then the bytes."""
    b = c.cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(b)), 16, "0")), b)


def hex_lower(c: Column) -> Column:
    return F.lower(F.hex(c.cast("binary")))


def utc_day(seconds: Column) -> Column:
    return F.floor(seconds / 86400).cast("long")


def line_count(text: Column) -> Column:
    """Newlines, and one more for an unterminated last line."""
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (newlines + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)).cast("long")


def nonblank_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))).cast("long")


def compact(text: Column) -> Column:
    return F.regexp_replace(text, r"\s", "")


def strip_quotes(text: Column) -> Column:
    return F.regexp_replace(text, "^[\"'`]+|[\"'`]+$", "")


def starts_uppercase(name: Column) -> Column:
    return name.rlike(r"^\p{Lu}")


def simple_name(name: Column) -> Column:
    return name.rlike(r"^[\p{L}\p{N}_$]+$")


def go_case_name(name: Column) -> Column:
    return name.rlike(r"^(Test|Benchmark|Example)(\P{Ll}.*)?$")


def ascii_u64(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("decimal(20,0)"))


def requirement_name(text: Column) -> Column:
    """What precedes the first version sign, extra, marker or blank of a requirement."""
    return F.trim(F.regexp_extract(text, r"^([^<>=!~;\[@ ]*)", 1))


def npm_source(req: Column) -> Column:
    return (
        F.when(req == "*", "wildcard").when(req.startswith("workspace:"), "workspace").when(req.rlike("^(file|link):"), "path").when(req.rlike("^git|github\\.com"), "git").otherwise("registry")
    )


def identity_key(owner: Column, repo: Column) -> Column:
    return F.lower(F.concat(owner, F.lit("/"), repo))


def valid_owner(owner: Column) -> Column:
    return owner.rlike(r"^[A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?$") & ~owner.contains("--")


def valid_repo(repo: Column) -> Column:
    return repo.rlike(r"^[A-Za-z0-9._-]{1,100}$") & ~repo.isin(".", "..")


def cache_key(repository_id: Column, commit: Column, bundle: Column) -> Column:
    """The file name under which the results of a bundle for one commit are kept."""
    return F.concat(F.sha2(F.concat_ws(":", repository_id.cast("string"), commit, bundle), 256), F.lit(".json"))


def log_scale(value: Column, largest: Column, extent: float) -> Column:
    """Position of log(1 + value) on an axis of ``extent`` that ends at ``largest``."""
    return F.coalesce(F.try_divide(F.log1p(value) * extent, F.log1p(largest)), F.lit(0.0))


def exact_double(x: Column) -> Column:
    """Whether a whole number survives a round trip through a double; one beyond 64 bits does not. (A cast of a double to a decimal would go through its shortest text.)"""
    whole = x.try_cast("long")
    return F.coalesce(whole.cast("double").try_cast("long") == whole, F.lit(False))


def plausible_rfc3339(ts: Column) -> Column:
    at = lambda k: F.regexp_extract(ts, PATTERN, k).try_cast("int")
    ok = at(2).between(1, 12) & at(3).between(1, 31) & at(4).between(0, 23) & at(5).between(0, 59) & at(6).between(0, 60)
    offset = (F.regexp_extract(ts, PATTERN, 7) == "") | (at(8).between(0, 23) & at(9).between(0, 59))
    return ts.rlike(PATTERN) & ok & offset


PATTERN = r"^(\d{4})-(\d{2})-(\d{2})[Tt](\d{2}):(\d{2}):(\d{2})(?:\.\d+)?(?:[Zz]|([+-])(\d{2}):(\d{2}))$"


def artifact_identity(artifact: Column) -> Column:
    return artifact.rlike(r"^[^\s@]+@[0-9a-fA-F]{7,}( vs [^\s@]+@[0-9a-fA-F]{7,})?$")


def safe_reference(path: Column) -> Column:
    """Relative, nonempty once its fragment is cut, and without a parent step."""
    bare = F.substring_index(path, "#", 1)
    return (bare != "") & ~bare.startswith("/") & ~bare.rlike(r"(^|/)\.\.(/|$)")
