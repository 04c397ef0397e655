"""Repetition coverage: how much of a document lies inside word n-grams and lines that it repeats.

Word hashes of a whole batch are rolled into n-gram hashes of several lengths, and repeats within a document are found by sorting them.
``top_n``: characters of the most frequent repeated n-gram, times its count, over all characters (1 at most). ``dup_n``: characters in the union
of all n-grams that occur more than once. ``dup_lines``: characters of lines with a word in them that occur more than once. Comparison ignores case.
A document is kept if every fraction is within its limit, one of the published ones for web pages. A fraction beyond it, but within ``SHORT``, is let pass where it amounts to
``ALLOWANCE`` characters or fewer: in a short text that is a sentence said twice.

Defined cases: a null or empty text has fractions of 0 and is kept; a document shorter than an n-gram has 0 for it; of equally
frequent n-grams the longest counts, measured where it first occurs; null ids and repeated rows give a row each; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textkit as tk
from tessera.llm.tables import table

LIMITS = {"top_2": 0.20, "top_3": 0.18, "top_4": 0.16, "dup_5": 0.15, "dup_6": 0.14, "dup_7": 0.13, "dup_8": 0.12, "dup_9": 0.11, "dup_10": 0.10, "dup_lines": 0.30}
SHORT = {"top_2": 0.20, "top_3": 0.30, "top_4": 0.35, **dict.fromkeys(["dup_5", "dup_6", "dup_7", "dup_8", "dup_9", "dup_10", "dup_lines"], 0.50)}
ALLOWANCE = 200
SCHEMA = "doc_id long, n_chars long, " + ", ".join(f"{k} double" for k in LIMITS) + ", keep boolean"


def repeats(key: np.ndarray, kind: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort order of ``key`` (equal ones in any order unless ``kind`` is stable), starts of its groups in that order, and their sizes."""
    order = np.argsort(key, kind=kind)
    s = key[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return order, first, np.diff(np.concatenate([first, [len(s)]]))


def repeated(key: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    order, _, size = repeats(key)
    out = np.empty(len(key), bool)
    out[order] = np.repeat(size > 1, size)
    return out


def coverage(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """All fractions of :data:`LIMITS`, and n_chars, for each document of a slice."""
    docs = len(offs) - 1
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters before each byte
    total = at[offs[1:]] - at[offs[:-1]]
    over = np.maximum(total, 1).astype(float)
    h, starts, ends, doc = tk.words(data, offs)
    begin, end = at[starts], at[ends]
    salt = tk.mix(doc.astype(np.uint64) + np.uint64(1))
    out = {"n_chars": total}

    def whole(n: int) -> np.ndarray:
        return np.flatnonzero(doc[: max(0, len(h) - n + 1)] == doc[n - 1 :])

    for n in (2, 3, 4):
        pos, best = whole(n), np.zeros(docs)
        order, first, size = repeats((tk.ngrams(h, n) ^ salt[: max(0, len(h) - n + 1)])[pos], "stable")
        many = size > 1
        p, size = pos[order[first[many]]], size[many]
        length, owner = end[p + n - 1] - begin[p], doc[p]
        rank = np.lexsort((length, size, owner))  # the last of each owner is the most frequent, then the longest
        p_owner = owner[rank]
        last = np.flatnonzero(np.concatenate([p_owner[1:] != p_owner[:-1], [True]])) if len(rank) else rank
        best[p_owner[last]] = (size * length)[rank][last]
        out[f"top_{n}"] = np.minimum(1.0, best / over)
    pos = whole(5)
    for n in range(5, 11):
        pos = pos[pos + n <= len(h)]
        pos = pos[doc[pos] == doc[pos + n - 1]]
        pos = np.sort(pos[repeated((tk.ngrams(h, n)[pos] if len(h) >= n else np.zeros(0, np.uint64)) ^ salt[pos])])
        fresh = end[pos + n - 1] - begin[pos]
        if len(pos) > 1:
            near = np.flatnonzero(doc[pos[1:]] == doc[pos[:-1]]) + 1
            fresh[near] = end[pos[near] + n - 1] - np.maximum(begin[pos[near]], end[pos[near - 1] + n - 1])
        out[f"dup_{n}"] = np.bincount(doc[pos], fresh, docs) / over
    ls, le, ld = tk.runs((data != 10).view(np.uint8), offs)
    seen = np.concatenate([[0], np.cumsum(tk.WORD[data])])
    full = seen[le] > seen[ls]
    ls, le, ld = ls[full], le[full], ld[full]
    twice = repeated(tk.run_hashes(data, ls, le) ^ tk.mix(ld.astype(np.uint64) + np.uint64(1)))
    out["dup_lines"] = np.bincount(ld[twice], (at[le] - at[ls])[twice], docs) / over
    return out


def measure(docs: DataFrame, limits: dict[str, float] = LIMITS, short: dict[str, float] = SHORT, allowance: int = ALLOWANCE) -> DataFrame:
    """doc_id, n_chars, the fractions and keep, for every document."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offs in tk.slices(batch.column(1), 1 << 20):
                got = coverage(data, offs)
                keep = np.ones(hi - lo, bool)
                for k, most in limits.items():
                    keep &= (got[k] <= most) | (got[k] <= short[k]) & (got[k] * got["n_chars"] <= allowance)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).cast(pa.int64()), pa.array(got["n_chars"].astype(np.int64)), *(pa.array(got[k].astype(float)) for k in LIMITS), pa.array(keep)], names=["doc_id", "n_chars", *LIMITS, "keep"])

    return docs.select(F.col("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text")).mapInArrow(run, SCHEMA)


def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents"))
