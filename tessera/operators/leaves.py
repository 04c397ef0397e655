"""Numeric leaves of JSON documents as RFC 6901 pointers, and their comparison."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalars import relative_change

LEAF = T.ArrayType(T.StructType([T.StructField("pointer", T.StringType()), T.StructField("value", T.DoubleType())]))


def flatten(text: str | None) -> list[tuple[str, float]]:
    """(pointer, value) of the numbers in a JSON text, in pointer order; booleans, strings and nulls are none. Integers must survive a double."""
    out: list[tuple[str, float]] = []
    stack = [("", json.loads(text))] if text else []
    while stack:
        at, v = stack.pop()
        if isinstance(v, dict):
            stack += [(f"{at}/{k.replace('~', '~0').replace('/', '~1')}", x) for k, x in v.items()]
        elif isinstance(v, list):
            stack += [(f"{at}/{i}", x) for i, x in enumerate(v)]
        elif isinstance(v, (int, float)) and not isinstance(v, bool):
            f = float(v)
            if not math.isfinite(f) or isinstance(v, int) and int(f) != v:
                raise ValueError(f"{at or '/'}: no exact finite double")
            out.append((at, f))
    return sorted(out)


@F.pandas_udf(LEAF)
def leaves_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"pointer": p, "value": v} for p, v in flatten(t)])


def numeric_leaves(df: DataFrame, text: str, key: list[str]) -> DataFrame:
    return df.select(*key, F.explode(leaves_udf(F.col(text))).alias("l")).select(*key, "l.pointer", "l.value")


def differences(left: DataFrame, right: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Leaves of both sides joined on their pointer; a leaf of one side only fails the query."""
    on = [*(key or []), "pointer"]
    j = left.withColumnRenamed("value", "left").join(right.withColumnRenamed("value", "right"), on, "full_outer")
    lone = F.col("left").isNull() | F.col("right").isNull()
    pointer = F.when(lone, F.raise_error(F.concat(F.lit("unmatched leaf "), F.col("pointer"))).cast("string")).otherwise(F.col("pointer"))
    return j.select(*(key or []), pointer.alias("pointer"), "left", "right", (F.col("right") - F.col("left")).alias("right_minus_left"), relative_change(F.col("left"), F.col("right")).alias("relative_change_from_left"))
