"""JSON records whose type shows in the keys they hold, and recursive lookups."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def shape_of(c: Column, rules: list[tuple[str, list[str]]], other: str = "unknown") -> Column:
    """The first rule all of whose keys the object holds; keys compare without regard to the case of their first letter. Null for text that is no object."""
    keys = F.transform(F.json_object_keys(c), lambda k: F.concat(F.lower(F.substring(k, 1, 1)), F.substr(k, F.lit(2))))
    out = F.when(keys.isNull(), F.lit(None).cast("string"))
    for name, need in rules:
        cond = None
        for k in need:
            one = F.array_contains(keys, k[:1].lower() + k[1:])
            cond = one if cond is None else cond & one
        out = out.when(cond, name)
    return out.otherwise(other)


def find_key(c: Column, key: str) -> Column:
    """The first text under a key at any depth. Spark has no recursive path: a batched Python function."""

    def walk(x: object) -> str | None:
        if isinstance(x, dict):
            if isinstance(x.get(key), str):
                return x[key]
            x = list(x.values())
        if isinstance(x, list):
            for v in x:
                got = walk(v)
                if got is not None:
                    return got
        return None

    @F.pandas_udf(StringType())
    def find(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return walk(json.loads(t)) if t else None
            except ValueError:
                return None

        return s.map(one)

    return find(c)


def as_array(c: Column, path: str, element: str = "string") -> Column:
    """The value at a path as an array, whether it is one value or an array; empty where it is missing."""
    v = F.get_json_object(c, path)
    return F.when(v.isNull(), F.array().cast(f"array<{element}>")).when(F.startswith(v, F.lit("[")), F.from_json(v, f"array<{element}>")).otherwise(F.array(v.cast(element)))




def is_cron(c: Column) -> Column:
    """Five fields of numbers, ranges, steps, lists or stars."""
    part = r"(?:\*|\d+(?:-\d+)?)(?:/\d+)?(?:,(?:\*|\d+(?:-\d+)?)(?:/\d+)?)*"
    return F.rlike(F.trim(c), F.lit(rf"^{part}(?:\s+{part}){{4}}$"))
