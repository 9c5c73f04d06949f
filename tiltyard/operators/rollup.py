"""Rollups: nested per-maker statistics, their incremental form, zero-filled categories, time buckets, alert rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested(df: DataFrame, outer: str, inner: str, kind: str, display: str | None = None) -> DataFrame:
    """(outer, display, members array<struct<inner, doc_count, counts map, has_manual>>): counts per type of each member, members in order.

    Two aggregations: rows to (outer, inner, kind), these to members. Types are compared without regard to case.
    """
    k = F.lower(F.col(kind))
    per = df.groupBy(outer, inner, k.alias("_k")).agg(F.count("*").cast("int").alias("_n"))
    m = per.groupBy(outer, inner).agg(F.sum("_n").cast("int").alias("doc_count"), F.sort_array(F.collect_list(F.struct("_k", "_n"))).alias("counts"), F.bool_or(F.col("_k") == "manual").alias("has_manual"))
    out = m.groupBy(outer).agg(F.transform(F.sort_array(F.collect_list(F.struct(inner, "doc_count", "counts", "has_manual"))), lambda x: F.struct(x[inner].alias(inner), x["doc_count"].alias("doc_count"), F.map_from_entries(x["counts"]).alias("counts"), x["has_manual"].alias("has_manual"))).alias("members"))
    if display:
        names = df.groupBy(outer).agg(F.min(display).alias("display"))
        out = out.join(names, outer, "left")
    return out


def replace_entries(old: DataFrame, new: DataFrame, outer: str, inner: str) -> DataFrame:
    """A rollup (one row per outer and inner key) with the entries of `new` in place of the old ones: the incremental form."""
    return old.join(new.select(outer, inner), [outer, inner], "left_anti").unionByName(new)


def zero_filled(categories: DataFrame, df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """A sum for each category of a full list, zero where nothing was seen."""
    g = df.groupBy(key).agg(F.sum(value).alias(name))
    return categories.join(g, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def time_bucket(c: Column, width: str) -> Column:
    """Start of the tumbling window that holds a time."""
    return F.window(c, width)["start"]


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def alerts(df: DataFrame, rules: list[tuple[str, Column, float]]) -> DataFrame:
    """(rule, value, limit) of the rules whose aggregate exceeds its limit: all in one pass over df."""
    one = df.agg(*(v.cast("double").alias(f"v{i}") for i, (_, v, _) in enumerate(rules)))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"v{i}").alias("value"), F.lit(float(m)).alias("limit")) for i, (n, _, m) in enumerate(rules))))
    return one.select(rows.alias("r")).select("r.*").filter(F.col("value") > F.col("limit"))
