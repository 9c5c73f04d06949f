"""Sinks: keyed tables in Parquet that are replaced whole, versions beside each other, so that readers and lost tasks see complete ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_version(df: DataFrame, path: str, version: int) -> str:
    """Writes a version of a table; the versions before it stay readable."""
    at = f"{path}/v={version:08d}"
    df.write.mode("overwrite").parquet(at)
    return at


def merge_fields(old: DataFrame, new: DataFrame, key: str, refreshed: list[str], reset: tuple[str, list[str], str], keep_if: str) -> DataFrame:
    """Field-level upsert: refreshed fields come from the new row, the others stay; the reset field falls back to its value where
    one of its triggers changed, unless it holds keep_if."""
    field, triggers, value = reset
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    is_new, is_old = F.col(f"n.{key}").isNotNull(), F.col(f"o.{key}").isNotNull()
    changed = None
    for t in triggers:
        c = ~F.col(f"o.{t}").eqNullSafe(F.col(f"n.{t}"))
        changed = c if changed is None else changed | c

    def pick(c: str) -> Column:
        if c == key:
            return F.coalesce(f"n.{c}", f"o.{c}").alias(c)
        if c == field:
            return F.when(is_new & is_old & changed & ~F.col(f"o.{c}").eqNullSafe(F.lit(keep_if)), value).when(is_old, F.col(f"o.{c}")).otherwise(F.coalesce(f"n.{c}", F.lit(value))).alias(c)
        return (F.when(is_new, F.coalesce(f"n.{c}", f"o.{c}")).otherwise(F.col(f"o.{c}")) if c in refreshed else F.coalesce(f"o.{c}", f"n.{c}")).alias(c)

    return j.select(*(pick(c) for c in old.columns))


def replace_chunks(index: DataFrame, new: DataFrame, doc: str, machine: str) -> DataFrame:
    """Chunks of an index with those of (document, machine) pairs replaced; pairs compare null-safe."""
    k = new.select(F.col(doc).alias("_d"), F.col(machine).alias("_m")).distinct()
    return index.join(k, index[doc].eqNullSafe(k["_d"]) & index[machine].eqNullSafe(k["_m"]), "left_anti").unionByName(new)


def dead_letters(df: DataFrame, key: str, error: str, message: str, prior: str) -> DataFrame:
    """Dead-letter rows: attempts one more than before, error class and message cut to their fields."""
    return df.select(key, (F.coalesce(F.col(prior), F.lit(0)) + 1).alias("attempt_count"), F.substr(error, F.lit(1), F.lit(64)).alias("error_class"), F.substr(message, F.lit(1), F.lit(1024)).alias("error_message"))


def download_decision(etag: Column, old_etag: Column, size: Column, status: Column, cap: int) -> Column:
    """What to do with a file: skip terminal answers, unchanged and too large ones."""
    return F.when(status.isin(401, 403, 404, 410), "skip_terminal").when(status == 304, "unchanged").when(size > cap, "skip_size").when(etag.eqNullSafe(old_etag) & etag.isNotNull(), "unchanged").otherwise("download")
