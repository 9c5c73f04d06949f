"""Catalogue maintenance: sync phases, reconciliation, lookups, backfill, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltyard.functions import text as X
from tiltyard.operators import relational as R


def sync(export: DataFrame, current: DataFrame, key: str) -> dict[str, DataFrame]:
    """Upserts and purge of a catalogue against a full export (kind, key, ...): aliases are joined to their base by the first two
    id segments; aliases without a base are orphans; current keys that the export lacks are stale. An empty export purges nothing."""
    base = export.filter("kind = 'machine'").withColumn("base", F.col(key))
    alias = export.filter("kind = 'alias'").withColumn("base", X.id_segments(F.col(key), 2))
    known = base.select("base").distinct()
    stale = current.select(key).distinct().join(export.select(key), key, "left_anti")
    return {
        "bases": base,
        "editions": alias.join(known, "base", "left_semi"),
        "orphans": alias.join(known, "base", "left_anti"),
        "stale": stale if export.take(1) else stale.filter(F.lit(False)),
    }


def edition_rows(machines: DataFrame, key: str, label: str) -> DataFrame:
    """(key, token): distinct words of edition labels without noise words."""
    return machines.select(key, F.explode(X.label_tokens(F.coalesce(label, F.lit("")))).alias("token")).distinct()


def lookup_rows(machines: DataFrame, key: str, title: str, maker: str) -> DataFrame:
    """(k, key): lookup keys of a machine: its title, both spellings of 'and', and each with the maker before it."""
    t = machines.select(key, F.col(maker).alias("_m"), F.explode(X.and_variants(F.col(title))).alias("_t"))
    ks = F.explode(F.array(X.lookup_key(F.col("_t")), X.lookup_key(F.concat_ws(" ", "_m", "_t"))))
    return t.select(ks.alias("k"), key).distinct()


def find_title(queries: DataFrame, row: str, query: str, machines: DataFrame, key: str, title: str, maker: str, full: Column) -> DataFrame:
    """(row, key, stage) of the best machine: exact lookup key, then the key without its first word, then the most shared words.

    Ties in the last stage go to the fuller record, then the smaller key. Candidates for it share a word with the query, so the
    join is on words.
    """
    look = lookup_rows(machines, key, title, maker)
    q = queries.select(row, X.lookup_key(F.col(query)).alias("k"), X.query_words(F.col(query)).alias("_w"))
    exact = q.join(look, "k").select(row, key)
    short = q.withColumn("k", F.regexp_replace("k", r"^\S+\s+", "")).join(look, "k").select(row, key)
    words = machines.select(key, full.alias("_f"), F.explode(F.array_distinct(X.title_tokens(F.col(title)))).alias("w")).filter(~F.col("w").isin(*X.STOP_WORDS)).distinct()
    shared = q.select(row, F.explode(F.array_distinct("_w")).alias("w")).join(words, "w").groupBy(row, key).agg(F.count("*").alias("n"), F.max("_f").alias("f"))
    best = shared.groupBy(row).agg(F.min_by(key, F.struct(F.negative("n"), F.negative("f"), F.col(key))).alias(key))
    return R.staged([exact, short, best], row).groupBy(row, "stage").agg(F.min(key).alias(key)).select(row, key, "stage")


def reconcile(scraped: DataFrame, catalogue: DataFrame, row: str, title: str, maker: str, key: str, group: str) -> DataFrame:
    """(row, group, how): scraped games to catalogue groups by full title, then franchise, within the maker; several groups are ambiguous."""
    c = catalogue.select(F.col(group).alias("g"), F.col(maker).alias("m"), X.compact_key(F.col(title)).alias("k1"), X.compact_key(X.franchise_head(F.col(title))).alias("k2")).distinct()
    s = scraped.select(row, F.col(maker).alias("m"), X.compact_key(F.col(title)).alias("k1"), X.franchise_key(F.col(title)).alias("k2"))
    a = s.join(c.select("g", "m", "k1"), ["m", "k1"]).select(row, "g")
    b = s.join(c.select("g", "m", "k2"), ["m", "k2"]).select(row, "g")
    h = R.staged([a, b], row).groupBy(row, "stage").agg(F.count_distinct("g").alias("n"), F.min("g").alias("g"))
    return h.select(row, F.when(F.col("n") == 1, F.col("g")).alias(group), F.when(F.col("n") > 1, "ambiguous").when(F.col("stage") == 0, "title").otherwise("franchise").alias("how"))


def backfill(rows: DataFrame, existing: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """Rows that existing lacks, one per key, each field from its first value that is not null."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields]
    return rows.join(existing.select(key).distinct(), key, "left_anti").groupBy(key).agg(*first)


def probe_coverage(hits: DataFrame, cells: DataFrame, on: list[str], row: str, rank: str, top: int = 10) -> DataFrame:
    """Cells with a sample row (the smallest id), whether it is found among the top ranks, and gaps (cells without rows)."""
    g = hits.groupBy(*on).agg(F.min(row).alias("sample"), F.bool_or(F.col(rank) <= top).alias("found"))
    return cells.join(g, on, "left").withColumn("state", F.when(F.col("sample").isNull(), "gap").when(F.col("found"), "covered").otherwise("missed"))


def boost(score: Column, completeness: Column, seen: Column, now: Column, most: float = 6.0, days: float = 60.0) -> Column:
    """A score with linear boosts: up to 2.0 for completeness, up to 1.5 for rows seen in the last days; both are added."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(seen.cast("timestamp"))) / 8.64e10
    fresh = F.greatest(F.lit(0.0), F.lit(1.0) - age / days)
    return score * (1.0 + (completeness / most) * (2.0 - 1.0) + F.coalesce(fresh, F.lit(0.0)) * (1.5 - 1.0))
