"""References to records that do not exist, direct and inherited.

A reference is an orphan where its key is not held by the parent table at the time of the reference. A reference that
resolves only to orphaned lives of a record is orphaned in turn: a fixpoint over the foreign-key graph finds these by
semi-joins with the lives that the last round orphaned.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltyard.session import cut


@dataclass(frozen=True)
class Parent:
    """Records of a table by key, each existing from start (inclusive) to end (exclusive, null: open)."""

    key: str
    start: str
    end: str


@dataclass(frozen=True)
class Edge:
    """Field of child refers to the key of parent; row identifies the child's record, time is that of the reference."""

    child: str
    field: str
    row: str
    time: str
    parent: str


def norm(c: Column) -> Column:
    """Keys are compared trimmed and without regard to case; blank is null."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def life_spans(df: DataFrame, p: Parent) -> DataFrame:
    """(key, first, spans): per key the first start and its distinct spans; one small array for each life of the record.

    Rows are deduplicated with partial aggregates before the arrays are built, so that a record exported any number of times
    gives one span.
    """
    s = df.select(norm(F.col(p.key)).alias("key"), F.col(p.start).alias("a"), F.col(p.end).alias("b")).filter("key is not null").distinct()
    return s.groupBy("key").agg(F.min("a").alias("first"), F.collect_list(F.struct("a", "b")).alias("spans"))


def _refs(df: DataFrame, e: Edge, own: Parent | None) -> DataFrame:
    """(row, key, t) of one edge; where the child has lives of its own, each life refers by itself: its own key and start come along."""
    life = [norm(F.col(own.key)).alias("own"), F.col(own.start).alias("born")] if own else [F.lit(None).cast("string").alias("own"), F.lit(None).cast("timestamp").alias("born")]
    row = F.concat_ws("@", F.col(e.row).cast("string"), F.unix_micros(F.col(own.start).cast("timestamp")).cast("string")) if own else F.col(e.row).cast("string")
    return df.select(row.alias("row"), norm(F.col(e.field)).alias("key"), F.col(e.time).alias("t"), *life).filter("key is not null")


def _alive(s: Column) -> Column:
    return (F.col("t") >= s["a"]) & (s["b"].isNull() | (F.col("t") < s["b"]))


def direct_orphans(df: DataFrame, e: Edge, spans: DataFrame, own: Parent | None = None) -> DataFrame:
    """(table_name, field_name, row, key, t, own, born, reason) of the references of one edge that do not resolve at their time.

    Null and blank keys are no references. A null time never falls into a span: its reference is missing where the key has no
    row, else deleted. Repeated rows give one row. The references are not sorted by key when the spans are small enough to be
    broadcast (Spark's threshold on their size); beyond it the join is by key, and AQE splits a hot key's partition.
    """
    j = _refs(df, e, own).join(spans, "key", "left")
    reason = F.when(F.col("spans").isNull(), "missing").when(F.coalesce(F.exists("spans", _alive), F.lit(False)), F.lit(None)).when(F.col("t") < F.col("first"), "late").otherwise("deleted")
    out = j.select(F.lit(e.child).alias("table_name"), F.lit(e.field).alias("field_name"), "row", "key", "t", "own", "born", reason.alias("reason"))
    return _once(out.filter("reason is not null"))


def _once(refs: DataFrame) -> DataFrame:
    """One reference per row: of rows written several times, the earliest time, then the first reason and key."""
    rest = [c for c in refs.columns if c not in ("table_name", "field_name", "row", "t", "reason", "key")]
    g = refs.groupBy("table_name", "field_name", "row").agg(F.min(F.struct("t", "reason", "key", *rest)).alias("m"))
    return g.select(*(c if c in ("table_name", "field_name", "row") else F.col(f"m.{c}").alias(c) for c in refs.columns))


def cascade(tables: dict[str, DataFrame], parents: dict[str, Parent], edges: list[Edge]) -> DataFrame:
    """All orphan references: (table_name, field_name, row, t, reason, depth).

    depth 0 is direct. depth k > 0 (reason 'inherited'): the reference resolves, but every life of the record that holds at
    its time was orphaned by round k - 1 or before. A record with lives of its own refers once for each of them (row:
    row@start in microseconds), so a later sound life is not blamed for an earlier one. Rounds end when one adds no orphaned
    life, however deep the chains are: each row is added once, so they end where references go in circles too. Each round is
    one semi-join per edge whose parent has newly orphaned lives, and is written to the shared folder.
    """
    spans = {n: life_spans(tables[n], p) for n, p in parents.items()}
    cols = ["table_name", "field_name", "row", "key", "t", "own", "born", "reason"]
    found = None
    for e in edges:
        d = direct_orphans(tables[e.child], e, spans[e.parent], parents.get(e.child)).select(*cols, F.lit(0).alias("depth"))
        found = d if found is None else found.unionByName(d)
    found = cut(found, "orphans")
    result = found
    middle = [n for n in parents if any(e.child == n for e in edges)]
    for depth in count(1):
        fresh = None
        for n in middle:
            lost = result.filter((F.col("table_name") == n) & F.col("own").isNotNull())
            if not lost.filter(F.col("depth") == depth - 1).take(1):
                continue
            # every orphaned start of the keys that the last round touched: their references may be lost by now
            last = lost.filter(F.col("depth") == depth - 1).select(F.col("own").alias("key")).distinct()
            starts = lost.select(F.col("own").alias("key"), "born").join(last, "key", "left_semi").groupBy("key").agg(F.collect_set("born").alias("lost"))
            held = spans[n].join(starts, "key")
            for e in (x for x in edges if x.parent == n):
                known = result.filter((F.col("table_name") == e.child) & (F.col("field_name") == e.field)).select("row")
                refs = _refs(tables[e.child], e, parents.get(e.child)).join(held, "key")
                alive = F.filter("spans", _alive)
                refs = refs.filter((F.size(alive) > 0) & F.forall(alive, lambda s: F.array_contains("lost", s["a"]))).join(known, "row", "left_anti")
                r = _once(refs.select(F.lit(e.child).alias("table_name"), F.lit(e.field).alias("field_name"), "row", "key", "t", "own", "born", F.lit("inherited").alias("reason"), F.lit(depth).alias("depth")))
                fresh = r if fresh is None else fresh.unionByName(r)
        if fresh is None:
            break
        found = cut(fresh, "orphans")
        result = result.unionByName(found)
    return result.drop("key", "own", "born")


def report(orphans: DataFrame) -> DataFrame:
    """Counts per table, field, month and reason, direct and inherited."""
    g = orphans.groupBy("table_name", "field_name", F.date_format("t", "yyyy-MM").alias("period"), "reason")
    return g.agg(F.count_if(F.col("depth") == 0).alias("direct"), F.count_if(F.col("depth") > 0).alias("inherited"))
