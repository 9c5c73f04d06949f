"""Joins, set operations, windows and top-k shapes that recur in the pipeline, as DataFrame compositions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tiltyard.functions import text as X


def latest_per_key(df: DataFrame, key: str, at: str, *ties: str) -> DataFrame:
    """The latest row of each key. max_by of a struct aggregates before the shuffle, so a hot key sends one row per task."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, *ties)).alias("_r"))
    return best.select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def first_per_key(df: DataFrame, key: Sequence[Column], order: Sequence[Column], top: int | None = None) -> DataFrame:
    """First row of each key in rank order, then the first `top` of these: collapse and limit."""
    r = df.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")
    return r.orderBy(*order).limit(top) if top else r


def merge_upsert(old: DataFrame, new: DataFrame, key: list[str], at: str) -> DataFrame:
    """Rows by key, the later of both sides; on equal times the new one."""
    both = old.withColumn("_s", F.lit(0)).unionByName(new.withColumn("_s", F.lit(1)))
    rest = [c for c in old.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(at, "_s")).alias("_r")).select(*key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def delete_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """df without the rows whose key stands in keys; deleting twice changes nothing."""
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def drift(expected: DataFrame, actual: DataFrame, key: str, want: str, have: str) -> DataFrame:
    """Compares a recorded count with the one found: Match, Missing (none found), CountMismatch, or Unexpected (none recorded)."""
    j = expected.join(actual, key, "full_outer")
    status = F.when(F.col(want).isNull(), "Unexpected").when(F.coalesce(have, F.lit(0)) == 0, F.when(F.col(want) == 0, "Match").otherwise("Missing")).when(F.col(want) == F.col(have), "Match").otherwise("CountMismatch")
    return j.withColumn("status", status)


def superset_titles(df: DataFrame, title: str, group: str) -> DataFrame:
    """(short, long) pairs of titles where the long one is the short one and a subtitle, of different groups.

    Joined on the part before the separator, so no title meets more than those that share it: an equi-join, not a prefix scan.
    """
    t = df.filter(F.col(title).isNotNull()).select(F.col(title).alias("t"), F.lower(title).alias("k"), F.col(group).alias("g")).distinct()
    heads = t.select(F.col("t").alias("long_title"), F.col("g").alias("long_group"), F.explode(F.filter(F.transform(F.sequence(F.lit(2), F.length("k")), lambda i: F.when(F.substr("k", i, F.lit(2)).isin(": ") | (F.substr("k", i, F.lit(3)) == " - "), F.substr("k", F.lit(1), i - 1))), lambda x: x.isNotNull())).alias("k"))
    return heads.join(t.select("k", F.col("t").alias("short_title"), F.col("g").alias("short_group")), "k").filter(~F.col("short_group").eqNullSafe(F.col("long_group"))).select("short_title", "short_group", "long_title", "long_group")


def longest_containment(texts: DataFrame, row: str, text_key: str, names: DataFrame, name_key: str) -> DataFrame:
    """(row, name_key, words): the names with most words that stand in a text as whole words.

    Names meet the texts that hold their rarest word (by the number of names with it), in an equi-join on words whose size follows
    the texts; whether the whole name stands there is then looked up in the text.
    """
    n = names.select(F.col(name_key).alias("k")).filter("k <> ''").distinct()
    ws = n.select("k", F.explode(F.array_distinct(F.split("k", " "))).alias("w"))
    rare = ws.join(ws.groupBy("w").agg(F.count("*").alias("df")), "w").groupBy("k").agg(F.min(F.struct("df", "w")).alias("r"))
    n = rare.select("k", F.col("r.w").alias("w"), F.size(F.split("k", " ")).alias("m"))
    t = texts.select(row, F.col(text_key).alias("_x"), F.explode(F.array_distinct(F.split(text_key, " "))).alias("w"))
    hits = t.join(n, "w").filter(X.word_contains(F.col("_x"), F.col("k"))).select(row, "k", "m").distinct()
    best = hits.withColumn("_b", F.max("m").over(W.partitionBy(row))).filter("m = _b")
    return best.select(row, F.col("k").alias(name_key), F.col("m").alias("words"))


def staged(stages: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first stage that has any for a key: stages in order, each with the same columns."""
    out = None
    for i, s in enumerate(stages):
        s = s.withColumn("stage", F.lit(i))
        out = s if out is None else out.unionByName(s)
    return out.withColumn("_s", F.min("stage").over(W.partitionBy(key))).filter("stage = _s").drop("_s")


def resolve_titles(queries: DataFrame, row: str, title: str, machines: DataFrame, mid: str, mtitle: str, group: str) -> DataFrame:
    """(row, status, stage, ids): titles resolved to machines by exact key, key without qualifiers, then containment.

    One machine: Resolved; several of one group: Family; else Ambiguous; no hit in any stage: NoMatch. Of contained names the
    longest count. Null and blank titles are NoMatch.
    """
    q = queries.select(row, X.title_key(F.col(title)).alias("k"))
    m = machines.select(F.col(mid).alias("id"), F.col(group).alias("g"), F.explode(F.array_distinct(F.array(X.title_key(F.col(mtitle)), X.title_key(X.franchise_head(F.col(mtitle)))))).alias("k")).filter("k <> ''").distinct()
    full = q.filter("k <> ''")
    exact = full.join(m, "k").select(row, "id", "g")
    bare = full.select(row, X.strip_qualifiers(F.col("k")).alias("k2"), "k").filter("k2 <> k").join(m, F.col("k2") == m["k"]).select(row, "id", "g")
    inside = longest_containment(full.withColumnRenamed("k", "tk"), row, "tk", m, "k").join(m, "k").select(row, "id", "g")
    hit = staged([exact, bare, inside], row).distinct()
    by = hit.groupBy(row, "stage").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.count_distinct("g").alias("gs"), F.count_if(F.col("g").isNull()).alias("nulls"))
    status = F.when(F.size("ids") == 1, "Resolved").when((F.col("gs") == 1) & (F.col("nulls") == 0), "Family").otherwise("Ambiguous")
    done = by.select(row, status.alias("status"), "stage", "ids")
    return queries.select(row).join(done, row, "left").select(row, F.coalesce("status", F.lit("NoMatch")).alias("status"), "stage", "ids")


def fixpoint(seed: DataFrame, edges: DataFrame, src: str, dst: str, most: int | None = None) -> DataFrame:
    """(node, pass): nodes reached from seed over edges, with the pass that added them; ends when a pass adds none, or after `most` passes where that is given.

    Each pass is written to the shared folder, so lineage stays short and lost executors cost one pass.
    """
    from tiltyard.session import cut

    reached = cut(seed.select(F.col(seed.columns[0]).alias("node")).filter("node is not null").distinct().withColumn("pass", F.lit(0)), "fix")
    front = reached
    for k in count(1) if most is None else range(1, most + 1):
        new = edges.join(front.select(F.col("node").alias(src)), src).select(F.col(dst).alias("node")).filter("node is not null").distinct().join(reached, "node", "left_anti").withColumn("pass", F.lit(k))
        front = cut(new, "fix")
        if not front.take(1):
            break
        reached = reached.unionByName(front)
    return reached


def runs(df: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """Adds streak: failures in a row up to and including the row, reset by a success (gaps and islands)."""
    w = W.partitionBy(key).orderBy(*order)
    d = df.withColumn("_f", failed.cast("int")).withColumn("_g", F.sum(1 - F.col("_f")).over(w))
    return d.withColumn("streak", F.sum("_f").over(W.partitionBy(key, "_g").orderBy(*order))).drop("_f", "_g")


def anchored_windows(df: DataFrame, key: str, at: str, seconds: int, cap: int) -> DataFrame:
    """Rate limiter: windows start at the first event after the last one expired; the first `cap` events of a window pass.

    The anchor depends on the events before, up to the last pause as long as a window: whatever came before it, the event behind
    it starts a new one. So keys are cut at their pauses, and each thousand stretches between them are walked in order by
    themselves; a key with many events is spread over several tasks. Output: the rows with window_start and allowed.
    """
    import pandas as pd

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", window_start {dict(df.dtypes)[at]}, allowed boolean"

    def walk(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values([at, *[c for c in f.columns if c not in (at, key)]], kind="stable")
        start, used, starts, ok = None, 0, [], []
        for t in f[at]:
            if start is None or (t - start).total_seconds() >= seconds:
                start, used = t, 0
            used += 1
            starts.append(start)
            ok.append(used <= cap)
        return f.assign(window_start=starts, allowed=ok)

    w = W.partitionBy(key).orderBy(at)
    pause = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp")) >= seconds * 1_000_000
    parts = df.withColumn("_p", F.coalesce(pause, F.lit(True)).cast("int")).withColumn("_g", F.floor((F.sum("_p").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1) / 1000))
    return parts.groupBy(key, "_g").applyInPandas(lambda f: walk(f.drop(columns=["_p", "_g"])), fields)
