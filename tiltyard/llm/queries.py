"""Queries of the text problems (p2, p3, p6 to p10) and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltyard.llm import leaks, mapping, matching, packing, pairs, scanned, truncated
from tiltyard.session import table


def _p2(spark: SparkSession, sf: str) -> DataFrame:
    return matching.match_documents(table(spark, sf, "scraped_changes"), table(spark, sf, "machines"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _p2(spark, sf).select("group_id", "document_id")


def p2_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return _p2(spark, sf)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.defects(table(spark, sf, "eval_answers"), "result_id", "question", "answer_text")


def _p6(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.p6(table(spark, sf, "alias_entries"), table(spark, sf, "doc_stats"), table(spark, sf, "canonical_values"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _p6(spark, sf).select("table_name", "field_name", "row_id", "canon_key")


def p6_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """The unmatched values with their number of rows, for those who keep the lists."""
    return _p6(spark, sf).filter(F.col("canon_key") == mapping.UNMATCHED).groupBy("table_name", "field_name", "value").agg(F.count("*").alias("rows"), F.round(F.max("score"), 4).alias("best_score"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return scanned.repaired(table(spark, sf, "chunks")).select("chunk_id", F.explode("noise").alias("noise"))


def p7_text(spark: SparkSession, sf: str) -> DataFrame:
    return scanned.repaired(table(spark, sf, "chunks")).select("chunk_id", "text")


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), "doc_id", "text")


def p8_summary(spark: SparkSession, sf: str) -> DataFrame:
    """What every packing must keep: all texts have a container, none is over capacity, only texts that exceed one are split, and
    the containers are at least 95 % full."""
    p = packing.pack(table(spark, sf, "documents"), "doc_id", "text")
    bins = p.groupBy("container").agg(F.sum("size").alias("used"))
    texts = p.groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum("size").alias("tokens"))
    b = bins.agg(F.count_if(F.col("used") > 2048).alias("over"), (F.sum("used") >= 0.95 * 2048 * (F.count("*") - 1)).alias("full"))
    t = texts.agg(F.count("*").alias("texts"), F.count_if((F.col("parts") > 1) & (F.col("tokens") <= 2048)).alias("split"))
    return t.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").select("texts", "over", "split", "full")


def _p9(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf, "documents"), table(spark, sf, "heldout_items"), "doc_id", "text", "item_id", "text")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _p9(spark, sf).select("item_id", "doc_id")


def p9_items(spark: SparkSession, sf: str) -> DataFrame:
    """Which items leaked, and into how many documents."""
    return _p9(spark, sf).groupBy("item_id").agg(F.count("*").alias("docs"), F.max("runs").alias("most_runs"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncated.cut_texts(table(spark, sf, "documents"), "doc_id", "text", "source").filter("cut").select("doc_id")


def p10_sources(spark: SparkSession, sf: str) -> DataFrame:
    return truncated.by_source(truncated.cut_texts(table(spark, sf, "documents"), "doc_id", "text", "source"), "source")


QUERIES = {f.__name__: f for f in (p2_found, p2_confidence, p3_found, p6_found, p6_unmatched, p7_found, p7_text, p8_containers, p8_summary, p9_found, p9_items, p10_found, p10_sources)}
_P9 = """
with w as (select item_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) ws from heldout_items),
     d as (select doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) ws from documents),
     gi as (select distinct item_id, array_to_string(ws[k:k + 12], ' ') g from w, unnest(range(1, len(ws) - 11)) r(k)),
     gd as (select doc_id, array_to_string(ws[k:k + 12], ' ') g from d, unnest(range(1, len(ws) - 11)) r(k))"""

ORACLE: dict[str, str] = {
    "p8_summary": "select count(distinct doc_id) as texts, 0::bigint as over, 0::bigint as split, true as full from documents",
    "p9_found": _P9 + " select distinct item_id, doc_id from gi join gd using (g)",
    "p9_items": _P9
    + """, per as (select item_id, doc_id, count(distinct gd.g) n from gi join gd using (g) group by 1, 2)
    select item_id, count(*) as docs, max(n) as most_runs from per group by 1""",
}
