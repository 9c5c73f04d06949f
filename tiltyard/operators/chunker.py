"""Hybrid chunker: running lines dropped, pages grouped to outline sections, overlapping token windows, short tails merged.

All of it is DataFrame operations: pages are rows, so a long document is spread over its pages until the sections are joined.
Tokens are runs of non-blank characters; a token protocol can replace the splitter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tokens of a window, of the overlap, the least tail, and when running lines are dropped.
WINDOW, OVERLAP, LEAST_TAIL, LEAST_PAGES, SHARE = 512, 51, 128, 3, 0.5


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def running_lines(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, header, footer): the first (last) line that most pages share, of documents with three pages or more.

    A page's last line counts only where it differs from its first; ties go to the line seen on the earliest page.
    """
    ls = pages.select(doc, page, _lines(F.col(text)).alias("ls"))
    ends = ls.select(doc, page, F.try_element_at("ls", F.lit(1)).alias("first"), F.when(F.size("ls") > 1, F.try_element_at("ls", F.lit(-1))).alias("last"))
    ends = ends.withColumn("last", F.when(F.col("last") != F.col("first"), F.col("last")))
    n = pages.groupBy(doc).agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_PAGES)

    def top(c: str, name: str) -> DataFrame:
        g = ends.filter(F.col(c).isNotNull()).groupBy(doc, c).agg(F.count("*").alias("k"), F.min(page).alias("p")).join(n, doc).filter(F.col("k") >= F.ceil(F.col("n") * SHARE))
        return g.groupBy(doc).agg(F.max_by(c, F.struct("k", F.negative(F.col("p")))).alias(name))

    return n.select(doc).join(top("first", "header"), doc, "left").join(top("last", "footer"), doc, "left")


def strip_running(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """Pages without their running header and footer; a page on which neither stands is left as it is."""
    r = running_lines(pages, doc, page, text)
    p = pages.join(r, doc, "left")
    ls = F.split(F.regexp_replace(F.regexp_replace(text, r"^(?:[ \t]*\n)+", ""), r"(?:\n[ \t]*)+$", ""), "\n")
    p = p.withColumn("_l", ls)
    p = p.withColumn("_h", F.trim(F.element_at("_l", 1)) == F.col("header")).withColumn("_f", F.trim(F.element_at("_l", -1)) == F.col("footer"))
    a = F.when(F.coalesce("_h", F.lit(False)), F.slice("_l", 2, F.greatest(F.lit(0), F.size("_l") - 1))).otherwise(F.col("_l"))
    p = p.withColumn("_l2", a)
    b = F.when(F.coalesce("_f", F.lit(False)) & (F.size("_l2") > 0), F.slice("_l2", 1, F.greatest(F.lit(0), F.size("_l2") - 1))).otherwise(F.col("_l2"))
    p = p.withColumn("_l3", b)
    body = F.when(F.coalesce("_h", F.lit(False)) | F.coalesce("_f", F.lit(False)), F.regexp_replace(F.regexp_replace(F.array_join("_l3", "\n"), r"^(?:[ \t]*\n)+", ""), r"(?:\n[ \t]*)+$", "")).otherwise(F.col(text))
    return p.withColumn(text, body).drop("_l", "_l2", "_l3", "_h", "_f", "header", "footer")


def windows(df: DataFrame, row: list[str], text: str, size: int = WINDOW, overlap: int = OVERLAP, tail: int = LEAST_TAIL) -> DataFrame:
    """(row, idx, tok_start, tok_end, body, token_count): windows of size tokens with overlap.

    A last window of fewer than `tail` tokens is joined to the one before it, which then ends with the text. Blank and null
    texts have no window; a text of up to `size` tokens has one.
    """
    step = max(1, size - overlap)
    d = df.select(*row, F.filter(F.split(text, r"[ \n\t\r]+"), lambda t: t != "").alias("_t")).withColumn("_n", F.size("_t")).filter("_n > 0")
    starts = F.filter(F.sequence(F.lit(0), F.col("_n"), F.lit(step)), lambda s: (s == 0) | (s - step + size < F.col("_n")))
    w = d.withColumn("_s", starts)
    short = (F.size("_s") > 1) & (F.col("_n") - F.element_at("_s", -1) < min(tail, size - 1))
    w = w.withColumn("_s", F.when(short, F.slice("_s", 1, F.size("_s") - 1)).otherwise(F.col("_s"))).withColumn("_k", F.size("_s"))
    w = w.select(*row, "_t", "_n", "_k", F.posexplode("_s").alias("idx", "tok_start"))
    end = F.when(F.col("idx") == F.col("_k") - 1, F.col("_n")).otherwise(F.least(F.col("tok_start") + size, F.col("_n")))
    w = w.withColumn("tok_end", end)
    return w.select(*row, "idx", "tok_start", "tok_end", F.array_join(F.slice("_t", F.col("tok_start") + 1, F.col("tok_end") - F.col("tok_start")), " ").alias("body"), (F.col("tok_end") - F.col("tok_start")).alias("token_count"))


def sections(pages: DataFrame, outline: DataFrame | None, doc: str, page: str, text: str) -> DataFrame:
    """(doc, section, heading, page, text): pages by outline section; what stands before the first entry is section 0 without heading.

    An entry ends before the next one begins; an entry whose next begins on the same page is skipped. Documents without an
    outline are one section. Blank pages are dropped.
    """
    p = pages.filter(F.trim(text) != "")
    if outline is None:
        return p.select(doc, F.lit(0).alias("section"), F.lit("").alias("heading"), page, text)
    o = outline.select(doc, F.col("title").alias("heading"), F.col("page").alias("_from"), F.col("pos").alias("_pos"))
    w = W.partitionBy(doc).orderBy("_pos")
    o = o.withColumn("_to", F.lead("_from").over(w) - 1).filter("_to is null or _to >= _from").withColumn("section", F.row_number().over(w))
    j = p.join(o, [doc], "left").filter(F.col("_from").isNull() | ((F.col(page) >= F.col("_from")) & (F.col("_to").isNull() | (F.col(page) <= F.col("_to")))))
    inside = j.filter("_from is not null").select(doc, "section", "heading", page, text)
    rest = p.join(inside.select(doc, page).distinct(), [doc, page], "left_anti").select(doc, F.lit(0).alias("section"), F.lit("").alias("heading"), page, text)
    return inside.unionByName(rest)


def chunk(pages: DataFrame, doc: str, page: str, text: str, outline: DataFrame | None = None, size: int = WINDOW, overlap: int = OVERLAP, tail: int = LEAST_TAIL) -> DataFrame:
    """(doc, chunk_index, heading, body, page_start, page_end, token_count) of paged documents."""
    s = sections(strip_running(pages, doc, page, text), outline, doc, page, text)
    s = s.withColumn("_c", F.size(F.filter(F.split(text, r"[ \n\t\r]+"), lambda t: t != "")))
    g = s.groupBy(doc, "section", "heading").agg(F.sort_array(F.collect_list(F.struct(F.col(page).alias("p"), F.col("_c").alias("c"), F.col(text).alias("x")))).alias("ps"))
    g = g.withColumn("_x", F.array_join(F.transform("ps", lambda p: p["x"]), "\n"))
    bounds = F.transform("ps", lambda p, i: F.struct(p["p"].alias("p"), F.aggregate(F.slice("ps", 1, i + 1), F.lit(0), lambda a, q: a + q["c"]).alias("e")))
    g = g.withColumn("_b", bounds)
    w = windows(g, [doc, "section", "heading", "_b"], "_x", size, overlap, tail)
    at = lambda pos: F.element_at(F.filter("_b", lambda b: b["e"] > pos), 1)["p"]
    w = w.withColumn("page_start", at(F.col("tok_start"))).withColumn("page_end", at(F.col("tok_end") - 1))
    n = F.row_number().over(W.partitionBy(doc).orderBy("section", "idx")) - 1
    return w.select(doc, n.alias("chunk_index"), "heading", "body", "page_start", "page_end", "token_count")
