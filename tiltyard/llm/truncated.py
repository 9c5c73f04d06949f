"""Text cut off by field limits: hidden limits per source found under several encodings, then inspection of the endings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltyard.llm import endings
from tiltyard.session import cut, spread


#: The ways of counting that are tried, simplest first.
ENCODINGS = ("chars", "utf8", "utf16", "chars_crlf", "utf8_crlf", "chars_html", "utf8_html", "chars_json", "utf8_json", "ascii_json")


def measures(t: str) -> list[int]:
    """The length of a text as stores with different encodings and escapes count it, in the order of ENCODINGS."""
    n = len(t)
    b = n if t.isascii() else len(t.encode("utf-8", "replace"))
    u = n if b == n else len(t.encode("utf-16-le", "replace")) // 2
    astral, other = u - n, 0 if b == n else n - len(t.encode("ascii", "ignore"))
    crlf = t.count("\n") - t.count("\r\n")
    html = 4 * t.count("&") + 3 * (t.count("<") + t.count(">")) + 5 * t.count('"') + 4 * t.count("'")
    json = sum(map(t.count, '"\\\n\r\t'))
    return [n, b, u, n + crlf, b + crlf, n + html, b + html, n + json, b + json, n + json + 5 * other + 6 * astral]


def piles(texts: DataFrame, source: str, least: int = 5, over: float = 12.0, different: int = 3) -> DataFrame:
    """(source, encoding, size): lengths at which the texts of a source pile up, counted under each encoding.

    texts: one row per different text, with its source, a map of measures and its number of copies. All texts count, whatever
    their ending. A length is a pile where at least `least` texts have it, `different` of them not copies of each other, and
    `over` times what its 64 neighbours hold on average. Counting is by (source, encoding, length): partial sums, then one row
    per length.
    """
    h = texts.select(source, "copies", F.explode("sizes").alias("encoding", "size")).groupBy(source, "encoding", "size").agg(F.sum("copies").alias("texts"), F.count("*").alias("different"))
    near = h.withColumn("near", F.expr(f"sum(texts) over (partition by {source}, encoding order by size range between 32 preceding and 32 following)"))
    return near.filter((F.col("size") > 0) & (F.col("texts") >= least) & (F.col("different") >= different) & (F.col("texts") >= over * (F.col("near") - F.col("texts")) / 64)).select(source, "encoding", "size")


def hidden_limits(rated: DataFrame, source: str, least: int = 5, over: float = 12.0, share: float = 0.5) -> DataFrame:
    """(source, encoding, size, texts): the limits of each source, all of them.

    rated: texts with source, text_hash, sizes and whether they break off if judged as a text at a limit is. A pile of lengths is a limit where
    at least `share` of its texts break off. A text in several piles (one limit seen under several encodings) counts for the
    pile with most broken texts, of equal ones for the simplest encoding; a limit keeps at least `least` texts of its own.
    """
    texts = rated.filter(F.col(source).isNotNull()).groupBy(source, "text_hash").agg(F.first("sizes").alias("sizes"), F.first("broken").alias("broken"), F.count("*").alias("copies"))
    p = piles(texts, source, least, over)
    at = texts.select(source, "text_hash", "broken", "copies", F.explode("sizes").alias("encoding", "size")).join(p, [source, "encoding", "size"])
    full = at.groupBy(source, "encoding", "size").agg(F.sum("copies").alias("n"), F.sum(F.when(F.col("broken"), F.col("copies"))).alias("cut")).filter(F.col("cut") >= share * F.col("n")).drop("n")
    rank = F.struct(F.col("cut"), F.negative(F.array_position(F.array(*map(F.lit, ENCODINGS)), F.col("encoding"))), F.negative(F.col("size")))
    own = at.filter("broken").join(full, [source, "encoding", "size"]).groupBy(source, "text_hash").agg(F.max_by(F.struct("encoding", "size"), rank).alias("m"), F.first("copies").alias("copies"))
    return own.groupBy(source, F.col("m.encoding").alias("encoding"), F.col("m.size").alias("size")).agg(F.sum("copies").alias("texts")).filter(F.col("texts") >= least)


def inspect(df: DataFrame, row: str, text: str, source: str) -> DataFrame:
    """(row, source, sizes, text_hash, kind, keys) of the texts: lengths, and how each ends. Written to the shared folder, as it is read twice."""
    row_type = df.schema[row].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = endings._Hashes()
        for b in batches:
            kinds, keys, sizes = [], [], []
            for t in b.column("_t").to_pylist():
                kind, rest = endings.finished(t or "")
                kinds.append(kind)
                sizes.append(measures(t or ""))
                keys.append(endings.keys_of_end(rest, hashes) if kind in ("open", "dots") else None)
            i = b.schema.names.index("_t")
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(b.columns) if k != i), pa.array(sizes, pa.list_(pa.int32())), pa.array(kinds, pa.string()), pa.array(keys, pa.list_(pa.int64()))], names=[*(n for n in b.schema.names if n != "_t"), "sizes", "kind", "keys"])

    t = F.col(text).cast("string")
    tab = df.select(F.col(row).alias("_r"), F.col(source).alias("_s"), F.xxhash64(t).alias("text_hash"), t.alias("_t"))
    out = tab.mapInArrow(run, f"_r {row_type}, _s string, text_hash long, sizes array<int>, kind string, keys array<long>")
    names = F.array(*(F.lit(k) for k in ENCODINGS))
    return cut(out.select(F.col("_r").alias(row), F.col("_s").alias(source), F.map_from_arrays(names, "sizes").alias("sizes"), "text_hash", "kind", "keys"), "ends")


def cut_texts(df: DataFrame, row: str, text: str, source: str) -> DataFrame:
    """(row, source, kind, cut, at_limit, limits) for every text.

    cut: it breaks off in mid-word or mid-sentence. Null, empty and blank texts are not cut. A text that ends with a full stop
    is not cut, whatever its length. Dots are a cut unless the words before them elsewhere end sentences, or what begins like the
    last sentence elsewhere ends in dots too; where nothing like either is seen elsewhere, they are taken for the author's. A text without a
    full stop is cut unless its last line is of a kind that elsewhere ends without one (list items, sign-offs, links) and its
    last words are seen to end lines or sentences; a text at a limit of its source needs the stronger evidence. Repeated rows
    give repeated results. limits: those of the source, as text.
    """
    df = spread(df.select(row, text, source), row)
    ends = inspect(df, row, text, source)
    rated = endings.with_rates(ends, df, text, row)
    seen = F.col("word_rate").isNotNull() | F.col("head_rate").isNotNull()
    line, stop, head, dots, word = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("line_rate", "stop_rate", "head_rate", "dots_rate", "word_rate"))

    def broken(at: Column) -> Column:
        whole_line = (head >= F.when(at, 0.8).otherwise(0.5)) & (word > 0.02)
        whole_end = ~at & (line >= 0.7) & (F.col("head_rate").isNull() | (head >= 0.2))
        by_kind = F.when(F.col("kind").isin("blank", "stop"), False).when(F.col("kind").isin("marker", "markup"), True)
        return by_kind.when(F.col("kind") == "dots", seen & (stop < 0.4) & (dots < 0.5)).otherwise(~whole_line & ~whole_end)

    rated = cut(rated.withColumn("broken", broken(F.lit(True))).drop("keys"), "rated")
    each = hidden_limits(rated, source).groupBy(F.col(source).alias("_ls"))
    limits = each.agg(F.sort_array(F.collect_list(F.struct("encoding", "size"))).alias("_limits"))  # a handful for each source
    j = rated.join(limits, F.col(source) == F.col("_ls"), "left")

    def reached(x: Column) -> Column:
        # a store that counts bytes drops the rest of a character it would have to split
        slack = F.when(x["encoding"].startswith("utf8"), 3).otherwise(0)
        size = F.element_at("sizes", x["encoding"])
        return (size <= x["size"]) & (size >= x["size"] - slack)

    at = F.coalesce(F.exists("_limits", reached), F.lit(False))
    text_of = F.array_join(F.transform("_limits", lambda x: F.concat_ws(" ", x["size"].cast("string"), x["encoding"])), ", ")
    return j.select(row, source, "kind", broken(at).alias("cut"), at.alias("at_limit"), text_of.alias("limits"), "line_rate", "stop_rate", "head_rate", "word_rate")


def by_source(cuts: DataFrame, source: str) -> DataFrame:
    """How often each source cuts, and the limits found for it."""
    return cuts.groupBy(source).agg(
        F.count("*").alias("texts"),
        F.count_if("cut").alias("cut_texts"),
        F.round(F.count_if("cut") / F.count("*"), 6).alias("cut_rate"),
        F.max("limits").alias("limits"),
        F.count_if(F.col("cut") & F.col("at_limit")).alias("cut_at_limit"),
    )
