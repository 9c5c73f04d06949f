"""Ranking: exact cosine neighbours, BM25, reciprocal-rank fusion, reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unit(df: DataFrame, vec: str) -> DataFrame:
    """Vectors scaled to length one, so that the cosine is a dot product; zero vectors stay."""
    norm = F.sqrt(F.aggregate(F.transform(vec, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
    return df.withColumn("_u", F.when(norm > 0, F.transform(vec, lambda x: x.cast("double") / norm)).otherwise(F.transform(vec, lambda x: x.cast("double"))))


def knn(queries: DataFrame, corpus: DataFrame, row: str, vec: str, k: int, block: int = 2000) -> DataFrame:
    """(query, row, score, rank): the k nearest rows of each query by cosine, itself left out; ties by row.

    Queries go to the workers in blocks of about `block` vectors, by a hash of their ids, so that no more than a block is in the
    driver at a time: the neighbours of a block are written to the shared folder before the next is read. Each worker keeps the
    best k of its rows for each query, and only those are shuffled: k rows per query and task, whatever the size of the corpus.
    Null vectors match nothing.
    """
    import numpy as np
    import pandas as pd

    from tiltyard.session import cut

    asked = queries.filter(F.col(vec).isNotNull()).select(row, vec)
    n = max(1, -(-asked.count() // block))
    row_type = corpus.schema[row].dataType.simpleString()
    schema = f"query {queries.schema[row].dataType.simpleString()}, `{row}` {row_type}, score double"
    c = corpus.filter(F.col(vec).isNotNull()).select(F.col(row).alias("i"), F.col(vec).alias("v"))
    out = None
    for at in range(n):
        part = [(r[0], r[1]) for r in (asked if n == 1 else asked.filter(F.pmod(F.xxhash64(row), F.lit(n)) == at)).collect()]

        def run(frames, part: list = part):  # noqa: ANN001, ANN202
            ids = np.array([q for q, _ in part])
            q = np.array([v for _, v in part], np.float64)
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12) if len(q) else q
            for f in frames:
                if not len(f) or not len(q):
                    continue
                x = np.array(f["v"].tolist(), np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                s, own = q @ x.T, f["i"].to_numpy()
                s[ids[:, None] == own[None, :]] = -np.inf
                n = min(k, s.shape[1])
                # the k-th best score decides; all rows that reach it stay, so ties are settled later
                cut = np.partition(s, -n, axis=1)[:, -n]
                a, b = np.nonzero((s >= cut[:, None]) & np.isfinite(s))
                yield pd.DataFrame({"query": ids[a], row: own[b], "score": s[a, b]})

        d = c.mapInPandas(run, schema)
        d = d if n == 1 else cut(_nearest(d, row, k), "neighbours")
        out = d if out is None else out.unionByName(d)
    return _nearest(out, row, k) if n == 1 else out


def _nearest(scored: DataFrame, row: str, k: int) -> DataFrame:
    w = W.partitionBy("query").orderBy(F.desc(F.round("score", 9)), row)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def tokens(df: DataFrame, row: str, text: str) -> DataFrame:
    """(row, t, tf): words of a text with their counts."""
    t = df.select(row, F.explode(F.split(F.lower(text), "[^a-z0-9]+")).alias("t")).filter("t <> ''")
    return t.groupBy(row, "t").agg(F.count("*").alias("tf"))


def bm25(df: DataFrame, row: str, text: str, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(row, score) of the rows that hold a query word. Only query words are counted per row; length and row count come from one pass."""
    t = df.select(row, F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "").alias("_t")).withColumn("_n", F.size("_t"))
    n, mean = t.agg(F.count("*"), F.avg("_n")).first()
    tf = t.select(row, "_n", F.explode(F.array(*(F.struct(F.lit(q).alias("t"), F.size(F.filter("_t", lambda x: x == q)).alias("tf")) for q in dict.fromkeys(query)))).alias("q")).select(row, "_n", "q.t", "q.tf").filter("tf > 0")
    df_ = tf.groupBy("t").agg(F.count("*").alias("df"))
    j = tf.join(F.broadcast(df_), "t")  # one row per query word
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    s = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("_n") / F.lit(mean or 1.0)))
    return j.groupBy(row).agg(F.sum(s).alias("score"))


def ranked(df: DataFrame, row: str, score: str, k: int, places: int = 6) -> DataFrame:
    """The top k by score, ties by row, with rank. Spark keeps k rows per task before the last sort."""
    top = df.withColumn(score, F.round(score, places)).orderBy(F.desc(score), row).limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), row)))


def fuse(a: DataFrame, b: DataFrame, row: str, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two rankings (row, rank)."""
    both = a.select(row, "rank").unionByName(b.select(row, "rank"))
    return both.groupBy(row).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def rerank(df: DataFrame, rank: str, score: str, first: int) -> DataFrame:
    """The first rows of a ranking ordered anew by score, the others behind them as they were."""
    w = W.orderBy(F.when(F.col(rank) <= first, 0).otherwise(1), F.when(F.col(rank) <= first, F.negative(F.col(score))).otherwise(F.lit(0.0)), rank)
    return df.withColumn("new_rank", F.row_number().over(w))
