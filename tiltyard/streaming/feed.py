"""The change feed as a stream: file source, retry budget, hash idempotence, incremental views, watermarked windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltyard.session import committed, scratch

BUDGET = 3  # attempts after which a document is left alone


def read_feed(spark: SparkSession, path: str, schema: str, per_batch: int = 100) -> DataFrame:
    """A stream over the Parquet files of a folder, a bounded number of files in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def drain(df: DataFrame, handle, checkpoint: str) -> None:  # noqa: ANN001
    """Runs a stream over all that is there and ends: backfill and tests."""
    q = df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def ingest_outcomes(batch: DataFrame, state: DataFrame, key: str, content_hash: str, kind: str, types: list[str]) -> DataFrame:
    """Adds outcome to a batch of changes: empty_id, over_budget, type_filtered, hash_unchanged or process.

    state: (key, last_hash, attempts). A null last hash is processed; a null content hash is processed and not recorded.
    """
    j = batch.join(state.select(key, "last_hash", "attempts"), key, "left")
    o = (
        F.when(F.coalesce(F.trim(key), F.lit("")) == "", "empty_id")
        .when(F.coalesce("attempts", F.lit(0)) >= BUDGET, "over_budget")
        .when(~F.coalesce(F.col(kind).isin(*types), F.lit(False)), "type_filtered")
        .when(F.col(content_hash) == F.col("last_hash"), "hash_unchanged")
        .otherwise("process")
    )
    return j.withColumn("outcome", o).drop("last_hash", "attempts")


class StateTable:
    """A keyed state in the shared folder: one complete table v=n for each batch n, the last two of which are kept.

    A version counts once it is written to the end, so the state survives a restart. A batch reads the last version before
    its own number: run again after a failure, it starts from the same state and writes the same version again.
    """

    def __init__(self, spark: SparkSession, schema: str, path: str | None = None):
        self.spark, self.schema, self.path = spark, schema, path or scratch(spark, "state")

    def read(self, before: int | None = None) -> DataFrame:
        """The state ahead of batch `before`, or the last one; empty at first."""
        done = [n for n in committed(self.spark, self.path) if before is None or n < before]
        if not done:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={done[-1]}")

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={batch}")
        jvm = self.spark._jvm.org.apache.hadoop.fs
        for n in [n for n in committed(self.spark, self.path) if n < batch][:-1]:
            at = jvm.Path(f"{self.path}/v={n}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def count_view(spark: SparkSession, feed: DataFrame, keys: list[str], checkpoint: str, state: StateTable) -> StateTable:
    """Maintains counts per key over a feed: each batch is aggregated, then added to the state. Ends equal to the batch rollup."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        new = batch.groupBy(*keys).agg(F.count("*").alias("n"))
        state.write(state.read(batch_id).unionByName(new).groupBy(*keys).agg(F.sum("n").alias("n")), batch_id)

    drain(feed, handle, checkpoint)
    return state


def retry_budget(feed: DataFrame, key: str, failed: Column, checkpoint: str, state: StateTable) -> StateTable:
    """Failures per key over a feed, no further than the budget: rows of a key over budget are skipped, and never block a batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        new = batch.filter(failed).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("attempts"))
        merged = state.read(batch_id).unionByName(new).groupBy("key").agg(F.least(F.sum("attempts"), F.lit(BUDGET).cast("bigint")).alias("attempts"))
        state.write(merged, batch_id)

    drain(feed, handle, checkpoint)
    return state


def windowed_counts(feed: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts per window and kind; rows later than the watermark are dropped, and state older than it is freed. Sliding where slide is given."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return feed.withWatermark(at, late).groupBy(w, kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def sessions(feed: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions per key: events no further apart than gap."""
    return feed.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def low_watermark(processed: DataFrame, at: str) -> object:
    """The time from which an incremental fetch goes on: the latest processed one, null at first."""
    return processed.agg(F.max(at)).first()[0]
