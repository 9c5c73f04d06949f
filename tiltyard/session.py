"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(master: str | None = None, app: str = "tiltyard", **conf: str) -> SparkSession:
    """A session with the settings the engine expects: UTC, AQE with skew joins, Arrow.

    Sizes (shuffle partitions, memory) are left to the cluster unless given in ``conf``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Unset, a temporary one is made in local mode, and a cluster is refused.

    On a cluster a temporary folder would be another one on each node, so that written tables could not be read back whole.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tiltyard-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tiltyard-{tag}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends here and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, tag)
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the catalogue folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame) -> int:
    """The size of the tables that df reads. (Spark's own estimate behind a join is a product.)"""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)  # rows made in memory have no size


def _pieces(df: DataFrame, per_core: int) -> int:
    """Partitions for Python work: a few for each core, more where the tables read are larger than 64 MB for each of them."""
    return max(per_core * df.sparkSession.sparkContext.defaultParallelism, input_bytes(df) >> 26)


def spread(df: DataFrame, *by: str, per_core: int = 3) -> DataFrame:
    """df in enough partitions to keep every core busy with Python work.

    Rows of a plain scan stay where they are read wherever the scan has a split for each core, as it does on all but small
    tables: no text is shuffled. A table in fewer splits (one small file), or rows behind a shuffle, whose partitions AQE may
    have drawn together, are parted by key.
    """
    q = df._jdf.queryExecution()
    adaptive = q.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec"
    if not adaptive and q.toRdd().getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(_pieces(df, per_core), *by)


def distinct_by(df: DataFrame, *by: str, per_core: int = 3) -> DataFrame:
    """One row per key, in enough partitions for Python work: parted by key once, which the removal of duplicates uses too."""
    return df.repartition(_pieces(df, per_core), *by).dropDuplicates(list(by))


def committed(spark: SparkSession, path: str) -> list[int]:
    """The numbers n of the tables path/v=n that were written to the end, ascending."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    mark = lambda n: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit() and fs.exists(mark(n)))
