"""Applying a stream of inserts, updates and deletes with delete vectors (merge on read).

A table is a folder of immutable row files, an index key -> (file, position), one deletion bitmap per file, and a manifest per
version. A batch of changes is folded to one state per key, the key's live row is found through the index, its bit is set, and
the new image is appended. Readers drop the positions whose bit is set. The folded state of a key is a commutative,
idempotent monoid, so repeated and out-of-order deliveries, even across batches, give the same table:

    ended   the greatest position of a delete
    made    the greatest position of an insert or update
    value   the values with the greatest position among the changes that sent them

A key exists where made > ended; a value holds where its position is greater than ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from tiltyard.session import committed, cut, input_bytes, scratch

#: Spellings of the operations, lower case.
DELETE_OPS = ("delete", "d", "tombstone", "remove", "del")
INSERT_OPS = ("insert", "i", "create", "add", "c")

_BITS = 32768  # positions of one bitmap: those of bitmap_construct_agg


def _position(seq: Column, ts: Column) -> Column:
    """Order of a change within its key: by sequence number, else by time; changes without a number precede those with one."""
    return F.struct(seq.isNotNull().cast("int").alias("k"), F.coalesce(seq, F.unix_micros(ts.cast("timestamp")), F.lit(-(2**63))).alias("v"))


def fold(changes: DataFrame, key: str, op: str, seq: str, ts: str, values: list[str]) -> DataFrame:
    """One state row per key: (key, ended, made, v_<value> = struct(p, v)).

    An insert sends all its values, nulls included; an update sends those that are not null. Changes with a null key or an
    unknown null operation are dropped; other unknown operations count as updates. Partial aggregates run before the
    shuffle, so that a key with a large share of all changes costs one row per task.
    """
    o = F.lower(F.trim(F.col(op)))
    gone, put = o.isin(*DELETE_OPS), o.isin(*INSERT_OPS)
    c = changes.select(
        F.col(key).alias("key"), _position(F.col(seq), F.col(ts)).alias("p"), gone.alias("gone"), put.alias("put"), *(F.col(v).alias(f"x_{i}") for i, v in enumerate(values))
    ).filter("key is not null and gone is not null")
    sent = lambda i: ~F.col("gone") & (F.col("put") | F.col(f"x_{i}").isNotNull())
    return c.groupBy("key").agg(
        F.max(F.when(F.col("gone"), F.col("p"))).alias("ended"),
        F.max(F.when(~F.col("gone"), F.col("p"))).alias("made"),
        *(F.max(F.when(sent(i), F.struct(F.col("p").alias("p"), F.col(f"x_{i}").alias("v")))).alias(f"v_{i}") for i in range(len(values))),
    )


class MergeOnReadTable:
    """A keyed table in a folder, opened at its last complete version, made where there is none.

        data/v=N/bucket=B      row files of the batch that made version N
        index/v=N/bucket=B     key -> (file, position) of those rows
        dv/v=N                 the bitmaps of superseded positions, as of version N
        manifest/v=N           one row: the segments, bitmaps and counts of version N

    A key's bucket is a hash of it, so a batch reads the index of the buckets that it touches and the row files that hold what
    it supersedes, no others. Nothing is rewritten in place and the manifest comes last: a task that is lost and run again
    can't corrupt the table, and a failed batch leaves the former version. Once more than `dead_share` of the rows are dead,
    the live ones are written anew as one segment.
    """

    def __init__(self, spark: SparkSession, path: str, values: list[str], buckets: int = 16, dead_share: float = 0.7):
        self.spark, self.path, self.values, self.buckets, self.dead_share = spark, path, values, buckets, dead_share
        self.version, self.segments, self.dv, self.rows, self.dead = 0, [], 0, 0, 0
        self.schema: StructType | None = None
        done = committed(spark, f"{path}/manifest")
        if done:
            m = spark.read.parquet(f"{path}/manifest/v={done[-1]}").first()
            if list(m["values"]) != list(values):
                raise ValueError(f"the table holds {list(m['values'])}")
            self.version, self.segments, self.dv, self.rows, self.dead, self.buckets = done[-1], list(m["segments"]), m["dv"], m["rows"], m["dead"], m["buckets"]
            self.schema = self.spark.read.parquet(f"{path}/data/v={self.segments[0]}").schema if self.segments else None

    @property
    def _state(self) -> list[str]:
        return ["ended", "made", *(f"v_{i}" for i in range(len(self.values)))]

    def _read(self, kind: str, segments: list[int]) -> DataFrame:
        fields = self.schema.fields if kind == "data" else [self.schema["key"], StructField("file", StringType()), StructField("pos", LongType()), StructField("bucket", IntegerType())]
        r = self.spark.read.option("basePath", f"{self.path}/{kind}").schema(StructType([*fields, StructField("v", IntegerType())]))
        return r.parquet(*(f"{self.path}/{kind}/v={n}" for n in segments))

    def _placed(self, segments: list[int]) -> DataFrame:
        """The stored rows, dead ones too, with _file and _pos."""
        at = F.concat_ws("/", F.col("v").cast("string"), F.col("bucket").cast("string"), F.col("_metadata.file_name"))
        return self._read("data", segments).select("key", *self._state, "v", "bucket", at.alias("_file"), F.col("_metadata.row_index").alias("_pos"))

    def live(self) -> DataFrame:
        """The stored rows whose bit is not set, with _file and _pos. The bitmaps (4 KB for 32,768 rows) are joined, never collected."""
        rows = self._placed(self.segments).select("key", *self._state, "_file", "_pos")
        if not self.dv:
            return rows
        dv = self.spark.read.parquet(f"{self.path}/dv/v={self.dv}")
        byte = f"cast(conv(hex(substring(bits, cast((_pos % {_BITS}) div 8 as int) + 1, 1)), 16, 10) as int)"
        bit = F.expr(f"coalesce(shiftright({byte}, cast(_pos % 8 as int)) & 1, 0)")
        on = (rows["_file"] == dv["file"]) & (F.expr(f"_pos div {_BITS}") == dv["part"])
        return rows.join(dv, on, "left").filter(bit == 0).select("key", *self._state, "_file", "_pos")

    def locate(self, keys: DataFrame) -> DataFrame:
        """(key, bucket, v, _file, _pos) of the live rows of keys (key, bucket), by the index; keys without a row give none."""
        touched = [r[0] for r in keys.select("bucket").distinct().collect()]  # at most self.buckets numbers
        index = self._read("index", self.segments).filter(F.col("bucket").isin(touched))
        # a key's live row is that of its latest version
        j = index.join(keys.select("key", "bucket"), ["bucket", "key"], "left_semi")
        return j.groupBy("bucket", "key").agg(F.max(F.struct("v", "file", "pos")).alias("m")).select("key", "bucket", "m.v", F.col("m.file").alias("_file"), F.col("m.pos").alias("_pos"))

    def _append(self, rows: DataFrame, n: int) -> None:
        """Writes a segment and its index. rows: (bucket, key, state columns, further columns)."""
        rows.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={n}")
        self.schema = self.schema or StructType([*(f for f in rows.schema.fields if f.name != "bucket"), StructField("bucket", IntegerType())])
        new = self._placed([n]).select("key", "bucket", F.col("_file").alias("file"), F.col("_pos").alias("pos"))
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/index/v={n}")

    def _commit(self, n: int, segments: list[int], dv: int, rows: int, dead: int) -> None:
        m = [(segments, dv, rows, dead, self.buckets, self.values)]
        self.spark.createDataFrame(m, "segments array<int>, dv int, rows long, dead long, buckets int, values array<string>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={n}")
        self.version, self.segments, self.dv, self.rows, self.dead = n, segments, dv, rows, dead

    def apply(self, states: DataFrame) -> None:
        """Merges folded states into the table: a new segment, its index and a new version of the bitmaps. An empty batch changes nothing."""
        n = self.version + 1
        s = states.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))
        if self.segments:
            s = cut(s, "batch")
            hits = cut(self.locate(s), "hits")
            place = F.concat_ws("/", F.col("v").cast("string"), F.col("bucket").cast("string"))
            held = {r[0]: r[1] for r in hits.groupBy(place).count().collect()}  # at most one row a segment and bucket
            old = self._placed(self.segments).filter(place.isin(list(held)))
            old = old.join(hits.select("_file", "_pos"), ["_file", "_pos"], "left_semi").alias("o")
            s = s.alias("s")
            new = s.join(old, (F.col("s.key") == F.col("o.key")) & (F.col("s.bucket") == F.col("o.bucket")), "left").select("s.bucket", "s.key", *(F.greatest(f"s.{c}", f"o.{c}").alias(c) for c in self._state))
        else:
            new = s.select("bucket", "key", *self._state)
        self._append(new, n)
        added = self._read("index", [n]).count()
        if not added:
            return
        dv, dead = self.dv, self.dead
        if self.segments:
            gone = hits.groupBy(F.col("_file").alias("file"), F.expr(f"_pos div {_BITS}").alias("part"))
            marks = gone.agg(F.bitmap_construct_agg(F.expr(f"_pos % {_BITS}")).alias("bits"))
            if self.dv:
                former = self.spark.read.parquet(f"{self.path}/dv/v={self.dv}")
                marks = marks.unionByName(former).groupBy("file", "part").agg(F.bitmap_or_agg("bits").alias("bits"))
            marks.write.mode("overwrite").parquet(f"{self.path}/dv/v={n}")
            dv, dead = n, dead + sum(held.values())
        self._commit(n, [*self.segments, n], dv, self.rows + added, dead)
        if self.dead > self.dead_share * self.rows:
            self.compact()

    def compact(self) -> None:
        """Writes the live rows as one segment with a new index and no bitmaps. Readers of the former version are not disturbed."""
        n = self.version + 1
        rows = self.live().withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")).select("bucket", "key", *self._state)
        self._append(rows, n)
        self._commit(n, [n], 0, self.rows - self.dead, 0)

    def current(self, key: str) -> DataFrame:
        """The keys that exist, with their values."""
        held = lambda i: F.when(F.col("ended").isNull() | (F.col(f"v_{i}.p") > F.col("ended")), F.col(f"v_{i}.v"))
        rows = self.live().filter("made is not null and (ended is null or made > ended)")
        return rows.select(F.col("key").alias(key), *(held(i).alias(v) for i, v in enumerate(self.values)))


def apply_feed(changes: DataFrame, key: str, op: str, seq: str, ts: str, arrival: str, values: list[str], batches: int = 3, buckets: int | None = None) -> DataFrame:
    """The current rows (key, values) after all changes, applied in batches by time of arrival (null: last).

    Equal positions of a key are repeats. Where repeats disagree, the greatest value wins, whatever the order of delivery. An
    empty feed gives an empty table. buckets: one for each 64 MB of the feed, if not given. Columns of the feed beyond those named are not read.
    """
    spark = changes.sparkSession
    t = MergeOnReadTable(spark, scratch(spark, "mor"), values, buckets or max(4, input_bytes(changes) >> 26))
    at = F.unix_micros(F.col(arrival).cast("timestamp"))
    q = changes.select(F.percentile_approx(at, [k / batches for k in range(1, batches)], 1000).alias("q")).first()["q"] if batches > 1 else None
    bounds = sorted(set(q or []))
    # literal timestamps, so that the filters reach the scan
    lit = [F.timestamp_micros(F.lit(b)).cast(changes.schema[arrival].dataType) for b in bounds]
    for k in range(len(bounds) + 1):
        c = F.col(arrival)
        part = F.lit(True)
        if k > 0:
            part = part & (c > lit[k - 1])
        part = part & (c <= lit[k]) if k < len(bounds) else part | c.isNull()
        t.apply(fold(changes.filter(part), key, op, seq, ts, values))
    if not t.segments:
        return changes.select(key, *values).limit(0)
    return t.current(key)
