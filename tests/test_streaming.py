import datetime as dt

from tiltyard.streaming import feed as S

SCHEMA = "key string, at timestamp"
T0 = dt.datetime(2025, 1, 1)


def add(spark, path, *rows):
    spark.createDataFrame([(k, T0 + dt.timedelta(minutes=m)) for k, m in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def counts(state):
    return {r["key"]: r["n"] for r in state.read().collect()}


def test_state_survives_a_restart(spark, tmp_path):
    src, cp, st = f"file://{tmp_path}/in", f"file://{tmp_path}/cp", f"file://{tmp_path}/state"
    add(spark, src, ("a", 0), ("a", 1))
    assert counts(S.count_view(spark, S.read_feed(spark, src, SCHEMA), ["key"], cp, S.StateTable(spark, "key string, n long", st))) == {"a": 2}
    add(spark, src, ("a", 2), ("b", 3))
    assert counts(S.count_view(spark, S.read_feed(spark, src, SCHEMA), ["key"], cp, S.StateTable(spark, "key string, n long", st))) == {"a": 3, "b": 1}


def test_a_batch_run_again_counts_once(spark, tmp_path):
    st = S.StateTable(spark, "key string, n long", f"file://{tmp_path}/state")
    one = spark.createDataFrame([("a", 1)], "key string, n long")
    for batch in (0, 1, 1, 1):
        st.write(st.read(batch).unionByName(one).groupBy("key").agg({"n": "sum"}).toDF("key", "n"), batch)
    assert counts(st) == {"a": 2}


def test_a_version_that_was_not_finished_is_not_read(spark, tmp_path):
    st = S.StateTable(spark, "key string, n long", f"file://{tmp_path}/state")
    st.write(spark.createDataFrame([("a", 1)], "key string, n long"), 0)
    (tmp_path / "state" / "v=1").mkdir()
    assert counts(S.StateTable(spark, "key string, n long", f"file://{tmp_path}/state")) == {"a": 1}


def test_late_rows_are_dropped_behind_the_watermark(spark, tmp_path):
    src, cp = f"file://{tmp_path}/in", f"file://{tmp_path}/cp"
    got = {}

    def handle(batch, n):
        got.update({(r["start"], r["key"]): r["n"] for r in batch.collect()})

    for rows in ([("a", 0), ("a", 600)], [("a", 5), ("a", 601)], [("a", 6), ("a", 2000)]):
        add(spark, src, *rows)
        q = S.windowed_counts(S.read_feed(spark, src, SCHEMA), "at", "key", late="1 hour").writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination()
    # minutes 5 and 6 come when the watermark has passed their window
    assert got == {(T0, "a"): 1, (T0 + dt.timedelta(hours=10), "a"): 2, (T0 + dt.timedelta(hours=33), "a"): 1}


def test_sessions_and_low_watermark(spark):
    df = spark.createDataFrame([("a", T0), ("a", T0 + dt.timedelta(minutes=20)), ("a", T0 + dt.timedelta(minutes=90)), (None, T0)], SCHEMA)
    got = sorted((r["key"] or "", r["n"]) for r in S.sessions(df, "key", "at").collect())
    assert got == [("", 1), ("a", 1), ("a", 2)]
    assert S.low_watermark(df, "at") == T0 + dt.timedelta(minutes=90) and S.low_watermark(df.limit(0), "at") is None
