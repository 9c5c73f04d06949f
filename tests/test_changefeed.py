import datetime as dt
import random

from tiltyard.operators import changefeed as C

T0 = dt.datetime(2025, 1, 1)
SCHEMA = "id string, op string, hash string, ts timestamp, seq long, at timestamp, key string"


def brute(rows):
    """Changes of each key sorted by position and replayed."""
    out = {}
    by = {}
    for r in rows:
        if r[0] is not None and r[1] is not None:
            by.setdefault(r[0], []).append(r)
    for k, rs in by.items():
        state = None
        pos = lambda r: r[4] if r[4] is not None else r[3].timestamp() if r[3] else -1
        for r in sorted(rs, key=pos):
            if r[1].strip().lower() in C.DELETE_OPS:
                state = None
            else:
                state = (r[2] if r[2] is not None or r[1].strip().lower() in C.INSERT_OPS else state[0] if state else None,)
        if state:
            out[k] = state[0]
    return out


def feed(seed, keys=12, n=160):
    rng = random.Random(seed)
    rows = []
    for k in range(keys):
        numbered = rng.random() < 0.7
        for i in range(rng.randint(1, n // keys)):
            op = rng.choice(["insert", "I", "update", "UPDATE", "replace", "delete", "D", " tombstone "])
            h = None if op.lower() in ("update", "replace") and rng.random() < 0.4 else f"h{rng.randint(0, 9)}"
            if op == "insert" or op == "I":
                h = h or "h"
            r = (f"d{k}", op, h, T0 + dt.timedelta(minutes=i), 10 * i if numbered else None, T0 + dt.timedelta(minutes=rng.randint(0, 400)), "x")
            rows += [r] * rng.choice([1, 1, 2])
    rng.shuffle(rows)
    return rows


def test_replay_in_any_order_and_batches(spark):
    for seed in range(2):
        rows = feed(seed)
        want = brute(rows)
        df = spark.createDataFrame(rows, SCHEMA)
        for batches in (1, 4):
            got = {r.id: r.hash for r in C.apply_feed(df, "id", "op", "seq", "ts", "at", ["hash"], batches, 2).collect()}
            assert got == want, (seed, batches)


def test_delete_vectors_hide_superseded_rows(spark, tmp_path):
    t = C.MergeOnReadTable(spark, f"file://{tmp_path}/t", ["hash"], 2)
    rows = [[("a", "insert", "1", T0, 1, T0, ""), ("b", "insert", "1", T0, 1, T0, "")], [("a", "update", "2", T0, 2, T0, "")], [("a", "delete", None, T0, 3, T0, ""), ("c", "update", "9", T0, 1, T0, "")]]
    for r in rows:
        t.apply(C.fold(spark.createDataFrame(r, SCHEMA), "id", "op", "seq", "ts", ["hash"]))
    assert t._read("data", t.segments).count() == 5
    assert t.live().count() == 3  # one image per key; the former ones are hidden by bits
    assert {(r.id, r.hash) for r in t.current("id").collect()} == {("b", "1"), ("c", "9")}


def test_nulls_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.apply_feed(empty, "id", "op", "seq", "ts", "at", ["hash"], buckets=2).count() == 0
    rows = [(None, "insert", "1", T0, 1, T0, ""), ("a", None, "1", T0, 1, T0, ""), ("b", "insert", None, None, None, None, ""), ("c", "update", "x" * 100_000, None, None, None, "")]
    got = {r.id: r.hash for r in C.apply_feed(spark.createDataFrame(rows, SCHEMA), "id", "op", "seq", "ts", "at", ["hash"], buckets=2).collect()}
    assert got == {"b": None, "c": "x" * 100_000}


def batch(spark, *rows):
    return C.fold(spark.createDataFrame([(k, op, h, T0, n, T0, "") for k, op, h, n in rows], SCHEMA), "id", "op", "seq", "ts", ["hash"])


def test_reopened_where_it_was_left(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    C.MergeOnReadTable(spark, at, ["hash"], 2).apply(batch(spark, ("a", "insert", "1", 1), ("b", "insert", "1", 1)))
    t = C.MergeOnReadTable(spark, at, ["hash"], 2)
    t.apply(batch(spark, ("a", "update", "2", 2)))
    t.apply(batch(spark))
    # a batch that failed before its manifest: files without one
    t._append(batch(spark, ("b", "update", "lost", 9)).selectExpr("0 as bucket", "key", "ended", "made", "v_0"), t.version + 1)
    t = C.MergeOnReadTable(spark, at, ["hash"], 2)
    assert (t.version, t.rows, t.dead) == (2, 3, 1)
    assert {(r.id, r.hash) for r in t.current("id").collect()} == {("a", "2"), ("b", "1")}
    t.apply(batch(spark, ("b", "delete", None, 5)))
    assert {(r.id, r.hash) for r in C.MergeOnReadTable(spark, at, ["hash"], 2).current("id").collect()} == {("a", "2")}


def test_index_finds_the_live_row_only(spark, tmp_path):
    t = C.MergeOnReadTable(spark, f"file://{tmp_path}/t", ["hash"], 2, dead_share=2.0)
    for n in range(1, 4):
        t.apply(batch(spark, ("a", "update", str(n), n), (f"x{n}", "insert", "0", 1)))
    keys = spark.createDataFrame([("a",), ("none",)], "key string").selectExpr("key", f"cast(pmod(xxhash64(key), {t.buckets}) as int) bucket")
    assert [(r.key, r.v) for r in t.locate(keys).collect()] == [("a", 3)]
    assert (t.rows, t.dead) == (6, 2)


def test_compaction_keeps_rows(spark, tmp_path):
    t = C.MergeOnReadTable(spark, f"file://{tmp_path}/t", ["hash"], 2, dead_share=0.5)
    for n in range(1, 5):
        t.apply(batch(spark, ("a", "update", str(n), n), ("b", "update", str(n), n)))
    assert len(t.segments) < 4 and t.dead <= t.rows / 2
    assert {(r.id, r.hash) for r in t.current("id").collect()} == {("a", "4"), ("b", "4")}
