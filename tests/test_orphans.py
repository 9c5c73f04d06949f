import datetime as dt
from calendar import timegm

from tiltyard.operators import orphans as O

D = lambda n: dt.datetime(2025, 1, n)
at = lambda key, n: f"{key}@{timegm(D(n).timetuple()) * 1_000_000}"  # noqa: E731  a life of a record
EDGES = [O.Edge("docs", "machine", "id", "at", "machines"), O.Edge("hits", "doc", "hit", "at", "docs")]
PARENTS = {"machines": O.Parent("id", "a", "b"), "docs": O.Parent("id", "at", "end")}


def tables(spark, hits):
    return {
        "machines": spark.createDataFrame([("M1", D(1), D(10)), ("M1", D(1), D(10)), ("M1", D(20), None), ("M2", D(5), None)], "id string, a timestamp, b timestamp"),
        "docs": spark.createDataFrame([("d1", "m1", D(2), None), ("d2", "m9", D(2), None), ("d3", "m2", D(6), D(8))], "id string, machine string, at timestamp, end timestamp"),
        "hits": spark.createDataFrame(hits, "hit long, doc string, at timestamp, key string, t string"),
    }


def test_direct_and_inherited(spark):
    hits = [(1, " D1 ", D(3), "k", "t"), (1, " D1 ", D(3), "k", "t"), (2, "d1", D(1), "", ""), (3, "d3", D(9), "", ""), (4, "nope", D(3), "", ""), (5, None, D(3), "", ""), (6, " ", D(3), "", ""), (7, "d2", D(3), "", ""), (8, "d3", None, "", ""), (9, "d3", D(8), "", ""), (10, "d3", D(6), "", "")]
    c = O.cascade(tables(spark, hits), PARENTS, EDGES)
    got = {(r.table_name, r.row, r.reason, r.depth) for r in c.collect()}
    assert got == {("docs", at("d2", 2), "missing", 0), ("hits", "2", "late", 0), ("hits", "3", "deleted", 0), ("hits", "4", "missing", 0), ("hits", "8", "deleted", 0), ("hits", "9", "deleted", 0), ("hits", "7", "inherited", 1)}
    rep = {(r.table_name, r.period, r.reason): (r.direct, r.inherited) for r in O.report(c).collect()}
    assert rep[("hits", "2025-01", "inherited")] == (0, 1) and rep[("hits", "2025-01", "deleted")] == (2, 0) and rep[("hits", None, "deleted")] == (1, 0)


def test_empty_tables(spark):
    t = tables(spark, [(1, "d1", D(3), "", "")])
    t["machines"] = t["machines"].limit(0)
    t["docs"] = t["docs"].limit(0)
    assert [(r.row, r.reason) for r in O.cascade(t, PARENTS, EDGES).collect()] == [("1", "missing")]
    assert O.cascade(tables(spark, []), PARENTS, EDGES[1:]).count() == 0


def test_hot_key(spark):
    hits = [(i, "d1" if i % 3 == 0 else f"x{i}", D(3), "", "") for i in range(3000)]
    assert O.cascade(tables(spark, hits), PARENTS, EDGES[1:]).count() == 2000


def test_chains_of_any_depth(spark):
    parts = [("p0", "none", D(2), None), *((f"p{i}", f"p{i - 1}", D(2), None) for i in range(1, 23)), ("c1", "c2", D(2), None), ("c2", "c1", D(2), None)]
    t = {"parts": spark.createDataFrame(parts, "id string, up string, at timestamp, end timestamp")}
    got = {r.row: r.depth for r in O.cascade(t, {"parts": O.Parent("id", "at", "end")}, [O.Edge("parts", "up", "id", "at", "parts")]).collect()}
    assert got == {at(f"p{i}", 2): i for i in range(23)}


def test_a_sound_life_is_not_blamed_for_an_orphaned_one(spark):
    t = tables(spark, [(1, "d1", D(3), "", ""), (2, "d1", D(13), "", ""), (3, "d1", D(7), "", "")])
    t["docs"] = spark.createDataFrame([("d1", "m9", D(2), D(8)), ("d1", "m1", D(6), D(9)), ("d1", "m2", D(12), None)], "id string, machine string, at timestamp, end timestamp")
    got = {(r.table_name, r.row, r.reason) for r in O.cascade(t, PARENTS, EDGES).collect()}
    # hit 1 falls into the orphaned life alone, hit 2 into a sound one, hit 3 into both
    assert got == {("docs", at("d1", 2), "missing"), ("hits", "1", "inherited")}
