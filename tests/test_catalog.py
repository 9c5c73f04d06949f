import datetime as dt

from pyspark.sql import functions as F

from tiltyard.functions import jsonshape, phonetic
from tiltyard.operators import catalog

T0 = dt.datetime(2025, 1, 1)


def test_sync(spark):
    ex = spark.createDataFrame([("machine", "G1-M1"), ("alias", "G1-M1-A1"), ("alias", "G9-M9-A1")], "kind string, id string")
    cur = spark.createDataFrame([("G1-M1",), ("G2-M2",), ("G2-M2",)], "id string")
    r = catalog.sync(ex, cur, "id")
    ids = lambda k: sorted(x.id for x in r[k].collect())
    assert ids("bases") == ["G1-M1"] and ids("editions") == ["G1-M1-A1"] and ids("orphans") == ["G9-M9-A1"] and ids("stale") == ["G2-M2"]
    assert catalog.sync(ex.limit(0), cur, "id")["stale"].count() == 0


def test_lookup_cascade(spark):
    m = spark.createDataFrame([("1", "Salt & Pepper", "Acme", 2000), ("2", "Moon Base", "Acme", None), ("3", "Moon Race", "Zed", 1990)], "id string, title string, maker string, year int")
    q = spark.createDataFrame([(1, "salt and pepper"), (2, "the Moon Base"), (3, "acme moon base"), (4, "moon landing"), (5, "zzz"), (6, None)], "q int, t string")
    got = {r.q: (r.id, r.stage) for r in catalog.find_title(q, "q", "t", m, "id", "title", "maker", F.col("year").isNotNull().cast("int")).collect()}
    assert got == {1: ("1", 0), 2: ("2", 1), 3: ("2", 0), 4: ("3", 2)}


def test_reconcile_backfill_coverage(spark):
    c = spark.createDataFrame([("a", "Star: Two", "m", "g1"), ("b", "Star", "m", "g2"), ("c", "Twin", "m", "g3"), ("d", "Twin", "m", "g4")], "id string, title string, maker string, g string")
    s = spark.createDataFrame([(1, "Star Two", "m"), (2, "Twin (LE)", "m"), (3, "Star", "x")], "r int, title string, maker string")
    got = {r.r: (r.g, r.how) for r in catalog.reconcile(s, c, "r", "title", "maker", "id", "g").collect()}
    assert got == {1: ("g1", "title"), 2: (None, "ambiguous")}
    b = catalog.backfill(spark.createDataFrame([("x", None, 1), ("x", "v", 2), ("y", "w", 1)], "k string, v string, o int"), spark.createDataFrame([("y",)], "k string"), "k", ["v"], "o").collect()
    assert [tuple(r) for r in b] == [("x", "v")]
    h = spark.createDataFrame([("m", 5, 3), ("n", 7, 30)], "c string, id int, rank int")
    p = {r.c: (r["sample"], r.state) for r in catalog.probe_coverage(h, spark.createDataFrame([("m",), ("n",), ("o",)], "c string"), ["c"], "id", "rank").collect()}
    assert p == {"m": (5, "covered"), "n": (7, "missed"), "o": (None, "gap")}


def test_boost_and_json(spark):
    d = spark.createDataFrame([(2.0, 6, T0, '{"TournamentId":1,"name":"x","deep":[{"datePublished":"2024"}]}'), (2.0, 0, None, "no json")], "s double, n int, at timestamp, j string")
    r = d.select(
        catalog.boost(F.col("s"), F.col("n"), F.col("at"), F.lit(T0)).alias("b"),
        jsonshape.shape_of(F.col("j"), [("t", ["tournamentId", "name"])]).alias("k"),
        jsonshape.find_key(F.col("j"), "datePublished").alias("d"),
        jsonshape.as_array(F.col("j"), "$.name").alias("a"),
        jsonshape.is_cron(F.lit("*/5 0-6 * * 1,3")).alias("c"),
        jsonshape.is_cron(F.lit("* * *")).alias("x"),
    ).collect()
    assert (r[0].b, r[0].k, r[0].d, r[0].a, r[0].c, r[0].x) == (5.0, "t", "2024", ["x"], True, False)
    assert (r[1].b, r[1].k, r[1].d, r[1].a) == (2.0, None, None, [])


def test_sound_keys():
    k = phonetic.sound_key
    assert k("night") == k("nite") and k("phantom") == k("fantom") and k("knock") == k("nock") and k("star") != k("moon") and k("") == ""
